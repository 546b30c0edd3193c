"""SentencePiece models encoded and decoded by the tokenizers library.

The model's protobuf is read field by field; from it the normaliser, the white-space marker, the scores or merges and the
byte fallback are rebuilt. Texts are cut into units wherever no piece of the vocabulary has the two characters in a row, so
that no piece crosses a unit's ends. Each different unit is encoded once per worker, in batches that the library may spread
over threads, and compared with the reference library (parity); a row says how many of its units were compared and how
many differ. Units are found and looked up as arrays of hashes, without an object per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from marginalia.llm.shared import chunks, text_rows
from marginalia.llm.tokenize import as_ids
from marginalia.llm.words import run_hashes

MARKER = "▁"
#: Characters encoded at once, ids decoded at once, and units kept per worker (about 40 bytes each).
BLOCK, DECODED, KNOWN = 1 << 20, 1 << 18, 300_000
#: Characters in which the end of a unit is looked for at once.
WINDOW = 1 << 12
#: Kinds of pieces and of models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: an integer, or the bytes of a string, message, float or double."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class SentencePieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    suffix: bool

    @classmethod
    def parse(cls, data: bytes) -> SentencePieceModel:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]
                pieces.append((piece.get(1, b"").decode(), float(score), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(trainer.get(24, 0)))

    @cached_property
    def ids(self) -> dict[str, int]:
        return {piece: i for i, (piece, _, _) in enumerate(self.pieces)}

    @cached_property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Classes of characters by code (0 for the last entry and all beyond), and whether two classes in a row may belong to one piece."""
        longer = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED) and len(p) > 1]
        chars = sorted(set("".join(longer)))
        classes = np.zeros(ord(chars[-1]) + 2 if chars else 1, np.int32)
        classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        together[0, 0] = not self.byte_fallback  # unknown characters in a row are one piece
        for p in longer:
            own = classes[[ord(c) for c in p]]
            together[own[:-1], own[1:]] = True
        return classes, together

    def joined(self, codes: np.ndarray) -> np.ndarray:
        """For each character of a text but the first whether a piece may hold it together with the one before."""
        classes, together = self.neighbours
        own = classes[np.minimum(codes, len(classes) - 1)]
        return together[own[:-1], own[1:]]

    def tokenizer(self) -> Tokenizer:
        """The model in the tokenizers library, for normalised texts."""
        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback))
        if self.kind != BPE:
            raise ValueError(f"model type {self.kind} isn't supported")
        merges = []
        usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        for piece, _, kind in sorted((p for p in self.pieces if p[2] == NORMAL), key=lambda p: -p[1]):
            merges += [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
        return Tokenizer(models.BPE(self.ids, merges, unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    @cached_property
    def normalizer(self) -> normalizers.Normalizer | None:
        return normalizers.Precompiled(self.charsmap) if self.charsmap else None

    def normalise(self, text: str) -> str:
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if self.remove_extra:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = text.replace(" ", MARKER)
        if self.dummy_prefix:
            text = text + MARKER if self.suffix else MARKER + text
        return text

    @cached_property
    def _bytes_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What pieces say, in a row, and where each one's bytes begin and end."""
        value = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        parts = [value.get(kind, lambda p: p.replace(MARKER, " ").encode())(p) for p, _, kind in self.pieces]
        ends = np.cumsum([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], ends[:-1])), ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: bytes in a row are read as UTF-8, control pieces say nothing, the added prefix is taken off."""
        said, begins, ends = self._bytes_of
        raw = []
        for at in range(0, len(ids), DECODED):
            own = ids[at : at + DECODED]
            sizes = ends[own] - begins[own]
            before = np.cumsum(sizes) - sizes
            raw.append(said[np.repeat(begins[own] - before, sizes) + np.arange(sizes.sum())].tobytes())
        text = b"".join(raw).decode(errors="replace")
        return text[1:] if self.dummy_prefix and not self.suffix and text.startswith(" ") else text


class Units:
    """Known units by two independent hashes of 64 bits: their ids, and whether the libraries differ. New ones wait in a second, smaller table."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.ids = np.zeros(0, "<u4")
        self.tables = [self._empty(), self._empty()]

    @staticmethod
    def _empty() -> tuple[np.ndarray, ...]:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32, bool))

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether units are known, and of those that are: place and number of their ids, and whether the libraries differ."""
        known, places, sizes, differ = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        for own_keys, own_checks, *values in self.tables:
            if len(own_keys):
                at = np.minimum(np.searchsorted(own_keys, keys), len(own_keys) - 1)
                hit = (own_keys[at] == keys) & (own_checks[at] == checks)
                known |= hit
                for out, own in zip((places, sizes, differ), values, strict=True):
                    out[hit] = own[at[hit]]
        return known, places, sizes, differ

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray, differ: np.ndarray) -> None:
        """Keeps new units as long as there is room: the earliest are the most frequent."""
        room = max(0, self.limit - len(self))
        places = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
        new = tuple(x[:room] for x in (keys, checks, places, sizes, differ))
        self.ids = np.concatenate((self.ids, ids[: sizes[:room].sum()]))
        large, small = self.tables
        small = self._merged(small, new)
        if 8 * len(small[0]) > len(large[0]):
            large, small = self._merged(large, small), self._empty()
        self.tables = [large, small]

    @staticmethod
    def _merged(*tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*tables, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)


class Encoder:
    """A worker's encoder for one model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.model = SentencePieceModel.parse(data)
        self.tokenizer = self.model.tokenizer()
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.units = Units(KNOWN)
        #: A unit can be handed to the reference library by itself, after a line end that no piece has next to anything else.
        plain = not self.model.charsmap and not self.model.remove_extra and self.model.byte_fallback
        self.by_unit = plain and not any(len(p) > 1 and "\n" in p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED))
        self.before = len(self.other.encode("\n")) if self.by_unit else 0

    def _encode_units(self, units: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of units, and where the reference library has others."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        if not self.by_unit:
            return own, [False] * len(own)
        theirs = self.other.encode(["\n" + u.replace(MARKER, " ") for u in units], num_threads=1)
        return own, [ids != other[self.before :] for ids, other in zip(own, theirs, strict=True)]

    def _encode_block(self, parts: list[str]) -> list[tuple[bytes, int, int]]:
        """Ids, units and differing units of normalised parts of texts; no unit crosses the ends of a part."""
        whole = "".join(parts)
        if not whole:
            return [(b"", 0, 0)] * len(parts)
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        cut = np.concatenate(([True], ~self.model.joined(codes)))
        bounds = np.cumsum([0, *map(len, parts)])
        cut[bounds[:-1][bounds[:-1] < len(codes)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))
        first, second = run_hashes(codes, starts, ends)
        keys, at, which = np.unique(first, return_index=True, return_inverse=True)
        checks = second[at]
        clash = bool((second != checks[which]).any())
        if clash:  # two units share the first hash, which hardly ever happens: each is looked up, and none is kept
            at = which = np.arange(len(starts))
            keys, checks = first, second
        known, places, sizes, differ = self.units.find(keys, checks)
        table = self.units.ids
        if len(new := np.flatnonzero(~known)):
            found, other = self._encode_units([whole[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            sizes[new], differ[new] = list(map(len, found)), other
            ids = np.fromiter((i for own in found for i in own), "<u4", int(sizes[new].sum()))
            places[new] = len(table) + np.cumsum(sizes[new], dtype=np.int64) - sizes[new]
            table = np.concatenate((table, ids))
            if not clash:
                self.units.add(keys[new], checks[new], ids, sizes[new], differ[new])
        counts = sizes[which]
        total = np.cumsum(counts, dtype=np.int64)
        flat = table[np.repeat(places[which] - (total - counts), counts) + np.arange(total[-1])]
        of_part = np.searchsorted(starts, bounds)
        id_bounds = np.concatenate(([0], total))[of_part].tolist()
        wrong = np.concatenate(([0], np.cumsum(differ[which])))[of_part]
        return [(flat[a:b].tobytes(), int(n), int(d)) for a, b, n, d in zip(id_bounds[:-1], id_bounds[1:], np.diff(of_part), np.diff(wrong), strict=True)]

    def _parts(self, text: str) -> Iterator[str]:
        """A normalised text in parts of about BLOCK characters, between units."""
        at = 0
        while len(text) - at > BLOCK:
            stop, apart = at + BLOCK, ()
            while stop < len(text) and not len(apart):
                codes = np.frombuffer(text[stop - 1 : stop + WINDOW].encode("utf-32-le"), "<u4")
                apart = np.flatnonzero(~self.model.joined(codes))
                stop = min(len(text), stop + (int(apart[0]) if len(apart) else WINDOW))
            yield text[at:stop]
            at = stop
        yield text[at:]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int, int]]:
        """For each text its ids, the units that were compared with the reference library, and how many of them differ. Where units can't be compared by themselves, a text is one."""
        found: list[list[tuple[bytes, int, int]]] = [[] for _ in texts]
        block: list[tuple[int, str]] = []

        def flush() -> None:
            for (i, _), own in zip(block, self._encode_block([p for _, p in block]), strict=True):
                found[i].append(own)
            block.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in self._parts(self.model.normalise(text)) if text else ():
                if block and size + len(part) > BLOCK:
                    flush()
                    size = 0
                block.append((i, part))
                size += len(part)
        flush()
        out = [(b"".join(ids for ids, _, _ in own), sum(n for _, n, _ in own), sum(d for _, _, d in own)) for own in found]
        if self.by_unit:
            return out
        theirs = self.other.encode([x or "" for x in texts], num_threads=1)
        return [(ids, int(bool(text)), int(ids != as_ids(other))) for text, (ids, _, _), other in zip(texts, out, theirs, strict=True)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_compared, n_differed): ids as little-endian unsigned 32-bit integers, without begin and end marks; one row per row of docs, without a shuffle.

    n_compared, n_differed: units of the row's text, all of which are compared with the reference library, and those for
    which it has other ids. They belong to the text alone. A null or empty text has no ids and no units; a text of any
    length is encoded in blocks. Other columns are ignored, null and repeated ids are rows like others; an empty table
    gives no rows. model: a file that every node has.
    """
    return _mapped(docs, id_col, text_col, model, False)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """encode, and `text`: the ids decoded again, by the same worker."""
    return _mapped(docs, id_col, text_col, model, True)


def _mapped(docs: DataFrame, id_col: str, text_col: str, model: str | None, back: bool) -> DataFrame:
    path = model or default_path()
    names = ["doc_id", "ids", "n_compared", "n_differed", *["text"] * back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in chunks(batches, "text", BLOCK):
            ids, compared, differed = zip(*own.encode(batch.column("text").to_pylist()), strict=True)
            texts = [pa.array([own.model.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(compared, pa.int64()), pa.array(differed, pa.int64()), *texts], names)

    schema = "doc_id long, ids binary, n_compared long, n_differed long" + ", text string" * back
    return text_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


@cache
def decoder(path: str) -> SentencePieceModel:
    with open(path, "rb") as f:
        return SentencePieceModel.parse(f.read())


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) for rows of (doc_id, ids); null ids are none."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in chunks(batches, "ids"):
            texts = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return text_rows(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, ids binary, text string")


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, n_compared, n_differed) of documents, encoded and decoded again."""
    back = round_trip(docs, model=model)
    text = F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), text, "n_compared", "n_differed")
