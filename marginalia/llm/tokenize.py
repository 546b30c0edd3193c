"""Token ids of texts in Python workers, for byte-level BPE files of the tokenizers library.

The ids are those of the tokenizers library. Its merges are run by tiktoken, from the ranks in the same file, for every
text on which both agree by construction: characters whose class (letter, number, white space, other) hasn't changed
since Unicode 3.2, no added token, no run so long that tiktoken takes quadratic time. All other texts go to the tokenizers
library, cut at places where it cuts them anyway; their pieces are encoded once each, and remembered up to a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import cache, cached_property
from itertools import islice

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Pieces of text kept per worker.
CACHE = 100_000
#: The longest run of white space, or of other characters, that tiktoken gets.
LONGEST_RUN = 400

#: The characters with Unicode's White_Space property, which the tokenizer's pattern calls \s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of other characters with a space before it, or white space as the tokenizer's pattern splits it.
_PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Characters at which str.split() splits and the tokenizer's pattern doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Fixed value: how byte-level tokenizers split texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class PieceCache:
    """Encodes texts piece by piece. encode_pieces: ids of each of some pieces, which no merge crosses, as bytes."""

    def __init__(self, encode_pieces: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE) -> None:
        self.encode_pieces, self.limit = encode_pieces, limit
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as pieces, as little-endian unsigned 32-bit integers."""
        found = [list(map(self.known.get, pieces)) for pieces in texts]
        gaps = [[i for i, ids in enumerate(own) if ids is None] for own in found]
        missing = list({pieces[i] for pieces, at in zip(texts, gaps, strict=True) for i in at})
        if missing:
            extra = dict(zip(missing, self.encode_pieces(missing), strict=True))
            for pieces, own, at in zip(texts, found, gaps, strict=True):
                for i in at:
                    own[i] = extra[pieces[i]]
            # once full, the earliest stay: they are the most frequent
            self.known.update(islice(extra.items(), max(0, self.limit - len(self.known))))
        return [b"".join(own) for own in found]


def as_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _class(char: str, unicode: object) -> str:
    """What the tokenizer's pattern tells apart; empty for a character that isn't assigned."""
    category = unicode.category(char)
    if category == "Cn":
        return ""
    if re.match(f"[{_WS}]", char) or category[0] == "Z":
        return "Z"
    return category[0] if category[0] in "LN" else "other"


@cache
def unsettled() -> re.Pattern:
    """Matches characters about whose class two versions of Unicode may differ, and all beyond 16 bits."""
    settled = [(own := _class(chr(c), unicodedata)) != "" and own == _class(chr(c), unicodedata.ucd_3_2_0) for c in range(1 << 16)]
    edges = [c for c in range((1 << 16) + 1) if (c < 1 << 16 and settled[c]) != (c > 0 and settled[c - 1])]
    return re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]")


def is_plain(text: str) -> bool:
    """Whether tiktoken and the tokenizers library agree on a text without added tokens, and tiktoken is quick."""
    if not text.isascii() and unsettled().search(text) or any(c in text for c in _SEPARATORS):
        return False
    runs = list(map(len, text.split()))
    # white space that isn't the one character after a run makes up the longest run of it, at most
    return max(runs, default=0) < LONGEST_RUN and len(text) - sum(runs) - len(runs) < LONGEST_RUN - 1


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelEncoder:
    """A byte-level BPE tokenizer file of the tokenizers library, as encode(..., add_special_tokens=False) uses it."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without a normaliser is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must match as they are")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.cache = PieceCache(self._encode_pieces)
        self.quick = self._quick(model, set(added))

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded by the first text that needs it."""
        return Tokenizer.from_file(self.path)

    @staticmethod
    def _quick(model: dict, added: set[str]) -> tiktoken.Encoding | None:
        """The same merges in tiktoken; None if the ids aren't the merges' ranks."""
        vocab, bytes_of = model["vocab"], byte_characters()
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        n = len(bytes_of)
        if model.get("ignore_merges") or model.get("dropout") or any(vocab.get(a + b) != n + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [as_ids(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        """Pieces that the tokenizers library encodes apart: added tokens, and what its pattern cuts between them."""
        if self.added is None:
            return _PIECE.findall(text)
        return [p for i, part in enumerate(self.added.split(text)) for p in ([part] if i % 2 else _PIECE.findall(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; a null text has none."""
        out, rest = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.quick is None or not is_plain(text) or self.added is not None and self.added.search(text):
                rest.append(i)
            else:
                out[i] = self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        for i, ids in zip(rest, self.cache.encode([self._pieces(texts[i]) for i in rest]), strict=True):
            out[i] = ids
        return out


@cache
def byte_level(path: str) -> ByteLevelEncoder:
    """The worker's encoder for a tokenizer file."""
    return ByteLevelEncoder(path)


def default_byte_level_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
