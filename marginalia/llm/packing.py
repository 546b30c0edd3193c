"""Packing of documents into sequences of tokens, online and in bounded space.

Every partition keeps a fixed number of open windows. A document's full windows leave at once; what remains is placed
into the open window with the least room that holds it. If none does, the fullest one is topped up with the
remainder's head and leaves full. What is open at a partition's end is merged there; what is then still short of a window
is cut at powers of two, which need no padding. So nothing is shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import chunks, text_rows
from marginalia.llm.tokenize import byte_level, default_byte_level_path

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Piece:
    """Part of a document: its ids from `start` on."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id: int | None, doc_tokens: int, start: int, ids: bytes) -> None:
        self.doc_id, self.doc_tokens, self.start, self.ids = doc_id, doc_tokens, start, ids

    def __len__(self) -> int:
        return len(self.ids) >> 2

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.doc_tokens, self.start, self.ids[: 4 * n]),
            Piece(self.doc_id, self.doc_tokens, self.start + n, self.ids[4 * n :]),
        )


class Rows:
    """Collects rows of the result; a sequence is a list of pieces."""

    def __init__(self, first_sequence: int) -> None:
        self.next_sequence = first_sequence
        self.rows: list[tuple] = []

    def add(self, sequence: list[Piece]) -> None:
        offset = 0
        for piece in sequence:
            self.rows.append((piece.doc_id, piece.start, len(piece), piece.ids, piece.doc_tokens, self.next_sequence, offset))
            offset += len(piece)
        self.next_sequence += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        long = pa.int64()
        types = [long, long, long, pa.binary(), long, long, long]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class OpenWindows:
    """At most `n_open` windows of `size` tokens that aren't full."""

    def __init__(self, rows: Rows, size: int, n_open: int) -> None:
        self.rows, self.size, self.n_open = rows, size, n_open
        self.windows: list[list[Piece]] = []
        self.fill: list[int] = []

    def place(self, piece: Piece) -> None:
        while len(piece) >= self.size:
            head, piece = piece.cut(self.size)
            self.rows.add([head])
        if not len(piece):
            return
        rooms = [(self.size - f, i) for i, f in enumerate(self.fill) if self.size - f >= len(piece)]
        if not rooms and len(self.windows) == self.n_open:
            fullest = max(range(len(self.fill)), key=self.fill.__getitem__)
            head, piece = piece.cut(self.size - self.fill[fullest])
            self._put(fullest, head)
            rooms = [(self.size - f, i) for i, f in enumerate(self.fill) if self.size - f >= len(piece)]
        if not rooms:
            self.windows.append([])
            self.fill.append(0)
            rooms = [(self.size, len(self.windows) - 1)]
        self._put(min(rooms)[1], piece)

    def _put(self, i: int, piece: Piece) -> None:
        self.windows[i].append(piece)
        self.fill[i] += len(piece)
        if self.fill[i] == self.size:
            self.rows.add(self.windows.pop(i))
            self.fill.pop(i)

    def merge(self) -> list[Piece]:
        """Merges the open windows, fullest first; returns the pieces that don't make a full one."""
        order = sorted(range(len(self.windows)), key=lambda i: -self.fill[i])
        return fill_up(self.rows, [p for i in order for p in self.windows[i]], self.size)


def fill_up(rows: Rows, pieces: list[Piece], size: int) -> list[Piece]:
    """Adds full sequences of the pieces in a row; returns what is left, shorter than one."""
    now, room = [], size
    for piece in pieces:
        while len(piece) >= room:
            head, piece = piece.cut(room)
            rows.add([*now, head])
            now, room = [], size
        if len(piece):
            now.append(piece)
            room -= len(piece)
    return now


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = 1024, n_open: int = 32, end_id: int = 0) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens.

    A document is its token ids and then end_id; it is cut freely, and each id lies in exactly one piece. Returns one row
    per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit
    integers. Every sequence is full or has a power of two of tokens, and few of each partition aren't full. A null text is an empty one (its only token is
    end_id), a text of any length is packed whole, null and repeated ids are kept as they are, other columns are ignored; an
    empty table gives no rows.
    tokenizer: a file of the tokenizers library that every node has.
    """
    path = tokenizer or default_byte_level_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = Rows(part << 32)
        windows = OpenWindows(rows, size, n_open)
        for batch in chunks(batches, "text"):
            encoded = byte_level(path).encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                windows.place(Piece(doc_id, len(ids) // 4 + 1, 0, ids + end))
            yield rows.take()
        left = windows.merge()
        rest = sum(map(len, left))
        while rest:  # the binary digits of the rest, largest first
            power = 1 << (rest.bit_length() - 1)
            rest -= power
            left = _take(rows, left, power)
        yield rows.take()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text_rows(columns).mapInArrow(run, _SCHEMA)


def _take(rows: Rows, pieces: list[Piece], n: int) -> list[Piece]:
    """Adds a sequence of the first n tokens; returns the rest."""
    taken = []
    for i, piece in enumerate(pieces):
        if len(piece) > n:
            head, tail = piece.cut(n)
            rows.add([*taken, head] if n else taken)
            return [tail, *pieces[i + 1 :]]
        taken.append(piece)
        n -= len(piece)
        if not n:
            rows.add(taken)
            return pieces[i + 1 :]
    return []


def with_digest(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
