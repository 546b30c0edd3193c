"""Packed matrices of token ids by best-fit decreasing.

Documents are cut losslessly into pieces of at most a row's length. Each block of pieces is packed by descending length:
a piece goes into the row with the least room that holds it, which a segment tree over the amounts of room finds in
logarithmic time. Rows carry their ids, padded, the cumulative lengths of their segments, and positions that start again
at every segment.
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

#: Tokens of the pieces that are packed together; bounds a task's memory.
BLOCK_TOKENS = 4 << 20

_SCHEMA = "row_id long, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


class RoomTree:
    """Rows by their room: a segment tree whose leaf r says whether a row has r tokens of room."""

    def __init__(self, size: int) -> None:
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.width + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a row with the least room of at least `need`; (room, row)."""
        node = self.width + need
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node *= 2
                if not self.any[node]:
                    node += 1
        room = node - self.width
        row = self.rows[room].pop()
        while node and not (self.rows[room] if node >= self.width else self.any[2 * node] or self.any[2 * node + 1]):
            self.any[node] = 0
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of the pieces in each row; a piece longer than a row is an error."""
    tree, rows = RoomTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room, row = tree.take(lengths[i]) or (size, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def pack_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = 2048, end_id: int = 50256, pad_id: int = 50256) -> DataFrame:
    """Rows of `size` token ids, without a shuffle.

    Returns (row_id, ids, position_ids, cu_seqlens, doc_ids, starts): ids and position_ids as little-endian unsigned
    32-bit integers, `size` of them (padding has pad_id and position 0); cu_seqlens from 0 to the tokens in use; for each
    segment its document and the document's tokens before it. A document is its ids and end_id. A null text is an empty
    one, a text of any length is kept whole; null and repeated ids are kept as they are; other columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or default_byte_level_path()
    end = np.array([end_id], "<u4").tobytes()

    def block(first_row: int, pieces: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(p[2]) // 4 for p in pieces], size)
        ids, positions, lengths, owners, starts = [], [], [], [], []
        for row in rows:
            parts = [pieces[i] for i in row]
            sizes = [len(p[2]) // 4 for p in parts]
            padding = size - sum(sizes)
            ids.append(b"".join(p[2] for p in parts) + np.full(padding, pad_id, "<u4").tobytes())
            positions.append(np.concatenate([*(np.arange(n, dtype="<u4") for n in sizes), np.zeros(padding, "<u4")]).tobytes())
            lengths.append(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            owners.append([p[0] for p in parts])
            starts.append([p[1] for p in parts])
        arrays = [pa.array(range(first_row, first_row + len(rows)), pa.int64()), pa.array(ids, pa.binary()), pa.array(positions, pa.binary()), pa.array(lengths, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row, pieces, tokens = TaskContext.get().partitionId() << 32, [], 0
        for batch in chunks(batches, "text"):
            encoded = byte_level(path).encode(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                pieces += [(doc, at // 4, ids[at : at + 4 * size]) for at in range(0, len(ids), 4 * size)]
                tokens += len(ids) // 4
            if tokens >= BLOCK_TOKENS:
                out = block(next_row, pieces)
                next_row, pieces, tokens = next_row + out.num_rows, [], 0
                yield out
        if pieces:
            yield block(next_row, pieces)

    return text_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, _SCHEMA)


def digest(rows: DataFrame) -> DataFrame:
    """Per segment: its document, place and length, and the row it lies in with the CRC-32 of the row's ids and positions."""
    flat = rows.select("row_id", F.crc32("ids").alias("row_crc32"), F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("i", "piece"))
    return flat.select(F.col("piece.doc_ids").alias("doc_id"), F.col("piece.starts").alias("start"), (F.expr("cu_seqlens[i + 1]") - F.expr("cu_seqlens[i]")).cast("long").alias("length"), "row_id", F.expr("cu_seqlens[i]").cast("long").alias("offset"), "row_crc32", "positions_crc32")


def write_matrices(rows: DataFrame, path: str) -> None:
    """Writes the rows as Parquet files: one binary row of a matrix each, with its segments."""
    rows.write.option("compression", "zstd").parquet(path)


def read_matrices(spark, path: str) -> DataFrame:
    """Rows written by write_matrices."""
    return spark.read.schema(_SCHEMA).parquet(path)
