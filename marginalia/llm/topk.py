"""Exact top-k by inner product over an impact-ordered index of quantised vectors.

Components are quantised to floor(scale * x), whole numbers that doubles hold exactly. The index holds blocks of
candidates; a block holds its postings (dimension, candidate, impact) in segments of descending impact: a segment has the
impacts whose size lies between two powers of four. A block of queries is scored segment by segment, and only over the
candidates and dimensions that have postings in it. After each, what the rest can add to a pair is at most the norm of the
query times the norm of the candidate's rest, and the sums so far are wrong by at most a known rounding error; a candidate
that stays under the k-th best score known by more than both can't be a member. Scoring stops once few enough pairs are
possible; these, and only these, are scored exactly in integers, of any size if need be. Pairs that tie with the k-th best
stay possible, so ties go by id.

Queries and candidates meet in a grid; a task handles a group of queries, as large as its memory bound allows, against a
share of the candidates' blocks, one after the other, and keeps k results per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise

#: Candidates of a block, and queries scored at once.
CANDIDATES, QUERIES = 2048, 2048
#: Bytes of the vectors of a group of queries. The index is sent to each group once.
GROUP_BYTES = 16 << 20
#: Shares of the candidates that are scored apart from each other.
SHARES = 16
#: Share of pairs that may be left for exact scoring before the last segment.
FEW = 0.05
#: Share of a segment's rectangle of candidates and dimensions from which on it is multiplied as a whole.
DENSE = 1 / 32

_INDEX = "share int, uids binary, ids binary, dims int, vectors binary, segments array<int>, posting_dims binary, posting_rows binary, impacts binary, rests array<binary>"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(uid, vec_id, vector): the vectors that take part, quantised, as little-endian doubles; uid tells rows apart. A null vector, or one with a null or not finite component (also after scaling), doesn't take part; one without components does."""
    x = F.expr(f"transform(`{vector_col}`, x -> cast(x AS double) * {scale!r}D)")
    whole = F.expr("forall(_x, y -> y IS NOT NULL AND NOT isnan(y) AND abs(y) < double('Infinity'))")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("_x")).where(whole)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col("_x").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.floor(np.array(v, "<f8")).tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), pa.array(blobs, pa.binary())], ["uid", "vec_id", "vector"])

    return rows.mapInArrow(run, "uid long, vec_id long, vector binary")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    dims = max(map(len, blobs)) // 8
    return np.frombuffer(b"".join(b.ljust(8 * dims, b"\0") for b in blobs), "<f8").reshape(len(blobs), dims)


def _segment_of(vectors: np.ndarray) -> np.ndarray:
    """The segment of each impact, 0 for none: sizes 1-3 are 1, 4-15 are 2, and so on."""
    return np.where(vectors == 0, 0, (np.frexp(vectors)[1] + 1) // 2).astype(np.int16)


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Upper bounds of the rows' norms: rounded up by more than the sum's error; infinite where squares don't fit."""
    with np.errstate(over="ignore"):
        return np.sqrt((vectors * vectors).sum(axis=1)) * (1 + 1e-9)


def index_block(share: int, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple:
    """A row of the index: postings by descending segment, and the norms of what each candidate has left after it."""
    vectors = vectors.astype("<f8")
    which = _segment_of(vectors)
    segments, dims, rows, impacts, rests = [], [], [], [], []
    for segment in np.unique(which[which > 0])[::-1]:
        d, r = np.nonzero(which.T == segment)
        segments.append(len(d))
        dims.append(d.astype("<u4"))
        rows.append(r.astype("<u2"))
        impacts.append(vectors[r, d])
        rests.append(_norms(np.where(which < segment, vectors, 0)).tobytes())
    join = lambda parts: np.concatenate(parts).tobytes() if parts else b""
    return share, uids.tobytes(), ids.tobytes(), vectors.shape[1], vectors.tobytes(), segments, join(dims), join(rows), join(impacts), rests


def _accumulate(partial: np.ndarray, queries: np.ndarray, dims: np.ndarray, rows: np.ndarray, impacts: np.ndarray) -> None:
    """Adds a segment's postings to the scores, over the candidates and dimensions that it has."""
    own_dims, d = np.unique(dims, return_inverse=True)
    own_rows, r = np.unique(rows, return_inverse=True)
    with np.errstate(over="ignore", invalid="ignore"):
        if len(impacts) >= DENSE * len(own_dims) * len(own_rows):
            segment = np.zeros((len(own_dims), len(own_rows)))
            segment[d, r] = impacts
            partial[:, own_rows] += queries[:, own_dims] @ segment
            return
        for i, dim in enumerate(own_dims):
            at = d == i
            partial[:, rows[at]] += queries[:, dim : dim + 1] * impacts[at]


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, as 64-bit integers, or as Python's if they might not fit."""
    with np.errstate(over="ignore"):
        largest = (np.abs(queries).max(axis=1, initial=0) * np.abs(vectors).max(axis=1, initial=0) * max(1, queries.shape[1])).max(initial=0)
    if largest < 2.0**62 and np.abs(queries).max(initial=0) < 2.0**62 and np.abs(vectors).max(initial=0) < 2.0**62:
        return (queries.astype(np.int64) * vectors.astype(np.int64)).sum(axis=1)
    out = np.empty(len(queries), object)
    out[:] = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for q, v in zip(queries.tolist(), vectors.tolist(), strict=True)]
    return out


class TopK:
    """The k best candidates so far of each query of a block."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.uids, self.ids, self.vectors, self.k = uids, ids, vectors.astype(float), k
        self.norms = _norms(self.vectors)
        self.worst = np.full(len(ids), -np.inf)
        self.rows = self.members = self.scores = np.zeros(0, np.int64)
        #: Pairs scored exactly, and pairs seen: how much the index saves.
        self.exact = self.seen = 0

    def add(self, block: dict) -> None:
        """A block of the index as a dict. Comparisons are such that what isn't a number rules nothing out."""
        uids, ids = np.frombuffer(block["uids"], "<i8"), np.frombuffer(block["ids"], "<i8")
        vectors = np.frombuffer(block["vectors"], "<f8").reshape(len(ids), block["dims"])
        shared = min(block["dims"], self.vectors.shape[1])
        dims, rows = np.frombuffer(block["posting_dims"], "<u4"), np.frombuffer(block["posting_rows"], "<u2")
        impacts = np.frombuffer(block["impacts"], "<f8")
        partial = np.zeros((len(self.ids), len(ids)))
        own = self.uids[:, None] == uids
        possible, start = ~own, 0
        with np.errstate(over="ignore", invalid="ignore"):
            # any order of at most so many additions and products errs by less
            rounding = (shared + len(block["segments"]) + 8) * 2.0**-52 * self.norms[:, None] * _norms(vectors)
            for i, n in enumerate(block["segments"]):
                at = slice(start, start + n)
                known = dims[at] < shared
                _accumulate(partial, self.vectors, dims[at][known], rows[at][known], impacts[at][known])
                start += n
                most = self.norms[:, None] * np.frombuffer(block["rests"][i], float) * (1 + 1e-9) + rounding
                floor = self.worst
                if len(ids) > self.k:  # k candidates have at least this much
                    low = np.where(own, -np.inf, np.nan_to_num(partial - most, nan=-np.inf, posinf=-np.inf, neginf=-np.inf))
                    floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
                possible = ~own & ~(partial + most < floor[:, None])
                if possible.sum() <= FEW * possible.size:
                    break
        found, cols = np.nonzero(possible)
        self.seen += possible.size
        self.exact += len(found)
        scores = [exact_scores(self.vectors[found[i : i + 65536], :shared], vectors[cols[i : i + 65536], :shared]) for i in range(0, len(found), 65536)]
        self._keep(np.concatenate((self.rows, found)), np.concatenate((self.members, ids[cols])), np.concatenate((self.scores, *scores)))

    def _keep(self, rows: np.ndarray, members: np.ndarray, scores: np.ndarray) -> None:
        if scores.dtype == object:
            order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], members[i])), np.int64)
        else:
            order = np.lexsort((members, -scores, rows))
        rows, members, scores = rows[order], members[order], scores[order]
        starts = np.searchsorted(rows, np.arange(len(self.ids)))
        rank = np.arange(len(rows)) - starts[rows]
        best = rank < self.k
        self.rows, self.members, self.scores = rows[best], members[best], scores[best]
        last = np.flatnonzero(rank == self.k - 1)
        # a double under the score: no candidate that ties is ruled out
        self.worst[rows[last]] = [np.nextafter(float(x), -np.inf) if abs(x) < 1 << 1000 else -np.inf for x in scores[last].tolist()]

    def result(self) -> pa.RecordBatch:
        """Scores beyond 64 bits are cut to them; `beyond` orders those."""
        scores = [int(x) for x in self.scores.tolist()]
        cut = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores]
        arrays = [pa.array(self.uids[self.rows]), pa.array(self.ids[self.rows]), pa.array(self.members), pa.array(cut, pa.int64()), pa.array([ordered(x) if abs(x) >= 1 << 62 else None for x in scores], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["uid", "query_id", "vec_id", "score", "beyond"])


def ordered(x: int) -> bytes:
    """Bytes that sort as integers do."""
    size = (abs(x).bit_length() + 7) // 8
    digits = size.to_bytes(2, "big") + abs(x).to_bytes(size, "big")
    return b"\1" + digits if x >= 0 else b"\0" + bytes(255 - d for d in digits)


def build_index(vectors: DataFrame, shares: int = SHARES) -> DataFrame:
    """The index of stored quantised(vectors), without a shuffle. Blocks are dealt to the shares in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                uids, ids = np.asarray(part.column("uid")), np.asarray(part.column("vec_id"))
                row = index_block(turn % shares, uids, ids, _matrix(part.column("vector").to_pylist()))
                turn += 1
                types = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
                names = [x.split()[0] for x in _INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    return vectors.mapInArrow(run, _INDEX)


def search(vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shares: int = SHARES) -> DataFrame:
    """The k best candidates of each query by the inner product of the quantised vectors.

    queries: an SQL condition on vec_id. A query's candidates are all other rows that take part, also such with its id.
    Returns (query_id, rank, vec_id, score); ties go to the smaller vec_id; fewer than k rows if there are fewer
    candidates. Scores are exact; one beyond 64 bits is cut to them but ranked as it is. A repeated row with a query's id
    is a query of its own. Vectors of different lengths are compared as if filled with zeros, an empty one scores 0 with
    all. Rows with a null id don't take part; other columns are ignored; an empty table gives none.
    """
    stored = materialise(quantised(vectors, id_col, vector_col, scale), "vectors")
    chosen = stored.where(queries.replace(id_col, "vec_id"))
    size = chosen.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("vector")), F.lit(0)).alias("longest")).first()
    n_groups = max(1, ceil(size.n / max(QUERIES // 8, GROUP_BYTES // max(8, size.longest))))
    asked = chosen.withColumn("query_block", F.pmod(F.xxhash64("uid"), F.lit(n_groups)).cast("int"))
    fields = "query_block int, share int, part int, uids binary, ids binary, dims int, vectors binary, segments array<int>, posting_dims binary, posting_rows binary, impacts binary, rests array<binary>"
    names = [x.split()[0] for x in fields.split(", ")]

    def pack(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("vector").to_pylist())
        uids, ids = (np.asarray(table.column(c).combine_chunks()).astype("<i8") for c in ("uid", "vec_id"))
        return pa.table({"query_block": pa.array([table.column("query_block")[0].as_py()], pa.int32()), "uids": [uids.tobytes()], "ids": [ids.tobytes()], "dims": pa.array([vectors.shape[1]], pa.int32()), "vectors": [vectors.tobytes()]})

    packed = asked.groupBy("query_block").applyInArrow(pack, "query_block int, uids binary, ids binary, dims int, vectors binary")
    nothing = {"segments": F.array().cast("array<int>"), "posting_dims": F.lit(None).cast("binary"), "posting_rows": F.lit(None).cast("binary"), "impacts": F.lit(None).cast("binary"), "rests": F.array().cast("array<binary>")}
    query_side = packed.withColumns({"share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1))), "part": F.lit(0), **nothing})
    index = build_index(stored, shares)
    candidate_side = index.withColumns({"query_block": F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))), "part": F.lit(1)})
    grid = query_side.select(names).unionAll(candidate_side.select(names))
    placed = grid.repartition(min(4096, n_groups * shares), "query_block", "share").sortWithinPartitions("query_block", "share", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[TopK] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in names}
                if row["part"] == 0:
                    yield from (b.result() for b in best)
                    uids, ids, own = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8")
                    own = own.reshape(len(ids), row["dims"])
                    best = [TopK(uids[a : a + QUERIES], ids[a : a + QUERIES], own[a : a + QUERIES], k) for a in range(0, len(ids), QUERIES)]
                for b in best if row["part"] else ():
                    b.add(row)
        yield from (b.result() for b in best)

    found = placed.mapInArrow(run, "uid long, query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query over `embeddings` for DuckDB.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored) WHERE rank <= 20
"""
