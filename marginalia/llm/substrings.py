"""Substring deduplication with a log-structured index of fingerprints.

A window is WINDOW consecutive words. Each window is represented by the GRAM consecutive words in it with the smallest
hash (its anchor), so equal windows have equal anchors and neighbouring windows mostly share one. The index has two
levels, each a set of immutable runs, sorted by hash and divided into buckets of hash ranges:

* anchors: hash, the first document that has it, and whether a second one does;
* windows: digests of the words of those windows whose anchor more than one document has, with the first document.

A batch is merge-joined with the anchors' runs. Documents in which a shared anchor occurs (also earlier ones, if until
now they had it alone) are read again, and their windows at such anchors are verified: a 96-bit digest of the words
themselves is merge-joined with the windows' runs. A window whose digest an earlier document has is a repeat. The batch's
own anchors and windows become new runs; compaction merges runs once there are more than `fanout`.

Hashes travel in blocks, one for each piece of the input and bucket. Within a piece each hash stands once with its first
document, so that a passage which a third of all documents share makes no hot bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import compress
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.shared import as_bytes, chunks, materialise, new_path, partitions, release, remove, text_rows, unused, unzipped, zipped
from marginalia.llm.words import first_minimum, rolling, word_hashes

WINDOW, GRAM = 13, 6
#: Bytes of text that make one piece of the input, and bytes for each of which the index has a bucket.
PIECE, BUCKET_BYTES = 4 << 20, 8 << 20

_BLOCK = "bucket int, kind int, keys binary, more binary, docs binary, places binary"
_NAMES = ["bucket", "kind", "keys", "more", "docs", "places"]
_ENTRIES, _REPLIES, _RUN = 0, 1, 2


def encode(x: np.ndarray) -> bytes:
    """Byte planes of integers: high planes compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def decode(data: bytes | None, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(data or b"", np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def anchors(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of each window of a text."""
    grams = rolling(word_hashes(text), GRAM)
    at = first_minimum(grams, WINDOW - GRAM + 1)
    return grams[at], at


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash: buckets of sorted keys are sorted too."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    """Buckets of documents. Each bucket of hashes has a row for each of them, so there are fewer where there are many: rows grow with n * sqrt(n), not with its square."""
    return _bucket(docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), min(n, 16 * isqrt(n)))


class Blocks:
    """Rows of the block schema."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, kind: int, bucket: np.ndarray, keys: np.ndarray, more: np.ndarray, docs: np.ndarray, places: np.ndarray) -> None:
        if not len(bucket):
            return
        order = np.argsort(bucket, kind="stable")
        bucket, keys, more, docs, places = (x[order] for x in (bucket, keys, more, docs, places))
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
            self.rows.append((int(bucket[a]), kind, *(encode(x[a:b]) for x in (keys, more, docs, places))))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 6
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], _NAMES)


def _gather(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of one kind in a bucket, in a row."""
    rows = table.filter(pc.equal(table.column("kind"), kind))
    parts = [[decode(x.as_py(), t) for x in rows.column(c)] for c, t in zip(_NAMES[2:], ("u8", "u4", "i8", "u4"), strict=True)]
    return tuple(np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, ("u8", "u4", "i8", "u4"), strict=True))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change: the first index of each group."""
    changed = np.zeros(len(keys[0]), bool)
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    changed[:1] = True
    return np.flatnonzero(changed)


def _merge_anchors(table: pa.Table, n_buckets: int) -> pa.Table:
    """One bucket of anchors: the batch's entries against the runs. `more` is 1 if another document has the anchor too."""
    out = Blocks()
    bucket = table.column("bucket")[0].as_py()
    keys, more, docs, _ = _gather(table, _ENTRIES)
    run_keys, run_more, run_docs, _ = _gather(table, _RUN)
    passed = _gather(table, _REPLIES)
    order = np.lexsort((docs, keys))
    keys, more, docs = keys[order], more[order], docs[order]
    if len(keys):
        starts = _groups(keys)
        unique, first = keys[starts], docs[starts]
        last = docs[np.append(starts[1:], len(docs)) - 1]
        shared = (first != last) | (np.maximum.reduceat(more, starts) > 0)
        at = np.minimum(np.searchsorted(unique, run_keys), len(unique) - 1)
        hit = np.flatnonzero(unique[at] == run_keys)
        at = at[hit]
        np.logical_or.at(shared, at, (run_more[hit] > 0) | (run_docs[hit] != first[at]) | (first[at] != last[at]))
        late = hit[(run_more[hit] == 0) & shared[at]]
        answered = shared[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))]
        reply_keys, reply_docs = np.concatenate((keys[answered], run_keys[late])), np.concatenate((docs[answered], run_docs[late]))
        out.add(_RUN, np.full(len(unique), bucket), unique, shared.astype(np.uint32), first, np.zeros(len(unique), np.uint32))
    else:
        reply_keys, reply_docs = keys, docs
    reply_keys, reply_docs = np.concatenate((reply_keys, passed[0])), np.concatenate((reply_docs, passed[2]))
    none = np.zeros(len(reply_docs), np.uint32)
    out.add(_REPLIES, _doc_bucket(reply_docs, n_buckets), np.zeros(len(none), np.uint64), none, reply_docs, reply_keys.astype(np.uint32))
    return pa.Table.from_batches([out.take()])


def _merge_windows(table: pa.Table, n_buckets: int) -> pa.Table:
    """One bucket of digests: the batch's entries and the runs. Replies are the places of windows that an earlier document has."""
    out = Blocks()
    bucket = table.column("bucket")[0].as_py()
    new, old, passed = _gather(table, _ENTRIES), _gather(table, _RUN), _gather(table, _REPLIES)
    is_new = np.concatenate((np.ones(len(new[0]), bool), np.zeros(len(old[0]), bool)))
    keys, more, docs, places = (np.concatenate(x) for x in zip(new, old, strict=True))
    order = np.lexsort((docs, more, keys))
    keys, more, docs, places, is_new = (x[order] for x in (keys, more, docs, places, is_new))
    starts = _groups(keys, more) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    repeat = is_new & (docs > np.repeat(docs[starts], sizes))
    fresh = starts[np.logical_or.reduceat(is_new, starts)] if len(starts) else starts
    out.add(_RUN, np.full(len(fresh), bucket), keys[fresh], more[fresh], docs[fresh], np.zeros(len(fresh), np.uint32))
    reply_docs, reply_places = np.concatenate((docs[repeat], passed[2])), np.concatenate((places[repeat], passed[3]))
    none = np.zeros(len(reply_docs), np.uint32)
    out.add(_REPLIES, _doc_bucket(reply_docs, n_buckets), np.zeros(len(none), np.uint64), none, reply_docs, reply_places)
    return pa.Table.from_batches([out.take()])


def _compact(table: pa.Table) -> pa.Table:
    """One bucket of several runs as one: each key with its first document; anchors that two runs have are shared."""
    keys, more, docs, _ = _gather(table, _RUN)
    out = Blocks()
    if table.column("level")[0].as_py() == 0:
        order = np.lexsort((docs, keys))
        keys, more, docs = keys[order], more[order], docs[order]
        starts = _groups(keys)
        last = docs[np.append(starts[1:], len(docs)) - 1]
        more = (np.maximum.reduceat(more, starts) | (docs[starts] != last)).astype(np.uint32)
    else:
        order = np.lexsort((docs, more, keys))
        keys, more, docs = keys[order], more[order], docs[order]
        starts = _groups(keys, more)
        more = more[starts]
    out.add(_RUN, np.full(len(starts), table.column("bucket")[0].as_py()), keys[starts], more, docs[starts], np.zeros(len(starts), np.uint32))
    return pa.Table.from_batches([out.take()])


def _by_doc(table: pa.Table) -> pa.Table:
    """Replies of one bucket of documents: per document its places, sorted, each once."""
    docs, places = (np.concatenate([decode(x.as_py(), t) for x in table.column(c)]) for c, t in (("docs", "i8"), ("places", "u4")))
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    starts = _groups(docs)
    blobs = [np.unique(x).tobytes() for x in np.split(places, starts[1:])]
    return pa.table({"_doc": pa.array(docs[starts], pa.int64()), "_places": pa.array(blobs, pa.binary())})


class FingerprintIndex:
    """A log-structured index in a folder of its own. Batches must come in ascending order of their ids: a document of a later batch never has a smaller id than one of an earlier batch.

    What the index holds is said by its newest manifest, a file of its own: the runs of each level, the number of buckets
    and the largest id. A folder that has one is opened and goes on from there, also in another session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, n_buckets: int | None = None) -> None:
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "index"), fanout
        self.runs: tuple[list[str], list[str]] = ([], [])
        self.n_buckets, self.largest, self._made = n_buckets or partitions(spark), None, 0
        if (state := self._newest()) is not None:
            self.runs = tuple(state["runs"])
            self.n_buckets, self.largest, self._made = state["n_buckets"], state["largest"], state["made"]

    def _files(self) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _newest(self) -> dict | None:
        store, path = self._files()
        folder = path(f"{self.path}/manifests")
        if not store.exists(folder):
            return None
        names = sorted(f.getPath().getName() for f in store.listStatus(folder) if f.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}").first()[0]) if names else None

    def _note(self) -> None:
        """Writes a new manifest; readers take it from the moment that it has its name."""
        self._made += 1
        state = {"runs": self.runs, "n_buckets": self.n_buckets, "largest": self.largest, "made": self._made}
        store, path = self._files()
        draft = path(f"{self.path}/manifests/{self._made:09d}.draft")
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        store.rename(draft, path(f"{self.path}/manifests/{self._made:09d}.json"))

    def _read_runs(self, level: int) -> list[DataFrame]:
        return [self.spark.read.schema(_BLOCK).parquet(p).select(_NAMES) for p in self.runs[level]]

    def _new_run(self, level: int) -> str:
        self._made += 1
        return f"{self.path}/level{level}/run{self._made:09d}"

    def _merged(self, level: int, blocks: DataFrame, merge: Callable, keep: bool) -> DataFrame:
        """Merge-joins new blocks with the runs of a level; adds a run; returns the replies by document."""
        n, path = self.n_buckets, self._new_run(level)
        every = reduce(DataFrame.unionAll, self._read_runs(level), blocks)
        # one pass writes both: the run stays where it is, the replies are read once
        every.groupBy("bucket").applyInArrow(lambda t: merge(t, n), _BLOCK).write.option("compression", "zstd").partitionBy("kind").parquet(path)
        found = self.spark.read.schema(_BLOCK).parquet(path)
        replies = found.where(f"kind = {_REPLIES}").select("bucket", "docs", "places")
        out = materialise(replies.groupBy("bucket").applyInArrow(_by_doc, "_doc long, _places binary"), "replies")
        for kind in (_REPLIES, *[_RUN] * (not keep)):
            remove(self.spark, f"{path}/kind={kind}")
        if keep:
            self.runs[level].append(path)
        return out

    def ingest(self, batch: DataFrame, earlier: DataFrame | None = None, keep: bool = True) -> DataFrame:
        """Adds batch(doc_id, text as binary) and returns (_doc, _places): the first words of the windows of each document that an earlier document has, as unsigned 32-bit integers; a document may have several rows. earlier: documents of former batches, of which those are read again that share an anchor with the batch and shared it with none before. keep: whether the batch's runs are written, which the last batch of a closed corpus doesn't need."""
        ends = batch.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        if ends.low is not None and self.largest is not None and ends.low < self.largest:
            raise ValueError(f"document {ends.low} comes after {self.largest}; batches must have ascending ids")
        shared = self._merged(0, text_rows(batch).mapInArrow(_anchor_blocks(self.n_buckets), _BLOCK), _merge_anchors, keep)
        texts = batch if earlier is None else batch.unionAll(earlier)
        asked = with_places(texts, shared, "inner")
        repeats = self._merged(1, asked.mapInArrow(_window_blocks(self.n_buckets), _BLOCK), _merge_windows, keep)
        release(shared)
        if ends.high is not None:
            self.largest = ends.high if self.largest is None else max(self.largest, ends.high)
        if keep:
            self._note()
            if len(self.runs[0]) > self.fanout:
                self.compact()
        return repeats

    def compact(self) -> None:
        """Merges all runs of each level into one, then deletes them."""
        gone = []
        for level in (0, 1):
            old = list(self.runs[level])
            if len(old) > 1:
                blocks = reduce(DataFrame.unionAll, self._read_runs(level)).withColumn("level", F.lit(level))
                path = self._new_run(level)
                blocks.groupBy("bucket").applyInArrow(_compact, _BLOCK).write.option("compression", "zstd").partitionBy("kind").parquet(path)
                self.runs[level][:] = [path]
                gone += old
        self._note()  # only what no manifest names any more is deleted
        for path in gone:
            remove(self.spark, path)

    def delete(self) -> None:
        remove(self.spark, self.path)


def with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Joins (doc_id, text) with (_doc, _places). Texts are shuffled compressed; the same way at any size."""
    packed = zipped(texts)
    return text_rows(packed.join(places, packed["doc_id"] == places["_doc"], how))


def _anchor_blocks(n_buckets: int) -> Callable:
    """Blocks of anchors of (doc_id, text). An anchor that several documents of a piece have is sent once, for the first, and answered here for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE):
            found, owners = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if doc is not None and text.is_valid:
                    keys = np.unique(anchors(text.as_py())[0])
                    found.append(keys)
                    owners.append(np.full(len(keys), doc, np.int64))
            if not found:
                continue
            keys, docs = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            if not len(keys):
                continue
            starts = _groups(keys)
            sizes = np.diff(np.append(starts, len(keys)))
            shared = docs[starts] != docs[np.append(starts[1:], len(docs)) - 1]
            every = np.repeat(shared, sizes)
            out = Blocks()
            zeros = np.zeros(len(keys), np.uint32)
            out.add(_ENTRIES, _bucket(keys[starts], n_buckets), keys[starts], shared.astype(np.uint32), docs[starts], zeros[starts])
            others = np.flatnonzero(every)
            # to any bucket that this piece writes to anyway
            out.add(_REPLIES, _bucket(keys[others] * np.uint64(0xD6E8FEB86659FD93) ^ docs[others].view(np.uint64) << np.uint64(32), n_buckets), keys[others], zeros[others], docs[others], zeros[others])
            yield out.take()

    return run


def _window_blocks(n_buckets: int) -> Callable:
    """Blocks of digests of (doc_id, text, _places): windows whose anchor is among the places, which hold the anchors' low 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE):
            digests, owners, places = [], [], []
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("_places"), strict=True):
                raw = unzipped(text.as_py())
                keys, _ = anchors(raw)
                at = np.flatnonzero(np.isin(keys.astype(np.uint32), np.frombuffer(asked.as_py(), np.uint32)))
                if len(at):
                    words = raw.split()
                    joined = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    starts = np.concatenate(([0], ends[:-1] + 1))
                    spans = zip(starts[at].tolist(), ends[at + WINDOW - 1].tolist(), strict=True)
                    digests.append(b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in spans]))
                    owners.append(np.full(len(at), doc, np.int64))
                    places.append(at.astype(np.uint32))
            if not digests:
                continue
            halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
            keys, more = halves[:, 0], halves[:, 1].astype(np.uint32)
            docs, at = np.concatenate(owners), np.concatenate(places)
            order = np.lexsort((docs, more, keys))
            keys, more, docs, at = keys[order], more[order], docs[order], at[order]
            starts = _groups(keys, more)
            first = np.repeat(docs[starts], np.diff(np.append(starts, len(keys))))
            out = Blocks()
            mine = np.flatnonzero(docs == first)
            out.add(_ENTRIES, _bucket(keys[mine], n_buckets), keys[mine], more[mine], docs[mine], at[mine])
            later = np.flatnonzero(docs > first)
            spread = _bucket(keys[later] * np.uint64(0xD6E8FEB86659FD93) ^ docs[later].view(np.uint64) << np.uint64(32), n_buckets)
            out.add(_REPLIES, spread, keys[later], more[later], docs[later], at[later])
            yield out.take()

    return run


def covered(places: bytes | None, n_words: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the places."""
    change = np.zeros(n_words + WINDOW + 1, np.int64)
    at = np.frombuffer(places or b"", np.uint32).astype(np.int64)
    at = at[at + WINDOW <= n_words]
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change)[:n_words] > 0


def batches_of(docs: DataFrame, id_col: str, n: int) -> tuple[list[F.Column], int]:
    """Conditions that divide the rows into n batches of ascending ids, about equally large; and the bytes of all texts."""
    found = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 1000).alias("cuts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    cuts = sorted(set(found.cuts or [])) if n > 1 else []
    lows, highs = [None, *cuts], [*cuts, None]
    every = []
    for low, high in zip(lows, highs, strict=True):
        c = F.col(id_col).isNotNull()
        c = c if low is None else c & (F.col(id_col) > low)
        every.append(c if high is None else c & (F.col(id_col) <= high))
    return every, found.bytes


def repeats(docs: DataFrame, n_batches: int = 2, fanout: int = 1) -> DataFrame:
    """(_doc, _places) of all documents(doc_id, text as binary), each once, through an index that takes them in batches of ascending ids, is compacted when it has more than `fanout` runs, and deleted in the end."""
    conditions, size = batches_of(docs, "doc_id", n_batches)
    spark = docs.sparkSession
    index = FingerprintIndex(spark, fanout=fanout, n_buckets=max(partitions(spark), ceil(size / BUCKET_BYTES)))
    found, before = [], None
    for condition in conditions:
        batch = docs.where(condition)
        found.append(index.ingest(batch, before))
        before = batch if before is None else before.unionAll(batch)
    index.delete()
    if len(found) == 1:
        return found[0]
    # a later batch may answer for an earlier document again
    each = reduce(DataFrame.unionAll, found).groupBy("_doc").agg(F.collect_list("_places").alias("_all"))
    united = materialise(each.select("_doc", F.expr("aggregate(_all, cast('' AS binary), (done, x) -> concat(done, x))").alias("_places")), "repeats")
    release(*found)
    return united


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_batches: int = 2) -> DataFrame:
    """Removes each word covered by a window of 13 words that also starts in a document with a smaller id.

    Returns (doc_id, n_words, n_removed, kept), one row per row of docs; kept: the remaining words joined by one space, as
    UTF-8 bytes. Words are runs of other bytes than ASCII white space. A null text has no words. A row with a null id
    loses nothing and makes no other lose anything. Rows with equal ids are one document for the order (none of them makes
    another lose anything), and what any of them loses is taken from all at the same places only if the texts are equal;
    with different texts of one id, places of windows are united. Texts may have any length. Other columns are ignored; an
    empty table gives none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("_places").to_pylist(), strict=True):
                words = (unzipped(text) or b"").split()
                n_words.append(len(words))
                if places:
                    gone = covered(places, len(words))
                    words = list(compress(words, (~gone).tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return with_places(texts, repeats(texts, n_batches), "left").select("doc_id", "text", "_places").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def digest(result: DataFrame) -> DataFrame:
    """The counts and the SHA-256 of the kept words."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", n_batches: int = 2) -> DataFrame:
    """docs, all columns, without repeated words: a text that loses some has its other words joined by one space; rows that lose all are gone.

    Texts that lose nothing stay as they are, also null and empty ones and rows with a null id; rows with equal ids are one
    document for the order. count_col, if docs has it, gets the new number of characters where a text changes. Texts may
    have any length; other columns don't matter, whatever their names; an empty table stays empty.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    names, lost = docs.columns, unused(docs, "places")
    found = repeats(texts, n_batches)
    places = found.select(F.col("_doc").alias(unused(docs, "doc")), F.col("_places").alias(lost))
    owner = places.columns[0]
    joined = docs.join(places, F.col(id_col).cast("long") == F.col(owner), "left").drop(owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            texts, keep = [], []
            asked = batch.column(lost).to_pylist()
            for text, places in zip(batch.column(text_col).to_pylist(), asked, strict=True):
                if places and text:
                    words = text.encode().split()
                    text = b" ".join(compress(words, (~covered(places, len(words))).tolist())).decode()
                    keep.append(bool(text))
                else:
                    keep.append(True)
                texts.append(text)
            arrays = [batch.column(n) for n in names]
            arrays[names.index(text_col)] = pa.array(texts, batch.column(text_col).type)
            if count_col in names:
                at = names.index(count_col)
                changed = [len(t) if p and t is not None else c for t, p, c in zip(texts, asked, arrays[at].to_pylist(), strict=True)]
                arrays[at] = pa.array(changed, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep, pa.bool_()))

    return text_rows(joined).mapInArrow(run, docs.schema)


#: The digest over `documents` for DuckDB.
SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13)
), firsts AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS k FROM windows JOIN firsts USING (w) WHERE first < doc_id
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)
"""
