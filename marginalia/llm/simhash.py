"""SimHash near-duplicate detection by Golay-code fuzzy hashing.

A fingerprint has 64 bits: segments of 23, 23 and 18. Two fingerprints that differ in at most two bits spread at most
two errors over these segments, so (pigeonhole) either the last is equal and the first has at most two errors, or one
of the long ones is equal and the other has at most one. Each segment with errors is replaced by the codewords of the
Golay code near to it, one to six per word, of which two words at most two bits apart share one. A key is an equal
segment and such a codeword, so a fingerprint has at most 18 keys. Fingerprints that share a key are verified.

A key with more than MAX_BUCKET different fingerprints isn't compared pairwise: its fingerprints go to an exact
alternative, in which each emits the 65 words at most one bit away. Two fingerprints are at most two bits apart exactly
if they share such a word, and a word can have no more than 65 fingerprints around it, so nothing is dropped and no
group is large.

Texts with equal fingerprints are one class throughout; only different fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import connected_components
from marginalia.llm.golay import near_codewords
from marginalia.llm.shared import as_bytes, chunks, materialise, small, text_rows, unused

#: Keys with more different fingerprints than this are solved by the words around them.
MAX_BUCKET = 32
#: The operator's distance; the segments above fit no other.
MAX_BITS = 2
#: Shingles hashed at once in one text.
BLOCK = 1 << 16

_LANES = np.uint64(0x0101010101010101)


class BitVotes:
    """Counts for each of the 64 bits in how many hashes it is set."""

    def __init__(self) -> None:
        self.total = 0
        self.counts = np.zeros((8, 8), np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """Eight bits at a time lie in the bytes of a word; 255 words are summed before a byte could overflow."""
        n = len(hashes)
        self.total += n
        padded = np.zeros(-(-n // 255) * 255, np.uint64)
        padded[:n] = hashes
        for bit in range(8):
            lanes = (padded >> np.uint64(bit)) & _LANES
            sums = lanes.reshape(-1, 255).sum(axis=1, dtype=np.uint64)
            self.counts[bit] += sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)

    def fingerprint(self) -> int:
        """The bits that are set in over half of the hashes."""
        over = self.counts * 2 > self.total
        return sum(1 << (8 * byte + bit) for bit in range(8) for byte in range(8) if over[bit, byte])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, split at ASCII white space, shingles of words with repeats. A text with fewer words is one shingle; without words it is 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= shingle:
        starts, ends = np.array([0]), np.array([len(joined)])
        shingle = 1
    n = len(starts) - shingle + 1
    votes, digest = BitVotes(), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        pairs = zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist(), strict=True)
        votes.add(np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, stop - at))
    return votes.fingerprint()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer; one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = np.array([fingerprint(x, shingle, seed) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return text_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))).mapInArrow(run, "doc_id long, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints and, for each key, the index of its fingerprint."""
    first = (fps & np.uint64(0x7FFFFF)).astype(np.int64)
    second = ((fps >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64)
    third = (fps >> np.uint64(46)).astype(np.int64)
    near_first, near_second = near_codewords(first), near_codewords(second)
    keys, owners = [], []
    for kind, (equal, near) in enumerate(((third, near_first), (first, near_second), (second, near_first))):
        rows, cols = np.nonzero(near >= 0)
        keys.append(kind << 40 | equal[rows] << 12 | near[rows, cols])
        owners.append(rows)
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp"))
            keys, owners = golay_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[owners])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) for different fingerprints of distinct(fp) that differ in at most two bits: every such pair is a row, or both are linked through others that are."""
    keyed = _keyed(distinct)
    sizes = keyed.groupBy("key").count().where("count > 1")
    shared = materialise(keyed.join(sizes, "key"), "buckets")
    buckets = shared.where(F.col("count") <= max_bucket).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    verified = buckets.select(
        F.explode(
            F.expr(
                f"flatten(transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= {MAX_BITS}), y -> struct(x AS a, y AS b))))"
            )
        ).alias("pair")
    ).select("pair.a", "pair.b")
    crowded = shared.where(F.col("count") > max_bucket).select("fp").distinct()
    around = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"))
    stars = around.groupBy("word").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    starred = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return verified.unionAll(starred)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Near-duplicate groups of texts.

    Returns (doc_id, fp, fingerprint, component_id), one row per row of docs: the fingerprint as 16 hex digits, and the
    smallest id reachable over links of at most two bits, its own included. A null or blank text has fingerprint 0 and
    is linked like any other; a text of any length is hashed as a whole. A row with a null id takes part, but its id names no group: a group of such rows alone has
    a null component_id. Repeated rows are rows of the result. Other columns are ignored; an empty table gives none.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    labels = connected_components(links(classes, max_bucket))
    rooted = labels.join(classes.withColumnRenamed("fp", "node"), "node")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = labels.join(lows, "root").select(F.col("node").alias("fp"), "component_id")
    named = materialise(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    return fps.join(small(named), "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id stays, once. Rows without an id can't be named by their group and stay as they are. Null and blank texts are copies of each other; an empty table stays empty."""
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **options)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct()
    # the join and the removal of repeated rows share one partitioning
    digest = unused(docs, "digest")
    kept = docs.join(stay, id_col, "left_semi").withColumn(digest, F.xxhash64(text_col)).dropDuplicates([id_col, digest]).drop(digest)
    return kept.select(docs.columns).unionAll(docs.where(F.col(id_col).isNull()))
