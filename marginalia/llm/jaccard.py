"""Groups of texts whose sets of shingles have a similarity (Jaccard) of at least 4/5: SimHash with Golay keys, and an exact join for the rest.

Texts with equal sets are one class. Candidates come first from operator 1: a set's fingerprint, the fingerprints at most
two bits apart by their Golay keys (`simhash.links`); and from a few tables of least hashes, in which each set meets the one
next to it. Every candidate is verified on the shingles of its texts, so texts with near fingerprints that aren't similar
stay apart. This links most near copies after a few comparisons for each text, however large their group.

What fingerprints can't find is found by an exact join. All shingles have one order; two sets of n and m shingles that are
similar have at least 4/9 (n + m) in common, so they share one of the first n - ceil(4n/5) + 1 (prefix filter). These are
the keys. Three rules say which of the sets that share a key need a comparison, none of which drops a similar pair unlinked:
sets of one component are linked already; at the first shingle that both share, at most what follows it can be shared
(positional filter); and similar sets differ in at most 1/9 (n + m) shingles, so in at most so many bits of sketches that
hold the parity of each bucket of hashes (sketch filter). All other pairs of a key are verified, so no similar pair is missed
and none is linked that isn't; a key with more than BLOCK members is dealt in blocks, each of which meets all members.

The order decides only how many candidates there are: shingles that are frequent in a sample of the texts come last. A pair
comes up at the first key of a run that both share, not at each. Where keys with members of several components stay crowded,
each member is compared with a few others of the key first, and again with other ones as long as this links more of them.

Pairs are verified in cells of a grid over both ends, so a text travels once for each cell that has a pair of it, compressed;
in a cell one end's sets are held and the other end's texts go by. Tables of ids are broadcast only after a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import simhash
from marginalia.llm.components import connected_components
from marginalia.llm.shared import as_bytes, chunks, materialise, release, small, text_rows, unused, unzipped, zipped
from marginalia.llm.words import mix, rolling, word_hashes

#: Members of a key that are compared in one group, and pairs of a cell, about.
BLOCK, CELL_PAIRS = 1024, 8192
#: Texts of the sample for the order, about; and its frequent shingles that are told apart.
SAMPLE, FREQUENT = 20_000, 100_000
#: Words of a sketch (a power of two), tables of least hashes, and keys before one that tell whether a pair came up already.
SKETCH, TABLES, EARLIER = 8, 4, 2
_ODD = mix(np.arange(1, 3 * TABLES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The different shingles of a text as sorted hashes: A-Z lower-cased, split at ASCII white space. A text with fewer words is one shingle; without words it has none."""
    words = word_hashes((text or b"").lower())
    return np.unique(rolling(words, min(shingle, len(words)))) if len(words) else words


def digest(found: np.ndarray) -> int:
    """A set's name, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of a set, by their counts among the frequent ones (sorted), then by hash."""
    n = len(found)
    if not n:
        return found
    own = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        own = np.where(frequent[at] == found, counts[at], 0)
    return found[np.lexsort((found, own))][: n - (4 * n + 4) // 5 + 1]


def sketch(found: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH buckets of hashes whether the set has an odd number in it. Sets that differ in k shingles differ in at most k bits."""
    bits = 64 * SKETCH
    counts = np.bincount((found >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def least(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name for each table, which two sets share with a chance of their similarity squared, and a place among the sets of that name."""
    if not len(found):
        return found, found
    first, second, third = np.array([(found * odd).min() for odd in _ODD], np.uint64).reshape(3, TABLES)
    return mix(first ^ mix(second + np.arange(TABLES, dtype=np.uint64))), third


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(d, shingles) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = [shingles(x, shingle) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["d", "shingles"])

    return text_rows(docs.select("text")).mapInArrow(run, "d long, shingles array<long>")


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in several texts of a sample, sorted, and in how many."""
    every = -(-docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, every))) == 0)
    rows = _sets(sample, shingle).select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    found = np.array([r.s for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["count"] for r in rows], np.int64)[order]


def _prefixes(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, d, n, fp, sketch, names, places, keys), one row per row of docs(doc_id, text): the set's name and size, the text's fingerprint, the set's sketch and least hashes and the keys in their order."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle))
    longs = lambda rows: pa.array([np.asarray(r).view(np.int64) for r in rows], pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            prints = np.array([simhash.fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            sets = [shingles(x, shingle) for x in texts]
            names, places = zip(*map(least, sets), strict=True)
            columns = [pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints)]
            columns += [longs(map(sketch, sets)), longs(names), longs(places), longs(prefix(s, frequent, counts) for s in sets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "d", "n", "fp", "sketch", "names", "places", "keys"])

    return text_rows(docs).mapInArrow(run, "doc_id long, d long, n long, fp long, sketch array<long>, names array<long>, places array<long>, keys array<long>")


def _possible(n: str, pos: str, m: str, at: str) -> str:
    """Whether sets of n and m that share their shingles number pos and at, and none before, can be similar."""
    return f"9 * least({n} - {pos}, {m} - {at}) >= 4 * ({n} + {m})"


def _words(sketch: str = "sketch", name: str = "w") -> list[F.Column]:
    """The words of a sketch as columns."""
    return [F.col(sketch)[i].alias(f"{name}{i}") for i in range(SKETCH)]


def _alike(n: str, m: str, left: str, right: str) -> str:
    """Whether sets of n and m with these words of sketches can be similar."""
    return f"9 * ({' + '.join(f'bit_count({left}{i} ^ {right}{i})' for i in range(SKETCH))}) <= {n} + {m}"


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted, have at least 4/5 of their union in common."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """The rows of pairs(a, b), each once, whose sets are similar, stored. Few different a should have many b each, not the other way round."""
    pairs = materialise(pairs.distinct(), "pairs")
    side = max(1, isqrt(ceil(pairs.count() / CELL_PAIRS)))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    placed = pairs.withColumn("cell", (group("a") * side + group("b")).cast("int"))
    held = placed.select("cell", F.col("a").alias("d")).distinct().select("cell", "d", F.lit(None).cast("array<long>").alias("partners"))
    asked = placed.groupBy("cell", F.col("b").alias("d")).agg(F.collect_list("a").alias("partners")).select("cell", "d", "partners")
    sends = materialise(held.unionAll(asked), "sends")
    ends = materialise(classes.join(sends.select("d").distinct(), "d", "left_semi").select(F.col("low").alias("doc_id"), "d"), "ends")
    texts = zipped(docs.join(small(ends), "doc_id"), "d")
    # rows with one id may have different texts; the set's name tells which is meant
    rows = texts.join(small(sends), "d").repartition(min(4096, side * side), "cell").sortWithinPartitions("cell", F.col("partners").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in chunks(batches, "text"):
            found: list[tuple[int, int]] = []
            for own, d, partners, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "d", "partners", "text")), strict=True):
                if own != cell:
                    cell, sets = own, {}
                shingled = shingles(unzipped(text), shingle)
                if digest(shingled) != d:
                    continue
                if partners is None:
                    sets[d] = shingled
                else:
                    found += [(a, d) for a in set(partners) if similar(sets[a], shingled)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = materialise(text_rows(rows.select("cell", "d", "partners", "text")).mapInArrow(run, "a long, b long"), "verified")
    release(pairs, sends, ends)
    return out


def _by_fingerprint(first: DataFrame) -> DataFrame:
    """(a, b) of first(d, n, fp), stored: each set with the smallest one of its fingerprint, and these for fingerprints at most two bits apart, by operator 1."""
    lead = F.first("d").over(Window.partitionBy("fp").orderBy("n", "d"))
    led = materialise(first.select("d", "fp", lead.alias("lead")), "led")
    leads = materialise(led.where("d = lead").select("fp", "d"), "leads")
    end = lambda c: small(leads).select(F.col("fp").alias(c), F.col("d").alias(f"d_{c}"))
    linked = simhash.links(leads.select("fp")).distinct().join(end("a"), "a").join(end("b"), "b")
    out = materialise(led.where("d <> lead").select(F.col("lead").alias("a"), F.col("d").alias("b")).unionAll(linked.select(F.col("d_a").alias("a"), F.col("d_b").alias("b"))), "by-fingerprint")
    release(led, leads)
    return out


def _by_least(first: DataFrame) -> DataFrame:
    """(a, b) of first(d, n, sketch, names, places): each set with the one before it in each table, where they can be similar."""
    rows = first.select("d", "n", *_words(), F.posexplode(F.arrays_zip("names", "places")).alias("turn", "at"))
    before = F.lag(F.struct("d", "n", *(f"w{i}" for i in range(SKETCH)))).over(Window.partitionBy("at.names", "turn").orderBy("at.places", "n", "d"))
    met = rows.withColumn("before", before).where(f"{_possible('n', '0', 'before.n', '0')} and {_alike('n', 'before.n', 'w', 'before.w')}")
    return met.select(F.col("before.d").alias("a"), F.col("d").alias("b"))


def _open_pairs(keyed: DataFrame, block: int) -> DataFrame:
    """(a, b) of all rows of keyed(key, d, n, pos, size, root, earlier, w0, ...) that have a key in common and different roots, and can be similar. Where they also share one of the keys in earlier, they are a pair there."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    words = lambda name: [F.col(f"w{i}").alias(f"{name}{i}") for i in range(SKETCH)]
    left = keyed.select("key", F.pmod(F.xxhash64("d"), blocks).cast("int").alias("block"), F.col("d").alias("a"), "n", "pos", F.col("root").alias("up"), F.col("earlier").alias("own"), *words("w"))
    right = keyed.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("d").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), "root", "earlier", *words("v"))
    new = f"a < b and up <> root and {_possible('n', 'pos', 'm', 'at')} and {_alike('n', 'm', 'w', 'v')} and not arrays_overlap(own, earlier)"
    return left.join(right, ["key", "block"]).where(new).select("a", "b")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id), one row per row of docs with an id: the smallest id reachable over similar texts, its own included.

    Texts without words are similar to each other, and one with fewer words than a shingle is one shingle. Rows with one
    id are one document with all of its texts' links. Texts may have any length; other columns are ignored; an empty
    table gives no rows.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    found = materialise(_prefixes(own, shingle), "prefixes")
    classes = materialise(found.groupBy("d").agg(F.min("doc_id").alias("low")), "classes")
    first = found.join(small(classes.select("d", F.col("low").alias("doc_id"))), ["d", "doc_id"])
    if _repeated(found):
        first = first.dropDuplicates(["d"])
    near = _verified(_by_fingerprint(first).unionAll(_by_least(first)), own, classes, shingle)
    roots = materialise(connected_components(near).withColumnRenamed("node", "d"), "roots")
    rooted = first.select("d", "n", "keys").join(small(roots), "d", "left").select("d", "n", F.coalesce("root", "d").alias("root"), F.posexplode("keys").alias("pos", "key"))
    # size and place go as one number, which keeps the largest shuffle's rows short
    short = _open(rooted.select("key", "d", "root", (F.shiftleft(F.col("n"), 31) + F.col("pos")).alias("at")))
    placed = short.select("key", "d", F.shiftright("at", 31).alias("n"), F.expr("cast(at & 2147483647 AS int)").alias("pos"), "size", "root")
    earlier = F.expr(f"slice(keys, greatest(pos - {EARLIER}, 0) + 1, least(pos, {EARLIER}))").alias("earlier")
    several, more = materialise(placed.join(first.select("d", "keys", *_words()), "d").select(*placed.columns, earlier, *(f"w{i}" for i in range(SKETCH))), "several"), []
    ids = materialise(found.select("doc_id", "d"), "ids")
    release(short, found)
    while _crowded(several):
        found_more = _verified(_neighbours(several, len(more)), own, classes, shingle)
        more.append(found_more)
        merged = materialise(connected_components(_of_roots(found_more, several)).select(F.col("node").alias("root"), F.col("root").alias("up")), "merged")
        before, several = several, _open(several.drop("size").join(small(merged), "root", "left").withColumn("root", F.coalesce("up", "root")).drop("up"))
        gone, there = merged.where("up <> root").count(), before.select("root").distinct().count()
        release(before, merged)
        if gone < 0.01 * there:
            break
    near = reduce(DataFrame.unionAll, more, near)
    rest = _verified(_open_pairs(several, block), own, classes, shingle)
    labels = connected_components(near.unionAll(rest)).withColumnRenamed("node", "d")
    lows = labels.join(classes, "d").groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(classes.join(labels.join(lows, "root").select("d", "component_id"), "d", "left").select("d", F.coalesce("component_id", "low").alias("component_id")), "components")
    out = materialise(ids.join(small(named), "d").select("doc_id", "component_id"), "groups")
    release(ids, classes, roots, several, named, rest, *more)
    return out


#: Pairs for each row of the open keys, from which on these are crowded; and members of a key that one is compared with first.
CROWDED, NEIGHBOURS = 8, 8


def _open(rooted: DataFrame) -> DataFrame:
    """The rows of rooted(key, d, root, ...) whose key has members of several components, stored, with the number of its members."""
    whole = Window.partitionBy("key")
    ends = rooted.select("*", F.min("root").over(whole).alias("_first"), F.max("root").over(whole).alias("_last"), F.count("*").over(whole).alias("size"))
    return materialise(ends.where("_first <> _last").drop("_first", "_last"), "open")


def _crowded(several: DataFrame) -> bool:
    """Whether the open keys have far more pairs of members in different components than rows."""
    sizes = several.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").cast("double").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("within"))
    found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("rows"), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2), F.lit(0.0)).alias("pairs")).first()
    return found.pairs > CROWDED * found.rows


def _neighbours(several: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member of an open key with the NEIGHBOURS before it that are in another component, where they can be similar. The members' order is another one for each key and turn."""
    words = [f"w{i}" for i in range(SKETCH)]
    before = Window.partitionBy("key").orderBy(F.xxhash64("d", "key", F.lit(turn)), "d").rowsBetween(-NEIGHBOURS, -1)
    met = several.select("d", "n", "pos", "root", *words, F.collect_list(F.struct("d", "n", "pos", "root", *words)).over(before).alias("others"))
    return met.withColumn("o", F.explode("others")).where(f"root <> o.root and {_possible('n', 'pos', 'o.n', 'o.pos')} and {_alike('n', 'o.n', 'w', 'o.w')}").select(F.least("d", "o.d").alias("a"), F.greatest("d", "o.d").alias("b"))


def _of_roots(pairs: DataFrame, several: DataFrame) -> DataFrame:
    """Links of members as links of their components."""
    roots = several.select("d", "root").distinct()
    ends = lambda c: roots.select(F.col("d").alias(c), F.col("root").alias(f"root_{c}"))
    return pairs.join(ends("a"), "a").join(ends("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def _repeated(found: DataFrame) -> bool:
    """Whether a row occurs more than once."""
    return not found.groupBy("d", "doc_id").count().where("count > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the row with the smallest id stays, once.

    Repeated rows (one id and text) stay once; different texts of an id that stays all stay. Rows without an id stay as
    they are. Null and blank texts are copies of each other. An empty table stays empty.
    """
    found = groups(docs, id_col, text_col, **options)
    named = lambda ids: small(materialise(ids.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct(), "ids"))
    several = materialise(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id")).where("n > 1"), "several")
    gone = found.where("doc_id <> component_id").select("doc_id").unionAll(several.select("doc_id"))
    kept = docs.join(named(gone), id_col, "left_anti")  # null ids match nothing and stay
    if several.isEmpty():
        return kept
    digested = unused(docs, "digest")
    again = docs.join(named(several.where("doc_id = component_id")), id_col, "left_semi")
    once = again.withColumn(digested, F.xxhash64(text_col)).dropDuplicates([id_col, digested]).drop(digested)
    return kept.unionAll(once.select(docs.columns))
