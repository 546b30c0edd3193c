"""SimHash and substring deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import golay, jaccard, simhash, substrings
from marginalia.llm.components import connected_components
from marginalia.llm.words import first_minimum, word_hashes

SCHEMA = "doc_id long, text string, source string, fp string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_golay_keys_meet_within_two_bits():
    cosets = np.arange(2048, dtype=np.int32)
    own = golay.near_codewords(cosets)
    singles = [1 << i for i in range(23)]
    for error in [0, *singles, *(a | b for a in singles for b in singles if a < b)]:
        other = golay.near_codewords(cosets ^ error)
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any((1, 2)).all()


def test_keys_of_near_fingerprints_meet():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        keys, owners = simhash.golay_keys(np.array([a, b], np.uint64))
        assert set(keys[owners == 0]) & set(keys[owners == 1])
        assert len(keys) <= 36


@pytest.mark.parametrize("text", [None, "", " \n ", "one", "One two", "a b c", "A  b\tc\nd", "é É ß " * 40, "x " * 70000, "y" * 300000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def near_texts(rng):
    base = words(rng, 900, 5000)
    texts = [None, "", " ", "a b", "A B"]
    texts += [" ".join(words(rng, rng.randint(1, 60))) for _ in range(60)]
    for _ in range(60):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(len(copy))] = "other"
        texts.append(" ".join(copy))
    return texts + texts[10:30]


@pytest.mark.parametrize("max_bucket", [1, 32])
def test_near_duplicates(spark, max_bucket):
    """Also with every shared key solved by the exact alternative."""
    texts = near_texts(random.Random(5))
    fps = [plain_fingerprint(t) for t in texts]
    expected = components_of(fps)
    rows = simhash.near_duplicates(frame(spark, texts), max_bucket=max_bucket).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fps[i]:016x}", expected[i]) for i in range(len(texts))}
    assert len(set(expected)) < len(texts) - 20


def test_near_duplicates_with_odd_ids(spark):
    texts = ["a b c d", "a b c d", "x y z", "x y z", "q"]
    rows = simhash.near_duplicates(frame(spark, texts, [None, 7, None, None, 7])).collect()
    assert sorted((r.doc_id is None, r.component_id is None) for r in rows) == [(False, False), (False, False), (True, False), (True, True), (True, True)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_drop_near_duplicates(spark):
    rows = simhash.drop_near_duplicates(frame(spark, ["a b c", "A  b c", "other text here", "other text here", None], [3, 2, 5, 5, 9]))
    assert rows.columns == ["doc_id", "text", "source", "fp"]
    assert sorted(r.doc_id for r in rows.collect()) == [2, 5, 9]


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (5, 5), (None, 7)]
    rows = connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(61)} | {200: 100, 100: 100, 300: 100}


def removed(texts, ids):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, own in zip(ids, split, strict=True):
        for k in range(len(own) - 12):
            w = tuple(own[k : k + 13])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, own in zip(ids, split, strict=True):
        gone = [False] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((i, len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(rng):
    shared = [words(rng, n) for n in (12, 13, 14, 40, 200)]
    texts = [None, "", "short", " ".join(["same"] * 500), " ".join(["same"] * 14)]
    for _ in range(150):
        text = words(rng, rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(shared) + words(rng, rng.randint(0, 20))
        texts.append(rng.choice([" ", "\n", "  "]).join(text))
    return texts + texts[20:40]


@pytest.mark.parametrize("n_batches", [1, 2, 5])
def test_deduplicate(spark, n_batches):
    rng = random.Random(n_batches)
    texts = passages(rng)
    ids = rng.sample(range(1000), len(texts))
    rows = substrings.digest(substrings.deduplicate(frame(spark, texts, ids), n_batches=n_batches)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removed(texts, ids)


def test_index_is_compacted(spark):
    """Batches one after the other, runs merged after every second: the same repeats, with one run left."""
    rng = random.Random(9)
    texts = passages(rng)
    docs = frame(spark, texts).select("doc_id", F.col("text").cast("binary").alias("text"))
    index = substrings.FingerprintIndex(spark, fanout=1, n_buckets=5)
    found, size, before = {}, 50, None
    for at in range(0, len(texts), size):
        batch = docs.where(F.col("doc_id").between(at, at + size - 1))
        for r in index.ingest(batch, before).collect():
            found[r._doc] = np.frombuffer(r._places, np.uint32)
        before = batch if before is None else before.unionAll(batch)
        assert len(index.runs[0]) == 1 and len(index.runs[1]) == 1
    index.delete()
    for i, n, gone, _ in removed(texts, range(len(texts))):
        places = found[i].tobytes() if i in found else None
        assert substrings.covered(places, n).sum() == gone


def test_index_is_opened_again(spark, tmp_path):
    """A folder with a manifest goes on where it was, in another object; batches in the wrong order are refused."""
    rng = random.Random(4)
    texts = passages(rng)
    docs = frame(spark, texts).select("doc_id", F.col("text").cast("binary").alias("text"))
    path, found, before = str(tmp_path / "index"), {}, None
    for at in range(0, len(texts), 60):
        batch = docs.where(F.col("doc_id").between(at, at + 59))
        for r in substrings.FingerprintIndex(spark, path, fanout=2, n_buckets=3).ingest(batch, before).collect():
            found[r._doc] = found.get(r._doc, b"") + r._places
        before = batch if before is None else before.unionAll(batch)
    index = substrings.FingerprintIndex(spark, path, n_buckets=99)
    assert index.n_buckets == 3 and 1 <= len(index.runs[0]) <= 2 and index.largest == len(texts) - 1
    for i, n, gone, _ in removed(texts, range(len(texts))):
        assert substrings.covered(found.get(i), n).sum() == gone
    with pytest.raises(ValueError, match="ascending"):
        index.ingest(docs.where("doc_id = 3"))
    index.delete()
    assert substrings.FingerprintIndex(spark, path).runs == ([], [])


@pytest.mark.parametrize("n_batches", [2, 5])
def test_clashing_hashes(spark, n_batches, monkeypatch, tmp_path):
    """Anchors that all agree in the bits that replies carry: one row per document, and the right words removed."""
    (tmp_path / "clash.py").write_text("import numpy as np\nfrom marginalia.llm import substrings\nreal = substrings.anchors\ndef anchors(text):\n    keys, at = real(text)\n    return keys & np.uint64(0xFFFFFFFF00000000), at\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    import clash

    real = substrings._anchor_blocks, substrings._window_blocks

    def clashing(make):
        def made(n):
            run = make(n)

            def patched(batches):
                import sys

                sys.path.insert(0, str(tmp_path))
                import clash as own

                substrings_ = __import__("marginalia.llm.substrings", fromlist=["x"])
                before, substrings_.anchors = substrings_.anchors, own.anchors
                try:
                    yield from run(batches)
                finally:
                    substrings_.anchors = before

            return patched

        return made

    assert clash.real is substrings.anchors
    monkeypatch.setattr(substrings, "_anchor_blocks", clashing(real[0]))
    monkeypatch.setattr(substrings, "_window_blocks", clashing(real[1]))
    texts = passages(random.Random(3))
    rows = substrings.digest(substrings.deduplicate(frame(spark, texts), n_batches=n_batches)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removed(texts, range(len(texts)))


def test_deduplicate_with_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = substrings.deduplicate(frame(spark, [text, text, text, text + " more"], [None, 4, 4, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (4, 0), (4, 0), (9, 30)]
    assert substrings.deduplicate(frame(spark, [])).count() == 0


def test_without_repeats(spark):
    text = "\n".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 99), (2, text, 99), (3, text + " and more", 99), (4, None, 99)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: (r.text, r.n_chars) for r in substrings.without_repeats(docs).collect()}
    assert rows == {1: (text, 99), 3: ("and more", 8), 4: (None, 99)}


def test_stages_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 1, "a", "b"), (2, text + " more", 2, "c", "d"), (2, text + " more", 2, "c", "d")], "doc_id long, text string, digest int, places string, doc string")
    for names in (["doc_id", "text", "digest", "places", "doc"], ["doc_id", "text", "_digest", "_places", "_doc"], ["doc_id", "text", "component_id", "fp", "d"]):
        own = docs.toDF(*names)
        for stage in (substrings.without_repeats, simhash.drop_near_duplicates, jaccard.drop_near_duplicates):
            kept = stage(own)
            assert kept.columns == names and sorted({r.doc_id for r in kept.collect()})[0] == 1
            assert stage(own.limit(0)).count() == 0


def test_words():
    texts = [b"a bb  ccc\n d\te", b"", b"x" * 5_000_000 + b" y", b" ".join(b"word%d" % i for i in range(500_000))]
    for text in texts:
        hashes = word_hashes(text)
        own = text.split()
        assert len(hashes) == len(own)
        assert len(set(hashes.tolist())) == len(set(own))
    assert word_hashes(b"q z q")[0] == word_hashes(b"  q")[0]
    values = np.array([3, 1, 1, 2, 0, 5], np.uint64)
    assert first_minimum(values, 3).tolist() == [1, 1, 4, 4]
