"""Near-duplicates of the pipeline against brute-force similarity of shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest

from marginalia.llm import jaccard, simhash


def plain_sets(texts):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def plain_groups(texts):
    sets, root = plain_sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, k):
    words = list(words)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"x{rng.randrange(10**9)}"
    return words


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def kept(spark, texts):
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts), "").collect())


def test_similar_pairs_are_found(spark):
    """Copies with one to six edits of 200 words, on both sides of a similarity of 0.8."""
    rng = random.Random(3)
    texts = [None, "", "a b", "A  b", "a b c"]
    for i in range(120):
        base = prose(rng, rng.randint(100, 300))
        texts += [" ".join(base), " ".join(edited(rng, base, 1 + i % 6))]
    expected = plain_groups(texts)
    rows = jaccard.groups(frame(spark, texts)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == set(enumerate(expected))
    assert kept(spark, texts) == sorted(set(expected))


@pytest.mark.parametrize("block", [3, 1024])
def test_crowded_keys(spark, block):
    """Many different texts with one long passage in common, some of which are near copies of each other."""
    rng = random.Random(8)
    passage, texts = prose(rng, 100), []
    for _ in range(60):
        own = prose(rng, 50)
        texts += [" ".join(passage + own), " ".join(passage + edited(rng, own, 2))]
    expected = plain_groups(texts)
    assert 40 < len(set(expected)) < 100
    rows = jaccard.groups(frame(spark, texts), block=block).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == set(enumerate(expected))


def test_large_group_of_loosely_near_copies(spark, monkeypatch):
    """Copies of one text that are near to about half of the others each: linked by a few rounds of stars, and few pairs are left to compare."""
    rng, pairs = random.Random(2), []
    base = prose(rng, 200)
    texts = [" ".join(edited(rng, base, rng.choice([1, 3, 4, 5]))) for _ in range(150)] + [" ".join(prose(rng, 100)) for _ in range(20)]
    real = jaccard._open_pairs
    monkeypatch.setattr(jaccard, "_open_pairs", lambda keyed, block: pairs.append(real(keyed, block).distinct().count()) or real(keyed, block))
    rows = jaccard.groups(frame(spark, texts)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == set(enumerate(plain_groups(texts)))
    assert pairs[0] < 150 * 20


def test_candidates_by_fingerprint(spark, monkeypatch):
    """Long texts with one edit are linked by operator 1 alone: near fingerprints, then the check on shingles."""
    rng, texts = random.Random(5), []
    for _ in range(20):
        base = prose(rng, 900)
        texts += [" ".join(base), " ".join(edited(rng, base, 1))]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    near = {2 * i for i in range(20) if (prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= simhash.MAX_BITS}
    assert len(near) > 5
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(jaccard, "_by_least", lambda first: none)
    monkeypatch.setattr(jaccard, "_open_pairs", lambda keyed, block: none)
    rows = jaccard.groups(frame(spark, texts)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, i - i % 2 if i - i % 2 in near else i) for i in range(40)}


def test_pairs_of_a_key_are_few(spark, monkeypatch):
    """A group of loosely near copies and many texts that share a passage with them and each other: few rows leave the join, although all pairs are decided."""
    rng, rows = random.Random(12), []
    base = prose(rng, 200)
    texts = [" ".join(edited(rng, base, rng.choice([1, 3, 4, 5]))) for _ in range(150)]
    texts += [" ".join(base[:120] + prose(rng, 80)) for _ in range(150)]
    real = jaccard._open_pairs
    monkeypatch.setattr(jaccard, "_open_pairs", lambda keyed, block: rows.append(real(keyed, block).count()) or real(keyed, block))
    found = jaccard.groups(frame(spark, texts)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == set(enumerate(plain_groups(texts)))
    assert rows[0] < 10 * len(texts)


def test_sketches_rule_out_no_similar_pair():
    rng = random.Random(4)
    for n in (1, 2, 9, 60, 300, 3000):
        for _ in range(30):
            x = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            kept = rng.sample(range(len(x)), rng.randint((4 * len(x) + 4) // 5, len(x)))
            added = [rng.getrandbits(64) for _ in range(rng.randint(0, n // 8))]
            y = np.unique(np.concatenate([x[kept], np.array(added, np.uint64)]))
            differ = sum((int(a) ^ int(b)).bit_count() for a, b in zip(jaccard.sketch(x).view(np.uint64), jaccard.sketch(y).view(np.uint64), strict=True))
            assert not jaccard.similar(x, y) or 9 * differ <= len(x) + len(y)


def test_equal_fingerprints_of_different_texts(spark):
    """Texts with one fingerprint of 64 bits, of which only the one that isn't first has a near copy."""
    rng = random.Random(1)
    base = prose(rng, 400)
    print_of = lambda words: simhash.fingerprint(" ".join(words).encode(), 5)
    near = [base]
    while len(near) < 6:
        if print_of(other := edited(rng, near[-1], 1)) == print_of(base):
            near.append(other)
    texts = [" ".join(w) for w in [*near, edited(rng, near[-1], 8)]]
    expected = plain_groups(texts)
    rows = jaccard.groups(frame(spark, texts)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == set(enumerate(expected))
    assert kept(spark, texts) == sorted(set(expected))


def test_odd_tables(spark):
    assert jaccard.groups(frame(spark, []).limit(0)).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (2, "A b"), (2, "A b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in jaccard.drop_near_duplicates(docs).collect()) == [0, 2]
