"""Top-k search, tokenisation, packing and the pipeline against brute force and exact round trips."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import matrices, packing, pieces, tokenize, topk

ODD_TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "\n", "a\n", "\na", "a\n\nb", "don't we'll it's", "x\ty\r\nz", "a b", "　x", "日本語 テスト",
    "<|endoftext|> hi", "1234 5678, 90.", "é" * 50, "\x1c a b", "“quoted” text", "😀 ok", "b" * 3000, "▁▁ marker", "word " * 500,
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def brute_top(rows, k=20):
    usable = [(u, i, [int(np.floor(64.0 * x)) for x in v]) for u, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for u, i, v in usable:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for t, j, w in usable if t != u)[:k]
            out += [(i, rank + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("large", [False, True])
def test_topk(spark, large, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)) * (200 if large else 0.2)
    vectors[50:90] = vectors[10]  # ties
    vectors[100] *= 50  # one that wins everywhere
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(500, None), (520, [None, 1.0]), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [1.0] * 8), (0, rows[0][1]), (580, [1.0, 2.0]), (600, [])]
    frame = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    got = topk.search(frame, "vec_id % 20 = 0", shares=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows)


def test_topk_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame, "vec_id % 20 = 0").collect()] == [(0, 1, 1, 8192)]
    assert topk.search(frame.limit(0), "vec_id % 20 = 0").count() == 0


def test_index_spares_work():
    """Most pairs of vectors with a few large components are never scored exactly, and the result is exact."""
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(3000, 64)) ** 5).astype(np.int64)
    ids = np.arange(3000)
    best = topk.TopK(ids[:10].astype("<i8"), ids[:10].astype("<i8"), vectors[:10], 5)
    for at in range(0, 3000, 1000):
        names = ["share", "uids", "ids", "dims", "vectors", "segments", "posting_dims", "posting_rows", "impacts", "rests"]
        best.add(dict(zip(names, topk.index_block(0, ids[at : at + 1000].astype("<i8"), ids[at : at + 1000].astype("<i8"), vectors[at : at + 1000]), strict=True)))
    scores = vectors[:10] @ vectors.T
    for q in range(10):
        scores[q, q] = -(10**15)
        expected = sorted(range(3000), key=lambda j: (-scores[q, j], j))[:5]
        assert best.members[best.rows == q].tolist() == expected
    assert best.exact < 0.2 * best.seen


@pytest.mark.parametrize("size", [2.0**20, 2.0**26, 2.0**40, 1e30, 1e150, 1e250])
def test_components_of_any_size(spark, size):
    """Scores that are close to each other, of components whose products pass 53 or 63 bits or don't fit a double: the order is exact."""
    rng = np.random.default_rng(7)
    for dims in (1, 3, 40):
        base = rng.normal(size=dims) * size
        vectors = np.floor(base * (1 + rng.integers(-3, 4, size=(300, dims)) * 2.0**-50))
        vectors[::3] = np.floor(rng.normal(size=(100, dims)) * rng.choice([1, 3, size], size=(100, 1)))
        best = topk.TopK(np.arange(6), np.arange(6), vectors[:6], 5)
        for at in range(0, 300, 100):
            names = ["share", "uids", "ids", "dims", "vectors", "segments", "posting_dims", "posting_rows", "impacts", "rests"]
            ids = np.arange(at, at + 100).astype("<i8")
            best.add(dict(zip(names, topk.index_block(0, ids, ids, vectors[at : at + 100]), strict=True)))
        whole = [[int(x) for x in v] for v in vectors]
        for q in range(6):
            scores = {j: sum(a * b for a, b in zip(whole[q], whole[j], strict=True)) for j in range(300) if j != q}
            assert best.members[best.rows == q].tolist() == sorted(scores, key=lambda j: (-scores[j], j))[:5], (dims, q)


def test_topk_beyond_64_bits(spark):
    rows = [(20 * i if i < 3 else 20 * i + 1, [float(x) * 1e12, 1.0]) for i, x in enumerate([3, -2, 5, 7, 7, -9, 1e-12, 0, 8])] + [(7, []), (9, [2.0e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(frame, "vec_id % 20 = 0", k=20, shares=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows)
    assert [topk.ordered(x) for x in sorted([-(2**70), -5, 0, 3, 300, 2**64])] == sorted(topk.ordered(x) for x in [3, 0, 2**64, -5, 300, -(2**70)])


def test_blocks_are_dealt_to_all_shares(spark):
    stored = topk.quantised(spark.range(4000).selectExpr("id AS vec_id", "array(cast(id AS double)) AS embedding").repartition(32))
    shares = [r.share for r in topk.build_index(stored, 16).select("share").collect()]
    assert len(shares) >= 32 and max(map(shares.count, range(16))) <= min(map(shares.count, range(16))) + 1


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenize.default_byte_level_path())


def random_texts(seed, n, longest=3000):
    rng = random.Random(seed)
    syllables = ["the", "ing", "er", "on", "é", "st", "W", "ly", "x"]
    make = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", ",", ".", "!?"])
    return [rng.choice([" ", " ", "\n"]).join(make() for _ in range(rng.randint(0, rng.choice([5, 100, longest])))) for _ in range(n)]


def test_byte_level_ids(reference):
    texts = ODD_TEXTS + random_texts(1, 100) + ["b " * 900, "a" * 20_000, " " * 20_000 + "x", "x" + "\x1c!" * 9000, "a\x85b", "x <|endoftext|>\n\n<|endoftext|> y", "𝒳 ok", "ꟊ new"]
    expected = [np.array(e.ids, "<u4").tobytes() for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = tokenize.ByteLevelEncoder(tokenize.default_byte_level_path())
    assert encoder.encode(texts) == expected
    assert encoder.encode(texts[::-1]) == expected[::-1]
    assert encoder.quick is not None and np.frombuffer(encoder.encode(["<|endoftext|>"])[0], "<u4").tolist() == [50256]
    encoder.quick, encoder.cache.limit = None, 5  # all by the tokenizers library, with a full cache
    assert encoder.encode(texts) == expected and encoder.encode(texts) == expected
    assert len(encoder.cache.known) >= 5


def test_settled_characters(reference):
    """Whatever goes to tiktoken has the tokenizers library's ids: every such character next to a letter, a digit, a mark and white space."""
    settled = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and not tokenize.unsettled().match(chr(c))]
    assert len(settled) > 40_000
    texts = [f"a{c}a 1{c}1 .{c}. {c}{c} {c}\n" for c in settled]
    own = tokenize.byte_level(tokenize.default_byte_level_path()).encode(texts)
    assert own == [np.array(e.ids, "<u4").tobytes() for e in reference.encode_batch_fast(texts, add_special_tokens=False)]


def check_packing(rows, texts, reference, size=1024):
    ids = [np.array([*e.ids, 0], "<u4") for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at < size and at & (at - 1) == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_packing(spark, reference, parts):
    texts = ODD_TEXTS + random_texts(2, 120)
    rows = packing.with_digest(packing.pack(documents(spark, texts).repartition(parts), n_open=4)).collect()
    check_packing(rows, texts, reference)


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    rows = packing.pack(documents(spark, [None])).collect()
    assert [(r.doc_id, r.start, r.length, bytes(r.ids), r.offset) for r in rows] == [(0, 0, 1, b"\0\0\0\0", 0)]


def test_open_windows_are_bounded():
    rows = packing.Rows(0)
    windows = packing.OpenWindows(rows, 100, 3)
    rng = random.Random(8)
    for i in range(500):
        windows.place(packing.Piece(i, 60, 0, bytes(4 * rng.randint(51, 70))))
        assert len(windows.windows) <= 3
    assert all(r[6] + r[2] <= 100 for r in rows.rows)


def test_room_tree():
    rng = random.Random(7)
    tree, plain = matrices.RoomTree(64), []
    for i in range(2000):
        if rng.random() < 0.5:
            room = rng.randint(0, 64)
            tree.add(room, i)
            plain.append(room)
        else:
            need = rng.randint(1, 64)
            fits = [r for r in plain if r >= need]
            got = tree.take(need)
            assert (got[0] if got else None) == (min(fits) if fits else None)
            if fits:
                plain.remove(min(fits))


def test_matrices(spark, reference, tmp_path):
    texts = ODD_TEXTS + random_texts(3, 80)
    rows = matrices.pack_rows(documents(spark, texts), size=256)
    matrices.write_matrices(rows, str(tmp_path / "m"))
    ids = [[*e.ids, 50256] for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    seen = {i: {} for i in range(len(texts))}
    padding = used = 0
    for r in matrices.read_matrices(spark, str(tmp_path / "m")).collect():
        row, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(row) == len(positions) == 256 and r.cu_seqlens[0] == 0
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            seen[doc][start] = row[a:b].tolist()
        assert (row[r.cu_seqlens[-1] :] == 50256).all()
        padding, used = padding + 256 - r.cu_seqlens[-1], used + r.cu_seqlens[-1]
    for doc, parts in seen.items():
        assert sum((parts[s] for s in sorted(parts)), []) == ids[doc]
    assert padding < 0.05 * used
    assert matrices.digest(rows).count() == sum(map(len, seen.values()))
    assert matrices.pack_rows(documents(spark, [])).count() == 0


def test_sentencepiece(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 1000)  # in this process
    texts = ODD_TEXTS + random_texts(4, 100, 300)
    other = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = pieces.encode(docs)
    rows = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    own = pieces.Encoder(pieces.default_path())
    again = own.encode(texts)  # in small blocks
    for i, text in enumerate(texts):
        ids = other.encode(text or "")
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids, text
        assert rows[i].text == back[i] == other.decode(ids) == (text or "").replace("▁", " "), text
        assert rows[i].n_differed == 0 and (rows[i].n_compared > 0) == bool(text)
        assert again[i] == (rows[i].ids, rows[i].n_compared, 0)
    # what was compared belongs to the text, not to the worker that had it
    assert rows[3].n_compared == 1 and rows[6].n_compared == 2
    assert pieces.digest(docs.limit(0)).count() == 0


def test_units(monkeypatch):
    """A full table of units, units of any length, and libraries that differ."""
    texts = ["x" * 30_000, "日本" * 9000, "word " * 5000, "9" * 3000] + random_texts(5, 30, 200)
    monkeypatch.setattr(pieces, "KNOWN", 7)
    monkeypatch.setattr(pieces, "BLOCK", 500)
    own = pieces.Encoder(pieces.default_path())
    assert [np.frombuffer(x[0], "<u4").tolist() for x in own.encode(texts)] == own.other.encode(texts) and len(own.units) == 7
    class Other:
        encode = staticmethod(lambda texts, num_threads: [[0, 0, *([7] if "word" in x else own.tokenizer.encode(x[1:].replace(" ", "▁")).ids)] for x in texts])

    odd = pieces.Encoder(pieces.default_path())
    odd.other = Other
    assert odd.encode(["a word", "word, no word", "a"])[0][2] == 1 and odd.encode(["a word", "word, no word", "a"])[1][1:] == (4, 2)


def message(*parts):
    """A protobuf message of (number, value): integers, floats, bytes or messages."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + np.array(value, "<f4").tobytes()
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_model(tmp_path):
    """A hand-made unigram model: the best path by scores, bytes for what is unknown."""
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁ab", -4.0, 1), ("aba", -9.0, 1)]
    vocabulary += [(f"<0x{i:02X}>", -10.0, 6) for i in range(256)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocabulary)
    data += message((2, message((3, 1), (35, 1), (40, 0)))) + message((3, message((1, b"identity"), (3, 1), (4, 0))))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    other = sentencepiece.SentencePieceProcessor(model_file=str(path))
    encoder = pieces.Encoder(str(path))
    assert encoder.model.kind == pieces.UNIGRAM and encoder.model.byte_fallback
    texts = ["ab", "aba ab", "b  a", "aé", "", "abab abba"]
    assert [np.frombuffer(x, "<u4").tolist() for x, _, _ in encoder.encode(texts)] == other.encode(texts)
    assert sum(d for _, _, d in encoder.encode(texts)) == 0
    assert [encoder.model.decode(np.array(x, "<u4")) for x in other.encode(texts)] == texts


def test_model_with_a_normaliser(tmp_path):
    """Characters are mapped and extra spaces removed: whole texts are compared, and differing ones reported."""
    spec = dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    charsmap = dict(pieces.fields(spec))[2]
    vocabulary = [("<unk>", 0.0, 2), ("▁", -3.0, 1), *((c, -4.0, 1) for c in "abcdef19"), ("ab", -3.0, 1), ("▁ab", -4.0, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocabulary)
    data += message((2, message((3, 1), (40, 0)))) + message((3, message((2, charsmap), (3, 1), (4, 1))))
    path = tmp_path / "n.model"
    path.write_bytes(data)
    encoder = pieces.Encoder(str(path))
    texts = ["ab  ab", " ab ", "ａｂ ①⑨", "ab\tab\nab", "", None, "xyz ab zz", "ﬁab"]
    own = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x, _, _ in own] == encoder.other.encode([t or "" for t in texts])
    assert [n for _, n, _ in own] == [1, 1, 1, 1, 0, 0, 1, 1] and not any(d for _, _, d in own)
    encoder.model.charsmap = b""
    encoder.model.__dict__.pop("normalizer", None)
    assert [d for _, _, d in encoder.encode(texts)] == [0, 0, 1, 1, 0, 0, 0, 1]


def test_pipeline(spark, reference, tmp_path):
    """All stages on a few documents, against what each is to do with them."""
    rng = random.Random(11)
    sentence = lambda n: " ".join("".join(rng.choices(["ba", "to", "ri", "ne", "lu"], k=rng.randint(1, 4))) for _ in range(n)) + "."
    prose = lambda n: "\n".join(sentence(12) for _ in range(n))
    passage = sentence(60)
    texts = [prose(10), prose(10), None, "too short", "\n".join("a | b | c | d" for _ in range(40))]
    texts += [texts[0], prose(8) + "\n" + passage, prose(8) + "\n" + passage]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept == [[0, 1, 5, 6, 7], [0, 1, 5, 6, 7], [0, 1, 6, 7], [0, 1, 6, 7]]
    final = {r.doc_id: r for r in docs.collect()}
    assert final[6].text == texts[6] and passage not in final[7].text and final[7].n_chars == len(final[7].text)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) == sum(len(e.ids) + 1 for e in reference.encode_batch([r.text for r in final.values()], add_special_tokens=False))
    assert corpus_pipeline.ORACLE_SQL is None and pa.__version__
