"""Operators over tables: values, CSL, citations, tallies, curation, web abstracts, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import bibliography, csl, values
from marginalia.functions.citations import Citations
from marginalia.operators import articles, citations, curation, jats, tallies, webstracts
from marginalia.sources import files, nodes


def article_row(i: str, body: str = "<p>x</p>", back: str = "") -> tuple:
    text = f"<article><front><article-meta><title-group><article-title>T {i}</article-title></title-group></article-meta></front><body>{body}</body>{back}</article>"
    return i, bytearray(text.encode())


@pytest.fixture(scope="module")
def corpus(spark):
    refs = '<back><ref-list><ref id="a"><element-citation><person-group person-group-type="author"><name><surname>Roe</surname><given-names>Ann B.</given-names></name><name><surname>Doe</surname></name><etal/></person-group><article-title>On &lt; it</article-title><year>2001</year><fpage>1</fpage><lpage>9</lpage><uri>https://e.org/?a=1&amp;b=2</uri><comment>c</comment></element-citation></ref></ref-list></back>'
    rows = [article_row("1", '<p>see <xref rid="a">1</xref></p>', refs), article_row("2"), ("3", bytearray(b"<broken")), ("4", None)]
    return articles.articles(spark.createDataFrame(rows, "article_id string, content binary")).cache()


def test_articles(corpus):
    rows = {r.article_id: r for r in corpus.collect()}
    assert rows["1"].valid and rows["2"].refs is None
    assert not rows["3"].valid and not rows["4"].valid
    assert articles.issues(corpus).where("article_id = '3'").first().condition == ["XMLSyntaxError"]


def test_csl_and_styles(corpus):
    refs = F.col("refs")
    row = corpus.where("article_id = '1'").select(csl.list_to_json(refs).alias("c"), csl.list_to_json(csl.list_from_json(csl.list_to_json(refs))).alias("d"), bibliography.html_list(refs).alias("full"), bibliography.html_list(refs, True).alias("short")).first()
    item = json.loads(row.c)[0]
    assert item["container-title"] is None and item["page"] == "1-9" and item["author"][2] == {"literal": "others"}
    assert json.loads(row.d) == json.loads(row.c)
    assert "\n<i>On &lt; it</i>.\n" in row.full  # an article without a source has no container
    assert "Roe, Ann B.,\nDoe,\net al.\n" in row.full and "pp. 1–9" in row.full and "<div>c</div>" in row.full
    assert "Roe AB,\nDoe,\net al.\nOn &lt; it.\n" in row.short
    assert '<a href="https://e.org/?a=1&amp;b=2">' in row.full


def test_csl_of_other_json(spark):
    rows = spark.createDataFrame([("null",), ('{"id": "x"}',), ('[1, {"id": "y", "title": "t"}]',), ("[]",)], "j string")
    got = rows.select(F.size(csl.list_from_json(F.col("j"))).alias("n")).collect()
    assert [r.n for r in got] == [-1, -1, 1, 0] or [r.n for r in got] == [None, None, 1, 0]


@pytest.mark.parametrize(("text", "number"), [("3", 3), ("3rd", 3), ("21st ed.", 21), ("4th Ed", 4), (" 5 ", 5), ("x", None), ("", None), ("1_0", 10)])
def test_edition(spark, text, number):
    assert values.edition_of(text) == number
    assert spark.createDataFrame([(text,)], "t string").select(values.edition(F.col("t"))).first()[0] == number


def git_tree(entries):
    import hashlib

    def sha(kind, data):
        return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).digest()

    body = b""
    for name, value in sorted(entries.items(), key=lambda e: e[0] + "/" * isinstance(e[1], dict)):
        inner = git_tree(value) if isinstance(value, dict) else sha("blob", value)
        body += f"{'40000' if isinstance(value, dict) else '100644'} {name}\0".encode() + inner
    return sha("tree", body)


def test_directory_identifiers(spark):
    tree = {"a": b"1", "b": {"c": b"2", "d": {"e": b""}}, "b.x": b"3", "b0": b"4"}
    flat = [("r", p, bytearray(c)) for p, c in (("a", b"1"), ("b/c", b"2"), ("b/d/e", b""), ("b.x", b"3"), ("b0", b"4"))]
    rows = values.directory_swhids(spark.createDataFrame([*flat, ("s", "x", bytearray(b"y"))], "root string, path string, content binary")).collect()
    assert {r.root: r.swhid for r in rows} == {"r": "swh:1:dir:" + git_tree(tree).hex(), "s": "swh:1:dir:" + git_tree({"x": b"y"}).hex()}


def test_directory_identifier(spark):
    row = spark.createDataFrame([("article.xml", bytearray(b"hello"))], "name string, c binary")
    found = row.select(values.tree_swhid(F.array(F.struct("name", values.blob_swhid(F.col("c")).alias("swhid"), F.lit(False).alias("folder")))).alias("t"), values.blob_swhid(F.col("c")).alias("b")).first()
    assert found.b == "swh:1:cnt:b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"
    assert found.t.startswith("swh:1:dir:") and len(found.t) == 50


def test_numbers_agree_with_the_walk(spark):
    """Window functions against the walk, on random lists and citations."""
    rng = random.Random(3)
    cites, refs, expected = [], [], {}
    for a in range(60):
        n = rng.randint(1, 6)
        ids = [f"r{i}" for i in range(n)]
        refs += [(str(a), i, rid) for i, rid in enumerate(ids)]
        pool = Citations(ids)
        for pos in range(rng.randint(0, 8)):
            place = rng.randint(0, n)
            printed = place + 1 if rng.random() < 0.7 else None
            cites.append((str(a), pos, f"r{place}", printed))
            pool.number(f"r{place}", printed)
        expected |= {(str(a), i): k + 1 for k, i in enumerate(pool.used)}
    got = citations.number(spark.createDataFrame(cites, "article_id string, pos int, rid string, printed int"), spark.createDataFrame(refs, "article_id string, zidx int, id string"))
    assert {(r.article_id, r.zidx): r.rord for r in got.collect()} == expected


def test_every(spark):
    rows = spark.range(103).repartition(5)
    assert sorted(r.id for r in curation.every(rows, 10, "id").collect()) == list(range(0, 103, 10))


def test_tallies(spark):
    scanned = nodes.scan_xml(spark.createDataFrame([article_row("1", "<p>a<b>x</b></p><p/>")], "article_id string, content binary"))
    assert {r.tag: r.n for r in tallies.tags(scanned).collect()}["p"] == 2
    pairs = {(r.parent_tag, r.tag): r.n for r in tallies.parents_and_children(scanned).collect()}
    assert pairs["p", "b"] == 1 and pairs["p", "TOTAL"] == 1 and pairs["body", "p"] == 2
    span = scanned.where("tag = 'body'").first()
    assert span.post - span.pre == 3


def test_html_scan(spark):
    page = "<html><body><p>one<p>two<br>x</b><ul><li>a<li>b</ul><!-- <a> --><script>'<a>'</script></body>"
    scanned = nodes.scan_html(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    paths = ["/".join(r.path[1:]) for r in scanned.where("article_id = '1'").orderBy("pre").collect()]
    assert paths.count("html/body/p") == 2 and paths.count("html/body/ul/li") == 2 and not any(p.endswith("a") for p in paths)


def test_webstracts(corpus):
    made = webstracts.webstracts(corpus)
    data = {r.article_id: json.loads(r.webstract) for r in webstracts.to_json(made).collect()}
    assert set(data) == {"1", "2"}
    assert data["1"]["title"] == "T 1" and data["1"]["csljson"][0]["id"] == "a" and "csljson" not in data["2"]
    assert list(data["1"]) == sorted(data["1"])
    assert "<h1>T 2</h1>" in webstracts.page(made).where("article_id = '2'").first().html


def test_jats(corpus):
    text = jats.to_jats(corpus.where("article_id = '1'")).first().jats
    assert '<xref rid="a" ref-type="bibr">1</xref>' in text and "<journal-meta>" in text and "<source>" not in text
    assert jats.convert("<x/>") is None and jats.convert(None) is None


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "article.xml").write_bytes(bytes(article_row("1")[1]))
    assert articles.articles(files.read_articles(spark, str(tmp_path))).first().title == "T 1"
    header = "AccessionID\tArticle Citation\tLicense\tRetracted\tLast Updated (YYYY-MM-DD HH:MM:SS)\n"
    lines = "PMC1\tJ A. 2020\tCC BY\tno\t2020-01-02 03:04:05\nPMC2\tJ B. 2020\tCC BY\tyes\t2020-01-02\nPMC3\tJ B. 2020\tOTHER\tno\t2020-01-02\n"
    (tmp_path / "list.txt").write_text(header + lines)
    files.make_index(spark, [str(tmp_path / "list.txt")], str(tmp_path / "index"), "2020-01-01", "2021-01-01")
    row = files.entry_path(spark.read.parquet(str(tmp_path / "index"))).first()
    assert (row.pmcid, row.journal_id, row.path) == (1, "J A", "oa_comm/xml/all/PMC1.xml")
    with pytest.raises(Exception, match="exists|PATH_ALREADY_EXISTS"):
        files.make_index(spark, [str(tmp_path / "list.txt")], str(tmp_path / "index"), "2020-01-01", "2021-01-01")
    assert files.read_lines(spark, str(tmp_path / "missing")).count() == 0


def test_deep_documents_do_not_fail_a_job(spark):
    deep = "<article><body><p>" + "<b>" * 100_000 + "x" + "</b>" * 100_000 + "</p></body></article>"
    raw = spark.createDataFrame([("1", deep.encode()), ("2", b"<article><front/><body><p>y</p></body></article>")], "article_id string, content binary")
    rows = {r.article_id: r for r in articles.articles(raw).collect()}
    assert not rows["1"].valid and rows["1"].issues[0].condition[0] == "Unreadable" and rows["2"].valid
    found = nodes.scan_xml(raw).groupBy("article_id").agg(F.count("*").alias("n"), F.max(F.size("path")).alias("longest")).collect()
    assert {r.article_id: r.n for r in found} == {"1": 100_003, "2": 4} and max(r.longest for r in found) == nodes.LONGEST_PATH


def test_article_files(spark, tmp_path):
    rows = spark.createDataFrame([("a1", "<article>é\n</article>"), ("b2", "<x/>"), ("c3", None)], "article_id string, xml string")
    webstracts.write_articles(rows.repartition(2), str(tmp_path / "out"))
    webstracts.write_articles(rows.where("article_id = 'b2'"), str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a1/article.xml": "<article>é\n</article>", "b2/article.xml": "<x/>"}
    with pytest.raises(ValueError, match="names of folders"):
        webstracts.write_articles(spark.createDataFrame([("a/b", "x")], "article_id string, xml string"), str(tmp_path / "no"))


def test_stored_webstracts_are_read_again(spark, tmp_path):
    raw = spark.createDataFrame([("1", b"<article><front><article-meta><title-group><article-title>A <b>t</b></article-title></title-group></article-meta></front><body><p>x</p></body></article>")], "article_id string, content binary")
    made = webstracts.to_json(webstracts.webstracts(articles.articles(raw)))
    (tmp_path / "w.json").write_text(made.first().webstract)
    row = files.read_webstracts(spark, str(tmp_path / "w.json")).first()
    assert row.title == "A <strong>t</strong>" and row.body == "<p>x</p>\n" and row.bare_tex is False
    assert webstracts.missing(raw, made).count() == 0


def test_page_without_edition(spark):
    raw = spark.createDataFrame([("1", b"<article><front/><body><p>x<sc>y</sc></p></body></article>")], "article_id string, content binary")
    rows = webstracts.webstracts(articles.articles(raw).withColumn("source", F.lit("swh:1:dir:abc")))
    html = webstracts.page(rows, banner="Draft", link_issues=True).first().html
    assert "<header>Draft</header>" in html and "<h1>No Title</h1>" in html and 'href="issues/"' in html
    assert "citation" not in html and '<p class="source">swh:1:dir:abc</p>' in html
    archived = webstracts.page(rows.withColumn("archive_date", F.lit("2020-01-02"))).first().html
    assert 'href="https://archive.softwareheritage.org/swh:1:dir:abc"' in archived and "issues/" not in archived


def test_lists_and_issue_pages(spark, tmp_path):
    values_ = spark.createDataFrame([("b",), ("a",), ("b",)], "value string")
    files.write_lines(values_, str(tmp_path / "list"))
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "list")).collect()] == ["a", "b"]
    assert files.read_lines(spark, str(tmp_path / "none")).count() == 0
    targets = spark.createDataFrame([("1", 5), ("2", 9)], "article_id string, modified long")
    sources = spark.createDataFrame([("1", 7), ("2", 7), ("3", 7)], "article_id string, modified long")
    assert sorted(r.article_id for r in files.up_to_date(targets, sources).collect()) == ["1", "3"]
    parsed = articles.articles(spark.createDataFrame([("1", b"<article><front/><body><p><sc>x</sc></p></body></article>")], "article_id string, content binary"))
    html = parsed.select(articles.html_issues(F.col("issues")).alias("h")).first().h
    assert html.startswith("<ul>\n<li>") and "UnsupportedElement sc p (line 1)" in html and html.endswith("</ul>\n")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from marginalia import __main__ as cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in/article.xml").write_text("<article><front/><body><p>x</p></body></article>")
    for kind in ("xml", "json", "html", "jats", "issues"):
        assert cli.main([str(tmp_path / "in"), str(tmp_path / kind), "--to", kind]) == 0
        assert len(spark.read.json(str(tmp_path / kind)).collect()) == 1
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "files"), "--to", "files"]) == 0
    assert (tmp_path / "files/in/article.xml").read_text().startswith("<article>")
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert capsys.readouterr().out.startswith("marginalia ")


def test_verdicts_on_journals(spark):
    rows = [("few", True, "x", 10, 10, 0, 0), ("all", True, "x", 11, 11, 3, 0), ("half", True, "x", 12, 5, 0, 0), ("six", True, "x", 12, 6, 0, 0), ("bad", True, "news", 1, 1, 1, 1), ("gone", False, "x", None, None, None, None)]
    cases = spark.createDataFrame(rows, "journal_id string, found boolean, article_type string, cites int, ecites int, odd_fields int, reject_fields int")
    found = {r.journal_id: r for r in curation.classify_journals(cases).collect()}
    assert {k: r.verdict for k, r in found.items()} == {"few": "undecided", "all": "unmixed", "half": "mixed", "six": "undecided", "bad": "reject", "gone": "undecided"}
    assert (found["gone"].total, found["gone"].local, found["gone"].cites, found["bad"].skipped) == (1, 0, 0, 1)


def test_stream(spark, tmp_path):
    from marginalia.streaming.ingest import ingest

    for i in "ab":
        (tmp_path / "in" / i).mkdir(parents=True)
        (tmp_path / "in" / i / "article.xml").write_bytes(bytes(article_row(i)[1]))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["T a", "T b"]


def test_scan_of_some_tags(spark):
    raw = spark.createDataFrame([article_row("1", "<p>a<b>x</b></p><p/>"), article_row("2", "<p/>")], "article_id string, content binary")
    whole = sorted((r.article_id, r.pre, r.post, r.path) for r in nodes.scan_xml(raw).where("tag = 'p'").collect())
    some = nodes.scan_xml(raw, columns="article_id nth pre post path", tags=("p",)).collect()
    assert sorted((r.article_id, r.pre, r.post, r.path) for r in some) == whole
    assert sorted((r.article_id, r.nth) for r in some) == [("1", 0), ("1", 1), ("2", 0)]


def test_dangling_citations_by_either_way(spark):
    body = '<p><xref rid="a" ref-type="bibr">1</xref><xref rid="x" ref-type="bibr"/>; <xref rid="x" ref-type="bibr"/><xref rid="b"/><xref rid="y"/><xref ref-type="bibr"/></p>'
    back = '<back><ref-list><ref id="a"/><ref id="b"/><ref/></ref-list></back>'
    raw = spark.createDataFrame([article_row("1", body, back), article_row("2", body), (None, article_row("3", body, back)[1])], "article_id string, content binary")
    scanned = nodes.scan_xml(raw)
    refs = scanned.where("tag = 'ref'").select("article_id", F.col("ord").alias("zidx"), F.col("attrs")["id"].alias("id"))
    rows = lambda df: sorted(map(str, df.select("article_id", "rid", "pos", "printed", "tail").collect()))
    joined = citations.dangling(citations.xrefs(scanned, refs).where("is_citation"), refs)
    assert rows(citations.dangling_of(scanned.where("tag IN ('ref', 'xref')"))) == rows(joined)
