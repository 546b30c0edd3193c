"""Queries over articles made from plain tables, and the same facts as SQL straight from these tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import bibliography, csl, values
from marginalia.operators import articles, citations, curation, jats, tallies, webstracts
from marginalia.plans import corpora
from marginalia.plans.corpora import table
from marginalia.sources import files, nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query by its function's name, and its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _article_id() -> F.Column:
    return F.col("article_id").cast("long").alias("article_id")


# ---- references

_PART_CSL = """
SELECT p_partkey AS article_id, 'r' || p_partkey AS id, p_name AS title, p_type AS container, p_size::VARCHAR AS volume,
  CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 10) || '-' || (p_partkey * 10 + 7) ELSE (p_partkey * 10)::VARCHAR END AS page,
  CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 40 + 1)::VARCHAR END AS edition, '10.5555/' || p_partkey AS doi,
  p_brand AS family, 'Ada ' || substr(p_type, 1, 1) AS given,
  '[[' || (p_partkey % 50 + 1970) || CASE WHEN p_partkey % 4 <> 0 THEN ',' || (p_partkey % 12 + 1) ELSE '' END || CASE WHEN p_partkey % 4 = 2 THEN ',' || (p_partkey % 28 + 1) ELSE '' END || ']]' AS issued
FROM part
"""


def _csl_fields(rows: DataFrame) -> DataFrame:
    get = lambda path: F.get_json_object("csl", f"$[0]{path}")
    named = {"id": ".id", "title": ".title", "container": "['container-title']", "volume": ".volume", "page": ".page", "edition": ".edition", "doi": ".DOI", "family": ".author[0].family", "given": ".author[0].given", "issued": ".issued['date-parts']"}
    return rows.select(_article_id(), *(get(p).alias(n) for n, p in named.items()))


@query(_PART_CSL)
def ref_csl_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as CSL-JSON."""
    parsed = articles.articles(corpora.part_references(spark, sf_dir), fields="refs")
    return _csl_fields(parsed.select("article_id", csl.list_to_json(F.col("refs")).alias("csl")))


@query(_PART_CSL)
def csl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSL-JSON read back into references and written again."""
    parsed = articles.articles(corpora.part_references(spark, sf_dir), fields="refs")
    back = csl.list_from_json(csl.list_to_json(F.col("refs")))
    return _csl_fields(parsed.select("article_id", csl.list_to_json(back).alias("csl")))


_MONTH = "['Jan.', 'Feb.', 'Mar.', 'Apr.', 'May', 'Jun.', 'Jul.', 'Aug.', 'Sep.', 'Oct.', 'Nov.', 'Dec.'][p_partkey % 12 + 1]"
_ORDINAL = "(p_partkey % 40 + 1) || CASE WHEN (p_partkey % 40 + 1) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN (p_partkey % 40 + 1) % 10 = 1 THEN 'st' WHEN (p_partkey % 40 + 1) % 10 = 2 THEN 'nd' WHEN (p_partkey % 40 + 1) % 10 = 3 THEN 'rd' ELSE 'th' END || ' ed.'"
_SQL_PAGES = "CASE WHEN p_partkey % 2 = 0 THEN 'pp. ' || (p_partkey * 10) || '–' || (p_partkey * 10 + 7) ELSE 'p. ' || (p_partkey * 10) END"
_SQL_LINK = "'<a href=\"https://doi.org/10.5555/' || p_partkey || '\">https://doi.org/10.5555/' || p_partkey || '</a>'"


@query(f"""
SELECT p_partkey AS article_id, replace(p_brand || ', Ada ' || substr(p_type, 1, 1) || '.' || chr(10) || '“' || p_name || '”.' || chr(10) ||
  concat_ws(',' || chr(10), '<i>' || p_type || '</i>', CASE WHEN p_partkey % 3 = 0 THEN {_ORDINAL} END, 'vol. ' || p_size,
    concat_ws(' ', CASE WHEN p_partkey % 4 = 2 THEN (p_partkey % 28 + 1)::VARCHAR END, CASE WHEN p_partkey % 4 <> 0 THEN {_MONTH} END, (p_partkey % 50 + 1970)::VARCHAR),
    {_SQL_PAGES}, {_SQL_LINK}) || '.', '..' || chr(10), '.' || chr(10)) AS full_style
FROM part
""")
def bibliography_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in the full style."""
    refs = articles.references(articles.articles(corpora.part_references(spark, sf_dir), fields="refs"))
    ref = F.struct(*(F.col(c) for c in refs.columns if c not in ("article_id", "zidx")))
    return refs.select(_article_id(), bibliography.full(ref).alias("full_style"))


@query(f"""
SELECT p_partkey AS article_id, rtrim(replace(p_brand || ' A' || substr(p_type, 1, 1) || '.' || chr(10) || p_name || '.' || chr(10) || p_type || '.' || chr(10) ||
  CASE WHEN p_partkey % 3 = 0 THEN {_ORDINAL} || '.' || chr(10) ELSE '' END ||
  CASE WHEN p_partkey % 3 = 0 THEN 'Vol. ' || p_size || '.' || chr(10) || d || '.' || chr(10) || {_SQL_PAGES} || '.' || chr(10)
  ELSE d || ';' || p_size || ':' || CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 10) || '–' || (p_partkey * 10 + 7) ELSE (p_partkey * 10)::VARCHAR END || '.' || chr(10) END ||
  {_SQL_LINK} || '.', '..' || chr(10), '.' || chr(10)), chr(10)) AS short_style
FROM (SELECT *, concat_ws(' ', (p_partkey % 50 + 1970)::VARCHAR, CASE WHEN p_partkey % 4 <> 0 THEN rtrim({_MONTH}, '.') END, CASE WHEN p_partkey % 4 = 2 THEN (p_partkey % 28 + 1)::VARCHAR END) AS d FROM part)
""")
def bibliography_abridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in the short style."""
    refs = articles.references(articles.articles(corpora.part_references(spark, sf_dir), fields="refs"))
    ref = F.struct(*(F.col(c) for c in refs.columns if c not in ("article_id", "zidx")))
    return refs.select(_article_id(), bibliography.abridged(ref).alias("short_style"))


# ---- citations

_NUMBERED = """
SELECT l_orderkey AS article_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY first))::INTEGER AS rord, 'p' || l_partkey AS id
FROM (SELECT l_orderkey, l_partkey, min(l_linenumber * 10000000 + l_partkey) AS first FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY ALL)
"""


@query(_NUMBERED)
def cite_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of parsed articles in the order of first citation; those that aren't cited are gone."""
    refs = articles.cited(articles.articles(corpora.order_citations(spark, sf_dir), fields="cited"))
    return refs.select(_article_id(), (F.col("zidx") + 1).cast("int").alias("rord"), "id")


_KEPT_ORDER = """
WITH refs AS (
  SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS zidx
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 7 <> 0)
), cited AS (
  SELECT l_orderkey, l_partkey, min(l_linenumber * 10000000 + l_partkey) AS pos FROM lineitem GROUP BY ALL
), placed AS (
  SELECT *, coalesce(max(zidx) OVER before, -1) AS furthest FROM cited JOIN refs USING (l_orderkey, l_partkey)
  WINDOW before AS (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, max(CASE WHEN zidx > furthest AND pos // 10000000 <> zidx + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS late FROM placed
), kept AS (
  SELECT *, coalesce(max(CASE WHEN late = 0 THEN zidx END) OVER (PARTITION BY l_orderkey), -1) AS k FROM judged
)
SELECT l_orderkey AS article_id, 'p' || l_partkey AS id, (zidx + 1)::INTEGER AS rord FROM refs JOIN (SELECT DISTINCT l_orderkey, k FROM kept) USING (l_orderkey) WHERE zidx <= k
UNION ALL
SELECT l_orderkey, 'p' || l_partkey, (k + 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY pos))::INTEGER FROM kept WHERE late = 1 AND zidx > k
"""


@query(_KEPT_ORDER)
def cite_order_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of parsed articles whose citations print the number of their line: the list's order is kept while that fits."""
    refs = articles.cited(articles.articles(corpora.order_citations(spark, sf_dir, F.col("l_linenumber").cast("string")), fields="cited"))
    return refs.select(_article_id(), "id", (F.col("zidx") + 1).cast("int").alias("rord"))


@query(_KEPT_ORDER)
def cite_numbers_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers by window functions over tables of citations and references."""
    lines = table(spark, sf_dir, "lineitem")
    rid = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    cited = lines.select(F.col("l_orderkey").alias("article_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("pos"), rid.alias("rid"), F.col("l_linenumber").alias("printed"))
    parts = lines.where("l_partkey % 7 <> 0").select("l_orderkey", "l_partkey").distinct()
    place = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")) - 1).alias("zidx")
    refs = parts.select(F.col("l_orderkey").alias("article_id"), place, rid.alias("id"))
    return citations.number(cited, refs).select("article_id", "id", "rord")


@query("""
SELECT o_orderkey AS article_id, g.i::INTEGER AS ord, ('r' || CASE WHEN g.i = 0 THEN n ELSE g.i END) AS rid, (CASE WHEN g.i = 0 THEN n ELSE g.i END)::VARCHAR AS shown
FROM (SELECT o_orderkey, o_orderkey % 9 + 2 AS n FROM orders), LATERAL (SELECT unnest(generate_series(0, n)) AS i) g
""")
def cite_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the normal form: a dash between two stands for those between."""
    parsed = articles.articles(corpora.range_articles(spark, sf_dir), fields="xml").select("article_id", F.col("xml").alias("content"))
    found = nodes.scan_xml(parsed, columns="article_id nth attrs text", tags=("xref",))
    return found.select(_article_id(), F.col("nth").alias("ord"), F.col("attrs")["rid"].alias("rid"), F.col("text").alias("shown"))


@query("""
SELECT o_orderkey AS article_id, g.i::INTEGER AS rord, (g.i > 1 AND g.i < n) AS implied
FROM (SELECT o_orderkey, o_orderkey % 9 + 2 AS n FROM orders), LATERAL (SELECT unnest(generate_series(1, n)) AS i) g
""")
def cite_ranges_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same expansion by a window function and explode."""
    n = (F.col("o_orderkey") % 9 + 2).cast("int")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit(1).alias("rord"), F.lit("–").alias("tail")), F.struct(F.lit(1).alias("pos"), n.alias("rord"), F.lit("").alias("tail")))).alias("c"))
    cites = rows.select("article_id", F.lit(1).alias("group"), "c.pos", "c.rord", F.col("c.rord").alias("printed"), "c.tail")
    return citations.expand_ranges(cites).select("article_id", "rord", "implied")


@query("SELECT l_orderkey AS article_id, count(*) AS n FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY ALL")
def dangling_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations without a reference, as issues of parsed articles."""
    found = articles.issues(articles.articles(corpora.order_citations(spark, sf_dir), fields="citation_issues"), "citation_issues")
    return found.groupBy(_article_id()).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS article_id, 'p' || l_partkey AS rid FROM lineitem WHERE l_partkey % 7 = 0")
def dangling_by_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same citations by scanned elements and an anti join of them."""
    scanned = nodes.scan_xml(corpora.order_citations(spark, sf_dir), columns="article_id pre tag attrs text tail", tags=("ref", "xref"))
    return citations.dangling_of(scanned).select(_article_id(), "rid")


# ---- values

@query("""
SELECT bits::INTEGER AS bits, count(*) AS n FROM (SELECT 4 + CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS bits FROM orders) GROUP BY bits
""")
def date_parts_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of partial dates."""
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    bits = values.date_bits(F.year(date), F.when(key % 3 != 0, F.month(date)), F.when(key % 5 == 0, F.day(date)))
    return table(spark, sf_dir, "orders").groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN NULL ELSE (p_partkey % 100)::INTEGER END AS edition FROM part
""")
def edition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of editions, of several spellings."""
    n = (F.col("p_partkey") % 100).cast("string")
    forms = F.array(n, F.concat(n, F.lit("th")), F.concat(n, F.lit("nd ed")), F.concat(n, F.lit("st Ed.")), F.concat(F.lit(" "), n, F.lit(".")), F.concat(F.lit("no. "), n, F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", values.edition(F.get(forms, (F.col("p_partkey") % 6).cast("int"))).alias("edition"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN '000000021825' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE '7' END END AS orcid,
  CASE WHEN c_custkey % 4 < 3 THEN '0000-0002-1825-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE '7' END END AS printed FROM customer
""")
def orcid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORCIDs with and without their address; others are null."""
    key = F.col("c_custkey")
    code = F.concat(F.lit("0000-0002-1825-"), F.lpad((key % 1000).cast("string"), 3, "0"), F.when(key % 2 == 0, "X").otherwise("7"))
    url = F.when(key % 4 == 0, F.concat(F.lit("https://orcid.org/"), code)).when(key % 4 == 1, code).when(key % 4 == 2, F.concat(F.lit("http://orcid.org/"), F.replace(code, F.lit("-"), F.lit("")))).otherwise(F.concat(F.lit("https://example.org/"), code))
    orcid = values.orcid(url)
    return table(spark, sf_dir, "customer").select("c_custkey", orcid.alias("orcid"), values.orcid_19(orcid).alias("printed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '10.1234/' || o_orderkey END AS doi FROM orders")
def doi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs, also with their address before them; others are null."""
    key = F.col("o_orderkey")
    start = F.when(key % 3 == 0, "10.1234/").when(key % 3 == 1, "https://doi.org/10.1234/").otherwise("doi:10.1234/")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.doi(F.concat(start, key.cast("string"))).alias("doi"))


@query("""
SELECT p_partkey AS article_id, (['cc0license', 'ccbylicense', 'ccbysalicense', 'ccbynclicense', 'ccbyncsalicense', 'ccbyndlicense', 'ccbyncndlicense'])[p_partkey % 10 + 1] AS cc_license_type,
  p_name AS license_p, '© ' || (p_partkey % 30 + 1990) || ' <strong>' || p_brand || '</strong>' AS copyright FROM part
""")
def license_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and copyright of parsed articles."""
    parsed = articles.articles(corpora.licensed(spark, sf_dir), fields="cc_license_type license_p copyright")
    return parsed.select(_article_id(), "cc_license_type", "license_p", "copyright")


@query("SELECT doc_id, 'swh:1:cnt:' || sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS swhid FROM documents WHERE text IS NOT NULL")
def blob_swhid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of contents."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", values.blob_swhid(F.col("text").cast("binary")).alias("swhid"))


# ---- front matter, tables, lists, sections

@query("""
SELECT c_nationkey AS article_id, split_part(c_name, '#', 2) AS surname, split_part(c_name, '#', 1) AS given_names,
  CASE WHEN c_custkey % 5 = 0 THEN '0000-0002-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || 'X' END AS orcid
FROM customer WHERE c_custkey % 7 <> 0
""")
def authors_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors with names and ORCIDs; those without a name are gone."""
    found = articles.authors(articles.articles(corpora.customer_authors(spark, sf_dir), fields="authors"))
    return found.select(_article_id(), "surname", "given_names", values.orcid_19(F.col("orcid")).alias("orcid"))


@query("""
SELECT n_regionkey AS article_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS row, 'th' AS tag, 'text-align: right;' AS style, n_nationkey::VARCHAR AS cell FROM nation
UNION ALL
SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER, 'td', NULL, n_name FROM nation
""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the HTML of parsed tables."""
    body = articles.articles(corpora.nation_tables(spark, sf_dir)).select("article_id", "body")
    found = nodes.scan_html(body, "article_id", "body").where(F.array_contains("path", "tbody"))
    rows = found.where("tag = 'tr'").select("article_id", F.col("pre").alias("parent"), F.col("ord").alias("row"))
    cells = found.where("tag IN ('th', 'td')").drop("ord").join(rows, ["article_id", "parent"])
    return cells.select(_article_id(), "row", "tag", F.col("attrs")["style"].alias("style"), F.col("text").alias("cell"))


@query("""
SELECT conv_id AS article_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS item, role AS term, trim(regexp_replace(text, '[\\x00-\\x20]+', ' ', 'g')) AS definition
FROM conversations WHERE text IS NOT NULL
""")
def def_list_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and definitions of the normal form."""
    parsed = articles.articles(corpora.conversation_lists(spark, sf_dir), fields="xml").select("article_id", F.col("xml").alias("content"))
    found = nodes.scan_xml(parsed)
    items = found.where("tag = 'div'").select("article_id", "pre", "post", F.col("ord").alias("item"))
    texts = found.where("tag IN ('dt', 'p')").select("article_id", F.col("tag").alias("_tag"), F.col("text").alias("_text"), F.when(F.col("tag") == "dt", F.col("parent")).otherwise(F.col("parent") - 2).alias("pre"))
    pair = texts.groupBy("article_id", "pre").agg(F.max(F.when(F.col("_tag") == "dt", F.col("_text"))).alias("term"), F.max(F.when(F.col("_tag") == "p", F.col("_text"))).alias("definition"))
    return items.join(pair, ["article_id", "pre"]).select(_article_id(), "item", "term", "definition")


@query("""
SELECT n_regionkey AS article_id, 'h2' AS tag, 'n' || n_nationkey AS id, n_name AS title FROM nation
UNION ALL SELECT n_regionkey, 'h3', 's' || s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the HTML of nested sections."""
    body = articles.articles(corpora.nested_sections(spark, sf_dir), fields="body").select("article_id", "body")
    found = nodes.scan_html(body, "article_id", "body").where(F.regexp_like("tag", F.lit("^h[1-6]$")))
    return found.select(_article_id(), "tag", F.col("attrs")["id"].alias("id"), F.col("text").alias("title"))


_LINES = "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\x00-\\x20]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL"


@query(f"""
WITH l AS ({_LINES}), split AS (SELECT doc_id, len(lines) AS n, len(list_filter(lines, lambda x, i: i % 3 = 0)) AS k FROM l)
SELECT doc_id AS article_id, tag, n FROM (SELECT doc_id, unnest(['p', 'div', 'ul']) AS tag, unnest([n + k, k, k]) AS n FROM split) WHERE n > 0
""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of bodies in which lists split paragraphs: what follows is a plain block, and an empty paragraph."""
    parsed = articles.articles(corpora.split_paragraphs(spark, sf_dir), fields="xml").select("article_id", F.col("xml").alias("content"))
    found = nodes.scan_xml(parsed).where(F.get("path", F.size("path") - 2) == "article-body")
    return found.groupBy(_article_id(), "tag").agg(F.count("*").alias("n"))


@query(f"WITH l AS ({_LINES}) SELECT doc_id AS article_id, array_to_string(lines, chr(10)) AS text FROM l WHERE len(lines) > 0")
def xml_escape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that go through XML, the parser, the normal form and the scan, and come back."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n", -1), corpora.plain), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: corpora.element("p", values.escaped(x))), "")
    parsed = articles.articles(corpora.raw(docs, F.col("doc_id"), corpora.article(body=body)), fields="xml").select("article_id", F.col("xml").alias("content"))
    found = nodes.scan_xml(parsed).where("tag = 'p' AND text <> ' '").select("article_id", F.struct("pre", "text").alias("line"))
    joined = found.groupBy(_article_id()).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return joined.select("article_id", F.array_join("lines.text", "\n").alias("text"))


# ---- issues and curation

_MML = "{http://www.w3.org/1998/Math/MathML}"


@query(f"""
SELECT condition, count(*) AS n FROM (
  SELECT 'UnsupportedElement,sc,p' AS condition FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'UnsupportedElement,fig,body' FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT 'UnsupportedAttribute,p,content-type' FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT 'MissingSectionHeading,sec,body' FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT 'UnsupportedElement,supplementary-material,p' FROM events WHERE event_id % 17 = 0
  UNION ALL SELECT 'UnsupportedElement,{_MML}semantics,{_MML}math' FROM events WHERE event_id % 19 = 0
  UNION ALL SELECT 'UnsupportedElement,journal-meta,front' FROM events WHERE event_id % 23 = 0) GROUP BY condition
""")
def unsupported_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the conditions that parsing reports."""
    found = articles.distinct_conditions(articles.articles(corpora.odd_tags(spark, sf_dir), fields="issues"))
    return found.groupBy(F.array_join("condition", ",").alias("condition")).agg(F.count("*").alias("n"))


# sc in p has a tier of 10, fig in body one of 100, supplementary-material in p one of 1000; a section without heading and maths have none and count 10; attributes and journal-meta are ignored
_PENALTY = "CASE WHEN event_id % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 100 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN event_id % 17 = 0 THEN 1000 ELSE 0 END + CASE WHEN event_id % 19 = 0 THEN 10 ELSE 0 END"


def _penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = articles.articles(corpora.odd_tags(spark, sf_dir), fields="issues")
    listed = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("article_id"))
    return curation.penalties(listed, articles.distinct_conditions(parsed), curation.tier_table(spark), curation.ignored_table(spark))


@query(f"SELECT event_id AS article_id, ({_PENALTY})::BIGINT AS penalty, event_id % 19 = 0 AS mathml FROM events")
def penalty_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties of articles by the table of tiers, without the ignored conditions; articles without any have 0."""
    return _penalties(spark, sf_dir).select(_article_id(), "penalty", "mathml")


@query(f"SELECT least({_PENALTY}, 100)::BIGINT AS penalty, count(*) AS n FROM events WHERE {_PENALTY} < 1000 AND event_id % 19 <> 0 GROUP BY 1")
def penalty_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of penalties of what is to be done, from 100 on together."""
    return curation.penalty_histogram(_penalties(spark, sf_dir))


_STATUS = f"CASE WHEN event_id % 11 = 0 THEN 'NOTFOUND' WHEN event_id % 13 = 0 THEN 'SKIPPED' WHEN {_PENALTY} >= 1000 THEN 'FORGO' WHEN event_id % 19 = 0 THEN 'MATHML' ELSE 'TBD' END"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a list with their status: some have no file, some are news."""
    key = F.col("event_id")
    listed = table(spark, sf_dir, "events").select(key.cast("string").alias("article_id"), F.concat(F.lit("f"), key.cast("string")).alias("path"), F.concat(F.lit("J"), (key % 5).cast("string")).alias("journal_id"), F.when(key % 13 == 0, "news").otherwise("research-article").alias("article_type"))
    there = table(spark, sf_dir, "events").where(key % 11 != 0).select(F.concat(F.lit("f"), key.cast("string")).alias("path"))
    scored = curation.listed_files(listed, there).join(_penalties(spark, sf_dir), "article_id")
    return scored.withColumn("status", curation.status(F.col("found"), F.col("article_type"), F.col("penalty"), F.col("mathml")))


@query(f"SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM events) GROUP BY status")
def article_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each article of a list, by its file, type and penalty."""
    return _cases(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""
WITH c AS (SELECT {_STATUS} AS status, 'J' || (event_id % 5) AS journal, least({_PENALTY}, 100)::VARCHAR AS penalty FROM events)
SELECT 'articles' AS kind, status AS key, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'forgone journals', journal, count(*) FROM c WHERE status = 'FORGO' GROUP BY ALL
UNION ALL SELECT 'maths journals', journal, count(*) FROM c WHERE status = 'MATHML' GROUP BY ALL
UNION ALL SELECT 'types', 'research-article', count(*) FROM c WHERE status = 'TBD' GROUP BY ALL
UNION ALL SELECT 'journals', journal, count(*) FROM c WHERE status = 'TBD' GROUP BY ALL
UNION ALL SELECT 'penalties', penalty, count(*) FROM c WHERE status = 'TBD' GROUP BY ALL
""")
def curation_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distributions of a curation run, in one pass."""
    return curation.distributions(_cases(spark, sf_dir))


@query("SELECT 'f' || event_id AS value FROM events WHERE event_id % 11 = 0")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an index that aren't there."""
    paths = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), "event_id")
    return curation.missing_files(paths, paths.where("event_id % 11 <> 0"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmcid"), F.col("source").alias("journal_id"), "lang")


def _journals(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    numbers = F.regexp_extract("journal_id", "([0-9]+)$", 1).cast("int")
    return _index(spark, sf_dir).where(numbers <= last).select(F.col("journal_id").alias("value")).distinct()


@query("SELECT doc_id AS pmcid, source AS journal_id FROM documents WHERE regexp_extract(source, '([0-9]+)$', 1)::INTEGER <= 4")
def journal_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of listed journals."""
    return curation.journal_entries(_index(spark, sf_dir), _journals(spark, sf_dir, 4)).select("pmcid", "journal_id")


@query("SELECT doc_id AS pmcid, source AS journal_id FROM documents WHERE source IS NULL OR NOT regexp_extract(source, '([0-9]+)$', 1)::INTEGER <= 14")
def journal_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of journals that no list has."""
    return curation.unclassified(_index(spark, sf_dir), _journals(spark, sf_dir, 4), _journals(spark, sf_dir, 14)).select("pmcid", "journal_id")


_JOURNALS = """
SELECT *, CASE WHEN reject_fields > 0 THEN 'reject' WHEN cites > 10 AND ecites * 2 < cites THEN 'mixed' WHEN cites > 10 AND ecites = cites THEN 'unmixed' ELSE 'undecided' END AS verdict FROM (
  SELECT source AS journal_id, count(*) AS total, count(*) FILTER (doc_id % 3 <> 0) AS local, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 9 = 1) AS skipped,
    coalesce(sum(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 END), 0)::BIGINT AS cites,
    coalesce(sum(CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN source IN ('src1', 'src2') THEN 0 WHEN source IN ('src3', 'src4', 'src5') THEN doc_id % 5 ELSE doc_id % 5 - doc_id % 2 * least(doc_id % 5, 1) END END), 0)::BIGINT AS ecites,
    coalesce(sum(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 7 END), 0)::BIGINT AS odd_fields, coalesce(sum(CASE WHEN doc_id % 3 <> 0 AND source IN ('src7', 'src8') AND doc_id % 50 = 7 THEN 1 ELSE 0 END), 0)::BIGINT AS reject_fields FROM documents GROUP BY source)
"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of documents, a third of which have no file."""
    doc, source = F.col("doc_id"), F.col("source")
    there = doc % 3 != 0
    k = doc % 5
    ecites = F.when(source.isin("src1", "src2"), 0).when(source.isin("src3", "src4", "src5"), k).otherwise(k - doc % 2 * F.least(k, F.lit(1)))
    bad = F.when(source.isin("src7", "src8") & (doc % 50 == 7), 1).otherwise(0)
    facts = {"cites": k, "ecites": ecites, "odd_fields": doc % 7, "reject_fields": bad}
    cases = table(spark, sf_dir, "documents").select(source.alias("journal_id"), there.alias("found"), F.when(doc % 9 == 1, "obituary").otherwise("research-article").alias("article_type"), *(F.when(there, c).alias(n) for n, c in facts.items()))
    return curation.classify_journals(cases)


@query(_JOURNALS)
def journal_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on journals from sums over their articles."""
    return _classified(spark, sf_dir)


@query(f"SELECT verdict AS list, journal_id AS value FROM ({_JOURNALS}) WHERE verdict <> 'undecided' AND journal_id IS NOT NULL UNION SELECT 'mixed', 'old' UNION SELECT 'reject', 'src7'")
def journal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of journals, with what was on them before."""
    known = {"mixed": spark.createDataFrame([("old",)], "value string"), "reject": spark.createDataFrame([("src7",)], "value string")}
    return curation.journal_lists(_classified(spark, sf_dir), known)


@query("""
SELECT o_orderkey AS article_id, 1::BIGINT AS cites, 1::BIGINT AS ecites, 0::BIGINT AS odd_fields, 0::BIGINT AS reject_fields FROM orders
""")
def citation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What journals are classified by, from scanned articles."""
    found = curation.citation_cases(nodes.scan_xml(corpora.tally_articles(spark, sf_dir), columns="article_id path"))
    return found.select(_article_id(), "cites", "ecites", "odd_fields", "reject_fields")


@query("SELECT event_id AS article_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS article_type, CASE WHEN event_id % 3 <> 0 THEN 'J' || user_id END AS journal_id FROM events")
def article_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and journals of scanned articles."""
    key = F.col("event_id")
    front = corpora.element("front", F.when(key % 3 != 0, corpora.element("journal-meta", corpora.element("journal-id", F.concat(F.lit("J"), F.col("user_id").cast("string"))))).otherwise(""), corpora.element("article-meta"))
    typed = corpora.element("article", front, article_type=F.col("event_type"))
    content = F.when(key % 4 == 0, corpora.element("article", front)).otherwise(typed)
    found = curation.article_facts(nodes.scan_xml(corpora.raw(corpora.spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")), key, content)))
    return found.select(_article_id(), "article_type", "journal_id")


@query("""
SELECT o_orderkey::INTEGER AS pmcid, 'Journal ' || o_orderstatus AS journal_id, o_orderdate::DATE AS updated, CASE WHEN o_orderkey % 3 = 0 THEN 'CC BY' ELSE 'CC BY-NC' END AS license,
  CASE WHEN o_orderkey % 3 = 0 THEN 'oa_comm' ELSE 'oa_noncomm' END || '/xml/all/PMC' || o_orderkey || '.xml' AS path
FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01'
""")
def index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file list becomes an index: retracted ones, other licences and other dates are left out."""
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("PMC"), key.cast("string")).alias("accession"),
        F.concat(F.lit("Journal "), F.col("o_orderstatus"), F.lit(". 2020; 1.2")).alias("citation"),
        F.when(key % 7 == 0, "NO-CC CODE").when(key % 3 == 0, "CC BY").otherwise("CC BY-NC").alias("license"),
        F.when(key % 4 == 0, "yes").otherwise("no").alias("retracted"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )
    return files.entry_path(files.in_range(files.filelist_entries(lines), "1995-01-01", "1997-01-01"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) WHERE (i - 1) % 10 = 0")
def every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document: the sampling of corpus scripts."""
    return curation.every(table(spark, sf_dir, "documents").select("doc_id"), 10, "doc_id")


# ---- tallies

@query("""
SELECT tag, sum(n)::BIGINT AS n FROM (
  SELECT unnest(['article', 'front', 'article-meta', 'title-group', 'article-title', 'body', 'table-wrap', 'table', 'thead', 'tbody']) AS tag, 1 AS n FROM (SELECT DISTINCT n_regionkey FROM nation)
  UNION ALL SELECT 'tr', count(*) + count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'th', count(*) + 2 * count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'td', count(*) FROM nation) GROUP BY tag
""")
def tag_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of elements by tag."""
    return tallies.tags(nodes.scan_xml(corpora.nation_tables(spark, sf_dir), columns=tallies.COLUMNS))


@query("""
WITH r AS (SELECT count(DISTINCT n_regionkey) AS r, count(*) AS n FROM nation)
SELECT * FROM (SELECT unnest(['article', 'article', 'article', 'front', 'front', 'article-meta', 'article-meta', 'title-group', 'title-group', 'body', 'body', 'table-wrap', 'table-wrap', 'table', 'table', 'table', 'thead', 'thead', 'tbody', 'tbody', 'tr', 'tr', 'tr']) AS parent_tag,
  unnest(['front', 'body', 'TOTAL', 'article-meta', 'TOTAL', 'title-group', 'TOTAL', 'article-title', 'TOTAL', 'table-wrap', 'TOTAL', 'table', 'TOTAL', 'thead', 'tbody', 'TOTAL', 'tr', 'TOTAL', 'tr', 'TOTAL', 'th', 'td', 'TOTAL']) AS tag,
  unnest([r, r, r, r, r, r, r, r, r, r, r, r, r, r, r, r, r, r, n, r, n + 2 * r, n, n + r]) AS n FROM r)
""")
def parent_child_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of elements by parent and tag, and of parents with children."""
    return tallies.parents_and_children(nodes.scan_xml(corpora.nation_tables(spark, sf_dir), columns=tallies.COLUMNS))


@query("""
SELECT publication, category, tag, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'book' WHEN o_orderkey % 4 = 1 THEN 'journal' WHEN o_orderkey % 4 = 2 THEN 'webpage' ELSE 'other' END AS publication,
    unnest(['TITLE', 'DATE', 'DATE', 'PAGES', 'PAGES']) AS category, unnest(['source', 'year', 'date-in-citation', 'size', CASE WHEN o_orderkey % 3 = 0 THEN 'fpage' END]) AS tag FROM orders) WHERE tag IS NOT NULL GROUP BY ALL
""")
def tally_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of references by kind of publication and category."""
    return tallies.citation_fields(nodes.scan_xml(corpora.tally_articles(spark, sf_dir), columns=tallies.COLUMNS))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pmid' ELSE 'doi' END AS pub_id_type, count(*) AS n FROM orders GROUP BY 1")
def tally_pub_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.pub_id_types(nodes.scan_xml(corpora.tally_articles(spark, sf_dir), columns="attrs path", tags=("pub-id",)))


@query("SELECT (['book', 'journal', 'webpage', 'thesis'])[o_orderkey % 4 + 1] AS publication_type, count(*) AS n FROM orders GROUP BY 1")
def tally_publication_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.publication_types(nodes.scan_xml(corpora.tally_articles(spark, sf_dir), columns="attrs path", tags=("element-citation",)))


@query("""
SELECT content_type, bits::INTEGER AS bits, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 6 = 5 THEN 'updated' ELSE 'access-date' END AS content_type,
  CASE WHEN o_orderkey % 6 <> 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS bits FROM orders) GROUP BY ALL
""")
def tally_date_in_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in citations by what they are and which parts they have."""
    return tallies.date_bits(nodes.scan_xml(corpora.tally_articles(spark, sf_dir), columns=tallies.COLUMNS))


@query("""
WITH c AS (SELECT count(*) FILTER (o_orderkey % 3 = 0) AS i, count(*) FILTER (o_orderkey % 8 = 0) AS d, count(*) FILTER (o_orderkey % 3 = 0 OR o_orderkey % 8 = 0) AS e FROM orders)
SELECT kind, a, b, n FROM (SELECT unnest(['display', 'display', 'display-parent', 'display-parent', 'formula', 'formula', 'articles', 'articles']) AS kind,
  unnest(['inline', 'block', 'inline', 'block', 'inline-formula', 'disp-formula', '{http://www.w3.org/1998/Math/MathML}math', 'tex-math']) AS a,
  unnest([NULL, NULL, 'alternatives', 'disp-formula', 'p', 'body', NULL, NULL]) AS b, unnest([i, d, i, d, i, d, e, i]) AS n FROM c) WHERE n > 0
""")
def tally_mathml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where maths stands, and in how many articles."""
    return tallies.mathml(nodes.scan_xml(corpora.tally_articles(spark, sf_dir), columns=tallies.COLUMNS))


@query("SELECT 'title' AS parent_tag, unnest(['italic', 'bold', 'TOTAL']) AS tag, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0")
def tally_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements inside titles and other short texts."""
    return tallies.titles(nodes.scan_xml(corpora.tally_articles(spark, sf_dir), columns=tallies.COLUMNS))


# ---- HTML pages

@query("""
SELECT page_id, len(regexp_extract_all(html, '(?i)<a[\\s>]')) AS links, len(regexp_extract_all(html, '(?i)<li[\\s>]')) AS items, len(regexp_extract_all(html, '(?i)<p[\\s>]')) AS paragraphs
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS html FROM pages)
""")
def html_pages_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of HTML pages, which aren't well-formed XML."""
    found = nodes.scan_html(table(spark, sf_dir, "pages"))
    n = lambda tag: F.count_if(F.col("tag") == tag).alias({"a": "links", "li": "items", "p": "paragraphs"}[tag])
    return found.groupBy(F.col("article_id").cast("long").alias("page_id")).agg(n("a"), n("li"), n("p"))


@query("""
SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<a\\s[^>]*>')) AS tag FROM pages)
WHERE NOT regexp_matches(tag, '(?i)\\srel=') AND regexp_matches(tag, '(?i)\\shref="[^#"]') GROUP BY page_id
""")
def html_link_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that the content models wouldn't take: without rel, and not to a place on the page."""
    found = nodes.scan_html(table(spark, sf_dir, "pages"))
    href = F.col("attrs")["href"]
    bad = found.where((F.col("tag") == "a") & F.col("attrs")["rel"].isNull() & href.isNotNull() & (href != "") & ~F.startswith(href, F.lit("#")))
    return bad.groupBy(F.col("article_id").cast("long").alias("page_id")).agg(F.count("*").alias("n"))


# ---- web abstracts

@query("""
SELECT p_partkey AS article_id, '1.' || (p_partkey % 12) AS edid, 'd' || (p_partkey // 10) AS base_dsi, 'd' || (p_partkey // 10) || '/1.' || (p_partkey % 12) AS dsi, '1' AS seq_edid, latest AS latest_edid, latest <> '1.' || (p_partkey % 12) AS obsolete,
  (p_partkey % 30 + 1990)::VARCHAR AS year
FROM (SELECT *, '1.' || max(p_partkey % 12) OVER (PARTITION BY p_partkey // 10) AS latest FROM part)
""")
def webstract_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of web abstracts: the latest of each succession by the numbers of its id."""
    made = webstracts.facade(_with_editions(spark, sf_dir))
    return made.select(_article_id(), "edid", "base_dsi", "dsi", "seq_edid", "latest_edid", "obsolete", "year")


@query("""
SELECT p_partkey AS article_id, p_name AS title, p_brand AS surname, '10.5555/' || p_partkey AS doi, false AS bare_tex FROM part
""")
def webstract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of web abstracts written as JSON."""
    rows = webstracts.to_json(webstracts.webstracts(articles.articles(corpora.part_references(spark, sf_dir), fields=webstracts.PARSED)))
    get = lambda path: F.get_json_object("webstract", path)
    return rows.select(_article_id(), get("$.title").alias("title"), get("$.csljson[0].author[0].family").alias("surname"), get("$.csljson[0].DOI").alias("doi"), get("$.bare_tex").cast("boolean").alias("bare_tex"))


@query("""
SELECT c_nationkey AS article_id, count(*) AS n_people, count(*) FILTER (c_custkey % 5 = 0) AS n_orcids FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1
""")
def commonmeta_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of Commonmeta records."""
    made = webstracts.commonmeta(articles.articles(corpora.customer_authors(spark, sf_dir)))
    people = F.from_json(F.get_json_object("commonmeta", "$.contributors"), "array<struct<familyName: string, id: string>>")
    return made.select(_article_id(), F.size(people).cast("long").alias("n_people"), F.size(F.filter(people, lambda p: p["id"].isNotNull())).cast("long").alias("n_orcids"))


@query("""
SELECT n_regionkey AS article_id, 'sec' AS tag, 'n' || n_nationkey AS id, n_name AS title FROM nation
UNION ALL SELECT n_regionkey, 'sec', 's' || s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def to_jats_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of articles turned back into JATS."""
    made = jats.to_jats(articles.articles(corpora.nested_sections(spark, sf_dir)))
    found = nodes.scan_xml(made, content_col="jats")
    secs = found.where("tag = 'sec'").select("article_id", F.col("pre").alias("parent"), "tag", F.col("attrs")["id"].alias("id"))
    titles = found.where("tag = 'title'").select("article_id", "parent", F.col("text").alias("title"))
    return secs.join(titles, ["article_id", "parent"]).select(_article_id(), "tag", "id", "title")


@query("SELECT p_partkey AS article_id, true AS same FROM part")
def restyle_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of the normal form is the same."""
    return articles.restyled_twice(corpora.part_references(spark, sf_dir)).select(_article_id(), "same")


@query("""
SELECT p_partkey AS article_id, '<h1>' || p_name || '</h1>' AS heading, 2 AS n_sections FROM part
""")
def html_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages: the heading, and the parts under a second one (text and references)."""
    made = webstracts.page(webstracts.webstracts(articles.articles(corpora.part_references(spark, sf_dir), fields=webstracts.PARSED)))
    return made.select(_article_id(), F.regexp_extract("html", "(<h1>.*</h1>)", 1).alias("heading"), (F.regexp_count("html", F.lit("<p>")) + F.regexp_count("html", F.lit("<h2>"))).alias("n_sections"))


# ---- what the content models make of links, markup, formulas, front matter

def _body(parsed: DataFrame) -> DataFrame:
    """The HTML of bodies, and how many issues there are."""
    return parsed.select(_article_id(), "body", F.size("issues").cast("long").alias("n_issues"))


@query("""
SELECT c_custkey AS article_id, '<p>' || CASE c_custkey % 8 WHEN 0 THEN '<a href="https://x.org/' || c_custkey || '" rel="external">t</a>' WHEN 2 THEN ''
  WHEN 4 THEN '<a href="http://x.org/' || c_custkey || '" rel="external">t <strong>u</strong></a>' WHEN 5 THEN '<a href="#r' || c_custkey || '">t</a>' WHEN 7 THEN '<a href="#r' || c_custkey || '">t</a>' ELSE 't' END || '.</p>' || chr(10) AS body,
  CASE WHEN c_custkey % 8 IN (1, 2, 3, 6) THEN 1 ELSE 0 END AS n_issues FROM customer
""")
def links_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links: those with a web address or a place in the text stay, others leave their text, those of another type nothing."""
    return _body(articles.articles(corpora.linked(spark, sf_dir), fields="body issues"))


@query("""
SELECT array_to_string(['UnsupportedAttributeValue', 'ext-link', '{http://www.w3.org/1999/xlink}href', 'ftp://x.org/' || c_custkey], ',') AS condition, 1 AS n FROM customer WHERE c_custkey % 8 = 1
UNION ALL SELECT 'UnsupportedAttributeValue,ext-link,ext-link-type,doi', count(*) FROM customer WHERE c_custkey % 8 = 2
UNION ALL SELECT 'MissingAttribute,ext-link,{http://www.w3.org/1999/xlink}href', count(*) FROM customer WHERE c_custkey % 8 = 3
UNION ALL SELECT 'UnsupportedAttributeValue,a,href,page/' || c_custkey, 1 FROM customer WHERE c_custkey % 8 = 6
""")
def link_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported about links."""
    found = articles.distinct_conditions(articles.articles(corpora.linked(spark, sf_dir), fields="issues"))
    return found.groupBy(F.array_join("condition", ",").alias("condition")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS article_id, CASE p_partkey % 8 WHEN 0 THEN '<p><strong>' || p_name || '</strong><em>i<sub>s</sub></em></p>' WHEN 1 THEN '<p><samp>' || p_name || '</samp><sup>u</sup></p>' WHEN 2 THEN '<p><code>' || p_name || '</code><br>x</p>'
  WHEN 3 THEN '<pre>a  ' || p_name || '</pre>' WHEN 4 THEN '<blockquote>' || chr(10) || '  <p>' || p_name || '</p>' || chr(10) || '</blockquote>' WHEN 5 THEN '<ol>' || chr(10) || '  <li>' || chr(10) || '    <p>' || p_name || '</p>' || chr(10) || '  </li>' || chr(10) || '</ol>'
  WHEN 6 THEN '<p>' || p_name || '.</p>' ELSE '<p><strong>a' || p_name || '</strong></p>' END || chr(10) AS body, CASE p_partkey % 8 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS n_issues FROM part
""")
def markup_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline markup and blocks in HTML; unknown markup leaves its text."""
    return _body(articles.articles(corpora.marked_up(spark, sf_dir), fields="body issues"))


@query("""
SELECT o_orderkey AS article_id, CASE o_orderkey % 5 WHEN 0 THEN '<p>a <span class="math inline">x&lt;y</span></p>' WHEN 1 THEN '<span class="math display">z</span>' WHEN 2 THEN '<p>a </p>' WHEN 3 THEN '<p>a <span class="math inline">w</span></p>' ELSE '<p>plain</p>' END || chr(10) AS body,
  CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS n_issues, o_orderkey % 5 IN (0, 1, 3) AS bare_tex FROM orders
""")
def formulas_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas are shown as TeX; those without TeX are left out."""
    parsed = articles.articles(corpora.formulas(spark, sf_dir), fields="body bare_tex issues")
    return parsed.select(_article_id(), "body", F.size("issues").cast("long").alias("n_issues"), "bare_tex")


@query("""
SELECT o_orderkey AS article_id, (o_orderkey % 5 < 2)::INTEGER AS maths, (o_orderkey % 5 IN (0, 1, 3))::INTEGER AS tex FROM orders
""")
def formulas_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maths and TeX of the normal form."""
    parsed = articles.articles(corpora.formulas(spark, sf_dir), fields="xml").select("article_id", F.col("xml").alias("content"))
    found = nodes.scan_xml(parsed, columns="article_id tag")
    n = lambda tag: F.count_if(F.col("tag") == tag).cast("int")
    return found.groupBy(_article_id()).agg(n("{http://www.w3.org/1998/Math/MathML}math").alias("maths"), n("tex-math").alias("tex"))


@query("""
SELECT condition, count(*) AS n FROM (SELECT unnest(CASE p_partkey % 9
  WHEN 1 THEN ['MissingChild,contrib,contrib-group,article-meta'] WHEN 2 THEN ['MissingChild,title-group,article-meta,front', 'MissingContent,article-title,title-group']
  WHEN 3 THEN ['MissingChild,article-meta,front,article', 'MissingContent,article-title,title-group'] WHEN 4 THEN ['MissingAttribute,contrib,contrib-type'] WHEN 5 THEN ['UnsupportedAttributeValue,contrib,contrib-type,editor']
  WHEN 6 THEN ['UnsupportedElement,b,contrib-id', 'InvalidOrcid,contrib-id,contrib'] WHEN 7 THEN ['ExcessElement,title-group,article-meta', 'UnsupportedAttributeValue,license_ref,content-type,odd']
  WHEN 8 THEN ['MissingChild,front,article', 'MissingContent,article-title,title-group'] ELSE [] END) AS condition FROM part) GROUP BY condition
""")
def front_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported about incomplete front matter: missing children, wrong attributes, repeated and unknown elements."""
    found = articles.distinct_conditions(articles.articles(corpora.fronts(spark, sf_dir), fields="issues"))
    return found.groupBy(F.array_join("condition", ",").alias("condition")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS article_id, CASE WHEN p_partkey % 3 = 1 THEN 'e' ELSE '' END || p_partkey AS page, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS n_issues FROM part
""")
def elocation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The electronic location of a cited work counts as its first page, if it has none."""
    parsed = articles.articles(corpora.paged(spark, sf_dir), fields="refs issues")
    return parsed.select(_article_id(), F.col("refs")[0]["fields"]["fpage"].alias("page"), F.size("issues").cast("long").alias("n_issues"))


@query("""
SELECT o_orderkey AS article_id, '<p>' || c(n, n) || '<span class="citation-tuple"> [' || list_aggregate(list_transform(range(1, n + 1), lambda i: '<a href="#r' || i || '">' || i || '</a>'), 'string_agg', ',') || ']</span></p>' || chr(10) AS body FROM (SELECT o_orderkey, o_orderkey % 9 + 2 AS n FROM orders)
""".replace("c(n, n)", """'<span class="citation-tuple"> [<a href="#r' || n || '">' || n || '</a>]</span>'"""))
def citations_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in HTML, in brackets, with those that a dash stands for."""
    return articles.articles(corpora.range_articles(spark, sf_dir), fields="body").select(_article_id(), "body")


# ---- editions and identifiers

def _with_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web abstracts of parts, ten to a succession of editions."""
    key = F.col("p_partkey")
    rows = webstracts.webstracts(articles.articles(corpora.licensed(spark, sf_dir), fields=webstracts.PARSED), html_refs=False)
    editions = table(spark, sf_dir, "part").select(key.cast("string").alias("article_id"), F.concat(F.lit("d"), F.expr("p_partkey div 10").cast("string")).alias("base_dsi"), F.concat(F.lit("1."), (key % 12).cast("string")).alias("edid"), F.concat((key % 30 + 1990).cast("string"), F.lit("-02-03")).alias("date"))
    return webstracts.with_editions(rows, editions)


@query("""
SELECT p_partkey AS article_id, '<header><a href="https://example.org/d' || (p_partkey // 10) || '/1.' || (p_partkey % 12) || '">d' || (p_partkey // 10) || '/1.' || (p_partkey % 12) || '</a></header>' AS header, '1.' || (p_partkey % 12) AS edition,
  CASE WHEN latest <> p_partkey % 12 THEN 'https://example.org/d' || (p_partkey // 10) || '/1.' || latest ELSE '' END AS newer, (p_partkey % 30 + 1990) || '-02-03' AS date, '(' || (p_partkey % 30 + 1990) || ') “T”' AS citation, p_name AS license
FROM (SELECT *, max(p_partkey % 12) OVER (PARTITION BY p_partkey // 10) AS latest FROM part)
""")
def html_page_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of editions: address, edition, notice of a newer one, date, how to cite it, licence."""
    made = webstracts.page(_with_editions(spark, sf_dir), "example.org")
    part = lambda pattern: F.regexp_extract("html", pattern, 1)
    found = {"header": "(<header>.*</header>)", "edition": ">Edition ([^<]*)<", "newer": 'newer edition: <a href="([^"]*)"', "date": 'class="date">([^<]*)<', "citation": 'class="citation"> ?([^<]*?) ?<', "license": 'class="license">([^<]*)<'}
    return made.select(_article_id(), *(part(p).alias(n) for n, p in found.items()))


@query("SELECT p_partkey % 8 >= 6 AS has_issues, count(*) AS n, count(*) FILTER (p_partkey % 8 >= 6) AS linked FROM part GROUP BY 1")
def html_page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages link to their issues, if they have any."""
    rows = webstracts.webstracts(articles.articles(corpora.marked_up(spark, sf_dir), fields=webstracts.PARSED), html_refs=False)
    made = webstracts.page(rows, link_issues=True, keep=("issues",)).withColumn("has_issues", webstracts.has_issues(F.col("issues")))
    return made.groupBy("has_issues").agg(F.count("*").alias("n"), F.count_if(F.contains("html", F.lit('href="issues/"'))).alias("linked"))


@query("SELECT tag, sum(n)::BIGINT AS n FROM (SELECT unnest(['math', 'mi']) AS tag, 1 AS n FROM orders WHERE o_orderkey % 5 < 2) GROUP BY tag")
def mathml_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of maths in the normal form, by name without namespace."""
    parsed = articles.articles(corpora.formulas(spark, sf_dir), fields="xml").select("article_id", F.col("xml").alias("content"))
    found = nodes.scan_xml(parsed, columns="tag").where(F.startswith("tag", F.lit(_MML)))
    return found.groupBy(values.local_name(F.col("tag")).alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS article_id FROM part WHERE p_partkey % 3 <> 0")
def webstract_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions without a stored web abstract: what an incremental run makes."""
    key = F.col("p_partkey").cast("string").alias("article_id")
    parts = table(spark, sf_dir, "part")
    return webstracts.missing(parts.select(key), parts.where("p_partkey % 3 = 0").select(key)).select(_article_id())


_TREE = """
SELECT n_nationkey AS article_id, 'swh:1:dir:' || sha1(encode('tree ' || octet_length(entries)) || '\x00'::BLOB || entries) AS swhid FROM (
  SELECT n_nationkey, encode('100644 article.xml') || '\x00'::BLOB || unhex(blob) || CASE WHEN n_nationkey % 2 = 0 THEN encode('40000 assets') || '\x00'::BLOB || unhex(inner_tree) ELSE ''::BLOB END AS entries FROM (
    SELECT n_nationkey, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS blob, sha1(encode('tree 36') || '\x00'::BLOB || encode('100644 name.txt') || '\x00'::BLOB || unhex(sha1('blob ' || octet_length(encode(n_name)) || chr(0) || n_name))) AS inner_tree
    FROM (SELECT *, '<article>' || n_name || '</article>' AS text FROM nation)))
"""


@query(_TREE)
def directory_swhids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the folders of articles, with folders inside."""
    found = values.directory_swhids(corpora.files_of_articles(spark, sf_dir))
    return found.select(F.col("root").cast("long").alias("article_id"), "swhid")


@query(f"SELECT article_id, substr(swhid, 1, 10) AS hash_scheme, substr(swhid, 11) AS hexhash, swhid AS commonmeta_id FROM ({_TREE})")
def webstract_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web abstracts and Commonmeta records that name the files they were made from."""
    found = corpora.files_of_articles(spark, sf_dir)
    raw = found.where("path = 'article.xml'").select(F.col("root").alias("article_id"), "content")
    rows = webstracts.with_source(articles.articles(raw), values.directory_swhids(found))
    facts = webstracts.facade(webstracts.webstracts(rows, html_refs=False)).select("article_id", "hash_scheme", "hexhash")
    records = webstracts.commonmeta(rows, F.col("source")).select("article_id", F.get_json_object("commonmeta", "$.id").alias("commonmeta_id"))
    return facts.join(records, "article_id").select(_article_id(), "hash_scheme", "hexhash", "commonmeta_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every article its references as CSL-JSON, in the order of citation."""
    return ref_csl_titles(spark, sf_dir)
