"""Articles made from plain tables, by SQL expressions: (article_id, content).

They have known content, so that what the engine reads from them can be compared with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.values import escaped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes articles of, while tables are small; and the most tasks that larger ones are dealt out to.
ROWS_OF_A_TASK, MOST_TASKS = 2_500, 2_000


def spread(rows: DataFrame, *by: str, rows_of_an_article: int = 1) -> DataFrame:
    """Rows dealt out to as many tasks as their number asks for, before articles are made of them. Spark cuts files by bytes and never within a row group, so a million short rows can be one task's, which then reads all their articles. by: the columns that name an article, if it has several rows; grouping by these needs no other shuffle."""
    tasks = min(MOST_TASKS, -(-rows.count() // (ROWS_OF_A_TASK * rows_of_an_article)))
    return rows.repartition(tasks, *by) if tasks > 1 else rows


def element(tag: str, *content: Column | str, **attrs: Column | str) -> Column:
    """An element as a text column; texts given as plain strings are markup, columns too. `_` in names of attributes is `-`."""
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    parts: list[Column] = [F.lit(f"<{tag}")]
    for key, value in attrs.items():
        parts += [F.lit(f' {key.strip("_").replace("_", "-")}="'), escaped(column(value), True), F.lit('"')]
    return F.concat(*parts, F.lit(">"), *(F.coalesce(column(c), F.lit("")) for c in content), F.lit(f"</{tag}>"))


def article(*, title: Column | str = "T", meta: Column | str = "", body: Column | str = "<p>Text</p>", refs: Column | str | None = None) -> Column:
    """A whole article. refs: the `ref` elements; without, there is no list."""
    front = element("front", element("article-meta", element("title-group", element("article-title", title)), meta))
    back = () if refs is None else (element("back", element("ref-list", refs)),)
    return element("article", front, element("body", body), *back)


def raw(rows: DataFrame, article_id: Column, content: Column) -> DataFrame:
    return rows.select(article_id.cast("string").alias("article_id"), content.cast("binary").alias("content"))


def cite(rid: Column | str, printed: Column | str = "", tail: str = "") -> Column:
    return F.concat(element("xref", printed, rid=rid, ref_type="bibr"), F.lit(tail))


def ref(rid: Column | str, *fields: Column | str) -> Column:
    return element("ref", element("element-citation", *fields), id=rid)


def part_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an article that cites one reference with many fields."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    key = F.col("p_partkey")
    name = element("name", element("surname", escaped(F.col("p_brand"))), element("given-names", F.lit("Ada "), F.substring("p_type", 1, 1)))
    fields = [
        element("person-group", name, person_group_type="author"),
        element("article-title", escaped(F.col("p_name"))),
        element("source-title", escaped(F.col("p_type"))),
        F.when(key % 3 == 0, element("edition", F.concat((key % 40 + 1).cast("string"), F.lit("th ed.")))),
        element("year", (key % 50 + 1970).cast("string")),
        F.when(key % 4 != 0, element("month", (key % 12 + 1).cast("string"))),
        F.when(key % 4 == 2, element("day", (key % 28 + 1).cast("string"))),
        element("volume", F.col("p_size").cast("string")),
        element("fpage", (key * 10).cast("string")),
        F.when(key % 2 == 0, element("lpage", (key * 10 + 7).cast("string"))),
        element("pub-id", F.when(key % 5 == 0, "https://doi.org/").otherwise(""), F.lit("10.5555/"), key.cast("string"), pub_id_type="doi"),
    ]
    rid = F.concat(F.lit("r"), key.cast("string"))
    return raw(p, key, article(title=escaped(F.col("p_name")), body=element("p", "See ", cite(rid, "1")), refs=ref(rid, *fields)))


def order_citations(spark: SparkSession, sf_dir: str, printed: Column | None = None) -> DataFrame:
    """An order is an article that cites its parts in the order of its lines; the list of references is sorted by part. Parts divisible by 7 are missing from the list. printed: what a citation shows, of l_linenumber."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", rows_of_an_article=4)
    shown = F.lit("") if printed is None else printed
    rid = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    # elements are made a row, not in the lambda of an array, which isn't compiled
    part = F.struct("l_partkey", ref(rid, element("source-title", F.col("l_partkey").cast("string"))).alias("text"))
    rows = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", cite(rid, shown, " ").alias("text")).alias("line"), F.when(F.col("l_partkey") % 7 != 0, part).alias("part"))
    grouped = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.sort_array(F.collect_set("part")).alias("parts"))
    body, refs = element("p", F.array_join("lines.text", "")), F.array_join("parts.text", "")
    return raw(grouped, F.col("l_orderkey"), article(body=body, refs=refs))


def range_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an article with as many references as o_orderkey % 9 + 2, cited as a range from the first to the last."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", (F.col("o_orderkey") % 9 + 2).cast("int").alias("n"))
    # n is 10 at most: the list's beginnings are constants
    refs = F.concat(*(F.when(F.col("n") >= i, ref(f"r{i}", element("source-title", str(i)))).otherwise("") for i in range(1, 11)))
    # the last is cited first, with its place, so that the list's order is kept
    body = element("p", cite(F.concat(F.lit("r"), F.col("n").cast("string")), F.col("n").cast("string")), element("sup", cite("r1", "1", "-"), cite(F.concat(F.lit("r"), F.col("n").cast("string")), F.col("n").cast("string"))))
    return raw(o, F.col("o_orderkey"), article(body=body, refs=refs))


def customer_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is an article whose authors are its customers; every fifth has an ORCID, every seventh no name."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    name = F.when(key % 7 != 0, element("name", element("surname", F.split_part("c_name", F.lit("#"), F.lit(2))), element("given-names", F.split_part("c_name", F.lit("#"), F.lit(1)))))
    code = F.concat(F.lit("https://orcid.org/0000-0002-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("X"))
    orcid = F.when(key % 5 == 0, element("contrib-id", code, contrib_id_type="orcid"))
    rows = c.select("c_nationkey", F.struct("c_custkey", element("contrib", orcid, name, contrib_type="author").alias("text")).alias("author"))
    rows = rows.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("author")).alias("authors"))
    return raw(rows, F.col("c_nationkey"), article(meta=element("contrib-group", F.array_join(F.transform("authors", lambda a: a["text"]), ""))))


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region is an article with a table of its nations."""
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_regionkey", F.struct("n_nationkey", element("tr", element("th", F.col("n_nationkey").cast("string"), align="right"), element("td", escaped(F.col("n_name")))).alias("text")).alias("r"))
    rows = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    head = element("thead", element("tr", "<th>key</th><th>name</th>"))
    body = element("tbody", F.array_join(F.transform("rs", lambda r: r["text"]), ""))
    return raw(rows, F.col("n_regionkey"), article(body=element("table-wrap", element("table", head, body))))


def conversation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is an article with a list of definitions: role and text of its turns."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    item = element("def-item", element("term", escaped(F.col("role"))), element("def", element("p", escaped(plain(F.col("text"))))))
    rows = c.select("conv_id", F.struct("turn", item.alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return raw(rows, F.col("conv_id"), article(body=element("def-list", F.array_join(F.transform("ts", lambda t: t["text"]), ""))))


def plain(text: Column) -> Column:
    """Text as XML keeps it: without control characters, line ends as one space."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x20]+", " "))


def nested_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region is an article whose sections are its nations, with suppliers as sections below."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct("s_suppkey", element("sec", element("title", escaped(F.col("s_name"))), "<p>x</p>", id=F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("text")).alias("s"))
    inner = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "").alias("inner"))
    n = table(spark, sf_dir, "nation").join(inner, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    sec = element("sec", element("title", escaped(F.col("n_name"))), F.coalesce("inner", F.lit("")), id=F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    rows = n.select("n_regionkey", F.struct("n_nationkey", sec.alias("text")).alias("s")).groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "").alias("secs"))
    return raw(rows, F.col("n_regionkey"), article(body=F.col("secs")))


def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is an article: each line a paragraph, each third line with a list in the middle of it."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.filter(F.split("text", "\n", -1), lambda x: plain(x) != "")
    text = lambda x: escaped(plain(x))
    para = lambda x, i: F.when(i % 3 == 2, element("p", text(x), "<ul><li>item</li></ul>after")).otherwise(element("p", text(x)))
    return raw(d, F.col("doc_id"), article(body=F.array_join(F.transform(lines, para), "")))


def odd_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is an article with unknown elements and attributes, by its number: by 17 one that makes it forgone, by 19 maths that isn't kept, by 23 one that doesn't matter."""
    key = F.col("event_id")
    word = escaped(F.col("event_type"))
    body = F.concat(
        element("p", F.when(key % 2 == 0, element("sc", word)).otherwise(word), F.when(key % 17 == 0, "<supplementary-material>s</supplementary-material>")),
        F.when(key % 3 == 0, element("fig", "<label>1</label>")).otherwise(""),
        F.when(key % 5 == 0, element("p", word, content_type="odd")).otherwise(""),
        F.when(key % 7 == 0, element("sec", "<p>no heading</p>")).otherwise(""),
        F.when(key % 19 == 0, element("p", "x ", _formula("x", "<mml:semantics/>"))).otherwise(""),
    )
    front = element("front", F.when(key % 23 == 0, element("journal-meta", element("journal-id", "J"))), element("article-meta", element("title-group", element("article-title", "T"))))
    return raw(spread(table(spark, sf_dir, "events").select("event_id", "event_type")), key, element("article", front, element("body", body)))


_MATHML = 'xmlns:mml="http://www.w3.org/1998/Math/MathML"'
_XLINK = 'xmlns:xlink="http://www.w3.org/1999/xlink"'


def _formula(tex: str, inside: str = "<mml:mi>x</mml:mi>", tag: str = "inline-formula") -> str:
    return f"<{tag}><alternatives><tex-math>{tex}</tex-math><mml:math {_MATHML}>{inside}</mml:math></alternatives></{tag}>"


def one_of(key: Column, *options: Column | str) -> Column:
    """One of some texts, by a number."""
    return F.get(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), (key % len(options)).cast("int"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is an article with one link of one of eight kinds."""
    key = F.col("c_custkey")
    number = key.cast("string")
    made = one_of(
        key,
        F.concat(F.lit(f'<ext-link {_XLINK} ext-link-type="uri" xlink:href="https://x.org/'), number, F.lit('">t</ext-link>')),
        F.concat(F.lit(f'<ext-link {_XLINK} xlink:href="ftp://x.org/'), number, F.lit('">t</ext-link>')),
        F.concat(F.lit(f'<ext-link {_XLINK} ext-link-type="doi" xlink:href="https://x.org/'), number, F.lit('">t</ext-link>')),
        "<ext-link>t</ext-link>",
        F.concat(F.lit('<a rel="external" href="http://x.org/'), number, F.lit('">t <b>u</b></a>')),
        F.concat(F.lit('<a href="#r'), number, F.lit('">t</a>')),
        F.concat(F.lit('<a href="page/'), number, F.lit('">t</a>')),
        F.concat(F.lit('<xref rid="r'), number, F.lit('">t</xref>')),
    )
    return raw(spread(table(spark, sf_dir, "customer").select("c_custkey")), key, article(body=element("p", made, ".")))


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an article with a block of one of eight kinds of markup."""
    key = F.col("p_partkey")
    name = escaped(F.col("p_name"))
    body = one_of(
        key,
        element("p", element("bold", name), element("italic", "i", element("sub", "s"))),
        element("p", element("monospace", name), element("sup", "u")),
        element("p", element("code", name), "<break/>", "x"),
        element("preformat", "a  ", name),
        element("disp-quote", element("p", name)),
        element("list", element("list-item", element("p", name)), list_type="order"),
        element("p", element("underline", name), "."),
        element("p", element("b", "a", element("xref", name, rid="q", ref_type="bibr"))),
    )
    return raw(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")), key, article(body=body))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an article with a formula of one of five kinds."""
    key = F.col("o_orderkey")
    body = one_of(
        key,
        element("p", "a ", _formula("x<y".replace("<", "&lt;"))),
        _formula("z", tag="disp-formula"),
        element("p", "a ", f"<inline-formula><mml:math {_MATHML}><mml:mi>x</mml:mi></mml:math></inline-formula>"),
        element("p", "a ", "<inline-formula><alternatives><tex-math>w</tex-math></alternatives></inline-formula>"),
        element("p", "plain"),
    )
    return raw(spread(table(spark, sf_dir, "orders").select("o_orderkey")), key, article(body=body))


def fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an article whose front matter lacks something or has too much, by its number."""
    key = F.col("p_partkey")
    name = "<name><surname>S</surname></name>"
    contrib = f'<contrib contrib-type="author">{name}</contrib>'
    group = "<title-group><article-title>T</article-title></title-group>"
    front = one_of(
        key,
        f"<front><article-meta>{group}</article-meta></front>",
        f"<front><article-meta>{group}<contrib-group></contrib-group></article-meta></front>",
        "<front><article-meta></article-meta></front>",
        "<front></front>",
        f"<front><article-meta>{group}<contrib-group><contrib>{name}</contrib></contrib-group></article-meta></front>",
        f'<front><article-meta>{group}<contrib-group><contrib contrib-type="editor">{name}</contrib>{contrib}</contrib-group></article-meta></front>',
        f'<front><article-meta>{group}<contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid"><b>no</b></contrib-id>{name}</contrib></contrib-group></article-meta></front>',
        f'<front><article-meta>{group}{group}<permissions><license><license_ref content-type="odd">u</license_ref></license></permissions></article-meta></front>',
        "",
    )
    return raw(spread(table(spark, sf_dir, "part").select("p_partkey")), key, element("article", front, element("body", "<p>x</p>")))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an article that cites one work by its first page, its electronic location, or both."""
    key = F.col("p_partkey")
    page, place = element("fpage", key.cast("string")), element("elocation-id", F.concat(F.lit("e"), key.cast("string")))
    fields = one_of(key, page, place, F.concat(page, place))
    return raw(spread(table(spark, sf_dir, "part").select("p_partkey")), key, article(body=element("p", cite("r1", "1")), refs=ref("r1", element("source", "S"), fields)))


def files_of_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path, content): a nation's article and, for every second one, a file in a folder `assets`."""
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("<article>"), F.col("n_name"), F.lit("</article>")).cast("binary")
    one = n.select(F.col("n_nationkey").cast("string").alias("root"), F.lit("article.xml").alias("path"), text.alias("content"))
    other = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("root"), F.lit("assets/name.txt").alias("path"), F.col("n_name").cast("binary").alias("content"))
    return one.unionAll(other)


def tally_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an article with one reference of several kinds, dates, formulas and marked-up titles."""
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "book").when(key % 4 == 1, "journal").when(key % 4 == 2, "webpage").otherwise("thesis")
    date = element("date-in-citation", F.when(key % 2 == 0, "<year>2020</year>").otherwise(""), F.when(key % 3 == 0, "<month>2</month>").otherwise(""), F.when(key % 5 == 0, "<day>3</day>").otherwise(""), content_type=F.when(key % 6 == 5, "updated").otherwise("access-date"))
    fields = element("element-citation", "<source>S</source><year>1999</year>", F.when(key % 3 == 0, "<fpage>1</fpage>").otherwise(""), date, element("pub-id", key.cast("string"), pub_id_type=F.when(key % 2 == 0, "pmid").otherwise("doi")), "<size>3</size>", publication_type=kind)
    math = '<inline-formula><alternatives><tex-math>x</tex-math><mml:math xmlns:mml="http://www.w3.org/1998/Math/MathML" display="inline"><mml:mi>x</mml:mi></mml:math></alternatives></inline-formula>'
    plain_math = '<disp-formula><mml:math xmlns:mml="http://www.w3.org/1998/Math/MathML" display="block"><mml:mi>y</mml:mi></mml:math></disp-formula>'
    body = F.concat(element("p", F.when(key % 3 == 0, math).otherwise("text")), F.when(key % 8 == 0, plain_math).otherwise(""), element("sec", element("title", F.when(key % 4 == 0, "a <italic>b</italic> <bold>c</bold>").otherwise("plain"))))
    return raw(spread(table(spark, sf_dir, "orders").select("o_orderkey")), key, article(body=body, refs=element("ref", fields, id="r1")))


def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an article with a licence of one of ten kinds of URL."""
    kinds = ["publicdomain/zero/1.0/", "licenses/by/4.0/", "licenses/by-sa/4.0/", "licenses/by-nc/4.0/", "licenses/by-nc-sa/4.0/", "licenses/by-nd/4.0/", "licenses/by-nc-nd/4.0/", "licenses/sampling/1.0/", "", "other"]
    key = F.col("p_partkey")
    url = F.concat(F.lit("https://creativecommons.org/"), F.get(F.array(*map(F.lit, kinds)), (key % 10).cast("int")))
    statement = F.concat(F.lit("© "), (key % 30 + 1990).cast("string"), F.lit(" <bold>"), escaped(F.col("p_brand")), F.lit("</bold>"))
    meta = element("permissions", element("copyright-statement", statement), element("license", element("license_ref", url), element("license-p", escaped(F.col("p_name")))))
    return raw(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")), key, article(meta=meta))
