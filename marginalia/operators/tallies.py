"""Corpus statistics over tables of elements: group counts that partial aggregation makes cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.tree import MATHML
from marginalia.sources.nodes import is_at, with_parent

#: Kinds of publications that are told apart; all others are one.
PUBLICATION_TYPES = ("journal", "webpage", "book")
#: What the fields of a reference are about; others are OTHER.
CATEGORIES = {
    "source": "TITLE",
    "article-title": "TITLE",
    "part-title": "TITLE",
    "data-title": "TITLE",
    "year": "DATE",
    "month": "DATE",
    "day": "DATE",
    "season": "DATE",
    "date": "DATE",
    "date-in-citation": "DATE",
    "conf-date": "DATE",
    "edition": "VERSION",
    "version": "VERSION",
    "volume": "PART",
    "issue": "PART",
    "issue-part": "PART",
    "series": "PART",
    "supplement": "PART",
    "elocation-id": "PAGES",
    "fpage": "PAGES",
    "lpage": "PAGES",
    "page-range": "PAGES",
    "size": "PAGES",
    "uri": "LINK",
    "object-id": "LINK",
    "ext-link": "LINK",
}
#: Columns of nodes that the tallies below need.
COLUMNS = "article_id pre parent ord tag attrs path n_children parent_attrs"
_REF = ("back", "ref-list", "ref")


def tags(nodes: DataFrame) -> DataFrame:
    """(tag, n)."""
    return nodes.groupBy("tag").agg(F.count("*").alias("n"))


def parents_and_children(nodes: DataFrame) -> DataFrame:
    """(parent_tag, tag, n); tag TOTAL counts the parents that have children."""
    return _pairs(with_parent(nodes).where("parent IS NOT NULL"))


def category(tag: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, tag), F.lit("OTHER"))


def in_citation(*below: str) -> Column:
    """Whether an element is at this path below a structured citation of the reference list, direct or among alternatives."""
    return is_at(*_REF, "element-citation", *below) | is_at(*_REF, "citation-alternatives", "element-citation", *below)


def _above() -> Column:
    """The path below the root without the element itself."""
    return F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))


def _below_citation() -> Column:
    """Whether an element is a child of a structured citation."""
    at = lambda *p: _above() == F.array(*map(F.lit, (*_REF, *p)))
    return at("element-citation") | at("citation-alternatives", "element-citation")


def publication_types(nodes: DataFrame) -> DataFrame:
    """(publication_type, n) of citations."""
    return nodes.where(in_citation()).groupBy(F.col("attrs")["publication-type"].alias("publication_type")).agg(F.count("*").alias("n"))


def pub_id_types(nodes: DataFrame) -> DataFrame:
    """(pub_id_type, n) of the identifiers of citations."""
    return nodes.where(in_citation("pub-id")).groupBy(F.col("attrs")["pub-id-type"].alias("pub_id_type")).agg(F.count("*").alias("n"))


def citation_fields(nodes: DataFrame) -> DataFrame:
    """(publication, category, tag, n) of the fields of citations, without identifiers and groups of persons: a filter and a count."""
    of = F.col("parent_attrs")["publication-type"]
    kind = F.when(of.isin(*PUBLICATION_TYPES), of).otherwise("other").alias("publication")
    fields = nodes.where(~F.col("tag").isin("person-group", "pub-id") & _below_citation())
    return fields.groupBy(kind, category(F.col("tag")).alias("category"), "tag").agg(F.count("*").alias("n"))


def date_bits(nodes: DataFrame) -> DataFrame:
    """(content_type, bits, n) of dates in citations: 4 year, 2 month, 1 day, or 8 for an ISO date in an attribute of a date without elements; only access dates have bits."""
    own, part = in_citation("date-in-citation"), F.coalesce(*(F.when(in_citation("date-in-citation", t), n) for t, n in (("year", 4), ("month", 2), ("day", 1))))
    kind, iso = F.col("attrs")["content-type"], F.col("attrs")["iso-8601-date"].isNotNull()
    bits = F.when(own, F.when(iso & (F.col("n_children") == 0), 8).otherwise(0)).otherwise(part)
    rows = nodes.where(own | part.isNotNull()).select("article_id", F.when(own, F.col("pre")).otherwise(F.col("parent")).alias("date"), F.when(own, kind).alias("content_type"), bits.alias("bits"))
    dates = rows.groupBy("article_id", "date").agg(F.max("content_type").alias("content_type"), F.bit_or("bits").alias("bits"))
    access = F.when(F.col("content_type") == "access-date", F.col("bits"))
    return dates.groupBy("content_type", access.cast("int").alias("bits")).agg(F.count("*").alias("n"))


def mathml(nodes: DataFrame) -> DataFrame:
    """(kind, a, b, n): maths by display; by display and parent; formulas by kind and parent; articles with maths; articles with TeX. In one pass: each element says what it counts for, first within its article."""
    tag, parent, display = F.col("tag"), F.col("parent_tag"), F.col("attrs")["display"]
    none = F.lit(None).cast("string")
    entry = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    of_math = F.array(entry("display", display, none), entry("display-parent", display, parent), entry("articles", tag, none))
    counted = F.when(tag == MATHML + "math", of_math).when(tag == "tex-math", F.array(entry("articles", tag, none))).when(tag.isin("inline-formula", "disp-formula"), F.array(entry("formula", tag, parent)))
    each = with_parent(nodes).select("article_id", F.explode(counted).alias("e")).groupBy("article_id", "e.kind", "e.a", "e.b").agg(F.count("*").alias("n"))
    return each.groupBy("kind", "a", "b").agg(F.sum(F.when(F.col("kind") == "articles", 1).otherwise(F.col("n"))).alias("n"))


#: Titles and other short texts, anywhere in an article.
SHORT_TEXTS = ("title", "copyright-statement", "license-p", "comment")


def titles(nodes: DataFrame) -> DataFrame:
    """(parent_tag, tag, n): children of titles and other short texts, of the titles of cited works, and TOTAL of those with any."""
    cited = lambda t: _above() == F.array(*map(F.lit, (*_REF, "element-citation", t)))
    asked = F.col("parent_tag").isin(*SHORT_TEXTS) | cited("article-title") | cited("source")
    return _pairs(with_parent(nodes).where(asked))


def _pairs(pairs: DataFrame) -> DataFrame:
    """Counts of children by both tags; an element's first child also stands for the element in TOTAL."""
    counted = F.explode(F.array_compact(F.array("tag", F.when(F.col("ord") == 0, "TOTAL")))).alias("tag")
    return pairs.select("parent_tag", counted).groupBy("parent_tag", "tag").agg(F.count("*").alias("n"))
