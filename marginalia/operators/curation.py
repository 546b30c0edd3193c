"""Which journals and articles of a corpus are worth working on: semi and anti joins, penalties, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Types of articles that aren't looked at as test articles.
SKIPPED_TYPES = ("correction", "retraction", "news", "abstract")
#: Types of articles that are counted as skipped where journals are judged.
SKIPPED_IN_JOURNALS = (
    "abstract",
    "addendum",
    "discussion",
    "expression-of-concern",
    "introduction",
    "meeting-report",
    "news",
    "obituary",
    "reply",
)
#: Fields of references that make a journal unfit.
REJECT_FIELDS = (
    "chapter-title",
    "collab",
    "etal",
    "italic",
    "name",
    "role",
    "std",
    "trans-source",
    "trans-title",
)
#: Fields of references that are fine.
OK_FIELDS = (
    "article-title", "comment", "conf-date", "conf-loc", "conf-name", "conf-sponsor", "data-title", "date", "date-in-citation", "day",
    "edition", "elocation-id", "ext-link", "fpage", "gov", "isbn", "issn", "institution", "issue", "issue-part", "issue-title", "label",
    "lpage", "month", "object-id", "page-range", "patent", "part-title", "person-group", "pub-id", "publisher-loc", "publisher-name",
    "season", "series", "size", "source", "supplement", "uri", "version", "volume", "year",
)
#: Kinds of conditions that don't count, and unsupported elements (tag, parent) that don't; `abstract` may be missing.
IGNORED_KINDS = ("ProcessingInstruction", "UnsupportedAttribute")
IGNORED = (
    ("MissingContent", "abstract", "article-meta"),
    ("UnsupportedElement", "article-categories", "article-meta"),
    ("UnsupportedElement", "article-id", "article-meta"),
    ("UnsupportedElement", "author-notes", "article-meta"),
    ("UnsupportedElement", "copyright-holder", "permissions"),
    ("UnsupportedElement", "copyright-year", "permissions"),
    ("UnsupportedElement", "counts", "article-meta"),
    ("UnsupportedElement", "custom-meta-group", "article-meta"),
    ("UnsupportedElement", "elocation-id", "article-meta"),
    ("UnsupportedElement", "ext-link", "comment"),
    ("UnsupportedElement", "ext-link", "element-citation"),
    ("UnsupportedElement", "fpage", "article-meta"),
    ("UnsupportedElement", "funding-group", "article-meta"),
    ("UnsupportedElement", "history", "article-meta"),
    ("UnsupportedElement", "hr", "th"),
    ("UnsupportedElement", "issue", "article-meta"),
    ("UnsupportedElement", "journal-meta", "front"),
    ("UnsupportedElement", "kwd-group", "article-meta"),
    ("UnsupportedElement", "label", "ref"),
    ("UnsupportedElement", "lpage", "article-meta"),
    ("UnsupportedElement", "processing-meta", "article"),
    ("UnsupportedElement", "pub-date", "article-meta"),
    ("UnsupportedElement", "related-article", "article-meta"),
    ("UnsupportedElement", "self-uri", "article-meta"),
    ("UnsupportedElement", "volume", "article-meta"),
)
#: Conditions by penalty.
TIERS = {
    1: (
        ("ExcessElement", "comment", "element-citation"),
        ("IgnoredText", "date-in-citation", "element-citation"),
        ("InvalidInteger", "month", "element-citation"),
        ("MissingContent", "body", "article"),
        ("UnsupportedElement", "address", "contrib"),
        ("UnsupportedElement", "aff", "contrib-group"),
        ("UnsupportedElement", "conf-loc", "element-citation"),
        ("UnsupportedElement", "degrees", "contrib"),
        ("UnsupportedElement", "italic", "comment"),
        ("UnsupportedElement", "role", "contrib"),
        ("UnsupportedElement", "size", "element-citation"),
        ("UnsupportedElement", "sup", "article-title"),
        ("UnsupportedElement", "sup", "source"),
        ("UnsupportedElement", "supplement", "element-citation"),
        ("UnsupportedElement", "title", "abstract"),
        ("UnsupportedElement", "uri", "license-p"),
        ("UnsupportedElement", "xref", "contrib"),
    ),
    10: (
        ("ExcessElement", "contrib-group", "article-meta"),
        ("UnsupportedElement", "ack", "back"),
        ("UnsupportedElement", "aff", "article-meta"),
        ("UnsupportedElement", "collab", "element-citation"),
        ("UnsupportedElement", "collab", "person-group"),
        ("UnsupportedElement", "part-title", "element-citation"),
        ("UnsupportedElement", "sc", "p"),
        ("UnsupportedElement", "table-wrap-foot", "table-wrap"),
    ),
    100: (
        ("UnsupportedElement", "caption", "fig"),
        ("UnsupportedElement", "fig", "body"),
        ("UnsupportedElement", "fig", "sec"),
        ("UnsupportedElement", "fn-group", "back"),
        ("UnsupportedElement", "graphic", "fig"),
        ("UnsupportedElement", "graphic", "p"),
        ("UnsupportedElement", "inline-graphic", "alternatives"),
        ("UnsupportedElement", "label", "fig"),
    ),
    1000: (
        ("ExcessElement", "abstract", "article-meta"),
        ("UnsupportedAttributeValue", "xref", "ref-type", "bibr"),
        ("UnsupportedElement", "bio", "back"),
        ("UnsupportedElement", "boxed-text", "sec"),
        ("UnsupportedElement", "citation-alternatives", "ref"),
        ("UnsupportedElement", "glossary", "back"),
        ("UnsupportedElement", "inline-supplementary-material", "p"),
        ("UnsupportedElement", "mixed-citation", "ref"),
        ("UnsupportedElement", "notes", "back"),
        ("UnsupportedElement", "sec", "back"),
        ("UnsupportedElement", "supplementary-material", "p"),
        ("UnsupportedElement", "supplementary-material", "sec"),
        ("UnsupportedElement", "trans-abstract", "article-meta"),
        ("UnsupportedElement", "trans-source", "element-citation"),
        ("UnsupportedElement", "trans-title", "element-citation"),
        ("UnsupportedElement", "trans-title-group", "title-group"),
    ),
}
#: A condition that has no tier of its own.
UNKNOWN_PENALTY = 10
#: Penalties from which on an article is forgone, and from which on they are shown as one.
FORGO, SHOWN = 1000, 100
#: Citations that a journal must have more than, to be listed as mixed or unmixed.
FEW_CITATIONS = 10


def journal_entries(index: DataFrame, journals: DataFrame) -> DataFrame:
    """Entries of the listed journals: a left semi join on journal_id."""
    return index.join(journals.select(F.col("value").alias("journal_id")), "journal_id", "left_semi")


def unclassified(index: DataFrame, *lists: DataFrame) -> DataFrame:
    """Entries of journals that no list has: left anti joins."""
    for journals in lists:
        index = index.join(journals.select(F.col("value").alias("journal_id")), "journal_id", "left_anti")
    return index


def listed_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """index(path, ...) and whether files(path) has the entry's file: `found`. A left join by path."""
    return index.join(files.select("path").distinct().withColumn("found", F.lit(True)), "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """(value): paths of the index that files(path) doesn't have, each once."""
    return index.join(files, "path", "left_anti").select(F.col("path").alias("value")).distinct()


def citation_cases(nodes: DataFrame) -> DataFrame:
    """(article_id, cites, ecites, odd_fields, reject_fields) of scanned articles: citations of the reference list, structured ones, fields of these that aren't among the fine ones, and fields that make a journal unfit. Read from the paths, so one aggregation does."""
    tag, above, ref = F.get("path", F.size("path") - 1), F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0))), ("back", "ref-list", "ref")
    under = lambda *more: above == F.array(*map(F.lit, (*ref, *more)))
    structured = (tag == "element-citation") & (under() | under("citation-alternatives"))
    cite = tag.isin("element-citation", "mixed-citation", "citation-alternatives") & under()
    field = under("element-citation") | under("citation-alternatives", "element-citation")
    counts = {"cites": cite, "ecites": structured, "odd_fields": field & ~tag.isin(*OK_FIELDS), "reject_fields": field & tag.isin(*REJECT_FIELDS)}
    return nodes.groupBy("article_id").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def article_facts(nodes: DataFrame) -> DataFrame:
    """(article_id, article_type, journal_id) of scanned articles: the root's attribute, empty without, and the first journal-id."""
    journal = (F.size("path") == 4) & (F.array_join(F.slice("path", 2, 3), "/") == "front/journal-meta/journal-id")
    facts = nodes.where((F.col("pre") == 0) | journal).groupBy("article_id")
    return facts.agg(F.coalesce(F.max(F.when(F.col("pre") == 0, F.col("attrs")["article-type"])), F.lit("")).alias("article_type"), F.min_by(F.when(journal, F.col("text")), F.when(journal, F.col("pre"))).alias("journal_id"))


def classify_journals(cases: DataFrame) -> DataFrame:
    """(journal_id, total, local, skipped, cites, ecites, odd_fields, reject_fields, verdict) of cases(journal_id, found, article_type, cites, ecites, odd_fields, reject_fields), one row an article; counts of articles that weren't found are null.

    reject: any field that makes a journal unfit; else, with more than 10 citations, mixed if under half of them are
    structured, unmixed if all are; undecided without any of these.
    """
    counts = [F.coalesce(F.sum(c).cast("long"), F.lit(0)).alias(c) for c in ("cites", "ecites", "odd_fields", "reject_fields")]
    skipped = F.count_if(F.col("found") & F.col("article_type").isin(*SKIPPED_IN_JOURNALS)).alias("skipped")
    sums = cases.groupBy("journal_id").agg(F.count("*").alias("total"), F.count_if("found").alias("local"), skipped, *counts)
    enough = F.col("cites") > FEW_CITATIONS
    verdict = F.when(F.col("reject_fields") > 0, "reject").when(enough & (F.col("ecites") * 2 < F.col("cites")), "mixed").when(enough & (F.col("ecites") == F.col("cites")), "unmixed").otherwise("undecided")
    return sums.withColumn("verdict", verdict)


def journal_lists(classified: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """(list, value): the lists of rejected, mixed and unmixed journals, what earlier runs put there (known lists of `value`) and what this one adds, each journal once."""
    out = classified.where("verdict <> 'undecided' AND journal_id IS NOT NULL").select(F.col("verdict").alias("list"), F.col("journal_id").alias("value"))
    for name, journals in known.items():
        out = out.unionAll(journals.select(F.lit(name).alias("list"), "value"))
    return out.distinct()


def tier_table(spark: SparkSession, tiers: dict = TIERS) -> DataFrame:
    """(condition, penalty) of a table of rules, the highest for a condition that has several."""
    rows = [(list(c), int(p)) for p, cs in tiers.items() for c in cs]
    return spark.createDataFrame(rows, "condition array<string>, penalty int").groupBy("condition").agg(F.max("penalty").alias("penalty"))


def ignored_table(spark: SparkSession, ignored: tuple = IGNORED) -> DataFrame:
    """(condition)."""
    return spark.createDataFrame([(list(c),) for c in ignored], "condition array<string>")


def penalties(articles: DataFrame, conditions: DataFrame, tiers: DataFrame, ignored: DataFrame) -> DataFrame:
    """(article_id, penalty, mathml), one row for each of articles(article_id), of distinct conditions(article_id, condition). tiers(condition, penalty) and ignored(condition) are tables of rules; Spark broadcasts them, as they are small. A condition without a tier counts UNKNOWN_PENALTY."""
    counted = conditions.where(~F.get("condition", F.lit(0)).isin(*IGNORED_KINDS)).join(ignored, "condition", "left_anti")
    each = counted.join(tiers, "condition", "left").withColumn("_p", F.coalesce("penalty", F.lit(UNKNOWN_PENALTY)))
    maths = F.startswith(F.coalesce(F.get("condition", F.lit(1)), F.lit("")), F.lit("{http://www.w3.org/1998/Math/MathML}"))
    sums = each.groupBy("article_id").agg(F.sum("_p").cast("long").alias("penalty"), F.bool_or(maths).alias("mathml"))
    return articles.select("article_id").join(sums, "article_id", "left").select("article_id", F.coalesce("penalty", F.lit(0)).cast("long").alias("penalty"), F.coalesce("mathml", F.lit(False)).alias("mathml"))


def status(found: Column, article_type: Column, penalty: Column, mathml: Column) -> Column:
    """NOTFOUND, SKIPPED, FORGO, MATHML or TBD."""
    return F.when(~found, "NOTFOUND").when(article_type.isin(*SKIPPED_TYPES), "SKIPPED").when(penalty >= FORGO, "FORGO").when(mathml, "MATHML").otherwise("TBD")


def distributions(cases: DataFrame) -> DataFrame:
    """(kind, key, n) of cases(status, article_type, journal_id, penalty), one row an article: articles by status; journals of forgone ones and of those with maths; of what is to be done, types, journals and penalties, from 100 on together. One pass: each article says what it counts for."""
    state, text = F.col("status"), lambda c: F.col(c).cast("string")
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    own = F.when(state == "FORGO", F.array(entry("forgone journals", text("journal_id")))).when(state == "MATHML", F.array(entry("maths journals", text("journal_id"))))
    shown = F.least("penalty", F.lit(SHOWN).cast("long")).cast("string")
    own = own.when(state == "TBD", F.array(entry("types", text("article_type")), entry("journals", text("journal_id")), entry("penalties", shown)))
    every_entry = F.concat(F.array(entry("articles", state)), F.coalesce(own, F.array().cast("array<struct<kind: string, key: string>>")))
    return cases.select(F.explode(every_entry).alias("e")).groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def penalty_histogram(scored: DataFrame) -> DataFrame:
    """(penalty, n) of scored(penalty, mathml), articles to be done only: those that aren't forgone and have no unsupported maths; penalties of SHOWN and above together."""
    todo = scored.where(f"penalty < {FORGO} AND NOT mathml")
    return todo.groupBy(F.least("penalty", F.lit(SHOWN).cast("long")).alias("penalty")).agg(F.count("*").alias("n"))


#: Ranges in which rows are numbered, and rows of the sample that each range's end is read from.
RANGES, SAMPLED = 64, 32


def every(rows: DataFrame, step: int, *order: str) -> DataFrame:
    """Every step-th row in the given order, the first included: a sample of the corpus. Rows are numbered within ranges of values, whose ends are constants from a bounded sample, so no task sees all and each run sees the same ranges. Ties are in any order."""
    key = F.struct(*order)
    sampled = rows.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(RANGES * SAMPLED).orderBy("k").collect()
    ends = [r.k for r in sampled[SAMPLED::SAMPLED]]
    kinds = rows.select(key.alias("k")).schema["k"].dataType
    below = [(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(e, kinds.fields, strict=True))) < key).cast("int") for e in ends]
    ranged = rows.withColumn("_range", sum(below, F.lit(0)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # at most RANGES rows
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return placed.where((F.col("_before") + F.col("_own") - 1) % step == 0).select(*rows.columns)
