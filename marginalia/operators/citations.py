"""Citations of a corpus as tables: classification, numbers, ranges, dangling ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks that stand for a range between two citations.
DASHES = ("-", "‐", "‑", "‒", "–", "—")


def xrefs(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Cross-references of scanned articles: (article_id, pos, group, rid, printed, tail, is_citation). A citation is marked as such or points to a reference; refs(article_id, zidx, id). group: the superscript it stands in, else itself."""
    found = nodes.where("tag = 'xref'").select(
        "article_id",
        F.col("pre").alias("pos"),
        F.when(F.get("path", F.size("path") - 2) == "sup", F.col("parent")).otherwise(F.col("pre")).alias("group"),
        F.col("attrs")["rid"].alias("rid"),
        F.expr("try_cast(trim(text) AS INT)").alias("printed"),
        F.trim("tail").alias("tail"),
        (F.coalesce(F.col("attrs")["ref-type"], F.lit("")) == "bibr").alias("_marked"),
    )
    ids = refs.select("article_id", F.col("id").alias("rid")).distinct().withColumn("_known", F.lit(True))
    joined = found.join(ids, ["article_id", "rid"], "left")
    return joined.withColumn("is_citation", F.col("_marked") | F.coalesce("_known", F.lit(False))).drop("_marked", "_known")


def dangling(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations without a reference: a left anti join."""
    return citations.join(refs.select("article_id", F.col("id").alias("rid")), ["article_id", "rid"], "left_anti")


def dangling_of(nodes: DataFrame) -> DataFrame:
    """(article_id, rid, pos, printed, tail): marked citations without a reference in their article, of scanned `ref` and `xref` elements. The anti join of the elements with themselves, by a window: the documents are read once, and each element is sent once."""
    attr, is_ref = F.col("attrs"), F.col("tag") == "ref"
    keyed = nodes.select("article_id", F.when(is_ref, attr["id"]).otherwise(attr["rid"]).alias("rid"), is_ref.alias("_ref"), (~is_ref & (attr["ref-type"] == "bibr")).alias("_cites"), F.col("pre").alias("pos"), F.expr("try_cast(trim(text) AS INT)").alias("printed"), F.trim("tail").alias("tail"))
    known = F.max(F.col("_ref") & F.col("rid").isNotNull() & F.col("article_id").isNotNull()).over(Window.partitionBy("article_id", "rid"))
    return keyed.where("_ref OR _cites").withColumn("_known", known).where("_cites AND NOT _known").drop("_ref", "_cites", "_known")


def number(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """(article_id, zidx, id, rord): references with their numbers; those without one are left out.

    citations(article_id, pos, rid, printed), refs(article_id, zidx, id). Numbers go by first citation, but as long as
    each newly cited reference is printed with its place in the list, the list's order is kept. So the result is the
    list's beginning up to the furthest reference cited before the first exception, then the rest by first citation.
    """
    places = refs.groupBy("article_id", F.col("id").alias("rid")).agg(F.min("zidx").alias("zidx"))
    first = citations.groupBy("article_id", "rid").agg(F.min("pos").alias("pos"), F.min_by("printed", "pos").alias("printed"))
    cited = first.join(places, ["article_id", "rid"])
    by_pos = Window.partitionBy("article_id").orderBy("pos")
    furthest = F.coalesce(F.max("zidx").over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    cited = cited.withColumn("_odd", (F.col("zidx") > furthest) & ~F.col("printed").eqNullSafe(F.col("zidx") + 1))
    cited = cited.withColumn("_late", F.max("_odd").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.coalesce(F.max(F.when(~F.col("_late"), F.col("zidx"))).over(Window.partitionBy("article_id")), F.lit(-1))
    cited = cited.withColumn("_kept", kept)
    late = cited.where("_late AND zidx > _kept").withColumn("rord", (F.col("_kept") + 1 + F.row_number().over(by_pos)).cast("int"))
    ends = cited.select("article_id", "_kept").distinct()
    early = refs.join(ends, "article_id").where("zidx <= _kept").select("article_id", "zidx", "id", (F.col("zidx") + 1).cast("int").alias("rord"))
    return early.unionAll(late.select("article_id", "zidx", F.col("rid").alias("id"), "rord"))


def expand_ranges(citations: DataFrame) -> DataFrame:
    """(article_id, group, pos, ord, rord, implied): the citations of each group, and those that a dash between two stands for. citations(article_id, group, pos, rord, printed, tail); a dash counts only if both printed numbers are right."""
    in_group = Window.partitionBy("article_id", "group").orderBy("pos")
    right = F.col("printed").eqNullSafe(F.col("rord"))
    begins = F.when(F.col("tail").isin(*DASHES) & right, F.col("rord"))
    rows = citations.withColumn("_begin", F.lag(begins).over(in_group))
    between = F.when(F.col("_begin").isNotNull() & right & (F.col("rord") - F.col("_begin") > 1), F.sequence(F.col("_begin") + 1, F.col("rord") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_all", F.concat(between, F.array("rord")))
    return rows.select("article_id", "group", "pos", F.posexplode("_all").alias("ord", "number"), F.size("_all").alias("_n")).select("article_id", "group", "pos", "ord", F.col("number").alias("rord"), (F.col("ord") < F.col("_n") - 1).alias("implied"))
