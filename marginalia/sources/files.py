"""Scans: articles, file lists, journal lists, reference lists, stored webstracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.values import integer

#: Licences of a file list that are used.
LICENSES = ("CC BY", "CC0", "CC BY-SA", "CC BY-NC", "CC BY-NC-SA", "CC BY-ND", "CC BY-NC-ND")


def read_articles(spark: SparkSession, path: str, name: str = "article.xml") -> DataFrame:
    """(article_id, path, modified, content): all files of that name below a folder, or one file. The id is the folder's path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    found = reader.load(path)
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("article_id"), "path", F.col("modificationTime").alias("modified"), "content")


def filelist_entries(lines: DataFrame) -> DataFrame:
    """Entries of file lists: (pmcid, journal_id, updated, license) of rows (accession, citation, license, retracted, updated), all text. Retracted ones and other licences are left out; the journal is the citation's text before the first period."""
    rows = lines.where((F.col("retracted") == "no") & F.col("license").isin(*LICENSES))
    return rows.select(
        F.expr("try_cast(substring(accession, 4) AS INT)").alias("pmcid"),
        F.split_part("citation", F.lit("."), F.lit(1)).alias("journal_id"),
        F.to_date(F.substring("updated", 1, 10)).alias("updated"),
        "license",
    )


def read_filelist(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file list with a header, as rows for filelist_entries; columns are taken by position."""
    raw = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    names = ["accession", "citation", "license", "retracted", "updated"]
    by_name = {"AccessionID": 0, "Article Citation": 1, "License": 2, "Retracted": 3}
    places = {by_name.get(c, 4 if c.startswith("Last Updated") else None): c for c in raw.columns}
    return raw.select(*(F.col(f"`{places[i]}`").alias(n) for i, n in enumerate(names)))


def in_range(entries: DataFrame, begin: str, end: str) -> DataFrame:
    """Entries updated from begin on and before end."""
    return entries.where((F.col("updated") >= F.lit(begin).cast("date")) & (F.col("updated") < F.lit(end).cast("date")))


def make_index(spark: SparkSession, lists: list[str], path: str, begin: str, end: str) -> None:
    """Writes the entries of several file lists as a table, by class of licence; an existing one is an error."""
    every = None
    for source in lists:
        part = in_range(filelist_entries(read_filelist(spark, source)), begin, end)
        every = part if every is None else every.unionByName(part)
    every.withColumn("oa_class", oa_class(F.col("license"))).write.mode("errorifexists").partitionBy("oa_class").parquet(path)


def oa_class(license: Column) -> Column:
    """The folder of a licence: commercial use allowed or not."""
    return F.when(license.contains("NC"), "oa_noncomm").otherwise("oa_comm")


def entry_path(entries: DataFrame) -> DataFrame:
    """entries with the path of each article."""
    name = F.format_string("PMC%d", "pmcid")
    return entries.withColumn("path", F.concat(oa_class(F.col("license")), F.lit("/xml/all/"), name, F.lit(".xml")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the trimmed lines of a text file; a missing file has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).select(F.trim("value").alias("value"))


def write_lines(values: DataFrame, path: str) -> None:
    """Writes the different values of a column, sorted, one a line."""
    values.toDF("value").distinct().orderBy("value").write.text(path)


def read_webstracts(spark: SparkSession, path: str) -> DataFrame:
    """Stored webstracts, one JSON document a file."""
    return spark.read.option("multiLine", "true").json(path)


def up_to_date(targets: DataFrame, sources: DataFrame, key: str = "article_id") -> DataFrame:
    """Keys of the sources whose target is missing or older: (key). Both sides have `modified`."""
    newest = targets.select(key, F.col("modified").alias("_made"))
    return sources.join(newest, key, "left").where("_made IS NULL OR _made < modified").select(key)


def line_numbers(text: Column) -> Column:
    """The integer on a line; null if there is none."""
    return integer(text)
