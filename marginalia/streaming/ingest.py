"""Incremental ingestion: new article files become rows of a stored table, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.articles import articles


def stream_articles(spark: SparkSession, path: str, name: str = "article.xml", per_trigger: int = 1000) -> DataFrame:
    """A stream of parsed articles: each file that appears below a folder, at most per_trigger at once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    raw = reader.load(path).select(F.regexp_replace("path", "/[^/]*$", "").alias("article_id"), "content")
    return articles(raw)


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Adds the articles of all files that aren't ingested yet to a Parquet table, then ends. The checkpoint remembers the files, so a run that was broken off goes on where it was."""
    return stream_articles(spark, path).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
