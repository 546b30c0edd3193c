"""Queries over many short rows: how their work is dealt out."""

import re

import pytest
from pyspark.sql import functions as F

from marginalia.plans import corpora
from marginalia.plans.queries import QUERIES


@pytest.fixture(scope="module")
def short_rows(spark, tmp_path_factory):
    """Tables of short rows, each one row group of one file, which Spark gives to one task."""
    path = tmp_path_factory.mktemp("short_rows")
    n = spark.range(1, 6001)
    key = lambda name: F.col("id").alias(name)
    word = lambda name: F.concat(F.lit(name), F.col("id").cast("string")).alias(name)
    tables = {
        "part": n.select(key("p_partkey"), word("p_name"), word("p_brand"), word("p_type"), F.lit(7).alias("p_size")),
        "customer": n.select(key("c_custkey")),
        "orders": n.select(key("o_orderkey")),
        "lineitem": spark.range(1, 24001).select((F.col("id") % 6000).alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 4).cast("int").alias("l_linenumber")),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


DEALT_OUT = ["tally_publication_types", "citations_html", "cite_order_kept", "dangling_by_anti_join", "dangling_citations", "cite_range_expand", "cite_numbering", "restyle_idempotent", "webstract_editions", "ref_csl_titles", "links_html", "csl_roundtrip", "elocation_pages", "html_page_issues", "link_issues", "license_type", "markup_html", "bibliography_full", "webstract_json", "html_page"]


@pytest.mark.parametrize("name", DEALT_OUT)
def test_articles_of_one_file_are_parsed_by_several_tasks(spark, short_rows, name):
    plan = plan_of(QUERIES[name](spark, short_rows))
    parsed = plan[plan.rindex("MapInArrow") :]
    assert re.search(r"Exchange [^\n]*REPARTITION_BY_NUM", parsed[: parsed.index("Scan parquet")])


def test_rows_are_dealt_out_evenly_and_whole(spark, short_rows):
    rows = corpora.spread(corpora.table(spark, short_rows, "part"))
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 3 and sum(sizes) == 6000 and max(sizes) - min(sizes) <= 3
    assert rows.select("p_partkey").distinct().count() == 6000


def test_pages_and_their_issues_come_from_one_parse(spark, short_rows):
    assert plan_of(QUERIES["html_page_issues"](spark, short_rows)).count("MapInArrow") == 1


def test_anti_join_reads_documents_once(spark, short_rows):
    assert plan_of(QUERIES["dangling_by_anti_join"](spark, short_rows)).count("MapInArrow") == 1
