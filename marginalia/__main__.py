"""Command line: python -m marginalia INPATH OUTPATH --to xml|html|json|jats|files|issues. INPATH is a file or a folder of articles.

`files` writes article.xml files, one folder an article, `issues` a list in HTML of what doesn't fit; the others write JSON lines.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import marginalia
from marginalia.operators import articles, jats, webstracts
from marginalia.sources.files import read_articles


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marginalia", description="Convert articles in XML.")
    parser.add_argument("--version", action="version", version=f"marginalia {marginalia.__version__}")
    parser.add_argument("inpath")
    parser.add_argument("outpath")
    parser.add_argument("--to", choices=["xml", "html", "json", "jats", "files", "issues"], default="xml")
    options = parser.parse_args(args)
    if options.inpath == options.outpath:
        parser.error("the output path must differ from the input path")
    spark = SparkSession.builder.appName("marginalia").getOrCreate()
    parsed = articles.articles(read_articles(spark, options.inpath, "*.xml"))
    rows = webstracts.webstracts(parsed)
    if options.to == "files":
        named = parsed.where("valid").select(F.regexp_extract("article_id", "([^/]+)$", 1).alias("article_id"), "xml")
        webstracts.write_articles(named, str(Path(options.outpath).absolute()) if "://" not in options.outpath else options.outpath)
        return _invalid(parsed)
    made = {
        "issues": lambda: (parsed.select("article_id", articles.html_issues(F.col("issues")).alias("html")), "html"),
        "xml": lambda: (parsed.where("valid").select("article_id", "xml"), "xml"),
        "jats": lambda: (jats.to_jats(parsed.where("valid")), "jats"),
        "html": lambda: (webstracts.page(rows), "html"),
        "json": lambda: (webstracts.to_json(rows), "webstract"),
    }[options.to]()
    webstracts.write_files(made[0], options.outpath, made[1])
    return _invalid(parsed)


def _invalid(parsed: DataFrame) -> int:
    bad = parsed.where("not valid").count()
    if bad:
        print(f"{bad} invalid", file=sys.stderr)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
