"""Articles in XML -> one row of parsed values, normalised XML and HTML per article.

Reading a document is a map over rows: one value in, one out, without a shuffle. Everything after it works on columns.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginalia.functions import model, render, tree

PERSON = "struct<surname: string, given: string, suffix: string, literal: string>"
GROUP = f"struct<persons: array<{PERSON}>, etal: boolean>"
DATE = "struct<year: int, month: int, day: int>"
REFERENCE = (
    f"struct<id: string, authors: {GROUP}, editors: {GROUP}, article_title: string, source_title: string, edition: int,"
    f" date: {DATE}, access_date: {DATE}, fields: map<string, string>, pub_ids: map<string, string>>"
)
AUTHOR = "struct<surname: string, given: string, suffix: string, email: string, orcid: string>"
ISSUE = "struct<condition: array<string>, sourceline: int, info: string>"
ARTICLE = (
    "article_id string, valid boolean, title string, abstract string, body string, bare_tex boolean, copyright string, license_p string,"
    f" license_ref string, cc_license_type string, authors array<{AUTHOR}>, refs array<{REFERENCE}>, xml string, issues array<{ISSUE}>"
)

#: Columns that are made only if they are named: ids of the cited references in the order of their numbers, and issues of citations. Both need no more of a reference than its id.
OPTIONAL = f"cited array<string>, citation_issues array<{ISSUE}>"

#: Years and editions beyond this don't fit the tables' integers; they are kept as null.
_MOST = (1 << 31) - 1


def _fits(value: int | None) -> int | None:
    return value if value is None or -_MOST <= value <= _MOST else None


def _bounded(ref: dict) -> dict:
    bound = lambda d: None if d is None or _fits(d["year"]) is None else d
    return ref | {"edition": _fits(ref["edition"]), "date": bound(ref["date"]), "access_date": bound(ref["access_date"]), "fields": list(ref["fields"].items()), "pub_ids": list(ref["pub_ids"].items())}


#: Frames of Python that reading one document may take: some per level of its depth.
DEEPEST = 1_000_000
_RENDERED = frozenset(["title", "abstract", "body", "bare_tex", "copyright", "license_p"])


def convert(content: bytes | None, wanted: frozenset[str] | None = None) -> dict:
    """All values of one document, or the wanted ones. It never fails: what can't be read, because it is nested too deeply or for any other reason, is an issue of a row that isn't valid."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEEPEST))
    try:
        return _convert(content, wanted)
    except (RecursionError, MemoryError, ValueError, LookupError, TypeError, AttributeError) as e:
        return {"valid": False, "issues": [{"condition": ["Unreadable", type(e).__name__], "sourceline": None, "info": str(e)[:200]}]}
    finally:
        sys.setrecursionlimit(limit)


#: What needs neither the body nor the references, and what needs the references themselves, not only their ids.
_OF_FRONT = frozenset(["article_id", "title", "authors", "copyright", "license_p", "license_ref", "cc_license_type"])
_OF_REFERENCES = frozenset(["refs", "xml", "issues"])
_CITED = frozenset(["cited"])


def _convert(content: bytes | None, wanted: frozenset[str] | None) -> dict:
    asks = lambda *names: wanted is None or not wanted.isdisjoint(names)
    parts = "all" if asks(*_OF_REFERENCES) else "front" if wanted <= _OF_FRONT else "cited" if wanted == _CITED else "ids"
    named = wanted is not None and "citation_issues" in wanted
    article, issues = model.parse(tree.scan(content or b""), parts, asks("issues") or named)
    row = {"valid": article is not None, "issues": [{"condition": list(i.condition), "sourceline": i.line, "info": i.info} for i in issues]}
    if named:
        row["citation_issues"] = [i for i in row["issues"] if i["condition"][0] == "InvalidCitation"]
    if article is None:
        return row
    if wanted is not None and "cited" in wanted:
        row["cited"] = None if article.refs is None else [r["id"] for r in article.refs]
    row["authors"] = article.authors
    if asks(*_RENDERED):
        html = render.HtmlWriter()
        if asks("body", "bare_tex"):
            row |= {"body": html.section(article.body), "bare_tex": html.bare_tex}
        row["title"] = " " if article.title is None else html.inner(article.title)
        if asks("abstract"):
            row["abstract"] = None if article.abstract is None else html.blocks(article.abstract)
        if article.license is not None:
            row |= {"license_p": html.inner(article.license["license_p"]), "copyright": None if article.copyright is None else html.inner(article.copyright)}
    if article.license is not None:
        row |= {"license_ref": article.license["license_ref"] or None, "cc_license_type": article.license["cc_license_type"]}
    if asks("refs"):
        row["refs"] = None if article.refs is None else [_bounded(r) for r in article.refs]
    if asks("xml"):
        row["xml"] = render.baseline_xml(article)
    return row


def _map(raw: DataFrame, id_col: str, content_col: str, schema: str, make: Callable[[bytes | None], dict]) -> DataFrame:
    """A row per document, without a shuffle."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [make(x) | {"article_id": i} for i, x in zip(part.column("id").to_pylist(), part.column("content").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return raw.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, schema)


def articles(raw: DataFrame, id_col: str = "article_id", content_col: str = "content", fields: str | None = None) -> DataFrame:
    """raw(article_id, content) -> one row per document. Malformed XML, or another root than an article, gives a row that isn't valid, with its issues. fields: names of the columns to make besides article_id, all by default; what nobody asks for isn't made."""
    if fields is None:
        return _map(raw, id_col, content_col, ARTICLE, convert)
    wanted = frozenset(fields.split())
    kinds = dict(_columns() + _columns(OPTIONAL))
    schema = ", ".join(["article_id string", *(f"{c} {kinds[c]}" for c in fields.split())])
    return _map(raw, id_col, content_col, schema, lambda x: convert(x, wanted))


def _columns(schema: str = ARTICLE) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(schema).fields]


def restyled_twice(raw: DataFrame, id_col: str = "article_id", content_col: str = "content") -> DataFrame:
    """(article_id, xml, same): each document's normal form, and whether the normal form of that is the same; both in one pass."""

    def make(content: bytes | None) -> dict:
        xml = convert(content, frozenset(["xml"])).get("xml")
        return {"xml": xml, "same": xml is not None and convert(xml.encode(), frozenset(["xml"])).get("xml") == xml}

    return _map(raw, id_col, content_col, "article_id string, xml string, same boolean", make)


def issues(parsed: DataFrame, column: str = "issues") -> DataFrame:
    """(article_id, pos, condition, sourceline, info): one row per issue, in the articles' order. column: the issues to take."""
    rows = parsed.select("article_id", F.posexplode(column).alias("pos", "issue"))
    return rows.select("article_id", "pos", "issue.condition", "issue.sourceline", "issue.info")


def distinct_conditions(parsed: DataFrame) -> DataFrame:
    """(article_id, condition, first_pos): each different condition of an article once."""
    return issues(parsed).groupBy("article_id", "condition").agg(F.min("pos").alias("first_pos"))


def authors(parsed: DataFrame) -> DataFrame:
    """(article_id, ord, surname, given_names, suffix, email, orcid)."""
    rows = parsed.select("article_id", F.posexplode("authors").alias("ord", "a"))
    return rows.select("article_id", "ord", "a.surname", F.col("a.given").alias("given_names"), "a.suffix", "a.email", "a.orcid")


def references(parsed: DataFrame) -> DataFrame:
    """(article_id, zidx, ref.*): the cited references, in the order of their numbers."""
    return parsed.select("article_id", F.posexplode("refs").alias("zidx", "ref")).select("article_id", "zidx", "ref.*")


def cited(parsed: DataFrame) -> DataFrame:
    """(article_id, zidx, id): the ids of the cited references, in the order of their numbers, of articles with the column `cited`."""
    return parsed.select("article_id", F.posexplode("cited").alias("zidx", "id"))


def html_issues(issues_col: Column) -> Column:
    """The issues of an article as an HTML list."""
    from marginalia.functions.values import escaped

    line = lambda i: F.coalesce(F.concat(F.lit(" (line "), i["sourceline"].cast("string"), F.lit(")")), F.lit(""))
    info = lambda i: F.when(F.coalesce(i["info"], F.lit("")) != "", F.concat(F.lit(": "), i["info"])).otherwise("")
    text = lambda i: F.concat(F.array_join(i["condition"], " "), line(i), info(i))
    return F.concat(F.lit("<ul>\n"), F.array_join(F.transform(issues_col, lambda i: F.concat(F.lit("<li>"), escaped(text(i)), F.lit("</li>\n"))), ""), F.lit("</ul>\n"))
