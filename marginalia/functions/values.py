"""Values in texts: as plain functions for one document, and as columns for tables of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of licence URLs, and kinds.
CC_URLS = (
    ("https://creativecommons.org/publicdomain/zero/", "cc0license"),
    ("https://creativecommons.org/licenses/by/", "ccbylicense"),
    ("https://creativecommons.org/licenses/by-sa/", "ccbysalicense"),
    ("https://creativecommons.org/licenses/by-nc/", "ccbynclicense"),
    ("https://creativecommons.org/licenses/by-nc-sa/", "ccbyncsalicense"),
    ("https://creativecommons.org/licenses/by-nd/", "ccbyndlicense"),
    ("https://creativecommons.org/licenses/by-nc-nd/", "ccbyncndlicense"),
)
_ORCID = r"^[0-9]{15}[0-9X]$"


def integer_of(text: str | None) -> int | None:
    """The integer that a text stands for, as Python reads it."""
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        return None


def edition_of(text: str | None) -> int | None:
    """The number of an edition: `3`, `3rd`, `3rd ed`, `3rd ed.`."""
    if text is None:
        return None
    text = text.removesuffix(".")
    text = text[:-3] if text.endswith((" Ed", " ed")) else text
    text = text[:-2] if text.endswith(("st", "nd", "rd", "th")) else text
    return integer_of(text)


def orcid_of(url: str | None) -> str | None:
    """The 16 characters of an ORCID, given with or without its address; no check sum."""
    text = (url or "").removeprefix("http://orcid.org/").removeprefix("https://orcid.org/").replace("-", "")
    return text if re.match(_ORCID, text) and len(text) == 16 else None


def cc_license_of(url: str | None) -> str | None:
    return next((kind for start, kind in CC_URLS if (url or "").startswith(start)), None)


def integer(text: Column) -> Column:
    """integer_of for ASCII digits: white space around and a sign are fine, single underscores between digits too."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.regexp_like(bare, F.lit(r"^[+-]?[0-9]+(_[0-9]+)*$")), F.replace(bare, F.lit("_"), F.lit("")).try_cast("int"))


def edition(text: Column) -> Column:
    """edition_of as a column."""
    dotless = F.regexp_replace(text, r"\.$", "")
    return integer(F.regexp_replace(F.regexp_replace(dotless, " [Ee]d$", ""), "(st|nd|rd|th)$", ""))


def orcid(url: Column) -> Column:
    """orcid_of as a column."""
    text = F.replace(F.regexp_replace(F.regexp_replace(url, "^http://orcid[.]org/", ""), "^https://orcid[.]org/", ""), F.lit("-"), F.lit(""))
    return F.when(F.regexp_like(text, F.lit(_ORCID)), text)


def orcid_19(orcid16: Column) -> Column:
    """Four groups of four characters."""
    return F.regexp_replace(orcid16, "(.{4})(?=.)", "$1-")


def cc_license(url: Column) -> Column:
    """cc_license_of as a column."""
    out = F.lit(None).cast("string")
    for start, kind in reversed(CC_URLS):
        out = F.when(url.startswith(start), kind).otherwise(out)
    return out


def doi(text: Column) -> Column:
    """A DOI, repaired if it has its address before it; null if it isn't one."""
    return F.when(text.startswith("10."), text).when(text.startswith("https://doi.org/"), F.substring(text, 17, 1 << 30))


def pages(first: Column, last: Column) -> Column:
    """`first-last`, or the first alone; null without a first."""
    return F.when(first.isNotNull() & (first != ""), F.concat(first, F.when(last.isNotNull() & (last != ""), F.concat(F.lit("-"), last)).otherwise("")))


def date_bits(year: Column, month: Column, day: Column) -> Column:
    """4 for a year, 2 for a month, 1 for a day."""
    bit = lambda c, n: F.when(c.isNotNull(), n).otherwise(0)
    return bit(year, 4) + bit(month, 2) + bit(day, 1)


def escaped(text: Column, quotes: bool = False) -> Column:
    """Text with & < > as entities, in attributes also quotes."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def local_name(tag: Column) -> Column:
    """A tag without its namespace."""
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def blob_swhid(content: Column) -> Column:
    """The identifier of a file's content: that of a git blob."""
    head = F.concat(F.lit("blob "), F.length(content).cast("string")).cast("binary")
    return F.concat(F.lit("swh:1:cnt:"), F.sha1(F.concat(head, F.unhex(F.lit("00")), content)))


def tree_swhid(entries: Column) -> Column:
    """The identifier of a directory. entries: array of struct(name, swhid, folder); folders sort as if their names ended with a slash."""
    key = lambda e: F.concat(e["name"], F.when(e["folder"], "/").otherwise("")).cast("binary")
    ordered = F.array_sort(entries, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    nothing = F.lit("").cast("binary")
    mode = lambda e: F.when(e["folder"], "40000 ").otherwise("100644 ")
    row = lambda e: F.concat(F.concat(mode(e), e["name"]).cast("binary"), F.unhex(F.lit("00")), F.unhex(F.substring(e["swhid"], 11, 40)))
    body = F.aggregate(ordered, nothing, lambda acc, e: F.concat(acc, row(e)))
    head = F.concat(F.lit("tree "), F.length(body).cast("string")).cast("binary")
    return F.concat(F.lit("swh:1:dir:"), F.sha1(F.concat(head, F.unhex(F.lit("00")), body)))


def directory_swhids(files: DataFrame) -> DataFrame:
    """(root, swhid) of the directories that hold files(root, path, content), path with / between names. Contents are hashed once; then the names and hashes of a root's files, which are short, are gathered and its directories named from the inside out, level by level, in expressions over that list."""
    entry = "struct<names: array<string>, swhid: string, folder: boolean>"
    one = F.struct(F.split("path", "/").alias("names"), blob_swhid(F.col("content")).alias("swhid"), F.lit(False).alias("folder")).cast(entry)
    rows = files.select("root", one.alias("e")).groupBy("root").agg(F.collect_list("e").alias("entries"))
    deepest = rows.agg(F.max(F.array_max(F.transform("entries", lambda e: F.size(e["names"]))))).first()[0] or 0
    for level in range(deepest, 1, -1):
        rows = _folded(rows, level, entry)
    return rows.select("root", tree_swhid(_entries(F.col("entries"))).alias("swhid"))


def _folded(rows: DataFrame, level: int, entry: str) -> DataFrame:
    """Replaces the entries with so many names by the folders that hold them."""
    above = lambda e: F.slice(e["names"], 1, level - 1)
    inside = lambda d: F.filter("_inner", lambda e: above(e) == d)
    folder = lambda d: F.struct(d.alias("names"), tree_swhid(_entries(inside(d))).alias("swhid"), F.lit(True).alias("folder")).cast(entry)
    rows = rows.withColumn("_inner", F.filter("entries", lambda e: F.size(e["names"]) == level)).withColumn("_folders", F.array_distinct(F.transform("_inner", above)))
    return rows.select("root", F.concat(F.filter("entries", lambda e: F.size(e["names"]) < level), F.transform("_folders", folder)).alias("entries"))


def _entries(entries: Column) -> Column:
    """Entries of a directory for tree_swhid."""
    return F.transform(entries, lambda e: F.struct(F.element_at(e["names"], -1).alias("name"), e["swhid"].alias("swhid"), e["folder"].alias("folder")))
