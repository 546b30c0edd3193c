"""References to and from CSL-JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.values import edition, pages

#: Plain fields of a reference and their CSL variables.
CSL_KEYS = (
    ("comment", "note"), ("isbn", "ISBN"), ("issn", "ISSN"), ("issue", "issue"), ("publisher-loc", "publisher-place"),
    ("publisher-name", "publisher"), ("uri", "URL"), ("volume", "volume"),
)

_NAME = "struct<family: string, given: string, literal: string>"
_DATES = "struct<`date-parts`: array<array<int>>>"
#: What of a CSL item is read; other keys are ignored.
ITEM = (
    "struct<id: string, title: string, `container-title`: string, volume: string, issue: string, page: string, publisher: string,"
    " `publisher-place`: string, edition: string, ISBN: string, ISSN: string, URL: string, DOI: string, PMID: string, note: string,"
    f" author: array<{_NAME}>, editor: array<{_NAME}>, issued: {_DATES}, accessed: {_DATES}>"
)


def filled(text: Column) -> Column:
    """The text, null if it is empty."""
    return F.when(text != "", text)


def _names(group: Column) -> Column:
    """CSL names of a group; null for an empty one. Suffixes are lost."""
    each = F.transform(
        group["persons"],
        lambda p: F.struct(
            F.when(p["literal"].isNull(), filled(p["surname"])).alias("family"),
            F.when(p["literal"].isNull(), filled(p["given"])).alias("given"),
            p["literal"].alias("literal"),
        ),
    )
    others = F.array(F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), F.lit("others").alias("literal")))
    both = F.concat(each, F.when(group["etal"], others).otherwise(F.slice(others, 1, 0)))
    return F.when(F.size(both) > 0, both)


def _date_parts(date: Column) -> Column:
    """[[year, month, day]], shorter for partial dates; the struct is null without a year."""
    none = F.lit(None).cast("int")
    month = F.when(date["month"] != 0, date["month"])
    day = F.when(month.isNotNull() & (date["day"] != 0), date["day"])
    parts = F.filter(F.array(date["year"], F.coalesce(month, none), F.coalesce(day, none)), lambda x: x.isNotNull())
    return F.when(date["year"].isNotNull(), F.struct(F.array(parts).alias("date-parts")))


def container_is_null(ref: Column) -> Column:
    """Whether there is a title of an article, but none of a source: CSL then has a container that is null, not absent."""
    return F.coalesce(filled(ref["article_title"]).isNotNull() & filled(ref["source_title"]).isNull(), F.lit(False))


def item(ref: Column) -> Column:
    """A CSL item of a reference, as a struct; absent keys are null."""
    article, source = filled(ref["article_title"]), filled(ref["source_title"])
    fields, ids = ref["fields"], ref["pub_ids"]
    plain = [fields[key].alias(csl) for key, csl in CSL_KEYS]
    return F.struct(
        F.lit("").alias("type"),
        ref["id"].alias("id"),
        F.coalesce(article, source).alias("title"),
        F.when(article.isNotNull(), source).alias("container-title"),
        *plain,
        pages(fields["fpage"], fields["lpage"]).alias("page"),
        ref["edition"].cast("string").alias("edition"),
        ids["doi"].alias("DOI"),
        ids["pmid"].alias("PMID"),
        _names(ref["authors"]).alias("author"),
        _names(ref["editors"]).alias("editor"),
        _date_parts(ref["date"]).alias("issued"),
        _date_parts(ref["access_date"]).alias("accessed"),
    )


def to_json(ref: Column) -> Column:
    """The CSL-JSON object of a reference."""
    text = F.to_json(item(ref))
    return F.when(container_is_null(ref), F.concat(F.lit('{"container-title":null,'), F.substring(text, 2, 1 << 30))).otherwise(text)


def list_to_json(refs: Column) -> Column:
    """The CSL-JSON array of references; null without a list."""
    return F.concat(F.lit("["), F.array_join(F.transform(refs, to_json), ","), F.lit("]"))


def _group(names: Column) -> Column:
    """Persons of CSL names; the literal `others` stands for et al."""
    people = F.transform(
        F.filter(names, lambda n: ~n["literal"].eqNullSafe(F.lit("others"))),
        lambda n: F.struct(
            F.when(n["literal"].isNull(), n["family"]).alias("surname"),
            F.when(n["literal"].isNull(), n["given"]).alias("given"),
            F.lit(None).cast("string").alias("suffix"),
            n["literal"].alias("literal"),
        ),
    )
    etal = F.exists(names, lambda n: n["literal"].eqNullSafe(F.lit("others")))
    return F.when(names.isNotNull(), F.struct(people.alias("persons"), etal.alias("etal")))


def _date(dates: Column) -> Column:
    parts = F.get(dates["date-parts"], F.lit(0))
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(part(0).isNotNull(), F.struct(part(0).alias("year"), part(1).alias("month"), F.when(part(1).isNotNull(), part(2)).alias("day")))


def reference(csl: Column, has_container: Column) -> Column:
    """A reference of a CSL item (a struct ITEM). has_container: whether the item has the key container-title, even with null."""
    container = csl["container-title"]
    split = F.split(csl["page"], "-", -1)
    entries = [F.struct(F.lit(key).alias("key"), csl[name].alias("value")) for key, name in CSL_KEYS]
    entries += [F.struct(F.lit("fpage").alias("key"), F.get(split, F.lit(0)).alias("value")), F.struct(F.lit("lpage").alias("key"), F.get(split, F.lit(1)).alias("value"))]
    ids = [F.struct(F.lit(key).alias("key"), csl[name].alias("value")) for key, name in (("doi", "DOI"), ("pmid", "PMID"))]
    some = lambda pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))
    return F.struct(
        F.coalesce(csl["id"], F.lit("")).alias("id"),
        _group(csl["author"]).alias("authors"),
        _group(csl["editor"]).alias("editors"),
        F.when(has_container, csl["title"]).alias("article_title"),
        F.when(has_container, container).otherwise(csl["title"]).alias("source_title"),
        edition(csl["edition"]).alias("edition"),
        _date(csl["issued"]).alias("date"),
        _date(csl["accessed"]).alias("access_date"),
        some(entries).alias("fields"),
        some(ids).alias("pub_ids"),
    )


def list_from_json(text: Column) -> Column:
    """References of a CSL-JSON array; null for anything else. Members that aren't objects are skipped."""
    raw = F.from_json(text, "array<string>")
    objects = F.filter(raw, lambda x: F.startswith(F.ltrim(x), F.lit("{")))
    return F.when(
        F.startswith(F.ltrim(text), F.lit("[")),
        F.transform(objects, lambda x: reference(F.from_json(x, ITEM), F.array_contains(F.json_object_keys(x), "container-title"))),
    )
