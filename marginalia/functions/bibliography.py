"""Formatted references in two styles, as column expressions over a reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.csl import filled
from marginalia.functions.values import escaped, pages

#: Short names of months.
MONTHS = ("Jan.", "Feb.", "Mar.", "Apr.", "May", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec.")
#: The short style names six authors if there are seven or more.
MOST_NAMES, SHOWN_NAMES = 7, 6


def _joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't null; null if none is left."""
    return filled(F.concat_ws(separator, *parts))


def _with(prefix: str, part: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), part, F.lit(suffix))


def _ordinal(number: Column) -> Column:
    last = F.abs(number) % 10
    teen = (F.abs(number) % 100).between(11, 13)
    return F.concat(number.cast("string"), F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def _edition(ref: Column) -> Column:
    return _with("", _ordinal(ref["edition"]), " ed.")


def _month(date: Column) -> Column:
    return F.when(date["month"].between(1, 12), F.get(F.array(*map(F.lit, MONTHS)), date["month"] - 1))


def _pages(ref: Column) -> Column:
    """`pp.` before a range, whose hyphen becomes a dash; `p.` before one page."""
    text = escaped(pages(ref["fields"]["fpage"], ref["fields"]["lpage"]))
    return F.concat(F.when(F.contains(text, F.lit("-")), "pp. ").otherwise("p. "), F.replace(text, F.lit("-"), F.lit("–")))


def _link(target: Column) -> Column:
    return F.concat(F.lit('<a href="'), escaped(target, True), F.lit('">'), escaped(target), F.lit("</a>"))


def _doi(ref: Column) -> Column:
    return _link(_with("https://doi.org/", ref["pub_ids"]["doi"]))


def _uri(ref: Column) -> Column:
    return _link(filled(ref["fields"]["uri"]))


def _value(ref: Column, key: str) -> Column:
    return escaped(filled(ref["fields"][key]))


def _publisher(ref: Column) -> Column:
    return _joined(": ", _value(ref, "publisher-loc"), _value(ref, "publisher-name"))


def _titles(ref: Column) -> tuple[Column, Column]:
    """Title and container: a source without an article is the title."""
    article, source = escaped(filled(ref["article_title"])), escaped(filled(ref["source_title"]))
    return F.coalesce(article, source), F.when(article.isNotNull(), source)


def _people(group: Column) -> Column:
    """(family, given, literal) of the persons, et al. as the literal `others`."""
    each = F.transform(group["persons"], lambda p: F.struct(escaped(filled(p["surname"])).alias("family"), escaped(filled(p["given"])).alias("given"), escaped(p["literal"]).alias("literal")))
    none = F.lit(None).cast("string")
    others = F.array(F.struct(none.alias("family"), none.alias("given"), F.lit("others").alias("literal")))
    return F.coalesce(F.concat(each, F.when(group["etal"], others).otherwise(F.slice(others, 1, 0))), F.slice(others, 1, 0))


def _full_names(ref: Column) -> Column:
    """The first name is turned; the last one has `and` before it."""
    people = _people(ref["authors"])
    turned = lambda p: F.coalesce(p["literal"], _joined(", ", p["family"], p["given"]))
    straight = lambda p: F.coalesce(p["literal"], _joined(" ", p["given"], p["family"]))
    said = F.transform(people, lambda p, i: F.when(i == 0, turned(p)).otherwise(F.concat(F.when(i == F.size(people) - 1, "and ").otherwise(""), straight(p))))
    return filled(F.array_join(said, ",\n"))


def _initials(given: Column) -> Column:
    """First letters of the parts of a given name, joined."""
    words = F.filter(F.split(given, r"[\s.\-]+", -1), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _short_names(ref: Column) -> Column:
    people = _people(ref["authors"])
    said = F.transform(people, lambda p: F.coalesce(p["literal"], _joined(" ", p["family"], filled(_initials(p["given"])))))
    most = F.concat(F.slice(said, 1, SHOWN_NAMES), F.array(F.lit("et al")))
    return filled(F.array_join(F.when(F.size(said) >= MOST_NAMES, most).otherwise(said), ",\n"))


def _polished(text: Column) -> Column:
    """No double periods at line ends; `others` is et al."""
    for old, new in (("..\n", ".\n"), ("others.\n", "et al.\n"), ("and et al.\n", "et al.\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def full(ref: Column) -> Column:
    """The full style: `Surname, Given,\\nand Given Surname.\\n“Title”.\\n<i>Source</i>,\\n3rd ed.,\\n...`."""
    title, container = _titles(ref)
    date, seen = ref["date"], ref["access_date"]
    day = lambda d: _joined(" ", F.when(_month(d).isNotNull(), d["day"].cast("string")), _month(d), d["year"].cast("string"))
    rest = _joined(
        ",\n",
        _with("<i>", container, "</i>"),
        _edition(ref),
        _with("vol. ", _value(ref, "volume")),
        _with("no. ", _value(ref, "issue")),
        _publisher(ref),
        day(date),
        _pages(ref),
        day(seen),
        _doi(ref),
        _uri(ref),
    )
    shown = F.when(container.isNotNull(), _with("“", title, "”")).otherwise(_with("<i>", title, "</i>"))
    return _polished(F.concat(F.concat_ws(".\n", _full_names(ref), shown, rest), F.lit(".")))


def abridged(ref: Column) -> Column:
    """The short style: `Surname IN,\\n... .\\nTitle.\\nSource.\\n2019;15(6):e1`."""
    title, container = _titles(ref)
    day = lambda d: _joined(" ", d["year"].cast("string"), F.replace(_month(d), F.lit("."), F.lit("")), F.when(_month(d).isNotNull(), d["day"].cast("string")))
    line = lambda part, end=".\n": F.coalesce(_with("", part, end), F.lit(""))
    volume, issue = _value(ref, "volume"), _value(ref, "issue")
    page = F.replace(escaped(pages(ref["fields"]["fpage"], ref["fields"]["lpage"])), F.lit("-"), F.lit("–"))
    cited = F.when(filled(ref["fields"]["uri"]).isNotNull(), _with("[cited ", day(ref["access_date"]), "]"))
    is_journal = ref["edition"].isNull() & _publisher(ref).isNull() & day(ref["date"]).isNotNull() & volume.isNotNull() & page.isNotNull()
    journal = line(F.concat(day(ref["date"]), F.lit(";"), volume, F.coalesce(_with("(", issue, ")"), F.lit("")), F.lit(":"), page))
    other = F.concat(line(_with("Vol. ", volume)), line(_with("No. ", issue)), line(_publisher(ref), ";\n"), line(_joined(" ", day(ref["date"]), cited)), line(_pages(ref)))
    head = line(_joined(".\n", _short_names(ref), title, container, _edition(ref)))
    return _polished(F.concat(head, F.when(is_journal, journal).otherwise(other), line(_joined(".\n", _doi(ref), _uri(ref)))))


def html_list(refs: Column, short: bool = False) -> Column:
    """An ordered list of formatted references; the full style has comments too."""
    style = abridged if short else full
    comment = lambda r: F.lit("") if short else F.coalesce(_with("<div>", escaped(filled(r["fields"]["comment"])), "</div>\n"), F.lit(""))
    row = lambda r: F.concat(F.lit('<li id="'), escaped(r["id"], True), F.lit('">\n<div>\n'), style(r), F.lit("\n</div>\n"), comment(r), F.lit("</li>\n"))
    return F.concat(F.lit("<ol>\n"), F.array_join(F.transform(refs, row), ""), F.lit("</ol>"))


def html_section(refs: Column, short: bool = False) -> Column:
    """The list under its heading."""
    return F.concat(F.lit("<h2>References</h2>\n"), html_list(refs, short), F.lit("\n"))
