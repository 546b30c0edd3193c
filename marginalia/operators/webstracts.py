"""Web abstracts of articles, Commonmeta records, pages: projections of parsed articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import bibliography, csl
from marginalia.functions.values import escaped, orcid_19

#: The keys of a web abstract.
KEYS = (
    "abstract", "archive_date", "bare_tex", "body", "cc_license_type", "csljson", "contributors", "copyright", "date", "edition",
    "issues", "license_p", "license_ref", "references", "references_abridged", "source", "title",
)
#: Columns of parsed articles that web abstracts are made of.
PARSED = "valid title abstract body bare_tex copyright license_p license_ref cc_license_type authors refs issues"


def contributors(authors: Column) -> Column:
    """Authors as contributors: absent values are null, and left out of JSON."""
    filled = csl.filled
    return F.transform(
        authors,
        lambda a: F.struct(
            F.lit("author").alias("type"),
            filled(a["surname"]).alias("surname"),
            filled(a["given"]).alias("given-names"),
            filled(a["suffix"]).alias("suffix"),
            F.when(filled(a["email"]).isNotNull(), F.array(a["email"])).alias("email"),
            orcid_19(a["orcid"]).alias("orcid"),
        ),
    )


def issue_records(issues: Column) -> Column:
    return F.transform(issues, lambda i: F.struct(i["condition"].alias("condition"), i["sourceline"].alias("sourceline"), csl.filled(i["info"]).alias("info")))


def webstracts(parsed: DataFrame, html_refs: bool = True) -> DataFrame:
    """A row per valid article, with the keys of a web abstract that parsing gives; csljson is a JSON text. Other keys are null."""
    refs = F.col("refs")
    made = {
        "contributors": contributors(F.col("authors")),
        "csljson": csl.list_to_json(refs),
        "references": bibliography.html_section(refs) if html_refs else F.lit(None).cast("string"),
        "references_abridged": bibliography.html_section(refs, True) if html_refs else F.lit(None).cast("string"),
        "issues": issue_records(F.col("issues")),
        "archive_date": F.lit(None).cast("string"),
        "date": F.lit(None).cast("string"),
        "source": F.col("source") if "source" in parsed.columns else F.lit(None).cast("string"),
        "edition": F.lit(None).cast("struct<edid: string, base_dsi: string, newer_edid: string>"),
    }
    return parsed.where("valid").withColumns(made).select("article_id", *KEYS)


def to_json(rows: DataFrame) -> DataFrame:
    """(article_id, webstract): JSON objects with sorted keys; null ones are left out."""
    plain = [k for k in sorted(KEYS) if k != "csljson"]
    text = lambda keys: F.regexp_replace(F.to_json(F.struct(*keys)), r"(?s)^\{|\}$", "")
    parts = F.array(text([k for k in plain if k < "csljson"]), F.concat(F.lit('"csljson":'), F.col("csljson")), text([k for k in plain if k > "csljson"]))
    body = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ",")
    return rows.select("article_id", F.concat(F.lit("{"), body, F.lit("}")).alias("webstract"))


def with_editions(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """Adds edition and date of editions(article_id, base_dsi, edid, date). An edition that isn't its succession's latest names the latest; ids are compared number by number."""
    parts = F.transform(F.split("edid", r"\."), lambda x: x.cast("int"))
    latest = F.max_by("edid", parts).over(Window.partitionBy("base_dsi"))
    known = editions.withColumn("_latest", latest).select(
        F.col("article_id"),
        F.struct("edid", "base_dsi", F.when(F.col("_latest") != F.col("edid"), F.col("_latest")).alias("newer_edid")).alias("_edition"),
        F.col("date").cast("string").alias("_date"),
    )
    return rows.join(known, "article_id", "left").withColumns({"edition": F.coalesce("_edition", "edition"), "date": F.coalesce("_date", "date")}).drop("_edition", "_date")


def with_source(rows: DataFrame, swhids: DataFrame) -> DataFrame:
    """Adds the identifier of each article's folder, of swhids(root, swhid), as `source`."""
    named = swhids.select(F.col("root").alias("article_id"), F.col("swhid").alias("source"))
    return rows.drop("source").join(named, "article_id", "left")


def missing(editions: DataFrame, stored: DataFrame) -> DataFrame:
    """Editions that no stored web abstract covers yet: what an incremental run works on."""
    return editions.join(stored.select("article_id"), "article_id", "left_anti")


def facade(rows: DataFrame, size: int = 1) -> DataFrame:
    """Computed columns of web abstracts. Authors without a given name or a surname keep the other."""
    edition = F.col("edition")
    numbers = F.split(edition["edid"], r"\.")
    return rows.select(
        "article_id",
        F.transform("contributors", lambda c: F.concat_ws(" ", c["given-names"], c["surname"])).alias("author_names"),
        F.substring("source", 1, 10).alias("hash_scheme"),
        F.substring("source", 11, 1 << 30).alias("hexhash"),
        F.coalesce(edition["newer_edid"].isNotNull(), F.lit(False)).alias("obsolete"),
        edition["base_dsi"].alias("base_dsi"),
        edition["edid"].alias("edid"),
        F.concat(edition["base_dsi"], F.lit("/"), edition["edid"]).alias("dsi"),
        F.array_join(F.slice(numbers, 1, size), ".").alias("edid_trunc"),
        F.array_join(F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(0))), ".").alias("seq_edid"),
        F.coalesce(edition["newer_edid"], edition["edid"]).alias("latest_edid"),
        F.year(F.to_date("date")).cast("string").alias("year"),
    )


def commonmeta(parsed: DataFrame, source: Column | None = None) -> DataFrame:
    """(article_id, commonmeta): records in Commonmeta's JSON. source: the identifier of the article's files."""
    person = lambda a: F.struct(
        F.lit("Person").alias("type"),
        F.array(F.lit("Author")).alias("contributorRoles"),
        csl.filled(a["surname"]).alias("familyName"),
        csl.filled(a["given"]).alias("givenName"),
        F.concat(F.lit("https://orcid.org/"), a["orcid"]).alias("id"),
    )
    record = F.struct(
        (F.lit(None).cast("string") if source is None else source).alias("id"),
        F.struct("title").alias("titles"),
        F.array(F.struct(F.col("abstract").alias("description"), F.lit("Abstract").alias("type"))).alias("descriptions"),
        F.transform("authors", person).alias("contributors"),
        F.when(F.col("license_p").isNotNull(), F.struct(F.col("cc_license_type").alias("id"), F.col("license_ref").alias("url"))).alias("license"),
    )
    return parsed.where("valid").select("article_id", F.to_json(record).alias("commonmeta"))


def has_issues(issues: Column) -> Column:
    """Whether anything in an article didn't fit."""
    return F.coalesce(F.size(issues) > 0, F.lit(False))


def page(rows: DataFrame, dsi_domain: str | None = None, banner: str | None = None, link_issues: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(article_id, html): a plain page of a web abstract. keep: further columns of the rows that stay.

    With a domain, an edition has its address at the top and how to cite it; without an edition the banner stands there.
    Then title, authors, edition and dates (and a notice, if a newer edition exists), abstract, body, references, copyright
    and licence, and the identifier of the files, as a link if they are archived. link_issues: a link to the page of
    issues, if there are any.
    """
    some = lambda c, before, after: F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    nothing = F.lit(None).cast("string")
    named = lambda *keys: F.transform("contributors", lambda c: escaped(F.concat_ws(" ", *(c[k] for k in keys))))
    title = F.coalesce(csl.filled(F.trim(F.regexp_replace("title", "<[^>]*>", ""))), F.lit("No Title"))
    edition, source = F.col("edition"), F.col("source")
    dsi = F.concat(edition["base_dsi"], F.lit("/"), edition["edid"])
    address = nothing if dsi_domain is None else F.concat(F.lit(f"https://{dsi_domain}/"), escaped(dsi, True))
    link = lambda url, text: F.concat(F.lit('<a href="'), url, F.lit('">'), text, F.lit("</a>"))
    newer = edition["newer_edid"]
    newest = newer if dsi_domain is None else link(F.concat(F.lit(f"https://{dsi_domain}/"), escaped(F.concat(edition["base_dsi"], F.lit("/"), newer), True)), newer)
    year = F.coalesce(F.year(F.to_date("date")).cast("string"), F.lit("20??"))
    cited = F.concat(F.array_join(named("given-names", "surname"), ", "), F.lit(" ("), year, F.lit(") “"), title, F.lit("” "), link(address, address))
    archived = F.when(F.col("archive_date").isNotNull(), link(F.concat(F.lit("https://archive.softwareheritage.org/"), source), source)).otherwise(source)
    top = F.coalesce(link(address, dsi), F.lit(None if banner is None else banner).cast("string"))
    issues = F.when(F.lit(link_issues) & has_issues(F.col("issues")), F.lit('<p class="issues"><a href="issues/">What did not fit</a></p>\n'))
    parts = [
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n'),
        some(title, "<title>", "</title>\n"),
        F.lit("</head>\n<body>\n"),
        some(top, "<header>", "</header>\n"),
        F.lit("<article>\n"),
        F.concat(F.lit("<h1>"), F.coalesce(csl.filled(F.trim("title")), F.lit("No Title")), F.lit("</h1>\n")),
        some(csl.filled(F.array_join(named("given-names", "surname", "suffix"), ", ")), '<p class="authors">', "</p>\n"),
        some(edition["edid"], '<p class="edition">Edition ', "</p>\n"),
        some(newest, '<p class="obsolete" role="alert">There is a newer edition: ', "</p>\n"),
        some(F.col("date"), '<p class="date">', "</p>\n"),
        some(F.col("archive_date"), '<p class="archived">Archived ', "</p>\n"),
        F.coalesce(issues, F.lit("")),
        some(F.col("abstract"), '<section class="abstract">\n<h2>Abstract</h2>\n', "</section>\n"),
        F.coalesce("body", F.lit("")),
        some(F.col("references"), "", ""),
        some(F.when(dsi.isNotNull(), cited), '<p class="citation">', "</p>\n"),
        some(F.col("copyright"), '<p class="copyright">', "</p>\n"),
        some(F.col("license_p"), '<p class="license">', "</p>\n"),
        some(archived, '<p class="source">', "</p>\n"),
        F.lit("</article>\n</body>\n</html>\n"),
    ]
    return rows.select("article_id", F.concat(*parts).alias("html"), *keep)


def write_files(rows: DataFrame, path: str, text_col: str) -> None:
    """Writes one row's text per line of JSON, with its article_id: the sink for XML, HTML and web abstracts of a corpus."""
    rows.select("article_id", text_col).write.json(path)


def write_articles(rows: DataFrame, path: str, xml_col: str = "xml", name: str = "article.xml") -> None:
    """Writes each article's XML as path/article_id/article.xml, byte for byte, for tools that read single files. Each task writes its own rows through pyarrow's file systems (path is an URI that all machines understand), so the number of articles doesn't matter to Spark's committer; a file is written under another name and then renamed, so a task that is run again does no harm. Ids are names of folders: without `/`, not empty."""
    if rows.where("article_id IS NULL OR article_id = '' OR contains(article_id, '/') OR article_id IN ('.', '..')").limit(1).count():
        raise ValueError("ids of articles must be names of folders")

    def run(batches):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for i, xml in zip(batch.column("article_id").to_pylist(), batch.column(xml_col).to_pylist(), strict=True):
                if xml is not None:
                    store.create_dir(f"{base}/{i}", recursive=True)
                    made = f"{base}/{i}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(made) as out:
                        out.write(xml.encode())
                    store.move(made, f"{base}/{i}/{name}")
            yield batch.slice(0, 0)

    rows.select("article_id", xml_col).mapInArrow(run, rows.select("article_id", xml_col).schema).write.format("noop").mode("overwrite").save()
