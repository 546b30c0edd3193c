"""Articles of the normal form as JATS: tags are renamed by their place, and what a journal's article must have is added."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.render import XmlWriter, escape
from marginalia.functions.tree import XLINK_HREF, Node, read

#: Tags and their JATS names.
JATS_TAGS = {
    "article-body": "body", "source-title": "source", "b": "bold", "blockquote": "disp-quote", "br": "break", "i": "italic",
    "pre": "preformat", "tt": "monospace", "section": "sec", "li": "list-item", "ol": "list", "ul": "list", "dd": "def", "dl": "def-list",
    "dt": "term", "license-ref": "{http://www.niso.org/schemas/ali/1.0/}license_ref",
} | {f"h{i}": "title" for i in range(1, 7)}
#: Children that get a paragraph around them.
WRAPPED = {"dd": frozenset(["code", "dl", "blockquote", "ol", "ul", "pre"]), "li": frozenset(["code", "blockquote", "pre"])}
#: Fixed value: the document type of the target.
DOCTYPE = '<!DOCTYPE article PUBLIC "-//NLM//DTD JATS (Z39.96) Journal Archiving and Interchange DTD with MathML3 v1.3 20210610//EN" "JATS-archivearticle1-3-mathml3.dtd">'

#: Made-up metadata of a journal.
JOURNAL = (
    '<journal-meta><journal-id journal-id-type="archive">JJXT</journal-id><journal-title-group><journal-title>Journal of JATS XML Testing</journal-title>'
    '</journal-title-group><issn pub-type="epub">0000-0000</issn><publisher><publisher-name>Random Madhouse</publisher-name></publisher></journal-meta>'
)
SUBJECT = '<article-categories><subj-group subj-group-type="heading"><subject>JATS</subject></subj-group></article-categories>'
PUBLISHED = '<pub-date pub-type="pub"><year>1700</year></pub-date>'
LOCATION = "<elocation-id>0</elocation-id>"


class JatsWriter(XmlWriter):
    def content_of(self, node: Node) -> str:
        return escape(node.text) + "".join(self.node(c) + escape(c.tail) for c in node)

    def node(self, node: Node) -> str:
        up = node.parent
        above = up.tag if up is not None else None
        if above == "article" and up.parent is None and node.tag == "front":
            start = "" if node.child("journal-meta") else JOURNAL
            return self.tag("front", self.named(node.attrs), start + self.content_of(node))
        if node.tag == "article-meta" and above == "front":
            return self.tag("article-meta", self.named(node.attrs), self.meta(node))
        tag, attrs = self.renamed(node, above)
        made = self.tag(self.name(tag), self.named(attrs), self.content_of(node) or None)
        return f"<p>{made}</p>" if node.tag in WRAPPED.get(above, ()) else made

    def named(self, attrs: dict[str, str]) -> dict[str, str]:
        return {self.name(k): v for k, v in attrs.items()}

    def meta(self, node: Node) -> str:
        lead = ("title-group", "contrib-group")
        some = lambda tag, text: "" if node.child(tag) else text
        first = "".join(self.node(c) for c in node if c.tag in lead)
        rest = "".join(self.node(c) for c in node if c.tag not in lead)
        return some("article-categories", SUBJECT) + first + some("pub-date", PUBLISHED) + some("elocation-id", LOCATION) + rest

    @staticmethod
    def renamed(node: Node, above: str | None) -> tuple[str, dict[str, str]]:
        tag, attrs = node.tag, node.attrs
        if tag == "a" and attrs.get("rel") == "external":
            return "ext-link", {"ext-link-type": "uri", XLINK_HREF: attrs.get("href", "")}
        if tag == "a":
            return "xref", {"rid": attrs.get("href", "")[1:]}
        if tag == "div" and above == "dl":
            return "def-item", {}
        if tag == "license-ref":
            return JATS_TAGS[tag], attrs
        if tag not in JATS_TAGS:
            return tag, attrs
        kind = {"ol": {"list-type": "order"}, "ul": {} if above == "dd" else {"list-type": "bullet"}}
        return JATS_TAGS[tag], kind.get(tag, {k: v for k, v in attrs.items() if tag == "section" and k == "id"})


def convert(xml: str | None) -> str | None:
    """JATS of one article; null for what isn't one."""
    root = read((xml or "").encode()).root
    if root is None or root.tag != "article":
        return None
    writer = JatsWriter()
    writer.namespaces.add("http://www.w3.org/1999/xlink")
    writer.name("{http://www.niso.org/schemas/ali/1.0/}x")
    body = f'<article xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:ali="http://www.niso.org/schemas/ali/1.0/" xmlns:mml="http://www.w3.org/1998/Math/MathML" article-type="other">{writer.content_of(root)}</article>'
    return f'<?xml version="1.0"?>\n{DOCTYPE}\n{body}\n'


def to_jats(rows: DataFrame, id_col: str = "article_id", xml_col: str = "xml") -> DataFrame:
    """(article_id, jats) of articles in the normal form, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), pa.array([convert(x) for x in batch.column("xml").to_pylist()], pa.string())], ["article_id", "jats"])

    return rows.select(F.col(id_col).alias("article_id"), F.col(xml_col).alias("xml")).mapInArrow(run, "article_id string, jats string")
