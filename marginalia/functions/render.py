"""Writes trees of the normal form as XML and as HTML."""

from __future__ import annotations

import re

from marginalia.functions.model import Article, Section
from marginalia.functions.tree import PREFIXES, Out

#: Tags of the normal form and what they are in HTML.
HTML_TAGS = {
    "b": "strong", "br": "br", "code": "code", "dd": "dd", "blockquote": "blockquote", "div": "div", "dl": "dl", "dt": "dt",
    "hr": "hr", "i": "em", "li": "li", "tt": "samp", "ol": "ol", "p": "p", "pre": "pre", "sub": "sub", "sup": "sup",
    "tbody": "tbody", "thead": "thead", "tr": "tr", "ul": "ul", "wbr": "wbr",
}


def escape(text: str) -> str:
    if "&" in text or "<" in text or ">" in text:
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text


class XmlWriter:
    """Elements as XML in ASCII; characters beyond it as references."""

    def __init__(self) -> None:
        self.namespaces: set[str] = set()

    def name(self, name: str) -> str:
        if not name.startswith("{"):
            return name
        uri, local = name[1:].split("}")
        if uri != "http://www.w3.org/XML/1998/namespace":
            self.namespaces.add(uri)
        return f"{PREFIXES.get(uri) or 'ns' + str(sorted(self.namespaces).index(uri))}:{local}"

    def open(self, out: Out) -> tuple[str, dict[str, str]] | str:
        """Tag and attributes, or the whole element."""
        return self.name(out.tag), {self.name(k): v for k, v in out.attrs.items()} if out.attrs else out.attrs

    def attribute(self, value: str) -> str:
        if value.isalnum():
            return value
        return escape(value).replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;")

    def tag(self, name: str, attrs: dict[str, str], content: str | None) -> str:
        start = name + "".join([f' {k}="{self.attribute(v)}"' for k, v in attrs.items()]) if attrs else name
        return f"<{start} />" if content is None else f"<{start}>{content}</{name}>"

    def element(self, out: Out, level: int = 0) -> str:
        opened = self.open(out)
        return opened if isinstance(opened, str) else self.tag(*opened, self.content(out, level))

    def content(self, out: Out, level: int) -> str | None:
        if out.kind == "mixed":
            return self.mixed(out, level)
        if out.kind == "void":
            return None
        if out.kind == "space":
            return " "
        if out.kind == "cites":
            return ",".join(self.element(i, level) for i in out.items)
        if (block := out.lone_block) is not None:
            return self.mixed(block, level)
        if not out.items:
            return " " if out.kind == "biform" else "\n" + "  " * level
        line = "\n" + "  " * (level + 1)
        return line + line.join(self.element(i, level + 1) for i in out.items) + "\n" + "  " * level

    def mixed(self, out: Out, level: int) -> str:
        """Text as it is; an element without anything gets a space, so that it isn't self-closed."""
        if len(out.items) == 1 and isinstance(out.items[0], str):
            return escape(out.items[0]) or " "
        return "".join(escape(i) if isinstance(i, str) else self.element(i, level + (i.kind != "mixed")) for i in out.items) or " "

    def document(self, root: Out) -> str:
        body = self.element(root)
        declared = "".join(f' xmlns:{p}="{uri}"' for p, uri in sorted((PREFIXES.get(u) or f"ns{i}", u) for i, u in enumerate(sorted(self.namespaces))))
        body = re.sub(r"^<[^\s>/]+", lambda m: m[0] + declared, body)
        return body.encode("ascii", "xmlcharrefreplace").decode()


class HtmlWriter(XmlWriter):
    """Elements as HTML. bare_tex: whether a formula was written as TeX."""

    def __init__(self) -> None:
        super().__init__()
        self.bare_tex = False

    def attribute(self, value: str) -> str:
        return value.replace("&", "&amp;").replace(">", "&gt;").replace('"', "&quot;")

    def tag(self, name: str, attrs: dict[str, str], content: str | None) -> str:
        start = name + "".join([f' {k}="{self.attribute(v)}"' for k, v in attrs.items()]) if attrs else name
        return f"<{start}>" if content is None else f"<{start}>{content}</{name}>"

    def open(self, out: Out) -> tuple[str, dict[str, str]] | str:
        tag, attrs = out.tag, out.attrs
        if out.role in ("inline", "display"):
            self.bare_tex = True
            return self.tag("span", {"class": f"math {out.role}"}, escape(out.items[0].items[0].items[0]))
        if out.kind == "cites":
            return self.tag("span", {"class": "citation-tuple"}, " [" + ",".join(map(self.element, out.items)) + "]")
        if out.role == "cite":
            return "a", {"href": "#" + attrs["rid"]}
        if out.role == "reference":
            return "a", {"href": attrs.get("href", "#")}
        if out.role == "link":
            return "a", {"href": attrs["href"], "rel": "external"}
        if tag == "table-wrap":
            return "div", {"class": "table-wrap"}
        if tag == "table":
            return tag, dict(sorted(({"frame": "hsides", "rules": "groups"} | attrs).items()))
        if tag in ("col", "colgroup"):
            return tag, dict(sorted(attrs.items()))
        if tag in ("th", "td"):
            named = {"style" if k == "align" else k: f"text-align: {v};" if k == "align" else v for k, v in attrs.items()}
            return tag, dict(sorted(named.items()))
        if tag in HTML_TAGS:
            return HTML_TAGS[tag], {}
        return "span", {"class": f"unknown-xml xml-{tag}"}

    def blocks(self, blocks: list[Out]) -> str:
        return "".join(self.element(b) + "\n" for b in blocks)

    def inner(self, out: Out | None) -> str:
        """The content of a mixed element."""
        return "" if out is None else "".join(escape(i) if isinstance(i, str) else self.element(i) for i in out.items)

    def section(self, section: Section, level: int = 0) -> str:
        level = min(level + 1, 6)
        head = ""
        if section.title is not None:
            head = self.tag(f"h{level}", {} if section.id is None else {"id": section.id}, self.mixed(section.title, level)) + "\n"
        return head + self.blocks(section.blocks) + "".join(f"<section>\n{self.section(s, level)}</section>\n" for s in section.sections)


def _text(tag: str, text: str, **attrs: str) -> Out:
    return Out(tag, attrs={k.replace("_", "-"): v for k, v in attrs.items()}, items=[text] if text else [])


def _name(person: dict) -> Out:
    keys = (("surname", "surname"), ("given", "given-names"), ("suffix", "suffix"))
    return Out("name", "array", items=[_text(tag, person[k]) for k, tag in keys if person[k]])


def _section(tag: str, section: Section, level: int = 0) -> Out:
    level = min(level + 1, 6)
    out = Out(tag, "array", {} if section.id is None else {"id": section.id})
    if section.title is not None:
        out.items.append(Out(f"h{level}", items=section.title.items))
    out.items += section.blocks + [_section("section", s, level) for s in section.sections]
    return out


def _date(date: dict | None) -> list[Out]:
    if date is None:
        return []
    padded = [_text(k, f"{date[k]:02}") for k in ("month", "day") if date[k] is not None]
    return [_text("year", str(date["year"])), *padded]


def _persons(kind: str, group: dict | None) -> list[Out]:
    if not group or not group["persons"] and not group["etal"]:
        return []
    people = [_text("string-name", p["literal"]) if p["literal"] is not None else _name(p) for p in group["persons"]]
    return [Out("person-group", "array", {"person-group-type": kind}, people + [Out("etal", "space")] * group["etal"])]


def reference(ref: dict) -> Out:
    """A reference as an element."""
    parts = _persons("author", ref["authors"]) + _persons("editor", ref["editors"])
    parts += [_text(tag, ref[k]) for k, tag in (("article_title", "article-title"), ("source_title", "source-title")) if ref[k]]
    parts += [_text("edition", str(ref["edition"]))] if ref["edition"] is not None else []
    parts += _date(ref["date"])
    parts += [Out("date-in-citation", "array", {"content-type": "access-date"}, _date(ref["access_date"]))] if ref["access_date"] else []
    parts += [_text(k, v) for k, v in ref["fields"].items()]
    parts += [_text("pub-id", v, pub_id_type=k) for k, v in ref["pub_ids"].items()]
    return Out("ref", "array", {"id": ref["id"]}, [Out("element-citation", "array", items=parts)])


def _author(author: dict) -> Out:
    from marginalia.functions.values import orcid_of

    parts = []
    if author["orcid"] and orcid_of(author["orcid"]):
        code = author["orcid"]
        parts.append(_text("contrib-id", "https://orcid.org/" + "-".join(code[i : i + 4] for i in range(0, 16, 4)), contrib_id_type="orcid"))
    parts.append(_name(author))
    parts += [_text("email", author["email"])] if author["email"] else []
    return Out("contrib", "array", {"contrib-type": "author"}, parts)


def _license(article: Article) -> Out:
    parts = [article.copyright] if article.copyright is not None else []
    kind = article.license["cc_license_type"]
    url = _text("license-ref", article.license["license_ref"], **({"content_type": kind} if kind else {}))
    return Out("permissions", "array", items=[*parts, Out("license", "array", items=[url, article.license["license_p"]])])


def document(article: Article) -> Out:
    """The article as an element: front, body, back, each if there is something in it."""
    meta = []
    if article.title is not None:
        meta.append(Out("title-group", "array", items=[article.title]))
    if article.authors:
        meta.append(Out("contrib-group", "array", items=[_author(a) for a in article.authors]))
    if article.license is not None:
        meta.append(_license(article))
    if article.abstract is not None:
        meta.append(Out("abstract", "array", items=article.abstract))
    parts = [Out("front", "array", items=[Out("article-meta", "array", items=meta)])] if meta else []
    if article.body.blocks or article.body.sections:
        parts.append(_section("article-body", article.body))
    if article.refs is not None:
        parts.append(Out("back", "array", items=[Out("ref-list", "array", items=[reference(r) for r in article.refs])]))
    return Out("article", "array", items=parts)


def baseline_xml(article: Article) -> str:
    """The article's normalised XML, with a line end."""
    return XmlWriter().document(document(article)) + "\n"
