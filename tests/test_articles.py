"""Content models, normal form and HTML of single documents."""

import json

import pytest

from marginalia.functions import model, render, tree
from marginalia.operators.articles import convert

HEAD = '<article xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:mml="http://www.w3.org/1998/Math/MathML"><front><article-meta><title-group><article-title>T</article-title></title-group></article-meta></front>'


def article(body: str, refs: str = "") -> dict:
    back = f"<back><ref-list>{refs}</ref-list></back>" if refs else ""
    return convert(f"{HEAD}<body>{body}</body>{back}</article>".encode())


def conditions(row: dict) -> list[list[str]]:
    return [i["condition"] for i in row["issues"]]


def ref(rid: str) -> str:
    return f'<ref id="{rid}"><element-citation><source-title>{rid}</source-title></element-citation></ref>'


def numbers(row: dict) -> list[str]:
    return [r["id"] for r in row["refs"]]


@pytest.mark.parametrize(
    ("body", "html"),
    [
        ("<p>a <bold>b</bold> <italic>c</italic> <monospace>d</monospace></p>", "<p>a <strong>b</strong> <em>c</em> <samp>d</samp></p>\n"),
        ("<p>a<list><list-item><p>x</p></list-item></list>b</p>", "<p>a</p>\n<ul>\n  <li>\n    <p>x</p>\n  </li>\n</ul>\n<div>b</div>\n<p> </p>\n"),
        ("loose <bold>x</bold><p>y</p>", "<div>loose <strong>x</strong></div>\n<p>y</p>\n"),
        ('<sec id="s"><title>H</title><p>x</p></sec>', '<section>\n<h2 id="s">H</h2>\n<p>x</p>\n</section>\n'),
        ("<sec><p>x</p></sec>", "<section>\n<h2> </h2>\n<p>x</p>\n</section>\n"),
        ('<p><ext-link xlink:href="https://e.org">e</ext-link></p>', '<p><a href="https://e.org" rel="external">e</a></p>\n'),
        ('<p><ext-link xlink:href="ftp://e.org"><bold>e</bold></ext-link></p>', "<p><strong>e</strong></p>\n"),
        ('<p><xref rid="t1">Table</xref></p>', '<p><a href="#t1">Table</a></p>\n'),
        ("<p>x<break/>y</p>", "<p>x<br>y</p>\n"),
        ("<p>a &lt; b &amp; c</p>", "<p>a &lt; b &amp; c</p>\n"),
        ("<ul><li>one</li><li><p>two</p><p>three</p></li></ul>", "<ul>\n  <li>one</li>\n  <li>\n    <p>two</p>\n    <p>three</p>\n  </li>\n</ul>\n"),
        ("<p>  </p>", "<p> </p>\n"),
    ],
)
def test_html(body, html):
    assert article(body)["body"] == html


def test_blank_start_stays_open():
    """A blank paragraph isn't closed by a block: what follows goes on in it."""
    assert article("<p>  <ul><li>x</li></ul>tail</p>")["body"] == "<ul>\n  <li>x</li>\n</ul>\n<p>  tail</p>\n<p> </p>\n"


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<p><sc>x</sc></p>", ["UnsupportedElement", "sc", "p"]),
        ("<fig/>", ["UnsupportedElement", "fig", "body"]),
        ('<p id="x">y</p>', ["UnsupportedAttribute", "p", "id"]),
        ("<sec><p>x</p></sec>", ["MissingSectionHeading", "sec", "body"]),
        ("<sec><title>a</title><title>b</title></sec>", ["ExcessElement", "title", "sec"]),
        ("<p>a<p>b</p></p>", ["BlockElementInPhrasingContent", "p", "p"]),
        ('<p><a href="x">y</a></p>', ["UnsupportedAttributeValue", "a", "href", "x"]),
        ('<table><tr/></table>', ["UnsupportedElement", "tr", "table"]),
        ("<dl><div><dd>x</dd></div></dl>", ["MissingContent", "div", "dl"]),
        ('<table-wrap><table><tbody><tr><td align="top">x</td></tr></tbody></table></table-wrap>', ["UnsupportedAttributeValue", "td", "align", "top"]),
    ],
)
def test_conditions(body, expected):
    assert expected in conditions(article(body))


def test_document_conditions():
    assert conditions(convert(b"<article>")) == [["XMLSyntaxError"]]
    assert conditions(convert(b"")) == [["XMLSyntaxError"]]
    assert conditions(convert(b"<html/>")) == [["UnsupportedElement", "html"]]
    doctype = convert(b'<!DOCTYPE article><article xml:lang="de"/>')
    assert conditions(doctype) == [
        ["DoctypeDeclaration"],
        ["UnsupportedAttributeValue", "article", "{http://www.w3.org/XML/1998/namespace}lang", "de"],
        ["MissingChild", "front", "article"],
        ["MissingContent", "article-title", "title-group"],
        ["MissingContent", "article-body", "article"],
    ]
    latin = '<?xml version="1.0" encoding="iso-8859-1"?><article/>'.encode("latin-1")
    assert ["EncodingNotUtf8"] in conditions(convert(latin))


def test_issues_of_the_back_come_last():
    row = convert(f"{HEAD}<back><ack/></back></article>".encode())
    assert conditions(row) == [["MissingContent", "article-body", "article"], ["UnsupportedElement", "ack", "back"]]


def test_numbers_by_first_citation():
    cites = "".join(f'<xref rid="{r}" ref-type="bibr"/>' for r in "cac")
    row = article(f"<p>{cites}</p>", "".join(map(ref, "abcd")))
    assert numbers(row) == ["c", "a"]


def test_order_is_kept_while_it_fits():
    row = article('<p><xref rid="c">3</xref><xref rid="a">9</xref><xref rid="d">1</xref><xref rid="e">5</xref></p>', "".join(map(ref, "abcdef")))
    assert numbers(row) == ["a", "b", "c", "d", "e"]


def test_dangling_and_duplicate_references():
    row = article('<p><xref rid="x" ref-type="bibr">1</xref><xref rid="a">1</xref></p>', ref("a") + ref("a"))
    assert ["InvalidCitation", "xref", "p"] in conditions(row)
    assert numbers(row) == ["a"]


def test_ranges():
    row = article('<p><xref rid="d">4</xref><sup>[<xref rid="a">1</xref>–<xref rid="d">4</xref>]</sup></p>', "".join(map(ref, "abcd")))
    assert row["body"].count("<a ") == 5
    assert "InvalidCitation" not in str(conditions(row))
    bad = article('<p><sup><xref rid="b">2</xref>-<xref rid="a">7</xref></sup></p>', "".join(map(ref, "abc")))
    assert ["InvalidCitation", "xref", "sup"] in conditions(bad)


def test_bare_citation_becomes_a_superscript():
    row = article('<p><xref rid="a">1</xref></p>', ref("a"))
    assert '<sup><xref rid="a" ref-type="bibr">1</xref></sup>' in row["xml"]
    assert row["body"] == '<p><span class="citation-tuple"> [<a href="#a">1</a>]</span></p>\n'


def test_formula():
    row = article("<p><inline-formula><alternatives><tex-math>x^2</tex-math><mml:math><mml:mi>x</mml:mi><mml:foo/></mml:math></alternatives></inline-formula></p>")
    assert row["bare_tex"] and row["body"] == '<p><span class="math inline">x^2</span></p>\n'
    assert ["UnsupportedElement", "{http://www.w3.org/1998/Math/MathML}foo", "{http://www.w3.org/1998/Math/MathML}math"] in conditions(row)
    assert 'xmlns:mml="http://www.w3.org/1998/Math/MathML"' in row["xml"]


def test_table_defaults():
    row = article('<table><thead><tr><th align="left" colspan="2">h</th></tr></thead><tfoot><tr><td>f</td></tr></tfoot><tbody><tr><td/></tr></tbody></table>')
    assert '<table frame="hsides" rules="groups">' in row["body"]
    assert '<th colspan="2" style="text-align: left;">h</th>' in row["body"]
    assert '<span class="unknown-xml xml-tfoot">' in row["body"]
    assert row["xml"].index("<tbody>") < row["xml"].index("<tfoot>")


def test_reference_fields():
    fields = (
        '<person-group person-group-type="author"><name><surname>W</surname></name><string-name>Grp</string-name><etal/></person-group>'
        "<edition>4th ed</edition><year>2001</year><month>0</month><day>5</day><elocation-id>e7</elocation-id>"
        '<pub-id pub-id-type="doi">https://doi.org/10.1/x</pub-id><pub-id pub-id-type="pmid">abc</pub-id><pub-id pub-id-type="other">1</pub-id>'
    )
    row = article('<p><xref rid="a">1</xref></p>', f'<ref id="a"><label>1.</label><element-citation>{fields}</element-citation></ref>')
    got = row["refs"][0]
    assert got["edition"] == 4 and got["date"] == {"year": 2001, "month": None, "day": None}
    assert got["authors"]["etal"] and got["authors"]["persons"][1]["literal"] == "Grp"
    assert dict(got["pub_ids"]) == {"doi": "10.1/x"} and dict(got["fields"]) == {"fpage": "e7"}
    for kind in ("InvalidDoi", "InvalidPmid", "InvalidPubId"):
        assert [kind, "pub-id", "element-citation"] in conditions(row)


def test_authors_and_permissions():
    meta = (
        '<contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid">http://orcid.org/0000-0002-1825-0097</contrib-id><name><surname>W</surname></name></contrib>'
        '<contrib contrib-type="editor"/><contrib contrib-type="author"/></contrib-group>'
        '<permissions><copyright-statement>© <bold>W</bold></copyright-statement><license><license-ref content-type="ccbylicense">https://creativecommons.org/licenses/by-sa/4.0/</license-ref></license></permissions>'
    )
    row = convert(f"<article><front><article-meta><title-group><article-title>T</article-title></title-group>{meta}</article-meta></front><body><p>x</p></body></article>".encode())
    assert [a["orcid"] for a in row["authors"]] == ["0000000218250097"]
    assert row["cc_license_type"] == "ccbysalicense" and row["copyright"] == "© <strong>W</strong>"
    assert ["MissingContent", "contrib", "contrib-group"] in conditions(row)
    assert ["UnsupportedAttributeValue", "license-ref", "content-type", "ccbylicense"] in conditions(row)


def test_normal_form_is_a_fixpoint():
    body = "<p>a<list><list-item>x <bold>y</bold></list-item></list>b</p><sec><title>T</title><def-list><def-item><term>t</term><def><p>d</p></def></def-item></def-list></sec><disp-quote>q</disp-quote>é"
    once = article(body)["xml"]
    assert "&#233;" in once and once.endswith("\n")
    assert convert(once.encode())["xml"] == once


def test_deep_markup_does_not_fail():
    depth = 200
    assert article("<p>" + "<b>" * depth + "x" + "</b>" * depth + "</p>")["body"].count("<strong>") == depth


@pytest.mark.parametrize(("before", "after"), [("<b>", "</b>"), ("<ul><li>", "</li></ul>"), ("<sec><title>t</title>", "</sec>"), ("<blockquote>", "</blockquote>")])
def test_any_depth_gives_a_row(before, after):
    """What is nested too deeply to be read is an issue, never an error."""
    for depth in (300, 100_000):
        row = article(before * depth + "x" + after * depth)
        assert row["valid"] and "xml" in row or row["issues"][0]["condition"][0] == "Unreadable"
    assert article(before * 300 + "x" + after * 300)["valid"]


def test_only_wanted_values_are_made():
    content = b"<article><front/><body><p>x</p></body></article>"
    assert set(convert(content, frozenset(["issues"]))) == {"valid", "issues", "authors"}
    assert convert(content, frozenset(["xml"]))["xml"] == convert(content)["xml"]


def test_text_of_and_entities():
    root = tree.read(b"<a>x<!-- c --><b>y</b><?p i?>z&#233;</a>").root
    assert tree.text_of(root) == "xyzé"


def test_issue_records_are_plain():
    row = article("<p><sc>x</sc></p>")
    assert json.loads(json.dumps(row["issues"]))[0]["sourceline"] == 1


def test_writer_keeps_unknown_namespaces():
    out = tree.Out("{http://example.org/x}t", items=["a"])
    assert render.XmlWriter().document(out) == '<ns0:t xmlns:ns0="http://example.org/x">a</ns0:t>'


def test_empty_model():
    assert model.parse(tree.Source(error="e", error_line=3))[1][0].line == 3


def flat(node) -> tuple:
    return node.tag, dict(getattr(node, "attrs", None) or getattr(node, "attrib", {})), node.text, node.tail, [flat(c) for c in node]


@pytest.mark.parametrize(
    "content",
    [
        b"<a>x<!-- c -->y<b k='&lt;&#10;'/>z<?p i?>w<![CDATA[<q>]]></a>",
        b"<?xml version='1.0' encoding='UTF-8'?>\n<!DOCTYPE a [<!ENTITY e 'v<b>w</b>'>]>\r\n<a xmlns='u' xml:lang='en'>&e;<!-- <!DOCTYPE x> --></a>",
        b"<!DOCTYPE a SYSTEM 'x'><a>&unknown; x</a>",
        "<?xml version='1.0' encoding='latin-1'?><a>\xe9</a>".encode("latin-1"),
        "<?xml version='1.0' encoding='utf-16'?><a>\n<b/></a>".encode("utf-16"),
        b"<a>\n<b></a>",
        b"<?xml version='1.0' encoding='nope'?><a/>",
    ],
)
def test_scan_finds_what_read_finds(content):
    read, scan = tree.read(content), tree.scan(content)
    assert (read.doctype, read.encoding.lower(), read.error, read.error_line) == (scan.doctype, scan.encoding.lower(), scan.error, scan.error_line)
    assert read.root is None and scan.root is None or flat(read.root) == flat(scan.root)
    assert read.root is None or [n.line for n in read.root.walk()] == tree.lines(content)


def test_lines_and_parents_of_issues():
    row = convert(b"<article>\n<front/>\n<body>\n<fig/>\n</body><back>\n<x/></back>\n</article>")
    assert [(i["condition"], i["sourceline"]) for i in row["issues"]] == [
        (["MissingChild", "article-meta", "front", "article"], 2),
        (["UnsupportedElement", "fig", "body"], 4),
        (["MissingContent", "article-title", "title-group"], None),
        (["MissingContent", "article-body", "article"], None),
        (["UnsupportedElement", "x", "back"], 6),
    ]


def test_only_what_is_asked_for_is_walked(monkeypatch):
    """Licences need no body, the body no fields of references."""
    content = f'{HEAD}<body><p>see <xref rid="a">1</xref></p></body><back><ref-list>{ref("a")}</ref-list></back></article>'.encode()
    whole, walked = convert(content), []
    section, citation = model.Walk.section, model.CITATION
    monkeypatch.setattr(model.Walk, "section", lambda *a: walked.append("body") or section(*a))
    monkeypatch.setattr(model, "CITATION", model.Rules(other=lambda n: walked.append("field")))
    assert convert(content, frozenset(["title", "cc_license_type"]))["title"] == whole["title"] and walked == []
    assert convert(content, frozenset(["body"]))["body"] == whole["body"] and walked == ["body"]


def test_cited_ids_are_those_of_the_references():
    cite = lambda rid: f'<xref rid="{rid}" ref-type="bibr"/>'
    head = HEAD.replace("</article-meta>", f"<abstract><p>{cite('c')}</p></abstract></article-meta>")
    content = f"{head}<body><title>t</title><p>{cite('b')}{cite('x')}{cite('c')}</p></body><back><ref-list>{ref('a')}<note/>{ref('b')}{ref('c')}</ref-list></back></article>".encode()
    assert convert(content, frozenset(["cited"]))["cited"] == numbers(convert(content)) == ["c", "b"]
    assert convert(b"<article><body/></article>", frozenset(["cited"]))["cited"] is None


def test_issues_of_citations_alone():
    content = f'{HEAD}<body><p><sc>a</sc>\n<xref rid="x" ref-type="bibr"/></p></body><back><ref-list>{ref("a")}<y/></ref-list></back></article>'.encode()
    found = convert(content, frozenset(["citation_issues"]))["citation_issues"]
    assert found == [i for i in convert(content)["issues"] if i["condition"][0] == "InvalidCitation"] and found[0]["sourceline"] == 2
