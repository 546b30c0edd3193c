"""XML and HTML documents as tables of elements.

nodes: one row per element, numbered in document order. `pre` and `post` span an element's descendants, `parent` is the
parent's `pre`, `path` holds the tags from the root down to the element. `text` stands before the first child, `tail`
after the element's end. `path` is null below LONGEST_PATH levels. What a tally asks of the parent (tag, attributes) is in the row, so it needs no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginalia.functions.tree import Element, Node, lines, scan

NODES = (
    "article_id string, pre int, post int, parent int, ord int, depth int, tag string, attrs map<string,string>, text string, tail string,"
    " path array<string>, line int, n_children int, parent_attrs map<string,string>"
)
#: A column that is made only if it is named: the place among the article's rows.
OPTIONAL = "nth int"
#: Levels of a document down to which elements know their path.
LONGEST_PATH = 1000
#: Elements of HTML without an end, and those that end where another of the list begins.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_BEFORE = {"p": frozenset("p div ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 section article nav footer header main form hr".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


class _Html(HTMLParser):
    """Builds a tree of tag soup: missing ends are added, stray ends ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None, 1)
        self.at, self.last = self.root, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.parent is not None and tag in ENDS_BEFORE.get(self.at.tag, ()):
            self.at, self.last = self.at.parent, self.at
        node = Node(tag, {}, self.at, self.getpos()[0])
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        if tag in VOID:
            self.last = node
        else:
            self.at, self.last = node, None

    def handle_endtag(self, tag: str) -> None:
        open_one = self.at
        while open_one is not None and open_one.tag != tag:
            open_one = open_one.parent
        if open_one is not None and open_one.parent is not None:
            self.at, self.last = open_one.parent, open_one

    def handle_data(self, data: str) -> None:
        if self.last is not None:
            self.last.tail += data
        else:
            self.at.text += data


def read_html(text: str) -> Node:
    parser = _Html()
    parser.feed(text)
    parser.close()
    return parser.root


def rows(article_id: str, root: Node) -> Iterator[dict]:
    """Rows of a tree, in document order; without recursion, so deep trees are fine."""
    out: list[dict] = []
    todo: list[tuple] = [(root, None, 0, 0, [])]
    while todo:
        node, parent, order, depth, above = todo.pop()
        if node is None:  # an element has ended: parent is its row
            parent["post"] = len(out) - 1
            continue
        path = None if above is None or depth >= LONGEST_PATH else [*above, node.tag]
        row = {"article_id": article_id, "pre": len(out), "parent": None if parent is None else parent["pre"], "ord": order, "depth": depth, "tag": node.tag, "attrs": list(node.attrs.items()), "text": node.text, "tail": node.tail, "path": path, "line": node.line, "n_children": len(node.children), "parent_attrs": None if node.parent is None or parent is None else list(node.parent.attrs.items())}
        out.append(row)
        todo.append((None, row, 0, 0, []))
        todo += [(c, row, i, depth + 1, path) for i, c in reversed(list(enumerate(node.children)))]
    return iter(out)


def _add(out: dict[str, list], article_id: str, content: bytes, root: Element, tags: frozenset[str] | None) -> None:
    """Adds a document's elements, or those with the tags, to columns. Only columns that are there are made."""
    asked = [(column, out[column].append) for column in out if column not in ("post", "line")]
    post, line = out.get("post"), lines(content) if "line" in out else ()
    with_path, pre, kept = "path" in out, 0, 0
    todo: list[tuple] = [(root, None, None, 0, 0, [])]
    while todo:
        node, up, parent, order, depth, above = todo.pop()
        if node is None:  # an element has ended: parent is its row
            post[parent] = pre - 1
            continue
        path = above
        if with_path:
            path = None if above is None or depth >= LONGEST_PATH else [*above, node.tag]
        below = node[:]
        if tags is None or node.tag in tags:
            for column, put in asked:
                if column == "article_id":
                    put(article_id)
                elif column == "tag":
                    put(node.tag)
                elif column == "attrs":
                    put(node.items())
                elif column == "path":
                    put(path)
                elif column == "text":
                    put(node.text)
                elif column == "tail":
                    put(node.tail)
                elif column == "pre":
                    put(pre)
                elif column == "parent":
                    put(parent)
                elif column == "ord":
                    put(order)
                elif column == "depth":
                    put(depth)
                elif column == "n_children":
                    put(len(below))
                elif column == "parent_attrs":
                    put(None if up is None else up.items())
                else:
                    put(kept)
            if line:
                out["line"].append(line[pre])
            if post is not None:
                todo.append((None, None, len(post), 0, 0, None))
                post.append(pre)
            kept += 1
        depth += 1
        for i in range(len(below) - 1, -1, -1):
            todo.append((below[i], node, pre, i, depth, path))
        pre += 1


def _scan(raw: DataFrame, id_col: str, content: F.Column, html: bool, columns: str | None, tags: frozenset[str] | None = None) -> DataFrame:
    kinds = dict(x.strip().split(" ", 1) for x in [*NODES.split(", "), OPTIONAL])
    schema = NODES if columns is None else ", ".join(f"{c} {kinds[c]}" for c in columns.split())
    arrow = to_arrow_schema(T._parse_datatype_string(schema), prefers_large_types=False)

    def run_html(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found += rows(i, read_html((x or b"").decode(errors="replace")))
                if len(found) > 20_000:
                    yield pa.RecordBatch.from_pylist(found, arrow)
                    found = []
            yield pa.RecordBatch.from_pylist(found, arrow)

    def made(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    def run_xml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {name: [] for name in arrow.names}
            for i, x in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                root = scan(x or b"").root
                if root is not None:
                    _add(found, i, x, root, tags)
                if len(found[arrow.names[0]]) > 20_000:
                    yield made(found)
                    found = {name: [] for name in arrow.names}
            yield made(found)

    run = run_html if html else run_xml
    return raw.select(F.col(id_col).cast("string").alias("id"), content.cast("binary").alias("content")).mapInArrow(run, schema)


def scan_xml(raw: DataFrame, id_col: str = "article_id", content_col: str = "content", columns: str | None = None, tags: tuple[str, ...] | None = None) -> DataFrame:
    """Elements of well-formed documents; others have none (the article operator reports them). columns: names of the columns to make, all of NODES by default. tags: those of the elements to return, all by default; their numbers are those of the whole document, and `nth` counts what is returned."""
    return _scan(raw, id_col, F.col(content_col), False, columns, None if tags is None else frozenset(tags))


def scan_html(raw: DataFrame, id_col: str = "page_id", content_col: str = "html", columns: str | None = None) -> DataFrame:
    """Elements of HTML pages, under a root `#document`. columns: as for scan_xml."""
    return _scan(raw, id_col, F.col(content_col), True, columns)


def with_parent(nodes: DataFrame) -> DataFrame:
    """nodes with parent_tag, taken from the path: no join."""
    return nodes.withColumn("parent_tag", F.when(F.size("path") > 1, F.get("path", F.size("path") - 2)))


def is_at(*path: str) -> F.Column:
    """Whether an element is at exactly this path below the root."""
    return F.slice("path", 2, 1 << 30) == F.array(*map(F.lit, path))


def at_path(nodes: DataFrame, *path: str) -> DataFrame:
    """Elements at exactly this path below the root."""
    return nodes.where(is_at(*path))
