"""Trees of one document: as read from XML, and as written in the normal form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.etree.ElementTree import Element, ParseError, XMLParser
from xml.parsers import expat

#: Namespaces with a usual prefix.
PREFIXES = {
    "http://www.niso.org/schemas/ali/1.0/": "ali",
    "http://www.w3.org/1998/Math/MathML": "mml",
    "http://www.w3.org/1999/xlink": "xlink",
    "http://www.w3.org/XML/1998/namespace": "xml",
}
MATHML = "{http://www.w3.org/1998/Math/MathML}"
XLINK_HREF = "{http://www.w3.org/1999/xlink}href"
XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


class Node:
    """An element of the source: `text` stands before its first child, `tail` after its own end."""

    __slots__ = ("attrs", "children", "line", "parent", "tag", "tail", "text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, line: int) -> None:
        self.tag, self.attrs, self.parent, self.line = tag, attrs, parent, line
        self.text = self.tail = ""
        self.children: list[Node] = []

    def __iter__(self):
        return iter(self.children)

    def child(self, tag: str) -> Node | None:
        return next((c for c in self.children if c.tag == tag), None)

    def walk(self):
        """The node and all below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)


@dataclass
class Source:
    """What a scan finds: a tree, or the place and message of a syntax error; both with facts about the document."""

    root: Node | Element | None = None
    doctype: bool = False
    encoding: str = "utf-8"
    error: str | None = None
    error_line: int | None = None
    content: bytes = b""


def _name(name: str) -> str:
    return "{" + name if "}" in name else name


def read(content: bytes) -> Source:
    """Reads XML without comments and processing instructions; tags are `{namespace}name` or `name`."""
    source = Source()
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.ordered_attributes = True
    at: Node | None = None
    last: Node | None = None

    def start(tag: str, pairs: list[str]) -> None:
        nonlocal at, last
        node = Node(_name(tag), {_name(k): v for k, v in zip(pairs[::2], pairs[1::2], strict=True)}, at, parser.CurrentLineNumber)
        if at is None:
            source.root = node
        else:
            at.children.append(node)
        at, last = node, None

    def end(tag: str) -> None:
        nonlocal at, last
        last, at = at, at.parent if at else None

    def text(data: str) -> None:
        if last is not None and at is not None:
            last.tail += data
        elif at is not None:
            at.text += data

    def declared(version: str, encoding: str | None, standalone: int) -> None:
        source.encoding = encoding or "utf-8"

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.XmlDeclHandler = declared
    parser.StartDoctypeDeclHandler = lambda *_: setattr(source, "doctype", True)
    try:
        parser.Parse(content or b"", True)
    except expat.ExpatError as e:
        source.root, source.error, source.error_line = None, expat.errors.messages[e.code], e.lineno
    except (LookupError, ValueError) as e:  # an unknown encoding
        source.root, source.error, source.error_line = None, str(e), 1
    return source


def _walked(content: bytes, **handlers) -> None:
    """Runs a document through handlers; what is wrong with it ends that."""
    parser = expat.ParserCreate(namespace_separator="}")
    for name, handler in handlers.items():
        setattr(parser, name, handler(parser))
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, LookupError, ValueError):
        pass


def lines(content: bytes) -> list[int]:
    """The lines on which elements begin, in document order."""
    out: list[int] = []
    _walked(content, StartElementHandler=lambda parser: lambda tag, attrs: out.append(parser.CurrentLineNumber))
    return out


def _has_doctype(content: bytes) -> bool:
    found: list[bool] = []
    _walked(content, StartDoctypeDeclHandler=lambda parser: lambda *_: found.append(True))
    return bool(found)


def _elements(root: Node) -> Element:
    """A tree as ElementTree has it."""
    made = {}
    for node in root.walk():
        made[node] = out = Element(node.tag, node.attrs)
        out.text, out.tail = node.text, node.tail
        if node is not root:
            made[node.parent].append(out)
    return made[root]


_ENCODING = re.compile(rb"""<\?xml[^>]*?\sencoding\s*=\s*["']([^"']*)["']""")


def scan(content: bytes) -> Source:
    """As `read`, but with the elements of ElementTree, which builds them without a call of Python for each; texts and tails are strings. Documents in another encoding than UTF-8, and those ElementTree doesn't take, go through `read`."""
    named = _ENCODING.match(content)
    encoding = named[1].decode("ascii", "replace") if named else "utf-8"
    if encoding.lower() == "utf-8" and content[:1] == b"<" and b"\0" not in content[:4]:
        try:
            parser = XMLParser()
            parser.feed(content)
            root = parser.close()
        except (ParseError, LookupError, ValueError):
            root = None
        if root is not None:
            for node in root.iter():
                if node.text is None:
                    node.text = ""
                if node.tail is None:
                    node.tail = ""
            return Source(root, b"<!DOCTYPE" in content and _has_doctype(content), encoding, content=content)
    source = read(content)
    if source.root is not None:
        source.root = _elements(source.root)
    source.content = content
    return source


@dataclass(slots=True)
class Out:
    """An element of the normal form.

    kind: mixed (text and elements), array (elements only, indented), biform (array that prints a lone block of phrasing
    as mixed), cites (citations in a row), void (self-closed), space (a single space), formula.
    """

    tag: str
    kind: str = "mixed"
    attrs: dict[str, str] = field(default_factory=dict)
    items: list = field(default_factory=list)
    #: What HTML makes of it, if the tag doesn't say: cite, reference, link, inline or display.
    role: str = ""

    def add(self, item: str | Out) -> None:
        """Appends; text after text is one text."""
        if isinstance(item, str):
            if not item:
                return
            if self.items and isinstance(self.items[-1], str):
                self.items[-1] += item
                return
        self.items.append(item)

    @property
    def blank(self) -> bool:
        """Whether there is no element and no text but white space."""
        return not any(not isinstance(i, str) or i.strip() for i in self.items)

    @property
    def lone_block(self) -> Out | None:
        if self.kind == "biform" and len(self.items) == 1 and self.items[0].tag == "div" and self.items[0].kind == "mixed":
            return self.items[0]
        return None


def text_of(node: Node) -> str:
    """All text below a node, in order; without recursion."""
    parts: list[str] = [node.text]
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
        else:
            parts.append(at.text)
            todo += [at.tail, *reversed(at.children)]
    return "".join(parts)
