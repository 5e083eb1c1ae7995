"""Pages as rows: a small document tree on the standard library's parser, and text, links, title and language from it.

Layout rules: <br> ends a line; line ends in the source are layout and count as a space; comments, scripts and styles are
skipped; blocks stand on lines of their own. Void and unclosed elements are closed as browsers do for the common cases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
#: An opening tag closes an open element of these names before it.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}} | {
    b: {"p"} for b in BLOCKS - {"p", "li", "tr", "td", "th", "dt", "dd"}
}
_SCOPE = frozenset(("table", "ul", "ol", "dl", "body", "html", "div", "article", "section", "blockquote"))


class Node:
    """An element; children are nodes and strings, comments are nodes named '!'."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, *names: str, cls: str | None = None, **attrs: str) -> list[Node]:
        return [n for n in self.walk() if (not names or n.name in names) and n.name != "!" and (cls is None or cls in n.classes) and all(n.attrs.get(k) == v for k, v in attrs.items())]

    def find(self, *names: str, cls: str | None = None, **attrs: str) -> Node | None:
        return next(iter(self.find_all(*names, cls=cls, **attrs)), None)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def raw(self) -> str:
        """The text as it stands, without layout rules."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            elif at.name != "!" and at.name not in HIDDEN:
                stack.extend(reversed(at.children))
        return "".join(out)

    def following(self) -> Iterator[Node | str]:
        """The siblings after this node."""
        seen = False
        for c in self.parent.children if self.parent else []:
            if seen:
                yield c
            seen = seen or c is self


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self.open
        while at.parent and at.name not in _SCOPE - {tag}:
            if at.name in CLOSES.get(tag, ()):
                self.open = at.parent
                at = self.open
                continue
            at = at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at.parent and at.name != tag:
            at = at.parent
        if at.parent:
            self.open = at.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open.children.append(Node("!", {"text": data}, self.open))


_STEP = re.compile(r"^([a-z0-9]*)(?:#([\w-]+))?((?:\.[\w-]+)*)$")


def select(root: Node, path: str) -> list[Node]:
    """Elements by a path of tag#id.class steps; a step after '>' is a child, others stand anywhere below."""
    found, direct = [root], False
    for step in path.split():
        if step == ">":
            direct = True
            continue
        name, ident, classes = _STEP.match(step).groups()
        wanted = set(classes.split(".")[1:])
        fits = lambda n: isinstance(n, Node) and n.name != "!" and (not name or n.name == name) and (not ident or n.attrs.get("id") == ident) and wanted <= set(n.classes)  # noqa: E731, B023
        below = [n for f in found for n in (f.children if direct else f.walk()) if fits(n)]
        found, direct = list({id(n): n for n in below}.values()), False
    return found


def first(root: Node, path: str) -> Node | None:
    return next(iter(select(root, path)), None)


def label(node: Node | None) -> str:
    """An element's text on one line."""
    return " ".join(node.raw().split()) if node else ""


def parse(html: str) -> Node:
    """The tree of a page; no page is refused."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def to_text(*nodes: Node | str, newline_breaks: bool = False) -> str:
    """Text by the layout rules. newline_breaks: source line ends break lines and <br> doesn't, as some pages want."""
    out: list[str] = []
    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        at = stack.pop()
        if at is None:
            out.append("\n")
        elif isinstance(at, str):
            out.append(at if newline_breaks else re.sub(r"\s+", " ", at))
        elif at.name == "br":
            out.append("" if newline_breaks else "\n")
        elif at.name != "!" and at.name not in HIDDEN:
            block = at.name in BLOCKS and not newline_breaks
            if block:
                out.append("\n")
                stack.append(None)
            stack.extend(reversed(at.children))
    lines = [re.sub(r"[ \t\xa0]+", " ", line).strip() for line in "".join(out).replace("\r", "").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def title(root: Node) -> str:
    found = root.find("title")
    return " ".join(found.raw().split()) if found else ""


def lang(root: Node) -> str:
    found = root.find("html")
    return found.attrs.get("lang", "") if found else ""


def links(root: Node) -> list[dict[str, str]]:
    return [{"href": a.attrs["href"], "label": " ".join(a.raw().split())} for a in root.find_all("a") if "href" in a.attrs]


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, title, lang, text (of the body), links (href, label) of every page; null html is an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [parse(h.as_py() or "") for h in batch.column(1)]
            bodies = [t.find("body") or t for t in trees]
            kind = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(title, trees), pa.string()), pa.array(map(lang, trees), pa.string()), pa.array([to_text(b) for b in bodies], pa.string()), pa.array(map(links, trees), kind)],
                [key, "title", "lang", "text", "links"],
            )

    return pages.select(key, html).mapInArrow(run, f"{key} long, title string, lang string, text string, links array<struct<href: string, label: string>>")
