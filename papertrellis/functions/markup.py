"""Elements of a page: a small tree by the standard parser, for the rules that need nesting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "noscript")


class Node:
    __slots__ = ("tag", "classes", "kids")

    def __init__(self, tag: str, classes: list[str]):
        self.tag, self.classes, self.kids = tag, classes, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", [])]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, next(((v or "").split() for k, v in attrs if k == "class"), []))
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(html: str | None) -> Node:
    """The page as nested elements; broken markup gives what can be read of it."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


def walk(node: Node) -> Iterator[Node | str]:
    """Elements and strings below a node in page order."""
    stack = list(reversed(node.kids))
    while stack:
        now = stack.pop()
        yield now
        if isinstance(now, Node) and now.tag not in SILENT:
            stack.extend(reversed(now.kids))


def text(node: Node) -> str:
    """All strings below, joined by one space, on one line."""
    return " ".join(" ".join(x.split()) for x in walk(node) if isinstance(x, str) and x.strip())


def of_class(root: Node, classes: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(class number, which element of the class, full text) by class and in page order."""
    found: list[list[str]] = [[] for _ in classes]
    for node in walk(root):
        if isinstance(node, Node):
            for rank, name in enumerate(classes):
                if name in node.classes:
                    found[rank].append(text(node))
    return [(rank, k, t) for rank, texts in enumerate(found) for k, t in enumerate(texts)]


def after_first(root: Node, tag: str) -> list[str]:
    """The strings from the first such element on, its own included; blank ones are left out."""
    out, seen = [], False
    for x in walk(root):
        if isinstance(x, Node):
            seen = seen or x.tag == tag
        elif seen and x.strip():
            out.append(" ".join(x.split()))
    return out


def sibling_section(root: Node, names: tuple[str, ...]) -> list[str]:
    """Texts of the siblings behind the first heading with one of the names, up to the next heading.

    A list gives its items one by one, a paragraph or division one text, other elements nothing.
    """
    wanted, heads = {n.lower() for n in names}, ("h2", "h3", "h4")
    for parent in (x for x in (root, *walk(root)) if isinstance(x, Node)):
        elements = [k for k in parent.kids if isinstance(k, Node)]
        for at, node in enumerate(elements):
            if node.tag in heads and text(node).lower() in wanted:
                out = []
                for near in elements[at + 1:]:
                    if near.tag in heads:
                        break
                    if near.tag in ("ul", "ol"):
                        out += [text(x) for x in walk(near) if isinstance(x, Node) and x.tag == "li"]
                    elif near.tag in ("p", "div"):
                        out.append(text(near))
                return [t for t in out if t]
    return []


def page_rows(pages: DataFrame, find: Callable[[Node], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """(page_id, and the columns) of what ``find`` returns for each page's tree."""
    kind = pages.schema["page_id"].dataType.simpleString()
    arrow = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = find(tree(batch.column(1)[k].as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([k] * len(rows))), *[pa.array(v, arrow[t]) for v, t in zip(zip(*rows), columns.values())]],
                        names=["page_id", *columns])

    return pages.select("page_id", "html").mapInArrow(run, ", ".join([f"page_id {kind}", *[f"`{n}` {t}" for n, t in columns.items()]]))
