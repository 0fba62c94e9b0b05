"""Main text of web pages: flat text blocks, classified by a decision tree over their words and links and those of their neighbours.

A page is read once from left to right by a small tokeniser; block tags end a block. A block has its number of words, its share of
words in links, the same of the blocks before and after it, and what its surroundings say (the names, classes and ids of the open
elements). The tree is fitted on the driver from the labelled blocks in LABELLED and is sent to the tasks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from papertrellis.llm.tables import slices

# Names of elements and of page parts.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea button".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset".split())
BODY = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus feedback footer header login "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted reader related replies respond reviews share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
BODY_WORDS = frozenset("article body content entry main post story text".split())
ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert menu".split())

_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?/]?[a-zA-Z]|<[!?]")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Tags whose opening ends an open paragraph or item of the same kind.
_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option", "p": "p"}


def _tag_end(page: str, at: int) -> int:
    """Position behind the tag's closing sign; quoted values may hold one. An unclosed tag runs to the end of the page."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        one, two = page.find('"', at, end), page.find("'", at, end)
        first = min(x for x in (one, two, end) if x >= 0)
        if first == end:
            return end + 1
        close = page.find(page[first], first + 1)
        if close < 0:
            return end + 1
        at = close + 1


def _signs(name: str, tag: str, inside: bool = False) -> tuple[bool, bool, bool]:
    """(page furniture, main part, hidden) by an element's name, classes, id and role.

    A header ``inside`` the main part, or one that a class calls the header of a text, is no furniture: it has the text's title.
    """
    chrome, body, hidden = name in CHROME and not (inside and name == "header"), name in BODY, name in HIDDEN
    if len(tag) > len(name) + 2:
        for key, a, b, c in _ATTR.findall(tag):
            value, key = a or b or c, key.lower()
            if key in ("class", "id"):
                for one in _CAMEL.sub("-", value).lower().split():
                    words = set(_WORDS.findall(one))
                    furniture = words & CHROME_WORDS
                    if inside or words & BODY_WORDS:
                        furniture.discard("header")
                    chrome |= bool(furniture) and name not in ("body", "html", "article", "main")
                    body |= bool(words & BODY_WORDS)
            elif key == "role":
                chrome |= value.lower() in ROLES
                body |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden |= key != "aria-hidden" or name not in ("body", "main", "article")
    return chrome, body, hidden


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, str]]:
    """(text, words, words in links, in page furniture, in the main part, innermost block tag) of each block with text, in page order."""
    out, stack = [], []  # stack: (name, furniture, main part, hidden) of the open elements, each with what its parents have
    standing: Counter[str] = Counter()  # open elements by name, so that an end tag without one costs nothing
    parts: list[str] = []
    words = linked = links = 0
    tag_now = ""
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, words, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                count = len(text.split())
                name, chrome, body, _ = stack[-1] if stack else ("", False, False, False)
                block = next((s[0] for s in reversed(stack) if s[0] not in INLINE), "")
                out.append((text, count, min(linked, count), chrome, body, block))
        parts, words, linked = [], 0, 0

    def close(name: str) -> None:
        nonlocal links
        if not standing[name]:
            return
        gone = ""
        while gone != name:
            gone = stack.pop()[0]
            standing[gone] -= 1
            links -= gone == "a"

    def say(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1][3]):
            parts.append(text)
            if links:
                linked += len(text.split())

    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at:found.start()])
        at, kind = found.start(), found.group()
        if kind == "<!--":
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if kind == "<![CDATA[" or kind[1] in "!?":
            end = page.find("]]>" if kind == "<![CDATA[" else ">", at)
            at = n if end < 0 else end + (3 if kind == "<![CDATA[" else 1)
            continue
        end = _tag_end(page, at)
        tag, at = page[at:end], end
        closing = tag[1] == "/"
        named = _NAME.search(tag)
        name = named.group().lower()
        if name not in INLINE:
            flush()
        if closing:
            close(name)
            continue
        if name in VOID:
            continue
        if name in _CLOSES:
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k][0] in (name, _CLOSES[name]):
                    close(stack[k][0])
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
        chrome, body, hidden = _signs(name, tag, bool(stack) and stack[-1][2])
        if stack:
            _, up_chrome, up_body, up_hidden = stack[-1]
            if name in BODY and not up_chrome:
                body = True
            chrome, body, hidden = chrome or up_chrome, body or up_body, hidden or up_hidden
        if name in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = n if end is None else _tag_end(page, end.start())
            continue
        if tag.endswith("/>") and name in ("svg", "path", "p", "div", "span") and name != "p":
            continue
        stack.append((name, chrome, body, hidden))
        standing[name] += 1
        links += name == "a"
    flush()
    return out


def features(found: list[tuple[str, int, int, bool, bool, str]]) -> np.ndarray:
    """One row per block: words, link density, both of the blocks before and after, furniture, main part, main part on the page, heading."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] / max(1, b[1]) for b in found])
    pad = lambda x: np.concatenate([[0], x, [0]])
    w, d = pad(words), pad(density)
    chrome, body = np.array([b[3] for b in found], float), np.array([b[4] for b in found], float)
    heading = np.array([b[5] in ("h1", "h2", "h3", "h4", "h5", "h6") for b in found], float)
    return np.column_stack([words, density, w[:-2], d[:-2], w[2:], d[2:], chrome, body, np.full(len(found), body.max()), heading])


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "main", "page_has_main", "heading")

#: The labelled table: pages in short, a line per block: tag path with classes, number of words, linked words, and 1 for main text.
LABELLED = """
nav>ul>li 1 1 0 | nav>ul>li 2 2 0 | div.ad 8 0 0 | article>h1 7 0 1 | article>p 42 0 1 | article>p 3 0 1 | article>p 120 2 1 | footer 9 0 0
nav>ul>li 1 1 0 | nav>ul>li 1 1 0 | div.ad 14 0 0 | article>h1 12 0 1 | article>p 12 0 1 | article>p 1 0 1 | article>p 66 0 1 | footer 6 0 0
header>div 4 0 0 | nav>a 6 6 0 | main>h1 5 0 1 | main>p 60 4 1 | main>aside 20 0 0 | main>p 35 0 1 | main>ul>li 9 0 1 | div.comments>p 40 0 0 | footer 30 12 0
div.cookie 25 2 0 | div.menu>a 8 8 0 | div.content>h1 6 0 1 | div.content>p 80 3 1 | div.content>p 55 0 1 | div.sidebar>p 12 2 0 | div.footer 15 3 0
div.header 5 1 0 | div 5 5 0 | div 70 1 1 | div 50 2 1 | div 90 0 1 | div 4 3 0 | div 6 5 0 | form 10 0 0
div 3 3 0 | div 4 4 0 | h1 8 0 1 | p 40 0 1 | p 25 1 1 | p 33 0 1 | p 2 0 0 | div 7 6 0 | div 5 0 0
article>div.share 3 3 0 | article>h1 9 0 1 | article>p 15 0 1 | article>blockquote 22 0 1 | article>p 7 7 1 | article>section.comments>p 18 0 0 | article>section.comments>p 44 0 0
div.notice 16 0 0 | main>h2 3 0 1 | main>p 11 1 1 | main>table>tr>td 2 0 1 | main>p 64 0 1 | main>form 5 0 0 | main>div.related 12 12 0 | footer>p 20 1 0
div.advert 30 0 0 | div.post>h1 4 0 1 | div.post>p 28 0 1 | div.post>p 31 2 1 | div.promo 18 4 0 | div.post>p 19 0 1 | div.newsletter 9 0 0
nav 10 10 0 | p 30 0 1 | p 48 0 1 | ul>li 6 5 0 | ul>li 5 5 0 | p 3 1 0
article>p 2 0 1 | article>p 5 1 1 | article>h2 2 0 1 | article>p 9 9 1 | article>figure>figcaption 6 0 1
body 200 3 1 | body 12 11 0
div 9 0 0 | div 25 1 0 | article>h1 6 0 1 | article>p 50 1 1 | article>p 21 0 1 | div 14 0 0 | p 11 0 0
p 17 0 0 | main>p 20 0 1 | main>p 8 0 1 | main>ul>li 4 4 1 | span 6 0 0 | div 31 0 0
div 60 60 0 | div 60 58 0
p 60 60 0 | p 62 62 0
p 9 0 1
div 7 0 1
p 6 0 1
h1 3 0 1 | p 8 0 1
div 5 0 1
div 30 28 0 | div 45 2 1 | div 6 0 1 | div 50 1 1 | div 8 7 0 | div 12 12 0
p 24 22 0 | p 40 1 1 | p 7 0 1 | p 38 0 1
ul>li 40 39 0 | ul>li 35 35 0 | div 80 2 1 | div 9 1 1 | div 90 0 1
div 6 6 0 | div 3 0 0 | div 7 7 0 | div 60 1 1 | div 4 0 1 | div 70 0 1 | div 9 9 0 | div 3 0 0 | div 8 8 0
div 12 12 0 | div 5 0 0 | div 10 10 0 | p 45 0 1 | p 5 0 1 | p 55 2 1 | p 4 1 1 | p 62 0 1 | div 6 0 0 | div 11 11 0 | div 2 0 0 | div 5 5 0
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of LABELLED."""
    rows, marks = [], []
    for line in LABELLED.strip().splitlines():
        found = []
        for entry in line.split(" | "):
            path, words, linked, label = entry.split()
            chrome = body = False
            for step in path.split(">"):
                name, _, kind = step.partition(".")
                one = _signs(name, f'<{name} class="{kind}">' if kind else f"<{name}>")
                chrome, body = chrome or one[0], body or one[1]
            found.append(("", int(words), int(linked), chrome, body, path.split(">")[-1].partition(".")[0]))
            marks.append(int(label))
        rows.append(features(found))
    return np.concatenate(rows), np.array(marks)


def grow(rows: np.ndarray, marks: np.ndarray, depth: int = 8, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, left, right) with rows up to the threshold to the left, or (share of 1,)."""
    if depth == 0 or len(marks) < 2 * least or marks.min() == marks.max():
        return (float(marks.mean()),)
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, y = rows[order, f], marks[order]
        n, ones = np.arange(1, len(y)), np.cumsum(y)[:-1]
        rest, more = len(y) - n, y.sum() - ones
        impurity = 2 * (ones * (n - ones) / n + more * (rest - more) / rest)
        impurity = np.where((np.diff(x) > 0) & (n >= least) & (rest >= least), impurity, np.inf)
        k = int(impurity.argmin())
        if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0] - 1e-12):
            best = (impurity[k], f, (x[k] + x[k + 1]) / 2)
    if best is None:
        return (float(marks.mean()),)
    _, f, cut = best
    left = rows[:, f] <= cut
    return f, float(cut), grow(rows[left], marks[left], depth - 1, least), grow(rows[~left], marks[~left], depth - 1, least)


def is_main(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, row in zip(found, features(found)) if is_main(tree, row))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` and main_text (replaced if there): the main text of the whole html, empty if there is none.

    Null and empty html have an empty text. Blocks are joined in page order by one space; white space inside is one space.
    """
    columns = [c for c in pages.columns if c != "main_text"]
    chosen = pages.select(*[F.col(f"`{c}`") for c in columns], F.col(html_col).cast("string").alias("__html"))
    schema = chosen.drop("__html").schema.add("main_text", "string")
    sent = pages.sparkSession.sparkContext.broadcast(grow(*labelled()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            texts = [main_text(t, sent.value) for t in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], pa.array(texts, pa.string())], names=[*columns, "main_text"])

    return chosen.mapInArrow(run, schema)
