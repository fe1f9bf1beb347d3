"""Main text of web pages by tag-path ratios.

A page is read as text nodes, each with the path of tags from the root to it. For each path the length of its text and
its punctuation are summed and set against its number of nodes; both ratios are fused, less the share that is
link text. The value of each node's path is smoothed along the page, and paths most of whose text lies above a
threshold are content. The smallest element that holds nearly all of that content is the article: within it, what is not a
list of links and does not name itself as something beside the text is returned, headings and short lines too. A name in
a class or an identifier, or a form, is a sign only: an element that holds the text of the page stays.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)                                              # comment
      | <(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|noembed|noframes|xmp|title)
            \b(?>[^>"']+|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)    # its content is no text
      | <[!?][^>]*(?:>|\Z)
      | <(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9_-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

# Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that stand in a line of text; every other element begins and ends a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output "
    "picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# What a start tag closes first: the elements it ends, and those beyond which it ends nothing.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_P_ENDS_AT = frozenset(["body", "div", "td", "th", "li", "article", "section", "blockquote", "button", "table"])
# Elements that are never the text of an article.
_BESIDE = frozenset(
    "head nav footer aside button select fieldset dialog menu input datalist audio video canvas map".split()
)
_BESIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar status".split()
)
# Words in a class or an identifier that say the same.
_BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations trending widget pagination pager toolbar search tags".split()
)
# First words of a class that tell how a page is laid out, not what the element is: has-sidebar, no-comments.
_LAYOUT = frozenset("has have no not with without is".split())
_WHOLE = frozenset(["html", "body", "main", "article"])

SELECTED_SHARE = 0.8
LINK_SHARE = 0.5
WIDENED_SHARE = 1.25


def _beside(name: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """Whether an element holds something other than the article: for certain, or by what its names or a form suggest."""
    if name in _BESIDE or (name == "header" and not within):
        return True, False
    suggested = name == "form"
    if not attributes or attributes.isspace() or name in _WHOLE:
        return False, suggested
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            named = [[w.lower() for w in _WORD.findall(token)] for token in value.split()]
            words = {w for token in named if token and token[0] not in _LAYOUT for w in token}
            if words & _BESIDE_WORDS:
                suggested = True
            if "header" in words and not within and not words & {"article", "post", "entry", "content"}:
                suggested = True
        elif key == "role" and value.lower() in _BESIDE_ROLES:
            if name != "form":
                return True, False
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, False
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return False, suggested


class _Page:
    """Text nodes of one page in order: text, element, block, path and whether in a link."""

    def __init__(self, source: str):
        self.names, self.parents = ["#page"], [0]
        self.marked: list[int] = []  # elements whose names suggest that they are beside the article
        self.nodes: list[tuple[str, int, int, tuple, bool]] = []
        stack = [0]  # open elements
        paths: list[tuple] = [()]
        hidden = 0  # depth of the outermost open element that is beside the article
        links = within = block = 0
        at = 0

        def close(depth: int) -> None:
            nonlocal hidden, links, within
            while len(stack) > depth:
                name = self.names[stack.pop()]
                paths.pop()
                links -= name == "a"
                within -= name in ("article", "main")
            if hidden >= len(stack) + 1:
                hidden = 0

        for found in _TOKEN.finditer(source):
            if found.start() > at and not hidden:
                self._text(source[at : found.start()], stack[-1], block, paths[-1], links > 0)
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if name not in _INLINE:
                block += 1
            elif name == "br" and not hidden:
                self._text("\n", stack[-1], block, paths[-1], links > 0)
            if found["end"]:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.names[stack[depth]] == name:
                        close(depth)
                        break
                continue
            if name not in _INLINE:
                self._close_implied(name, stack, close)
            if name in _VOID:
                continue
            self.names.append(name)
            self.parents.append(stack[-1])
            stack.append(len(self.names) - 1)
            paths.append((*paths[-1], name))
            links += name == "a"
            if not hidden:
                certain, suggested = _beside(name, found["attributes"], within > 0)
                if certain:
                    hidden = len(stack)
                elif suggested:
                    self.marked.append(stack[-1])
            within += name in ("article", "main")
            if found["attributes"].endswith("/") and name not in _INLINE and ":" in name:
                close(len(stack) - 1)
        if at < len(source) and not hidden:
            self._text(source[at:], stack[-1], block, paths[-1], links > 0)

    def _text(self, text: str, element: int, block: int, path: tuple, link: bool) -> None:
        self.nodes.append((html.unescape(text) if "&" in text else text, element, block, path, link))

    def _close_implied(self, name: str, stack: list[int], close) -> None:
        for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
            open_name = self.names[stack[depth]]
            if open_name == "p":
                close(depth)
                break
            if open_name in _P_ENDS_AT:
                break
        ended, stops = _CLOSES.get(name, (frozenset(), frozenset()))
        for depth in range(len(stack) - 1, 0, -1) if ended else ():
            open_name = self.names[stack[depth]]
            if open_name in stops:
                break
            if open_name in ended:
                close(depth)
                if name != "tr":
                    break


def _path_values(nodes: list[tuple]) -> dict[tuple, tuple[float, float]]:
    """For each path the fused ratio, and the share of link text."""
    sums: dict[tuple, list[float]] = {}
    for text, _, _, path, link in nodes:
        length = len(text.strip())
        if length:
            total = sums.setdefault(path, [0, 0, 0, 0])
            total[0] += 1
            total[1] += length
            total[2] += len(_PUNCTUATION.findall(text))
            total[3] += length * link
    return {p: (c / n * (1 + m / n) * (1 - k / c), k / c) for p, (n, c, m, k) in sums.items()}


def _widened(page: _Page, filled: list[tuple], lengths: np.ndarray, root: int) -> int:
    """The article element around the root, if there is one; else the widest element with little other text."""
    chain = [root]
    while chain[-1]:
        chain.append(page.parents[chain[-1]])
    for name in ("article", "main"):
        for element in chain:
            if page.names[element] == name:
                return element
    every = [0] * len(page.names)
    for node, length in zip(filled, lengths.tolist()):
        every[node[1]] += length
    for element in range(len(every) - 1, 0, -1):
        every[page.parents[element]] += every[element]
    for parent in chain[1:]:
        if every[parent] > WIDENED_SHARE * every[chain[0]]:
            break
        root = parent
    return root


def _dropped(page: _Page) -> list[bool]:
    """For each element whether it lies in a marked one that does not hold the text of the page.

    A marked element stays if it holds `main`, or most of the running text while no other element says that it is the
    article; with less of the text it also needs the only heading or article.
    """
    prose = [0] * len(page.names)
    for text, element, _, _, link in page.nodes:
        prose[element] += 0 if link else len(text.strip())
    holds = [{name} & {"main", "article", "h1"} for name in page.names]
    for element in range(len(prose) - 1, 0, -1):
        prose[page.parents[element]] += prose[element]
        holds[page.parents[element]] = holds[page.parents[element]] | holds[element]
    under = [False] * len(page.names)  # whether in a marked element
    for element in page.marked:
        under[element] = True
    for element in range(1, len(under)):
        under[element] = under[element] or under[page.parents[element]]
    # Articles and headings outside of marked elements: on the page, and around each element.
    articles, titles = [0] * len(page.names), [0] * len(page.names)
    for element in range(1, len(under)):
        told = prose[element] > 0 and not under[element]
        articles[element] = articles[page.parents[element]] + (told and page.names[element] in ("main", "article"))
        titles[element] = titles[page.parents[element]] + (told and page.names[element] == "h1")
    every = [e for e in range(1, len(under)) if prose[e] and not under[e]]
    all_articles = sum(page.names[e] in ("main", "article") for e in every)
    all_titles = sum(page.names[e] == "h1" for e in every)
    dropped = [False] * len(page.names)
    for element in page.marked:
        alone = articles[element] == all_articles
        whole = alone and prose[element] >= SELECTED_SHARE * prose[0]
        most = alone and titles[element] == all_titles and holds[element] and 2 * prose[element] > prose[0]
        dropped[element] = not (prose[element] and ("main" in holds[element] or whole or most))
    for element in range(1, len(dropped)):
        dropped[element] = dropped[element] or dropped[page.parents[element]]
    return dropped


def main_text(source: str) -> str:
    """The article of a page: its blocks in order, joined by an empty line."""
    page = _Page(source)
    nodes = [n for n in page.nodes if n[0]]
    if page.marked:
        dropped = _dropped(page)
        nodes = [n for n in nodes if not dropped[n[1]]]
    filled = [n for n in nodes if n[0].strip()]
    if not filled:
        return ""
    values = _path_values(filled)
    raw = np.array([values[n[3]][0] for n in filled])
    padded = np.pad(raw, 2, mode="edge")
    smooth = sum(w * padded[i : i + len(raw)] for i, w in enumerate((0.06, 0.24, 0.4, 0.24, 0.06)))
    above = smooth >= min(smooth.std(), 0.5 * smooth.max())
    lengths = np.array([len(n[0].strip()) for n in filled])
    passed: dict[tuple, list[int]] = {}
    for node, length, high in zip(filled, lengths.tolist(), above.tolist()):
        total = passed.setdefault(node[3], [0, 0])
        total[0] += length * high
        total[1] += length
    content = {p for p, (high, every) in passed.items() if 2 * high >= every and values[p][1] < LINK_SHARE}
    # Text of content paths under each element; children come after their parents.
    under = [0] * len(page.names)
    for node, length in zip(filled, lengths.tolist()):
        if node[3] in content:
            under[node[1]] += length
    for element in range(len(under) - 1, 0, -1):
        under[page.parents[element]] += under[element]
    root = 0
    if under[0]:
        children: dict[int, list[int]] = {}
        for element in range(1, len(under)):
            if under[element]:
                children.setdefault(page.parents[element], []).append(element)
        while True:
            largest = max(children.get(root, []), key=lambda e: under[e], default=None)
            if largest is None or page.names[largest] in ("p", "li", "td", "pre") or page.names[largest] in _INLINE:
                break
            if under[largest] < SELECTED_SHARE * under[0]:
                break
            root = largest
    root = _widened(page, filled, lengths, root)
    inside = [False] * len(page.names)
    inside[root] = True
    for element in range(root + 1, len(page.names)):
        inside[element] = inside[page.parents[element]]
    titles = [e for e, name in enumerate(page.names) if name == "h1"]
    if titles and root and not any(inside[e] for e in titles) and titles[0] < root:
        inside[max(e for e in titles if e < root)] = True  # a title that stands before its article
        for element in range(root):
            inside[element] = inside[element] or (element > 0 and inside[page.parents[element]])
    blocks: dict[int, list[str]] = {}
    linked: dict[int, list[int]] = {}
    for text, element, block, path, link in nodes:
        if inside[element]:
            blocks.setdefault(block, []).append(text)
            total = linked.setdefault(block, [0, 0])
            length = len(text.strip())
            total[0] += length * link
            total[1] += length * (path in content)
    out = []
    for block, parts in blocks.items():
        text = " ".join("".join(parts).split())
        links, chosen = linked[block]
        # A block that is mostly links is kept only as part of running text.
        if text and (links < LINK_SHARE * len(text) or 2 * chosen >= len(text)):
            out.append(text)
    return "\n\n".join(out)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty page, and one without text, gives the empty text. White space in a block, line breaks too, is one space;
    character references are decoded; blocks are joined by two line feeds. Any text is a page: what is no tag is text.
    Repeated rows are read each for itself. An empty table gives no rows. Other columns are not read.
    """
    source = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kinds = dict(source.dtypes)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, type=pa.string()),
                    pa.array([len(t) for t in texts], type=pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return source.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


register_pickle_by_value(sys.modules[__name__])
