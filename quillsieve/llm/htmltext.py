"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its path: the names (with classes and ids) of the block elements from
the root to it. Per path, text length, punctuation, linked text and the number of blocks are added up. A path's ratio is its
text per block; punctuation per block is the second ratio. Both are smoothed over the paths in page order, fused, and a
path is content if the result reaches a share of the best path's. Blocks that sit beside or below content paths in the same
container (headings, lists, short paragraphs) are kept with them unless they are mostly links.

Elements that never hold the article (menus, scripts, notices and the like, by element or role) are left out before
anything is counted. Classes, ids and forms are only signs: an element that bears one is left out if the page's text is
mostly elsewhere, and one whose whole class is a mark also if it holds most text but no article, main or h1.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.arrow import map_texts

#: A path is content from this share of the best fused score on.
CONTENT_SHARE = 0.2
#: Paths below an element made for the article count this much more.
ARTICLE_WEIGHT = 4.0
#: Elements nested deeper are read as if they stood in the one at this depth.
DEEPEST = 512
#: A block is a list of links from this share of linked letters on.
LINKED = 0.5
#: A marked element that holds this share of the page's unlinked text is no part beside the article.
MAJOR = 0.5

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An opening element closes an open one of these in the same container.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"),
    "thead": ("thead", "tbody", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
CONTAINERS = frozenset("ul ol menu dl table select datalist".split())
# What marks the parts around an article.
NEVER = frozenset(
    "head title script style noscript template iframe svg math canvas object audio video map nav aside footer button "
    "select datalist textarea input fieldset legend dialog menu xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv adbox adslot banner promo promos promotion menu nav navbar topnav subnav topbar masthead footer colophon header "
    "sidebar sidebars rail widget widgets cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast "
    "subscribe subscription newsletter signup login share sharing social toolbar related recommended recommendations "
    "pager pagination breadcrumb breadcrumbs search disqus replies reply respond discussion paywall disclaimer "
    "copyright legal tags skip hidden".split()
)
MARK_STARTS = ("advert", "sponsor", "comment", "sidebar", "navig", "breadcrumb", "cookie", "newsletter", "related")
# Names of the readers' part of a page, and words beside them that only tell a setting of the page.
COMMENTS = re.compile(r"comments?|comment(list|area|section|box|thread|threads|form|body|wrapper|container|block)|disqus|responses|replies|respond")
SETTINGS = frozenset("has no with without open closed enabled disabled allowed allow off on show hide status count page".split())
ARTICLE = frozenset("article main".split())
ARTICLE_MARKS = frozenset("article articlebody content post entry story maincontent".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class _Quotes:
    """Finds the end of a tag; remembers where a kind of quotation mark ends, so no page takes quadratic time."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def tag_end(self, at: int) -> int:
        """Index of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none."""
        page = self.page
        while found := _STOP.search(page, at):
            at = found.start()
            mark = page[at]
            if mark == ">":
                return at
            before = at - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and at < self.last[mark]:
                at = page.index(mark, at + 1)
            at += 1
        return -1


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


class _Element:
    __slots__ = ("article", "doubts", "inline", "link", "name", "out", "path")

    def __init__(self, name: str, path: str, out: bool, article: bool, inline: bool, link: bool, doubts: tuple = ()):
        self.doubts = doubts
        self.name, self.path, self.out, self.article, self.inline, self.link = name, path, out, article, inline, link


class _Doubt:
    """A marked element: ``whole`` if a class or id is nothing but the mark, ``holds`` with an article, main or h1 in it.

    ``comments`` are the readers', however long, unless nothing outside of them holds an article.
    """

    __slots__ = ("comments", "holds", "whole")

    def __init__(self, whole: bool, comments: bool):
        self.whole, self.comments, self.holds = whole, comments, False


class _Block:
    __slots__ = ("article", "doubts", "linked", "parent", "path", "text")

    def __init__(self, path: str, parent: str, text: str, linked: int, article: bool, doubts: tuple):
        self.doubts = doubts
        self.path, self.parent, self.text, self.linked, self.article = path, parent, text, linked, article


def _marked(token: str) -> bool:
    return token != "header" and (token in MARKS or (token.isalnum() and token.startswith(MARK_STARTS)))


def _comments(tokens: list[str]) -> bool:
    """Whether a class or id names readers' comments and not a setting of the page."""
    for token in tokens:
        parts = _WORDS.findall(token)
        if any(COMMENTS.fullmatch(p) for p in parts) and not SETTINGS.intersection(parts):
            return True
    return False


def _opened(name: str, attributes: dict[str, str], above: _Element) -> _Element:
    """The element that an opening tag makes below ``above``."""
    named = _CAMEL.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
    marks = _WORDS.findall(named.lower())
    article = above.article
    if name in ARTICLE or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody":
        article = True
    elif name in ("div", "section", "td") and ARTICLE_MARKS.intersection(marks):
        article = True
    header = name == "header" or "header" in marks
    out = (
        above.out
        or name in NEVER
        or (header and not above.article)
        or attributes.get("role", "") in ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or bool(_HIDDEN.search(attributes.get("style", "")))
    )
    doubts = above.doubts
    if name in ("article", "main", "h1"):
        for doubt in doubts:
            doubt.holds = True
    signs = any((m in MARKS and m != "header") or m.startswith(MARK_STARTS) for m in marks)
    tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    comments = _comments(_CAMEL.sub("-", tokens).lower().split())
    if name == "form" or ((signs or comments) and name not in ("body", "html")):
        whole = any(_marked(t) for t in tokens.lower().split())
        doubt = _Doubt(whole, comments and name not in ("body", "html"))
        doubt.holds = name in ("article", "main")
        doubts = (*doubts, doubt)
    inline = name in INLINE
    path = above.path if inline else f"{above.path}/{name}{''.join('.' + m for m in marks)}"
    return _Element(name, path, out, article, inline, above.link or name == "a", doubts)


def page_blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, without what stands in left-out elements."""
    root = _Element("", "", False, False, False, False)
    stack, blocks = [root], []
    pieces: list[str] = []
    linked = 0
    outside = False  # an article, main or h1 that no comments hold
    quotes = _Quotes(page)

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].out and (not stack[-1].doubts or stack[-1].doubts == holder_doubts()):
            pieces.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())

    def holder_doubts() -> tuple:
        return next(e for e in reversed(stack) if not e.inline).doubts

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                holder = next(e for e in reversed(stack) if not e.inline)
                blocks.append(_Block(holder.path, holder.path.rpartition("/")[0], text, linked, holder.article, holder_doubts()))
            pieces.clear()
        linked = 0

    def close(index: int) -> None:
        if any(not e.inline for e in stack[index:]):
            flush()
        del stack[index:]

    def find_open(names: tuple[str, ...] | frozenset, barrier: frozenset = frozenset()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in barrier:
                return 0
        return 0

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            text_of(page[at:])
            break
        if tag > at:
            text_of(page[at:tag])
        after = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        if after in ("!", "?"):
            end = page.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        ends = after == "/"
        name_match = _NAME.match(page, tag + 2 if ends else tag + 1)
        if not name_match:
            if ends:  # HTML takes it for a comment
                end = page.find(">", tag)
                at = n if end < 0 else end + 1
            else:
                text_of("&lt;")
                at = tag + 1
            continue
        name = name_match[0].lower()
        end = quotes.tag_end(name_match.end())
        if end < 0:
            break  # a tag that never ends holds the rest of the page
        at = end + 1
        if ends:
            index = find_open((name,))
            if name == "p" and not index:
                flush()
            elif index and stack[index].inline and any(not e.inline for e in stack[index:]):
                del stack[index]  # an inline element never closes a block
            elif index:
                close(index)
            elif name == "br":
                text_of(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            elif name == "br":
                text_of(" ")
            continue
        source = page[name_match.end() : end]
        if name in CLOSED_BY_BLOCK and (index := find_open(("p",), CONTAINERS | frozenset(("td", "th", "button")))):
            close(index)
        if name in CLOSES and (index := find_open(CLOSES[name], CONTAINERS)):
            lowest = index
            while stack[lowest - 1].name in CLOSES[name]:
                lowest -= 1
            close(lowest)
        element = _opened(name, _attributes(source), stack[-1])
        if name in ("article", "main", "h1") and not element.out:
            outside = outside or not any(d.comments for d in element.doubts)
        if not element.inline:
            flush()
        if name in RAW:
            close_tag = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if not close_tag:
                break
            end = page.find(">", close_tag.end())
            at = n if end < 0 else end + 1
            continue
        if len(stack) < DEEPEST:
            stack.append(element)
    del stack[1:]
    flush()
    blocks = [b for b in blocks if not any(d.comments and (outside or not d.holds) for d in b.doubts)]
    return _undoubted(_undoubted(blocks, True), False)


def _undoubted(blocks: list[_Block], whole: bool) -> list[_Block]:
    """Blocks without those in elements with a mark (of the kind ``whole``) that are parts beside the article."""
    sizes: dict[_Doubt, int] = {}
    total = 0
    for b in blocks:
        size = len(b.text) - min(len(b.text), b.linked)
        total += size
        for d in b.doubts:
            sizes[d] = sizes.get(d, 0) + size
    left = {d for d, n in sizes.items() if d.whole == whole and (n < MAJOR * total or not n or (whole and not d.holds))}
    return [b for b in blocks if not left.intersection(b.doubts)] if left else blocks


def _smooth(values: list[float]) -> list[float]:
    """Each value with half of its neighbours' weight on either side."""
    out = []
    for i, v in enumerate(values):
        near = [values[j] for j in (i - 1, i + 1) if 0 <= j < len(values)]
        out.append((v + 0.25 * sum(near)) / (1 + 0.25 * len(near)))
    return out


def content_paths(blocks: list[_Block]) -> set[str]:
    """Paths whose fused ratio of text and punctuation per block reaches the threshold."""
    paths: dict[str, list[float]] = {}
    for b in blocks:
        own = paths.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        own[0] += len(b.text) - min(len(b.text), b.linked)
        own[1] += len(PUNCTUATION.findall(b.text))
        own[2] += 1
        own[3] = float(b.article)
    rows = list(paths.values())
    text = _smooth([r[0] / r[2] for r in rows])
    marks = _smooth([r[1] / r[2] for r in rows])
    scores = {}
    for path, r, t, m in zip(paths, rows, text, marks, strict=True):
        # long texts in few blocks and short ones in many both count, so the ratio goes with the root of the length
        fused = math.sqrt(r[0] * t) * (0.5 + math.sqrt(m + r[1] / r[2]))
        scores[path] = fused * (ARTICLE_WEIGHT if r[3] else 1.0) * (0.05 if not r[0] else 1.0)
    best = max(scores.values(), default=0.0)
    return {p for p, s in scores.items() if s >= CONTENT_SHARE * best}


def main_text(page: str) -> str:
    """The article of a page as one line; empty if there is none."""
    blocks = page_blocks(page)
    chosen = content_paths(blocks)
    holders = {b.parent for b in blocks if b.path in chosen}
    below = tuple(h + "/" for h in holders)

    def kept(b: _Block) -> bool:
        if b.path in chosen:
            return True
        beside = b.parent in holders or b.path in holders or b.path.startswith(below)
        return beside and b.linked < LINKED * len(b.text)

    return " ".join(b.text for b in blocks if kept(b))


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id, keep..., text`` of every row: the main text of the whole page.

    White space inside a block is one space; blocks are joined by one space in page order. A null or empty page, and one
    without any text outside of left-out elements, has the empty text. Broken markup is read as far as it goes; a
    tag or comment that never ends holds the rest of the page. Rows that repeat give rows that repeat. An empty table
    gives an empty one. Other columns are not read.
    """

    def work() -> Callable:
        def step(pages: list[str], part: pa.RecordBatch) -> dict:
            kept = {name: part.column(2 + i) for i, name in enumerate(keep)}
            return kept | {"text": pa.array([main_text(p) for p in pages], pa.string())}

        return step

    kinds = {name: df.schema[name].dataType.simpleString() for name in (id_col, *keep)}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items()) + ", text string"
    return map_texts(df, [F.col(id_col), F.col(html_col), *[F.col(k) for k in keep]], work, schema)
