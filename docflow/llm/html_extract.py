"""Main text of web pages by minimum-cut labelling.

A page becomes a row of blocks (runs of text between block-level tags). A classifier's costs are the
capacities to the terminals: what it costs to call the block boilerplate, and to call it content.
Smoothness edges join blocks that are neighbours in the page, and siblings under one parent with nothing
but other blocks' text between them; calling one content and the other not costs their weight. The
minimum cut, found by maximum flow, is the labelling of least total cost.

The classifier is logistic, over a block's ancestors (tags, and words of their class, id and role) and
its text. Its weights are fixed values below (there are no labelled blocks to train on). Elements that carry
no article by HTML's own rules (menus, asides, forms, scripts, page headers and footers, an article inside an
article, hidden elements) have a cost no cut will pay. Names are evidence: a whole class or id of such words
(sidebar, comments) weighs more than one as a part of a name (left-sidebar, entry-header), and neither weighs
anything on wrappers around the article or most of the page's text, nor a part in a title's header.

One scan, nothing is shuffled; pages do not meet. Tags, open elements and names are looked up in time
linear in the page, whatever its markup. Defined results: a null or empty page has empty text and 0 characters;
repeated rows are extracted alike; broken markup is closed as browsers do; where a quote in a tag never ends,
tags end at the next ``>``; an empty table gives an empty table; other columns are not read; pages of any
length are taken whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<]+)|(<)", re.S)
#: The same where quotes do not count.
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+)|(<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
ASCII_LOWER = str.maketrans(UPPER, LOWER)

# How HTML elements behave.
RAW = frozenset("script style textarea title template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("table ul ol dl article section div main body nav aside header footer td th".split())

# Markup that carries no article text, whatever its words.
NEVER = frozenset("nav aside form button input label fieldset script style noscript template iframe svg math canvas object select option textarea title head dialog menu".split())
BAD = (
    r"(?:ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"pagination|pager|sidebar|side-bar|aside|widget|widgets|rail|related|recommended|recommendations|trending|popular|share|sharing|social|follow|newsletter|subscribe|subscription|signup|login|comment|comments|comment-list|commentlist|disqus|"
    r"reply|replies|respond|discussion|footer|foot|site-footer|header|site-header|masthead|topbar|copyright|legal|disclaimer|skip-link|skip|toolbar|search|tags|tag-cloud|byline-share)"
)
#: Fixed: words that say where an element is, beside such a word.
PLACE = r"(?:section|block|box|area|container|wrapper|wrap|inner|outer|top|bottom|left|right|main|list|item|items|title|heading|bar|panel|group|[0-9]+)"
#: A whole class or id of such words, and such a word beside others in one.
NAMES, PARTS = re.compile(rf"(?:{PLACE}[\s_-]+)*{BAD}(?:[\s_-]+(?:{BAD}|{PLACE}))*"), re.compile(rf"(?:^|[\s_-]){BAD}(?:$|[\s_-])")
#: Parts that a title's element may have inside an article.
TITLE = re.compile(r"(?:^|[\s_-])(?:header|heading|title|masthead)(?:$|[\s_-])")
GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|page-content|article-body|post-body|entry-content)(?:$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# The classifier's weights, in nats for content, and the weights of the smoothness edges.
WEIGHTS = {"bias": -0.4, "in_article": 3.0, "in_main": 2.0, "good_name": 1.2, "heading": 0.6, "paragraph": 1.0, "per_log_word": 0.35, "sentence": 0.8, "link_share": -4.0, "link_share_in_article": 1.8, "list_item": -0.8, "symbol_only": -1.0, "bad_part": -4.5, "bad_name": -9.0}
NEIGHBOUR, SIBLING, NEVER_COST = 0.6, 0.4, 1e6


class Doubt(NamedTuple):
    """An element whose name speaks against its text: its number, the next such element around it, and whether the whole name does."""

    number: int
    around: "Doubt | None"
    whole: bool


class State(NamedTuple):
    """What an element gives to the text in it; article: the outermost article's number."""

    never: bool = False
    article: int = 0
    main: bool = False
    good: bool = False
    doubt: Doubt | None = None


class Open(NamedTuple):
    """An open element; block, paragraph, cell: where in the stack the nearest block element, p or scope, and list part or list stand."""

    tag: str
    state: State
    number: int
    block: int
    paragraph: int
    cell: int


class Block:
    __slots__ = ("parts", "linked", "state", "bad", "tag", "parent")

    def __init__(self, tag: str, state: State, parent: int):
        self.parts, self.linked, self.state, self.tag, self.parent, self.bad = [], 0, state, tag, parent, 0.0


#: What an end of a list part is looked for among, and where the search stops.
CELLS = frozenset(x for ends in CLOSES.values() for x in ends) | {"ul", "ol", "dl", "table"}
WHOLE = frozenset(("body", "html", "main", "article", "h1"))


def inside(name: str, attributes: str, state: State, number: int) -> State:
    """The state inside a new element."""
    never, article, main, good, doubt = state
    if never:
        return state
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
    role = found.get("role", "").lower()
    # Attributes of whole-page wrappers say nothing about the text in them.
    if name in NEVER or name == "footer" or name == "header" and not article or name == "article" and article:
        return state._replace(never=True)
    if role in ROLES and name not in WHOLE or found.get("aria-hidden") == "true" or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return state._replace(never=True)
    names = [x for x in (found.get("class", "").lower().strip(), found.get("id", "").lower().strip()) if x]
    if names:
        good = good or any(GOOD.search(x) for x in names)
        if name not in WHOLE and any(PARTS.search(x) for x in names):
            titled = article and (name == "header" or any(TITLE.search(x) for x in names))
            whole = not titled and any(NAMES.fullmatch(x) for x in names)
            if whole or not titled:
                doubt = Doubt(number, doubt, whole)
    if not article and (name == "article" or role == "article"):
        article = number
    return State(False, article, main or name == "main" or role == "main", good, doubt)


def blocks_of(page: str) -> list[tuple[str, Block]]:
    """(text, block) in page order; texts are decoded, with white space as single spaces, and never empty."""
    stack = [Open("", State(), 0, 0, 0, 0)]
    count: dict[str, int] = {}
    around: dict[int, Doubt | None] = {}
    out: list[Block] = []
    current: Block | None = None
    serial = 0
    at, end, closed = 0, len(page), page.rfind(">")
    token = TOKEN
    lower = None

    def leave(depth: int) -> None:
        nonlocal current
        for x in stack[depth:]:
            count[x.tag] -= 1
            if x.tag in BLOCK:
                current = None
        del stack[depth:]

    while at < end:
        if at > closed and page.find("<!--", at) != at:  # no tag ends any more: the rest is text
            closing, name, attributes, text, at = "", None, "", page[at:], end
        else:
            m = token.match(page, at)
            if m[5] and token is TOKEN and page[at + 1 : at + 2].isascii() and page[at + 1 : at + 2].isalpha():
                # A quote in this tag never ends. It is looked for once: from here on quotes do not count.
                token = LOOSE
                m = token.match(page, at)
            closing, name, attributes, text, angle = m.groups()
            at, text = m.end(), text or angle
        if name is None:
            if text is None:
                continue
            if current is None:
                if text.isspace():
                    continue
                top = stack[-1]
                near = stack[top.block]
                current = Block(near.tag, top.state, near.number)
                out.append(current)
            current.parts.append(text)
            if count.get("a"):
                current.linked += len(text)
            continue
        name = name.lower()
        if closing:
            if count.get(name):
                # What is passed on the way down is closed, so every element is passed once.
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name))
            elif name == "p":
                current = None
            continue
        if name in RAW:
            if lower is None:
                # Lower case of A-Z only, so that positions stay.
                lower = page.translate(ASCII_LOWER)
            stop = lower.find("</" + name, at)
            at = end if stop < 0 else (page.find(">", stop) + 1 or end)
            if name in BLOCK or name == "textarea":
                current = None
            continue
        if name == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                current = None
            continue
        if name in ENDS_P and stack[stack[-1].paragraph].tag == "p":
            leave(stack[-1].paragraph)
        for other in CLOSES.get(name, ()):
            # Between two lists or tables there is at most one open part of each kind.
            depth = stack[-1].cell if count.get(other) else 0
            while depth and stack[depth].tag != other:
                depth = 0 if stack[depth].tag in ("ul", "ol", "dl", "table") else stack[depth - 1].cell
            if depth:
                leave(depth)
        serial += 1
        state = inside(name, attributes, stack[-1].state, serial)
        if state.article == serial:
            around[serial] = state.doubt
        if name in BLOCK:
            current = None
        count[name] = count.get(name, 0) + 1
        top, here = stack[-1], len(stack)
        stack.append(Open(name, state, serial, here if name in BLOCK else top.block, here if name == "p" or name in SCOPE else top.paragraph, here if name in CELLS else top.cell))
    done = []
    for b in out:
        text = SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()
        if text:
            done.append((text, b))
    _doubt(done, around)
    return done


def _doubt(found: list[tuple[str, Block]], around: dict[int, Doubt | None]) -> None:
    """Sets what names say against blocks. Wrappers say nothing: elements around the largest article, or with over half of the page's text."""
    held, known, articles, whole = {}, {}, {}, 0
    for text, b in found:
        if not b.state.never:
            n = max(0, len(text) - b.linked)
            whole += n
            if b.state.doubt:
                held[b.state.doubt.number] = held.get(b.state.doubt.number, 0) + n
            x = b.state.doubt
            while x and x.number not in known:
                known[x.number] = x
                x = x.around
            if b.state.article:
                articles[b.state.article] = articles.get(b.state.article, 0) + n
    if not known:
        return
    # An element's text is that of the elements in it too; those have higher numbers.
    for number in sorted(known, reverse=True):
        if known[number].around:
            outer = known[number].around.number
            held[outer] = held.get(outer, 0) + held.get(number, 0)
    wrappers = {number for number, n in held.items() if 2 * n > whole}
    x = around[max(articles, key=articles.get)] if articles else None
    while x:
        wrappers.add(x.number)
        x = x.around
    against: dict[int, float] = {}
    for number in sorted(known):
        own = 0.0 if number in wrappers else WEIGHTS["bad_name" if known[number].whole else "bad_part"]
        against[number] = min(own, against[known[number].around.number] if known[number].around else 0.0)
    for _, b in found:
        if b.state.doubt and not b.state.never:
            b.bad = against[b.state.doubt.number]


def costs(text: str, block: Block, has_article: bool) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content): the two negative log-likelihoods of the classifier."""
    if block.state.never:
        return 0.0, NEVER_COST
    w, state = WEIGHTS, block.state
    words = text.count(" ") + 1
    z = w["bias"] + w["per_log_word"] * math.log1p(words)
    z += w["in_article"] * (1.0 if state.article else -1.0 if has_article else 0.0) + w["in_main"] * state.main + w["good_name"] * state.good + block.bad
    z += w["heading"] * (block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")) + w["paragraph"] * (block.tag in ("p", "blockquote", "pre")) + w["list_item"] * (block.tag == "li")
    z += w["sentence"] * (text[-1] in ".!?…\"'”’") + (w["link_share"] + w["link_share_in_article"] * bool(state.article)) * min(1.0, block.linked / max(1, len(text))) + w["symbol_only"] * (not any(map(str.isalnum, text)))
    return math.log1p(math.exp(min(z, 50.0))), math.log1p(math.exp(min(-z, 50.0)))


def minimum_cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut; keep: capacities from the source, drop: to the sink. Dinic's algorithm."""
    n = len(keep)
    flow = [min(a, b) for a, b in zip(keep, drop, strict=True)]  # paths source, node, sink at once
    source, sink = [a - f for a, f in zip(keep, flow, strict=True)], [b - f for b, f in zip(drop, flow, strict=True)]
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, c in edges:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(c)
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if source[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or sink[i] > tiny
            for e in head[i]:
                j = to[e]
                if level[j] < 0 and cap[e] > tiny:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            while source[start] > tiny and level[start] == 0:
                path, i = [], start
                while True:
                    if sink[i] > tiny:
                        push = min([source[start], sink[i], *(cap[e] for e in path)])
                        source[start] -= push
                        sink[i] -= push
                        for e in path:
                            cap[e] -= push
                            cap[e ^ 1] += push
                        break
                    while at[i] < len(head[i]):
                        e = head[i][at[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        at[i] += 1
                    if at[i] < len(head[i]):
                        path.append(head[i][at[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        at[i] += 1
                    else:
                        break
                if at[start] >= len(head[start]) and sink[start] <= tiny:
                    break


def content_of(page: str) -> list[str]:
    """The texts of the blocks labelled content."""
    found = blocks_of(page)
    if not found:
        return []
    has_article = any(b.state.article and not b.state.never for _, b in found)
    prices = [costs(t, b, has_article) for t, b in found]
    edges, last = [], {}
    for i, (_, b) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEIGHBOUR))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    side = minimum_cut([p[0] for p in prices], [p[1] for p in prices], edges)
    return [t for (t, b), kept in zip(found, side, strict=True) if kept and not b.state.never]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, pages in slices(batches, "html"):
        texts = ["\n\n".join(content_of(p.decode())) if p else "" for p in pages]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
