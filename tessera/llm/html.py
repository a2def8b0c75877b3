"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A logistic classifier, fitted on the labelled pages below, gives each
block the cost of calling it content and of calling it boilerplate: the capacities of its edges to the two
terminals. Neighbours in page order and under one parent are tied by smoothness edges. The maximum flow
separates content from boilerplate at the least total cost.

What an element's name and attributes say against its text counts the less, the more of the page's text it
holds: a wrapper around nearly all of a page, or a form around it, says nothing.
"""

from __future__ import annotations

import math
import re
from collections import deque
from functools import cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, read_table

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Smoothness of neighbours in page order and of neighbours under one parent, in nats; capacities are thousandths.
NEXT, SIBLING, UNIT = 0.25, 0.35, 1000

#: Shares of a page's text without links from which on, and at which, a mark against an element fades out.
FADE = (0.5, 0.9)

# Fixed values of HTML: elements without an end, elements whose content isn't markup, elements whose content
# isn't shown as text, what may stand in a head, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe title textarea xmp noembed noframes".split())
SILENT = frozenset("template object svg math canvas audio video head select button".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the start of an element ends: these, if open within the element that holds them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("td", "th", "tr"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
INLINE_ENDS = frozenset("a b big code em font i s small span strike strong tt u mark sub sup label".split())
# Words of tag names, classes, ids and roles that speak for boilerplate or for content.
AGAINST = frozenset(
    "nav navbar navigation menu menus header head masthead topbar footer foot bottom sidebar aside rail notice notices alert cookie cookies consent gdpr banner ad ads adv advert adverts advertisement "
    "advertising adsense sponsor sponsored sponsors promo promotion form search login signup subscribe newsletter comment comments commentlist disqus reply replies respond discussion share sharing social "
    "related recommended breadcrumb breadcrumbs pagination pager popup modal overlay dialog toolbar widget widgets copyright legal skip hidden contentinfo complementary warning disclaimer tags".split()
)
#: Words that keep their full weight whatever the share, and words that make a layout's name of the words after them.
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
LAYOUT = frozenset("no has with without not non is hide show enable disable".split())
#: Words of elements that hold an article and no more; others of those in favour may hold a whole page.
ARTICLE = frozenset("article main post entry story".split())
FAVOUR = frozenset("article main content contents post entry story body text page blog news".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.DOTALL)
NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
STOPS = re.compile(r"[.!?,;:]")


class Element:
    __slots__ = ("tag", "parent", "own", "readers", "mark", "weight", "depth", "order", "form", "article", "masthead", "size", "favoured", "above")

    def __init__(self, tag: str, parent: Element | None, attributes: str, order: int):
        self.tag, self.parent, self.order, self.size, self.favoured = tag, parent, order, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        #: Elements around it that are marked as content, and with text those from it on downwards (`favoured`).
        self.above = parent.above + (parent.own > 0) if parent else 0
        self.own, self.readers, article = (0, False, False) if tag in ("body", "html") else marks(tag, attributes)
        self.article = article or bool(parent and parent.article)
        # An article's own header holds its title: headings there aren't spoken against.
        self.masthead = tag == "header" and self.article or bool(parent and parent.masthead)
        self.mark, self.weight, self.form = 0, 0.0, 0.0

    def settle(self, root: Element) -> None:
        """Weigh what is said against the element by its share of the page; its parent is settled before it.

        Where text elsewhere is marked as content, the weight is full.
        """
        parent, (start, end) = self.parent, FADE
        weight = 1.0
        if root.favoured == self.favoured + self.above:
            weight = min(max((end - self.size / max(root.size, 1)) / (end - start), 0.0), 1.0)
        # The innermost element that says something counts.
        if self.own > 0:
            self.mark, self.weight = 1, 1.0
        elif self.own < 0 and (self.readers or weight):
            self.mark, self.weight = -1, 1.0 if self.readers else weight
        elif parent:
            self.mark, self.weight = parent.mark, parent.weight
        self.form = max(parent.form if parent else 0.0, weight if self.tag in ("form", "fieldset", "label") else 0.0)


@cache
def word_marks(names: str) -> tuple[int, bool, bool]:
    """What class names, ids and roles say, and whether they speak of readers' comments and of an article."""
    words: set[str] = set()
    for name in names.split():
        for w in PART.findall(name):
            if w.lower() in LAYOUT:
                break
            words.add(w.lower())
    against = bool(words & AGAINST)
    return -1 if against else int(bool(words & FAVOUR)), bool(words & READERS), not against and bool(words & ARTICLE)


def marks(tag: str, attributes: str) -> tuple[int, bool, bool]:
    """-1 if an element's name or attributes speak for boilerplate, 1 for content, 0 for neither; whether of readers' comments; whether it is an article."""
    article = tag in ("article", "main")
    if attributes and not attributes.isspace():
        names = []
        for key, a, b, c in NAMES.findall(attributes):
            value, key = a or b or c, key.lower()
            if key in ("class", "id", "role"):
                names.append(value)
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return -1, False, article
        if names and (m := word_marks(" ".join(names)))[0]:
            return m[0], m[1], m[2] or article
    if article:
        return 1, False, True
    return -1 if tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog", "search") else 0, False, False


class Block:
    __slots__ = ("text", "element", "linked", "heading", "order")

    def __init__(self, text: str, element: Element, linked: int, heading: bool):
        self.text, self.element, self.linked, self.heading = text, element, linked, heading


def blocks_of(html: str) -> list[Block]:
    """Blocks of shown text in page order; white space within each is one space. Those within a form are left out."""
    root = Element("", None, "", 0)
    stack, every, out, parts = [root], [root], [], []
    linked, in_link, silent, at, n = 0, 0, 0, 0, len(html)
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                heading = top.tag in HEADINGS
                holder = top
                while holder.tag in INLINE_ENDS and holder.parent:
                    holder = holder.parent
                    heading = heading or holder.tag in HEADINGS
                out.append(Block(text, holder, min(linked, len(text)), heading))
            parts.clear()
        linked = 0

    def close(index: int) -> None:
        nonlocal in_link, silent
        for e in stack[index:]:
            in_link -= e.tag == "a"
            silent -= e.tag in SILENT
        del stack[index:]

    def close_last(tags: tuple[str, ...], but: tuple[str, ...] = ()) -> None:
        """Close the innermost of these elements, unless one of the others is open within it."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in but:
                return
            if stack[k].tag in tags:
                close(k)
                return

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", html, re.IGNORECASE)), default=-1)
        return last_end[tag] >= at

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            if not silent:
                parts.append(html[at:])
            break
        if m.start() > at:
            piece = html[at : m.start()]
            if silent and stack[-1].tag == "head" and not piece.isspace():
                close(len(stack) - 1)
            if not silent:
                parts.append(piece)
                if in_link:
                    linked += len(piece.strip())
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE_ENDS and stack[k].tag in BLOCK:
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if silent:
            # As in browsers: a block ends a drawing or a choice that was left open, and what is no part of a head ends it.
            if tag not in IN_HEAD:
                close_last(("head",))
            if tag in BLOCK:
                close_last(("svg", "math"), ("foreignobject",))
                close_last(("select",))
            if tag == "button":
                close_last(("button",))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
            if end is None and tag == "title":
                continue
            at = end.end() if end else n
            if tag in ("textarea", "title"):
                flush()
            continue
        if tag in SILENT:
            if tag in ("head", "select"):
                flush()
            # Without an end to come, what follows is the page's text.
            if not ends_later(tag) and tag != "head" or attributes.endswith("/") and tag in ("svg", "math"):
                continue
            silent += 1
        if tag == "br" or tag == "wbr":
            if tag == "br" and not silent:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            # A paragraph can't hold a block; inline elements left open there end with it.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE_ENDS:
                    break
            if tag in ENDS:
                ended, within = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in within:
                        break
                    if stack[k].tag in ended:
                        close(k)
                        if tag != "tr":
                            break
        if tag in VOID:
            continue
        if tag == "body" or tag == "html":
            if any(e.tag == tag for e in stack):
                continue
        stack.append(Element(tag, stack[-1], attributes, len(every)))
        every.append(stack[-1])
        if tag == "a":
            in_link += 1
    flush()
    for b in out:
        b.element.size += len(b.text) - b.linked
    for e in reversed(every):
        e.favoured += e.own > 0 and e.size > 0
        if e.parent:
            e.parent.size += e.size
            e.parent.favoured += e.favoured
    for e in every:
        e.settle(root)
    return [b for b in out if b.element.form < 1]


def features(b: Block) -> list[float]:
    """What the classifier sees of a block: its marks, length, links, punctuation and kind."""
    e, n = b.element, len(b.text)
    against = max(e.weight if e.mark < 0 and not (e.masthead and b.heading) else 0.0, e.form)
    sentence = bool(STOPS.search(b.text[-1]))
    return [
        1.0,
        1.0 if e.mark > 0 else 0.0,
        against,
        min(math.log1p(n), 6.0) / 6.0,
        b.linked / n,
        1.0 if sentence else 0.0,
        1.0 if b.heading else 0.0,
        1.0 if e.tag in ("li", "td", "th", "dt", "dd") else 0.0,
        1.0 if e.tag in ("p", "blockquote", "pre") else 0.0,
        1.0 if e.article and b.heading else 0.0,
    ]


# Labelled pages that the classifier is fitted on. Blocks that begin with "+" are content.
PAGES = (
    """<html><head><title>x</title></head><body><header><h1>-The Daily</h1><p>-News since 1900.</p></header><nav><ul><li><a href=/>-Home</a></li><li><a href=/s>-Sport</a></li><li>-Contact</li></ul></nav>
    <article><h1>+A bridge reopens after three years</h1><p>+The bridge over the river was opened to traffic on Monday, after repairs that took three years.</p><p>+Yes.</p>
    <p>+Engineers replaced <a href=/c>the cables</a> and most of the deck, the city said.</p><ul><li>+Two new lanes for bicycles</li><li>+A wider footpath</li></ul>
    <aside class=related><h3>-Read more</h3><p>-Ten bridges you should see before you die.</p></aside><p>+The next inspection is due in ten years.</p></article>
    <div class=ad><p>-Buy one now, and get one free. Offer ends on Sunday.</p></div><section id=comments><h2>-Comments</h2><p>-I crossed it this morning and it was very fine indeed, thank you all.</p></section>
    <footer><p>-Copyright 2020 The Daily. All rights reserved.</p></footer></body></html>""",
    """<body><div class="cookie-notice">-We use cookies to make this site better. By staying you agree.</div><div id="menu"><a href=a>-Start</a> <a href=b>-Products</a></div>
    <div id="content"><h2>+How to keep bees</h2><p>+Bees need water, shelter and flowers. Place the hive where it gets sun in the morning.</p><blockquote>+A quiet hive is a happy hive.</blockquote>
    <p>+Feed them in winter.</p><table><tr><td>+March</td><td>+Clean the hive</td></tr></table></div><div class="sidebar"><h3>-Archive</h3><ul><li><a href=1>-2019</a></li><li><a href=2>-2018</a></li></ul>
    <p>-Subscribe to our letter and never miss a post again.</p></div><div class="footer">-Imprint. Terms of use.</div></body>""",
    """<body><ul><li><a href=1>-About us</a></li><li><a href=2>-Jobs</a></li><li><a href=3>-Press</a></li></ul><div><h1>+Notes on tides</h1>
    <p>+The tide rises and falls twice a day, because the earth turns below the bulges that the moon and the sun raise in the sea.</p><p>+Where a bay narrows, the water has nowhere to go but up, and the range can pass ten metres.</p>
    <p>+See the tables.</p></div><p><a href=p>-Previous</a> <a href=n>-Next</a></p><p>-Contact | Privacy</p></body>""",
    """<body><main><header><h1>+Bread without kneading</h1></header><p>+Mix flour, water, salt and a little yeast.</p><p>+Wait.</p><h2>+Baking</h2><p>+Heat a heavy pot in the oven, and bake the dough in it for forty minutes.</p>
    <div class="share-buttons"><span>-Share this on your page.</span></div><div class="newsletter"><p>-Get our best recipes by mail, every week, for free.</p></div><p>+Let it cool before you cut it.</p></main>
    <aside><p>-Sponsored: knives that stay sharp for a lifetime, from our partners.</p><h4>-Popular</h4></aside><footer><ul><li>-Help</li><li>-Imprint</li></ul></footer></body>""",
)


@cache
def weights() -> tuple[float, ...]:
    """The classifier: logistic regression by Newton steps with a little ridge, on the labelled pages."""
    rows, labels = [], []
    for page in PAGES:
        for b in blocks_of(page):
            labels.append(1.0 if b.text[0] == "+" else 0.0)
            b.text = b.text[1:]
            rows.append(features(b))
    x, y = np.array(rows), np.array(labels)
    w, ridge = np.zeros(x.shape[1]), 0.05
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return tuple(np.round(w, 6).tolist())


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stand with the source in a minimum cut. Capacities are whole numbers, edges go both ways.

    A node whose terminals differ by more than all its edges together stands with the larger one in every
    minimum cut; such nodes are settled first, and their edges become capacities of their neighbours.
    Augmenting paths then decide the rest.
    """
    n = len(source)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    to_source, to_sink = list(source), list(sink)
    side: list[bool | None] = [None] * n
    open_sum = [sum(d.values()) for d in near]
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if side[k] is not None or abs(to_source[k] - to_sink[k]) <= open_sum[k]:
            continue
        side[k] = to_source[k] > to_sink[k]
        for j, c in near[k].items():
            if side[j] is None:
                (to_source if side[k] else to_sink)[j] += c
                open_sum[j] -= c
                todo.append(j)
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        # Residual capacities by node; -1 is the source, -2 the sink.
        flow: dict[int, dict[int, int]] = {k: {j: c for j, c in near[k].items() if side[j] is None} for k in rest}
        flow[-1], flow[-2] = {k: to_source[k] for k in rest}, {}
        for k in rest:
            flow[k][-2], flow[k][-1] = to_sink[k], 0
            flow[-2][k] = 0
        while True:
            came, queue = {-1: -1}, deque([-1])
            while queue and -2 not in came:
                k = queue.popleft()
                for j, c in flow[k].items():
                    if c > 0 and j not in came:
                        came[j] = k
                        queue.append(j)
            if -2 not in came:
                break
            path, j = [], -2
            while j != -1:
                path.append((came[j], j))
                j = came[j]
            push = min(flow[a][b] for a, b in path)
            for a, b in path:
                flow[a][b] -= push
                flow[b][a] += push
        for k in rest:
            side[k] = k in came
    return [bool(s) for s in side]


def label(found: list[Block]) -> list[bool]:
    """Whether each block is content."""
    w = weights()
    source, sink = [], []
    for b in found:
        z = sum(map(float.__mul__, w, features(b)))
        # -log p and -log(1 - p): the cost of calling it boilerplate is paid if it is content, and the other way round.
        source.append(int(UNIT * min(math.log1p(math.exp(min(z, 30.0))), 20.0)))
        sink.append(int(UNIT * min(math.log1p(math.exp(min(-z, 30.0))), 20.0)))
    edges, last = [], {}
    for k, b in enumerate(found):
        e = b.element
        group = (e.parent or e).order if e.tag in BLOCK else e.order
        if k:
            p = found[k - 1].element
            # Page neighbours are the closer, the nearer their depths; marks that contradict each other cut the tie.
            if p.mark * e.mark >= 0:
                edges.append((k - 1, k, int(UNIT * NEXT / (1 + abs(p.depth - e.depth)))))
        if (j := last.get((group, e.mark))) is not None:
            edges.append((j, k, int(UNIT * SIBLING)))
        last[group, e.mark] = k
    return minimum_cut(source, sink, edges)


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by empty lines; null and empty pages have none."""
    if not html:
        return ""
    found = blocks_of(html)
    return "\n\n".join(b.text for b, keep in zip(found, label(found), strict=True) if keep) if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text and n_chars, the text's code points.

    Pages that are null, empty or without content: empty text and 0. Null ids and addresses and repeated
    rows stay; other columns are not read. No rows in: no rows out. Elements left open end as in browsers
    where a block, an ancestor's end or their like follows; drawings, buttons and the like that never end
    hide nothing, while scripts, styles and other raw text that never end hide the rest, as there.
    """

    def make():
        def run(batch):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_batches(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")), SCHEMA, make)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over pages: one row a page, whole pages; null and empty pages have no text."""
    return extract(read_table(spark, sf_dir, "pages"))
