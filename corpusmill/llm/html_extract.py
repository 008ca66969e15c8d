"""Operator 5: main text of web pages by minimum-cut labelling.

A page is read once, from left to right, into a tree of elements; the text between two block-level
tags is a block. A classifier (logistic regression over place, names, tag, length, link share and
sentence marks) gives each block a cost for either label. Positive log odds are the capacity from
the content terminal, negative ones that to the boilerplate terminal. Neighbouring blocks, and blocks of one parent, are joined
by smoothness edges that weaken with their distance in the tree. The minimum cut between the
terminals, found by maximum flow, labels all blocks; content blocks are given in page order.

The classifier is trained here, on labelled blocks of pages that ``training_pages`` writes from a
seed: articles in many containers, among menus, notices, adverts, comments and forms with many
names. No page of the table to be read is among them.

An element named after a sidebar, a comment or the like holds boilerplate, whatever stands inside,
unless it wraps the page: it holds all of the page's main headings or articles and most of its text.
Names that only tell a state (``has-sidebar``, ``comments-open``) tell nothing of a place.

Null or empty html: empty text. Scripts, styles, comments, hidden elements and everything in the
head are no blocks. Broken markup: a tag that is cut off at the page's end is dropped, unknown end
tags are ignored, open elements end with the page or with the element around them; a raw element without its end tag
(but script and style) ends at the next tag; a quote that is not closed ends with its tag. Reading
takes time in proportion to the page, however long. No block is dropped or cut for its length;
equal scores on both sides of the cut: boilerplate. Other columns are dropped; repeated rows stay.
"""

from __future__ import annotations

import random
import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.batches import append
from corpusmill.session import spread

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)\s*(=\s*)?""")
PLAIN_VALUE = re.compile(r"[^\s>]*")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Their content is text to the parser, up to their end tag.
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())
#: Ordinary elements whose content is not read.
UNSEEN = frozenset("noscript template svg object select option button canvas math audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption head".split()
)
SPACED = frozenset(["td", "th", "br"])
#: An opening tag of the key ends an open element of these kinds that has no other block inside.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",)}

KINDS = ("plain", "content", "header", "nav", "foot", "side", "ad", "notice", "comments", "share", "form", "unseen")
_KIND = {kind: i for i, kind in enumerate(KINDS)}
#: Kinds of places by element, and by a word of class, id or role.
BY_TAG = {
    "article": "content", "main": "content", "header": "header", "nav": "nav", "menu": "nav", "footer": "foot", "aside": "side",
    "dialog": "notice", "form": "form", "fieldset": "form", "head": "unseen", "address": "foot",
}
BY_NAME = {
    name: kind
    for kind, names in {
        "content": "article articles content post entry story main text maintext articlebody body prose",
        "header": "header masthead topbar logo branding",
        "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sitemap skip",
        "foot": "footer foot copyright colophon legal disclaimer contentinfo imprint",
        "side": "sidebar side aside widget widgets complementary related recommended trending popular teaser teasers",
        "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted outbrain taboola",
        "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay subscribe newsletter signup paywall toast",
        "comments": "comment comments commentlist disqus reply replies respond responses",
        "share": "share sharing social follow",
        "form": "form login search",
    }.items()
    for name in names.split()
}
#: Names with one of these words tell a state.
STATES = frozenset("with has have no not without open opened closed enabled disabled is show hide allow js off on".split())
FEATURES = len(KINDS) + 12
SMOOTH = 0.9


@dataclass
class Block:
    """Text between two block-level tags. ``place``: number of its element."""

    text: str
    linked: int
    place: int


@dataclass
class Page:
    """Blocks, and for each element its parent, depth, tag and kind (0: none of its own)."""

    blocks: list[Block]
    parent: list[int]
    depth: list[int]
    tag: list[str]
    kind: list[int]


def kind_of(tag: str, attributes: list[tuple[str, str]]) -> int:
    """The kind of place that an element opens by its own tag and names."""
    own = _KIND[BY_TAG[tag]] if tag in BY_TAG else 0
    found = []
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return _KIND["unseen"]
        if name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                parts = {w.lower() for w in NAME_WORDS.findall(token)} | {token.lower()}
                kinds = {BY_NAME[w] for w in parts if w in BY_NAME}
                bad = kinds - {"content"}
                if bad and not parts & STATES:
                    found.append(min(bad))
                elif kinds and not bad:
                    found.append("content")
    bad = sorted(k for k in found if k != "content")
    if bad and tag not in ("body", "html", "main", "article"):
        return _KIND[bad[0]] if own in (0, _KIND["content"], _KIND["header"]) else own
    if found and own == 0 and tag not in ("body", "html"):
        return _KIND["content"]
    return own


class _Reader:
    """Reads a page in one pass. Each search for a sign starts behind the last one of its kind."""

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.lower: str | None = None
        self.next_end: dict[str, int] = {}
        self.none_left: set[str] = set()

    def find(self, sign: str, at: int) -> int:
        """Position of ``sign`` from ``at`` on, or the page's end."""
        if sign in self.none_left:
            return self.size
        found = self.html.find(sign, at)
        if found < 0:
            self.none_left.add(sign)
            return self.size
        return found

    def end_tag(self, tag: str, at: int) -> int:
        """Where the next end tag of ``tag`` begins, or -1."""
        known = self.next_end.get(tag, 0)
        if known < 0 or known >= at and known:
            return known
        if self.lower is None:
            # characters that grow in lower case would move all positions behind them
            self.lower = "".join(c.lower() if c < "\x80" else c for c in self.html) if not self.html.isascii() else self.html.lower()
        sign = f"</{tag}"
        found = self.lower.find(sign, at)
        while found >= 0 and self.lower[found + len(sign) : found + len(sign) + 1] not in ("", ">", "/", " ", "\n", "\t", "\r", "\f"):
            found = self.lower.find(sign, found + 1)
        self.next_end[tag] = found
        return found

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """(name, value) pairs of a tag, whether it closes itself, and the place behind it."""
        html, found = self.html, []
        while True:
            match = ATTRIBUTE.match(html, at)
            if match is None:
                end = self.find(">", at)
                return found, html[end - 1 : end] == "/", min(end + 1, self.size)
            name, at = match[1].lower(), match.end()
            if not match[2]:
                found.append((name, ""))
                continue
            quote = html[at : at + 1]
            if quote not in ('"', "'") or not quote:
                value = PLAIN_VALUE.match(html, at)
                found.append((name, value[0]))
                at = value.end()
                continue
            close = self.find(quote, at + 1)
            end = html.find(">", at + 1, close) if close < self.size else self.find(">", at + 1)
            if close == self.size or (end >= 0 and html[close - 1] == "="):  # the quote was not closed
                return found, False, min(end + 1, self.size)
            found.append((name, html[at + 1 : close]))
            at = close + 1


def read_page(html: str) -> Page:
    page = Page([], [-1], [0], [""], [0])
    reader, size = _Reader(html), len(html)
    stack, open_tags = [0], {}
    parts: list[str] = []
    linked, in_link, unseen, at = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            parts.clear()
            if text:
                page.blocks.append(Block(text, min(linked, len(text)), stack[-1]))
        linked = 0

    def pop() -> None:
        nonlocal unseen
        node = stack.pop()
        open_tags[page.tag[node]] -= 1
        unseen -= page.kind[node] == _KIND["unseen"]

    def close(tag: str) -> None:
        if open_tags.get(tag):
            while page.tag[stack[-1]] != tag:
                pop()
            pop()

    def push(tag: str, kind: int) -> None:
        nonlocal unseen
        page.parent.append(stack[-1])
        page.depth.append(page.depth[stack[-1]] + 1)
        page.tag.append(tag)
        page.kind.append(kind)
        stack.append(len(page.tag) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        unseen += kind == _KIND["unseen"]

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not unseen:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    while at < size:
        sign = reader.find("<", at)
        text(html[at:sign])
        if sign == size:
            break
        if html.startswith("<!--", sign):
            at = sign + 5 if html.startswith("<!-->", sign) else reader.find("-->", sign + 4) + 3
            continue
        if html[sign + 1 : sign + 2] in ("!", "?"):
            at = reader.find(">", sign) + 1
            continue
        closing = html[sign + 1 : sign + 2] == "/"
        name = TAG_NAME.match(html, sign + 1 + closing)
        if name is None:
            text(html[sign])
            at = sign + 1
            continue
        tag = name[0].lower()
        if closing:
            at = reader.find(">", name.end()) + 1
            if tag == "a":
                in_link = False
            elif tag in BLOCK or tag in UNSEEN:
                if tag in BLOCK:
                    flush()
                close(tag)
            continue
        attributes, self_closed, at = reader.attributes(name.end())
        if tag in RAW:
            end = reader.end_tag(tag, at)
            if end >= 0:
                at = reader.find(">", end) + 1
            else:
                at = size if tag in ("script", "style") else reader.find("<", at)
        elif tag in UNSEEN:
            if not self_closed and reader.end_tag(tag, at) >= 0:
                push(tag, _KIND["unseen"])
        elif tag == "a":
            in_link = True
        elif tag in SPACED:
            text(" ")
        elif tag in BLOCK:
            flush()
            in_link = False
            if tag == "body":
                close("head")
            while page.tag[stack[-1]] in ("p", "button", "select", "option"):
                pop()
            if page.tag[stack[-1]] in ENDS.get(tag, ()):
                pop()
            if tag not in VOID:
                push(tag, kind_of(tag, attributes))
    flush()
    return page


def places(page: Page) -> list[int]:
    """The kind of place that each element stands in: the nearest of its own and those around it.

    Boilerplate stays boilerplate whatever stands inside, but for elements that wrap the page.
    """
    n = len(page.tag)
    length, heads, bodies = [0] * n, [0] * n, [0] * n
    for block in page.blocks:
        length[block.place] += len(block.text)
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        length[up] += length[i]
        heads[up] += heads[i] + (page.tag[i] == "h1")
        bodies[up] += bodies[i] + (page.tag[i] in ("article", "main"))
    content, header, comments = _KIND["content"], _KIND["header"], _KIND["comments"]
    out = [0] * n
    for i in range(1, n):
        own, around = page.kind[i], out[page.parent[i]]
        if own not in (0, content, _KIND["unseen"]) and 2 * length[i] > length[0]:
            all_heads = heads[0] and heads[i] == heads[0]
            if all_heads or (bodies[0] and bodies[i] == bodies[0] and own != comments):
                own = 0
        if own == header and around == content:
            own = content  # the head of an article
        out[i] = around if around not in (0, content, header) or own == 0 else own
        if around == header and own == content:
            out[i] = header
    return out


#: Marks that end a sentence.
_ENDS = frozenset(".!?:\"'»”…。！？")


def features(page: Page) -> np.ndarray:
    """One row for each block: what the classifier sees."""
    kinds = places(page)
    anywhere = any(kinds[b.place] == 1 for b in page.blocks)
    rows = np.zeros((len(page.blocks), FEATURES))
    for row, block in zip(rows, page.blocks, strict=True):
        n, kind, tag = len(block.text), kinds[block.place], page.tag[block.place]
        row[kind] = 1.0
        row[len(KINDS) :] = (
            anywhere and kind == 0, min(1.0, n / 60), min(1.0, n / 300), block.linked / n, block.linked == n,
            n > 25 and block.text[-1] in _ENDS, tag == "p", tag in ("h1", "h2", "h3", "h4"), tag == "li", tag in ("blockquote", "pre"),
            "©" in block.text, block.text[-1] in _ENDS,
        )
    return rows


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut (least content side on ties).

    A node's positive score is its capacity from the source, a negative one that to the sink; edges
    hold their capacity both ways. A node with more capacity to its terminal than all its edges hold
    is on that side of any minimum cut; such nodes are settled first. The rest is cut by blocking
    flows in graphs of shortest paths (Dinic).
    """
    left = [round(s * 1000) for s in scores]
    n = len(left)
    around: list[dict[int, int]] = [{} for _ in left]
    for a, b, weight in edges:
        capacity = round(weight * 1000)
        if a != b and capacity > 0:
            around[a][b] = around[a].get(b, 0) + capacity
            around[b][a] = around[b].get(a, 0) + capacity
    side: list[bool | None] = [None] * n
    wait = deque(range(n))
    while wait:
        i = wait.popleft()
        if side[i] is None and abs(left[i]) > sum(around[i].values()):
            side[i] = left[i] > 0
            for j, capacity in around[i].items():  # the neighbour has the edge to that terminal now
                del around[j][i]
                left[j] += capacity if side[i] else -capacity
                wait.append(j)
            around[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    content = _flow({i: left[i] for i in rest}, {i: around[i] for i in rest})
    return [i in content if known is None else known for i, known in enumerate(side)]


def _flow(left: dict[int, int], around: dict[int, dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow. ``left`` and ``around`` are used up."""
    while True:
        level = {i: 0 for i, s in left.items() if s > 0}
        queue, met = deque(level), False
        while queue:
            a = queue.popleft()
            met = met or left[a] < 0
            for b, capacity in around[a].items():
                if capacity > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if not met:
            return set(level)
        arcs = {a: iter([b for b in around[a] if level.get(b) == level[a] + 1]) for a in level}
        for source in [a for a, depth in level.items() if depth == 0]:
            path = [source]
            while left[source] > 0 and path:
                a = path[-1]
                if left[a] < 0:
                    flow = min(left[source], -left[a], *(around[x][y] for x, y in zip(path, path[1:], strict=False)))
                    left[source] -= flow
                    left[a] += flow
                    cut = len(path)
                    for at in range(len(path) - 1, 0, -1):
                        x, y = path[at - 1], path[at]
                        around[x][y] -= flow
                        around[y][x] += flow
                        if around[x][y] == 0:
                            cut = at
                    del path[cut:]
                    continue
                b = next(arcs[a], None)
                if b is None:
                    path.pop()
                elif around[a][b] > 0:
                    path.append(b)


def _distance(page: Page, a: int, b: int, most: int = 8) -> int:
    """Steps between two elements of the tree; ``most`` + 1 if they are more."""
    steps = 0
    while a != b and steps <= most:
        if page.depth[a] < page.depth[b]:
            a, b = b, a
        a, steps = page.parent[a], steps + 1
    return steps


def edges_of(page: Page) -> list[tuple[int, int, float]]:
    """Neighbours in page order by their distance in the tree, and blocks of one parent."""
    edges, blocks = [], page.blocks
    for i in range(1, len(blocks)):
        near = _distance(page, blocks[i - 1].place, blocks[i].place)
        if near <= 8:
            edges.append((i - 1, i, SMOOTH * 0.6 ** max(0, near - 2)))
    last: dict[int, int] = {}  # blocks of one parent are near even if others stand between
    for i, block in enumerate(blocks):
        parent = max(0, page.parent[block.place])
        if last.get(parent, i) < i - 1:
            edges.append((last[parent], i, SMOOTH * 0.4))
        last[parent] = i
    return edges


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    page = read_page(html) if html else None
    if page is None or not page.blocks:
        return ""
    scores = features(page) @ (classifier() if weights is None else weights)
    content = min_cut(scores.tolist(), edges_of(page))
    return "\n".join(b.text for b, keep in zip(page.blocks, content, strict=True) if keep)


#: Stands before each text of a training page that is content.
_MARK = ""


def training_pages(n: int, seed: int) -> list[str]:
    """Pages with articles in many containers among many kinds of boilerplate; content texts carry ``_MARK``."""
    rng = random.Random(seed)
    letters = "abcdefghilmnoprstuvéäñß"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 1, high: int = 25) -> str:
        return words(low, high).capitalize() + rng.choice(["."] * 8 + ["!", "?", ""])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 1, 2, 4, 8])))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def named(names: str, inside: str, tags: str = "div section") -> str:
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">{inside}</{tag}>'

    def content(text: str, tag: str) -> str:
        return f"<{tag}>{_MARK}{text}</{tag}>"

    def boilerplate() -> str:
        return rng.choice([
            lambda: f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>",
            lambda: named("menu main-nav navbar breadcrumbs pagination", f"<ul>{links(rng.randint(1, 6))}</ul>"),
            lambda: f"<footer>&copy; {words(1, 4)} &middot; {sentence()} {sentence()}</footer>",
            lambda: named("footer site-footer copyright legal", f"<p>&copy; {paragraph()}</p>"),
            lambda: f"<header><h2>{words(1, 3)}</h2><p>{sentence()}</p></header>",
            lambda: named("masthead header logo topbar", f"<p>{sentence()}</p>"),
            lambda: f"<aside><h3>{words(1, 3)}</h3><p>{paragraph()}</p><ul>{links(3)}</ul></aside>",
            lambda: named("sidebar related widget recommended", f"<h3>{words(1, 3)}</h3><p>{paragraph()}</p><ul>{links(2)}</ul>"),
            lambda: named("ad ads advert banner-ad sponsored promo", f"{'<p>' * rng.randint(0, 1)}{paragraph()}"),
            lambda: named("cookie-notice consent alert newsletter popup subscribe", f"<p>{paragraph()}</p>"),
            lambda: named("share social-links follow", f"<ul>{links(3)}</ul>{words(1, 3)}"),
            lambda: f"<form><p>{sentence()}</p>{words(1, 3)}<input name=q></form>",
            lambda: named("search login", f"<p>{sentence()}</p>"),
            lambda: f'<dialog open><p>{paragraph()}</p></dialog>',
            lambda: f'<p style="display: none">{paragraph()}</p>',
        ])()

    def outside() -> str:
        return rng.choice(["<div>{}</div>", "<p>{}</p>", "<span>{}</span>", "<div><a href=/>{}</a></div>"]).format(words(1, 6))

    def comments() -> str:
        one = rng.choice(["<p>{}</p>", "<article><p>{}</p></article>", '<div class="comment-body"><p>{}</p></div>'])
        return named("comments comment-list disqus replies", "".join(one.format(paragraph()) for _ in range(rng.randint(1, 4))))

    def body() -> str:
        out = [content(words(2, 10), "h1") if rng.random() < 0.8 else ""]
        for _ in range(rng.choice([1, 2, 3, 6, 12])):
            out.append(rng.choice([lambda: content(paragraph(), "p")] * 8 + [
                lambda: content(words(1, 6), "h2"), lambda: content(paragraph(), "blockquote"), lambda: content(words(4, 40), "pre"),
                lambda: content(f"{words(1, 5)} {rng.choice('©|#*%')} {words(1, 5)}", "p"), lambda: content(words(1, 4), "p"),
                lambda: f"<ul>{''.join(content(sentence(), 'li') for _ in range(3))}</ul>",
                lambda: f"<table><tr><td>{_MARK}{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>",
                lambda: f"<figure><img src=x>{content(sentence(), 'figcaption')}</figure>",
                lambda: content(f'{paragraph()} <a href="/x">{words(1, 4)}</a> {sentence()}', "p"),
            ])())
            if rng.random() < 0.12:
                out.append(rng.choice([boilerplate, comments])())
        return "".join(out) + (comments() if rng.random() < 0.3 else "")

    pages = []
    for _ in range(n):
        hold = rng.choice([
            "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>',
            '<div id="main">{}</div>', '<div class="post entry">{}</div>', '<section class="story">{}</section>', "<div>{}</div>", "{}",
            '<div class="wrap has-sidebar"><article>{}</article></div>', '<div class="sidebar"><main>{}</main></div>', "<form><article>{}</article></form>",
        ])
        before, after = ("".join(boilerplate() for _ in range(rng.randint(0, 3))) for _ in range(2))
        if "article" in hold or "main" in hold:
            before, after = before + outside() * rng.randint(0, 1), after + outside() * rng.randint(0, 1)
        pages.append(f"<html><head><title>{words(1, 4)}</title></head><body>{before}{hold.format(body())}{after}</body></html>")
    return pages


def labelled_blocks(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: content) of the blocks of training pages."""
    rows, labels = [], []
    for html in pages:
        page = read_page(html)
        labels += [float(b.text.startswith(_MARK)) for b in page.blocks]
        for block in page.blocks:
            block.text = block.text.lstrip(_MARK) or "."
        rows.append(features(page))
    return np.concatenate(rows), np.array(labels)


@lru_cache(maxsize=1)
def classifier(pages: int = 400, seed: int = 11, ridge: float = 0.3) -> np.ndarray:
    """Weights of the log odds of content: ridge logistic regression by Newton steps."""
    x, y = labelled_blocks(training_pages(pages, seed))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points) for each page."""
    weights = classifier()

    def run(values):
        texts = [main_text(v, weights) for v in values]
        return texts, [len(t) for t in texts]

    rows = spread(pages.select(key, url, html))
    return append(rows, [html], [("text", T.StringType()), ("n_chars", T.LongType())], lambda: run).drop(html)
