"""Operator 3 - main text of web pages by a tree-structured graphical model.

A page becomes a DOM tree.  Every element is a binary variable, content or not, with a potential from its features
(tag, words of class and id, depth, text length, share of links, ...) and one for each parent-child edge.  Belief
propagation is exact on a tree: sum-product messages pass upward from leaves to root and back downward, level by
level for all pages of a block at once, and give every element's content marginal.  The weights are trained by
gradient ascent on the exact conditional likelihood of labelled pages, which are generated from a fixed seed
(``labelled_pages``; ``train_pages`` bounds their number) in many templates, so nothing is fitted to the input.

A piece of text is kept if its own element is content; pieces between two edges of block elements make a block.
Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by one line break.

Defined cases: null and empty pages, and pages without content, give the empty string; unclosed, stray and
misnested tags are repaired as browsers do in simple cases; an attribute's quote that is never closed ends with its
tag; ``svg`` and ``math`` are elements like others, so formulas in an article are kept; a repeated row is extracted again; an empty table gives
no rows; further columns are ignored.  Pages are independent: nothing is shuffled, memory holds one block of pages.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's element classes (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption button label".split())
#: An opening tag of the key closes an open element of the value (fixed values).
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]), "body": frozenset(["head"])}
#: Elements that say nothing of what stands around them, as they hold no text or never the main one: no edge leads
#: to them, nor to any element without text.
SILENT = VOID | RAW | frozenset(["button", "select", "option", "datalist", "object", "audio", "video", "canvas", "form", "nav", "aside"])
#: Beyond these no implied end tag reaches.
SCOPE = frozenset("html body div section article aside main table ul ol dl td th form nav header footer blockquote figure".split())

#: Comments, declarations and tags.  A quote that is never closed ends with its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACES = re.compile(r"\s+")
_NAME = re.compile(r"[A-Za-z]+")


class Page:
    """Elements in page order: ``tag``, ``names`` (words of class, id and role), ``parent``; and texts as
    ``(element, decoded text)`` in page order, with ``(element, None)`` where a block begins or ends."""

    def __init__(self, source: str):
        self.tag, self.names, self.parent = ["#root"], [""], [-1]
        self.flow: list[tuple[int, str | None]] = []
        stack = [0]
        at = 0
        size = len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else size
            if stop > at:
                self.flow.append((stack[-1], source[at:stop]))
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            for closed in CLOSES.get(tag, ()):
                self._imply(stack, closed)
            attrs = m[3] or ""
            names = " ".join(v or k for k, v in _ATTR.findall(attrs)).lower() if attrs else ""
            self.tag.append(tag)
            self.names.append(names)
            self.parent.append(stack[-1])
            own = len(self.tag) - 1
            if tag in BLOCK:
                self.flow.append((own, None))
            if tag == "br":
                self.flow.append((stack[-1], " "))
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:  # raw text up to its own end tag
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            stack.append(own)

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                for e in stack[:k - 1:-1]:
                    if self.tag[e] in BLOCK:
                        self.flow.append((e, None))
                del stack[k:]
                return
            if tag not in BLOCK and self.tag[stack[k]] in SCOPE:
                return

    def _imply(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                for e in stack[:k - 1:-1]:
                    if self.tag[e] in BLOCK:
                        self.flow.append((e, None))
                del stack[k:]
                return
            if self.tag[stack[k]] in SCOPE:
                return

    def text(self, content: np.ndarray) -> str:
        """Blocks of the texts whose element is content."""
        blocks, now = [], []
        for e, t in self.flow:
            if t is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif content[e]:
                now.append(t)
        if now:
            blocks.append("".join(now))
        done = (_SPACES.sub(" ", html_lib.unescape(b)).strip() for b in blocks)
        return "\n".join(b for b in done if b)


#: Words in class, id and role that tell regions apart (fixed values), a feature each.
HINTS = ("nav", "menu", "head", "foot", "side", "ad", "ads", "advert", "banner", "promo", "sponsor", "cookie", "notice", "consent", "alert", "comment", "reply", "discuss", "share", "social", "related", "recommend", "breadcrumb", "pagination", "form", "login", "search", "subscribe", "newsletter", "widget", "popup", "modal", "legal", "copyright", "tag", "article", "content", "main", "post", "entry", "story", "body", "text", "page", "hidden")
TAGS = ("html", "body", "head", "header", "footer", "nav", "aside", "article", "main", "section", "div", "form", "ul", "ol", "li", "p", "h1", "h2", "h3", "table", "tr", "td", "th", "a", "b", "strong", "em", "i", "span", "blockquote", "pre", "code", "figure", "figcaption", "button", "label", "select", "option", "input", "dl", "dt", "dd", "script", "style", "title")
_HASHED = 64
N_FEATURES = 1 + len(TAGS) + 1 + len(HINTS) + _HASHED + 8 + 3 + 4
_TAG_AT = {t: 1 + i for i, t in enumerate(TAGS)}
_HINT_AT = {h: 2 + len(TAGS) + i for i, h in enumerate(HINTS)}
_MAIN = re.compile(r"\b(?:article|content|main|post|entry|story)")
#: What a hint's word may be compounded with, before and after (fixed values).
BEFORE = frozenset("site page top main sub left right post entry blog user story inner global primary secondary mast nav".split())
AFTER = frozenset("s er ers bar box list area wrap wrapper container block section item items form thread links link row col panel group feed".split())


def _hint(word: str) -> str | None:
    """The hint that ``word`` is, alone or compounded with a word of the lists."""
    if word in _HINT_AT:
        return word
    for k in range(2, len(word) - 1 + 1):
        a, b = word[:k], word[k:]
        if a in _HINT_AT and b in AFTER or b in _HINT_AT and a in BEFORE:
            return a if a in _HINT_AT and b in AFTER else b
    return None


def _name_features(names: str) -> list[int]:
    out = set()
    for w in _NAME.findall(names):
        hit = _hint(w)
        out.add(_HINT_AT[hit] if hit else 2 + len(TAGS) + len(HINTS) + zlib.crc32(w.encode()) % _HASHED)
    return sorted(out)


_fixed: dict[tuple[str, str], list[int]] = {}


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse binary features of all elements as (element, feature) pairs, and which elements hold any text."""
    n = len(page.tag)
    chars, linked = np.zeros(n), np.zeros(n)
    for e, t in page.flow:
        if t:
            chars[e] += len(t)
    for e in range(n):
        if page.tag[e] == "a":
            linked[e] = chars[e]
    alone = chars.copy()
    for e in range(n - 1, 0, -1):  # children stand after their parents
        chars[page.parent[e]] += chars[e]
        linked[page.parent[e]] += linked[e]
    rows: list[int] = []
    cols: list[int] = []
    base = 2 + len(TAGS) + len(HINTS) + _HASHED
    framed = any(t in ("article", "main") for t in page.tag) or any(m and _MAIN.search(m) for m in page.names)
    for e in range(n):
        key = (page.tag[e], page.names[e])
        own = _fixed.get(key)
        if own is None:
            own = [0, _TAG_AT.get(key[0], 1 + len(TAGS)), *(_name_features(key[1]) if key[1] else ())]
            if len(_fixed) < 100_000:
                _fixed[key] = own
        own = [*own, base + min(3, int(chars[e] > 20) + int(chars[e] > 80) + int(chars[e] > 300))]
        if page.tag[e] not in BLOCK:
            own.append(base + 8)
        if not framed:  # a page whose blocks stand in its body
            own.append(base + 9 + (page.tag[page.parent[e]] in ("#root", "body")))
        own.append(base + 4 + (2 if linked[e] > 0.6 * chars[e] else 1 if linked[e] > 0.2 * chars[e] else 0) if chars[e] else base + 7)
        if alone[e]:
            own.append(base + 11 + min(2, int(alone[e] > 20) + int(alone[e] > 80)))
            if not framed and page.tag[e] in ("#root", "body"):
                own.append(base + 14)
        rows += [e] * len(own)
        cols += own
    return np.array(rows), np.array(cols), chars > 0


class Forest:
    """Trees of many pages end to end, with their elements by depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.first = np.append(0, np.cumsum(sizes)).astype(int)
        pairs = [features(p) for p in pages]
        joined = [[x + o if x >= 0 and held[e] and p.tag[e] not in SILENT else -1 for e, x in enumerate(p.parent)] for p, o, (_, _, held) in zip(pages, self.first, pairs, strict=False)]
        self.parent = np.array([x for own in joined for x in own], int)
        self.rows = np.concatenate([r + o for (r, _, _), o in zip(pairs, self.first, strict=False)]) if pages else np.zeros(0, int)
        self.cols = np.concatenate([c for _, c, _ in pairs]) if pages else np.zeros(0, int)
        depth = np.zeros(len(self.parent), int)
        for e, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[e] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element, and P(parent state, own state) of each edge, by sum-product messages."""
        n = len(self.parent)
        node = np.zeros((n, 2))
        node[:, 1] = np.bincount(self.rows, weights=weights[self.cols], minlength=n)
        up, to_parent = node.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):  # upward
            to_parent[level] = np.logaddexp(edge[None, :, 0] + up[level, None, 0], edge[None, :, 1] + up[level, None, 1])
            np.add.at(up, self.parent[level], to_parent[level])
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:  # downward
            p = self.parent[level]
            rest = up[p] + down[p] - to_parent[level]
            both = rest[:, :, None] + edge[None]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            j = both + up[level][:, None, :]
            j -= j.max(axis=(1, 2), keepdims=True)
            j = np.exp(j)
            joint[level] = j / j.sum(axis=(1, 2), keepdims=True)
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def labelled_pages(n: int, seed: int = 11) -> Iterator[tuple[Page, np.ndarray]]:
    """Generated pages with the label of every element: content where the article's own elements are."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    prose = lambda k: " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(k)).capitalize() + "."

    def links(k: int) -> str:
        return "<ul>" + "".join(f"<li><a href='#'>{prose(1)}</a></li>" for _ in range(k)) + "</ul>"

    def chrome() -> str:
        k = int(rng.integers(13))
        words = prose(int(rng.integers(2, 30)))
        outer, each, title = pick("section", "div"), pick("div", "article", "li"), pick("h1", "div", "p")
        return [
            lambda: f"<nav{pick('', ' class=menu', ' id=topnav')}>{links(int(rng.integers(2, 9)))}</nav>",
            lambda: f"<header{pick('', ' class=masthead')}><{title}>{prose(3)}</{title}>{links(3)}</header>",
            lambda: f"<footer{pick('', ' class=site-footer')}>&copy; {pick(words, f'<p>{words}</p>', links(4))}</footer>",
            lambda: f"<aside{pick('', ' class=sidebar', ' class=related')}><h3>{prose(2)}</h3>{pick(links(4), f'<p>{words}</p>')}</aside>",
            lambda: f"<div class=\"{pick('ad', 'ads', 'advert', 'ad-slot', 'banner', 'sponsored', 'promo')}\">{pick(words, f'<p>{words}</p>', f'<a href=x>{words}</a>')}</div>",
            lambda: f"<div class=\"{pick('cookie-notice', 'notice', 'consent-banner', 'alert', 'gdpr notice')}\"><p>{words}</p><button>{prose(1)}</button></div>",
            lambda: f"<form action=x{pick('', ' class=search', ' class=newsletter')}><label>{prose(2)}</label><input name=q>{pick('', f'<p>{words}</p>')}<button>{prose(1)}</button></form>",
            lambda: f"<{outer} class=\"{pick('comments', 'comment-list', 'discussion', 'replies')}\"><h2>{prose(1)}</h2>" + "".join(f"<{each} class=comment><p>{prose(int(rng.integers(4, 40)))}</p></{each}>" for _ in range(int(rng.integers(1, 5)))) + f"</{outer}>",
            lambda: f"<div class=\"{pick('sidebar', 'side-col', 'widget', 'related-posts', 'share', 'social')}\">{pick(links(5), f'<p>{words}</p>')}</div>",
            lambda: f"<div id=\"{pick('menu', 'nav', 'header', 'footer', 'breadcrumbs')}\">{pick(links(5), f'<p>{words}</p>', words, f'<h1>{prose(2)}</h1>')}</div>",
            lambda: f"<script>var x='<p>{words}</p>'</script><style>p{{margin:0}}</style>",
            lambda: f"<ul class=\"{pick('menu', 'nav', 'pagination', 'breadcrumb', 'tags')}\"><li><a href=x>{prose(1)}</a></li><li><a href=y>{prose(1)}</a></li></ul>",
            lambda: f"<noscript>{words}</noscript><div class=\"{pick('popup', 'modal', 'subscribe', 'login')}\"><p>{words}</p></div>",
        ][k]()

    mark = "data-c"
    odd = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 11)))

    def raw() -> str:
        return pick("<script>var x = '<p>no</p>'</script>", "<style>p{}</style>", "<textarea>note</textarea>", "<noscript>turn it on</noscript>", "<template><p>later</p></template>", "<iframe src=x></iframe>", "<img src=i>", "<select><option>one</select>", "<svg width=1 />")

    def inline() -> str:
        """Running words with inline markup; now and then a distractor stands among them."""
        words = prose(int(rng.choice([1, 2, 5, 20, 60, 120])))
        k = int(rng.integers(19))
        tag = pick("a", "b", "em", "i", "strong", "span", "sup", "sub", "code", "kbd", "mark", "time", "cite", "abbr", "q", "small", "u", "var", "font", "math", "ins", "dfn")
        if k < 6:
            return words
        if k < 11:
            return f"{words} <{tag} {mark}>{prose(2)}</{tag}> {prose(3)}"
        if k == 11:
            return f"<{tag} {mark}>{words}</{tag}>"
        if k == 12:
            return f"{words} <math {mark}><mi {mark}>x</mi><mo {mark}>=</mo><mn {mark}>2</mn></math> {prose(4)}"
        if k == 13:
            return f"{words} <a {mark} href=x><em {mark}>{prose(1)}</em></a>"
        if k == 14:
            return f"{words} <span class=\"{pick('ad', 'ads', 'advert', 'sponsored', 'promo', 'share', 'social-count')}\">{prose(int(rng.integers(1, 9)))}</span> {prose(3)}"
        if k == 15:
            return f"{words} <button{pick('', ' class=share')}>{prose(1)}</button>"
        if k == 16:  # mostly or only a link
            return f"{pick('', prose(1))} <a {mark} href=x>{prose(int(rng.integers(1, 9)))}</a> {pick('', prose(1))}"
        if k == 17:
            return f"{words} {raw()} {prose(int(rng.integers(1, 9)))}"
        return f"{prose(1)} <a {mark} href=x>{prose(3)}</a>, <a {mark} href=y>{prose(2)}</a> {pick('', prose(2))}"

    def body_block() -> str:
        k = int(rng.integers(19))
        words = inline()
        return [
            lambda: f"<p {mark}>{words}</p>", lambda: f"<p {mark}>{words}", lambda: f"<p {mark}>{words} <a {mark} href=x>{prose(2)}</a> {prose(4)}</p>", lambda: f"<p {mark}>{words}</p><p {mark}>{inline()}</p>",
            lambda: f"<h2 {mark}>{prose(3)}</h2>", lambda: f"<ul {mark}><li {mark}>{words}</li><li {mark}>{prose(4)}</li></ul>", lambda: f"<blockquote {mark}>{pick(words, f'<p {mark}>{words}</p>')}</blockquote>",
            lambda: f"<table {mark}><tr {mark}><td {mark}>{prose(1)}</td><td {mark}>{prose(2)}</td></tr></table>", lambda: f"<p {mark}><b {mark}>{words}</b> <em {mark}>{prose(2)}</em></p>",
            lambda: f"<p {mark}><b {mark}>{words}<br><p {mark}>{prose(8)}</p>", lambda: f"<div {mark}>{words}</div>", lambda: f"<h3 {mark}>{prose(2)}</h3><p {mark}>{words}</p>",
            lambda: f"<pre {mark}><code {mark}>{prose(9)}</code></pre><figure {mark}><img src=i><figcaption {mark}>{prose(4)}</figcaption></figure>",
            lambda: f"<{pick('ol', 'dl')} {mark}><{pick('li', 'dd')} {mark}><a {mark} href=x>{prose(2)}</a>, {prose(6)}",
            lambda: f"<{(t := pick('ul', 'ol'))} {mark}>" + "".join(f"<li {mark}><a {mark} href=x>{prose(int(rng.integers(1, 6)))}</a></li>" for _ in range(int(rng.integers(1, 6)))) + f"</{t}>",
            lambda: f"{raw()}<p {mark}>{words}</p>{raw()}", lambda: f"<{(t := pick('div', 'section', 'p', 'p'))} {mark} class='{odd()}'>{words}</{t}>", lambda: f"<p {mark}>{prose(int(rng.integers(1, 4)))}</p>",
            lambda: f"<div {mark}>" * (depth := int(rng.integers(1, 5))) + f"<p {mark}>{words}</p>" + "</div>" * depth,
        ][k]()

    for _ in range(n):
        blocks = [body_block() for _ in range(int(rng.choice([1, 1, 2, 3, 4, 8, 16])))]
        for _ in range(int(rng.choice([0, 0, 0, 1, 1, 2]))):  # adverts, forms or comments inside the article
            blocks.insert(int(rng.integers(len(blocks) + 1)), chrome())
        inner = (f"<h1 {mark}>{prose(4)}</h1>" if rng.random() < 0.6 else "") + "".join(blocks)
        if rng.random() < 0.08:
            inner = f"<header {mark}><h1 {mark}>{prose(5)}</h1></header>" + "".join(blocks)
        wrap = pick("<article {m}>{x}</article>", "<article {m} class='" + odd() + "'>{x}</article>", "<article {m} id='" + odd() + " " + odd() + "'>{x}</article>", "<article {m}>{x}</article>", "<article {m} class=post>{x}</article>", "<main {m}><article {m}>{x}</article></main>", "<main {m}>{x}</main>", '<div {m} class="content">{x}</div>', '<div {m} id="main">{x}</div>', '<div {m} class="post-body">{x}</div>', "<div {m} class='entry-content'>{x}</div>", "<section {m} class=story>{x}</section>", '<div {m} class="article-text"><div {m}>{x}</div></div>', "{x}")
        main = wrap.format(m=mark, x=inner)
        before, after = "".join(chrome() for _ in range(int(rng.integers(0, 4)))), "".join(chrome() for _ in range(int(rng.integers(0, 4))))
        middle = before + main + after
        if rng.random() < 0.3:
            middle = f"<div class=\"{pick('wrapper', 'container', 'row', 'page', '')}\">{middle}</div>"
        frame = float(rng.random())
        if rng.random() < 0.05:  # words that stand in the body itself
            loose = pick("{p}", "{p}<p {m}>{p}</p>", "{p}<br>{p}", "<h1 {m}>{p}</h1>{p}").format(p=prose(int(rng.integers(1, 40))), m=mark)
            source = pick(f"<html><body {mark}>{loose}{chrome()}</body></html>", f"<body {mark}>{loose}</body>", f"<html><head><title>{prose(2)}</title></head><body {mark}>{chrome()}{loose}")
        elif frame < 0.7:
            source = f"<!DOCTYPE html><html><head><title>{prose(3)}</title><style>p{{}}</style></head><body>{middle}</body></html>"
        else:  # fragments without a document around them
            source = middle if frame < 0.9 else f"<body>{middle}"
        page = Page(source)
        page_marks = _marks(source, mark)
        yield page, page_marks


def _marks(source: str, mark: str) -> np.ndarray:
    """Whether each element's tag carries ``mark``, in the order in which ``Page`` numbers elements."""
    out, at = [False], 0
    while m := _TOKEN.search(source, at):
        at = m.end()
        if m[2] is None or m[1]:
            continue
        tag = m[2].lower()
        out.append(mark in (m[3] or ""))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
    return np.array(out)


def train(train_pages: int = 1200, steps: int = 250, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and edges by Adam on the exact log-likelihood of ``train_pages`` generated pages."""
    pages, labels = zip(*labelled_pages(train_pages), strict=True)
    forest, y = Forest(list(pages)), np.concatenate(labels).astype(float)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[inner]].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p, joint = forest.marginals(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
        g = np.append(np.bincount(forest.cols, weights=(y - p)[forest.rows], minlength=N_FEATURES), (seen - joint[inner].sum(axis=0)).ravel())
        g = g / train_pages - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (1 - 0.95 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)


def extract(pages: list[str | None], weights: np.ndarray, edge: np.ndarray) -> list[str]:
    trees = [Page(p or "") for p in pages]
    forest = Forest(trees)
    content = forest.marginals(weights, edge)[0] > 0.5
    return [t.text(content[a:b]) for t, a, b in zip(trees, forest.first, forest.first[1:], strict=False)]


def main_text(pages: DataFrame, train_pages: int = 1200, block: int = 64) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``."""
    weights, edge = train(train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                texts = extract(part.column(2).to_pylist(), weights, edge)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
