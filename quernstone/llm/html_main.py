"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into its structural elements (implied end tags as browsers put them), each described by its tag,
attribute words, depth, text and link density of its subtree, and how it stands among its siblings. Boosted trees,
trained here on generated pages of many layouts, give each node the probability of belonging to the main text. The
decoding is hierarchical: along each path from the root a page may enter the main text once and leave it once, so
no node contradicts the choices above and below it; a dynamic programme over the tree finds the best such choice.
The text of the chosen nodes is given block by block.

Training needs no corpus, only the generator and its seed; the model is a few kilobytes. Pages are judged one by
one within their tasks, nothing is shuffled.

Parsing follows browsers: optional tags are implied (head, body, paragraphs, list items, cells), text outside the body
belongs to it, attribute values may hold quotes, unclosed scripts and comments run to the end. Formulas, buttons,
fallback texts of objects and the like are text of their block; scripts, styles, templates, frames, titles and the
options and contents of form fields are not.

Edge cases: null, empty or text-free html gives an empty text of 0 characters; unclosed and stray tags, comments and
truncated pages are read as far as they go, a tag that the end cuts off is dropped; a page of text without tags is all
main text or none; repeated rows are each extracted; nulls in other columns stay; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExtractParams:
    pages: int = 260  # generated training pages
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    seed: int = 7


# --- the tree ---------------------------------------------------------------------------------------------------

#: Attributes as browsers read them: a value is quoted, or runs to the next white space and may hold quotes.
ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
TOKEN = re.compile(rf"<!---?>|<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
STRUCTURE = frozenset(
    "html body main article section div header footer nav aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog center hgroup menu".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page. Scripts and styles run to their end tag, the others at most to the next structural tag.
SILENT = frozenset("script style template iframe title select textarea".split())
NEXT = re.compile(rf"</?(?:{'|'.join(sorted(STRUCTURE))})(?=[\s/>])", re.I)
#: Elements that an opening tag of the key ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


@dataclass
class Page:
    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    words: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])  # of class, id, role and the like
    hidden: list[bool] = field(default_factory=lambda: [False])
    mark: list[int | None] = field(default_factory=lambda: [None])  # of training pages
    runs: list[tuple[int, str, int]] = field(default_factory=list)  # owner, text of a block, characters in links


def after_silent(source: str, name: str, at: int) -> int:
    """Where reading goes on after the opening tag of a silent element."""
    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
    if name in ("script", "style"):
        return end.end() if end else len(source)
    stop = NEXT.search(source, at) if name != "template" or not end else None
    if end and (name in ("title", "textarea", "iframe") or not stop or end.start() < stop.start()):
        return end.end()
    return stop.start() if stop else len(source)


def parse(source: str) -> Page:
    page = Page()
    stack, text, linked = [0], [], 0
    link: int | None = None  # depth of the stack at an open link

    def push(name: str, words: frozenset[str] = frozenset(), hidden: bool = False, mark: str = "") -> None:
        page.tag.append(name)
        page.parent.append(stack[-1])
        page.words.append(words)
        page.hidden.append(hidden)
        page.mark.append(int(mark) if mark in ("0", "1") else None)
        stack.append(len(page.tag) - 1)

    def flush() -> None:
        nonlocal linked
        block = " ".join("".join(text).split())
        if block:
            if page.tag[stack[-1]] in ("#root", "html"):
                push("body")  # implied, as in browsers
            page.runs.append((stack[-1], block, min(linked, len(block))))
        text.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if link is not None:
                linked += len(raw.strip())

    at = 0
    while m := TOKEN.search(source, at):  # from the end of each silent stretch: what begins in one is no token
        put(source[at : m.start()])
        at = m.end()
        name, closing = (m[2] or "").lower(), bool(m[1])
        if not name:
            continue
        if name in SILENT:
            if not closing:
                at = after_silent(source, name, at)
            continue
        if name not in STRUCTURE:
            if name == "a":
                link = None if closing else len(stack)
            elif name == "hr":
                flush()
                if page.tag[stack[-1]] == "p":
                    stack.pop()
            elif name in ("br", "img"):
                text.append(" ")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if name in ("html", "body"):  # what comes after belongs to the body all the same
                    if page.tag[stack[i]] == "body":
                        del stack[i + 1 :]
                        break
                elif page.tag[stack[i]] == name:
                    del stack[i:]
                    break
                if name == "p" and page.tag[stack[i]] not in ("p", *HEADINGS):
                    break
        elif name in ("html", "body") and any(page.tag[i] in ("body", name) for i in stack):
            continue
        else:
            if page.tag[stack[-1]] == "p" or (name in HEADINGS and page.tag[stack[-1]] in HEADINGS):
                stack.pop()
            if name in ENDS:
                for i in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[i]] in HOLDS[name]:
                        break
                    if page.tag[stack[i]] in ENDS[name]:
                        del stack[i:]
                        break
            if name not in ("html", "body") and page.tag[stack[-1]] in ("#root", "html"):
                push("body")
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])}
            raw = " ".join(attrs.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
            words = frozenset(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", raw).lower()))
            push(name, words, "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower(), attrs.get("data-y", ""))
        if link is not None and len(stack) < link:
            link = None
    rest = source[at:]
    cut = rest.rfind("<")  # a tag that the page's end cuts off
    put(rest[:cut] if cut >= 0 and ">" not in rest[cut:] and re.match(r"<[/!?]?[a-zA-Z]|<[/!?]", rest[cut:]) else rest)
    flush()
    return page


# --- features ---------------------------------------------------------------------------------------------------

GOOD = frozenset("article content post entry main story text body blog page".split())
BAD = frozenset(
    "ad ads adv advert advertisement banner sponsor sponsored promo promotion nav navigation navbar menu sidebar side footer foot header masthead breadcrumb breadcrumbs crumbs cookie cookies notice consent gdpr alert popup modal newsletter subscribe signup related recommended more share social widget login search form tags tool tools toolbar copyright legal skip pager pagination".split()
)
TALK = frozenset("comment comments reply replies discussion disqus respond commentlist feedback reactions reader responses".split())
CHROME = frozenset("nav footer aside form menu".split())


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    own, links, runs, points = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for owner, block, linked in page.runs:
        own[owner] += len(block)
        links[owner] += linked
        runs[owner] += 1
        points[owner] += block.count(".") + block.count(",")
    parent = page.parent
    sub, sub_links, sub_points, tags, paras, depth = own.copy(), links.copy(), points.copy(), np.ones(n), np.array([t == "p" for t in page.tag], float), np.zeros(n)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        sub[p] += sub[i]
        sub_links[p] += sub_links[i]
        sub_points[p] += sub_points[i]
        tags[p] += tags[i]
        paras[p] += paras[i]
    good, bad, talk, chrome = (np.zeros(n) for _ in range(4))
    above = np.zeros((n, 4))
    place, count, same, last_at = np.zeros(n), np.zeros(n), np.zeros(n), {}
    before = np.zeros(n)
    for i in range(n):
        w = page.words[i]
        good[i], bad[i], talk[i], chrome[i] = bool(w & GOOD), bool(w & BAD), bool(w & TALK), page.tag[i] in CHROME or page.hidden[i]
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = np.maximum(above[p], (good[p] or page.tag[p] in ("article", "main"), bad[p], talk[p], chrome[p]))
            place[i] = count[p]
            count[p] += 1
            if p in last_at:
                q = last_at[p]
                before[i] = sub_links[q] / max(1.0, sub[q])
                same[i] = page.tag[q] == page.tag[i]
            last_at[p] = i
    par = np.array(parent)
    par[0] = 0
    total = max(1.0, sub[0])
    kind = lambda *names: np.array([t in names for t in page.tag], float)
    return np.stack(
        [
            kind("article"), kind("main"), kind("section"), kind("div"), kind("header"), kind("p"), kind(*HEADINGS), kind("li", "ul", "ol", "dl", "dt", "dd"), kind("table", "tr", "td", "th"), kind("body", "html", "#root"),
            chrome, good, bad, talk, above[:, 0], above[:, 1], above[:, 2], above[:, 3],
            depth, np.log1p(own), np.log1p(sub), sub_links / np.maximum(1, sub), sub / tags, 100 * sub_points / np.maximum(1, sub), np.log1p(paras), sub / total,
            sub / np.maximum(1, sub[par]), place, count[par], before, same, runs,
        ],
        1,
    )


# --- boosted trees ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees in arrays; node k of a tree goes to 2k+1 (not above the cut) or 2k+2."""

    base: float
    feature: np.ndarray  # [trees, inner nodes]
    cut: np.ndarray
    leaf: np.ndarray  # [trees, leaves]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: ExtractParams) -> Boosted:
    """Logistic gradient boosting with Newton leaves over quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, params.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    f, inner = np.full(len(y), base), 2**params.depth - 1
    feature, cut, leaf = (np.zeros((params.trees, k)) for k in (inner, inner, inner + 1))
    for t in range(params.trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf)
            if len(rows) > 20:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, c[k])
            feature[t, node], cut[t, node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        at -= inner
        leaf[t] = params.rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        f += leaf[t, at]
    return Boosted(base, feature.astype(np.int64), cut, leaf)


# --- training pages ---------------------------------------------------------------------------------------------


def training_page(r: random.Random) -> str:
    """A page of a random layout; data-y marks where the main text begins (1) and where in it something else does (0)."""
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "le", "de", "ung", "que", "ció", "st", "ment", "a", "en", "in")) for _ in range(r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    noise = lambda t: re.sub(" ", lambda m: r.choice(("%%% ", "*** ", "&amp;&amp; ")), t) if junk else t
    sentence = lambda: noise(some(3, 18)).capitalize() + r.choice(".!?...")
    junk = r.random() < 0.1
    para = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5))))
    anchors = lambda k: [f'<a href="/{word()}">{some(1, 3)}</a>' for _ in range(k)]
    plain = lambda: f"c{r.randint(1, 99)}"

    def named(options: str) -> str:
        return r.choice((f'class="{r.choice(options.split())}"', f'id="{r.choice(options.split())}"', f'class="{plain()} {r.choice(options.split())}"'))

    def menu() -> str:
        items = "".join(f"<li>{a}</li>" if r.random() < 0.9 else f"<li>{a}" for a in anchors(r.randint(2, 9)))
        return r.choice((f"<nav><ul>{items}</ul></nav>", f"<div {named('menu nav navbar navigation')}><ul>{items}</ul></div>", f"<ul {named('menu nav')}>{items}</ul>", f"<nav>{' | '.join(anchors(4))}</nav>"))

    def advert() -> str:
        return r.choice((f"<div {named('ad ads advert banner sponsored promo')}>{sentence()}</div>", f"<aside {named('ad promo')}><p>{sentence()}</p></aside>", f"<div {named('ad sponsor')}><p>{para()}</p>{anchors(1)[0]}</div>"))

    def notice() -> str:
        return r.choice((f"<div {named('cookie notice consent alert gdpr popup')}><p>{sentence()}</p></div>", f'<div role="alert">{sentence()}</div>', f"<div {named('notice newsletter subscribe')}>{para()}</div>", f"<p {named('notice alert')}>{sentence()}</p>"))

    def sidebar() -> str:
        inside = "".join(r.choice((f"<h3>{some(1, 3)}</h3><ul>{''.join(f'<li>{a}</li>' for a in anchors(3))}</ul>", f"<p>{sentence()}</p>", advert())) for _ in range(r.randint(1, 3)))
        return r.choice((f"<aside>{inside}</aside>", f"<div {named('sidebar side widget related recommended')}>{inside}</div>", f"<section {named('related sidebar')}>{inside}</section>"))

    def search() -> str:
        return f"<form><label>{some(1, 4)}</label><input name='q'><p>{some(2, 8)}</p><button>{word()}</button></form>"

    def talk() -> str:
        one = lambda: r.choice((f"<div {named('comment reply')}><p><b>{word()}</b></p><p>{para()}</p></div>", f"<li {named('comment')}>{para()}</li>", f"<article {named('comment')}><p>{para()}</p></article>", f"<p>{word()}: {para()}</p>"))
        inside = f"<h2>{r.choice(('Comments', 'Discussion', some(1, 2)))}</h2>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6)))
        return r.choice((f"<section {named('comments discussion')}>{inside}</section>", f"<div {named('comments commentlist responses reader-comments')}>{inside}</div>", f"<ol {named('comments commentlist')}>{inside}</ol>"))

    def off(block: str) -> str:
        return re.sub(r"^<(\w+)", r'<\1 data-y="0"', block)

    title = some(2, 8)
    body = []
    for _ in range(r.choice((1, 2, 4, 8, 14, 25))):
        kind = r.random()
        if kind < 0.72:
            body.append(r.choice((f"<p>{para()}</p>", f"<p>{para()}</p>", f"<p>{para()}", f"<p><b>{para()}<br>", f"<p>{para()} {anchors(1)[0]} {sentence()}</p>", f"<p>{some(1, 2)}.</p>", f"<div>{para()}</div>")))
        elif kind < 0.8:
            body.append(f"<h2>{some(1, 6)}</h2>")
        elif kind < 0.88:
            body.append(r.choice((f"<ul>{''.join(f'<li>{some(2, 12)}</li>' for _ in range(r.randint(2, 5)))}</ul>", f"<ol>{''.join(f'<li><p>{sentence()}</p></li>' for _ in range(3))}</ol>")))
        elif kind < 0.94:
            body.append(r.choice((f"<blockquote><p>{para()}</p></blockquote>", f"<pre>{some(4, 20)}</pre>", f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>", f"<section><h3>{some(1, 4)}</h3><p>{para()}</p></section>")))
        else:
            body.append(f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>")
    for extra, chance in ((advert, 0.25), (notice, 0.12), (sidebar, 0.1), (search, 0.08), (menu, 0.08)):
        if r.random() < chance:
            body.insert(r.randint(0, len(body)), off(extra()))
    head = f"<h1>{title}</h1>"
    head = r.choice((head, head, f"<header>{head}</header>", f"<header>{head}<p>{some(1, 4)}</p></header>", ""))
    inner = head + "".join(body) + (off(talk()) if r.random() < 0.15 else "")
    inner += off(f"<footer>{' '.join(anchors(2))}</footer>") if r.random() < 0.12 else ""
    main = r.choice((f'<article data-y="1">{inner}</article>',) * 3 + (f'<main data-y="1">{inner}</main>', f'<main><article data-y="1">{inner}</article></main>', f'<div data-y="1" {named("content post entry article story main-content body-text")}>{inner}</div>', f'<div data-y="1" {named("content post entry")}>{inner}</div>', f'<div data-y="1" class="{plain()}">{inner}</div>', f'<section data-y="1" {named("article story")}>{inner}</section>'))
    if r.random() < 0.1:  # a layout table: links in one cell, the main text in another
        cells = [f"<td>{r.choice(('<br>', ' ')).join(anchors(r.randint(1, 6)))}</td>", f'<td data-y="1">{inner}</td>']
        main = f"<table><tr>{''.join(cells if r.random() < 0.7 else cells[::-1])}</tr></table>"
    elif r.random() < 0.35:
        main = f'<div class="{r.choice(("wrap", "container", "page", plain()))}">{main}{sidebar() if r.random() < 0.5 else ""}</div>'
    above = [f() for f, chance in ((menu, 0.85), (advert, 0.5), (notice, 0.3), (search, 0.2)) if r.random() < chance]
    r.shuffle(above)
    if r.random() < 0.5:
        bar = f"<p>{some(1, 4)}</p>" + "".join(above[:1])
        above[:1] = [r.choice((f"<header>{bar}</header>", f"<div {named('header masthead')}>{bar}</div>"))]
    below = [f() for f, chance in ((sidebar, 0.4), (talk, 0.4), (advert, 0.3), (notice, 0.15), (search, 0.1)) if r.random() < chance]
    below.append(r.choice((f"<footer>&copy; {some(1, 3)} {para()}</footer>", f"<div {named('footer copyright legal')}><p>{para()}</p></div>", f"<footer><p>{sentence()}</p>{' '.join(anchors(3))}</footer>")) if r.random() < 0.9 else "")
    top = r.choice((f"<head><title>{title}</title><style>p{{}}</style></head>", f"<head><title>{title}</title>", ""))
    if r.random() < 0.12:  # no element around the main text
        inner = r.choice((inner, inner, f"{para()}<br>{para()}", f"{head}{para()}<p>{para()}"))
        return f'<html>{top}<body data-y="1">{"".join(map(off, above))}{inner}{"".join(map(off, filter(None, below)))}</body></html>'
    return f"<!DOCTYPE html><html>{top}<body>{''.join(above)}{main}{''.join(below)}</body></html>"


def training_labels(page: Page) -> np.ndarray:
    """1 for the nodes of the main text: the nearest mark above says so."""
    out = np.zeros(len(page.tag))
    for i in range(1, len(page.tag)):
        out[i] = out[page.parent[i]] if page.mark[i] is None else page.mark[i]
    return out


@lru_cache(maxsize=4)
def model(params: ExtractParams) -> Boosted:
    r = random.Random(params.seed)
    xs, ys, ws = [], [], []
    for _ in range(params.pages):
        page = parse(training_page(r))
        x = features(page)
        xs.append(x)
        ys.append(training_labels(page))
        ws.append(weights(x))
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws), params)


def weights(x: np.ndarray) -> np.ndarray:
    """What a node's own text is worth; nodes without any still count a little."""
    return 0.3 + x[:, 19] / 4


# --- decoding ---------------------------------------------------------------------------------------------------


def decode(page: Page, margin: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which nodes are main text: on each path outside, then inside, then outside again."""
    n = len(page.tag)
    inside, outside = -np.logaddexp(0, -margin) * weight, -np.logaddexp(0, margin) * weight
    best = np.stack([outside, inside, outside], 1)  # before, in, after
    choice = np.zeros((n, 3), dtype=np.int8)
    best[[i for i in range(n) if page.hidden[i]], 1] = -1e9
    for i in range(n - 1, 0, -1):
        b = best[i]
        choice[i] = (int(b.argmax()), 1 if b[1] >= b[2] else 2, 2)
        best[page.parent[i]] += b[choice[i]]
    state = np.zeros(n, dtype=np.int8)
    for i in range(1, n):
        state[i] = choice[i][state[page.parent[i]]]
    return state == 1


def texts_of(pages: list[str | None], boosted: Boosted) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    xs = [features(p) for p in parsed]
    margins = boosted.margin(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for p, x in zip(parsed, xs, strict=True):
        chosen = decode(p, margins[at : at + len(x)], weights(x))
        at += len(x)
        out.append("\n".join(block for owner, block, _ in p.runs if chosen[owner]))
    return out


def extract(pages: DataFrame, params: ExtractParams = ExtractParams()) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    boosted = model(params)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            sources = list(b)
            out = []
            for low in range(0, len(sources), 256):
                out += texts_of(sources[low : low + 256], boosted)
            yield pd.Series(out, dtype=object)

    found = pages.select("page_id", "url", main_text("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
