"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in a block is a node with a hidden state, content or not.
Unary potentials come from a node's tag, names in class, id and role, size and link share;
pairwise potentials tie each child to its parent by the child's kind. Sum-product messages pass up the
trees and down again, for all pages of a batch together, and give each node's marginal; runs whose
marginal is over one half are the page's text. All potentials are trained together by the gradient of
the likelihood (observed minus expected counts, from the same messages) on labelled pages, which a
seeded generator writes in several layouts (``labelled_pages``); any list of pages whose content
elements are marked may be used instead.

Defined results: null, empty and text-free pages give an empty text; character references are decoded,
white space inside a block becomes one space and blocks are joined by a blank line; broken markup is
read as browsers mostly do (a block closes an open paragraph, stray end tags are dropped, an open script,
comment or tag runs to the end; a quote that is never closed is a character like others); elements nested
deeper than ``DEPTH`` become children of the last one; repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.llm.words import column, ranges_of

# Element names of HTML, and name parts that sites give to parts of pages.
BLOCKS = "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
RAW = "script style textarea title iframe noembed noframes xmp".split()  # up to the end tag, whatever stands inside
HIDDEN = "noscript template svg button canvas audio video select datalist option optgroup".split()
CHOICES = frozenset("select datalist option optgroup".split())  # of these, that no block can be in
VOID = "hr br img input link meta area base col embed source track wbr".split()
NAMES = "ad ads advert advertisement sponsor sponsored promo banner cookie consent notice notification alert popup modal overlay comment comments reply discussion disqus sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright legal share social related recommended more newsletter subscribe signup login search form tag tags toolbar toc pagination pager skip article content main post entry story body text".split()

_BLOCK = {t: k for k, t in enumerate(BLOCKS)}
_NAME = {t: k for k, t in enumerate(NAMES)}
_HIDDEN = frozenset(HIDDEN)
#: Quotes count only after an equals sign and if they are closed. Nothing is tried twice, so that time grows with length.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_HIDDEN_END = re.compile(rf"</({'|'.join(HIDDEN)})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAMING = frozenset(["class", "id", "role", "aria-label"])
_PART = re.compile(r"[a-z]+")
_ENDS: dict[str, frozenset] = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table", "tbody", "thead", "tfoot"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}
#: Kinds of child for pairwise potentials: each block tag, and runs of text.
RUN = len(BLOCKS)
SIZES = 8
#: Open elements of a page.
DEPTH = 256
N_FEATURES = len(BLOCKS) + 1 + len(NAMES) + 3 * SIZES + 8


@dataclass
class Forest:
    """Nodes of a batch of pages: parents come before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    names: list[tuple] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)

    def node(self, parent: int, kind: int, names: tuple, text: str, links: int, page: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.names.append(names)
        self.text.append(text)
        self.links.append(links)
        self.page.append(page)
        return len(self.parent) - 1

    def add(self, source: str, page: int) -> None:
        """Parse a page in one pass."""
        stack = [("", self.node(-1, _BLOCK["html"], (), "", 0, page))]
        opened: Counter[str] = Counter()
        run: list[str] = []
        inside: list[str] = []  # open elements from the outermost one on whose text isn't shown
        last: dict[str, int] | None = None  # last end tag of each kind of these
        linked, in_link, at, n = 0, False, 0, len(source)

        def say(text: str) -> None:
            nonlocal linked
            if not inside:
                run.append(html.unescape(text) if "&" in text else text)
                linked += len(text) if in_link else 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.node(stack[-1][1], RUN, (), text, min(linked, len(text)), page)
                run.clear()
            linked = 0

        def shut(k: int) -> None:
            for name, _ in stack[k:]:
                opened[name] -= 1
            del stack[k:]

        while at < n:
            begin = source.find("<", at)
            if begin != at:
                say(source[at : begin if begin >= 0 else n])
            if begin < 0:
                break
            m = _TAG.match(source, begin)
            if not m:
                at = self._past(source, begin)
                if at == begin + 1:
                    say("<")
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                if inside:
                    if name in inside:
                        del inside[len(inside) - 1 - inside[::-1].index(name) :]
                        continue
                    if not (name in _BLOCK and opened[name]):
                        continue
                    inside.clear()
                if name in _BLOCK:
                    flush()
                    if opened[name]:
                        shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                elif name == "a":
                    in_link = False
            elif name in _RAW_END:
                end = _RAW_END[name].search(source, at)
                at = source.find(">", end.end()) + 1 if end else 0
                at = at or n
                say(" ")
            elif name in _HIDDEN:
                if last is None:
                    last = {e[1].lower(): e.start() for e in _HIDDEN_END.finditer(source)}
                if inside and name in CHOICES and inside[-1] == name:
                    continue  # an open choice ends at the next one
                if not inside:
                    say(" ")
                # If it is never closed, only choices end somewhere: at the next block or with what holds them.
                if not m[3].endswith("/") and len(inside) < DEPTH and (name in CHOICES or last.get(name, 0) >= at):
                    inside.append(name)
            elif name in _BLOCK:
                if inside:
                    if not CHOICES.issuperset(inside):
                        if name not in VOID and len(inside) < DEPTH:
                            inside.append(name)
                        continue
                    inside.clear()
                flush()
                k = self._closed(stack, name)
                if k:
                    shut(k)
                if name in ("html", "body") and len(stack) > 1:
                    continue
                names = {_NAME[p] for a in _ATTRIBUTE.finditer(m[3]) if a[1].lower() in _NAMING for p in _PART.findall((a[2] or a[3] or a[4] or "").lower()) if p in _NAME} if m[3] else ()
                node = self.node(stack[-1][1], _BLOCK[name], tuple(names), "", 0, page)
                if name not in VOID and len(stack) < DEPTH:
                    stack.append((name, node))
                    opened[name] += 1
            elif name == "a":
                in_link = True
            elif name in ("br", "img", "input"):
                say(" ")
        inside.clear()
        flush()

    @staticmethod
    def _past(source: str, at: int) -> int:
        """Where to go on after a "<" that begins no whole tag: after the next character, if it is text."""
        for mark, end, least in (("<!--", "-->", 2), ("<![CDATA[", "", 9), ("<!", ">", 2), ("<?", ">", 2), ("</", ">", 2)):
            if source.startswith(mark, at):
                if not end:
                    return at + least
                found = source.find(end, at + least)
                return found + len(end) if found >= 0 else len(source)
        return len(source) if source[at + 1 : at + 2].isalpha() and source[at + 1 : at + 2].isascii() else at + 1

    @staticmethod
    def _closed(stack: list, name: str) -> int:
        """From which place on the start of an element closes open ones (0: none)."""
        for k in range(len(stack) - 1, 0, -1):
            open_ = stack[k][0]
            if open_ == "p" or name in _ENDS and open_ == name or name in ("dt", "dd") and open_ in ("dt", "dd") or name in ("td", "th") and open_ in ("td", "th"):
                return k
            if name not in _ENDS or open_ in _ENDS[name]:
                break
        return 0

    def features(self) -> np.ndarray:
        """0/1 features of all nodes."""
        n = len(self.parent)
        parent, kind, depth = np.array(self.parent), np.array(self.kind), np.array(self.depth)
        out = np.zeros((n, N_FEATURES), np.float32)
        out[np.arange(n), kind] = 1
        at = len(BLOCKS) + 1
        size = np.fromiter((len(t) for t in self.text), np.float64, n)
        links, total = np.array(self.links, np.float64), size.copy()
        for d in range(depth.max(initial=0), 0, -1):
            own = np.flatnonzero(depth == d)
            np.add.at(total, parent[own], total[own])
            np.add.at(links, parent[own], links[own])
        rows = np.repeat(np.arange(n), [len(x) for x in self.names])
        flat = np.array([k for x in self.names for k in x], int)
        out[rows, at + flat] = 1
        at += len(NAMES)
        level = lambda x: np.clip(np.log2(x / 8 + 1).astype(int), 0, SIZES - 1)
        out[np.arange(n), at + level(total)] = 1
        share = np.clip((links / np.maximum(1, total) * SIZES).astype(int), 0, SIZES - 1)
        out[np.arange(n), at + SIZES + share] = 1
        of_page = total / np.maximum(1, total[np.maximum(0, np.searchsorted(np.array(self.page), self.page))])
        out[np.arange(n), at + 2 * SIZES + np.clip((of_page * SIZES).astype(int), 0, SIZES - 1)] = 1
        at += 3 * SIZES
        run = kind == RUN
        ends = np.fromiter((t[-1:] in ".!?…:;\"'”’)" for t in self.text), bool, n)
        mark = np.fromiter(("©" in t for t in self.text), bool, n)
        out[:, at] = run & ends
        out[:, at + 1] = run & ~ends
        out[:, at + 2] = mark
        out[:, at + 3] = run & (size > 200)
        out[:, at + 4] = 1
        out[:, at + 5] = (links == 0) & run
        return out


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)


@dataclass
class TreeModel:
    """Unary weights (features x kinds of node: element, run) and log potentials [kind, parent state, child state]."""

    unary: np.ndarray
    pair: np.ndarray

    def infer(self, forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of content for each node, and of (parent, child) states for each edge."""
        parent, depth, kind = np.array(forest.parent), np.array(forest.depth), np.array(forest.kind)
        n, run = len(parent), (np.array(forest.kind) == RUN).astype(int)
        belief = np.zeros((n, 2))
        belief[:, 1] = np.where(run, x @ self.unary[:, 1], x @ self.unary[:, 0])
        levels = [np.flatnonzero(depth == d) for d in range(depth.max(initial=-1) + 1)]
        up = np.zeros((n, 2))
        pair = self.pair[kind]  # node, parent state, own state
        for own in reversed(levels[1:]):
            up[own] = np.logaddexp(pair[own, :, 0] + belief[own, None, 0], pair[own, :, 1] + belief[own, None, 1])
            belief += _sums(up[own], parent[own], n)
        edges = np.zeros((n, 2, 2))
        for own in levels[1:]:
            cavity = belief[parent[own]] - up[own]
            joint = cavity[:, :, None] + pair[own] + belief[own][:, None, :]
            down = np.logaddexp(cavity[:, 0, None] + pair[own, 0], cavity[:, 1, None] + pair[own, 1])
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            edges[own] = joint / joint.sum((1, 2), keepdims=True)
            belief[own] += down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), edges


def train(pages: list[tuple[str, set[str]]], steps: int = 90, rate: float = 0.25, decay: float = 1e-3) -> TreeModel:
    """Fit to labelled pages: (html, texts of the runs that are content).

    An element is content if it has some and lies in the smallest element with all of the page's content, is that one, or is one around it, below the
    body, that has nothing else.
    """
    forest, truth = Forest(), []
    for k, (source, content) in enumerate(pages):
        begin = len(forest.parent)
        forest.add(source, k)
        truth += [forest.kind[i] == RUN and forest.text[i] in content for i in range(begin, len(forest.parent))]
    y, kind, parent = np.array(truth), np.array(forest.kind), np.array(forest.parent)
    page, run = np.array(forest.page), kind == RUN
    below, other = (y & run).astype(int), (~y & run).astype(int)
    for i in range(len(y) - 1, 0, -1):
        if parent[i] >= 0:
            below[parent[i]] += below[i]
            other[parent[i]] += other[i]
    whole = np.bincount(page, y & run)[page]
    # Elements with all of the content form a path from the root.
    outer = np.zeros(len(y), bool)
    inner = np.flatnonzero((below == whole) & (parent >= 0) & ~run)
    outer[parent[inner]] = True
    outer &= (other > 0) | (np.array(forest.depth) < 3)
    y = ((below > 0) & ~(outer & (below == whole))).astype(int)
    x = forest.features().astype(float)
    x_element, x_run = x[~run].T.copy(), x[run].T.copy()
    model = TreeModel(np.zeros((N_FEATURES, 2)), np.zeros((len(BLOCKS) + 1, 2, 2)))
    seen_u, seen_p = np.full(model.unary.shape, 1e-6), np.full(model.pair.shape, 1e-6)
    child = np.flatnonzero(parent >= 0)
    observed = np.zeros(model.pair.shape)
    np.add.at(observed, (kind[child], y[parent[child]], y[child]), 1)
    for _ in range(steps):
        marginal, edges = model.infer(forest, x)
        error = y - marginal
        grad_u = np.stack([x_element @ error[~run], x_run @ error[run]], 1) / len(pages) - decay * model.unary
        expected = _sums(edges[child].reshape(-1, 4), kind[child], len(BLOCKS) + 1).reshape(model.pair.shape)
        grad_p = (observed - expected) / len(pages) - decay * model.pair
        seen_u += grad_u**2
        seen_p += grad_p**2
        model.unary += rate * grad_u / np.sqrt(seen_u)
        model.pair += rate * grad_p / np.sqrt(seen_p)
    return model


#: What the main part of a generated page is wrapped in; the first ones are met more often.
WRAPS = (
    "<article>{}</article>", "<article class='{post}'>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="{content}">{}</div>', '<div id="{main}">{}</div>', "<div>{}</div>",
    '<div class="page"><div>{}</div></div>', "<section>{}</section>", '<div id="wrap"><div class="row"><article>{}</article></div></div>', '<article><div class="{content}">{}</div></article>', '<main role="main"><section class="{post}">{}</section></main>', "<table><tr><td>{}</td></tr></table>",
    "{}", '<main><div class="row"><div class="col">{}</div></div></main>', "<div><div><div>{}</div></div></div>",
)


def labelled_pages(count: int = 450, seed: int = 11, wraps: tuple[str, ...] = WRAPS, bare_share: float = 0.0) -> list[tuple[str, set[str]]]:
    """Pages in random layouts with what is content known: articles under several kinds of element, among page furniture."""
    rng = np.random.default_rng(seed)
    syllables = "ba co di fu ge hi jo ka lu me ni po ra si to va we xi yo za".split()
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    out = []
    for _ in range(count):
        content: set[str] = set()

        def say(a: int, b: int, end: str = ".", keep: bool = True, content: set[str] = content) -> str:
            text = words(a, b).capitalize() + end
            if keep:
                content.add(text)
            return text

        def linked(text: str) -> str:
            """The text with a link somewhere in it, or some, or none."""
            parts = text.split(" ")
            for _ in range(pick(0, 0, 1, 1, 2)):
                a = int(rng.integers(len(parts)))
                b = min(len(parts), a + int(rng.integers(1, 5)))
                if not any("<" in w for w in parts[a:b]):
                    parts[a], parts[b - 1] = f'<{(t := pick("a", "a", "em"))}{f' href="/{word()}"' if t == "a" else ""}>' + parts[a], parts[b - 1] + f"</{t}>"
            return " ".join(parts)

        def links(n: int) -> str:
            return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n))

        def junk(kinds: tuple[str, ...]) -> str:
            kind = pick(*kinds)
            size = (1, 12) if rng.random() < 0.7 else (10, 40)
            text = say(*size, end=pick(".", "", "!"), keep=False)
            if kind == "nav":
                return pick(f"<nav><ul>{links(rng.integers(2, 9))}</ul></nav>", f'<div class="{pick("menu", "nav", "navbar", "breadcrumbs")}"><ul>{links(rng.integers(2, 9))}</ul></div>', f"<nav>{words(1, 3)} | {words(1, 3)}</nav>", f'<nav><a href="/{word()}">{words(1, 4)}</a></nav>')
            if kind == "ad":
                return f'<{(t := pick("div", "aside", "section"))} class="{pick("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement")}">{pick("", "<p>")}{text}</{t}>'
            if kind == "notice":
                return f'<div {pick("class", "id")}="{pick("cookie-notice", "notice", "cookie", "consent", "alert", "popup", "newsletter", "subscribe", "banner")}"><p>{text}</p></div>'
            if kind == "aside":
                return f'<{(t := pick("aside", "div"))} class="{pick("sidebar", "widget", "related", "recommended")}"><h3>{words(1, 4)}</h3>{pick(f"<ul>{links(4)}</ul>", f"<p>{text}</p>")}</{t}>'
            if kind == "form":
                return f'<form action="/{word()}"><label>{words(1, 3)}</label><input name="q"><p>{text}</p></form>'
            if kind == "comments":
                said = "".join(f'<{(t := pick("div", "li", "article", "p"))} class="{pick("comment", "reply", "comment-body")}">{pick("<p>", "")}{say(4, 40, keep=False)}</{t}>' for _ in range(rng.integers(1, 5)))
                return f'<{(t := pick("section", "div"))} {pick("class", "id")}="{pick("comments", "comment-list", "discussion")}">{pick("", f"<h2>{words(1, 3)}</h2>")}{said}</{t}>'
            if kind == "comment":
                return f'<div class="{pick("comment", "reply", "comment-box")}">{pick("", "<p>")}{say(2, 30, keep=False)}</div>'
            if kind == "header":
                return f'<header><{(t := pick("h1", "div", "p", "h2"))}>{words(1, 5)}</{t}>{pick("", f"<nav><ul>{links(3)}</ul></nav>")}</header>'
            if kind == "share":
                return f'<div class="{pick("share", "social", "tags", "related")}">{pick(f"<ul>{links(3)}</ul>", text)}</div>'
            return f"<footer>{pick('', '<p>')}&copy; {words(2, 12)} {pick('', f'<a href=/x>{word()}</a>')}</footer>"

        body, most = [], pick(6, 30, 90, 250)
        named = f' class="{pick("text", "body-text", "story-text", "entry", "content", "lead", "para")}"' if rng.random() < 0.2 else ""
        if rng.random() < 0.85:
            head = f"<{(t := pick('h1', 'h1', 'h2'))}>{say(1, 12, end='')}</{t}>"
            if rng.random() < 0.25:
                head = f"<header>{head}{'' if rng.random() < 0.5 else f'<p>{say(2, 9, end=pick("", "."))}</p>'}</header>"
            body.append(head)
        # So many pages have blocks of one kind only: plain divisions, bare text or paragraphs.
        bare = pick(1, 2, 3, 3) if rng.random() < bare_share else 0
        if bare and rng.random() < 0.5:
            body = []
            content.clear()
        for _ in range(rng.integers(1, 9)):
            kind = rng.random() * 1.15
            if bare:
                body.append(f"<div>{linked(say(3, most + 3, end=pick('.', '.', '')))}</div>" if bare == 1 else f"{linked(say(3, most + 3))}{pick('<br><br>', '<p>')}" if bare == 2 else f"<p>{linked(say(3, most + 3))}</p>")
                continue
            if kind < 0.7:
                body.append(f"<p{named}>{pick('', '', '<b>')}{linked(say(1, most, end=pick('.', '.', '', '', '!!', '?')))}{pick('', '<br>')}{pick('</p>', '</p>', '')}")
            elif kind < 0.73:
                body.append(f"<p>{say(2, 12, end=' | ' + words(1, 20).replace(' ', ' | ') + pick('', ' |'))}</p>")
            elif kind < 0.78:
                body.append(f"<{(t := pick('h2', 'h2', 'h3', 'h4'))}>{say(2, 7, end='')}</{t}>")
            elif kind < 0.86:
                body.append(f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{(linked if rng.random() < 0.3 else str)(say(2, 20, end=pick('', '.')))}</li>" for _ in range(rng.integers(1, 5))) + f"</{t}>")
            elif kind < 0.9:
                body.append(f"<blockquote>{pick('', '<p>')}{say(3, 40)}</blockquote>")
            elif kind < 0.93:
                top = f"<tr><th>{say(1, 4, end='')}</th><th>{say(1, 4, end='')}</th></tr>" if rng.random() < 0.5 else ""
                body.append(f"<table>{top}<tr><td>{say(1, 6, end='')}</td><td>{say(1, 6, end='')}</td></tr></table>")
            elif kind < 0.95:
                body.append(f"<pre>{say(3, 20, end='')}</pre>")
            elif kind > 1.12:
                body.append(f"<section><h2>{say(2, 7, end='')}</h2><p>{say(5, most + 5)}</p></section>")
            elif kind > 1.07:
                body.append(f"<figure>{pick('', '<img src=x>')}<figcaption>{say(1, 15, end=pick('', '.'))}</figcaption></figure>")
            elif kind > 1.02:
                body.append("<dl>" + "".join(f"<dt>{say(1, 4, end='')}<dd>{say(2, 20, end=pick('', '.'))}" for _ in range(rng.integers(1, 4))) + "</dl>")
            elif kind > 1.0:
                body.append(f"<details><summary>{say(1, 6, end='')}</summary><p>{say(4, 20)}</p></details>")
            else:
                body.append(junk(("ad", "share", "notice")))
        if rng.random() < 0.12:
            body.append(junk(("comments", "comment", "footer", "share", "form")))
        before = [junk(("nav", "ad", "notice", "header", "form", "aside")) for _ in range(rng.integers(0, 5))]
        after = [junk(("aside", "comments", "footer", "ad", "form", "share", "nav")) for _ in range(rng.integers(0, 4))] + [junk(("footer",))] * (rng.random() < 0.85)
        if rng.random() < 0.1:
            before, after = [], []
        inner = "".join(body)
        wrap = wraps[int(len(wraps) * rng.random() ** 1.5)]
        names = {"{post}": pick("post", "entry", "story"), "{content}": pick("content", "post-content", "article-body", "entry", "story", "main-text"), "{main}": pick("content", "main", "article")}
        for name, chosen in names.items():
            wrap = wrap.replace(name, chosen)
        main = wrap.replace("{}", inner)
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", content))
    return out


@functools.lru_cache(1)
def default_model() -> TreeModel:
    return train(labelled_pages(bare_share=0.15))


def main_texts(pages: list[str], model: TreeModel) -> list[str]:
    forest = Forest()
    for k, source in enumerate(pages):
        if source:
            forest.add(source, k)
    kept: list[list[str]] = [[] for _ in pages]
    if forest.parent:
        marginal, _ = model.infer(forest, forest.features())
        for i in np.flatnonzero((marginal > 0.5) & (np.array(forest.kind) == RUN)).tolist():
            kept[forest.page[i]].append(forest.text[i])
    return ["\n\n".join(x) for x in kept]


def extract(pages: DataFrame, model: TreeModel | None = None, source: str = "html") -> DataFrame:
    """Add text and n_chars to a table of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # of fixed size
    keep = [c for c in pages.columns if c not in (source, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = column(batch, source)
            for a, b in ranges_of(sources):
                texts = main_texts(sources.slice(a, b - a).to_pylist(), shared.value)
                own = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(*keep, F.col(source).cast("string")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"]))
