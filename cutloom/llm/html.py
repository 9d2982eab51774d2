"""Main text of web pages: boosted trees over DOM nodes, decoded top-down along the tree.

A page becomes a tree of elements and text runs. Every node gets features (tag, words of its class, id
and role, subtree density of text and links, depth, siblings); boosted trees give the chance that it
belongs to the article. Decoding picks the likeliest labels under one law: what is inside an excluded
node is excluded. The model is trained on pages that this module composes itself, with a fixed seed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import slices

_ATTRS = r"(?:[\s/]++|=?[^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+(?<![\s/]))*+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_ATTR = re.compile(r"(class|id|role|aria-label|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Fixed values of HTML: elements without content, of raw content that is not shown, of content that is no running text (drawings and the choices of a form), of raw content that is shown, and that end an open paragraph.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea title iframe noembed noframes".split())
_HIDDEN = frozenset("svg select".split())
_SHOWN_RAW = frozenset("xmp plaintext".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br xmp plaintext listing".split())
_ENDS_P = _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Groups of tags and of words in class, id and role that the features tell apart.
TAGS = ("#text", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "a", "nav menu", "header", "footer", "aside", "article main", "section", "div", "span b i em strong u small sup sub font mark code cite q", "blockquote pre figure figcaption xmp plaintext listing", "table tbody thead tr td th", "form fieldset input button label legend", "html body")
WORDS = (
    "content article post entry main body story text prose blog markdown page read",
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header head masthead banner logo branding top topbar title",
    "footer foot copyright legal colophon bottom imprint",
    "sidebar side aside widget related recommended recommendation more popular trending rail teaser promoted also latest",
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner dfp taboola outbrain commercial affiliate",
    "comment comments reply replies respond discussion disqus thread commentlist responses feedback reader",
    "cookie cookies consent notice alert gdpr privacy popup modal overlay toast banner warning message announcement paywall",
    "newsletter subscribe subscription signup register login signin search form contact input",
    "share sharing social follow facebook twitter tags tag meta byline author date tools print buttons",
)
_TAG_GROUP = {t: i for i, g in enumerate(TAGS) for t in g.split()}
_WORD_GROUP: dict[str, int] = {}
for _i, _g in enumerate(WORDS):
    for _w in _g.split():
        _WORD_GROUP[_w] = _WORD_GROUP.get(_w, 0) | 1 << _i
#: Elements whose own meaning is that of a word group.
_TAG_WORDS = {"nav": 1 << 1, "header": 1 << 2, "footer": 1 << 3, "aside": 1 << 4, "form": 1 << 8, "article": 1, "main": 1}


class Page:
    """A parsed page: parallel lists over nodes in document order, the root first."""

    def __init__(self, html: str):
        self.tag: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.words: list[int] = [0]
        self.text: list[str | None] = [None]
        self.truth: list[str | None] = [None]
        self.end: list[int] = [0]  # where the nodes below end
        self.order: list[int] = []  # text nodes and, as -1, block edges
        self._parse(html)

    def _node(self, tag: str, parent: int, words: int = 0, text: str | None = None, truth: str | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append(text)
        self.truth.append(truth)
        self.end.append(len(self.tag))
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack, pos = [0], 0
        for_text = self.order.append
        #: How many elements of a tag are open: most searches of the stack are for tags that are not.
        n_open: dict[str, int] = {}

        def text(upto: int) -> None:
            if upto > pos and (raw := html[pos:upto]):
                decoded = unescape(raw) if "&" in raw else raw
                if decoded.strip():
                    for_text(self._node("#text", stack[-1], 0, decoded))
                elif self.order and self.order[-1] >= 0:
                    for_text(-2)  # white space between inline elements

        def close(k: int) -> None:
            n = len(self.tag)
            for j in stack[k:]:
                self.end[j] = n
                n_open[self.tag[j]] -= 1
            del stack[k:]

        def close_nearest(names: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> None:
            if not any(n_open.get(t) for t in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in names:
                    close(k)
                    return
                if t in until:
                    return

        search, last = _TAG.search, html.rfind(">")
        while pos <= last and (m := search(html, pos)) is not None:
            text(m.start())
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name in _BLOCK:
                    for_text(-1)
                close_nearest({name})
                continue
            rest = m[3] if m[2] else m[6]
            if name in _BLOCK:
                for_text(-1)
            if name in _RAW or name in _HIDDEN:
                if name == "svg" and rest.endswith("/"):
                    continue
                end = _end_of(name).search(html, pos)
                if end:
                    pos = end.end()
                elif name in _RAW:
                    pos = len(html)
                continue
            if name in ("html", "body", "head"):
                if "data-y" in rest:
                    self.truth[0] = "1"
                continue
            if name in _VOID:
                continue
            if rest.endswith("/") and (name == "math" or n_open.get("math")):  # elements of formulas may close themselves
                continue
            if name in _ENDS_P:
                close_nearest(_P, _BLOCK)
            if name in _SIBLING:
                close_nearest(_SIBLING[name], _SCOPE[name])
            words, truth = _TAG_WORDS.get(name, 0), None
            if rest:
                for key, value in _ATTR.findall(rest):
                    if key == "data-y":
                        truth = value.strip("\"'")
                        continue
                    for w in _WORD.findall(value):
                        words |= _WORD_GROUP.get(w.lower(), 0)
            stack.append(self._node(name, stack[-1], words, None, truth))
            n_open[name] = n_open.get(name, 0) + 1
            if name in _SHOWN_RAW:
                end = _end_of(name).search(html, pos) if name == "xmp" else None
                if (raw := html[pos : end.start() if end else len(html)]).strip():
                    for_text(self._node("#text", stack[-1], 0, raw))
                for_text(-1)
                close(len(stack) - 1)
                pos = end.end() if end else len(html)
        text(len(html))
        n_open["html"] = n_open.get("html", 0) + 1
        close(0)


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


_P = frozenset({"p"})
N_WORDS, N_TAGS = len(WORDS), len(TAGS)
FEATURES = 8 + N_TAGS + 3 * N_WORDS + 16


def features(pages: list[Page]) -> np.ndarray:
    """One row of features for each node of all pages in a row.

    Nodes are in document order, so the nodes below one are a run, and sums and unions over it are
    differences of running totals.
    """
    sizes = np.array([len(p.tag) for p in pages])
    root = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = len(root)
    at = np.arange(n)
    flat = lambda f: np.concatenate([f(p) for p in pages])
    up = flat(lambda p: np.array(p.parent)) + root
    is_root = at == root
    parent = np.where(is_root, root - 1, up)
    end = flat(lambda p: np.array(p.end)) + root
    own = flat(lambda p: np.array(p.words, np.int64))
    names, tag = np.unique(flat(lambda p: np.array(p.tag)), return_inverse=True)
    group = np.array([_TAG_GROUP.get(t, -1) for t in names.tolist()])[tag]
    runs = [t.strip() if t is not None else None for p in pages for t in p.text]
    full = np.array([t is not None for t in runs])
    said = [t for t in runs if t is not None]
    chars, words, marks, links = (np.zeros(n) for _ in range(4))
    chars[full] = [len(t) for t in said]
    words[full] = [t.count(" ") + 1 for t in said]
    marks[full] = [t.count(".") + t.count(",") + t.count("。") for t in said]

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return total[end] - total[at]

    def inside(x: np.ndarray) -> np.ndarray:
        """How many of the nodes marked by x a node lies below."""
        total = np.cumsum(x - np.bincount(end[x > 0], minlength=n + 1)[:n], axis=0)
        return total - x

    is_link = (names == "a")[tag].astype(np.int64)
    links[full] = (chars * (inside(is_link) > 0))[full]
    depth = inside(np.ones(n, np.int64))
    bits = 1 << np.arange(N_WORDS)
    own_bits = (own[:, None] & bits) > 0
    above = np.stack([inside(x.astype(np.int64)) > 0 for x in own_bits.T], axis=1)
    start = np.cumsum(chars) - chars
    start, whole = start - start[root], np.maximum(1.0, below(chars)[root])
    children = np.bincount(up[~is_root], minlength=n).astype(float)
    order = np.argsort(np.where(is_root, -1, up), kind="stable")
    place = np.empty(n)
    place[order] = at - np.searchsorted(np.where(is_root, -1, up)[order], np.where(is_root, -1, up)[order], "left")
    place[is_root] = 0
    kinds = np.where(is_root, -1 - at, parent) * len(names) + tag
    same = np.unique(kinds, return_inverse=True, return_counts=True)
    same = same[2][same[1]].astype(float)
    blocks = np.array([t in _BLOCK for t in names.tolist()])[tag].astype(float)
    paragraphs, nodes, blocks = below((names == "p")[tag].astype(float)), (end - at).astype(float), below(blocks)
    chars, words, marks, links = below(chars), below(words), below(marks), below(links)
    p = np.where(is_root, root, up)
    one_hot = (group[:, None] == np.arange(N_TAGS)).astype(float)
    density = chars / np.maximum(1, nodes)
    link_share = links / np.maximum(1, chars)
    parts = [
        np.log1p(chars), np.log1p(words), chars / whole, np.log1p(density), link_share, marks / np.maximum(1, words), np.log1p(paragraphs), np.log1p(nodes),
        *one_hot.T, *own_bits.T, *above.T, *(below(own_bits.astype(np.int64)) > 0).T,
        depth, place, children[p], place / np.maximum(1, children[p]), same / np.maximum(1, children[p]), start / whole, (start + chars) / whole,
        chars / np.maximum(1, chars[p]), link_share[p], np.log1p(chars[p]), np.log1p(density[p]), group[p], group[p[p]], np.log1p(children), np.log1p(words / np.maximum(1, blocks)), marks,
    ]
    return np.stack([np.asarray(x, float) for x in parts], axis=1)


def decode(page: Page, chance: np.ndarray) -> np.ndarray:
    """The likeliest labels under two laws: what lies in an excluded node is excluded, and an included
    node that has any text below includes some of it. The root is included.
    """
    n = len(chance)
    q = np.clip(chance, 1e-4, 1 - 1e-4)
    inside, outside = np.log(q), np.log(1 - q)
    #: What it costs to include one child more than is best, and which child that is.
    least, pick = np.full(n, np.inf), np.full(n, -1)
    full = np.array([t is not None for t in page.text])
    for i in range(n - 1, 0, -1):
        if page.text[i] is None and pick[i] >= 0 and least[i] > 0:
            inside[i] -= least[i]
        p = page.parent[i]
        full[p] |= full[i]
        inside[p] += max(inside[i], outside[i])
        outside[p] += outside[i]
        if full[i] and (lost := max(0.0, outside[i] - inside[i])) < least[p]:
            least[p], pick[p] = lost, i
    keep = np.zeros(n, bool)
    keep[0] = True
    forced = np.zeros(n, bool)
    for i in range(n):
        keep[i] = i == 0 or keep[page.parent[i]] and (forced[i] or inside[i] >= outside[i])
        if keep[i] and pick[i] >= 0 and i:
            forced[pick[i]] = True
    return keep


def assemble(page: Page, keep: np.ndarray) -> str:
    """Kept text runs, white space inside a block as one space, blocks joined by one space."""
    blocks, run = [], []
    for i in page.order:
        if i >= 0:
            if keep[i]:
                run.append(page.text[i])
        elif i == -2:
            run.append(" ")
        elif run:
            blocks.append(" ".join("".join(run).split()))
            run = []
    blocks.append(" ".join("".join(run).split()))
    return " ".join(b for b in blocks if b)


# Training pages.


def _compose(rng: random.Random) -> str:
    """A page of known truth: data-y="1" marks the article, data-y="0" what does not belong to it."""
    syllables = ["".join(rng.choice("bcdfghklmnprstvwzéöñ") + rng.choice("aeiouàü") for _ in range(rng.randint(1, 2))) for _ in range(40)]
    noisy = rng.random() < 0.15

    def word() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
        return w + rng.choice(["", "###", "&&&", "$$$", "%%%"]) if noisy else w

    def sentence(a: int = 1, b: int = 18) -> str:
        w = [word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(a, b))]
        return escape(" ".join(w).capitalize() + rng.choice([".", ".", ".", "!", "?"]), quote=False)

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def name(kind: int | None) -> str:
        if kind is None or rng.random() < 0.25:
            return "".join(rng.choice("abcdefgh0123456789") for _ in range(rng.randint(3, 8))) if rng.random() < 0.6 else ""
        w = rng.choice(WORDS[kind].split())
        return w if rng.random() < 0.5 else rng.choice([f"{w}-{rng.choice(['box', 'wrap', 'inner', 'area', 'list', 'section'])}", f"site-{w}", f"{w}{rng.randint(1, 9)}", f"js-{w} {w}__item"])

    def el(tag: str, inner: str, kind: int | None = None, y: str = "", named: float = 0.8) -> str:
        c = name(kind) if rng.random() < named else ""
        attr = f' {rng.choice(["class", "class", "id"])}="{c}"' if c else ""
        return f"<{tag}{attr}{f' data-y={y}' if y else ''}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        tag = rng.choice(["li", "li", "span", "div", ""])
        items = [f'<a href="/{word()}">{escape(" ".join(word() for _ in range(rng.randint(1, 4))))}</a>' for _ in range(rng.randint(a, b))]
        inner = "".join(f"<{tag}>{x}</{tag}>" if tag else x + rng.choice([" ", " | "]) for x in items)
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    def short() -> str:
        """A block of a word or a few, of any tag, and text in elements that hold it less often."""
        s = rng.choice([escape(word()), escape(word()), sentence(1, 3), sentence(2, 6)])
        r = rng.random()
        if r < 0.6:
            return el(rng.choice(["div", "div", "div", "section", "p", "figcaption", "center"]), s, None, named=0.4)
        if r < 0.75:
            return f"<math><mi>{escape(word())}</mi><mo>=</mo><mn>{rng.randint(0, 99)}</mn><mspace/></math>"
        return rng.choice([f"<object data=x>{s}</object>", f"<xmp>{word()} <b></xmp>", f"<noscript>{s}</noscript>", f"<!-->{el('p', s, None)}", f"<details><summary>{s}</summary>{sentence()}</details>"])

    def paragraph() -> str:
        s = prose()
        if rng.random() < 0.25:
            s = s.replace(" ", f' <{(t := rng.choice(["b", "i", "em", "a href=x", "strong"]))}>{escape(word())}</{t.split()[0]}> ', 1)
        r = rng.random()
        if r < 0.06:
            return short()
        if r < 0.15:
            return f"<p><b>{sentence()}<br>"
        return f"<p>{s}</p>" if r < 0.85 else f"<p>{s}" if r < 0.92 else el("div", s, None)

    def body() -> str:
        out = [f"<h{(k := rng.randint(1, 2))}>{sentence(3, 10)}</h{k}>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
            r = rng.random()
            if r < 0.78:
                out.append(paragraph())
            elif r < 0.84:
                out.append(f"<h{rng.randint(2, 4)}>{sentence(2, 7)}</h2>")
            elif r < 0.9:
                out.append("<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.93:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif r < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{escape(word())}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif r < 0.98:
                out.append(f"<pre>{escape(word())}\n{escape(word())}</pre>")
            else:
                out.append(f"{prose()}<br><br>{prose()}")
            if rng.random() < 0.05:
                out.append(extra(rng.choice([4, 5, 8, 9])))
        return "".join(out)

    def extra(kind: int) -> str:
        def box(inner: str, tags: list[str], named: float = 0.95) -> str:
            return el(rng.choice(tags), inner, kind, "0", named)

        if kind == 1:
            return box(links(3, 12), ["nav", "nav", "div", "ul"])
        if kind == 2:
            return box(rng.choice([f"<h1>{sentence(1, 4)}</h1>", f'<a href="/">{escape(word())}</a>', f"<p>{sentence(2, 8)}</p>"]) + rng.choice(["", links(2, 6)]), ["header", "header", "div"])
        if kind == 3:
            return box(rng.choice([f"&copy; {escape(word())} &middot; {sentence()}", f"<p>{prose(1, 2)}</p>", links(2, 8), f"<p>&copy; 2020 {escape(word())}</p>{links(2, 5)}"]), ["footer", "footer", "div"])
        if kind == 4:
            return box(f"<h3>{sentence(1, 3)}</h3>" * rng.randint(0, 1) + rng.choice([links(3, 10), "".join(f"<div><a href=x>{sentence(3, 8)}</a><p>{sentence()}</p></div>" for _ in range(rng.randint(2, 5))), f"<p>{prose(1, 3)}</p>"]), ["aside", "aside", "div", "section"])
        if kind == 5:
            return box(rng.choice([sentence(), f"<p>{prose(1, 2)}</p>", f"<a href=x>{sentence()}</a>", f"<span>{sentence(2, 5)}</span><a href=x>{escape(word())}</a>"]), ["div", "div", "aside", "section", "p"], 1.0)
        if kind == 6:
            one = lambda: el(rng.choice(["div", "li", "article", "section"]), f"<b>{escape(word())}</b>" * rng.randint(0, 1) + rng.choice([f"<p>{prose(1, 5)}</p>", prose(1, 4)]), 6)
            return box(f"<h3>{sentence(1, 3)}</h3>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 8))) + rng.choice(["", "<form><textarea>x</textarea><button>Send</button></form>"]), ["div", "section", "ol", "aside"], 1.0)
        if kind == 7:
            return box(rng.choice([f"<p>{prose(1, 3)}</p>", sentence()]) + rng.choice(["", "<button>OK</button>", "<a href=x>More</a>"]), ["div", "div", "section", "aside", "p"], 1.0)
        if kind == 8:
            return box(rng.choice([f"<p>{sentence()}</p>", f"<h3>{sentence(2, 6)}</h3>", ""]) + f"<label>{escape(word())}</label><input name=a><button>{escape(word())}</button>", ["form", "form", "div"])
        return box(rng.choice([links(2, 6), f"<span>{sentence(1, 4)}</span>", f"<span>{escape(word())}</span> <time>2020-01-01</time>"]), ["div", "div", "ul", "p"], 1.0)

    main = el(rng.choice(["article", "article", "main", "div", "section"]), body(), 0, "1", 0.7)
    middle = "".join(extra(rng.choice([4, 5, 7, 8, 9])) for _ in range(rng.choice([0, 0, 1, 2]))) + main + "".join(extra(rng.choice([4, 5, 6, 6, 9])) for _ in range(rng.choice([0, 0, 1, 1, 2])))
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        middle = el(rng.choice(["div", "div", "main", "section"]), middle + (extra(rng.choice([4, 6, 9])) if rng.random() < 0.15 else ""), rng.choice([None, None, 0]))
    bare = rng.random()
    if bare < 0.2:  # no element holds the article and nothing else
        middle = body() if bare < 0.12 else "".join(paragraph() for _ in range(rng.randint(1, 6)))
    if bare < 0.06:  # nor is there anything else on the page
        return f"<html><body data-y=1>{middle}</body></html>"
    top = "".join(extra(k) for k in (7, 2, 1, 5) if rng.random() < 0.55)
    end = "".join(extra(k) for k in (6, 4, 8, 7, 3) if rng.random() < (0.8 if k == 3 else 0.2))
    return f"<!DOCTYPE html><html><head><title>{sentence()}</title><script>var a='</p>';</script></head><body{' data-y=1' if bare < 0.2 else ''}>{top}{middle}{end}</body></html>"


def truth(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Labels (holds article text and lies in nothing excluded) and which nodes have any text below."""
    n = len(page.tag)
    state = [""] * n
    y, full = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        state[i] = page.truth[i] or (state[page.parent[i]] if i else "")
        y[i] = page.text[i] is not None and state[i] == "1"
        full[i] = page.text[i] is not None
    for i in range(n - 1, 0, -1):
        y[page.parent[i]] |= y[i]
        full[page.parent[i]] |= full[i]
    for i in range(n):
        y[i] &= state[i] != "0"
    return y, full


@cache
def model(pages: int = 700, trees: int = 70, depth: int = 5, seed: int = 5) -> tuple[float, list[boost.Tree]]:
    """The node model, trained on `pages` composed pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        p = Page(_compose(rng))
        y, full = truth(p)
        xs.append(features([p])[full])
        ys.append(y[full])
    return boost.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees, depth, 0.25, share=0.5)


def main_texts(pages: list[str], fitted: tuple[float, list[boost.Tree]]) -> list[str]:
    parsed = [Page(h) for h in pages]
    if not parsed:
        return []
    chance = boost.predict(*fitted, features(parsed))
    out, at = [], 0
    for p in parsed:
        out.append(assemble(p, decode(p, chance[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text; repeated rows are extracted each and null page_ids stay null;
    an empty table gives an empty result; other columns are ignored. Nothing is cut off, however long the
    page. Never text: comments, scripts, styles, templates, frames, the page's title, what is typed into a
    form or chosen from a list, and the insides of svg drawings. All other text is left to the trees.
    """
    fitted = model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 128, 2 << 20):
            texts = main_texts([h or "" for h in part.column("html").to_pylist()], fitted)
            yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
