"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree; every node is described by its subtree (text, links, density), its tag and
hashed attribute tokens, its depth and its siblings.  Boosted trees, trained in numpy on generated pages
whose main text is known, give each node a probability of being main text.  Hierarchical decoding then picks
the best joint choice for the whole tree: below a dropped node nothing is kept, and a kept node may hold
dropped islands, so no ancestor contradicts a descendant.

Text under a kept node is put out whole: character references are decoded, white space inside a block
becomes one space, blocks are joined in page order by one newline.

Defined results: null or empty html, and a page without main text, give the empty text; unclosed and stray
tags are repaired; repeated rows give repeated results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import released

# Fixed values of HTML: elements by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no markup; a script or style that never ends takes the rest of the page with it.
RAW = frozenset("script style textarea title iframe template".split())
ENDLESS = frozenset("script style".split())
#: Drawings and formulas: what is in them belongs to the text around; their elements can close themselves.
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul details figure".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements of a head; any other one ends it.
HEAD = frozenset("base head html link meta noscript script style template title".split())
#: Tags that the trees know one by one; others share a place.
TAGS = "html body main article section div p h1 h2 h3 h4 ul ol li table tr td nav header footer aside form blockquote pre figure figcaption dl span a button select hr".split()
_TAG_NO = {t: k for k, t in enumerate(TAGS)}
ATTR_BUCKETS = 128
#: Rows of features that are in memory at once.
NODES = 16_384

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ENDS = {t: re.compile(f"</{t}(?![^\\s/>])", re.I | re.A) for t in RAW}
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


@dataclass
class Page:
    """Nodes in page order (parents first), and text runs (node, block, text, whether in a link)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    attrs: list[tuple[int, ...]] = field(default_factory=list)
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)


def tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") of a page, read once from the left.

    A quote belongs to a value only after an equals sign; where a value never ends, quotes mean nothing from there on,
    and where no tag can end any more, all that is left is text.  So no character is looked at often."""
    at, n = 0, len(text)
    since = 0  # of text that has not been given out
    quotes = True
    endless: set[str] = set()
    while True:
        lt = text.find("<", at)
        if lt < 0:
            break
        if text.startswith("<!--", lt):
            if lt > since:
                yield "text", text[since:lt], ""
            end = text.find("-->", lt + 2)
            at = since = n if end < 0 else end + 3
            continue
        close = text.startswith("/", lt + 1)
        name = _NAME.match(text, lt + 1 + close)
        if not name and text[lt + 1 : lt + 2] not in ("!", "?") and not close:
            at = lt + 1
            continue
        # to the end of the tag
        stop = lt + 1 if not name else name.end()
        while True:
            m = _STOP.search(text, stop) if quotes and name else None
            if not m or m[0] == ">":
                break
            stop = m.end()
            if text[lt : m.start()].rstrip()[-1:] == "=" if m.start() - lt < 64 else text[m.start() - 64 : m.start()].rstrip()[-1:] == "=":
                end = text.find(m[0], stop)
                if end < 0:
                    quotes = False
                else:
                    stop = end + 1
        gt = m.start() if m else text.find(">", lt)
        if gt < 0:
            if quotes and name and text.find(">", lt) >= 0:
                # every end that is left stands in a quoted value
                quotes = False
                continue
            break
        if lt > since:
            yield "text", text[since:lt], ""
        at = since = gt + 1
        if not name:
            continue
        low = name[0].lower()
        attrs = text[name.end() : gt]
        if low in RAW and not close:
            if low == "iframe" and attrs.endswith("/") or low in endless:
                continue
            end = _ENDS[low].search(text, at)
            if end:
                gt = text.find(">", end.end())
                at = since = n if gt < 0 else gt + 1
            elif low in ENDLESS:
                at = since = n
            else:
                endless.add(low)
            yield "open", low, ""
            continue
        yield ("close", low, "") if close else ("open", low, attrs)
    if since < n:
        yield "text", text[since:], ""


def parse(source: str | None) -> Page:
    page = Page()
    known: dict[str, tuple[int, ...]] = {}  # equal attributes are read once

    def hashed(attrs: str) -> tuple[int, ...]:
        found: set[int] = set()
        for m in _ATTR.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            found.update(zlib.crc32(t.encode()) % ATTR_BUCKETS for t in _TOKEN.findall(value))
        return tuple(found)

    def add(tag: str, parent: int, attrs: str) -> int:
        page.tag.append(tag)
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        if "=" not in attrs:
            page.attrs.append(())
        else:
            if attrs not in known:
                known[attrs] = hashed(attrs)
            page.attrs.append(known[attrs])
        return len(page.tag) - 1

    add("html", -1, "")
    # open elements: name, node that their text belongs to, whether in a link; and how many of a name are open
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]
    opened: Counter = Counter()
    block, head = 0, False

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    for kind, name, attrs in tokens(source or ""):
        if kind == "text":
            if not head and name:
                _, node, link = stack[-1]
                page.runs.append((node, block, name, link))
            continue
        if kind == "close":
            if name == "head":
                head = False
            if not opened[name] and opened[f"svg:{name}"]:
                name = f"svg:{name}"
            if opened[name]:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                if any(x[0] not in INLINE and not x[0].startswith("svg:") for x in stack[k:]):
                    block += 1
                cut(k)
            elif name == "p":
                block += 1
            continue
        if name == "head":
            head = True
            continue
        if name not in HEAD:
            head = False
        if name in ("html", "body"):
            if name == "body" and len(stack) == 1:
                stack.append(("body", add("body", 0, attrs), False))
                opened["body"] += 1
            continue
        if name in RAW:
            continue
        drawn = opened["svg"] + opened["math"]
        if drawn and (name in CLOSES_P or name in CLOSES_SAME):
            # text elements end a drawing that was left open
            cut(next(k for k in range(1, len(stack)) if stack[k][0] in FOREIGN))
            drawn = 0
        if drawn or name in FOREIGN:
            if not attrs.endswith("/"):
                stack.append((name if name in FOREIGN else f"svg:{name}", *stack[-1][1:]))
                opened[stack[-1][0]] += 1
            continue
        if name in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    cut(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        same = CLOSES_SAME.get(name)
        if same and any(opened[t] for t in same):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in same:
                    cut(k)
                    break
                if stack[k][0] in SCOPES[name]:
                    break
        flows = name in INLINE or name == "noscript"
        if not flows:
            block += 1
        own, link = stack[-1][1], stack[-1][2]
        if name == "br":
            page.runs.append((own, block, " ", link))
        if name in VOID:
            if name not in INLINE:
                block += 1
            continue
        inline_plain = name in INLINE and not (name == "span" and "class" in attrs)
        node = own if inline_plain else add(name, own, attrs)
        if attrs.endswith("/") and name in INLINE:
            continue
        stack.append((name, node, link or name == "a"))
        opened[name] += 1
    return page


N_FEATURES = 26 + 3 * (len(TAGS) + 1) + ATTR_BUCKETS


def feature_rows(page: Page) -> Iterator[np.ndarray]:
    """A row for each node, in blocks of at most NODES rows."""
    n = len(page.tag)
    parent = page.parent
    own = np.zeros((n, 6))  # characters, words, link characters, sentence marks, runs, digits
    start = np.full(n, np.inf)
    stop = np.zeros(n)
    at = 0
    for node, _, text, link in page.runs:
        size = len(text)
        bare = text.strip()
        if bare:
            o = own[node]
            o[0] += len(bare)
            o[1] += bare.count(" ") + 1
            if link:
                o[2] += len(bare)
            o[3] += bare.count(".") + bare.count(",") + bare.count("!") + bare.count("?")
            o[4] += 1
            start[node] = min(start[node], at)
            stop[node] = at + size
        at += size
    total = max(own[:, 0].sum(), 1.0)
    sub = own.copy()
    count = np.zeros((n, 6))  # nodes, paragraphs, items, form parts, headings, blocks with own text
    kids = np.zeros(n)
    tags = np.array(page.tag)
    count[:, 0] = 1
    count[:, 1] = tags == "p"
    count[:, 2] = np.isin(tags, ("li", "option"))
    count[:, 3] = np.isin(tags, ("form", "button", "select", "fieldset"))
    count[:, 4] = np.isin(tags, [f"h{k}" for k in range(10)])
    count[:, 5] = own[:, 0] > 0
    index = np.zeros(n)
    same = np.zeros(n)
    last: dict[tuple[int, str], int] = {}
    for v in range(1, n):
        p = parent[v]
        index[v] = kids[p]
        kids[p] += 1
        key = (p, page.tag[v])
        last[key] = last.get(key, 0) + 1
    for v in range(1, n):
        same[v] = last[(parent[v], page.tag[v])]
    for v in range(n - 1, 0, -1):
        p = parent[v]
        sub[p] += sub[v]
        count[p] += count[v]
        start[p] = min(start[p], start[v])
        stop[p] = max(stop[p], stop[v])
    start = np.where(np.isfinite(start), start, 0)
    par = np.maximum(np.array(parent), 0)
    chars = sub[:, 0]
    safe = np.maximum(chars, 1)
    cols = [
        np.log1p(chars), np.log1p(own[:, 0]), sub[:, 2] / safe, own[:, 2] / np.maximum(own[:, 0], 1), sub[:, 3] / np.maximum(sub[:, 1], 1), np.log1p(sub[:, 1]),
        chars / np.maximum(count[:, 0], 1), chars / total, chars / np.maximum(chars[par], 1), np.array(page.depth), index, kids[par] - index, same, kids,
        start / max(at, 1), stop / max(at, 1), np.log1p(count[:, 1]), np.log1p(count[:, 2]), np.log1p(count[:, 3]), np.log1p(count[:, 4]), np.log1p(count[:, 5]),
        own[:, 0] / safe, sub[:, 0] / np.maximum(sub[:, 1], 1), np.log1p(chars[par]), sub[par, 2] / np.maximum(chars[par], 1), np.log1p(total),
    ]
    dense = np.empty((n, len(cols)), np.float32)
    for k, c in enumerate(cols):
        dense[:, k] = c
    del cols, own, sub, count
    width = len(TAGS) + 1
    number = np.array([_TAG_NO.get(t, len(TAGS)) for t in page.tag])
    # as bits: the tags that stand anywhere above, the attributes of the node and of what is above
    above, around, mine = [0] * n, [0] * n, [0] * n
    known: dict[int, int] = {}  # equal masks are one object
    tag_bit = [1 << k for k in range(width)]
    numbers = number.tolist()
    for v in range(n):
        p = parent[v]
        if p >= 0:
            m = above[p] | tag_bit[numbers[p]]
            above[v] = known.setdefault(m, m)
            m = around[p] | mine[p]
            around[v] = known.setdefault(m, m)
        if page.attrs[v]:
            m = sum(1 << t for t in page.attrs[v])
            mine[v] = known.setdefault(m, m)

    def bits(masks: list[int], size: int) -> np.ndarray:
        raw = b"".join(m.to_bytes(-(-size // 8), "little") for m in masks)
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(masks), -1), axis=1, count=size, bitorder="little")

    base = dense.shape[1]
    for lo in range(0, n, NODES):
        hi = min(lo + NODES, n)
        x = np.zeros((hi - lo, N_FEATURES), np.float32)
        x[:, :base] = dense[lo:hi]
        rows = np.arange(hi - lo)
        x[rows, base + number[lo:hi]] = 1
        x[rows, base + width + number[par[lo:hi]]] = np.array(parent[lo:hi]) >= 0
        x[:, base + 2 * width : base + 3 * width] = bits(above[lo:hi], width)
        x[:, base + 3 * width :] = np.maximum(bits(mine[lo:hi], ATTR_BUCKETS), 0.5 * bits(around[lo:hi], ATTR_BUCKETS))
        yield x


def features(page: Page) -> np.ndarray:
    return np.concatenate(list(feature_rows(page)))


@dataclass
class Forest:
    """Boosted trees in arrays: nodes of a tree are numbered as in a heap."""

    feature: np.ndarray  # trees, inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees, leaves
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 64, depth: int = 4, rate: float = 0.25, bins: int = 32, seed: int = 3) -> Forest:
    """Second-order boosting of the logistic loss on binned features; a third of the features a tree."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1])) for k in range(x.shape[1])]
    edges = [e if len(e) else np.zeros(1) for e in edges]
    b = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.int64)
    useful = np.flatnonzero(b.max(axis=0) > b.min(axis=0))
    prior = float(np.log(max((y * weight).sum(), 1e-6) / max(((1 - y) * weight).sum(), 1e-6)))
    z = np.full(len(y), prior)
    inner, leaves = 2**depth - 1, 2**depth
    feats, cuts, outs = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        some = np.sort(rng.choice(useful, max(1, len(useful) // 3), replace=False))
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = at - first
            best = np.full(many, 1e-3)
            for f in some:
                size = len(edges[f]) + 1
                key = slot * size + b[:, f]
                gs = np.bincount(key, g, many * size).reshape(many, size).cumsum(axis=1)
                hs = np.bincount(key, h, many * size).reshape(many, size).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    v = gain[np.arange(many), k]
                    up = v > best
                    best[up] = v[up]
                    feats[t, first : first + many][up] = f
                    cuts[t, first : first + many][up] = edges[f][k[up]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feats[t, at]] > cuts[t, at])
        slot = at - inner
        outs[t] = -rate * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + 1)
        z += outs[t][slot]
    return Forest(feats, cuts, outs, prior)


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest joint choice.  A node is outside (what is below may be anything),
    kept (below it are kept nodes and dropped islands) or dropped (with all below)."""
    n = len(page.tag)
    parent = page.parent
    no = (-np.logaddexp(0, logit)).tolist()
    kept, dropped, outside = (-np.logaddexp(0, -logit)).tolist(), no.copy(), no
    for v in range(n - 1, 0, -1):
        p, k, d, o = parent[v], kept[v], dropped[v], outside[v]
        kept[p] += k if k >= d else d
        dropped[p] += d
        outside[p] += k if k >= o else o
    state = [False] * n
    out = [True] * n  # still outside
    state[0] = kept[0] > outside[0]
    out[0] = not state[0]
    for v in range(1, n):
        p = parent[v]
        if state[p]:
            state[v], out[v] = kept[v] >= dropped[v], False
        elif out[p]:
            state[v] = kept[v] > outside[v]
            out[v] = not state[v]
        else:
            out[v] = False
    return np.array(state, bool)


def text_of(page: Page, keep: np.ndarray) -> str:
    """The kept nodes' text, block by block."""
    blocks: list[str] = []
    now, parts = None, []
    for node, block, text, _ in page.runs:
        if not keep[node]:
            continue
        if block != now:
            if parts:
                blocks.append("".join(parts))
            now, parts = block, []
        parts.append(text)
    if parts:
        blocks.append("".join(parts))
    shown = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in shown if b)


def extract(pages: list[str | None], forest: Forest) -> list[str]:
    """Main text of each page; so many pages go through the trees at once as make up NODES nodes."""
    out: list[str] = []
    held: list[Page] = []
    rows: list[np.ndarray] = []

    def close() -> None:
        if held:
            z, at = forest.logits(np.concatenate(rows)), 0
            for p in held:
                out.append(text_of(p, decode(p, z[at : at + len(p.tag)])))
                at += len(p.tag)
            held.clear(), rows.clear()

    for source in pages:
        page = parse(source)
        if sum(map(len, rows)) + len(page.tag) > NODES:
            close()
        if len(page.tag) > NODES:
            z = np.concatenate([forest.logits(x) for x in feature_rows(page)])
            out.append(text_of(page, decode(page, z)))
        else:
            held.append(page)
            rows.append(features(page))
    close()
    return out


# ---- generated training pages ----

# Words in class and id names of content and of what surrounds it.
_GOOD = "content article post entry main body story text page-content post-body entry-content article-body".split()
_BAD = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar pagination tabs links".split(),
    "header": "header masthead top banner site-header logo brand".split(),
    "footer": "footer bottom copyright site-footer legal colophon".split(),
    "side": "sidebar side aside related widget recommended trending popular more tags archive".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad teaser".split(),
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay warning banner privacy message".split(),
    "form": "form search login newsletter subscribe signup contact".split(),
    "comments": "comments comment replies reply discussion responses disqus thread".split(),
    "share": "share social sharing follow buttons toolbar byline meta author".split(),
}


def sample_page(rng: np.random.Generator) -> tuple[str, str]:
    """A random page; characters of its main text are marked by a private-use character after each run."""
    mark = ""
    syll = ["".join(rng.choice(list("bcdfghjklmnprstvwz"), 1)) + "".join(rng.choice(list("aeiouéä"), 1)) for _ in range(40)]

    def word() -> str:
        return "".join(rng.choice(syll, int(rng.integers(1, 5))))

    def sentence(lo: int = 3, hi: int = 20) -> str:
        w = [word() for _ in range(int(rng.integers(lo, hi)))]
        w = [x + "," if rng.random() < 0.1 else x for x in w]
        if junk:
            w = [x + junk[int(rng.integers(len(junk)))] if rng.random() < 0.8 else x for x in w]
        return " ".join(w).capitalize() + ("." if rng.random() < 0.9 else "")

    junk = ["%%%", "&amp;&amp;&amp;", "###", "***"] if rng.random() < 0.15 else []

    def prose(lo=1, hi=7) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(lo, hi))))

    def name(words: list[str]) -> str:
        r = rng.random()
        if r < 0.25:
            return ""
        w = str(rng.choice(words))
        w = w if rng.random() < 0.6 else w + str(rng.choice(["-wrap", "-box", "1", " clear", "_inner", " x2"]))
        return f' class="{w}"' if r < 0.75 else f' id="{w}"'

    def one(tags: list[str]) -> str:
        return str(rng.choice(tags))

    def links(k: int) -> str:
        items = [f'<a href="/{word()}">{word()}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)

    def good_block() -> str:
        r = rng.random()
        if r < 0.06:
            return "<ul>" + "".join(f"<li>{sentence()}{mark}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if r < 0.1:
            return f"<blockquote><p>{prose()}{mark}</p></blockquote>"
        if r < 0.13:
            return f"<pre>{prose()}{mark}</pre>"
        if r < 0.17:
            return "<table>" + "".join(f"<tr><td>{word()}{mark}</td><td>{sentence(1, 5)}{mark}</td></tr>" for _ in range(3)) + "</table>"
        if r < 0.25:
            return f"<h{int(rng.integers(2, 4))}>{sentence(1, 6)}{mark}</h2>"
        if r < 0.33:
            return f"<p><b>{sentence()}{mark}<br><p>{prose()}{mark}</p>"
        if r < 0.4:
            return f'<p>{sentence()} <a href="/{word()}">{word()} {word()}</a>{mark} {prose()}</p>'
        if r < 0.46:
            return f"<p>{word().capitalize()}.{mark}</p>"
        return f"<p>{prose(1, 10)}{mark}" + ("</p>" if rng.random() < 0.9 else "")

    def bad_block(kind: str, inside: bool) -> str:
        w = _BAD[kind]
        if kind == "nav":
            t = one(["nav", "nav", "div", "ul"])
            return f"<{t}{name(w)}>{links(int(rng.integers(3, 12)))}</{t}>"
        if kind == "header":
            t = one(["header", "header", "div"]) if not inside else "div"
            return f'<{t}{name(w) if t != "div" else f" class={one(w)}"}><h1>{sentence(1, 4)}</h1>{links(3) if rng.random() < 0.6 else sentence(2, 8)}</{t}>'
        if kind == "footer":
            t = one(["footer", "footer", "div"])
            body = f"&copy; {word()}.example &middot; {sentence()}" if rng.random() < 0.7 else f"<p>{prose(1, 3)}</p>{links(4)}"
            return f'<{t}{name(w) if t != "div" else f" class={one(w)}"}>{body}</{t}>'
        if kind == "side":
            t = one(["aside", "aside", "div", "section"])
            body = "".join(f"<h3>{sentence(1, 5)}</h3>" + (links(4) if rng.random() < 0.6 else f"<p>{prose(1, 3)}</p>") for _ in range(int(rng.integers(1, 3))))
            return f'<{t}{name(w) if t == "aside" else f" class={one(w)}"}>{body}</{t}>'
        if kind == "ad":
            t = one(["div", "div", "aside", "ins", "section", "p"])
            return f'<{t} class="{one(w)}">{sentence() if rng.random() < 0.7 else prose(1, 3)}</{t}>'
        if kind == "notice":
            t = one(["div", "div", "section", "aside", "p"])
            attr = f' class="{one(w)}"' if rng.random() < 0.8 else ' role="alert"'
            return f"<{t}{attr}>" + (prose(1, 4) if t == "p" or rng.random() < 0.5 else f"<p>{prose(1, 4)}</p><button>{word()}</button>") + f"</{t}>"
        if kind == "form":
            return f'<form{name(w)}><p>{sentence(1, 8)}</p><label>{word()}</label><input name="q"><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>'
        if kind == "comments":
            t = one(["section", "div", "ol"])
            each = "".join(
                f'<{one(["div", "article", "li"])} class="{one(["comment", "reply", "response", "comment-body", "post-comment"])}"><b>{word()}</b><p>{prose(1, 5)}</p></div>' if rng.random() < 0.7 else f"<li><p>{prose(1, 5)}</p></li>"
                for _ in range(int(rng.integers(1, 7)))
            )
            return f'<{t} {one(["class", "id"])}="{one(w)}"><h2>{word()}</h2>{each}</{t}>'
        t = one(["div", "ul", "p", "span"])
        return f'<{t} class="{one(w)}">{links(3) if rng.random() < 0.6 and t == "div" else sentence(1, 5)}</{t}>'

    shape = rng.random()
    body: list[str] = []
    for kind, p in (("header", 0.45), ("nav", 0.7), ("notice", 0.35), ("ad", 0.45), ("form", 0.15), ("side", 0.2)):
        if rng.random() < p:
            body.append(bad_block(kind, False))
    main = []
    brief = rng.random() < 0.2  # a title and a sentence or two
    if brief or rng.random() < 0.8:
        h = f"<h1>{sentence(1, 10)}{mark}</h1>"
        main.append(f"<header>{h}</header>" if rng.random() < 0.15 else h)
    if brief:
        main.append(f"<p><b>{sentence()}{mark}</b><br>" if rng.random() < 0.5 else f"<p>{sentence()}{mark}</p>")
    for _ in range(int(rng.integers(0, 2)) if brief else int(rng.integers(1, 4)) if rng.random() < 0.3 else int(rng.integers(2, 25))):
        main.append(good_block())
        if rng.random() < 0.06:
            main.append(bad_block(str(rng.choice(["ad", "share", "side", "form", "notice", "nav"])), True))
    if rng.random() < 0.12:
        main.append(bad_block("comments", True))
    inner = "".join(main)
    if shape < 0.5:
        inner = f"<article{name(_GOOD)}>{inner}</article>"
    elif shape < 0.65:
        inner = f"<main{name(_GOOD)}>{inner}</main>"
    elif shape < 0.9:
        inner = f'<{one(["div", "section"])} {one(["class", "id"])}="{one(_GOOD)}">{inner}</div>'
    else:
        inner = f"<div>{inner}</div>"
    if rng.random() < 0.3:
        side = bad_block("side", False)
        inner = f'<div class="{one(["wrapper", "container", "row", "layout"])}">{inner + side if rng.random() < 0.6 else side + inner}</div>'
    if shape < 0.65 and rng.random() < 0.2:
        inner = f"<main>{inner}</main>" if shape < 0.5 else inner
    body.append(inner if rng.random() < 0.96 else "")
    for kind, p in (("comments", 0.3), ("side", 0.2), ("share", 0.15), ("form", 0.15), ("ad", 0.2), ("notice", 0.15), ("footer", 0.75)):
        if rng.random() < p:
            body.append(bad_block(kind, False))
    head = f"<!DOCTYPE html><html><head><title>{sentence(1, 5)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>"
    return head + "".join(body) + ("</body></html>" if rng.random() < 0.9 else ""), mark


def train_forest(pages: int = 1000, seed: int = 17) -> Forest:
    """Fit on generated pages (a fixed number): a node is main text if nearly all text below it is."""
    rng = np.random.default_rng(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        source, mark = sample_page(rng)
        page = parse(source)
        n = len(page.tag)
        good, every = np.zeros(n), np.zeros(n)
        # the mark follows a good run of text in its block; the parser sees it as text of that block
        marked = {b for _, b, t, _ in page.runs if mark in t}
        clean = [(v, b, t.replace(mark, ""), link) for v, b, t, link in page.runs]
        for v, b, t, _ in clean:
            size = len(t.strip())
            every[v] += size
            good[v] += size * (b in marked)
        page.runs = clean
        for v in range(n - 1, 0, -1):
            good[page.parent[v]] += good[v]
            every[page.parent[v]] += every[v]
        xs.append(features(page))
        ys.append((good >= 0.85 * every) & (every > 0))
        # nodes without text say little, long ones more
        ws.append(np.where(every > 0, 1 + np.log1p(every) / 4, 0.2))
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def main_text(pages: DataFrame, forest: Forest) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    parts = (forest.feature, forest.cut, forest.leaf, forest.prior)  # of fixed size
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Forest(*parts)
        for b in batches:
            texts = extract(list(b["html"]), f)
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(released(run), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    from .common import table

    return main_text(table(spark, sf_dir, "pages"), train_forest())
