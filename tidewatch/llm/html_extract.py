"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element of a page gets features: the density of text, links and punctuation below it, tokens of its name, class,
id and role and of its ancestors', its depth, and its place among its siblings.  The trees are trained on the driver on
pages that a seeded generator builds in many layouts, so every node's label is known.  Decoding is hierarchical: a node
that is rejected takes all below it along, and a node is kept if that adds up to a positive gain over its subtree, so no
choice contradicts that of an ancestor or descendant.  Pages are independent: one pass over the scan, no shuffle.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import gbt

#: Elements by what the HTML standard says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
HIDDEN = frozenset("script style textarea title noscript template iframe svg math head select option button object canvas audio video map datalist input xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Of an element, those that its start tag ends, up to the nearest of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Tokens of names, classes, ids and roles that speak for the article, and those that speak against it.
FOR = frozenset("article articlebody content post entry main story body text page blog single prose maincontent postcontent entrycontent".split())
AGAINST = frozenset(
    "nav navigation navbar menu sidebar side aside ad ads advert advertisement adsense banner promo promotion sponsor sponsored footer foot header masthead top comment comments "
    "disqus reply replies discussion respond cookie cookies consent gdpr notice alert popup modal overlay share sharing social related recommended recommendations more subscribe newsletter signup form login search "
    "breadcrumb breadcrumbs widget tags tagcloud pagination pager copyright legal toolbar complementary contentinfo dialog".split()
)
_TOKEN = re.compile(r"[a-z]+")
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAMES = ("article main section div p h1 h2 h3 li ul ol td table tr blockquote pre nav header footer aside form figure figcaption a b span dd dt").split()
NAME_NUMBER = {n: i + 1 for i, n in enumerate(_NAMES)}


class Node:
    __slots__ = ("name", "parent", "children", "parts", "tokens", "hidden", "depth", "label")

    def __init__(self, name: str, parent: Node | None, attributes: str = "") -> None:
        self.name, self.parent, self.children, self.parts = name, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.tokens, self.hidden, self.label = set(), name in HIDDEN, None
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "style":
                    self.hidden |= bool(_HIDES.search(value))
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    self.hidden = True
                elif key in ("class", "id", "role"):
                    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
                    self.tokens |= set(_TOKEN.findall(spaced)) | set(_TOKEN.findall(value.lower()))


def parse(page: str) -> Node:
    """Tree of a page; ``parts`` of a node are its texts and child nodes in order."""
    root = Node("html", None)
    stack, at, end = [root], 0, len(page)

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(html.unescape(piece) if "&" in piece else piece)

    def close(upto: int) -> None:
        del stack[max(1, upto) :]

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if name in INLINE and stack[i].name not in INLINE:
                    break  # a stray end tag of an inline element ends no block
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name not in INLINE:
                    break
            while len(stack) > 1 and stack[-1].name in INLINE and stack[-1].name != "a":
                close(len(stack) - 1)  # formatting that a block breaks off
        if name in ENDS:
            ended, within = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in within:
                    break
                if stack[i].name in ended:
                    close(i)
                    if name in ("li", "dt", "dd", "td", "th", "option"):
                        break
        node = Node(name, stack[-1], m[3])
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        if name in VOID or m[3].endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        stack.append(node)
    return root


def blocks(root: Node) -> list[Node]:
    """Visible block elements in page order; inline elements belong to the block around them."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.hidden:
            continue
        if node.name not in INLINE:
            out.append(node)
        todo.extend(reversed(node.children))
    return out


def own_text(node: Node) -> list[str]:
    """Texts of a block that stand directly in it, split where a child block stands between; a line break is a space."""
    runs: list[list[str]] = [[]]

    def walk(n: Node) -> None:
        stack: list[Iterator] = [iter(n.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, str):
                    runs[-1].append(part)
                elif part.hidden:
                    continue
                elif part.name == "br":
                    runs[-1].append(" ")
                elif part.name in INLINE:
                    stack.append(iter(part.parts))
                    break
                else:
                    runs.append([])
            else:
                stack.pop()

    walk(node)
    return ["".join(r) for r in runs]


FEATURES = (
    "name", "depth", "chars", "own_chars", "page_share", "link_share", "density", "punctuation", "words", "children", "siblings", "place", "page_place",
    "for_own", "against_own", "for_above", "against_above", "against_below", "in_article", "in_frame", "same_siblings", "mean_child_chars", "digits",
)
_FRAME = frozenset(("nav", "footer", "aside", "header", "form", "menu", "dialog", "fieldset"))

#: A form that holds one of these is wrapped around the page, as some servers do, and says no more than a ``div``.
_LANDMARKS = frozenset(("h1", "article", "main", "nav", "header", "footer", "aside"))


def _wrappers(nodes: list[Node], parent: np.ndarray) -> list[bool]:
    """Which nodes are forms around a page."""
    holds = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if parent[i] >= 0 and (holds[i] or nodes[i].name in _LANDMARKS):
            holds[parent[i]] = True
    return [h and node.name == "form" for h, node in zip(holds, nodes)]


def describe(nodes: list[Node], texts: list[list[str]]) -> np.ndarray:
    """Features of the blocks of one page."""
    number = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    own = np.zeros((n, 5))  # characters, of these in links, punctuation, words, digits
    for i, (node, runs) in enumerate(zip(nodes, texts)):
        t = " ".join(runs)
        size = len(t) - t.count(" ")
        linked = 0
        todo = [c for c in node.children if c.name in INLINE]
        while todo:
            c = todo.pop()
            if c.name == "a":
                linked += sum(len(x.strip()) for x in own_text(c))
            else:
                todo += [d for d in c.children if d.name in INLINE]
        own[i] = size, min(linked, size), sum(map(t.count, ".,;:!?")), len(t.split()), sum(map(t.count, "0123456789"))
    parent = np.full(n, -1)
    for i, node in enumerate(nodes):
        p = node.parent
        while p is not None and id(p) not in number:
            p = p.parent
        parent[i] = number[id(p)] if p is not None else -1
    wrapper = _wrappers(nodes, parent)
    names_of = ["div" if w else node.name for node, w in zip(nodes, wrapper)]
    tokens = [frozenset() if w else node.tokens for node, w in zip(nodes, wrapper)]
    below, count, against = own.copy(), np.ones(n), np.array([float(bool(t & AGAINST or x in _FRAME)) for t, x in zip(tokens, names_of)])
    kids: list[list[int]] = [[] for _ in nodes]
    below_against = against.copy()
    for i in range(n - 1, 0, -1):
        if (p := parent[i]) >= 0:
            below[p] += below[i]
            count[p] += count[i]
            below_against[p] += below_against[i]
            kids[p].append(i)
    x = np.zeros((n, len(FEATURES)))
    total, before = max(1.0, below[0, 0]), 0.0
    pro = [float(len(t & FOR)) for t in tokens]
    above = np.zeros((n, 4))
    for i, node in enumerate(nodes):
        p = parent[i]
        if p >= 0:
            above[i] = above[p]
            above[i, 0] += pro[p]
            above[i, 1] += len(tokens[p] & AGAINST)
            above[i, 2] = max(above[i, 2], names_of[p] in ("article", "main"))
            above[i, 3] = max(above[i, 3], names_of[p] in _FRAME)
        group = kids[p][::-1] if p >= 0 else [i]
        chars = max(1.0, below[i, 0])
        x[i] = (
            NAME_NUMBER.get(names_of[i], 0), node.depth, np.log1p(below[i, 0]), np.log1p(own[i, 0]), below[i, 0] / total, below[i, 1] / chars, np.log1p(below[i, 0] / count[i]),
            below[i, 2] / chars, np.log1p(below[i, 3]), len(kids[i]), len(group), 0.0, before / total, pro[i], len(tokens[i] & AGAINST), above[i, 0], above[i, 1],
            below_against[i] - against[i], max(above[i, 2], names_of[i] in ("article", "main")), max(above[i, 3], names_of[i] in _FRAME), 0.0,
            np.log1p(below[i, 0] / max(1, len(kids[i]))), below[i, 4] / chars,
        )
        before += own[i, 0]
    for group in kids:
        names: dict[str, int] = {}
        for j in group:
            names[nodes[j].name] = names.get(nodes[j].name, 0) + 1
        for place, j in enumerate(reversed(group)):
            x[j, 11] = place / len(group)
            x[j, 20] = names[nodes[j].name] / len(group)
    return x


def decode(nodes: list[Node], own_chars: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The consistent choice of largest gain: a rejected node rejects all below it."""
    number = {id(n): i for i, n in enumerate(nodes)}
    gain = np.clip(margin, -6, 6) * (own_chars + 1.0)
    keep = np.zeros(len(nodes), dtype=bool)
    parent = []
    for node in nodes:
        p = node.parent
        while p is not None and id(p) not in number:
            p = p.parent
        parent.append(number[id(p)] if p is not None else -1)
    for i in range(len(nodes) - 1, -1, -1):
        keep[i] = gain[i] > 0 or i == 0
        if keep[i] and parent[i] >= 0:
            gain[parent[i]] += gain[i]
    for i in range(1, len(nodes)):
        keep[i] &= keep[parent[i]]
    return keep


def extract(pages: list[str | None], trees: gbt.Trees) -> list[str]:
    """Main texts of some pages, whose nodes are scored together; empty if there is none."""
    out, held, xs, chars = [""] * len(pages), [], [], 0
    for i, page in enumerate(pages):
        if page:
            root = parse(page)
            nodes = blocks(root)
            xs.append(describe(nodes, [own_text(n) for n in nodes]))
            held.append((i, root, nodes))
            chars += len(page)
        if held and (chars > 400_000 or i == len(pages) - 1):
            margin, at = trees.margin(np.concatenate(xs)), 0
            for (j, root, nodes), x in zip(held, xs):
                out[j] = assemble(root, nodes, decode(nodes, np.expm1(x[:, 3]), margin[at : at + len(nodes)]))
                at += len(nodes)
            held, xs, chars = [], [], 0
    return out


def assemble(root: Node, nodes: list[Node], keep: np.ndarray) -> str:
    """Texts of the kept nodes in page order, one space between blocks."""
    chosen = {id(n) for n, k in zip(nodes, keep) if k}
    out: list[str] = []
    open_run: list[str] = []

    def flush() -> None:
        if t := _SPACE.sub(" ", "".join(open_run)).strip():
            out.append(t)
        open_run.clear()

    stack: list[tuple[Iterator, bool, bool]] = [(iter(root.parts), id(root) in chosen, True)]
    while stack:
        parts, kept, is_block = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if kept:
                    open_run.append(part)
            elif part.hidden:
                continue
            elif part.name == "br":
                open_run.append(" ")
            elif part.name in INLINE:
                stack.append((iter(part.parts), kept, False))
                break
            else:
                flush()
                stack.append((iter(part.parts), id(part) in chosen, True))
                break
        else:
            stack.pop()
            if is_block:
                flush()
    return " ".join(out)


#: Pages that the trees are trained on, and the seed of their generator.
TRAIN_PAGES, SEED = 700, 7
#: Share of names on those pages that hold a token of the other side as well.
MIXED = 0.4


_FOR, _AGAINST = sorted(FOR), sorted(AGAINST)


class Maker:
    """Builds pages whose main blocks are known."""

    def __init__(self, seed: int, mix: float = MIXED) -> None:
        self.r, self.mix = random.Random(seed), mix
        self.syllables = [a + b for a in "b c d f g l m n p r s t v st tr ch".split() for b in "a e i o u é ö ou en er".split()]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 1, high: int = 24) -> str:
        words = [self.word() + self.r.choice(("", "", "", "", "", ",")) for _ in range(self.r.randint(low, high))]
        odd = self.r.choice(("", "", "", "", "%%%", "###", "***", "$$$")) if self.odd else ""
        return (" ".join(w + odd for w in words)).capitalize() + self.r.choice((".", ".", ".", "", "!"))

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def links(self, n: int) -> list[str]:
        r = self.r
        words = lambda: " ".join(self.word() + r.choice(("", "", "", "", ".", ",")) for _ in range(r.randint(1, 5)))
        return [f'<a href="/{self.word()}">{r.choice((str.capitalize, str))(words())}</a>' for _ in range(n)]

    def mixed(self, name: str, decoys: list[str]) -> str:
        """A class or id, at times with a token that speaks for something else, as in ``content-with-sidebar``."""
        r = self.r
        if r.random() >= self.mix:
            return name
        other = r.choice(decoys)
        forms = (f"{name}-with-{other}", f"{name} {other}-{self.word()}", f"{other}-free {name}", f"{name}-{other}", f"{other}-{name}", f"{self.word()}-{other} {name} {self.word()}")
        return r.choice(forms)

    def named(self, tag: str, inside: str, decoys: list[str]) -> str:
        r = self.r.random()
        return f"<{tag}>{inside}</{tag}>" if r < 0.55 else f'<{tag} class="{self.mixed(self.word(), decoys)}">{inside}</{tag}>'

    def box(self, names: str, inside: str, tags: str = "div div div section aside", decoys: list[str] = _FOR) -> str:
        """An element that says what it is by name, class or id, or only by its content."""
        tag, name, r = self.r.choice(tags.split()), self.r.choice(names.split()), self.r.random()
        name = self.mixed(self.r.choice((name, f"{name}-box", f"site-{name}", f"{name}{self.r.randint(1, 9)}", f"c-{name}")), decoys)
        return f'<{tag} class="{name}">{inside}</{tag}>' if r < 0.6 else f'<{tag} id="{name}">{inside}</{tag}>' if r < 0.85 else f'<{tag} class="{self.word()} {name}">{inside}</{tag}>'

    def boiler(self) -> str:
        r, kind = self.r, self.r.randrange(12)
        items = "".join(f"<li>{x}</li>" for x in self.links(r.randint(3, 14)))
        if kind == 0:
            return f"<nav><ul>{items}</ul></nav>" if r.random() < 0.6 else self.box("menu navbar navigation breadcrumb", f"<ul>{items}</ul>")
        if kind == 1:
            inside = r.choice((f"<h1>{self.word()}</h1>", f"<p>{self.sentence(2, 9)}</p>", self.sentence(2, 9))) + r.choice(("", f"<ul>{items}</ul>"))
            return f"<header>{inside}</header>" if r.random() < 0.6 else self.box("header masthead topbar", inside)
        if kind == 2:
            return self.box("ad ads advert banner sponsored promo advertisement", r.choice((self.prose(1, 3), f"<p>{self.prose(1, 4)}</p>", f"<a href='/x'>{self.sentence(2, 8)}</a>")))
        if kind == 3:
            inside = r.choice((f"<h3>{self.sentence(1, 4)}</h3><ul>{items}</ul>", f"<p>{self.prose(1, 5)}</p>", self.prose(1, 3)))
            return f"<aside>{inside}</aside>" if r.random() < 0.6 else self.box("sidebar side widget related recommended", inside)
        if kind == 4:
            inside = r.choice((f"<p>{self.prose(1, 3)}</p><button>{self.word()}</button>", self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>"))
            return self.box("cookie consent notice alert popup gdpr", inside)
        if kind in (5, 6):
            one = lambda: r.choice((f"<div class='comment'><b>{self.word()}</b><p>{self.prose(1, 6)}</p></div>", f"<li><p>{self.prose(1, 4)}</p></li>", f"<p>{self.prose(1, 4)}</p>"))
            return self.box("comments comment-list discussion responses replies", r.choice(("", f"<h2>{self.word()}</h2>")) + "".join(one() for _ in range(r.randint(1, 7))), "div div section ul")
        if kind == 7:
            return f"<form action='/s'><label>{self.sentence(1, 6)}</label><input name='q'><p>{self.sentence(2, 12)}</p><button>{self.word()}</button></form>"
        if kind == 8:
            inside = r.choice(("&copy; ", "", "")) + r.choice((self.sentence(2, 9), f"<p>{self.prose(1, 3)}</p>", f"<ul>{items}</ul><p>{self.sentence()}</p>"))
            return f"<footer>{inside}</footer>" if r.random() < 0.65 else self.box("footer copyright legal", inside)
        if kind == 9:
            return self.box("share social toolbar", "".join(self.links(r.randint(2, 6))))
        if kind == 10:
            return self.box("newsletter subscribe signup", f"<h3>{self.sentence(1, 6)}</h3><p>{self.prose(1, 2)}</p>")
        return self.box("tags tagcloud pagination pager", "".join(self.links(r.randint(2, 9))))

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        self.odd = r.random() < 0.2
        main: list[str] = []

        def block(tag: str, low: int, high: int) -> str:
            t = self.prose(low, high) if high > 1 else self.sentence(1, 14)
            if tag[0] == "h" and r.random() < 0.75 or r.random() < 0.1:
                t = t.rstrip(".")  # headings and broken-off paragraphs
            main.append(t)
            if r.random() < 0.15:
                cut = t.split(" ")
                at = r.randrange(len(cut))
                cut[at] = f'<a href="/y">{cut[at]}</a>' if r.random() < 0.5 else f"<b>{cut[at]}</b>"
                t = " ".join(cut)
            return f"<{tag}>{t}</{tag}>"

        body = [block("h1", 1, 1)] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            k = r.random()
            if k < 0.78:
                body.append(block("p", 1, r.choice((1, 2, 6, 12))))
            elif k < 0.86:
                body.append(block(r.choice(("h2", "h3")), 1, 1))
            elif k < 0.92:
                body.append("<ul>" + "".join(block("li", 1, 2) for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.96:
                body.append(f"<blockquote>{block('p', 1, 3)}</blockquote>")
            else:
                body.append("<table><tr>" + "".join(block("td", 1, 1) for _ in range(r.randint(2, 6))) + "</tr></table>")
        if body and r.random() < 0.2:
            body[0] = f"<header>{body[0]}</header>"
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body.insert(r.randint(1, len(body)), self.boiler())
        inside, k = "".join(body), r.random()
        if k < 0.45:
            core = self.named("article", inside, _AGAINST)
        elif k < 0.55:
            core = self.named("main", inside, _AGAINST)
        elif k < 0.9:
            core = self.box("content post entry article main story body text article-body post-content", inside, "div div div section", _AGAINST)
        else:
            core = self.named("div", inside, _AGAINST)
        parts = [self.boiler() for _ in range(r.randint(0, 4))] + [core] + [self.boiler() for _ in range(r.randint(0, 4))]
        whole = "".join(parts)
        for _ in range(r.choice((0, 0, 1, 2))):
            whole = f"<div class='{r.choice(('wrap', 'container', 'page', 'row', self.word()))}'>{whole}</div>"
        return f"<html><head><title>{self.word()}</title></head><body>{whole}</body></html>", {_SPACE.sub(" ", t).strip() for t in main}


def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> gbt.Trees:
    """Trees from generated pages; the driver fits them in a few seconds."""
    maker, xs, ys, ws = Maker(seed), [], [], []
    for _ in range(pages):
        page, main = maker.page()
        nodes = blocks(parse(page))
        texts = [own_text(n) for n in nodes]
        number = {id(n): i for i, n in enumerate(nodes)}
        y = np.array([float(any(_SPACE.sub(" ", t).strip() in main for t in runs)) for runs in texts])
        for i in range(len(nodes) - 1, 0, -1):
            p = nodes[i].parent
            while p is not None and id(p) not in number:
                p = p.parent
            if p is not None:
                y[number[id(p)]] = max(y[number[id(p)]], y[i])
        xs.append(describe(nodes, texts))
        ys.append(y)
        ws.append(np.where(np.expm1(xs[-1][:, 3]) > 0, 1.0, 0.6))
    return gbt.fit(np.concatenate(xs), np.concatenate(ys), trees=60, depth=5, rate=0.2, bins=32, min_leaf=6, weight=np.concatenate(ws))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", trees: gbt.Trees | None = None) -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``text_col`` and its code points in ``n_chars``, in place of any such columns.

    Blocks stand in page order with one space between; white space in a block is one space, and character references
    are read.  A null or empty page, and one without an article, has an empty text.  Whole pages are read, however long
    or deeply nested.  Rows are independent, so repeated rows get equal texts.
    """
    trees = trees or train()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(extract([p if isinstance(p, str) else None for p in batch], trees), dtype=object)

    kept = [f"`{c}`" for c in pages.columns if c.lower() not in (text_col.lower(), "n_chars")]
    found = pages.select(*kept, run(F.col(f"`{html_col}`").cast("string")).alias(text_col))
    return found.withColumn("n_chars", F.length(text_col).cast("long"))
