"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every text block is a node with a hidden label, content or not. A node's own features give its
unary potential (naive Bayes), the labels of parent and child a pairwise one; both are counted on labelled pages.
Sum-product message passing, once up and once down the tree, gives each node's exact marginal. Blocks that are
content with probability over a half, in page order, are the main text.

The labelled pages are generated here from layouts that web pages commonly have (`labelled_pages`); callers may
train on their own.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameflow.llm.common import mapped

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"

#: Fixed values of the HTML standard: elements without an end tag, with raw text, and laid out as blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title template iframe noembed noframes xmp svg select annotation annotation-xml".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold the whole page have a pairwise potential of their own.
PAGE = {"#root", "html", "body"}
#: A start tag of the key closes an open element of the values (up to a block that holds it).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}} | {t: {"table"} for t in ("tr", "td", "th", "tbody", "tfoot")}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(slots=True)
class Node:
    """An element, or a block of text if tag is #text."""

    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0  # characters of the text inside links
    kids: list[int] = field(default_factory=list)


def parse(html: str | None) -> list[Node]:
    """The elements and text blocks of a page in page order; node 0 is the root. Any input is accepted.

    Where each open tag stands on the stack is kept by tag, so no tag is searched for: time is linear in the page.
    """
    nodes = [Node("#root", -1)]
    stack: list[int] = [0]  # open block elements
    places: dict[str, list[int]] = defaultdict(list)  # by tag, where on the stack
    inline: Counter[str] = Counter()  # open inline tags of the innermost block
    piece: list[str] = []
    linked = 0
    html = html or ""

    def block_end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(piece)).strip()
        if text:
            nodes[stack[-1]].kids.append(len(nodes))
            nodes.append(Node("#text", stack[-1], text=text, linked=min(linked, len(text))))
        piece.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            t = entities.unescape(raw) if "&" in raw else raw
            piece.append(t)
            if inline["a"] or inline["button"]:
                linked += len(t.strip())

    def cut(to: int) -> None:
        for node in stack[to:]:
            places[nodes[node].tag].pop()
        del stack[to:]

    at = 0
    while m := _TOKEN.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if ending:
            if tag in BLOCKS:
                block_end()
                if places[tag]:
                    cut(places[tag][-1])
            elif inline[tag]:
                inline[tag] -= 1
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            piece.append(" ")
            continue
        if tag == "br":
            piece.append(" ")
            continue
        if tag in BLOCKS:
            block_end()
            ended = {"p"} | CLOSES.get(tag, set())  # end tags that the standard lets pages leave out
            if tag in SCOPE:
                scope = max((places[t][-1] for t in SCOPE[tag] if places[t]), default=0)
                cut(min((places[t][bisect_right(places[t], scope)] for t in ended if places[t] and places[t][-1] > scope), default=len(stack)))
            else:
                while len(stack) > 1 and nodes[stack[-1]].tag in ended:
                    cut(len(stack) - 1)
            if tag == "hr":
                continue
            names: list[str] = []
            if m[3]:
                for name, value in _ATTRIBUTE.findall(m[3]):
                    value = value.strip("\"'")
                    if name.lower() == "style":
                        names += ["hidden"] * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
                    elif name.lower() == "hidden":
                        names.append("hidden")
                    else:
                        names += [x.lower() for x in _NAMES.findall(value)]
            nodes[stack[-1]].kids.append(len(nodes))
            nodes.append(Node(tag, stack[-1], tuple(dict.fromkeys(names))))
            places[tag].append(len(stack))
            stack.append(len(nodes) - 1)
            inline.clear()
        elif tag not in VOID and not m[3].endswith("/"):
            inline[tag] += 1
    say(html[at:])
    block_end()
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """What each node shows by itself: tag and names of an element, length and links of a text."""
    n = len(nodes)
    chars, linked = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            chars[i], linked[i] = len(x.text), x.linked
        if x.parent >= 0:
            chars[x.parent] += chars[i]
            linked[x.parent] += linked[i]
    out = []
    for i, x in enumerate(nodes):
        share = 0 if not chars[i] else min(3, 4 * linked[i] // max(1, chars[i]))
        if x.tag == "#text":
            out.append([f"text={share},{(chars[i] >= 40) + (chars[i] >= 200)}"])
        else:
            out.append([f"tag={x.tag},{share > 1}", *(f"name={w}" for w in x.names)])
    return out


class TreeModel:
    """Potentials of the tree: log weights of features for content against not, and of parent-child label pairs."""

    def __init__(self, weight: dict[str, float], pair: np.ndarray, prior: float):
        self.weight, self.pair, self.prior = weight, pair, prior

    @classmethod
    def train(cls, pages: Iterable[tuple[list[Node], list[int]]]) -> "TreeModel":
        """pages: nodes and the 0/1 label of each."""
        seen: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
        pair, total = np.ones((2, 2, 2)), Counter()
        for nodes, labels in pages:
            for x, f, y in zip(nodes, features(nodes), labels):
                total[y] += 1
                for name in f:
                    seen[name][y] += 1
                if x.parent >= 0:
                    pair[int(nodes[x.parent].tag in PAGE), labels[x.parent], y] += 1
        n0, n1 = total[0] + 1.0, total[1] + 1.0
        weight = {k: max(-6.0, min(4.0, log(b / n1) - log(a / n0))) for k, (a, b) in seen.items()}
        return cls(weight, pair / pair.sum(2, keepdims=True), n1 / (n0 + n1))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, exact on the tree: messages to the root, then back."""
        n, get = len(nodes), self.weight.get
        tables = self.pair.tolist()
        above = [tables[x.parent >= 0 and nodes[x.parent].tag in PAGE] for x in nodes]
        own = []
        for f in features(nodes):
            s = max(-12.0, min(12.0, sum(get(x, 0.0) for x in f)))
            odds = 2.718281828459045**s
            own.append((1 / (1 + odds), odds / (1 + odds)))
        up0, up1 = [a for a, _ in own], [b for _, b in own]  # evidence at and below a node, by its label
        to0, to1 = [1.0] * n, [1.0] * n  # the message that it sends to its parent
        for i in range(n - 1, 0, -1):  # children come after their parents
            a, b = up0[i], up1[i]
            (p00, p01), (p10, p11) = above[i]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            s = m0 + m1
            to0[i], to1[i] = m0 / s, m1 / s
            p = nodes[i].parent
            a, b = up0[p] * to0[i], up1[p] * to1[i]
            s = a + b
            up0[p], up1[p] = (a / s, b / s) if s > 0 else (0.5, 0.5)
        out = [0.0] * n
        full0, full1 = [0.0] * n, [0.0] * n
        full0[0], full1[0] = up0[0] * (1 - self.prior), up1[0] * self.prior
        for i in range(n):
            if i:
                p = nodes[i].parent
                (p00, p01), (p10, p11) = above[i]
                a, b = full0[p] / max(to0[i], 1e-300), full1[p] / max(to1[i], 1e-300)  # the parent without this child
                full0[i], full1[i] = up0[i] * (a * p00 + b * p10), up1[i] * (a * p01 + b * p11)
            s = full0[i] + full1[i]
            full0[i], full1[i] = (full0[i] / s, full1[i] / s) if s > 0 else (0.5, 0.5)
            out[i] = full1[i]
        return out

    def main_text(self, html: str | None) -> list[str]:
        """The content blocks of a page."""
        nodes = parse(html)
        if all(x.tag == "#text" for x in nodes[1:]):  # no markup to judge by
            return [x.text for x in nodes[1:]]
        return [x.text for x, p in zip(nodes, self.marginals(nodes)) if x.tag == "#text" and p > 0.5]


def labelled_pages(pages: int = 400, seed: int = 11) -> Iterator[tuple[list[Node], list[int]]]:
    """Pages of common layouts, with content marked: every start tag of a content block carries the name `truth`."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ne", "ti", "ro", "su", "la", "mi", "der", "and")) for _ in range(r.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    prose = lambda: " ".join(line(3, 16) + r.choice(".,.?") for _ in range(r.randint(1, 9)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{line(1, 2)}</a></li>' for _ in range(r.randint(a, b)))

    def wrap(tags: tuple[str, ...], names: tuple[str, ...], body: str) -> str:
        tag = r.choice(tags)
        how = r.choice((f'class="{r.choice(names)}"', f'id="{r.choice(names)}"', "")) if tag != "div" and tag != "section" else r.choice((f'class="{r.choice(names)}"', f'id="{r.choice(names)}"'))
        return f"<{tag} {how}>{body}</{tag}>"

    def menu() -> str:
        return wrap(("nav", "nav", "div", "ul"), ("nav", "menu", "navbar", "main-menu", "breadcrumb", "topnav"), f"<ul>{links(2, 8)}</ul>")

    def advert() -> str:
        return wrap(("div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "banner-ad"), r.choice((prose(), f"<p>{prose()}</p>", f"<a href='#'>{line(2, 6)}</a>")))

    def sidebar() -> str:
        return wrap(("aside", "div"), ("sidebar", "related", "widget", "side", "recommended"), f"<h{(h := r.choice('2344'))}>{line(1, 3)}</h{h}>" + r.choice((f"<ul>{links(2, 6)}</ul>", f"<p>{prose()}</p>", f"<p>{line(2, 8)}</p>")))

    def notice() -> str:
        return wrap(("div", "section", "aside", "dialog"), ("cookie", "notice", "cookie-banner", "consent", "popup", "newsletter", "subscribe", "alert", "gdpr"), r.choice((prose(), f"<p>{prose()}</p><button>{line(1, 2)}</button>")))

    def form() -> str:
        return f"<form class='{r.choice(('search', 'login', 'signup', 'form'))}'><label>{line(1, 3)}</label><p>{line(2, 9)}</p><input><button>{line(1, 2)}</button></form>"

    def header() -> str:
        return wrap(("header", "header", "div"), ("header", "masthead", "top", "site-header"), r.choice((f"<p>{line(1, 5)}</p>", f"<a href='/'>{line(1, 3)}</a>", f"<h1>{line(1, 3)}</h1><ul>{links(2, 4)}</ul>", f"<h{(h := r.choice('12'))}>{line(1, 3)}</h{h}>")))

    def footer() -> str:
        return wrap(("footer", "footer", "div"), ("footer", "site-footer", "copyright", "legal", "bottom"), r.choice((f"&copy; {prose()}", f"<p>{prose()}</p><ul>{links(1, 4)}</ul>")))

    def comments() -> str:
        one = lambda: f"<{(t := r.choice(('div', 'div', 'li', 'li', 'p')))} class='{r.choice(('comment', 'comment', 'reply', 'comment-body'))}'>" + r.choice((f"<p>{prose()}</p>" * (t != "p"), prose())) + f"</{t}>"
        head = f"<h{(h := r.choice('2334'))}>{line(1, 3)}</h{h}>" if r.random() < 0.7 else ""
        return wrap(("section", "div", "ol"), ("comments", "comment-list", "discussion", "replies", "responses", "disqus", "user-comments"), head + "".join(one() for _ in range(r.randint(1, 5))))

    def article() -> str:
        t = 'data-x="1" class="truth"'
        bits = [f"<h1 {t}>{line(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.66:
                bits.append(f"<p {t}>{r.choice(('', '<b>'))}{prose()}" + r.choice(("</p>", "", f" <a href='#'>{line(1, 4)}</a> {prose()}</p>")))
            elif kind < 0.76:
                bits.append(f"<h{r.choice('2233')} {t}>{line(1, 7)}</h2>")
            elif kind < 0.84:
                bits.append(f"<{(u := r.choice(('ul', 'ol')))} {t}>" + "".join(f"<li {t}>{line(2, 14)}" for _ in range(r.randint(1, 5))) + f"</{u}>")
            elif kind < 0.89:
                bits.append(f"<blockquote {t}>{prose()}</blockquote>")
            elif kind < 0.93:
                bits.append(f"<table {t}><tr {t}><td {t}>{line(1, 4)}</td><td {t}>{line(1, 4)}</td></tr></table>")
            elif kind < 0.96:
                bits.append(f"<pre {t}>{line(3, 20)}</pre>")
            else:
                bits.append(f"<figure {t}><figcaption {t}>{line(2, 12)}</figcaption></figure>")
            if r.random() < 0.05:
                bits.append(r.choice((advert, notice))())
        tag, how = r.choice((("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry article"), ("section", "story main"), ("div", "article-content text")))
        if r.random() < 0.3:
            bits.insert(r.choice((0, len(bits), len(bits))), r.choice((comments, comments, sidebar, advert, header))())
        if r.random() < 0.15:
            return "".join(bits)
        return f"<{tag} class='truth {how}'>{''.join(bits)}</{tag}>"

    for _ in range(pages):
        top = [f() for f in (header, menu, notice, advert, form, menu) if r.random() < 0.5]
        end = [f() for f in (comments, sidebar, advert, form, notice, footer) if r.random() < 0.55]
        middle = article()
        if r.random() < 0.3:
            middle = f"<div class='wrapper'>{middle}{sidebar()}</div>"
        if r.random() < 0.2:
            middle = f"<main>{middle}</main>"
        if r.random() < 0.1:
            top, middle, end = [], r.choice((f"<div class='truth'>{prose()}</div>", f"<p class='truth'>{prose()}</p>" * 3)), []
        nodes = parse(f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title></head><body>{''.join(top)}{middle}{''.join(end)}</body></html>")
        labels = [0] * len(nodes)
        for i, x in enumerate(nodes):
            labels[i] = labels[x.parent] if x.tag == "#text" else int("truth" in x.names)
            x.names = tuple(w for w in x.names if w != "truth")
        yield nodes, labels


_DEFAULT: list[TreeModel] = []


def default_model() -> TreeModel:
    """The model of the generated pages, trained once per process."""
    if not _DEFAULT:
        _DEFAULT.append(TreeModel.train(labelled_pages()))
    return _DEFAULT[0]


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for every row of pages (page_id, url, html).

    Character references are decoded, white space inside a block is one space, blocks are joined by a line feed. A
    null or empty page, or one without content, has an empty text. Ids and urls, null or repeated, are kept as they
    are; other columns are ignored.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model or default_model()
        for batch in batches:
            found = [use.main_text(h) for h in batch.column("html").to_pylist()]
            texts = ["\n".join(b) for b in found]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").transform(mapped, step, SCHEMA)
