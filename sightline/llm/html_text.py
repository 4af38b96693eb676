"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a two-state node (content or not). Node potentials are learned log likelihoods of what the
element shows (tag, class and id words, link share, length, sentence ends); potentials between parent and child are
learned transition rates for the child's tag. Sum-product messages go up the tree and down again and give each node's
exact marginal; the text of blocks that are more likely content than not is kept, in page order.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import in_small_batches

# Element names by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object select textarea option button canvas audio video title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
P_SCOPE = frozenset("article aside blockquote body div li main section table td th".split())
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_P = frozenset({"p"})

#: Most labelled pages that the model is trained on.
LABELLED_PAGES = 2_000


# Elements whose inside is not markup.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_WHITE = " \t\n\r\f"
_TAG_NAME = re.compile(f"[A-Za-z][^{_WHITE}/>]*")
_BETWEEN = re.compile(f"[{_WHITE}/]*")
_ATTRIBUTE = re.compile(f"[^{_WHITE}/>][^{_WHITE}/>=]*")
_EQUALS = re.compile(f"[{_WHITE}]*=[{_WHITE}]*")
_UNQUOTED = re.compile(f"[^{_WHITE}>]*")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(f"</{tag}(?=[{_WHITE}/>])", re.IGNORECASE) for tag in RAW}


class _Node:
    __slots__ = ("tag", "names", "parent", "own", "total", "linked", "stops")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int):
        self.tag, self.names, self.parent = tag, names, parent
        self.own = self.total = self.linked = self.stops = 0


class _Tree:
    """Block elements in page order, each after its parent, and the runs of text between block bounds."""

    def __init__(self):
        self.nodes = [_Node("#root", (), -1)]
        #: open elements: (tag, block node or that of the nearest block, is it hidden)
        self.open: list[tuple[str, int, bool]] = [("#root", 0, False)]
        #: depths of the open elements of each name, so that none is searched for
        self.depths: dict[str, list[int]] = {}
        #: (node, text) and (-1, "") at block bounds, in page order
        self.runs: list[tuple[int, str]] = []
        self.links = 0

    def _deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _end_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, _, _ = self.open.pop()
            self.depths[tag].pop()
            self.links -= tag == "a"
            if tag not in INLINE:
                self.runs.append((-1, ""))

    def _close_open(self, tags, stop) -> None:
        depth = self._deepest(tags)
        if depth and depth > self._deepest(stop - tags):
            self._end_to(depth)

    def start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if tag in CLOSES_P:
            self._close_open(_P, P_SCOPE)
        if tag in SAME:
            self._close_open(SAME[tag], SCOPE[tag])
        if tag not in INLINE:
            self.runs.append((-1, ""))
        if tag in VOID:
            return
        _, node, hidden = self.open[-1]
        if tag not in INLINE:
            names: list[str] = []
            for key, value in attributes:
                if key in ("class", "id", "role"):
                    names += re.findall("[a-z]+", value.lower())
                hidden = hidden or key == "hidden" or (key == "style" and bool(re.search(r"display\s*:\s*none", value)))
            self.nodes.append(_Node(tag, tuple(dict.fromkeys(names)), node))
            node = len(self.nodes) - 1
        self.links += tag == "a"
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, hidden or tag in HIDDEN))

    def end(self, tag: str) -> None:
        depth = self._deepest((tag,))
        if depth:
            self._end_to(depth)

    def data(self, data: str) -> None:
        _, node, hidden = self.open[-1]
        if hidden:
            return
        data = unescape(data)
        self.runs.append((node, data))
        size = len(data) - data.count(" ")
        if size and not data.isspace():
            own = self.nodes[node]
            own.own += size
            own.linked += size if self.links else 0
            own.stops += sum(map(data.count, ".!?。"))

    def read(self, html: str) -> _Tree:
        """Reads a whole page from left to right, each character once. Nothing in it is an error: what a comment, tag or
        declaration that never ends would hold is left out, as browsers do."""
        at, size = 0, len(html)
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self.data(html[at:])
                break
            if mark > at:
                self.data(html[at:mark])
            at = self._markup(html, mark)
        return self

    def _markup(self, html: str, mark: int) -> int:
        """Reads what begins with the < at mark; returns the place behind it."""
        closing = html.startswith("/", mark + 1)
        name = _TAG_NAME.match(html, mark + 1 + closing)
        if name:
            return self._tag(html, name[0].lower(), name.end(), closing)
        if html.startswith("!--", mark + 1):
            if html.startswith(">", mark + 4) or html.startswith("->", mark + 4):
                return html.index(">", mark) + 1
            found = _COMMENT_END.search(html, mark + 4)
            return found.end() if found else len(html)
        if html[mark + 1 : mark + 2] in ("!", "?", "/"):
            end = html.find(">", mark)
            return end + 1 if end >= 0 else len(html)
        self.data("<")
        return mark + 1

    def _tag(self, html: str, tag: str, at: int, closing: bool) -> int:
        attributes: list[tuple[str, str]] = []
        while True:
            at = _BETWEEN.match(html, at).end()
            if at >= len(html):
                return at
            if html[at] == ">":
                break
            key = _ATTRIBUTE.match(html, at)
            at, value = key.end(), ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote and quote in "'\"":
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return len(html)
                    value, at = html[at + 1 : end], end + 1
                else:
                    found = _UNQUOTED.match(html, at)
                    value, at = found[0], found.end()
            attributes.append((key[0].lower(), unescape(value)))
        at += 1
        if closing:
            self.end(tag)
            return at
        self.start(tag, attributes)
        if tag in RAW:  # its inside is never part of the text
            found = _RAW_END[tag].search(html, at)
            return found.start() if found else len(html)
        return at


def parse(html: str) -> _Tree:
    tree = _Tree().read(html)
    for node in tree.nodes:
        node.total += node.own
    for node in reversed(tree.nodes[1:]):  # children come after their parents
        up = tree.nodes[node.parent]
        up.total, up.linked, up.stops = up.total + node.total, up.linked + node.linked, up.stops + node.stops
    return tree


def _kind(node: _Node) -> str:
    """The tag, apart for elements with a class, id or role."""
    return node.tag + "." * bool(node.names)


def _features(node: _Node, parent: _Node) -> list[str]:
    share = node.linked / node.total if node.total else 0.0
    out = [f"kind={_kind(node)} links={0 if not node.linked else 1 + int(share * 3.99)}", f"size={min(10, node.total.bit_length())}"]
    if node.total:
        out.append(f"stops={min(4, int(200 * node.stops / node.total))}")
    return out + [f"kind={_kind(node)} under={_kind(parent)}"] + [f"name={n}" for n in node.names]


def joined(tree: _Tree, kept: np.ndarray) -> str:
    """The text of kept nodes: blocks in page order, white space as one space."""
    return " ".join("".join(" " if node < 0 else text for node, text in tree.runs if node < 0 or kept[node]).split())


class ContentModel:
    """Potentials from labelled trees; content() gives each node's marginal."""

    def __init__(self, labelled: list[tuple[str, str]]):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        moves: dict[str, np.ndarray] = {}
        total = np.ones(2)
        for html, text in labelled:
            tree = parse(html)
            label = self._labels(tree, text)
            for node, y in zip(tree.nodes[1:], label[1:]):
                if not node.total:
                    continue
                total[y] += 1
                seen[y].update(_features(node, tree.nodes[node.parent]))
                moves.setdefault(_kind(node), np.full((2, 2), 0.5))[label[node.parent], y] += 1
        self.node = {f: math.log((seen[1][f] + 0.5) / total[1]) - math.log((seen[0][f] + 0.5) / total[0]) for f in seen[0] | seen[1]}
        every = sum(moves.values(), np.full((2, 2), 0.5))
        self.moves = {kind: np.log(m / m.sum(axis=1, keepdims=True)) for kind, m in moves.items()}
        self.any_move = np.log(every / every.sum(axis=1, keepdims=True))

    @staticmethod
    def _labels(tree: _Tree, text: str) -> list[int]:
        """A block is content if its text is what the page's main text goes on with, or a long part of the rest of it; a
        container goes with most of its text."""
        main, at = " ".join(text.split()) + " ", 0
        own: list[list[str]] = [[] for _ in tree.nodes]
        for node, piece in tree.runs:
            if node >= 0:
                own[node].append(piece)
        inside = [0] * len(tree.nodes)
        for i, pieces in enumerate(own):
            said = " ".join("".join(pieces).split())
            found = main.find(said + " ", at) if len(said) > 60 else at if main.startswith(said + " ", at) else -1
            if said and found >= 0:
                at = found + len(said) + 1
                inside[i] = tree.nodes[i].own
        for i in range(len(tree.nodes) - 1, 0, -1):
            inside[tree.nodes[i].parent] += inside[i]
        return [int(n.total > 0 and 2 * k > n.total) for n, k in zip(tree.nodes, inside)]

    def content(self, tree: _Tree) -> np.ndarray:
        """The probability that each node is content: messages from the leaves to the root and back."""
        n = len(tree.nodes)
        local = [(0.0, 0.0)] * n
        for i, node in enumerate(tree.nodes):
            if node.total and i:
                # features overlap, so each counts for half
                local[i] = (0.0, 0.5 * sum(self.node.get(f, 0.0) for f in _features(node, tree.nodes[node.parent])))
        exp, log1p = math.exp, math.log1p

        def lse(a: float, b: float) -> float:
            high, low = (a, b) if a > b else (b, a)
            return high + log1p(exp(low - high))

        below = [list(x) for x in local]
        up = [(0.0, 0.0)] * n
        moves = [self.moves.get(_kind(node), self.any_move).tolist() for node in tree.nodes]
        for i in range(n - 1, 0, -1):
            m, (a, b) = moves[i], below[i]
            up[i] = (lse(m[0][0] + a, m[0][1] + b), lse(m[1][0] + a, m[1][1] + b))
            parent = below[tree.nodes[i].parent]
            parent[0] += up[i][0]
            parent[1] += up[i][1]
        belief = [tuple(below[0])] + [(0.0, 0.0)] * (n - 1)
        for i in range(1, n):
            m, (p, q) = moves[i], belief[tree.nodes[i].parent]
            p, q = p - up[i][0], q - up[i][1]  # without what the node itself said
            a, b = below[i][0] + lse(p + m[0][0], q + m[1][0]), below[i][1] + lse(p + m[0][1], q + m[1][1])
            norm = lse(a, b)
            belief[i] = (a - norm, b - norm)
        return np.array([1 / (1 + exp(min(700.0, a - b))) for a, b in belief])

    def extract(self, html: str) -> str:
        tree = parse(html)
        return joined(tree, self.content(tree) > 0.5)


def labelled_pages(number: int = 400, seed: int = 11) -> list[tuple[str, str]]:
    """Made-up labelled pages (html, main text) in varied layouts: what the model is trained on without others."""
    r = random.Random(seed)
    syllables = "ba co da fe gi lo mu na pe ri so tu va".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    some = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: some(r.randrange(3, 22)).capitalize() + r.choice(".....!?")
    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 6, 12])))
    link = lambda: f'<a href="/{word()}">{some(r.randrange(1, 3))}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randrange(2, 9))) + "</ul>"

    def named(tag: str, names: str, inside: str) -> str:
        key = r.choice(["class", "class", "id"])
        return f'<{tag} {key}="{r.choice(names.split("|"))}">{inside}</{tag}>'

    def junk_inside() -> str:
        p = f"<p>{prose()}</p>"
        return r.choice(
            [
                lambda: named("div", "ad|ads|advert|advertisement|sponsored|promo|banner", r.choice([p, some(5), link()])),
                lambda: named(r.choice(["aside", "div"]), "sidebar|related|widget|recommended|trending", f"<h3>{some(2)}</h3>" + r.choice([links(), p])),
                lambda: named("div", "share|social|tools|toolbar|meta|tags", links()),
                lambda: f"<aside>{p}</aside>",
                lambda: f"<form><label>{some(2)}</label><input name=q><p>{sentence()}</p></form>",
                lambda: named("div", "newsletter|subscribe|signup", f"<p>{sentence()}</p>" + r.choice(["", "<form><input></form>"])),
            ]
        )()

    def comments() -> str:
        one = lambda: named(r.choice(["div", "li", "article"]), "comment|reply|comment body", f"<p>{prose()}</p>" + r.choice(["", f"<span>{word()}</span>"]))
        return named(r.choice(["section", "div"]), "comments|comment list|discussion|responses|replies", f"<h3>{some(2)}</h3>" + "".join(one() for _ in range(r.randrange(1, 6))))

    def block() -> str:
        return r.choice(
            [
                lambda: f"<p>{prose()}</p>",
                lambda: f"<p>{prose()}</p>",
                lambda: f"<p>{prose()}</p>",
                lambda: f"<p>{sentence()} <b>{some(2)}</b> {link()} {sentence()}</p>",
                lambda: f"<h2>{some(3)}</h2>",
                lambda: f"<blockquote><p>{prose()}</p></blockquote>",
                lambda: "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>",
                lambda: f"<pre>{some(9)}</pre>",
                lambda: f"<table><tr><td>{some(2)}</td><td>{sentence()}</td></tr></table>",
                lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>",
                lambda: f"<div>{prose()}</div>",
                lambda: f"<section><h3>{some(2)}</h3><p>{prose()}</p></section>",
            ]
        )()

    out = []
    for _ in range(number):
        parts = [f"<h1>{some(r.randrange(2, 9))}</h1>"] + [block() for _ in range(r.choice([1, 2, 4, 9, 15]))]
        plain = _Tree().read("".join(parts))
        text = joined(plain, np.ones(len(plain.nodes), bool))
        for _ in range(r.choice([0, 0, 1, 2])):
            parts.insert(r.randrange(1, len(parts) + 1), junk_inside())
        if r.random() < 0.15:
            parts.append(comments())
        body = "".join(parts)
        main = r.choice([f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", named("div", "content|post|entry|article|story|main|article body|post content", body)])
        page = []
        if r.random() < 0.5:
            page.append(f"<header>{r.choice([some(3), f'<h1>{some(2)}</h1>', links()])}</header>")
        if r.random() < 0.8:
            page.append(r.choice([f"<nav>{links()}</nav>", named("div", "menu|nav|navigation|navbar|breadcrumbs", links())]))
        if r.random() < 0.4:
            page.append(named("div", "cookie|cookies|notice|consent|alert|popup|modal", f"<p>{prose()}</p>"))
        if r.random() < 0.5:
            page.append(junk_inside())
        page.append(main)
        if r.random() < 0.3:
            page.append(comments())
        if r.random() < 0.5:
            page.append(junk_inside())
        page.append(r.choice([f"<footer>&copy; {some(4)}</footer>", f"<footer><p>{prose()}</p>{links()}</footer>", named("div", "footer|copyright|legal", f"<p>{sentence()}</p>")]))
        out.append((f"<html><head><title>{some(3)}</title></head><body>{''.join(page)}</body></html>", text))
    return out


def _run(model):
    def run(batches):
        for batch in batches:
            texts = [model.value.extract(html.as_py() or "") for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id, url, html): the whole page's main text, empty if none.

    labelled (html, text) are pages with their main text, of which the first LABELLED_PAGES by hash train the model;
    without it made-up pages do. Null and empty pages have an empty text. No markup is an error: unknown
    declarations are comments, end tags without a start are passed over, and what a comment, tag or quoted value that never
    ends would hold is left out. Deep and long pages take time in proportion to their length. Repeated rows come back once each; other columns are ignored; an empty table gives no rows.
    """
    if labelled is None:
        known = labelled_pages()
    else:
        rows = labelled.selectExpr("html", "text", "xxhash64(html) as rank").filter("html is not null and text is not null")
        known = [(r.html, r.text) for r in rows.orderBy("rank", "html").limit(LABELLED_PAGES).collect()]
    model = pages.sparkSession.sparkContext.broadcast(ContentModel(known))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return in_small_batches(pages).select("page_id", "url", "html").mapInArrow(_run(model), f"page_id {kinds['page_id']}, url string, text string")
