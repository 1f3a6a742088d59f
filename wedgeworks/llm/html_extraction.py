"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks (runs of inline content between block-level tags). Blocks, and the elements
around them that say something of their text (semantic elements, roles, class and id words), are the nodes of
a graph. A logistic classifier gives each block the log odds of being content from its text and its
neighbours' texts (length, links, punctuation, place in headings, lists and tables); another gives each
element log odds from what it says and what is said around it. Log odds are terminal capacities, an element's
as often as it has blocks. Smoothness edges join blocks that follow each other, blocks with the last one of
the same parent, and blocks with the innermost element that speaks for them. The minimum cut separates
content from boilerplate: a short line in an article is content by its surroundings, a fine sentence in an
advert is not, and an element is outvoted when its blocks speak against it. Weights and edge capacities are
fitted on labelled pages (``html_training``) by pseudo-likelihood: a block's label is predicted from its own
features and the labels around it, so that terminals and edges are on one scale.

An element that names itself boilerplate but holds most of the page's text with its heading or article is a
wrapper and says nothing. Text that isn't shown (hidden elements, scripts, controls) takes no part.

Nodes whose terminal outweighs all their edges keep their side in every minimum cut. They are settled
first, which moves their edges to their neighbours' terminals; what is left goes to a max-flow search
(shortest augmenting paths by levels, without recursion).

Everything of a page stays in one row: no shuffle. Defined results: null and empty pages, and pages without
content, have empty text; unclosed and misnested tags, comments and tags cut off by the page's end are
read as far as they go; rows are independent, so ties and repeats agree.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, table
from .html_training import CUES, labelled_pages

#: Quotes matter only where an attribute's value begins; a quote that never closes ends with its tag.
ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|</?[A-Za-z][^\s/>]*+{ATTRIBUTES}(?:>|\Z)|[^<]+|<",
    re.S,
)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# fixed values: HTML's block-level, void and raw-text elements
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE_KEPT = frozenset("a button label select svg template noscript object video audio canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
# fixed values: elements and roles by what they hold
BOXES = frozenset("nav footer aside form menu dialog label fieldset".split())
UNSEEN = frozenset("button select svg template noscript head object video audio canvas map".split())
GOOD_ROLES = {"main": "main", "article": "article"}
BOX_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# fixed values: class and id words for boilerplate, for content, and words that name a box of any kind
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar aside "
    "footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall subscribe "
    "subscription newsletter signup login share sharing social related recommended recommendations trending widget comment comments "
    "discussion disqus reply replies respond feedback pagination pager toolbar copyright skip teaser outbrain taboola form search".split()
)
GOOD_WORDS = frozenset("article content post entry story main text prose".split())
ANY_BOX = frozenset("container wrapper wrap list inner outer box area section block bar items item links buttons button header head body slot unit group panel column col row".split())
#: What the elements around a block may say, after ``settle``.
SAYINGS = ("article", "many", "main", "good", "weak", "bad", "box", "head")
FEATURES = (
    "one", "length", "two_words", "five_words", "long", "linked", "mostly_linked", "ends", "commas", "heading", "title", "listed", "listed_link", "paragraph", "cell",
    "copyright", "fragment", "before", "after", "before_linked", "after_linked", "cue", "digits", "parent_share", "parent_prose", "alone", "apart",
)
EDGES = ("follows", "near", "said")


class Mark:
    """An element that says something about its text."""

    __slots__ = ("kind", "outer", "start", "chars", "anchors_before", "anchors", "says", "heard", "said_good", "said_bad", "in_good", "in_bad")

    def __init__(self, kind: str, outer: Mark | None, start: int, anchors: int):
        self.kind, self.outer, self.start, self.anchors_before = kind, outer, start, anchors
        self.chars = self.anchors = 0


class Element:
    __slots__ = ("name", "mark", "own", "number")

    def __init__(self, name: str, mark: Mark | None, own: Mark | None, number: int):
        self.name, self.mark, self.own, self.number = name, mark, own, number


def cue(token: str) -> str:
    """What a class name says: its last word that isn't just a box decides; other boilerplate words are weak."""
    words = [w.lower() for w in WORDS.findall(token)]
    while len(words) > 1 and words[-1] in ANY_BOX:
        words.pop()
    if not words:
        return ""
    if words[-1] in BAD_WORDS:
        return "bad"
    if words[-1] in GOOD_WORDS:
        return "good"
    return "weak" if any(w in BAD_WORDS for w in words) else ""


def kind_of(name: str, tag: str) -> str:
    """What an element says of its text: article, main, good, weak, bad, box, head, unseen, or nothing."""
    kind = name if name in ("article", "main") else "head" if name == "header" else "box" if name in BOXES else "unseen" if name in UNSEEN else ""
    if "=" not in tag and "hidden" not in tag:
        return kind
    said = set()
    for key, value in ATTRIBUTE.findall(tag[len(name) + 1 :]):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            said.update(map(cue, value.split()))
        elif key == "role":
            role = value.strip().lower()
            kind = GOOD_ROLES.get(role, "box" if role in BOX_ROLES else kind)
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "unseen"
        elif key == "itemprop" and value == "articleBody":
            said.add("good")
    if kind in ("box", "unseen"):
        return kind
    if "bad" in said:
        return "bad"
    return kind or ("good" if "good" in said else "weak" if "weak" in said else "")


class Block:
    __slots__ = ("text", "mark", "heading", "linked", "parent", "listed", "inside")

    def __init__(self, text: str, mark: Mark | None, heading: int, linked: int, parent: int, listed: bool, inside: str):
        self.text, self.mark, self.heading, self.linked, self.parent, self.listed, self.inside = text, mark, heading, linked, parent, listed, inside


HEADINGS = {f"h{i}": i for i in range(1, 7)}


def blocks_of(page: str) -> list[Block]:
    """The blocks that are shown, in page order, with what their elements say settled."""
    stack: list[Element] = []
    blocks: list[Block] = []
    marks: list[Mark] = []
    parts: list[str] = []
    linked = number = links = chars = anchors = 0
    at, end = 0, len(page)
    lowered = ""

    def flush() -> None:
        nonlocal parts, linked, chars
        text = " ".join("".join(parts).split())
        if text:
            names = {e.name for e in stack[-64:]}
            box = next((e.number for e in reversed(stack) if e.own or (e.name in BLOCK and e.name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"))), 0)
            inside = next((e.name for e in reversed(stack) if e.name in BLOCK), "")
            blocks.append(Block(text, stack[-1].mark if stack else None, min((HEADINGS[n] for n in names if n in HEADINGS), default=0), linked, box, "li" in names, inside))
            chars += len(text)
        parts, linked = [], 0

    def push(name: str, kind: str) -> None:
        nonlocal number, anchors
        outer = stack[-1].mark if stack else None
        own = None
        if kind and name not in ("html", "body"):
            own = Mark(kind, outer, chars, anchors)
            marks.append(own)
        if name == "h1" or kind in ("article", "main"):
            anchors += 1
        number += 1
        stack.append(Element(name, own or outer, own, number))

    def pop() -> Element:
        e = stack.pop()
        if e.own:
            e.own.chars, e.own.anchors = chars - e.own.start, anchors - e.own.anchors_before
        return e

    while at < end:
        m = TOKEN.match(page, at)
        token = m.group()
        at = m.end()
        if token[0] != "<" or token == "<":
            if not token.isspace():
                decoded = unescape(token) if "&" in token else token
                parts.append(decoded)
                if links:
                    linked += len(decoded)
            else:
                parts.append(" ")
            continue
        if token.startswith("<![CDATA["):
            continue
        named = NAME.match(token)
        if not named:
            continue
        name = named.group(1).lower()
        if token[1] == "/":
            if name == "br":
                parts.append(" ")
            if name == "a":
                links = 0
            if name in BLOCK:
                flush()
            if any(e.name == name for e in stack):
                # other inline elements are on the stack only if they, or one around them, say something
                inner = next(e for e in reversed(stack) if e.name == name)
                if name not in BLOCK and name != "a" and inner.own:
                    flush()
                while pop() is not inner:
                    pass
            continue
        if name in RAW:
            if not lowered:
                lowered = page.lower() if len(page.lower()) == end else re.sub("[A-Z]", lambda c: c.group().lower(), page)
            at = lowered.find("</" + name, at)
            at = end if at < 0 else at
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCK or name in INLINE_KEPT:
            if name in BLOCK or name != "a":
                flush()
            if name in BLOCK:
                if stack and stack[-1].name == "p":
                    pop()
                while stack and stack[-1].name in CLOSES.get(name, ()):
                    pop()
                if name == "body":  # a head that was never closed
                    stack = [e for e in stack if e.name != "head"]
            if name == "a":
                links = 1
                continue
            if name == "hr" or (token.endswith("/>") and name not in BLOCK):
                continue
            push(name, kind_of(name, token))
        elif name not in VOID:
            kind = kind_of(name, token) if "=" in token or "hidden" in token else ""
            kind = kind if kind in ("bad", "unseen") else ""
            if kind or any(e.name == name for e in stack):
                if kind:
                    flush()
                push(name, kind)
    flush()
    while stack:
        pop()
    settle(marks, chars)
    return [b for b in blocks if not b.mark or b.mark.says != "unseen"]


def settle(marks: list[Mark], chars: int) -> None:
    """What each mark says, given those around it and how much of the page it holds."""
    several = sum(m.kind == "article" and (m.outer is None or m.outer.kind != "article") for m in marks) > 1
    for m in marks:  # outer ones come first
        o = m.outer
        says, m.said_good, m.said_bad = (o.says, o.in_good, o.in_bad) if o else ("nothing", False, False)
        wraps = m.anchors > 0 and m.chars * 2 > chars or m.chars * 10 > chars * 9
        kind = m.kind
        if says == "unseen":
            kind = says
        elif kind in ("weak", "bad", "box", "unseen") and wraps:
            kind = ""
        elif kind == "head":
            kind = "head" if m.said_good and says not in ("bad", "box") else "box"
        elif kind == "article" and several and m.chars * 2 <= chars:
            kind = "many"
        m.says, m.heard = kind or says, m if kind else o
        m.in_good = m.said_good or m.says in ("article", "main", "good")
        m.in_bad = m.said_bad or m.says in ("bad", "box")


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    apart = any(b.mark and b.mark.says in ("article", "main", "good") for b in blocks)
    cues = frozenset(CUES)
    x = np.zeros((len(blocks), len(FEATURES)))
    total, held, prose = 0, {}, {}
    for b in blocks:
        plain = len(b.text) - min(b.linked, len(b.text))
        total += plain
        held[b.parent] = held.get(b.parent, 0) + plain
        prose[b.parent] = prose.get(b.parent, 0) + (b.text.count(" ") >= 9 and b.linked * 3 < len(b.text))
    for i, b in enumerate(blocks):
        text = b.text
        words = text.count(" ") + 1
        linked = min(1.0, b.linked / len(text))
        ends = text[-1] in ".!?\u2026\"\u201d\u00bb\u3002:"
        x[i, :17] = (
            1, math.log1p(min(words, 100)), words <= 2, words <= 5, words >= 25, linked, linked > 0.6, ends, min(1.0, 5 * text.count(",") / words),
            b.heading > 0, b.heading == 1, b.listed, b.listed and linked > 0.6, b.inside == "p", b.inside in ("td", "th"), "\u00a9" in text, words <= 5 and not ends and not b.heading,
        )
        x[i, 21:] = (
            words <= 15 and not cues.isdisjoint(text.lower().split()), sum(map(str.isdigit, text)) / len(text) if len(text) < 200 else 0.0,
            held[b.parent] / max(1, total), math.log1p(min(prose[b.parent], 10)), len(blocks) < 3, apart and (b.mark is None or b.mark.says == "nothing"),
        )
    x[1:, 17], x[:-1, 18] = x[:-1, 1], x[1:, 1]
    x[1:, 19], x[:-1, 20] = x[:-1, 5], x[1:, 5]
    return x


def speakers(blocks: list[Block]) -> tuple[list[Mark], list[int]]:
    """The elements that speak for blocks, and each block's element, -1 for none."""
    at: dict[int, int] = {}
    marks, of = [], []
    for b in blocks:
        m = b.mark
        while m is not None and m.heard is not m:  # one that says nothing itself leaves the word to the next around it
            m = m.heard
        if m is None:
            of.append(-1)
            continue
        if id(m) not in at:
            at[id(m)] = len(marks)
            marks.append(m)
        of.append(at[id(m)])
    return marks, of


def sayings(marks: list[Mark]) -> np.ndarray:
    """A row for each element: what it says, and whether content or boilerplate was said around it."""
    x = np.zeros((len(marks), len(SAYINGS) + 3))
    for i, m in enumerate(marks):
        x[i, SAYINGS.index(m.says)] = 1
        x[i, -3:] = m.said_good, m.said_bad, 1
    return x


def edges_of(blocks: list[Block], of: list[int]) -> tuple[list[tuple[int, int]], ...]:
    """EDGES: blocks that follow each other; nearness in the DOM, to the last block with the same parent; and blocks with their element, numbered after the blocks."""
    near, last = [], {}
    for i, b in enumerate(blocks):
        if (j := last.get(b.parent)) is not None:
            near.append((j, i))
        last[b.parent] = i
    return [(i, i + 1) for i in range(len(blocks) - 1)], near, [(i, len(blocks) + m) for i, m in enumerate(of) if m >= 0]


class Labeller:
    """Fitted weights of the features and sayings, and capacities of the kinds of edges."""

    def __init__(self, weights: np.ndarray, said: np.ndarray, capacities: tuple[float, ...]):
        self.weights, self.said, self.capacities = weights, said, capacities

    def costs(self, blocks: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
        """Log odds of the blocks, then of the elements that speak for them; and edge capacities."""
        marks, of = speakers(blocks)
        edges: dict[tuple[int, int], float] = {}
        for kind, capacity in zip(edges_of(blocks, of), self.capacities, strict=True):
            for e in kind:
                edges[e] = edges.get(e, 0.0) + capacity
        often = np.bincount([m for m in of if m >= 0], minlength=len(marks))
        return [*(features(blocks) @ self.weights).tolist(), *(sayings(marks) @ self.said * often).tolist()], edges


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
    return w


@lru_cache(maxsize=4)
def fitted(pages: int = 700, seed: int = 11, l2: float = 2.0) -> Labeller:
    """Both classifiers and the edges, which can't be negative."""
    rows, labels, around, spoken, heard = [], [], [], [], []
    for page, content in labelled_pages(pages, seed):
        blocks = blocks_of(page)
        if not blocks:
            continue
        marks, of = speakers(blocks)
        y = np.array([2.0 * (b.text in content) - 1 for b in blocks])
        votes = np.bincount([m for m in of if m >= 0], weights=[v for v, m in zip(y, of, strict=True) if m >= 0], minlength=len(marks))
        full = np.concatenate([y, np.sign(votes)])
        s = np.zeros((len(full), len(EDGES)))
        for k, kind in enumerate(edges_of(blocks, of)):
            for i, j in kind:
                s[i, k] += full[j]
                s[j, k] += full[i]
        rows.append(features(blocks))
        labels.append(y)
        around.append(s[: len(y)])
        spoken.append(sayings(marks))
        heard.append(votes > 0)
    x, y = np.concatenate([np.concatenate(rows), np.concatenate(around)], 1), (np.concatenate(labels) + 1) / 2
    w = logistic(x, y, l2)
    said = logistic(np.concatenate(spoken), np.concatenate(heard).astype(float), l2)
    return Labeller(w[: -len(EDGES)], said, tuple(max(0.0, float(c)) for c in w[-len(EDGES) :]))


def max_flow(odds: dict[int, float], edges: dict[tuple[int, int], float]) -> set[int]:
    """Nodes on the source (content) side of a minimum cut."""
    source, sink = -1, -2
    residual: dict[int, dict[int, float]] = {v: {} for v in (source, sink, *odds)}

    def link(a: int, b: int, there: float, back: float) -> None:
        residual[a][b] = residual[a].get(b, 0.0) + there
        residual[b][a] = residual[b].get(a, 0.0) + back

    for v, x in odds.items():
        link(source, v, x, 0.0) if x > 0 else link(v, sink, -x, 0.0)
    for (a, b), w in edges.items():
        link(a, b, w, w)
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for u, c in residual[v].items():
                if c > tiny and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return {v for v in level if v >= 0}
        todo = {v: iter(list(residual[v])) for v in level}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                amount = min(residual[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    residual[a][b] -= amount
                    residual[b][a] += amount
                cut = next(i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if residual[a][b] <= tiny)
                path = path[: cut + 1]
                continue
            for u in todo[v]:
                if residual[v][u] > tiny and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                level[v] = -1
                path.pop()


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is content in a cut of least capacity."""
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in odds]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    pull = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * len(odds)
    queue = deque(range(len(odds)))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(odds[i]) < pull[i]:
            continue
        label[i] = odds[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                odds[j] += w if label[i] else -w
                pull[j] -= w
                queue.append(j)
    if open_ := {i: odds[i] for i, x in enumerate(label) if x is None}:
        content = max_flow(open_, {e: w for e, w in edges.items() if e[0] in open_ and e[1] in open_})
        for i in open_:
            label[i] = i in content
    return [bool(x) for x in label]


def labelled(page: str | None, labeller: Labeller) -> tuple[list[Block], list[bool], list[bool]]:
    """A page's blocks, whether each is content by the cut, and by its own log odds alone."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return [], [], []
    odds, edges = labeller.costs(blocks)
    return blocks, minimum_cut(odds, edges)[: len(blocks)], [x > 0 for x in odds[: len(blocks)]]


def main_text(page: str | None, labeller: Labeller | None = None) -> str:
    blocks, kept, _ = labelled(page, labeller or fitted())
    return " ".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    labeller = fitted()  # here, once; the workers get its weights

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, labeller) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(extracted, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op6_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
