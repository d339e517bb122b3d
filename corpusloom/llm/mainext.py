"""Main text of web pages from flat blocks (operator 7).

A page is cut into flat text blocks at block-level tags. Each block is described by its
number of words and its link density, those of its neighbours, its kind (heading, paragraph,
other), the element that it stands in (the article, what surrounds it, neither) and how
far the names of classes around it speak of what is no article; a decision tree, grown from
the small labelled table below, keeps or drops it. Kept blocks are joined in page order.

Names are evidence, not a verdict: a word that often names a frame counts less beside other
words, and little in the slug of a heading. What follows a heading such as "3 comments" in
the same element counts as named so.

Defined results: null or empty pages give the empty text; markup that breaks off ends with
the page; what is not markup is text, however long. Repeated pages repeat. Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.base import append_arrow, texts

#: Fixed: elements of the HTML standard by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe svg object canvas select datalist audio video annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom menclose semantics mtable mtr mtd".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav aside footer form button menu dialog head fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p li blockquote pre dd dt td th figcaption".split())
#: Fixed: words in names of classes, ids and roles that mark what is no article; those that also name parts of one; words for content; words for layout.
HARD = frozenset(
    "ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments comentarios kommentare commentaires consent cookie cookies disqus menu nav navbar navigation "
    "newsletter pagination pager popup modal promo promoted promotion related replies respond share sharing sidebar signup sponsor sponsored subscribe subscription toolbar widget widgets "
    "contentinfo complementary".split()
)
SOFT = frozenset("header footer masthead disclaimer notice notices recommended reply social tags toc alert login search form".split())
CONTENT = frozenset("article post entry story content main body text news blog".split())
LAYOUT = frozenset("site page top bottom global wrapper wrap container box block section area bar list item left right inner outer the a".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|(?<=\s))(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
COMMENTS = re.compile(r"\(?\d*\)?\s*(?:(?:reader|user)\s+)?(?:comments?|responses?|kommentare?|commentaires?|comentarios?|leave\s+a\s+(?:reply|comment))\s*(?:\(\d+\))?:?", re.I)
_CLOSERS = {t: re.compile(rf"</{t}(?![A-Za-z0-9:-])[^>]*(?:>|\Z)", re.I) for t in RAW}
OPEN, MAINLY, FRAMED = 0, 1, 2  # the element a block stands in: none known, the article, what surrounds it
OTHER, PARAGRAPH, HEADING = 0, 1, 2
NO_HINT, WEAK, CLEAR, STRONG = 0, 1, 2, 3

#: The labelled blocks of pages that tell no container: kind, words, share of words in links, words and link share of the block before and after; keep or not.
LABELLED = """
0 1 1.0 0 0.0 1 1.0 0
0 2 1.0 1 1.0 3 1.0 0
0 4 0.9 5 1.0 60 0.0 0
0 6 1.0 80 0.0 4 1.0 0
0 3 0.0 2 1.0 2 1.0 0
0 5 0.0 0 0.0 4 1.0 0
0 8 0.6 10 0.8 6 0.9 0
0 20 0.9 9 1.0 12 1.0 0
0 30 0.7 25 0.9 5 1.0 0
0 7 0.0 3 0.0 2 0.0 0
0 9 0.1 4 1.0 3 0.5 0
0 6 0.0 90 0.0 0 0.0 0
0 4 0.0 5 0.0 5 0.0 0
0 8 0.0 3 1.0 90 0.0 1
0 6 0.0 2 0.5 55 0.0 1
0 35 0.0 0 0.0 50 0.0 1
0 60 0.0 7 0.0 80 0.0 1
0 90 0.05 60 0.0 45 0.0 1
0 200 0.1 90 0.0 100 0.1 1
0 25 0.0 90 0.0 60 0.0 1
0 14 0.0 70 0.0 50 0.0 1
0 5 0.0 80 0.0 75 0.0 1
0 45 0.2 14 0.0 3 1.0 1
0 30 0.0 30 0.0 2 1.0 1
0 120 0.0 3 1.0 4 1.0 1
1 3 1.0 2 1.0 3 1.0 0
1 2 1.0 1 1.0 6 0.0 0
1 2 1.0 3 1.0 80 0.0 0
1 4 0.0 3 1.0 3 1.0 0
1 6 0.0 2 1.0 2 1.0 0
1 9 0.8 70 0.0 5 1.0 0
1 4 0.0 80 0.0 75 0.0 1
1 3 0.0 40 0.0 50 0.0 1
1 5 0.0 12 0.0 9 0.0 1
1 7 0.0 30 0.0 6 0.0 1
1 4 0.0 60 0.0 2 1.0 1
1 6 0.0 45 0.0 0 0.0 1
1 12 0.0 5 0.0 10 0.0 1
1 18 0.1 6 0.0 20 0.0 1
1 30 0.0 3 1.0 40 0.0 1
1 60 0.1 4 0.0 3 1.0 1
1 150 0.05 80 0.0 90 0.0 1
2 2 0.0 30 0.0 3 1.0 0
2 3 0.0 0 0.0 2 1.0 0
2 1 0.0 2 1.0 1 1.0 0
2 4 1.0 3 1.0 12 0.8 0
2 5 0.0 60 0.0 0 0.0 0
2 6 0.0 3 1.0 60 0.0 1
2 6 0.0 0 0.0 60 0.0 1
2 9 0.0 2 1.0 8 0.0 1
2 4 0.0 90 0.0 50 0.0 1
2 1 0.0 80 0.0 45 0.0 1
2 3 0.0 7 0.0 12 0.0 1
2 8 0.1 3 1.0 25 0.0 1
"""
#: Blocks in a container whose name is weak evidence: words, link share, words and link share before and after; keep or not.
WEAKLY = """
2 0.0 0 0.0 2 0.0 0
4 0.0 3 1.0 3 1.0 0
5 1.0 4 1.0 5 1.0 0
9 0.0 2 1.0 4 0.5 0
12 0.9 8 1.0 9 1.0 0
30 0.8 9 1.0 4 1.0 0
3 0.0 6 0.0 4 0.0 0
6 0.0 40 0.0 50 0.0 1
5 0.0 2 1.0 60 0.0 1
25 0.0 6 0.0 30 0.0 1
40 0.1 9 0.0 5 0.0 1
90 0.0 60 0.0 70 0.0 1
150 0.05 3 1.0 4 1.0 1
"""


@dataclass
class Block:
    text: str
    words: int
    linked: int
    container: int
    hint: int
    kind: int


def hint_of(name: str, attrs: str, container: int) -> int:
    """How far an element's class, id and role speak of what is no article."""
    most = NO_HINT
    for m in ATTR.finditer(attrs):
        attr = m[1].lower()
        if attr == "id" and (name in HEADINGS or name in PROSE):
            continue  # the slug of what it says
        for token in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in WORDS.findall(token)}
            if container == MAINLY:
                words -= {"header"}  # an article's own header has its headline
            hard, soft = words & HARD, words & SOFT
            if hard:
                most = max(most, STRONG if len(words) <= (2 if attr == "id" else 3) else WEAK)
            elif soft:
                rest = words - soft - LAYOUT
                most = max(most, NO_HINT if rest & CONTENT else WEAK if rest else CLEAR)
    return STRONG if HIDDEN.search(attrs) else most


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order; whole, with references decoded and white space made single."""
    out: list[Block] = []
    held: list[tuple[str, bool]] = []
    #: Open elements: name, container, hint.
    stack: list[list] = [["", OPEN, NO_HINT]]
    open_names: Counter[str] = Counter()
    links = at = 0

    def pop() -> None:
        open_names[stack.pop()[0]] -= 1

    def close() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            words = text.count(" ") + 1
            linked = sum(len(html.unescape(t).split()) for t, a in held if a)
            name, container, hint = stack[-1]
            if name in HEADINGS and words < 6 and COMMENTS.fullmatch(text):
                hint = stack[-2][2] = STRONG  # what follows in the same element
            out.append(Block(text, words, min(linked, words), container, hint, HEADING if name in HEADINGS else PARAGRAPH if name in PROSE else OTHER))
        held.clear()

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            held.append((page[at:], links > 0))
            break
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or ""
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                end = _CLOSERS[name].search(page, at)
                at = end.end() if end else n
            held.append((" ", links > 0))
            continue
        if name == "br":
            held.append((" ", links > 0))
        up, own = stack[-1][1], NO_HINT
        if attrs and not closing and name not in VOID:
            own = hint_of(name, attrs, up)
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            if own < CLEAR and not (closing and open_names[name]):
                continue
        close()
        if closing:
            if open_names[name]:  # else nothing of that name is open: no search through what is
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        # Elements left open end where the next block begins.
        while stack[-1][0] == "p" or stack[-1][0] == name == "li":
            pop()
        kind, hint = stack[-1][1], max(stack[-1][2], own)
        if kind != FRAMED:
            role = attrs and re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attrs, re.I)
            if name in MAIN or role:
                kind = MAINLY
            if name in FRAME or (name == "header" and kind != MAINLY):
                kind = FRAMED
        if name not in INLINE:
            links = 0
        stack.append([name, kind, hint])
        open_names[name] += 1
    close()
    return out


def describe(own: list[Block]) -> np.ndarray:
    """One row of features for each block: container, hint, kind, then words and link share of it, the one before and the one after."""
    rows = [(b.words, b.linked / b.words) for b in own]
    none = (0, 0.0)
    return np.array([[b.container, b.hint, b.kind, *rows[i], *(rows[i - 1] if i else none), *(rows[i + 1] if i + 1 < len(rows) else none)] for i, b in enumerate(own)], dtype=float).reshape(-1, 9)


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
        self.value = bool(y.mean() >= 0.5) if len(y) else False
        self.feature: int | None = None
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        best = 1e-12
        base = len(y) * y.mean() * (1 - y.mean())
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                a, b = y[x[:, f] <= t], y[x[:, f] > t]
                gain = base - sum(len(s) * s.mean() * (1 - s.mean()) for s in (a, b))
                if min(len(a), len(b)) >= least and gain > best + 1e-12:
                    best, self.feature, self.at = gain, f, t
        if self.feature is not None:
            low = x[:, self.feature] <= self.at
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.at
        out = np.empty(len(x), dtype=bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def labelled(table: str = LABELLED, weakly: str = WEAKLY) -> np.ndarray:
    """The whole labelled table: the rows above, and blocks of an article (kept), of its frame and of clearly named containers (dropped) of many shapes."""
    rows = [[OPEN, NO_HINT, *map(float, line.split())] for line in table.strip().splitlines()]
    rows += [[c, WEAK, k, *map(float, line.split())] for line in weakly.strip().splitlines() for c in (OPEN, MAINLY) for k in (OTHER, PARAGRAPH)]
    known = [(MAINLY, NO_HINT, 1), (FRAMED, NO_HINT, 0), (FRAMED, STRONG, 0)] + [(c, h, 0) for c in (OPEN, MAINLY) for h in (CLEAR, STRONG)]
    for (container, hint, label), kind, words, before, after in product(known, (OTHER, PARAGRAPH, HEADING), (1, 3, 8, 30, 200), (0, 2, 9, 80), (0, 2, 9, 80)):
        share = (0.0, 0.1, 0.5, 0.0)[(words + before + after) % 4]
        rows.append([container, hint, kind, words, share, before, 1.0 if before == 2 else 0.0, after, 1.0 if after == 2 else 0.0, label])
    return np.array(rows)


def train(table: str = LABELLED, weakly: str = WEAKLY) -> Tree:
    rows = labelled(table, weakly)
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    own = blocks(page or "")
    if not own:
        return ""
    return " ".join(b.text for b, keep in zip(own, tree.predict(describe(own))) if keep)


def extract(df: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` (string) and ``n_chars`` (long, code points) of every whole page. One Arrow pass, no shuffle."""

    def make():
        tree = train()

        def work(column):
            out = [main_text(t, tree) for t in texts(column)]
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return work

    return append_arrow(df, [page], make, [("text", T.StringType(), pa.string()), ("n_chars", T.LongType(), pa.int64())], keep)
