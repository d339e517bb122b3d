"""Benchmark decontamination (operator 10).

The test items' normalised words make one generalised suffix automaton. A document's words
stream through it and the longest matching length is tracked; wherever it reaches a window
(``window`` words, or a whole shorter item) the words of that window are hit. Documents are
read once, with no shuffle: the automaton is broadcast. Its size is checked: items beyond
``SHARD_WORDS`` words go to further automata, which the driver sends one by one and a worker
holds one by one, each for ``GATHER`` bytes of documents at a time.

Defined results: a null text has no words; an item without words matches nothing; repeated
items count by their ids. Null item ids are left out of the lists of items.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.base import append_arrow, aside, held, quoted

#: Words of items in one automaton at most: bounds what is broadcast and held by a worker at once.
SHARD_WORDS = 150_000
#: Bytes of documents that pass through several automata in turn.
GATHER = 32 << 20
#: ASCII: letters to lower case, digits as they are, all else to a space; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items that own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        rows = []
        for name, words in items:
            if words:
                ids = [self.number.setdefault(w, len(self.number)) for w in words]
                rows.append((name, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        #: For each state, the nearest one on its suffix path whose strings' last ``window`` words are the same.
        n = len(self.len)
        self.at_window = [-1] * n
        self.shorts: list[tuple[tuple[int, str], ...]] = [()] * n
        order = sorted(range(n), key=self.len.__getitem__)
        for v in order[1:]:
            p = self.link[v]
            self.at_window[v] = v if self.len[p] < window <= self.len[v] else self.at_window[p]
        self.owners: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        for name, ids in rows:
            v = 0
            if len(ids) < window:
                self.least = min(self.least, len(ids))
                for w in ids:
                    v = self.next[v][w]
                short.setdefault(v, []).append((len(ids), name))
                continue
            for i, w in enumerate(ids):
                v = self.next[v][w]
                if i >= window - 1:
                    self.owners.setdefault(self.at_window[v], set()).add(name)
        for v in order[1:]:
            self.shorts[v] = self.shorts[self.link[v]] + tuple(short.get(v, ()))
        codes = {a * len(self.number) + b for _, ids in rows for a, b in zip(ids, ids[1:])}
        self.bigrams = np.array(sorted(codes), dtype=np.int64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nxt.append(dict(nxt[q]))
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (word positions, end exclusive, by end), items found, longest match of a window or more (else 0)."""
        n = len(words)
        if n < self.least or not self.number:
            return [], set(), 0
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=n)
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        for a, b in self._segments(ids):
            longest = max(longest, self._stream(ids[a:b].tolist(), a, spans, found))
        return spans, found, longest

    def _segments(self, ids: np.ndarray):
        """Stretches in which every two neighbours are neighbours in some item: no match crosses their ends."""
        if self.least < 2:
            yield 0, len(ids)
            return
        code = ids[:-1] * len(self.number) + ids[1:]
        code[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
        if not len(self.bigrams):
            return
        at = np.minimum(np.searchsorted(self.bigrams, code), len(self.bigrams) - 1)
        known = np.r_[False, self.bigrams[at] == code, False]
        turns = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a + 1 >= self.least:
                yield a, b + 1

    def _stream(self, ids: list[int], base: int, spans: list, found: set) -> int:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        v = l = longest = 0
        for i, w in enumerate(ids):
            while v and w not in nxt[v]:
                v = link[v]
                l = length[v]
            if w not in nxt[v]:
                continue
            v = nxt[v][w]
            l += 1
            end = base + i + 1
            for size, name in self.shorts[v]:
                if size <= l:
                    found.add(name)
                    spans.append((end - size, end))
            if l >= window:
                longest = max(longest, l)
                found |= self.owners.get(self.at_window[v], set())
                spans.append((end - window, end))
        return longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[^ ]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode("utf-8")
    places = [m.span() for m in _WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def _automaton(name: str, shared, window: int) -> SuffixAutomaton:
    def build() -> SuffixAutomaton:
        own = SuffixAutomaton([(key, words_of(text)) for key, text in shared.value], window)
        shared.__dict__.pop("_value", None)  # the items' texts aren't needed any more
        return own

    return held(("automaton", name, window), build)


def item_shards(items: DataFrame, key: str, text: str, most: int = SHARD_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The items, streamed to the driver, in shards of ``most`` words (an item is never cut): one shard is held at a time."""
    shard: list[tuple[str, str]] = []
    size = 0
    rows = items.where(quoted(text).isNotNull()).select(quoted(key).cast("string"), quoted(text))
    for name, own in rows.toLocalIterator():
        words = len(words_of(own))
        if size and size + words > most:
            yield shard
            shard, size = [], 0
        shard.append((name, own))
        size += words
    yield shard


def contamination(
    df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = 8, clean_from: int | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Add, for every row: ``n_words``, ``n_hit``, ``longest`` (long), ``item_ids`` (sorted strings), ``spans`` (word start, end, start, ...).

    With ``clean_from``, also ``cleaned``: the text without merged spans of that many words or more.
    """
    context = df.sparkSession.sparkContext
    shards = [(uuid.uuid4().hex, context.broadcast(x)) for x in item_shards(items, item_key, item_text)]

    def make():
        def work(column):
            many = column.to_pylist()
            sizes, seen = [0] * len(many), [([], set(), 0)] * len(many)
            for name, shared in shards:
                automaton = _automaton(name, shared, window)
                for k, t in enumerate(many):
                    words = words_of(t)
                    sizes[k] = len(words)
                    spans, found, longest = automaton.match(words)
                    seen[k] = (seen[k][0] + spans, seen[k][1] | found, max(seen[k][2], longest))
            out = []
            for t, n, (spans, found, longest) in zip(many, sizes, seen):
                whole = merged(spans)
                row = [n, sum(b - a for a, b in whole), longest, sorted(x for x in found if x is not None), [x for s in whole for x in s]]
                if clean_from is not None:
                    cuts = [s for s in whole if s[1] - s[0] >= clean_from]
                    row.append(without_spans(t, cuts) if cuts else t)
                out.append(row)
            kinds = [f[2] for f in fields]
            return [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)]

        return work

    many = pa.list_(pa.int64())
    fields = [
        ("n_words", T.LongType(), pa.int64()), ("n_hit", T.LongType(), pa.int64()), ("longest", T.LongType(), pa.int64()),
        ("item_ids", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("spans", T.ArrayType(T.LongType()), many),
    ]
    if clean_from is not None:
        fields.append(("cleaned", T.StringType(), pa.string()))
    return append_arrow(df, [text], make, fields, keep, GATHER if len(shards) > 1 else 0)


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", window: int = 8, max_coverage: float = 0.5, **names: str) -> DataFrame:
    """Rows of ``df`` with hit spans cut out of ``text``; rows whose words are hit beyond ``max_coverage`` go.

    Columns are those of ``df``. Null texts, and texts without a hit, stay as they are.
    """
    own, back = aside(df, ["n_words", "n_hit", "longest", "item_ids", "spans", "cleaned"])
    seen = contamination(own, items, text, window=window, clean_from=1, **names)
    stays = (F.col("n_hit") == 0) | (F.col("n_hit") <= max_coverage * F.col("n_words"))
    return seen.where(stays).select(*[F.col("cleaned").alias(c) if c.lower() == text.lower() else back[c] for c in df.columns])
