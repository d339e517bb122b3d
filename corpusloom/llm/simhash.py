"""SimHash near-duplicate components over BK-trees (operator 4).

A text's fingerprint is the majority vote of the XXH64 values of its word shingles. Distinct
fingerprints, not documents, are then linked: 64 bits are cut into ``radius + parts`` blocks,
and by the pigeonhole principle two fingerprints within ``radius`` bits agree on at least
``parts`` whole blocks, so every link lies inside a shard (a choice of blocks and their
bits). Each shard is one BK-tree: children are keyed by their integer Hamming distance to
the parent, and a search follows only edges within the radius of its own distance. The
trees grow with the data, so they are built where the shuffle puts their shard instead of
being broadcast. A shard of more than ``MOST`` fingerprints is dealt anew by further blocks of
its remaining bits, of which two linked fingerprints again agree on one, so a hot shard is
split without losing a link. A shard emits a spanning forest of its links, never all pairs.
Components come from alternating large-star and small-star steps on the links, in DataFrames;
the edges of a hub are dealt over tasks.

Defined results: null and empty texts have fingerprint zero and link like any other; texts
with fewer words than a shingle are one shingle; repeated rows share a component. Keys may be
of any ordered type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.base import append_arrow, cut, quoted, salted_join, texts

SEED = 42
_WEIGHT = 1 << np.arange(64, dtype=np.uint64)


def shingles_of(text: str | None, words: int) -> list[bytes]:
    """The word shingles of a whole text, repeats too; one if it has fewer words, none if it has no word."""
    own = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    line = b" ".join(own)
    if len(own) <= words:
        return [line] if own else []
    ends = np.cumsum([len(w) + 1 for w in own])
    begins = np.concatenate([[0], ends[:-1]])
    n = len(own) - words + 1
    return [line[a:b] for a, b in zip(begins[:n].tolist(), (ends[words - 1 :] - 1).tolist())]


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    shingles = shingles_of(text, words)
    if not shingles:
        return 0
    ones, digest, step = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest, 1 << 15
    for i in range(0, len(shingles), step):
        h = np.array([digest(s, SEED) for s in shingles[i : i + step]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHT[ones * 2 > len(shingles)].sum())


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Add ``simhash``: the fingerprint as a signed 64-bit long. One Arrow pass, no shuffle."""

    def make():
        return lambda column: [pa.array(np.array([fingerprint_of(t, words) for t in texts(column)], dtype=np.uint64).view(np.int64))]

    return append_arrow(df, [text], make, [("simhash", T.LongType(), pa.int64())], keep)


class BkTree:
    """Items by integer distance to their parent; a search follows only edges within the radius of its own distance."""

    def __init__(self, distance: Callable[[object, object], int]):
        self.distance = distance
        self.items: list = []
        self.children: list[dict[int, int]] = []

    def within(self, item: object, radius: int) -> Iterator[tuple[int, int]]:
        """(place, distance) of every entry at most ``radius`` away."""
        stack = [0] if self.items else []
        while stack:
            at = stack.pop()
            d = self.distance(self.items[at], item)
            if d <= radius:
                yield at, d
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)

    def add(self, item: object) -> int:
        """Insert ``item``; its place."""
        me = len(self.items)
        self.items.append(item)
        self.children.append({})
        at = 0
        while me:
            d = self.distance(self.items[at], item)
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = me
                break
            at = below
        return me


def hamming(a: int, b: int) -> int:
    return (a ^ b).bit_count()


def shard_links(codes: list[int], nodes: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one shard, as pairs of nodes (larger, smaller)."""
    if len(codes) == 2:
        return [(max(nodes), min(nodes))] if hamming(*codes) <= radius else []
    tree, leader = BkTree(hamming), list(range(len(codes)))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    for me, c in enumerate(codes):
        for at, _ in tree.within(c, radius):
            a, b = find(at), find(me)
            if a != b:
                leader[max(a, b)] = min(a, b)
        tree.add(c)
    low: dict[int, int] = {}
    roots = [find(i) for i in range(len(codes))]
    for r, n in zip(roots, nodes):
        low[r] = min(n, low.get(r, n))
    return [(n, low[r]) for r, n in zip(roots, nodes) if n != low[r]]


def blocks_for(n: int, radius: int) -> tuple[int, int]:
    """How many blocks to cut and how many of them name a shard: more as fingerprints grow, exact at each choice."""
    for parts in (2, 3, 4):
        bits = 64 * parts // (radius + parts)
        if n <= 32 << bits:
            break
    return radius + parts, parts


#: Fingerprints that one tree holds before its shard is dealt anew, and how often that may happen: each time adds the bits of one block.
MOST, DEPTH = 4096, 4


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _dealt_anew(mask: int, radius: int) -> list[int]:
    """``mask`` with each of ``radius + 1`` blocks of the bits it leaves free: two fingerprints within the radius agree on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)]) for i in range(radius + 1)]


def _shards(masks: list[int]) -> Column:
    """For each mask the shard of ``code``: a hash of the mask and of the bits that it covers. Two shards that share a hash make one tree: no link lost or added."""
    return F.array(*[F.struct(F.lit(i).alias("k"), F.xxhash64(F.lit(_signed(m)), F.col("code").bitwiseAND(F.lit(_signed(m)))).alias("shard")) for i, m in enumerate(masks)])


def dealt(codes: DataFrame, radius: int) -> DataFrame:
    """``(code, node, shard)``: every two fingerprints within ``radius`` bits share a shard; hot shards are split as far as their bits allow."""
    blocks, parts = blocks_for(codes.count(), radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(blocks), parts)]
    now = codes.select("code", "node", F.inline(_shards(masks)))
    done = None
    for _ in range(DEPTH):
        hot = cut(now.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("shard"))
        if hot.isEmpty():
            break
        # At most one hot shard for MOST rows; the anti join and the semi join split a hot side by themselves, their other side being this table.
        calm = now.join(hot, "shard", "left_anti").select("code", "node", "shard")
        done = calm if done is None else done.unionByName(calm)
        finer = [_dealt_anew(m, radius) for m in masks]
        busy = cut(now.join(hot, "shard", "left_semi").select("code", "node", "k"))
        # A row for each mask, a few thousand at most: set by blocks and depth, not by the data.
        choice = codes.sparkSession.createDataFrame([(k, [_signed(m) for m in own]) for k, own in enumerate(finer)], "k int, finer array<long>")
        again = busy.join(F.broadcast(choice), "k").select("code", "node", "k", F.posexplode("finer").alias("i", "mask"))
        now = again.select("code", "node", (F.col("k") * (radius + 1) + F.col("i")).alias("k"), F.xxhash64("mask", F.col("code").bitwiseAND(F.col("mask"))).alias("shard"))
        masks = [m for own in finer for m in own]
        if max(m.bit_count() for m in masks) > 56 or len(masks) > 4000:
            break
    rest = now.select("code", "node", "shard")
    return rest if done is None else done.unionByName(rest)


def links(codes: DataFrame, radius: int = 4) -> DataFrame:
    """From distinct (``code`` long, ``node``): links ``(hi, lo)`` whose components are those of all pairs within ``radius``."""
    rows = dealt(codes, radius).repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        shard, code, node = (np.empty(0, np.int64),) * 3
        for batch in batches:
            got = [batch.column(i).to_numpy() for i in (2, 0, 1)]
            shard, code, node = (np.concatenate(x) for x in zip((shard, code, node), got))
            if not len(shard) or shard[0] == shard[-1]:
                continue
            whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            yield from _linked(shard[:whole], code[:whole], node[:whole], radius)
            shard, code, node = shard[whole:], code[whole:], node[whole:]
        yield from _linked(shard, code, node, radius)

    return rows.mapInArrow(run, "hi long, lo long").distinct()


def _linked(shard, code, node, radius):
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(shard)] if len(shard) else starts
    several = ends - starts > 1
    hi, lo = [], []
    bits = code.view(np.uint64)
    for a, b in zip(starts[several].tolist(), ends[several].tolist()):
        for x, y in shard_links(bits[a:b].tolist(), node[a:b].tolist(), radius):
            hi.append(x)
            lo.append(y)
    if hi:
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """From links ``(hi, lo)``, hi > lo: ``(node, root)`` of every linked node, root the smallest node it reaches.

    Large-star (each higher neighbour of a node goes to the node's least neighbour), then small-star (each lower
    neighbour and the node itself do), until nothing changes; each round is cut into a table. A hub is the lower end of
    many edges, so that join is salted; as the higher end a node meets only the few nodes that its shards name.
    Only counts reach the driver.
    """
    edges = cut(edges.distinct())
    last = None
    while True:
        least = edges.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))  # of nodes that have a lower neighbour
        large = salted_join(edges, least, "lo", F.col("hi"), "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        small = large.select("hi", "lo", F.min("lo").over(Window.partitionBy("hi")).alias("m"))
        both = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        edges = cut(small.select(F.inline(both)).where("hi > lo").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        last = now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``(key, simhash long, component)`` of every row; component: the smallest key reachable over links.

    Rows with a null key take no part in components (component null); a fingerprint that only such rows have makes none.
    """
    own = cut(fingerprints(df.select(quoted(key).alias("key"), quoted(text).alias("text")), "text", words, ["key"]))
    # Fingerprints are their own nodes, so keys of any type will do; the smallest key of a component is found afterwards.
    codes = cut(own.where("key is not null").groupBy(F.col("simhash").alias("code")).agg(F.min("key").alias("least")))
    roots = components(links(codes.select("code", F.col("code").alias("node")), radius))
    named = cut(codes.join(roots, codes["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root")))
    lows = named.groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(lows, "root").select(F.col("code").alias("simhash"), "component")
    out = salted_join(own, known, "simhash", F.col("key"), "left")
    return out.select(F.col("key").alias(key), "simhash", F.when(F.col("key").isNotNull(), F.col("component")).alias("component"))
