"""Operator 4 at a similarity: near copies of Jaccard similarity 0.8 on five-word shingles (the pipeline's near-duplicate stage).

The steps are operator 4's, with an exact check after them. A text's fingerprint is the SimHash of its distinct shingles,
``64 * WORDS64`` bits; BK-trees keyed by the integer Hamming distance of fingerprints are searched within ``RADIUS`` bits,
and what they find is a link if the shingle sets have similarity 0.8 or more. A bit of two such texts differs with
probability 0.1875 at most (enumerated for up to 60 shingles; 0.15 for many), so the radius
overlooks a pair with probability of about 1e-9 at most.

Trees need shards. Operator 4's own, by agreeing blocks of 64 bits, hold every pair within ``NEAR`` bits; at the radius
that similarity 0.8 needs there (24 of 64 bits) two agreeing blocks would make 325 shards of 4 bits for each text, four 20,475 of 9.
Texts beyond ``NEAR`` bits are therefore brought into a shard by MinHash bands as well, ``BANDS`` bands of ``ROWS`` values each: a
pair of similarity 0.8 shares no band with probability (1 - 0.8**7)**52, about 5e-6. Texts that share a band are linked to
the least of them, never pairwise. Both kinds of links make families, and a family is a shard: links are only taken from its trees.

A family of up to ``FAMILY`` shingles is compared by one task, which holds one such family at a time. A larger one is
spread: all members meet the family's first text, which leaves the usual group of copies with few others; these few, in
blocks of up to ``FAMILY`` shingles, then meet all blocks of members and each other. Copies that the first text already
joins are never compared with each other, and no task holds more than two blocks.

Defined results: texts with the same shingles are copies; null and empty texts have no shingle and
are copies of each other; texts with fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm import simhash
from corpusloom.llm.base import append_arrow, cut, salted_join, texts
from corpusloom.llm.simhash import SEED, BkTree, components, hamming, shingles_of

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 52, 7
#: 64-bit words of a family's fingerprints, and how many of their bits may differ between texts of similarity ``LEAST``.
WORDS64, RADIUS = 4, 88
#: The radius of the operator's own shards, over the first word.
NEAR = 4
_RNG = np.random.RandomState(SEED)
_TIMES = (_RNG.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) << 1 | 1)[:, None]
_PLUS = _RNG.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
#: Shingles of a family that one task compares, and of a block of a larger family (8 bytes each).
FAMILY = 4_000_000
#: Shingles hashed at a time, so that one product stays in the processor's cache.
_STEP = 256


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles_of(text, words)], dtype=np.uint64))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of the MinHash signature; texts without shingles share theirs."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), _STEP):
        np.minimum(least, (_TIMES * low[None, i : i + _STEP] + _PLUS).min(axis=1), out=least)
    raw, n = least.tobytes(), 4 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[n * b : n * (b + 1)], b) for b in range(BANDS)], dtype=np.uint64).view(np.int64)


def fingerprint_of(hashes: np.ndarray, words: int = WORDS64) -> int:
    """The unsigned SimHash of a shingle set, ``64 * words`` bits: the first word by the hashes themselves, the others by mixes of them; zero without shingles."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        own = hashes[i : i + _STEP]
        each = np.stack([own, *[_mixed(own, j) for j in range(1, words)]], axis=1).astype("<u8")
        ones += np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _mixed(hashes: np.ndarray, j: int) -> np.ndarray:
    """A further 64-bit value of each hash (the finaliser of SplitMix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * j % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_of(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def sketched(df: DataFrame, text: str, words: int = WORDS, shards: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Add ``__code``, a digest of the shingle set, its size ``__n``, and if asked for ``__simhash``, its 64-bit fingerprint as a signed long, and ``__bands``.

    One Arrow pass, no shuffle.
    """

    def make():
        def work(column):
            codes, sizes, prints, keys = [], [], [], []
            for t in texts(column):
                own = shingle_hashes(t, words)
                codes.append(code_of(own))
                sizes.append(len(own))
                if shards:
                    prints.append(fingerprint_of(own, 1))
                    keys.append(bands_of(own))
            out = [pa.array(codes, pa.int64()), pa.array(sizes, pa.int64())]
            if shards:
                offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * BANDS)
                out.append(pa.array(np.array(prints, dtype=np.uint64).view(np.int64)))
                out.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *keys]))))
            return out

        return work

    fields = [
        ("__code", T.LongType(), pa.int64()),
        ("__n", T.LongType(), pa.int64()),
        ("__simhash", T.LongType(), pa.int64()),
        ("__bands", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    ]
    return append_arrow(df, [text], make, fields if shards else fields[:2], keep)


def fingerprint_links(codes: DataFrame) -> DataFrame:
    """From distinct (``code``, ``simhash``): operator 4's links within ``NEAR`` bits as ``(hi, lo)`` of codes. Codes of one fingerprint join the least of them."""
    low = cut(codes.groupBy("simhash").agg(F.min("code").alias("node")))
    same = salted_join(codes.select("code", "simhash"), low, "simhash", F.col("code")).where("code > node").select(F.col("code").alias("hi"), F.col("node").alias("lo"))
    return same.union(simhash.links(low.select(F.col("simhash").alias("code"), "node"), NEAR))


def band_links(own: DataFrame) -> DataFrame:
    """From rows (``__code``, ``__bands``): links ``(hi, lo)`` that join each code with the least that shares a band.

    In two steps: to the least of the band in the code's Arrow batch, and from there to the least of all batches. So one
    row of a band leaves each batch, a hot band too, and bands are shuffled once.
    """

    def local(batches):
        for batch in batches:
            code = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = batch.column(1).flatten().to_numpy()
            order = np.lexsort((code, band))
            code, band = code[order], band[order]
            first = np.r_[True, band[1:] != band[:-1]] if len(band) else np.empty(0, bool)
            lead = code[first][np.cumsum(first) - 1]
            near = np.unique(np.stack([code, lead])[:, code > lead], axis=1)
            for kind, x, y in ((0, near[0], near[1]), (1, band[first], code[first])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], names=["kind", "a", "b"])

    found = own.select("__code", "__bands").mapInArrow(local, "kind int, a long, b long")
    far = found.where("kind = 1").select(F.col("b").alias("hi"), F.min("b").over(Window.partitionBy("a")).alias("lo"))
    return found.where("kind = 0").select("a", "b").union(far.where("hi > lo")).toDF("hi", "lo").distinct()


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """The integer Hamming distance of two sorted shingle sets, as vectors."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return len(b)
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return len(a) + len(b) - 2 * same


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted shingle sets have Jaccard similarity ``LEAST`` or more; division rounds a tie to the same number."""
    small, large = sorted((len(a), len(b)))
    if not small or small / large < LEAST:
        return not large
    d = distance(a, b)
    return (small + large - d) / (small + large + d) >= LEAST


def entry(own: np.ndarray) -> tuple[int, np.ndarray]:
    """What a tree holds of a text: its fingerprint, and its shingles for the check."""
    return fingerprint_of(own), own


def tree_of(entries: Iterable[tuple[int, np.ndarray]] = ()) -> BkTree:
    """A BK-tree of entries by the Hamming distance of their fingerprints."""
    tree = BkTree(lambda a, b: hamming(a[0], b[0]))
    for e in entries:
        tree.add(e)
    return tree


def found(tree: BkTree, e: tuple[int, np.ndarray]) -> Iterator[int]:
    """Places of entries within the radius that are alike."""
    return (at for at, _ in tree.within(e, RADIUS) if alike(tree.items[at][1], e[1]))


class Family:
    """Texts by component; each component is a few BK-trees, and one entry found there is enough to join it."""

    def __init__(self):
        self.parts: list[tuple[list[int], list[BkTree]]] = []

    def add(self, name: int, e: tuple[int, np.ndarray]) -> None:
        joined = [p for p in self.parts if any(True for tree in p[1] for _ in found(tree, e))]
        if not joined:
            self.parts.append(([name], [tree_of([e])]))
            return
        first = joined[0]
        first[0].append(name)
        first[1][0].add(e)
        for p in joined[1:]:
            first[0].extend(p[0])
            first[1].extend(p[1])
        if len(joined) > 1:
            gone = {id(p) for p in joined[1:]}
            self.parts = [p for p in self.parts if id(p) not in gone]


def groups(sets: list[np.ndarray]) -> list[int]:
    """For each set the number of the first one of its component, over all links of Jaccard similarity ``LEAST`` or more."""
    family = Family()
    for i, own in enumerate(sets):
        family.add(i, entry(own))
    out = [0] * len(sets)
    for members, _ in family.parts:
        first = min(members)
        for i in members:
            out[i] = first
    return out


def _grouped(batches, columns: int) -> Iterator[list[list]]:
    """Rows of sorted batches by their first column (long), one key's rows at a time, as lists of columns."""
    held: list[list] = [[] for _ in range(columns)]
    for batch in batches:
        key = batch.column(0).to_numpy()
        for a, b in zip(*_runs(key)):
            if held[0] and held[0][0] != key[a]:
                yield held
                held = [[] for _ in range(columns)]
            for i in range(columns):
                held[i] += batch.column(i).slice(a, b - a).to_pylist()
    if held[0]:
        yield held


def _runs(key: np.ndarray) -> tuple[list[int], list[int]]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() if len(key) else []
    return starts, [*starts[1:], len(key)]


def _pairs(hi: list[int], lo: list[int]) -> Iterator[pa.RecordBatch]:
    if hi:
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])


def confirmed(members: DataFrame, words: int = WORDS) -> DataFrame:
    """From (``root``, ``code``, ``text``): links ``(hi, lo)`` of each code with another one of its component. A family is held by one task at a time."""
    rows = members.select("root", "code", "text").repartition("root").sortWithinPartitions("root", "code")

    def run(batches):
        for _, code, text in _grouped(batches, 3):
            own = {}  # a repeated row is one
            for c, t in zip(code, text):
                if c not in own and code_of(h := shingle_hashes(t, words)) == c:  # else another text of the same key
                    own[c] = h
            names = list(own)
            lead = groups(list(own.values()))
            links = [(max(names[i], names[j]), min(names[i], names[j])) for i, j in enumerate(lead) if i != j]
            yield from _pairs([x for x, _ in links], [x for _, x in links])

    return rows.mapInArrow(run, "hi long, lo long")


def confirmed_in_blocks(members: DataFrame, words: int = WORDS, size: int = FAMILY) -> DataFrame:
    """As ``confirmed``, for families of any size."""

    def hash_all(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                root, code, text = (batch.column(j)[i].as_py() for j in range(3))
                own = shingle_hashes(text, words)
                if code_of(own) == code:  # else another text of the same key
                    cols = [pa.array([root], pa.int64()), pa.array([code], pa.int64()), pa.array([own.view(np.int64).tolist()], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["root", "code", "own"])

    def set_of(values) -> np.ndarray:
        return np.asarray(values if values is not None else [], dtype=np.int64).view(np.uint64)

    def judge(batches):
        root, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if tree is None or root != row.column(0)[0].as_py():
                    root, tree = row.column(0)[0].as_py(), tree_of([entry(set_of(row.column(3)[0].values.to_numpy()))])
                near = any(True for _ in found(tree, entry(set_of(row.column(2)[0].values.to_numpy()))))
                yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([near])], names=["root", "code", "own", "near"])

    hashed = cut(members.select("root", "code", "text").mapInArrow(hash_all, "root long, code long, own array<long>").dropDuplicates(["root", "code"]))
    first = hashed.where("code = root").select("root", F.col("own").alias("first"))  # a family is named by its least code
    met = salted_join(hashed, first, "root", F.col("code")).select("root", "code", "own", "first")
    judged = cut(met.mapInArrow(judge, "root long, code long, own array<long>, near boolean"))
    weigh = lambda test, most: F.ceil(F.coalesce(F.sum(F.when(test, F.size("own"))), F.lit(0)) / most).cast("int")
    # Blocks of members that the first text joins are small: each meets the few others once, none meets another.
    blocks = judged.groupBy("root").agg(weigh(F.col("near"), max(1, size // 64)).alias("nv"), weigh(~F.col("near"), size).alias("nr"))  # a row for each large family
    dealt = salted_join(judged, cut(blocks), "root", F.col("code"))
    block = F.pmod(F.xxhash64("code"), F.greatest(F.when(F.col("near"), F.col("nv")).otherwise(F.col("nr")), F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", block)
    others = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: F.struct(F.lit(0).alias("kind"), j.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    apart = F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    mutual = F.transform(
        F.sequence(F.lit(0), F.col("nr") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (j < F.col("block")).cast("int").alias("side"))
    )
    # Members that the first text joins meet the others' blocks; the others meet those and each other.
    places = F.when(F.col("near") & (F.col("nr") > 0), others).when(~F.col("near") & (F.col("nv") > 0), F.concat(apart, mutual)).when(~F.col("near"), mutual)
    each = dealt.select("root", "code", "own", F.inline(places))
    rows = each.select(F.xxhash64("root", "kind", "i", "j").alias("pair"), "root", "kind", "side", "code", "own").repartition("pair", "root").sortWithinPartitions("pair", "root", F.desc("side"), "code")

    def compare(batches):
        for _, root, kind, side, code, own in _grouped(batches, 6):
            for r in set(root):  # two families may share a hash
                rows = [(s, c, set_of(o)) for x, s, c, o in zip(root, side, code, own) if x == r]
                links = _met(rows) if kind[root.index(r)] == 0 else [(rows[i][1], rows[j][1]) for i, j in enumerate(groups([o for _, _, o in rows])) if i != j]
                yield from _pairs([max(x) for x in links], [min(x) for x in links])

    near = judged.where("near AND code <> root").select(F.greatest("code", "root").alias("hi"), F.least("code", "root").alias("lo"))
    return near.union(rows.mapInArrow(compare, "hi long, lo long"))


def _met(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of entries of side 0 with one entry of side 1, all of which share a component already."""
    tree, names = tree_of(entry(own) for side, _, own in rows if side == 1), [code for side, code, _ in rows if side == 1]
    out = []
    for side, code, own in rows:
        if side == 0:
            hit = next(found(tree, entry(own)), None)
            if hit is not None:
                out.append((code, names[hit]))
    return out


def representatives(df: DataFrame, key: str, text: str, words: int = WORDS, family: int = FAMILY) -> DataFrame:
    """Of each component the text with the smallest key (of several, the least digest), as one row.

    Rows with a null key take no part and stay. Key and digest name a text, so another text of the same key is apart.
    """
    keyed = df.where(F.col(key).isNotNull())
    own = cut(sketched(keyed.select(key, text), text, words, keep=[key]))
    codes = cut(own.groupBy(F.col("__code").alias("code")).agg(F.min(key).alias("least"), F.first("__n").alias("n"), F.first("__simhash").alias("simhash")))
    linked = components(band_links(own).union(fingerprint_links(codes)))
    linked = linked.union(linked.select("root", "root")).distinct().withColumnRenamed("node", "code")
    one = cut(codes.select("code", "least", "n").join(linked, "code"))
    large = cut(one.groupBy("root").agg(F.sum("n").alias("w")).where(F.col("w") > family).select("root"))
    # Both joins with texts are by sorted shuffle at every size, not by broadcast where a table happens to be small.
    members = keyed.select(F.col(key).alias("least"), F.col(text).alias("text")).join(one.hint("merge"), "least")
    if large.isEmpty():
        links = confirmed(members, words)
    else:
        # At most one large family for each FAMILY shingles of the input.
        links = confirmed(members.join(large, "root", "left_anti"), words).union(confirmed_in_blocks(members.join(large, "root", "left_semi"), words, family))
    leads = components(links)
    named = codes.select("code", "least").join(leads.withColumnRenamed("node", "code"), "code", "left")
    best = named.groupBy(F.coalesce("root", "code").alias("lead")).agg(F.min(F.struct("least", "code")).alias("b"))
    # Texts are read a second time rather than kept: a copy of them would cost more disk than their digests cost time.
    kept = sketched(keyed, text, words, shards=False).join(best.select(F.col("b.least").alias(key), F.col("b.code").alias("__code")).hint("merge"), [key, "__code"], "left_semi")
    once = kept.dropDuplicates([key, "__code"]).drop("__code", "__n")
    return once.unionByName(df.where(F.col(key).isNull()))
