"""K-d tree partitioning into shards of near equal bytes (operator 6), in DataFrame expressions only.

A node is split along the metadata dimension that spans most of its range, at the weighted
quantile that divides its bytes as its shards divide; leaves have reached the target bytes,
``total / shards``. One distributed histogram of all dimensions together gives the bytes of
every cell (a value of each dimension, at most 2**CELL_BITS of them), and the tree is grown
on it. A cut that falls inside a cell is found by the rows' ties, all cuts at once, refined
inside the bin that holds the cut until that bin is a single code or weighs less than a
small part of a shard: some three passes over the metadata, whatever the number of shards.
A tie is the text's checksum and a hash of the key: equal texts lie side by side and stay in one
shard unless they outweigh a small part of it, and a hot text can be cut anywhere, since no
two rows need share a code.

Places within a shard are counted in two steps, so that no task numbers a whole shard.

Defined results: null texts have size 16 and checksum 0; null dimensions are zero; rows
with equal keys and texts lie side by side; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.base import cut, quoted

BINS = 4096
BUCKETS = 256
#: Bits of a dimension from a name, of one from a size, of a tie and of its part from the key; the cells that the driver holds.
NAME_BITS, SIZE_BITS, TIE_BITS, KEY_BITS, CELL_BITS = 8, 10, 42, 21, 20
#: A cut may miss its quantile by this part of a shard.
MISS = 0.001
#: Copies of a text that weigh up to this part of a shard are not cut apart.
WHOLE = 0.01


@dataclass(frozen=True)
class Dimension:
    """A column of whole numbers from 0 to 2**bits - 1."""

    code: Column
    bits: int


def of_string(c: Column) -> Dimension:
    """A dimension from a name: its checksum's leading bits."""
    return Dimension(F.coalesce(F.shiftright(F.crc32(c.cast("binary")), 32 - NAME_BITS), F.lit(0)).cast("bigint"), NAME_BITS)


def of_size(c: Column) -> Dimension:
    """A dimension from a size: its logarithm, 32 steps to each doubling."""
    return Dimension(F.least(F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * 32), F.lit((1 << SIZE_BITS) - 1)).cast("bigint"), SIZE_BITS)


@dataclass
class _Piece:
    """Bytes ``lo`` to ``hi`` of a cell, in the order of its ties."""

    cell: tuple[int, ...]
    lo: int
    hi: int


@dataclass
class _Node:
    first: int
    shards: int
    dim: int | None = None
    cell: tuple[int, ...] = ()
    #: What goes left: smaller cells in the order of ``dim``, and of the cut's own cell the ties up to ``tie``, which hold ``want`` bytes.
    want: int = 0
    tie: int = (1 << TIE_BITS) - 1
    left: _Node | None = None
    right: _Node | None = None

    def key(self, cell: tuple) -> tuple:
        return (cell[self.dim], *cell)

    def place(self, dims: list[Column], tie: Column) -> Column:
        """The shard that a row falls into."""
        if self.dim is None:
            return F.lit(self.first)
        own = [*self.key(tuple(dims)), tie]
        at = [*self.key(self.cell), self.tie]
        test = F.lit(True)  # up to the cut, in the order of all dimensions
        for c, v in reversed(list(zip(own, at))):
            test = (c < v) | ((c == v) & test)
        return F.when(test, self.left.place(dims, tie)).otherwise(self.right.place(dims, tie))


def grow(cells: dict[tuple[int, ...], int], shards: int) -> tuple[_Node, list[_Node]]:
    """The tree over the bytes of cells, and its nodes whose cut falls inside a cell."""
    dims = len(next(iter(cells), ()))
    whole = [max((c[d] for c in cells), default=0) - min((c[d] for c in cells), default=0) for d in range(dims)]
    root = _Node(0, shards)
    inside: list[_Node] = []
    todo = [(root, [_Piece(c, 0, w) for c, w in cells.items()])]
    while todo:
        node, pieces = todo.pop()
        if node.shards == 1 or not pieces:
            continue
        spans = [(max(p.cell[d] for p in pieces) - min(p.cell[d] for p in pieces)) / max(1, whole[d]) for d in range(dims)]
        node.dim = max(range(dims), key=lambda d: spans[d])  # the first of equals
        pieces.sort(key=lambda p: (node.key(p.cell), p.lo))
        half = node.shards // 2
        want = sum(p.hi - p.lo for p in pieces) * half // node.shards
        left: list[_Piece] = []
        for i, p in enumerate(pieces):
            if want < p.hi - p.lo or i + 1 == len(pieces):
                break
            want -= p.hi - p.lo
            left.append(p)
        node.cell, node.want = p.cell, p.lo + want
        rest = pieces[len(left) + 1 :]
        if want:
            left = [*left, _Piece(p.cell, p.lo, p.lo + want)]
        inside.append(node)
        node.left, node.right = _Node(node.first, half), _Node(node.first + half, node.shards - half)
        todo += [(node.left, left), (node.right, [_Piece(p.cell, p.lo + want, p.hi), *rest])]
    return root, inside


@dataclass
class _Search:
    """Where the cut of ``want`` bytes of a cell still is: codes ``lo`` to ``hi`` (without ``shift`` low bits), ``before`` bytes ahead of them."""

    cell: tuple[int, ...]
    want: int
    share: float
    lo: int = 0
    hi: int = (1 << (TIE_BITS - KEY_BITS)) - 1
    shift: int = KEY_BITS
    before: int = 0
    tie: int | None = None
    step: int = field(default=1)

    def _settle(self, last: int) -> None:
        self.tie = ((last + 1) << self.shift) - 1

    def narrow(self, bins: list[tuple[int, int]]) -> None:
        """Go into the bin that holds the cut, or set it."""
        for b, w in bins:
            if self.before + w >= self.want:
                break
            self.before += w
        else:
            return self._settle(self.hi)
        start, end = self.lo + b * self.step, min(self.hi, self.lo + (b + 1) * self.step - 1)
        single = self.step == 1
        if w <= MISS * self.share or (single and (self.shift == 0 or w <= WHOLE * self.share)):
            return self._settle(end if self.before + w - self.want <= self.want - self.before else start - 1)
        if single:  # one text, or texts that share a checksum: cut it by key
            self.lo, self.hi, self.shift = start << self.shift, ((start + 1) << self.shift) - 1, 0
        else:
            self.lo, self.hi = start, end
        return None


def kd_tree(meta: DataFrame, size: str, dims: list[str], tie: str, shards: int) -> _Node:
    """The tree over the columns ``dims`` and ``tie`` of ``meta``."""
    cells = {tuple(r[:-1]): r[-1] for r in meta.groupBy(*dims).agg(F.sum(size)).collect()}  # at most 2**CELL_BITS rows
    root, inside = grow(cells, shards)
    share = sum(cells.values()) / shards
    cuts = {(n.cell, n.want): _Search(n.cell, n.want, share) for n in inside}
    while open_ := {k: s for k, s in cuts.items() if s.tie is None}:
        numbers = {k: i for i, k in enumerate(open_)}
        found = []  # the bin that a row has for each cut that it concerns
        for k, s in open_.items():
            s.step = max(1, -(-(s.hi - s.lo + 1) // BINS))
            code = F.shiftright(tie, s.shift)
            mine = code.between(s.lo, s.hi)
            for d, v in zip(dims, s.cell):
                mine = mine & (F.col(d) == v)
            found.append(F.when(mine, F.struct(F.lit(numbers[k]).alias("cut"), F.call_function("div", code - s.lo, F.lit(s.step).cast("bigint")).alias("bin"))))
        rows = meta.select(size, F.explode(F.array_compact(F.array(*found))).alias("at"))
        sums: dict[int, list] = {}
        for c, b, w in rows.groupBy("at.cut", "at.bin").agg(F.sum(size)).collect():  # at most cuts x BINS rows
            sums.setdefault(c, []).append((b, w))
        for k, s in open_.items():
            s.narrow(sorted(sums.get(numbers[k], [])))
    for n in inside:
        n.tie = cuts[(n.cell, n.want)].tie
    return root


def kd_shards(df: DataFrame, key: str, text: str, dims: dict[str, Dimension], shards: int = 40) -> DataFrame:
    """``(key, size, text_crc32, shard int, slot long)`` of every row; ``size`` is the text's UTF-8 bytes plus 16."""
    if sum(d.bits for d in dims.values()) + SIZE_BITS > CELL_BITS:
        raise ValueError(f"all dimensions together may have {CELL_BITS} bits")
    size = (F.coalesce(F.octet_length(quoted(text)), F.lit(0)) + 16).cast("bigint")
    checksum = F.crc32(F.coalesce(quoted(text), F.lit("")).cast("binary"))
    tie = F.shiftleft(F.shiftright(F.col("crc"), 11), KEY_BITS).bitwiseOR(F.xxhash64("key").bitwiseAND(F.lit((1 << KEY_BITS) - 1)))
    names = [f"d_{i}" for i in range(len(dims) + 1)]
    base = df.select(quoted(key).alias("key"), size.alias("size"), checksum.alias("crc"), *[d.code.alias(n) for d, n in zip(dims.values(), names)])
    meta = cut(base.select("key", "size", "crc", *names[:-1], of_size(F.col("size")).code.alias(names[-1]), tie.alias("tie")))
    root = kd_tree(meta, "size", names, "tie", shards)
    shard = root.place([F.col(n) for n in names], F.col("tie")).cast("int")
    placed = meta.select("key", "size", "crc", shard.alias("shard"), F.pmod(F.xxhash64("key", "crc"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    sums = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy("key", "crc", "size")
    numbered = placed.withColumn("at", F.row_number().over(own))
    # At most shards x BUCKETS rows: a proven bound, whatever the data.
    out = numbered.join(F.broadcast(starts), ["shard", "bucket"])
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("at") - 1).alias("slot"))
