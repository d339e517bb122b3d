"""Order-bound operators: positions, first occurrences, seeded samples, index percentiles, ranks."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.scratch import cut


def positions(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """Positions 0, 1, 2, ... by ``order`` without gathering rows in one task; rows that tie follow one another in any order.

    Rows are range-partitioned, sorted and written once with their range and place: a plan that ranged them twice, for
    rows and for counts, would draw its bounds twice. Counts of the ranges, one row each, give every range its start.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(ranged.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")))
    sums = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))  # a row for each partition
    return placed.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + F.col("__at")).alias(name))


def first_of(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key, by a partial aggregate: a hot key is one row for each task before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.min_by(F.struct(*rest), order) if rest else None
    out = df.groupBy(*keys).agg(F.min(order).alias(order), *([best.alias("__r")] if rest else []))
    return out.select(*[F.col(f"__r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def seeded_order(seed: int, *keys: str) -> Column:
    """A shuffle that depends on seed and keys alone, not on partitions: the MD5 of both, joined by bars, as any engine can draw it."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def shuffled(df: DataFrame, seed: int, *keys: str, limit: int = 0) -> DataFrame:
    """Rows in seeded order, numbered by ``draw``; the first ``limit`` of them where that is set."""
    drawn = df.withColumn("__draw", seeded_order(seed, *keys))
    if limit:
        drawn = drawn.orderBy("__draw", *keys).limit(limit)
    return positions(drawn, "__draw", *keys, name="draw").drop("__draw")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``: a top-n of each task, then of those."""
    return df.orderBy(*order).limit(n)


#: Up to so many rows of a key, Spark ranks them within each task ahead of the shuffle (its windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def _bin(draw: str) -> Column:
    """4096 bins in the order of a draw."""
    return F.left(draw, F.lit(3))


def draw_counts(df: DataFrame, key: Sequence[str], seed: int, *identity: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(key, keep, __bin, __n)``: how many rows of each key fall into each bin of the draw. Written once. The key sets ``keep``."""
    own = df.withColumn("__draw", seeded_order(seed, *key, *identity)).withColumn("__bin", _bin("__draw"))
    return cut(own.groupBy(*key, *keep, "__bin").agg(F.count("*").alias("__n")))


def sample_per_key(df: DataFrame, key: Sequence[str], n: int, seed: int, *identity: str, counts: DataFrame | None = None) -> DataFrame:
    """Up to ``n`` rows of each key, drawn by hash.

    Where ``n`` is large, no task sorts a whole key: rows are counted by bins of the draw (``counts``, from ``draw_counts``),
    keys of ``n`` rows or fewer pass, and of the others' rows those of a bin are ranked together.
    """
    drawn = df.withColumn("__draw", seeded_order(seed, *key, *identity))
    if n <= GROUP_LIMIT:
        w = Window.partitionBy(*key).orderBy("__draw", *identity)
        return drawn.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).select(*df.columns)
    counts = draw_counts(df, key, seed, *identity) if counts is None else counts
    upto = F.sum("__n").over(Window.partitionBy(*key).orderBy("__bin"))
    # A row for each key of more than n rows: the bin in which the nth falls, and how many of that bin's rows stay.
    over = counts.withColumn("__upto", upto).where(F.col("__upto") > n).groupBy(*key).agg(F.min(F.struct("__bin", (n - F.col("__upto") + F.col("__n")).alias("rest"))).alias("__last"))
    last = cut(over.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(key)], "__last"))
    if last.isEmpty():
        return df
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(key)])
    own = drawn.withColumn("__bin", _bin("__draw")).join(last, same, "left")
    own = own.where(F.col("__last").isNull() | (F.col("__bin") <= F.col("__last.__bin")))
    w = Window.partitionBy(*key, "__bin").orderBy("__draw", *identity)
    stays = F.col("__last").isNull() | (F.col("__bin") < F.col("__last.__bin")) | (F.col("__rank") <= F.col("__last.rest"))
    return own.withColumn("__rank", F.row_number().over(w)).where(stays).select(*df.columns)


def hash_split(df: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """``split`` 'test' for about ``share`` of the rows, by hash."""
    draw = F.pmod(F.conv(F.left(seeded_order(seed, *keys), F.lit(15)), 16, 10).cast("bigint"), F.lit(1_000_000))
    return df.withColumn("split", F.when(draw < int(share * 1_000_000), "test").otherwise("train"))


def index_percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """Values at index ``int(n * share)`` of the sorted column, for each group.

    Distinct values with their counts are ranked, not rows, and in two steps: values fall into ``bins`` bins by their
    place between the group's least and greatest, bins are summed, and only the values of a bin are sorted together.
    """
    keys = [*by, "__all"]  # without groups, all values share a constant
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))).withColumn("__all", F.lit(0))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("n").alias("__total"))
    width = F.try_divide(F.col(value).cast("double") - F.col("__lo").cast("double"), F.col("__hi").cast("double") - F.col("__lo").cast("double"))
    own = counts.join(ends, keys).withColumn("__bin", F.least(F.floor(F.coalesce(width, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int"))
    sums = own.groupBy(*keys, "__bin").agg(F.sum("n").alias("__b"))
    ahead = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__bin", F.coalesce(F.sum("__b").over(ahead), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = own.withColumn("__own", F.sum("n").over(within)).join(starts, [*keys, "__bin"]).withColumn("__upto", F.col("__start") + F.col("__own"))
    picks = [F.min(F.when(F.col("__upto") > F.floor(F.col("__total") * s), F.col(value))).alias(name) for name, s in shares.items()]
    return ranked.groupBy(*by).agg(F.max("__total").alias("n"), *picks)
