"""Learning phrase-boundary markers and measuring what they recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.scratch import cut


def tails(line: Column) -> Column:
    """Tail syllables of a line's chunks, in order."""
    return F.transform(X.space_chunks(line), lambda c: X.tail_syllable(X.rstrip_shad(c)))


def boundary_counts(lines: DataFrame, column: str = "value", tail=tails) -> DataFrame:
    """``(tail, total, before)``: how often a tail occurs, and how often not at the line's end."""
    marked = X.let(tail(F.col(column)), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("tail"), (i < F.size(t) - 1).alias("inner"))))
    each = lines.select(F.inline(F.filter(marked, lambda x: x["tail"] != "")))
    return each.groupBy("tail").agg(F.count("*").alias("total"), F.count_if("inner").alias("before"))


def learn_markers(lines: DataFrame, column: str = "value", min_count: int = 200, min_prob: float = 0.90, tail=tails) -> DataFrame:
    """Tails frequent enough that precede a boundary often enough."""
    return boundary_counts(lines, column, tail).where((F.col("total") >= min_count) & (F.col("before") / F.col("total") >= min_prob))


def marker_lines(markers: DataFrame) -> DataFrame:
    """Markers as sorted lines, for the marker file."""
    return markers.select(F.col("tail").alias("value")).distinct().orderBy("value")


def head_and_rest(lines: DataFrame, position: str, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The first ``int(share * n)`` rows by a gapless position, and the others."""
    n = int(lines.count() * share)
    return lines.where(F.col(position) < n), lines.where(F.col(position) >= n)


#: Up to so many markers are tested inside the scan; beyond, every chunk meets a join.
MAX_MARKERS = 20_000


def boundary_recall(lines: DataFrame, markers: DataFrame, column: str = "value", tail=tails) -> DataFrame:
    """``lines, boundaries, recovered, missed, exact, recall`` over lines of two chunks or more.

    Markers are written once. Where there are few, each line is judged in place and nothing is shuffled; many join as a
    relation, so their number is free.
    """
    inner = X.let(tail(F.col(column)), lambda t: F.when(F.size(t) >= 2, F.slice(t, F.lit(1), F.size(t) - 1)))
    known = cut(markers.select("tail").where("tail is not null").distinct())
    few = [r[0] for r in known.limit(MAX_MARKERS + 1).collect()]
    if len(few) <= MAX_MARKERS:
        judged = X.let(inner, lambda t: F.struct(F.size(t).cast("bigint").alias("n"), F.size(F.filter(t, lambda x: x.isin(*few))).cast("bigint").alias("tp")))
        per_line = lines.select(F.inline(F.filter(F.array(judged), lambda x: x["n"] > 0)))
    else:
        own = lines.select(F.monotonically_increasing_id().alias("line"), inner.alias("inner"))
        each = own.select("line", F.explode("inner").alias("tail"))
        hit = each.join(known.select("tail", F.lit(1).alias("hit")), "tail", "left")
        per_line = hit.groupBy("line").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    return per_line.agg(
        F.count("*").alias("lines"), F.sum("n").alias("boundaries"), F.sum("tp").alias("recovered"), F.sum(F.col("n") - F.col("tp")).alias("missed"),
        F.count_if(F.col("n") == F.col("tp")).alias("exact"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("n")), F.lit(0.0)).alias("recall"),
    )
