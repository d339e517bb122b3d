"""Exact deduplication and decontamination against an evaluation pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import first_of


def eval_pool(*evals: DataFrame, columns: tuple[str, ...] = ("dz", "en")) -> DataFrame:
    """Every string of both sides of the evaluation splits, once."""
    pool = None
    for e in evals:
        for c in columns:
            one = e.select(F.col(c).alias("text"))
            pool = one if pool is None else pool.union(one)
    return pool.distinct()


def not_leaked(df: DataFrame, pool: DataFrame, columns: tuple[str, ...] = ("dz", "en")) -> DataFrame:
    """Rows none of whose ``columns`` is in the pool. Spark broadcasts the pool where its measured size allows, else sorts."""
    for c in columns:
        df = df.join(pool.withColumnRenamed("text", c), c, "left_anti").select(*df.columns)
    return df


def prepare_train(train: DataFrame, pool: DataFrame, order: str = "row_id") -> DataFrame:
    """Train pairs without leaks, then without repeats; of equal pairs the first stays."""
    clean = train.where("dz <> '' AND en <> ''")
    return first_of(not_leaked(clean, pool), ["dz", "en"], order)


def train_report(train: DataFrame, pool: DataFrame) -> DataFrame:
    """``rows, blank, leaked, dup, kept`` in one pass over the pairs' distinct values."""
    counts = train.groupBy("dz", "en").agg(F.count("*").alias("n"))
    flagged = counts
    for c in ("dz", "en"):
        flagged = flagged.join(pool.select(F.col("text").alias(c), F.lit(True).alias(f"in_{c}")), c, "left")
    blank = (F.col("dz") == "") | (F.col("en") == "")
    leaked = F.coalesce("in_dz", "in_en").isNotNull()
    one = F.when(~blank & ~leaked, 1).otherwise(0)
    return flagged.agg(
        F.sum("n").alias("rows"), F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(~blank & leaked, F.col("n")).otherwise(0)).alias("leaked"),
        F.sum(one * (F.col("n") - 1)).alias("dup"), F.sum(one).alias("kept"),
    )
