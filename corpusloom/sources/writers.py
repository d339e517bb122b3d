"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.readers import TERM_COLUMNS


def write_dataset(df: DataFrame, path: str, split: str | None = "split") -> None:
    """Parquet, one folder for each split where there is such a column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split and split in df.columns else writer).parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "value", ordered: bool = False) -> None:
    """Text lines; ``ordered`` for small contractual files only: one sorted part."""
    out = df.select(F.col(column).alias("value"))
    (out.orderBy("value").coalesce(1) if ordered else out).write.mode("overwrite").text(path)


def write_term_tables(df: DataFrame, path: str) -> None:
    """One CSV folder for each category, the fixed columns in order, blanks where one is missing; coverage with two digits."""
    def cell(c: str):
        own = F.format_string("%.2f", F.col(c).cast("double")) if c == "coverage" and dict(df.dtypes)[c] == "double" else F.col(c).cast("string")
        return F.coalesce(F.when(F.col(c).isNotNull(), own), F.lit("")).alias(c)

    cols = [cell(c) if c in df.columns else F.lit("").alias(c) for c in TERM_COLUMNS]
    df.select("category", *cols).repartition("category").write.mode("overwrite").partitionBy("category").options(header=True, emptyValue="", escape='"').csv(path)


#: What the review sheet opens with; comment lines that the reader of term sheets skips.
PREAMBLE = (
    "# Review this sheet, then pass it on as the term sheet.",
    "# dz_preferred is guessed from co-occurrence: a native speaker must confirm it, and put the proper term for any loan.",
    "# Wrong forms that the corpus holds go to dz_variants, between bars, so that they are found and corrected.",
    "#",
    "# category\ten\tdz_preferred\tdz_variants",
)


def review_line() -> Column:
    """A line of the review sheet: category, English, the best candidate, no variants yet, and a comment with the evidence."""
    note = F.concat(F.lit("# "), F.col("carriers").cast("string"), F.lit(" carriers | candidates: "), F.col("dz_candidates"))
    return F.concat_ws("\t", "category", "en", "dz_preferred", F.lit(""), note)


def review_lines(df: DataFrame) -> DataFrame:
    """The lines of the review sheet under its preamble."""
    return df.select(review_line().alias("value"))


def write_review(df: DataFrame, path: str) -> None:
    """The review sheet as one text part: the preamble, then the terms in order. A line for each term, so one task holds it."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, i, "", "", line) for i, line in enumerate(PREAMBLE)], "part int, at int, category string, en string, value string")
    body = df.select(F.lit(1).alias("part"), F.lit(0).alias("at"), "category", "en", review_line().alias("value"))
    head.unionByName(body).orderBy("part", "at", "category", "en").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> str:
    """Metrics by direction as one JSON object; a row for each direction, so it fits the driver."""
    rows = {r["direction"]: {k: v for k, v in r.asDict().items() if k != "direction"} for r in df.collect()}
    text = json.dumps(rows, indent=2, sort_keys=True, default=str)
    spark = df.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
