"""Scans. Order is never implicit: a source whose order counts gets a ``row_id`` or a natural key."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X

PAIR = T.StructType([T.StructField("dz", T.StringType()), T.StructField("en", T.StringType())])
TERM_COLUMNS = ("en", "dz_preferred", "confidence", "coverage", "carriers", "dz_candidates", "review", "dz_variants", "notes")
LINE = T.StructType([T.StructField("value", T.StringType())])
#: Names under which a corpus may hold its two sides.
SIDE_ALIASES = {"dz": ("dz", "dzo", "dzongkha", "source", "src"), "en": ("en", "eng", "english", "target", "tgt")}


def spread(df: DataFrame) -> DataFrame:
    """A table too small to give every core a file split is dealt over the cores; any larger one stays as it is scanned."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


def read_pairs_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``(row_id, dz, en)`` of a two-column CSV with a header; fields of any length, sides stripped; ``row_id`` follows the file, with gaps.

    A quoted field may hold line breaks, so each file is one task; without such fields ``multiline=False`` lets large files be split.
    """
    raw = spark.read.schema(PAIR).options(header=True, multiLine=multiline, escape='"', maxCharsPerColumn=-1).csv(path)
    numbered = raw.withColumn("row_id", F.monotonically_increasing_id())
    return numbered.select("row_id", *[X.strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("dz", "en")])


def read_pairs(spark: SparkSession, csv_path: str = "", dataset: str = "", split: str | None = None) -> DataFrame:
    """``(row_id, dz, en)`` and ``split`` where there is one: from a CSV if one is given, else from a stored dataset, nested pairs or plain."""
    if csv_path:
        return read_pairs_csv(spark, csv_path)
    if not dataset:
        raise ValueError("neither a CSV nor a dataset is given")
    df = read_split(spark, dataset, split)
    if "translation" in df.columns:
        df = flatten_translation(df)
    return df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())


def range_splits(df: DataFrame, sizes: dict[str, int], expect: bool = True) -> DataFrame:
    """``split`` from consecutive ranges of ``row_id``; the total is asserted when ``expect``."""
    total = sum(sizes.values())
    if expect and (n := df.count()) != total:
        raise ValueError(f"{n} rows; the splits need {total}")
    split, end = None, 0
    for name, size in sizes.items():
        end += size
        test = F.col("row_id") < end
        split = F.when(test, name) if split is None else split.when(test, name)
    return df.withColumn("split", split)


def flatten_translation(df: DataFrame, column: str = "translation") -> DataFrame:
    """Nested pairs as plain columns."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.dz", f"{column}.en")


def first_source(readers: Sequence[tuple[str, Callable[[], DataFrame]]], forced: str = "") -> tuple[str, DataFrame]:
    """The first reader whose schema resolves and that has a row, or the forced one; all errors are told if none does."""
    errors = []
    for name, read in readers:
        if forced and name != forced:
            continue
        try:
            df = read()
            if df.isEmpty():
                raise ValueError("no rows")
            return name, df
        except Exception as e:  # noqa: BLE001 - a source may fail in any way; the next is tried
            errors.append(f"{name}: {str(e).splitlines()[0][:200]}")
    raise RuntimeError("no source could be read: " + "; ".join(errors))


def paired(df: DataFrame, left: str, right: str) -> DataFrame:
    """Two aligned columns of one table as a pair."""
    return df.select(F.col(left).alias("dz"), F.col(right).alias("en"))


def join_languages(left: DataFrame, right: DataFrame, key: str = "id", value: str = "text", order: str | None = None, expect: bool = False) -> DataFrame:
    """Two tables of one language each, joined on their ids; of rows with one id on the right the last counts.

    With ``expect``, tables that have no id in common are an error.
    """
    one = right.groupBy(key).agg((F.max_by(value, order) if order else F.max(value)).alias("en"))
    out = left.select(key, F.col(value).alias("dz")).join(one, key)
    if expect and out.isEmpty():
        raise ValueError(f"no sentences aligned on {key}")
    return out


def read_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Lines stripped, blank ones dropped; a missing file is no lines if ``missing_ok``."""
    try:
        raw = spark.read.text(path)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LINE)
        raise
    return raw.select(X.strip(F.col("value")).alias("value")).where("value <> ''")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], required: int) -> DataFrame:
    """Tab-separated cells; blank lines, comments (#) and lines of fewer than ``required`` cells are skipped."""
    raw = spark.read.text(path).where((X.strip(F.col("value")) != "") & ~F.col("value").rlike(rf"(?U)^[\s]*#"))
    cells = raw.select(F.split("value", "\t", -1).alias("c")).where(F.size("c") >= required)
    return cells.select(*[F.coalesce(F.try_element_at("c", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(columns)])


def _header_of(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff")]), [])


def read_term_dir(spark: SparkSession, path: str) -> DataFrame:
    """All term CSVs of a folder, in the order of their names: category from the file's name, variants as an array, sides stripped.

    Cells are found by the names in their own file's header; further columns are ignored, missing ones are blank.
    Files that share a header are read by one scan.
    """
    files = spark.read.format("binaryFile").load(f"{path}/*.csv").select("path", F.split_part(F.decode("content", "UTF-8"), F.lit("\n"), F.lit(1)).alias("h"))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in files.collect():  # a row for each term file, its first line only
        by_header.setdefault(tuple(_header_of(r["h"].rstrip("\r"))), []).append(r["path"])
    out = None
    for header, paths in sorted(by_header.items()):
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        raw = spark.read.schema(schema).options(header=True, enforceSchema=True, escape='"', multiLine=True, maxCharsPerColumn=-1).csv(sorted(paths))
        at = {name: i for i, name in enumerate(header)}
        have = {c: X.strip(F.coalesce(F.col(f"c{at[c]}"), F.lit(""))) if c in at else F.lit("") for c in TERM_COLUMNS}
        variants = F.filter(F.transform(F.split(have["dz_variants"], r"\|"), X.strip), lambda v: v != "")
        file = F.col("_metadata.file_name")
        own = raw.select(
            F.regexp_replace(file, r"\.csv$", "").alias("category"), have["en"].alias("en"), have["dz_preferred"].alias("dz"), variants.alias("variants"),
            F.lower(have["confidence"]).alias("confidence"), file.alias("file"), F.monotonically_increasing_id().alias("line"),
        ).where("en <> ''")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise FileNotFoundError(f"no term files in {path}")
    return out


def literal_texts(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """Given texts as rows ``(row_id, text)``."""
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


def detect_sides(df: DataFrame) -> dict[str, str]:
    """Which columns hold the two sides: by alias, else the fixed names."""
    low = {c.lower(): c for c in df.columns}
    return {side: next((low[a] for a in names if a in low), side) for side, names in SIDE_ALIASES.items()}


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A stored dataset; one split is pruned at the scan."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
