"""Synthetic pairs: a hook for any batch translator, the filter cascade and digit augmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.filters import drop_empty_arrays, tag_synthetic, waterfall
from corpusloom.operators.order import first_rows


#: A worker sends translated rows back when they reach so many, or so many characters: bounds its memory whatever the batch and the texts.
SEND_ROWS, SEND_CHARS = 1024, 1 << 20


def translate(df: DataFrame, column: str, out: str, load: Callable[[], Callable[[Sequence[str]], Sequence[str]]], batch: int = 32) -> DataFrame:
    """Add ``out``: what the translator gives for ``column``. ``load`` runs once for each task; rows keep their identity.

    A worker holds the texts of one call of the translator and the rows not yet sent as Python objects, never a whole Arrow batch.
    """
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).withColumn(out, F.lit(None).cast("string")).schema

    slices = _slices(kept.index(column), out, batch)

    def run(frames):
        model = load()
        for frame in frames:
            yield from slices(frame, model)

    return df.select(*kept).mapInArrow(run, schema)


def _slices(at: int, out: str, batch: int) -> Callable[[pa.RecordBatch, Callable[[Sequence[str]], Sequence[str]]], Iterator[pa.RecordBatch]]:
    """A function that gives an Arrow batch with the column ``out``, in slices; it needs nothing of this package on a worker."""

    def run(frame, model):
        done = []
        start = size = 0
        for i in range(0, frame.num_rows, batch):
            texts = frame.column(at).slice(i, batch).to_pylist()
            made = list(model(texts))
            if len(made) != len(texts):
                raise ValueError(f"the translator gave {len(made)} texts for {len(texts)}")
            done += made
            size += sum(len(t) for x in (texts, made) for t in x if t is not None)
            if len(done) >= SEND_ROWS or size >= SEND_CHARS or start + len(done) == frame.num_rows:
                own = frame.slice(start, len(done))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(done, pa.string())], names=[*own.schema.names, out])
                start, done, size = start + len(done), [], 0

    return run


def tokenize(df: DataFrame, load: Callable[[str, str], Callable[[Sequence[str], Sequence[str]], tuple[Sequence[list[int]], Sequence[list[int]]]]], max_length: int) -> DataFrame:
    """Add ``input_ids`` and ``labels`` (arrays of int, ``max_length`` at most). ``load(src_lang, tgt_lang)`` gives a tokenizer of (sources, targets);
    each task makes one for each direction it meets. Rows without ids go.
    """
    schema = df.drop("input_ids", "labels").withColumns({c: F.array().cast("array<int>") for c in ("input_ids", "labels")}).schema
    names = df.drop("input_ids", "labels").columns

    def run(frames):
        made: dict[tuple[str, str], Callable] = {}
        for frame in frames:
            for way, own in frame.groupby(["src_lang", "tgt_lang"], sort=False):
                if way not in made:
                    made[way] = load(*way)
                ids, labels = made[way](own["src"].tolist(), own["tgt"].tolist())
                cut = [[list(x)[:max_length] for x in xs] for xs in (ids, labels)]
                yield own.assign(input_ids=pd.Series(cut[0], index=own.index, dtype=object), labels=pd.Series(cut[1], index=own.index, dtype=object))

    return drop_empty_arrays(df.select(*names).mapInPandas(run, schema), "input_ids")


def synthetic_rules(dz: Column, en: Column, min_ratio: float = 0.25, max_ratio: float = 3.0, digits: bool = True) -> list[tuple[str, Column]]:
    """Why a generated pair goes, in order: empty, length ratio, repetition, contradicting numbers."""
    ratio = F.size(X.chunks(en)) / F.greatest(F.size(X.chunks(dz)), F.lit(1))
    rules = [("empty", X.strip(F.coalesce(en, F.lit(""))) == ""), ("ratio", ~ratio.between(min_ratio, max_ratio)), ("repetition", X.has_repetition(en))]
    return [*rules, ("digits", X.digit_conflict(dz, en))] if digits else rules


def filter_synthetic(df: DataFrame, **limits) -> DataFrame:
    return waterfall(df, synthetic_rules(F.col("dz"), F.col("en"), **limits))


def digit_variants(df: DataFrame, key: str = "row_id", copies: int = 4, seed: int = 42) -> DataFrame:
    """Up to ``copies`` further pairs with other numbers, for pairs with the same numbers on both sides."""
    same = df.where((F.size(X.digits_in(F.col("dz"))) > 0) & (X.digits_in(F.col("dz")) == X.digits_in(F.col("en"))))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    drawn = each.withColumn("__s", X.substitute_digits(F.col("dz"), F.col("en"), F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("copy").cast("string"))))
    return drawn.where("__s.dz is not null").withColumns({"dz": F.col("__s.dz"), "en": F.col("__s.en")}).drop("__s")


def synthetic_rows(df: DataFrame, copies: int = 4, seed: int = 42, tag: str = "<bt> ", **limits) -> DataFrame:
    """Kept pairs and their digit variants as tagged rows."""
    kept = filter_synthetic(df, **limits).where("reject_reason is null").drop("reject_reason")
    both = kept.select("dz", "en")
    if copies:
        both = both.unionByName(digit_variants(kept, copies=copies, seed=seed).select("dz", "en"))
    return tag_synthetic(both, tag)


def rejected_samples(filtered: DataFrame, reason: str = "digits", n: int = 5, width: int = 70, order: str = "row_id") -> DataFrame:
    """The first ``n`` pairs that a rule cost, both sides cut to ``width`` characters for show."""
    own = filtered.where(F.col("reject_reason") == reason)
    return first_rows(own, n, order).select(order, *[F.left(c, F.lit(width)).alias(c) for c in ("dz", "en")])


def digit_drop_rate(filtered: DataFrame) -> DataFrame:
    """Share of the source rows that contradicting numbers cost; a rate over 0.25 calls for a look."""
    lost = F.count_if(F.col("reject_reason") == "digits")
    return filtered.agg(F.count("*").alias("rows"), lost.alias("dropped"), F.coalesce(F.try_divide(lost, F.count("*")), F.lit(0.0)).alias("rate"))
