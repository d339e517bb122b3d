"""Whole paths, as lazy plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import nfc
from corpusloom.operators import filters
from corpusloom.operators.dedup import eval_pool, prepare_train
from corpusloom.operators.order import first_of


def prepare(splits: dict[str, DataFrame], markers: Sequence[str] = (), raw: bool = False, both_ways: bool = True) -> DataFrame:
    """Directional rows of all splits: train without leaks and repeats, evaluation splits as they are, blanks dropped."""
    clean = {k: filters.strip_pairs(v) for k, v in splits.items()}
    pool = eval_pool(*[v for k, v in clean.items() if k != "train"])
    out = None
    for name, df in clean.items():
        own = prepare_train(df, pool) if name == "train" else df
        rows = filters.flatten_directions(filters.normalize_pairs(own.select("dz", "en"), markers, raw), both_ways).withColumn("split", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def monolingual(docs: DataFrame, url: str = "url", score: str = "og_language_score", text: str = "og_full_text", key: str = "doc_id", bounds: dict | None = None, **limits) -> DataFrame:
    """Distinct sentences of the crawl documents that pass the waterfall, the first occurrence of each within ``bounds``."""
    rules = filters.crawl_rules(F.col(url), F.col(score), F.col(text), **limits)
    kept = filters.waterfall(docs, rules).where("reject_reason is null")
    own = filters.sentences(kept.select(F.col(key).alias("doc"), nfc(F.col(text)).alias("text")), "text")
    bounded = filters.within_bounds(own, **(bounds or {})).withColumn("at", F.struct("doc", "pos"))
    return first_of(bounded.select("sentence", "at"), ["sentence"], "at").select("sentence", "at.doc", "at.pos")


def with_extra(train: DataFrame, *extra: DataFrame) -> DataFrame:
    """Further rows appended to the train split alone."""
    out = train
    for e in extra:
        out = out.unionByName(e.withColumn("split", F.lit("train")))
    return out
