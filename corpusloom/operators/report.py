"""Profiles and audits: a few aggregated rows each, for a reader's eye."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.order import first_rows, index_percentiles


def audit(pairs: DataFrame, dz: str = "dz", honorifics: tuple[str, ...] = (), unit: str = X.TSHEG) -> DataFrame:
    """Figures of a corpus side, one row: rows, share with a number, words at most and at 95 of 100, spaces for each syllable, share with an honorific."""
    c = F.col(dz)
    words = pairs.select(F.size(X.chunks(c)).alias("words"))
    at = index_percentiles(words, "words", {"p95_words": 0.95}).select("p95_words")
    polite = F.lit(False)
    for h in honorifics:
        polite = polite | c.contains(h)
    share = lambda test: F.coalesce(F.avg(test.cast("int")), F.lit(0.0))
    own = pairs.agg(
        F.count("*").alias("rows"), share(c.rlike("[༠-༩0-9]")).alias("digit_share"), F.max(F.size(X.chunks(c))).alias("max_words"),
        F.coalesce(F.try_divide(F.sum(X.count_of(c, " ")).cast("double"), F.sum(X.count_of(c, unit))), F.lit(0.0)).alias("spaces_per_syllable"), share(polite).alias("honorific_share"),
    )
    return own.withColumn("p95_words", at.scalar())


def sentence_profile(lines: DataFrame, column: str = "sentence", unit: str = X.TSHEG) -> DataFrame:
    """One row: sentences, how many carry a numeral, units of a sentence at the middle and at 95 of 100."""
    own = lines.select(X.count_of(F.col(column), unit).alias("units"))
    at = index_percentiles(own, "units", {"median": 0.5, "p95": 0.95})
    some = lines.agg(F.count("*").alias("sentences"), F.count_if(F.col(column).rlike("[༠-༩0-9]")).alias("with_numeral"))
    return some.withColumns({c: at.select(c).scalar() for c in ("median", "p95")})


def samples(lines: DataFrame, column: str, *order: str, n: int = 5, width: int = 110) -> DataFrame:
    """The first ``n`` rows in order, cut to ``width`` characters for show."""
    return first_rows(lines, n, *order).select(F.left(column, F.lit(width)).alias(column))
