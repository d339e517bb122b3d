"""Projections, filters and the reject waterfall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X

#: Publishers of the language, and hosts known to be of another.
ALLOWED_HOSTS = "dzkuensel.com www.dzkuensel.com dzkuensel.bt www.dzkuensel.bt kuenseldzongkhaonline.blogspot.com bbs.bt www.bbs.bt dzongkha.gov.bt www.dzongkha.gov.bt nab.gov.bt www.nab.gov.bt molhr.gov.bt gnhc.gov.bt".split()
BLOCKED_HOSTS = (
    "voatibetan.com www.voatibetan.com voanews.com www.voanews.com rfa.org www.rfa.org tibettimes.net www.tibettimes.net ti.tibet3.com tibet3.com ti.zangdiyg.com zangdiyg.com "
    "baike.yongzin.com yongzin.com rgbm123.com qhtibetan.com ti.kbcmw.com kbcmw.com help.libreoffice.org audio-video.shanti.virginia.edu shanti.virginia.edu"
).split()
LANGS = ("dzo_Tibt", "eng_Latn")
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def strip_pairs(df: DataFrame) -> DataFrame:
    """Both sides stripped; pairs with a blank side go."""
    return df.withColumns({c: X.strip(F.col(c)) for c in ("dz", "en")}).where("dz <> '' AND en <> ''")


def waterfall(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reject_reason") -> DataFrame:
    """``name``: the first rule that is true, null where none is. Rules in order, cheap ones first."""
    out = F.lit(None).cast("string")
    for reason, test in reversed(rules):
        out = F.when(test, reason).otherwise(out)
    return df.withColumn(name, out)


def crawl_rules(
    url: Column, score: Column, text: Column, min_score: float = 0.85, min_ratio: float = 0.80, any_domain: bool = False,
    allowed: Sequence[str] = ALLOWED_HOSTS, blocked: Sequence[str] = BLOCKED_HOSTS, block: str = X.TIBETAN_BLOCK,
) -> list[tuple[str, Column]]:
    """Blocked hosts always, allowed hosts unless any is, then the language score (none is 0), then the script."""
    host = X.host_of(F.coalesce(url, F.lit("")))
    rules = [("blocked", host.isin(*blocked))]
    if not any_domain:
        rules.append(("domain", ~host.isin(*allowed)))
    rules.append(("score", F.coalesce(score, F.lit(0.0)) < min_score))
    rules.append(("script", X.script_ratio(F.coalesce(text, F.lit("")), block) < min_ratio))
    return rules


def reject_counts(df: DataFrame, name: str = "reject_reason") -> DataFrame:
    return df.groupBy(F.coalesce(name, F.lit("kept")).alias(name)).agg(F.count("*").alias("n"))


def sentences(df: DataFrame, text: str, terminator: str = "[།༎]+", suffix: str = X.SHAD, order: str = "pos") -> DataFrame:
    """Explode ``text`` into cleaned sentences with ``suffix`` put back; ``order`` is the position in the text.

    Pieces are cleaned and blank ones dropped inside the array, before the explode: tests of the result can't be pushed
    through it, so each piece is cleaned once.
    """
    pieces = F.transform(F.split(F.col(text), terminator, -1), lambda s, i: F.struct(i.alias(order), X.clean_sentence(s).alias("sentence")))
    kept = F.filter(pieces, lambda x: x["sentence"] != "")
    if suffix:
        kept = F.transform(kept, lambda x: F.struct(x[order].alias(order), F.concat(x["sentence"], F.lit(suffix)).alias("sentence")))
    return df.select(*[c for c in df.columns if c != text], F.inline(kept))


def within_bounds(df: DataFrame, column: str = "sentence", max_chars: int = 400, least: int = 4, most: int = 70, unit: str = X.TSHEG) -> DataFrame:
    """At most ``max_chars`` characters and between ``least`` and ``most`` units."""
    return df.where((F.length(column) <= max_chars) & X.count_of(F.col(column), unit).between(least, most))


def flatten_directions(df: DataFrame, both_ways: bool = True, langs: tuple[str, str] = LANGS) -> DataFrame:
    """Pairs as directional rows ``(src, tgt, src_lang, tgt_lang)``; other columns stay."""
    rest = [c for c in df.columns if c not in ("dz", "en")]

    def row(a: str, b: str, la: str, lb: str) -> Column:
        return F.struct(F.col(a).alias("src"), F.col(b).alias("tgt"), F.lit(la).alias("src_lang"), F.lit(lb).alias("tgt_lang"))

    ways = [row("dz", "en", *langs)] + ([row("en", "dz", *reversed(langs))] if both_ways else [])
    return df.select(*rest, F.explode(F.array(*ways)).alias("r")).select(*rest, "r.*")


def normalize_pairs(df: DataFrame, markers: Sequence[str] = (), raw: bool = False) -> DataFrame:
    if raw:
        return df
    pair = X.normalize_pair(F.col("dz"), F.col("en"), markers)
    return df.withColumn("__p", pair).withColumns({"dz": F.col("__p.dz"), "en": F.col("__p.en")}).drop("__p")


def direction(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """One direction; both tests reach the scan."""
    return df.where((F.col("src_lang") == src) & (F.col("tgt_lang") == tgt))


def confidence_gate(df: DataFrame, floor: str, column: str = "confidence") -> DataFrame:
    """Terms of at least ``floor``; labels that are no band pass."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.lower(F.col(column)))
    return df.where(F.coalesce(rank, F.lit(3)) >= CONFIDENCE[floor])


def drop_empty_arrays(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.size(column) > 0)


def tag_synthetic(df: DataFrame, tag: str = "<bt> ") -> DataFrame:
    """Synthetic pairs as rows whose source carries a tag; one direction only."""
    return df.select(F.concat(F.lit(tag), "en").alias("src"), F.col("dz").alias("tgt"), F.lit(LANGS[1]).alias("src_lang"), F.lit(LANGS[0]).alias("tgt_lang"))
