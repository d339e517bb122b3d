"""Corpus BLEU and chrF++: n-grams are counted and clipped inside a sentence, sums leave it, the published formulas end it.

Clipped counts of a sentence concern no other one, so they are made in Arrow batches and only a few sums for each
batch are shuffled. No expression of Spark's counts the repeated members of two arrays in linear time.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X

Tokens = Callable[[str], list[str]]
_SYMBOLS = re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])")
_BEFORE, _AFTER, _DASH = re.compile(r"([^0-9])([.,])"), re.compile(r"([.,])([^0-9])"), re.compile(r"([0-9])(-)")


def tokens_13a(line: str) -> list[str]:
    """The tokens of mteval-v13a: skips and line-end hyphens joined, entities decoded, punctuation set apart, but not points and commas inside numbers."""
    line = line.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = _SYMBOLS.sub(r" \1 ", f" {line} ")
    line = _AFTER.sub(r" \1 \2", _BEFORE.sub(r"\1 \2 ", line))
    return _DASH.sub(r"\1 \2 ", line).split()


def pick_tokenizer(named: Sequence[tuple[str, Callable[[], Tokens]]]) -> tuple[str, Tokens]:
    """The first tokenizer that can be made and its name, so that a score can say which it was; 13a if none can."""
    for name, make in named:
        try:
            return name, make()
        except Exception:  # noqa: BLE001 - a tokenizer may lack its model; the score must not be lost with it
            continue
    return "13a", tokens_13a


def _counts(items: Sequence, n: int) -> Counter:
    if isinstance(items, str):
        return Counter([items[i : i + n] for i in range(len(items) - n + 1)])
    return Counter(zip(*[items[i:] for i in range(n)]))


def _add(into: list[int], h: Sequence, r: Sequence, n: int) -> None:
    a, b = _counts(h, n), _counts(r, n)
    small, large = (a, b) if len(a) < len(b) else (b, a)
    into[0] += sum(min(c, large[g]) for g, c in small.items() if g in large)
    into[1] += max(0, len(h) - n + 1)
    into[2] += max(0, len(r) - n + 1)


def _sums(df: DataFrame, by: str, hyp: str, ref: str, names: Sequence[str], measure: Callable[[str, str, list[list[int]]], None]) -> DataFrame:
    """``by``, n, and for each of ``names`` its matches, hypothesis and reference counts (``m_``, ``h_``, ``r_``)."""
    columns = [f"{p}_{x}" for x in names for p in ("m", "h", "r")]

    def run(batches):
        for batch in batches:
            keys, sums = {}, []
            for key, h, r in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                at = keys.setdefault(key, len(keys))
                if at == len(sums):
                    sums.append([0, [[0, 0, 0] for _ in names]])
                sums[at][0] += 1
                measure(h or "", r or "", sums[at][1])
            rows = [[n, *[x for three in own for x in three]] for n, own in sums]
            data = [pa.array(list(keys), pa.string()), *[pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * (1 + len(columns)))]]
            yield pa.RecordBatch.from_arrays(data, names=[by, "n", *columns])

    own = df.select(F.col(by).cast("string").alias(by), hyp, ref)
    parts = own.mapInArrow(run, f"`{by}` string, n long, " + ", ".join(f"{c} long" for c in columns))
    return parts.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n", *columns)])


def bleu(df: DataFrame, by: str = "direction", hyp: str = "hyp", ref: str = "ref", tokens: Tokens = tokens_13a, max_n: int = 4) -> DataFrame:
    """``(by, bleu, n)``: BLEU of 0 to 100 with a brevity penalty; orders without a match are smoothed by halving."""
    orders = range(1, max_n + 1)

    def measure(h: str, r: str, sums: list[list[int]]) -> None:
        a, b = tokens(h), tokens(r)
        for n in orders:
            _add(sums[n - 1], a, b, n)

    wide = _sums(df, by, hyp, ref, [f"w{n}" for n in orders], measure)
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in orders:
        none = F.col(f"m_w{n}") == 0
        zeros = zeros + none.cast("int")
        value = F.when(none, 1.0 / (F.pow(F.lit(2.0), zeros) * F.col(f"h_w{n}"))).otherwise(F.col(f"m_w{n}") / F.greatest(F.col(f"h_w{n}"), F.lit(1)))
        logs = logs + F.when(F.col(f"h_w{n}") > 0, F.ln(value)).otherwise(F.lit(float("-inf")))
    brevity = F.when(F.col("h_w1") < F.col("r_w1"), F.exp(1 - F.try_divide(F.col("r_w1"), F.col("h_w1")))).otherwise(1.0)
    score = F.when((F.col("h_w1") == 0) | (F.col("m_w1") == 0), 0.0).otherwise(100 * brevity * F.exp(logs / max_n))
    return wide.select(by, score.alias("bleu"), "n")


_PUNCT = frozenset(string.punctuation)


def chrf_words(text: str) -> list[str]:
    """Words with one mark at an end set apart."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCT:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCT:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf(df: DataFrame, by: str = "direction", hyp: str = "hyp", ref: str = "ref", chars: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """``(by, chrf, n)``: character n-grams without white space and word n-grams, precision and recall averaged over orders."""
    names = [f"c{n}" for n in range(1, chars + 1)] + [f"w{n}" for n in range(1, words + 1)]

    def measure(h: str, r: str, sums: list[list[int]]) -> None:
        a, b = "".join(h.split()), "".join(r.split())
        for n in range(1, chars + 1):
            _add(sums[n - 1], a, b, n)
        if words:
            a, b = chrf_words(h), chrf_words(r)
            for n in range(1, words + 1):
                _add(sums[chars + n - 1], a, b, n)

    wide = _sums(df, by, hyp, ref, names, measure)

    def mean(side: str) -> Column:
        shares = F.array(*[F.when((F.col(f"h_{x}") > 0) & (F.col(f"r_{x}") > 0), F.col(f"m_{x}") / F.col(f"{side}_{x}")) for x in names])
        real = F.array_compact(shares)
        return F.try_divide(F.aggregate(real, F.lit(0.0), lambda s, v: s + v), F.size(real))

    p, r, b = mean("h"), mean("r"), beta * beta
    return wide.select(by, F.coalesce(100 * (1 + b) * F.try_divide(p * r, b * p + r), F.lit(0.0)).alias("chrf"), "n")


def scores(df: DataFrame, by: str = "direction", tokenizers: Sequence[tuple[str, Callable[[], Tokens]]] = ()) -> DataFrame:
    """``(by, chrf2, bleu, bleu_tokenizer, n)``, scores rounded to two digits: the record of an evaluation."""
    name, tokens = pick_tokenizer(tokenizers)
    own = bleu(df, by, tokens=tokens).drop("n").join(chrf(df, by), by)
    return own.select(by, F.round("chrf", 2).alias("chrf2"), F.round("bleu", 2).alias("bleu"), F.lit(name).alias("bleu_tokenizer"), "n")


def digit_round_trip(df: DataFrame, src: str = "src", hyp: str = "hyp") -> DataFrame:
    """How many sources with numbers keep exactly these in the hypothesis."""
    own = df.where(F.size(X.digits_in(F.col(src))) > 0)
    return own.agg(F.count("*").alias("n"), F.count_if(X.digits_in(F.col(src)) == X.digits_in(F.col(hyp))).alias("kept"))
