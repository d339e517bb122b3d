"""Risk-controlled quality rules (operator 3).

A rule rejects a document when a score exceeds the cutoff of the document's stratum. Cutoffs
come from labelled documents, none of which shaped the scores: a rule's cutoffs are tried
from mild to strict, each tested with the exact binomial tail against the hypothesis that it
rejects more than its share of the tolerated rate of good documents. Within a stratum and
rule the tests stop at the first failure (a fixed sequence needs no correction); across
strata and rules the level is divided (Bonferroni), and the tolerated rate is divided among
the rules of a stratum. So, with probability ``1 - level``, no stratum loses more than
``rate`` of its good documents to the rules. Among cutoffs so guaranteed, the one that best
separates bad from good is taken. A stratum without enough labels rejects nothing.

Counts cover all labelled rows and are aggregated before they reach the driver: at most
strata x rules x (GRID + 1) x 2 numbers.

Defined results: null texts have no words; null strata are one stratum, apart from the empty name; a document labelled
more than once counts as good only if every label says so; null labels are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.base import append_arrow, quoted, texts

GRID = 100
RATE, LEVEL = 0.05, 0.05
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_marks")


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers of ``BASE`` and ``MORE`` for one whole text."""
    if not text:
        return (0,) * (len(BASE) + len(MORE))
    raw = text.encode("utf-8")
    words = raw.split()  # bytes: ASCII white space only
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    number: dict[bytes, int] = {}
    repeated = 0
    if n > 3:
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        at, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)[1:]
        twice = count[at] > 1
        cover = np.zeros(n, dtype=bool)
        for k in range(3):
            cover[k : k + len(twice)] |= twice
        repeated = int(cover.sum())
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, upper + lower, raw.count(b"!")


def measured(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the numbers of ``BASE`` and ``MORE`` (long). One Arrow pass, no shuffle."""

    def make():
        def work(column):
            rows = np.array([measure(t) for t in texts(column)], dtype=np.int64).reshape(-1, len(BASE) + len(MORE))
            return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(rows.shape[1])]

        return work

    return append_arrow(df, [text], make, [(n, T.LongType(), pa.int64()) for n in BASE + MORE], keep)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scores() -> dict[str, Column]:
    """Rules: each a score from 0 to 1, the higher the worse."""

    def share(a: str, b: str) -> Column:
        return F.least(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), F.lit(1.0))

    return {"symbols": share("n_symbols", "word_chars"), "capitals": share("n_upper", "n_letters"), "marks": share("n_marks", "n_words"), "dup_lines": share("n_dup_lines", "n_lines")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): the regularised incomplete beta function of 1 - p at n - k and k + 1, by its continued fraction."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _fraction(b, a, p) / b)


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz's evaluation); it needs some sqrt(max(a, b)) steps."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or tiny)
    out, m = d, 1
    while True:
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + top * d) or tiny)
            c = (1.0 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15 or m > 100_000:
            return out
        m += 1


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which ``k`` of ``n`` were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if binomial_tail(k, n, mid) <= level else (mid, high)
    return high


@dataclass(frozen=True)
class Cutoff:
    stratum: str
    rule: str
    cutoff: float
    good: int
    good_rejected: int
    bad_rejected: int
    bound: float


def choose(counts: dict[tuple[str, str], dict[tuple[int, bool], int]], rate: float = RATE, level: float = LEVEL) -> list[Cutoff]:
    """Cutoffs from counts by (stratum, rule) of (bin, good)."""
    rules = len({r for _, r in counts}) or 1
    tolerated, alpha = rate / rules, level / (len(counts) or 1)
    out = []
    for (stratum, rule), own in sorted(counts.items()):
        good, bad = (sum(n for (_, g), n in own.items() if g == kind) for kind in (True, False))
        gone = {True: 0, False: 0}
        best: Cutoff | None = None
        gain = 0.0
        for b in range(GRID, 0, -1):  # rejects scores of at least b / GRID
            for kind in gone:
                gone[kind] += own.get((b, kind), 0)
            # The tail falls short of the level without summing it once the seen rate is over the tolerated one.
            if gone[True] > tolerated * good or not good or binomial_tail(gone[True], good, tolerated) > alpha:
                break
            now = gone[False] / max(bad, 1) - gone[True] / good
            if now > gain:
                gain, best = now, Cutoff(stratum, rule, b / GRID, good, gone[True], gone[False], upper_bound(gone[True], good, alpha))
        if best:
            out.append(best)
    return out


def _stratum(name: str) -> Column:
    """The stratum's name after a mark; a null has none, so that it isn't the empty name."""
    return F.coalesce(F.concat(F.lit("="), quoted(name).cast("string")), F.lit(""))


def calibrate(rows: DataFrame, labels: DataFrame, key: str, stratum: str, quality: str = "quality", rate: float = RATE, level: float = LEVEL) -> list[Cutoff]:
    """Cutoffs from measured ``rows`` and ``labels`` (key, quality 0 or 1)."""
    known = labels.where(quoted(key).isNotNull() & quoted(quality).isNotNull()).groupBy(quoted(key).alias("__key")).agg(F.min(quality).alias("__good"))
    own = rows.join(known, quoted(key) == F.col("__key"))
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.floor(s * GRID).cast("int").alias("bin")) for r, s in scores().items()]))
    got = own.select(_stratum(stratum).alias("stratum"), (F.col("__good") == 1).alias("good"), bins.alias("s"))
    counts: dict[tuple[str, str], dict[tuple[int, bool], int]] = {}
    for st, rule, b, good, n in got.groupBy("stratum", "s.rule", "s.bin", "good").count().collect():
        counts.setdefault((st, rule), {})[(b, good)] = n
    return choose(counts, rate, level)


def verdict(cutoffs: list[Cutoff], stratum: str) -> Column:
    """True where no rule rejects the row."""
    rejected = F.lit(False)
    own, name = scores(), _stratum(stratum)
    for c in cutoffs:
        rejected = rejected | ((name == c.stratum) & (F.floor(own[c.rule] * GRID) >= round(c.cutoff * GRID)))
    return ~rejected
