"""Bilingual term mining by coverage and lift, over one hash join of terms with words.

A term of one word meets the corpus through its words (each word and, where it ends in s,
the word without it), so the join is on equality; only terms of several words are then
held against the sentence. Rows are multiplied only by words that some term begins with.
Frequencies are counted, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.sources.scratch import cut

BANDS = (("high", 0.80), ("medium", 0.50), ("low", 0.0))
#: English words, by category, whose rendering upstream audits first.
SEED_WORDS = {
    "fruit": ("apple", "banana", "mango", "orange", "grape", "peach", "pear", "guava", "papaya", "lemon", "pineapple", "watermelon"),
    "vegetable": ("potato", "onion", "chilli", "cabbage", "carrot", "spinach", "tomato", "garlic", "ginger", "radish", "pumpkin"),
    "animal": ("cow", "dog", "cat", "horse", "yak", "goat", "sheep", "pig", "chicken", "tiger", "bear", "monkey", "snake", "bird", "fish"),
    "kinship": ("mother", "father", "brother", "sister", "uncle", "aunt", "son", "daughter", "grandmother", "grandfather", "wife", "husband"),
    "place": ("thimphu", "paro", "punakha", "bumthang", "trongsa", "wangdue", "trashigang", "india", "nepal", "bhutan"),
    "colour": ("red", "blue", "green", "yellow", "white", "black", "orange"),
    "person": ("tom", "mary", "john", "alice", "david", "mike"),
}
#: Up to so many first words of terms are tested inside the scan; beyond, every word meets the join.
MAX_KEYS = 20_000


def seed_terms(spark: SparkSession) -> DataFrame:
    """``(category, term)`` of the seed words."""
    return spark.createDataFrame([(c, w) for c, words in SEED_WORDS.items() for w in words], "category string, term string")


def words_of(en: Column, keys: Sequence[str] | None = None) -> Column:
    """Lower-cased words, and words that end in s also without it; only those among ``keys`` where these are given."""
    w = F.regexp_extract_all(F.lower(en), F.lit(r"(?U)\w+"), F.lit(0))
    if keys is not None:  # most words go before any is cut or compared
        own = F.filter(w, lambda x: x.isin(*{y for k in keys for y in (k, f"{k}s")}))
        return F.filter(_singular(own), lambda x: x.isin(*keys))
    return _singular(w)


def _singular(w: Column) -> Column:
    return X.let(w, lambda own: F.array_distinct(F.concat(own, F.transform(F.filter(own, lambda x: x.endswith("s")), lambda x: F.substr(x, F.lit(1), F.length(x) - 1)))))


def first_word(term: Column) -> Column:
    """The first word of a term, lower-cased; null for a term without one."""
    return F.try_element_at(F.filter(F.split(F.lower(term), r"(?U)\W+"), lambda x: x != ""), F.lit(1))


def matches(en: str = "en", term: str = "term") -> Column:
    """Whether the English side has the term or its plural as whole words."""
    return F.expr(f"{en} rlike concat('(?iU)\\\\b\\\\Q', {term}, '\\\\Es?\\\\b')")


def term_hits(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms x corpus`` where the English side has the term or its plural; columns of both, once a pair.

    Terms without a word (blank, punctuation) and repeated terms of a category are left out. Spark broadcasts the terms
    where their measured size allows; then nothing is shuffled.
    """
    # Written, so that its size is measured: Spark would take a relation of the session's for a large one and broadcast the corpus.
    keyed = cut(terms.withColumn("__w", first_word(F.col("term"))).where("__w is not null").dropDuplicates(["category", "term"]).coalesce(1))
    keys = [r[0] for r in keyed.select("__w").distinct().limit(MAX_KEYS + 1).collect()]
    words = words_of(F.col("en"), keys if len(keys) <= MAX_KEYS else None)
    # A row has each of its words once and a term has one first word, so no pair comes twice.
    joined = corpus.withColumn("__w", F.explode(words)).join(keyed, "__w").drop("__w")
    return joined.where(~F.col("term").rlike(r"(?U)\W") | matches())


def chunk_frequency(corpus: DataFrame, column: str = "dz") -> DataFrame:
    """``(chunk, df)``: in how many rows a chunk occurs."""
    return corpus.select(F.explode(F.array_distinct(X.chunks(F.col(column)))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("df"))


def _with_total(chunks: Column) -> Column:
    """A row's distinct chunks and a null that counts the row."""
    return F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(chunks))


def evidence(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """``(category, term, chunk, c)``: in how many of a term's hits a chunk occurs; the null chunk counts the hits. Written once."""
    own = term_hits(corpus, terms).select("category", "term", F.explode(_with_total(X.chunks(F.col("dz")))).alias("chunk"))
    return cut(own.groupBy("category", "term", "chunk").agg(F.count("*").alias("c")))


def hit_counts(seen: DataFrame) -> DataFrame:
    """``(category, term, hits)`` of terms with any."""
    return seen.where("chunk is null").select("category", "term", F.col("c").alias("hits"))


def associations(corpus: DataFrame, terms: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``(category, term, chunk, c, hits, coverage, lift)`` of every chunk seen with a term.

    Two passes over the corpus: one for the hits, one for the overall frequencies; both leave aggregates only.
    """
    seen = evidence(corpus, terms) if seen is None else seen
    overall = cut(corpus.select(F.explode(_with_total(X.chunks(F.col("dz")))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("df")))
    total = overall.where("chunk is null").select("df").scalar()
    scored = seen.where("chunk is not null").join(hit_counts(seen), ["category", "term"]).join(overall, "chunk").withColumn("rows", total)
    coverage = F.col("c") / F.col("hits")
    return scored.select("category", "term", "chunk", "c", "hits", coverage.alias("coverage"), (coverage / F.greatest(F.col("df") / F.col("rows"), F.lit(1e-9))).alias("lift"))


def discover_floor(scored: DataFrame, min_count: int = 5) -> DataFrame:
    """Candidates of terms with evidence enough, seen three times and in 15 of 100 hits at least."""
    return scored.where((F.col("hits") >= min_count) & (F.col("c") >= F.greatest(F.lit(3.0), 0.15 * F.col("hits"))))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` candidates of each term by lift, coverage, chunk, all descending."""
    w = Window.partitionBy("category", "term").orderBy(F.desc("lift"), F.desc("coverage"), F.desc("chunk"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def band(coverage: Column) -> Column:
    """The first band whose floor the unrounded coverage reaches."""
    out = F.lit(None).cast("string")
    for name, floor in reversed(BANDS):
        out = F.when(coverage >= floor, name).otherwise(out)
    return out


def _best(candidates: DataFrame, shown: Column) -> DataFrame:
    """A row for each term: its first candidate with the coverage, and all of them, shown and joined by bars."""
    s = F.struct("rank", shown.alias("s"))
    return candidates.groupBy("category", "term").agg(
        F.max("hits").alias("hits"), F.max(F.when(F.col("rank") == 1, F.col("chunk"))).alias("dz_preferred"), F.max(F.when(F.col("rank") == 1, F.col("coverage"))).alias("coverage"),
        F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["s"]), " | ").alias("dz_candidates"),
    )


def draft_table(corpus: DataFrame, terms: DataFrame, min_count: int = 5, top: int = 4) -> DataFrame:
    """The draft for review: ``(category, en, carriers, dz_preferred, dz_candidates)`` of terms with ``min_count`` hits or more.

    Candidates are shown with their counts; a term may have none.
    """
    seen = evidence(corpus, terms)
    best = _best(ranked(discover_floor(associations(corpus, terms, seen), min_count), top), F.format_string("%s(%d)", "chunk", "c")).drop("hits", "coverage")
    out = hit_counts(seen).where(F.col("hits") >= min_count).join(best, ["category", "term"], "left")
    return out.select("category", F.col("term").alias("en"), F.col("hits").alias("carriers"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("dz_preferred", "dz_candidates")])


def term_table(corpus: DataFrame, terms: DataFrame, min_carriers: int = 4, top: int = 3) -> DataFrame:
    """The term tables: every term, with its best candidate, band and candidates, or MISSING where evidence lacks.

    ``coverage`` is unrounded; the sink shows two digits. ``review`` says why a row needs a look.
    """
    seen = evidence(corpus, terms)
    best = _best(ranked(associations(corpus, terms, seen).where("coverage >= 0.15"), top), F.format_string("%s(%.2f)", "chunk", "coverage")).drop("hits")
    out = terms.select("category", "term").join(hit_counts(seen), ["category", "term"], "left").join(best, ["category", "term"], "left")
    carriers = F.coalesce("hits", F.lit(0))
    known = F.col("dz_preferred").isNotNull()
    enough = (carriers >= min_carriers) & known
    rank = F.when(enough, band(F.col("coverage"))).otherwise("MISSING")
    review = F.when(carriers < min_carriers, "YES - not in corpus").when(~known, "YES - no clear candidate").when(rank == "high", "").otherwise("YES")
    return out.select(
        "category", F.col("term").alias("en"), F.when(enough, F.col("dz_preferred")).otherwise("").alias("dz_preferred"), rank.alias("confidence"),
        F.when(enough, F.col("coverage")).alias("coverage"), carriers.alias("carriers"), F.when(enough, F.col("dz_candidates")).otherwise("").alias("dz_candidates"), review.alias("review"),
    )


def band_summary(table: DataFrame) -> DataFrame:
    """Terms of each category by band."""
    names = [*[b for b, _ in BANDS], "missing"]
    return table.groupBy("category").agg(*[F.count_if(F.lower("confidence") == b).alias(b) for b in names])
