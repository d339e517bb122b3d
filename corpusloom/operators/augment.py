"""Term linting, carriers and substitution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.operators.mining import term_hits
from corpusloom.operators.order import GROUP_LIMIT, draw_counts, first_rows, sample_per_key
from corpusloom.sources.scratch import cut


def lint(terms: DataFrame, order: str = "ord") -> DataFrame:
    """``terms`` with ``problems`` (array of kind and message) and ``usable``.

    Empty, Latin and not Tibetan end the checks; what follows only warns. Repeats are told
    on the later row in ``order``, among rows that got that far.
    """
    dz, en = F.coalesce("dz", F.lit("")), F.coalesce("en", F.lit(""))
    stop = F.when(dz == "", F.struct(F.lit("skip").alias("kind"), F.lit("empty").alias("message")))
    stop = stop.when(X.has_latin(dz), F.struct(F.lit("error").alias("kind"), F.lit("latin letters").alias("message")))
    stop = stop.when(~X.has_tibetan(dz), F.struct(F.lit("error").alias("kind"), F.lit("no tibetan script").alias("message")))
    own = terms.withColumn("__stop", stop).withColumn("__ok", F.col("__stop").isNull())
    same_en = Window.partitionBy("category", F.lower("en"), "__ok").orderBy(order)
    same_dz = Window.partitionBy("dz", "__ok").orderBy(order)
    own = own.withColumn("__nth", F.row_number().over(same_en)).withColumn("__first", F.first("en").over(same_dz))

    def warn(test: Column, message: str) -> Column:
        return F.when(test, F.struct(F.lit("warn").alias("kind"), F.lit(message).alias("message")))

    warnings = F.array_compact(
        F.array(
            warn(~dz.endswith(X.TSHEG), "no final tsheg"), warn(en.contains(" "), "several words"), warn(F.col("__nth") > 1, "repeated english"), warn(F.col("__first") != en, "same dzongkha as another term"),
        )
    )
    return own.withColumn("problems", F.when(F.col("__ok"), warnings).otherwise(F.array("__stop"))).withColumn("usable", F.col("__ok")).drop("__stop", "__ok", "__nth", "__first")


def lint_summary(linted: DataFrame) -> DataFrame:
    """Problems by kind; the table is ready when no row says error."""
    return linted.select(F.explode("problems").alias("p")).groupBy("p.kind").agg(F.count("*").alias("n"))


def readiness(linted: DataFrame) -> DataFrame:
    """One row ``(rows, usable, skip, error, warn, ready)``: ready unless there is an error."""
    def n(kind: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("problems", lambda p: p["kind"] == kind))), F.lit(0)).cast("bigint")

    out = linted.agg(F.count("*").alias("rows"), F.count_if("usable").alias("usable"), *[n(k).alias(k) for k in ("skip", "error", "warn")])
    return out.withColumn("ready", F.col("error") == 0)


def carriers(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows that hold a term on the English side and one of its forms on the other: ``found`` is the first form in order of preference.

    ``terms``: category, term, dz, variants.
    """
    hits = term_hits(corpus, terms.withColumnRenamed("dz", "preferred"))
    forms = F.concat(F.array("preferred"), F.coalesce("variants", F.array().cast("array<string>")))
    found = F.try_element_at(F.filter(forms, lambda f: (f != "") & (F.instr(F.col("dz"), f) > 0)), F.lit(1))
    return hits.withColumn("found", found).where("found is not null")


def carrier_counts(terms: DataFrame, carried: DataFrame) -> DataFrame:
    """Carriers of every term, those without any too."""
    n = carried.groupBy("category", "term").agg(F.count("*").alias("carriers"))
    return terms.select("category", "term").join(n, ["category", "term"], "left").withColumn("carriers", F.coalesce("carriers", F.lit(0)))


def carrier_report(counts: DataFrame, zero: int = 10, top: int = 5) -> DataFrame:
    """``(kind, category, term, carriers)``: the first ``zero`` terms without a carrier, and the ``top`` richest, as a report asks for."""
    none = first_rows(counts.where("carriers = 0"), zero, "category", "term").withColumn("kind", F.lit("none"))
    rich = counts.where("carriers > 0").orderBy(F.desc("carriers"), F.desc("category"), F.desc("term")).limit(top).withColumn("kind", F.lit("richest"))
    return none.union(rich).select("kind", "category", "term", "carriers")


def augment(
    corpus: DataFrame, terms: DataFrame, phrases: DataFrame | None = None, max_carriers: int = 40, cross_per_term: int = 0, bare_repeat: int = 6, phrase_repeat: int = 8, seed: int = 42,
    ascii_words: bool = False,
) -> DataFrame:
    """Pairs ``(dz, en, bare, origin)``: corrected carriers, their loans to sibling terms, bare terms and phrases.

    ``ascii_words``: how ``swap_english`` bounds words in loans.
    """
    key, hits = ["category", "term"], carriers(corpus, terms).select("row_id", "dz", "en", "category", "term", "preferred", "found")
    many = draw_counts(hits, key, seed, "row_id", keep=["preferred"]) if max_carriers > GROUP_LIMIT else None
    drawn = sample_per_key(hits, key, max_carriers, seed, "row_id", counts=many)
    if many is None:
        drawn = cut(drawn)  # used up to three times, and small: the corpus is searched once
    origin = F.when(F.col("found") == F.col("preferred"), "kept").otherwise("corrected")
    out = drawn.select(F.replace("dz", "found", "preferred").alias("dz"), "en", F.lit(False).alias("bare"), origin.alias("origin"))
    if cross_per_term:
        # Ranked a second time, so that the carriers lent do not depend on how rows were dealt.
        lent = sample_per_key(drawn, key, cross_per_term, seed, "row_id")
        other = terms.select("category", F.col("term").alias("other"), F.col("dz").alias("other_dz"))
        both = lent.join(other, "category").where("other <> term")
        swapped = both.select("dz", "en", F.replace("dz", "found", "other_dz").alias("new_dz"), X.swap_english(F.col("en"), F.col("term"), F.col("other"), ascii_words).alias("new_en"))
        crossed = swapped.where("new_dz <> dz AND new_en <> en")
        out = out.union(crossed.select("new_dz", "new_en", F.lit(False), F.lit("cross")))
    with_any = (drawn if many is None else many).select("category", "term", F.col("preferred").alias("dz")).distinct()
    spelled = F.when(F.left("term", F.lit(1)).rlike(r"(?U)^\p{Lower}"), F.array(F.col("term"), X.capitalize(F.col("term")))).otherwise(F.array("term"))
    bare = with_any.select("dz", F.explode(spelled).alias("en")).select("dz", "en", F.explode(F.sequence(F.lit(1), F.lit(bare_repeat))))
    out = out.union(bare.select("dz", "en", F.lit(True), F.lit("bare")))
    if phrases is not None:
        more = phrases.select("dz", "en", F.explode(F.sequence(F.lit(1), F.lit(phrase_repeat))))
        out = out.union(more.select("dz", "en", F.lit(False), F.lit("phrase")))
    return out


def build_counts(made: DataFrame, counts: DataFrame) -> DataFrame:
    """``(counter, n)``: rows by origin, and terms with and without a carrier."""
    rows = made.groupBy(F.col("origin").alias("counter")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("carriers") > 0, "terms_with_carrier").otherwise("terms_without_carrier")
    return rows.union(counts.groupBy(kind.alias("counter")).agg(F.count("*").alias("n")))


def show_rows(rows: DataFrame, sentences: int = 4, bare: int = 8) -> DataFrame:
    """``(kind, src, tgt)``: a few English sources of more than five words, and a few of one word, for a reader's eye."""
    own = rows.where(F.col("src_lang") == "eng_Latn").withColumn("__n", F.size(X.chunks(F.col("src"))))
    long = first_rows(own.where("__n > 5"), sentences, "src", "tgt").select(F.lit("sentence").alias("kind"), "src", "tgt")
    return long.union(first_rows(own.where("__n = 1"), bare, "src", "tgt").select(F.lit("bare"), "src", "tgt"))


def normalize_augmented(pairs: DataFrame, markers=()) -> DataFrame:
    """Bare rows are only stripped; all others are normalised."""
    pair = X.normalize_pair(F.col("dz"), F.col("en"), markers)
    bare = F.struct(X.strip(F.col("dz")).alias("dz"), X.strip(F.col("en")).alias("en"))
    out = pairs.withColumn("__p", F.when(F.col("bare"), bare).otherwise(pair))
    return out.withColumns({"dz": F.col("__p.dz"), "en": F.col("__p.en")}).drop("__p")
