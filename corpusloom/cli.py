"""The command line: ``python -m corpusloom <command>``. Each command builds one plan, writes it and prints its report.

Models are no part of the engine: commands that translate take ``--translator module:function``, a function without
arguments that gives a batch translator (a list of texts to a list of texts) in each task.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import augment, boundary, dedup, filters, metrics, mining, order, report, synth
from corpusloom.plans import flows, manifest
from corpusloom.sources import readers, scratch, writers

DZ, EN = filters.LANGS


def _show(df: DataFrame, title: str = "") -> None:
    """Rows of a report, one JSON object a line."""
    if title:
        print(title)
    for r in df.collect():
        print("  " + json.dumps(r.asDict(), ensure_ascii=False, default=str))


def _hook(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _markers(spark: SparkSession, path: str) -> list[str]:
    """The marker file's lines; a missing file is no markers. A marker file is small by its making (frequent syllables only)."""
    return sorted({r[0] for r in readers.read_lines(spark, path, missing_ok=True).collect()}) if path else []


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.csv:
        sizes = {k: int(v) for k, v in (x.split("=") for x in a.sizes)}
        numbered = order.positions(readers.read_pairs_csv(spark, a.csv), "row_id", name="place").drop("row_id").withColumnRenamed("place", "row_id")
        rows = readers.range_splits(numbered, sizes)
    else:
        rows = readers.read_pairs(spark, dataset=a.dataset)
    splits = {s: rows.where(F.col("split") == s).select("row_id", "dz", "en") for s in ("train", "validation", "test")}
    _show(rows.groupBy("split").count(), "Loaded")
    clean = {k: filters.strip_pairs(v) for k, v in splits.items()}
    _show(dedup.train_report(clean["train"], dedup.eval_pool(clean["validation"], clean["test"])), "Train")
    markers = _markers(spark, a.markers)
    out = scratch.cut(flows.prepare(splits, markers, raw=a.raw, both_ways=not a.single_direction))
    writers.write_dataset(out, a.out)
    own = manifest.write_manifest(out, a.out.rstrip("/") + "-manifest", vars(a), markers=markers)
    print("Rows", json.dumps(own["row_counts"]))
    _show(order.first_rows(out.where("split = 'train'"), 2, "src", "tgt"), "Examples")


def respace(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = order.positions(readers.read_lines(spark, a.mono).withColumn("at", F.monotonically_increasing_id()), "at")
    train, held = boundary.head_and_rest(lines, "row_id", a.train_frac)
    if a.mode == "learn":
        found = boundary.marker_lines(boundary.learn_markers(train, min_count=a.min_count, min_prob=a.min_prob))
        writers.write_lines(found, a.out, ordered=True)
        print(f"Learned {found.count()} markers -> {a.out}")
        return
    known = readers.read_lines(spark, a.markers).select(F.col("value").alias("tail")).distinct()
    _show(boundary.boundary_recall(held, known), "Boundary recall (every space of the held-out lines is one)")


def monolingual(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = readers.read_split(spark, a.docs).withColumn("doc_id", F.monotonically_increasing_id())
    rules = filters.crawl_rules(F.col("url"), F.col("og_language_score"), F.col("og_full_text"), a.min_lang_score, a.min_tibetan_ratio, a.any_domain)
    _show(filters.reject_counts(filters.waterfall(docs, rules)), "Documents")
    limits = {"min_score": a.min_lang_score, "min_ratio": a.min_tibetan_ratio, "any_domain": a.any_domain}
    bounds = {"max_chars": a.max_chars, "least": a.min_syllables, "most": a.max_syllables}
    own = scratch.cut(flows.monolingual(docs, bounds=bounds, **limits))
    writers.write_lines(own, a.out, "sentence")
    _show(report.sentence_profile(own), "Sentences")
    _show(report.samples(own, "sentence", "doc", "pos"), "Sample")


def _term_rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Terms ``(ord, category, term, en, dz, variants, confidence, file)`` from one sheet or from a folder of tables."""
    if a.terms:
        cells = readers.read_tsv(spark, a.terms, ["category", "en", "dz", "variants"], 3)
        variants = F.filter(F.transform(F.split("variants", r"\|"), X.strip), lambda v: (v != "") & ~v.startswith("#"))
        own = cells.select(*[X.strip(F.col(c)).alias(c) for c in ("category", "en", "dz")], variants.alias("variants"), F.lit("").alias("confidence"), F.lit(a.terms.rpartition("/")[2]).alias("file"))
        own = own.withColumn("line", F.monotonically_increasing_id())
    else:
        own = readers.read_term_dir(spark, a.terms_dir)
    return order.positions(own, "file", "line", name="ord").withColumn("term", F.col("en")).drop("line")


def _seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed terms from a sheet of category and term; without one, the seed words."""
    return readers.read_tsv(spark, path, ["category", "term"], 2) if path else mining.seed_terms(spark)


def terms(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = readers.read_pairs_csv(spark, a.csv)
    if a.mode == "discover":
        draft = scratch.cut(mining.draft_table(corpus, _seeds(spark, a.seeds), a.min_count))
        writers.write_review(draft, a.out)
        print(f"Drafted {draft.count()} terms -> {a.out}")
        return
    raw = _term_rows(spark, a)
    if a.mode == "build":
        raw = filters.confidence_gate(raw, a.min_confidence)
    linted = scratch.cut(augment.lint(raw))
    state = augment.readiness(linted).first()
    print("Terms", json.dumps(state.asDict()))
    told = linted.select("ord", "file", "en", F.explode("problems").alias("p")).where("p.kind <> 'skip'").select("ord", "file", "en", "p.kind", "p.message")
    _show(told.orderBy("ord") if a.verbose else order.first_rows(told, 18, "ord"), "Problems")
    usable = linted.where("usable").select("category", "term", "dz", "variants").dropDuplicates(["category", "term"])
    if a.mode == "check":
        _show(augment.carrier_report(augment.carrier_counts(usable, augment.carriers(corpus, usable))), "Carriers of usable terms")
        print("READY" if state["ready"] else "NOT READY")
        return
    if not state["ready"]:
        raise SystemExit("Terms with errors: mend or drop these rows first.")
    phrases = readers.read_tsv(spark, a.phrases, ["en", "dz"], 2).select(*[X.strip(F.col(c)).alias(c) for c in ("dz", "en")]) if a.phrases else None
    made = augment.augment(corpus, usable, phrases, a.max_carriers, a.cross_per_term, a.bare_repeat, a.phrase_repeat, a.seed)
    own = scratch.cut(made if a.no_normalize else augment.normalize_augmented(made, _markers(spark, a.markers)))
    _show(augment.build_counts(own, augment.carrier_counts(usable, augment.carriers(corpus, usable))), "Rows and terms")
    rows = filters.flatten_directions(own.select("dz", "en"))
    writers.write_dataset(rows, a.out, None)
    _show(augment.show_rows(rows), "Read these before training on them")


def term_tables(spark: SparkSession, a: argparse.Namespace) -> None:
    table = scratch.cut(mining.term_table(readers.read_pairs_csv(spark, a.csv), _seeds(spark, a.seeds), a.min_carriers, a.top))
    writers.write_term_tables(table, a.out)
    _show(mining.band_summary(table).orderBy("category"), "Terms by band")


def backtranslate(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = order.positions(readers.read_lines(spark, a.mono).select(F.col("value").alias("dz"), F.monotonically_increasing_id().alias("at")), "at").drop("at")
    if a.limit:
        lines = lines.where(F.col("row_id") < a.limit)
    made = scratch.cut(synth.translate(lines, "dz", "en", _hook(a.translator), a.batch))  # translated once, whatever is asked of it
    limits = {"min_ratio": a.min_ratio, "max_ratio": a.max_ratio, "digits": not a.no_digit_filter}
    judged = synth.filter_synthetic(made, **limits)
    _show(filters.reject_counts(judged), "Pairs")
    rate = synth.digit_drop_rate(judged).first()["rate"]
    if rate > 0.25:
        print(f"{rate:.0%} of the pairs contradict in their numbers: look at these, then think of --no-digit-filter")
        _show(synth.rejected_samples(judged))
    writers.write_dataset(synth.synthetic_rows(made, a.digit_aug, a.seed, "" if a.no_tag else "<bt> ", **limits), a.out, None)


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> tuple[str, DataFrame]:
    """The first benchmark that can be read: two columns of one table, or a table for each language."""
    def columns() -> DataFrame:
        return readers.paired(readers.read_split(spark, a.benchmark), f"sentence_{DZ}", f"sentence_{EN}")

    def languages() -> DataFrame:
        return readers.join_languages(*[readers.read_split(spark, f"{a.benchmark}/{x}") for x in (DZ, EN)], expect=True).select("dz", "en")

    return readers.first_source([("paired", columns), ("per language", languages)])


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.benchmark:
        source, pairs = _benchmark(spark, a)
        print(f"Benchmark: {a.benchmark} ({source})")
        rows = filters.flatten_directions(pairs)
    else:
        rows = readers.read_split(spark, a.data, a.split)
    rows = rows.select("src", "tgt", "src_lang", "tgt_lang")
    if a.limit:
        rows = filters.direction(rows, DZ, EN).orderBy("src", "tgt").limit(a.limit).union(filters.direction(rows, EN, DZ).orderBy("src", "tgt").limit(a.limit))
    hook = _hook(a.translator)
    done = None
    for src, tgt in ((DZ, EN), (EN, DZ)):  # each direction has a translator of its own
        own = synth.translate(filters.direction(rows, src, tgt), "src", "hyp", lambda s=src, t=tgt: hook(s, t), a.batch)
        done = own if done is None else done.unionByName(own)
    done = scratch.cut(done)
    scored = done.select(X.direction_key(F.col("src_lang"), F.col("tgt_lang")).alias("direction"), "hyp", F.col("tgt").alias("ref"))
    named = [(n, _hook(f)) for n, _, f in (x.partition("=") for x in a.tokenizer)]
    result = metrics.scores(scored, tokenizers=named)
    print(writers.write_metrics(result, a.out) if a.out else json.dumps({r["direction"]: r.asDict() for r in result.collect()}))
    _show(metrics.digit_round_trip(done), "Numbers kept")


def training_set(spark: SparkSession, a: argparse.Namespace) -> None:
    extra = [readers.read_split(spark, p).select("src", "tgt", "src_lang", "tgt_lang") for p in a.extra_data]
    rows = flows.with_extra(readers.read_split(spark, a.data).select("src", "tgt", "src_lang", "tgt_lang", "split"), *extra)
    if a.tokenizer:
        rows = synth.tokenize(rows, _hook(a.tokenizer), a.max_length)
    keys = ("src", "tgt", "src_lang")
    train = order.shuffled(rows.where("split = 'train'"), a.seed, *keys, limit=512 if a.smoke else 0).drop("draw")
    rest = rows.where("split <> 'train'")
    if a.eval_subset:
        rest = rest.where("split <> 'validation'").unionByName(order.shuffled(rest.where("split = 'validation'"), a.seed, *keys, limit=a.eval_subset).drop("draw"))
    out = scratch.cut(train.unionByName(rest))
    writers.write_dataset(out, a.out)
    own = manifest.write_manifest(out, a.out.rstrip("/") + "-manifest", vars(a), markers=_markers(spark, a.markers))
    print("Rows", json.dumps(own["row_counts"]))


def translate(spark: SparkSession, a: argparse.Namespace) -> None:
    src, tgt = (DZ, EN) if a.direction == "dz2en" else (EN, DZ)
    hook = _hook(a.translator)
    done = synth.translate(readers.literal_texts(spark, a.text).withColumnRenamed("text", "src"), "src", "hyp", lambda: hook(src, tgt))
    _show(done.orderBy("row_id").select("src", "hyp"))
    _show(metrics.digit_round_trip(done), "Numbers kept")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    commands = top.add_subparsers(dest="command", required=True)

    def add(f: Callable, name: str, *options: tuple) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        own.set_defaults(run=f)
        for flag, default in options:
            if isinstance(default, bool):
                own.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                own.add_argument(flag, nargs="*", default=default)
            elif default is None:
                own.add_argument(flag, required=True)
            else:
                own.add_argument(flag, type=type(default), default=default)
        return own

    markers = ("--markers", "")
    #: The split sizes of the corpus's CSV.
    sizes = ["train=225565", "validation=3436", "test=3488"]
    add(prepare, "prepare", ("--dataset", ""), ("--csv", ""), ("--sizes", sizes), ("--out", None), ("--single-direction", False), ("--raw", False), markers)
    add(respace, "respace", ("--mono", None), markers, ("--out", "boundary_markers"), ("--min-count", 200), ("--min-prob", 0.90), ("--train-frac", 0.7)).add_argument("mode", choices=["learn", "validate"])
    add(
        monolingual, "monolingual", ("--docs", None), ("--out", None), ("--min-lang-score", 0.85), ("--min-tibetan-ratio", 0.80), ("--min-syllables", 4), ("--max-syllables", 70), ("--max-chars", 400), ("--any-domain", False)
    )
    add(term_tables, "term-tables", ("--csv", None), ("--seeds", ""), ("--out", None), ("--min-carriers", 4), ("--top", 3))
    own = add(
        terms, "terms", ("--csv", None), ("--terms", ""), ("--terms-dir", "terms"), ("--phrases", ""), ("--seeds", ""), ("--out", ""), ("--min-count", 5), ("--max-carriers", 40), ("--cross-per-term", 0),
        ("--phrase-repeat", 8), ("--bare-repeat", 6), ("--no-normalize", False), ("--seed", 42), ("--verbose", False), markers,
    )
    own.add_argument("--min-confidence", choices=list(filters.CONFIDENCE), default="low")
    own.add_argument("mode", choices=["discover", "build", "check"])
    add(
        backtranslate, "backtranslate", ("--translator", None), ("--mono", None), ("--out", None), ("--batch", 32), ("--limit", 0), ("--no-tag", False), ("--no-digit-filter", False), ("--digit-aug", 4), ("--seed", 42),
        ("--min-ratio", 0.25), ("--max-ratio", 3.0),
    )
    add(evaluate, "evaluate", ("--translator", None), ("--data", ""), ("--split", "test"), ("--benchmark", ""), ("--batch", 32), ("--limit", 0), ("--out", ""), ("--tokenizer", []))
    add(training_set, "training-set", ("--data", None), ("--extra-data", []), ("--out", None), ("--eval-subset", 0), ("--smoke", False), ("--seed", 42), ("--tokenizer", ""), ("--max-length", 64), markers)
    add(translate, "translate", ("--translator", None), ("--direction", "dz2en")).add_argument("text", nargs="+")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    own = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"corpusloom {own.command}").getOrCreate()
    run = own.run
    del own.run
    run(spark, own)
