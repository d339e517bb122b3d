"""From raw documents to token ids, in five stages; each is written as Parquet and read back as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, langid, pii, resemblance
from corpusloom.llm.base import aside, scratch, table
from corpusloom.llm.queries import DEMO_KEY

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A document goes if no language holds this share of it.
MIN_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejects texts without letters and texts in no one language; fills in a missing ``lang``.

    Null and empty texts have no letter and go. Rows of equal text go or stay together, repeated rows and ids included.
    """
    crf = langid.fit(langid.training_rows(docs.where(~langid.held_out("doc_id")), "text", "lang", "doc_id"))
    own, back = aside(docs, ["lang_pred", "score"])
    seen = langid.identify(own, crf, "text")
    kept = seen.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else back[c] for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 at the stage's setting: five-word shingles, Jaccard similarity 0.8 or more. SimHash fingerprints meet in BK-trees by Hamming distance, within a radius wide enough for that; the shingles are checked after.

    Of each component the document with the smallest id stays; repeated rows of it become one, other texts of its id are documents of their own.
    Rows without an id belong to no component and stay. Null and empty texts are copies of each other.
    """
    own, back = aside(docs, ["__code", "__n", "__simhash", "__bands", "least", "text_", "root", "code"])
    return resemblance.representatives(own, "doc_id", "text").select(*[back[c] for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: benchmark passages are cut out; documents of which more than half is benchmark go.

    Null and empty texts stay as they are; repeated rows and ids are judged each for itself, equal texts alike. An empty benchmark changes nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), "text", window=8, max_coverage=0.5)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data are replaced by linked pseudonyms of the same format.

    All rows stay, null and empty texts and repeated rows and ids as they are; equal values become equal pseudonyms in all of them.
    """
    return pii.pseudonymize(docs, DEMO_KEY, "text", counts=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids of every text, and digests of them and of what they decode to.

    All rows stay, repeated ones too; null and empty texts have no ids.
    """
    out = bpe.bpe_encode(docs, TOKENIZER, "text", decoded=True, keep=["doc_id", "lang", "source"])
    return out.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pseudonymize", pseudonymize),
    ("encode", encode),
]

#: Operators 5, 4, 1 and 9 have no SQL form. The tests hold the near-dedup stage and, apart from the stages, the matching of
#: operator 10 and the encoding of operator 9 against brute force; of run() as a whole they compare only which ids may stay
#: and the digests of documents without benchmark passages or personal data.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    The stages' tables hold texts as they were before the pseudonyms, so they are deleted at the session's end. With a folder ``where`` of the
    caller's they stay, and a run that failed goes on after the last stage that ended.
    """
    docs = table(spark, sf_dir, "documents")
    home = where or scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        if not (where and _whole(spark, f"{home}/{name}")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ended."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
