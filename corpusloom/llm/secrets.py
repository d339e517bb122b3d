"""Secret scans over an incremental blob ledger (operator 8).

Every version of a path is content-addressed: its blob is the SHA-256 of its text. The
ledger has one row for each blob and rule version already scanned, with the findings, and
stays in a folder of its own between runs. A run addresses all versions, scans each blob that
the ledger lacks for this rule version once, however many paths hold it, appends it to the
ledger, and joins findings back to all paths. Texts that were scanned before are neither
shuffled nor scanned again. The ledger holds spans, never texts.

Spans are code points, end exclusive. Base kinds are kept as they are; ``EXTRA`` adds
further kinds. Defined results: null text is the empty blob; repeated paths repeat (each row
is a version of its path).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.base import append_arrow, cut, quoted, salted_join, texts

#: Name of the rules: a digest of this module. Where it changed, old blobs are scanned again.
VERSION = hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:12]
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("version", T.StringType()), T.StructField("findings", T.ArrayType(T.StringType()))])
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Fixed: published shapes of further credentials, and a string each must contain.
EXTRA = {
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
}
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate([*BASE, *EXTRA])}


def scan_text(text: str | None) -> list[str]:
    """All findings of a whole text as ``kind:start:end``, by start, then kind."""
    text = text or ""
    found: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        # A value that is too short still uses up what it matched.
        found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    for kind, (needle, rule) in EXTRA.items():
        if needle in text:
            found += [(m.start(), ORDER[kind], m.end(), kind) for m in rule.finditer(text)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def read_ledger(spark: SparkSession, home: str) -> DataFrame | None:
    """``(blob, version, findings)`` of all runs that ended; None before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(home)


def scan_versions(df: DataFrame, path: str, text: str, home: str | None = None, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every row, and this run's new entries of the ledger in the folder ``home`` (without one, all blobs are new).

    ``(path, blob, findings)`` and ``(blob, version, findings)``. Shuffles checksums, and each unseen text once
    (copies are merged before the shuffle).
    """
    spark = df.sparkSession
    blob = F.sha2(F.coalesce(quoted(text), F.lit("")).cast("binary"), 256)
    paths = df.select(quoted(path).alias("path"), blob.alias("blob"))
    fresh = df.select(blob.alias("blob"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    ledger = read_ledger(spark, home) if home else None
    if ledger is not None:
        ledger = ledger.where(F.col("version") == version).dropDuplicates(["blob"])
        unseen = cut(paths.select("blob").distinct().join(ledger.select("blob"), "blob", "left_anti"))
        few = int(unseen._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        # Few unseen blobs keep all other texts where they are. Many meet the texts after the copies were merged, so that no hot blob gathers in a task.
        fresh = fresh.join(F.broadcast(unseen), "blob", "left_semi").dropDuplicates(["blob"]) if few else fresh.dropDuplicates(["blob"]).join(unseen, "blob", "left_semi")
    else:
        fresh = fresh.dropDuplicates(["blob"])

    def make():
        return lambda column: [pa.array([scan_text(t) for t in texts(column)], pa.list_(pa.string()))]

    scanned = append_arrow(fresh, ["text"], make, [("findings", T.ArrayType(T.StringType()), pa.list_(pa.string()))], keep=["blob"])
    own = scanned.select("blob", F.lit(version).alias("version"), "findings")
    if home:
        part = f"{home}/run-{uuid.uuid4().hex}"
        own.write.parquet(part)
        entries = spark.read.schema(LEDGER).parquet(part)
    else:
        entries = cut(own)
    known = entries if ledger is None else entries.unionByName(ledger)
    found = known.where(F.size("findings") > 0).select("blob", "findings")
    out = salted_join(paths, found, "blob", F.col("path"), "left")
    return out.select(F.col("path").alias(path), "blob", F.coalesce("findings", F.array().cast("array<string>")).alias("findings")), entries
