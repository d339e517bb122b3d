"""What made an output: arguments, row counts, schema, settings and digests of the code, beside the data."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path

import corpusloom
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digest(df: DataFrame) -> DataFrame:
    """``(path, sha256_16)`` of files read as ``binaryFile``: the first 16 hex digits."""
    return df.select("path", F.left(F.sha2("content", 256), F.lit(16)).alias("sha256_16"))


def code_digests() -> dict[str, str]:
    """Digests of the engine's modules; the parts that decide how text is preprocessed are among them."""
    top = Path(corpusloom.__file__).parent
    own = (p for part in ("functions", "operators", "plans", "sources", "streaming") for p in sorted((top / part).glob("*.py")))
    return {str(p.relative_to(top)): hashlib.sha256(p.read_bytes()).hexdigest()[:16] for p in own}


def git_id() -> str | None:
    """The short id of the engine's commit, if it runs from a checkout."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=Path(corpusloom.__file__).parent, capture_output=True, text=True, check=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def manifest(df: DataFrame, args: dict, split: str = "split", markers: Sequence[str] | None = None, shad_after_ga: bool = True) -> dict:
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(split).count().collect()} if split in df.columns else {"all": df.count()}
    keys = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    return {
        "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "git_sha": git_id(), "args": args, "row_counts": counts, "schema": json.loads(df.schema.json()),
        "preprocessing": {"shad_after_ga": shad_after_ga, "boundary_marker_count": None if markers is None else len(set(markers)), "file_hashes": code_digests()},
        "env": {"spark": spark.version, **{k: spark.conf.get(k) for k in keys}},
    }


def contract(own: dict) -> str:
    """The preprocessing contract as Markdown: what a user of the data must do to their own text."""
    how = own["preprocessing"]
    rows = "\n".join(f"- `{k}`: {v}" for k, v in sorted(own["row_counts"].items()))
    files = "\n".join(f"- `{k}` {v}" for k, v in how["file_hashes"].items())
    return (
        "# Preprocessing contract\n\nThe Dzongkha side of these rows had its phrase spaces and shads restored. Text that meets a model trained on them "
        "must be preprocessed by the same functions.\n\n"
        f"- shad after ga: {how['shad_after_ga']}\n- phrase-boundary markers: {how['boundary_marker_count']}\n- commit: {own['git_sha']}\n- arguments: `{json.dumps(own['args'], sort_keys=True)}`\n\n"
        f"Rows by split:\n\n{rows}\n\nDigests of the code:\n\n{files}\n"
    )


def _write(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_manifest(df: DataFrame, path: str, args: dict, **settings) -> dict:
    """The manifest as JSON in the folder ``path``, the contract and the markers in folders beside it, through Spark's writer: any file system will do."""
    own = manifest(df, args, **settings)
    _write(df.sparkSession, json.dumps(own, sort_keys=True, ensure_ascii=False), path)
    _write(df.sparkSession, contract(own), path.rstrip("/") + "-contract")
    if settings.get("markers") is not None:
        _write(df.sparkSession, "\n".join(sorted(set(settings["markers"]))), path.rstrip("/") + "-markers")
    return own
