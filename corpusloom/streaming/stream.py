"""The row-wise operators over streams: they are stateless, so a stream's plan is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import filters


def stream_sentences(docs: DataFrame, text: str, event_time: str, late: str = "1 hour", **split) -> DataFrame:
    """Sentences of arriving documents, each once within the watermark."""
    own = filters.sentences(docs.withWatermark(event_time, late), text, **split)
    return own.dropDuplicatesWithinWatermark(["sentence"])


def stream_rejects(docs: DataFrame, rules, event_time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Reject reasons by window of event time."""
    own = filters.waterfall(docs.withWatermark(event_time, late), rules)
    return own.groupBy(F.window(event_time, window), F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count("*").alias("n"))
