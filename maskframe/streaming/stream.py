"""Redaction of streams. Detection is a projection of one row, so it needs no state and is the same plan as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskframe.functions.registry import Options
from maskframe.plans.engine import find_spans, redact_spans, span_table


def redact_stream(docs: DataFrame, options: Options | None = None, mode: str = "redacted", text_col: str = "text") -> DataFrame:
    """A streaming frame with redacted text and items; append mode, no watermark."""
    return redact_spans(find_spans(docs, options, text_col=text_col), mode, text_col=text_col)


def windowed_counts(docs: DataFrame, time_col: str, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", options: Options | None = None) -> DataFrame:
    """An addition of ours: spans by time window and category; rows later than ``late`` are left out."""
    spans = span_table(find_spans(docs.withWatermark(time_col, late), options), time_col)
    times = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return spans.groupBy(times, "category").agg(F.count("*").alias("n_spans"))


def write_redacted(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, once, to Parquet; a later call goes on where this one stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
