"""Streaming: PDF files as they arrive, and event-time sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.sources import pdf


def stream_relation(spark: SparkSession, path: str, relation: str = "page", passwords: tuple[str, ...] = ()) -> DataFrame:
    """One relation of the PDF files that arrive below a path. Each file's rows depend on that file alone, so there is no state."""
    return pdf.parse(pdf.files(spark, path, stream=True), relation, passwords)


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): sessions that a gap ends, in event time; batch or streaming."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, written once: a rerun with the same checkpoint takes what is new."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
