"""Streaming forms of the headline store and of the daily ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ledger import Table


def first_told(stream: DataFrame, late: str = "5 days") -> DataFrame:
    """One headline a timestamp, that of the smallest story_id, as ``news.dedupe`` keeps in batch.

    A timestamp's smallest one so far is its state, whatever the order of arrival; it is given out
    when the watermark, ``late`` behind the newest, has passed it. What comes later still is left out.
    """
    other = [c for c in stream.columns if c != "ts"]
    kept = stream.withWatermark("ts", late).groupBy("ts").agg(F.min_by(F.struct(*other), "story_id").alias("told"))
    return kept.select("ts", "told.*")


def windowed_sentiment(stream: DataFrame, days: int = 5, late: str = "5 days", slide: str = "1 day") -> DataFrame:
    """(start, end, key, n, score): trailing windows that slide by a day, in append mode: a window is
    given out when the watermark has passed its end.

    ``stream``: (ts, key, sentiment, story_id). Headlines of one timestamp count once, see ``first_told``.
    """
    told = first_told(stream, late)
    windows = told.groupBy(F.window("ts", f"{days} days", slide), "key").agg(F.count("*").alias("n"), F.avg("sentiment").alias("score"))
    return windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "key", "n", "score")


def confident(windows: DataFrame, full: int = 50) -> DataFrame:
    """Windows that are read back, with the confidence of all headlines of a window together."""
    total = F.sum("n").over(W.partitionBy("start"))
    return windows.withColumn("confidence", F.least(total / full, F.lit(1.0)))


def upsert_into(stream: DataFrame, table: Table) -> DataStreamWriter:
    """A writer that replaces, batch by batch, the rows of the dates that a batch brings; a batch
    that runs again after a failure changes nothing."""
    return stream.writeStream.outputMode("append").foreachBatch(lambda batch, _: table.upsert(batch))
