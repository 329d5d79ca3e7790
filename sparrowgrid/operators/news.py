"""Scored headlines: labels, scoring with a model passed in, dedupe, trailing windows by class or ticker."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.panel import cut
from .ledger import Table

log = logging.getLogger(__name__)


def label_score(label: Column) -> Column:
    """1 for positive, -1 for negative, 0 for any other label, null among them."""
    return F.when(F.lower(label) == "positive", 1.0).when(F.lower(label) == "negative", -1.0).otherwise(0.0)


def score(head: DataFrame, model: Callable[[list[str]], list[tuple[str, float]]], batch: int = 32, text: str = "headline") -> DataFrame:
    """``head`` with sentiment: label score times confidence of a model of (label, confidence) pairs.

    The model is called on ``batch`` texts at a time inside the tasks; a batch on which it fails
    is logged and counts 0, a null text is an empty one.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value = {"positive": 1.0, "negative": -1.0}
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    found = [value.get(label.lower(), 0.0) * sure for label, sure in model(some)]
                    if len(found) != len(some):
                        raise ValueError("the model left texts out")
                except Exception:  # whatever a foreign model raises
                    log.exception("a batch of headlines could not be scored")
                    found = [0.0] * len(some)
                out += found
            yield pd.Series(out, dtype=float)

    return head.withColumn("sentiment", F.pandas_udf(run, "double")(F.col(text)))


def fetch(queries: dict[str, str], source: Callable[[str], DataFrame], key: str = "key") -> DataFrame | None:
    """(ts, key, headline, story_id) of a query for each key; a query that fails is logged and left
    out, without any that worked there is none. One headline a timestamp, in the order of keys."""
    parts = []
    for name, query in queries.items():
        try:
            parts.append(source(query).select("ts", F.lit(name).alias(key), "headline", "story_id"))
        except Exception:  # whatever a vendor's client raises
            log.exception("no headlines for %s", name)
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return dedupe(out)


def dedupe(head: DataFrame) -> DataFrame:
    """One headline per timestamp (the smallest story_id), whatever its key."""
    return head.withColumn("_rn", F.row_number().over(W.partitionBy("ts").orderBy("story_id"))).where("_rn = 1").drop("_rn")


def append(store: Table, head: DataFrame) -> None:
    """Add headlines to a store with a folder for each day, which keeps one a timestamp, the smallest
    story_id. Only the days that ``head`` brings are read and written; adding the same again changes nothing.
    """
    new = head.withColumn("dt", F.to_date("ts"))
    days = F.broadcast(new.select("dt").distinct())  # one row a day that comes
    old = store.read().join(days, "dt", "left_semi")
    store.upsert(cut(dedupe(old.unionByName(new))))  # written before the folders that it was read from are replaced


def load(store: Table, start: str, end: str) -> DataFrame:
    """The stored headlines of the days from ``start`` to ``end``; other folders are not read."""
    return store.read().where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("dt")


def _window(head: DataFrame, as_of: str, days: int) -> DataFrame:
    """Headlines of the last ``days`` calendar days up to midnight of ``as_of``, both ends included."""
    end = F.lit(as_of).cast("timestamp")
    return head.where(F.col("ts").between(end - F.expr(f"interval {days - 1} days"), end))


def aggregate(head: DataFrame, as_of: str, window: int = 5, full: int = 50) -> DataFrame:
    """(key, n, score, confidence) of a trailing window; the confidence is that of all headlines together."""
    rows = dedupe(_window(head, as_of, window))
    out = rows.groupBy("key").agg(F.count("*").alias("n"), F.avg("sentiment").alias("score"))
    return out.withColumn("confidence", F.least(F.sum("n").over(W.partitionBy()) / full, F.lit(1.0)))  # one row a key


def by_ticker(head: DataFrame, as_of: str, window: int = 5, full: int = 10) -> DataFrame:
    """(ticker, n, score, confidence) of a trailing window; each ticker's confidence is its own count
    of scores by ``full``."""
    rows = _window(head, as_of, window)
    out = rows.groupBy("ticker").agg(F.count("sentiment").alias("n"), F.avg("sentiment").alias("score"))
    return out.withColumn("confidence", F.least(F.col("n") / full, F.lit(1.0)))


def has_signal(tickers: DataFrame) -> bool:
    """Is there a ticker, and one with any confidence?"""
    return (tickers.agg(F.max("confidence").alias("c")).first().c or 0) > 0
