"""Idempotent daily portfolio ledger on Parquet tables, one row per logical date."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    """A Parquet table with a folder for each logical date.

    An upsert replaces the folders of the dates that it brings and touches no other, so a day costs
    a day; running it again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "dt"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _place(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        p, fs = self._place()
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.select(*self.spark.createDataFrame([], self.schema).columns)

    def upsert(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path)

    def replace(self, day: str, rows: DataFrame) -> None:
        """The rows of one date in place of those there; also none."""
        if rows.isEmpty():
            p, fs = self._place()
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p, f"{self.key}={day}"), True)
        else:
            self.upsert(rows)

    def reset(self) -> None:
        p, fs = self._place()
        fs.delete(p, True)


class Broker:
    """Positions, NAV and orders. NAV of a day uses the weights of the last rebalance before it. Days are ISO dates."""

    def __init__(self, spark: SparkSession, path: str, capital: float = 1e6, cost_bps: float = 10.0):
        self.spark, self.capital, self.cost_bps = spark, capital, cost_bps
        self.positions = Table(spark, f"{path}/positions", "dt date, asset string, w double")
        self.navs = Table(spark, f"{path}/nav", "dt date, nav double")
        self.orders = Table(spark, f"{path}/orders", "dt date, asset string, old_w double, new_w double, cost_bps double")

    def state(self) -> dict:
        """The last book with its date, and the NAV; before any, no book and the capital."""
        book = self.positions.read()
        last = book.agg(F.max("dt").alias("dt")).first().dt
        weights = {r.asset: r.w for r in book.where(F.col("dt") == F.lit(last)).collect() if r.asset is not None} if last else {}  # one book
        return {"date": last, "weights": weights, "nav": self.nav()}

    def nav(self) -> float:
        row = self.navs.read().agg(F.max_by("nav", "dt").alias("nav")).first()
        return self.capital if row.nav is None else row.nav

    def last_nav_date(self):
        return self.navs.read().agg(F.max("dt").alias("dt")).first().dt

    def last_rebalance_date(self):
        """The date of the last book, which also a rebalance without orders leaves."""
        return self.positions.read().agg(F.max("dt").alias("dt")).first().dt

    def reset(self) -> None:
        """Forget everything: positions, NAV and orders."""
        for t in (self.positions, self.navs, self.orders):
            t.reset()

    def weights_before(self, day: str) -> DataFrame:
        p = self.positions.read().where(F.col("dt") < F.lit(day).cast("date"))
        return p.join(p.agg(F.max("dt").alias("dt")), "dt").where("asset is not null").select("asset", "w")

    def nav_before(self, day: str) -> float:
        row = self.navs.read().where(F.col("dt") < F.lit(day).cast("date")).agg(F.max_by("nav", "dt").alias("nav")).first()
        return self.capital if row.nav is None else row.nav

    def nav_date_before(self, day: str):
        return self.navs.read().where(F.col("dt") < F.lit(day).cast("date")).agg(F.max("dt").alias("dt")).first().dt

    def period_returns(self, day: str, prices: DataFrame) -> DataFrame:
        """(asset, ret) from the last NAV before ``day`` to ``day``; ``prices``: (asset, dt, price).

        Where the prices lack that date, or there is no NAV yet, from the last date before ``day``.
        The window depends on nothing written on ``day``, so running it again changes nothing.
        """
        at = F.lit(day).cast("date")
        base = self.nav_date_before(day)
        earlier = prices.where(F.col("dt") < at)
        if base is None or earlier.where(F.col("dt") == F.lit(base)).isEmpty():
            base = earlier.agg(F.max("dt").alias("dt")).first().dt
        old = earlier.where(F.col("dt") == F.lit(base).cast("date")).select("asset", F.col("price").alias("before"))
        new = prices.where(F.col("dt") == at).select("asset", "price")
        return new.join(old, "asset", "left").select("asset", (F.try_divide("price", "before") - 1).alias("ret"))

    def apply_cost(self, day: str, cost: float) -> float:
        """Take a share of the NAV of ``day``, which must be there; never below 0."""
        row = self.navs.read().where(F.col("dt") == F.lit(day).cast("date")).first()
        if row is None:
            raise ValueError("no NAV of that day")
        nav = max(0.0, row.nav * (1 - cost))
        self.navs.upsert(self.spark.createDataFrame([(row.dt, nav)], "dt date, nav double"))
        return nav

    def record_nav(self, day: str, returns: DataFrame) -> float:
        """``returns``: (asset, ret) since the last NAV. A missing return on a held asset fails."""
        row = self.weights_before(day).where("w <> 0").join(returns, "asset", "left").agg(
            F.coalesce(F.sum(F.col("w") * F.col("ret")), F.lit(0.0)).alias("r"), F.count_if(F.col("ret").isNull() | F.isnan("ret")).alias("bad")
        ).first()
        if row.bad:
            raise ValueError("no return for an invested asset")
        nav = max(0.0, self.nav_before(day) * (1 + row.r))
        self.navs.upsert(self.spark.createDataFrame([(day, nav)], "dt string, nav double").withColumn("dt", F.col("dt").cast("date")))
        return nav

    def rebalance(self, day: str, target: DataFrame) -> float:
        """Flat cost on the turnover over old and new assets together; returns the cost as a share.

        A target without assets sells everything: the book of that day is one row without an asset,
        so that the day counts. Running a day again replaces its orders and book, also by none.
        """
        bad = target.agg(F.count_if(F.col("w").isNull() | F.isnan("w")).alias("n"), F.sum("w").alias("s")).first()
        if bad.n or (bad.s or 0) > 1 + 1e-6:
            raise ValueError("weights must be numbers that add up to 1 at most")
        at = F.lit(day).cast("date")
        both = self.weights_before(day).withColumnRenamed("w", "old_w").join(target.select("asset", F.col("w").alias("new_w")), "asset", "full").fillna(0.0)
        orders = both.where("old_w <> new_w").select(at.alias("dt"), "asset", "old_w", "new_w", F.lit(self.cost_bps).alias("cost_bps"))
        cost = (both.agg(F.sum(F.abs(F.col("new_w") - F.col("old_w"))).alias("t")).first().t or 0.0) * self.cost_bps / 1e4
        book = target.select(at.alias("dt"), "asset", "w")
        if book.isEmpty():
            book = self.spark.createDataFrame([(None, 0.0)], "asset string, w double").select(at.alias("dt"), "asset", "w")
        self.orders.replace(day, orders)
        self.positions.upsert(book)
        return cost


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def rebalance_due(last: str | None, ends: list[str]) -> bool:
    return last is None or bool(ends) and max(ends) > last


def record_trial(spark: SparkSession, path: str, experiment: str, params: dict, metrics: dict) -> None:
    row = (config_hash(params), experiment, json.dumps(params, sort_keys=True), json.dumps(metrics, sort_keys=True))
    spark.createDataFrame([row], "config_hash string, experiment string, params string, metrics string").write.mode("append").json(path)


def distinct_trials(log: DataFrame) -> int:
    return log.select("experiment", "params").distinct().count()
