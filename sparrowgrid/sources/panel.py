"""Long return panels (dt, asset, ret, day_ix) and the readers around them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


LOCAL_CHECKPOINTS = "/tmp/checkpoints/sparrowgrid"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only in local mode with none set is a folder of our own used; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage like ``cut``, by a compressed table in the shared folder: for wide or very long ones,
    of which a plan reads some columns."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_day_ix(panel: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Number the calendar days, so that row-count windows over a matrix become RANGE windows.

    The calendar has one row per day, whatever the number of assets: its ranking is small.
    """
    cal = (panel if calendar is None else calendar).select("dt").distinct()
    ranked = cal.select("dt", F.row_number().over(W.orderBy("dt")).cast("long").alias("day_ix"))
    return panel.join(ranked, "dt")


def discount_panel(spark: SparkSession, sf_dir: str, asset: str = "brand") -> DataFrame:
    """Bounded daily returns per brand, part type or supplier, from an exact integer sum of discounts."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_discount")
    if asset in ("brand", "type"):
        parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(f"p_{asset}").alias("asset"))
        lines = lines.join(parts, "l_partkey")
    else:
        lines = lines.withColumn("asset", F.col("l_suppkey"))
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("long") - 5)
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("dt"), "asset").agg((cents / (F.count("*") * F.lit(100.0))).alias("ret"))


def prices(panel: DataFrame) -> DataFrame:
    """100 x compounded returns."""
    return panel.withColumn("price", 100 * F.product(1 + F.col("ret")).over(W.partitionBy("asset").orderBy("dt")))


def align_to_calendar(panel: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel on calendar days, extra days of the panel, calendar days that the panel lacks)."""
    days, cal = panel.select("dt").distinct(), calendar.select("dt").distinct()
    grid = panel.select("asset").distinct().crossJoin(F.broadcast(cal))  # days x assets, as asked; one row a day is sent
    return grid.join(panel, ["dt", "asset"], "left"), days.join(cal, "dt", "left_anti"), cal.join(days, "dt", "left_anti")


def null_nan(df: DataFrame, *cols: str) -> DataFrame:
    """NaN becomes null on the way in; Spark's aggregates skip nulls only."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def simple_returns(price: str, key: str = "asset", order: str = "dt") -> Column:
    """p / previous valid p - 1: gaps are padded, as pct_change does."""
    w = W.partitionBy(key).orderBy(order)
    padded = F.last(price, ignorenulls=True)
    return F.try_divide(padded.over(w.rowsBetween(W.unboundedPreceding, 0)), padded.over(w.rowsBetween(W.unboundedPreceding, -1))) - 1


def log_returns(price: str, key: str = "asset", order: str = "dt") -> Column:
    """ln(p / p of the row before): a gap is null on both sides."""
    return F.ln(F.try_divide(F.col(price), F.lag(price).over(W.partitionBy(key).orderBy(order))))


def returns_of(prices: DataFrame, kind: str = "log") -> DataFrame:
    """(asset, dt, ret) from (asset, dt, price); ``kind`` is 'log' or 'simple'. The first row of an
    asset, and rows without a return of their own, are left out; others of the day stay."""
    if kind not in ("log", "simple"):
        raise ValueError("returns are 'log' or 'simple'")
    ret = log_returns("price") if kind == "log" else simple_returns("price")
    return prices.select("asset", "dt", ret.alias("ret")).where("ret is not null")


def filled(df: DataFrame, value: str, key: str = "asset", order: str = "dt") -> DataFrame:
    """The table with gaps of ``value`` filled by the value before."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def bid_ask_spread(quotes: DataFrame) -> DataFrame:
    """(asset, dt, spread): (ask - bid) / mid of (asset, dt, bid, ask); a mid of 0 or a missing side
    takes the spread before."""
    mid = (F.col("ask") + F.col("bid")) / 2
    made = quotes.select("asset", "dt", F.try_divide(F.col("ask") - F.col("bid"), mid).alias("spread"))
    return filled(made, "spread").where("spread is not null")


def percent_returns(raw: DataFrame, start: str, end: str) -> DataFrame:
    """(asset, dt, ret) from returns in percent, within [start, end]; missing ones are left out."""
    inside = F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return raw.where(inside & F.col("ret").isNotNull()).select("asset", "dt", (F.col("ret") / 100).alias("ret"))


def first_of(first: DataFrame, second: DataFrame, *key: str, value: str = "x") -> DataFrame:
    """(key..., value): the first source's value, the second's where the first has none."""
    both = first.select(*key, F.col(value).alias("_a")).join(second.select(*key, F.col(value).alias("_b")), [*key], "full")
    return both.select(*key, F.coalesce("_a", "_b").alias(value)).where(F.col(value).isNotNull())


def funding_series(yields: DataFrame, calendar: DataFrame, spread: float = 0.005, flat: float = 0.02) -> DataFrame:
    """(dt, rate) for each calendar day: the latest yield in percent / 100 + spread; ``flat`` before
    there is one. ``yields``: (dt, x)."""
    days = calendar.select("dt").distinct().withColumn("all", F.lit(1))
    known = as_of(days, yields.where("x is not null").withColumn("all", F.lit(1)), "all", "dt", "x")  # one row a day
    return known.select("dt", F.coalesce(F.col("x") / 100 + spread, F.lit(flat)).alias("rate"))


def ticker(ric: Column, last: bool = False) -> Column:
    """A code without its exchange: up to the first dot, or (``last``) up to the last one that has
    something before it."""
    return F.regexp_replace(ric, r"(?<=.)\.[^.]*$", "") if last else F.substring_index(ric, ".", 1)


def next_month_end(day: Column) -> Column:
    """A month end moves to the next one, any other day to the end of its month."""
    return F.last_day(F.date_add(day, 1))


def resample(panel: DataFrame, freq: str, how: str = "compound") -> DataFrame:
    """Returns per week (ending Sunday), month or quarter end; inner bins without rows are 0."""
    ends = {
        "W": F.date_add(F.date_trunc("week", F.col("dt")).cast("date"), 6),
        "ME": F.last_day("dt"),
        "QE": F.last_day(F.add_months(F.date_trunc("quarter", F.col("dt")).cast("date"), 2)),
    }
    made = F.product(1 + F.col("ret")) - 1 if how == "compound" else F.sum("ret")
    bins = panel.withColumn("end", ends[freq]).groupBy("asset", "end").agg(made.alias("ret"))
    step = {"W": "interval 7 days", "ME": "interval 1 month", "QE": "interval 3 months"}[freq]
    span = panel.agg(F.min(ends[freq]).alias("a"), F.max(ends[freq]).alias("z"))
    grid = span.select(F.explode(F.expr(f"sequence(trunc(a, 'month'), z, interval 1 month)" if freq != "W" else f"sequence(a, z, {step})")).alias("d"))
    grid = grid.select((F.col("d") if freq == "W" else F.last_day("d")).alias("end"))
    if freq == "QE":
        grid = grid.where(F.month("end") % 3 == 0)
    full = panel.select("asset").distinct().crossJoin(F.broadcast(grid))  # one row a period
    return full.join(bins, ["asset", "end"], "left").fillna(0.0, ["ret"])


def add_business_days(day: Column, n: int | Column) -> Column:
    """The n-th weekday after a date (n >= 0); a weekend counts as its Friday."""
    n = F.lit(n)
    at = F.least(F.weekday(day), F.lit(4))
    friday = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    return F.date_add(friday, (n + 2 * F.floor((at + n) / 5)).cast("int"))


def published(series: DataFrame, lag: int | Column, key: str = "series", value: str = "x") -> DataFrame:
    """(key, dt, value) on every weekday: the latest value whose publication, ``lag`` weekdays
    after its date, has come. Values published on one day: that of the latest date."""
    out = series.where(F.col(value).isNotNull()).withColumn("at", add_business_days(F.col("dt"), lag))
    out = out.groupBy(key, "at").agg(F.max_by(value, "dt").alias(value)).withColumnRenamed("at", "dt")
    days = out.groupBy(key).agg(F.explode(F.sequence(F.min("dt"), F.max("dt"))).alias("dt")).where(F.weekday("dt") < 5)
    return as_of(days, out, key, "dt", value)


def splice(first: DataFrame, second: DataFrame) -> DataFrame:
    """(asset, dt, price): ``first``, preceded by ``second`` scaled to meet it on its first date.

    An asset whose ``second`` has no price on that date keeps its own history alone.
    """
    own = first.where("price is not null")
    start = own.groupBy("asset").agg(F.min("dt").alias("start"), F.min_by("price", "dt").alias("level"))
    more = second.where("price is not null").join(start, "asset").where("dt <= start")
    scale = F.max(F.when(F.col("dt") == F.col("start"), F.col("level") / F.col("price"))).over(W.partitionBy("asset"))
    more = more.withColumn("price", F.col("price") * scale).where("price is not null and dt < start")
    return own.select("asset", "dt", "price").unionByName(more.select("asset", "dt", "price"))


def rolling_adv(volume: DataFrame, calendar: DataFrame, window: int = 20, least: int = 5) -> DataFrame:
    """(asset, dt, day_ix, adv) on all calendar days: mean of the last ``window`` rows with
    ``least`` values or more, carried forward. ``volume``: (asset, dt, volume)."""
    grid = volume.select("asset").distinct().crossJoin(F.broadcast(calendar.select("dt", "day_ix").distinct()))  # days x assets, as asked; one row a day is sent
    w = W.partitionBy("asset").orderBy("day_ix")
    last = w.rangeBetween(1 - window, 0)
    mean = grid.join(volume, ["asset", "dt"], "left").withColumn("adv", F.when(F.count("volume").over(last) >= least, F.avg("volume").over(last)))
    return mean.select("asset", "dt", "day_ix", F.last("adv", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("adv"))


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, value: str, strict: bool = False) -> DataFrame:
    """Latest ``value`` of ``right`` at or (strict) before each row of ``left``: union and running last()."""
    rows = left.withColumn("_value", F.lit(None)).withColumn("_side", F.lit(0 if strict else 1))
    more = right.select(key, order, F.col(value).alias("_value")).withColumn("_side", F.lit(1 if strict else 0))
    both = rows.unionByName(more, allowMissingColumns=True).withColumn("_left", F.col("_side") == (0 if strict else 1))
    w = W.partitionBy(key).orderBy(order, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_left").drop("_value", "_side", "_left")
