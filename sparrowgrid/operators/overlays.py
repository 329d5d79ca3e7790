"""Overlays on the weights of a rebalance, as windows over (rebalance_dt, asset, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..sources.panel import cut


def _book() -> WindowSpec:
    return W.partitionBy("rebalance_dt")


def _sums(weights: DataFrame, equity: Column) -> DataFrame:
    own = weights.withColumn("_eq", equity)
    sleeve = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("w"))).over(_book()), F.lit(0.0))
    return own.withColumns({"_have": sleeve(F.col("_eq")), "_other": sleeve(~F.col("_eq")), "_names": F.count_if("_eq").over(_book())})


def renormalised(weights: DataFrame) -> DataFrame:
    """Weights that add up to 1; a book of nothing or less stays."""
    total = F.sum("w").over(_book())
    return weights.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(F.col("w")))


def capped(weights: DataFrame, cap: float) -> DataFrame:
    """No weight above ``cap``, or above an equal share where that is more; adds up to 1 again."""
    return renormalised(weights.withColumn("w", F.least(F.col("w"), F.greatest(F.lit(cap), 1 / F.count("*").over(_book())))))


def equity_floor(weights: DataFrame, equity: Column, floor: float, spare: float = 0.01) -> DataFrame:
    """Lift the equity sleeve to its floor at the cost of the rest; unchanged where the rest cannot
    pay for it and keep ``spare``."""
    s = _sums(weights, equity).withColumn("_short", F.lit(floor) - F.col("_have"))
    stays = (F.col("_short") <= 0) | (F.col("_names") == 0) | (F.col("_other") < F.col("_short") + spare)
    lift = F.when(F.col("_have") > 0, F.col("w") / F.col("_have")).otherwise(1 / F.nullif("_names", F.lit(0)))
    new = F.when(F.col("_eq"), F.col("w") + F.col("_short") * lift).otherwise(F.col("w") * F.try_divide(F.col("_other") - F.col("_short"), "_other"))
    moved = s.withColumn("_new", F.when(stays, F.col("w")).otherwise(new))
    total = F.sum("_new").over(_book())
    return moved.withColumn("w", F.when(stays | (total <= 0), F.col("_new")).otherwise(F.col("_new") / total)).select(*weights.columns)


def regime_band(weights: DataFrame, equity: Column, regimes: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Bring the equity sleeve into the band of the regime of its rebalance.

    ``regimes``: (rebalance_dt, regime). A regime without a band, or none at all, leaves the book
    as it is. The other sleeve takes the rest; if it is empty that is cash.
    """
    rows = regimes.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in bands.items()], "regime string, _low double, _high double")
    band = regimes.join(F.broadcast(rows), "regime").select("rebalance_dt", "_low", "_high")  # one row a rebalance
    s = _sums(weights, equity).join(F.broadcast(band), "rebalance_dt", "left")
    goal = F.least(F.greatest("_have", "_low"), "_high")
    inside = F.when(F.col("_have") > 0, F.col("w") * goal / F.nullif("_have", F.lit(0.0))).otherwise(goal / F.nullif("_names", F.lit(0)))
    outside = F.when(F.col("_other") > 0, F.col("w") * (1 - goal) / F.nullif("_other", F.lit(0.0))).otherwise(0.0)
    moves = F.col("_low").isNotNull() & (F.abs(goal - F.col("_have")) >= 1e-12)
    return s.withColumn("w", F.when(moves, F.when(F.col("_eq"), inside).otherwise(outside)).otherwise(F.col("w"))).select(*weights.columns)


def vol_target(weights: DataFrame, panel: DataFrame, target: float, cap: float, window: int = 63) -> DataFrame:
    """Scale each book by min(target / its volatility, cap): that of its weights over the last
    ``window`` calendar rows before the rebalance, missing returns counting 0."""
    from .engine import history

    dates = weights.select("rebalance_dt", "signal_ix").distinct()
    rows = history(panel, dates, window).join(weights.drop("signal_ix"), ["rebalance_dt", "asset"])
    days = rows.groupBy("rebalance_dt", "day_ix").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("r"))
    sd = days.groupBy("rebalance_dt").agg((F.stddev_samp("r") * 252**0.5).alias("sd"))
    scale = F.when(F.col("sd") > 0, F.least(F.lit(target) / F.nullif("sd", F.lit(0.0)), F.lit(cap))).otherwise(1.0)
    return weights.join(F.broadcast(sd), "rebalance_dt", "left").withColumn("w", F.col("w") * scale).select(*weights.columns)  # one row a rebalance


def no_trade(weights: DataFrame, threshold: float | Column, *by: str) -> DataFrame:
    """Hold the last traded book while the sum of absolute changes over the assets of the new one is
    below ``threshold``, a number or an expression of ``by``; the first book is always traded.

    Which book is traded next after each one depends on these two alone, whatever was traded before:
    the distances of all books of a strategy (``by``) give every book its successor, and the traded
    ones are those reached from the first, by pointers that double. No strategy is one group.
    """
    order = weights.select(*by, "rebalance_dt", "signal_ix").distinct().withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("signal_ix")))  # one row a rebalance
    order = cut(order)
    w = cut(weights.join(order.drop("rebalance_dt"), [*by, "signal_ix"]).select(*by, "k", "asset", "w"))
    total = w.groupBy(*by, "k").agg(F.sum(F.abs("w")).alias("t"))
    old = w.select(*by, "asset", F.col("k").alias("i"), F.col("w").alias("o"))
    shared = old.join(w, [*by, "asset"]).where("i < k").groupBy(*by, "i", "k").agg(F.sum(F.abs(F.col("w") - F.col("o")) - F.abs("w")).alias("c"))
    pairs = order.select(*by, F.col("k").alias("i")).join(total, list(by)).where("i < k").join(shared, [*by, "i", "k"], "left")
    far = pairs.where(F.col("t") + F.coalesce("c", F.lit(0.0)) >= threshold)
    jump = cut(far.groupBy(*by, "i").agg(F.min("k").alias("j")))
    traded = order.where("k = 1").select(*by, F.col("k").alias("i"))
    most = order.agg(F.max("k").alias("k")).first().k or 1
    for _ in range(max(1, most - 1).bit_length()):
        reached = traded.join(jump, [*by, "i"]).select(*by, F.col("j").alias("i"))
        traded = cut(traded.unionByName(reached).distinct())
        jump = cut(jump.join(jump.select(*by, F.col("i").alias("j"), F.col("j").alias("l")), [*by, "j"]).select(*by, "i", F.col("l").alias("j")))
    last = F.max("i").over(W.partitionBy(*by).orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    held = order.join(traded.withColumn("k", F.col("i")), [*by, "k"], "left").withColumn("i", last)  # one row a rebalance
    return held.drop("k").join(w.withColumnRenamed("k", "i"), [*by, "i"]).select(*by, "rebalance_dt", "signal_ix", "asset", "w")


def skipped(weights: DataFrame, *by: str) -> DataFrame:
    """(by..., n, n_skipped): rebalances after the first, and those that change no weight."""
    order = weights.select(*by, "signal_ix").distinct().withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("signal_ix")))  # one row a rebalance
    w = weights.join(F.broadcast(order), [*by, "signal_ix"]).select(*by, "k", "asset", "w")
    old = w.select(*by, (F.col("k") + 1).alias("k"), "asset", F.col("w").alias("o"))
    both = w.join(old, [*by, "k", "asset"], "full").join(F.broadcast(order.select(*by, "k")), [*by, "k"])
    moved = both.where("k > 1").groupBy(*by, "k").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("o", F.lit(0.0)))).alias("t"))
    return moved.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("t") < 1e-12).alias("n_skipped"))


def equity_share(weights: DataFrame, equity: Column) -> DataFrame:
    """One row: the mean weight of the equity sleeve over all rebalances."""
    sleeve = weights.groupBy("rebalance_dt").agg(F.coalesce(F.sum(F.when(equity, F.col("w"))), F.lit(0.0)).alias("s"))
    return sleeve.agg(F.avg("s").alias("equity_share"))
