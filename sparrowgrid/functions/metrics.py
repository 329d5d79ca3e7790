"""Risk and performance metrics as aggregate expressions over a return column."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PPY = 252
INF = float("inf")
EULER = 0.5772156649


def sharpe(ret: str = "ret", ppy: int = PPY) -> Column:
    """Mean over standard deviation, annualised; 0 for constant returns, null below 2."""
    sd = F.stddev_samp(ret)
    return F.when(sd == 0, 0.0).otherwise(F.avg(ret) / F.nullif(sd, F.lit(0.0)) * math.sqrt(ppy))


def sortino(ret: str = "ret", ppy: int = PPY) -> Column:
    """Mean over the deviation of negative returns; infinite without any, null with one."""
    low = F.when(F.col(ret) < 0, F.col(ret))
    sd = F.stddev_samp(low)
    return F.when(F.count(low) == 0, INF).when(sd == 0, INF).otherwise(F.avg(ret) / F.nullif(sd, F.lit(0.0)) * math.sqrt(ppy))


def annualized_return(ret: str = "ret", ppy: int = PPY) -> Column:
    return F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.pow(F.product(1 + F.col(ret)), ppy / F.count(F.lit(1))) - 1)


def with_drawdown(panel: DataFrame, key: str = "asset", order: str = "dt", ret: str = "ret") -> DataFrame:
    """nav and drawdown (positive); the peak starts after the first return."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    nav = panel.withColumn("nav", F.product(1 + F.col(ret)).over(w))
    peak = F.max("nav").over(w)
    return nav.withColumn("drawdown", (peak - F.col("nav")) / peak)


def summary(panel: DataFrame, key: str = "asset", ppy: int = PPY) -> DataFrame:
    """One row per series: one shuffle for the drawdown window, reused by the aggregation."""
    out = with_drawdown(panel, key).groupBy(key).agg(
        F.count("ret").alias("n"), sharpe(ppy=ppy).alias("sharpe"), sortino(ppy=ppy).alias("sortino"),
        F.max("drawdown").alias("max_drawdown"), annualized_return(ppy=ppy).alias("annualized_return"),
        (F.avg("ret") * ppy).alias("mean_annual"), (F.stddev_samp("ret") * math.sqrt(ppy)).alias("volatility"),
        F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") == 0, INF).otherwise(F.col("annualized_return") / F.nullif("max_drawdown", F.lit(0.0))))


def tail_risk(panel: DataFrame, key: str = "asset", confidence: float = 0.95) -> DataFrame:
    """(key, var, cvar): the 'lower' quantile of returns, negated and floored at 0, and the mean beyond it."""
    w = W.partitionBy(key)
    at = F.floor((F.count("ret").over(w) - 1) * (1 - confidence)) + 1
    ranked = panel.where("ret is not null").withColumns({"_rn": F.row_number().over(w.orderBy("ret")), "_at": at})
    low = ranked.withColumn("var", F.greatest(F.lit(0.0), -F.max(F.when(F.col("_rn") == F.col("_at"), F.col("ret"))).over(w)))
    out = low.groupBy(key).agg(F.first("var").alias("var"), F.avg(F.when(F.col("ret") <= -F.col("var"), F.col("ret"))).alias("tail"))
    return out.select(key, "var", F.greatest("var", F.coalesce(-F.col("tail"), F.col("var"))).alias("cvar"))


def expected_max_sharpe(trials: int, observations: int) -> float:
    if trials <= 1:
        return 0.0
    z = NormalDist().inv_cdf
    return ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e))) / math.sqrt(observations)


def deflated_sharpe(sharpe_annual: float, observations: int, trials: int, skew: float, kurtosis: float, ppy: int = PPY) -> float:
    """Probability that the Sharpe ratio beats the best of ``trials`` lucky ones (total kurtosis)."""
    sr = sharpe_annual / math.sqrt(ppy)
    spread = math.sqrt(max(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr, 1e-12))
    return NormalDist().cdf((sr - expected_max_sharpe(trials, observations)) * math.sqrt(observations - 1) / spread)


def deflated(summary: DataFrame, trials: tuple[int, ...], ppy: int = PPY) -> DataFrame:
    """The rows of ``summary`` for each number of trials, with dsr: sensitivity of the deflated Sharpe
    ratio to how much was tried. A row a series and number: the distribution is a vectorised UDF."""
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("trials"), F.lit(expected_max_sharpe(t, 1)).alias("luck")) for t in trials]))
    rows = summary.withColumn("_t", grid).select("*", "_t.trials", "_t.luck").drop("_t")
    sr = F.col("sharpe") / math.sqrt(ppy)
    # the summary's skewness is biased, its kurtosis total
    spread = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr, F.lit(1e-12)))
    z = (sr - F.col("luck") / F.sqrt("n")) * F.sqrt(F.col("n") - 1) / spread

    @F.pandas_udf("double")
    def cdf(z: pd.Series) -> pd.Series:
        return z.map(NormalDist().cdf, na_action="ignore")

    return rows.withColumn("dsr", cdf(z)).drop("luck")


def sample_covariance(panel: DataFrame) -> DataFrame:
    """(a, b, cov) for a <= b; a pair of which a day of the panel lacks a return has none."""
    days = panel.agg(F.count_distinct("dt").alias("_days"))
    x = panel.select("dt", F.col("asset").alias("a"), F.col("ret").alias("x"))
    y = panel.select("dt", F.col("asset").alias("b"), F.col("ret").alias("y"))
    pairs = x.join(y, "dt").where("a <= b").groupBy("a", "b").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"), F.covar_samp("x", "y").alias("c"))
    return pairs.crossJoin(F.broadcast(days)).select("a", "b", F.when(F.col("n") == F.col("_days"), F.col("c")).alias("cov"))  # one row


def rolling_covariance(panel: DataFrame, window: int = 60, least: int = 2, block: int = 64, tile: int = 64) -> DataFrame:
    """(dt, a, b, cov) for a <= b: pairwise-complete covariances over the last ``window`` calendar rows, for
    each calendar day from row ``window`` on; null with fewer than ``least`` common rows.

    ``panel``: (asset, dt, day_ix, ret). Assets are dealt to tiles by hash, days to blocks, and a task
    has two tiles over one block and the rows before it, as a matrix whose running sums of products
    give all pairs and days. What is shuffled is a row of the panel for each tile and some, not for
    each pair.
    """
    days = sorted((r.day_ix, r.dt) for r in panel.select("day_ix", "dt").distinct().collect())  # one row a day
    names = panel.select("asset").distinct().withColumn("h", F.abs(F.xxhash64("asset") % (1 << 40)))
    n = names.count()
    tiles = max(1, -(-n // tile))
    names = names.select("asset", (F.col("h") % tiles).cast("int").alias("t"))
    at = F.floor(F.col("day_ix") / block)
    rows = panel.select("asset", "day_ix", F.col("ret").cast("double").alias("ret")).withColumn("t", (F.abs(F.xxhash64("asset") % (1 << 40)) % tiles).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(at, F.floor((F.col("day_ix") + window - 1) / block))))
    last = days[-1][0] // block if days else -1
    # every asset stands in every block, with no day, so that pairs without returns have their rows
    every = names.select("asset", F.lit(None).cast("long").alias("day_ix"), F.lit(None).cast("double").alias("ret"), "t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(last, 0)).cast("long"))).alias("block"))
    both = rows.where(F.col("block") <= last).unionByName(every).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    both = both.withColumns({"i": F.least("t", "o"), "j": F.greatest("t", "o")})
    calendar = panel.sparkSession.sparkContext.broadcast(days)  # one row a day

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(pdf["block"].iloc[0]) * block
        own = [(ix, dt) for ix, dt in calendar.value if lo <= ix < lo + block and ix >= window]
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = (sorted(pdf.loc[pdf["t"] == k, "asset"].unique()) for k in (i, j))
        if not own or not left or not right:
            return pd.DataFrame({c: pd.Series([], dtype=object if c != "cov" else float) for c in ("dt", "a", "b", "cov")})
        there = pdf[pdf["day_ix"].notna() & pdf["ret"].notna()]
        x = np.full((block + window, len(left)), np.nan)
        y = np.full((block + window, len(right)), np.nan)
        for m, side, k in ((x, left, i), (y, right, j)):
            mine = there[there["t"] == k]
            m[(mine["day_ix"] - lo + window).astype(int), pd.Index(side).get_indexer(mine["asset"])] = mine["ret"]
        u, v = ~np.isnan(x), ~np.isnan(y)
        x, y = np.where(u, x, 0.0), np.where(v, y, 0.0)
        ends = np.array([ix - lo + window for ix, _ in own])
        made = lambda p, q: np.cumsum(p[:, :, None] * q[:, None, :], axis=0)
        within = lambda c: c[ends] - c[ends - window]  # noqa: E731  row 0 is before every window
        count = within(made(u.astype(float), v.astype(float)))
        sx, sy, sxy = within(made(x, v)), within(made(u, y)), within(made(x, y))
        with np.errstate(all="ignore"):
            cov = np.where(count >= max(least, 2), (sxy - sx * sy / count) / (count - 1), np.nan)
        a, b = np.meshgrid(np.array(left, object), np.array(right, object), indexing="ij")
        keep = (a <= b) if i == j else np.ones(a.shape, bool)
        a, b = a[keep], b[keep]
        low, high = np.where(a <= b, a, b), np.where(a <= b, b, a)
        k = len(low)
        return pd.DataFrame({"dt": np.repeat(np.array([dt for _, dt in own], object), k), "a": np.tile(low, len(own)), "b": np.tile(high, len(own)), "cov": cov[:, keep].ravel()})

    kind = dict(panel.dtypes)["asset"]
    out = both.groupBy("block", "i", "j").applyInPandas(run, f"dt date, a {kind}, b {kind}, cov double")
    return out.withColumn("cov", F.when(~F.isnan("cov"), F.col("cov")))


def tearsheet(panel: DataFrame, key: str = "asset", least: int = 20, ppy: int = PPY) -> DataFrame:
    """Nine metrics a series; series of fewer than ``least`` rows are left out. The tail is the signed
    linear 5 % quantile and the mean of what lies at or below it."""
    low = panel.groupBy(key).agg(F.percentile("ret", F.lit(0.05)).alias("var_95"))
    sd = F.nullif(F.stddev_samp("ret"), F.lit(0.0))
    down = F.nullif(F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))), F.lit(0.0))
    out = with_drawdown(panel, key).join(low, key).groupBy(key).agg(
        F.count("ret").alias("n"), annualized_return(ppy=ppy).alias("cagr"), (F.stddev_samp("ret") * math.sqrt(ppy)).alias("volatility"),
        (F.avg("ret") / sd * math.sqrt(ppy)).alias("sharpe"), (F.avg("ret") / down * math.sqrt(ppy)).alias("sortino"), F.max("drawdown").alias("max_drawdown"),
        (F.count_if(F.col("ret") > 0) / F.count("*")).alias("hit_rate"), F.first("var_95").alias("var_95"),
        F.avg(F.when(F.col("ret") <= F.col("var_95"), F.col("ret"))).alias("cvar_95"),
    )
    return out.where(F.col("n") >= least).withColumn("calmar", F.col("cagr") / F.nullif("max_drawdown", F.lit(0.0)))


def verdict(panel: DataFrame, key: str = "asset", sharpe_least: float = 0.5, drawdown_most: float = 0.25, days: int = 252, capital: float = 10_000.0) -> DataFrame:
    """Sharpe ratio, drawdown and final value of each series, and whether it passes the checks."""
    out = with_drawdown(panel, key).groupBy(key).agg(
        sharpe().alias("sharpe"), F.max("drawdown").alias("max_drawdown"), (F.product(1 + F.col("ret")) * capital).alias("final_value"), F.count("ret").alias("n")
    )
    checks = {"sharpe_ok": F.col("sharpe") > sharpe_least, "drawdown_ok": F.col("max_drawdown") < drawdown_most, "history_ok": F.col("n") >= days}
    return out.withColumns(checks).withColumn("passed", F.col("sharpe_ok") & F.col("drawdown_ok") & F.col("history_ok"))
