"""The cross-sectional experiment: a declared search space judged once, from scores to verdict."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..sources.panel import cut, stored
from . import backtest as B
from . import search as S

MONTHS = 12
#: Configurations of the declared space: each family by rank and by z, three seeds, three products.
SPACE = 2 * len(S.MOMENTUM) + 2 * sum(map(len, S.WINDOWS.values())) + 6


def return_matrix(
    panel: DataFrame, baskets: DataFrame, train_end: str, decile: float = 0.1, min_names: int = 20, tc_bps: float = 10.0, beta_obs: int = 60
) -> tuple[DataFrame, DataFrame]:
    """(scores, net returns by config, part and formation) of the point-in-time search space, both
    written; every statistic of the experiment reads these. ``baskets``: (formation, asset).

    The parts, 'train' up to ``train_end`` and 'holdout' after it, are simulated from a fresh start each.
    """
    months = panel.select(F.last_day("dt").alias("formation")).distinct()
    members = cut(baskets.select("formation", "asset").distinct().join(F.broadcast(months), "formation"))  # one row a month
    scores = stored(S.search_space(panel, members.select("formation").distinct(), beta_obs=beta_obs, baskets=members, pick=(decile, min_names)))
    part = F.when(F.col("formation") <= F.lit(train_end).cast("date"), "train").otherwise("holdout")
    split = members.withColumn("part", part)
    sims = B.simulate_monthly(scores, panel, decile, min_names, tc_bps, "config", "part", baskets=split, of_members=True)
    return scores.drop("w"), cut(sims.select("config", "part", "formation", F.col("net").alias("ret")))


def _sharpe() -> Column:
    """Annual Sharpe ratio of monthly returns; 0 where they do not vary."""
    return F.coalesce(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * math.sqrt(MONTHS), F.lit(0.0))


def judge(
    scores: DataFrame, returns: DataFrame, forward: DataFrame, benchmark: DataFrame, trials: int = SPACE, correlated: float = 0.7, partitions: int = 16,
    pbo_most: float = 0.5, dsr_least: float = 0.95,
) -> DataFrame:
    """One row: the configuration that the search window favours, and whether it stands.

    Correlated configurations are pruned in order of their names on the search window; the overfitting
    probability is that of the rest, the best is the rest's largest Sharpe ratio (ties by name), and
    its deflated ratio counts all ``trials``. The holdout must beat ``benchmark`` (dt, ret), by the
    same months, and its mean rank IC must be positive in every year. ``forward``: (formation,
    asset, fwd). A part without months has null figures and fails its check.
    """
    train = returns.where("part = 'train'")
    kept = cut(S.correlation_prune(train.select(F.col("formation").alias("period"), "config", "ret"), correlated))
    pruned = train.join(F.broadcast(kept), "config")  # names of the declared space
    ix = train.select("formation").distinct().withColumn("period_ix", F.row_number().over(W.orderBy("formation")) - 1)  # one row a month
    pruned = cut(pruned.join(F.broadcast(ix), "formation").select("formation", "period_ix", "config", "ret"))
    splits = B.pbo_splits(pruned, partitions)
    pbo = splits.agg(F.count("*").alias("n_splits"), F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"))
    each = pruned.groupBy("config").agg(F.count("ret").alias("n"), _sharpe().alias("sharpe"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"))
    best = cut(M.deflated(each.orderBy(F.desc("sharpe"), "config").limit(1), (trials,), MONTHS))  # one row
    name = F.broadcast(best.select("config"))
    held = returns.where("part = 'holdout'").join(name, "config")
    mix = held.select(F.last_day(F.date_add("formation", 1)).alias("dt")).join(benchmark, "dt")
    later = held.select("formation").distinct()
    own = scores.join(name, "config").join(F.broadcast(later), "formation")  # one row a month
    ic = B.rank_ic(own.withColumn("score", F.round("score", S.DIGITS)), forward)
    by_year = ic.where("ic is not null").groupBy(F.year(F.date_add("formation", 1)).alias("year")).agg(F.avg("ic").alias("ic"))
    rows = [
        kept.agg(F.count("*").alias("n_kept")), pbo, best.select(F.col("config").alias("best"), F.col("sharpe").alias("sharpe_is"), "dsr"),
        held.agg(F.count("*").alias("months"), F.when(F.count("*") > 0, _sharpe()).alias("sharpe_holdout")),
        mix.agg(F.when(F.count("*") > 0, _sharpe()).alias("sharpe_mix")), by_year.agg(F.min("ic").alias("worst_ic")),
    ]
    one = returns.sparkSession.range(1).select(F.lit(trials).cast("long").alias("n_configs"))
    for r in rows:  # single rows
        one = one.join(r, how="left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    one = one.withColumns({
        "pbo_ok": sure(F.col("pbo") < pbo_most), "dsr_ok": sure(F.col("dsr") > dsr_least),
        "holdout_ok": sure(F.col("sharpe_holdout") > F.col("sharpe_mix")) & sure(F.col("worst_ic") > 0),
    })
    return one.withColumn("verdict", F.when(F.col("pbo_ok") & F.col("dsr_ok") & F.col("holdout_ok"), "CANDIDATE").otherwise("KILL"))
