"""Walk-forward engine and costs: rebalances in parallel, then as-of weights and one aggregation."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import sharpe
from ..sources.panel import as_of
from . import kernels as K


log = logging.getLogger(__name__)
#: Calendar rows of a bucket of windows; see ``history``.
_BUCKET = 64
_PERIODS = {"D": lambda d: d, "W": lambda d: F.date_trunc("week", d).cast("date"), "ME": F.last_day, "QE": lambda d: F.date_trunc("quarter", d).cast("date")}


def rebalance_dates(panel: DataFrame, freq: str = "ME") -> DataFrame:
    """(rebalance_dt, signal_ix): the last trading day of each day, week, month or quarter."""
    days = panel.select("dt", "day_ix").distinct()
    return days.groupBy(_PERIODS[freq](F.col("dt")).alias("m")).agg(F.max("dt").alias("rebalance_dt"), F.max("day_ix").alias("signal_ix")).drop("m")


def fit_dates(panel: DataFrame) -> DataFrame:
    """(rebalance_dt, fit_dt): the trading day before the last one of each month, on which its regime is fitted."""
    days = panel.select("dt").distinct().withColumn("before", F.lag("dt").over(W.orderBy("dt")))  # one row a day
    return days.groupBy(F.last_day("dt").alias("m")).agg(F.max("dt").alias("rebalance_dt"), F.max_by("before", "dt").alias("fit_dt")).drop("m").where("fit_dt is not null")


def history(panel: DataFrame, dates: DataFrame, lookback: int) -> DataFrame:
    """Rows strictly before each rebalance, ``lookback`` calendar rows of them.

    Each window is cut into buckets of calendar rows, so that rows and windows meet by an
    equality; what is copied is what a kernel must see. Sums over windows need no copy: see
    ``windowed``.
    """
    bucket = lambda ix: F.floor(ix / _BUCKET)
    spans = dates.withColumn("bucket", F.explode(F.sequence(bucket(F.col("signal_ix") - lookback), bucket(F.col("signal_ix") - 1))))
    d = F.broadcast(spans)  # lookback / _BUCKET rows a rebalance
    inside = (F.col("day_ix") < F.col("signal_ix")) & (F.col("day_ix") >= F.col("signal_ix") - lookback)
    return panel.withColumn("bucket", bucket(F.col("day_ix"))).join(d, "bucket").where(inside).drop("bucket")


def windowed(panel: DataFrame, dates: DataFrame, lookback: int, **made: Column) -> DataFrame:
    """(columns of ``dates``, asset, made...): aggregates over the ``lookback`` calendar rows before each date.

    ``dates`` has signal_ix; an aggregate may use ``back``, how many calendar rows before it a row
    lies (from 1). Rows meet their windows where they are read and are summed there, so what is
    shuffled is a row an asset, date and task. Assets without a row in a window have none here.
    """
    rows = history(panel.select("asset", "day_ix", "ret"), dates, lookback).withColumn("back", F.col("signal_ix") - F.col("day_ix"))
    return rows.groupBy(*dates.columns, "asset").agg(*[c.alias(n) for n, c in made.items()])


def inverse_volatility(panel: DataFrame, dates: DataFrame, lookback: int = 252, min_obs: int = 60) -> DataFrame:
    """(rebalance_dt, signal_ix, asset, w): weights in proportion to 1 / standard deviation, pure SQL."""
    return inverse_volatility_grid(panel, dates, (lookback,), min_obs).drop("lookback")


def inverse_volatility_grid(panel: DataFrame, dates: DataFrame, lookbacks: tuple[int, ...], min_obs: int = 60) -> DataFrame:
    """(lookback, rebalance_dt, signal_ix, asset, w): all lookbacks from one pass."""
    inside = lambda x: F.when(F.col("back") <= x, F.col("ret"))
    made = {f"_{what}{x}": f(inside(x)) for x in lookbacks for what, f in (("sd", F.stddev_samp), ("n", F.count))}
    wide = windowed(panel, dates, max(lookbacks), **made)
    each = F.array(*[F.struct(F.lit(x).alias("lookback"), F.col(f"_sd{x}").alias("sd"), F.col(f"_n{x}").alias("n")) for x in lookbacks])
    long = wide.select("rebalance_dt", "signal_ix", "asset", F.inline(each))
    inv = long.where((F.col("n") >= min_obs) & (F.col("sd") > 0)).withColumn("v", 1 / F.col("sd"))
    share = F.col("v") / F.sum("v").over(W.partitionBy("lookback", "rebalance_dt"))
    return inv.select("lookback", "rebalance_dt", "signal_ix", "asset", share.alias("w"))


def equal_weights(panel: DataFrame, dates: DataFrame, lookback: int = 252) -> DataFrame:
    """Equal weights of the assets that have a return in the window."""
    a = windowed(panel, dates, lookback, _n=F.count("ret")).where("_n > 0").drop("_n")
    return a.withColumn("w", 1 / F.count("*").over(W.partitionBy("rebalance_dt")))


def fixed_weights(dates: DataFrame, weights: dict) -> DataFrame:
    """(rebalance_dt, signal_ix, asset, w): the same weights at each rebalance."""
    each = F.array(*[F.struct(F.lit(a).alias("asset"), F.lit(float(w)).alias("w")) for a, w in weights.items()])
    return dates.select("rebalance_dt", "signal_ix", F.inline(each))


def optimize(panel: DataFrame, dates: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], lookback: int = 756, min_hist: int = 252, failed=None) -> DataFrame:
    """Weights of a numpy kernel over the complete rows of each window; a grouped map per rebalance.

    A group is one window of one universe: lookback x assets numbers, whatever the history.
    Assets with fewer than ``min_hist`` returns are left out, then rows that lack one. Fewer than
    ``min_hist`` complete rows, or fewer than two assets: equal weights. A kernel that fails gives
    equal weights too, is logged, and counted in ``failed``, an accumulator, if there is one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="day_ix", columns="asset", values="ret")
        held = wide.columns[wide.notna().sum() >= min_hist]
        clean = wide[held].dropna()
        names = held if len(held) else wide.columns
        w = np.full(len(names), 1 / len(names))
        if len(clean) >= min_hist and len(held) >= 2:
            try:
                w = kernel(clean.to_numpy())
            except (ValueError, np.linalg.LinAlgError):
                log.exception("kernel failed at %s: equal weights", pdf["rebalance_dt"].iloc[0])
                if failed is not None:
                    failed.add(1)
        return pd.DataFrame({"rebalance_dt": pdf["rebalance_dt"].iloc[0], "signal_ix": pdf["signal_ix"].iloc[0], "asset": names, "w": w})

    rows = history(panel, dates, lookback).select("rebalance_dt", "signal_ix", "asset", "day_ix", "ret")
    kind = dict(panel.dtypes)["asset"]
    return rows.groupBy("rebalance_dt").applyInPandas(run, f"rebalance_dt date, signal_ix long, asset {kind}, w double")


def trend_grid(panel: DataFrame, dates: DataFrame, damps: tuple[float, ...], tilts: tuple[float, ...], cap: float = 0.3, lookback: int = 756, min_hist: int = 252) -> DataFrame:
    """(damp, tilt, rebalance_dt, signal_ix, asset, w): the trend and momentum book for each pair of
    settings. Risk parity is worked out once a window; what the settings change is cheap."""
    cells = [(d, t) for d in damps for t in tilts]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="day_ix", columns="asset", values="ret")
        clean = wide[wide.columns[wide.notna().sum() >= min_hist]].dropna()
        ok = len(clean) >= min_hist and clean.shape[1] >= 2
        names = clean.columns if clean.shape[1] else wide.columns
        x = clean.to_numpy()
        base = hrp_kernel(x) if ok else np.full(len(names), 1 / len(names))
        out = []
        for damp, tilt in cells:
            w = K.momentum_tilt(x, K.trend_filter(x, base, damp), tilt) if ok else base
            w = np.minimum(w, max(cap, 1 / len(w)))
            out.append(pd.DataFrame({"damp": damp, "tilt": tilt, "rebalance_dt": pdf["rebalance_dt"].iloc[0], "signal_ix": pdf["signal_ix"].iloc[0], "asset": names, "w": w / w.sum()}))
        return pd.concat(out)

    rows = history(panel, dates, lookback).select("rebalance_dt", "signal_ix", "asset", "day_ix", "ret")
    kind = dict(panel.dtypes)["asset"]
    return rows.groupBy("rebalance_dt").applyInPandas(run, f"damp double, tilt double, rebalance_dt date, signal_ix long, asset {kind}, w double")


def hrp_kernel(x: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity; a book that ends in one asset becomes equal weights."""
    w = K.hrp(K.ledoit_wolf(x)[0])
    return np.full(len(w), 1 / len(w)) if len(w) > 1 and w.max() > 1 - 1e-6 else w


def trend_momentum_kernel(damp: float = 0.25, tilt: float = 0.5, cap: float = 0.2, floor: float = 0.0, equity: tuple[int, ...] = ()) -> Callable[[np.ndarray], np.ndarray]:
    """Risk parity, equity floor, trend filter, momentum tilt, cap. ``equity``: columns of the sleeve."""

    def run(x: np.ndarray) -> np.ndarray:
        w = hrp_kernel(x)
        if floor > 0 and equity:
            w = K.sleeve_floor(w, np.isin(np.arange(len(w)), equity), floor)
        w = K.momentum_tilt(x, K.trend_filter(x, w, damp), tilt)
        w = np.minimum(w, max(cap, 1 / len(w)))
        return w / w.sum()

    return run


def check_leverage(weights: DataFrame, most: float) -> DataFrame:
    """The weights; a sum of positive weights above ``most`` fails the job."""
    total = F.sum(F.greatest("w", F.lit(0.0))).over(W.partitionBy("rebalance_dt"))
    return weights.withColumn("w", F.when(total > most + 1e-9, F.raise_error(F.lit("leverage"))).otherwise(F.col("w")))


def executions(signals: DataFrame, lag: int, *by: str) -> DataFrame:
    """(by..., k, signal_ix, from_ix, to_ix): the signals that are executed, numbered, and the rows they hold for.

    A signal that comes while another waits takes its place, and the day of execution stays. The
    fold runs over the sorted list of rebalance days, a number per rebalance.
    """
    one = lambda at, s: F.array(F.struct(at.cast("long").alias("from_ix"), s.cast("long").alias("signal_ix")))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        waits = F.coalesce(s < last["from_ix"], F.lit(False))
        return F.when(waits, F.concat(F.slice(done, 1, F.size(done) - 1), one(last["from_ix"], s))).otherwise(F.concat(done, one(s + lag, s)))

    days = signals.groupBy(*by).agg(F.array_sort(F.collect_set("signal_ix")).alias("days"))
    empty = F.lit(None).cast("long")
    chain = F.aggregate("days", F.filter(one(empty, empty), lambda _: F.lit(False)), step)
    w = W.partitionBy(*by).orderBy("from_ix")  # one row a rebalance
    return days.select(*by, F.inline(chain)).withColumns({"k": F.row_number().over(w), "to_ix": F.coalesce(F.lead("from_ix").over(w), F.lit(1 << 60))})


def _executed(weights: DataFrame, lag: int, *by: str) -> tuple[DataFrame, DataFrame]:
    """The executions, and the weights (k, from_ix, by..., asset, w) of each."""
    spans = executions(weights.select("signal_ix", *by).distinct(), lag, *by)
    w = weights.join(F.broadcast(spans), ["signal_ix", *by]).select("k", "from_ix", *by, "asset", "w")  # one row a rebalance and configuration
    return spans, w


def _trades(w: DataFrame, *by: str) -> DataFrame:
    """(k, from_ix, by..., asset, dw): absolute changes over the assets of each target but the first."""
    old = w.select((F.col("k") + 1).alias("k"), *by, "asset", F.col("w").alias("o"))
    new = w.where("k > 1").join(old, ["k", *by, "asset"], "left")
    return new.select("k", "from_ix", *by, "asset", F.abs(F.col("w") - F.coalesce("o", F.lit(0.0))).alias("dw"))


def _gross(panel: DataFrame, spans: DataFrame, w: DataFrame, funding: float | DataFrame, *by: str) -> DataFrame:
    """(dt, day_ix, k, from_ix, by..., gross): return before costs of each day with weights. What
    exceeds the capital is borrowed at ``funding``, a rate or a table (dt, rate)."""
    days = panel.select("dt", "day_ix").distinct()
    if isinstance(funding, DataFrame):
        days = days.join(funding.select("dt", "rate"), "dt", "left").fillna(0.0, ["rate"])
    else:
        days = days.withColumn("rate", F.lit(float(funding)))
    last = days.agg(F.max("day_ix").alias("last"))
    ends = spans.drop("signal_ix").crossJoin(F.broadcast(last)).where("from_ix <= last")  # one row
    live = ends.select("k", "from_ix", *by, F.explode(F.sequence("from_ix", F.least(F.col("to_ix") - 1, "last"))).alias("day_ix")).join(F.broadcast(days), "day_ix")
    held = live.join(w.drop("from_ix"), ["k", *by]).join(panel.select("dt", "asset", "ret"), ["dt", "asset"], "left")
    made = F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))) - F.greatest(F.sum("w") - 1, F.lit(0.0)) * F.first("rate") / 252
    return held.groupBy("dt", "day_ix", "k", "from_ix", *by).agg(made.alias("gross"))


def run(panel: DataFrame, weights: DataFrame, lag: int = 1, tc_bps: float = 10.0, funding: float = 0.0, *by: str) -> DataFrame:
    """(by..., dt, ret, cost) per day: weights of a signal on row t earn from row t + lag, held constant.

    The first purchase is free, later trades pay on the sum of absolute changes over the assets of
    the new target. Missing returns count 0; days before the first execution return 0. Signals that
    overtake each other are resolved by ``executions``. ``by`` adds dimensions, such as the
    configurations of a grid, which run in the same plan.
    """
    spans, w = _executed(weights, lag, *by)
    cost = _trades(w, *by).groupBy(F.col("from_ix").alias("day_ix"), *by).agg((F.sum("dw") * tc_bps / 1e4).alias("cost"))
    days = panel.select("dt", "day_ix").distinct()
    if by:
        days = days.crossJoin(F.broadcast(weights.select(*by).distinct()))  # one row a configuration
    paid = _gross(panel, spans, w, funding, *by).select("day_ix", *by, "gross")
    out = days.join(paid, ["day_ix", *by], "left").join(cost, ["day_ix", *by], "left").fillna(0.0, ["gross", "cost"])
    return out.select(*by, "dt", (F.col("gross") - F.col("cost")).alias("ret"), "cost")


def run_with_impact(
    panel: DataFrame, weights: DataFrame, liquidity: DataFrame, lag: int = 1, capital: float = 1e6, tc_bps: float = 10.0,
    funding: float = 0.0, eta: float = 0.1, gamma: float = 0.1, vol_window: int = 63,
) -> DataFrame:
    """(dt, ret, cost) per day, like ``run``, with Almgren-Chriss costs on the running NAV.

    ``liquidity``: (asset, day_ix, adv, spread); the latest row at the execution counts, and
    before there is any, trades pay ``tc_bps``. What a rebalance costs is a + b * nav + c * nav^2
    of the NAV, with three sums over its trades, and the NAV grows by a product of daily returns
    in between. So what must be folded in order is four numbers a rebalance, in one expression.
    """
    spans, w = _executed(weights, lag)
    trades = _trades(w).withColumnRenamed("from_ix", "day_ix")
    for name in ("adv", "spread"):
        trades = as_of(trades, liquidity.where(F.col(name).isNotNull()), "asset", "day_ix", name)
    vol = windowed(panel, spans.select(F.col("from_ix").alias("signal_ix"), "k"), vol_window, vol=F.stddev_samp("ret")).drop("signal_ix")
    known = liquidity.agg(F.greatest(F.min(F.when(F.col("adv").isNotNull(), F.col("day_ix"))), F.min(F.when(F.col("spread").isNotNull(), F.col("day_ix")))).alias("known"))
    trades = trades.join(vol, ["k", "asset"], "left").crossJoin(F.broadcast(known))  # one row
    dw, adv = F.col("dw"), F.greatest(F.coalesce("adv", F.lit(1.0)), F.lit(1.0))
    v = F.greatest(F.coalesce("vol", F.lit(0.01)), F.lit(1e-6))
    priced = F.coalesce(F.col("day_ix") >= F.col("known"), F.lit(False))
    flat = dw * F.greatest(F.coalesce("spread", F.lit(0.001)), F.lit(0.0)) / 2
    terms = trades.groupBy("k").agg(
        F.sum(F.when(priced, flat).otherwise(dw * tc_bps / 1e4)).alias("a"),
        F.sum(F.when(priced, eta * v * dw * dw / adv).otherwise(0.0)).alias("b"),
        F.sum(F.when(priced, gamma * v * dw * dw * dw / (adv * adv)).otherwise(0.0)).alias("c"),
    )
    gross = _gross(panel, spans, w, funding)
    spell = gross.groupBy("k", "from_ix").agg(
        F.max(F.when(F.col("day_ix") == F.col("from_ix"), F.col("gross"))).alias("first"),
        F.coalesce(F.product(F.when(F.col("day_ix") > F.col("from_ix"), 1 + F.col("gross"))), F.lit(1.0)).alias("rest"),
    )
    rows = spell.join(terms, "k", "left").fillna(0.0, ["a", "b", "c"])

    def step(done: Column, r: Column) -> Column:
        nav = done["nav"]
        cost = r["a"] + r["b"] * nav + r["c"] * nav * nav
        paid = F.array(F.struct(r["from_ix"].alias("day_ix"), cost.alias("cost")))
        return F.struct((nav * (1 + r["first"] - cost) * r["rest"]).alias("nav"), F.concat(done["out"], paid).alias("out"))

    start = F.struct(F.lit(float(capital)).alias("nav"), F.array().cast("array<struct<day_ix:bigint,cost:double>>").alias("out"))
    line = rows.agg(F.array_sort(F.collect_list(F.struct("k", "from_ix", "a", "b", "c", "first", "rest"))).alias("rows"))  # one row a rebalance
    costs = line.select(F.inline(F.aggregate("rows", start, step, lambda done: done["out"])))
    days = panel.select("dt", "day_ix").distinct()
    out = days.join(gross.select("day_ix", "gross"), "day_ix", "left").join(F.broadcast(costs), "day_ix", "left").fillna(0.0, ["gross", "cost"])
    return out.select("dt", (F.col("gross") - F.col("cost")).alias("ret"), "cost")


def grid_scores(returns: DataFrame, *by: str, windows: int = 4, least: int = 20) -> DataFrame:
    """(by..., sharpe, stable): whole-span Sharpe ratio of each configuration, and in how many of
    ``windows`` equal stretches of more than ``least`` days it is positive."""
    n = F.count("*").over(W.partitionBy(*by))
    part = F.floor((F.row_number().over(W.partitionBy(*by).orderBy("dt")) - 1) * windows / n)
    cut = returns.withColumn("part", part)
    good = cut.groupBy(*by, "part").agg((F.coalesce(sharpe() > 0, F.lit(False)) & (F.count("ret") > least)).alias("good"))
    return returns.groupBy(*by).agg(sharpe().alias("sharpe")).join(good.groupBy(*by).agg(F.count_if("good").alias("stable")), [*by])


def calibrate(scores: DataFrame, *by: str, need: int = 3) -> DataFrame:
    """One row: the configuration with the best Sharpe ratio among those stable in ``need`` windows;
    if that is negative, the best of all; null if none is stable. Ties: the smallest by ``by``."""
    pick = F.struct(*by, "sharpe")
    rank = F.struct("sharpe", *[(-F.col(c)).alias(c) for c in by])
    best = scores.agg(F.max_by(pick, F.when(F.col("stable") >= need, rank)).alias("steady"), F.max_by(pick, rank).alias("any"))
    chosen = F.when(F.col("steady").isNull(), None).when(F.col("steady.sharpe") < 0, F.col("any")).otherwise(F.col("steady"))
    return best.select(chosen.alias("c")).select("c.*")


def almgren_chriss(dw: Column, aum: Column, adv: Column, spread: Column, vol: Column, eta: float = 0.1, gamma: float = 0.1) -> Column:
    """Share of capital that a trade costs: half spread, temporary and permanent impact; defaults
    for missing inputs: adv 1, spread 0.001, volatility 0.01."""
    size = F.abs(dw) * aum / F.greatest(F.coalesce(adv, F.lit(1.0)), F.lit(1.0))
    v = F.greatest(F.coalesce(vol, F.lit(0.01)), F.lit(1e-6))
    return F.abs(dw) * (F.greatest(F.coalesce(spread, F.lit(0.001)), F.lit(0.0)) / 2 + eta * v * size + gamma * v * size * size)


def futures_cost(contracts: Column, fee: float = 0.85, tick: float = 1.25, ticks: float = 0.5) -> Column:
    return F.abs(contracts) * (fee + tick * ticks)
