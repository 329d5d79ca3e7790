"""Queries of portfolio construction, the walk-forward engine and costs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import engine as E
from ..operators import kernels as K
from ..operators import regime as G
from ..registry import register
from ..sources import panel as P
from .panels import brand, held, r8
from .sql import BRAND

_DATES = f"{BRAND}, rd AS (SELECT last_day(dt) AS m, max(dt) AS rebalance_dt, max(day_ix) AS signal_ix FROM p GROUP BY 1)"
_IV = f"""{_DATES}, sd AS (SELECT rebalance_dt, signal_ix, asset, stddev_samp(ret) AS sd, count(*) AS n FROM p JOIN rd ON day_ix < signal_ix AND day_ix >= signal_ix - 252 GROUP BY 1, 2, 3),
iv AS (SELECT rebalance_dt, signal_ix, asset, (1 / sd) / sum(1 / sd) OVER (PARTITION BY rebalance_dt) AS w FROM sd WHERE n >= 60 AND sd > 0)"""


def _weights(spark, sf_dir):
    """(panel, inverse-volatility weights), both written: what follows reads them several times."""
    p = held(spark, sf_dir)
    return p, P.cut(E.inverse_volatility(p, E.rebalance_dates(p)))


@register("inverse_volatility", f"WITH {_IV} SELECT rebalance_dt, asset, round(w, 8) AS w FROM iv")
def inverse_volatility(spark, sf_dir):
    return _weights(spark, sf_dir)[1].select("rebalance_dt", "asset", *r8("w"))


@register("walk_forward", f"""WITH {_IV}, k AS (SELECT signal_ix, row_number() OVER (ORDER BY signal_ix) AS k, signal_ix + 1 AS a, coalesce(lead(signal_ix) OVER (ORDER BY signal_ix) + 1, 1e15) AS z
  FROM (SELECT DISTINCT signal_ix FROM iv)), wk AS (SELECT k.k, a, z, asset, w FROM iv JOIN k USING (signal_ix)),
c AS (SELECT n.a AS day_ix, sum(abs(n.w - coalesce(o.w, 0))) * 0.001 AS cost FROM wk n LEFT JOIN wk o ON o.k = n.k - 1 AND o.asset = n.asset WHERE n.k > 1 GROUP BY 1),
d AS (SELECT DISTINCT dt, day_ix FROM p),
g AS (SELECT d.dt, sum(w * coalesce(ret, 0)) AS gross FROM d JOIN wk ON d.day_ix >= a AND d.day_ix < z LEFT JOIN p ON p.dt = d.dt AND p.asset = wk.asset GROUP BY 1)
SELECT d.dt, round(coalesce(gross, 0) - coalesce(cost, 0), 8) AS ret, round(coalesce(cost, 0), 8) AS cost FROM d LEFT JOIN g USING (dt) LEFT JOIN c USING (day_ix)""")
def walk_forward(spark, sf_dir):
    p, w = _weights(spark, sf_dir)
    return E.run(p, E.check_leverage(w, 1.0)).select("dt", *r8("ret", "cost"))


@register("trade_costs", """WITH a AS (SELECT l_partkey % 25 AS asset, cast(l_shipdate AS date) AS dt, sum(cast(round(l_extendedprice * 100) AS bigint)) / 100.0 AS adv,
  sum(cast(round(l_tax * 100) AS bigint)) / (100.0 * count(*)) / 100 AS spread FROM lineitem GROUP BY 1, 2)
SELECT asset, dt, round(0.02 * (spread / 2 + 0.1 * 0.01 * (0.02 * 1e6 / greatest(adv, 1)) + 0.1 * 0.01 * pow(0.02 * 1e6 / greatest(adv, 1), 2)), 10) AS cost FROM a""")
def trade_costs(spark, sf_dir):
    """Almgren-Chriss cost of trading 2 % of a million in each asset each day."""
    x = P.read(spark, sf_dir, "lineitem")
    a = x.groupBy((F.col("l_partkey") % 25).alias("asset"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("adv"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / (F.count("*") * F.lit(100.0)) / 100).alias("spread"),
    )
    return a.select("asset", "dt", F.round(E.almgren_chriss(F.lit(0.02), F.lit(1e6), F.col("adv"), F.col("spread"), F.lit(0.01)), 10).alias("cost"))


def _kernel(name, kernel):
    @register(name)
    def query(spark, sf_dir):
        """Part types are the assets: six dense series, whose rows are nearly all complete."""
        p = held(spark, sf_dir, "type")
        return E.optimize(p, E.rebalance_dates(p), kernel).select("rebalance_dt", "asset", *r8("w"))

    return query


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covariance a year, risk-parity weights and twelve-one momentum."""
    return np.cov(x.T) * 252, E.hrp_kernel(x), np.prod(1 + x[-252:-21], axis=0) - 1


def _bl(x: np.ndarray) -> np.ndarray:
    """Views on two classes of three assets each, by the sign of their momentum."""
    cov, w, mom = _moments(x)
    p, names = K.class_views(["a" if i < len(w) / 2 else "b" for i in range(len(w))])
    return K.bl_weights(cov, w, p, np.sign(p @ mom), np.full(len(names), 0.5), high=0.4)


def _ticker_bl(x: np.ndarray) -> np.ndarray:
    """A view on each asset by the sign of its momentum, the surer the larger it is."""
    cov, w, mom = _moments(x)
    return K.ticker_bl(cov, w, np.sign(mom), np.minimum(np.abs(mom) * 10, 0.95), high=0.4)


hrp = _kernel("hrp_weights", E.hrp_kernel)
trend = _kernel("trend_momentum_weights", E.trend_momentum_kernel(cap=0.3, floor=0.4, equity=(0, 1, 2)))
black_litterman = _kernel("black_litterman_weights", _bl)
ticker_bl = _kernel("ticker_bl_weights", _ticker_bl)
vol_target = _kernel("vol_target_weights", lambda x: K.vol_target(x, E.hrp_kernel(x), 0.08, 2.0))
risk_filtered = _kernel("risk_filter_weights", lambda x: K.risk_filter(x, E.hrp_kernel(x), 0.01))


@register("tsmom_position", f"""WITH {BRAND}, q AS (SELECT asset, dt, avg(ret) OVER (PARTITION BY asset ORDER BY day_ix RANGE BETWEEN 251 PRECEDING AND CURRENT ROW) AS trend,
  stddev_samp(ret) OVER (PARTITION BY asset ORDER BY day_ix RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS v FROM p)
SELECT asset, dt, CASE WHEN trend > 0 AND NOT coalesce(v > 0.028, false) THEN 1 WHEN trend < 0 AND coalesce(v > 0.028, false) THEN -1 ELSE 0 END AS position FROM q WHERE abs(trend) > 1e-12""")
def tsmom_position(spark, sf_dir):
    from ..functions.timeseries import days

    q = brand(spark, sf_dir).withColumns({"trend": F.avg("ret").over(days(252)), "v": F.stddev_samp("ret").over(days(21))})
    stress = F.coalesce(F.col("v") > 0.028, F.lit(False))
    pos = F.when((F.col("trend") > 0) & ~stress, 1).when((F.col("trend") < 0) & stress, -1).otherwise(0)
    return q.where(F.abs("trend") > 1e-12).select("asset", "dt", pos.alias("position"))


def state_variables(spark, sf_dir):
    """(dt, x): daily order counts by priority, '1-URGENT' first, which names the regimes."""
    o = P.read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("dt")).pivot(
        "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    ).count().fillna(0)
    return o.select("dt", F.array(*[F.col(f"`{c}`").cast("double") for c in o.columns[1:]]).alias("x"))


@register("regimes")
def regimes(spark, sf_dir):
    """Posterior of the three-state model over all days; states are named by their mean of the first series."""
    return G.detect(state_variables(spark, sf_dir)).select("dt", "label", F.transform("p", lambda v: F.round(v, 6)).alias("p"))


@register("regime_counts")
def regime_counts(spark, sf_dir):
    return G.detect(state_variables(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@register("walkforward_regimes")
def walkforward_regimes(spark, sf_dir):
    """The regime at each month's last trading day, from causal scores of the daily counts of orders by
    priority, fitted on what was known then."""
    from .macro import series

    raw = P.cut(series(spark, sf_dir))
    dates = raw.groupBy(F.last_day("dt").alias("m")).agg(F.max("dt").alias("rebalance_dt")).drop("m")
    return G.walk_forward(P.cut(G.causal_states(raw, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])), dates)


@register("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    """95 % stationary-bootstrap intervals of the equal-weight portfolio's five metrics."""
    port = P.discount_panel(spark, sf_dir).groupBy("dt").agg(F.avg("ret").alias("ret"))
    return B.bootstrap_intervals(port).select("metric", *r8("point", "low", "high"))


@register("cpcv_paths", f"""WITH {BRAND}, d AS (SELECT dt, avg(ret) AS ret, row_number() OVER (ORDER BY dt) - 1 AS i FROM p GROUP BY dt), n AS (SELECT count(*) AS t FROM d),
g AS (SELECT ret, CASE WHEN i < (t % 6) * (t // 6 + 1) THEN i // (t // 6 + 1) ELSE t % 6 + (i - (t % 6) * (t // 6 + 1)) // (t // 6) END AS grp FROM d, n)
SELECT a.i AS a, b.i AS b, count(*) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM range(6) a(i), range(6) b(i), g WHERE a.i < b.i AND grp IN (a.i, b.i) GROUP BY 1, 2""")
def cpcv_paths(spark, sf_dir, groups: int = 6):
    """Sharpe ratio of each pair of test groups of the equal-weight portfolio."""
    d = P.discount_panel(spark, sf_dir).groupBy("dt").agg(F.avg("ret").alias("ret"))
    d = d.withColumns({"i": F.row_number().over(W.orderBy("dt")) - 1, "t": F.count("*").over(W.partitionBy())})  # one row a day
    size, rest = F.floor(F.col("t") / groups), F.col("t") % groups
    edge = rest * (size + 1)
    grp = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(rest + F.floor((F.col("i") - edge) / size))
    pairs = spark.range(groups).select(F.col("id").alias("a")).crossJoin(spark.range(groups).select(F.col("id").alias("b"))).where("a < b")
    both = d.withColumn("grp", grp).join(F.broadcast(pairs), (F.col("grp") == F.col("a")) | (F.col("grp") == F.col("b")))  # 15 rows
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * 252**0.5, 6).alias("sharpe"))
