"""Queries of macro features, regimes and rolling covariances."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import metrics as M
from ..operators import regime as R
from ..registry import register
from ..sources import panel as P
from .panels import brand
from .sql import BRAND

_SERIES = """c AS (SELECT o_orderpriority AS series, cast(o_orderdate AS date) AS dt, cast(count(*) AS double) AS x FROM orders GROUP BY 1, 2)"""
_GAPS = f"""{_SERIES}, g AS (SELECT series, dt, CASE WHEN day(dt) % 7 <> 0 THEN x END AS x FROM c)"""


def series(spark, sf_dir):
    """Daily order counts by priority, in long form."""
    return P.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("dt")).agg(
        F.count("*").cast("double").alias("x")
    )


@register("gap_fill", f"""WITH {_GAPS}, f AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS fx, first_value(x IGNORE NULLS) OVER z AS bx,
  last_value(CASE WHEN x IS NOT NULL THEN dt END IGNORE NULLS) OVER a AS fd, first_value(CASE WHEN x IS NOT NULL THEN dt END IGNORE NULLS) OVER z AS bd FROM g
  WINDOW a AS (PARTITION BY series ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY series ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, dt, fx AS filled, round(CASE WHEN bx IS NULL THEN fx WHEN bd = fd THEN fx ELSE fx + (bx - fx) * ((dt - fd) / (bd - fd)) END, 8) AS interpolated FROM f""")
def gap_fill(spark, sf_dir):
    g = series(spark, sf_dir).withColumn("x", F.when(F.day("dt") % 7 != 0, F.col("x")))
    return g.select("series", "dt", X.forward_fill().alias("filled"), F.round(X.time_interpolation(), 8).alias("interpolated"))


@register("expanding_robust_z", f"""WITH {_SERIES}, q AS (SELECT *, count(x) OVER w AS n, quantile_cont(x, 0.5) OVER w AS m, quantile_cont(x, 0.75) OVER w - quantile_cont(x, 0.25) OVER w AS i FROM c
  WINDOW w AS (PARTITION BY series ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series, dt, round(CASE WHEN n >= 60 THEN (x - m) / nullif(i, 0) END, 8) AS z FROM q""")
def expanding_robust_z(spark, sf_dir):
    return X.expanding_robust_z(series(spark, sf_dir)).select("series", "dt", F.round("z", 8).alias("z"))


@register("full_robust_z", f"""WITH {_SERIES}, q AS (SELECT series, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS i FROM c GROUP BY 1)
SELECT series, dt, round((x - m) / CASE WHEN i = 0 THEN 1 ELSE i END, 8) AS z FROM c JOIN q USING (series)""")
def full_robust_z(spark, sf_dir):
    return X.full_robust_z(series(spark, sf_dir)).select("series", "dt", F.round("z", 8).alias("z"))


@register("rate_of_change", f"""WITH {_SERIES} SELECT series, dt, round(x / lag(x, 5) OVER w - 1, 8) AS roc_5d, round(x / lag(x, 21) OVER w - 1, 8) AS roc_21d,
round(x / lag(x, 63) OVER w - 1, 8) AS roc_63d FROM c WINDOW w AS (PARTITION BY series ORDER BY dt)""")
def rate_of_change(spark, sf_dir):
    return series(spark, sf_dir).select("series", "dt", *[F.round(X.rate_of_change(d), 8).alias(f"roc_{d}d") for d in (5, 21, 63)])


@register("rolling_covariance", f"""WITH {BRAND},
g AS (SELECT d.dt, d.day_ix, a.asset AS a, b.asset AS b FROM (SELECT DISTINCT dt, day_ix FROM p) d, (SELECT DISTINCT asset FROM p) a, (SELECT DISTINCT asset FROM p) b WHERE a.asset <= b.asset),
x AS (SELECT g.*, CASE WHEN s.ret IS NOT NULL AND t.ret IS NOT NULL THEN s.ret END AS x, CASE WHEN s.ret IS NOT NULL AND t.ret IS NOT NULL THEN t.ret END AS y
  FROM g LEFT JOIN p s ON s.asset = a AND s.dt = g.dt LEFT JOIN p t ON t.asset = b AND t.dt = g.dt),
r AS (SELECT dt, day_ix, a, b, covar_samp(x, y) OVER (PARTITION BY a, b ORDER BY day_ix RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS cov FROM x)
SELECT dt, a, b, round(cov + 1e-15, 10) AS cov FROM r WHERE day_ix >= 60""")
def rolling_covariance(spark, sf_dir, window: int = 60):
    """Pairwise-complete covariances of the last 60 calendar rows, every day and pair.

    Returns lie on a grid, so some values end in an exact half: the nudge rounds those alike.
    """
    return M.rolling_covariance(P.cut(brand(spark, sf_dir)), window).select("dt", "a", "b", F.round(F.col("cov") + 1e-15, 10).alias("cov"))


_TABLE = ", ".join(f"('{a}', {x}, {y}, {z})" for a, (x, y, z) in R.REGIME_TABLE.items())


@register("composite_signal", f"""WITH k AS (SELECT cast(ts AS date) AS dt, count(*) AS n, count(*) FILTER (WHERE value < 30) AS a, count(*) FILTER (WHERE value >= 30 AND value < 45) AS b, avg(sign(value - 50)) AS s FROM events GROUP BY 1),
q AS (SELECT dt, n, s, a / n AS p0, b / n AS p1, (n - a - b) / n AS p2 FROM k), t(asset_class, e, c, t) AS (VALUES {_TABLE}),
m AS (SELECT dt, asset_class, p0 * e + p1 * c + p2 * t AS macro, least(n / 400.0, 1) AS conf, CASE WHEN asset_class = 'equity' THEN s ELSE 0 END AS s,
  greatest(0, 1 + (greatest(p0, 1e-12) * ln(greatest(p0, 1e-12)) + greatest(p1, 1e-12) * ln(greatest(p1, 1e-12)) + greatest(p2, 1e-12) * ln(greatest(p2, 1e-12))) / ln(3)) AS confidence,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS regime FROM q, t)
SELECT dt, asset_class, round(CASE WHEN conf >= 0.05 THEN 0.7 * macro + 0.3 * s * conf ELSE macro END, 8) AS score, round(confidence, 8) AS confidence, regime FROM m""")
def composite_signal(spark, sf_dir):
    """Shares of the day's event values stand for the posterior, their signs for the news on equity."""
    v = F.col("value")
    k = P.read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("dt")).agg(
        F.count("*").alias("n"), F.count_if(v < 30).alias("a"), F.count_if((v >= 30) & (v < 45)).alias("b"), F.avg(F.signum(v - 50)).alias("s")
    )
    p = F.array(F.col("a") / F.col("n"), F.col("b") / F.col("n"), (F.col("n") - F.col("a") - F.col("b")) / F.col("n"))
    news = k.select("dt", F.lit("equity").alias("asset_class"), F.col("s").alias("score"), F.least(F.col("n") / 400.0, F.lit(1.0)).alias("n"))
    return R.composite(k.select("dt", p.alias("p")), news).select("dt", "asset_class", F.round("score", 8).alias("score"), F.round("confidence", 8).alias("confidence"), "regime")


@register("smoothed_regimes", f"""WITH RECURSIVE {BRAND}, mo AS (SELECT asset, last_day(dt) AS dt, product(1 + ret) - 1 AS ret FROM p GROUP BY 1, 2),
s AS (SELECT asset AS series, dt, CASE WHEN ret > 0.02 THEN 0 WHEN ret < -0.02 THEN 1 ELSE 2 END AS r, least(1, 0.5 + 3 * abs(ret)) AS c, row_number() OVER (PARTITION BY asset ORDER BY dt) AS k FROM mo),
f(series, k, dt, held, waiting, seen, confidence) AS (SELECT series, k, dt, r, -1, 0, c FROM s WHERE k = 1 UNION ALL
  SELECT series, k, dt, CASE WHEN takes THEN r ELSE held END, CASE WHEN takes OR c < 0.65 THEN -1 ELSE r END, CASE WHEN takes OR c < 0.65 THEN 0 ELSE now END, CASE WHEN takes THEN c ELSE 1.0 END
  FROM (SELECT *, r = held OR now >= 2 AS takes FROM (SELECT s.*, f.held, CASE WHEN s.c < 0.65 THEN 0 WHEN s.r = f.waiting THEN f.seen + 1 ELSE 1 END AS now FROM f JOIN s ON s.series = f.series AND s.k = f.k + 1)))
SELECT series, dt, held AS regime, round(confidence, 8) AS confidence FROM f""")
def smoothed_regimes(spark, sf_dir):
    """Confirmed monthly regimes of each brand: gain, loss or neither, surer the larger the move."""
    mo = P.discount_panel(spark, sf_dir).groupBy("asset", F.last_day("dt").alias("dt")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    regime = F.when(F.col("ret") > 0.02, 0).when(F.col("ret") < -0.02, 1).otherwise(2)
    out = R.smooth(mo.select(F.col("asset").alias("series"), "dt", regime.alias("regime"), F.least(F.lit(1.0), 0.5 + 3 * F.abs("ret")).alias("confidence")))
    return out.select("series", "dt", "regime", F.round("confidence", 8).alias("confidence"))
