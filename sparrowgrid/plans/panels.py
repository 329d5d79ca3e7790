"""Queries over return panels: metrics, windows, cross-sections, calendars, joins."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import timeseries as T
from ..registry import register
from ..sources import panel as P
from .sql import BRAND, span


def brand(spark, sf_dir):
    return P.with_day_ix(P.discount_panel(spark, sf_dir))


def held(spark, sf_dir, asset: str = "brand"):
    """The panel for plans that mention it many times: written once, so that the facts are scanned once."""
    return P.cut(P.with_day_ix(P.cut(P.discount_panel(spark, sf_dir, asset))))


def r8(*cols: str):
    return [F.round(c, 8).alias(c) for c in cols]


@register("metrics_summary", f"""WITH {BRAND},
nav AS (SELECT *, product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS nav FROM p),
dd AS (SELECT *, 1 - nav / max(nav) OVER (PARTITION BY asset ORDER BY dt) AS dd FROM nav),
a AS (SELECT asset, count(*) AS n, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
  avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS sortino, max(dd) AS max_drawdown,
  pow(product(1 + ret), 252.0 / count(*)) - 1 AS annualized_return, avg(ret) * 252 AS mean_annual,
  stddev_samp(ret) * sqrt(252) AS volatility, skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS skew,
  kurtosis_pop(ret) + 3 AS kurtosis FROM dd GROUP BY asset)
SELECT asset, n, round(sharpe, 8) AS sharpe, round(sortino, 8) AS sortino, round(max_drawdown, 8) AS max_drawdown,
  round(annualized_return, 8) AS annualized_return, round(mean_annual, 8) AS mean_annual, round(volatility, 8) AS volatility,
  round(skew, 8) AS skew, round(kurtosis, 8) AS kurtosis, round(annualized_return / max_drawdown, 8) AS calmar FROM a""")
def metrics_summary(spark, sf_dir):
    cols = ("sharpe", "sortino", "max_drawdown", "annualized_return", "mean_annual", "volatility", "skew", "kurtosis", "calmar")
    return M.summary(P.discount_panel(spark, sf_dir)).select("asset", "n", *r8(*cols))


@register("tail_risk", f"""WITH {BRAND}, r AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ret) AS rn,
  floor((count(*) OVER (PARTITION BY asset) - 1) * (1 - 0.95)) + 1 AS ix FROM p),
v AS (SELECT asset, greatest(0, -max(CASE WHEN rn = ix THEN ret END)) AS var FROM r GROUP BY asset)
SELECT v.asset, round(var, 8) AS var, round(greatest(var, coalesce(-avg(ret) FILTER (WHERE ret <= -var), var)), 8) AS cvar
FROM v JOIN p USING (asset) GROUP BY v.asset, var""")
def tail_risk(spark, sf_dir):
    return M.tail_risk(P.discount_panel(spark, sf_dir)).select("asset", *r8("var", "cvar"))


@register("component_var", f"""WITH {BRAND}, x AS (SELECT * FROM p WHERE asset IN (SELECT asset FROM p GROUP BY 1)),
n AS (SELECT count(DISTINCT asset) AS k FROM x), port AS (SELECT dt, round(sum(ret) / (SELECT k FROM n), 12) AS r FROM x GROUP BY dt),
rk AS (SELECT r, row_number() OVER (ORDER BY r) AS rn, floor((count(*) OVER () - 1) * (1 - 0.95)) + 1 AS ix FROM port),
v AS (SELECT greatest(0, -max(CASE WHEN rn = ix THEN r END)) AS var FROM rk),
tail AS (SELECT dt FROM port WHERE r <= -(SELECT var FROM v)),
c AS (SELECT asset, -sum(ret) / (SELECT count(*) FROM tail) / (SELECT k FROM n) AS component FROM x WHERE dt IN (SELECT dt FROM tail) GROUP BY asset)
SELECT asset, round(component, 8) AS component, round(component / sum(component) OVER (), 8) AS share FROM c""")
def component_var(spark, sf_dir):
    """Equal weights; components add up to the CVaR, shares to 1. Missing returns count as 0."""
    panel = P.discount_panel(spark, sf_dir)
    k = panel.select(F.count_distinct("asset").alias("k"))
    port = panel.crossJoin(F.broadcast(k)).groupBy("dt", "k").agg(F.round(F.sum("ret") / F.first("k"), 12).alias("ret"))  # one row of k
    var = M.tail_risk(port.withColumn("all", F.lit(1)), "all").select("var")
    tail = port.crossJoin(F.broadcast(var)).where(F.col("ret") <= -F.col("var")).select("dt", "k")
    n = tail.select(F.count("*").alias("n"))
    parts = panel.join(F.broadcast(tail), "dt").groupBy("asset", "k").agg(F.sum("ret").alias("s")).crossJoin(F.broadcast(n))  # a twentieth of the days
    parts = parts.select("asset", (-F.col("s") / F.col("n") / F.col("k")).alias("component"))
    share = F.col("component") / F.sum("component").over(W.partitionBy())
    return parts.withColumn("share", share).select("asset", *r8("component", "share"))


@register("ts_windows", f"""WITH {BRAND} SELECT asset, dt,
  round(avg(ret) OVER {span(20)}, 8) AS mean20, round(stddev_samp(ret) OVER {span(20)}, 8) AS std20,
  round(product(1 + ret) OVER {span(252, 21)} - 1, 8) AS mom, round(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY day_ix), 8) AS log_price,
  round(sign(ret) * ln(1 + abs(ret)), 8) AS slog, round(sign(ret) * pow(abs(ret), 0.5), 8) AS spow FROM p""")
def ts_windows(spark, sf_dir):
    p = brand(spark, sf_dir)
    out = p.select(
        "asset", "dt", T.ts_mean("ret", 20).alias("mean20"), T.ts_std("ret", 20).alias("std20"), T.cumulative_return("ret", 252, 21).alias("mom"),
        T.log_price("ret").alias("log_price"), T.signed_log1p("ret").alias("slog"), T.signed_power("ret", 0.5).alias("spow"),
    )
    return out.select("asset", "dt", *r8("mean20", "std20", "mom", "log_price", "slog", "spow"))


@register("ts_order", f"""WITH {BRAND}, l AS (SELECT asset, dt, ret, list(ret) OVER {span(15)} AS seen FROM p)
SELECT asset, dt, round((len(list_filter(seen, lambda v: v < ret)) + (len(list_filter(seen, lambda v: v = ret)) + 1) / 2.0) / len(seen), 8) AS ts_rank,
  len(seen) - list_position(seen, list_max(seen)) AS argmax, len(seen) - list_position(seen, list_min(seen)) AS argmin,
  round(list_sum(list_transform(seen, lambda v, i: v * i)) / (len(seen) * (len(seen) + 1) / 2.0), 8) AS decay FROM l""")
def ts_order(spark, sf_dir):
    out = brand(spark, sf_dir).select(
        "asset", "dt", T.ts_rank("ret", 15).alias("ts_rank"), T.ts_argmax("ret", 15).cast("long").alias("argmax"),
        T.ts_argmax("ret", 15, False).cast("long").alias("argmin"), T.decay_linear("ret", 15).alias("decay"),
    )
    return out.select("asset", "dt", "argmax", "argmin", *r8("ts_rank", "decay"))


@register("residual_return", f"""WITH {BRAND}, m AS (SELECT *, avg(ret) OVER (PARTITION BY dt) AS mkt FROM p),
b AS (SELECT *, count(ret) OVER {span(60)} AS n, covar_samp(ret, mkt) OVER {span(60)} AS c, var_samp(mkt) OVER {span(60)} AS v,
  corr(ret, mkt) OVER {span(60)} AS ts_corr FROM m)
SELECT asset, dt, round(CASE WHEN n >= 30 THEN ret - c / v * mkt END, 8) AS resid,
  CASE WHEN n >= 30 THEN round(ts_corr, 6) END AS ts_corr FROM b""")
def residual_return(spark, sf_dir):
    """Return less beta times the equal-weight market, 60-day window (30 valid rows here)."""
    p = brand(spark, sf_dir).withColumn("mkt", F.avg("ret").over(W.partitionBy("dt")))
    w = T.days(60)
    beta = F.covar_samp("ret", "mkt").over(w) / F.nullif(F.var_samp("mkt").over(w), F.lit(0.0))
    out = p.withColumns({"n": F.count("ret").over(w), "beta": beta, "c": T.ts_corr("ret", "mkt", 60)})
    keep = F.col("n") >= 30
    return out.select("asset", "dt", F.when(keep, F.round(F.col("ret") - F.col("beta") * F.col("mkt"), 8)).alias("resid"), F.when(keep, F.round("c", 6)).alias("ts_corr"))


@register("cross_section", f"""WITH {BRAND}, t AS (SELECT *, rank() OVER (PARTITION BY dt ORDER BY ret) AS r, count(*) OVER (PARTITION BY dt, ret) AS ties,
  count(*) OVER (PARTITION BY dt) AS n, avg(ret) OVER (PARTITION BY dt) AS m, stddev_pop(ret) OVER (PARTITION BY dt) AS s,
  sum(abs(ret)) OVER (PARTITION BY dt) AS g FROM p)
SELECT asset, dt, round((r + (ties - 1) / 2.0) / n, 8) AS cs_rank, round(CASE WHEN s = 0 THEN 0 ELSE (ret - m) / s END, 6) AS cs_zscore,
  round(ret - m, 8) AS cs_demean, round(CASE WHEN g = 0 THEN 0 ELSE ret / g END, 8) AS cs_scale FROM t""")
def cross_section(spark, sf_dir):
    out = P.discount_panel(spark, sf_dir).select(
        "asset", "dt", T.cs_rank("ret").alias("cs_rank"), F.round(T.cs_zscore("ret") + 0.0, 6).alias("cs_zscore"), T.cs_demean("ret").alias("cs_demean"), T.cs_scale("ret").alias("cs_scale")
    )
    return out.select("asset", "dt", "cs_zscore", *r8("cs_rank", "cs_demean", "cs_scale"))


@register("price_returns", f"""WITH {BRAND}, q AS (SELECT asset, dt, 100 * product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS price FROM p)
SELECT asset, dt, round(price / lag(price) OVER w - 1, 8) AS simple, round(ln(price / lag(price) OVER w), 8) AS log FROM q WINDOW w AS (PARTITION BY asset ORDER BY dt)""")
def price_returns(spark, sf_dir):
    q = P.prices(P.discount_panel(spark, sf_dir))
    return q.select("asset", "dt", F.round(P.simple_returns("price"), 8).alias("simple"), F.round(P.log_returns("price"), 8).alias("log"))


for _freq, _end in (("W", "cast(date_trunc('week', dt) AS date) + 6"), ("ME", "last_day(dt)"), ("QE", "last_day(cast(date_trunc('quarter', dt) AS date) + INTERVAL 2 MONTH)")):

    @register(f"resample_{_freq.lower()}", f"""WITH {BRAND}, b AS (SELECT asset, cast({_end} AS date) AS bin, product(1 + ret) - 1 AS ret FROM p GROUP BY 1, 2),
    g AS (SELECT asset, bin FROM (SELECT DISTINCT asset FROM p), (SELECT DISTINCT bin FROM b))
    SELECT g.asset, g.bin AS "end", round(coalesce(ret, 0), 12) AS ret FROM g LEFT JOIN b USING (asset, bin)""")
    def resample(spark, sf_dir, freq=_freq):
        return P.resample(P.discount_panel(spark, sf_dir), freq).select("asset", "end", F.round("ret", 12).alias("ret"))


@register("align_calendar", f"""WITH {BRAND}, d AS (SELECT DISTINCT dt FROM panel WHERE day(dt) <> 13),
c AS (SELECT DISTINCT dt FROM panel WHERE dayofweek(dt) BETWEEN 1 AND 5)
SELECT 'extra' AS kind, count(*) AS n FROM d WHERE dt NOT IN (SELECT dt FROM c) UNION ALL
SELECT 'missing', count(*) FROM c WHERE dt NOT IN (SELECT dt FROM d) UNION ALL
SELECT 'rows', (SELECT count(*) FROM c) * (SELECT count(DISTINCT asset) FROM panel WHERE day(dt) <> 13) UNION ALL
SELECT 'valued', count(*) FROM panel WHERE day(dt) <> 13 AND dt IN (SELECT dt FROM c)""")
def align_calendar(spark, sf_dir):
    panel = P.discount_panel(spark, sf_dir)
    cal = panel.where(F.weekday("dt") < 5).select("dt")
    on, extra, missing = P.align_to_calendar(panel.where(F.day("dt") != 13), cal)
    n = F.count("*").alias("n")
    return (
        extra.select(F.lit("extra").alias("kind")).groupBy("kind").agg(n)
        .unionByName(missing.select(F.lit("missing").alias("kind")).groupBy("kind").agg(n))
        .unionByName(on.select(F.lit("rows").alias("kind")).groupBy("kind").agg(n))
        .unionByName(on.where("ret is not null").select(F.lit("valued").alias("kind")).groupBy("kind").agg(n))
    )


for _strict in (False, True):

    @register(f"as_of_{'before' if _strict else 'at'}", f"""WITH {BRAND}, m AS (SELECT asset, dt, ret AS mark FROM panel WHERE day(dt) % 10 = 0)
    SELECT p.asset, p.dt, round(m.mark, 8) AS mark FROM p ASOF LEFT JOIN m ON p.asset = m.asset AND p.dt {'>' if _strict else '>='} m.dt""")
    def as_of(spark, sf_dir, strict=_strict):
        panel = P.discount_panel(spark, sf_dir)
        marks = panel.where(F.day("dt") % 10 == 0).withColumnRenamed("ret", "mark")
        return P.as_of(panel.select("asset", "dt"), marks, "asset", "dt", "mark", strict).select("asset", "dt", *r8("mark"))


@register("drawdown_path", f"""WITH {BRAND}, nav AS (SELECT asset, dt, product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS nav FROM p)
SELECT asset, dt, round(1 - nav / max(nav) OVER (PARTITION BY asset ORDER BY dt), 12) AS drawdown FROM nav""")
def drawdown_path(spark, sf_dir):
    return M.with_drawdown(P.discount_panel(spark, sf_dir)).select("asset", "dt", F.round("drawdown", 12).alias("drawdown"))


@register("covariance_pairs", f"""WITH {BRAND} SELECT x.asset AS a, y.asset AS b, count(*) AS n, round(covar_samp(x.ret, y.ret), 10) AS cov
FROM p x JOIN p y ON x.dt = y.dt AND x.asset <= y.asset GROUP BY 1, 2""")
def covariance_pairs(spark, sf_dir):
    """Pairwise-complete covariances: a self-join by day, combined before the shuffle."""
    p = P.discount_panel(spark, sf_dir)
    y = p.select("dt", F.col("asset").alias("b"), F.col("ret").alias("y"))
    both = p.select("dt", F.col("asset").alias("a"), "ret").join(y, "dt").where("a <= b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.covar_samp("ret", "y"), 10).alias("cov"))


@register("ewma_covariance", f"""WITH {BRAND}, d AS (SELECT dt, day_ix - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT dt, day_ix FROM p)),
x AS (SELECT a.asset, d.t, d.n, coalesce(p.ret, 0) AS ret FROM (SELECT DISTINCT asset FROM p) a CROSS JOIN d LEFT JOIN p ON p.asset = a.asset AND p.dt = d.dt),
s AS (SELECT x.asset AS a, y.asset AS b, pow(0.94, max(x.n) - 2) * covar_samp(x.ret, y.ret) FILTER (WHERE x.t < 2)
  + coalesce(sum(0.06 * pow(0.94, x.n - 1 - x.t) * x.ret * y.ret) FILTER (WHERE x.t >= 2), 0) AS cov FROM x JOIN x y ON x.t = y.t AND x.asset <= y.asset GROUP BY 1, 2)
SELECT a, b, round(cov, 10) AS cov FROM s""")
def ewma_covariance(spark, sf_dir, decay: float = 0.94):
    """All assets and days; a missing return counts 0. Seed: covariance of the first two days."""
    p = P.discount_panel(spark, sf_dir)
    days = p.select("dt").distinct().select("dt", (F.row_number().over(W.orderBy("dt")) - 1).alias("t"), F.count("*").over(W.partitionBy()).alias("n"))  # one row a day
    grid = p.select("asset").distinct().crossJoin(F.broadcast(days))
    x = grid.join(p.select("asset", "dt", "ret"), ["asset", "dt"], "left").select(F.col("asset").alias("a"), F.coalesce("ret", F.lit(0.0)).alias("x"), "t", "n")
    return _ewma(x, decay)


def _ewma(x, decay):
    both = x.join(x.select(F.col("a").alias("b"), F.col("x").alias("y"), "t"), "t").where("a <= b")
    old, new = F.col("t") < 2, F.col("t") >= 2
    seed = F.covar_samp(F.when(old, F.col("x")), F.when(old, F.col("y"))) * F.pow(F.lit(decay), F.max("n") - 2)
    rest = F.sum(F.when(new, (1 - decay) * F.pow(F.lit(decay), F.col("n") - 1 - F.col("t")) * F.col("x") * F.col("y")))
    return both.groupBy("a", "b").agg(F.round(seed + F.coalesce(rest, F.lit(0.0)), 10).alias("cov"))


@register("annualized_stats", f"""WITH {BRAND} SELECT asset, round(avg(ret) * 252, 8) AS mean, round(stddev_samp(ret) * sqrt(252), 8) AS vol,
round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)), 8) AS ratio FROM p GROUP BY asset""")
def annualized_stats(spark, sf_dir):
    mean, vol = F.avg("ret") * 252, F.stddev_samp("ret") * math.sqrt(252)
    return P.discount_panel(spark, sf_dir).groupBy("asset").agg(F.round(mean, 8).alias("mean"), F.round(vol, 8).alias("vol"), F.round(mean / F.nullif(vol, F.lit(0.0)), 8).alias("ratio"))


@register("rebalance_dates", f"""WITH {BRAND}, e AS (SELECT last_day(dt) AS period, max(dt) AS dt FROM p GROUP BY 1)
SELECT dt, dt < (SELECT date_trunc('month', max(dt)) FROM p) AS completed FROM e""")
def rebalance_dates(spark, sf_dir):
    """Last trading day of each month, and whether its month was over at the last date."""
    p = P.discount_panel(spark, sf_dir)
    asof = p.select(F.trunc(F.max("dt"), "month").alias("m"))
    ends = p.groupBy(F.last_day("dt").alias("period")).agg(F.max("dt").alias("dt"))
    return ends.crossJoin(F.broadcast(asof)).select("dt", (F.col("dt") < F.col("m")).alias("completed"))  # one row


@register("news_by_key", """WITH head AS (SELECT ts, event_type AS key, sign(value - 50) AS sentiment, row_number() OVER (PARTITION BY ts ORDER BY event_id) AS rn FROM events),
w AS (SELECT * FROM head WHERE rn = 1 AND ts BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 4 DAY AND TIMESTAMP '2024-01-20 00:00:00')
SELECT key, count(*) AS n, round(avg(sentiment), 8) AS score, round(least((SELECT count(*) FROM w) / 50.0, 1), 8) AS confidence FROM w GROUP BY key""")
def news_by_key(spark, sf_dir):
    from ..operators.news import aggregate

    e = P.read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("key"), F.signum(F.col("value") - 50).alias("sentiment"), F.col("event_id").alias("story_id"))
    return aggregate(e, "2024-01-20").select("key", "n", *r8("score", "confidence"))
