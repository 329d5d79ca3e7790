"""Queries of the search space: scores, simulations by configuration, pruning."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import search as S
from ..registry import register
from ..sources import panel as P
from .panels import held, r8
from .sql import BRAND, span

#: Valid rows of the 60 that a beta needs here; the panel of brands is sparse.
BETA_OBS = 30


def _family_sql() -> dict[str, str]:
    out = {}
    for back, skip in S.MOMENTUM:
        sign = "-" if (back, skip) in S.REVERSALS else ""
        out[f"mom{back}_{skip}"] = f"CASE WHEN day_ix >= {back * 21} THEN {sign}(coalesce(product(1 + ret) OVER {span(back * 21, skip * 21)}, 1) - 1) END"
    for d in S.WINDOWS["retvol"]:
        out[f"retvol{d}"] = f"-stddev_samp(ret) OVER {span(d)}"
    for d in S.WINDOWS["idiovol"]:
        out[f"idiovol{d}"] = f"-stddev_samp(resid) OVER {span(d)}"
    for d in S.WINDOWS["maxret"]:
        out[f"maxret{d}"] = f"-max(ret) OVER {span(d)}"
    for d in S.WINDOWS["skew"]:
        out[f"skew{d}"] = f"CASE WHEN count(ret) OVER {span(d)} >= 3 THEN -skewness(ret) OVER {span(d)} END"
    for d in S.WINDOWS["autocorr"]:
        out[f"autocorr{d}"] = f"corr(ret, prev) OVER {span(d)}"
    return out


def _rank(x: str, by: str) -> str:
    known = f"PARTITION BY {by}, {x} IS NULL"
    return f"((rank() OVER ({known} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}))"


def _pair(name: str, a: str, b: str, flip: bool) -> str:
    second = f"(1 - {_rank('y', 'formation')})" if flip else _rank("y", "formation")
    return f"SELECT formation, '{name}' AS config, asset, {_rank('x', 'formation')} * {second} AS score FROM (SELECT formation, asset, {a} AS x, {b} AS y FROM c WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


_SEEDS = {
    "_last": f"max(ret) OVER {span(1)}",
    "_step": f"max(lp) OVER {span(1)} - max(lp) OVER (PARTITION BY asset ORDER BY day_ix RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING)",
    "_gain": f"coalesce(product(1 + ret) OVER {span(250)}, 1) - 1",
    "_ratio": f"stddev_samp(ret) OVER {span(2)} / nullif(stddev_samp(ret) OVER {span(5)}, 0)",
}
_COLUMNS = _family_sql() | _SEEDS
_TREND = f"SELECT formation, asset, -sign(_step) * (1 + {_rank('_gain', 'formation')}) AS x FROM c"
C0 = f"""c AS (SELECT formation, asset, {", ".join(f"CASE WHEN NOT isnan({n}) THEN round({n}, {S.DIGITS}) END AS {n}" for n in _COLUMNS)} FROM c0 WHERE formation IS NOT NULL)"""
VIEWS = f"""m AS (SELECT *, avg(ret) OVER (PARTITION BY dt) AS mkt FROM p),
h AS (SELECT asset, day_ix, ret,
  CASE WHEN count(ret) OVER {span(60)} >= {BETA_OBS} THEN ret - covar_samp(ret, mkt) OVER {span(60)} / nullif(var_samp(mkt) OVER {span(60)}, 0) * mkt END AS resid,
  max(ret) OVER (PARTITION BY asset ORDER BY day_ix RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev,
  sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY day_ix) AS lp FROM m),
fo AS (SELECT last_day(dt) AS formation, max(day_ix) AS day_ix FROM p GROUP BY 1),
u AS (SELECT NULL::date AS formation, asset, day_ix, ret, resid, prev, lp FROM h UNION ALL
  SELECT formation, asset, day_ix, NULL, NULL, NULL, NULL FROM fo CROSS JOIN (SELECT DISTINCT asset FROM p)),
c0 AS (SELECT formation, asset, {", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items())} FROM u)"""
SCORES = f"""l AS (SELECT formation, asset, name, x FROM c UNPIVOT (x FOR name IN ({", ".join(_family_sql())})) WHERE x IS NOT NULL),
s AS (
  SELECT formation, 'B:' || name || ':rank' AS config, asset, {_rank('x', 'formation, name')} AS score FROM l UNION ALL
  SELECT formation, 'B:' || name || ':z', asset, CASE WHEN stddev_pop(x) OVER n = 0 THEN 0 ELSE (x - avg(x) OVER n) / nullif(stddev_pop(x) OVER n, 0) END FROM l WINDOW n AS (PARTITION BY formation, name) UNION ALL
  SELECT formation, 'A:k_rev_close1', asset, CASE WHEN x IS NOT NULL THEN {_rank('x', 'formation')} END FROM (SELECT formation, asset, -_last AS x FROM c) UNION ALL
  SELECT formation, 'A:k_reversion_trend', asset, CASE WHEN x IS NOT NULL THEN {_rank('x', 'formation')} END FROM ({_TREND}) UNION ALL
  SELECT formation, 'A:k_volratio', asset, CASE WHEN _ratio IS NOT NULL AND _last IS NOT NULL THEN 2 - {_rank('_ratio', 'formation')} - {_rank('_last', 'formation')} END FROM c UNION ALL
  {_pair("C:mom_x_lowvol", "mom12_1", "-retvol126", True)} UNION ALL
  {_pair("C:mom_x_lowidiovol", "mom12_1", "-idiovol126", True)} UNION ALL
  {_pair("C:revol_x_skew", "retvol126", "skew252", False)})"""
_SPACE = f"{BRAND}, {VIEWS}, {C0}, {SCORES}"


def _scores(spark, sf_dir):
    p = held(spark, sf_dir)
    return S.search_space(p, p.select(F.last_day("dt").alias("formation")), beta_obs=BETA_OBS), p


@register("search_space", f"WITH {_SPACE} SELECT formation, config, asset, round(score, 5) + 0.0 AS score FROM s WHERE score IS NOT NULL")
def search_space(spark, sf_dir):
    return _scores(spark, sf_dir)[0].select("formation", "config", "asset", (F.round("score", 5) + 0.0).alias("score"))


@register("search_space_simulation", f"""WITH {_SPACE}, hd AS (SELECT last_day(dt - INTERVAL 1 MONTH) AS formation, dt, asset, ret FROM p),
fd AS (SELECT formation, min(dt) AS first FROM hd GROUP BY 1 HAVING count(DISTINCT dt) >= 2),
mr AS (SELECT hd.formation, asset, product(1 + ret) - 1 AS month_ret FROM hd JOIN fd ON hd.formation = fd.formation AND dt > first GROUP BY 1, 2),
e AS (SELECT * FROM s WHERE score IS NOT NULL AND formation IN (SELECT formation FROM mr)),
kk AS (SELECT config, formation, row_number() OVER (PARTITION BY config ORDER BY formation) AS k FROM (SELECT DISTINCT config, formation FROM e)),
rr AS (SELECT config, formation, asset, ceil(count(*) OVER (PARTITION BY config, formation) * 0.2) AS n_top, row_number() OVER (PARTITION BY config, formation ORDER BY score DESC, asset) AS rn FROM e),
hh AS (SELECT config, k, rr.asset, 1.0 / n_top AS w, coalesce(month_ret, 0) AS mr FROM rr JOIN kk USING (config, formation) LEFT JOIN mr ON mr.formation = rr.formation AND mr.asset = rr.asset WHERE rn <= n_top AND n_top >= 3),
dd AS (SELECT config, k + 1 AS k, asset, CASE WHEN sum(w * (1 + mr)) OVER b > 0 THEN w * (1 + mr) / sum(w * (1 + mr)) OVER b ELSE w END AS d FROM hh WINDOW b AS (PARTITION BY config, k)),
tt AS (SELECT coalesce(hh.config, dd.config) AS config, coalesce(hh.k, dd.k) AS k, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover FROM hh FULL JOIN dd ON hh.config = dd.config AND hh.k = dd.k AND hh.asset = dd.asset GROUP BY 1, 2),
gg AS (SELECT config, k, sum(w * mr) AS gross FROM hh GROUP BY 1, 2), net AS (SELECT config, coalesce(gross, 0) - coalesce(turnover, 0) * 0.001 AS net FROM kk LEFT JOIN gg USING (config, k) LEFT JOIN tt USING (config, k))
SELECT config, count(*) AS n, round(avg(net), 8) AS mean, round(stddev_samp(net), 8) AS deviation, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12), 8) AS sharpe FROM net GROUP BY 1""")
def search_space_simulation(spark, sf_dir):
    """Monthly simulation of every configuration in one plan: mean, deviation and Sharpe ratio of the net returns."""
    scores, p = _scores(spark, sf_dir)
    scores = P.cut(scores)  # the simulation reads them several times
    sims = B.simulate_monthly(scores, p, 0.2, 3, 10.0, "config")
    sd = F.stddev_samp("net")
    return sims.groupBy("config").agg(
        F.count("*").alias("n"), *[F.round(c, 8).alias(n) for n, c in {"mean": F.avg("net"), "deviation": sd, "sharpe": F.avg("net") / F.nullif(sd, F.lit(0.0)) * math.sqrt(12)}.items()]
    )


@register("correlation_prune", f"""WITH RECURSIVE {BRAND}, m AS (SELECT last_day(dt) AS period, asset AS config, product(1 + ret) - 1 AS ret FROM p GROUP BY 1, 2),
c AS (SELECT x.config AS a, y.config AS b, corr(x.ret, y.ret) AS c FROM m x JOIN m y ON x.period = y.period AND x.config < y.config GROUP BY 1, 2), near AS (SELECT b, list(a) AS near FROM c WHERE abs(c) <= 0.1 GROUP BY 1),
names AS (SELECT config, coalesce(near, []) AS near, row_number() OVER (ORDER BY config) AS k FROM (SELECT DISTINCT config FROM m) LEFT JOIN near ON b = config),
f(k, kept) AS (SELECT cast(0 AS bigint), []::varchar[] UNION ALL SELECT names.k, CASE WHEN list_has_all(near, kept) THEN list_append(kept, config) ELSE kept END FROM f JOIN names ON names.k = f.k + 1)
SELECT unnest(kept) AS config FROM f WHERE k = (SELECT max(k) FROM names)""")
def correlation_prune(spark, sf_dir):
    monthly = P.discount_panel(spark, sf_dir).groupBy(F.last_day("dt").alias("period"), F.col("asset").alias("config")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    return S.correlation_prune(P.cut(monthly), 0.1)


_MONTHLY = f"{BRAND}, mo AS (SELECT asset, last_day(dt) AS dt, product(1 + ret) - 1 AS ret FROM p GROUP BY 1, 2)"


def monthly(spark, sf_dir):
    return P.discount_panel(spark, sf_dir).groupBy("asset", F.last_day("dt").alias("dt")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


@register("yearly_tearsheet", f"""WITH {_MONTHLY} SELECT asset, year(dt) AS year, count(*) AS n, round(product(1 + ret) - 1, 8) AS total, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 8) AS sharpe,
round(count(*) FILTER (WHERE ret > 0) / count(*), 8) AS hit_rate, round(quantile_cont(ret, 0.05), 8) AS quantile FROM mo GROUP BY 1, 2""")
def yearly_tearsheet(spark, sf_dir):
    """Metrics by named period, here calendar years."""
    sharpe = F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * math.sqrt(12)
    made = {"total": F.product(1 + F.col("ret")) - 1, "sharpe": sharpe, "hit_rate": F.count_if(F.col("ret") > 0) / F.count("*"), "quantile": F.percentile("ret", F.lit(0.05))}
    return monthly(spark, sf_dir).groupBy("asset", F.year("dt").cast("long").alias("year")).agg(F.count("*").alias("n"), *[F.round(c, 8).alias(n) for n, c in made.items()])


@register("contiguous_segments", f"""WITH {BRAND}, g AS (SELECT asset, dt, CASE WHEN dt - lag(dt) OVER (PARTITION BY asset ORDER BY dt) > 7 THEN 1 ELSE 0 END AS fresh FROM p),
s AS (SELECT asset, dt, sum(fresh) OVER (PARTITION BY asset ORDER BY dt) AS seg FROM g)
SELECT asset, min(dt) AS first, max(dt) AS last, count(*) AS n FROM s GROUP BY asset, seg HAVING count(*) >= 20""")
def contiguous_segments(spark, sf_dir, gap: int = 7, least: int = 20):
    """Runs of rows without a gap of over ``gap`` days, of ``least`` rows or more."""
    from pyspark.sql import Window as W

    w = W.partitionBy("asset").orderBy("dt")
    fresh = F.coalesce(F.datediff("dt", F.lag("dt").over(w)) > gap, F.lit(False)).cast("int")
    runs = P.discount_panel(spark, sf_dir).withColumn("fresh", fresh).withColumn("seg", F.sum("fresh").over(w))
    return runs.groupBy("asset", "seg").agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("seg")


@register("calendar_cagr", f"""WITH {BRAND}, q AS (SELECT asset, dt, 100 * product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS price FROM p)
SELECT asset, round(pow(max_by(price, dt) / min_by(price, dt), 365.25 / (max(dt) - min(dt))) - 1, 8) AS cagr FROM q GROUP BY asset HAVING max(dt) > min(dt)""")
def calendar_cagr(spark, sf_dir):
    growth = F.max_by("price", "dt") / F.min_by("price", "dt")
    out = P.prices(P.discount_panel(spark, sf_dir)).groupBy("asset").agg(growth.alias("g"), F.datediff(F.max("dt"), F.min("dt")).alias("d")).where("d > 0")
    return out.select("asset", F.round(F.pow("g", 365.25 / F.col("d")) - 1, 8).alias("cagr"))


@register("stability_count", f"""WITH {BRAND}, y AS (SELECT asset, (year(dt) - 1994) // 2 AS part, ret FROM p),
s AS (SELECT asset, part, count(*) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr FROM y GROUP BY 1, 2)
SELECT asset, count(*) FILTER (WHERE n > 20 AND sr > 0) AS positive, count(*) FILTER (WHERE n > 20 AND sr > 0) >= 3 AS stable FROM s GROUP BY asset""")
def stability_count(spark, sf_dir):
    """Sub-windows (two years each) with over 20 rows and a positive Sharpe ratio; stable from three on."""
    parts = P.discount_panel(spark, sf_dir).groupBy("asset", F.floor((F.year("dt") - 1994) / 2).alias("part")).agg(
        F.count("*").alias("n"), (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sr")
    )
    positive = F.count_if((F.col("n") > 20) & (F.col("sr") > 0))
    return parts.groupBy("asset").agg(positive.alias("positive"), (positive >= 3).alias("stable"))


@register("overlay_on_core", f"""WITH {_MONTHLY}, core AS (SELECT dt, avg(ret) AS core FROM mo GROUP BY dt),
j AS (SELECT core.dt, core, ret - core AS ov, core + 0.15 * (ret - core) AS comb FROM core JOIN mo ON mo.dt = core.dt AND asset = 'Brand#1'),
nav AS (SELECT *, product(1 + core) OVER (ORDER BY dt) AS a, product(1 + comb) OVER (ORDER BY dt) AS b FROM j),
d AS (SELECT *, 1 - a / max(a) OVER (ORDER BY dt) AS da, 1 - b / max(b) OVER (ORDER BY dt) AS db, quantile_cont(core, 0.1) OVER () AS q FROM nav),
o AS (SELECT max(da) AS cd, max(db) AS bd, (pow(product(1 + core), 12.0 / count(*)) - 1) / max(da) AS cc, (pow(product(1 + comb), 12.0 / count(*)) - 1) / max(db) AS bc, product(1 + ov) - 1 AS cum, corr(ov, core) AS cf,
  CASE WHEN count(*) FILTER (WHERE core <= q) >= 3 THEN corr(ov, core) FILTER (WHERE core <= q) END AS cs FROM d)
SELECT round(cd, 8) AS core_maxdd, round(bd, 8) AS combined_maxdd, round(cc, 8) AS core_calmar, round(bc, 8) AS combined_calmar, round(cum, 8) AS overlay_cum, round(cf, 8) AS corr_full, round(cs, 8) AS corr_stress,
  bd < cd AS criterion_a, bc > cc AS criterion_b, cum >= 0 AS criterion_c, cf <= 0 AND coalesce(cs <= 0, false) AS criterion_d, bd < cd AND bc > cc AND cum >= 0 AND cf <= 0 AND coalesce(cs <= 0, false) AS passed FROM o""")
def overlay_on_core(spark, sf_dir):
    """A 15 % overlay (one brand over the mean) on the equal-weight core, by month."""
    mo = monthly(spark, sf_dir)
    core = mo.groupBy("dt").agg(F.avg("ret").alias("core"))
    j = core.join(mo.where("asset = 'Brand#1'"), "dt").select("dt", "core", (F.col("ret") - F.col("core")).alias("overlay"))
    out = B.overlay_on_core(j, 0.15)
    numbers = ("core_maxdd", "combined_maxdd", "core_calmar", "combined_calmar", "overlay_cum", "corr_full", "corr_stress")
    return out.select(*r8(*numbers), *[f"criterion_{c}" for c in "abcd"], "passed")
