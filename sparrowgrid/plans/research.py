"""Queries of cross-sectional research: signals, simulations, validation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..registry import register
from ..sources import panel as P
from .panels import held, r8
from . import universes
from .sql import BRAND, LOG
from .universes import ALL, BASKETS, SNAP

_MARKS = f"""{BRAND}, f AS (SELECT last_day(dt) AS formation, max(day_ix) AS day_ix FROM p GROUP BY 1),
w AS (SELECT formation, a.asset, count(ret) AS n, product(1 + ret) - 1 AS mom FROM f CROSS JOIN (SELECT DISTINCT asset FROM p) a
  LEFT JOIN p ON p.asset = a.asset AND p.day_ix BETWEEN f.day_ix - 251 AND f.day_ix - 21 GROUP BY 1, 2),
s AS (SELECT formation, asset, CASE WHEN n >= 100 THEN mom END AS score FROM w),
hd AS (SELECT last_day(dt - INTERVAL 1 MONTH) AS formation, dt, asset, ret FROM p),
fd AS (SELECT formation, min(dt) AS first FROM hd GROUP BY 1 HAVING count(DISTINCT dt) >= 2),
m AS (SELECT hd.formation, asset, product(1 + ret) - 1 AS month_ret FROM hd JOIN fd ON hd.formation = fd.formation AND dt > first GROUP BY 1, 2)"""
_SIM = f"""{_MARKS}, e AS (SELECT s.* FROM s WHERE formation IN (SELECT formation FROM m)),
k AS (SELECT formation, row_number() OVER (ORDER BY formation) AS k, count(score) AS n_eligible FROM e GROUP BY formation),
r AS (SELECT formation, asset, ceil(count(*) OVER (PARTITION BY formation) * 0.2) AS n_top, row_number() OVER (PARTITION BY formation ORDER BY score DESC, asset) AS rn FROM e WHERE score IS NOT NULL),
h AS (SELECT k, r.asset, 1.0 / n_top AS w, coalesce(month_ret, 0) AS mr FROM r JOIN k USING (formation) LEFT JOIN m ON m.formation = r.formation AND m.asset = r.asset WHERE rn <= n_top AND n_top >= 3),
d AS (SELECT k + 1 AS k, asset, CASE WHEN sum(w * (1 + mr)) OVER (PARTITION BY k) > 0 THEN w * (1 + mr) / sum(w * (1 + mr)) OVER (PARTITION BY k) ELSE w END AS d FROM h),
t AS (SELECT coalesce(h.k, d.k) AS k, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover FROM h FULL JOIN d ON h.k = d.k AND h.asset = d.asset GROUP BY 1),
g AS (SELECT k, sum(w * mr) AS gross, count(*) AS n_held FROM h GROUP BY 1)"""


def momentum_scores(spark, sf_dir, min_obs: int, asset: str = "brand"):
    """(scores, panel), both written: what follows reads them several times."""
    p = held(spark, sf_dir, asset)
    return P.cut(B.momentum_12_1(p, p.select(F.last_day("dt").alias("formation")).distinct(), min_obs=min_obs)), p


def simulate(spark, sf_dir, min_obs: int = 100, decile: float = 0.2, min_names: int = 3):
    scores, p = momentum_scores(spark, sf_dir, min_obs)
    out = B.simulate_monthly(scores, p, decile, min_names)
    return out.select("formation", "n_eligible", "n_held", *r8("gross", "turnover", "cost", "net"))


def flagship(spark, sf_dir):
    return simulate(spark, sf_dir, min_obs=10)


@register("momentum_12_1", f"WITH {_MARKS} SELECT formation, asset, round(score, 8) AS score FROM s")
def momentum(spark, sf_dir):
    return momentum_scores(spark, sf_dir, 100)[0].select("formation", "asset", *r8("score"))


@register("simulate_monthly", f"""WITH {_SIM} SELECT formation, n_eligible, coalesce(n_held, 0) AS n_held, round(coalesce(gross, 0), 8) AS gross, round(coalesce(turnover, 0), 8) AS turnover,
round(coalesce(turnover, 0) * 0.001, 8) AS cost, round(coalesce(gross, 0) - coalesce(turnover, 0) * 0.001, 8) AS net FROM k LEFT JOIN g USING (k) LEFT JOIN t USING (k)""")
def simulate_monthly(spark, sf_dir):
    return simulate(spark, sf_dir)


def _sim_sql(decile: float, least: int, members: str) -> str:
    """The same simulation among the members of a basket, with their coverage."""
    return f"""b AS (SELECT snapshot_dt AS formation, asset FROM {members} WHERE snapshot_dt IN (SELECT formation FROM fd)), e AS (SELECT s.* FROM s JOIN b USING (formation, asset)),
k AS (SELECT formation, row_number() OVER (ORDER BY formation) AS k, count(*) AS n_members FROM b GROUP BY formation),
r AS (SELECT formation, asset, ceil(count(*) OVER (PARTITION BY formation) * {decile}) AS n_top, row_number() OVER (PARTITION BY formation ORDER BY score DESC, asset) AS rn FROM e WHERE score IS NOT NULL),
h AS (SELECT k, r.asset, 1.0 / n_top AS w, coalesce(month_ret, 0) AS mr FROM r JOIN k USING (formation) LEFT JOIN m ON m.formation = r.formation AND m.asset = r.asset WHERE rn <= n_top AND n_top >= {least}),
d AS (SELECT k + 1 AS k, asset, CASE WHEN sum(w * (1 + mr)) OVER (PARTITION BY k) > 0 THEN w * (1 + mr) / sum(w * (1 + mr)) OVER (PARTITION BY k) ELSE w END AS d FROM h),
t AS (SELECT coalesce(h.k, d.k) AS k, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover FROM h FULL JOIN d ON h.k = d.k AND h.asset = d.asset GROUP BY 1),
g AS (SELECT k, sum(w * mr) AS gross, count(*) AS n_held FROM h GROUP BY 1), el AS (SELECT formation, count(score) AS n_eligible FROM e GROUP BY 1),
cv AS (SELECT b.formation, count(m.asset) / count(*) AS coverage FROM b LEFT JOIN m ON m.formation = b.formation AND m.asset = b.asset GROUP BY 1)
SELECT formation, n_members, coalesce(n_eligible, 0) AS n_eligible, coalesce(n_held, 0) AS n_held, round(coverage, 8) AS coverage, round(coalesce(gross, 0), 8) AS gross, round(coalesce(turnover, 0), 8) AS turnover,
  round(coalesce(turnover, 0) * 0.001, 8) AS cost, round(coalesce(gross, 0) - coalesce(turnover, 0) * 0.001, 8) AS net FROM k LEFT JOIN g USING (k) LEFT JOIN t USING (k) LEFT JOIN el USING (formation) JOIN cv USING (formation)"""


SUPPLIER = BRAND.replace("p_brand AS asset", "l_suppkey AS asset").replace("FROM lineitem JOIN part ON l_partkey = p_partkey", "FROM lineitem")


@register("pit_simulation", f"""WITH {_MARKS.replace(BRAND, SUPPLIER).replace("n >= 100", "n >= 20")}, {LOG}, {SNAP}, {ALL}, {BASKETS}, {_sim_sql(0.2, 1, "bk")}""")
def pit_simulation(spark, sf_dir):
    """Momentum among the members of each month's basket alone: the point-in-time universe."""
    scores, p = momentum_scores(spark, sf_dir, 20, "supplier")
    basket = universes.baskets(spark, sf_dir).withColumnRenamed("snapshot_dt", "formation")
    out = B.simulate_monthly(scores, p, 0.2, 1, baskets=P.cut(basket))
    return out.select("formation", "n_members", "n_eligible", "n_held", *r8("coverage", "gross", "turnover", "cost", "net"))


_IC = f"""{_MARKS}, fw AS (SELECT f.formation, a.asset, coalesce(product(1 + ret), 1) - 1 AS fwd FROM (SELECT DISTINCT formation FROM hd) f CROSS JOIN (SELECT DISTINCT asset FROM p) a
  LEFT JOIN hd ON hd.formation = f.formation AND hd.asset = a.asset GROUP BY 1, 2),
j AS (SELECT s.formation, s.asset, score, fwd FROM s JOIN fw USING (formation, asset) WHERE score IS NOT NULL),
q AS (SELECT *, rank() OVER (PARTITION BY formation ORDER BY score) + (count(*) OVER (PARTITION BY formation, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY formation ORDER BY fwd) + (count(*) OVER (PARTITION BY formation, fwd) - 1) / 2.0 AS b FROM j),
ic AS (SELECT formation, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS ic FROM q GROUP BY 1)"""


def _rank_ic(spark, sf_dir):
    scores, p = momentum_scores(spark, sf_dir, 100)
    return B.rank_ic(scores, B.forward_returns(p))


@register("rank_ic", f"WITH {_IC} SELECT formation, n, round(ic, 8) AS ic FROM ic")
def rank_ic(spark, sf_dir):
    return _rank_ic(spark, sf_dir).select("formation", "n", *r8("ic"))


@register("rank_ic_by_year", f"WITH {_IC} SELECT year(formation) AS year, round(avg(ic), 8) AS ic FROM ic GROUP BY 1")
def rank_ic_by_year(spark, sf_dir):
    return _rank_ic(spark, sf_dir).groupBy(F.year("formation").cast("long").alias("year")).agg(F.round(F.avg("ic"), 8).alias("ic"))


_MONTHS = f"""{BRAND}, mo AS (SELECT last_day(dt) AS m, asset AS config, product(1 + ret) - 1 AS ret FROM p GROUP BY 1, 2),
x AS (SELECT dense_rank() OVER (ORDER BY m) - 1 AS t, config, ret FROM mo), z AS (SELECT max(t) + 1 AS n FROM x),
pt AS (SELECT config, CASE WHEN t < (n % 16) * (n // 16 + 1) THEN t // (n // 16 + 1) ELSE n % 16 + (t - (n % 16) * (n // 16 + 1)) // (n // 16) END AS part, ret FROM x, z),
sp AS (SELECT i AS split FROM range(65536) r(i) WHERE bit_count(i) = 8),
sr AS (SELECT split, config, avg(ret) FILTER (WHERE (split >> part) & 1 = 1) / stddev_samp(ret) FILTER (WHERE (split >> part) & 1 = 1) AS a,
  avg(ret) FILTER (WHERE (split >> part) & 1 = 0) / stddev_samp(ret) FILTER (WHERE (split >> part) & 1 = 0) AS b FROM pt, sp GROUP BY 1, 2),
rk AS (SELECT *, (rank() OVER (PARTITION BY split ORDER BY b) + (count(*) OVER (PARTITION BY split, b) - 1) / 2.0) / count(*) OVER (PARTITION BY split) AS w,
  row_number() OVER (PARTITION BY split ORDER BY a DESC, config) AS rn FROM sr),
lg AS (SELECT split, config AS best, ln(least(greatest(w, 1e-6), 1 - 1e-6) / (1 - least(greatest(w, 1e-6), 1 - 1e-6))) AS logit FROM rk WHERE rn = 1)"""


def _monthly_matrix(spark, sf_dir):
    from pyspark.sql import Window as W

    mo = P.discount_panel(spark, sf_dir).groupBy(F.last_day("dt").alias("m"), F.col("asset").alias("config")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    ix = mo.select("m").distinct().withColumn("period_ix", F.row_number().over(W.orderBy("m")) - 1)  # one row a month
    return mo.join(F.broadcast(ix), "m").select("period_ix", "config", "ret")


@register("pbo_splits", f"WITH {_MONTHS} SELECT split, best, round(logit, 6) AS logit FROM lg")
def pbo_splits(spark, sf_dir):
    return B.pbo_splits(P.cut(_monthly_matrix(spark, sf_dir))).select("split", "best", F.round("logit", 6).alias("logit"))


@register("pbo", f"WITH {_MONTHS} SELECT count(*) AS n, round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END), 8) AS pbo FROM lg")
def pbo(spark, sf_dir):
    s = B.pbo_splits(P.cut(_monthly_matrix(spark, sf_dir)))
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)), 8).alias("pbo"))
