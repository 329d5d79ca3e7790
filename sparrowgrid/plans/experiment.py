"""The composed cross-sectional experiment on the supplier panel and its point-in-time baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import backtest as B
from ..operators import experiment as X
from ..operators import search as S
from ..registry import register
from ..sources import panel as P
from . import universes
from .accounts import fixed_mix
from .books import _PHI
from .panels import held
from .research import SUPPLIER
from .search import C0, SCORES, VIEWS
from .sql import BRAND, LOG
from .universes import ALL, BASKETS, SNAP

TRAIN_END = "1997-06-30"
DECILE, MIN_NAMES, BETA_OBS = 0.2, 3, 8
_OWN = ", ".join(f"-round(stddev_samp(resid) FILTER (WHERE day_ix > last_ix - {d}), {S.DIGITS}) AS idiovol{d}" for d in S.WINDOWS["idiovol"])
_LAST = max(S.WINDOWS["idiovol"]) + 60
#: Scores of the members of each month's basket; their market is the basket's own.
_SPACE = f"""{SUPPLIER}, {LOG}, {SNAP}, {ALL}, {BASKETS}, {VIEWS}, {C0.replace("c AS (", "ca AS (", 1)},
b0 AS (SELECT snapshot_dt AS formation, asset FROM bk WHERE snapshot_dt IN (SELECT formation FROM fo)),
hb AS (SELECT b0.formation, b0.asset, fo.day_ix AS last_ix, p.day_ix, ret FROM b0 JOIN fo ON fo.formation = b0.formation JOIN p ON p.asset = b0.asset AND p.day_ix BETWEEN fo.day_ix - {_LAST - 1} AND fo.day_ix),
hm AS (SELECT *, avg(ret) OVER (PARTITION BY formation, day_ix) AS mkt FROM hb),
hr AS (SELECT *, CASE WHEN count(ret) OVER v >= {BETA_OBS} THEN ret - covar_samp(ret, mkt) OVER v / nullif(var_samp(mkt) OVER v, 0) * mkt END AS resid FROM hm
  WINDOW v AS (PARTITION BY formation, asset ORDER BY day_ix RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
own AS (SELECT formation, asset, {_OWN} FROM hr GROUP BY 1, 2),
c AS (SELECT ca.* REPLACE ({", ".join(f"own.idiovol{d} AS idiovol{d}" for d in S.WINDOWS["idiovol"])}) FROM ca JOIN b0 ON b0.formation = ca.formation AND b0.asset = ca.asset
  LEFT JOIN own ON own.formation = ca.formation AND own.asset = ca.asset),
{SCORES}"""
_MATRIX = f"""{_SPACE}, hd AS (SELECT last_day(dt - INTERVAL 1 MONTH) AS formation, dt, asset, ret FROM p),
fd AS (SELECT formation, min(dt) AS first FROM hd GROUP BY 1 HAVING count(DISTINCT dt) >= 2),
mr AS (SELECT hd.formation, asset, product(1 + ret) - 1 AS month_ret FROM hd JOIN fd ON hd.formation = fd.formation AND dt > first GROUP BY 1, 2),
bx AS (SELECT DISTINCT formation, CASE WHEN formation <= DATE '{TRAIN_END}' THEN 'train' ELSE 'holdout' END AS part FROM b0 WHERE formation IN (SELECT formation FROM fd)),
e AS (SELECT s.*, part FROM s JOIN bx USING (formation) WHERE score IS NOT NULL),
kk AS (SELECT config, part, formation, row_number() OVER (PARTITION BY config, part ORDER BY formation) AS k FROM bx, (SELECT DISTINCT config FROM s WHERE score IS NOT NULL)),
rr AS (SELECT config, part, formation, asset, ceil(count(*) OVER (PARTITION BY config, formation) * {DECILE}) AS n_top, row_number() OVER (PARTITION BY config, formation ORDER BY score DESC, asset) AS rn FROM e),
hh AS (SELECT config, part, k, rr.asset, 1.0 / n_top AS w, coalesce(month_ret, 0) AS mr FROM rr JOIN kk USING (config, part, formation) LEFT JOIN mr ON mr.formation = rr.formation AND mr.asset = rr.asset WHERE rn <= n_top AND n_top >= {MIN_NAMES}),
dd AS (SELECT config, part, k + 1 AS k, asset, CASE WHEN sum(w * (1 + mr)) OVER b > 0 THEN w * (1 + mr) / sum(w * (1 + mr)) OVER b ELSE w END AS d FROM hh WINDOW b AS (PARTITION BY config, part, k)),
tt AS (SELECT coalesce(hh.config, dd.config) AS config, coalesce(hh.part, dd.part) AS part, coalesce(hh.k, dd.k) AS k, sum(abs(coalesce(w, 0) - coalesce(d, 0))) AS turnover
  FROM hh FULL JOIN dd ON hh.config = dd.config AND hh.part = dd.part AND hh.k = dd.k AND hh.asset = dd.asset GROUP BY 1, 2, 3),
gg AS (SELECT config, part, k, sum(w * mr) AS gross FROM hh GROUP BY 1, 2, 3),
net AS (SELECT config, part, formation, coalesce(gross, 0) - coalesce(turnover, 0) * 0.001 AS ret FROM kk LEFT JOIN gg USING (config, part, k) LEFT JOIN tt USING (config, part, k))"""
_PRUNED = f"""{_MATRIX}, tr AS (SELECT * FROM net WHERE part = 'train'),
cc AS (SELECT x.config AS a, y.config AS b, corr(x.ret, y.ret) AS c FROM tr x JOIN tr y ON x.formation = y.formation AND x.config < y.config GROUP BY 1, 2), near AS (SELECT b, list(a) AS near FROM cc WHERE abs(c) <= 0.7 GROUP BY 1),
names AS (SELECT config, coalesce(near, []) AS near, row_number() OVER (ORDER BY config) AS k FROM (SELECT DISTINCT config FROM tr) LEFT JOIN near ON b = config),
f(k, kept) AS (SELECT cast(0 AS bigint), []::varchar[] UNION ALL SELECT names.k, CASE WHEN list_has_all(near, kept) THEN list_append(kept, config) ELSE kept END FROM f JOIN names ON names.k = f.k + 1),
ke AS (SELECT unnest(kept) AS config FROM f WHERE k = (SELECT max(k) FROM names))"""
_SR = "coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 0)"


def _matrix(spark, sf_dir):
    p = held(spark, sf_dir, "supplier")
    baskets = universes.baskets(spark, sf_dir).withColumnRenamed("snapshot_dt", "formation")
    return (p, *X.return_matrix(p, baskets, TRAIN_END, DECILE, MIN_NAMES, beta_obs=BETA_OBS))


def _forward(p):
    """Rounded, so that ties do not depend on the order of products."""
    return P.cut(B.forward_returns(p).withColumn("fwd", F.round("fwd", S.DIGITS)))


@register("pruned_space", f"WITH RECURSIVE {_PRUNED} SELECT config FROM ke")
def pruned_space(spark, sf_dir):
    """The configurations of the point-in-time space that pruning at 0.7 keeps, on the search window."""
    _, _, returns = _matrix(spark, sf_dir)
    return S.correlation_prune(returns.where("part = 'train'").select(F.col("formation").alias("period"), "config", "ret"))


@register("basket_rank_ic", f"""WITH {_SPACE}, hd AS (SELECT last_day(dt - INTERVAL 1 MONTH) AS formation, dt, asset, ret FROM p),
fw AS (SELECT f.formation, a.asset, round(coalesce(product(1 + ret), 1) - 1, {S.DIGITS}) AS fwd FROM (SELECT DISTINCT formation FROM hd) f CROSS JOIN (SELECT DISTINCT asset FROM p) a
  LEFT JOIN hd ON hd.formation = f.formation AND hd.asset = a.asset GROUP BY 1, 2),
j AS (SELECT config, s.formation, s.asset, round(score, {S.DIGITS}) AS score, fwd FROM s JOIN fw USING (formation, asset) WHERE score IS NOT NULL),
q AS (SELECT *, rank() OVER (PARTITION BY config, formation ORDER BY score) + (count(*) OVER (PARTITION BY config, formation, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY config, formation ORDER BY fwd) + (count(*) OVER (PARTITION BY config, formation, fwd) - 1) / 2.0 AS b FROM j WHERE formation >= DATE '1996-01-01'),
ic AS (SELECT config, formation, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS ic FROM q GROUP BY 1, 2)
SELECT config, formation, n, CASE WHEN NOT isnan(ic) THEN round(ic, 4) + 0.0 END AS ic FROM ic""")
def basket_rank_ic(spark, sf_dir):
    """Rank IC of every configuration within each month's basket, from 1996 on, when all windows are filled."""
    p = held(spark, sf_dir, "supplier")
    baskets = universes.baskets(spark, sf_dir).withColumnRenamed("snapshot_dt", "formation")
    months = p.select(F.last_day("dt").alias("formation")).distinct().where("formation >= '1996-01-01'")
    members = P.cut(baskets.join(F.broadcast(months), "formation"))  # one row a month
    scores = S.search_space(p, members.select("formation").distinct(), beta_obs=BETA_OBS, baskets=members)
    out = B.rank_ic(scores.withColumn("score", F.round("score", S.DIGITS)), _forward(p), "config", "formation")
    return out.select("config", "formation", "n", (F.round("ic", 4) + 0.0).alias("ic"))


@register("cross_sectional_experiment", f"""WITH RECURSIVE {_PRUNED}, x AS (SELECT dense_rank() OVER (ORDER BY formation) - 1 AS t, config, ret FROM tr JOIN ke USING (config)), z AS (SELECT max(t) + 1 AS n FROM x),
pt AS (SELECT config, CASE WHEN t < (n % 16) * (n // 16 + 1) THEN t // (n // 16 + 1) ELSE n % 16 + (t - (n % 16) * (n // 16 + 1)) // (n // 16) END AS part, ret FROM x, z),
sp AS (SELECT i AS split FROM range(65536) r(i) WHERE bit_count(i) = 8),
sr AS (SELECT split, config, avg(ret) FILTER (WHERE (split >> part) & 1 = 1) / nullif(stddev_samp(ret) FILTER (WHERE (split >> part) & 1 = 1), 0) AS a,
  avg(ret) FILTER (WHERE (split >> part) & 1 = 0) / nullif(stddev_samp(ret) FILTER (WHERE (split >> part) & 1 = 0), 0) AS b FROM pt, sp GROUP BY 1, 2),
rk AS (SELECT split, a, CASE WHEN b IS NOT NULL THEN (rank() OVER (PARTITION BY split, b IS NULL ORDER BY b) + (count(*) OVER (PARTITION BY split, b) - 1) / 2.0) / count(b) OVER (PARTITION BY split) END AS w,
  row_number() OVER (PARTITION BY split ORDER BY a DESC NULLS LAST, config) AS rn FROM sr),
pb AS (SELECT count(*) AS n_splits, avg(CASE WHEN w <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM rk WHERE rn = 1 AND a IS NOT NULL AND w IS NOT NULL),
st AS (SELECT config, count(*) AS n, {_SR} AS sharpe, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS g, kurtosis_pop(ret) + 3 AS k FROM tr JOIN ke USING (config) GROUP BY 1),
be AS (SELECT * FROM st ORDER BY sharpe DESC, config LIMIT 1),
zz AS (SELECT config AS best, sharpe AS sharpe_is, (sr - {M.expected_max_sharpe(X.SPACE, 1)!r} / sqrt(n)) * sqrt(n - 1) / sqrt(greatest(1 - g * sr + (k - 1) / 4 * sr * sr, 1e-12)) AS z FROM be),
ds AS (SELECT best, sharpe_is, {_PHI} AS dsr FROM zz),
ho AS (SELECT last_day(formation + INTERVAL 1 DAY) AS dt, formation, ret FROM net WHERE part = 'holdout' AND config = (SELECT config FROM be)),
hs AS (SELECT count(*) AS months, CASE WHEN count(*) > 0 THEN {_SR} END AS sharpe_holdout FROM ho),
brand AS (WITH {BRAND} SELECT * FROM p), mo AS (SELECT asset, last_day(dt) AS dt, product(1 + ret) - 1 AS ret FROM brand WHERE asset IN ('Brand#1', 'Brand#2') GROUP BY 1, 2),
mx AS (SELECT dt, sum(CASE asset WHEN 'Brand#1' THEN 0.6 ELSE 0.4 END * ret) AS ret FROM mo GROUP BY dt HAVING count(*) = 2),
ms AS (SELECT CASE WHEN count(*) > 0 THEN {_SR} END AS sharpe_mix FROM (SELECT mx.ret FROM mx JOIN ho USING (dt))),
fw AS (SELECT f.formation, a.asset, round(coalesce(product(1 + ret), 1) - 1, {S.DIGITS}) AS fwd FROM (SELECT DISTINCT formation FROM ho) f CROSS JOIN (SELECT DISTINCT asset FROM p) a LEFT JOIN hd ON hd.formation = f.formation AND hd.asset = a.asset GROUP BY 1, 2),
j AS (SELECT s.formation, round(score, {S.DIGITS}) AS score, fwd FROM s JOIN fw USING (formation, asset) WHERE score IS NOT NULL AND config = (SELECT config FROM be)),
q AS (SELECT formation, rank() OVER (PARTITION BY formation ORDER BY score) + (count(*) OVER (PARTITION BY formation, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY formation ORDER BY fwd) + (count(*) OVER (PARTITION BY formation, fwd) - 1) / 2.0 AS b FROM j),
ic AS (SELECT formation, corr(a, b) AS ic FROM q GROUP BY 1 HAVING count(*) >= 3), iy AS (SELECT year(formation + INTERVAL 1 DAY) AS y, avg(ic) AS ic FROM ic WHERE NOT isnan(ic) GROUP BY 1),
o AS (SELECT {X.SPACE}::bigint AS n_configs, (SELECT count(*) FROM ke) AS n_kept, n_splits, pbo, best, sharpe_is, dsr, months, sharpe_holdout, sharpe_mix, (SELECT min(ic) FROM iy) AS worst_ic FROM pb, ds, hs, ms),
v AS (SELECT *, coalesce(pbo < 0.5, false) AS pbo_ok, coalesce(dsr > 0.95, false) AS dsr_ok, coalesce(sharpe_holdout > sharpe_mix, false) AND coalesce(worst_ic > 0, false) AS holdout_ok FROM o)
SELECT n_configs, n_kept, n_splits, round(pbo, 6) AS pbo, best, round(sharpe_is, 6) AS sharpe_is, round(dsr, 6) AS dsr, months, round(sharpe_holdout, 6) AS sharpe_holdout, round(sharpe_mix, 6) AS sharpe_mix,
  round(worst_ic, 6) AS worst_ic, pbo_ok, dsr_ok, holdout_ok, CASE WHEN pbo_ok AND dsr_ok AND holdout_ok THEN 'CANDIDATE' ELSE 'KILL' END AS verdict FROM v""")
def cross_sectional_experiment(spark, sf_dir):
    """Search, pruning, overfitting, deflation, holdout and verdict in one row."""
    p, scores, returns = _matrix(spark, sf_dir)
    out = X.judge(scores, returns, _forward(p), fixed_mix(spark, sf_dir))
    numbers = {"pbo", "sharpe_is", "dsr", "sharpe_holdout", "sharpe_mix", "worst_ic"}
    return out.select(*[F.round(c, 6).alias(c) if c in numbers else c for c in out.columns])
