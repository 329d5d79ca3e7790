"""Queries of costs on a running NAV, grids, liquidity, spliced and lagged series, the daily report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import engine as E
from ..operators import regime as G
from ..operators import report as R
from ..registry import register
from ..sources import panel as P
from .macro import _SERIES, series
from .panels import held, r8
from .portfolios import _DATES, _IV, _weights
from .sql import BRAND

_LIQUIDITY = """liq AS (SELECT p.asset, p.dt, p.day_ix, sum(cast(round(l_extendedprice * 100) AS bigint)) / 100.0 AS adv, sum(cast(round(l_tax * 100) AS bigint)) / (100.0 * count(*)) / 100 AS spread
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN p ON p.asset = p_brand AND p.dt = cast(l_shipdate AS date) GROUP BY 1, 2, 3)"""
_SPELLS = """kk AS (SELECT signal_ix, row_number() OVER (ORDER BY signal_ix) AS k, signal_ix + 1 AS a, coalesce(lead(signal_ix) OVER (ORDER BY signal_ix) + 1, 1e15) AS z FROM (SELECT DISTINCT signal_ix FROM iv)),
wk AS (SELECT kk.k, a, z, asset, w FROM iv JOIN kk USING (signal_ix)), d AS (SELECT DISTINCT dt, day_ix FROM p),
g AS (SELECT d.dt, d.day_ix, wk.k, wk.a, sum(w * coalesce(ret, 0)) AS gross FROM d JOIN wk ON d.day_ix >= a AND d.day_ix < z LEFT JOIN p ON p.dt = d.dt AND p.asset = wk.asset GROUP BY 1, 2, 3, 4)"""


def liquidity(spark, sf_dir) -> DataFrame:
    """(asset, dt, adv, spread) of the brands, from exact integer sums."""
    parts = P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    lines = P.read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_tax").join(parts, "l_partkey")
    return lines.groupBy("asset", F.col("l_shipdate").cast("date").alias("dt")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("adv"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / (F.count("*") * F.lit(100.0)) / 100).alias("spread"),
    )


@register("walk_forward_impact", f"""WITH RECURSIVE {_IV}, {_LIQUIDITY}, {_SPELLS},
tr AS (SELECT n.k, n.a, n.asset, abs(n.w - coalesce(o.w, 0)) AS dw FROM wk n LEFT JOIN wk o ON o.k = n.k - 1 AND o.asset = n.asset WHERE n.k > 1),
vol AS (SELECT kk.k, asset, stddev_samp(ret) AS v FROM kk JOIN p ON p.day_ix < kk.a AND p.day_ix >= kk.a - 63 GROUP BY 1, 2),
tl AS (SELECT tr.*, greatest(coalesce(l.adv, 1), 1) AS adv, greatest(coalesce(l.spread, 0.001), 0) AS spread FROM tr ASOF LEFT JOIN liq l ON tr.asset = l.asset AND tr.a >= l.day_ix),
te AS (SELECT k, sum(dw * spread / 2) AS a0, sum(0.1 * greatest(coalesce(v, 0.01), 1e-6) * dw * dw / adv) AS b0, sum(0.1 * greatest(coalesce(v, 0.01), 1e-6) * dw * dw * dw / (adv * adv)) AS c0
  FROM tl LEFT JOIN vol USING (k, asset) GROUP BY k),
st AS (SELECT g.k, g.a, max(gross) FILTER (WHERE day_ix = g.a) AS f0, coalesce(product(1 + gross) FILTER (WHERE day_ix > g.a), 1) AS rest, coalesce(max(a0), 0) AS a0, coalesce(max(b0), 0) AS b0, coalesce(max(c0), 0) AS c0
  FROM g LEFT JOIN te USING (k) GROUP BY 1, 2),
f(k, a, nav, cost) AS (SELECT k, a, cast(1e7 * (1 + f0) * rest AS double), cast(0 AS double) FROM st WHERE k = 1
  UNION ALL SELECT st.k, st.a, nav * (1 + f0 - (a0 + b0 * nav + c0 * nav * nav)) * rest, a0 + b0 * nav + c0 * nav * nav FROM f JOIN st ON st.k = f.k + 1)
SELECT d.dt, round(coalesce(gross, 0) - coalesce(cost, 0), 8) AS ret, round(coalesce(cost, 0), 8) AS cost FROM d LEFT JOIN g USING (dt) LEFT JOIN f ON f.a = d.day_ix""")
def walk_forward_impact(spark, sf_dir):
    p, w = _weights(spark, sf_dir)
    liquid = P.with_day_ix(liquidity(spark, sf_dir), p).select("asset", "day_ix", "adv", "spread")
    return E.run_with_impact(p, w, P.cut(liquid), capital=1e7).select("dt", *r8("ret", "cost"))


_LOOKBACKS = (63, 126, 252)


@register("parameter_grid", f"""WITH {_DATES}, cfg(lookback) AS (VALUES {', '.join(f'({x})' for x in _LOOKBACKS)}),
sd AS (SELECT lookback, signal_ix, asset, stddev_samp(ret) AS sd, count(*) AS n FROM cfg, p JOIN rd ON day_ix < signal_ix WHERE day_ix >= signal_ix - lookback GROUP BY 1, 2, 3),
iv AS (SELECT lookback, signal_ix, asset, (1 / sd) / sum(1 / sd) OVER (PARTITION BY lookback, signal_ix) AS w FROM sd WHERE n >= 20 AND sd > 0),
kk AS (SELECT lookback, signal_ix, row_number() OVER s AS k, signal_ix + 1 AS a, coalesce(lead(signal_ix) OVER s + 1, 1e15) AS z FROM (SELECT DISTINCT lookback, signal_ix FROM iv) WINDOW s AS (PARTITION BY lookback ORDER BY signal_ix)),
wk AS (SELECT lookback, kk.k, a, z, asset, w FROM iv JOIN kk USING (lookback, signal_ix)),
c AS (SELECT n.lookback, n.a AS day_ix, sum(abs(n.w - coalesce(o.w, 0))) * 0.001 AS cost FROM wk n LEFT JOIN wk o ON o.lookback = n.lookback AND o.k = n.k - 1 AND o.asset = n.asset WHERE n.k > 1 GROUP BY 1, 2),
d AS (SELECT lookback, dt, day_ix FROM cfg, (SELECT DISTINCT dt, day_ix FROM p)),
g AS (SELECT d.lookback, d.day_ix, sum(w * coalesce(ret, 0)) AS gross FROM d JOIN wk ON d.lookback = wk.lookback AND d.day_ix >= a AND d.day_ix < z LEFT JOIN p ON p.dt = d.dt AND p.asset = wk.asset GROUP BY 1, 2),
r AS (SELECT d.lookback, d.day_ix, coalesce(gross, 0) - coalesce(cost, 0) AS ret, floor((row_number() OVER (PARTITION BY d.lookback ORDER BY d.day_ix) - 1) * 4 / count(*) OVER (PARTITION BY d.lookback)) AS part
  FROM d LEFT JOIN g USING (lookback, day_ix) LEFT JOIN c USING (lookback, day_ix)),
q AS (SELECT lookback, part, avg(ret) > 0 AND stddev_samp(ret) > 0 AND count(*) > 20 AS good FROM r GROUP BY 1, 2)
SELECT s.lookback, round(sharpe, 6) AS sharpe, stable FROM (SELECT lookback, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM r GROUP BY 1) s JOIN (SELECT lookback, count(*) FILTER (WHERE good) AS stable FROM q GROUP BY 1) t USING (lookback)""")
def parameter_grid(spark, sf_dir):
    """Sharpe ratio and stability of each lookback, all configurations in one plan."""
    p = held(spark, sf_dir)
    w = P.cut(E.inverse_volatility_grid(p, E.rebalance_dates(p), _LOOKBACKS, 20))
    returns = P.cut(E.run(p, w, 1, 10.0, 0.0, "lookback"))
    return E.grid_scores(returns, "lookback").select("lookback", F.round("sharpe", 6).alias("sharpe"), "stable")


_GRID = f"""WITH {_DATES}, cfg(lookback) AS (VALUES {', '.join(f'({x})' for x in _LOOKBACKS)}),
sd AS (SELECT lookback, signal_ix, asset, stddev_samp(ret) AS sd, count(*) AS n FROM cfg, p JOIN rd ON day_ix < signal_ix WHERE day_ix >= signal_ix - lookback GROUP BY 1, 2, 3),
iv AS (SELECT lookback, signal_ix, asset, (1 / sd) / sum(1 / sd) OVER (PARTITION BY lookback, signal_ix) AS w FROM sd WHERE n >= 20 AND sd > 0),
kk AS (SELECT lookback, signal_ix, row_number() OVER s AS k, signal_ix + 1 AS a, coalesce(lead(signal_ix) OVER s + 1, 1e15) AS z FROM (SELECT DISTINCT lookback, signal_ix FROM iv) WINDOW s AS (PARTITION BY lookback ORDER BY signal_ix)),
wk AS (SELECT lookback, kk.k, a, z, asset, w FROM iv JOIN kk USING (lookback, signal_ix)),
c AS (SELECT n.lookback, n.a AS day_ix, sum(abs(n.w - coalesce(o.w, 0))) * 0.001 AS cost FROM wk n LEFT JOIN wk o ON o.lookback = n.lookback AND o.k = n.k - 1 AND o.asset = n.asset WHERE n.k > 1 GROUP BY 1, 2),
d AS (SELECT lookback, dt, day_ix FROM cfg, (SELECT DISTINCT dt, day_ix FROM p)),
g AS (SELECT d.lookback, d.day_ix, sum(w * coalesce(ret, 0)) AS gross FROM d JOIN wk ON d.lookback = wk.lookback AND d.day_ix >= a AND d.day_ix < z LEFT JOIN p ON p.dt = d.dt AND p.asset = wk.asset GROUP BY 1, 2)"""


@register("cpcv_grid", f"""{_GRID}, r AS (SELECT d.lookback, d.dt, coalesce(gross, 0) - coalesce(cost, 0) AS ret FROM d LEFT JOIN g USING (lookback, day_ix) LEFT JOIN c USING (lookback, day_ix)),
ix AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS ix, (SELECT count(DISTINCT dt) FROM r) AS n FROM (SELECT DISTINCT dt FROM r)), l AS (SELECT dt, ix, least(ix + 21, n - 1) AS e, n FROM ix),
b AS (SELECT g AS grp, g * (n // 6) + least(g, n % 6) AS lo, (g + 1) * (n // 6) + least(g + 1, n % 6) AS hi, cast(floor(n * 0.01) AS bigint) AS em FROM range(6) x(g), (SELECT max(n) AS n FROM l)),
ro AS (SELECT dt, (1 << s.grp) + (1 << t.grp) AS split, CASE WHEN (ix >= s.lo AND ix < s.hi) OR (ix >= t.lo AND ix < t.hi) THEN 'test'
  WHEN (e >= s.lo AND e < s.hi) OR (e >= t.lo AND e < t.hi) OR (ix >= s.hi AND ix < s.hi + s.em) OR (ix >= t.hi AND ix < t.hi + t.em) THEN 'left out' ELSE 'train' END AS role FROM l, b s, b t WHERE s.grp < t.grp),
sc AS (SELECT split, lookback, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test,
  coalesce(avg(ret) FILTER (WHERE role = 'train') / nullif(stddev_samp(ret) FILTER (WHERE role = 'train'), 0) * sqrt(252), 0) AS tr,
  coalesce(avg(ret) FILTER (WHERE role = 'test') / nullif(stddev_samp(ret) FILTER (WHERE role = 'test'), 0) * sqrt(252), 0) AS te FROM r JOIN ro USING (dt) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY tr DESC, lookback) AS rn FROM sc)
SELECT split::bigint AS split, n_train, n_test, lookback, round(tr, 6) AS train_sharpe, round(te, 6) AS score FROM rk WHERE rn = 1""")
def cpcv_grid(spark, sf_dir):
    """The lookback of inverse-volatility weights chosen on each split's training days, scored on its test days."""
    p = held(spark, sf_dir)
    w = P.cut(E.inverse_volatility_grid(p, E.rebalance_dates(p), _LOOKBACKS, 20))
    returns = P.cut(E.run(p, w, 1, 10.0, 0.0, "lookback"))
    out = B.cpcv_grid(returns.select(F.col("lookback").alias("config"), "dt", "ret"))
    return out.select("split", "n_train", "n_test", F.col("config").alias("lookback"), F.round("train_sharpe", 6).alias("train_sharpe"), F.round("score", 6).alias("score"))


@register("rolling_adv", f"""WITH {BRAND}, {_LIQUIDITY}, g AS (SELECT d.dt, d.day_ix, a.asset, adv FROM (SELECT DISTINCT dt, day_ix FROM p) d CROSS JOIN (SELECT DISTINCT asset FROM p) a LEFT JOIN liq ON liq.dt = d.dt AND liq.asset = a.asset),
m AS (SELECT *, CASE WHEN count(adv) OVER w >= 5 THEN avg(adv) OVER w END AS mean FROM g WINDOW w AS (PARTITION BY asset ORDER BY day_ix RANGE BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT asset, dt, round(last_value(mean IGNORE NULLS) OVER (PARTITION BY asset ORDER BY day_ix), 6) AS adv FROM m""")
def rolling_adv(spark, sf_dir):
    volume = liquidity(spark, sf_dir).select("asset", "dt", F.col("adv").alias("volume"))
    return P.rolling_adv(volume, P.with_day_ix(volume)).select("asset", "dt", F.round("adv", 6).alias("adv"))


_PORT = f"{BRAND}, port AS (SELECT dt, avg(ret) AS ret FROM p GROUP BY dt)"


def portfolio(spark, sf_dir):
    return P.discount_panel(spark, sf_dir).groupBy("dt").agg(F.avg("ret").alias("ret"))


@register("rolling_sharpe", f"""WITH {_PORT} SELECT dt, round(CASE WHEN count(*) OVER w = 252 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END, 6) AS sharpe FROM port WINDOW w AS (ORDER BY dt ROWS 251 PRECEDING)""")
def rolling_sharpe(spark, sf_dir):
    w = W.orderBy("dt").rowsBetween(-251, 0)  # one row a day
    ratio = F.avg("ret").over(w) / F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0)) * 252**0.5
    return portfolio(spark, sf_dir).select("dt", F.round(F.when(F.count("ret").over(w) == 252, ratio), 6).alias("sharpe"))


@register("publication_lag", f"""WITH {_SERIES}, s AS (SELECT series, dt, x, least(isodow(dt) - 1, 4) AS wd, dt - cast(greatest(isodow(dt) - 5, 0) AS integer) AS friday FROM c),
o AS (SELECT series, friday + cast(7 + 2 * ((wd + 7) // 5) AS integer) AS pub, arg_max(x, dt) AS x FROM s GROUP BY 1, 2),
d AS (SELECT series, unnest(range(min(pub), max(pub) + 1, INTERVAL 1 DAY)) AS ts FROM o GROUP BY 1), e AS (SELECT series, cast(ts AS date) AS dt FROM d WHERE isodow(ts) <= 5)
SELECT e.series, e.dt, o.x FROM e ASOF JOIN o ON e.series = o.series AND e.dt >= o.pub""")
def publication_lag(spark, sf_dir):
    """Daily order counts as they are known seven weekdays later, on all weekdays."""
    return P.published(series(spark, sf_dir), 7).select("series", "dt", "x")


@register("splice", f"""WITH {BRAND}, q AS (SELECT asset, dt, product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS nav FROM p), a AS (SELECT asset, dt, 100 * nav AS price FROM q WHERE year(dt) >= 1996),
b AS (SELECT asset, dt, 7 * pow(nav, 2) AS price FROM q WHERE year(dt) <= 1996), s AS (SELECT asset, min(dt) AS start, arg_min(price, dt) AS level FROM a GROUP BY 1),
m AS (SELECT b.asset, b.dt, b.price * s.level / j.price AS price FROM b JOIN s USING (asset) JOIN b j ON j.asset = s.asset AND j.dt = s.start WHERE b.dt < s.start)
SELECT asset, dt, round(price, 6) AS price FROM (SELECT * FROM a UNION ALL SELECT * FROM m)""")
def splice(spark, sf_dir):
    q = P.prices(P.discount_panel(spark, sf_dir))
    first = q.where(F.year("dt") >= 1996).select("asset", "dt", "price")
    second = q.where(F.year("dt") <= 1996).select("asset", "dt", (7 * F.pow(F.col("price") / 100, 2)).alias("price"))
    return P.splice(first, second).select("asset", "dt", F.round("price", 6).alias("price"))


@register("annual_turnover", f"""WITH {_IV}, k AS (SELECT signal_ix, min(rebalance_dt) AS dt, row_number() OVER (ORDER BY signal_ix) AS k FROM iv GROUP BY signal_ix), w AS (SELECT k, asset, w FROM iv JOIN k USING (signal_ix)),
t AS (SELECT coalesce(n.k, o.k + 1) AS k, sum(abs(coalesce(n.w, 0) - coalesce(o.w, 0))) AS t FROM w n FULL JOIN w o ON o.k + 1 = n.k AND o.asset = n.asset GROUP BY 1)
SELECT year(dt) AS year, count(*) AS n, round(sum(t) / 2, 8) AS turnover FROM t JOIN k USING (k) WHERE k > 1 GROUP BY 1""")
def annual_turnover(spark, sf_dir):
    """One-way turnover per calendar year over old and new assets, the first purchase left out."""
    w = _weights(spark, sf_dir)[1]
    order = w.groupBy("signal_ix").agg(F.min("rebalance_dt").alias("dt")).withColumn("k", F.row_number().over(W.orderBy("signal_ix")))  # one row a rebalance
    w = w.join(F.broadcast(order), "signal_ix").select("k", "asset", "w")
    both = w.join(w.select((F.col("k") + 1).alias("k"), "asset", F.col("w").alias("o")), ["k", "asset"], "full")
    t = both.groupBy("k").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("o", F.lit(0.0)))).alias("t")).where("k > 1")
    return t.join(F.broadcast(order), "k").groupBy(F.year("dt").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("t") / 2, 8).alias("turnover"))


@register("report_metrics", f"""WITH {_PORT}, v AS (SELECT dt, 1e6 * product(1 + ret) OVER (ORDER BY dt) AS nav FROM port), r AS (SELECT dt, nav, nav / lag(nav) OVER (ORDER BY dt) - 1 AS ret, nav - lag(nav) OVER (ORDER BY dt) AS gain FROM v),
x AS (SELECT *, product(1 + ret) OVER (ORDER BY dt) AS cum FROM r WHERE ret IS NOT NULL), dd AS (SELECT max(1 - cum / peak) AS dd FROM (SELECT cum, max(cum) OVER (ORDER BY dt) AS peak FROM x)), z AS (SELECT max(dt) AS z FROM v),
s AS (SELECT avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS sortino, pow(product(1 + ret), 252.0 / count(*)) - 1 AS cagr, quantile_cont(ret, 0.05) AS var_95 FROM x)
SELECT z AS dt, round((SELECT arg_max(nav, dt) FROM v), 4) AS nav, round((SELECT arg_max(gain, dt) FROM r), 4) AS pnl_day, round((SELECT arg_max(nav, dt) - arg_min(nav, dt) FROM v WHERE dt >= z - 7), 4) AS pnl_week,
  round((SELECT arg_max(nav, dt) - arg_min(nav, dt) FROM v), 4) AS pnl_inception, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(cagr / dd, 6) AS calmar, round(dd, 8) AS max_drawdown, round(var_95, 8) AS var_95 FROM s, dd, z""")
def report_metrics(spark, sf_dir):
    nav = portfolio(spark, sf_dir).select("dt", (1e6 * F.product(1 + F.col("ret")).over(W.orderBy("dt"))).alias("nav"))  # one row a day
    places = {"nav": 4, "pnl_day": 4, "pnl_week": 4, "pnl_inception": 4, "sharpe": 6, "sortino": 6, "calmar": 6, "max_drawdown": 8, "var_95": 8}
    return R.metrics(nav).select("dt", *[F.round(c, n).alias(c) for c, n in places.items()])


@register("conditional_means", f"""WITH {BRAND}, l AS (SELECT DISTINCT dt, CASE WHEN day(dt) <= 3 THEN month(dt) % 3 END AS x FROM p), k AS (SELECT dt, last_value(x IGNORE NULLS) OVER (ORDER BY dt) AS regime FROM l),
n AS (SELECT regime, count(*) AS n FROM k WHERE regime IS NOT NULL GROUP BY 1), i AS (SELECT asset, regime, avg(ret) * 252 AS mu FROM p JOIN k USING (dt) GROUP BY 1, 2),
u AS (SELECT asset, regime, avg(ret) * 252 AS mu FROM p, (VALUES (0), (1), (2), (3)) r(regime) GROUP BY 1, 2)
SELECT u.asset, u.regime, round(CASE WHEN n >= 20 THEN i.mu ELSE u.mu END, 8) AS mu FROM u LEFT JOIN i USING (asset, regime) LEFT JOIN n ON n.regime = u.regime""")
def conditional_means(spark, sf_dir):
    """Labels stand on the first three days of each month; the fourth regime never comes."""
    p = P.discount_panel(spark, sf_dir)
    labels = p.where(F.day("dt") <= 3).select("dt", (F.month("dt") % 3).alias("regime")).distinct()
    return G.conditional_means(p, labels, (0, 1, 2, 3)).select("asset", "regime", F.round("mu", 8).alias("mu"))


@register("fixed_mix_monthly", f"""WITH {BRAND}, mo AS (SELECT asset, last_day(dt) AS dt, product(1 + ret) - 1 AS ret FROM p WHERE asset IN ('Brand#1', 'Brand#2') GROUP BY 1, 2)
SELECT dt, round(sum(CASE asset WHEN 'Brand#1' THEN 0.6 ELSE 0.4 END * ret), 8) AS ret FROM mo GROUP BY dt HAVING count(*) = 2""")
def fixed_mix_monthly(spark, sf_dir):
    return fixed_mix(spark, sf_dir).select("dt", *r8("ret"))


def fixed_mix(spark, sf_dir):
    """(dt, ret): benchmark of 60 and 40 % in two legs, months in which both have returns."""
    legs = P.discount_panel(spark, sf_dir).where(F.col("asset").isin("Brand#1", "Brand#2"))
    mo = legs.groupBy("asset", F.last_day("dt").alias("dt")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    w = F.when(F.col("asset") == "Brand#1", 0.6).otherwise(0.4)
    return mo.groupBy("dt").agg(F.sum(w * F.col("ret")).alias("ret"), F.count("*").alias("n")).where("n = 2").select("dt", "ret")


@register("risk_free_monthly", f"""WITH {_SERIES}, s AS (SELECT last_day(dt) AS m, arg_max(x, dt) / 1200 AS rf FROM c WHERE series = '1-URGENT' AND month(dt) % 4 <> 1 GROUP BY 1),
g AS (SELECT DISTINCT last_day(dt) AS m FROM c) SELECT m, round(coalesce(last_value(rf IGNORE NULLS) OVER (ORDER BY m), 0), 10) AS rf FROM g LEFT JOIN s USING (m)""")
def risk_free_monthly(spark, sf_dir):
    """Last yield of each month by 1200, carried over months without one, 0 before the first."""
    x = series(spark, sf_dir).withColumn("m", F.last_day("dt"))
    own = x.where("series = '1-URGENT' and month(dt) % 4 <> 1").groupBy("m").agg((F.max_by("x", "dt") / 1200).alias("rf"))
    w = W.orderBy("m").rowsBetween(W.unboundedPreceding, 0)  # one row a month
    return x.select("m").distinct().join(own, "m", "left").select("m", F.round(F.coalesce(F.last("rf", ignorenulls=True).over(w), F.lit(0.0)), 10).alias("rf"))


@register("cpcv_rows", f"""WITH {_PORT}, x AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS ix FROM port), l AS (SELECT ix, ix + 5 AS e, (SELECT count(*) FROM x) AS n FROM x),
b AS (SELECT g, g * (n // 6) + least(g, n % 6) AS lo, (g + 1) * (n // 6) + least(g + 1, n % 6) AS hi, cast(floor(n * 0.01) AS bigint) AS em FROM range(6) r(g), (SELECT max(n) AS n FROM l)),
r AS (SELECT s.g AS a, t.g AS b, CASE WHEN (ix >= s.lo AND ix < s.hi) OR (ix >= t.lo AND ix < t.hi) THEN 'test'
  WHEN (e >= s.lo AND e < s.hi) OR (e >= t.lo AND e < t.hi) OR (ix >= s.hi AND ix < s.hi + s.em) OR (ix >= t.hi AND ix < t.hi + t.em) THEN 'left out' ELSE 'train' END AS role FROM l, b s, b t WHERE s.g < t.g)
SELECT a, b, role, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def cpcv_rows(spark, sf_dir):
    """Rows by role of each split; labels are known five days later."""
    ix = portfolio(spark, sf_dir).select((F.row_number().over(W.orderBy("dt")) - 1).cast("long").alias("ix"))  # one row a day
    rows = B.cpcv_rows(ix.withColumn("end_ix", F.col("ix") + 5)).groupBy("split", "role").agg(F.count("*").alias("n"))
    b = F.floor(F.log2("split"))
    a = F.floor(F.log2(F.col("split") - F.pow(F.lit(2), b)))
    return rows.select(a.cast("long").alias("a"), b.cast("long").alias("b"), "role", "n")


@register("data_gates", f"""WITH {BRAND}, d AS (SELECT DISTINCT dt FROM p), s AS (SELECT min(dt) AS a, max(dt) AS z FROM d), w AS (SELECT cast(unnest(range(a, z + 1, INTERVAL 1 DAY)) AS date) AS dt FROM s),
c AS (SELECT last_day(dt) AS m, count(DISTINCT asset) / (SELECT count(DISTINCT asset) FROM p) AS coverage FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM w WHERE isodow(dt) <= 5 AND dt NOT IN (SELECT dt FROM d)) AS missing_days, (SELECT datediff('month', a, z) + 1 FROM s) - (SELECT count(*) FROM c) AS skipped_months,
  (SELECT count(*) FROM c WHERE coverage < 0.9) AS thin_months, (SELECT round(min(coverage), 8) FROM c) AS min_coverage""")
def data_gates(spark, sf_dir):
    """What a panel must pass before a verdict: missing weekdays, skipped months, coverage by month."""
    p = P.discount_panel(spark, sf_dir)
    days = p.select("dt").distinct()
    span = days.agg(F.min("dt").alias("a"), F.max("dt").alias("z"))
    weekdays = span.select(F.explode(F.sequence("a", "z")).alias("dt")).where(F.weekday("dt") < 5)
    missing = weekdays.join(days, "dt", "left_anti").agg(F.count("*").alias("missing_days"))
    names = p.agg(F.count_distinct("asset").alias("names"))
    share = p.groupBy(F.last_day("dt").alias("m")).agg(F.count_distinct("asset").alias("k")).crossJoin(F.broadcast(names))  # one row
    months = share.withColumn("coverage", F.col("k") / F.col("names")).agg(
        F.count("*").alias("months"), F.count_if(F.col("coverage") < 0.9).alias("thin_months"), F.round(F.min("coverage"), 8).alias("min_coverage")
    )
    all_months = (F.year("z") - F.year("a")) * 12 + F.month("z") - F.month("a") + 1
    one = months.crossJoin(span).crossJoin(missing)  # single rows
    return one.select("missing_days", (all_months - F.col("months")).alias("skipped_months"), "thin_months", "min_coverage")
