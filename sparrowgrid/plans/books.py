"""Queries of overlays on weights, news by ticker, refitted validation, verdicts and sources."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import backtest as B
from ..operators import engine as E
from ..operators import news as N
from ..operators import overlays as O
from ..registry import register
from ..sources import panel as P
from .accounts import _PORT, portfolio
from .macro import _SERIES, series
from .panels import held, r8
from .portfolios import _IV, _weights
from .search import _MONTHLY, monthly
from .sql import BRAND


def _equity():
    return F.col("asset").like("Brand#1%")


_SLEEVE = """sl AS (SELECT *, asset LIKE 'Brand#1%' AS eq, coalesce(sum(w) FILTER (WHERE asset LIKE 'Brand#1%') OVER b, 0) AS have, coalesce(sum(w) FILTER (WHERE NOT asset LIKE 'Brand#1%') OVER b, 0) AS oth FROM iv WINDOW b AS (PARTITION BY rebalance_dt))"""


@register("equity_floor", f"""WITH {_IV}, {_SLEEVE}, n AS (SELECT *, CASE WHEN 0.6 - have <= 0 OR oth < 0.6 - have + 0.01 THEN w WHEN eq THEN w + (0.6 - have) * w / have ELSE w * (oth - (0.6 - have)) / oth END AS x FROM sl)
SELECT rebalance_dt, asset, round(CASE WHEN 0.6 - have <= 0 OR oth < 0.6 - have + 0.01 THEN x ELSE x / sum(x) OVER (PARTITION BY rebalance_dt) END, 8) AS w FROM n""")
def equity_floor(spark, sf_dir):
    return O.equity_floor(_weights(spark, sf_dir)[1], _equity(), 0.6).select("rebalance_dt", "asset", *r8("w"))


@register("regime_band", f"""WITH {_IV}, {_SLEEVE}, r AS (SELECT *, month(rebalance_dt) % 3 AS r FROM sl), b(r, lo, hi) AS (VALUES (0, 0.6, 0.9), (1, 0.1, 0.3)),
g AS (SELECT r.*, least(greatest(have, lo), hi) AS goal FROM r LEFT JOIN b USING (r))
SELECT rebalance_dt, asset, round(CASE WHEN goal IS NULL OR abs(goal - have) < 1e-12 THEN w WHEN eq THEN w * goal / have ELSE w * (1 - goal) / oth END, 8) AS w FROM g""")
def regime_band(spark, sf_dir):
    """A regime for each month in turn; the third has no band."""
    w = _weights(spark, sf_dir)[1]
    name = F.get(F.array(*map(F.lit, ("EXPANSION", "CONTRACTION", "TRANSITION"))), F.month("rebalance_dt") % 3)
    regimes = w.select("rebalance_dt").distinct().withColumn("regime", name)
    return O.regime_band(w, _equity(), regimes, {"EXPANSION": (0.6, 0.9), "CONTRACTION": (0.1, 0.3)}).select("rebalance_dt", "asset", *r8("w"))


@register("vol_target_book", f"""WITH {_IV}, d AS (SELECT iv.rebalance_dt, p.day_ix, sum(w * coalesce(ret, 0)) AS r FROM iv JOIN p ON p.asset = iv.asset AND p.day_ix < iv.signal_ix AND p.day_ix >= iv.signal_ix - 63 GROUP BY 1, 2),
s AS (SELECT rebalance_dt, stddev_samp(r) * sqrt(252) AS sd FROM d GROUP BY 1)
SELECT rebalance_dt, asset, round(w * CASE WHEN sd > 0 THEN least(0.08 / sd, 2) ELSE 1 END, 8) AS w FROM iv LEFT JOIN s USING (rebalance_dt)""")
def vol_target_book(spark, sf_dir):
    p, w = _weights(spark, sf_dir)
    return O.vol_target(w, p, 0.08, 2.0).select("rebalance_dt", "asset", *r8("w"))


@register("capped_weights", f"""WITH {_IV}, c AS (SELECT rebalance_dt, asset, least(w, greatest(0.05, 1 / count(*) OVER (PARTITION BY rebalance_dt))) AS x FROM iv)
SELECT rebalance_dt, asset, round(x / sum(x) OVER (PARTITION BY rebalance_dt), 8) AS w FROM c""")
def capped_weights(spark, sf_dir):
    return O.capped(_weights(spark, sf_dir)[1], 0.05).select("rebalance_dt", "asset", *r8("w"))


@register("equity_share", f"""WITH {_IV}, s AS (SELECT rebalance_dt, coalesce(sum(w) FILTER (WHERE asset LIKE 'Brand#1%'), 0) AS s FROM iv GROUP BY 1) SELECT round(avg(s), 8) AS equity_share FROM s""")
def equity_share(spark, sf_dir):
    return O.equity_share(_weights(spark, sf_dir)[1], _equity()).select(*r8("equity_share"))


def _books_sql(bands: str) -> str:
    """The no-trade books of each width as a walk from one traded book to the next."""
    return f"""{_IV}, bd(band) AS (VALUES {bands}), bk AS (SELECT dense_rank() OVER (ORDER BY signal_ix) AS k, rebalance_dt, asset, w FROM iv), tk AS (SELECT k, sum(abs(w)) AS t FROM bk GROUP BY 1),
cm AS (SELECT a.k AS i, b.k AS j, sum(abs(b.w - a.w) - abs(b.w)) AS c FROM bk a JOIN bk b ON a.asset = b.asset AND a.k < b.k GROUP BY 1, 2),
ds AS (SELECT x.k AS i, y.k AS j, y.t + coalesce(c, 0) AS d FROM tk x JOIN tk y ON x.k < y.k LEFT JOIN cm ON cm.i = x.k AND cm.j = y.k),
nx AS (SELECT band, i, min(j) AS j FROM ds, bd WHERE d >= band GROUP BY 1, 2),
rc(band, k) AS (SELECT band, cast(1 AS bigint) FROM bd UNION ALL SELECT rc.band, nx.j FROM rc JOIN nx ON nx.band = rc.band AND nx.i = rc.k),
ht AS (SELECT rc.band, o.k, o.rebalance_dt, max(rc.k) AS t FROM (SELECT DISTINCT k, rebalance_dt FROM bk) o JOIN rc ON rc.k <= o.k GROUP BY 1, 2, 3),
nb AS (SELECT band, ht.k, ht.rebalance_dt, asset, w FROM ht JOIN bk ON bk.k = ht.t)"""


@register("no_trade_weights", f"WITH RECURSIVE {_books_sql('(0.05)')} SELECT rebalance_dt, asset, round(w, 8) AS w FROM nb")
def no_trade_weights(spark, sf_dir):
    """Inverse-volatility books that are traded only where they move by a twentieth."""
    w = _weights(spark, sf_dir)[1].withColumn("strategy", F.lit("iv"))
    return O.no_trade(w, 0.05, "strategy").select("rebalance_dt", "asset", *r8("w"))


def _banded(w, *bands: float):
    """The no-trade books of all widths in one plan."""
    return P.cut(O.no_trade(w.withColumn("band", F.explode(F.array(*map(F.lit, bands)))), F.col("band"), "band"))


@register("skipped_rebalances", f"""WITH RECURSIVE {_books_sql('(0.02), (0.05), (0.1)')}, mv AS (SELECT coalesce(n.band, o.band) AS band, coalesce(n.k, o.k + 1) AS k, sum(abs(coalesce(n.w, 0) - coalesce(o.w, 0))) AS t
  FROM nb n FULL JOIN nb o ON o.band = n.band AND o.k = n.k - 1 AND o.asset = n.asset GROUP BY 1, 2)
SELECT band::double AS band, count(*) AS n, count(*) FILTER (WHERE t < 1e-12) AS n_skipped FROM mv WHERE k > 1 AND k <= (SELECT max(k) FROM bk) GROUP BY 1""")
def skipped_rebalances(spark, sf_dir):
    """Rebalances that a no-trade band of each width leaves out."""
    return O.skipped(_banded(_weights(spark, sf_dir)[1], 0.02, 0.05, 0.1), "band")


@register("band_calibration")
def band_calibration(spark, sf_dir):
    """Sharpe ratio and stability of each width of the no-trade band, and which is chosen."""
    p, w = _weights(spark, sf_dir)
    books = _banded(w, 0.0, 0.02, 0.05, 0.1)
    scores = P.cut(E.grid_scores(P.cut(E.run(p, books, 1, 10.0, 0.0, "band")), "band"))
    best = E.calibrate(scores, "band").select(F.col("band").alias("chosen"))
    return scores.crossJoin(F.broadcast(best)).select("band", F.round("sharpe", 6).alias("sharpe"), "stable", (F.col("band") == F.col("chosen")).alias("chosen"))  # one row


@register("equal_weights", f"""WITH {BRAND}, rd AS (SELECT last_day(dt) AS m, max(dt) AS rebalance_dt, max(day_ix) AS signal_ix FROM p GROUP BY 1),
a AS (SELECT DISTINCT rebalance_dt, asset FROM rd JOIN p ON day_ix < signal_ix AND day_ix >= signal_ix - 21 WHERE ret IS NOT NULL)
SELECT rebalance_dt, asset, round(1.0 / count(*) OVER (PARTITION BY rebalance_dt), 8) AS w FROM a""")
def equal_weights(spark, sf_dir):
    p = held(spark, sf_dir)
    return E.equal_weights(p, E.rebalance_dates(p), 21).select("rebalance_dt", "asset", *r8("w"))


@register("fixed_weights", f"""WITH {BRAND}, rd AS (SELECT max(dt) AS rebalance_dt FROM p GROUP BY date_trunc('quarter', dt)) SELECT rebalance_dt, asset, w FROM rd, (VALUES ('Brand#1', 0.6), ('Brand#2', 0.4)) v(asset, w)""")
def fixed_weights(spark, sf_dir):
    p = held(spark, sf_dir)
    return E.fixed_weights(E.rebalance_dates(p, "QE"), {"Brand#1": 0.6, "Brand#2": 0.4}).select("rebalance_dt", "asset", "w")


@register("rebalance_calendar", f"""WITH {BRAND}, d AS (SELECT DISTINCT dt, day_ix FROM p)
SELECT 'W' AS freq, max(dt) AS rebalance_dt, max(day_ix) AS signal_ix FROM d GROUP BY date_trunc('week', dt) UNION ALL SELECT 'ME', max(dt), max(day_ix) FROM d GROUP BY last_day(dt)
UNION ALL SELECT 'QE', max(dt), max(day_ix) FROM d GROUP BY date_trunc('quarter', dt)""")
def rebalance_calendar(spark, sf_dir):
    p = held(spark, sf_dir)
    parts = [E.rebalance_dates(p, f).select(F.lit(f).alias("freq"), "rebalance_dt", "signal_ix") for f in ("W", "ME", "QE")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("fit_dates", f"""WITH {BRAND}, d AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS b FROM (SELECT DISTINCT dt FROM p)) SELECT max(dt) AS rebalance_dt, arg_max(b, dt) AS fit_dt FROM d GROUP BY last_day(dt) HAVING arg_max(b, dt) IS NOT NULL""")
def fit_dates(spark, sf_dir):
    return E.fit_dates(held(spark, sf_dir))


@register("news_by_ticker", """WITH w AS (SELECT user_id AS ticker, sign(value - 50) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts <= TIMESTAMP '2024-01-15')
SELECT ticker, count(s) AS n, round(avg(s), 8) AS score, round(least(count(s) / 10.0, 1), 8) AS confidence FROM w GROUP BY 1""")
def news_by_ticker(spark, sf_dir):
    head = P.read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("ticker"), F.signum(F.col("value") - 50).alias("sentiment"))
    return N.by_ticker(head, "2024-01-15").select("ticker", "n", *r8("score", "confidence"))


@register("label_scores", """SELECT event_type, count(*) AS n, sum(CASE WHEN value > 66 THEN 1 WHEN value < 33 THEN -1 ELSE 0 END)::double AS total FROM events GROUP BY 1""")
def label_scores(spark, sf_dir):
    label = F.when(F.col("value") > 66, "Positive").when(F.col("value") < 33, "negative").otherwise("neutral")
    return P.read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(N.label_score(label)).alias("total"))


_TRIALS = (50, 200, 500)


def _luck(trials: int) -> float:
    """Expected best Sharpe ratio of ``trials`` lucky ones, times the root of the observations."""
    return M.expected_max_sharpe(trials, 1)


# the normal distribution by Simpson's rule: an SQL engine without erf can follow
_PHI = "CASE WHEN z > 8 THEN 1.0 WHEN z < -8 THEN 0.0 ELSE 0.5 + z / 600 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 201), lambda i: (CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 200.0, 2) / 2))) END"


@register("deflated_sharpe", f"""WITH {BRAND}, m AS (SELECT asset, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS g, kurtosis_pop(ret) + 3 AS k FROM p GROUP BY 1),
t(trials, luck) AS (VALUES {', '.join(f'({t}, {_luck(t)!r})' for t in _TRIALS)}),
z AS (SELECT asset, trials, (sr - luck / sqrt(n)) * sqrt(n - 1) / sqrt(greatest(1 - g * sr + (k - 1) / 4 * sr * sr, 1e-12)) AS z FROM m, t)
SELECT asset, trials, round({_PHI}, 6) AS dsr FROM z""")
def deflated_sharpe(spark, sf_dir):
    """Deflated Sharpe ratio of each brand, by how many trials it is held against."""
    return M.deflated(M.summary(P.discount_panel(spark, sf_dir)), _TRIALS).select("asset", "trials", F.round("dsr", 6).alias("dsr"))


def _calibrate(train):
    """The threshold among three whose days have the best mean."""
    x = train["ret"].shift(1)
    best = max((-0.01, 0.0, 0.01), key=lambda c: (train["ret"][x > c].mean() if (x > c).any() else -1.0))
    return {"threshold": best}


def _evaluate(test, params):
    r = test["ret"][test["ret"].shift(1) > params["threshold"]]
    return float(r.mean() / r.std(ddof=1) * math.sqrt(252)) if len(r) > 1 and r.std(ddof=1) > 0 else 0.0


@register("cpcv_refit")
def cpcv_refit(spark, sf_dir):
    """A threshold on yesterday's return, chosen anew on the training days of each split."""
    return B.cpcv_refit(P.cut(portfolio(spark, sf_dir)), _calibrate, _evaluate).select("split", "n_train", "n_test", "params", F.round("score", 8).alias("score"))


@register("sample_covariance", f"""WITH panel AS (SELECT p_type AS asset, cast(l_shipdate AS date) AS dt, sum(cast(round(l_discount * 100) AS bigint) - 5) / (100.0 * count(*)) AS ret FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
n AS (SELECT count(DISTINCT dt) AS n FROM panel), c AS (SELECT x.asset AS a, y.asset AS b, count(*) AS k, covar_samp(x.ret, y.ret) AS c FROM panel x JOIN panel y ON x.dt = y.dt AND x.asset <= y.asset GROUP BY 1, 2)
SELECT a, b, round(CASE WHEN k = n THEN c END, 12) AS cov FROM c, n""")
def sample_covariance(spark, sf_dir):
    """Covariances of the part types; a pair with a missing day has none."""
    return M.sample_covariance(P.cut(P.discount_panel(spark, sf_dir, "type"))).select("a", "b", F.round("cov", 12).alias("cov"))


@register("full_tearsheet", f"""WITH {BRAND}, q AS (SELECT asset, dt, ret, product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS nav FROM p), d AS (SELECT *, 1 - nav / max(nav) OVER (PARTITION BY asset ORDER BY dt) AS dd FROM q),
c AS (SELECT asset, quantile_cont(ret, 0.05) AS v FROM p GROUP BY 1), a AS (SELECT d.asset, count(*) AS n, pow(product(1 + ret), 252.0 / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS vol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe,
  avg(ret) / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0) * sqrt(252) AS sortino, max(dd) AS mdd, count(*) FILTER (WHERE ret > 0) / count(*) AS hit, any_value(v) AS var_95, avg(ret) FILTER (WHERE ret <= v) AS cvar_95 FROM d JOIN c USING (asset) GROUP BY 1 HAVING count(*) >= 20)
SELECT asset, n, round(cagr, 8) AS cagr, round(vol, 8) AS volatility, round(sharpe, 8) AS sharpe, round(sortino, 8) AS sortino, round(mdd, 8) AS max_drawdown, round(cagr / nullif(mdd, 0), 8) AS calmar, round(hit, 8) AS hit_rate,
  round(var_95, 8) AS var_95, round(cvar_95, 8) AS cvar_95 FROM a""")
def full_tearsheet(spark, sf_dir):
    out = M.tearsheet(P.discount_panel(spark, sf_dir))
    return out.select("asset", "n", *r8("cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "var_95", "cvar_95"))


_PERIODS = (("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31"), ("whole", "1995-01-01", "2001-12-31"))


@register("period_analysis", f"""WITH {_PORT}, t(period, a, z) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in _PERIODS)})
SELECT period, count(*) AS n, round(product(1 + ret) - 1, 8) AS total, round(avg(ret) / stddev_samp(ret) * sqrt(252), 8) AS sharpe FROM port JOIN t ON dt BETWEEN a AND z GROUP BY 1""")
def period_analysis(spark, sf_dir):
    """Named spans that may overlap."""
    rows = spark.createDataFrame(_PERIODS, "period string, a string, z string").selectExpr("period", "date(a) AS a", "date(z) AS z")
    days = portfolio(spark, sf_dir).join(F.broadcast(rows), F.col("dt").between(F.col("a"), F.col("z")))  # four rows
    sharpe = F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * math.sqrt(252)
    return days.groupBy("period").agg(F.count("*").alias("n"), F.round(F.product(1 + F.col("ret")) - 1, 8).alias("total"), F.round(sharpe, 8).alias("sharpe"))


@register("strategy_verdict", f"""WITH {_PORT}, q AS (SELECT dt, ret, product(1 + ret) OVER (ORDER BY dt) AS nav FROM port), d AS (SELECT *, 1 - nav / max(nav) OVER (ORDER BY dt) AS dd FROM q),
m AS (SELECT avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, max(dd) AS mdd, product(1 + ret) * 10000 AS final, count(*) AS n FROM d)
SELECT round(sharpe, 8) AS sharpe, round(mdd, 8) AS max_drawdown, round(final, 4) AS final_value, sharpe > 0.5 AS sharpe_ok, mdd < 0.25 AS drawdown_ok, n >= 252 AS history_ok, sharpe > 0.5 AND mdd < 0.25 AND n >= 252 AS passed FROM m""")
def strategy_verdict(spark, sf_dir):
    """A battery of checks on the equal-weight portfolio, and what 10,000 would have become."""
    return M.verdict(portfolio(spark, sf_dir).withColumn("asset", F.lit(1))).select(*r8("sharpe", "max_drawdown"), F.round("final_value", 4).alias("final_value"), "sharpe_ok", "drawdown_ok", "history_ok", "passed")


@register("kill_criteria", f"""WITH {_MONTHLY}, b AS (SELECT dt, avg(ret) AS b FROM mo GROUP BY dt), s AS (SELECT asset, avg(mo.ret) / stddev_samp(mo.ret) * sqrt(12) AS sharpe, avg(mo.ret - b) AS excess, count(*) AS n FROM mo JOIN b USING (dt) GROUP BY 1)
SELECT asset, sharpe < 0 AS loses, excess <= 0 AS lags, n < 24 AS "short", sharpe < 0 OR excess <= 0 OR n < 24 AS killed FROM s""")
def kill_criteria(spark, sf_dir):
    """A brand is dropped if it loses, lags the mean of all, or is too young."""
    mo = monthly(spark, sf_dir)
    both = mo.join(F.broadcast(mo.groupBy("dt").agg(F.avg("ret").alias("b"))), "dt")  # one row a month
    sharpe = F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))
    out = both.groupBy("asset").agg((sharpe < 0).alias("loses"), (F.avg(F.col("ret") - F.col("b")) <= 0).alias("lags"), (F.count("*") < 24).alias("short"))
    return out.withColumn("killed", F.col("loses") | F.col("lags") | F.col("short"))


@register("monthly_turnover_rate", f"""WITH {_IV}, k AS (SELECT signal_ix, row_number() OVER (ORDER BY signal_ix) AS k FROM (SELECT DISTINCT signal_ix FROM iv)), w AS (SELECT k, asset, w FROM iv JOIN k USING (signal_ix)),
t AS (SELECT coalesce(n.k, o.k + 1) AS k, sum(abs(coalesce(n.w, 0) - coalesce(o.w, 0))) AS t FROM w n FULL JOIN w o ON o.k + 1 = n.k AND o.asset = n.asset GROUP BY 1) SELECT round(avg(t) * 12, 8) AS turnover FROM t WHERE k > 1 AND k <= (SELECT max(k) FROM k)""")
def monthly_turnover_rate(spark, sf_dir):
    """Summed changes of twelve months, on average; neither halved nor by calendar year."""
    w = _weights(spark, sf_dir)[1]
    order = w.select("signal_ix").distinct().withColumn("k", F.row_number().over(W.orderBy("signal_ix")))  # one row a rebalance
    w = w.join(F.broadcast(order), "signal_ix").select("k", "asset", "w")
    both = w.join(w.select((F.col("k") + 1).alias("k"), "asset", F.col("w").alias("o")), ["k", "asset"], "full").join(F.broadcast(order.select("k")), "k")
    t = both.where("k > 1").groupBy("k").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("o", F.lit(0.0)))).alias("t"))
    return t.agg(F.round(F.avg("t") * 12, 8).alias("turnover"))


@register("top_names", f"""WITH {_IV}, r AS (SELECT rebalance_dt, asset, w, row_number() OVER (PARTITION BY rebalance_dt ORDER BY round(w, 8) DESC, asset) AS rn FROM iv) SELECT rebalance_dt, asset, round(w, 8) AS w FROM r WHERE rn <= 5""")
def top_names(spark, sf_dir):
    """The five largest weights of each book: a report, so the limit is its feature."""
    w = _weights(spark, sf_dir)[1].select("rebalance_dt", "asset", *r8("w"))
    return w.withColumn("rn", F.row_number().over(W.partitionBy("rebalance_dt").orderBy(F.desc("w"), "asset"))).where("rn <= 5").drop("rn")


_QUOTES = """q AS (SELECT l_suppkey AS asset, cast(l_shipdate AS date) AS dt, min(cast(round(l_extendedprice * 100) AS bigint)) / 100.0 AS bid, max(cast(round(l_extendedprice * 100) AS bigint)) / 100.0 AS ask, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


@register("bid_ask_spread", f"""WITH {_QUOTES}, s AS (SELECT asset, dt, CASE WHEN n > 1 THEN (ask - bid) / ((ask + bid) / 2) END AS s FROM q), f AS (SELECT asset, dt, last_value(s IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt) AS s FROM s)
SELECT asset, dt, round(s, 8) AS spread FROM f WHERE s IS NOT NULL""")
def bid_ask_spread(spark, sf_dir):
    """Lowest and highest price of a supplier's day as bid and ask; a day of one line has no ask."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    q = P.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        (F.min(cents) / 100.0).alias("bid"), F.when(F.count("*") > 1, F.max(cents) / 100.0).alias("ask")
    )
    return P.bid_ask_spread(q).select("asset", "dt", *r8("spread"))


@register("funding_series", f"""WITH {BRAND}, {_SERIES}, y AS (SELECT dt, x / 10 AS x FROM c WHERE series = '1-URGENT' AND day(dt) % 5 = 0 AND dt >= DATE '1995-06-01'), d AS (SELECT DISTINCT dt FROM p)
SELECT d.dt, round(coalesce(y.x / 100 + 0.005, 0.02), 10) AS rate FROM d ASOF LEFT JOIN y ON d.dt >= y.dt""")
def funding_series(spark, sf_dir):
    """A yield that is quoted now and then, as a rate on each day of the panel."""
    y = series(spark, sf_dir).where("series = '1-URGENT' and day(dt) % 5 = 0 and dt >= '1995-06-01'").select("dt", (F.col("x") / 10).alias("x"))
    return P.funding_series(y, held(spark, sf_dir)).select("dt", F.round("rate", 10).alias("rate"))


@register("returns_of_prices", f"""WITH {BRAND}, q AS (SELECT asset, dt, 100 * product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS x FROM p), l AS (SELECT asset, dt, x, lag(x) OVER (PARTITION BY asset ORDER BY dt) AS y FROM q)
SELECT asset, dt, round(ln(x / y), 8) AS log_ret, round(x / y - 1, 8) AS simple_ret FROM l WHERE y IS NOT NULL""")
def returns_of_prices(spark, sf_dir):
    q = P.cut(P.prices(P.discount_panel(spark, sf_dir)).select("asset", "dt", "price"))
    both = P.returns_of(q, "log").withColumnRenamed("ret", "log_ret").join(P.returns_of(q, "simple").withColumnRenamed("ret", "simple_ret"), ["asset", "dt"])
    return both.select("asset", "dt", *r8("log_ret", "simple_ret"))


@register("overlay_months", f"""WITH {_MONTHLY}, b AS (SELECT dt, avg(ret) AS m FROM mo GROUP BY dt), s AS (SELECT last_day(dt + 1) AS dt, CASE WHEN m > 0.01 THEN 1 WHEN m < -0.01 THEN -1 ELSE 0 END AS p FROM b),
h AS (SELECT s.dt, p, b.m - 0.002 AS excess, 10000 + 100 * month(s.dt) AS notional, month(s.dt) % 3 = 0 AS rolls FROM s JOIN b ON b.dt = s.dt)
SELECT dt, p AS position, round(p * excess - abs(p - coalesce(lag(p) OVER (ORDER BY dt), 0)) * 1.475 / notional - CASE WHEN rolls THEN abs(p) * 2.95 / notional ELSE 0 END, 10) AS overlay FROM h""")
def overlay_months(spark, sf_dir):
    """Last month's mean return decides the position in one contract; it rolls each quarter."""
    mean = P.cut(monthly(spark, sf_dir).groupBy("dt").agg(F.avg("ret").alias("m")))
    side = F.when(F.col("m") > 0.01, 1).when(F.col("m") < -0.01, -1).otherwise(0)
    market = mean.select("dt", (F.col("m") - 0.002).alias("excess"), (10000 + 100 * F.month("dt")).alias("notional"), (F.month("dt") % 3 == 0).alias("rolls"))
    trade = E.futures_cost(F.lit(1))
    return B.overlay_months(mean.select(F.col("dt").alias("formation"), side.alias("position")), market, trade, 2 * trade).select("dt", "position", F.round("overlay", 10).alias("overlay"))


@register("dividend_gap", f"""WITH {BRAND}, q AS (SELECT asset, dt, product(1 + ret) OVER (PARTITION BY asset ORDER BY dt) AS x, product(1 + ret + 0.0001) OVER (PARTITION BY asset ORDER BY dt) AS y FROM p),
g AS (SELECT asset, pow(arg_max(x, dt) / arg_min(x, dt), 365.25 / (max(dt) - min(dt))) - 1 AS plain, pow(arg_max(y, dt) / arg_min(y, dt), 365.25 / (max(dt) - min(dt))) - 1 AS total FROM q GROUP BY 1 HAVING max(dt) > min(dt))
SELECT asset, round((total - plain) / 0.02, 8) AS closed, (total - plain) / 0.02 > 0.7 AS ok FROM g""")
def dividend_gap(spark, sf_dir):
    """How much of an expected gap of 2 % a year a total-return series closes over its price series."""
    w = W.partitionBy("asset").orderBy("dt")
    q = P.discount_panel(spark, sf_dir).select("asset", "dt", F.product(1 + F.col("ret")).over(w).alias("x"), F.product(1 + F.col("ret") + 0.0001).over(w).alias("y"))
    rate = lambda c: F.pow(F.max_by(c, "dt") / F.min_by(c, "dt"), 365.25 / F.nullif(F.datediff(F.max("dt"), F.min("dt")), F.lit(0))) - 1
    out = q.groupBy("asset").agg(((rate("y") - rate("x")) / 0.02).alias("closed")).where("closed is not null")
    return out.select("asset", *r8("closed"), (F.col("closed") > 0.7).alias("ok"))


@register("trend_grid")
def trend_grid(spark, sf_dir):
    """Sharpe ratio and stability of seven by seven settings of the trend and momentum book."""
    p = held(spark, sf_dir, "type")
    damps, tilts = (0.0, 0.1, 0.25, 0.4, 0.5, 0.75, 1.0), (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
    books = P.cut(E.trend_grid(p, E.rebalance_dates(p), damps, tilts))
    returns = P.cut(E.run(p, books, 1, 10.0, 0.0, "damp", "tilt"))
    return E.grid_scores(returns, "damp", "tilt").select("damp", "tilt", F.round("sharpe", 6).alias("sharpe"), "stable")


@register("basket_search_space")
def basket_search_space(spark, sf_dir):
    """Mean score and number of members scored by each configuration, in the universe of each month."""
    from ..operators import search as S
    from . import universes

    p = held(spark, sf_dir, "supplier")
    basket = P.cut(universes.baskets(spark, sf_dir).withColumnRenamed("snapshot_dt", "formation"))
    scores = S.search_space(p, basket.select("formation").distinct(), beta_obs=8, baskets=basket)
    return scores.groupBy("formation", "config").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
