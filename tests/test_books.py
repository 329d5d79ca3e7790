import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparrowgrid.functions import metrics as M
from sparrowgrid.operators import backtest as B
from sparrowgrid.operators import daily as D
from sparrowgrid.operators import engine as E
from sparrowgrid.operators import hmm as H
from sparrowgrid.operators import kernels as K
from sparrowgrid.operators import ledger, news, universe
from sparrowgrid.operators import overlays as O
from sparrowgrid.operators import regime as R
from sparrowgrid.sources import panel as P
from sparrowgrid.sources import store as S


def weekdays(start, end):
    return [d.date() for d in pd.bdate_range(start, end)]


def long(spark, wide: pd.DataFrame):
    rows = [(a, d, i + 1, None if np.isnan(v) else float(v)) for a in wide.columns for i, (d, v) in enumerate(wide[a].items())]
    return spark.createDataFrame(rows, "asset string, dt date, day_ix long, ret double")


def baskets(spark, formations, members):
    return spark.createDataFrame([(f, m) for f in formations for m in members], "formation date, asset string")


def momentum(spark, wide, formations, **kw):
    p = long(spark, wide)
    return p, B.momentum_12_1(p, spark.createDataFrame([(f,) for f in formations], "formation date"), **kw)


@pytest.fixture(scope="module")
def flat():
    wide = pd.DataFrame({"WIN": 0.001, "LOSE": -0.001, "MID": 0.0}, index=weekdays("2020-01-01", "2022-02-28"))
    return wide, [d.date() for d in pd.date_range("2021-01-31", "2021-12-31", freq="ME")]


def test_point_in_time_book_and_its_costs(spark, flat):
    wide, ends = flat
    p, scores = momentum(spark, wide, ends)
    basket = baskets(spark, ends, ["WIN", "LOSE", "MID"])
    free, paid = (B.simulate_monthly(scores, p, 0.34, 1, bps, baskets=basket).orderBy("formation").collect() for bps in (0.0, 10.0))
    assert len(free) == 12 and all(r.n_held == 2 and r.n_members == 3 and r.coverage == 1 and r.net > 0 for r in free)
    assert free[0].net - paid[0].net == pytest.approx(1e-3) and abs(free[3].net - paid[3].net) < 2e-5
    cash = B.simulate_monthly(scores, p, 0.34, 10, 0.0, baskets=basket).collect()
    assert all(r.net == 0 and r.n_held == 0 for r in cash)
    # a member that leaves is not held, a formation without members has no row
    later = B.simulate_monthly(scores, p, 1.0, 1, 0.0, baskets=baskets(spark, ends[:1], ["WIN", "LOSE"]).unionByName(baskets(spark, ends[1:2], ["LOSE"]))).orderBy("formation").collect()
    assert [r.n_held for r in later] == [2, 1] and later[1].gross < 0 and later[1].turnover == pytest.approx(1.0, abs=0.05)


def test_the_first_holding_day_is_not_credited_and_a_crash_is(spark):
    wide = pd.DataFrame({"A": 0.0, "B": -0.001}, index=weekdays("2020-01-01", "2021-03-31"))
    wide.loc[dt.date(2021, 2, 1), "A"] = 0.10
    end = [dt.date(2021, 1, 31)]
    p, s = momentum(spark, wide, end)
    assert B.simulate_monthly(s, p, 0.5, 1, 0.0, baskets=baskets(spark, end, ["A", "B"])).first().net == pytest.approx(0)
    wide = pd.DataFrame({"DEAD": 0.002, "ALIVE": 0.001}, index=wide.index)
    wide.loc[dt.date(2021, 2, 10), "DEAD"] = -0.5
    wide.loc[wide.index > dt.date(2021, 2, 10), "DEAD"] = np.nan
    p, s = momentum(spark, wide, end)
    row = B.simulate_monthly(s, p, 1.0, 1, 0.0, baskets=baskets(spark, end, ["DEAD", "ALIVE", "GHOST"])).first()
    assert row.net < -0.2 and row.coverage == pytest.approx(2 / 3) and row.n_members == 3 and row.n_eligible == 2


def test_forward_returns_take_the_whole_month(spark):
    wide = pd.DataFrame({"A": 0.01, "B": np.nan}, index=weekdays("2021-01-01", "2021-03-31"))
    got = {(r.formation.month, r.asset): r.fwd for r in B.forward_returns(long(spark, wide)).collect()}
    assert got[1, "A"] == pytest.approx(1.01**20 - 1) and got[1, "B"] == 0


def test_risk_filter_keeps_the_book_whole():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(0, s, 400) for s in (0.03, 0.01, 0.005, 0.004, 0.002)])
    w = np.full(5, 0.2)
    out = K.risk_filter(x, w, 0.01, drawdown_limit=9.0)
    assert out.sum() == pytest.approx(1) and K.historical_cvar(x @ out)[0] <= 0.01 < K.historical_cvar(x @ w)[0] and out[0] < 0.2
    assert (K.risk_filter(x[:5], w, 0.0) == w).all()
    assert (K.risk_filter(x, w, 0.9, drawdown_limit=9.0) == w).all()
    scaled = K.risk_filter(x, w, 0.9, drawdown_limit=0.01)
    assert scaled.sum() < 1 and scaled == pytest.approx(w * scaled.sum())
    assert K.risk_filter(x, w, 1e-9, drawdown_limit=9.0, least=0.05).min() >= 0.05 / 1.3
    nothing = np.zeros(5)
    assert not K.risk_filter(x, nothing, -1.0).any()


def test_optimizer_uses_complete_rows_only(spark):
    rng = np.random.default_rng(4)
    wide = pd.DataFrame(rng.normal(0, 0.01, (500, 4)), columns=list("abcd"), index=weekdays("2020-01-01", "2021-11-30")[:500])
    wide.loc[wide.index[:300], "d"] = np.nan
    wide.iloc[::7, 1] = np.nan
    p = long(spark, wide)
    dates = spark.createDataFrame([(wide.index[-1], 500)], "rebalance_dt date, signal_ix long")
    seen = {r.asset: r.w for r in E.optimize(p, dates, lambda x: np.array([len(x), x.shape[1], x.sum()]), 756).collect()}
    clean = wide.iloc[:499][["a", "b", "c"]].dropna()
    assert seen == {"a": len(clean), "b": 3, "c": pytest.approx(clean.to_numpy().sum())}
    few = {r.asset: r.w for r in E.optimize(p, dates, lambda x: 1 / 0, 100).collect()}
    assert few == dict.fromkeys("abcd", 0.25)

    def broken(x):
        raise ValueError("no")

    failed = spark.sparkContext.accumulator(0)
    assert {r.w for r in E.optimize(p, dates, broken, 756, failed=failed).collect()} == {1 / 3} and failed.value == 1


def test_windows_meet_rows_by_buckets(spark):
    p = spark.range(1, 301).select(F.lit("a").alias("asset"), F.col("id").alias("day_ix"), F.col("id").cast("double").alias("ret"), F.lit(dt.date(2020, 1, 1)).alias("dt"))
    dates = spark.createDataFrame([(dt.date(2020, 1, i), s) for i, s in ((1, 1), (2, 64), (3, 65), (4, 200), (5, 300))], "rebalance_dt date, signal_ix long")
    for back in (1, 63, 64, 100):
        got = {r.signal_ix: (r.n, r.a, r.z) for r in E.history(p, dates, back).groupBy("signal_ix").agg(F.count("*").alias("n"), F.min("day_ix").alias("a"), F.max("day_ix").alias("z")).collect()}
        assert got == {s: (min(back, s - 1), max(1, s - back), s - 1) for s in (64, 65, 200, 300)}


def test_sleeves_against_the_kernels(spark):
    rng = np.random.default_rng(6)
    names, equity = list("abcde"), np.array([True, True, False, False, False])
    books = [rng.dirichlet(np.ones(5)) for _ in range(6)] + [np.array([0, 0, 0.5, 0.5, 0]), np.array([0.5, 0.5, 0, 0, 0]), np.array([0.2, 0.0, 0.795, 0.005, 0.0])]
    at = [dt.date(2020, 1, i + 1) for i in range(len(books))]
    w = spark.createDataFrame([(d, i, a, float(v)) for i, (d, b) in enumerate(zip(at, books)) for a, v in zip(names, b)], "rebalance_dt date, signal_ix long, asset string, w double")
    regimes = spark.createDataFrame([(d, ("X", "Y", "Z")[i % 3]) for i, d in enumerate(at)], "rebalance_dt date, regime string")
    is_equity = F.col("asset").isin("a", "b")
    read = lambda df: {(r.rebalance_dt, r.asset): r.w for r in df.collect()}
    band = read(O.regime_band(w, is_equity, regimes, {"X": (0.5, 0.9), "Y": (0.0, 0.1)}))
    floor = read(O.equity_floor(w, is_equity, 0.6))
    for i, (d, b) in enumerate(zip(at, books)):
        want = K.regime_band(b, equity, *((0.5, 0.9), (0.0, 0.1), (0.0, 1.0))[i % 3])
        assert [band[d, a] for a in names] == pytest.approx(list(want)), i
        assert [floor[d, a] for a in names] == pytest.approx(list(K.sleeve_floor(b, equity, 0.6))), i
    assert K.trend_filter(np.vstack([np.full((250, 2), 0.01), np.full((150, 2), -0.02)]), np.array([0.5, 0.5]), 1e-300).sum() == pytest.approx(1)


def test_no_trade_band_remembers_what_was_traded(spark):
    rng = np.random.default_rng(2)
    books = [rng.dirichlet(np.full(3, 60.0)) for _ in range(30)]
    w = spark.createDataFrame([("s", dt.date(2020, 1, i + 1), i, a, float(v)) for i, b in enumerate(books) for a, v in zip("abc", b)], "s string, rebalance_dt date, signal_ix long, asset string, w double")
    got = {(r.signal_ix, r.asset): r.w for r in O.no_trade(w, 0.1, "s").collect()}
    want = K.no_trade_band(books, 0.1)
    assert got == {(i, a): v for i, b in enumerate(want) for a, v in zip("abc", b)}
    row = O.skipped(O.no_trade(w, 0.1, "s"), "s").first()
    assert (row.n, row.n_skipped) == (29, sum(a is b for a, b in zip(want, want[1:]))) and 0 < row.n_skipped < 29


def test_views_move_the_book_and_no_views_leave_it():
    rng = np.random.default_rng(3)
    cov = np.cov((rng.normal(0, 0.01, (400, 6)) + rng.normal(0, 0.005, (400, 1))).T) * 252
    market = np.full(6, 1 / 6)
    p, names = K.class_views(["x", "x", "y", "y", "y", "z"])
    assert names == ["x", "y", "z"] and p.sum(axis=1) == pytest.approx(1) and p[0, 0] == 0.5
    up = K.bl_weights(cov, market, p, np.array([1.0, 0.0, -1.0]), np.full(3, 0.9), cost=0.0, high=0.5)
    assert up[:2].sum() > 2 / 6 > up[5] * 2 and up.sum() == pytest.approx(1)
    assert (K.ticker_bl(cov, market, np.ones(6), np.full(6, 0.01)) == market).all()
    one = K.ticker_bl(cov, market, np.array([1, 0, 0, 0, 0, 0.0]), np.array([0.9, 0, 0, 0, 0, 0]), cost=0.0, high=0.5)
    assert one[0] == one.max() and one.sum() == pytest.approx(1)
    # the solver's book is no worse than random ones
    mu, post = K.bl_posterior(cov, 2.5 * cov @ market, np.eye(6)[:1], np.array([0.2]), np.array([0.9]), 0.025)
    risk = K.positive(cov + post)
    value = lambda w: mu @ w - 1.25 * w @ risk @ w - 0.02 * np.abs(w - market).sum()
    best = K.mean_variance(mu, risk, market, 2.5, 0.02, 0.0, 0.5)
    others = [K._prox(x := rng.dirichlet(np.ones(6)), x, 0.0, 0.0, 0.5) for _ in range(500)]
    assert all(value(best) >= value(o) - 1e-7 for o in others)


def test_bootstrap_draws_one_stream():
    r = np.random.default_rng(0).normal(0.001, 0.01, 300)
    a, b = K.bootstrap_intervals(r, 200), K.bootstrap_intervals(r, 200)
    assert a == b and set(a) == {"sharpe", "sortino", "cagr", "max_dd", "calmar"} and all(low <= high for _, low, high in a.values())
    assert a["sharpe"][1] < a["sharpe"][0] < a["sharpe"][2] and K.bootstrap_intervals(r, 200, seed=1) != a
    rng = np.random.default_rng(42)
    p = 1 / 300**0.5
    starts, sizes = rng.integers(0, 300, size=int(300 * p * 3)), rng.geometric(p, size=int(300 * p * 3))
    first = np.concatenate([np.arange(s, s + n) % 300 for s, n in zip(starts, sizes)])[:300]
    assert (next(K.stationary_bootstrap(300, 1)) == first).all()
    with pytest.raises(ValueError):
        K.bootstrap_intervals(np.array([0.1, np.nan]))


@pytest.mark.parametrize("groups, tests, n", [(6, 2, 60), (5, 3, 62), (4, 1, 41)])
def test_cross_validation_rows_against_the_kernel(spark, groups, tests, n):
    labels = spark.createDataFrame([(i, min(i + 3, n - 1)) for i in range(n)], "ix long, end_ix long")
    rows = B.cpcv_rows(labels, groups, 0.05, tests).collect()
    got = {}
    for r in rows:
        got.setdefault(r.split, {"test": set(), "train": set(), "left out": set()})[r.role].add(r.ix)
    want = sorted((sorted(map(int, t)), sorted(map(int, a))) for t, a in K.cpcv_splits(n, groups, tests, np.minimum(np.arange(n) + 3, n - 1), int(n * 0.05)))
    assert sorted((sorted(v["test"]), sorted(v["train"])) for v in got.values()) == want


def test_refit_sees_training_rows_only(spark):
    n = 120
    frame = spark.createDataFrame([(d, float(i)) for i, d in enumerate(weekdays("2020-01-01", "2020-12-31")[:n])], "dt date, ret double")
    got = B.cpcv_refit(frame, lambda t: {"sum": float(t["ret"].sum()), "n": len(t)}, lambda t, p: p["sum"] + t["ret"].sum(), horizon=5).collect()
    splits = list(K.cpcv_splits(n, 6, 2, np.minimum(np.arange(n) + 5, n - 1), int(n * 0.01)))
    assert sorted((r.n_train, r.n_test, r.score) for r in got) == sorted((len(a), len(t), float(a.sum() + t.sum())) for t, a in splits)


def test_walk_forward_regimes_know_no_future(spark):
    rng = np.random.default_rng(1)
    days = weekdays("2020-01-01", "2021-06-30")
    x = np.concatenate([rng.normal(0, 1, (200, 1)), rng.normal(8, 1, (len(days) - 200, 1))]) @ np.ones((1, 2)) + rng.normal(0, 0.5, (len(days), 2))
    rows = spark.createDataFrame([(d, [float(v) for v in r]) for d, r in zip(days, x)], "dt date, x array<double>")
    at = [days[50], days[190], days[-1]]
    dates = spark.createDataFrame([(d,) for d in at], "rebalance_dt date")
    got = {r.rebalance_dt: r.regime for r in R.walk_forward(rows, dates, restarts=2, rounds=20).collect()}
    early = {r.rebalance_dt: r.regime for r in R.walk_forward(rows.where(F.col("dt") <= F.lit(at[1])), dates.where(F.col("rebalance_dt") <= F.lit(at[1])), restarts=2, rounds=20).collect()}
    assert got[at[0]] == "UNKNOWN" and got[at[1]] == early[at[1]] != "UNKNOWN" and got[at[2]] == "CONTRACTION"
    assert R.latest(R.detect(rows, 1, 10))[0] == 1 and R.latest(rows.select("dt", F.array(F.lit(1.0)).alias("p")).limit(5)) == (2, [0.0, 0.0, 1.0])
    none = spark.createDataFrame([], "dt date, x array<double>")
    assert {r.regime for r in R.walk_forward(none, dates).collect()} == {"UNKNOWN"}


def test_model_over_blocks_equals_the_kernel(spark):
    rng = np.random.default_rng(0)
    n, at = 150, np.repeat([0, 1, 2, 0, 2], 30)
    x = rng.normal(size=(n, 3)) * 0.5 + np.array([0, 3, -3])[at][:, None]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i), [float(v) for v in x[i]]) for i in range(n)]
    states = spark.createDataFrame(rows, "dt date, x array<double>")
    blocks = H.blocks_of(states, 40)  # the last one is not full
    score, fits, centre = H.fit(blocks, [n, n, 95], [0, 1, 0], rounds=12)
    for i, (t, seed) in enumerate([(n, 0), (n, 1), (95, 0)]):
        post, want, _ = K.student_hmm(x[:t], seed=seed, rounds=12)
        assert score[i] == pytest.approx(want, rel=1e-10)
        if i < 2:
            got = H.posteriors(blocks, fits.of(np.array([i])), centre, [0, 1, 2]).orderBy("dt").toPandas()
            np.testing.assert_allclose(np.stack(got["p"]), post, atol=1e-8)
        else:
            np.testing.assert_allclose(H.expectation(blocks, fits.of(np.array([i])), centre)[3]["final"][0], post[-1], atol=1e-8)
    post, _, _ = max((K.student_hmm(x, seed=s, rounds=12) for s in range(2)), key=lambda f: f[1])
    got = R.detect(states, 2, 12, block=40).orderBy("dt").toPandas()
    np.testing.assert_allclose(np.stack(got["p"]), R.by_label(post, x), atol=1e-8)
    with pytest.raises(ValueError):
        R.detect(states.limit(2))


def test_causal_states_know_no_future(spark):
    rng = np.random.default_rng(2)
    days = weekdays("2020-01-01", "2020-06-30")
    raw = [(s, d, None if rng.random() < 0.1 and d != days[0] else float(rng.normal())) for s in "abc" for d in days]
    frame = spark.createDataFrame(raw, "series string, dt date, x double")
    whole = {r.dt: r.x for r in R.causal_states(frame, list("abc"), 20).collect()}
    part = {r.dt: r.x for r in R.causal_states(frame.where(F.col("dt") <= F.lit(days[60])), list("abc"), 20).collect()}
    assert part and all(whole[d] == pytest.approx(x) for d, x in part.items()) and min(whole) >= days[19]
    with pytest.raises(ValueError):
        R.causal_states(frame, ["a", "b"])


def test_headlines_by_ticker_and_scoring(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    head = spark.createDataFrame([(at(11), "A", 1.0), (at(15), "A", 0.0), (at(15, 1), "A", 9.0), (at(10, 23), "A", 9.0), (at(12), "B", None), (at(13), "B", -1.0)], "ts timestamp, ticker string, sentiment double")
    got = {r.ticker: (r.n, r.score, r.confidence) for r in news.by_ticker(head, "2024-01-15").collect()}
    assert got == {"A": (2, 0.5, 0.2), "B": (1, -1.0, 0.1)} and news.has_signal(news.by_ticker(head, "2024-01-15"))
    assert not news.has_signal(news.by_ticker(head, "2020-01-15"))

    def model(texts):
        if "boom" in texts:
            raise RuntimeError("no model")
        return [("Positive", 0.5) if "up" in t else ("negative", 1.0) if "down" in t else ("?", 1.0) for t in texts]

    text = spark.createDataFrame([("up",), ("down",), (None,), ("flat",)], "headline string").coalesce(1)
    assert [r.sentiment for r in news.score(text, model).collect()] == [0.5, -1.0, 0.0, 0.0]
    assert {r.sentiment for r in news.score(text.union(spark.createDataFrame([("boom",)], "headline string")).coalesce(1), model).collect()} == {0.0}
    labels = spark.createDataFrame([("POSITIVE",), ("negative",), ("x",), (None,)], "l string").select(news.label_score(F.col("l")).alias("s"))
    assert [r.s for r in labels.collect()] == [1.0, -1.0, 0.0, 0.0]


def test_daily_runs_repeat_and_catch_up(spark, tmp_path):
    days = weekdays("2024-01-01", "2024-03-15")
    prices = spark.createDataFrame([(a, d, 100 * (1 + g) ** i) for a, g in (("a", 0.01), ("b", 0.0)) for i, d in enumerate(days)], "asset string, dt date, price double").cache()
    half = lambda returns, asof: spark.createDataFrame([("a", 0.5), ("b", 0.5)], "asset string, w double")
    broker = ledger.Broker(spark, str(tmp_path / "book"), capital=1000.0)
    runner = D.DailyRunner(broker, prices, half, min_history=5, cost=lambda old, new, nav: 0.01)
    sunday = dt.date(2024, 2, 4)
    for _ in range(2):
        out = runner.run(sunday)
        assert out["date"] == dt.date(2024, 2, 2) and out["rebalanced"] and out["nav"] == pytest.approx(990)
    nxt = runner.run(dt.date(2024, 2, 5))
    assert not nxt["rebalanced"] and nxt["nav"] == pytest.approx(990 * 1.005)
    late = runner.run(dt.date(2024, 3, 1))
    assert late["rebalanced"] and late["nav"] < runner.broker.nav_before("2024-03-01") * (1 + 0.5 * (1.01**19 - 1))
    assert broker.last_rebalance_date() == dt.date(2024, 3, 1) == broker.last_nav_date() and broker.state()["weights"] == {"a": 0.5, "b": 0.5}
    with pytest.raises(ValueError):
        runner.run(dt.date(2023, 1, 1))
    broker.reset()
    assert broker.state() == {"date": None, "weights": {}, "nav": 1000.0}


def test_triggers_and_staleness():
    day, now = dt.date(2024, 1, 10), {"a": 0.5, "b": 0.5}
    ask = lambda **k: D.rebalance_reason(**({"day": day, "last": None, "current": now, "candidate": now, "regime_changed": False, "losses": 0.0} | k))
    assert ask(last=dt.date(2024, 1, 8), regime_changed=True) == (False, "cooldown") and ask(candidate=None) == (False, "optimization_failed")
    assert ask(current={}) == (True, "empty_portfolio") and ask(regime_changed=True) == (True, "regime_change")
    assert ask(candidate={"a": 0.6, "b": 0.4}) == (True, "signal_drift") and ask(candidate={"a": 0.54, "b": 0.46}) == (False, "no_trigger")
    assert ask(losses=0.05) == (True, "risk_breach") and ask() == (False, "no_trigger")
    monday = dt.date(2024, 1, 8)
    assert D.last_trading_day(monday) == dt.date(2024, 1, 5) and D.is_stale(None, monday)
    assert not D.is_stale(dt.date(2024, 1, 5), monday) and not D.is_stale(dt.date(2024, 1, 4), monday) and D.is_stale(dt.date(2024, 1, 3), monday)
    assert D.report_due(dt.date(2024, 1, 5), False) and not D.report_due(monday, False) and D.report_due(monday, True)


def test_execution_order_and_degraded_cycles(spark, tmp_path):
    broker = ledger.Broker(spark, str(tmp_path / "b"), capital=100.0)
    book = spark.createDataFrame([("a", 1.0)], "asset string, w double")
    rets = lambda r: spark.createDataFrame([("a", r)], "asset string, ret double")
    first = D.execute(broker, dt.date(2024, 1, 1), rets(0.1), book)
    assert first["traded"] and first["nav"] == pytest.approx(99.9)
    assert D.execute(broker, dt.date(2024, 1, 2), rets(None), book) == {"nav": None, "traded": False}
    assert D.execute(broker, dt.date(2024, 1, 3), rets(0.1), spark.createDataFrame([("a", 2.0)], "asset string, w double"))["traded"] is False

    def fail(*_):
        raise RuntimeError("down")

    ok = {"data": lambda d: {"day": d}, "regime": lambda d: {"label": 0, "p": [1, 0, 0], "changed": True}, "signal": lambda r, d: {"views": r["label"]}, "portfolio": lambda s, d, r: {"trade": True, "s": s}, "execution": lambda c, d: {"nav": 1}, "report": lambda c, d: None}
    cycle = D.Cycle(**ok)
    assert cycle.run(dt.date(2024, 1, 1))["degraded"] == []
    cycle.regime = fail
    out = cycle.run(dt.date(2024, 1, 2))
    assert out["regime"] == {"label": 0, "p": [1, 0, 0], "changed": False} and out["choice"]["trade"]
    assert D.Cycle(**(ok | {"regime": fail})).run(dt.date(2024, 1, 1))["regime"]["label"] == 2
    sick = D.Cycle(**(ok | {k: fail for k in ("signal", "portfolio", "execution", "report")})).run(dt.date(2024, 1, 1))
    assert sick["degraded"] == ["signal", "portfolio", "execution", "report"] and sick["choice"] == {"trade": False, "reason": "no_trigger"}
    assert D.Cycle(**(ok | {"data": fail})).run(dt.date(2024, 1, 1)) == {"status": "aborted"}
    means = spark.createDataFrame([("a", 0, 0.1), ("a", 1, -0.2), ("a", 2, 0.0)], "asset string, regime int, mu double")
    assert D.expected_returns(means, [0.5, 0.5, 0.0]).first().mu == pytest.approx(-0.05)
    assert D.book_losses(spark.createDataFrame([("a", dt.date(2024, 1, 1), -0.1), ("a", dt.date(2024, 1, 2), 0.1)], "asset string, dt date, ret double"), {"a": 0.5}) == pytest.approx(0.05)


def test_store_loader_and_sources(spark, tmp_path):
    days = weekdays("2024-01-01", "2024-01-10")
    quotes, macro = str(tmp_path / "quotes"), str(tmp_path / "macro")
    spark.createDataFrame([("a", d, float(10 + i) if i != 2 else float("nan")) for i, d in enumerate(days)], "asset string, dt date, price double").write.parquet(quotes)
    spark.createDataFrame([("y", days[0], 1.0), ("y", days[3], 2.0)], "series string, dt date, x double").write.parquet(macro)
    store = S.Store(spark, str(tmp_path / "store"))
    gone, here = S.ParquetSource(spark, str(tmp_path / "no"), name="gone"), S.ParquetSource(spark, quotes, macro, lags={"y": 1})
    loader = S.Loader(store, [gone, here])
    got = [r.price for r in loader.get_prices(["a", "zz"], "2024-01-02", "2024-01-08").orderBy("dt").collect()]
    assert got == [11.0, 11.0, 13.0, 14.0, 15.0] and len(store.list()) == 1
    simple = loader.get_returns(["a", "zz"], "2024-01-02", "2024-01-08", "simple").orderBy("dt").collect()
    assert [r.ret for r in simple] == pytest.approx([0, 2 / 11, 1 / 13, 1 / 14]) and len(store.list()) == 1
    with pytest.raises(ValueError):
        P.returns_of(loader.get_prices(["a", "zz"], "2024-01-02", "2024-01-08"), "odd")
    y = {r.dt: r.x for r in loader.get_macro(["y", "none"], "2024-01-01", "2024-01-10").collect()}
    assert min(y) == days[1] and y[days[3]] == 1.0 and y[days[4]] == 2.0
    with pytest.raises(LookupError):
        S.Loader(store, [gone]).source()
    assert store.load("nothing") is None and not store.exists("nothing")
    store.save("k1", spark.range(1)), store.save("k1", spark.range(2)), store.save("k2", spark.range(3))
    assert store.load("k1").count() == 2 and store.newest("k") == "k2" and store.delete("k2") and "k2" not in store.list()


def test_store_names_are_apart_and_saves_are_atomic(spark, tmp_path):
    keys = ["BRK/B", "BRK_B", "BRK.B", "BRK%2fB", "x" * 300, "x" * 299 + "y", "é", "A~B"]
    assert len({S.path_name(k) for k in keys}) == len(keys) and all(len(S.path_name(k)) <= 120 for k in keys)
    store = S.Store(spark, str(tmp_path / "s"))
    for i, k in enumerate(keys):
        assert not store.exists(k)
        store.save(k, spark.range(i + 1))
    assert [store.load(k).count() for k in keys] == list(range(1, 9)) and store.list() == sorted(keys)
    # a reader of the old table is not disturbed by a save
    store.save("k", spark.range(3))
    reader = store.load("k")
    store.save("k", spark.range(5))
    assert reader.count() == 3 and store.load("k").count() == 5

    class Crash(S.Store):
        def _publish(self, folder, manifest):
            raise OSError("between the steps")

    with pytest.raises(OSError):
        Crash(spark, str(tmp_path / "s")).save("k", spark.range(9))
    assert store.load("k").count() == 5
    store.save("k", spark.range(7))
    assert store.load("k").count() == 7 and store.delete("k") and not store.exists("k")


def test_ledger_sells_everything_and_replaces_orders(spark, tmp_path):
    b = ledger.Broker(spark, str(tmp_path / "b"), capital=100.0)
    book = lambda **w: spark.createDataFrame([(k, float(v)) for k, v in w.items()], "asset string, w double")
    b.rebalance("2024-01-02", book(x=0.6, y=0.4))
    assert b.rebalance("2024-01-03", spark.createDataFrame([], "asset string, w double")) == pytest.approx(0.001)
    assert b.weights_before("2024-01-04").count() == 0 and b.state()["weights"] == {} and str(b.last_rebalance_date()) == "2024-01-03"
    assert b.record_nav("2024-01-04", spark.createDataFrame([("x", 0.5)], "asset string, ret double")) == 100.0
    assert b.rebalance("2024-01-05", book(x=1.0)) == pytest.approx(0.001)
    b.rebalance("2024-01-08", book(x=0.5))
    assert b.orders.read().where("dt = '2024-01-08'").count() == 1
    b.rebalance("2024-01-08", book(x=1.0))  # run again with a target that needs no trade
    assert b.orders.read().where("dt = '2024-01-08'").count() == 0 and b.state()["weights"] == {"x": 1.0}


def test_headline_store_keeps_the_first_story_of_a_timestamp(spark, tmp_path):
    store = ledger.Table(spark, str(tmp_path / "news"), "dt date, ts timestamp, key string, headline string, story_id string")
    at = [dt.datetime(2024, 1, d, 9) for d in (1, 1, 2, 3)]
    head = lambda *rows: spark.createDataFrame(list(rows), "ts timestamp, key string, headline string, story_id string")
    news.append(store, head((at[0], "k", "b", "s2"), (at[2], "k", "c", "s3")))
    for _ in range(2):
        news.append(store, head((at[1], "z", "a", "s1"), (at[3], "k", "d", "s4"), (at[3], "z", "e", "s5")))
    got = [(r.ts, r.story_id) for r in news.load(store, "2024-01-01", "2024-01-03").orderBy("ts").collect()]
    assert got == [(at[0], "s1"), (at[2], "s3"), (at[3], "s4")] and news.load(store, "2024-01-02", "2024-01-02").count() == 1


def test_cross_validation_of_a_grid_refits_on_training_rows(spark):
    rng = np.random.default_rng(3)
    n, r = 90, {}
    for c in "ab":
        r[c] = rng.normal(0.001, 0.01, n)
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(i), float(x)) for c, v in r.items() for i, x in enumerate(v)]
    got = {x.split: x for x in B.cpcv_grid(spark.createDataFrame(rows, "config string, dt date, ret double"), 6, 2, 0.02, 4).collect()}
    ratio = lambda v: v.mean() / v.std(ddof=1) * 252**0.5
    splits = list(K.cpcv_splits(n, 6, 2, np.minimum(np.arange(n) + 4, n - 1), int(n * 0.02)))
    assert len(got) == len(splits) == 15
    want = []
    for test, train in splits:
        best = max("ab", key=lambda c: ratio(r[c][train]))
        want.append((len(train), len(test), best, pytest.approx(ratio(r[best][train])), pytest.approx(ratio(r[best][test]))))
    for x in got.values():
        groups = [g for g in range(6) if x.split >> g & 1]
        k = [i for i, (test, _) in enumerate(splits) if {t * 6 // n for t in test} == set(groups)][0]
        assert (x.n_train, x.n_test, x.config, x.train_sharpe, x.score) == want[k]


def test_rolling_covariances_of_tiles_against_pandas(spark):
    rng = np.random.default_rng(8)
    wide = pd.DataFrame(rng.normal(0, 0.02, (75, 5)), index=weekdays("2020-01-01", "2020-04-14")[:75], columns=list("abcde"))
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["f"] = np.nan  # an asset without returns
    panel = long(spark, wide)
    for tile, block in ((64, 64), (2, 16)):
        out = M.rolling_covariance(panel, 20, 2, block, tile).toPandas()
        assert len(out) == 56 * 21 and (out["a"] <= out["b"]).all()
        got = out.set_index(["dt", "a", "b"])["cov"].astype(float)
        for i in (19, 40, 74):
            part = wide.iloc[i - 19 : i + 1]
            for a in "abcdef":
                for b in "abcdef":
                    if a <= b:
                        w = part[[a, b]].dropna() if a != b else part[[a]].dropna()
                        want = np.cov(w.to_numpy().T)[0, 1] if a != b and len(w) > 1 else w[a].var() if len(w) > 1 else np.nan
                        assert got[wide.index[i], a, b] == pytest.approx(want, nan_ok=True, abs=1e-15)


def test_mean_variance_reaches_the_optimum():
    rng = np.random.default_rng(0)
    for i in range(200):
        n = int(rng.integers(3, 9))
        a = rng.normal(size=(n + 3, n)) * 0.2
        cov, mu = a.T @ a / (n + 3) + 1e-4 * np.eye(n), rng.normal(size=n) * 0.05
        cost, low, high = float(rng.choice([0, 0.005, 0.02])), float(rng.choice([0, 0.02])), float(rng.choice([0.4, 0.6, 1.0]))
        before = rng.dirichlet(np.ones(n)) if i % 2 else np.full(n, 1 / n)
        w = K.mean_variance(mu, cov, before, 2.5, cost, low, high)
        assert w.sum() == pytest.approx(1, abs=1e-9) and (w >= low - 1e-9).all() and (w <= high + 1e-9).all()
        assert K.duality_gap(w, mu - 2.5 * cov @ w, before, cost, low, high) < 1e-9
    # the bound itself: linear programmes by vertices of a fine grid
    gain, before = np.array([0.1, 0.05, -0.2]), np.array([0.2, 0.5, 0.3])
    grid = [np.array([x, y, 1 - x - y]) for x in np.arange(0, 0.81, 0.01) for y in np.arange(0, 0.81, 0.01) if -1e-9 <= 1 - x - y <= 0.8]
    value = lambda v: gain @ v - 0.08 * np.abs(v - before).sum()
    assert K.duality_gap(before, gain, before, 0.08, 0.0, 0.8) == pytest.approx(max(map(value, grid)) - value(before), abs=1e-9)


def test_ward_by_chain_orders_leaves_as_the_plain_search():
    def plain(d):
        sq = ((d[:, None] - d[None]) ** 2).sum(axis=2)
        np.fill_diagonal(sq, np.inf)
        groups, size = {i: [i] for i in range(len(d))}, np.ones(len(d))
        while len(groups) > 1:
            live = sorted(groups)
            sub = sq[np.ix_(live, live)]
            i, j = sorted(live[k] for k in np.unravel_index(sub.argmin(), sub.shape))
            for k in live:
                if k not in (i, j):
                    sq[i, k] = sq[k, i] = ((size[i] + size[k]) * sq[i, k] + (size[j] + size[k]) * sq[j, k] - size[k] * sq[i, j]) / (size[i] + size[j] + size[k])
            groups[i] += groups.pop(j)
            size[i] += size[j]
        return next(iter(groups.values()))

    rng = np.random.default_rng(1)
    for _ in range(60):
        c = np.corrcoef(rng.normal(size=(int(rng.integers(2, 14)), 50)))
        d = np.sqrt(np.clip((1 - c) / 2, 0, None))
        assert K.ward_order(d) == plain(d)


def test_bootstrap_by_draw_equals_the_kernel(spark):
    r = np.random.default_rng(5).normal(0.001, 0.01, 120)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(r)]
    got = {x.metric: (x.point, x.low, x.high) for x in B.bootstrap_intervals(spark.createDataFrame(rows, "dt date, ret double"), 60).collect()}
    want = K.bootstrap_intervals(r, 60)
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)


def test_records_and_change_logs(spark, tmp_path):
    e = S.Experiment("t", ("a", "b"), "2020-01-01", "2021-01-01", {"x": 1})
    assert S.Experiment.from_json(e.to_json()) == e and len(e.hash) == 16 and e.override(name="u").hash != e.hash
    with pytest.raises(KeyError):
        e.override(nme="u")
    for p in ({"x": 1}, {"x": 1}, {"x": 2}):
        ledger.record_trial(spark, str(tmp_path / "trials"), "t", p, {"sharpe": 1.0})
    trials = S.read_trials(spark, str(tmp_path / "trials"))
    assert trials.count() == 3 and ledger.distinct_trials(trials) == 2
    raw = spark.createDataFrame([("2020-01-01", "A.N", "Joiner"), ("2020-02-01", "A.N", "leave ")], "Date string, RIC string, Change string")
    assert [r.change for r in S.read_changes(raw).orderBy("dt").collect()] == ["join", "leave"]
    with pytest.raises(Exception, match="join or leave"):
        S.read_changes(raw.unionByName(spark.createDataFrame([("2020-03-01", "A.N", "merge")], raw.schema))).collect()
    with pytest.raises(KeyError):
        S.resolve_column(["a"], "b")
    asked = []

    def fetch(names):
        asked.append(names)
        return spark.createDataFrame([(n, 1.0) for n in names if n != "ghost"], "asset string, ret double")

    have = spark.createDataFrame([("a", 1.0)], "asset string, ret double")
    out = S.fetch_missing(have, spark.createDataFrame([(x,) for x in ("a", "b", "c", "ghost")], "asset string"), fetch, 2)
    assert asked == [["b", "c"], ["ghost"]] and sorted(r.asset for r in out.collect()) == ["a", "b", "c"]
    tickers = spark.createDataFrame([("A.B.N",), (".SPX",)], "r string").select(P.ticker(F.col("r")).alias("a"), P.ticker(F.col("r"), True).alias("b"))
    assert [tuple(r) for r in tickers.collect()] == [("A", "A.B"), ("", ".SPX")]
    ends = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 1, 15),)], "d date").select(P.next_month_end(F.col("d")).alias("e"))
    assert [r.e for r in ends.collect()] == [dt.date(2024, 2, 29), dt.date(2024, 1, 31)]
    both = P.first_of(spark.createDataFrame([("y", 1, None), ("y", 2, 5.0)], "s string, d int, x double"), spark.createDataFrame([("y", 1, 3.0), ("y", 3, 4.0)], "s string, d int, x double"), "s", "d")
    assert sorted((r.d, r.x) for r in both.collect()) == [(1, 3.0), (2, 5.0), (3, 4.0)]
    pct = P.percent_returns(spark.createDataFrame([("a", dt.date(2024, 1, 1), 5.0), ("a", dt.date(2024, 1, 2), None), ("a", dt.date(2025, 1, 1), 1.0)], "asset string, dt date, ret double"), "2024-01-01", "2024-12-31")
    assert [r.ret for r in pct.collect()] == [0.05]


def test_toggle_against_counting(spark):
    rng = np.random.default_rng(8)
    log = [(dt.date(2020, 1, 1) + dt.timedelta(int(i)), int(a)) for i, a in zip(rng.integers(0, 200, 80), rng.integers(0, 8, 80))]
    current, snaps = {1, 3, 20}, [dt.date(2020, m, 28) for m in range(1, 8)]
    got = universe.baskets_by_toggle(
        spark.createDataFrame(log, "dt date, asset long"), spark.createDataFrame([(a,) for a in current], "asset long"), spark.createDataFrame([(s,) for s in snaps], "snapshot_dt date")
    )
    want = {(s, a) for s in snaps for a in {*current, *(a for _, a in log)} if ((a in current) + sum(d > s for d, b in log if b == a)) % 2}
    assert {(r.snapshot_dt, r.asset) for r in got.collect()} == want and got.count() == len(want)
    assert {r.asset for r in universe.basket_at(got, "2020-03").collect()} == {a for s, a in want if s.month == 3}
    empty = universe.baskets_by_toggle(spark.createDataFrame([], "dt date, asset long"), spark.createDataFrame([(1,)], "asset long"), spark.createDataFrame([(snaps[0],)], "snapshot_dt date"))
    assert [r.asset for r in empty.collect()] == [1]


def test_overlay_verdict_of_a_hedge(spark):
    n = 40
    core = [0.02 if i % 4 else -0.05 for i in range(n)]
    rows = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(31 * i), c, -c / 2 + 0.01 + 0.001 * (i % 3)) for i, c in enumerate(core)], "dt date, core double, overlay double")
    r = B.overlay_on_core(rows, 0.5).first()
    assert r.criterion_a and r.criterion_b and r.criterion_c and r.combined_maxdd < r.core_maxdd
    assert not B.overlay_on_core(rows.withColumn("core", F.lit(0.01)), 0.5).first().passed


def test_smoothing_as_a_stream_in_two_batches(spark, tmp_path):
    from sparrowgrid.streaming.regimes import smoothed

    rng = np.random.default_rng(5)
    days = weekdays("2024-01-01", "2024-02-29")
    rows = [(s, d, int(rng.integers(0, 3)), float(rng.uniform(0.4, 1))) for s in ("a", "b") for d in days]
    kind = "series string, dt date, regime int, confidence double"
    want = {tuple(r) for r in R.smooth(spark.createDataFrame(rows, kind)).collect()}
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (days[:20], days[20:]):
        spark.createDataFrame([r for r in rows if r[1] in part], kind).coalesce(1).write.mode("append").parquet(src)
        q = smoothed(spark.readStream.schema(kind).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want and len(want) == len(rows)


def test_members_are_scored_against_their_own_market(spark):
    from sparrowgrid.operators import search as S

    rng = np.random.default_rng(9)
    days = weekdays("2020-01-01", "2021-12-31")
    wide = pd.DataFrame(rng.normal(0, 0.01, (len(days), 5)), columns=list("abcde"), index=days)
    at = days[-1]
    got = {r.asset: r for r in S.basket_idiovol(long(spark, wide), baskets(spark, [at], ["a", "b", "c", "ghost"])).collect()}
    m = wide[["a", "b", "c"]]
    market = m.mean(axis=1)
    assert set(got) == {"a", "b", "c"}
    for c in m:
        resid = m[c] - m[c].rolling(60).cov(market) / market.rolling(60).var() * market
        for d in (63, 126, 252):
            assert got[c][f"idiovol{d}"] == pytest.approx(-resid.iloc[-d:].std(), abs=1e-9)


def test_headline_queries_and_the_mail(spark):
    from sparrowgrid.operators import report

    at = dt.datetime(2024, 1, 1)
    heads = lambda q: spark.createDataFrame([(at, f"{q} up", 1), (at + dt.timedelta(hours=len(q)), q, 2)], "ts timestamp, headline string, story_id long") if q != "bad" else 1 / 0
    got = news.fetch({"k1": "x", "k2": "bad", "k3": "yy"}, heads)
    assert got.count() == 3 and {r.key for r in got.collect()} <= {"k1", "k3"} and news.fetch({"k": "bad"}, heads) is None
    sent = []
    assert report.send("<p>x</p>", "s", ["a@b.c"], "me@b.c", sent.append) and not report.send("", "s", [], "me@b.c", sent.append)
    assert len(sent) == 1 and sent[0]["To"] == "a@b.c"
