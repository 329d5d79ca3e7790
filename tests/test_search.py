import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from sparrowgrid.functions import features as X
from sparrowgrid.operators import engine as E
from sparrowgrid.operators import regime as R
from sparrowgrid.operators import search as S

DAY = dt.date(2020, 1, 31)


def dates(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


@pytest.mark.parametrize("lag", [0, 1, 3, 7])
def test_waiting_signals_are_replaced(spark, lag):
    signals = [2, 4, 5, 9, 10, 11, 20]
    waiting, due, want = None, 0, []
    for day in range(40):
        if waiting is not None:
            due -= 1
            if due <= 0:
                want.append((day, waiting))
                waiting = None
        if day in signals:
            if lag == 0:
                want.append((day, day))
            elif waiting is None:
                waiting, due = day, lag
            else:
                waiting = day
    got = E.executions(spark.createDataFrame([(s,) for s in signals], "signal_ix long"), lag).orderBy("k").collect()
    assert [(r.from_ix, r.signal_ix) for r in got] == want
    assert E.executions(spark.createDataFrame([], "signal_ix long"), lag).count() == 0


def test_smoothing_confirms_after_two(spark):
    rows = [(0, 0.9), (1, 0.9), (0, 0.5), (1, 0.9), (1, 0.8), (2, 0.3), (2, 0.9), (1, 0.4), (2, 0.9), (2, 0.7)]
    data = [("s", d, r, c) for d, (r, c) in zip(dates(len(rows)), rows)]
    got = R.smooth(spark.createDataFrame(data, "series string, dt date, regime int, confidence double")).orderBy("dt").collect()
    assert [r.regime for r in got] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 2]
    assert [r.confidence for r in got] == [0.9, 1.0, 0.5, 1.0, 0.8, 1.0, 1.0, 0.4, 1.0, 0.7]


def test_composite_of_a_sure_and_an_even_posterior(spark):
    post = spark.createDataFrame([(DAY, [1.0, 0.0, 0.0]), (DAY + dt.timedelta(1), [1 / 3] * 3)], "dt date, p array<double>")
    got = {(r.dt, r.asset_class): r for r in R.composite(post).collect()}
    assert got[DAY, "equity"].score == pytest.approx(0.8) and got[DAY, "equity"].confidence == pytest.approx(1)
    assert got[DAY + dt.timedelta(1), "bonds"].score == pytest.approx(0.4 / 3) and got[DAY + dt.timedelta(1), "bonds"].confidence == pytest.approx(0)
    with pytest.raises(ValueError):
        R.check_table({"equity": (2.0, 0.0, 0.0)})


def test_features_against_pandas(spark):
    rng = np.random.default_rng(5)
    x = pd.Series(np.where(rng.random(90) < 0.2, np.nan, rng.normal(100, 5, 90)), index=pd.DatetimeIndex(dates(90)))
    data = [("s", d, None if math.isnan(v) else float(v)) for d, v in zip(dates(90), x)]
    f = X.expanding_robust_z(spark.createDataFrame(data, "series string, dt date, x double"), min_obs=30).select(
        "dt", X.forward_fill().alias("f"), X.time_interpolation().alias("i"), "z", X.rate_of_change(5).alias("r")
    )
    got = f.orderBy("dt").toPandas()
    e = x.expanding(30)
    want = {"f": x.ffill(), "i": x.interpolate(method="time"), "z": (x - e.median()) / (e.quantile(0.75) - e.quantile(0.25)), "r": x.ffill() / x.ffill().shift(5) - 1}
    for c, w in want.items():
        np.testing.assert_allclose(got[c].astype(float).to_numpy(), w.to_numpy(), rtol=1e-9, err_msg=c)


def test_search_space_has_54_configurations(spark):
    rng = np.random.default_rng(1)
    n, names = 820, ["a", "b", "c", "d"]
    x = rng.normal(0, 0.01, (n, len(names)))
    data = [(a, d, i + 1, float(x[i, j])) for j, a in enumerate(names) for i, d in enumerate(dates(n))]
    panel = spark.createDataFrame(data, "asset string, dt date, day_ix long, ret double")
    last = dates(n)[-1]
    got = S.search_space(panel, spark.createDataFrame([(last,)], "formation date")).toPandas()
    assert got["config"].nunique() == 54 and set(got.groupby("config").size()) == {4}
    wide = pd.DataFrame(x, columns=names)
    score = got.pivot(index="asset", columns="config", values="score")
    rank = lambda s: (s.rank() / s.count()).sort_index()
    mom = (1 + wide.iloc[-252:-21]).prod() - 1
    resid = wide.sub(wide.mean(axis=1) , axis=0) * 0
    market = wide.mean(axis=1)
    for c in names:
        resid[c] = wide[c] - wide[c].rolling(60).cov(market) / market.rolling(60).var() * market
    vol = wide.iloc[-126:].std()
    want = {
        "B:mom12_1:rank": rank(mom), "B:mom1_0:rank": rank(1 - (1 + wide.iloc[-21:]).prod()), "B:retvol126:rank": rank(-vol),
        "B:idiovol63:rank": rank(-resid.iloc[-63:].std()), "B:skew63:rank": rank(-wide.iloc[-63:].skew()), "B:maxret21:rank": rank(-wide.iloc[-21:].max()),
        "B:autocorr63:rank": rank(wide.iloc[-64:].apply(lambda s: s.autocorr(1))), "A:k_rev_close1": rank(-wide.iloc[-1]), "C:mom_x_lowvol": rank(mom) * (1 - rank(vol)),
        "A:k_volratio": 2 - rank(wide.iloc[-2:].std() / wide.iloc[-5:].std()) - rank(wide.iloc[-1]),
    }
    for c, w in want.items():
        np.testing.assert_allclose(score[c].to_numpy(), w.to_numpy(), atol=1e-9, err_msg=c)


def test_pruning_keeps_in_order(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=60), rng.normal(size=60)
    cols = {"a": a, "b": b, "c": a + 0.01 * b, "d": np.zeros(60)}
    data = [(i, c, float(v[i])) for c, v in cols.items() for i in range(60)]
    kept = S.correlation_prune(spark.createDataFrame(data, "period int, config string, ret double"))
    assert sorted(r.config for r in kept.collect()) == ["a", "b"]


def test_first_independent_set_is_the_greedy_walk(spark):
    rng = np.random.default_rng(4)
    names = [f"n{i:02d}" for i in range(25)]
    edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.15] + list(zip(names[:6], names[1:7]))
    kept = []
    for n in names:
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    got = S.first_independent(spark.createDataFrame([(n,) for n in names], "config string"), spark.createDataFrame(edges, "a string, b string"))
    assert sorted(r.config for r in got.collect()) == kept


def test_expanding_quantiles_of_a_long_series():
    from sparrowgrid.operators.kernels import expanding_quantiles

    x = np.random.default_rng(0).integers(0, 50, 300).astype(float)  # ties
    q = expanding_quantiles(x, (0.25, 0.5, 0.75))
    np.testing.assert_allclose(q, [np.quantile(x[: i + 1], (0.25, 0.5, 0.75)) for i in range(300)], rtol=1e-12)
    long = np.random.default_rng(1).normal(size=200_000)
    q = expanding_quantiles(long, (0.5,))
    for i in (0, 1, 99_999, 199_999):
        assert q[i, 0] == pytest.approx(np.quantile(long[: i + 1], 0.5))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def sparse(spark, n=150, names="abcdef"):
    """A panel with missing rows and null returns, and baskets of two dates."""
    rng = np.random.default_rng(3)
    data = [(a, d, i + 1, None if rng.random() < 0.05 else float(rng.normal(0, 0.01))) for a in names for i, d in enumerate(dates(n)) if rng.random() < 0.6]
    panel = spark.createDataFrame(data, "asset string, dt date, day_ix long, ret double")
    members = spark.createDataFrame([(dates(n)[k], a) for k, held in ((100, names[:4]), (n - 1, names[1:])) for a in held], "formation date, asset string")
    return data, panel, members


def test_sparse_members_against_pandas(spark):
    data, panel, members = sparse(spark)
    got = {(r.formation, r.asset): r for r in S.characteristics(panel, members, beta_obs=8, baskets=members).collect()}
    long = pd.DataFrame(data, columns=["asset", "dt", "ix", "ret"])
    for f, held in members.toPandas().groupby("formation")["asset"]:
        last = int(long[long["dt"] <= f]["ix"].max())
        own = long[long["asset"].isin(held) & (long["ix"] <= last)]
        market = own.groupby("ix")["ret"].mean()
        for a in held:
            x = own[own["asset"] == a].set_index("ix")["ret"]
            resid = {}
            for i in x.index:
                w = x[(x.index > i - 60) & (x.index <= i)]
                m = market.reindex(w.index)
                both = w.notna() & m.notna()
                if both.sum() >= 8 and x[i] == x[i]:
                    resid[i] = x[i] - np.cov(w[both], m[both])[0, 1] / m.var() * market[i]
            near = lambda d: x[x.index > last - d]
            r = got[f, a]
            assert r.idiovol63 == pytest.approx(-pd.Series({i: v for i, v in resid.items() if i > last - 63}).std(), abs=1e-9)
            assert r.mom3_1 == pytest.approx((1 + near(63)[lambda s: s.index <= last - 21]).prod() - 1, abs=1e-9)
            assert r.retvol21 == pytest.approx(-near(21).std(), abs=1e-9) and r.maxret63 == pytest.approx(-near(63).max(), abs=1e-9)
            assert r.skew63 == pytest.approx(-near(63).skew(), abs=1e-9)
            pairs = [(x[i], x[i - 1]) for i in near(63).index if i - 1 in x.index and x[i] == x[i] and x[i - 1] == x[i - 1]]
            assert r.autocorr63 == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1], abs=1e-9)
            assert (r["_last"] is None) == (last not in x.dropna().index) and r.mom12_1 is None


def test_the_search_space_is_ranked_in_two_shuffles(spark):
    _, panel, members = sparse(spark)
    assert shuffles(S.search_space(panel, members, beta_obs=8, baskets=members)) == 2  # of characteristics by name, and of the seeds' inputs


def test_history_is_not_copied_for_each_formation(spark):
    _, panel, members = sparse(spark)
    plan = S.basket_idiovol(panel, members, beta_obs=8)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("MapInArrow")[0] and "Generate" not in plan


def test_rank_ic_shuffles_scores_once_for_all_windows(spark):
    from sparrowgrid.operators import backtest as B

    scores = spark.createDataFrame([(DAY, c, a, float(i * k)) for k, c in enumerate("xy", 1) for i, a in enumerate("abcd")], "formation date, config string, asset string, score double")
    forward = spark.createDataFrame([(DAY, a, float(-i)) for i, a in enumerate("abcd")], "formation date, asset string, fwd double")
    got = B.rank_ic(scores, forward, "config", "formation")
    assert shuffles(got) <= 3  # two sides of the join, then one by configuration and formation
    assert {(r.config, round(r.ic, 9)) for r in got.collect()} == {("x", -1.0), ("y", -1.0)}


def test_scores_of_members_need_not_meet_the_baskets_again(spark):
    from sparrowgrid.operators import backtest as B

    _, panel, members = sparse(spark)
    months = panel.selectExpr("last_day(dt) AS formation").distinct()
    basket = months.join(spark.createDataFrame([(a,) for a in "abcd"], "asset string"))
    scores = basket.selectExpr("formation", "asset", "'c' AS config", "hash(formation, asset) / 1e9 AS score").localCheckpoint()
    split = basket.selectExpr("formation", "asset", "month(formation) % 2 AS part")
    made = [B.simulate_monthly(scores, panel, 0.5, 1, 10.0, "config", "part", baskets=split, of_members=m) for m in (False, True)]
    a, b = ([tuple(r) for r in m.orderBy("part", "formation").collect()] for m in made)
    assert a == b and a and shuffles(made[1]) < shuffles(made[0])


def test_search_space_picks_as_top_weights_does(spark):
    """Weights made with the ranks are those of a sort of all scores, ties included, and the simulation
    of picked scores gives the same."""
    from sparrowgrid.operators import backtest as B
    from sparrowgrid.sources import panel as P

    panel, days = P.with_day_ix(spark.sql("""SELECT date_add(date'2020-01-01', cast(d AS int)) AS dt, a AS asset, CASE WHEN a % 4 = 1 THEN 0.01 ELSE (a * 7 + d * 13) % 11 / 100 - 0.05 END AS ret
        FROM (SELECT explode(sequence(0, 150)) AS d), (SELECT explode(sequence(1, 12)) AS a) WHERE (a + d) % 5 > 0""")), ("2020-03-31", "2020-04-30")
    members = spark.sql(f"SELECT cast(f AS date) AS formation, a AS asset FROM (SELECT explode(array('{days[0]}', '{days[1]}')) AS f), (SELECT explode(sequence(1, 11)) AS a)")
    plain = S.search_space(panel, members, beta_obs=8, baskets=members)
    picked = P.cut(S.search_space(panel, members, beta_obs=8, baskets=members, pick=(0.3, 3)))
    want = {(r.formation, r.config, r.asset): r.w for r in B.top_weights(plain, 0.3, 3, "config", "formation").collect()}
    got = {(r.formation, r.config, r.asset): r.w for r in picked.where("w is not null").collect()}
    assert want and got == want
    assert picked.count() == plain.count()
    a, b = (B.simulate_monthly(x, panel, 0.3, 3, 10.0, "config", baskets=members, of_members=True).orderBy("config", "formation").collect() for x in (picked.drop("w"), picked))
    assert len(a) == len(b) > 0 and all(x.config == y.config and abs(x.net - y.net) < 1e-12 and abs(x.turnover - y.turnover) < 1e-12 for x, y in zip(a, b))
