import datetime as dt
import math
import os
from collections import Counter

import numpy as np
import pytest

from sparrowgrid.functions import metrics as M
from sparrowgrid.operators import kernels as K
from sparrowgrid.operators import ledger, universe

DATA = "/root/testdata/sf0.001"


def panel(spark, *rets):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([("A", day + dt.timedelta(i), r) for i, r in enumerate(rets)], "asset string, dt date, ret double")


def test_first_day_loss_is_no_drawdown(spark):
    assert M.summary(panel(spark, -0.1, 0.05)).first().max_drawdown == 0


def test_constant_returns_and_no_losses(spark):
    row = M.summary(panel(spark, 0.01, 0.01, 0.01)).first()
    assert row.sharpe == 0 and row.sortino == math.inf and row.calmar == math.inf


def test_explicit_baskets_match_undoing_the_log(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(int(i)) for i in rng.integers(0, 200, 60)]
    log = [(d, int(a), c) for d, a, c in zip(days, rng.integers(0, 6, 60), rng.choice(["join", "leave"], 60))]
    current = {1, 3, 4}
    snaps = [dt.date(2020, m, 28) for m in range(1, 8)]
    got = universe.baskets(
        spark.createDataFrame(log, "dt date, asset long, change string"), spark.createDataFrame([(a,) for a in current], "asset long"),
        spark.createDataFrame([(s,) for s in snaps], "snapshot_dt date"),
    ).collect()
    net = Counter()
    for d, a, c in log:
        net[d, a] += 1 if c == "join" else -1
    want = set()
    for s in snaps:
        members = set(current)
        for (d, a), n in sorted(net.items(), reverse=True):
            if d > s and n:
                members.discard(a) if n > 0 else members.add(a)
        want |= {(s, a) for a in members}
    assert {(r.snapshot_dt, r.asset) for r in got} == want and len(got) == len(want)


def test_kernels_keep_their_invariants():
    x = np.random.default_rng(0).standard_normal((300, 8)) * 0.01
    cov, k = K.ledoit_wolf(x)
    assert 0 <= k <= 1 and np.linalg.eigvalsh(cov)[0] > 0
    w = K.hrp(cov)
    assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
    q = K.mean_variance(np.full(8, 0.01), cov * 252, high=0.3)
    assert abs(q.sum() - 1) < 1e-6 and q.max() <= 0.3 + 1e-9
    post, _, _ = K.student_hmm(x[:, :2], rounds=5)
    assert np.allclose(post.sum(axis=1), 1)
    for test, train in K.cpcv_splits(60, 6, 2, np.minimum(np.arange(60) + 3, 59), 2):
        assert not set(test) & set(train)


def test_bootstrap_is_seeded_and_in_range():
    a, b = (np.stack(list(K.stationary_bootstrap(50, 3, 7))) for _ in range(2))
    assert a.shape == (3, 50) and (a == b).all() and a.min() >= 0 and a.max() < 50


def test_ledger_is_idempotent(spark, tmp_path):
    b = ledger.Broker(spark, str(tmp_path), capital=100.0)
    target = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "asset string, w double")
    rets = spark.createDataFrame([("A", 0.1), ("B", 0.0)], "asset string, ret double")
    for _ in range(2):
        assert b.rebalance("2024-01-01", target) == pytest.approx(0.001)
        assert b.record_nav("2024-01-02", rets) == pytest.approx(105)
    assert b.navs.read().count() == 1 and b.positions.read().count() == 2
    with pytest.raises(ValueError):
        b.record_nav("2024-01-03", rets.where("asset = 'A'"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def plain(v):
        return "" if v is None or v != v else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)[:10]

    sql = e.oracle_sql()
    for name in ("metrics_summary", "tail_risk", "ts_order", "cross_section", "simulate_monthly", "pit_simulation", "walk_forward", "baskets_toggle", "as_of_before", "pbo", "regime_band", "equity_floor", "smoothed_regimes", "correlation_prune", "deflated_sharpe"):
        a, b = e.queries()[name](spark, DATA).toPandas(), con.sql(sql[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns) and len(a) == len(b), name
        x, y = (Counter(tuple(map(plain, r)) for r in z[cols].values.tolist()) for z in (a, b))
        assert sum((x - y).values()) <= len(a) // 500, name  # rounding at a half


def test_regimes_cover_all_days(spark):
    from pyspark.sql import functions as F

    from sparrowgrid.plans.portfolios import regimes

    got = regimes(spark, "/root/testdata/sf0.001").collect()
    days = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderdate").cast("date").alias("dt")).distinct().collect()
    assert len(days) > 756 and sorted(r.dt for r in got) == sorted(d.dt for d in days)
    assert all(r.label in (0, 1, 2) and abs(sum(r.p) - 1) < 1e-5 for r in got)


@pytest.mark.parametrize("name", ["rolling_covariance", "ewma_covariance"])
def test_covariances_of_all_assets(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = {r[:-1]: r[-1] for r in map(tuple, entry.queries()[name](spark, DATA).collect())}
    want = {r[:-1]: r[-1] for r in con.execute(entry.oracle_sql()[name]).fetchall()}
    n = len({k[-1] for k in got})
    assert n > 5 and len({k[-2:] for k in got}) == n * (n + 1) // 2 and got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and abs((got[k] or 0) - (want[k] or 0)) < 2e-10 for k in got)
