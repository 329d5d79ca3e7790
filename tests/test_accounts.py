import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparrowgrid.operators import engine as E
from sparrowgrid.operators import ledger, news
from sparrowgrid.operators import report as R
from sparrowgrid.sources import panel as P
from sparrowgrid.streaming import headlines

DAY = dt.date(2020, 1, 1)


def dates(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


@pytest.mark.parametrize("known", [0, 30])
def test_impact_on_the_running_nav_against_a_daily_loop(spark, known):
    rng = np.random.default_rng(7)
    n, names, lag, window = 60, ["a", "b", "c"], 2, 10
    x = rng.normal(0.001, 0.02, (n, 3))
    signals = {10: [0.5, 0.5, 0.0], 22: [0.2, 0.3, 0.5], 35: [0.0, 1.0, 0.0], 50: [0.4, 0.3, 0.3]}
    adv = {(a, i): float(rng.uniform(1e5, 1e6)) for a in names for i in range(known + 1, n + 1, 3)}
    panel = spark.createDataFrame([(a, d, i + 1, float(x[i, j])) for j, a in enumerate(names) for i, d in enumerate(dates(n))], "asset string, dt date, day_ix long, ret double")
    weights = spark.createDataFrame([(s, a, float(v)) for s, w in signals.items() for a, v in zip(names, w)], "signal_ix long, asset string, w double")
    liquid = spark.createDataFrame([(a, i, v, 0.002) for (a, i), v in adv.items()], "asset string, day_ix long, adv double, spread double")
    nav, held, want = 1e6, None, []
    for ix in range(1, n + 1):
        cost = 0.0
        if ix - lag in signals:
            new = np.array(signals[ix - lag])
            if held is not None:
                moves = np.abs(new - held)
                if ix > known:
                    for j, a in enumerate(names):
                        day = max((i for i in range(1, ix + 1) if (a, i) in adv), default=None)
                        volume, spread = (adv[a, day], 0.002) if day else (1.0, 0.001)
                        vol = x[max(0, ix - 1 - window) : ix - 1, j].std(ddof=1)
                        trade = moves[j] * nav
                        cost += (0.5 * spread * trade + 0.1 * vol * trade**2 / volume + 0.1 * vol * trade**3 / volume**2) / nav
                else:
                    cost = moves.sum() * 10 / 1e4
            held = new
        ret = 0.0 if held is None else float(x[ix - 1] @ held) - cost
        want.append((ret, cost))
        nav *= 1 + ret
    got = E.run_with_impact(panel, weights, liquid, lag, vol_window=window).orderBy("dt").collect()
    np.testing.assert_allclose([(r.ret, r.cost) for r in got], want, atol=1e-12)
    flat = E.run(panel, weights, lag).orderBy("dt").collect()
    both = weights.selectExpr("*", "1 AS c").unionByName(weights.where("signal_ix > 20").selectExpr("*", "2 AS c"))
    grid = E.run(panel, both, lag, 10.0, 0.0, "c")
    assert [r.ret for r in grid.where("c = 1").orderBy("dt").collect()] == pytest.approx([r.ret for r in flat])
    assert [r.ret for r in grid.where("c = 2").orderBy("dt").collect()][:23] == [0.0] * 23


@pytest.mark.parametrize("rows, want", [
    ([(1, 0.5, 3), (2, 0.9, 2), (3, 0.7, 4)], 3), ([(1, -0.5, 3), (2, 0.9, 1)], 2), ([(1, 0.5, 1)], None), ([(2, 0.5, 3), (1, 0.5, 3)], 1), ([], None),
])
def test_calibration_prefers_stable_then_relaxes(spark, rows, want):
    assert E.calibrate(spark.createDataFrame(rows, "c int, sharpe double, stable long"), "c").first().c == want


def test_business_days_against_pandas(spark):
    for lag in (0, 1, 5, 7):
        got = spark.createDataFrame([(d,) for d in dates(21)], "dt date").select("dt", P.add_business_days(P.F.col("dt"), lag).alias("at")).collect()
        for r in got:
            friday = pd.Timestamp(r.dt) - pd.Timedelta(max(0, r.dt.weekday() - 4), "D")
            assert pd.Timestamp(r.at) == friday + pd.offsets.BDay(lag)
    none = spark.createDataFrame([], "series string, dt date, x double")
    assert P.published(none, 3).count() == 0


def test_splice_keeps_an_asset_without_overlap(spark):
    kind = "asset string, dt date, price double"
    first = spark.createDataFrame([("a", dates(5)[2], 10.0), ("a", dates(5)[3], 11.0), ("b", dates(5)[2], 1.0), ("a", dates(5)[0], None)], kind)
    second = spark.createDataFrame([("a", dates(5)[1], 4.0), ("a", dates(5)[2], 5.0), ("a", dates(5)[4], 9.0), ("b", dates(5)[1], 1.0)], kind)
    got = {(r.asset, r.dt.day): r.price for r in P.splice(first, second).collect()}
    assert got == {("a", 2): 8.0, ("a", 3): 10.0, ("a", 4): 11.0, ("b", 3): 1.0}


def test_report_of_one_day_of_none_and_of_many(spark):
    nav = spark.createDataFrame([(d, 100.0 + i) for i, d in enumerate(dates(10))], "dt date, nav double")
    row = R.metrics(nav).first()
    assert (row.nav, row.pnl_day, row.pnl_week, row.pnl_inception, row.max_drawdown) == (109.0, 1.0, 7.0, 9.0, 0.0)
    assert R.metrics(nav.limit(1)).first().pnl_day == 0 and R.metrics(nav.limit(0)).count() == 1
    orders = spark.createDataFrame([(DAY, "<x>", 0.0, 1.0)], "dt date, asset string, old_w double, new_w double")
    page = R.html(nav, orders, "calm")
    assert "&lt;x&gt;" in page and "<polyline" in page and "calm" in page and "No history" in R.html(nav.limit(0))


def test_stream_of_headlines_equals_the_batch_whatever_the_order(spark, tmp_path):
    kind = "ts timestamp, key string, story_id long, sentiment double"
    rng = np.random.default_rng(3)
    start = dt.datetime(2020, 1, 1)
    rows = [(start + dt.timedelta(hours=int(rng.integers(0, 300))), str(rng.choice(["k", "z"])), i, float(rng.integers(-1, 2))) for i in range(400)]
    rng.shuffle(rows)
    batches = [rows[:150], rows[150:300], rows[300:], [(start + dt.timedelta(days=90), "end", 999, 0.0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame([(t, k, int(n), float(v)) for t, k, n, v in b], kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    batch = news.dedupe(spark.createDataFrame([tuple(r) for r in rows], kind))
    told = run(headlines.first_told(stream, "30 days"), "told")
    assert sorted(map(tuple, told.select("ts", "key", "story_id", "sentiment").collect())) == sorted(map(tuple, batch.select("ts", "key", "story_id", "sentiment").collect()))
    windows = run(headlines.windowed_sentiment(stream, late="30 days"), "heads")
    want = batch.groupBy(F.window("ts", "5 days", "1 day").alias("w"), "key").agg(F.count("*").alias("n"), F.avg("sentiment").alias("score"))
    got = {(r.start, r.key): (r.n, r.score) for r in windows.where("key <> 'end'").collect()}
    assert got == {(r.w.start, r.key): (r.n, r.score) for r in want.collect()} and len(got) > 20
    assert all(0 < r.confidence <= 1 for r in headlines.confident(windows).collect())


def test_stream_upserts_repeat(spark, tmp_path):
    table = ledger.Table(spark, str(tmp_path / "nav"), "dt date, nav double")
    spark.createDataFrame([(DAY, 5.0)], "dt date, nav double").write.parquet(str(tmp_path / "navs"))
    for i in range(2):
        days = spark.readStream.schema("dt date, nav double").parquet(str(tmp_path / "navs"))
        assert headlines.upsert_into(days, table).option("checkpointLocation", str(tmp_path / f"c2{i}")).trigger(availableNow=True).start().awaitTermination(60)
    assert [tuple(r) for r in table.read().collect()] == [(DAY, 5.0)]


def test_ledger_windows_do_not_move_on_a_second_run(spark, tmp_path):
    b = ledger.Broker(spark, str(tmp_path / "book"))
    d = [str(x) for x in dates(4)]
    prices = spark.createDataFrame([("a", dates(4)[i], 10.0 * 2**i) for i in (0, 1, 2, 3)] + [("n", dates(4)[3], 1.0)], "asset string, dt date, price double")
    ret = lambda day: {r.asset: r.ret for r in b.period_returns(day, prices).collect()}
    assert ret(d[1])["a"] == 1.0 and b.nav_date_before(d[1]) is None
    b.rebalance(d[0], spark.createDataFrame([("a", 0.5)], "asset string, w double"))
    b.record_nav(d[1], b.period_returns(d[1], prices))
    for _ in range(2):
        assert ret(d[3])["a"] == 3.0 and ret(d[3])["n"] is None
        assert b.record_nav(d[3], b.period_returns(d[3], prices)) == pytest.approx(1.5e6 * 2.5)
    assert b.apply_cost(d[3], 0.1) == pytest.approx(1.5e6 * 2.5 * 0.9)
    with pytest.raises(ValueError):
        b.apply_cost(d[2], 0.1)
