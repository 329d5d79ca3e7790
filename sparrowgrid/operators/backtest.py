"""Monthly cross-sectional simulation: every formation and configuration in one plan."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.timeseries import cs_rank
from ..sources.panel import as_of, cut, stored
from . import kernels as K
from .engine import windowed


def last_day_of(panel: DataFrame, formations: DataFrame) -> DataFrame:
    """(formation, day_ix): the last trading day up to each formation."""
    days = panel.select("dt", "day_ix").distinct().withColumn("all", F.lit(1))  # one row a day
    dates = formations.select("formation").distinct().select(F.col("formation").alias("dt"), F.lit(1).alias("all"))
    return as_of(dates, days, "all", "dt", "day_ix").where("day_ix is not null").select(F.col("dt").alias("formation"), "day_ix")


def momentum_12_1(panel: DataFrame, formations: DataFrame, lookback: int = 252, skip: int = 21, min_obs: int = 200) -> DataFrame:
    """(formation, asset, score): compounded return over rows (-lookback, -skip] up to the formation.

    ``panel`` has day_ix; an asset without a row that day is scored too, one without enough rows
    has a null score. Windows are summed where the panel is read; see ``engine.windowed``.
    """
    if skip == 0:
        raise ValueError("skip=0 leaves an empty window")
    last = last_day_of(panel, formations).withColumn("day_ix", F.col("day_ix") + 1).withColumnRenamed("day_ix", "signal_ix")
    inside = F.when(F.col("back") > skip, F.col("ret"))
    made = windowed(panel, last, lookback, n=F.count(inside), mom=F.product(1 + inside) - 1).drop("signal_ix")
    grid = panel.select("asset").distinct().crossJoin(F.broadcast(last.select("formation")))  # one row a month
    return grid.join(made, ["formation", "asset"], "left").select("formation", "asset", F.when(F.col("n") >= min_obs, F.col("mom")).alias("score"))


def top_weights(scores: DataFrame, decile: float, min_names: int, *by: str) -> DataFrame:
    """Equal weights of the best ceil(n * decile), ties by asset; fewer than ``min_names``: cash."""
    valid = scores.where("score is not null")
    n = F.ceil(F.count("*").over(W.partitionBy(*by)) * decile)
    ranked = valid.withColumns({"n_top": n, "rn": F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "asset"))})
    return ranked.where((F.col("rn") <= F.col("n_top")) & (F.col("n_top") >= min_names)).select(*by, "asset", (1 / F.col("n_top")).alias("w"))


def holding_returns(panel: DataFrame) -> DataFrame:
    """(formation, asset, month_ret): the month after the formation without its first trading day."""
    held = panel.withColumn("formation", F.last_day(F.add_months("dt", -1)))
    first = held.groupBy("formation").agg(F.min("dt").alias("first"), F.count_distinct("dt").alias("n_days"))
    kept = held.join(F.broadcast(first), "formation").where((F.col("dt") > F.col("first")) & (F.col("n_days") >= 2))  # one row a month
    return kept.groupBy("formation", "asset").agg((F.coalesce(F.product(1 + F.col("ret")), F.lit(1.0)) - 1).alias("month_ret"), F.count("ret").alias("n"))


def forward_returns(panel: DataFrame) -> DataFrame:
    """(formation, asset, fwd): the whole month after the formation; an asset of the panel without a
    return in that month counts 0, as an empty product does."""
    held = panel.withColumn("formation", F.last_day(F.add_months("dt", -1)))
    months = held.select("formation").distinct()
    made = held.groupBy("formation", "asset").agg((F.coalesce(F.product(1 + F.col("ret")), F.lit(1.0)) - 1).alias("fwd"))
    grid = panel.select("asset").distinct().crossJoin(F.broadcast(months))  # one row a month
    return grid.join(made, ["formation", "asset"], "left").fillna(0.0, ["fwd"])


def members_of(scores: DataFrame, baskets: DataFrame) -> DataFrame:
    """Scores of the assets in the basket of their formation; ``baskets``: (formation, asset)."""
    return scores.join(baskets.select("formation", "asset").distinct(), ["formation", "asset"], "left_semi")


def simulate_monthly(
    scores: DataFrame, panel: DataFrame, decile: float = 0.10, min_names: int = 20, tc_bps: float = 10.0, *by: str, baskets: DataFrame | None = None,
    of_members: bool = False,
) -> DataFrame:
    """(by..., formation, gross, turnover, cost, net, n_eligible, n_held) for each simulated formation.

    The drift of the weights depends on the last target and that month's returns alone, so the
    turnover compares consecutive rows of a name and is no loop. ``by`` adds dimensions such
    as a configuration. Formations with fewer than two holding days are left out.

    With ``baskets`` (formation, asset), the point-in-time universe, only members are eligible,
    every formation that has a basket is simulated, and n_members and coverage are added: the
    members, and the share of them with a return among the holding days. Columns of ``by`` that
    ``baskets`` has too split the formations, such as into a search window and a holdout, each
    simulated from a fresh start. ``of_members``: ``scores`` hold members alone, and need not meet
    the baskets again. Scores with a column w are picked already: it is the weight of a name held,
    null for others, as ``top_weights`` would give it.
    """
    month = cut(holding_returns(panel))  # four plans read it
    order = month.select("formation").distinct()
    if baskets is None:
        sims = scores.join(F.broadcast(order), "formation")  # one row a month
        rows = sims.select(*by, "formation").distinct()
    else:
        split = [c for c in by if c in baskets.columns]
        basket = baskets.select("formation", "asset", *split).distinct().join(F.broadcast(order), "formation")
        rows = basket.select("formation", *split).distinct()
        sims = scores.drop(*split) if of_members else members_of(scores.drop(*split), basket)
        sims = sims.join(F.broadcast(rows), "formation")  # one row a month
        if rest := [c for c in by if c not in split]:
            rows = rows.crossJoin(F.broadcast(scores.select(*rest).distinct()))  # one row a configuration
    seq = rows.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("formation")))
    picked = sims.where("w is not null").select(*by, "formation", "asset", "w") if "w" in scores.columns else top_weights(sims, decile, min_names, *by, "formation")
    w = picked.join(month, ["formation", "asset"], "left").fillna(0.0, ["month_ret"])
    w = stored(w.join(seq, [*by, "formation"]).select(*by, "k", "asset", "w", "month_ret"))  # a row a name held
    grown = F.col("w") * (1 + F.col("month_ret"))
    total = F.broadcast(w.groupBy(*by, "k").agg(F.sum(grown).alias("total")))  # one row a formation and configuration
    drift = w.join(total, [*by, "k"]).select(*by, "k", "asset", "w", F.when(F.col("total") > 0, grown / F.col("total")).otherwise(F.col("w")).alias("d"))
    # a name's holdings in a row: one shuffle; what it drifted to is traded against the next weight, or sold
    line = W.partitionBy(*by, "asset").orderBy("k")
    before = F.when(F.lag("k").over(line) == F.col("k") - 1, F.lag("d").over(line)).otherwise(0.0)
    sold = F.when(F.coalesce(F.lead("k").over(line) == F.col("k") + 1, F.lit(False)), 0.0).otherwise(F.col("d"))
    drift = drift.withColumns({"_bought": F.abs(F.col("w") - before), "_sold": F.abs(sold)})
    trades = drift.select(*by, F.inline(F.array(F.struct("k", F.col("_bought").alias("trade")), F.struct((F.col("k") + 1).alias("k"), F.col("_sold").alias("trade")))))
    turn = trades.groupBy(*by, "k").agg(F.sum("trade").alias("turnover"))
    held = w.groupBy(*by, "k").agg(F.sum(F.col("w") * F.col("month_ret")).alias("gross"), F.count("*").alias("n_held"))
    eligible = sims.groupBy(*by, "formation").agg(F.count("score").alias("n_eligible"))
    out = seq.join(eligible, [*by, "formation"], "left").join(held, [*by, "k"], "left").join(turn, [*by, "k"], "left")
    out = out.fillna(0.0, ["gross", "turnover"]).fillna(0, ["n_held", "n_eligible"]).withColumn("cost", F.col("turnover") * (tc_bps / 1e4))
    out = out.withColumn("net", F.col("gross") - F.col("cost")).drop("k")
    if baskets is None:
        return out
    priced = basket.join(month.where("n > 0").select("formation", "asset", F.lit(1).alias("priced")), ["formation", "asset"], "left")
    cover = priced.groupBy("formation").agg(F.count("*").alias("n_members"), (F.count("priced") / F.count("*")).alias("coverage"))
    return out.join(cover, "formation")


def rank_ic(scores: DataFrame, forward: DataFrame, *by: str) -> DataFrame:
    """Spearman correlation of scores and next returns per formation, null below three names."""
    by = by or ("formation",)
    both = scores.join(forward, ["formation", "asset"]).where("score is not null and fwd is not null").repartition(*by)  # one shuffle for all windows
    ranked = both.withColumns({"a": cs_rank("score", *by), "b": cs_rank("fwd", *by)})
    corr = F.covar_samp("a", "b") / F.nullif(F.stddev_samp("a") * F.stddev_samp("b"), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= 3, corr).alias("ic"), F.count("*").alias("n"))


def pbo_splits(returns: DataFrame, partitions: int = 16) -> DataFrame:
    """(split, logit) of combinatorially symmetric cross-validation.

    ``returns``: (period_ix from 0, config, ret), complete. The sums of a configuration's partitions
    stand in one row, with the sums over every subset of the first and of the second half of them: a
    split is two lookups there. What meets the splits is a row a configuration, and what is shuffled
    is a row a split and task: first the best configuration inside, then how many results outside
    the best one's ranks above.
    """
    t = returns.select(F.count_distinct("period_ix").alias("t")).first().t
    s = max(2, min(partitions - partitions % 2, t // 2 * 2))
    size, rest = t // s, t % s
    edge = rest * (size + 1)
    part = F.when(F.col("period_ix") < edge, F.floor(F.col("period_ix") / (size + 1))).otherwise(rest + F.floor((F.col("period_ix") - edge) / size))
    pieces = {"n": F.lit(1), "x": F.col("ret"), "xx": F.col("ret") ** 2}
    inside = lambda k, c: F.when((F.col("part") == k) & F.col("ret").isNotNull(), c)
    half = s // 2
    sums = [
        F.array(*[F.coalesce(F.sum(inside(k, c)), F.lit(0)).cast("double") for k in range(at, at + half)]).alias(f"{side}{name}")
        for name, c in pieces.items() for side, at in (("low_", 0), ("high_", half))
    ]
    subset = lambda c: F.transform(
        F.sequence(F.lit(0), F.lit((1 << half) - 1)),
        lambda m: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: F.when(F.getbit(m, k) == 1, F.get(c, k)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v),
    )
    wide = returns.withColumn("part", part.cast("int")).groupBy("config").agg(*sums)
    wide = cut(wide.select("config", *[subset(F.col(f"{side}{name}")).alias(f"{side}{name}") for name in pieces for side in ("low_", "high_")]))  # a row a configuration
    splits = returns.sparkSession.range(1 << s).where(F.bit_count("id") == half).withColumnRenamed("id", "split")
    both = wide.crossJoin(F.broadcast(splits))  # at most C(16, 8) rows a configuration
    full = (1 << half) - 1
    low, high = F.col("split").bitwiseAND(full).cast("int"), F.shiftright("split", half).cast("int")

    def ratio(bit: int) -> Column:
        at = (low, high) if bit else (full - low, full - high)
        n, x, xx = (F.get(f"low_{c}", at[0]) + F.get(f"high_{c}", at[1]) for c in pieces)
        return F.when((n > 1) & (xx - x * x / n > 1e-18), (x / n) / F.sqrt((xx - x * x / n) / (n - 1)))

    sr = both.select("split", "config", ratio(1).alias("is_sr"), ratio(0).alias("oos_sr"))
    best = sr.where("is_sr is not null").groupBy("split").agg(F.min(F.struct((-F.col("is_sr")).alias("lost"), "config", "oos_sr")).alias("best"))
    best = F.broadcast(best.select("split", F.col("best.config").alias("best"), F.col("best.oos_sr").alias("own")).where("own is not null"))  # a row a split
    beats = F.count_if(F.col("oos_sr") < F.col("own")) + (F.count_if(F.col("oos_sr") == F.col("own")) + 1) / 2
    rank = sr.where("oos_sr is not null").join(best, "split").groupBy("split").agg(F.first("best").alias("best"), (beats / F.count("*")).alias("rank"))
    q = F.least(F.greatest("rank", F.lit(1e-6)), F.lit(1 - 1e-6))
    return rank.select("split", "best", F.ln(q / (1 - q)).alias("logit"))


def cpcv_rows(labels: DataFrame, groups: int = 6, embargo: float = 0.01, test_groups: int = 2) -> DataFrame:
    """(split, ix, role): combinatorial purged cross-validation, all splits in one plan.

    ``labels``: (ix from 0, end_ix), the row on which each label is known. ``split`` is a set of
    ``test_groups`` groups, its bits. Rows of those groups are 'test'; the others 'train', but for
    those whose label ends inside a test group and those of the embargo after one, which are
    'left out'. The bounds of a group follow from its number.
    """
    n = labels.agg(F.count("*").alias("n"))
    splits = labels.sparkSession.range(1 << groups).where(F.bit_count("id") == test_groups).withColumnRenamed("id", "split")
    rows = labels.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(splits))  # one row; C(groups, test_groups) rows
    size, rest = F.floor(F.col("n") / groups), F.col("n") % groups
    edge = rest * (size + 1)
    of = lambda x: F.when(x < edge, F.floor(x / (size + 1))).otherwise(rest + F.floor((x - edge) / F.greatest(size, F.lit(1))))
    tested = lambda g: F.coalesce(F.get(F.array(*[F.getbit("split", F.lit(i)) for i in range(groups)]), g.cast("int")) == 1, F.lit(False))
    low = lambda g: g * size + F.least(g, rest)
    after = F.lit(False)
    for g in range(groups):  # rows of the embargo after group g
        start = low(F.lit(g + 1))
        after = after | ((F.getbit("split", F.lit(g)) == 1) & (F.col("ix") >= start) & (F.col("ix") < start + F.floor(F.col("n") * embargo)))
    end = (F.col("end_ix") >= 0) & (F.col("end_ix") < F.col("n")) & tested(of(F.col("end_ix")))
    role = F.when(tested(of(F.col("ix"))), "test").when(end | after, "left out").otherwise("train")
    return rows.select("split", "ix", role.alias("role"))


def cpcv_refit(returns: DataFrame, calibrate, evaluate, groups: int = 6, test_groups: int = 2, embargo: float = 0.01, horizon: int = 21) -> DataFrame:
    """(split, n_train, n_test, params, score): parameters chosen on each split's training rows alone,
    scored on its test rows; a split is a group.

    ``returns``: (dt, ret) or more columns, a row a day. ``calibrate(train)`` gives a dict,
    ``evaluate(test, params)`` a number, both on pandas frames in order of dt; a label is known
    ``horizon`` rows later.
    """
    rows = returns.withColumn("ix", (F.row_number().over(W.orderBy("dt")) - 1).cast("long"))  # one row a day
    last = F.count("*").over(W.partitionBy()) - 1
    labels = rows.select("ix", F.least(F.col("ix") + horizon, last).alias("end_ix"))
    used = cpcv_rows(labels, groups, embargo, test_groups).where("role <> 'left out'").join(F.broadcast(rows), "ix")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        train, test = (pdf[pdf["role"] == r].drop(columns=["split", "role", "ix"]).reset_index(drop=True) for r in ("train", "test"))
        params = calibrate(train)
        return pd.DataFrame([{"split": pdf["split"].iloc[0], "n_train": len(train), "n_test": len(test), "params": json.dumps(params, sort_keys=True), "score": float(evaluate(test, params))}])

    return used.groupBy("split").applyInPandas(run, "split long, n_train long, n_test long, params string, score double")


def cpcv_grid(returns: DataFrame, groups: int = 6, test_groups: int = 2, embargo: float = 0.01, horizon: int = 21) -> DataFrame:
    """(split, n_train, n_test, config, train_sharpe, score): of a strategy's configurations the one with the best
    Sharpe ratio on each split's training rows (ties: the smallest), scored on its test rows.

    ``returns``: (config, dt, ret), daily returns of each configuration, whose weights know the past
    alone; a label is known ``horizon`` rows later. Splits are a dimension: their roles meet the
    returns by row, and what is shuffled is a row a split, configuration and task.
    """
    days = returns.select("dt").distinct().withColumn("ix", (F.row_number().over(W.orderBy("dt")) - 1).cast("long"))  # one row a day
    days = cut(days)
    last = days.agg(F.max("ix")).first()[0]
    labels = days.select("ix", F.least(F.col("ix") + horizon, F.lit(last)).alias("end_ix"))
    roles = cpcv_rows(labels, groups, embargo, test_groups).where("role <> 'left out'").join(F.broadcast(days), "ix")
    each = returns.join(roles.select("dt", "split", (F.col("role") == "train").alias("train")), "dt")
    sharpe = lambda keep: F.coalesce(
        F.avg(F.when(keep, F.col("ret"))) / F.nullif(F.stddev_samp(F.when(keep, F.col("ret"))), F.lit(0.0)) * 252**0.5, F.lit(0.0)
    )
    scored = each.groupBy("split", "config").agg(
        F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"), sharpe(F.col("train")).alias("train_sharpe"), sharpe(~F.col("train")).alias("score")
    )
    best = scored.groupBy("split").agg(F.min(F.struct((-F.col("train_sharpe")).alias("lost"), "config", "n_train", "n_test", "train_sharpe", "score")).alias("b"))
    return best.select("split", "b.n_train", "b.n_test", "b.config", "b.train_sharpe", "b.score")


def bootstrap_intervals(returns: DataFrame, reps: int = 1000, confidence: float = 0.95, seed: int = 42, p: float | None = None) -> DataFrame:
    """(metric, point, low, high): stationary-bootstrap intervals of five metrics of one series.

    ``returns``: (dt, ret), a row a day, without gaps. The blocks of all draws come from one stream of
    random numbers on the driver, some 3 sqrt(T) a draw; they are dealt by draw, where they become
    rows and meet the returns. Draws are the groups of what follows, the series itself is draw -1.
    """
    rows = cut(returns.select((F.row_number().over(W.orderBy("dt")) - 1).alias("ix"), "ret"))  # one row a day
    t, bad = rows.agg(F.count("*"), F.count_if(F.col("ret").isNull() | F.isnan("ret"))).first()
    if not t or bad:
        raise ValueError("needs returns without gaps")
    drawn = [(k, *b) for k, b in enumerate(K.stationary_blocks(t, reps, seed, p))]
    blocks = pd.DataFrame({
        "rep": np.repeat([k for k, _, _ in drawn], [len(s) for _, s, _ in drawn]), "start": np.concatenate([s for _, s, _ in drawn]),
        "size": np.concatenate([n for _, _, n in drawn]), "at": np.concatenate([np.cumsum(n) - n for _, _, n in drawn]),
    })
    blocks = returns.sparkSession.createDataFrame(blocks[blocks["at"] < t]).repartition("rep")
    each = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.least("size", t - F.col("at")) - 1)))
    each = each.select("rep", (F.col("at") + F.col("o")).alias("dt"), ((F.col("start") + F.col("o")) % t).alias("ix"))
    made = each.join(rows, "ix").select("rep", "dt", "ret").unionByName(rows.select(F.lit(-1).cast("long").alias("rep"), F.col("ix").cast("long").alias("dt"), "ret"))
    found = M.summary(made, "rep").select("rep", "sharpe", "sortino", F.col("annualized_return").alias("cagr"), F.col("max_drawdown").alias("max_dd"), "calmar")
    long = found.unpivot("rep", ["sharpe", "sortino", "cagr", "max_dd", "calmar"], "metric", "x")
    side = (1 - confidence) / 2
    draw = F.when(F.col("rep") >= 0, F.col("x"))
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("rep") < 0, F.col("x"))).alias("point"), F.percentile(draw, F.lit(side)).alias("low"), F.percentile(draw, F.lit(1 - side)).alias("high")
    )


def overlay_on_core(returns: DataFrame, share: float, stress: float = 0.10) -> DataFrame:
    """One row: drawdowns and Calmar ratios of the core and of core + share * overlay, the overlay's
    total and its correlations, four criteria and whether all hold.

    ``returns``: (dt, core, overlay), a row per month; the stress months are the core's worst
    ``stress`` of them (linear quantile), null below three. The overlay must lower the drawdown
    (a), raise the Calmar ratio (b), not lose (c), and not move with the core (d).
    """
    w = W.orderBy("dt").rowsBetween(W.unboundedPreceding, 0)  # one row a month
    nav = returns.where("core is not null and overlay is not null").withColumn("combined", F.col("core") + share * F.col("overlay"))
    nav = nav.withColumns({"a": F.product(1 + F.col("core")).over(w), "b": F.product(1 + F.col("combined")).over(w)})
    nav = nav.withColumns({"da": 1 - F.col("a") / F.max("a").over(w), "db": 1 - F.col("b") / F.max("b").over(w)})
    low = nav.agg(F.percentile("core", F.lit(stress)).alias("q"))
    rows = nav.crossJoin(F.broadcast(low)).withColumn("bad", F.col("core") <= F.col("q"))  # one row of q

    def corr(keep: Column) -> Column:
        x, y = F.when(keep, F.col("overlay")), F.when(keep, F.col("core"))
        return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))

    cagr = lambda c: F.pow(F.product(1 + F.col(c)), F.lit(12.0) / F.count("*")) - 1
    one = rows.agg(
        F.max("da").alias("core_maxdd"), F.max("db").alias("combined_maxdd"), cagr("core").alias("ca"), cagr("combined").alias("cb"),
        (F.product(1 + F.col("overlay")) - 1).alias("overlay_cum"),
        corr(F.lit(True)).alias("corr_full"), F.when(F.count_if("bad") >= 3, corr(F.col("bad"))).alias("corr_stress"),
    )
    calmar = lambda gain, drop: F.when(F.col(drop) > 0, F.col(gain) / F.col(drop)).otherwise(float("inf"))
    one = one.withColumns({"core_calmar": calmar("ca", "core_maxdd"), "combined_calmar": calmar("cb", "combined_maxdd")}).drop("ca", "cb")
    sure = lambda c: F.coalesce(c, F.lit(False))
    one = one.withColumns({
        "criterion_a": sure(F.col("combined_maxdd") < F.col("core_maxdd")), "criterion_b": sure(F.col("combined_calmar") > F.col("core_calmar")),
        "criterion_c": sure(F.col("overlay_cum") >= 0), "criterion_d": sure((F.col("corr_full") <= 0) & (F.col("corr_stress") <= 0)),
    })
    return one.withColumn("passed", F.col("criterion_a") & F.col("criterion_b") & F.col("criterion_c") & F.col("criterion_d"))


def overlay_months(positions: DataFrame, market: DataFrame, fee: Column, roll: Column) -> DataFrame:
    """(dt, position, overlay): position times excess return, less what trades and rolls cost.

    ``positions``: (formation, position); ``market``: (dt, excess, notional, rolls), a row per
    holding month, ``rolls`` being whether contracts roll in it. ``fee`` and ``roll`` are the cost
    of one contract traded or rolled, in money; a change of position is traded in the next month
    that is held.
    """
    held = positions.select(F.last_day(F.date_add("formation", 1)).alias("dt"), "position").join(market, "dt")
    before = F.coalesce(F.lag("position").over(W.orderBy("dt")), F.lit(0))  # one row a month
    traded = F.abs(F.col("position") - before) * fee / F.col("notional")
    rolled = F.when(F.col("rolls"), F.abs(F.col("position")) * roll / F.col("notional")).otherwise(0.0)
    return held.select("dt", "position", (F.col("position") * F.col("excess") - traded - rolled).alias("overlay"))
