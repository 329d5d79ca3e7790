"""From regime posteriors to asset-class scores, and the confirmation of regime changes."""

from __future__ import annotations

from itertools import chain

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import expanding_robust_z, forward_fill
from ..sources.panel import as_of
from . import hmm as H

log = logging.getLogger(__name__)

# Score of each asset class in expansion, contraction and transition.
REGIME_TABLE = {"equity": (0.8, -0.8, 0.0), "bonds": (-0.3, 0.6, 0.1), "gold": (0.1, 0.5, 0.3), "cash": (-0.2, 0.4, 0.2)}
MIN_NEWS = 0.05
# Names of the regimes by label.
NAMES = ("EXPANSION", "CONTRACTION", "TRANSITION")
UNKNOWN = "UNKNOWN"


def check_table(scores: dict[str, tuple[float, float, float]]) -> None:
    if not scores or any(len(v) != 3 or any(not -1 <= s <= 1 for s in v) for v in scores.values()):
        raise ValueError("three scores between -1 and 1 for each asset class")


def composite(posterior: DataFrame, news: DataFrame | None = None, scores: dict | None = None, macro_weight: float = 0.7) -> DataFrame:
    """(dt, asset_class, score, confidence, regime) from (dt, p array of three).

    Confidence is one less the normalised entropy. ``news``: (dt, asset_class, score, n), the share
    ``n`` being its confidence; from MIN_NEWS on it is blended in, and a class it lacks counts 0.
    """
    scores = REGIME_TABLE if scores is None else scores
    check_table(scores)
    table = F.create_map(*chain.from_iterable((F.lit(a), F.array(*map(F.lit, v))) for a, v in scores.items()))
    safe = F.transform("p", lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-12)))
    entropy = -F.aggregate(safe, F.lit(0.0), lambda s, v: s + v * F.ln(v)) / F.ln(F.lit(3.0))
    rows = posterior.select(
        "dt", "p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy)).alias("confidence"),
        (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("regime"), F.explode(table).alias("asset_class", "by_regime"),
    )
    macro = sum((F.col("p")[i] * F.col("by_regime")[i] for i in range(3)), F.lit(0.0))
    out = rows.select("dt", "asset_class", macro.alias("score"), "confidence", "regime")
    if news is None:
        return out
    heard = news.groupBy(F.col("dt").alias("_dt")).agg(F.max("n").alias("_n"))
    by_class = news.select(F.col("dt").alias("_d"), F.col("asset_class").alias("_a"), F.col("score").alias("_s"))
    out = out.join(heard, F.col("dt") == F.col("_dt"), "left").join(by_class, (F.col("dt") == F.col("_d")) & (F.col("asset_class") == F.col("_a")), "left")
    mixed = macro_weight * F.col("score") + (1 - macro_weight) * F.coalesce("_s", F.lit(0.0)) * F.col("_n")
    return out.select("dt", "asset_class", F.when(F.col("_n") >= MIN_NEWS, mixed).otherwise(F.col("score")).alias("score"), "confidence", "regime")


def conditional_means(panel: DataFrame, labels: DataFrame, regimes: tuple[int, ...] = (0, 1, 2), least: int = 20) -> DataFrame:
    """(asset, regime, mu): annualised mean return on the days of each regime.

    ``labels``: (dt, regime), carried forward over the days of the panel. A regime with fewer than
    ``least`` days has the unconditional mean; an asset without returns on its days has null.
    """
    days = panel.select("dt").distinct().withColumn("all", F.lit(1))  # one row a day
    known = as_of(days, labels.select("dt", "regime").withColumn("all", F.lit(1)), "all", "dt", "regime").where("regime is not null").drop("all")
    enough = known.groupBy("regime").agg((F.count("*") >= least).alias("enough"))
    inside = panel.join(F.broadcast(known), "dt").groupBy("asset", "regime").agg((F.avg("ret") * 252).alias("inside"))
    whole = panel.groupBy("asset").agg((F.avg("ret") * 252).alias("whole")).withColumn("regime", F.explode(F.array(*map(F.lit, regimes))))
    out = whole.join(inside, ["asset", "regime"], "left").join(F.broadcast(enough), "regime", "left")  # one row a regime
    return out.select("asset", "regime", F.when(F.col("enough"), F.col("inside")).otherwise(F.col("whole")).alias("mu"))


def confirm(rows, min_prob: float = 0.65, min_periods: int = 2, state=(None, None, 0)):
    """((regime, confidence) of each row, state): a change counts once ``min_periods`` rows in a row
    signal it. The state is the regime held, the one that waits, and how often it was seen."""
    held, waiting, seen = state
    out = []
    for regime, sure in rows:
        if not 0 <= sure <= 1:
            raise ValueError("confidence must lie between 0 and 1")
        differs = held is not None and regime != held
        if differs and sure >= min_prob:
            seen = seen + 1 if regime == waiting else 1
            waiting = regime
        else:
            waiting, seen = None, 0
        if not differs or seen >= min_periods:
            held, waiting, seen = regime, None, 0
            out.append((regime, sure))
        else:
            out.append((held, 1.0))
    return out, (held, waiting, seen)


def smooth(labels: DataFrame, min_prob: float = 0.65, min_periods: int = 2) -> DataFrame:
    """(series, dt, regime, confidence): changes of regime as ``confirm`` lets them pass.

    ``labels`` has the same columns. Each row depends on the state that the row before left, so a
    series is one group; it has a row per rebalance. A held regime has confidence 1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        out, _ = confirm(zip(pdf["regime"], pdf["confidence"]), min_prob, min_periods)
        return pdf[["series", "dt"]].assign(regime=[r for r, _ in out], confidence=[c for _, c in out])

    kind = dict(labels.dtypes)["series"]
    return labels.select("series", "dt", F.col("regime").cast("int").alias("regime"), "confidence").groupBy("series").applyInPandas(
        run, f"series {kind}, dt date, regime int, confidence double"
    )


def label_order(days: np.ndarray, total: np.ndarray, ascending: bool = True) -> list[int]:
    """The states in order of labels, from the number of days of each and their sum of the naming
    series: the lowest mean is the expansion, the highest the contraction. No days: mean 0."""
    mean = np.where(days > 0, total / np.maximum(days, 1), 0.0)
    low, middle, high = mean.argsort() if ascending else mean.argsort()[::-1]
    return [int(low), int(high), int(middle)]


def by_label(post: np.ndarray, x: np.ndarray, named_by: int = 0, ascending: bool = True) -> np.ndarray:
    """Posterior with its states in order of labels, see ``label_order``."""
    at = post.argmax(axis=1)
    return post[:, label_order(np.bincount(at, minlength=3), np.bincount(at, x[:, named_by], 3), ascending)]


def detect(states: DataFrame, restarts: int = 5, rounds: int = 100, named_by: int = 0, block: int = H.BLOCK) -> DataFrame:
    """(dt, label, p): the most likely state of each day and the posterior of the three, all days.

    ``states``: (dt, x array), complete. All restarts are fitted in the same passes over blocks of days;
    the best likelihood counts, of equal ones the first. States are named by the means of series
    ``named_by``; see ``label_order``.
    """
    blocks = H.blocks_of(states, block)
    n = blocks.agg(F.sum(F.size("days"))).first()[0] or 0
    if n < 3 or blocks.select(F.explode("days").alias("d")).where(F.col("d.x").isNull() | F.exists("d.x", lambda v: v.isNull() | F.isnan(v))).count():
        raise ValueError("state variables must be complete, and three days or more")
    score, fits, centre = H.fit(blocks, np.full(restarts, n), np.arange(restarts), rounds=rounds)
    best = fits.of(np.array([int(np.nanargmax(score))]))
    sums = H.expectation(blocks, best, centre)[3]
    order = label_order(sums["days"][0], sums["total"][0, :, named_by] + sums["days"][0] * centre[named_by])
    out = H.posteriors(blocks, best, centre, order)
    return out.select("dt", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"), "p")


def walk_forward(states: DataFrame, dates: DataFrame, min_obs: int = 120, restarts: int = 5, rounds: int = 100, named_by: int = 0, block: int = H.BLOCK) -> DataFrame:
    """(rebalance_dt, regime): the regime on each date, of a model fitted on the rows up to it alone.

    Rows with gaps are left out. A history of fewer than ``min_obs`` rows, and a fit that fails, are
    UNKNOWN. The fits of all dates and restarts go through the blocks of days together, each seeing
    the days up to its date: no fit has a history of its own. ``states`` should be causal, such as
    ``causal_states``, or later rows change earlier ones.
    """
    whole = states.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    blocks = H.blocks_of(whole, block)
    grid = dates.select("rebalance_dt").distinct()
    numbered = blocks.select(F.explode("days").alias("d")).select("d.dt", F.lit(1).alias("n"))
    known = grid.join(numbered, F.col("dt") <= F.col("rebalance_dt"), "left").groupBy("rebalance_dt").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    seen = [(r.rebalance_dt, r.n) for r in known.orderBy("rebalance_dt").collect()]  # a row a rebalance
    out = dict.fromkeys((at for at, _ in seen), UNKNOWN)
    todo = [(at, n) for at, n in seen if n >= max(min_obs, 3)]
    if todo:
        rows, seeds = np.repeat([n for _, n in todo], restarts), np.tile(np.arange(restarts), len(todo))
        score, fits, centre = H.fit(blocks, rows, seeds, rounds=rounds)
        good = np.where(np.isfinite(score), score, -np.inf).reshape(len(todo), restarts)
        best = good.argmax(axis=1) + np.arange(len(todo)) * restarts
        sums = H.expectation(blocks, fits.of(best), centre)[3]
        for i, (at, n) in enumerate(todo):
            p = sums["final"][i]
            if np.isfinite(good[i].max()) and np.isfinite(p).all():
                order = label_order(sums["days"][i], sums["total"][i, :, named_by] + sums["days"][i] * centre[named_by])
                out[at] = NAMES[int(p[order].argmax())]
            else:
                log.error("no regime at %s", at)
    return states.sparkSession.createDataFrame(list(out.items()), "rebalance_dt date, regime string")


def causal_states(raw: DataFrame, series: list[str], min_obs: int = 60) -> DataFrame:
    """(dt, x array): the series (series, dt, x) as expanding robust z-scores, in the order given. Gaps are
    filled forward first; days on which one has no score yet are left out. A day's scores depend on
    no later day, so the fits of all dates share them. Fewer than three series are an error.
    """
    if len(series) < 3:
        raise ValueError("three state variables or more")
    days = raw.select("dt").distinct().crossJoin(F.broadcast(raw.sparkSession.createDataFrame([(s,) for s in series], "series string")))  # a row a series
    filled = days.join(raw, ["series", "dt"], "left").withColumn("x", forward_fill())
    scored = expanding_robust_z(filled, min_obs=min_obs).where("z is not null")
    wide = scored.groupBy("dt").pivot("series", series).agg(F.first("z"))
    return wide.where(" and ".join(f"`{s}` is not null" for s in series)).select("dt", F.array(*[F.col(f"`{s}`") for s in series]).alias("x"))


def latest(posterior: DataFrame, least: int = 60) -> tuple[int, list[float]]:
    """(label, p) of the last day of (dt, p); fewer than ``least`` days are a transition for sure."""
    row = posterior.agg(F.count("*").alias("n"), F.max_by("p", "dt").alias("p")).first()
    if row.n < least:
        return 2, [0.0, 0.0, 1.0]
    return int(np.argmax(row.p)), list(row.p)
