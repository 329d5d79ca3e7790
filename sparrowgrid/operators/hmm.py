"""The Student-t hidden Markov model over blocks of time, many fits at once.

Forward and backward vectors are products of one small matrix a day, and products can be formed in
any grouping: each block multiplies its own days, the products of the blocks are linked, and each
block then goes through its days again from the vectors at its edges. Sums over days, which the new
parameters come from, add up over blocks. So no task holds more than a block, and what reaches the
driver in a round is a matrix and a few sums for each block and fit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.panel import cut

BLOCK = 512


@dataclass
class Fits:
    """Parameters of S fits of K states on d series; fit s sees the first ``rows[s]`` days. Series are
    measured from a common centre."""

    rows: np.ndarray  # S
    mean: np.ndarray  # S, K, d
    var: np.ndarray  # S, K, d
    trans: np.ndarray  # S, K, K
    start: np.ndarray  # S, K

    def of(self, which: np.ndarray) -> Fits:
        return Fits(self.rows[which], self.mean[which], self.var[which], self.trans[which], self.start[which])


def blocks_of(states: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, days: array of (ix, dt, x) in order), written; the days of ``states`` (dt, x array) numbered from 0."""
    rows = states.select((F.row_number().over(W.orderBy("dt")) - 1).cast("long").alias("ix"), "dt", "x")  # one row a day
    dealt = rows.withColumn("block", F.floor(F.col("ix") / size)).repartition(states.sparkSession.sparkContext.defaultParallelism, "block")
    return cut(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("ix", "dt", "x"))).alias("days")))  # ``size`` days


def _emissions(x: np.ndarray, ix: np.ndarray, f: Fits, df: float):
    """(relative densities, their logs' maxima, distances): days, fits, states. Days that a fit does not see have density 1."""
    d = x.shape[1]
    dist = np.zeros((len(x), *f.mean.shape[:2]))
    for j in range(d):
        dist += (x[:, j, None, None] - f.mean[None, :, :, j]) ** 2 / f.var[None, :, :, j]
    logp = -0.5 * np.log(f.var).sum(axis=2) - (df + d) / 2 * np.log1p(dist / df)
    top = logp.max(axis=2)
    live = ix[:, None] < f.rows
    return np.where(live[..., None], np.exp(logp - top[..., None]), 1.0), np.where(live, top, 0.0), dist, live


def _steps(b: np.ndarray, ix: np.ndarray, live: np.ndarray, f: Fits) -> np.ndarray:
    """One matrix a day: transition times density; the identity on days that a fit does not see, and
    no transition into the first day."""
    eye = np.eye(f.trans.shape[1])
    move = np.where((ix == 0)[:, None, None, None], eye, f.trans[None])
    return np.where(live[..., None, None], move * b[:, :, None, :], eye)


def _product(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product over the days, scaled, with the log of the scale; neighbours are multiplied level by level."""
    log = np.zeros(steps.shape[1])
    while True:
        size = steps.sum(axis=(2, 3))
        steps, log = steps / size[..., None, None], log + np.log(size).sum(axis=0)
        if len(steps) == 1:
            return steps[0], log
        if len(steps) % 2:
            steps = np.concatenate([steps, np.broadcast_to(np.eye(steps.shape[2]), (1, *steps.shape[1:]))])
        steps = steps[::2] @ steps[1::2]


def _run(blocks: DataFrame, f: Fits, work) -> dict[int, object]:
    """What ``work(ix, x, fits)`` gives for each block, on the driver: sums of a fixed size."""
    sent = blocks.sparkSession.sparkContext.broadcast(f)  # a few numbers a fit

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block, days in zip(pdf["block"], pdf["days"]):
                ix = np.array([day["ix"] for day in days])
                x = np.array([day["x"] for day in days], float)
                if (use := np.flatnonzero(sent.value.rows > ix[0])).size:  # fits that see something of the block
                    yield pd.DataFrame({"block": [block], "found": [pickle.dumps((use, work(block, ix, x, sent.value.of(use), use)))]})

    made = blocks.mapInPandas(run, "block long, found binary").collect()
    return {r.block: pickle.loads(bytes(r.found)) for r in made}


def _edges(products: dict, f: Fits):
    """Forward vectors into and backward vectors out of each block, and the log-likelihood of each fit."""
    s, k = f.start.shape
    v, total, into, out = f.start / f.start.sum(axis=1, keepdims=True), np.log(f.start.sum(axis=1)), {}, {}
    for block in sorted(products):
        use, (p, log, top) = products[block]
        into[block] = v[use]
        w = np.einsum("sk,skj->sj", v[use], p)
        total[use] += np.log(w.sum(axis=1)) + log + top
        v[use] = w / w.sum(axis=1, keepdims=True)
    v = np.ones((s, k)) / k
    for block in sorted(products, reverse=True):
        use, (p, _, _) = products[block]
        out[block] = v[use]
        w = np.einsum("skj,sj->sk", p, v[use])
        v[use] = w / w.sum(axis=1, keepdims=True)
    return into, out, total


def _through(ix, x, f: Fits, into, out, df):
    """Posterior of each day, and what new parameters need, from the vectors at the edges of a block."""
    b, _, dist, live = _emissions(x, ix, f, df)
    steps = _steps(b, ix, live, f)
    n, d = x.shape
    a, back = np.empty((n + 1, *into.shape)), np.empty((n, *out.shape))
    a[0], now = into, out
    for t in range(n):
        v = np.einsum("sk,skj->sj", a[t], steps[t])
        a[t + 1] = v / v.sum(axis=1, keepdims=True)
    for t in reversed(range(n)):
        back[t] = now
        now = np.einsum("skj,sj->sk", steps[t], now)
        now /= now.sum(axis=1, keepdims=True)
    post = a[1:] * back
    post = np.where(live[..., None], post / post.sum(axis=2, keepdims=True), 0.0)
    moves = live & (ix > 0)[:, None]
    ahead = b * back
    pair = (np.einsum("tsk,skj->tsj", a[:-1], f.trans) * ahead).sum(axis=2, keepdims=True)
    xi = f.trans * np.einsum("tsk,tsj->skj", np.where(moves[..., None], a[:-1], 0.0), ahead / pair)
    u = post * (df + d) / (df + dist)
    best, seen = post.argmax(axis=2), live
    sums = {
        "first": np.where((ix == 0)[:, None, None], post, 0.0).sum(axis=0), "final": np.where((ix[:, None] == f.rows - 1)[..., None], post, 0.0).sum(axis=0),
        "xi": xi, "post": post.sum(axis=0), "u": u.sum(axis=0), "ux": np.einsum("tsk,td->skd", u, x), "uxx": np.einsum("tsk,td->skd", u, x * x),
        "days": np.stack([(seen & (best == k)).sum(axis=0) for k in range(f.start.shape[1])], 1),
        "total": np.stack([np.einsum("ts,td->sd", seen & (best == k), x) for k in range(f.start.shape[1])], 1),
    }
    return post, sums


def expectation(blocks: DataFrame, f: Fits, centre: np.ndarray, df: float = 5.0):
    """(vectors into each block, vectors out of it, log-likelihoods, sums over days by name) of the fits."""

    def multiplied(_, ix, x, g, use):
        b, top, _, seen = _emissions(x - centre, ix, g, df)
        return *_product(_steps(b, ix, seen, g)), top.sum(axis=0)

    into, out, total = _edges(_run(blocks, f, multiplied), f)

    def summed(block, ix, x, g, use):
        return _through(ix, x - centre, g, into[block], out[block], df)[1]

    sums: dict[str, np.ndarray] = {}
    for use, found in _run(blocks, f, summed).values():
        for name, v in found.items():
            sums.setdefault(name, np.zeros((len(f.rows), *v.shape[1:])))[use] += v
    return into, out, total, sums


def fit(blocks: DataFrame, rows: np.ndarray, seeds: np.ndarray, states: int = 3, df: float = 5.0, sticky: float = 8.0, rounds: int = 60, close: float = 1e-6):
    """(log-likelihoods, parameters that gave them, centre): EM of a fit for each of ``rows`` and ``seeds``,
    all in the same passes over the blocks.

    A fit ends when a round adds less than ``close`` of its likelihood, after ``rounds`` at the latest,
    and is left alone from then on. A likelihood that is no number ends it too.
    """
    rows, seeds = np.asarray(rows, np.int64), np.asarray(seeds, np.int64)
    drawn = [np.random.default_rng(int(s)).choice(int(t), states, False) for t, s in zip(rows, seeds)]
    asked = sorted({int(i) for ix in drawn for i in ix})
    days = blocks.select(F.explode("days").alias("day")).select("day.ix", "day.x").where(F.col("ix").isin(asked))
    at = {r.ix: np.array(r.x, float) for r in days.collect()}  # ``states`` days a fit
    centre = np.mean(list(at.values()), axis=0)
    s, d = len(rows), len(centre)
    blank = Fits(rows, np.zeros((s, states, d)), np.ones((s, states, d)), np.ones((s, states, states)), np.ones((s, states)))

    def moments(_, ix, x, g, use):
        inside = (ix[:, None] < g.rows).astype(float)
        return inside.T @ (x - centre), inside.T @ (x - centre) ** 2

    one, two = np.zeros((s, d)), np.zeros((s, d))
    for use, (m1, m2) in _run(blocks, blank, moments).values():
        one[use] += m1
        two[use] += m2
    spread = two / rows[:, None] - (one / rows[:, None]) ** 2 + 1e-6
    f = Fits(
        rows, np.array([[at[int(i)] - centre for i in ix] for ix in drawn]), np.repeat(spread[:, None], states, 1),
        np.repeat(((np.eye(states) * sticky + 1) / (sticky + states))[None], s, 0), np.full((s, states), 1 / states),
    )
    last, score, before, live = f.of(np.arange(s)), np.full(s, -np.inf), np.full(s, -np.inf), np.arange(s)
    for _ in range(rounds):
        now = f.of(live)
        with np.errstate(all="ignore"):
            _, _, total, k = expectation(blocks, now, centre, df)
            mean = k["ux"] / k["u"][..., None]
            new = {
                "mean": mean, "var": (k["uxx"] - mean * k["ux"]) / k["post"][..., None] + 1e-6, "trans": k["xi"] + sticky * np.eye(states) + 1e-3, "start": k["first"],
            }
            new["trans"] /= new["trans"].sum(axis=2, keepdims=True)
            ended = ~np.isfinite(total) | (total - before[live] < close * np.abs(total))
        for name, v in new.items():
            getattr(last, name)[live] = getattr(now, name)
            getattr(f, name)[live] = v
        score[live] = before[live] = total
        live = live[~ended]
        if not len(live):
            break
    return score, last, centre


def posteriors(blocks: DataFrame, f: Fits, centre: np.ndarray, states: list[int], df: float = 5.0) -> DataFrame:
    """(dt, p) of the days of one fit, its states in the order of ``states``."""
    into, out, _, _ = expectation(blocks, f, centre, df)
    sent = blocks.sparkSession.sparkContext.broadcast((f, into, out))  # a few numbers a block

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, a, z = sent.value
        for pdf in frames:
            for block, days in zip(pdf["block"], pdf["days"]):
                ix, x = np.array([day["ix"] for day in days]), np.array([day["x"] for day in days], float)
                p = _through(ix, x - centre, g, a[block], z[block], df)[0][:, 0][:, states]
                yield pd.DataFrame({"dt": [day["dt"] for day in days], "p": p.tolist()})

    return blocks.mapInPandas(run, "dt date, p array<double>")
