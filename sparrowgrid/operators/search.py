"""The declared search space of cross-sectional signals: all configurations in one wide plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timeseries as T
from ..sources.panel import cut, stored
from .backtest import last_day_of

# Months back and months skipped of the momentum families, the reversals among
# them, and the windows of the other families; the names of families and, below, of the seeds
# (A:...) and products (C:...).
MOMENTUM = ((12, 1), (9, 1), (6, 1), (3, 1), (1, 0), (24, 13), (36, 13))
REVERSALS = ((1, 0), (24, 13), (36, 13))
WINDOWS = {"retvol": (21, 63, 126, 189, 252), "idiovol": (63, 126, 252), "maxret": (21, 63, 126), "skew": (63, 126, 252), "autocorr": (21, 63, 126)}
MONTH = 21
#: Characteristics that agree to so many decimals tie, whatever the order of their sums.
DIGITS = 10


def families() -> list[str]:
    """Names of the 24 characteristics, higher is preferred."""
    return [f"mom{back}_{skip}" for back, skip in MOMENTUM] + [f"{name}{d}" for name, ds in WINDOWS.items() for d in ds]


class Runs:
    """Sums and moments over runs of rows of one owner each; ``owner`` is sorted and below ``size``."""

    def __init__(self, owner: np.ndarray, size: int):
        self.owner, self.n = owner, np.bincount(owner, minlength=size)
        self.live = np.flatnonzero(self.n)
        self.at = (np.cumsum(self.n) - self.n)[self.live]

    def fold(self, op: np.ufunc, x: np.ndarray) -> np.ndarray:
        """NaN where an owner has no rows."""
        out = np.full(len(self.n), np.nan)
        if len(x):
            out[self.live] = op.reduceat(x, self.at)
        return out

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Less the mean; exactly 0 where nothing varies."""
        if not len(x):
            return x
        x = x - np.repeat(x[self.at], self.n[self.live])
        return x - (self.fold(np.add, x) / np.maximum(self.n, 1))[self.owner]

    def cov(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sample covariance, NaN below two rows."""
        out = self.fold(np.add, self.centred(x) * self.centred(y)) / np.maximum(self.n - 1, 1)
        return np.where(self.n >= 2, out, np.nan)

    def std(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(self.cov(x, x))

    def skew(self, x: np.ndarray) -> np.ndarray:
        """Bias-corrected, NaN below three rows or where nothing varies."""
        n, c = self.n.astype(float), self.centred(x)
        m2, m3 = self.fold(np.add, c * c), self.fold(np.add, c**3)
        return np.where((n >= 3) & (m2 > 0), np.sqrt(n) * m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2), np.nan)


class Histories:
    """The rows of whole assets, in order of asset and day, and the markers to be scored among them."""

    STEP = np.int64(1) << 40

    def __init__(self, number: np.ndarray, day: np.ndarray, ret: np.ndarray, marker: np.ndarray):
        rows, self.marks = np.flatnonzero(~marker), np.flatnonzero(marker)
        self.every = number[rows] * self.STEP + day[rows]
        self.valid = rows[~np.isnan(ret[rows])]
        self.key, self.ret, self.day = number[self.valid] * self.STEP + day[self.valid], ret[self.valid], day[self.valid]
        self.last = day[self.marks]
        self.mark_key = number[self.marks] * self.STEP + self.last

    def spans(self, at: np.ndarray, d: int, skip: int = 0, key: np.ndarray | None = None) -> tuple[Runs, np.ndarray]:
        """The last d calendar rows, less the last ``skip``, of each key in ``at``: runs and places in ``key``."""
        key = self.key if key is None else key
        a, z = np.searchsorted(key, at - (d - 1)), np.searchsorted(key, at - skip, "right")
        n = np.maximum(z - a, 0)
        return Runs(np.repeat(np.arange(len(at)), n), len(at)), np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)

    def residuals(self, at: np.ndarray, ret: np.ndarray, market, window: int, least: int) -> np.ndarray:
        """Returns less beta times the market, for rows with the keys ``at``; ``market(owner, key)`` are
        the market's returns. NaN below ``least`` returns or where the market does not vary."""
        runs, rows = self.spans(at, window)
        mkt = market(runs.owner, self.key[rows])
        cov, var = runs.cov(self.ret[rows], mkt), runs.cov(mkt, mkt)
        if len(self.every) > len(self.key):  # days without a return of the asset have a market all the same
            all_runs, rows = self.spans(at, window, key=self.every)
            mkt = market(all_runs.owner, self.every[rows])
            known = ~np.isnan(mkt)
            all_runs = Runs(all_runs.owner[known], len(at))
            var = all_runs.cov(mkt[known], mkt[known])
        beta = cov / np.where(var == 0, np.nan, var)
        return np.where(runs.n >= least, ret - beta * market(np.arange(len(at)), at), np.nan)


def _scores_of(h: Histories, idio: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each family and input of the seeds at each marker; ``idio``: what has been made already."""
    held: dict[tuple[int, int], tuple[Runs, np.ndarray]] = {}

    def span(d: int, skip: int = 0) -> tuple[Runs, np.ndarray]:
        if (d, skip) not in held:
            held[d, skip] = h.spans(h.mark_key, d, skip)
        return held[d, skip]

    def over(d: int, f, skip: int = 0) -> np.ndarray:
        runs, rows = span(d, skip)
        return f(runs, h.ret[rows])

    gain = lambda d, skip: np.nan_to_num(over(d, lambda r, x: r.fold(np.multiply, 1 + x), skip) - 1)
    std = lambda d: over(d, Runs.std)
    out = {}
    for back, skip in MOMENTUM:
        g = gain(back * MONTH, skip * MONTH)
        out[f"mom{back}_{skip}"] = np.where(h.last >= back * MONTH, -g if (back, skip) in REVERSALS else g, np.nan)
    out |= {f"retvol{d}": -std(d) for d in WINDOWS["retvol"]} | idio
    out |= {f"maxret{d}": -over(d, lambda r, x: r.fold(np.maximum, x)) for d in WINDOWS["maxret"]}
    out |= {f"skew{d}": -over(d, Runs.skew) for d in WINDOWS["skew"]}
    follows = np.zeros(len(h.key), bool)
    follows[1:] = h.key[1:] == h.key[:-1] + 1
    for d in WINDOWS["autocorr"]:
        runs, rows = span(d)
        paired = follows[rows]
        runs, rows = Runs(runs.owner[paired], len(h.last)), rows[paired]
        x, y = h.ret[rows], h.ret[rows - 1]
        size = runs.std(x) * runs.std(y)
        out[f"autocorr{d}"] = runs.cov(x, y) / np.where(size == 0, np.nan, size)
    line, at = Runs(h.key // h.STEP, int(h.key[-1] // h.STEP) + 1 if len(h.key) else 0), {}
    level = np.log1p(h.ret)
    level = np.cumsum(level) - np.repeat((np.cumsum(level) - level)[line.at], line.n[line.live]) if len(level) else level
    for back, x in ((0, level), (7, level), (-1, h.ret)):
        place = np.minimum(np.searchsorted(h.key, h.mark_key - max(back, 0)), max(len(h.key) - 1, 0))
        at[back] = np.where(h.key[place] == h.mark_key - max(back, 0), x[place], np.nan) if len(h.key) else np.full(len(h.last), np.nan)
    wide = std(5)
    return out | {"_last": at[-1], "_step": at[0] - at[7], "_gain": gain(250, 0), "_ratio": std(2) / np.where(wide == 0, np.nan, wide)}


def _starts(asset: pa.Array) -> np.ndarray:
    """Whether a row's asset is not that of the row before."""
    x, y = asset[1:], asset[:-1]
    new = pc.coalesce(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y)))
    return np.concatenate(([True], new.to_numpy(zero_copy_only=False)))[: len(asset)]


def _whole_assets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Histories]]:
    """Rows sorted by asset and day, dealt anew so that no asset is in two batches, and their histories."""

    def made(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, Histories]:
        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        day, ret = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))  # null returns: NaN
        return b, Histories(np.cumsum(_starts(b.column(0))), day, ret.astype(float), b.column(3).is_valid().to_numpy(zero_copy_only=False))

    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if rest and rest[-1].column(0)[-1].as_py() != b.column(0)[0].as_py():
            yield made(rest)
            rest = []
        if at := int(np.flatnonzero(_starts(b.column(0)))[-1]):
            yield made([*rest, b.slice(0, at)])
            rest, b = [], b.slice(at)
        rest.append(b)
    if rest:
        yield made(rest)


def _dates(b: pa.RecordBatch, h: Histories) -> tuple[list, np.ndarray]:
    """Formations of the markers, and which of them each marker has."""
    dates = b.column(3).take(pa.array(h.marks)).to_numpy(zero_copy_only=False).astype("M8[D]")
    dates, code = np.unique(dates, return_inverse=True)
    return dates.tolist(), code


def _sorted(panel: DataFrame, marks: DataFrame) -> DataFrame:
    """(asset, day_ix, ret, formation): the panel's rows and a marker for each (formation, asset), one shuffle by asset."""
    rows = panel.select("asset", F.col("day_ix").cast("long").alias("day_ix"), F.col("ret").cast("double").alias("ret"), F.lit(None).cast("date").alias("formation"))
    both = rows.unionByName(marks.select("asset", F.col("day_ix").cast("long").alias("day_ix"), F.lit(None).cast("double").alias("ret"), "formation"))
    return both.repartition("asset").sortWithinPartitions("asset", "day_ix")


def characteristics(panel: DataFrame, formations: DataFrame, beta_window: int = 60, beta_obs: int = 60, baskets: DataFrame | None = None) -> DataFrame:
    """(formation, asset, one column a family, inputs of the seeds), for all assets of ``panel`` or, with
    ``baskets`` (formation, asset), for the members.

    One shuffle by asset brings its rows and a marker for each formation together; windows are then
    summed at the markers alone (Spark's own sliding windows sum every frame of every row anew). A
    few assets are in memory at once. Residuals are against the equal-weight mean of ``panel`` or, with ``baskets``,
    of the formation's members: these means are a row a day, or one for each formation and day of its
    longest window, summed where the rows are.
    """
    last = last_day_of(panel, formations)  # one row a month
    if baskets is None:
        marks = panel.select("asset").distinct().crossJoin(F.broadcast(last))
    else:
        known = panel.select("asset").distinct()
        marks = baskets.select("formation", "asset").distinct().join(known, "asset", "left_semi").join(F.broadcast(last), "formation")
    both, windows = _sorted(panel, marks), WINDOWS["idiovol"]
    if baskets is None:
        days = {r.day_ix: r.mkt for r in panel.groupBy("day_ix").agg(F.avg("ret").alias("mkt")).toLocalIterator()}  # one row a day
        place, means = {}, np.full(max(days, default=0) + 1, np.nan)
        for i, m in days.items():
            means[i] = np.nan if m is None else m
    else:
        held = _basket_means(both, max(windows) + beta_window)
        place, means = {f: i for i, f in enumerate(held)}, np.stack([*held.values()] or [np.full(max(windows) + beta_window, np.nan)])
    sent = panel.sparkSession.sparkContext.broadcast(means)

    def of_panel(b: pa.RecordBatch, h: Histories, mkt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        resid = h.residuals(h.key, h.ret, lambda _, key: mkt[key % h.STEP], beta_window, beta_obs)
        runs, rows = h.spans(h.mark_key, max(windows))
        return runs.owner, rows, resid[rows]

    def of_baskets(b: pa.RecordBatch, h: Histories, mkt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dates, code = _dates(b, h)
        own = np.array([place.get(f, 0) for f in dates], np.int64)[code]
        runs, rows = h.spans(h.mark_key, max(windows))
        market = lambda who, key: mkt[own[runs.owner[who]], h.last[runs.owner[who]] - key % h.STEP]
        return runs.owner, rows, h.residuals(h.key[rows], h.ret[rows], market, beta_window, beta_obs)

    residuals = of_panel if baskets is None else of_baskets

    def idiovol(b: pa.RecordBatch, h: Histories, mkt: np.ndarray) -> dict[str, np.ndarray]:
        owner, rows, resid = residuals(b, h, mkt)
        inside = {d: ~np.isnan(resid) & (h.day[rows] > h.last[owner] - d) for d in windows}
        return {f"idiovol{d}": -Runs(owner[k], len(h.last)).std(resid[k]) for d, k in inside.items()}

    names = [*families(), "_last", "_step", "_gain", "_ratio"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h in _whole_assets(batches):
            if len(h.marks):
                with np.errstate(all="ignore"):
                    made = _scores_of(h, idiovol(b, h, sent.value))
                which = b.take(pa.array(h.marks))
                columns = [which.column(3), which.column(0), *[pa.array(made[n], from_pandas=True) for n in names]]
                yield pa.RecordBatch.from_arrays(columns, ["formation", "asset", *names])

    kind = panel.schema["asset"].dataType.simpleString()
    wide = both.mapInArrow(run, f"formation date, asset {kind}, " + ", ".join(f"{n} double" for n in names))
    return wide.select("formation", "asset", *[F.round(n, DIGITS).alias(n) for n in names])


def basket_idiovol(panel: DataFrame, baskets: DataFrame, beta_window: int = 60, beta_obs: int = 60) -> DataFrame:
    """(formation, asset, idiovol...): negated volatility of residuals against the mean of the members
    of each formation's basket; ``baskets``: (formation, asset)."""
    made = characteristics(panel, baskets, beta_window, beta_obs, baskets)
    return made.select("formation", "asset", *[f"idiovol{d}" for d in WINDOWS["idiovol"]])


def _basket_means(both: DataFrame, lookback: int) -> dict:
    """formation -> mean return of its members on each of the ``lookback`` calendar rows up to its last
    day, that day first; sums over the rows of ``_sorted``, so what is shuffled is a row a formation, day and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b, h in _whole_assets(batches):
            if not len(h.marks):
                continue
            dates, code = _dates(b, h)
            runs, rows = h.spans(h.mark_key, lookback)
            cell = code[runs.owner] * lookback + h.last[runs.owner] - h.day[rows]
            n = np.bincount(cell, minlength=len(dates) * lookback).reshape(-1, lookback)
            x = np.bincount(cell, h.ret[rows], len(dates) * lookback).reshape(-1, lookback)
            for f, k, v in zip(dates, n, x):
                held = total.setdefault(f, (np.zeros(lookback, np.int64), np.zeros(lookback)))
                held[0][:] += k
                held[1][:] += v
        for f, (n, x) in total.items():
            back = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(back), pa.date32()), pa.array(back), pa.array(n[back]), pa.array(x[back])], ["formation", "back", "n", "x"])

    cells = both.mapInArrow(run, "formation date, back long, n long, x double").groupBy("formation", "back")
    out: dict = {}
    for r in cells.agg((F.sum("x") / F.sum("n")).alias("mkt")).toLocalIterator():  # formations x lookback rows at most
        out.setdefault(r.formation, np.full(lookback, np.nan))[r.back] = r.mkt
    return out


def _picked(place: Column, n: Column, pick: tuple[float, int]) -> Column:
    """Weight of the ``place``-th of n names, as ``backtest.top_weights`` gives it; null for names not held."""
    top = F.ceil(n * pick[0])
    return F.when((place <= top) & (top >= pick[1]), 1 / top)


def search_space(
    panel: DataFrame, formations: DataFrame, beta_obs: int = 60, baskets: DataFrame | None = None, pick: tuple[float, int] | None = None
) -> DataFrame:
    """(formation, config, asset, score) of all 54 configurations; rows without a score are left out.

    With ``baskets`` (formation, asset) only members are scored, against the members' own market. With
    ``pick`` (decile, least names) also w, what ``backtest.top_weights`` would give each row: a name's place
    is known where its rank is, so the scores need no shuffle and no sort of their own for it.
    """
    c = stored(characteristics(panel, formations, beta_obs=beta_obs, baskets=baskets))  # two plans read it
    by = ("formation", "name")
    long = c.unpivot(["formation", "asset"], families(), "name", "x").where("x is not null").repartition(*by)  # one shuffle for all its windows
    # from the largest x down, ties by asset: the order of either norm, and the one sort for all windows here
    w, long = W.partitionBy(*by), long.withColumn("_down", -F.col("x"))
    long = long.withColumn("_place", F.row_number().over(w.orderBy("_down", "asset")))
    below = F.rank().over(w.orderBy("_down")) + (F.count("*").over(W.partitionBy(*by, "_down")) - 1) / 2
    single = long.withColumns({"rank": (F.count("x").over(w) + 1 - below) / F.count("x").over(w), "z": T.cs_zscore("x", *by), "_n": F.count("x").over(w)})
    single = single.unpivot(["formation", "asset", "name", "_place", "_n"], ["rank", "z"], "norm", "score")
    more = [_picked(F.col("_place"), F.col("_n"), pick).alias("w")] if pick else []
    single = single.select("formation", "asset", F.concat(F.lit("B:"), "name", F.lit(":"), "norm").alias("config"), "score", *more)

    # seeds, and products of the ranks of two characteristics among the assets that have both; a second
    # rank is of the plain quantity, which is the negated one the other way round
    pairs = {"C:mom_x_lowvol": ("mom12_1", "retvol126", True), "C:mom_x_lowidiovol": ("mom12_1", "idiovol126", True), "C:revol_x_skew": ("retvol126", "skew252", False)}
    inputs, scores = {"_rev": -F.col("_last")}, {"A:k_rev_close1": T.cs_rank("_rev", "formation"), "A:k_reversion_trend": T.cs_rank("_trend", "formation")}
    scores["A:k_volratio"] = 2 - T.cs_rank("_ratio", "formation") - T.cs_rank("_last", "formation")
    for i, (name, (a, b, flip)) in enumerate(pairs.items()):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        inputs |= {f"_a{i}": F.when(both, F.col(a)), f"_b{i}": F.when(both, -F.col(b) if flip else F.col(b))}
        other = T.cs_rank(f"_b{i}", "formation")
        scores[name] = T.cs_rank(f"_a{i}", "formation") * ((1 - other) if flip else other)
    used = c.select("formation", "asset", "_last", "_step", "_gain", "_ratio", *[x.alias(n) for n, x in inputs.items()]).repartition("formation")
    used = used.withColumn("_trend", -F.signum("_step") * (1 + T.cs_rank("_gain", "formation")))
    made = used.select("formation", "asset", *[x.alias(n) for n, x in scores.items()])
    w = W.partitionBy("formation")
    if pick:
        made = made.withColumns({f"w{i}": _picked(F.row_number().over(w.orderBy(F.desc(f"`{n}`"), "asset")), F.count(F.col(f"`{n}`")).over(w), pick) for i, n in enumerate(scores)})
    each = [F.struct(F.lit(n).alias("config"), F.col(f"`{n}`").alias("score"), *[F.col(f"w{i}").alias("w")] * bool(pick)) for i, n in enumerate(scores)]
    made = made.select("formation", "asset", F.inline(F.array(*each)))
    return single.unionByName(made.select(*single.columns)).where("score is not null")


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that a walk in order keeps if it leaves out each node with an edge to one kept before.

    ``nodes``: (config); ``edges``: (a, b), a < b. Rounds over the open nodes side by side: a node
    without an open smaller neighbour stays, and its neighbours go with their edges. Each round is
    written; as many are needed as the longest chain of decisions that hang on each other.
    """
    kept = None
    nodes, edges = cut(nodes.select("config").distinct()), cut(edges.select("a", "b").distinct())
    while not nodes.isEmpty():
        waits = edges.select(F.col("b").alias("config")).distinct()
        chosen = cut(nodes.join(waits, "config", "left_anti"))
        gone = edges.join(chosen.withColumnRenamed("config", "a"), "a", "left_semi").select(F.col("b").alias("config"))
        closed = cut(chosen.unionByName(gone).distinct())
        nodes = cut(nodes.join(closed, "config", "left_anti"))
        edges = edges.join(closed.withColumnRenamed("config", "a"), "a", "left_anti")
        edges = cut(edges.join(closed.withColumnRenamed("config", "b"), "b", "left_anti"))
        kept = chosen if kept is None else cut(kept.unionByName(chosen))
    return nodes if kept is None else kept


def correlation_prune(returns: DataFrame, most: float = 0.7) -> DataFrame:
    """(config): names in order, each kept if its correlation with all kept before is at most ``most``
    in size. ``returns``: (period, config, ret). A correlation that is not defined, also for want of
    common periods, keeps no name. Only the pairs that exclude each other go into the rounds.
    """
    x = returns.select("period", F.col("config").alias("a"), F.col("ret").alias("x"))
    y = returns.select("period", F.col("config").alias("b"), F.col("ret").alias("y"))
    corr = F.covar_samp("x", "y") / F.nullif(F.stddev_samp("x") * F.stddev_samp("y"), F.lit(0.0))
    pairs = x.join(y, "period").where("a < b and x is not null and y is not null").groupBy("a", "b").agg(corr.alias("c"))
    names = returns.select("config").distinct()
    agree = pairs.where(F.abs("c") <= most).select("a", "b")
    every = names.select(F.col("config").alias("a")).join(names.select(F.col("config").alias("b")), F.col("a") < F.col("b"))
    return first_independent(names, every.join(agree, ["a", "b"], "left_anti"))
