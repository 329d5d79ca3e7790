"""The daily cycle on the ledger: profit and loss, triggers, rebalance, costs; and stages that may fail."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import engine as E
from . import kernels as K
from .ledger import Broker, rebalance_due

log = logging.getLogger(__name__)


def last_trading_day(today: dt.date) -> dt.date:
    """The last weekday strictly before a day."""
    day = today - dt.timedelta(1)
    return day - dt.timedelta(max(0, day.weekday() - 4))


def is_stale(last: dt.date | None, today: dt.date) -> bool:
    """Is the ledger more than one weekday behind the last trading day?"""
    return last is None or int(np.busday_count(last, last_trading_day(today) + dt.timedelta(1))) - (last.weekday() < 5) > 1


def completed_ends(prices: DataFrame, asof: dt.date, freq: str = "ME") -> list[str]:
    """Last trading days of the periods before the one that ``asof`` lies in."""
    days = prices.where(F.col("dt") <= F.lit(asof)).select("dt", F.lit(0).cast("long").alias("day_ix"))
    period = E._PERIODS[freq]
    ends = E.rebalance_dates(days, freq).where(period(F.col("rebalance_dt")) < period(F.lit(asof).cast("date")))
    return [str(r.rebalance_dt) for r in ends.orderBy("rebalance_dt").collect()]  # one row a period


@dataclass
class DailyRunner:
    """One day of paper trading.

    ``prices``: (asset, dt, price). ``policy(returns, asof)`` gives the target (asset, w) from the
    returns up to that day; ``risk``, if there is one, changes it; ``cost(old, new, nav)`` gives the
    share that trading takes, the broker's flat cost if there is none.
    """

    broker: Broker
    prices: DataFrame
    policy: Callable[[DataFrame, dt.date], DataFrame]
    freq: str = "ME"
    min_history: int = 20
    risk: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    cost: Callable[[DataFrame, DataFrame, float], float] | None = None

    def run(self, day: dt.date) -> dict:
        """The logical day is the last one with prices: a late run is booked where it belongs.

        Profit and loss on the old weights come first, then a rebalance if a period has ended since
        the last one, then its cost on that day's NAV. A second run leaves the same state: it books
        the NAV anew and so repeats the rebalance of that day.
        """
        from ..sources.panel import returns_of

        known = self.prices.where(F.col("dt") <= F.lit(day))
        asof = known.agg(F.max("dt").alias("dt")).first().dt
        if asof is None:
            raise ValueError(f"no prices up to {day}")
        nav = self.broker.record_nav(str(asof), self.broker.period_returns(str(asof), known))
        last = self.broker.last_rebalance_date()
        due = rebalance_due(last and str(last), completed_ends(known, asof, self.freq)) or last == asof
        returns = returns_of(known, "simple")
        if not due or returns.select("dt").distinct().count() < self.min_history:
            return {"date": asof, "nav": nav, "rebalanced": False, "cost": 0.0}
        target = self.policy(returns, asof)
        if self.risk is not None:
            target = self.risk(target, returns)
        old = self.broker.weights_before(str(asof))
        cost = self.broker.rebalance(str(asof), target)
        if self.cost is not None:
            try:
                cost = self.cost(old, target, nav)
            except Exception:  # a cost model that fails must not lose the day
                log.exception("cost model failed: flat cost")
        if cost > 0:
            nav = self.broker.apply_cost(str(asof), cost)
        return {"date": asof, "nav": nav, "rebalanced": True, "cost": cost}


def rebalance_reason(
    day: dt.date, last: dt.date | None, current: dict[str, float], candidate: dict[str, float] | None, regime_changed: bool, losses: float,
    cooldown: int = 5, drift: float = 0.05, cvar_limit: float = 0.02,
) -> tuple[bool, str]:
    """(trade, reason); the names of reasons are fixed values. The cooldown blocks everything; then an empty book, a new regime, a drift of half
    the summed changes, or ``losses``, the CVaR of the current book, above its limit."""
    if last is not None and (day - last).days < cooldown:
        return False, "cooldown"
    if candidate is None:
        return False, "optimization_failed"
    if not current:
        return True, "empty_portfolio"
    if regime_changed:
        return True, "regime_change"
    if sum(abs(w - current.get(a, 0.0)) for a, w in candidate.items()) / 2 > drift:
        return True, "signal_drift"
    return (True, "risk_breach") if losses > cvar_limit else (False, "no_trigger")


def book_losses(returns: DataFrame, weights: dict[str, float]) -> float:
    """CVaR of a fixed book: a number a day reaches the driver."""
    if not weights:
        return 0.0
    w = F.create_map(*[x for a, v in weights.items() for x in (F.lit(a), F.lit(float(v)))])
    rows = returns.withColumn("w", F.try_element_at(w, F.col("asset"))).where("w is not null")
    days = rows.groupBy("dt").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("r")).collect()
    return K.historical_cvar(np.array([r.r for r in days]))[0]


def expected_returns(means: DataFrame, posterior: list[float]) -> DataFrame:
    """(asset, mu): means by regime (asset, regime, mu) under the regimes' probabilities."""
    p = F.get(F.array(*map(F.lit, map(float, posterior))), F.col("regime").cast("int"))
    return means.groupBy("asset").agg(F.sum(F.col("mu") * p).alias("mu"))


def execute(broker: Broker, day: dt.date, returns: DataFrame, target: DataFrame | None) -> dict:
    """Book the day's NAV, then trade. Where the NAV cannot be booked nothing is traded: the next
    run of the day makes up for it."""
    try:
        nav = broker.record_nav(str(day), returns)
    except ValueError as e:
        log.error("NAV of %s not booked (%s): no rebalance", day, e)
        return {"nav": None, "traded": False}
    if target is None:
        return {"nav": nav, "traded": False}
    try:
        cost = broker.rebalance(str(day), target)
        return {"nav": broker.apply_cost(str(day), cost) if cost > 0 else nav, "traded": True}
    except ValueError as e:
        log.error("rebalance of %s failed (%s)", day, e)
        return {"nav": nav, "traded": False}


@dataclass
class Cycle:
    """Stages of a day, passed in: data, regime, signal, portfolio, execution, report.

    Without data the day ends. A regime that fails is the last one known (not changed), or even
    odds; a signal that fails is no view; a portfolio that fails is no trade; execution and report
    only log. Each stage gets what the stages before it gave, by name.
    """

    data: Callable[[dt.date], dict]
    regime: Callable[[dict], dict]
    signal: Callable[[dict, dict], dict]
    portfolio: Callable[[dict, dict, dict], dict]
    execution: Callable[[dict, dict], dict]
    report: Callable[[dict, dict], object]
    known: dict | None = field(default=None)

    def run(self, day: dt.date) -> dict:
        try:
            data = self.data(day)
        except Exception:
            log.exception("no data for %s", day)
            return {"status": "aborted"}
        out = {"status": "done", "degraded": []}

        def stage(name: str, call: Callable[[], dict], instead: Callable[[], dict]) -> dict:
            try:
                return call()
            except Exception:
                log.exception("stage %s failed on %s", name, day)
                out["degraded"].append(name)
                return instead()

        even = {"label": 2, "p": [1 / 3] * 3, "changed": False}
        regime = stage("regime", lambda: self.regime(data), lambda: {**(self.known or even), "changed": False})
        self.known = regime
        signal = stage("signal", lambda: self.signal(regime, data), lambda: {"views": {}, "confidence": [1 / 3] * 3})
        choice = stage("portfolio", lambda: self.portfolio(signal, data, regime), lambda: {"trade": False, "reason": "no_trigger"})
        booked = stage("execution", lambda: self.execution(choice, data), dict)
        stage("report", lambda: self.report(choice, data) or {}, dict)
        return out | {"regime": regime, "choice": choice, "booked": booked}


def report_due(day: dt.date, traded: bool) -> bool:
    return traded or day.weekday() == 4
