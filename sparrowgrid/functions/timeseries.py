"""Time-series and cross-sectional operators as window expressions.

Windows count calendar rows through day_ix, so that missing rows of an asset need no filling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def days(d: int, skip: int = 0, key: str = "asset", order: str = "day_ix"):
    """The last d calendar rows, less the last ``skip``."""
    return W.partitionBy(key).orderBy(order).rangeBetween(-(d - 1), -skip)


def ts_mean(x: str, d: int) -> Column:
    return F.avg(x).over(days(d))


def ts_std(x: str, d: int) -> Column:
    return F.stddev_samp(x).over(days(d))


def ts_skew(x: str, d: int) -> Column:
    """Bias-corrected, null below three values."""
    n, g = F.count(x).over(days(d)), F.skewness(x).over(days(d))
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def ts_rank(x: str, d: int) -> Column:
    """Average rank of the last value in its window, as a share."""
    seen = F.collect_list(x).over(days(d))
    below = F.size(F.filter(seen, lambda v: v < F.col(x)))
    equal = F.size(F.filter(seen, lambda v: v == F.col(x)))
    return F.when(F.col(x).isNotNull(), (below + (equal + 1) / 2) / F.size(seen))


def ts_argmax(x: str, d: int, largest: bool = True) -> Column:
    """Rows since the window's extreme; the first of several counts."""
    seen = F.collect_list(x).over(days(d))
    best = F.array_max(seen) if largest else F.array_min(seen)
    return F.size(seen) - F.array_position(seen, best)


def decay_linear(x: str, d: int) -> Column:
    """Mean with weights 1..k, the last row heaviest."""
    seen = F.collect_list(x).over(days(d))
    total = F.aggregate(F.transform(seen, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    k = F.size(seen)
    return F.when(k > 0, total / F.nullif(k * (k + 1) / 2, F.lit(0.0)))


def ts_corr(x: str, y: str, d: int) -> Column:
    w = days(d)
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    return F.covar_samp(a, b).over(w) / F.nullif(F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w), F.lit(0.0))


def cumulative_return(x: str, d: int, skip: int) -> Column:
    return F.product(1 + F.col(x)).over(days(d, skip)) - 1


def log_price(x: str) -> Column:
    w = W.partitionBy("asset").orderBy("day_ix")
    return F.when(F.col(x).isNotNull(), F.sum(F.log1p(x)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def signed_log1p(x: str) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_power(x: str, a: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), a)


def _average_rank(x: str, by: tuple[str, ...]) -> Column:
    known = F.col(x).isNull().cast("int")
    w = W.partitionBy(*by, known)
    ties = F.count("*").over(W.partitionBy(*by, x))
    return F.rank().over(w.orderBy(x)) + (ties - 1) / 2


def cs_rank(x: str, *by: str) -> Column:
    """Average rank over the number of valid values."""
    by = by or ("dt",)
    return F.when(F.col(x).isNotNull(), _average_rank(x, by) / F.count(x).over(W.partitionBy(*by)))


def cs_zscore(x: str, *by: str) -> Column:
    w = W.partitionBy(*(by or ("dt",)))
    sd = F.stddev_pop(x).over(w)
    return F.when(sd == 0, F.col(x) * 0.0).otherwise((F.col(x) - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0)))


def cs_demean(x: str, *by: str) -> Column:
    return F.col(x) - F.avg(x).over(W.partitionBy(*(by or ("dt",))))


def cs_scale(x: str, a: float = 1.0, *by: str) -> Column:
    total = F.sum(F.abs(x)).over(W.partitionBy(*(by or ("dt",))))
    return F.when(total == 0, F.col(x) * 0.0).otherwise(a * F.col(x) / F.nullif(total, F.lit(0.0)))
