"""Preparation of macro series in long form: (series, dt, x)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_OBS = 60


def _line(start=W.unboundedPreceding, end=0):
    return W.partitionBy("series").orderBy("dt").rowsBetween(start, end)


def forward_fill(x: str = "x") -> Column:
    return F.last(x, ignorenulls=True).over(_line())


def time_interpolation(x: str = "x") -> Column:
    """Linear in time between the valid neighbours; after the last value it is held, before the first null."""
    day = F.when(F.col(x).isNotNull(), F.unix_date("dt"))
    a, b = forward_fill(x), F.first(x, ignorenulls=True).over(_line(0, W.unboundedFollowing))
    s, t = F.last(day, ignorenulls=True).over(_line()), F.first(day, ignorenulls=True).over(_line(0, W.unboundedFollowing))
    share = F.coalesce(F.try_divide(F.unix_date("dt") - s, t - s), F.lit(0.0))
    return F.when(b.isNull(), a).otherwise(a + (b - a) * share)


def expanding_robust_z(df: DataFrame, x: str = "x", min_obs: int = MIN_OBS) -> DataFrame:
    """(series, dt, x, z): (x - median) / IQR of all rows so far; null below ``min_obs`` values, where x
    is null or where the IQR is 0.

    A series is a group, a number a day; its prefixes share one order-statistic structure, so that
    a long series costs n log n and not its square. See ``kernels.expanding_quantiles``.
    """
    from ..operators.kernels import expanding_quantiles

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        there = pdf["x"].notna().to_numpy()
        v = pdf["x"].to_numpy()[there]
        z = np.full(len(pdf), np.nan)
        if len(v):
            q = expanding_quantiles(v, (0.25, 0.5, 0.75))
            width = q[:, 2] - q[:, 0]
            z[there] = np.where((width != 0) & (np.arange(1, len(v) + 1) >= min_obs), (v - q[:, 1]) / np.where(width == 0, 1.0, width), np.nan)
        return pdf.assign(z=z)

    kinds = dict(df.dtypes)
    made = df.select("series", "dt", F.col(x).cast("double").alias("x")).groupBy("series").applyInPandas(run, f"series {kinds['series']}, dt {kinds['dt']}, x double, z double")
    return made.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def full_robust_z(df: DataFrame, x: str = "x") -> DataFrame:
    """``df`` with z: median and IQR of the whole series, which looks ahead. An IQR of 0 divides by 1."""
    q = df.groupBy(F.col("series").alias("_s")).agg(F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("_q"))
    width = F.col("_q")[2] - F.col("_q")[0]
    z = (F.col(x) - F.col("_q")[1]) / F.when(width == 0, 1.0).otherwise(width)
    return df.join(q, F.col("series") == F.col("_s")).withColumn("z", z).drop("_s", "_q")


def rate_of_change(rows: int, x: str = "x") -> Column:
    """Padded x over the padded value ``rows`` rows before, less 1."""
    return F.try_divide(forward_fill(x), F.last(x, ignorenulls=True).over(_line(W.unboundedPreceding, -rows))) - 1
