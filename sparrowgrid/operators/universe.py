"""Point-in-time universe from a membership change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cancel_same_day(log: DataFrame) -> DataFrame:
    """(dt, asset, change): joins and leaves of one day cancel out; the sign of the rest stays."""
    net = F.count_if(F.col("change") == "join") - F.count_if(F.col("change") == "leave")
    days = log.groupBy("dt", "asset").agg(net.alias("net")).where("net <> 0")
    return days.select("dt", "asset", F.when(F.col("net") > 0, "join").otherwise("leave").alias("change"))


def validate(log: DataFrame) -> DataFrame:
    """The log itself; a null or unknown change fails the job."""
    bad = F.col("change").isNull() | ~F.col("change").isin("join", "leave")
    return log.withColumn("change", F.when(bad, F.raise_error(F.lit("change must be join or leave"))).otherwise(F.col("change")))


def intervals(log: DataFrame, current: DataFrame) -> DataFrame:
    """(asset, from_dt, to_dt): membership in [from_dt, to_dt), open ends null.

    Between two events of an asset its state is the opposite of what the later event does, and
    after the last one it is the current basket's. One shuffle by asset; the lookups that follow
    are joins on an interval table instead of one pass over the log for each date.
    """
    events = cancel_same_day(log)
    w = W.partitionBy("asset").orderBy("dt")
    gaps = events.select("asset", F.lag("dt").over(w).alias("from_dt"), F.col("dt").alias("to_dt"), (F.col("change") == "leave").alias("member"))
    last = events.groupBy("asset").agg(F.max("dt").alias("from_dt"))
    cur = current.select("asset").distinct().withColumn("now", F.lit(True))
    tail = last.join(cur, "asset", "full").select("asset", "from_dt", F.lit(None).cast("date").alias("to_dt"), F.coalesce("now", F.lit(False)).alias("member"))
    return gaps.unionByName(tail).where("member").drop("member")


def baskets(log: DataFrame, current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_dt, asset): who was a member at the end of each snapshot day."""
    spans = intervals(log, current)
    s = F.broadcast(snapshots.select("snapshot_dt").distinct())  # one row per month
    inside = (F.col("from_dt").isNull() | (F.col("from_dt") <= F.col("snapshot_dt"))) & (F.col("to_dt").isNull() | (F.col("to_dt") > F.col("snapshot_dt")))
    return spans.join(s, inside).select("snapshot_dt", "asset")


def baskets_by_toggle(log: DataFrame, current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The same without directions: an odd number of later changes flips today's state.

    The state between two days of changes is constant, so the log becomes intervals by one running
    count from its end, and snapshots meet intervals as they do in ``baskets``.
    """
    days = log.groupBy("asset", "dt").agg(F.count("*").alias("n"))
    w = W.partitionBy("asset").orderBy("dt")
    later = F.sum("n").over(w.rowsBetween(0, W.unboundedFollowing))
    gaps = days.select("asset", F.lag("dt").over(w).alias("from_dt"), F.col("dt").alias("to_dt"), later.alias("flips"))
    last = days.groupBy("asset").agg(F.max("dt").alias("from_dt")).withColumns({"to_dt": F.lit(None).cast("date"), "flips": F.lit(0).cast("long")})
    cur = current.select("asset").distinct().withColumn("now", F.lit(1))
    untouched = cur.select("asset").join(days.select("asset").distinct(), "asset", "left_anti")
    untouched = untouched.select("asset", F.lit(None).cast("date").alias("from_dt"), F.lit(None).cast("date").alias("to_dt"), F.lit(0).cast("long").alias("flips"))
    spans = gaps.unionByName(last).unionByName(untouched).join(cur, "asset", "left")
    spans = spans.where((F.coalesce("now", F.lit(0)) + F.col("flips")) % 2 == 1)
    s = F.broadcast(snapshots.select("snapshot_dt").distinct())  # one row per month
    inside = (F.col("from_dt").isNull() | (F.col("from_dt") <= F.col("snapshot_dt"))) & (F.col("to_dt").isNull() | (F.col("to_dt") > F.col("snapshot_dt")))
    return spans.join(s, inside).select("snapshot_dt", "asset")


def basket_at(baskets: DataFrame, month: str) -> DataFrame:
    """(asset): the basket of the first snapshot in a month ('2020-03')."""
    rows = baskets.where(F.date_format("snapshot_dt", "yyyy-MM") == month)
    return rows.join(rows.agg(F.min("snapshot_dt").alias("snapshot_dt")), "snapshot_dt").select("asset")


def check_sizes(baskets: DataFrame, expected: DataFrame) -> DataFrame:
    """(snapshot_dt, n, ok) for each row of ``expected`` (snapshot_dt, low, high): the size of the
    basket, 0 if there is none, and whether it lies in the band, both ends included."""
    sizes = baskets.groupBy("snapshot_dt").agg(F.count("*").alias("n"))
    out = expected.join(sizes, "snapshot_dt", "left").fillna(0, ["n"])
    return out.select("snapshot_dt", "n", F.col("n").between(F.col("low"), F.col("high")).alias("ok"))


def month_ends(spark, start: str, end: str) -> DataFrame:
    return spark.sql(f"select last_day(m) as snapshot_dt from (select explode(sequence(date'{start}', date'{end}', interval 1 month)) as m)").where(F.col("snapshot_dt") <= F.lit(end).cast("date"))


def integrity(log: DataFrame, current: DataFrame, earliest: str = "1900-01-01") -> DataFrame:
    """(check, n): events, exact repeats, same-day pairs, equal consecutive changes, last change
    against the basket, and dates that are missing or before ``earliest`` (sentinels)."""
    events = log.agg(F.count("*").alias("n")).withColumn("check", F.lit("events"))
    early = F.col("dt").isNull() | (F.col("dt") < F.lit(earliest).cast("date"))
    sentinels = log.where(early).agg(F.count("*").alias("n")).withColumn("check", F.lit("sentinel_dates"))
    repeats = log.groupBy("dt", "asset", "change").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("check", F.lit("exact_repeats"))
    pairs = log.groupBy("dt", "asset").agg(F.count_distinct("change").alias("k")).where("k > 1").agg(F.count("*").alias("n")).withColumn("check", F.lit("same_day_pairs"))
    net = cancel_same_day(log)
    w = W.partitionBy("asset").orderBy("dt")
    same = net.withColumn("p", F.lag("change").over(w)).where("p = change").agg(F.count("*").alias("n")).withColumn("check", F.lit("consecutive_same"))
    last = net.groupBy("asset").agg(F.max_by("change", "dt").alias("c")).join(current.select("asset").distinct().withColumn("now", F.lit(True)), "asset", "left")
    odd = last.where((F.col("c") == "join") != F.coalesce("now", F.lit(False))).agg(F.count("*").alias("n")).withColumn("check", F.lit("last_against_basket"))
    return repeats.unionByName(pairs).unionByName(same).unionByName(odd).unionByName(events).unionByName(sentinels).select("check", "n")
