"""Queries over the point-in-time universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import universe as U
from ..registry import register
from ..sources.panel import read
from .sql import LOG


def log_of(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem")
    join = (F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 46)
    leave = (F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 5)
    return x.where(join | leave).select(F.last_day("l_shipdate").alias("dt"), F.col("l_suppkey").alias("asset"), F.when(join, "join").otherwise("leave").alias("change"))


def current_of(spark, sf_dir):
    return read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("asset"))


SNAP = "snap AS (SELECT last_day(m) AS snapshot_dt FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-11-30', INTERVAL 1 MONTH)) AS m))"
ALL = "al AS (SELECT asset FROM cur UNION SELECT asset FROM log)"


@register("net_changes", f"WITH {LOG} SELECT dt, asset, change FROM ev")
def net_changes(spark, sf_dir):
    return U.cancel_same_day(U.validate(log_of(spark, sf_dir)))


BASKETS = """nx AS (SELECT snapshot_dt, al.asset, min_by(change, dt) AS nxt FROM snap CROSS JOIN al LEFT JOIN ev ON ev.asset = al.asset AND ev.dt > snapshot_dt GROUP BY 1, 2),
bk AS (SELECT snapshot_dt, asset FROM nx WHERE nxt = 'leave' OR (nxt IS NULL AND asset IN (SELECT asset FROM cur)))"""


@register("baskets", f"WITH {LOG}, {SNAP}, {ALL}, {BASKETS} SELECT * FROM bk")
def baskets(spark, sf_dir):
    return U.baskets(log_of(spark, sf_dir), current_of(spark, sf_dir), U.month_ends(spark, "1995-01-01", "2001-11-30"))


@register("baskets_toggle", f"""WITH {LOG}, {SNAP}, {ALL},
n AS (SELECT snapshot_dt, al.asset, count(log.dt) AS k FROM snap CROSS JOIN al LEFT JOIN log ON log.asset = al.asset AND log.dt > snapshot_dt GROUP BY 1, 2)
SELECT snapshot_dt, asset FROM n WHERE (k + (asset IN (SELECT asset FROM cur))::int) % 2 = 1""")
def baskets_toggle(spark, sf_dir):
    return U.baskets_by_toggle(log_of(spark, sf_dir), current_of(spark, sf_dir), U.month_ends(spark, "1995-01-01", "2001-11-30"))


@register("log_integrity", f"""WITH {LOG}, lg AS (SELECT change, lag(change) OVER (PARTITION BY asset ORDER BY dt) AS p FROM ev),
la AS (SELECT asset, max_by(change, dt) AS c FROM ev GROUP BY 1)
SELECT 'exact_repeats' AS "check", count(*) AS n FROM (SELECT 1 FROM log GROUP BY dt, asset, change HAVING count(*) > 1) UNION ALL
SELECT 'same_day_pairs', count(*) FROM (SELECT 1 FROM log GROUP BY dt, asset HAVING count(DISTINCT change) > 1) UNION ALL
SELECT 'consecutive_same', count(*) FROM lg WHERE p = change UNION ALL
SELECT 'last_against_basket', count(*) FROM la WHERE (c = 'join') <> (asset IN (SELECT asset FROM cur)) UNION ALL
SELECT 'events', count(*) FROM log UNION ALL SELECT 'sentinel_dates', count(*) FROM log WHERE dt < DATE '1995-02-01' OR dt IS NULL""")
def log_integrity(spark, sf_dir):
    return U.integrity(log_of(spark, sf_dir), current_of(spark, sf_dir), "1995-02-01")


@register("basket_validation", f"""WITH {LOG}, {SNAP}, {ALL}, {BASKETS}, c AS (SELECT snapshot_dt, count(asset) AS n FROM snap LEFT JOIN bk USING (snapshot_dt) GROUP BY 1), x AS (SELECT count(*) AS u FROM al)
SELECT snapshot_dt, n, CASE WHEN year(snapshot_dt) <= 1996 THEN abs(n - u * 0.5) <= u * 0.25 ELSE n BETWEEN u * 0.3 AND u * 0.7 END AS ok FROM c, x""")
def basket_validation(spark, sf_dir):
    """Basket sizes against an expected size up to 1996 and a band after, in shares of the universe."""
    snaps = U.month_ends(spark, "1995-01-01", "2001-11-30")
    log, cur = log_of(spark, sf_dir), current_of(spark, sf_dir)
    size = log.select("asset").union(cur).distinct().count()
    want = snaps.select("snapshot_dt", F.when(F.year("snapshot_dt") <= 1996, size * 0.25).otherwise(size * 0.3).alias("low"), F.when(F.year("snapshot_dt") <= 1996, size * 0.75).otherwise(size * 0.7).alias("high"))
    return U.check_sizes(U.baskets(log, cur, snaps), want)
