"""Common table expressions of the oracle SQL."""

BRAND = """panel AS (
  SELECT p_brand AS asset, cast(l_shipdate AS date) AS dt,
         sum(cast(round(l_discount * 100) AS bigint) - 5) / (100.0 * count(*)) AS ret
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
p AS (SELECT panel.*, day_ix FROM panel JOIN
  (SELECT dt, row_number() OVER (ORDER BY dt) AS day_ix FROM (SELECT DISTINCT dt FROM panel)) USING (dt))"""
LOG = """log AS (
  SELECT last_day(cast(l_shipdate AS date)) AS dt, l_suppkey AS asset,
         CASE WHEN l_returnflag = 'A' AND l_quantity >= 46 THEN 'join' ELSE 'leave' END AS change
  FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity >= 46) OR (l_returnflag = 'R' AND l_quantity <= 5)),
cur AS (SELECT s_suppkey AS asset FROM supplier WHERE s_suppkey % 2 = 0),
ev AS (SELECT dt, asset, CASE WHEN j > l THEN 'join' ELSE 'leave' END AS change FROM
  (SELECT dt, asset, count(*) FILTER (WHERE change = 'join') AS j, count(*) FILTER (WHERE change = 'leave') AS l
   FROM log GROUP BY 1, 2) WHERE j <> l)"""
EVENTS = """head AS (SELECT ts, event_type AS key, sign(value - 50) AS sentiment FROM events)"""


def span(d: int, skip: int = 0) -> str:
    return f"(PARTITION BY asset ORDER BY day_ix RANGE BETWEEN {d - 1} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"
