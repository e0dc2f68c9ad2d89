"""The batch forms of the stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.queries.tables import table
from tamarisk.registry import query
from tamarisk.streaming import events, limits


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def window_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.window_figures(table(spark, sf_dir, "events"), "event_type")


@query("WITH w AS (SELECT event_type, unnest(list_transform(range(6), lambda i: time_bucket(INTERVAL '10 minutes', ts) - i * INTERVAL '10 minutes')) AS start FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) > 2")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.over_limit(table(spark, sf_dir, "events"), "event_type", 2, window="1 hour", slide="10 minutes")


@query("""WITH RECURSIVE ordered AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
step AS (
  SELECT DISTINCT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::TIMESTAMP[] AS held, NULL::BOOLEAN AS admitted FROM ordered
  UNION ALL
  SELECT event_type, n, event_id, CASE WHEN len(near) < 3 THEN list_append(near, ts) ELSE near END, len(near) < 3
  FROM (SELECT o.*, list_filter(s.held, lambda t: o.ts - t < INTERVAL 1 HOUR) AS near FROM step s JOIN ordered o ON o.event_type = s.event_type AND o.n = s.n + 1)
)
SELECT event_type, event_id, admitted FROM step WHERE n > 0""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event by a limit of three an hour and type."""
    return limits.judged(table(spark, sf_dir, "events"), "event_type", "event_id", 3, 3600)
