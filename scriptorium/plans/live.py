"""Queries run through streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.streaming import live
from scriptorium.session import checkpoint_dir, ship


def _events(spark, directory):
    ship(spark)
    return live.events(spark, directory)


def str_tumbling(spark, directory):
    """Counts by hour and type, of the hours that the watermark has closed."""
    return live.drain(live.tumbling(_events(spark, directory)))


def str_once(spark, directory):
    """Events without repeats, by type."""
    return live.drain(live.once_each(_events(spark, directory), ["event_id"])).groupBy("event_type").agg(F.count("*").alias("n"))


def str_sessions(spark, directory):
    """Runs of each user's events without a pause of half an hour, as the watermark closes them."""
    return live.drain(live.sessions(_events(spark, directory)))


def str_upserts(spark, directory):
    """The last event of each user, kept by upserts."""
    events = _events(spark, directory).select("user_id", "ts", "event_id", "event_type")
    at = f"{checkpoint_dir(spark)}/upserts-{uuid.uuid4().hex}"
    live.upsert_batches(events, f"{at}/table", "user_id", "ts", f"{at}/log").awaitTermination()
    return live.current(spark, f"{at}/table", events.schema)


QUERIES = {"str_tumbling": str_tumbling, "str_once": str_once, "str_sessions": str_sessions, "str_upserts": str_upserts}

ORACLES = {
    "str_tumbling": """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
      GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "str_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "str_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
      SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "str_upserts": """SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS k FROM events) WHERE k = 1""",
}
