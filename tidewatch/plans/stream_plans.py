"""Streaming queries over the event table as a stream of files; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import live
from .detector import RULES, ruled
from .registry import HOUR, query, r, rounded


def _done(stream, mode: str = "complete", keys: tuple[str, ...] = ()):
    return live.drained(stream, "live", mode, keys=keys)


@query("stream_tumbling", f"WITH w AS (SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, count(*) AS n, sum(value) AS total, max(value) AS most FROM events GROUP BY ALL) SELECT start_us, n, {r('total', 'most')} FROM w")
def q_tumbling(spark, sf_dir):
    return rounded(_done(live.tumbling(live.event_stream(spark, sf_dir))))


@query("stream_sliding", "WITH w AS (SELECT (epoch_us(ts) // 900000000 - unnest(range(0, 4))) * 900000000 AS start_us FROM events) SELECT start_us, count(*) AS n FROM w GROUP BY start_us")
def q_sliding(spark, sf_dir):
    return _done(live.sliding(live.event_stream(spark, sf_dir)))


@query("stream_sessions", "WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum((coalesce(gap, 0) > 86400000000)::INT) OVER (PARTITION BY user_id ORDER BY t) AS session FROM g) SELECT user_id, min(t) AS start_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, session")
def q_sessions(spark, sf_dir):
    return _done(live.session_counts(live.event_stream(spark, sf_dir), "user_id", "24 hours"))


@query("stream_cusum", """WITH g AS (SELECT event_type, epoch_us(ts) AS t, row_number() OVER w AS k, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT event_type, k, sum(CASE WHEN gap > 0 THEN greatest(0, gap - 900) / 900.0::DOUBLE - 0.5 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY k) AS total FROM g)
SELECT event_type, count(*) AS n, round(arg_max(total, k) - least(0, min(total)) + 1e-7, 4) + 0e0 AS state FROM s GROUP BY event_type""")
def q_cusum(spark, sf_dir):
    return rounded(_done(live.cusum(live.event_stream(spark, sf_dir), "event_type", 900.0, 900.0), "update", ("event_type",)))


_ALERTS = f"WITH {RULES}, a AS (SELECT position, row_number() OVER (ORDER BY position) AS k FROM flagged WHERE fired), g AS (SELECT min(position) AS position, count(*) AS length FROM a GROUP BY position - k) SELECT position, length, (CASE WHEN length >= 5 THEN 3 WHEN length >= 2 THEN 2 ELSE 1 END)::INTEGER AS severity FROM g"


@query("consecutive_alerts", _ALERTS)
def q_consecutive(spark, sf_dir):
    rows = ruled(spark, sf_dir).select(F.col("position"), F.col("hit.fired").alias("fired"))
    return live.consecutive(rows)


@query("stream_alerts", _ALERTS)
def q_stream_alerts(spark, sf_dir):
    """The rules' alerts replayed ten days at a time, without those that follow one directly."""
    rows = ruled(spark, sf_dir).select(F.lit("rules").alias("key"), F.timestamp_micros(F.col("bucket") * HOUR).alias("ts"), "position", F.col("hit.fired").alias("fired"))
    stream = live.replayed(rows, "ts", 864_000, 1.0, "alerts")
    return _done(live.deduplicated(stream, "key"), "update", ("key", "position")).select("position", "length", "severity")
