"""Queries on the events table; the streaming ones are an extension and run over the files as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.plans.base import table
from cairn.streaming import events as E
from cairn.streaming import traces as T


def event_sessions(s, d):
    """Sessions of a user with a gap of 30 minutes, in batch."""
    e = table(s, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id")
    return e.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.sum("purchases").alias("purchases"))


def stream_hourly(s, d):
    out = E.drained(E.windowed_counts(E.read_events(s, d)), f"hourly_{uuid.uuid4().hex}")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def trace_sessions(s, d):
    """Every user's traces, audited in batch."""
    return T.closed_traces(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def stream_traces(s, d):
    """The traces that the stream has closed: those whose gap ends before the last event's time less ten minutes."""
    old = s.conf.get(T.PROVIDER)
    s.conf.set(T.PROVIDER, T.ROCKS)
    try:
        return E.drained(T.audited_traces(E.read_events(s, d)), f"traces_{uuid.uuid4().hex}", "append")
    finally:
        s.conf.set(T.PROVIDER, old)


QUERIES = {"event_sessions": event_sessions, "stream_hourly": stream_hourly, "trace_sessions": trace_sessions, "stream_traces": stream_traces}
_TRACES = """WITH g AS (SELECT *, epoch_us(ts) AS us, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS trace FROM g),
t AS (SELECT user_id, min(us) AS began, max(us) AS ended, count(*) AS events, bool_or(event_type='error') AS denied, bool_or(event_type='purchase') AS committed,
coalesce(min({'a': us, 'i': event_id}) FILTER (event_type='error') < min({'a': us, 'i': event_id}) FILTER (event_type='purchase'), false) AS error_first FROM n GROUP BY user_id, trace)"""
SQL = {
    "trace_sessions": f"{_TRACES} SELECT * FROM t",
    "stream_traces": f"{_TRACES} SELECT * FROM t WHERE (ended+1800000000)//1000+1 <= (SELECT max(epoch_ms(ts))-600000 FROM events)",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS events, count(*) FILTER (event_type='purchase') AS purchases FROM g GROUP BY 1",
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
