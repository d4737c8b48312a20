"""Traces of events audited as a stream: keyed state, timers in event time, rows in any order up to the watermark.

An extension, like the other streams: the same audit of a table in batch is closed_traces().
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN = "begin long, last long, events long, denied long, denied_id long, committed long, committed_id long"
TRACE = "user_id long, began long, ended long, events long, denied boolean, committed boolean, error_first boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def merged(a: tuple, b: tuple) -> tuple:
    """One open trace of two; of each mark the first by time and event stays."""
    first = lambda i: min(((x[i], x[i + 1]) for x in (a, b) if x[i] is not None), default=(None, None))
    return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], *first(3), *first(5))


def joined_traces(traces: list[tuple], gap: int) -> list[tuple]:
    """Open traces in order of time, those less than gap apart as one."""
    out: list[tuple] = []
    for trace in sorted(traces, key=lambda t: t[:2]):
        if out and trace[0] - out[-1][1] < gap:
            out[-1] = merged(out[-1], trace)
        else:
            out.append(trace)
    return out


class TraceAudit(StatefulProcessor):
    """Per user the open traces, a few numbers each; a timer behind the first to end closes all whose end the watermark has passed.

    One timer a user, so what is held is read and written once a step and not once for each trace.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def _held(self) -> list[tuple]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def _closes(self, trace: tuple) -> int:
        """The first millisecond of a watermark that closes a trace."""
        return (trace[1] + self.gap) // 1000 + 1

    def _keep(self, traces: list[tuple]) -> None:
        if traces:
            self.open.put(traces)
            self.handle.registerTimer(min(map(self._closes, traces)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        traces = self._held()
        for part in rows:
            for at, event, kind in zip(part["at"].tolist(), part["event_id"].tolist(), part["event_type"].tolist(), strict=True):
                denied = (at, event) if kind == "error" else (None, None)
                committed = (at, event) if kind == "purchase" else (None, None)
                traces.append((at, at, 1, *denied, *committed))
            # what is held follows the traces that are open and not the rows that came
            traces = joined_traces(traces, self.gap)
        self._keep(traces)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # timers of before a trace went on come too: those find nothing to close
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        traces = self._held()
        done = [t for t in traces if self._closes(t) <= now]
        self._keep([t for t in traces if self._closes(t) > now])
        if done:
            rows = [(key[0], *t[:3], t[3] is not None, t[5] is not None, t[3] is not None and t[5] is not None and t[3:5] < t[5:7]) for t in done]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TRACE.split(", ")])
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def audited_traces(events: DataFrame, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(user_id, began, ended, events, denied, committed, error_first) of each trace of a stream, once the watermark has passed its end.

    A trace is a user's events less than gap_minutes apart, times are microseconds since 1970; events may come in any order
    up to the watermark, and later ones are dropped. Needs the session's state store to be RocksDB.
    """
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    audit = TraceAudit(gap_minutes * 60_000_000)
    return rows.groupBy("user_id").transformWithStateInPandas(audit, TRACE, "Append", "EventTime")


def closed_traces(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """The same rows of a table, in batch."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.struct(F.unix_micros("ts").alias("at"), "event_id")))
    traces = events.groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes")).agg(
        F.min(F.unix_micros("ts")).alias("began"), F.max(F.unix_micros("ts")).alias("ended"), F.count("*").alias("events"), first("error").alias("e"), first("purchase").alias("p")
    )
    return traces.select("user_id", "began", "ended", "events", F.col("e").isNotNull().alias("denied"), F.col("p").isNotNull().alias("committed"), F.coalesce(F.col("e") < F.col("p"), F.lit(False)).alias("error_first"))
