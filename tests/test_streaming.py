"""Traces as a stream in several steps, out of order and late, against the same audit in batch."""

import datetime

import numpy as np
import pandas as pd
import pytest

from cairn.streaming import traces

SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"


def events(n, users):
    rng = np.random.default_rng(6)
    start = datetime.datetime(2024, 1, 1)
    minutes = np.sort(rng.integers(0, 60 * 48, n))
    return [(int(rng.integers(0, users)), start + datetime.timedelta(minutes=int(m), microseconds=int(i)), i, str(rng.choice(["error", "purchase", "click"]))) for i, m in enumerate(minutes)]


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(traces.PROVIDER)
    spark.conf.set(traces.PROVIDER, traces.ROCKS)
    yield
    spark.conf.set(traces.PROVIDER, old)


def test_stream_and_batch_give_equal_rows(spark, rocks, tmp_path):
    rows = events(400, 7)
    end = rows[-1][1] + datetime.timedelta(days=1)
    late = [(0, rows[0][1], 9000, "error")]  # far behind the watermark of the third step
    rng = np.random.default_rng(1)
    steps = [rows[:150], rows[150:300], rows[300:] + late, [(99, end, 9001, "click")]]
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    for step in steps:
        shuffled = [step[k] for k in rng.permutation(len(step))]
        spark.createDataFrame(shuffled, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = traces.audited_traces(spark.readStream.schema(SCHEMA).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    kept = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in traces.closed_traces(kept).collect())
    assert got == want and len(got) > 100 and {r[6] for r in got} == {True, False}


class Held:
    """List state and timers of one user, counted."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, set()

    def getListState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 150 * 3_600_000

    def getExpiryTimeInMs(self):  # noqa: N802
        return min(self.timers)


def test_one_timer_closes_all_traces_behind_the_watermark():
    held, audit = Held(), traces.TraceAudit(60_000_000)
    audit.init(held)
    hours = pd.DataFrame({"at": [h * 3_600_000_000 for h in range(200)], "event_id": range(200), "event_type": "click"})
    list(audit.handleInputRows((1,), iter([hours]), held))
    assert len(held.timers) == 1
    out = pd.concat(audit.handleExpiredTimer((1,), held, held))
    # those of hours 0 to 149 are closed at hour 150; the others stay behind one more timer
    assert out["began"].tolist() == [h * 3_600_000_000 for h in range(150)] and len(held.rows) == 50 and len(held.timers) == 2 and held.calls <= 4
