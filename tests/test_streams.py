"""Streams over many small files against their batch twins."""

from __future__ import annotations

import datetime as dt
import random
import time
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkguard.operators import alerts as A
from sparkguard.operators import metrics
from sparkguard.plans.metrics_queries import ALERTS, STEP, points
from sparkguard.plans.registry import Inputs
from sparkguard.streaming import jobs


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def in_parts(df, path, n):
    """Time-ordered files, so that the watermark moves between micro-batches."""
    df.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(path)


def test_alert_events_over_micro_batches(spark, inputs, folder):
    p = points(inputs)
    for lo, hi in (("2023-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2025-01-01")):
        inside = (F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
        p.where(inside).coalesce(1).write.mode("append").parquet(folder("points"))
        # each run takes up where the checkpoint of the last one ends
        stream = spark.readStream.schema(p.schema).parquet(folder("points"))
        query = jobs.alerts_to_files(stream, ALERTS, folder("events"), folder("checkpoint"), STEP)
        query.awaitTermination()
        final = dt.datetime.fromisoformat(query.lastProgress.eventTime["watermark"].rstrip("Z"))
    got = {(r["alert_id"], r["event"], r["at"]) for r in spark.read.schema(jobs.ALERT_EVENTS).parquet(folder("events")).collect()}
    episodes = A.episodes(A.grid_spans(p, ALERTS, STEP)).collect()
    want = {(r["alert_id"], "firing", r["triggered_at"]) for r in episodes}
    want |= {(r["alert_id"], "resolved", r["resolved_at"]) for r in episodes if r["resolved_at"]}
    assert got and got == {w for w in want if w[2] <= final}


def test_alert_events_at_thirty_seconds(spark, inputs, folder):
    """Stopped in the middle and restarted: the events of the batch episodes at the same step, each once."""
    p = points(inputs)
    far = p.groupBy("series_key").agg(F.max_by(F.struct(*p.columns), "ts").alias("r")).select("r.*").withColumn("ts", p.agg(F.max("ts")).scalar() + F.expr("interval 3650 days"))
    cut = p.agg(F.median(F.unix_micros(F.col("ts").cast("timestamp")))).head()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) < cut
    for part in (p.where(early), p.where(~early), far):
        part.coalesce(1).write.mode("append").parquet(folder("points"))
        stream = spark.readStream.schema(p.schema).parquet(folder("points"))
        jobs.alerts_to_files(stream, ALERTS, folder("events"), folder("checkpoint")).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(jobs.ALERT_EVENTS).parquet(folder("events")).collect()))
    evaluated = {(r["alert_id"], r["evaluated_at"]): r["current_value"] for r in A.grid_spans(p, ALERTS).collect()}
    episodes = A.episodes(A.grid_spans(p, ALERTS)).collect()
    at = [(r["alert_id"], "firing", r["triggered_at"]) for r in episodes] + [(r["alert_id"], "resolved", r["resolved_at"]) for r in episodes if r["resolved_at"]]
    assert got and got == sorted((*x, evaluated[x[0], x[2]]) for x in at)


def test_a_late_point_neither_enters_nor_leaves(spark, folder):
    """Behind the watermark a point counts for nothing, also at the time it would have left."""
    alert = (A.Alert("a", "A", "m", 5, "high", 5, 1),)
    start = dt.datetime(2024, 1, 1)
    schema = "point_id long, name string, tags map<string,string>, series_key string, ts timestamp_ntz, value double"
    for i, parts in enumerate(([(0, 9.0)], [(7200, 1.0)], [(60, 9.0), (7230, 9.0)], [(90000, 1.0)], [(180000, 1.0)])):
        rows = [(10 * i + k, "m", {}, "m", start + dt.timedelta(seconds=s), v) for k, (s, v) in enumerate(parts)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder("points"))
        stream = spark.readStream.schema(schema).parquet(folder("points"))
        jobs.alerts_to_files(stream, alert, folder("events"), folder("checkpoint")).awaitTermination()
    got = sorted((r["at"] - start).total_seconds() for r in spark.read.schema("at timestamp_ntz").parquet(folder("events")).collect())
    assert got == [0.0, 7200.0, 7230.0, 90000.0]


class Held:
    """A state handle of one key in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def listTimers(self):  # noqa: N802
        return sorted(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


def transitions(batches, step, datapoints):
    """Events of batches of changes, each of which may come in parts; timers up to the next batch expire before it."""
    held, got = Held(), []
    alert = jobs.Transitions((A.Alert("a", "A", "m", 5, "high", 5, datapoints),), step)
    alert.init(held)
    for rows, until in batches:
        if rows:
            frame = pd.DataFrame(rows, columns=["slot", "until", "points", "breaches", "current_value"])
            parts = (frame.iloc[i : i + 10_000] for i in range(0, len(frame), 10_000))
            got += alert.handleInputRows(("a",), parts, None)
        while held.timers and min(held.timers) <= until * step * 1000:
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda u=until: u * step * 1000)
            got += alert.handleExpiredTimer(("a",), times, SimpleNamespace(getExpiryTimeInMs=lambda: min(held.timers)))
    return [tuple(r) for some in got for r in some.itertuples(index=False)]


@pytest.mark.parametrize("seed", range(8))
def test_transitions_are_those_of_every_grid_time(seed):
    """Counts of the points that each grid time sees, one after the other, give the same events; whatever the batches are."""
    rng, step, datapoints = random.Random(seed), 30, 1 + seed % 3
    rows, slot = [], 100
    while slot < 1500:
        for stay in sorted(rng.sample((3, 4, 5, 40), rng.choice((1, 1, 2)))):
            n = rng.randint(1, 3)
            rows.append((slot, slot + stay, n, rng.randint(0, n) if rng.random() < 0.4 else 0, rng.choice((1.5, 9.0, float("nan")))))
        slot += rng.choice((1, 1, 2, 6, 60))
    want, firing, value = [], False, None
    for at in range(100, 1600):
        seen = [r for r in rows if r[0] <= at < r[1]]
        value = next((r[4] for r in reversed(rows) if r[0] == at), value)
        if seen and (sum(r[3] for r in seen) >= datapoints) != firing:
            firing = not firing
            want.append(("a", "firing" if firing else "resolved", pd.Timestamp(at * step, unit="s"), value))
    for cuts in ([2000], [400, 900, 2000], list(range(110, 2000, 10))):
        batches, start = [], 0
        for cut in cuts:
            some = [r for r in rows if start <= r[0] <= cut]
            rng.shuffle(some)
            batches.append((some, cut))
            start = cut + 1
        pd.testing.assert_frame_equal(pd.DataFrame(transitions(batches, step, datapoints)), pd.DataFrame(want))
    assert len(want) > 4


def test_a_long_backfill_takes_no_step_of_python_per_grid_time():
    """A batch of 200,000 grid times of one alert, a millisecond each before."""
    rows = [(k, k + 5, 1, int(k % 10 == 0), 1.0) for k in range(200_000)]
    start = time.perf_counter()
    got = transitions([(rows, 300_000)], 30, 1)
    assert time.perf_counter() - start < 20
    assert len(got) == 40_000 and got[1][1:3] == ("resolved", pd.Timestamp(150, unit="s"))


def test_windows_over_micro_batches(spark, inputs, folder):
    p = points(inputs)
    in_parts(p, folder("points"), 6)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 6).parquet(folder("points"))
    jobs.run_to_files(jobs.metric_windows(stream, "1 hour", "30 minutes"), folder("out"), folder("cp")).awaitTermination()
    got = spark.read.parquet(folder("out")).select("window_start", "series_key", "count")
    batch = metrics.metric_windows(p, "1 hour", "30 minutes")
    last = p.agg(F.max("ts").cast("timestamp")).head()[0]
    closed = batch.where(F.col("window_end") <= F.lit(last) - F.expr("interval 10 minutes")).select("window_start", "series_key", "count")
    assert got.count() > 0 and got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0


def test_a_repeated_batch_arrives_once(spark, inputs, folder):
    """The same source and checkpoint again add nothing, and the state holds the newest rows."""
    rows = inputs.table("customer").select("c_custkey", "c_name", F.lit(1).alias("version"))
    rows.write.parquet(folder("source"))
    keys, order = ["c_custkey"], ["version"]
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(folder("source"))
        jobs.sync_to_changes(stream, folder("changes"), folder("cp"), keys, order).awaitTermination()
    assert jobs.changes(spark, folder("changes"), rows.schema).count() == rows.count()
    newer = rows.withColumn("c_name", F.lit("new")).withColumn("version", F.lit(2)).limit(10)
    jobs.merge_into_changes(newer, 7, folder("changes"), keys, order)
    state = jobs.current(jobs.changes(spark, folder("changes"), rows.schema), keys, order)
    assert state.count() == rows.count() and state.where("c_name = 'new'").count() == 10
    assert jobs.changes(spark, folder("nowhere"), rows.schema).count() == 0


def test_fifty_batches_stay_few_files(spark, folder, monkeypatch):
    """The parts of a change table are merged in tiers, and its folder holds a bounded number of files."""
    monkeypatch.setattr(jobs, "FAN", 3)
    keys, order, state = ["k"], ["v"], {}
    schema = spark.createDataFrame([(1, 1)], "k int, v int").schema
    for n in range(50):
        batch = spark.createDataFrame([((n * 7 + i) % 23, n) for i in range(5)], schema).coalesce(1)
        state |= {r["k"]: r["v"] for r in batch.collect()}
        jobs.merge_into_changes(batch, n, folder("t"), keys, order)
        jobs.merge_into_changes(batch, n, folder("t"), keys, order)  # repeated
    rows = jobs.changes(spark, folder("t"), schema)
    assert {r["k"]: r["v"] for r in jobs.current(rows, keys, order).collect()} == state
    (live,) = jobs._manifest(spark, folder("t")).values()
    assert len(live) <= 2 * 4 and len(list(Path(folder("t")).rglob("*.parquet"))) < 40


def test_a_crash_between_merge_and_manifest(spark, folder, monkeypatch):
    """A merge that never got its manifest changes nothing, and the repeated batch completes it."""
    monkeypatch.setattr(jobs, "FAN", 2)
    keys, order = ["k"], ["v"]
    schema = spark.createDataFrame([(1, 1)], "k int, v int").schema
    read = lambda: sorted(map(tuple, jobs.current(jobs.changes(spark, folder("t"), schema), keys, order).collect()))
    for n in range(7):
        before = read()
        batch = spark.createDataFrame([(i, n) for i in range(n % 3, 4)], schema)
        with monkeypatch.context() as broken:
            broken.setattr(jobs, "MANIFEST", "no schema")
            with pytest.raises(Exception, match="(?i)schema|parse|syntax"):
                jobs.merge_into_changes(batch, n, folder("t"), keys, order)
        assert read() == before
        crashing = type(spark).createDataFrame
        with monkeypatch.context() as broken:  # all parts are written, the manifest is not

            def crash(*_, **__):
                raise RuntimeError("lost")

            broken.setattr(type(spark), "createDataFrame", crash)
            with pytest.raises(RuntimeError, match="lost"):
                jobs.merge_into_changes(batch, n, folder("t"), keys, order)
        assert type(spark).createDataFrame is crashing and read() == before
        jobs.merge_into_changes(batch, n, folder("t"), keys, order)
        assert dict(read()) == dict(before) | {i: n for i in range(n % 3, 4)}
