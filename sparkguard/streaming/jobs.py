"""Streams of the batch operators. Each has a batch twin that gives the same rows.

Late rows: ten minutes of watermark, later ones are dropped and counted by Spark. A bounded input, such as a backfill, is closed by
``ending``: in one run over all its files nothing is late, and nothing stays open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from sparkguard.operators import alerts as A
from sparkguard.operators import audit, limits, masking, metrics, timeslices

WATERMARK = "10 minutes"
SESSION_TIMEOUT = "3600 seconds"


def files(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder whose names match."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def with_event_time(stream: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Watermarks need a timestamp with zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def ending(rows: DataFrame, keys: list[Column], folder: str, ts: str = "ts", days: int = 3650) -> DataFrame:
    """A stream of the newest row per key, moved ``days`` beyond the last one, to be joined to a bounded input by union.

    Its watermark closes every window, session and evaluation that the input leaves open. What the moved rows open stays open, so
    nothing of them is emitted.
    """
    spark = rows.sparkSession
    newest = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*rows.columns), F.col(ts)).alias("_r")).select("_r.*")
    far = rows.agg(F.max(ts)).scalar() + F.expr(f"interval {days} days")
    newest.withColumn(ts, far).select(*rows.columns).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available into parquet files, exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def metric_windows(points: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    return metrics.windowed(with_event_time(points), length, slide, ("series_key",))


def request_counts(requests: DataFrame, keys: list[str], length: str = "60 seconds", limit: int = limits.GATEWAY_LIMIT[0]) -> DataFrame:
    counts = limits.timed_counts(with_event_time(requests), keys, length)
    return counts.where(F.col("requests") > limit).withColumn("over_limit", F.col("requests") - limit)


def activity_sessions(events: DataFrame, keys: list[str], gap: str = SESSION_TIMEOUT) -> DataFrame:
    """Runs of activity that end after a pause of ``gap``.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` rows merge to sessions before they are shuffled.
    """
    out = with_event_time(events).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "events")


def masked(rows: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    return masking.mask_dataset(rows, key, threshold=threshold)


def audit_to_sinks(log: DataFrame, blocked_path: str, allowed_path: str, checkpoint: str) -> StreamingQuery:
    """Decisions split into two folders. A repeated batch overwrites its own part, so rows arrive once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        decided = audit.decisions(batch).drop("normalized").persist()
        for decision, path in (("BLOCKED", blocked_path), ("ALLOWED", allowed_path)):
            decided.where(F.col("decision") == decision).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        decided.unpersist()

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Parts of a tier that are merged into one of the next, and what a manifest says of each live part.
FAN = 8
MANIFEST = "batch long, tier int, slot int"


def _manifest(spark: SparkSession, path: str, newest: int = 1) -> dict[int, set[tuple[int, int]]]:
    """The live parts by the batch that made them so, of the ``newest`` manifests."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*").collect()  # a row per part, few per tier
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = []
    last = sorted({r["batch"] for r in rows})[-newest:]
    return {n: {(r["tier"], r["slot"]) for r in rows if r["batch"] == n} for n in last}


def _part(path: str, part: tuple[int, int]) -> str:
    return f"{path}/parts/tier={part[0]}/slot={part[1]}"


def changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a change table that are not known to be replaced; ``current`` gives the state."""
    live = sorted(set().union(*_manifest(spark, path).values()))
    reader = spark.read.schema(schema)
    return reader.parquet(*[_part(path, p) for p in live]) if live else spark.createDataFrame([], schema)


def merge_into_changes(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str]) -> None:
    """A batch becomes a part; FAN parts of a tier are merged into one of the next, which holds the newest row per key.

    So with n batches there are fewer than FAN parts in each of about log(n) tiers. Parts are written to slots that neither of the last two manifests
    names, and count from the moment their manifest is there, which is one file: whatever breaks off before leaves the state as it was, and the repeated
    batch writes the same again. A batch that the manifest has already is not taken twice.
    """
    spark = batch.sparkSession
    known = _manifest(spark, path, 2)
    last = max(known, default=-1)
    if batch_id <= last:
        return
    taken = set().union(*known.values())
    live = set(known.get(last, ()))

    def free(tier: int) -> tuple[int, int]:
        part = next((tier, k) for k in range(len(taken) + 1) if (tier, k) not in taken)
        taken.add(part)
        return part

    part = free(0)
    batch.write.mode("overwrite").parquet(_part(path, part))
    live.add(part)
    tier = 0
    while len(full := sorted(p for p in live if p[0] == tier)) >= FAN:
        part = free(tier + 1)
        rows = spark.read.schema(batch.schema).parquet(*[_part(path, p) for p in full])
        current(rows, keys, order).select(*batch.columns).write.mode("overwrite").parquet(_part(path, part))
        live = (live - set(full)) | {part}
        tier += 1
    listed = spark.createDataFrame([(batch_id, *p) for p in sorted(live)], MANIFEST)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/slot={batch_id % 2}")


def sync_to_changes(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Every micro-batch as a part of a change table that merges itself; ``changes`` and ``current`` read it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_into_changes(batch, batch_id, path, keys, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key of a change table, combined before the shuffle."""
    values = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return changes.groupBy(*keys).agg(newest.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


ALERT_EVENTS = "alert_id string, event string, at timestamp, value double"
ALERT_STATE = "firing boolean, points long, breaches long, value double, leaving array<bigint>, left_points array<bigint>, left_breaches array<bigint>"
ENTERING = {"slot": "int64", "until": "int64", "points": "int64", "breaches": "int64", "current_value": "float64"}


class Transitions(StatefulProcessor):
    """Firing and resolved events of one alert, from the points that enter its look-back.

    The state holds how many points are in the look-back, and by the grid time ``until`` which they are seen how many of them leave then: a few numbers per
    grid time of the period at most, however many points there are. What enters comes in the order of the grid, as the counts of a grid time are
    final when they come. What leaves between two of them is taken out on the way, and what leaves after the last one when an event-time timer for
    the next such grid time expires.
    """

    def __init__(self, alerts: tuple[A.Alert, ...], step: int) -> None:
        self.step, self.datapoints = step, {a.alert_id: a.datapoints for a in alerts}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("alert", ALERT_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [[some[c].to_numpy(dtype) for c, dtype in ENTERING.items()] for some in rows]
        entering = [np.concatenate(column) for column in zip(*parts, strict=True)]
        yield from self._evaluated(key, entering, int(entering[0].max()))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._evaluated(key, [np.array([], dtype) for dtype in ENTERING.values()], max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // (1000 * self.step))

    def close(self) -> None:
        pass

    def _evaluated(self, key: tuple, entering: list[np.ndarray], last: int) -> Iterator[pd.DataFrame]:
        """Goes through the grid times up to ``last`` at which points enter or leave: running sums over the changes, and no step of Python per grid time."""
        firing, points, breaches, value, *lists = self.held.get() if self.held.exists() else (False, 0, 0, None, [], [], [])
        in_order = np.lexsort((entering[1], entering[0]))
        slot, until, n, b, current = (column[in_order] for column in entering)
        left, left_n, left_b = (np.array(x, dtype="int64") for x in lists)
        slots, (more, more_b) = _summed(np.concatenate([slot, until, left]), np.concatenate([n, -n, -left_n]), np.concatenate([b, -b, -left_b]))
        due = slots <= last
        now, points_now, breaches_now = slots[due], points + np.cumsum(more[due]), breaches + np.cumsum(more_b[due])
        latest = np.concatenate([[np.nan if value is None else value], current])[np.searchsorted(slot, now, side="right")]
        if len(now):
            points, breaches, value = int(points_now[-1]), int(breaches_now[-1]), float(latest[-1])
        seen = points_now > 0
        states = np.concatenate([[firing], breaches_now[seen] >= self.datapoints[key[0]]]).astype(bool)
        changed = states[1:] != states[:-1]
        self.held.update(
            (bool(states[-1]), points, breaches, None if pd.isna(value) else value, slots[~due].tolist(), (-more[~due]).tolist(), (-more_b[~due]).tolist())
        )
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not due.all():
            self.handle.registerTimer(int(slots[~due][0]) * self.step * 1000)
        if changed.any():
            events = np.where(states[1:][changed], "firing", "resolved")
            at = pd.to_datetime(now[seen][changed] * self.step, unit="s")
            yield pd.DataFrame({"alert_id": key[0], "event": events, "at": at, "value": latest[seen][changed]})


def _summed(slots: np.ndarray, *changes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct slots in order, with the sum of each kind of change."""
    order = np.argsort(slots, kind="stable")
    distinct, starts = np.unique(slots[order], return_index=True)
    return distinct, [np.add.reduceat(c[order], starts) if len(starts) else c for c in changes]


def alert_changes(points: DataFrame, alerts: tuple[A.Alert, ...], step: int = A.EVALUATION_SECONDS, id_column: str = "point_id") -> DataFrame:
    """What enters the alerts' look-backs at times of the grid, each emitted once it is final.

    Spark counts the points per alert, grid time and the grid time ``until`` which they are seen, before anything meets in an alert: a point is
    counted once, however long the period is and short the step. A late point is dropped, so it neither enters nor leaves.
    """
    watched = A.alert_points(points, alerts)
    longest = max(a.period_minutes for a in alerts if a.enabled)
    first, last = timeslices.first_and_last_slot(step, F.col("period"), F.col("ts"))
    spread = watched.where(first <= last).withColumns({"slot": first, "until": last + 1, "b": F.col("breach").cast("long")})
    timed = spread.withColumn("evaluated_at", F.timestamp_seconds(F.col("slot") * step)).withWatermark("evaluated_at", WATERMARK)
    counted = timed.groupBy("evaluated_at", "alert_id", "datapoints", "slot", "until").agg(
        F.count(F.lit(1)).alias("points"), F.sum("b").alias("breaches"), F.max_by("value", F.struct("ts", id_column)).alias("current_value")
    )
    return counted.select("alert_id", "evaluated_at", "slot", "until", "datapoints", "points", "breaches", "current_value")


def alert_events(points: DataFrame, alerts: tuple[A.Alert, ...], step: int = A.EVALUATION_SECONDS) -> DataFrame:
    """Firing and resolved events of a stream of points: two stateful steps of one query, which needs the RocksDB state store."""
    changes = alert_changes(points, alerts, step)
    return changes.groupBy("alert_id").transformWithStateInPandas(Transitions(alerts, step), ALERT_EVENTS, "append", "EventTime")


def alerts_to_files(
    points: DataFrame, alerts: tuple[A.Alert, ...], path: str, checkpoint: str, step: int = A.EVALUATION_SECONDS
) -> StreamingQuery:
    """Events of everything available into parquet files, exactly once. The state store is set for this query alone."""
    conf, name = points.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = run_to_files(alert_events(points, alerts, step), path, checkpoint)
        query.processAllAvailable()
        return query
    finally:
        conf.set(name, before)
