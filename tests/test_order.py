"""Positions, percentiles and time slices against plain windows and numpy."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.operators import metrics, promql, ranking, timeslices
from sparkguard.operators import alerts as A


@pytest.fixture(scope="module")
def series(spark):
    """One key with half of all rows, gaps longer than a slice, equal times and null values."""
    rng = np.random.default_rng(3)
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(3000):
        key = "hot" if i % 2 else f"k{i % 7}"
        at = t0 + dt.timedelta(seconds=int(rng.integers(0, 6 * 3600)) + (86_400 if i % 5 == 0 else 0))
        rows.append((i, key, at, float(round(rng.exponential(20), 1)), int(rng.integers(0, 2))))
    return spark.createDataFrame(rows, "id bigint, key string, ts timestamp_ntz, value double, state int").cache()


def test_percentiles_match_numpy(spark, series):
    got = {r["key"]: r for r in ranking.percentiles(series, ["key"], "value", metrics.PERCENTILES).collect()}
    for key, part in series.toPandas().groupby("key"):
        for name, q in metrics.PERCENTILES.items():
            assert got[key][name] == pytest.approx(np.percentile(part["value"], q * 100))


def test_percentiles_of_one_value_and_nulls(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", None), ("c", 1.0), ("c", 2.0)], "key string, value double")
    got = {r["key"]: r["m"] for r in ranking.percentiles(df, ["key"], "value", {"m": 0.5}).collect()}
    assert got == {"a": 5.0, "c": 1.5}


@pytest.mark.parametrize("accuracy", [4, 100, 10_000])
def test_percentiles_do_not_depend_on_the_sketch(spark, accuracy):
    """Coarse borders only leave more values between them; outliers, repeats, infinities and null keys are ranked like any other."""
    rng = random.Random(accuracy)
    values = {
        "even": [float(k) for k in range(2000)], "repeats": [rng.choice([1.0, 2.0, 3.0]) for _ in range(2001)], "outliers": [rng.random() for _ in range(500)] + [1e300, -1e300],
        "tiny": [5.0, 7.0], "one": [3.25], "zeros": [0.0, -0.0] * 50 + [1.0], "ends": [float("-inf"), *[float(k) for k in range(400)], float("inf")], None: [rng.gauss(0, 5) for _ in range(777)],
    }
    rows = [(k, v) for k, some in values.items() for v in rng.sample(some, len(some))] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(5)
    wanted = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r["key"]: r for r in ranking.percentiles(df, ["key"], "value", wanted, accuracy).collect()}
    assert set(got) == set(values)
    for key, some in values.items():
        for name, q in wanted.items():
            at = (len(some) - 1) * q
            low, share = sorted(some)[int(at)], at - int(at)
            want = low * (1 - share) + sorted(some)[int(at) + 1] * share if share else low
            assert got[key][name] == pytest.approx(want, rel=1e-12), (key, name)


@pytest.mark.parametrize("accuracy", [4, 10_000])
def test_discrete_percentiles_are_values_of_their_rank(spark, accuracy):
    rows = [("long", float(k)) for k in range(12_345)] + [("hundred", float(k)) for k in range(1, 101)] + [("one", 2.5), ("gone", None)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(5)
    wanted = {"p0": 0.0, "p7": 0.07, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["key"]: tuple(r)[1:] for r in ranking.percentiles(df, ["key"], "value", wanted, accuracy, discrete=True).collect()}
    assert got == {"long": (0.0, 864.0, 6172.0, 12_221.0, 12_344.0), "hundred": (1.0, 7.0, 50.0, 99.0, 100.0), "one": (2.5,) * 5}


def test_approx_stats_of_long_series_have_the_exact_rank(spark):
    """A sketch alone is off by ranks from half its accuracy's number of points on. A series without any value keeps its row."""
    names = F.when(F.col("id") < 7_000, "a").when(F.col("id") < 27_000, "b").otherwise("empty")
    value = F.when(F.col("id") < 7_000, (F.col("id") * 7_919) % 7_000).when(F.col("id") < 27_000, (F.col("id") * 7_919) % 20_000)
    df = spark.range(0, 27_001, 1, 6).select(names.alias("series_key"), metrics.at(NOON).alias("ts"), value.cast("double").alias("value"))
    got = {r["series_key"]: (r["count"], r["p50"], r["p95"], r["p99"]) for r in metrics.metric_stats_approx(df, NOON).collect()}
    assert got == {"a": (7_000, 3_499.0, 6_649.0, 6_929.0), "b": (20_000, 9_999.0, 18_999.0, 19_799.0), "empty": (0, None, None, None)}


def test_percentiles_run_no_job_and_sort_nothing_whole(spark, series):
    """No checkpoint and no range partitioning in the plan; a query that is only built reads nothing."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "percentiles")
    plan = ranking.percentiles(series, ["key"], "value", metrics.PERCENTILES)._jdf.queryExecution().optimizedPlan().toString()
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "RepartitionByExpression" not in plan and "LogicalRDD" not in plan.replace("InMemoryRelation", "")


def test_percentiles_of_a_hot_series(spark):
    """Ten million points of one series: the last step sees a small share of them."""
    df = spark.range(10_000_000).select(F.lit("hot").alias("key"), ((F.col("id") * 7_919) % 10_000_000).cast("double").alias("value"))
    out = ranking.percentiles(df, ["key"], "value", {"p50": 0.5, "p99": 0.99})
    assert [tuple(r) for r in out.collect()] == [("hot", 4_999_999.5, 9_899_999.01)]


def test_positions_are_row_numbers(spark, series):
    got = ranking.positions(series.select("id", "key", "value"), ["key"], ["value", "id"])
    want = series.select("id", (F.row_number().over(W.partitionBy("key").orderBy("value", "id")) - 1).alias("rn"))
    assert got.join(want, "id").where(F.col("before") != F.col("rn")).count() == 0
    whole = ranking.positions(series.select("id"), [], ["id"])
    assert whole.where(F.col("before") != F.col("id")).count() == 0 and whole.count() == 3000


@pytest.mark.parametrize("seconds", [60, 300, 7200])
def test_lookback_matches_a_plain_window(spark, series, seconds):
    holes = series.withColumn("value", F.when(F.col("id") % 11 != 0, F.col("value")))
    got = timeslices.rolling(holes, ["key"], "ts", "value", seconds)
    us = timeslices.micros(F.col("ts"))
    w = W.partitionBy("key").orderBy(us).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    v = F.col("value")
    plain = {"count": F.count(v), "sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "stddev": F.stddev_pop(v)}
    want = holes.select("id", *[c.over(w).alias(f"w_{n}") for n, c in plain.items()])
    joined = got.join(want, "id").cache()
    assert got.count() == joined.count() == 3000
    for n in plain:
        same = F.col(n).eqNullSafe(F.col(f"w_{n}")) | (F.abs(F.col(n) - F.col(f"w_{n}")) < 1e-6)
        assert joined.where(~F.coalesce(same, F.lit(False))).count() == 0, n


@pytest.fixture(scope="module")
def burst(spark):
    """All rows of a hot series within one minute, few before and after it, and another series."""
    rng, t0, rows = random.Random(8), dt.datetime(2024, 1, 2, 7, 30), []
    for i in range(6000):
        spread = rng.random() * 60 if i % 20 else rng.random() * 300_000 - 100_000
        rows.append((i, "hot" if i % 9 else "other", t0 + dt.timedelta(seconds=spread), 1e6 + rng.random() if i % 13 else None, int(rng.random() < 0.3)))
    rows += [(6000 + i, None, t0 + dt.timedelta(seconds=i % 7), 1.0 * i, i % 2) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, key string, ts timestamp_ntz, value double, state int").cache()


@pytest.mark.parametrize("seconds", [30, 3600, 86_400])
def test_lookback_over_a_burst(spark, burst, seconds):
    """A day's window over a minute that holds nearly all rows: the statistics of a plain window, from pieces of about 100 rows."""
    got = timeslices.rolling(burst, ["key"], "ts", "value", seconds, most=100)
    us = timeslices.micros(F.col("ts"))
    w = W.partitionBy("key").orderBy(us).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    v = F.col("value")
    plain = {"count": F.count(v), "sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "stddev": F.stddev_pop(v)}
    want = burst.select("id", *[c.over(w).alias(f"w_{n}") for n, c in plain.items()])
    joined = got.join(want, "id").cache()
    assert got.count() == joined.count() == burst.count()
    for n in plain:
        same = F.col(n).eqNullSafe(F.col(f"w_{n}")) | (F.abs(F.col(n) - F.col(f"w_{n}")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(f"w_{n}") / 1e4))
        assert joined.where(~F.coalesce(same, F.lit(False))).count() == 0, n


def test_pieces_are_bounded_however_rows_lie_in_time(burst):
    us = timeslices.micros(F.col("ts"))
    for seconds in (60, 3600, 86_400):
        placed = burst.withColumns({"_slice": timeslices.time_slice("ts", seconds), "_cell": timeslices.cell(us, seconds * 1_000_000)})
        borders = timeslices.borders_of(placed, ["key"], 200)
        every, some = timeslices.cut(placed, ["key"], borders), timeslices.cut(placed, ["key"], borders, "inner")
        assert every.count() == burst.count() and every.groupBy("_g").count().agg(F.max("count")).head()[0] <= 400
        assert 0 < some.count() <= every.count()
        order = every.select("_g", us.alias("us")).groupBy("_g").agg(F.min("us").alias("a"), F.max("us").alias("z"))
        apart = order.withColumn("next", F.lead("a").over(W.partitionBy("_g.key").orderBy("_g._slice", "_g._piece")))
        assert apart.where(F.col("next") <= F.col("z")).count() == 0
    assert timeslices.borders_of(placed, ["key"], timeslices.PIECE_ROWS) is None


def test_few_hot_slices_are_cut_first(burst, monkeypatch):
    """The cut is bounded: beyond as many slices or pieces, slices stay whole and pieces grow, and results stay right."""
    monkeypatch.setattr(timeslices, "MOST_PIECES", 3)
    placed = burst.withColumns({"_slice": timeslices.time_slice("ts", 3600), "_cell": timeslices.cell(timeslices.micros(F.col("ts")), 3_600_000_000)})
    found = timeslices.borders_of(placed, ["key"], 100)
    assert found.count() <= 3 and found.agg(F.sum(F.size("_borders"))).head()[0] <= 9
    total = timeslices.with_running_sum(burst, ["key"], ["ts", "id"], F.col("state"), "total", most=100)
    want = burst.select("id", F.sum("state").over(W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)).alias("want"))
    assert total.join(want, "id").where(F.col("total") != F.col("want")).count() == 0


def test_previous_sums_and_runs_over_a_burst(spark, burst):
    """One hour of one series is many groups, and runs reach over them."""
    order, w = ["ts", "id"], W.partitionBy("key").orderBy("ts", "id")
    prev = timeslices.with_previous(burst, ["key"], order, ["value"], most=100)
    want = burst.select("id", F.lag("value").over(w).alias("want"))
    assert prev.join(want, "id").where(~F.col("prev_value").eqNullSafe(F.col("want"))).count() == 0 and prev.count() == burst.count()
    total = timeslices.with_running_sum(burst, ["key"], order, F.col("state"), "total", most=100)
    want = burst.select("id", F.sum("state").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("want"))
    assert total.join(want, "id").where(F.col("total") != F.col("want")).count() == 0
    runs = timeslices.with_run(burst, ["key"], order, "state", most=100)
    flagged = burst.select("id", "key", *order[:1], F.when(F.col("state").eqNullSafe(F.lag("state").over(w)), 0).otherwise(1).alias("f"))
    want = flagged.select("id", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("want"))
    assert runs.join(want, "id").where(F.col("run") != F.col("want")).count() == 0 and runs.count() == burst.count()


def test_previous_running_sum_and_runs_match_plain_windows(spark, series):
    order = ["ts", "id"]
    w = W.partitionBy("key").orderBy(*order)
    prev = timeslices.with_previous(series, ["key"], order, ["value"], 600)
    want = series.select("id", F.lag("value").over(w).alias("want"))
    assert prev.join(want, "id").where(~F.col("prev_value").eqNullSafe(F.col("want"))).count() == 0
    total = timeslices.with_running_sum(series, ["key"], order, F.col("state"), "total", 600)
    want = series.select("id", F.sum("state").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("want"))
    assert total.join(want, "id").where(F.col("total") != F.col("want")).count() == 0
    runs = timeslices.with_run(series, ["key"], order, "state", 600)
    flagged = series.withColumn("f", F.when(F.col("state").eqNullSafe(F.lag("state").over(w)), 0).otherwise(1))
    want = flagged.select("id", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("want"))
    assert runs.join(want, "id").where(F.col("run") != F.col("want")).count() == 0


def test_newest_is_exact(spark, series):
    got = {r["id"] for r in ranking.newest(series, ["key"], "ts", "id", 40, 60).collect()}
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")))
    want = {r["id"] for r in series.withColumn("rn", rank).where("rn <= 40").collect()}
    assert got == want


NOON = dt.datetime(2024, 1, 1, 12)


def at(minutes: float) -> dt.datetime:
    return NOON + dt.timedelta(minutes=minutes)


def points(spark, rows):
    tagged = [(i, "m", {}, "m", t, v) for i, (t, v) in enumerate(rows)]
    return spark.createDataFrame(tagged, "point_id int, name string, tags map<string,string>, series_key string, ts timestamp_ntz, value double")


def test_bounds_of_the_lookbacks(spark):
    p = points(spark, [(at(-5), 1.0), (at(-4.999), 2.0), (at(0), 3.0), (at(0.001), 9.0)])
    assert metrics.metric_stats(p, NOON).head()["count"] == 2
    assert metrics.recent(p, NOON, 300, inclusive=True).count() == 3
    assert metrics.metric_range(p, "m", at(-5), at(0)).count() == 3
    assert metrics.series_cap(points(spark, [(at(-1440), 1.0), (at(-1439), 2.0)]), NOON, 10, 24).count() == 1
    rolling = {r["point_id"]: r["count"] for r in metrics.metric_rolling(p).collect()}
    assert rolling == {0: 1, 1: 2, 2: 2, 3: 2}


def test_counter_reset(spark):
    p = points(spark, [(at(0), 10.0), (at(1), 14.0), (at(2), 3.0), (at(3), 5.0)])
    up = {r["point_id"]: r["increase"] for r in promql.increases(p, ["series_key"], "value", "point_id").collect()}
    assert up == {0: 0.0, 1: 4.0, 2: 3.0, 3: 2.0}


ALERT = A.Alert("a", "A", "m", 5, "high", 5, 2, actions=("email",))


def test_alert_states(spark):
    p = points(spark, [(at(-5), 9.0), (at(-1), 9.0), (at(0), 1.0)])
    row = A.evaluate(p, (ALERT,), NOON).head()
    assert (row["state"], row["breaches"], row["current_value"]) == ("firing", 2, 1.0)
    assert row["message"] == "A: 1.0 GreaterThanThreshold 5.0"
    assert A.evaluate(points(spark, [(at(-6), 9.0)]), (ALERT,), NOON).count() == 0
    odd = A.Alert("o", "O", "m", 0, "low", 5, 1, "Odd")
    assert A.evaluate(p, (odd,), NOON).head()["state"] == "ok"
    assert A.evaluate(p, (A.Alert("d", "D", "m", 0, "low", enabled=False), ALERT), NOON).count() == 1


def test_silence_changes_nothing(spark):
    """Two bursts of breaches with hours of silence between them are one episode."""
    bursts = [(at(0), 9.0), (at(0), 9.0), (at(300), 9.0), (at(300), 9.0), (at(400), 1.0)]
    found = A.episodes(A.grid_spans(points(spark, bursts), (ALERT,), 60))
    (row,) = found.collect()
    assert (row["triggered_at"], row["resolved_at"], row["state"]) == (NOON, at(400), "resolved")
    notes = A.notifications(found, (ALERT,)).collect()
    assert sorted(r["handler"] for r in notes) == ["email", "email_resolution"]


def test_spans_against_every_evaluation(spark):
    """At half a minute and a day's look-back a point is two changes, not 2,881 copies."""
    rng = random.Random(4)
    rows = [(at(rng.randint(0, 4000)) + dt.timedelta(seconds=rng.choice([0, 30, 7])), rng.choice([1.0, 9.0])) for _ in range(120)]
    day = A.Alert("d", "D", "m", 5, "high", 1440, 3)
    spans = A.grid_spans(points(spark, rows), (ALERT, day), 30)
    assert spans.count() <= 4 * len(rows)
    got = {(r["alert_id"], r["evaluated_at"]): (r["breaches"], r["state"]) for r in A.grid_states(points(spark, rows), (ALERT, day), 30).collect()}
    want = {}
    for alert in (ALERT, day):
        length = dt.timedelta(minutes=alert.period_minutes)
        for k in range(-200, 12_000):
            now = NOON + dt.timedelta(seconds=30 * k)
            seen = [v for t, v in rows if now - length <= t <= now]
            if seen:
                n = sum(v > 5 for v in seen)
                want[alert.alert_id, now] = (n, "firing" if n >= alert.datapoints else "ok")
    assert got == want


def test_default_alerts(spark):
    rows = [(1, "system.cpu.usage", 85.0), (2, "system.cpu.usage", 81.0), (3, "system.cpu.usage", 80.0), (4, "system.disk.free_percent", 9.0)]
    rows += [(5, "system.disk.free_percent", 8.0), (6, "cloud.daily_cost", 501.0)]
    p = spark.createDataFrame(
        [(i, n, {}, n, at(-i), v) for i, n, v in rows],
        "point_id int, name string, tags map<string,string>, series_key string, ts timestamp_ntz, value double",
    )
    states = {r["alert_id"]: r["state"] for r in A.evaluate(p, A.DEFAULT_ALERTS, NOON).collect()}
    # two of three readings are above 80, three are asked for; equal is not above
    assert states == {"high_cpu": "ok", "disk_space": "firing", "cost_anomaly": "firing"}


def test_tag_match(spark):
    p = spark.createDataFrame(
        [(1, "m", {"u": "1"}, "m:u=1", NOON, 9.0), (2, "m", {"u": "1"}, "m:u=1", NOON, 9.0)],
        "point_id int, name string, tags map<string,string>, series_key string, ts timestamp_ntz, value double",
    )
    assert A.evaluate(p, (ALERT,), NOON).count() == 0
    assert A.evaluate(p, (ALERT,), NOON, tag_match="subset").count() == 1
