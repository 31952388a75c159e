"""Metric series, alerts, dashboards and rates over the events projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.functions import series as S
from sparkguard.operators import alerts as A
from sparkguard.operators import metrics as M
from sparkguard.operators import promql as P
from sparkguard.operators.dashboards import Widget, dashboard_data
from sparkguard.plans.registry import Inputs, query

AS_OF = dt.datetime(2024, 1, 31)
NOW = "timestamp '2024-01-31 00:00:00'"
DAY_MINUTES = 1440


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def points(t: Inputs) -> DataFrame:
    tagged = t.fx("metrics").withColumn("tags", F.create_map(F.lit("user"), F.col("tag_user")))
    return tagged.withColumn("series_key", S.series_key(F.col("name"), F.col("tags")))


@query("series_key", "select point_id, series_key, name || ':env=test,user=' || tag_user as two_tags, name as no_tags from fx_metrics", fx="metrics")
def series_key(t: Inputs):
    two = F.create_map(F.lit("user"), F.col("tag_user"), F.lit("env"), F.lit("test"))
    none = F.create_map().cast("map<string,string>")
    return points(t).select(
        "point_id", "series_key", S.series_key(F.col("name"), two).alias("two_tags"), S.series_key(F.col("name"), none).alias("no_tags")
    )


@query(
    "metric_range",
    """select point_id, ts, value from fx_metrics where series_key = 'app.view:user=3'
    and ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'""",
    fx="metrics",
)
def metric_range(t: Inputs):
    out = M.metric_range(points(t), S.key_of("app.view", {"user": "3"}), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 12))
    return out.select("point_id", "ts", "value")


_STATS = """count(*) as count, round(sum(value), 4) as sum, round(avg(value), 4) as avg, min(value) as min, max(value) as max,
  round(stddev_pop(value), 4) as stddev"""


@query(
    "metric_stats",
    f"""select series_key, {_STATS}, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95,
    round(quantile_cont(value, 0.99), 4) as p99 from fx_metrics
    where ts > {NOW} - interval 5 day and ts <= {NOW} group by series_key""",
    fx="metrics",
)
def metric_stats(t: Inputs):
    out = M.metric_stats(points(t), AS_OF, 5 * DAY_MINUTES * 60)
    return rounded(out, "sum", "avg", "stddev", "p50", "p95", "p99")


@query(
    "metric_stats_approx",
    f"""select series_key, {_STATS}, list_sort(list(value))[cast(ceil(0.5 * count(*)) as int)] as p50, list_sort(list(value))[cast(ceil(0.95 * count(*)) as int)] as p95,
    list_sort(list(value))[cast(ceil(0.99 * count(*)) as int)] as p99 from fx_metrics where ts > {NOW} - interval 5 day and ts <= {NOW} group by series_key""",
    fx="metrics",
)
def metric_stats_approx(t: Inputs):
    """Series get the value of exactly that rank, also those with more points than the sketch's accuracy."""
    return rounded(M.metric_stats_approx(points(t), AS_OF, 5 * DAY_MINUTES * 60), "sum", "avg", "stddev")


@query(
    "metric_rolling",
    f"""select point_id, series_key, count(*) over w as count, round(sum(value) over w, 4) as sum, round(avg(value) over w, 9) as avg,
      min(value) over w as min, max(value) over w as max, round(stddev_pop(value) over w, 3) as stddev from fx_metrics
    window w as (partition by series_key order by ts range between interval '{DAY_MINUTES * 60 - 1} seconds 999999 microseconds' preceding and current row)""",
    fx="metrics",
)
def metric_rolling(t: Inputs):
    out = M.metric_rolling(points(t), DAY_MINUTES * 60).select(
        "point_id", "series_key", "count", "sum", "avg", "min", "max", "stddev"
    )
    return rounded(rounded(rounded(out, "sum"), "avg", places=9), "stddev", places=3)


@query(
    "metric_windows",
    f"""with w as (select series_key, value, unnest(range(date_trunc('minute', ts) - interval 4 minute, date_trunc('minute', ts) + interval 1 minute, interval 1 minute)) as window_start from fx_metrics)
    select window_start, window_start + interval 5 minute as window_end, series_key, {_STATS} from w group by window_start, series_key""",
    fx="metrics",
)
def metric_windows(t: Inputs):
    return rounded(M.metric_windows(points(t)), "sum", "avg", "stddev")


@query(
    "series_cap",
    f"""select point_id, series_key, ts from (select *, row_number() over (partition by series_key order by ts desc, point_id desc) as rn
    from fx_metrics where ts > {NOW} - interval 480 hour) where rn <= 50""",
    fx="metrics",
)
def series_cap(t: Inputs):
    return M.series_cap(points(t), AS_OF, 50, 480).select("point_id", "series_key", "ts")


@query(
    "service_health",
    f"""select service, arg_max(value, (ts, event_id)) = 1 as healthy, max(ts) as last_check from fx_health
    where ts >= {NOW} - interval 1440 minute and ts <= {NOW} group by service""",
    fx="health",
)
def service_health(t: Inputs):
    return M.service_health(t.fx("health"), AS_OF, DAY_MINUTES * 60)


@query(
    "last_value_panel",
    """select series_key, arg_max(value, (ts, point_id)) as last_value from fx_metrics where value >= 5 group by series_key""",
    fx="metrics",
)
def last_value_panel(t: Inputs):
    holes = points(t).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return M.last_not_null(holes, ["series_key"], "point_id")


@query(
    "legend_calcs",
    """select series_key, round(avg(value), 4) as avg, arg_max(value, (ts, point_id)) as current, max(value) as max, min(value) as min
    from fx_metrics group by series_key""",
    fx="metrics",
)
def legend_calcs(t: Inputs):
    return rounded(M.legend(points(t), ["series_key"], "point_id"), "avg")


# ---- rates -----------------------------------------------------------------------------------

_UP = """u as (select point_id, label, ts, counter_value, case when p is null then 0 when counter_value < p then counter_value else counter_value - p end as up
  from (select *, lag(counter_value) over (partition by label order by ts, point_id) as p from fx_counters))"""


@query(
    "prom_rate",
    f"""with {_UP} select point_id, label, round(sum(up) over (partition by label order by ts range between interval '299 seconds 999999 microseconds' preceding and current row) / 300.0::double, 6) as rate from u""",
    fx="counters",
)
def prom_rate(t: Inputs):
    return rounded(P.rate(t.fx("counters"), ["label"], "counter_value", "point_id"), "rate", places=6).select("point_id", "label", "rate")


@query(
    "prom_ratio",
    """with p as (select tag_user, date_trunc('day', ts) as bucket, sum(value) as value from fx_metrics where name = 'app.purchase' group by 1, 2),
    v as (select tag_user, date_trunc('day', ts) as bucket, sum(value) as value from fx_metrics where name = 'app.view' group by 1, 2)
    select p.tag_user, p.bucket, round(case when v.value = 0 then null else p.value / v.value * 100 end, 4) as percent
    from p join v on p.tag_user = v.tag_user and p.bucket = v.bucket""",
    fx="metrics",
)
def prom_ratio(t: Inputs):
    daily = points(t).withColumn("bucket", F.date_trunc("day", "ts").cast("timestamp_ntz"))

    def total(name: str) -> DataFrame:
        return daily.where(F.col("name") == name).groupBy("tag_user", "bucket").agg(F.sum("value").alias("value"))

    return rounded(P.ratio(total("app.purchase"), total("app.view"), ["tag_user", "bucket"]), "percent")


@query(
    "prom_histogram_quantile",
    """with b as (select label, case when le = 500 then 'infinity'::double else le::double end as le, cum_count::bigint as c from fx_histogram),
    r as (select *, coalesce(lag(le) over (partition by label order by le), 0) as lower, coalesce(lag(c) over (partition by label order by le), 0) as below,
      max(c) over (partition by label) as total from b),
    h as (select q, label, arg_min(struct_pack(le := le, c := c, lower := lower, below := below, rank := total * q), le) as h
      from r, (values (0.5::double), (0.95::double), (0.99::double)) v(q) where c >= total * q group by 1, 2)
    select label, q, round(case when isinf(h.le) then h.lower else h.lower + (h.le - h.lower) * (h.rank - h.below) / (h.c - h.below) end, 4) as quantile from h""",
    fx="histogram",
)
def prom_histogram_quantile(t: Inputs):
    buckets = t.fx("histogram").withColumn("le", F.when(F.col("le") == 500, float("inf")).otherwise(F.col("le").cast("double")))
    return rounded(P.histogram_quantile(buckets, ["label"], [0.5, 0.95, 0.99]), "quantile")


@query(
    "prom_changes",
    """with c as (select *, case when p is not null and p <> value then 1 else 0 end as ch from
      (select *, lag(value) over (partition by service order by ts, event_id) as p from fx_health))
    select * from (select event_id, service, cast(sum(ch) over (partition by service order by ts range between interval '3599 seconds 999999 microseconds' preceding and current row) as bigint) as changes from c) where changes > 0""",
    fx="health",
)
def prom_changes(t: Inputs):
    out = P.changes(t.fx("health"), ["service"], "value", "event_id")
    return out.where(F.col("changes") > 0).select("event_id", "service", "changes")


# ---- alerts ----------------------------------------------------------------------------------

ALERTS = (
    A.Alert("slow_view", "Slow View", "app.view", 40, "high", 2880, 2, "GreaterThanThreshold", ("email", "slack"), {"user": "3"}),
    A.Alert("low_click", "Low Click", "app.click", 1.5, "medium", 1440, 1, "LessThanThreshold", ("email",), {"user": "5"}),
    A.Alert("errors", "Errors", "app.error", 60, "critical", 1440, 1, "GreaterThanOrEqualToThreshold", ("email", "pagerduty"), {"user": "7"}),
    A.Alert("signup_floor", "Signup Floor", "app.signup", 2, "low", 720, 2, "LessThanOrEqualToThreshold", ("slack",), {"user": "1"}),
    A.Alert("odd_operator", "Odd Operator", "app.view", 0, "low", 1440, 1, "Unknown", ("email",), {"user": "2"}),
    A.Alert("switched_off", "Switched Off", "app.view", 0, "low", 1440, 1, "GreaterThanThreshold", ("email",), {"user": "4"}, False),
    A.Alert("untagged", "Untagged", "app.view", 0, "low", 1440, 1, "GreaterThanThreshold", ("email",)),
)
STEP = A.EVALUATION_SECONDS


def _alert_rows() -> str:
    rows = []
    for a in ALERTS:
        if a.enabled:
            actions = "[" + ", ".join(f"'{x}'" for x in a.actions) + "]"
            rows.append(
                f"('{a.alert_id}', '{a.name}', '{S.key_of(a.metric_name, a.tags)}', {a.threshold}::double, '{a.severity}', {a.period_minutes}, {a.datapoints}, '{a.operator}', {actions})"
            )
    return "al(alert_id, alert_name, series_key, threshold, severity, period, datapoints, operator, actions) as (values " + ", ".join(rows) + ")"


_BREACH = """case operator when 'GreaterThanThreshold' then value > threshold when 'LessThanThreshold' then value < threshold
  when 'GreaterThanOrEqualToThreshold' then value >= threshold when 'LessThanOrEqualToThreshold' then value <= threshold else false end"""


def _num(e: str) -> str:
    trimmed = f"regexp_replace(cast(cast({e} as decimal(38,6)) as varchar), '0+$', '')"
    return f"(case when ends_with({trimmed}, '.') then {trimmed} || '0' else {trimmed} end)"


@query(
    "alert_metric_join",
    f"""with {_alert_rows()} select alert_id, count(*) as points, round(sum(value), 4) as total, max(ts) as last_ts from fx_metrics m join al on m.series_key = al.series_key
    where ts between {NOW} - interval 1 minute * period and {NOW} group by 1""",
    fx="metrics",
)
def alert_metric_join(t: Inputs):
    w = A.alert_points(points(t), ALERTS)
    start = F.unix_micros(M.at(AS_OF).cast("timestamp")) - F.col("period").cast("long") * 1_000_000
    inside = w.where((F.unix_micros(F.col("ts").cast("timestamp")) >= start) & (F.col("ts") <= M.at(AS_OF)))
    out = inside.groupBy("alert_id").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"), F.max("ts").alias("last_ts"))
    return rounded(out, "total")


_EVAL = f"""e as (select alert_id, alert_name, severity, operator, threshold, datapoints, count(*) as points, count(*) filter ({_BREACH}) as breaches,
  arg_max(value, (ts, point_id)) as current_value from fx_metrics m join al on m.series_key = al.series_key
  where ts between {NOW} - interval 1 minute * period and {NOW} group by 1, 2, 3, 4, 5, 6)"""


@query(
    "alert_eval",
    f"""with {_alert_rows()}, {_EVAL} select alert_id, severity, points, breaches, current_value, case when breaches >= datapoints then 'firing' else 'ok' end as state,
    alert_name || ': ' || {_num('current_value')} || ' ' || operator || ' ' || {_num('threshold')} as message from e""",
    fx="metrics",
)
def alert_eval(t: Inputs):
    return A.evaluate(points(t), ALERTS, AS_OF).select("alert_id", "severity", "points", "breaches", "current_value", "state", "message")


def episodes_sql(step: int, evaluated: str = "true") -> str:
    """Every point at every grid time that sees it, counted; ``evaluated`` limits the grid times."""
    return f"""w as (select al.*, m.ts, m.point_id, m.value, {_BREACH} as breach,
    unnest(range(cast(ceil(epoch_us(ts) / {step}e6) as bigint), cast(floor((epoch_us(ts) + period::bigint * 60000000) / {step}e6) as bigint) + 1)) * {step} as slot
  from fx_metrics m join al on m.series_key = al.series_key),
g as (select alert_id, severity, slot, datapoints, count(*) filter (breach) as breaches, arg_max(value, (ts, point_id)) as cv from w where {evaluated} group by 1, 2, 3, 4),
s as (select *, case when breaches >= datapoints then 'firing' else 'ok' end as state from g),
f as (select *, case when state = lag(state) over (partition by alert_id order by slot) then 0 else 1 end as fresh from s),
r as (select *, sum(fresh) over (partition by alert_id order by slot rows unbounded preceding) as run from f),
z as (select alert_id, severity, run, state, min(slot) as first_slot, max(slot) as last_slot, count(*) as evaluations, arg_max(cv, slot) as current_value from r group by 1, 2, 3, 4),
ep as (select a.alert_id, a.severity, a.run, make_timestamp(a.first_slot * 1000000) as triggered_at, make_timestamp(b.first_slot * 1000000) as resolved_at,
    a.evaluations, a.current_value, case when b.first_slot is null then 'firing' else 'resolved' end as state
  from z a left join z b on a.alert_id = b.alert_id and b.run = a.run + 1 and b.state = 'ok' where a.state = 'firing')"""


_EPISODES = episodes_sql(STEP)


def _episodes(t: Inputs, step: int = STEP) -> DataFrame:
    return A.episodes(A.grid_spans(points(t), ALERTS, step))


@query(
    "alert_episodes",
    f"with {_alert_rows()}, {_EPISODES} select alert_id, severity, triggered_at, resolved_at, evaluations, current_value, state from ep",
    fx="metrics",
)
def alert_episodes(t: Inputs):
    return _episodes(t).select("alert_id", "severity", "triggered_at", "resolved_at", "evaluations", "current_value", "state")


@query(
    "firing_alerts",
    f"with {_alert_rows()}, {episodes_sql(STEP, f'slot <= epoch({NOW})')} select alert_id, severity, triggered_at, current_value from ep where state = 'firing'",
    fx="metrics",
)
def firing_alerts(t: Inputs):
    """What fires now."""
    return A.firing(A.grid_spans(points(t), ALERTS, STEP), AS_OF).select("alert_id", "severity", "triggered_at", "current_value")


@query(
    "alert_notifications",
    f"""with {_alert_rows()}, {_EPISODES}, x as (select ep.*, unnest(actions) as action from ep join al on ep.alert_id = al.alert_id)
    select alert_id, triggered_at, action as handler, triggered_at as sent_at from x
    union all select alert_id, triggered_at, action || '_resolution', resolved_at from x where resolved_at is not null""",
    fx="metrics",
)
def alert_notifications(t: Inputs):
    return A.notifications(_episodes(t), ALERTS)


@query(
    "monitoring_status",
    f"""with {_alert_rows()}, {_EPISODES} select (select count(distinct series_key) from fx_metrics) as total_series, (select count(*) from fx_metrics) as total_points,
    {len(ALERTS)}::bigint as alerts_total, {sum(a.enabled for a in ALERTS)}::bigint as alerts_enabled, (select count(*) from ep where state = 'firing') as alerts_firing""",
    fx="metrics",
)
def monitoring_status(t: Inputs):
    return M.monitoring_status(points(t), A.alert_table(t.spark, ALERTS), _episodes(t))


@query(
    "consecutive_failures",
    """with r as (select *, row_number() over (partition by service order by ts, event_id) - row_number() over (partition by service, value order by ts, event_id) as g from fx_health)
    select service, count(*) as failures, min(ts) as first_failure, max(ts) as last_failure from r where value = 0 group by service, g having count(*) >= 3""",
    fx="health",
)
def consecutive_failures(t: Inputs):
    return A.failure_runs(t.fx("health"), ["service"], "event_id", 3)


# ---- dashboards, panels, points --------------------------------------------------------------

WIDGETS = [
    Widget("Views", "line_chart", "app.view:user=3", "views"),
    Widget("Clicks", "area_chart", "app.click:user=5"),
    Widget("Errors", "gauge", "app.error:user=7", "errors", low=0, high=500),
    Widget("Signups", "stat", "app.signup:user=1", "signups", stat="max"),
    Widget("Views p95", "stat", "app.view:user=3", "views p95", stat="p95"),
    Widget("Nothing", "stat", "app.none", "none"),
]


@query(
    "dashboard_data",
    f"""with r as (select * from fx_metrics where ts between {NOW} - interval 7 day and {NOW}), l as (select * from fx_metrics where ts > {NOW} - interval 1440 minute and ts <= {NOW})
    select 'Views' as title, 'line_chart' as kind, 'views' as label, ts, value, null::double as low, null::double as high from r where series_key = 'app.view:user=3'
    union all select 'Clicks', 'area_chart', 'app.click:user=5', ts, value, null, null from r where series_key = 'app.click:user=5'
    union all select 'Errors', 'gauge', 'errors', null, round(coalesce(avg(value), 0), 4), 0.0, 500.0 from l where series_key = 'app.error:user=7'
    union all select 'Signups', 'stat', 'signups', null, round(coalesce(max(value), 0), 4), null, null from l where series_key = 'app.signup:user=1'
    union all select 'Views p95', 'stat', 'views p95', null, round(coalesce(quantile_cont(value, 0.95), 0), 4), null, null from l where series_key = 'app.view:user=3'
    union all select 'Nothing', 'stat', 'none', null, 0.0, null, null""",
    fx="metrics",
)
def dashboard(t: Inputs):
    return rounded(dashboard_data(points(t), WIDGETS, "7d", AS_OF, DAY_MINUTES * 60), "value")


@query(
    "health_points",
    """select event_id, service, 'health.status' as name, value::double as value, '' as unit, 'health.status:healthy=' || case when value = 1 then 'True' else 'False' end || ',service=' || service as series_key from fx_health
    union all select event_id, service, 'health.response_time', (event_id % 250)::double, 'milliseconds', 'health.response_time:service=' || service from fx_health where event_id % 4 <> 0""",
    fx="health",
)
def health_points(t: Inputs):
    checks = t.fx("health").select(
        "event_id",
        "service",
        (F.col("value") == 1).alias("healthy"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 250).alias("response_time"),
    )
    out = M.health_points(checks)
    return out.select("event_id", "service", "name", "value", "unit", S.series_key(F.col("name"), F.col("tags")).alias("series_key"))


@query(
    "timer_durations",
    """with m as (select event_id // 2 as timer_id, event_id % 2 = 0 as is_start, event_type = 'error' as lost, ts from events),
    d as (select timer_id, min(ts) filter (is_start and not lost) as s, max(ts) filter (not is_start and not lost) as e from m group by 1)
    select timer_id, 'load.duration' as name, e as ts, round((epoch_us(e) - epoch_us(s)) / 1000.0, 3) as value, 'milliseconds' as unit from d where s is not null and e is not null""",
)
def timer_durations(t: Inputs):
    """Marks that got lost (errors) leave their timers without a start or a stop."""
    mark = F.when(F.col("event_type") == "error", "lost").when(F.col("event_id") % 2 == 0, "start").otherwise("stop")
    marks = t.table("events").select(
        F.floor(F.col("event_id") / 2).alias("timer_id"),
        F.lit("load").alias("name"),
        mark.alias("mark"),
        "ts",
    )
    return rounded(M.timer_durations(marks), "value", places=3)


def _labelled(t: Inputs) -> DataFrame:
    """Events as labelled samples of jobs, some of them ours by name."""
    job = F.concat(F.when(F.col("user_id") % 2 == 0, "core-").otherwise("other-"), "event_type")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return t.table("events").select(
        "event_id",
        "ts",
        F.create_map(
            F.lit("job"), job, F.lit("level"), level, F.lit("instance"), F.concat(F.lit("i"), (F.col("user_id") % 7).cast("string"))
        ).alias("labels"),
        F.when(F.col("event_id") % 9 == 0, 0).otherwise(1).alias("up"),
        F.concat(F.when(F.col("event_id") % 3 == 0, "container_").otherwise("node_"), "event_type").alias("metric"),
        "value",
    )


_LABELLED = """l as (select event_id, ts, case when user_id % 2 = 0 then 'core-' else 'other-' end || event_type as job, case when event_type = 'error' then 'error' else 'info' end as level,
  'i' || cast(user_id % 7 as varchar) as instance, case when event_id % 9 = 0 then 0 else 1 end as up,
  case when event_id % 3 = 0 then 'container_' else 'node_' end || event_type as metric, value from events)"""


@query("label_match", f"with {_LABELLED} select event_id, job, instance, value from l where regexp_full_match(job, 'core-.*') and instance = 'i3'")
def label_match(t: Inputs):
    lab = F.col("labels")
    hit = S.label_matches(lab, job="core-.*") & S.label_equals(lab, instance="i3")
    return _labelled(t).where(hit).select("event_id", lab["job"].alias("job"), lab["instance"].alias("instance"), "value")


@query("label_values", f"with {_LABELLED} select distinct instance from l where regexp_full_match(job, 'core-.*')")
def label_values(t: Inputs):
    lab = F.col("labels")
    return _labelled(t).where(S.label_matches(lab, job="core-.*")).select(lab["instance"].alias("instance")).distinct().orderBy("instance")


@query(
    "uptime_panel",
    f"""with {_LABELLED}, x as (select job, instance, arg_max(up, (ts, event_id)) as up from l where regexp_full_match(job, 'core-.*') group by 1, 2)
    select job, instance, up, case up when 0 then 'DOWN' else 'UP' end as text from x""",
)
def uptime_panel(t: Inputs):
    lab = F.col("labels")
    up = _labelled(t).where(S.label_matches(lab, job="core-.*"))
    latest = up.groupBy(lab["job"].alias("job"), lab["instance"].alias("instance")).agg(F.max_by("up", F.struct("ts", "event_id")).alias("up"))
    return latest.withColumn("text", S.mapped_value(F.col("up"), {0: "DOWN", 1: "UP"}))


@query(
    "error_log_panel",
    f"with {_LABELLED} select event_id, ts, job, value from l where job = 'core-error' and level = 'error' order by ts desc, event_id desc",
)
def error_log_panel(t: Inputs):
    lab = F.col("labels")
    rows = _labelled(t).where(S.label_equals(lab, job="core-error", level="error"))
    return rows.select("event_id", "ts", lab["job"].alias("job"), "value").orderBy(F.desc("ts"), F.desc("event_id"))


@query(
    "metric_relabel",
    f"""with {_LABELLED} select event_id, metric, case when starts_with(metric, 'container_') then substr(metric, 11) else '' end as captured,
    'analytics' as platform from l""",
)
def metric_relabel(t: Inputs):
    out = M.relabel(_labelled(t), "labels", "metric", "container_(.*)", "container_metric", {"platform": "analytics"})
    lab = F.col("labels")
    return out.select(
        "event_id", "metric", F.coalesce(lab["container_metric"], F.lit("")).alias("captured"), lab["platform"].alias("platform")
    )


@query(
    "value_status_map",
    """select event_id, case event_id % 3 when 0 then 'UNHEALTHY' when 1 then 'HEALTHY' else 'WARNING' end as status,
    case when value >= 80 then 'red' when value >= 60 then 'yellow' else 'green' end as colour from events""",
)
def value_status_map(t: Inputs):
    return t.table("events").select(
        "event_id",
        S.mapped_value(F.col("event_id") % 3, {0: "UNHEALTHY", 1: "HEALTHY", 2: "WARNING"}).alias("status"),
        S.threshold_colour(F.col("value"), [(None, "green"), (60, "yellow"), (80, "red")]).alias("colour"),
    )
