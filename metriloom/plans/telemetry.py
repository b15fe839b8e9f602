"""Telemetry queries: rates, ratios, histograms, alerts and triggers over the events."""

from pyspark.sql import functions as F

from metriloom.operators import align, telemetry
from metriloom.operators.scale import attach_row
from metriloom.plans.align import INC, SERIES, r
from metriloom.plans.registry import query
from metriloom.schemas import ALERT_RULES, SCALING_TRIGGERS

HOUR = 3600
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
SLIDE = """steps AS (SELECT name, deployment, date_trunc('hour', timestamp) AS timestamp, sum(increase) AS inc FROM inc GROUP BY 1, 2, 3),
slid AS (SELECT name, deployment, timestamp, sum(inc) OVER (PARTITION BY name, deployment ORDER BY timestamp
  RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS v FROM steps)"""


@query("m01_rate", "counters", f"WITH {INC}, {SLIDE} SELECT name, deployment, timestamp, round(v / 10800, 6) AS counter_value FROM slid")
def m01(t):
    out = telemetry.rate(t.counters, keys=SERIES, range_seconds=3 * HOUR, step_seconds=HOUR, value="counter_value")
    return out.select(*SERIES, "timestamp", r("counter_value"))


@query("m02_increase", "counters", f"WITH {INC}, {SLIDE} SELECT name, deployment, timestamp, round(v, 4) AS counter_value FROM slid")
def m02(t):
    out = telemetry.increase(t.counters, keys=SERIES, range_seconds=3 * HOUR, step_seconds=HOUR, value="counter_value")
    return out.select(*SERIES, "timestamp", r("counter_value", 4))


@query("m03_vector_aggregate", "samples", """
WITH a AS (SELECT name, deployment, date_trunc('hour', timestamp) AS timestamp, avg(value) AS value FROM samples GROUP BY 1, 2, 3)
SELECT name, timestamp, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(min(value), 6) AS min, count(value) AS count
FROM a GROUP BY 1, 2""")
def m03(t):
    aligned = align.align_mean(t.samples, keys=SERIES, period=HOUR)
    out = telemetry.vector_aggregate(aligned, by=["name"])
    return out.select("name", "timestamp", r("sum"), r("avg"), r("max"), r("min"), "count")


@query("m04_error_ratio", "samples", """
SELECT deployment, date_trunc('hour', timestamp) AS hour, round(count(*) FILTER (name = 'error') * 100.0 / count(*), 6) AS ratio FROM samples GROUP BY 1, 2""")
def m04(t):
    rows = t.samples.withColumn("hour", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    out = telemetry.ratio(rows, F.col("name") == "error", by=["deployment", "hour"], scale=100.0)
    return out.select("deployment", "hour", r("ratio"))


@query("m04_vector_ratio", "samples", """
WITH u AS (SELECT deployment, date_trunc('day', timestamp) AS timestamp, sum(value) AS value FROM samples WHERE name = 'view' GROUP BY 1, 2),
l AS (SELECT deployment, date_trunc('day', timestamp) AS timestamp, sum(value) AS value FROM samples WHERE name = 'click' GROUP BY 1, 2)
SELECT deployment, timestamp, round(u.value / l.value, 6) AS ratio FROM u JOIN l USING (deployment, timestamp)""")
def m04_vector(t):
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("timestamp")
    used, limit = (
        t.samples.where(F.col("name") == n).groupBy("deployment", day).agg(F.sum("value").alias("value")) for n in ("view", "click")
    )
    out = telemetry.vector_ratio(used, limit, on=["deployment", "timestamp"])
    return out.select("deployment", "timestamp", r("ratio"))


BUCKETS = """b AS (SELECT unnest([5, 10, 25, 50, 100, 250, 500, 'inf'::DOUBLE]) AS le),
h AS (SELECT name, le, count(*) FILTER (value <= le) AS bucket, round(sum(value), 4) AS sum, count(value) AS count FROM samples, b GROUP BY 1, 2)"""


@query("m05_histogram_quantile", "samples", f"""WITH {BUCKETS},
p AS (SELECT name, le, bucket, count * 0.95 AS rank, coalesce(lag(bucket) OVER w, 0) AS before, lag(le) OVER w AS lower FROM h WINDOW w AS (PARTITION BY name ORDER BY le)),
e AS (SELECT name, le, CASE WHEN isinf(le) THEN lower ELSE coalesce(lower, 0) + (le - coalesce(lower, 0)) * (rank - before) / (bucket - before) END AS v FROM p WHERE bucket >= rank)
SELECT name, round(arg_min(v, le), 6) AS quantile FROM e GROUP BY name""")
def m05(t):
    buckets = telemetry.bucketize(t.samples, BOUNDS, by=["name"])
    return telemetry.histogram_quantile(buckets, 0.95, by=["name"]).select("name", r("quantile"))


@query("m06_bucketize", "samples", f"WITH {BUCKETS} SELECT name, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS INT) AS VARCHAR) END AS le, bucket, sum, count FROM h")
def m06(t):
    out = telemetry.bucketize(t.samples, BOUNDS, by=["name"])
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string"))
    return out.select("name", le.alias("le"), "bucket", r("sum", 4), "count")


@query("m07_counters_by_labels", "samples", "SELECT name, deployment, count(*) AS total FROM samples GROUP BY 1, 2")
def m07(t):
    return telemetry.counters_by_labels(t.samples, SERIES)


@query("m08_label_matchers", "samples", """
SELECT seq, name, deployment, host FROM samples
WHERE name <> 'error' AND regexp_full_match(host, 'host1.*') AND NOT regexp_full_match(name, 'p.*e') AND deployment = 'dep1'""")
def m08(t):
    out = telemetry.match_labels(
        t.samples, [("name", "!=", "error"), ("host", "=~", "host1.*"), ("name", "!~", "p.*e"), ("deployment", "=", "dep1")]
    )
    return out.select("seq", "name", "deployment", "host")


@query("m09_or_vector", "samples", """
SELECT coalesce(max(value) FILTER (name = 'absent'), 2.0::DOUBLE) AS empty_side, coalesce(max(value) FILTER (name = 'view'), 2.0::DOUBLE) AS filled_side FROM samples""")
def m09(t):
    empty = telemetry.or_vector(t.samples.where("name = 'absent'"), 2.0).withColumnRenamed("value", "empty_side")
    filled = telemetry.or_vector(t.samples.where("name = 'view'"), 2.0).withColumnRenamed("value", "filled_side")
    return attach_row(empty, filled)


# facts of the service, made from the samples of an hour
SERVICE_FACTS = {
    "up": "CAST(count(*) FILTER (WHERE name = 'view') > 0 AS INT)",
    "ready": "CAST(count(*) FILTER (WHERE name = 'click') > 0 AS INT)",
    "models_loaded": "count(DISTINCT name) - 1",
    "prediction_latency_p95": "max(value) / 50",
    "error_ratio": "count(*) FILTER (WHERE name = 'error') / count(*)",
    "critical_anomalies_5m": "count(*) FILTER (WHERE value > 150)",
    "anomalies_15m": "2 * count(*) FILTER (WHERE value > 40)",
    "cache_hit_ratio": "count(*) FILTER (WHERE value < 60) / count(*)",
    "scale_out_5m": "count(*) FILTER (WHERE name = 'purchase' AND value > 100)",
    "memory_ratio": "avg(CASE WHEN name = 'click' THEN value END) / 60",
    "cpu_ratio": "avg(CASE WHEN name = 'view' THEN value END) / 60",
}
_rules = ", ".join(f"('{a}', '{e}', '{op}', {limit}, {minutes}, '{severity}')" for a, e, op, limit, minutes, severity in ALERT_RULES)
_facts = " UNION ALL ".join(f"SELECT deployment, timestamp, '{name}' AS expression, {name} AS value FROM f" for name in SERVICE_FACTS)


@query("m10_alert_eval", "samples", f"""
WITH f AS (SELECT deployment, date_trunc('hour', timestamp) AS timestamp, {", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {name}" for name, sql in SERVICE_FACTS.items())} FROM samples GROUP BY 1, 2),
v AS ({_facts}),
e AS (SELECT deployment, timestamp, value, r.*, coalesce(CASE op WHEN '==' THEN value = threshold WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold END, false) AS holds
  FROM v JOIN (VALUES {_rules}) r(alert, expression, op, threshold, minutes, severity) USING (expression)),
g AS (SELECT *, count(*) FILTER (NOT holds) OVER (PARTITION BY deployment, alert ORDER BY timestamp) AS grp FROM e),
s AS (SELECT *, CASE WHEN holds THEN min(timestamp) FILTER (holds) OVER (PARTITION BY deployment, alert, grp) END AS active_since FROM g)
SELECT deployment, timestamp, value, alert, severity, active_since,
  CASE WHEN NOT holds THEN 'inactive' WHEN date_diff('minute', active_since, timestamp) >= minutes THEN 'firing' ELSE 'pending' END AS state FROM s""")
def m10(t):
    """The 13 shipped rules over facts of each deployment and hour."""
    facts = t.samples.groupBy("deployment", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")).agg(
        *[F.expr(f"round(CAST({sql} AS DOUBLE), 6)").alias(name) for name, sql in SERVICE_FACTS.items()]
    )
    values = facts.unpivot(["deployment", "timestamp"], list(SERVICE_FACTS), "expression", "value")
    return telemetry.alert_eval(values, ALERT_RULES, keys=["deployment"])


# values of the seven triggers, made from the samples of an hour
TRIGGER_FACTS = {
    ("shop-api", "cpu_utilization"): "avg(value) / 60",
    ("shop-api", "requests_per_second"): "count(*) * 10",
    ("shop-api", "p95_latency"): "max(value) / 300",
    ("shop-api", "predicted_replicas"): "count(*) FILTER (WHERE name = 'signup')",
    ("inference", "predictions_per_minute"): "count(*) FILTER (WHERE name = 'purchase') * 30",
    ("inference", "request_latency"): "min(value) / 10",
    ("inference", "cpu_utilization"): "avg(CASE WHEN name = 'click' THEN value END) / 60",
}
_triggers = ", ".join(f"('{w}', '{n}', {limit}, {active}, {lo}, {hi})" for w, n, limit, active, lo, hi in SCALING_TRIGGERS)
_values = " UNION ALL ".join(f"SELECT timestamp, '{w}' AS workload, '{n}' AS trigger, c{i} AS value FROM f" for i, (w, n) in enumerate(TRIGGER_FACTS))


@query("m11_trigger_eval", "samples", f"""
WITH f AS (SELECT date_trunc('hour', timestamp) AS timestamp, {", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS c{i}" for i, sql in enumerate(TRIGGER_FACTS.values()))} FROM samples GROUP BY 1),
v AS ({_values}), j AS (SELECT * FROM v JOIN (VALUES {_triggers}) t(workload, trigger, threshold, activation, lo, hi) USING (workload, trigger))
SELECT workload, timestamp, count(*) FILTER (value > activation) AS active_triggers,
  CAST(least(greatest(coalesce(max(CASE WHEN value > activation THEN ceil(value / CAST(threshold AS DOUBLE)) END), max(lo)), max(lo)), max(hi)) AS INT) AS replicas
FROM j GROUP BY 1, 2""")
def m11(t):
    """The seven shipped triggers."""
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")
    facts = t.samples.groupBy(hour).agg(*[F.expr(f"round(CAST({sql} AS DOUBLE), 6)").alias(f"c{i}") for i, sql in enumerate(TRIGGER_FACTS.values())])
    asked = F.array(*[F.struct(F.lit(w).alias("workload"), F.lit(n).alias("trigger"), F.col(f"c{i}").alias("value")) for i, (w, n) in enumerate(TRIGGER_FACTS)])
    return telemetry.trigger_eval(facts.select("timestamp", F.inline(asked)))


@query("m12_service_totals", "samples scaling_events", """
WITH d AS (SELECT date_trunc('day', timestamp) AS day, count(*) FILTER (name = 'error' AND value > 100) AS anomalies FROM samples GROUP BY 1),
l AS (SELECT workload, count(*) AS n, max(timestamp) AS last FROM scaling_events GROUP BY 1)
SELECT (SELECT count(*) FROM samples WHERE name = 'view') AS forecasts_made, (SELECT count(*) FROM d) AS detections,
  CAST((SELECT sum(anomalies) FROM d) AS BIGINT) AS anomalies_found, round((SELECT avg(anomalies) FROM d), 6) AS anomalies_per_detection,
  CAST((SELECT sum(n) FROM l) AS BIGINT) AS recommendations,
  (SELECT count(*) FROM l WHERE last + INTERVAL 30 DAY > (SELECT max(last) FROM l)) AS workloads_in_cooldown""")
def m12(t):
    day = F.date_trunc("day", "timestamp")
    detections = t.samples.groupBy(day).agg(F.count_if((F.col("name") == "error") & (F.col("value") > 100)).alias("anomalies"))
    out = telemetry.service_totals(
        forecasts=t.samples.where("name = 'view'"),
        detections=detections,
        recommendations=t.scaling_events,
        as_of=t.scaling_events.agg(F.max("timestamp")).scalar(),
        cooldown_seconds=30 * 86400,
    )
    return out.withColumn("anomalies_per_detection", F.round("anomalies_per_detection", 6))
