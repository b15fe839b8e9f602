"""Source queries. Payload texts are derived from the event rows, good and faulty ones mixed."""

from datetime import datetime

from pyspark.sql import functions as F

from metriloom.functions.names import series_id
from metriloom.operators import store
from metriloom.plans.registry import query
from metriloom.session import new_path
from metriloom.sources import host, payloads, tables

ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
ID = ["event_id"]


def texts(t, body, **extra):
    cols = [F.expr(e).alias(c) for c, e in extra.items()]
    return t.events.select("event_id", F.expr(body).alias("body"), F.expr("ts + INTERVAL 1 HOUR").alias("received_at"), *cols)


def flat(samples):
    """Samples with the label map as its series key, as the oracle can say it."""
    return samples.select(
        "event_id", "name", F.round("value", 6).alias("value"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        series_id(F.lit(""), "labels").alias("labels"),
    )


@query("s01_read_samples", "samples", """
SELECT name, value, timestamp, 'gauge' AS type, name || '{deployment=' || deployment || ',host=' || host || '}' AS series_id, 'events' AS source FROM samples
WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-20' AND name IN ('view', 'click', 'error')""")
def s01(t):
    rows = t.samples.select(
        "name", "value", "timestamp", F.lit("gauge").alias("type"),
        F.create_map(F.lit("host"), F.col("host"), F.lit("deployment"), F.col("deployment")).alias("labels"), F.lit("events").alias("source"),
    )
    path = new_path(t.spark, "samples")
    tables.write_samples(rows, path)
    back = tables.read_samples(t.spark, path, start=datetime(2024, 1, 5, 12), end=datetime(2024, 1, 20), names=["view", "click", "error"])
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).drop("labels")


ENVELOPE_BODY = f"""CASE WHEN event_id % 10 = 7 THEN '{{"metrics": 5}}' ELSE to_json(named_struct(
  'metrics', array(named_struct('name', if(event_id % 4 = 0, NULL, event_type),
      'value', CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' ELSE CAST(value AS STRING) END,
      'timestamp', CASE event_id % 3 WHEN 0 THEN {ISO} WHEN 1 THEN 'soon' END,
      'labels', if(event_id % 6 = 0, NULL, map('deployment', concat('dep', user_id % 5), 'host', concat('node-number-', user_id)))),
    named_struct('name', 'up', 'value', '1', 'timestamp', {ISO}, 'labels', map('host', 'x'))),
  'agent_version', '0.1.0')) END"""


@query("s02_ingest_payload", "", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS name, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value,
  CASE WHEN event_id % 3 = 0 THEN ts ELSE ts + INTERVAL 1 HOUR END AS timestamp,
  CASE WHEN event_id % 6 = 0 THEN '{}' ELSE '{deployment=dep' || user_id % 5 || ',host=node-number-' || user_id || '}' END AS labels
FROM events WHERE event_id % 10 <> 7 AND event_id % 5 <> 1
UNION ALL SELECT event_id, 'up', 1, ts, '{host=x}' FROM events WHERE event_id % 10 <> 7""")
def s02(t):
    samples, _ = payloads.ingest_payload(texts(t, ENVELOPE_BODY), keep=ID)
    return flat(samples)


@query("s02_ingest_rejects", "", """
SELECT event_id, 'metrics is not a list' AS reason FROM events WHERE event_id % 10 = 7
UNION ALL SELECT event_id, 'value is not a number' FROM events WHERE event_id % 5 = 1 AND event_id % 10 <> 7""")
def s02_rejects(t):
    _, rejects = payloads.ingest_payload(texts(t, ENVELOPE_BODY), keep=ID)
    return rejects.select("event_id", "reason")


PROM_LABELS = "if(event_id % 4 = 0, map('pod', concat('p', user_id)), map('__name__', event_type, 'pod', concat('p', user_id)))"
SECONDS = "CAST(CAST(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000 AS DECIMAL(20, 6)) AS STRING)"


@query("s03_promql_vector", "", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'sum_over' ELSE event_type END AS name, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS value,
  CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '1970-01-01' ELSE ts END AS timestamp, '{pod=p' || user_id || '}' AS labels
FROM events WHERE event_id % 7 = 0 OR event_id % 5 <> 0""")
def s03(t):
    body = f"""to_json(named_struct('status', 'success', 'data', named_struct('resultType', 'vector', 'result', array(named_struct(
      'metric', {PROM_LABELS}, 'value', if(event_id % 7 = 0, NULL, array({SECONDS}, if(event_id % 5 = 0, 'broken', CAST(value AS STRING)))))))))"""
    rows = texts(t, body, query="'  Sum Over(rate(x[5m])) '")
    return flat(payloads.normalize_promql_vector(rows, keep=ID))


@query("s04_promql_matrix", "", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'sum_over' ELSE event_type END AS name, value, ts AS timestamp, '{pod=p' || user_id || '}' AS labels
FROM events WHERE event_id % 7 <> 0""")
def s04(t):
    body = f"""to_json(named_struct('data', named_struct('resultType', 'matrix', 'result', array(named_struct(
      'metric', {PROM_LABELS}, 'values', if(event_id % 7 = 0, array(), array(array('1', '2'), array({SECONDS}, CAST(value AS STRING)))))))))"""
    return flat(payloads.normalize_promql_matrix(texts(t, body, query="'sum over{a=1}'"), keep=ID))


@query("s05_cloudwatch", "", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ec2_cpu_utilization' ELSE 'applicationelb_target_response_time' END AS name, value, ts AS timestamp,
  CASE event_id % 3 WHEN 0 THEN '{InstanceId=i-' || user_id || ',Team=ops,namespace=AWS/EC2}' ELSE '{Team=ops,namespace=AWS/ApplicationELB}' END AS labels
FROM events WHERE event_id % 3 <> 2 AND event_id % 8 <> 0""")
def s05(t):
    older = "date_format(ts - INTERVAL 5 MINUTES, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    body = f"""to_json(named_struct('Datapoints', if(event_id % 8 = 0, array(), array(
      named_struct('Timestamp', {ISO}, 'Average', value), named_struct('Timestamp', {older}, 'Average', 0D)))))"""
    spec = "CASE event_id % 3 WHEN 0 THEN concat('AWS/EC2/CPUUtilization:InstanceId=i-', user_id) WHEN 1 THEN 'AWS/ApplicationELB/TargetResponseTime' ELSE 'noslash' END"
    return flat(payloads.normalize_cloudwatch(texts(t, body, spec=spec), dimensions={"Team": "ops"}, keep=ID))


@query("s06_cloud_monitoring", "", """
SELECT event_id, 'instance_cpu_use_time' AS name, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN floor(value) WHEN 2 THEN 1 ELSE value * 2 END AS value, ts AS timestamp,
  '{deployment=main,kind=' || event_type || ',resource_type=gce_instance,resource_zone=z' || user_id % 3 || '}' AS labels FROM events WHERE event_id % 9 <> 0""")
def s06(t):
    body = f"""to_json(named_struct('timeSeries', array(named_struct('metric', named_struct('type', 'compute.example.com/instance/cpu/use-time', 'labels', map('kind', event_type)),
      'resource', named_struct('type', 'gce_instance', 'labels', map('zone', concat('z', user_id % 3))),
      'points', if(event_id % 9 = 0, array(), array(named_struct('interval', named_struct('endTime', {ISO}), 'value', named_struct(
        'doubleValue', if(event_id % 4 = 0, value, NULL), 'int64Value', if(event_id % 4 = 1, CAST(CAST(value AS BIGINT) AS STRING), NULL),
        'boolValue', if(event_id % 4 = 2, true, NULL), 'distributionValue', if(event_id % 4 = 3, named_struct('mean', value * 2), NULL)))))))))"""
    return flat(payloads.normalize_cloud_monitoring(texts(t, body), static_labels={"deployment": "main"}, keep=ID))


@query("s07_azure_monitor", "", """
SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'percentage_cpu' ELSE 'disk_used_pct' END AS name, CASE WHEN event_id % 5 = 0 THEN 7.5 ELSE value END AS value,
  CASE WHEN event_id % 5 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts END AS timestamp, '{vm=v' || user_id || '}' AS labels FROM events WHERE event_id % 6 <> 0""")
def s07(t):
    older = "date_format(ts - INTERVAL 1 MINUTES, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    body = f"""to_json(named_struct('value', array(named_struct('name', named_struct('value', if(event_id % 2 = 0, 'Percentage CPU', 'DiskUsed %')), 'timeseries', array(named_struct(
      'metadatavalues', array(named_struct('name', named_struct('value', 'vm'), 'value', concat('v', user_id))),
      'data', if(event_id % 6 = 0, array(), array(named_struct('timeStamp', {older}, 'average', 7.5D), named_struct('timeStamp', {ISO}, 'average', if(event_id % 5 = 0, NULL, value))))))))))"""
    return flat(payloads.normalize_azure_monitor(texts(t, body), keep=ID))


@query("s08_datadog", "", """
SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'cpu_user' ELSE 'shop_orders' END AS name, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value,
  make_timestamp(epoch_us(ts) // 1000 * 1000) AS timestamp, '{env=prod:eu,host=h' || user_id || '}' AS labels FROM events WHERE event_id % 6 <> 0""")
def s08(t):
    body = """to_json(named_struct('series', array(named_struct('metric', if(event_id % 2 = 0, 'system.cpu.user', NULL), 'scope', concat('host:h', user_id, ', env:prod:eu,loose'),
      'pointlist', if(event_id % 6 = 0, array(), array(array(1D, 2D), array(CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS DOUBLE), if(event_id % 5 = 0, NULL, value))))))))"""
    return flat(payloads.normalize_datadog(texts(t, body, query="'shop.orders'"), keep=ID))


@query("s09_host_metrics", "", """
WITH e AS (SELECT *, 'host' || user_id AS h FROM events)
SELECT event_id, 'cpu_utilization' AS name, round(value / 100, 6) AS value, ts AS timestamp, 'gauge' AS type, '{host=' || h || '}' AS labels FROM e
UNION ALL SELECT event_id, 'cpu_utilization', round(value / 200, 6), ts, 'gauge', '{cpu=0,host=' || h || '}' FROM e
UNION ALL SELECT event_id, 'cpu_utilization', round(value / 50, 6), ts, 'gauge', '{cpu=1,host=' || h || '}' FROM e
UNION ALL SELECT event_id, 'memory_utilization', round(value / 400, 6), ts, 'gauge', '{host=' || h || '}' FROM e
UNION ALL SELECT event_id, 'memory_bytes', floor(value * 1000), ts, 'gauge', '{host=' || h || ',type=used}' FROM e
UNION ALL SELECT event_id, 'memory_bytes', 400000, ts, 'gauge', '{host=' || h || ',type=total}' FROM e
UNION ALL SELECT event_id, 'disk_utilization', round(value / 500, 6), ts, 'gauge', '{device=/dev/sda,host=' || h || ',mountpoint=/}' FROM e
UNION ALL SELECT event_id, 'network_bytes_recv', event_id * 10, ts, 'counter', '{host=' || h || '}' FROM e
UNION ALL SELECT event_id, 'network_bytes_sent', event_id * 20, ts, 'counter', '{host=' || h || '}' FROM e""")
def s09(t):
    snapshots = t.events.selectExpr(
        "event_id", "ts AS timestamp", "concat('host', user_id) AS host", "value AS cpu_percent", "array(value / 2, value * 2) AS per_cpu",
        "value / 4 AS memory_percent", "floor(value * 1000) AS memory_used", "400000 AS memory_total",
        "array(named_struct('device', '/dev/sda', 'mountpoint', '/', 'percent', value / 5)) AS disks", "event_id * 10 AS bytes_recv", "event_id * 20 AS bytes_sent",
    )
    out = host.normalize_host_metrics(snapshots, keep=ID)
    return out.select("event_id", "name", F.round("value", 6).alias("value"), "timestamp", "type", series_id(F.lit(""), "labels").alias("labels"))


@query("s10_union_sources", "samples", """
SELECT seq, name, value, 'a' AS source, '{deployment=fixed,host=' || host || '}' AS labels FROM samples WHERE name IN ('view', 'purchase', 'signup')
UNION ALL SELECT seq, name, value, 'b', '{deployment=' || deployment || '}' FROM samples WHERE name IN ('click', 'error')""")
def s10(t):
    labels = F.create_map(F.lit("host"), F.col("host"), F.lit("deployment"), F.col("deployment"))
    first = F.col("name").isin("view", "purchase", "signup")
    a = t.samples.where(first).select("seq", "name", "value", F.lit("a").alias("source"), labels.alias("labels"))
    b = t.samples.where(~first).select("seq", "name", "value", F.lit("b").alias("source"), F.create_map(F.lit("deployment"), F.col("deployment")).alias("labels"))
    out = host.union_sources([host.merge_static_labels(a, {"deployment": "fixed"}), None, b])
    return out.withColumn("labels", series_id(F.lit(""), "labels"))


@query("s11_training_csv", "wide", """
SELECT timestamp, round(cpu_usage, 6) AS cpu_usage, round(memory_usage, 6) AS memory_usage, round(rps, 6) AS rps, round(latency, 6) AS latency FROM wide""")
def s11(t):
    cols = ["cpu_usage", "memory_usage", "rps", "latency"]
    path = new_path(t.spark, "training-csv")
    rounded = t.wide.select(F.col("timestamp").cast("timestamp").alias("timestamp"), *[F.round(c, 6).alias(c) for c in cols])
    tables.write_training_csv(rounded, path)
    back = tables.read_training_csv(t.spark, path, cols)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("s12_loadtest_stats", "", """
WITH e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS request, CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method FROM events)
SELECT event_id, 'loadtest_request_count' AS name, event_id * 1000.0 AS value, ts + INTERVAL 1 HOUR AS timestamp, '{method=' || method || ',request=' || request || '}' AS labels FROM e
UNION ALL SELECT event_id, 'loadtest_request_failures', CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END, ts + INTERVAL 1 HOUR, '{method=' || method || ',request=' || request || '}' FROM e
UNION ALL SELECT event_id, 'loadtest_request_rps', value, ts + INTERVAL 1 HOUR, '{method=' || method || ',request=' || request || '}' FROM e
UNION ALL SELECT event_id, 'loadtest_request_avg_ms', value * 2, ts + INTERVAL 1 HOUR, '{method=' || method || ',request=' || request || '}' FROM e""")
def s12(t):
    body = """to_json(named_struct('stats', array(named_struct('name', if(event_id % 4 = 0, NULL, event_type), 'method', if(event_id % 3 = 0, NULL, 'POST'),
      'num_requests', format_number(event_id * 1000, 0), 'num_failures', if(event_id % 5 = 0, 'none', CAST(event_id AS STRING)),
      'avg_response_time', if(event_id % 2 = 0, CAST(value * 2 AS STRING), NULL), 'avg', CAST(value * 2 AS STRING), 'current_rps', CAST(value AS STRING)))))"""
    return flat(payloads.normalize_loadtest_json(texts(t, body), keep=ID))


@query("s14_data_summary", "samples", """
SELECT count(*) AS n_records, 6 AS n_columns, 'seq,name,value,timestamp,deployment,host' AS columns, min(timestamp) AS start, max(timestamp) AS "end" FROM samples""")
def s14(t):
    return tables.data_summary(t.samples)


@query("q11_registry_from_ingest", "", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'dep' || user_id % 5 END AS deployment_id,
  CASE WHEN event_id % 6 = 0 THEN 'unknown' ELSE 'node-number-' || user_id END AS hostname,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'node-num-dep' || user_id % 5 END AS agent_id, 2 AS received,
  CASE WHEN event_id % 4 = 0 THEN ',up' ELSE least(event_type, 'up') || ',' || greatest(event_type, 'up') END AS metrics, '0.1.0' AS agent_version FROM events WHERE event_id % 10 <> 7""")
def q11(t):
    out = store.registry_from_ingest(payloads.envelopes(texts(t, ENVELOPE_BODY)))
    ordered = F.array_join(F.array_sort("metrics"), ",")
    return out.select(
        "event_id", "deployment_id", "hostname", "agent_id", "received", ordered.alias("metrics"), "agent_version"
    )


@query("q11_control", "agents", """
SELECT event_id, 'node-num-dep' || user_id % 5 AS agent_id, a.paused AS paused FROM events LEFT JOIN
  (SELECT 'node-num-dep' || agent_id % 5 AS id, bool_or(paused) AS paused FROM agents WHERE agent_id % 5 <> 3 GROUP BY 1) a ON id = 'node-num-dep' || user_id % 5
WHERE event_id % 10 <> 7 AND event_id % 6 <> 0""")
def q11_control(t):
    """The answer to an ingest carries the agent's paused flag; unknown agents have none."""
    named = F.concat(F.lit("node-num-dep"), F.col("agent_id") % 5).alias("agent_id")
    agents = t.agents.where("agent_id % 5 <> 3").groupBy(named).agg(F.bool_or("paused").alias("paused"), F.lit(15).alias("collection_interval"))
    out = store.registry_from_ingest(payloads.envelopes(texts(t, ENVELOPE_BODY)), agents)
    return out.where("agent_id IS NOT NULL").select("event_id", "agent_id", "paused")
