"""Recommendation queries over the workload table and the samples."""

from pyspark.sql import functions as F

from metriloom.functions import quantities
from metriloom.operators import anomaly, recommend
from metriloom.plans.align import r
from metriloom.plans.registry import query

# utilization of a workload = its cpu ratio; predictions = the same ratio of each of its return flags
UTIL = """pred AS (SELECT s_name AS workload, l_returnflag, sum(l_quantity * l_discount) * (1 + s_suppkey % 10) * 2 / sum(l_quantity) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, l_returnflag),
peak AS (SELECT workload, round(max(value), 8) AS predicted_utilization FROM pred GROUP BY 1),
util AS (SELECT w.*, predicted_utilization, greatest(round(cpu_used / cpu_requested, 8), predicted_utilization) AS u FROM workloads w JOIN peak USING (workload))"""


def utilization(t):
    line, supplier = t.table("lineitem"), t.table("supplier")
    per_flag = line.groupBy("l_suppkey", "l_returnflag").agg(
        (F.sum(F.col("l_quantity") * F.col("l_discount")) * 2 / F.sum("l_quantity")).alias("part")
    )
    named = per_flag.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("workload"), F.round(F.col("part") * (1 + F.col("s_suppkey") % 10), 8).alias("value")
    )
    now = t.workloads.withColumn("current_utilization", F.round(F.col("cpu_used") / F.col("cpu_requested"), 8))
    return recommend.effective_utilization(now, named, keys=["workload"])


@query("r01_effective_utilization", "workloads", f"WITH {UTIL} SELECT workload, round(predicted_utilization, 6) AS predicted_utilization, round(u, 6) AS utilization FROM util")
def r01(t):
    return utilization(t).select("workload", r("predicted_utilization"), r("utilization"))


ACTIONS = """act AS (SELECT workload, namespace, replicas, u, cpu_request, cpu_limit,
  CASE WHEN u > 0.85 THEN 'scale_out' WHEN u < 0.3 THEN 'scale_in' ELSE 'no_action' END AS action,
  CAST(CASE WHEN u > 0.85 THEN least(ceil(replicas * (u / 0.7::DOUBLE)), 100) WHEN u < 0.3 THEN greatest(ceil(replicas * (u / 0.7::DOUBLE)), 1) END AS INT) AS target FROM util),
full_act AS (SELECT workload, namespace, action, target AS target_replicas, NULL AS target_cpu_request,
  round(CASE action WHEN 'scale_out' THEN least(0.5 + (u - 0.85) * 2, 0.95) WHEN 'scale_in' THEN least(0.4 + (0.3 - u), 0.85) ELSE 0.9 END, 6) AS confidence,
  CASE action WHEN 'scale_out' THEN 'Current utilization (' || format('{:.1f}', round(u * 100, 1)) || '%) exceeds threshold (85.0%). Recommend scaling from ' || replicas || ' to ' || target || ' replicas.'
    WHEN 'scale_in' THEN 'Current utilization (' || format('{:.1f}', round(u * 100, 1)) || '%) is below threshold (30.0%). Recommend scaling from ' || replicas || ' to ' || target || ' replicas.'
    ELSE 'Utilization (' || format('{:.1f}', round(u * 100, 1)) || '%) is within target range' END AS reason,
  CASE WHEN action = 'scale_in' THEN round(CASE WHEN replicas > target THEN (replicas - target) / replicas * 100 ELSE 0 END, 6) END AS estimated_savings_percent FROM act),
resize AS (SELECT workload, namespace, 'scale_down' AS action, CAST(NULL AS INT) AS target_replicas, cpu_request AS target_cpu_request, 0.6::DOUBLE AS confidence,
  'CPU limit (' || cpu_limit || ') is significantly higher than request (' || cpu_request || '). Consider right-sizing based on actual usage.' AS reason, CAST(NULL AS DOUBLE) AS estimated_savings_percent
  FROM act WHERE CAST(replace(cpu_limit, 'm', '') AS INT) > 3 * CAST(replace(cpu_request, 'm', '') AS INT))"""
COLUMNS = ["workload", "namespace", "action", "target_replicas", "target_cpu_request", "confidence", "reason", "estimated_savings_percent"]


def actions(t):
    out = recommend.recommend(utilization(t))
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("estimated_savings_percent", F.round("estimated_savings_percent", 6)).select(*COLUMNS)


def action_query(key, action):
    cols = "workload, namespace, action, target_replicas, confidence, reason, estimated_savings_percent"

    @query(key, "workloads", f"WITH {UTIL}, {ACTIONS} SELECT {cols} FROM full_act WHERE action = '{action}'")
    def one(t):
        return actions(t).where(F.col("action") == action).drop("target_cpu_request")


action_query("r02_recommend_scale_out", "scale_out")
action_query("r03_recommend_scale_in", "scale_in")
action_query("r04_no_action", "no_action")


@query("r05_recommend_rightsizing", "workloads", f"WITH {UTIL}, {ACTIONS} SELECT workload, namespace, action, target_cpu_request, confidence, reason FROM resize")
def r05(t):
    return recommend.rightsizing(t.workloads).select("workload", "namespace", "action", "target_cpu_request", "confidence", "reason")


@query("r05_recommend_all", "workloads", f"WITH {UTIL}, {ACTIONS} SELECT * FROM full_act UNION ALL SELECT * FROM resize")
def r05_all(t):
    return actions(t)


@query("r06_cooldown", "samples", """
WITH RECURSIVE acc AS (
  SELECT name, deployment, min(timestamp) AS at FROM samples GROUP BY 1, 2
  UNION ALL
  SELECT a.name, a.deployment, min(s.timestamp) FROM acc a JOIN samples s ON s.name = a.name AND s.deployment = a.deployment AND s.timestamp >= a.at + INTERVAL 6 HOUR GROUP BY 1, 2),
w AS (SELECT s.name, s.deployment, s.timestamp, min(seq) AS seq FROM samples s JOIN acc a ON s.name = a.name AND s.deployment = a.deployment AND s.timestamp = a.at GROUP BY 1, 2, 3)
SELECT s.name, s.deployment, s.seq, s.timestamp, w.seq IS NOT NULL AS accepted, CASE WHEN w.seq IS NULL THEN 'no_action' ELSE 'scale_out' END AS action, CASE WHEN w.seq IS NULL THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence
FROM samples s LEFT JOIN w ON w.name = s.name AND w.deployment = s.deployment AND w.seq = s.seq""")
def r06(t):
    marked = recommend.cooldown(t.samples, keys=["name", "deployment"], cooldown_seconds=6 * 3600)
    asked = marked.withColumns({"action": F.lit("scale_out"), "confidence": F.lit(0.6), "reason": F.lit("load")})
    return recommend.with_cooldown(asked).select("name", "deployment", "seq", "timestamp", "accepted", "action", "confidence")


@query("r07_k8s_quantities", "workloads", """
SELECT workload, CAST(replace(cpu_request, 'm', '') AS INT) / 1000 AS cores, CAST(replace(memory_request, 'Mi', '') AS INT) / 1024 AS gigabytes,
  CAST(replace(cpu_limit, 'm', '') AS DOUBLE) AS millicores, CAST(replace(memory_request, 'Mi', '') AS DOUBLE) * 1048576 AS bytes, replicas * 1000.0::DOUBLE AS plain_millicores,
  0.0::DOUBLE AS bad_cost, CAST(NULL AS DOUBLE) AS bad_bytes FROM workloads""")
def r07(t):
    return t.workloads.select(
        "workload",
        quantities.cost_quantity("cpu_request").alias("cores"),
        quantities.cost_quantity("memory_request").alias("gigabytes"),
        quantities.millicores("cpu_limit").alias("millicores"),
        quantities.memory_bytes("memory_request").alias("bytes"),
        quantities.millicores(F.col("replicas").cast("string")).alias("plain_millicores"),
        quantities.cost_quantity("workload").alias("bad_cost"),
        quantities.memory_bytes("workload").alias("bad_bytes"),
    )


@query("r08_rule_actions", "wide_all", """
WITH m AS (SELECT deployment, avg(latency) AS mean, stddev_pop(latency) AS std FROM wide_all GROUP BY 1),
f AS (SELECT deployment, timestamp, round(cpu_usage / 100, 8) AS cpu, round(memory_usage / 60, 8) AS mem, round(lead(cpu_usage) OVER w / 90, 8) AS pc, 0.85 AS conf, rps, lag(rps) OVER w AS base,
  round(abs(latency - mean) / std, 6) AS z,
  max(round(cpu_usage / 100, 8)) OVER (PARTITION BY deployment ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hi
  FROM wide_all JOIN m USING (deployment) WINDOW w AS (PARTITION BY deployment ORDER BY timestamp))
SELECT deployment, timestamp, 'SCALE_UP' AS action FROM f WHERE pc > 0.8 AND conf > 0.8
UNION ALL SELECT deployment, timestamp, 'SCALE_DOWN' FROM f WHERE hi < 0.2
UNION ALL SELECT deployment, timestamp, 'INCREASE_MEMORY_LIMIT' FROM f WHERE mem > 0.85
UNION ALL SELECT deployment, timestamp, 'PREEMPTIVE_SCALE' FROM f WHERE rps > 2 * base
UNION ALL SELECT deployment, timestamp, 'ALERT_CRITICAL' FROM f WHERE z >= 4
UNION ALL SELECT deployment, timestamp, 'ALERT_WARNING' FROM f WHERE z >= 2.5 AND z < 4""")
def r08(t):
    from pyspark.sql import Window

    w = Window.partitionBy("deployment").orderBy("timestamp")
    stats = t.wide_all.groupBy("deployment").agg(F.avg("latency").alias("m"), F.stddev_pop("latency").alias("s"))
    rows = t.wide_all.join(stats, "deployment").select(
        "deployment",
        "timestamp",
        F.round(F.col("cpu_usage") / 100, 8).alias("cpu_utilization"),
        F.round(F.col("memory_usage") / 60, 8).alias("memory_utilization"),
        F.round(F.lead("cpu_usage").over(w) / 90, 8).alias("predicted_cpu"),
        F.lit(0.85).alias("confidence"),
        F.col("rps").alias("predicted_traffic"),
        F.lag("rps").over(w).alias("baseline_traffic"),
        anomaly.severity(F.round(F.abs(F.col("latency") - F.col("m")) / F.col("s"), 6)).alias("severity"),
    )
    return recommend.rule_actions(rows, keys=["deployment"], severity="severity")
