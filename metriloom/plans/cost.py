"""Cost, efficiency, savings and budget queries over the workload and scaling tables."""

from pyspark.sql import functions as F

from metriloom.operators import cost
from metriloom.plans.align import r
from metriloom.plans.registry import SQL, query
from metriloom.session import new_path
from metriloom.sources import tables

COST = """cost AS (SELECT *, replicas * (cpu_requested * 0.0445 + memory_requested * 0.0049) AS hourly,
  (cpu_used / cpu_requested + memory_used / memory_requested) / 2 AS score FROM workloads)"""
EFF = """eff AS (SELECT workload, namespace, 0.6 * least(1, cpu_used / cpu_requested) + 0.4 * least(1, memory_used / memory_requested) AS e,
  (greatest(0, cpu_requested - cpu_used) * 0.0445 + greatest(0, memory_requested - memory_used) * 0.0049) * 720 AS waste FROM workloads)"""


def costs(t):
    return cost.workload_cost(
        t.workloads, cpu_usage=F.col("cpu_used") / F.col("cpu_requested"), memory_usage=F.col("memory_used") / F.col("memory_requested")
    )


@query("c01_resource_cost", "workloads", """
WITH u AS (SELECT workload, namespace, 'cpu' AS resource, cpu_requested * replicas AS quantity, 0.0445 AS p FROM workloads
  UNION ALL SELECT workload, namespace, 'memory', memory_requested * replicas, 0.0049 FROM workloads
  UNION ALL SELECT workload, namespace, 'storage', cpu_used * replicas, 0.0001 FROM workloads WHERE cpu_used > 0)
SELECT workload, namespace, resource, round(quantity, 6) AS quantity, CAST(p AS DOUBLE) AS unit_price, round(quantity * p, 7) AS hourly_cost,
  round(quantity * p * 24, 6) AS daily_cost, round(quantity * p * 720, 5) AS monthly_cost FROM u""")
def c01(t):
    out = cost.resource_cost(cost.workload_resources(t.workloads, storage="cpu_used"))
    return out.select(
        "workload", "namespace", "resource", r("quantity"), "unit_price", r("hourly_cost", 7), r("daily_cost"), r("monthly_cost", 5)
    )


@query("c02_workload_cost", "workloads", f"""WITH {COST}
SELECT workload, namespace, replicas, round(hourly, 7) AS total_hourly, round(hourly * 24, 6) AS total_daily, round(hourly * 720, 5) AS total_monthly, round(score, 6) AS efficiency_score FROM cost""")
def c02(t):
    return costs(t).select(
        "workload", "namespace", "replicas", r("total_hourly", 7), r("total_daily"), r("total_monthly", 5), r("efficiency_score")
    )


@query("c03_namespace_cost", "workloads", f"""WITH {COST}
SELECT namespace, round(sum(hourly), 6) AS total_hourly, round(sum(hourly) * 24, 5) AS total_daily, round(sum(hourly) * 720, 4) AS total_monthly, count(*) AS workload_count FROM cost GROUP BY 1""")
def c03(t):
    out = cost.namespace_cost(costs(t))
    return out.select("namespace", r("total_hourly"), r("total_daily", 5), r("total_monthly", 4), "workload_count")


@query("c04_cost_summary", "workloads", f"""WITH {COST}
SELECT namespace, workload, CASE WHEN grouping(namespace) = 1 THEN 'all' WHEN grouping(workload) = 1 THEN 'namespace' ELSE 'workload' END AS level,
  round(sum(hourly), 6) AS total_hourly, round(sum(hourly) * 24, 5) AS total_daily, round(sum(hourly) * 720, 4) AS total_monthly, count(*) AS workload_count
FROM cost GROUP BY ROLLUP (namespace, workload)""")
def c04(t):
    out = cost.cost_summary(costs(t))
    return out.select("namespace", "workload", "level", r("total_hourly"), r("total_daily", 5), r("total_monthly", 4), "workload_count")


@query("c04_cost_overview", "workloads", f"""WITH {COST}, n AS (SELECT namespace, sum(hourly) AS h FROM cost GROUP BY 1)
SELECT round(sum(h), 2) AS total_hourly, round(sum(h) * 24, 2) AS total_daily, round(sum(h) * 720, 2) AS total_monthly, 'USD' AS currency,
  count(*) AS namespace_count, arg_max(namespace, h) AS top_namespace FROM n""")
def c04_overview(t):
    return cost.cost_overview(costs(t))


@query("c05_discounted_cost", "workloads", f"""WITH {COST}
SELECT workload, namespace, plan, round(hourly * 720 * (1 - d), 5) AS discounted, round(hourly * 720 * d, 5) AS saved
FROM cost, (VALUES ('on_demand', 0), ('spot', 0.60), ('committed_1yr', 0.37), ('committed_3yr', 0.55)) p(plan, d)""")
def c05(t):
    return cost.discounted_cost(costs(t)).select("workload", "namespace", "plan", r("discounted", 5), r("saved", 5))


@query("e01_resource_efficiency", "workloads", """
WITH u AS (SELECT workload, namespace, 'cpu' AS resource, cpu_requested AS req, cpu_used AS used, 0.0445 AS p FROM workloads
  UNION ALL SELECT workload, namespace, 'memory', memory_requested, memory_used, 0.0049 FROM workloads),
e AS (SELECT *, least(1, used / req) AS e FROM u)
SELECT workload, namespace, resource, round(req, 6) AS requested, round(used, 6) AS used, round(e, 6) AS efficiency, round(greatest(0, req - used) * p, 8) AS waste_cost_hourly,
  CASE WHEN e < 0.3 THEN 'Consider reducing ' || resource || ' request by ' || CAST(trunc((1 - e) * 100) AS INT) || '%'
       WHEN e > 0.85 THEN 'Consider increasing ' || resource || ' request to handle peak load' END AS recommendation FROM e""")
def e01(t):
    out = cost.resource_efficiency(t.workloads)
    return out.select(
        "workload", "namespace", "resource", r("requested"), r("used"), r("efficiency"), r("waste_cost_hourly", 8), "recommendation"
    )


@query("e02_workload_efficiency", "workloads", f"""WITH {EFF}
SELECT workload, namespace, round(e, 6) AS overall_efficiency, round(waste, 5) AS waste_cost_monthly, e < 0.3 AS is_oversized, e > 0.85 AS is_undersized FROM eff""")
def e02(t):
    out = cost.workload_efficiency(t.workloads)
    return out.select("workload", "namespace", r("overall_efficiency"), r("waste_cost_monthly", 5), "is_oversized", "is_undersized")


@query("e03_efficiency_summary", "workloads", f"WITH {EFF} SELECT round(avg(e), 6) AS overall_efficiency, round(sum(waste), 4) AS total_waste_monthly, count(*) AS workload_count FROM eff")
def e03(t):
    out = cost.efficiency_summary(cost.workload_efficiency(t.workloads))
    return out.select(r("overall_efficiency"), r("total_waste_monthly", 4), "workload_count")


@query("e03_top_opportunities", "workloads", f"""WITH {EFF}
SELECT workload, namespace, round(waste / (1 - e), 5) AS current_cost_monthly, round(waste / (1 - e) * e, 5) AS optimized_cost_monthly, round(waste, 5) AS potential_savings_monthly,
  'Right-size resources to match ' || format('{{:.0f}}', round(e * 100)) || '% actual usage' AS recommendation, 0.8::DOUBLE AS confidence,
  CASE WHEN waste < 10 THEN 'low' ELSE 'medium' END AS implementation_effort FROM eff WHERE e < 0.3 ORDER BY waste DESC, workload LIMIT 5""")
def e03_top(t):
    out = cost.top_opportunities(cost.workload_efficiency(t.workloads))
    return out.withColumns(
        {c: F.round(c, 5) for c in ("current_cost_monthly", "optimized_cost_monthly", "potential_savings_monthly")}
    )


@query("e04_efficiency_counts", "workloads", f"""WITH {EFF}
SELECT round(avg(e) * 100, 1) AS overall_efficiency, round(sum(waste), 2) AS total_waste_monthly, count(*) AS workload_count, count(*) FILTER (e < 0.3) AS oversized_count,
  count(*) FILTER (e > 0.85) AS undersized_count, count(*) FILTER (e BETWEEN 0.3 AND 0.85) AS optimal_count, arg_max(workload, waste) FILTER (e < 0.3) AS top_opportunity FROM eff""")
def e04(t):
    return cost.efficiency_counts(cost.workload_efficiency(t.workloads))


SAVED = """sav AS (SELECT *, greatest(0, coalesce((before_replicas - after_replicas) * 0.02715::DOUBLE, 0)) AS s FROM scaling_events)"""


def saved(t):
    return cost.scaling_event_savings(t.scaling_events, cpu_per_replica=0.5, memory_per_replica=1.0)


@query("v01_scaling_event_savings", "scaling_events", f"""WITH {SAVED}
SELECT workload, namespace, timestamp, seq, before_replicas, after_replicas, round(coalesce(before_replicas, 0) * 0.02715::DOUBLE, 6) AS before_cost, round(after_replicas * 0.02715::DOUBLE, 6) AS after_cost,
  round(s, 6) AS savings_hourly, round(s * 720, 5) AS savings_monthly,
  CASE WHEN before_replicas > after_replicas THEN 'Scaled down from ' || before_replicas || ' to ' || after_replicas || ' replicas'
       WHEN before_replicas < after_replicas THEN 'Scaled up from ' || before_replicas || ' to ' || after_replicas || ' replicas' ELSE 'No scaling change' END AS action_taken FROM sav""")
def v01(t):
    return saved(t).select(
        "workload", "namespace", "timestamp", "seq", "before_replicas", "after_replicas", r("before_cost"), r("after_cost"), r("savings_hourly"),
        r("savings_monthly", 5), "action_taken",
    )


@query("v02_savings_summary", "scaling_events", f"""WITH {SAVED}, p AS (SELECT *, 'autoscaling' AS kind FROM sav WHERE timestamp >= (SELECT max(timestamp) FROM sav) - INTERVAL 90 DAY)
SELECT CASE WHEN grouping(kind) = 0 THEN 'type' WHEN grouping(namespace) = 0 THEN 'namespace' ELSE 'all' END AS level, coalesce(kind, namespace) AS key,
  round(coalesce(sum(s * 720), 0), 4) AS total_savings, count(*) AS events, round(coalesce(sum(s * 720), 0) / 2, 4) AS roi_percent FROM p GROUP BY GROUPING SETS ((kind), (namespace), ())""")
def v02(t):
    return cost.savings_summary(saved(t), "90d").select("level", "key", r("total_savings", 4), "events", r("roi_percent", 4))


@query("v02_stored_summary", "", SQL["v02_savings_summary"])
def v02_stored(t):
    path = new_path(t.spark, "savings")
    tables.write_by_date(saved(t), path, order=["namespace"], unit="month")
    rows, as_of = tables.read_recent(t.spark, path, 90 * 86_400, unit="month")
    return cost.savings_summary(rows, "90d", as_of=as_of).select("level", "key", r("total_savings", 4), "events", r("roi_percent", 4))


@query("v02_last_events", "scaling_events", f"""WITH {SAVED} SELECT workload, namespace, timestamp, seq, round(s * 720, 5) AS savings_monthly
FROM sav WHERE timestamp >= (SELECT max(timestamp) FROM sav) - INTERVAL 30 DAY ORDER BY timestamp DESC, seq DESC LIMIT 20""")
def v02_last(t):
    return cost.last_events(saved(t)).select("workload", "namespace", "timestamp", "seq", r("savings_monthly", 5))


@query("v03_potential_savings", "workloads", f"""WITH {EFF} SELECT round(coalesce(sum(waste), 0), 2) AS total_potential_monthly, count(*) AS opportunities_count FROM eff WHERE e < 0.3""")
def v03(t):
    return cost.potential_savings(cost.opportunities(cost.workload_efficiency(t.workloads)))


def forecast_sql(n, hours, per_day, cap="i + 1"):
    return f"""cur AS (SELECT namespace, sum(hourly) * 24 AS daily FROM cost GROUP BY 1),
pts AS (SELECT namespace, CAST(i AS INT) AS i, TIMESTAMP '2024-01-30' + to_hours(CAST((i + 1) * {hours} AS BIGINT)) AS timestamp, daily / {per_day} * (1 + 0.02 / 30 * ({cap})) AS base FROM cur, (SELECT unnest(range({n})) AS i)),
fc AS (SELECT *, base * (1 + CASE WHEN isodow(timestamp) >= 6 THEN -0.1 WHEN isodow(timestamp) BETWEEN 2 AND 4 THEN 0.05 ELSE 0 END) AS v, i / {n} AS part FROM pts)"""


def forecast_points(t, period):
    current = cost.namespace_cost(costs(t)).select("namespace", F.col("total_daily").alias("daily_cost"))
    return cost.cost_forecast(current, period, as_of=F.lit("2024-01-30").cast("timestamp_ntz"))


POINTS = """SELECT namespace, i, timestamp, round(v, 5) AS predicted_cost, round(v - v * 0.1 * (1 + part * 0.3), 5) AS lower_bound,
  round(v + v * 0.1 * (1 + part * 0.3), 5) AS upper_bound, round(greatest(0.5, 0.95 - part * 0.3), 6) AS confidence FROM fc"""


@query("k01_cost_forecast", "workloads", f"WITH {COST}, {forecast_sql(30, 24, 1)} {POINTS}")
def k01(t):
    return forecast_points(t, "30d").select(
        "namespace", "i", "timestamp", r("predicted_cost", 5), r("lower_bound", 5), r("upper_bound", 5), r("confidence")
    )


@query("k01_cost_forecast_hourly", "workloads", f"WITH {COST}, {forecast_sql(24, 1, 24, '(i + 1) / 24')} {POINTS}")
def k01_hourly(t):
    return forecast_points(t, "24h").select(
        "namespace", "i", "timestamp", r("predicted_cost", 5), r("lower_bound", 5), r("upper_bound", 5), r("confidence")
    )


@query("k02_cost_trend", "workloads", f"""WITH {COST}, {forecast_sql(12, 168, 1, '(i + 1) * 7')},
g AS (SELECT namespace, sum(v) * 7 AS total, (max(v) FILTER (i = 11) - max(v) FILTER (i = 0)) / max(v) FILTER (i = 0) * 100 AS change FROM fc GROUP BY 1)
SELECT namespace, round(total, 4) AS projected_total, round(change, 6) AS trend_percent, CASE WHEN change > 5 THEN 'increasing' WHEN change < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM g""")
def k02(t):
    out = cost.cost_trend(forecast_points(t, "90d"), keys=["namespace"], period="90d")
    return out.select("namespace", r("projected_total", 4), r("trend_percent"), "trend")


@query("k03_budget_status", "scaling_events", """
WITH m AS (SELECT namespace, date_trunc('month', timestamp) AS month, round(sum(after_replicas * 0.02715::DOUBLE * 24), 4) AS current_spend, max(day(timestamp)) - 1 AS days_elapsed, 400.0::DOUBLE AS b FROM scaling_events GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN days_elapsed > 0 THEN current_spend / days_elapsed ELSE 0 END AS burn, CASE WHEN days_elapsed > 0 THEN b - current_spend ELSE b END AS rest FROM m)
SELECT namespace, month, current_spend, CAST(days_elapsed AS INT) AS days_elapsed, round(burn, 6) AS burn_rate, round(burn * 30, 5) AS projected_monthly, round(rest, 4) AS budget_remaining,
  CASE WHEN days_elapsed > 0 THEN burn * 30 <= b ELSE true END AS on_track,
  CASE WHEN days_elapsed > 0 THEN round(CASE WHEN burn > 0 THEN rest / burn ELSE 'inf'::DOUBLE END, 5) END AS days_to_exhaustion,
  CASE WHEN days_elapsed > 0 THEN round(greatest(0, burn * 30 - b), 5) END AS overage_projected FROM x""")
def k03(t):
    month = F.date_trunc("month", "timestamp").cast("timestamp_ntz").alias("month")
    spend = t.scaling_events.groupBy("namespace", month).agg(
        F.round(F.sum(F.col("after_replicas") * 0.02715 * 24), 4).alias("current_spend"), (F.max(F.dayofmonth("timestamp")) - 1).alias("days_elapsed")
    )
    out = cost.budget_status(spend, budget=F.lit(400.0))
    return out.select(
        "namespace", "month", "current_spend", "days_elapsed", r("burn_rate"), r("projected_monthly", 5), r("budget_remaining", 4), "on_track",
        r("days_to_exhaustion", 5), r("overage_projected", 5),
    )


@query("s15_gauge_snapshot", "workloads scaling_events", f"""WITH {COST}, {EFF}, {SAVED}, {forecast_sql(30, 24, 1)},
u AS (SELECT workload, namespace, 'cpu' AS resource, cpu_requested * replicas * 0.0445 AS h FROM workloads UNION ALL SELECT workload, namespace, 'memory', memory_requested * replicas * 0.0049 FROM workloads)
SELECT 'cost_current' AS gauge, namespace || ',' || resource AS labels, round(arg_max(h, workload), 6) AS value FROM u GROUP BY namespace, resource
UNION ALL SELECT 'savings_total', 'autoscaling', round(sum(s * 720), 4) FROM sav WHERE timestamp >= (SELECT max(timestamp) FROM sav) - INTERVAL 30 DAY
UNION ALL SELECT 'efficiency', namespace, round(arg_max(e, workload), 6) FROM eff GROUP BY namespace
UNION ALL SELECT 'cost_forecast', '30d', round(sum(v), 4) FROM fc""")
def s15(t):
    projected = cost.cost_trend(forecast_points(t, "30d"), keys=[])
    out = cost.gauge_snapshot(
        cost.resource_cost(cost.workload_resources(t.workloads)), cost.savings_summary(saved(t)), cost.workload_efficiency(t.workloads), projected
    )
    digits = F.when(F.col("gauge").isin("savings_total", "cost_forecast"), F.round("value", 4)).otherwise(F.round("value", 6))
    return out.withColumn("value", digits)
