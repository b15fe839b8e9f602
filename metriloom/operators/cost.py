"""Cost, efficiency, savings, cost forecast and budget.

Prices are a constant map, so they are literals in the plan; totals at every level come from one
grouping-sets aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriloom.functions.time import add_seconds, col
from metriloom.operators.forecast import trend_word
from metriloom.operators.scale import with_previous
from metriloom.operators.store import cutoff
from metriloom.schemas import HOURS_PER_DAY, HOURS_PER_MONTH, PLAN_DISCOUNTS, UNIT_PRICES

# fixed values: size classes and weights of the efficiency score
OVERSIZED, UNDERSIZED = 0.3, 0.85
CPU_WEIGHT, MEMORY_WEIGHT = 0.6, 0.4
INFRASTRUCTURE_COST = 200.0  # fixed value: monthly cost the savings are compared with
PERIOD_HOURS = {"1h": 1, "24h": 24, "7d": 7 * 24, "30d": 30 * 24, "90d": 90 * 24}


def unit_price(resource: str | Column, prices: Mapping[str, float] = UNIT_PRICES) -> Column:
    """Price per unit and hour; an unknown resource is free."""
    entries = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, col(resource)), F.lit(0.0))


def resource_cost(df: DataFrame, *, resource: str = "resource", quantity: str = "quantity", prices: Mapping[str, float] = UNIT_PRICES) -> DataFrame:
    hourly = F.col(quantity) * F.col("unit_price")
    return df.withColumn("unit_price", unit_price(resource, prices)).withColumns(
        {"hourly_cost": hourly, "daily_cost": hourly * HOURS_PER_DAY, "monthly_cost": hourly * HOURS_PER_MONTH}
    )


def workload_resources(df: DataFrame, *, storage: str | None = None) -> DataFrame:
    """Wide workloads to (workload, resource) rows with totals over replicas; storage only if above 0."""
    have = {"cpu": "cpu_requested", "memory": "memory_requested"}
    if storage:
        have["storage"] = storage
    structs = [F.struct(F.lit(n).alias("resource"), (F.col(c) * F.col("replicas")).alias("quantity")) for n, c in have.items()]
    if storage:
        structs[-1] = F.when(F.col(storage) > 0, structs[-1])
    rows = F.filter(F.array(*structs), lambda x: x.isNotNull())
    return df.select("workload", "namespace", "replicas", F.inline(rows))


def workload_cost(df: DataFrame, *, storage: str | None = None, cpu_usage: str | Column = "cpu_usage", memory_usage: str | Column = "memory_usage") -> DataFrame:
    """Cost per workload: per-pod resources times replicas. Stays a projection, no shuffle."""
    hourly = F.col("replicas") * (F.col("cpu_requested") * UNIT_PRICES["cpu"] + F.col("memory_requested") * UNIT_PRICES["memory"])
    if storage:
        hourly = hourly + F.col("replicas") * F.greatest(F.coalesce(F.col(storage), F.lit(0.0)), F.lit(0.0)) * UNIT_PRICES["storage"]
    return df.withColumns(
        {
            "total_hourly": hourly,
            "total_daily": hourly * HOURS_PER_DAY,
            "total_monthly": hourly * HOURS_PER_MONTH,
            "efficiency_score": (col(cpu_usage) + col(memory_usage)) / 2,
        }
    )


def namespace_cost(costs: DataFrame) -> DataFrame:
    hourly = F.sum("total_hourly")
    return costs.groupBy("namespace").agg(
        hourly.alias("total_hourly"),
        (hourly * HOURS_PER_DAY).alias("total_daily"),
        (hourly * HOURS_PER_MONTH).alias("total_monthly"),
        F.count("*").alias("workload_count"),
    )


def cost_summary(costs: DataFrame, *, namespace: str | None = None) -> DataFrame:
    """Cost of every workload, namespace and of all in one rollup; ``level`` says which."""
    rows = costs if namespace is None else costs.where(F.col("namespace") == namespace)
    level = F.element_at(F.array(F.lit("workload"), F.lit("namespace"), F.lit("namespace"), F.lit("all")), (F.grouping_id() + 1).cast("int"))
    hourly = F.sum("total_hourly")
    return rows.rollup("namespace", "workload").agg(
        level.alias("level"),
        hourly.alias("total_hourly"),
        (hourly * HOURS_PER_DAY).alias("total_daily"),
        (hourly * HOURS_PER_MONTH).alias("total_monthly"),
        F.count("*").alias("workload_count"),
    )


def cost_overview(costs: DataFrame) -> DataFrame:
    """One row: rounded totals, number of namespaces and the dearest namespace."""
    per = namespace_cost(costs)
    hourly = F.sum("total_hourly")
    return per.agg(
        F.round(hourly, 2).alias("total_hourly"),
        F.round(hourly * HOURS_PER_DAY, 2).alias("total_daily"),
        F.round(hourly * HOURS_PER_MONTH, 2).alias("total_monthly"),
        F.lit("USD").alias("currency"),
        F.count("*").alias("namespace_count"),
        F.max_by("namespace", "total_monthly").alias("top_namespace"),
    )


def discounted_cost(costs: DataFrame, *, cost: str = "total_monthly", plans: Mapping[str, float] = PLAN_DISCOUNTS) -> DataFrame:
    """The cost under each purchase plan; the plan list is a literal array per row."""
    options = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(d).alias("discount")) for p, d in plans.items()])
    out = costs.select("*", F.inline(options))
    return out.withColumn("discounted", F.col(cost) * (1 - F.col("discount"))).withColumn("saved", F.col(cost) * F.col("discount"))


def efficiency(requested: str | Column, used: str | Column) -> Column:
    """Used over requested, at most 1; 0 where nothing is requested."""
    req = col(requested)
    return F.when(req <= 0, 0.0).otherwise(F.least(F.lit(1.0), col(used) / F.when(req > 0, req)))


def waste_hourly(resource: str, requested: str | Column, used: str | Column) -> Column:
    return F.greatest(F.lit(0.0), col(requested) - col(used)) * UNIT_PRICES[resource]


def resource_efficiency(df: DataFrame) -> DataFrame:
    """(workload, resource) rows: efficiency, waste and advice at the extremes."""
    parts = [
        F.struct(F.lit(n).alias("resource"), F.col(f"{n}_requested").alias("requested"), F.col(f"{n}_used").alias("used"), waste_hourly(n, f"{n}_requested", f"{n}_used").alias("waste_cost_hourly"))
        for n in ("cpu", "memory")
    ]
    rows = df.select("workload", "namespace", F.inline(F.array(*parts))).withColumn("efficiency", efficiency("requested", "used"))
    e = F.col("efficiency")
    advice = F.when(
        e < OVERSIZED, F.format_string("Consider reducing %s request by %d%%", F.col("resource"), ((1 - e) * 100).cast("int"))
    ).when(e > UNDERSIZED, F.format_string("Consider increasing %s request to handle peak load", F.col("resource")))
    return rows.withColumn("recommendation", advice)


def workload_efficiency(df: DataFrame) -> DataFrame:
    """Weighted efficiency, monthly waste and size class per workload. A projection, no shuffle."""
    overall = CPU_WEIGHT * efficiency("cpu_requested", "cpu_used") + MEMORY_WEIGHT * efficiency("memory_requested", "memory_used")
    waste = waste_hourly("cpu", "cpu_requested", "cpu_used") + waste_hourly("memory", "memory_requested", "memory_used")
    return df.select(
        "workload", "namespace", overall.alias("overall_efficiency"), (waste * HOURS_PER_MONTH).alias("waste_cost_monthly")
    ).withColumns({"is_oversized": F.col("overall_efficiency") < OVERSIZED, "is_undersized": F.col("overall_efficiency") > UNDERSIZED})


def opportunities(eff: DataFrame) -> DataFrame:
    """Every oversized workload with its present and its right-sized monthly cost."""
    e, waste = F.col("overall_efficiency"), F.col("waste_cost_monthly")
    now = F.when(e < 1, waste / (1 - e)).otherwise(0.0)
    return eff.where("is_oversized").select(
        "workload",
        "namespace",
        now.alias("current_cost_monthly"),
        (now * e).alias("optimized_cost_monthly"),
        waste.alias("potential_savings_monthly"),
        F.format_string("Right-size resources to match %.0f%% actual usage", e * 100).alias("recommendation"),
        F.lit(0.8).alias("confidence"),
        F.when(waste < 10, "low").otherwise("medium").alias("implementation_effort"),
    )


def top_opportunities(eff: DataFrame, n: int = 5) -> DataFrame:
    return opportunities(eff).orderBy(F.desc("potential_savings_monthly"), "workload").limit(n)


def efficiency_summary(eff: DataFrame) -> DataFrame:
    """One row: unweighted mean efficiency and total waste."""
    return eff.agg(
        F.coalesce(F.avg("overall_efficiency"), F.lit(0.0)).alias("overall_efficiency"),
        F.coalesce(F.sum("waste_cost_monthly"), F.lit(0.0)).alias("total_waste_monthly"),
        F.count("*").alias("workload_count"),
    )


def efficiency_counts(eff: DataFrame) -> DataFrame:
    """One row: rounded figures, workloads per size class, the best opportunity."""
    over, under = F.col("is_oversized"), F.col("is_undersized")
    best = F.max_by(F.when(over, F.col("workload")), F.when(over, F.struct("waste_cost_monthly", "workload")))
    return eff.agg(
        F.round(F.coalesce(F.avg("overall_efficiency"), F.lit(0.0)) * 100, 1).alias("overall_efficiency"),
        F.round(F.coalesce(F.sum("waste_cost_monthly"), F.lit(0.0)), 2).alias("total_waste_monthly"),
        F.count("*").alias("workload_count"),
        F.count_if(over).alias("oversized_count"),
        F.count_if(under).alias("undersized_count"),
        F.count_if(~over & ~under).alias("optimal_count"),
        best.alias("top_opportunity"),
    )


def scaling_event_savings(
    events: DataFrame, *, cpu_per_replica: float | Column, memory_per_replica: float | Column, ts: str = "timestamp", tie: str = "seq",
    chunk_seconds: int = 86400,
) -> DataFrame:
    """Cost before and after each scaling event; only scaling down saves.

    ``before_replicas`` is taken from the previous event of the workload where the input lacks it; a
    workload's first event has none and costs nothing before.
    """
    rows = events
    if "before_replicas" not in events.columns:
        rows = with_previous(events, ["namespace", "workload"], ts, tie, {"after_replicas": "before_replicas"}, chunk_seconds)

    def c(v):
        return v if isinstance(v, Column) else F.lit(float(v))

    per_replica = c(cpu_per_replica) * UNIT_PRICES["cpu"] + c(memory_per_replica) * UNIT_PRICES["memory"]
    before, after = F.col("before_replicas"), F.col("after_replicas")
    saved = F.greatest(F.lit(0.0), F.coalesce((before - after) * per_replica, F.lit(0.0)))
    said = F.when(before > after, "down").when(before < after, "up")
    action = F.when(said.isNotNull(), F.format_string("Scaled %s from %d to %d replicas", said, before, after)).otherwise("No scaling change")
    return rows.withColumns(
        {
            "before_cost": F.coalesce(before, F.lit(0)) * per_replica,
            "after_cost": after * per_replica,
            "savings_hourly": saved,
            "savings_monthly": saved * HOURS_PER_MONTH,
            "optimization_type": F.lit("autoscaling"),
            "action_taken": action,
        }
    )


def in_period(events: DataFrame, period: str, *, as_of=None, namespace: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Events not older than the period at ``as_of`` (inclusive)."""
    rows = events.where(F.col(ts) >= cutoff(events, ts, as_of, PERIOD_HOURS[period] * 3600))
    return rows if namespace is None else rows.where(F.col("namespace") == namespace)


def savings_summary(events: DataFrame, period: str = "30d", *, as_of=None, namespace: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Totals, by type and by namespace in one grouping-sets aggregate; return on the monthly infrastructure cost in percent."""
    rows = in_period(events, period, as_of=as_of, namespace=namespace, ts=ts)
    kind, ns = F.col("optimization_type"), F.col("namespace")
    level = F.when(F.grouping(kind) == 0, "type").when(F.grouping(ns) == 0, "namespace").otherwise("all")
    total = F.coalesce(F.sum("savings_monthly"), F.lit(0.0))
    return rows.groupingSets([[kind], [ns], []], kind, ns).agg(
        level.alias("level"),
        total.alias("total_savings"),
        F.count("*").alias("events"),
        (total / INFRASTRUCTURE_COST * 100).alias("roi_percent"),
    ).select("level", F.coalesce("optimization_type", "namespace").alias("key"), "total_savings", "events", "roi_percent")


def last_events(events: DataFrame, period: str = "30d", n: int = 20, *, as_of=None, ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    return in_period(events, period, as_of=as_of, ts=ts).orderBy(F.desc(ts), F.desc(tie)).limit(n)


def potential_savings(found: DataFrame) -> DataFrame:
    """Total and number of the opportunities."""
    return found.agg(
        F.round(F.coalesce(F.sum("potential_savings_monthly"), F.lit(0.0)), 2).alias("total_potential_monthly"),
        F.count("*").alias("opportunities_count"),
    )


def cost_forecast(current: DataFrame, period: str = "30d", *, as_of: Column, daily_cost: str = "daily_cost", reference_compat: bool = False) -> DataFrame:
    """Predicted cost per future point of each row of ``current``.

    Growth is 0.02 / 30 per day ahead, weekends 10 % lower, Tuesday to Thursday 5 % higher; the margin
    starts at 10 % and widens. Hourly points grow by fractions of a day, and by whole days per hour
    with ``reference_compat``.
    """
    n, hours = {"7d": (7, 24), "30d": (30, 24), "90d": (12, 7 * 24)}.get(period, (24, 1))
    hourly = hours == 1
    points = current.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    when = add_seconds(as_of, (F.col("i") + 1) * hours * 3600)
    ahead = (F.col("i") + 1) * (hours / 24.0 if not (hourly and reference_compat) else 1.0)
    base = F.col(daily_cost) / (24.0 if hourly else 1.0) * (1 + (0.02 / 30) * ahead)
    dow = F.weekday("timestamp")
    season = F.when(dow >= 5, -0.1).when(dow.between(1, 3), 0.05).otherwise(0.0)
    part = F.col("i") / float(n)
    out = points.withColumn("timestamp", when).withColumn("predicted_cost", base * (1 + season))
    margin = F.col("predicted_cost") * 0.1 * (1 + part * 0.3)
    return out.withColumns(
        {
            "lower_bound": F.col("predicted_cost") - margin,
            "upper_bound": F.col("predicted_cost") + margin,
            "confidence": F.greatest(F.lit(0.5), 0.95 - part * 0.3),
        }
    )


def cost_trend(points: DataFrame, *, keys: Sequence[str], period: str = "30d") -> DataFrame:
    """Projected total and change from the first to the last point; weekly points count seven days."""
    days = 7 if period == "90d" else 1
    out = points.groupBy(*keys).agg(
        (F.sum("predicted_cost") * days).alias("projected_total"),
        F.min_by("predicted_cost", "i").alias("_first"),
        F.max_by("predicted_cost", "i").alias("_last"),
    )
    change = F.coalesce(F.try_divide((F.col("_last") - F.col("_first")) * 100, "_first"), F.lit(0.0))
    return out.withColumn("trend_percent", change).withColumn("trend", trend_word(F.col("trend_percent"))).drop("_first", "_last")


def budget_status(spend: DataFrame, *, budget: str | Column = "monthly_budget", current: str = "current_spend", days: str = "days_elapsed") -> DataFrame:
    """Burn rate, 30-day projection and time to exhaustion per row (infinite without a burn).

    With no day elapsed nothing is projected: on track, burn 0, the rest unknown.
    """
    b, spent, d = col(budget), F.col(current), F.col(days)
    started = d > 0
    burn = F.when(started, F.try_divide(spent, d)).otherwise(0.0)
    projected, remaining = F.col("burn_rate") * 30, F.when(started, b - spent).otherwise(b)
    out = spend.withColumn("burn_rate", burn).withColumn("projected_monthly", projected).withColumn("budget_remaining", remaining)
    exhaustion = F.when(F.col("burn_rate") > 0, F.col("budget_remaining") / F.col("burn_rate")).otherwise(F.lit(float("inf")))
    return out.withColumns(
        {
            "on_track": F.when(started, F.col("projected_monthly") <= b).otherwise(True),
            "days_to_exhaustion": F.when(started, exhaustion),
            "overage_projected": F.when(started, F.greatest(F.lit(0.0), F.col("projected_monthly") - b)),
        }
    )


def gauge_snapshot(costs: DataFrame, savings: DataFrame, eff: DataFrame, projected: DataFrame, *, order: str = "workload") -> DataFrame:
    """Current gauges in long form; of several writes to one label set the last (by ``order``) stays."""

    def gauge(df: DataFrame, name: str, label: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("gauge"), label.alias("labels"), value.alias("value"))

    last_cost = costs.groupBy("namespace", "resource").agg(F.max_by("hourly_cost", order).alias("v"))
    last_eff = eff.groupBy("namespace").agg(F.max_by("overall_efficiency", order).alias("v"))
    by_type = savings.where("level = 'type'")
    parts = [
        gauge(last_cost, "cost_current", F.concat_ws(",", "namespace", "resource"), F.col("v")),
        gauge(by_type, "savings_total", F.col("key"), F.col("total_savings")),
        gauge(last_eff, "efficiency", F.col("namespace"), F.col("v")),
        gauge(projected, "cost_forecast", F.lit("30d"), F.col("projected_total")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
