"""The dashboard, alert and autoscaling expressions as DataFrame operators.

Rates are sums of increases over whole evaluation steps (no extrapolation at the edges); a range is
a multiple of the step, so a sliding range is a window over the step totals and the raw samples are
aggregated only once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.functions.quantities import finite
from metriloom.functions.time import MICROS, add_seconds, floor_to, micros, seconds_between
from metriloom.operators.align import with_increase
from metriloom.operators.scale import attach_row
from metriloom.schemas import SCALING_TRIGGERS


def increase(
    df: DataFrame, *, keys: Sequence[str], range_seconds: int, step_seconds: int, ts: str = "timestamp", tie: str = "seq", value: str = "value"
) -> DataFrame:
    """Counter increase over the range ending with each step; ``ts`` is the start of the newest step."""
    if range_seconds % step_seconds:
        raise ValueError("the range must be a multiple of the step")
    steps = (
        with_increase(df, keys=keys, ts=ts, tie=tie, value=value)
        .groupBy(*keys, floor_to(ts, step_seconds).alias(ts))
        .agg(F.sum("increase").alias("_inc"))
    )
    back = range_seconds - step_seconds
    over = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-back * MICROS, 0)
    return steps.select(*keys, ts, F.sum("_inc").over(over).alias(value))


def rate(df: DataFrame, *, range_seconds: int, value: str = "value", **kw) -> DataFrame:
    """``increase`` per second."""
    out = increase(df, range_seconds=range_seconds, value=value, **kw)
    return out.withColumn(value, F.col(value) / F.lit(float(range_seconds)))


def vector_aggregate(df: DataFrame, *, by: Sequence[str] = (), ts: str | None = "timestamp", value: str = "value") -> DataFrame:
    """sum, avg, max, min and count of a vector per label set (and time)."""
    groups = [*by, *([ts] if ts else [])]
    return df.groupBy(*groups).agg(
        F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("count")
    )


def ratio(df: DataFrame, part: Column, *, by: Sequence[str], weight: Column | None = None, scale: float = 1.0, out: str = "ratio") -> DataFrame:
    """Share of the rows (or of ``weight``) that satisfy ``part``, in one pass; NULL where there is none."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    share = F.try_divide(F.coalesce(F.sum(F.when(part, w)), F.lit(0.0)), F.sum(w)) * scale
    return df.groupBy(*by).agg(share.alias(out))


def vector_ratio(left: DataFrame, right: DataFrame, *, on: Sequence[str], value: str = "value", out: str = "ratio") -> DataFrame:
    """Left over right where both sides have the labels; a zero divisor gives NULL."""
    r = right.select(*on, F.col(value).alias("_divisor"))
    return left.join(r, list(on)).withColumn(out, F.try_divide(value, "_divisor")).drop("_divisor")


def bucketize(df: DataFrame, bounds: Sequence[float], *, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Cumulative bucket counts per label set, with +Inf, sum and count.

    All bounds are counted in one pass over the rows; rows are never multiplied.
    """
    names = [f"_b{i}" for i in range(len(bounds))]
    counts = df.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(n) for b, n in zip(bounds, names)],
        F.count(value).alias("count"),
        F.sum(value).alias("sum"),
    )
    buckets = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("bucket")) for b, n in zip(bounds, names)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket")),
    )
    return counts.select(*by, F.explode(buckets).alias("_x"), "sum", "count").select(*by, "_x.le", "_x.bucket", "sum", "count")


def histogram_quantile(buckets: DataFrame, q: float, *, by: Sequence[str] = (), le: str = "le", bucket: str = "bucket", out: str = "quantile") -> DataFrame:
    """Quantile by linear interpolation inside the first cumulative bucket that reaches it.

    In the +Inf bucket the highest finite bound is returned; an empty histogram gives NULL. A group
    holds one row per bound.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    seen = w.orderBy(le)
    placed = buckets.select(
        *by,
        F.col(le).alias("_le"),
        F.col(bucket).cast("double").alias("_cum"),
        F.lag(le).over(seen).alias("_lower"),
        F.coalesce(F.lag(bucket).over(seen).cast("double"), F.lit(0.0)).alias("_before"),
        F.max(bucket).over(w).cast("double").alias("_total"),
    )
    rank = F.col("_total") * q
    low = F.coalesce("_lower", F.when(F.col("_le") > 0, 0.0).otherwise(F.col("_le")))
    inside = low + (F.col("_le") - low) * F.try_divide(rank - F.col("_before"), F.col("_cum") - F.col("_before"))
    estimate = F.when(F.col("_total") == 0, None).when(F.col("_le") == float("inf"), F.col("_lower")).otherwise(inside)
    return placed.where(F.col("_cum") >= rank).groupBy(*by).agg(F.min_by(estimate, F.col("_le")).alias(out))


def counters_by_labels(df: DataFrame, by: Sequence[str], out: str = "total") -> DataFrame:
    """Event count per label set."""
    return df.groupBy(*by).agg(F.count("*").alias(out))


def match_labels(df: DataFrame, matchers: Sequence[tuple[str, str, str]], labels_col: str = "labels") -> DataFrame:
    """Rows satisfying all (label, operator, pattern) matchers; a missing label counts as ''."""

    def one(label: str, op: str, pattern: str) -> Column:
        have = F.coalesce(F.col(label) if label in df.columns else F.col(labels_col)[label], F.lit(""))
        whole = f"^(?:{pattern})$"
        return {"=": have == pattern, "!=": have != pattern, "=~": have.rlike(whole), "!~": ~have.rlike(whole)}[op]

    return df.where(reduce(lambda a, b: a & b, [one(*m) for m in matchers]))


def or_vector(df: DataFrame, default: float, *, value: str = "value", agg: str = "max") -> DataFrame:
    """One aggregate over the vector, or ``default`` where the vector is empty."""
    fn = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg}[agg]
    return df.agg(F.coalesce(fn(value), F.lit(default)).alias(value))


def condition(value: Column, op: str, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return {">": value > limit, "<": value < limit, "==": value == limit, ">=": value >= limit, "<=": value <= limit}[op]


def alert_eval(
    df: DataFrame, rules: Sequence[tuple], *, keys: Sequence[str] = (), expression: str = "expression", ts: str = "timestamp", value: str = "value"
) -> DataFrame:
    """State of each rule at each evaluation: inactive, pending, or firing once true for its time.

    ``df`` holds one row per (keys, expression, evaluation time). Rules are (alert, expression,
    operator, threshold, minutes, severity); they become literals, so no rule table is shuffled. A NULL,
    NaN or infinite value holds for no rule.
    """
    per_rule = []
    for alert, expr, op, threshold, minutes, sev in rules:
        per_rule.append(
            F.when(
                F.col(expression) == expr,
                F.struct(
                    F.lit(alert).alias("alert"),
                    F.lit(sev).alias("severity"),
                    F.lit(int(minutes) * 60).alias("for_seconds"),
                    F.coalesce(condition(finite(value), op, threshold), F.lit(False)).alias("holds"),
                ),
            )
        )
    matching = F.filter(F.array(*per_rule), lambda x: x.isNotNull())
    evaluated = df.select(*keys, ts, value, F.explode(matching).alias("_r")).select(*keys, ts, value, "_r.*")
    order = Window.partitionBy(*keys, "alert").orderBy(ts)
    started = F.col("holds") & ~F.coalesce(F.lag("holds").over(order), F.lit(False))
    since = F.last(F.when(F.col("_started"), F.col(ts)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = evaluated.withColumn("_started", started).withColumn("active_since", F.when(F.col("holds"), since))
    state = (
        F.when(~F.col("holds"), "inactive")
        .when(seconds_between(F.col(ts), F.col("active_since")) >= F.col("for_seconds"), "firing")
        .otherwise("pending")
    )
    return placed.withColumn("state", state).drop("_started", "holds", "for_seconds")


def trigger_eval(
    values: DataFrame, triggers: Sequence[tuple] = SCALING_TRIGGERS, *, at: Sequence[str] = ("timestamp",), workload: str = "workload",
    trigger: str = "trigger", value: str = "value",
) -> DataFrame:
    """Replicas asked for per workload: the highest over its active triggers, within its limits.

    A trigger is active above its activation threshold and asks for ceil(value / threshold). The
    trigger table is a constant of the call and is broadcast.
    """
    table = values.sparkSession.createDataFrame(
        [tuple(t) for t in triggers],
        f"{workload} string, {trigger} string, threshold double, activation double, min_replicas int, max_replicas int",
    )
    placed = values.join(F.broadcast(table), [workload, trigger])
    active = F.col(value) > F.col("activation")
    wanted = F.when(active, F.ceil(F.col(value) / F.col("threshold")))
    return (
        placed.groupBy(workload, *at)
        .agg(
            F.count_if(active).alias("active_triggers"),
            F.max(wanted).alias("_wanted"),
            F.max("min_replicas").alias("_lo"),
            F.max("max_replicas").alias("_hi"),
        )
        .select(
            workload,
            *at,
            "active_triggers",
            F.least(F.greatest(F.coalesce("_wanted", F.col("_lo")), "_lo"), "_hi").cast("int").alias("replicas"),
        )
    )


def service_totals(
    *, forecasts: DataFrame, detections: DataFrame, recommendations: DataFrame, as_of: Column, cooldown_seconds: int = 300,
    anomalies: str = "anomalies", requested_at: str = "timestamp",
) -> DataFrame:
    """One row of totals over the run tables; workloads whose last recommendation is still cooling."""
    f = forecasts.agg(F.count("*").alias("forecasts_made"))
    d = detections.agg(
        F.count("*").alias("detections"),
        F.coalesce(F.sum(anomalies), F.lit(0)).alias("anomalies_found"),
        F.coalesce(F.avg(anomalies), F.lit(0.0)).alias("anomalies_per_detection"),
    )
    last = recommendations.groupBy("workload").agg(F.count("*").alias("n"), F.max(requested_at).alias("last"))
    r = last.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("recommendations"),
        F.count_if(add_seconds("last", cooldown_seconds) > as_of).alias("workloads_in_cooldown"),
    )
    return attach_row(attach_row(f, d), r)
