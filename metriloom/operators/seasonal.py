"""Seasonal forecast: one trend line per series, a daily and a weekly index, a residual band.

Fits are windows over an aligned frame, all partitioned by the series, so one shuffle serves the
whole fit. The result is one parameter row per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.functions.time import MICROS, add_seconds, micros
from metriloom.operators.features import ordered_split
from metriloom.operators.forecast import forecast_metrics, steps, z_of
from metriloom.operators.scale import join_small

DAY_MICROS = 86_400 * MICROS


def _days(ts: str) -> Column:
    return micros(ts) / F.lit(float(DAY_MICROS))


def _without(value: Column, base: Column, mode: str) -> Column:
    return F.try_divide(value, base) if mode == "multiplicative" else value - base


def _combine(base: Column, index: Column, mode: str) -> Column:
    return base * index if mode == "multiplicative" else base + index


def seasonal_fit(df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", mode: str = "multiplicative") -> DataFrame:
    """Slope, intercept, hour and weekday index, residual deviation per series of two points or more."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_y"), _days(ts).alias("_x"))
    per = Window.partitionBy(*keys)
    hour, dow = F.hour(ts), F.weekday(ts)
    placed = rows.withColumns(
        {
            "_slope": F.coalesce(F.regr_slope("_y", "_x").over(per), F.lit(0.0)),
            "_mx": F.avg("_x").over(per),
            "_my": F.avg("_y").over(per),
            "_n": F.count("*").over(per),
            "_hour": hour,
            "_dow": dow,
        }
    ).where("_n >= 2")
    placed = placed.withColumn("_trend", F.col("_my") + F.col("_slope") * (F.col("_x") - F.col("_mx")))
    placed = placed.withColumn("_r", _without(F.col("_y"), F.col("_trend"), mode))
    placed = placed.withColumn("_daily", F.avg("_r").over(Window.partitionBy(*keys, "_hour")))
    placed = placed.withColumn("_r", _without(F.col("_r"), F.col("_daily"), mode))
    placed = placed.withColumn("_weekly", F.avg("_r").over(Window.partitionBy(*keys, "_dow")))
    fitted = _combine(_combine(F.col("_trend"), F.col("_daily"), mode), F.col("_weekly"), mode)

    def index(key: str, value: str, name: str) -> Column:
        # equal within its window group, so the set holds one entry per hour or weekday
        return F.map_from_entries(F.collect_set(F.struct(key, value))).alias(name)

    return placed.groupBy(*keys).agg(
        F.first("_slope").alias("slope"),
        F.first("_mx").alias("center_days"),
        F.first("_my").alias("center_value"),
        index("_hour", "_daily", "daily"),
        index("_dow", "_weekly", "weekly"),
        F.stddev_pop(F.col("_y") - fitted).alias("std"),
        F.count("*").alias("n_points"),
        F.max(ts).alias("fitted_until"),
        F.lit(mode).alias("mode"),
    )


def seasonal_values(df: DataFrame, *, ts: str = "timestamp", mode: str = "multiplicative", confidence: float = 0.95) -> DataFrame:
    """Add trend, daily and weekly component, value and band to rows that carry the parameters.

    An hour or weekday never seen in the fit is neutral.
    """
    neutral = F.lit(1.0 if mode == "multiplicative" else 0.0)
    trend = F.col("center_value") + F.col("slope") * (_days(ts) - F.col("center_days"))
    out = df.withColumns(
        {
            "trend": trend,
            "daily_component": F.coalesce(F.try_element_at("daily", F.hour(ts)), neutral),
            "weekly_component": F.coalesce(F.try_element_at("weekly", F.weekday(ts)), neutral),
        }
    )
    value = _combine(_combine(F.col("trend"), F.col("daily_component"), mode), F.col("weekly_component"), mode)
    margin = z_of(confidence) * F.col("std")
    return out.withColumn("predicted", value).withColumn("lower_bound", value - margin).withColumn("upper_bound", value + margin)


def seasonal_forecast(params: DataFrame, periods: int = 12, *, step_seconds: int = 300, mode: str = "multiplicative", confidence: float = 0.95) -> DataFrame:
    """Forecast ``periods`` steps beyond the last fitted time, with components."""
    future = steps(params, periods).withColumn("timestamp", add_seconds("fitted_until", F.col("step") * step_seconds))
    return seasonal_values(future, mode=mode, confidence=confidence)


def seasonal_evaluate(df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", ratio: float = 0.8, mode: str = "multiplicative") -> DataFrame:
    """Fit the first part of each series, score the rest: errors, coverage of the band, sizes."""
    split = ordered_split(df.where(F.col(value).isNotNull()), keys=keys, ratio=ratio, ts=ts, aligned=True)
    params = seasonal_fit(split.where("is_train"), keys=keys, ts=ts, value=value, mode=mode)
    test = split.where("NOT is_train").select(*keys, ts, F.col(value).alias("actual"))
    scored = seasonal_values(join_small(test, params, keys), ts=ts, mode=mode)
    errors = forecast_metrics(scored, by=[*keys, "n_points"])
    covered = F.avg(F.col("actual").between(F.col("lower_bound"), F.col("upper_bound")).cast("double")) * 100
    coverage = scored.groupBy(*keys).agg(covered.alias("coverage"))
    return errors.join(coverage, list(keys)).withColumnRenamed("n_points", "train_size").withColumnRenamed("n", "test_size")


def rolling_origin_cv(
    df: DataFrame, *, keys: Sequence[str], initial_seconds: int, period_seconds: int, horizon_seconds: int, ts: str = "timestamp", value: str = "value",
    mode: str = "multiplicative", bucket_seconds: int = 3600,
) -> DataFrame:
    """Cross-validation from moving cutoffs; errors by horizon.

    Cutoffs step back from (end - horizon) by ``period`` while at least ``initial`` of history is
    left. Each row is copied only to the cutoffs it trains or tests, by a sequence per row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, ts, value, micros(ts).alias("_us"))
    span = rows.groupBy(*keys).agg(F.min("_us").alias("_start"), F.max("_us").alias("_end"))
    p, h = period_seconds * MICROS, horizon_seconds * MICROS
    last = F.col("_end") - h
    count = F.floor((last - F.col("_start") - initial_seconds * MICROS) / F.lit(p)).cast("int")  # cutoffs are 0..count back
    span = span.withColumn("_last", last).withColumn("_count", count).where("_count >= 0").drop("_end", "_start")
    placed = join_small(rows, span, keys)
    cutoffs = F.transform(F.sequence(F.lit(0), F.col("_count")), lambda k: F.col("_last") - k.cast("bigint") * p)
    copies = placed.select(*keys, ts, value, "_us", F.explode(F.filter(cutoffs, lambda c: F.col("_us") <= c + h)).alias("cutoff"))
    grouped = [*keys, "cutoff"]
    train, test = copies.where(F.col("_us") <= F.col("cutoff")), copies.where(F.col("_us") > F.col("cutoff"))
    params = seasonal_fit(train, keys=grouped, ts=ts, value=value, mode=mode)
    scored = seasonal_values(join_small(test.withColumnRenamed(value, "actual"), params, grouped), ts=ts, mode=mode)
    size = bucket_seconds * MICROS
    ahead = F.ceil((F.col("_us") - F.col("cutoff")) / F.lit(float(size))).cast("bigint") * bucket_seconds
    scored = scored.withColumn("horizon_seconds", ahead)
    hit = F.col("actual").between(F.col("lower_bound"), F.col("upper_bound")).cast("double")
    by = [*keys, "horizon_seconds"]
    return forecast_metrics(scored, by=by).join(scored.groupBy(*by).agg(F.avg(hit).alias("coverage")), by)




def seasonal_components(params: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Mode, number of trend changepoints (one line: none) and the seasonalities present."""
    names = F.filter(
        F.array(F.when(F.size("daily") > 1, "daily"), F.when(F.size("weekly") > 1, "weekly")), lambda x: x.isNotNull()
    )
    return params.select(*keys, "mode", F.lit(0).alias("n_changepoints"), names.alias("seasonalities"))
