"""Moving-average forecasts with bands, their evaluation and comparison.

Fits run on aligned frames (one row per series and period). Parameters are a table with one row per
series, so any number of series is fitted and forecast in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.functions.time import add_seconds, col, floor_to
from metriloom.operators.features import ordered_split
from metriloom.operators.scale import join_small, newest_per_key

MAX_PERIODS = 288  # fixed value: longest forecast offered


def z_of(confidence: float) -> float:
    """1.96 at 0.95; any other level uses the 99 % factor."""
    return 1.96 if confidence == 0.95 else 2.576


def steps(df: DataFrame, periods: int) -> DataFrame:
    """One row per forecast step of every input row."""
    if not 1 <= periods <= MAX_PERIODS:
        raise ValueError(f"periods must be between 1 and {MAX_PERIODS}")
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))


def baseline_fit(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", window: int | Column = 12, trend_window: int = 24,
    max_window: int = 12,
) -> DataFrame:
    """Mean of the last ``window`` values, mean step of the last ``trend_window``, residual deviation.

    ``window`` may be a per-series integer column up to ``max_window``. A series shorter than its
    window is returned with ``is_fitted`` false and NULL parameters.
    """
    rows = df.where(F.col(value).isNotNull())
    per = Window.partitionBy(*keys)
    order = per.orderBy(ts)

    def trailing(n: int) -> Column:
        return F.avg(value).over(order.rowsBetween(-(n - 1), 0))

    if isinstance(window, int):
        size, mean = F.lit(window), trailing(window)
    else:
        size, mean = F.col("_w"), F.element_at(F.array(*[trailing(n) for n in range(1, max_window + 1)]), F.col("_w"))
        rows = rows.withColumn("_w", window.cast("int"))
    placed = rows.select(
        *keys,
        ts,
        F.col(value).alias("_y"),
        size.alias("_size"),
        F.row_number().over(order).alias("_rn"),
        F.count("*").over(per).alias("_n"),
        mean.alias("_mean"),
    ).withColumn("_back", F.col("_n") - F.col("_rn"))
    in_trend = F.col("_back") < trend_window
    fitted = placed.groupBy(*keys).agg(
        F.max("_n").alias("n_points"),
        F.max("_size").alias("window"),
        F.max(ts).alias("fitted_until"),
        F.max_by("_y", ts).alias("last_value"),
        F.avg(F.when(F.col("_back") < F.col("_size"), F.col("_y"))).alias("moving_average"),
        F.max_by("_y", ts).alias("_last"),
        F.min_by(F.when(in_trend, F.col("_y")), F.when(in_trend, F.col(ts))).alias("_first"),
        F.count_if(in_trend).alias("_k"),
        F.stddev_pop(F.when(F.col("_rn") >= F.col("_size"), F.col("_y") - F.col("_mean"))).alias("std"),
    )
    enough = (F.col("n_points") >= F.col("window")) & (F.col("window") > 0)
    trend = F.when(F.col("_k") > 1, (F.col("_last") - F.col("_first")) / (F.col("_k") - 1)).otherwise(0.0)
    return fitted.select(
        *keys,
        "n_points",
        "window",
        "fitted_until",
        "last_value",
        enough.alias("is_fitted"),
        F.when(enough, F.col("moving_average")).alias("moving_average"),
        F.when(enough, trend).alias("trend"),
        F.when(enough, F.col("std")).alias("std"),
    )


def baseline_predict(params: DataFrame, periods: int = 12, *, confidence: float = 0.95) -> DataFrame:
    """Average plus trend per step; the band widens with the root of the step."""
    z = z_of(confidence)
    out = steps(params.where("is_fitted"), periods)
    margin = z * F.col("std") * F.sqrt("step")
    value = F.col("moving_average") + F.col("trend") * F.col("step")
    return out.withColumn("value", value).withColumn("lower_bound", value - margin).withColumn("upper_bound", value + margin)


def portable_forecast(params: DataFrame, periods: int = 12, *, confidence: float = 0.95) -> DataFrame:
    """Forecast from stored parameters: never negative, band of constant width."""
    margin = z_of(confidence) * F.col("std")
    value = F.greatest(F.lit(0.0), F.col("moving_average") + F.col("trend") * F.col("step"))
    out = steps(params, periods).withColumn("value", value)
    return out.withColumn("lower_bound", F.greatest(F.lit(0.0), F.col("value") - margin)).withColumn(
        "upper_bound", F.col("value") + margin
    )


def forecast_metrics(df: DataFrame, *, by: Sequence[str], actual: str = "actual", predicted: str = "predicted", naive: str | None = None) -> DataFrame:
    """mae, mse, rmse, mape and, with a ``naive`` forecast column, the skill against it."""
    error = F.col(actual) - F.col(predicted)
    aggs = [
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, F.col(actual) + 1e-8))) * 100).alias("mape"),
    ]
    if naive is None:
        return df.groupBy(*by).agg(*aggs)
    out = df.groupBy(*by).agg(*aggs, F.avg(F.abs(F.col(actual) - F.col(naive))).alias("_naive"))
    skill = F.when(F.col("_naive") > 0, 1 - F.col("mae") / F.col("_naive")).otherwise(0.0)
    return out.withColumn("skill_score", skill).drop("_naive")


def train_baseline(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", largest_window: int = 6, trend_window: int = 24
) -> DataFrame:
    """Split each series in time, fit the first part, score the rest.

    The window is ``largest_window`` or half the training rows, whichever is smaller.
    """
    split = ordered_split(df.where(F.col(value).isNotNull()), keys=keys, ts=ts, aligned=True)
    sized = split.withColumn(
        "_train_rows", F.floor(F.col("series_rows") * F.when(F.col("series_rows") < 50, 0.6).otherwise(0.8))
    )
    window = F.least(F.lit(largest_window), F.floor(F.col("_train_rows") / 2).cast("int"))
    train, test = sized.where("is_train"), sized.where("NOT is_train")
    params = baseline_fit(train, keys=keys, ts=ts, value=value, window=window, trend_window=trend_window, max_window=largest_window)
    scored = join_small(test, params.where("is_fitted"), keys)
    step = F.col("row_index") - F.col("_train_rows")
    scored = scored.withColumn("predicted", F.col("moving_average") + F.col("trend") * step)
    out = forecast_metrics(
        scored.withColumnRenamed(value, "actual"), by=[*keys, "window", "n_points", "moving_average", "trend"], naive="last_value"
    )
    return out.withColumnRenamed("n_points", "train_size").withColumnRenamed("n", "test_size")


def online_baseline(
    df: DataFrame, periods: int = 12, *, keys: Sequence[str], ts: str = "timestamp", tie: str = "seq", value: str = "value", window: int = 12,
    confidence: float = 0.95, wanted: DataFrame | None = None,
) -> DataFrame:
    """Forecast from the newest rows of each series, with a constant-width band.

    Fewer rows than the window: flat at the last value with band (0, 1). ``wanted`` lists series that
    must be answered; one without any row is flat at 0.
    """
    newest = newest_per_key(df, keys, [F.desc(ts), F.desc(tie)], 2 * window, "_rank")
    now, before = F.col("_rank") <= window, F.col("_rank") > window
    facts = newest.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max_by(value, -F.col("_rank")).alias("last"),
        F.avg(F.when(now, F.col(value))).alias("ma"),
        F.avg(F.when(before, F.col(value))).alias("prev"),
        F.stddev_pop(F.when(now, F.col(value))).alias("std"),
    )
    if wanted is not None:
        facts = wanted.join(facts, list(keys), "left")
    return online_values(facts, periods, keys=keys, window=window, confidence=confidence)


def online_values(facts: DataFrame, periods: int, *, keys: Sequence[str], window: int = 12, confidence: float = 0.95) -> DataFrame:
    """Forecast rows from per-series facts: row count, last value, mean and deviation of the newest
    window (``ma``, ``std``) and mean of the one before (``prev``)."""
    n = F.coalesce("n", F.lit(0))
    short = n < window
    trend = F.when(n >= 2 * window, (F.col("ma") - F.col("prev")) / window).otherwise(0.0)
    moving = F.greatest(F.lit(0.0), F.col("ma") + trend * F.col("step"))
    margin = z_of(confidence) * F.col("std")
    out = steps(facts, periods).withColumn("value", F.when(short, F.coalesce("last", F.lit(0.0))).otherwise(moving))
    return out.select(
        *keys,
        "step",
        "value",
        F.when(short, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("value") - margin)).alias("lower_bound"),
        F.when(short, 1.0).otherwise(F.col("value") + margin).alias("upper_bound"),
    )


def fixed_margin_band(df: DataFrame, *, value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Band of +-0.1 (0.15 at other levels) inside [0, 1], for forecasts of a ratio."""
    margin = 0.1 if confidence == 0.95 else 0.15
    return df.withColumn("lower_bound", F.greatest(F.lit(0.0), F.col(value) - margin)).withColumn(
        "upper_bound", F.least(F.lit(1.0), F.col(value) + margin)
    )


def relative_band(df: DataFrame, *, value: str = "value", share: float = 0.1) -> DataFrame:
    """Band of +-10 % of the value, used where a seasonal band is missing."""
    return df.withColumn("lower_bound", F.col(value) * (1 - share)).withColumn("upper_bound", F.col(value) * (1 + share))


def forecast_many(
    forecasts: Mapping[str, DataFrame], model: str, *, keys: Sequence[str], as_of: Column, step_seconds: int = 300, fallback: str = "baseline",
    include_confidence: bool = True,
) -> DataFrame:
    """One forecast per series: the asked model where it has one, else the fallback.

    Each frame holds (keys, step, value, lower_bound, upper_bound).
    """
    order = [model, *[m for m in (fallback,) if m != model]]
    columns = [*keys, "step", "value", "lower_bound", "upper_bound"]
    parts = [
        forecasts[m].select(*columns, F.lit(m).alias("model"), F.lit(rank).alias("_rank")) for rank, m in enumerate(order) if m in forecasts
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    best = union.groupBy(*keys, "step").agg(F.min_by(F.struct("model", "value", "lower_bound", "upper_bound"), "_rank").alias("_b"))
    out = best.select(*keys, "step", add_seconds(as_of, F.col("step") * step_seconds).alias("timestamp"), "_b.*")
    return out if include_confidence else out.drop("lower_bound", "upper_bound")


def compare_models(metrics: DataFrame, *, keys: Sequence[str], model: str = "model", baseline: str = "baseline") -> DataFrame:
    """Error figures per model and the mae improvement over the baseline in percent.

    A series has one row per model.
    """
    base = F.max(F.when(F.col(model) == baseline, F.col("mae"))).over(Window.partitionBy(*keys))
    return metrics.select(*keys, model, "mae", "rmse", "mape", F.try_divide(base - F.col("mae"), base * 0.01).alias("improvement"))


def forecast_summary(df: DataFrame, *, keys: Sequence[str], value: str = "value", step: str = "step") -> DataFrame:
    """Peak, average, rounded change from the fourth-last to the last point, and a trend word."""
    facts = df.groupBy(*keys).agg(
        F.max(value).alias("peak"), F.avg(value).alias("average"), F.max_by(value, step).alias("latest"), F.max(step).alias("_n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(step, value)))).alias("_points"),  # at most 288 steps
    )
    earlier = F.try_element_at("_points", F.greatest(F.lit(1), F.col("_n") - 3))
    change = F.when(earlier > 0, F.floor((F.col("latest") - earlier) / earlier * 100 + 0.5)).otherwise(0)
    return (
        facts.withColumn("change_percent", change.cast("bigint"))
        .withColumn("trend", trend_word(F.col("change_percent")))
        .drop("_n", "_points")
    )


def trend_word(percent: Column) -> Column:
    return F.when(percent > 5, "increasing").when(percent < -5, "decreasing").otherwise("stable")


def forecast_vs_actual(
    forecasts: DataFrame, actuals: DataFrame, *, keys: Sequence[str], period: int, ts: str = "timestamp", value: str = "value", horizon: str = "horizon_minutes"
) -> DataFrame:
    """Errors of stored forecasts by series and horizon, once the actual value is known."""
    known = actuals.groupBy(*keys, floor_to(ts, period).alias("_bucket")).agg(F.avg(value).alias("actual"))
    due = forecasts.select(*keys, horizon, floor_to(ts, period).alias("_bucket"), col(value).alias("predicted"))
    return forecast_metrics(due.join(known, [*keys, "_bucket"]), by=[*keys, horizon])
