"""Anomaly scores, grades and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.functions.quantities import finite
from metriloom.functions.time import col
from metriloom.operators.scale import attach_row, join_small, numbered
from metriloom.schemas import SENSITIVITY_SIGMA, SEVERITY_FLOORS


def severity(score: str | Column) -> Column:
    """Grade of a score: the first floor it reaches, else ``low``."""
    s = col(score)
    grade = F.when(s >= SEVERITY_FLOORS["critical"], "critical")
    for name in ("high", "medium"):
        grade = grade.when(s >= SEVERITY_FLOORS[name], name)
    return grade.otherwise("low")


def zscore_anomalies(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("name",),
    value: str = "value",
    sigma: float | None = None,
    sensitivity: str = "medium",
    min_points: int = 12,
    score_digits: int = 6,
) -> DataFrame:
    """Rows whose distance from their series mean exceeds ``sigma`` population deviations.

    Series with fewer than ``min_points`` values are skipped; NaN and infinite values are no values. The score is rounded before it is
    compared, so the same rows are kept whatever order the sums were taken in.
    """
    sigma = SENSITIVITY_SIGMA[sensitivity] if sigma is None else sigma
    if not 1.0 <= sigma <= 5.0:
        raise ValueError("sigma must lie between 1 and 5")
    df = df.withColumn(value, finite(value))
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.avg(value).alias("expected"), F.stddev_pop(value).alias("_std")
    ).where(F.col("_n") >= min_points).withColumn("_std", F.when(F.col("_std") < 1e-10, 0.001).otherwise(F.col("_std")))
    score = F.round(F.abs(F.col(value) - F.col("expected")) / F.col("_std"), score_digits)
    return (
        join_small(df, stats, keys)
        .withColumn("score", score)
        .where(F.col("score") > sigma)
        .withColumn("severity", severity("score"))
        .drop("_n", "_std")
    )


def describe(metric: str | Column, value: str | Column, expected: str | Column, score: str | Column) -> Column:
    """One sentence about an anomaly."""
    v, e, s = col(value), col(expected), col(score)
    # fixed values: opening words per severity
    urgency = F.element_at(
        F.create_map(
            *[
                F.lit(x)
                for x in (
                    "critical", "Critical anomaly detected!",
                    "high", "Significant anomaly detected.",
                    "medium", "Moderate anomaly detected.",
                    "low", "Minor anomaly detected.",
                )
            ]
        ),
        severity(s),
    )
    percent = F.when(e != 0, F.abs(v - e) / e * 100).otherwise(0.0)
    side = F.when(v > e, "above").otherwise("below")
    return F.format_string(
        "%s %s is %.1f%% %s expected value (actual: %.4f, expected: %.4f, score: %.2fσ)",
        urgency, col(metric), percent, side, v, e, s,
    )


def anomaly_counts(found: DataFrame, *, name: str = "name", severity: str = "severity") -> DataFrame:
    """Anomalies per severity and per metric as rows (``level``, ``key``), which any number of metrics fits; one aggregate."""
    by_severity, by_name = F.col(severity), F.col(name)
    return found.groupingSets([[by_severity], [by_name]], by_severity, by_name).agg(
        F.when(F.grouping(by_severity) == 0, "severity").otherwise("metric").alias("level"), F.count("*").alias("anomalies"), F.max("score").alias("max_score")
    ).select("level", F.when(F.col("level") == "severity", by_severity).otherwise(by_name).alias("key"), "anomalies", "max_score")


def anomaly_summary(points: DataFrame, anomalies: DataFrame, *, metric: str = "name", severity_col: str = "severity", score: str = "score") -> DataFrame:
    """One row: status, rate over all points, counts by severity and by metric, highest score.

    The maps hold one entry per severity and per metric name, not per row.
    """
    counts = anomalies.groupBy(metric, severity_col).agg(F.count("*").alias("n"), F.max(score).alias("top"))
    by_metric = counts.groupBy(metric).agg(F.sum("n").alias("n"))
    by_severity = counts.groupBy(severity_col).agg(F.sum("n").alias("n"))

    def as_map(frame: DataFrame, key: str, name: str) -> DataFrame:
        return frame.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias(name))

    def of(level: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(severity_col) == level, F.col("n"))), F.lit(0))

    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("anomalies"),
        of("critical").alias("_critical"),
        of("high").alias("_high"),
        F.max("top").alias("max_score"),
    )
    out = attach_row(points.agg(F.count("*").alias("points")), totals)
    out = attach_row(out, as_map(by_severity, severity_col, "by_severity"))
    out = attach_row(out, as_map(by_metric, metric, "by_metric"))
    status = (
        F.when(F.col("anomalies") == 0, "healthy")
        .when(F.col("_critical") > 0, "critical")
        .when(F.col("_high") > 0, "warning")
        .otherwise("attention")
    )
    return out.select(
        status.alias("status"),
        F.when(F.col("points") > 0, F.col("anomalies") / F.col("points")).otherwise(0.0).alias("anomaly_rate"),
        "anomalies",
        "points",
        "by_severity",
        "by_metric",
        "max_score",
    )


def holdout_zscore(
    df: DataFrame, *, keys: Sequence[str] = ("name",), ts: str = "timestamp", tie: str = "seq", value: str = "value",
    ratio: float = 0.8, sigma: float = 2.5, score_digits: int = 6,
) -> DataFrame:
    """Score every row against the mean and deviation of the first ``ratio`` of its series.

    A series of ten rows or fewer is scored against mean 0 and deviation 1. NaN and infinite values are
    no values.
    """
    df = df.withColumn(value, finite(value))
    placed = numbered(df, keys, ts, tie)
    head = F.col("row_index") <= F.floor(F.col("series_rows") * ratio)
    stats = placed.groupBy(*keys).agg(
        F.max("series_rows").alias("_n"),
        F.avg(F.when(head, F.col(value))).alias("_mean"),
        F.stddev_pop(F.when(head, F.col(value))).alias("_std"),
    )
    long_enough = F.col("_n") > 10
    stats = stats.select(
        *keys,
        F.when(long_enough, F.col("_mean")).otherwise(0.0).alias("expected"),
        F.when(long_enough, F.greatest("_std", F.lit(0.001))).otherwise(1.0).alias("_scale"),
    )
    score = F.round(F.abs(F.col(value) - F.col("expected")) / F.col("_scale"), score_digits)
    return join_small(df, stats, keys).withColumn("score", score).where(F.col("score") > sigma).drop("_scale")


def residual_over_std(
    df: DataFrame, *, keys: Sequence[str], actual: str, predicted: str, out: str = "score"
) -> DataFrame:
    """Absolute residual over the deviation of the residuals of its series (1 where that is 0)."""
    with_residual = df.withColumn("residual", finite(F.abs(F.col(actual) - F.col(predicted))))
    spread = with_residual.groupBy(*keys).agg(F.stddev_pop("residual").alias("_std"))
    spread = spread.withColumn("_std", F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0))
    return join_small(with_residual, spread, keys).withColumn(out, F.col("residual") / F.col("_std")).drop("_std")


def detector_evaluate(df: DataFrame, *, keys: Sequence[str] = (), score: str = "score", flag: str = "flag", label: str | None = None) -> DataFrame:
    """Count, rate and score statistics; precision, recall and f1 where true labels are given."""
    hit = F.col(flag).cast("boolean")
    aggs = [
        F.count_if(hit).alias("n_anomalies"),
        (F.count_if(hit) / F.count("*")).alias("anomaly_rate"),
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
        F.stddev_pop(score).alias("std_score"),
    ]
    if label is None:
        return df.groupBy(*keys).agg(*aggs)
    truth = F.col(label).cast("boolean")
    tp, fp, fn = F.count_if(hit & truth), F.count_if(hit & ~truth), F.count_if(~hit & truth)
    scored = df.groupBy(*keys).agg(*aggs, tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"))
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp") + 1e-8)
    recall = F.col("_tp") / (F.col("_tp") + F.col("_fn") + 1e-8)
    return (
        scored.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1_score", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))
        .drop("_tp", "_fp", "_fn")
    )


def contributing_features(wide: DataFrame, *, columns: Sequence[str], ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Share of each metric in a multi-metric score: its |z| over the sum at that time, largest first.

    Columns that are NULL at a time take no part there.
    """
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    if keys:
        placed = join_small(wide, wide.groupBy(*keys).agg(*aggs), keys)
    else:
        placed = attach_row(wide, wide.agg(*aggs))
    z = [F.try_divide(F.abs(F.col(c) - F.col(f"_m_{c}")), F.col(f"_s_{c}")).alias(c) for c in columns]
    scores = placed.select(*keys, ts, *z).unpivot([*keys, ts], list(columns), "feature", "z").where("z IS NOT NULL")
    at_time = Window.partitionBy(*keys, ts)
    share = F.try_divide(F.col("z"), F.sum("z").over(at_time))
    return scores.select(
        *keys,
        ts,
        "feature",
        share.alias("contribution"),
        F.row_number().over(at_time.orderBy(F.desc("z"), "feature")).alias("rank"),
    )
