"""Alignment, reduction and merge of metric samples.

Aligned frames hold at most one row per (series, period); every window in the feature, forecast and
alert operators runs on such frames, so a task holds at most span / period rows of a series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriloom.functions.time import col, floor_to, round_half_even_to
from metriloom.operators.scale import with_previous
from metriloom.schemas import GAUGE_FRAGMENTS, TRAINING_ALIGNERS


def align_mean(df: DataFrame, *, keys: Sequence[str], period: int, ts: str = "timestamp", value: str = "value") -> DataFrame:
    """Mean per series and period."""
    return df.groupBy(*keys, floor_to(ts, period).alias(ts)).agg(F.avg(value).alias(value))


def with_increase(df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", tie: str = "seq", value: str = "value", out: str = "increase") -> DataFrame:
    """Counter growth since the previous sample of the series; after a reset the new value counts.

    The first sample of a series adds nothing.
    """
    prev = F.col("_prev")
    growth = F.when(prev.isNull(), 0.0).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    return with_previous(df, keys, ts, tie, {value: "_prev"}).withColumn(out, growth).drop("_prev")


def align_delta(df: DataFrame, *, keys: Sequence[str], period: int, ts: str = "timestamp", tie: str = "seq", value: str = "value") -> DataFrame:
    """Counter increase per series and period."""
    grown = with_increase(df, keys=keys, ts=ts, tie=tie, value=value)
    return grown.groupBy(*keys, floor_to(ts, period).alias(ts)).agg(F.sum("increase").alias(value))


def align_rate(df: DataFrame, *, keys: Sequence[str], period: int, ts: str = "timestamp", tie: str = "seq", value: str = "value") -> DataFrame:
    """Counter increase per second, per series and period."""
    delta = align_delta(df, keys=keys, period=period, ts=ts, tie=tie, value=value)
    return delta.withColumn(value, F.col(value) / F.lit(float(period)))


def training_aligner(metric: str | Column, table: Mapping[str, str] = TRAINING_ALIGNERS) -> Column:
    """Aligner of a metric in the training path: from the table, else the mean."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, col(metric)), F.lit("ALIGN_MEAN"))


def collection_aligner(metric: str | Column, fragments: Sequence[str] = GAUGE_FRAGMENTS) -> Column:
    """Aligner in the collection path: mean where the name marks a gauge, else the rate."""
    is_gauge = reduce(lambda a, b: a | b, [F.contains(col(metric), F.lit(f)) for f in fragments])
    return F.when(is_gauge, "ALIGN_MEAN").otherwise("ALIGN_RATE")


def align_by_metric(
    df: DataFrame, aligner: Column, *, keys: Sequence[str], period: int, ts: str = "timestamp", tie: str = "seq", value: str = "value"
) -> DataFrame:
    """Align every series with its own aligner in one pass over the samples."""
    grown = with_increase(df, keys=keys, ts=ts, tie=tie, value=value).withColumn("aligner", aligner)
    facts = grown.groupBy(*keys, "aligner", floor_to(ts, period).alias(ts)).agg(
        F.avg(value).alias("_mean"), F.sum("increase").alias("_delta")
    )
    chosen = (
        F.when(F.col("aligner") == "ALIGN_RATE", F.col("_delta") / F.lit(float(period)))
        .when(F.col("aligner") == "ALIGN_DELTA", F.col("_delta"))
        .otherwise(F.col("_mean"))
    )
    return facts.withColumn(value, chosen).drop("_mean", "_delta")


def reduce_mean(df: DataFrame, *, by: Sequence[str] = (), ts: str = "timestamp", value: str = "value") -> DataFrame:
    """Mean over the series present at each time, per group where ``by`` is given."""
    return df.groupBy(*by, ts).agg(F.avg(value).alias(value))


def _bucket_mean(df, bucket, columns, keys, ts):
    names = columns or [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint") and c not in keys]
    return df.groupBy(*keys, bucket.alias(ts)).agg(*[F.avg(c).alias(c) for c in names])


def floor_mean(df: DataFrame, *, period: int = 300, columns: Sequence[str] | None = None, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Mean of the numeric columns per bucket, times rounded down."""
    return _bucket_mean(df, floor_to(ts, period), columns, keys, ts)


def round_mean(df: DataFrame, *, period: int = 300, columns: Sequence[str] | None = None, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Mean of the numeric columns per bucket, times rounded to the nearest bucket (ties to even)."""
    return _bucket_mean(df, round_half_even_to(ts, period), columns, keys, ts)


def merge_metrics(df: DataFrame, columns: Mapping[str, str], *, keys: Sequence[str] = (), ts: str = "timestamp", name: str = "name", value: str = "value") -> DataFrame:
    """Long to wide: one row per time, one column per listed metric, in one shuffle.

    ``columns`` maps metric -> column, so no job is needed to find the pivot values, and metrics not
    listed are filtered at the scan.
    """
    rows = df.where(F.col(name).isin(list(columns)))
    return rows.groupBy(*keys, ts).agg(
        *[F.avg(F.when(F.col(name) == m, F.col(value))).alias(c) for m, c in columns.items()]
    )


def merge_frames(frames: Sequence[DataFrame], on: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Full outer join of frames of different kinds on time (and series group)."""
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), frames)


def metric_family(df: DataFrame, family: Mapping[str, str], *, keys: Sequence[str] = (), ts: str = "timestamp", name: str = "name", value: str = "value") -> DataFrame:
    """The wide frame of a metric family: mean over its series, then one column per metric."""
    return merge_metrics(df, family, keys=keys, ts=ts, name=name, value=value)


def to_mebibytes(value: str | Column) -> Column:
    return col(value) / F.lit(1048576.0)


def select_series(df: DataFrame, *, labels: Mapping[str, str] | None = None, start=None, end=None, ts: str = "timestamp", labels_col: str = "labels") -> DataFrame:
    """Rows whose labels all match and whose time lies in [start, end]."""
    out = df
    for key, wanted in (labels or {}).items():
        have = F.col(key) if key in df.columns else F.col(labels_col)[key]
        out = out.where(have == wanted)
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(ts) <= F.lit(end))
    return out
