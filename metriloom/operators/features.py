"""Time-series features on aligned frames.

All row-shift windows run per series over an aligned frame (at most one row per period), share one
partitioning and order, and are written into one projection, so a frame is shuffled and sorted once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.operators.scale import attach_row, join_small, numbered

# fixed values: default lags, windows and change periods
LAGS = (1, 2, 3, 6, 12)
ROLLING = (3, 6, 12)
CHANGES = (1, 3, 6)
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def series_window(keys: Sequence[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def known(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The listed columns that exist; unknown names are skipped."""
    return [c for c in columns if c in df.columns]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, kind in df.dtypes if (kind in NUMERIC or kind.startswith("decimal")) and c not in exclude]


def time_feature_columns(ts: str) -> dict[str, Column]:
    hour, dow = F.hour(ts), F.weekday(ts)
    turn = 2 * math.pi
    return {
        "hour": hour,
        "hour_sin": F.sin(turn * hour / 24),
        "hour_cos": F.cos(turn * hour / 24),
        "day_of_week": dow,
        "dow_sin": F.sin(turn * dow / 7),
        "dow_cos": F.cos(turn * dow / 7),
        "is_weekend": (dow >= 5).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
        "minute_of_day": hour * 60 + F.minute(ts),
    }


def lag_columns(columns, w, lags=LAGS) -> dict[str, Column]:
    return {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in columns for n in lags}


def rolling_columns(columns, w, windows=ROLLING) -> dict[str, Column]:
    out = {}
    for c in columns:
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            full = F.count(c).over(frame) == n
            for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                out[f"{c}_roll_{name}_{n}"] = F.when(full, fn(c).over(frame))
    return out


def diff_columns(columns, w, periods=CHANGES) -> dict[str, Column]:
    return {f"{c}_diff_{n}": F.col(c) - F.lag(c, n).over(w) for c in columns for n in periods}


def pct_change_columns(columns, w, periods=CHANGES) -> dict[str, Column]:
    """Relative change of the forward-filled column (held in ``_ff_<column>``)."""
    return {f"{c}_pct_change_{n}": F.try_divide(F.col(f"_ff_{c}"), F.lag(f"_ff_{c}", n).over(w)) - 1 for c in columns for n in periods}


def forward_filled(df: DataFrame, columns, w) -> DataFrame:
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"_ff_{c}": F.last(c, ignorenulls=True).over(upto) for c in columns})


def time_features(df: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(time_feature_columns(ts))


def lag_features(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str], lags: Sequence[int] = LAGS, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(lag_columns(known(df, columns), series_window(keys, ts), lags))


def rolling_features(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str], windows: Sequence[int] = ROLLING, ts: str = "timestamp") -> DataFrame:
    """Trailing mean, sample deviation, min and max; NULL until the window holds only values."""
    return df.withColumns(rolling_columns(known(df, columns), series_window(keys, ts), windows))


def pct_change(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str], periods: Sequence[int] = CHANGES, ts: str = "timestamp") -> DataFrame:
    """Relative change after forward fill; a zero base gives NULL."""
    w, cols = series_window(keys, ts), known(df, columns)
    out = forward_filled(df, cols, w).withColumns(pct_change_columns([c for c in cols], w, periods))
    return out.drop(*[f"_ff_{c}" for c in cols])


def diff(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str], periods: Sequence[int] = CHANGES, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(diff_columns(known(df, columns), series_window(keys, ts), periods))


def transform(df: DataFrame, targets: Sequence[str] | None = None, *, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """9 calendar columns and 23 columns per target (default: every numeric column)."""
    cols = known(df, targets) if targets is not None else numeric_columns(df, exclude=keys)
    w = series_window(keys, ts)
    filled = forward_filled(df, cols, w)
    out = filled.withColumns(
        {
            **time_feature_columns(ts),
            **lag_columns(cols, w),
            **rolling_columns(cols, w),
            **pct_change_columns(cols, w),
            **diff_columns(cols, w),
        }
    )
    return out.drop(*[f"_ff_{c}" for c in cols])


def prepare_for_training(df: DataFrame, target: str, *, keep: Sequence[str] = (), ts: str = "timestamp", drop_na: bool = True) -> DataFrame:
    """Numeric feature columns and the target, without rows that hold a NULL."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the frame")
    features = numeric_columns(df, exclude=(*keep, ts, target))
    out = df.select(*keep, *features, target)
    return out.dropna(subset=[*features, target]) if drop_na else out


def lookback_features(df: DataFrame, value: str, *, keys: Sequence[str], lookback: int = 12, ts: str = "timestamp", target_lead: int = 1) -> DataFrame:
    """``lookback`` lags, their statistics, scaled calendar columns and the target after the current row.

    ``lag_1`` is the newest lag. Only rows with a full set of lags and an existing target row remain.
    """
    w = series_window(keys, ts)
    frame = w.rowsBetween(-lookback, -1)
    hour, dow = F.hour(ts), F.weekday(ts)
    out = df.select(
        *keys,
        ts,
        *[F.lag(value, n).over(w).alias(f"lag_{n}") for n in range(lookback, 0, -1)],
        F.avg(value).over(frame).alias("roll_mean"),
        F.stddev_pop(value).over(frame).alias("roll_std"),
        F.min(value).over(frame).alias("roll_min"),
        F.max(value).over(frame).alias("roll_max"),
        (hour / 24).alias("hour_part"),
        (dow / 7).alias("dow_part"),
        hour.between(9, 17).cast("double").alias("is_business_hours"),
        (dow >= 5).cast("double").alias("is_weekend"),
        F.lead(value, target_lead).over(w).alias("target"),
        F.row_number().over(w).alias("_rn"),
        F.lead(F.lit(1), target_lead).over(w).alias("_has_target"),
    )
    return out.where((F.col("_rn") > lookback) & F.col("_has_target").isNotNull()).drop("_rn", "_has_target")


def lookback_names(lookback: int = 12) -> list[str]:
    """Feature columns of :func:`lookback_features` in model order."""
    return [
        *[f"lag_{n}" for n in range(lookback, 0, -1)],
        "roll_mean", "roll_std", "roll_min", "roll_max", "hour_part", "dow_part", "is_business_hours", "is_weekend",
    ]


def ordered_split(
    df: DataFrame, *, keys: Sequence[str], ratio: float | None = None, ts: str = "timestamp", tie: str | None = None, aligned: bool = False
) -> DataFrame:
    """Mark the first part of each series as train (``is_train``), with ``row_index`` and ``series_rows``.

    Without a ratio it is 60 % for series under 50 rows and 80 % otherwise. On ``aligned`` frames one
    window per series does it; raw samples are numbered in time chunks.
    """
    if aligned:
        w = Window.partitionBy(*keys)
        placed = df.withColumn("row_index", F.row_number().over(w.orderBy(ts))).withColumn("series_rows", F.count("*").over(w))
    else:
        placed = numbered(df, keys, ts, tie or ts)
    share = F.lit(ratio) if ratio is not None else F.when(F.col("series_rows") < 50, 0.6).otherwise(0.8)
    return placed.withColumn("is_train", F.col("row_index") <= F.floor(F.col("series_rows") * share))


def random_split(df: DataFrame, key: str, *, folds: int = 5) -> DataFrame:
    """Repeatable 80/20 split: one row in ``folds`` is held out by its key, whatever the partitioning."""
    kind = dict(df.dtypes)[key]
    number = F.col(key) if kind in ("int", "bigint") else F.xxhash64(key)
    return df.withColumn("is_train", F.pmod(number, F.lit(folds)) != 0)


def standard_scale(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population deviation, in place; a constant column keeps scale 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    placed = join_small(df, df.groupBy(*keys).agg(*aggs), keys) if keys else attach_row(df, df.agg(*aggs))
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns
    }
    return placed.withColumns(scaled).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def domain_features(
    df: DataFrame, *, keys: Sequence[str], users: str, waiting: str, running: str, utilization: str, ts: str = "timestamp",
    rolling_hours: Mapping[str, int] | None = None,
) -> DataFrame:
    """Peak hour, time-range means of the user count, queue pressure and headroom."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    by_time = Window.partitionBy(*keys).orderBy(seconds)
    out = df.withColumn("is_peak_hour", F.hour(ts).between(18, 23).cast("int"))
    for name, hours in (rolling_hours or {"1h": 1, "24h": 24}).items():
        # the range is open on the left, as in a trailing time window of that length
        out = out.withColumn(f"{users}_rolling_{name}", F.avg(users).over(by_time.rangeBetween(-hours * 3600 + 1, 0)))
    return out.withColumn("queue_pressure", F.col(waiting) / F.greatest(F.col(running), F.lit(1.0))).withColumn(
        "headroom", 1 - F.col(utilization)
    )
