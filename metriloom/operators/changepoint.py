"""Seasonal forecast whose trend bends: piecewise-linear with candidate changepoints and an L1 penalty.

A series is a trend plus, or times one plus, Fourier terms of the day and the week. The trend is a line and a
hinge at each of ``CANDIDATES`` times spread evenly over the first 80 % of the fitted span; its bends carry a
Laplace prior, so most of them are exactly 0. All terms are linear given the trend's level, so a fit needs one
Gram matrix per series. It is summed in Spark: rows are dealt by (series, stretch of time), each task adds up
its rows, and only sums of a fixed size meet; a series of any length is never brought together.

Per series, coordinate descent on the Gram matrix (over the bends; line and Fourier terms follow from them by one
linear solve) alternates with the noise variance, which weighs the priors.
The band holds the noise and the bends still to come: as many per time as there are candidates, each as large
as the fitted ones on average, which gives a variance that grows with the cube of the horizon.

Null and non-finite values are left out; a series of fewer than two values has no fit. A seasonality needs two
whole periods in the span, or it is left out. The multiplicative mode fits twice: the second time the seasonal
columns are multiplied by the trend of the first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metriloom.functions.quantities import finite
from metriloom.functions.time import MICROS, add_seconds, micros
from metriloom.operators.features import ordered_split
from metriloom.operators.forecast import forecast_metrics, steps, z_of
from metriloom.operators.scale import join_small

# fixed values of the forecaster: candidates and the part of the history that they cover, scale of the bends'
# prior, Fourier orders of day and week, deviations of the priors of level and slope, and of the Fourier terms
CANDIDATES = 25
COVERED = 0.8
BEND_SCALE = 0.05
DAILY_ORDER, WEEKLY_ORDER = 4, 3
LINE_DEVIATION, FOURIER_DEVIATION = 5.0, 10.0

DAY, WEEK = 86_400 * MICROS, 7 * 86_400 * MICROS
#: rows of a series within this many microseconds are added up by one task
STRETCH = 30 * DAY
HINGES = [COVERED * k / CANDIDATES for k in range(1, CANDIDATES + 1)]
LINE, BENDS = slice(0, 2), slice(2, 2 + CANDIDATES)
DAILY = slice(2 + CANDIDATES, 2 + CANDIDATES + 2 * DAILY_ORDER)
WEEKLY = slice(DAILY.stop, DAILY.stop + 2 * WEEKLY_ORDER)
TERMS = WEEKLY.stop
UPPER = np.triu_indices(TERMS + 1)

SWEEPS, TRIES, ROUNDS = 5, 200, 30
#: series solved together: their matrices take some 20 MB
AT_ONCE = 256


def design(t: np.ndarray, day: np.ndarray, week: np.ndarray, level: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns of the terms and, last, the value. ``t`` is 0 to 1 over the span, day and week are phases."""
    out = np.empty((len(t), TERMS + 1))
    out[:, 0], out[:, 1], out[:, -1] = 1.0, t, y
    out[:, BENDS] = np.maximum(0.0, t[:, None] - np.array(HINGES))
    for part, phase, order in ((DAILY, day, DAILY_ORDER), (WEEKLY, week, WEEKLY_ORDER)):
        angle = 2 * np.pi * phase[:, None] * np.arange(1, order + 1)
        out[:, part] = np.concatenate([np.sin(angle), np.cos(angle)], axis=1) * level[:, None]
    return out


def _placed(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Values with their place in the span and their scale: ``_us, _y, _from, _span, _scale``."""
    rows = df.select(*keys, micros(ts).alias("_us"), finite(value).cast("double").alias("_y")).where("_us IS NOT NULL AND _y IS NOT NULL")
    spans = rows.groupBy(*keys).agg(
        F.min("_us").alias("_from"), F.max("_us").alias("_until"), F.max(F.abs("_y")).alias("_top"), F.count("*").alias("_n")
    ).where("_n >= 2")
    scaled = spans.select(*keys, "_from", F.greatest(F.col("_until") - F.col("_from"), F.lit(1)).alias("_span"), F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0).alias("_scale"))
    return join_small(rows, scaled, keys)


def _rows_of(placed: DataFrame, keys: Sequence[str], level: Column) -> DataFrame:
    """What the design needs, and the stretch of time a row is added up in."""
    phase = lambda size: F.pmod(F.col("_us"), F.lit(size)) / F.lit(float(size))
    return placed.select(
        *keys, ((F.col("_us") - F.col("_from")) / F.col("_span")).alias("_t"), phase(DAY).alias("_day"), phase(WEEK).alias("_week"),
        level.cast("double").alias("_level"), (F.col("_y") / F.col("_scale")).alias("_value"), "_from", "_span", "_scale",
        F.floor(F.col("_us") / F.lit(float(STRETCH))).alias("_stretch"),
    )


def design_rows(df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value") -> DataFrame:
    """Rows for ``gram_sums`` of a fit whose seasonal columns stand by themselves (additive)."""
    return _rows_of(_placed(df, keys, ts, value), keys, F.lit(1.0))


def gram_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series the upper triangle of the Gram matrix of terms and value (``gram``), with its span and scale."""
    kept = [*keys, "_from", "_span", "_scale"]
    sums = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("_gram", sums)])

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            number = pdf.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            x = design(*(pdf[c].to_numpy("float64")[order] for c in ("_t", "_day", "_week", "_level", "_value")))
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            parts = [(part.T @ part)[UPPER].tolist() for part in np.split(x, starts[1:])]
            heads = batch.select(kept).take(pa.array(order[starts]))
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(parts, pa.list_(pa.float64()))], schema=pa.schema([*heads.schema, pa.field("_gram", pa.list_(pa.float64()))]))

    parts = rows.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_t").mapInArrow(run, schema)
    add = F.aggregate(F.collect_list("_gram"), F.array_repeat(F.lit(0.0), len(UPPER[0])), lambda a, g: F.zip_with(a, g, lambda x, y: x + y))
    return parts.groupBy(*kept).agg(add.alias("gram"))


def _bent(inner: np.ndarray, against: np.ndarray, limit: np.ndarray, free: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Minimum of d'Ad/2 - c'd + limit * |d| for many series: coordinate descent, and steps on the bends it leaves.

    Neighbouring hinges are nearly alike, and descent alone creeps. So after a few sweeps the bends that are not
    0 are solved exactly for their signs, and the step goes there or to the first bend that reaches 0 on the way;
    both never raise the objective. A series is done when no bend that is 0 wants to leave it.
    """
    size = d.shape[1]
    diagonal = np.einsum("sjj->sj", inner)
    open_ = np.ones(len(d), dtype=bool)
    for _ in range(TRIES):
        some = np.flatnonzero(open_)
        if not len(some):
            break
        a, c, x, most = inner[some], against[some], d[some], limit[some]
        left = c - np.einsum("sij,sj->si", a, x)
        for _ in range(SWEEPS):
            for j in range(size):
                pull = left[:, j] + diagonal[some, j] * x[:, j]
                new = np.where(free[some, j], np.sign(pull) * np.maximum(np.abs(pull) - most, 0.0) / np.maximum(diagonal[some, j], 1e-300), 0.0)
                left -= a[:, :, j] * (new - x[:, j])[:, None]
                x[:, j] = new
        sign = np.sign(x)
        on = sign != 0
        system = a * (on[:, :, None] & on[:, None, :])
        system[:, np.arange(size), np.arange(size)] += np.where(on, 1e-12 * diagonal[some], 1.0)
        to = np.linalg.solve(system, np.where(on, c - most[:, None] * sign, 0.0)[:, :, None])[:, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(on & (to * sign < 0), x / (x - to), np.inf)
        least = np.minimum(share.min(axis=1), 1.0)
        x = np.where(share <= least[:, None], 0.0, x + least[:, None] * (to - x))
        left = c - np.einsum("sij,sj->si", a, x)
        done = (least >= 1.0) & (np.where(x == 0, np.abs(left) * free[some], 0.0).max(axis=1) <= most * (1 + 1e-6))
        d[some], open_[some] = x, ~done
    return d


def solve(grams: np.ndarray, spans: np.ndarray, bend_scale: float = BEND_SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and noise variance of many series at once, from their Gram matrices (series, terms + 1, terms + 1)."""
    a, c, yy = grams[:, :TERMS, :TERMS], grams[:, :TERMS, TERMS], grams[:, TERMS, TERMS]
    n = np.maximum(grams[:, 0, 0], 1.0)
    used = np.ones((len(grams), TERMS), dtype=bool)
    used[:, DAILY] = (spans >= 2 * DAY)[:, None]
    used[:, WEEKLY] = (spans >= 2 * WEEK)[:, None]
    used &= np.einsum("sjj->sj", a) > 1e-12
    a, c = a * used[:, :, None] * used[:, None, :], c * used
    bends = np.arange(BENDS.start, BENDS.stop)
    smooth = np.setdiff1d(np.arange(TERMS), bends)  # terms with a normal prior
    deviation = np.where(smooth < BENDS.start, LINE_DEVIATION, FOURIER_DEVIATION)
    across = a[:, smooth][:, :, bends]
    b = np.zeros((len(grams), TERMS))
    variance = np.maximum(yy / n, 1e-12)
    for _ in range(ROUNDS):
        # the smooth terms follow from the bends, so only the bends are searched, on what the others leave of them
        block = a[:, smooth][:, :, smooth].copy()
        at = np.arange(len(smooth))
        block[:, at, at] += np.where(used[:, smooth], variance[:, None] / deviation**2, 1.0)
        against = np.linalg.solve(block, np.concatenate([across, c[:, smooth, None]], axis=2))
        inner = a[:, bends][:, :, bends] - across.transpose(0, 2, 1) @ against[:, :, :-1]
        left = c[:, bends] - np.einsum("suh,su->sh", across, against[:, :, -1])
        diagonal = np.einsum("sjj->sj", inner).copy()
        free = diagonal > 1e-9 * np.maximum(n, 1)[:, None]
        limit = variance / bend_scale
        d = b[:, bends] * free
        d = _bent(inner, left, limit, free, d)
        b[:, bends] = d
        b[:, smooth] = against[:, :, -1] - np.einsum("suh,sh->su", against[:, :, :-1], d)
        rest = np.maximum((yy - 2 * np.einsum("sj,sj->s", b, c) + np.einsum("si,sij,sj->s", b, a, b)) / n, 1e-12)
        settled = np.allclose(rest, variance, rtol=1e-6)
        variance = rest
        if settled:
            break
    return b, variance


def _parameters(sums: DataFrame, keys: Sequence[str], mode: str, bend_scale: float) -> DataFrame:
    """One row per series; values are in units of the series' greatest value."""
    double = T.DoubleType()
    fields = [("line", T.ArrayType(double)), ("bends", T.ArrayType(double)), ("daily", T.ArrayType(double)), ("weekly", T.ArrayType(double)), ("variance", double), ("n_points", T.LongType())]
    kept = [*keys, "_from", "_span", "_scale"]
    schema = T.StructType([*[sums.schema[c] for c in kept], *[T.StructField(n, k) for n, k in fields]])

    def run(batches):
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            grams = np.zeros((batch.num_rows, TERMS + 1, TERMS + 1))
            grams[:, UPPER[0], UPPER[1]] = batch.column(len(kept)).flatten().to_numpy().reshape(batch.num_rows, -1)
            grams = grams + np.triu(grams, 1).transpose(0, 2, 1)
            b, variance = solve(grams, batch.column(len(keys) + 1).to_numpy(zero_copy_only=False), bend_scale)
            lists = [pa.array(b[:, part].tolist(), pa.list_(pa.float64())) for part in (LINE, BENDS, DAILY, WEEKLY)]
            arrays = [*batch.columns[: len(kept)], *lists, pa.array(variance), pa.array(np.rint(grams[:, 0, 0]).astype("int64"))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[n for n, _ in fields]])

    found = sums.select(*kept, "gram").mapInArrow(run, schema).withColumnsRenamed({"_from": "from_us", "_span": "span_us", "_scale": "scale"})
    return found.withColumn("mode", F.lit(mode)).withColumn("fitted_until", F.timestamp_micros(F.col("from_us") + F.col("span_us")).cast("timestamp_ntz"))


def _trend(us: Column) -> Column:
    """Trend at a time, in units of the scale, from the parameter columns."""
    t = (us - F.col("from_us")) / F.col("span_us")
    bends = F.aggregate(
        F.zip_with("bends", F.array(*[F.lit(h) for h in HINGES]), lambda b, h: b * F.greatest(F.lit(0.0), t - h)), F.lit(0.0), lambda a, x: a + x
    )
    return F.col("line")[0] + F.col("line")[1] * t + bends


def _wave(us: Column, terms: str, period: int, order: int) -> Column:
    """Fourier sum of a seasonality at a time."""
    phase = F.pmod(us, F.lit(period)) / F.lit(float(period)) * F.lit(2 * math.pi)
    out = F.lit(0.0)
    for k in range(order):
        out = out + F.col(terms)[k] * F.sin(phase * (k + 1)) + F.col(terms)[order + k] * F.cos(phase * (k + 1))
    return out


def changepoint_fit(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", mode: str = "multiplicative", bend_scale: float = BEND_SCALE
) -> DataFrame:
    """Parameters of each series of two values or more: line, bends, Fourier terms, variance, span and scale."""
    params = _parameters(gram_sums(design_rows(df, keys=keys, ts=ts, value=value), keys), keys, "additive", bend_scale)
    if mode == "additive":
        return params
    placed = _placed(df, keys, ts, value)
    leveled = join_small(placed, params.select(*keys, "from_us", "span_us", "line", "bends"), keys)
    return _parameters(gram_sums(_rows_of(leveled, keys, _trend(F.col("_us"))), keys), keys, mode, bend_scale)


def changepoint_values(df: DataFrame, *, ts: str = "timestamp", confidence: float = 0.95) -> DataFrame:
    """Add trend, components, value and band to rows that carry the parameters.

    A multiplicative component is a share of the trend.
    """
    us = micros(ts)
    additive = F.col("mode") == "additive"
    out = df.withColumns(
        {"trend": _trend(us) * F.col("scale"), "daily_component": _wave(us, "daily", DAY, DAILY_ORDER), "weekly_component": _wave(us, "weekly", WEEK, WEEKLY_ORDER)}
    )
    both = F.col("daily_component") + F.col("weekly_component")
    predicted = F.when(additive, F.col("trend") + both * F.col("scale")).otherwise(F.col("trend") * (1 + both))
    size = F.aggregate("bends", F.lit(0.0), lambda a, b: a + F.abs(b)) / CANDIDATES
    beyond = F.greatest(F.lit(0.0), (us - F.col("from_us") - F.col("span_us")) / F.col("span_us"))
    # a Laplace variable of mean size m has variance 2 m^2; a bend moves the trend by its size times the time since
    to_come = CANDIDATES * 2 * size * size * F.pow(beyond, 3) / 3
    margin = z_of(confidence) * F.col("scale") * F.sqrt(F.col("variance") + to_come)
    out = out.withColumn("predicted", predicted).withColumn("lower_bound", predicted - margin).withColumn("upper_bound", predicted + margin)
    return out.withColumns({c: F.when(additive, F.col(c) * F.col("scale")).otherwise(F.col(c)) for c in ("daily_component", "weekly_component")})


def changepoint_forecast(params: DataFrame, periods: int = 12, *, step_seconds: int = 300, confidence: float = 0.95) -> DataFrame:
    """Forecast ``periods`` steps beyond the last fitted time, with components."""
    future = steps(params, periods).withColumn("timestamp", add_seconds("fitted_until", F.col("step") * step_seconds))
    return changepoint_values(future, confidence=confidence)


def changepoint_evaluate(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", ratio: float = 0.8, mode: str = "multiplicative"
) -> DataFrame:
    """Fit the first part of each aligned series, score the rest: errors, coverage of the band, sizes."""
    split = ordered_split(df.where(F.col(value).isNotNull()), keys=keys, ratio=ratio, ts=ts, aligned=True)
    params = changepoint_fit(split.where("is_train"), keys=keys, ts=ts, value=value, mode=mode)
    test = split.where("NOT is_train").select(*keys, ts, F.col(value).alias("actual"))
    scored = changepoint_values(join_small(test, params, keys), ts=ts)
    errors = forecast_metrics(scored, by=[*keys, "n_points"])
    covered = F.avg(F.col("actual").between(F.col("lower_bound"), F.col("upper_bound")).cast("double")) * 100
    coverage = scored.groupBy(*keys).agg(covered.alias("coverage"))
    return errors.join(coverage, list(keys)).withColumnRenamed("n_points", "train_size").withColumnRenamed("n", "test_size")


def changepoint_components(params: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Mode, candidates, bends that are not 0 with their times and sizes, and the seasonalities fitted."""
    present = lambda c: F.exists(c, lambda x: x != 0)
    names = F.filter(F.array(F.when(present("daily"), "daily"), F.when(present("weekly"), "weekly")), lambda x: x.isNotNull())
    at = F.zip_with(
        "bends", F.array(*[F.lit(h) for h in HINGES]),
        lambda b, h: F.struct(F.timestamp_micros((F.col("from_us") + h * F.col("span_us")).cast("bigint")).cast("timestamp_ntz").alias("timestamp"), b.alias("bend")),
    )
    bent = F.filter(at, lambda x: F.abs(x["bend"]) > 1e-8)
    return params.select(
        *keys, "mode", F.lit(CANDIDATES).alias("n_candidates"), F.size(bent).alias("n_changepoints"), bent.alias("changepoints"), names.alias("seasonalities")
    )
