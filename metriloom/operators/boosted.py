"""Boosted-tree forecasters and residual detectors.

One model over all rows is fitted by Spark ML, distributed over rows. One model per series is grown in the task
that holds the series (``trees.grow``), so that all series are fitted in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metriloom.operators.features import lookback_features, lookback_names, ordered_split, random_split
from metriloom.operators.forecast import MAX_PERIODS
from metriloom.operators.scale import exact_percentile, join_small, newest_per_key
from metriloom.operators.trees import ENSEMBLE, TreeEnsemble, from_pipeline, grow
from metriloom.session import small_batches, written

MODEL = [f.name for f in fields(TreeEnsemble)]


def _pipeline(features: Sequence[str], target: str, trees: int, depth: int, rate: float, seed: int) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            GBTRegressor(
                featuresCol="_scaled", labelCol=target, predictionCol="prediction", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed,
            ),
        ]
    )


def _predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_raw", "_scaled")


@dataclass
class Forecaster:
    """A fitted forecaster; ``evaluation`` is one row with errors and sample counts."""

    model: PipelineModel
    evaluation: DataFrame
    lookback: int


def boosted_forecaster_train(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", lookback: int = 12, trees: int = 100, depth: int = 5,
    rate: float = 0.1, seed: int = 42,
) -> Forecaster:
    """Fit on the first 80 % of each series' lookback rows; score both parts.

    One model is fitted over all series given; the fit is distributed over rows.
    """
    rows = lookback_features(df, value, keys=keys, lookback=lookback, ts=ts)
    split = ordered_split(rows, keys=keys, ratio=0.8, ts=ts, aligned=True).dropna(subset=[*lookback_names(lookback), "target"])
    split = written(split.select(*keys, ts, *lookback_names(lookback), "target", "is_train"), "lookback")
    model = _pipeline(lookback_names(lookback), "target", trees, depth, rate, seed).fit(split.where("is_train"))
    error = (F.col("target") - F.col("prediction")) ** 2
    train = F.col("is_train")
    evaluation = _predicted(model, split).agg(
        F.avg(F.when(train, error)).alias("train_mse"),
        F.avg(F.when(~train, error)).alias("test_mse"),
        F.var_pop(F.when(train, F.col("target"))).alias("train_variance"),
        F.count_if(train).alias("train_samples"),
        F.count_if(~train).alias("test_samples"),
    )
    return Forecaster(model, evaluation, lookback)


@dataclass
class SeriesForecasters:
    """One forecaster per series: ``models`` has the keys and the columns of ``trees.ENSEMBLE``; ``evaluation`` has
    the errors and sample counts of each series."""

    models: DataFrame
    evaluation: DataFrame
    lookback: int


def _field_types(df: DataFrame, keys: Sequence[str], more: str) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(more).fields])


def boosted_forecasters_train(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", lookback: int = 12, trees: int = 100, depth: int = 5, rate: float = 0.1,
) -> SeriesForecasters:
    """A forecaster of each series' own, fitted on the first 80 % of its lookback rows and scored on both parts.

    Spark deals the series over tasks and each is grown where its rows are. The frame is aligned, so a series has
    at most span / period rows. A series without a complete lookback row has no model.
    """
    names = lookback_names(lookback)
    rows = lookback_features(df, value, keys=keys, lookback=lookback, ts=ts)
    split = ordered_split(rows, keys=keys, ratio=0.8, ts=ts, aligned=True).dropna(subset=[*names, "target"])
    scores = "train_mse double, test_mse double, train_variance double, train_samples long, test_samples long"

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, train = pdf[names].to_numpy(float), pdf["target"].to_numpy(float), pdf["is_train"].to_numpy(bool)
        if not train.any():
            return pd.DataFrame()
        order = np.argsort(pdf[ts].to_numpy(), kind="stable")  # sums do not depend on how the rows came
        x, y, train = x[order], y[order], train[order]
        model = grow(x[train], y[train], names, trees=trees, depth=depth, rate=rate)
        error = (y - model.predict(x)) ** 2
        test = error[~train].mean() if (~train).any() else None
        return pd.DataFrame([{**dict(zip(keys, key)), **model.row(), "train_mse": error[train].mean(), "test_mse": test,
                              "train_variance": y[train].var(), "train_samples": train.sum(), "test_samples": (~train).sum()}])

    schema = _field_types(df, keys, f"{ENSEMBLE}, {scores}")
    fitted = written(split.select(*keys, ts, *names, "target", "is_train").groupBy(*keys).applyInPandas(fit, schema), "forecasters")
    numbers = T.StructType.fromDDL(scores).names
    return SeriesForecasters(fitted.drop(*numbers), fitted.select(*keys, *numbers), lookback)


def _last_values(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, size: int) -> DataFrame:
    """The last ``size`` values of each series in time order, as ``_h``."""
    newest = newest_per_key(df.where(F.col(value).isNotNull()), keys, order, size, "_rk")
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("_rk")).alias("o"), F.col(value).cast("double").alias("v"))))
    return newest.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias("_h"))


def _unrolled(model: TreeEnsemble, held: np.ndarray, periods: int, lookback: int, clamp, calendar) -> np.ndarray:
    """Predictions of all steps for rows of last values, each step fed back into the lags."""
    out = np.empty((len(held), periods))
    for step in range(periods):
        lags = held[:, :lookback]
        facts = [lags.mean(axis=1), lags.std(axis=1), lags.min(axis=1), lags.max(axis=1), *(np.full(len(held), c) for c in calendar)]
        guess = model.predict(np.column_stack([lags, *facts]))
        out[:, step] = np.clip(guess, *clamp) if clamp else guess
        held = np.column_stack([held[:, 1:], out[:, step]])
    return out


def recursive_forecast(
    df: DataFrame, forecaster: Forecaster | SeriesForecasters | None, periods: int = 12, *, keys: Sequence[str], ts: str = "timestamp", tie: str | None = None,
    value: str = "value", target_lead: int = 1, clamp: tuple[float, float] | None = (0.0, 1.0), calendar: Sequence[float] = (0.5, 0.5, 1.0, 0.0),
) -> DataFrame:
    """Feed each prediction back into the lags of its series; one row per series and step.

    The state is one row per series holding its last values as an array. All steps of a batch of series run
    in one task, on the trees as flat arrays: those of the one model, or of each series' own. Series shorter than
    the lookback or without a model (or all without a forecaster) are flat at the last value, 0.5 if none.
    """
    if not 1 <= periods <= MAX_PERIODS:
        raise ValueError(f"periods must be between 1 and {MAX_PERIODS}")
    lookback = forecaster.lookback if forecaster else 12
    size = lookback + target_lead - 1
    state = _last_values(df, keys, [F.desc(ts), *([F.desc(tie)] if tie else [])], value, size)
    shared = trees_of(df.sparkSession, forecaster) if isinstance(forecaster, Forecaster) else None
    if isinstance(forecaster, SeriesForecasters):
        small_batches(df.sparkSession)
        state = join_small(state, forecaster.models, keys)
        without = _last_values(df, keys, [F.desc(ts), *([F.desc(tie)] if tie else [])], value, size).join(forecaster.models.select(*keys), list(keys), "left_anti")
    full = F.size("_h") >= size
    last = F.coalesce(F.try_element_at("_h", F.lit(-1)), F.lit(0.5))
    kept = [*keys, "_h"]
    flat = state.where(~full).select(*kept) if forecaster else state
    if isinstance(forecaster, SeriesForecasters):
        flat = flat.unionByName(without)
    flat = flat.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"), last.alias("value"))
    if not forecaster:
        return flat
    schema = _field_types(df, keys, "value array<double>")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(len(keys)).flatten().to_numpy().reshape(batch.num_rows, size)
            if shared is not None:
                out = _unrolled(shared, held, periods, lookback, clamp, calendar)
            else:
                own = (TreeEnsemble.of({c: batch.column(c)[i].as_py() for c in MODEL}) for i in range(batch.num_rows))
                out = np.concatenate([_unrolled(m, held[i : i + 1], periods, lookback, clamp, calendar) for i, m in enumerate(own)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out.tolist(), pa.list_(pa.float64()))], names=[*keys, "value"])

    ready = state.where(full).select(*kept, *(MODEL if shared is None else []))
    found = ready.mapInArrow(run, schema).select(*keys, F.posexplode("value").alias("_p", "value"))
    return found.select(*keys, (F.col("_p") + 1).alias("step"), "value").unionByName(flat)


def next_values(df: DataFrame, forecasters: SeriesForecasters, *, keys: Sequence[str], ts: str = "timestamp", value: str = "value", calendar: Sequence[float] = (0.5, 0.5, 1.0, 0.0)) -> DataFrame:
    """``next`` of each series with a forecaster and a whole lookback: the prediction for the row after its newest."""
    lookback, names = forecasters.lookback, lookback_names(forecasters.lookback)
    state = _last_values(df, keys, [F.desc(ts)], value, lookback).where(F.size("_h") == lookback)
    lags = [F.col("_h")[i] for i in range(lookback)]
    mean = F.aggregate("_h", F.lit(0.0), lambda a, x: a + x) / lookback
    spread = F.sqrt(F.aggregate("_h", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / lookback)
    inputs = [*lags, mean, spread, F.array_min("_h"), F.array_max("_h"), *[F.lit(float(c)) for c in calendar]]
    rows = state.select(*keys, *[c.alias(n) for c, n in zip(inputs, names)])
    schema = T.StructType([*rows.schema.fields, T.StructField("next", T.DoubleType())])

    def predict(pdf: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(models):
            return pd.DataFrame()
        return pdf.assign(next=TreeEnsemble.of(models.iloc[0]).predict(pdf[names].to_numpy(float)))

    return rows.groupBy(*keys).cogroup(forecasters.models.groupBy(*keys)).applyInPandas(predict, schema).select(*keys, "next")


def trees_of(spark: SparkSession, forecaster: Forecaster) -> TreeEnsemble:
    """The trees of a forecaster as flat arrays; they predict what the fitted pipeline predicts."""
    return from_pipeline(spark, forecaster.model, lookback_names(forecaster.lookback))


@dataclass
class ResidualDetector:
    """A fitted residual detector with its threshold and feature names."""

    model: PipelineModel
    threshold: float
    features: list[str]
    target: str


def residual_detector_fit(
    df: DataFrame, target: str, features: Sequence[str], *, split_key: str, sigma: float = 2.5, contamination: float = 0.05, trees: int = 100,
    depth: int = 6, rate: float = 0.1, seed: int = 42,
) -> ResidualDetector:
    """Regress the target on the features; the threshold is the higher of mean + sigma deviations and
    the top-``contamination`` percentile of the absolute errors over all rows.

    Rows with a NULL are left out. One row in five (by ``split_key``) is held out of the fit.
    """
    clean = written(df.dropna(subset=[*features, target]), "clean")  # read by the fit and by the errors
    model = _pipeline(features, target, trees, depth, rate, seed).fit(random_split(clean, split_key).where("is_train").drop("is_train"))
    errors = written(_predicted(model, clean).select(F.abs(F.col(target) - F.col("prediction")).alias("e")), "errors")
    stats = errors.agg(F.avg("e").alias("m"), F.stddev_pop("e").alias("s")).first()
    cut = exact_percentile(errors, "e", 1 - contamination)
    return ResidualDetector(model, max(stats["m"] + sigma * stats["s"], cut), list(features), target)


def residual_detector_score(df: DataFrame, detector: ResidualDetector) -> DataFrame:
    """Absolute residual and flag of every row without NULLs."""
    clean = df.dropna(subset=[*detector.features, detector.target])
    score = F.abs(F.col(detector.target) - F.col("prediction"))
    return _predicted(detector.model, clean).withColumn("score", score).withColumn("flag", F.col("score") > detector.threshold)


def feature_importance(detector: ResidualDetector, spark, n: int | None = None) -> DataFrame:
    """Features by importance, largest first; one row per model input."""
    weights = detector.model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(detector.features, (float(w) for w in weights)), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame([(f, w, i + 1) for i, (f, w) in enumerate(rows)], "feature string, importance double, rank int")


@dataclass
class SeriesDetectors:
    """One residual detector per series: ``models`` has the keys, the columns of ``trees.ENSEMBLE``, ``threshold``,
    ``percentile`` and the number of rows."""

    models: DataFrame
    features: list[str]
    target: str


def residual_detectors_fit(
    df: DataFrame, target: str, features: Sequence[str], *, keys: Sequence[str], split_key: str, sigma: float = 2.5, contamination: float = 0.05,
    trees: int = 100, depth: int = 6, rate: float = 0.1, penalty: float = 1.0,
) -> SeriesDetectors:
    """A residual detector of each series' own, as ``residual_detector_fit`` makes one for a whole frame.

    The frame is aligned, so a series has at most span / period rows; each is fitted in the task that holds it.
    """
    features = list(features)
    clean = random_split(df.dropna(subset=[*features, target]), split_key)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order", kind="stable")
        x, y, train = pdf[features].to_numpy(float), pdf[target].to_numpy(float), pdf["is_train"].to_numpy(bool)
        if not train.any():
            return pd.DataFrame()
        model = grow(x[train], y[train], features, trees=trees, depth=depth, rate=rate, penalty=penalty)
        errors = np.abs(y - model.predict(x))
        percentile = float(np.percentile(errors, (1 - contamination) * 100))
        threshold = max(float(errors.mean() + sigma * errors.std()), percentile)
        return pd.DataFrame([{**dict(zip(keys, key)), **model.row(), "threshold": threshold, "percentile": percentile, "rows": len(y)}])

    inputs = clean.select(*keys, F.col(split_key).alias("_order"), *features, target, "is_train")
    schema = _field_types(df, keys, f"{ENSEMBLE}, threshold double, percentile double, rows long")
    return SeriesDetectors(written(inputs.groupBy(*keys).applyInPandas(fit, schema), "detectors"), features, target)


def residual_detectors_score(df: DataFrame, detectors: SeriesDetectors, *, keys: Sequence[str]) -> DataFrame:
    """Prediction, absolute residual and flag of every row without NULLs whose series has a detector.

    Rows and models of a series meet by a cogroup; models stay one row per series.
    """
    clean = df.dropna(subset=[*detectors.features, detectors.target])
    schema = T.StructType([*clean.schema.fields, *T.StructType.fromDDL("prediction double, score double, flag boolean").fields])
    features, target = detectors.features, detectors.target

    def score(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(models):
            return pd.DataFrame()
        model = models.iloc[0]
        guess = TreeEnsemble.of(model).predict(rows[features].to_numpy(float))
        off = np.abs(rows[target].to_numpy(float) - guess)
        return rows.assign(prediction=guess, score=off, flag=off > model["threshold"])

    return clean.groupBy(*keys).cogroup(detectors.models.groupBy(*keys)).applyInPandas(score, schema)


def series_importance(detectors: SeriesDetectors, *, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Inputs of each series' detector by importance, largest first by ``rank``."""
    schema = _field_types(detectors.models, keys, "feature string, importance double, rank int")

    def rank(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                model = TreeEnsemble.of(row)
                best = sorted(zip(model.features, model.importance().tolist()), key=lambda r: (-r[1], r[0]))[:n]
                yield pd.DataFrame([{**{k: row[k] for k in keys}, "feature": f, "importance": w, "rank": i + 1} for i, (f, w) in enumerate(best)])

    small_batches(detectors.models.sparkSession)
    return detectors.models.select(*keys, *MODEL).mapInPandas(rank, schema)
