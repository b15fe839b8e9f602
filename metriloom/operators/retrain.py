"""Retraining as a batch job: gates, training, champion and challenger, run log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriloom.operators import boosted, features, forecast, model_store, seasonal
from metriloom.operators.scale import newest_per_key
from metriloom.schemas import TARGET_CANDIDATES
from metriloom.session import written

# fixed values: gates of the job
MIN_POINTS = 100
MIN_IMPROVEMENT = 0.05


def gates(frame: DataFrame, *, keys: Sequence[str], min_points: int = MIN_POINTS, wanted: DataFrame | None = None) -> DataFrame:
    """Per series: number of points, ready or skipped, and why. ``wanted`` lists series that must appear."""
    counts = frame.groupBy(*keys).agg(F.count("*").alias("data_points"))
    if wanted is not None:
        counts = wanted.join(counts, list(keys), "left").fillna(0, ["data_points"])
    n = F.col("data_points")
    error = F.when(n == 0, "No data returned from monitoring platform").when(
        n < min_points, F.format_string(f"Insufficient data: got %d, need {min_points}", n)
    )
    return counts.withColumn("status", F.when(n >= min_points, "ready").otherwise("skipped")).withColumn("error", error)


def choose_target(df: DataFrame, candidates: Sequence[str] = TARGET_CANDIDATES) -> str:
    """First candidate present, else the first numeric column."""
    numeric = features.numeric_columns(df)
    for c in candidates:
        if c in numeric:
            return c
    if not numeric:
        raise ValueError("no numeric target column")
    return numeric[0]


def train_all(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", target: str | None = None, trees: int = 100, min_points: int = MIN_POINTS,
    fitted_models: dict | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """Baseline, seasonal forecaster and residual detector on one frame.

    Returns rows (keys, model, metrics) and, per failed model, its error; one failing model does not
    stop the others. All three are fitted and scored per series. With ``fitted_models`` the models that were
    trained, fitted on all rows, are put there by name.
    """
    target = target or choose_target(df.drop(*keys))
    passed = gates(df, keys=keys, min_points=min_points).where("status = 'ready'").select(*keys)
    frame = written(df.join(passed, list(keys), "left_semi"), "training")  # read by every model
    series = frame.select(*keys, ts, F.col(target).alias("value"))

    def metrics(*names: str):
        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))

    def keep(name: str, make: Callable) -> None:
        if fitted_models is not None:
            fitted_models[name] = make()

    def baseline() -> DataFrame:
        scored = forecast.train_baseline(series, keys=keys, ts=ts)
        keep("baseline", lambda: written(forecast.baseline_fit(series, keys=keys, ts=ts), "baseline"))
        return scored.select(*keys, metrics("rmse", "mae", "mape", "skill_score").alias("metrics"))

    def seasonal_model() -> DataFrame:
        scored = seasonal.seasonal_evaluate(series, keys=keys, ts=ts)
        keep("seasonal", lambda: written(seasonal.seasonal_fit(series, keys=keys, ts=ts), "seasonal"))
        return scored.select(*keys, metrics("rmse", "mae", "mape", "coverage").alias("metrics"))

    def detector() -> DataFrame:
        wide = written(features.transform(frame, keys=keys, ts=ts).withColumn("_key", F.xxhash64(*keys, ts)), "wide")
        inputs = features.numeric_columns(wide, exclude=[*keys, target, "_key"])
        fitted = boosted.residual_detectors_fit(wide, target, inputs, keys=keys, split_key="_key", trees=trees)
        scored = boosted.residual_detectors_score(wide, fitted, keys=keys).groupBy(*keys).agg(
            F.count_if("flag").alias("anomalies"), F.avg(F.col("flag").cast("double")).alias("anomaly_rate"), F.avg("score").alias("mean_error")
        )
        out = scored.join(fitted.models.select(*keys, "threshold"), list(keys))
        keep("residual_detector", lambda: fitted)
        return out.select(*keys, metrics("threshold", "mean_error", "anomalies", "anomaly_rate").alias("metrics"))

    models: dict[str, Callable[[], DataFrame]] = {"baseline": baseline, "seasonal": seasonal_model, "residual_detector": detector}
    done, failed = None, {}
    for name, fit in models.items():
        try:
            # written here, as a lazy failure would show only later and take the other models with it
            part = written(fit().withColumn("model", F.lit(name)).select(*keys, "model", "metrics"), "trained")
        except Exception as error:  # the other models still train
            if fitted_models is not None:
                fitted_models.pop(name, None)
            failed[name] = str(error).splitlines()[0] if str(error) else type(error).__name__
            continue
        done = part if done is None else done.unionByName(part)
    if done is None:
        raise RuntimeError(f"no model could be trained: {failed}")
    return done, failed


def champion_challenger(challenger: DataFrame, champion: DataFrame, *, keys: Sequence[str], error: str = "rmse", min_improvement: float = MIN_IMPROVEMENT) -> DataFrame:
    """Deploy where there is no champion, no comparable error, or the error falls by the needed share."""
    old = champion.select(*keys, F.col(error).alias("_old"))
    joined = challenger.join(old, list(keys), "left")
    gain = F.try_divide(F.col("_old") - F.col(error), F.col("_old"))
    out = joined.withColumn("improvement", F.coalesce(gain, F.when(F.col("_old").isNotNull() & F.col(error).isNotNull(), 1.0)))
    open_gate = F.col("_old").isNull() | F.col(error).isNull() | (F.col(error) == 0)
    return out.withColumn("deployed", open_gate | F.coalesce(F.col("improvement") >= min_improvement, F.lit(False))).withColumnRenamed(
        "_old", f"champion_{error}"
    )


def run_history(runs: DataFrame, limit: int = 10, *, keys: Sequence[str], order: Sequence[str] = ("started_at",)) -> DataFrame:
    """The newest runs of each series, newest first by ``rank``."""
    return newest_per_key(runs, keys, [F.desc(c) for c in order], limit)


def run_status(runs: DataFrame, *, keys: Sequence[str], order: str = "started_at") -> DataFrame:
    """Per series: number of runs and the newest one."""
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.count("*").alias("total_runs"), F.max_by(F.struct(*rest), order).alias("_r")).select(
        *keys, "total_runs", "_r.*"
    )


def model_registry(models: DataFrame, *, key: str = "model", version: str = "version") -> DataFrame:
    """The newest version of each model with all it carries."""
    rest = [c for c in models.columns if c != key]
    return models.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


def retrain_job(
    df: DataFrame, *, keys: Sequence[str], store: str, log: str, run_id: str, version: int, started_at: datetime, ts: str = "timestamp",
    target: str | None = None, trees: int = 100, min_points: int = MIN_POINTS, min_improvement: float = MIN_IMPROVEMENT, error: str = "rmse",
    compared: str = "seasonal",
) -> DataFrame:
    """One run: gates, training, comparison with the stored version, storing, and one log row per series.

    The new models become version ``version`` if some series may be deployed: it has no stored error of ``compared``
    yet, or the error falls by the needed share. A run that fails is logged with its error. Running again under the
    same ``run_id`` replaces the log rows and, if it got that far, the version.
    """
    spark = df.sparkSession
    checked = written(gates(df, keys=keys, min_points=min_points), "gates")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    empty = F.create_map().cast("map<string,double>")

    def logged(rows: DataFrame, status, deployed, why, metrics=empty) -> DataFrame:
        return rows.select(
            name.alias("series"), F.lit(version).alias("version"), F.lit(started_at).alias("started_at"), status.alias("status"), "data_points",
            metrics.alias("metrics"), deployed.alias("deployed"), why.alias("error"),
        )

    fitted: dict = {}
    no = F.lit(False)
    try:
        rows, failed = train_all(df, keys=keys, ts=ts, target=target, trees=trees, min_points=min_points, fitted_models=fitted)
        flat = rows.groupBy(*keys).agg(
            F.map_from_entries(F.flatten(F.collect_list(F.transform(F.map_entries("metrics"), lambda e: F.struct(F.concat("model", F.lit("."), e["key"]).alias("key"), e["value"].alias("value")))))).alias("_metrics")
        )
        new = rows.where(F.col("model") == compared).select(*keys, F.col("metrics")[error].alias(error))
        try:
            old = model_store.load(spark, store, "_metrics").where(F.col("model") == compared).select(*keys, F.col("metrics")[error].alias(error))
        except LookupError:
            old = new.limit(0)
        verdict = written(champion_challenger(new, old, keys=keys, error=error, min_improvement=min_improvement).select(*keys, "deployed"), "verdict")
        if verdict.where("deployed").head(1):
            model_store.save_version(spark, store, version, fitted, keys=keys, metrics=rows, committed_at=started_at)
        result = checked.join(verdict, list(keys), "left").join(flat, list(keys), "left")
        ready = F.col("status") == "ready"
        problem = F.when(ready, F.lit("; ".join(f"{m}: {e}" for m, e in sorted(failed.items())) or None)).otherwise(F.col("error"))
        out = logged(result, F.when(ready, "completed").otherwise(F.col("status")), F.coalesce("deployed", no), problem, F.coalesce("_metrics", empty))
    except Exception as problem:  # the log says what happened; the next run starts anew
        ready = F.col("status") == "ready"
        said = str(problem).splitlines()[0] if str(problem) else type(problem).__name__
        out = logged(checked, F.when(ready, "failed").otherwise(F.col("status")), no, F.when(ready, F.lit(said)).otherwise(F.col("error")))
    model_store.append_runs(out, log, run_id)
    return model_store.read_runs(spark, log).where(F.col("run_id") == run_id)
