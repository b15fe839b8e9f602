"""Versioned model store and run log on a shared folder.

A version is a set of models written to a folder of its own; its last write is the commit, a small table with one
row per model: kind, folder, settings, inputs, number of series and mean performance. Readers see committed
versions only. A failed or repeated write leaves an unread folder behind and never half a version; committing a
version again replaces it as a whole, while who has read the old commit goes on with the old files.

Stored kinds: parameter tables, one model per series (forecasters, detectors), pipelines of Spark ML with what
belongs to them (threshold, inputs, lookback), and isolation forests as a table of trees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metriloom.operators.boosted import Forecaster, ResidualDetector, SeriesDetectors, SeriesForecasters
from metriloom.operators.isolation import TREE, IsolationForest
from metriloom.schemas import RUN_LOG

COMMIT = (
    "model string, kind string, path string, settings string, features array<string>, n_series long, performance map<string, double>, committed_at timestamp_ntz"
)
Model = DataFrame | SeriesForecasters | SeriesDetectors | Forecaster | ResidualDetector | IsolationForest


@dataclass
class Stored:
    """What the commit says of one model."""

    kind: str
    path: str
    settings: dict
    features: list[str]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _write(spark: SparkSession, model: Model, path: str, keys: Sequence[str]) -> tuple[str, dict, list[str], int | None]:
    """Write one model; kind, settings, inputs and number of series."""
    if isinstance(model, DataFrame):
        model.write.parquet(path)
        return "table", {}, [], spark.read.parquet(path).select(*keys).distinct().count()
    if isinstance(model, SeriesForecasters):
        model.models.write.parquet(f"{path}/models")
        model.evaluation.write.parquet(f"{path}/evaluation")
        return "series_forecasters", {"lookback": model.lookback}, [], spark.read.parquet(f"{path}/models").count()
    if isinstance(model, SeriesDetectors):
        model.models.write.parquet(path)
        return "series_detectors", {"target": model.target}, model.features, spark.read.parquet(path).count()
    if isinstance(model, Forecaster):
        model.model.write().save(f"{path}/pipeline")
        model.evaluation.write.parquet(f"{path}/evaluation")
        return "forecaster", {"lookback": model.lookback}, [], None
    if isinstance(model, ResidualDetector):
        model.model.write().save(path)
        return "residual_detector", {"target": model.target, "threshold": model.threshold}, model.features, None
    if isinstance(model, IsolationForest):
        rows = [(i, *(part.tolist() for part in tree)) for i, tree in enumerate(model.trees)]
        spark.createDataFrame(rows, TREE).write.parquet(path)
        settings = {"center": model.center.tolist(), "scale": model.scale.tolist(), "sample": model.sample, "offset": model.offset}
        return "isolation_forest", settings, model.features, None
    raise TypeError(f"no way to store {type(model).__name__}")


def save_version(
    spark: SparkSession, root: str, version: int, models: Mapping[str, Model], *, keys: Sequence[str] = ("name",), metrics: DataFrame | None = None,
    committed_at: datetime | None = None,
) -> None:
    """Store models under one version. ``metrics``: keys, ``model`` and a map of ``metrics`` per series, kept as a table."""
    folder = new_path_under(root, f"data/version={version}")
    written = {name: (f"{folder}/{name}", *_write(spark, model, f"{folder}/{name}", keys)) for name, model in models.items()}
    mean: dict[str, dict[str, float]] = {}
    if metrics is not None:
        metrics.write.parquet(f"{folder}/_metrics")
        kept = spark.read.parquet(f"{folder}/_metrics").select("model", F.explode("metrics").alias("metric", "value"))
        for r in kept.groupBy("model", "metric").agg(F.avg("value").alias("v")).collect():  # a few numbers a model
            mean.setdefault(r["model"], {})[r["metric"]] = r["v"]
    at = committed_at or datetime.now()
    rows = [
        (name, kind, path, json.dumps(settings), list(features), series, mean.get(name, {}), at)
        for name, (path, kind, settings, features, series) in written.items()
    ]
    if metrics is not None:
        rows.append(("_metrics", "metrics", f"{folder}/_metrics", "{}", [], None, {}, at))
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/commits/version={version}")


def new_path_under(root: str, label: str) -> str:
    """A fresh folder below ``root``."""
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per model and committed version."""
    at = f"{root.rstrip('/')}/commits"
    if not _exists(spark, at):
        return spark.createDataFrame([], f"{COMMIT}, version long")
    return spark.read.schema(f"{COMMIT}, version long").option("basePath", at).parquet(at)


def find(spark: SparkSession, root: str, model: str, version: int | None = None) -> Stored:
    """Where a model of a version lies; the newest version that has it unless one is named."""
    rows = commits(spark, root).where(F.col("model") == model)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    found = rows.orderBy(F.desc("version")).first()
    if found is None:
        raise LookupError(f"no committed version holds {model}" + ("" if version is None else f" {version}"))
    return Stored(found["kind"], found["path"], json.loads(found["settings"]), list(found["features"]))


def load(spark: SparkSession, root: str, model: str, version: int | None = None) -> Model:
    """The model as it was stored."""
    s = find(spark, root, model, version)
    if s.kind in ("table", "metrics"):
        return spark.read.parquet(s.path)
    if s.kind == "series_forecasters":
        return SeriesForecasters(spark.read.parquet(f"{s.path}/models"), spark.read.parquet(f"{s.path}/evaluation"), s.settings["lookback"])
    if s.kind == "series_detectors":
        return SeriesDetectors(spark.read.parquet(s.path), s.features, s.settings["target"])
    if s.kind == "forecaster":
        return Forecaster(PipelineModel.load(f"{s.path}/pipeline"), spark.read.parquet(f"{s.path}/evaluation"), s.settings["lookback"])
    if s.kind == "residual_detector":
        return ResidualDetector(PipelineModel.load(s.path), s.settings["threshold"], s.features, s.settings["target"])
    trees = spark.read.parquet(s.path).orderBy("tree").collect()  # at most 2 * sample nodes a tree
    arrays = [tuple(np.array(r[c]) for c in ("feature", "cut", "left", "right", "depth")) for r in trees]
    return IsolationForest(s.features, arrays, np.array(s.settings["center"]), np.array(s.settings["scale"]), s.settings["sample"], s.settings["offset"])


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version of each model, with kind, time, inputs, series and performance."""
    rest = ["version", "kind", "committed_at", "features", "n_series", "performance"]
    rows = commits(spark, root).where("kind <> 'metrics'")
    return rows.groupBy("model").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("model", "_r.*")


def append_runs(rows: DataFrame, log: str, run_id: str) -> None:
    """Write the rows of one run (``RUN_LOG``), one per series; the same run written again replaces itself."""
    rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_LOG]).write.mode("overwrite").parquet(f"{log.rstrip('/')}/run_id={run_id}")


def read_runs(spark: SparkSession, log: str) -> DataFrame:
    """All runs with their ``run_id``."""
    if not _exists(spark, log):
        return spark.createDataFrame([], RUN_LOG).withColumn("run_id", F.lit(""))
    return spark.read.schema(T.StructType([*RUN_LOG.fields, T.StructField("run_id", T.StringType())])).option("basePath", log).parquet(log)
