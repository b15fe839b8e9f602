"""Stored models score as before in a new session; versions are whole or unseen; runs are logged once."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metriloom.operators import boosted, forecast, isolation, model_store, retrain

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    rows = []
    for name, level in (("a", 0.3), ("b", 0.6)):
        for i in range(140):
            x = float(rng.random())
            rows.append((name, i, START + timedelta(hours=i), x, float(level + 0.2 * np.sin(i / 4) + 0.05 * x)))
    rows += [("short", i, START + timedelta(hours=i), 0.1, 0.1 * i) for i in range(9)]
    return spark.createDataFrame(rows, "name string, key long, timestamp timestamp, load double, value double").persist()


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_everything_comes_back(spark, frame, tmp_path):
    keys = ["name"]
    baseline = forecast.baseline_fit(frame, keys=keys)
    forecasters = boosted.boosted_forecasters_train(frame, keys=keys, trees=8)
    detectors = boosted.residual_detectors_fit(frame, "value", ["load"], keys=keys, split_key="key", trees=8)
    shared = boosted.boosted_forecaster_train(frame, keys=keys, trees=3)
    detector = boosted.residual_detector_fit(frame, "value", ["load"], split_key="key", trees=3)
    forest = isolation.isolation_forest_fit(frame, ["load", "value"], key="key", trees=8)
    at = str(tmp_path / "store")
    models = {"baseline": baseline, "forecaster": forecasters, "detector": detectors, "shared": shared, "one_detector": detector, "forest": forest}
    model_store.save_version(spark, at, 3, models, committed_at=START)

    other = spark.newSession()
    table = other.createDataFrame(frame.toPandas()[["name", "key", "timestamp", "load", "value"]], frame.schema)
    back = {name: model_store.load(other, at, name) for name in models}
    assert rows_of(back["baseline"], "name", "moving_average", "trend", "std") == rows_of(baseline, "name", "moving_average", "trend", "std")
    for name in ("forecaster", "shared"):
        now = boosted.recursive_forecast(frame, models[name], 5, keys=keys)
        then = boosted.recursive_forecast(table, back[name], 5, keys=keys)
        assert rows_of(then, "name", "step", "value") == rows_of(now, "name", "step", "value")
    cols = ("name", "key", "score", "flag")
    assert rows_of(boosted.residual_detectors_score(table, back["detector"], keys=keys), *cols) == rows_of(boosted.residual_detectors_score(frame, detectors, keys=keys), *cols)
    assert rows_of(boosted.residual_detector_score(table, back["one_detector"]), *cols) == rows_of(boosted.residual_detector_score(frame, detector), *cols)
    cols = ("name", "key", "score_sample", "flag")
    assert rows_of(isolation.isolation_forest_score(table, back["forest"]), *cols) == rows_of(isolation.isolation_forest_score(frame, forest), *cols)
    listed = {r["model"]: r for r in model_store.registry(other, at).collect()}
    assert set(listed) == set(models) and listed["baseline"]["n_series"] == 3 and listed["forest"]["features"] == ["load", "value"]


def test_only_committed_versions_are_seen(spark, frame, tmp_path, monkeypatch):
    at = str(tmp_path / "store")
    table = lambda n: frame.where("name = 'a'").select("name", F.lit(n).alias("n")).limit(1)
    assert model_store.registry(spark, at).count() == 0
    with pytest.raises(LookupError):
        model_store.load(spark, at, "m")
    metrics = spark.createDataFrame([("a", "m", {"rmse": 2.0}), ("b", "m", {"rmse": 4.0})], "name string, model string, metrics map<string,double>")
    model_store.save_version(spark, at, 1, {"m": table(1)}, metrics=metrics, committed_at=START)
    broken = {"m": table(2), "z": object()}
    with pytest.raises(TypeError):
        model_store.save_version(spark, at, 2, broken)
    assert model_store.load(spark, at, "m").first()["n"] == 1  # version 2 was begun and never committed
    old = model_store.load(spark, at, "m", 1)
    model_store.save_version(spark, at, 1, {"m": table(5)}, committed_at=START)
    assert model_store.load(spark, at, "m", 1).first()["n"] == 5 and old.first()["n"] == 1
    model_store.save_version(spark, at, 10, {"m": table(10), "k": table(3)}, committed_at=START)
    listed = {r["model"]: r["version"] for r in model_store.registry(spark, at).collect()}
    assert listed == {"m": 10, "k": 10} and model_store.load(spark, at, "m").first()["n"] == 10


def test_a_failed_and_repeated_run_leaves_one_row_per_series(spark, frame, tmp_path, monkeypatch):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    run = lambda run_id, version, n=0: retrain.retrain_job(
        frame, keys=["name"], store=store, log=log, run_id=run_id, version=version, started_at=START + timedelta(days=n), target="value", trees=3
    )
    with monkeypatch.context() as m:
        m.setattr(retrain, "train_all", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("disk full\nmore")))
        first = {r["series"]: r for r in run("r1", 1).collect()}
    assert first["a"]["status"] == "failed" and first["a"]["error"] == "disk full" and first["short"]["status"] == "skipped"
    assert model_store.registry(spark, store).count() == 0
    again = {r["series"]: r for r in run("r1", 1).collect()}
    assert again["a"]["status"] == "completed" and again["a"]["deployed"] and again["a"]["error"] is None and again["a"]["data_points"] == 140
    assert again["short"]["status"] == "skipped" and "need 100" in again["short"]["error"] and not again["short"]["deployed"]
    assert model_store.read_runs(spark, log).count() == 3 and {"baseline.rmse", "residual_detector.threshold"} <= set(again["b"]["metrics"])
    listed = {r["model"]: r for r in model_store.registry(spark, store).collect()}
    assert set(listed) == {"baseline", "seasonal", "residual_detector"} and listed["seasonal"]["performance"]["rmse"] > 0
    # the same data again is no improvement: logged, and the stored version stays
    second = {r["series"]: r for r in run("r2", 2, 1).collect()}
    assert not second["a"]["deployed"] and second["a"]["status"] == "completed"
    assert {r["version"] for r in model_store.registry(spark, store).collect()} == {1}
    runs = model_store.read_runs(spark, log)
    assert runs.count() == 6 and retrain.run_history(runs, 1, keys=["series"]).where("series = 'a'").first()["run_id"] == "r2"
