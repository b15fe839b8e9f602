"""Properties of the fitted models."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metriloom.operators import boosted, isolation, retrain, trees

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(42)
    cpu, memory, noise = rng.normal(50, 10, 300), rng.normal(60, 10, 300), rng.normal(0, 1, 300)
    rows = []
    for i in range(300):
        outlier = i >= 295
        rows.append((i, START + timedelta(hours=i), float(cpu[i]), float(memory[i]), float(noise[i]), 500.0 if outlier else float(2 * cpu[i] + 0.2 * memory[i])))
    return spark.createDataFrame(rows, "key long, timestamp timestamp, cpu_usage double, memory_usage double, noise double, rps double")


def test_residual_detector_flags_outliers_and_ranks_features(spark, frame):
    normal = frame.where("key < 295")
    fitted = boosted.residual_detector_fit(normal, "rps", ["cpu_usage", "memory_usage", "noise"], split_key="key", trees=10)
    scored = boosted.residual_detector_score(frame, fitted)
    assert scored.where("flag AND key >= 295").count() == 5
    assert scored.where("flag AND key < 295").count() <= 15
    top = boosted.feature_importance(fitted, spark, 2).orderBy("rank").collect()
    assert [r["feature"] for r in top][0] == "cpu_usage" and len(top) == 2


def test_flat_trees_predict_as_the_pipeline(spark, frame):
    """Also where the pipeline's own inputs lie beyond all cuts, and for every step of a recursive forecast."""
    features = ["cpu_usage", "memory_usage", "noise"]
    model = boosted._pipeline(features, "rps", 12, 4, 0.1, 1).fit(frame.where("key < 250"))
    flat = trees.from_pipeline(spark, model, features)
    odd = frame.select(*[(F.col(c) * F.when(F.col("key") % 50 == 0, 100).otherwise(1)).alias(c) for c in features])
    rows = boosted._predicted(model, odd).collect()
    guess = flat.predict(np.array([[r[c] for c in features] for r in rows]))
    assert np.allclose(guess, [r["prediction"] for r in rows], rtol=0, atol=1e-9)
    assert flat.importance() == pytest.approx(model.stages[-1].featureImportances.toArray(), abs=0.15)
    assert np.array_equal(trees.TreeEnsemble.of(flat.row()).predict(np.ones((2, 3))), flat.predict(np.ones((2, 3))))


def test_recursive_forecast_equals_a_plan_per_step(spark):
    rows = [(n, START + timedelta(hours=i), float(0.5 + 0.3 * np.sin(i / (4 + k)) + 0.01 * (i % 5))) for k, n in enumerate("ab") for i in range(80)]
    df = spark.createDataFrame(rows, "name string, timestamp timestamp, value double")
    fitted = boosted.boosted_forecaster_train(df, keys=["name"], trees=8)
    got = {(r["name"], r["step"]): r["value"] for r in boosted.recursive_forecast(df, fitted, 4, keys=["name"]).collect()}
    for n in "ab":
        held = [r[2] for r in rows if r[0] == n][-12:]
        for step in range(1, 5):
            lags = np.array(held[-12:])
            one = [*lags.tolist(), float(lags.mean()), float(lags.std()), float(lags.min()), float(lags.max()), 0.5, 0.5, 1.0, 0.0]
            names = boosted.lookback_names(12)
            guess = boosted._predicted(fitted.model, spark.createDataFrame([one], names)).first()["prediction"]
            assert got[n, step] == pytest.approx(min(1.0, max(0.0, guess)), abs=1e-9)
            held.append(got[n, step])


def plain_tree_error(x, y, depth):
    """Squared error of one tree grown greedily over all cuts between different values."""
    if depth == 0 or len(y) < 2:
        return ((y - y.mean()) ** 2).sum()
    best = None
    for j in range(x.shape[1]):
        seen = np.unique(x[:, j])
        for c in (seen[1:] + seen[:-1]) / 2:
            left = x[:, j] <= c
            error = sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, ~left))
            if best is None or error < best[0] - 1e-12:
                best = (error, left)
    if best is None:
        return ((y - y.mean()) ** 2).sum()
    return sum(plain_tree_error(x[s], y[s], depth - 1) for s in (best[1], ~best[1]))


def test_growing_equals_greedy_trees():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 2) * 5 + rng.normal(0, 0.1, 60)
    model = trees.grow(x, y, list("abc"), trees=1, depth=3, rate=1.0)
    assert ((y - model.predict(x)) ** 2).sum() == pytest.approx(plain_tree_error(x, y, 3), rel=1e-9)
    many = trees.grow(x, y, list("abc"), trees=60, depth=3, rate=0.2)
    assert ((y - many.predict(x)) ** 2).mean() < 0.05 and many.importance()[2] < 0.05
    flat = trees.grow(x, np.full(60, 3.0), list("abc"), trees=3, depth=2, rate=0.1, penalty=1.0)
    assert np.allclose(flat.predict(x), 3.0)


def test_one_model_per_series(spark):
    """Series of different scale get their own errors, thresholds and forecasts."""
    rng = np.random.default_rng(8)
    rows = []
    for name, scale in (("small", 1.0), ("large", 1000.0)):
        for i in range(200):
            a = float(rng.normal())
            rows.append((name, i, START + timedelta(hours=i), a, scale * (2 * a + 0.05 * float(rng.normal())) + (scale * 50 if i in (150, 151) else 0.0)))
    rows += [("alone", 0, START, 1.0, 1.0), (None, 1, START, 1.0, 2.0), (None, 2, START, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "name string, key long, timestamp timestamp, a double, y double").repartition(5)
    found = boosted.residual_detectors_fit(df, "y", ["a"], keys=["name"], split_key="key", trees=20)
    limits = {r["name"]: r["threshold"] for r in found.models.collect()}
    assert limits["large"] > 100 * limits["small"] > 0
    scored = boosted.residual_detectors_score(df, found, keys=["name"])
    flagged = {(r["name"], r["key"]) for r in scored.where("flag").collect()}
    assert {(n, k) for n in ("small", "large") for k in (150, 151)} <= flagged and len(flagged) <= 20
    assert {r["name"]: r["feature"] for r in boosted.series_importance(found, keys=["name"], n=1).collect()}["small"] == "a"

    waves = [(n, START + timedelta(hours=i), float(v + 0.2 * np.sin(i / 4))) for n, v in (("low", 0.3), ("high", 0.7)) for i in range(120)] + [("new", START, 0.5)]
    frame = spark.createDataFrame(waves, "name string, timestamp timestamp, value double")
    fitted = boosted.boosted_forecasters_train(frame, keys=["name"], trees=30)
    scores = {r["name"]: r for r in fitted.evaluation.collect()}
    assert set(scores) == {"low", "high"} and all((r["train_samples"], r["test_samples"]) == (85, 22) and r["train_mse"] < 0.1 * r["train_variance"] for r in scores.values())
    ahead = boosted.recursive_forecast(frame, fitted, 6, keys=["name"]).collect()
    assert len(ahead) == 18 and all(abs(r["value"] - {"low": 0.3, "high": 0.7, "new": 0.5}[r["name"]]) <= 0.25 for r in ahead)
    assert {r["value"] for r in ahead if r["name"] == "new"} == {0.5}


def test_isolation_forest_isolates(spark, frame):
    points = frame.select("key", F.col("cpu_usage").alias("a"), F.col("memory_usage").alias("b"))
    odd = points.withColumn("a", F.when(F.col("key") < 3, 500.0).otherwise(F.col("a")))
    forest = isolation.isolation_forest_fit(odd, ["a", "b"], key="key", trees=30, contamination=0.05)
    scored = isolation.isolation_forest_score(odd, forest)
    lowest = [r["key"] for r in scored.orderBy("score_sample").limit(3).collect()]
    assert set(lowest) == {0, 1, 2}
    assert 10 <= scored.where("flag").count() <= 15
    again = isolation.isolation_forest_fit(odd.repartition(5), ["a", "b"], key="key", trees=30, contamination=0.05)
    assert again.offset == forest.offset  # the draw does not depend on partitioning


def test_average_path():
    assert list(isolation._average_path(np.array([1, 2]))) == [0.0, 1.0]
    assert float(isolation._average_path(256)) == pytest.approx(10.244770920, abs=1e-6)


def test_recursive_forecast(spark):
    rows = [("long", START + timedelta(hours=i), 0.5 + 0.3 * np.sin(i / 4)) for i in range(120)] + [("short", START, 0.25)]
    df = spark.createDataFrame([(n, t, float(v)) for n, t, v in rows], "name string, timestamp timestamp, value double")
    fitted = boosted.boosted_forecaster_train(df, keys=["name"], trees=5)
    e = fitted.evaluation.first()
    assert (e["train_samples"], e["test_samples"]) == (85, 22) and e["train_mse"] < 0.01
    for lead in (1, 2):
        out = boosted.recursive_forecast(df, fitted, 10, keys=["name"], target_lead=lead).collect()
        assert len(out) == 20 and all(0.0 <= r["value"] <= 1.0 for r in out)
        assert {r["value"] for r in out if r["name"] == "short"} == {0.25}
        assert sorted(r["step"] for r in out if r["name"] == "long") == list(range(1, 11))
    assert {r["value"] for r in boosted.recursive_forecast(df.where("name = 'short'"), None, 2, keys=["name"]).collect()} == {0.25}


def test_train_all_survives_a_failing_model(spark, frame, monkeypatch):
    df = frame.withColumn("shop", F.lit("x")).select("shop", "timestamp", "cpu_usage", "rps")

    def broken(*args, **kwargs):
        raise RuntimeError("no trees today")

    monkeypatch.setattr(boosted, "residual_detectors_fit", broken)
    rows, failed = retrain.train_all(df, keys=["shop"])
    assert failed == {"residual_detector": "no trees today"}
    assert {r["model"] for r in rows.collect()} == {"baseline", "seasonal"}
    assert retrain.choose_target(df) == "rps" and retrain.choose_target(df.drop("rps")) == "cpu_usage"
