"""Trend with changepoints: Gram sums and coordinate descent against plain numpy, kinks against one line."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metriloom.operators import changepoint as cp
from metriloom.operators import seasonal

START = datetime(2024, 1, 1)
SCHEMA = "name string, timestamp timestamp_ntz, value double"


def frame(spark, series, step=3600):
    rows = [(k, START + timedelta(seconds=step * i), None if v is None else float(v)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def kinked(n=24 * 28, at=0.5, noise=1.0, seed=3):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    bend = np.maximum(0, i - at * n)
    return 100 + 0.05 * i + 0.4 * bend + 8 * np.sin(2 * np.pi * i / 24) + noise * rng.standard_normal(n)


def plain_design(values, step=3600):
    us = np.array([int((START + timedelta(seconds=step * i) - datetime(1970, 1, 1)).total_seconds()) * 10**6 for i in range(len(values))], dtype=float)
    t = (us - us[0]) / (us[-1] - us[0])
    return t, (us % cp.DAY) / cp.DAY, (us % cp.WEEK) / cp.WEEK, np.asarray(values) / np.abs(values).max()


def test_gram_sums_of_rows_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(cp, "STRETCH", 2 * cp.DAY)
    values = {"a": kinked(400), "b": kinked(300, seed=5), "c": [1.0, None, 3.0]}
    rows = cp._rows_of(cp._placed(frame(spark, values), ["name"], "timestamp", "value"), ["name"], F.lit(1.0))
    got = {r["name"]: np.array(r["gram"]) for r in cp.gram_sums(rows, ["name"]).collect()}
    for k in "ab":
        t, day, week, y = plain_design(values[k])
        x = cp.design(t, day, week, np.ones(len(t)), y)
        assert np.allclose(got[k], (x.T @ x)[cp.UPPER], rtol=1e-9, atol=1e-9)
    assert got["c"][0] == 2


def objective(gram, n, b, variance):
    a, c, yy = gram[: cp.TERMS, : cp.TERMS], gram[: cp.TERMS, cp.TERMS], gram[cp.TERMS, cp.TERMS]
    fourier = b[cp.BENDS.stop :]
    rss = yy - 2 * b @ c + b @ a @ b
    return rss / 2 + variance * (np.abs(b[cp.BENDS]).sum() / cp.BEND_SCALE + (b[cp.LINE] @ b[cp.LINE]) / (2 * cp.LINE_DEVIATION**2) + fourier @ fourier / (2 * cp.FOURIER_DEVIATION**2))


def test_descent_reaches_the_minimum():
    """At the solution no subgradient is left, and no step of any size and direction tried lowers the objective."""
    rng = np.random.default_rng(1)
    t, day, week, y = plain_design(kinked())
    x = cp.design(t, day, week, np.ones(len(t)), y)
    gram = x.T @ x
    (b,), (variance,) = cp.solve(gram[None], np.array([28.0 * cp.DAY]))
    assert variance == pytest.approx(((y - x[:, :-1] @ b) ** 2).mean(), rel=1e-5)
    slope = gram[: cp.TERMS, cp.TERMS] - gram[: cp.TERMS, : cp.TERMS] @ b
    limit = variance / cp.BEND_SCALE
    bends, pull = b[cp.BENDS], slope[cp.BENDS]
    zero = bends == 0
    assert zero.any() and not zero.all()
    assert (np.abs(pull[zero]) <= limit * 1.001).all() and np.allclose(pull[~zero], np.sign(bends[~zero]) * limit, rtol=1e-2)
    least = objective(gram, len(t), b, variance)
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(200):
            assert objective(gram, len(t), b + size * rng.standard_normal(cp.TERMS), variance) >= least - 1e-9


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_kink_is_fitted_better_than_by_one_line(spark, mode):
    i = np.arange(24 * 28)
    level, wave = 100 + 0.1 * i, 0.05 * np.sin(2 * np.pi * i / 24)
    straight = (level * (1 + wave) if mode == "multiplicative" else level + 100 * wave) + np.random.default_rng(4).standard_normal(len(i))
    values = {"kink": kinked(), "line": straight}
    rows = frame(spark, values)
    params = cp.changepoint_fit(rows, keys=["name"], mode=mode).persist()
    found = {r["name"]: r for r in cp.changepoint_components(params, keys=["name"]).collect()}
    assert found["kink"]["n_changepoints"] >= 1 and found["kink"]["n_candidates"] == 25 and "daily" in found["kink"]["seasonalities"]
    largest = max(found["kink"]["changepoints"], key=lambda c: abs(c["bend"]))
    assert abs((largest["timestamp"] - START).total_seconds() / 3600 - 0.5 * 24 * 28) < 48
    assert sum(abs(c["bend"]) for c in found["line"]["changepoints"]) < 0.1 * sum(abs(c["bend"]) for c in found["kink"]["changepoints"])

    bent = cp.changepoint_evaluate(rows, keys=["name"], mode=mode).where("name = 'kink'").first()
    straight = seasonal.seasonal_evaluate(rows, keys=["name"], mode=mode).where("name = 'kink'").first()
    assert bent["rmse"] < straight["rmse"] / 3 and bent["test_size"] == straight["test_size"]
    ahead = {r["step"]: r for r in cp.changepoint_forecast(params.where("name = 'kink'"), 48, step_seconds=3600).collect()}
    want = kinked(24 * 30, at=0.5 * 28 / 30, noise=0.0)[-48:]
    assert np.abs([ahead[i + 1]["predicted"] - want[i] for i in range(48)]).mean() < 4
    width = [ahead[i]["upper_bound"] - ahead[i]["lower_bound"] for i in (1, 24, 48)]
    assert width[0] < width[1] < width[2]


def test_short_constant_and_odd_series(spark):
    values = {"one": [1.0, None], "two": [1.0, 2.0], "flat": [7.0] * 40, "zero": [0.0] * 40, "odd": [1.0, float("nan"), float("inf"), 2.0, 3.0]}
    rows = frame(spark, values).unionByName(spark.createDataFrame([(None, START, 1.0), (None, START, 2.0)], SCHEMA))
    params = cp.changepoint_fit(rows, keys=["name"], mode="additive")
    got = {r["name"]: r for r in cp.changepoint_forecast(params, 2, step_seconds=3600).where("step = 1").collect()}
    assert set(got) - {None} == {"two", "flat", "zero", "odd"} and got["odd"]["n_points"] == 3
    assert got["flat"]["predicted"] == pytest.approx(7.0, abs=0.01) and got["zero"]["predicted"] == pytest.approx(0.0, abs=1e-6)
    assert cp.changepoint_components(params.where("name = 'flat'"), keys=["name"]).first()["seasonalities"] == []
    empty = cp.changepoint_fit(spark.createDataFrame([], SCHEMA), keys=["name"])
    assert empty.count() == 0
