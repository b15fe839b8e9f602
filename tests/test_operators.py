"""Hand-computed cases of the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from metriloom.functions.names import query_name, series_id, snake_case
from metriloom.functions.quantities import cost_quantity, memory_bytes, millicores
from metriloom.functions.time import floor_to, round_half_even_to
from metriloom.operators import align, anomaly, cost, features, forecast, recommend, retrain, seasonal, store, telemetry

START = datetime(2024, 1, 1)


def series(spark, values, step=300, name="cpu"):
    rows = [(name, i, START + timedelta(seconds=step * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "name string, seq long, timestamp timestamp, value double")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# ---- forecasts


def test_baseline_on_increasing_series(spark):
    p = only(forecast.baseline_fit(series(spark, range(1, 11)), keys=["name"], window=5))
    assert (p["moving_average"], p["trend"], p["is_fitted"]) == (8.0, 1.0, True)
    assert p["std"] == pytest.approx(0.0)


def test_baseline_short_series_is_not_fitted(spark):
    params = forecast.baseline_fit(series(spark, [1, 2, 3]), keys=["name"], window=10)
    assert only(params)["is_fitted"] is False
    assert forecast.baseline_predict(params, 3).count() == 0


def test_baseline_one_point(spark):
    p = only(forecast.baseline_fit(series(spark, [4]), keys=["name"], window=1))
    assert (p["moving_average"], p["trend"], p["std"]) == (4.0, 0.0, 0.0)


def test_bands_widen_and_order(spark):
    params = forecast.baseline_fit(series(spark, [100 + (i * 7919) % 13 for i in range(50)]), keys=["name"])
    rows = forecast.baseline_predict(params, 10).orderBy("step").collect()
    assert all(r["lower_bound"] < r["value"] < r["upper_bound"] for r in rows)
    width = [r["upper_bound"] - r["lower_bound"] for r in rows]
    assert width[3] == pytest.approx(2 * width[0]) and width == sorted(width)
    wider = forecast.baseline_predict(params, 1, confidence=0.99).first()
    assert wider["upper_bound"] > rows[0]["upper_bound"]


@pytest.mark.parametrize("periods", [0, 289])
def test_periods_are_checked(spark, periods):
    with pytest.raises(ValueError):
        forecast.portable_forecast(forecast.baseline_fit(series(spark, range(20)), keys=["name"]), periods)


def test_portable_forecast_is_never_negative(spark):
    params = forecast.baseline_fit(series(spark, range(20, 0, -1)), keys=["name"])
    assert min(r["value"] for r in forecast.portable_forecast(params, 50).collect()) == 0.0


def test_online_baseline_short_and_absent(spark):
    wanted = spark.createDataFrame([("cpu",), ("none",)], "name string")
    rows = forecast.online_baseline(series(spark, [1, 2, 3]), 2, keys=["name"], wanted=wanted).collect()
    assert {(r["name"], r["step"], r["value"], r["lower_bound"], r["upper_bound"]) for r in rows} == {
        ("cpu", 1, 3.0, 0.0, 1.0), ("cpu", 2, 3.0, 0.0, 1.0), ("none", 1, 0.0, 0.0, 1.0), ("none", 2, 0.0, 0.0, 1.0),
    }


def test_online_baseline_trend(spark):
    rows = forecast.online_baseline(series(spark, range(24)), 1, keys=["name"]).collect()
    assert rows[0]["value"] == pytest.approx(17.5 + 1.0)  # (17.5 - 5.5) / 12 per step


def test_skill_is_zero_for_a_perfect_naive(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1.0)], "k string, actual double, predicted double, naive double")
    r = only(forecast.forecast_metrics(df, by=["k"], naive="naive"))
    assert (r["mae"], r["skill_score"], r["mape"]) == (1.0, 0.0, pytest.approx(100.0))


def test_train_baseline_uses_sixty_percent_when_short(spark):
    r = only(forecast.train_baseline(series(spark, range(20)), keys=["name"]))
    assert (r["train_size"], r["test_size"], r["window"]) == (12, 8, 6)
    # average 8.5 plus slope 1 per step against 12, 13, ...
    assert r["mae"] == pytest.approx(2.5)


def test_forecast_many_falls_back(spark):
    def f(names, value):
        return spark.createDataFrame([(n, 1, value, 0.0, 1.0) for n in names], "name string, step int, value double, lower_bound double, upper_bound double")

    out = forecast.forecast_many({"baseline": f("ab", 1.0), "seasonal": f("a", 2.0)}, "seasonal", keys=["name"], as_of=F.lit(START), include_confidence=False)
    got = {r["name"]: (r["model"], r["value"], r["timestamp"]) for r in out.collect()}
    at = START + timedelta(minutes=5)
    assert got == {"a": ("seasonal", 2.0, at), "b": ("baseline", 1.0, at)}
    assert "lower_bound" not in out.columns
    assert {r["model"] for r in forecast.forecast_many({"baseline": f("a", 1.0)}, "boosted", keys=["name"], as_of=F.lit(START)).collect()} == {"baseline"}


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_seasonal_recovers_a_daily_pattern(spark, mode):
    values = [100 + (10 if i % 24 < 12 else -10) for i in range(24 * 14)]
    params = seasonal.seasonal_fit(series(spark, values, step=3600), keys=["name"], mode=mode)
    rows = seasonal.seasonal_forecast(params, 24, step_seconds=3600, mode=mode).orderBy("step").collect()
    # the trend line leans a little with the phase of the pattern
    assert [r["predicted"] for r in rows] == pytest.approx([110] * 12 + [90] * 12, abs=3)
    assert all(r["lower_bound"] <= r["predicted"] <= r["upper_bound"] for r in rows)


def test_seasonal_needs_two_points(spark):
    assert seasonal.seasonal_fit(series(spark, [1.0, None]), keys=["name"]).count() == 0


# ---- anomalies


def test_one_spike_is_found(spark):
    values = [0.15 + (i % 5) * 0.01 for i in range(20)] + [0.95]
    r = only(anomaly.zscore_anomalies(series(spark, values)))
    assert (r["value"], r["severity"]) == (0.95, "critical")


def test_constant_series_and_short_series_have_none(spark):
    assert anomaly.zscore_anomalies(series(spark, [0.15] * 20)).count() == 0
    assert anomaly.zscore_anomalies(series(spark, [0.0] * 10 + [9.0]), min_points=12).count() == 0


def test_sigma_is_checked(spark):
    with pytest.raises(ValueError):
        anomaly.zscore_anomalies(series(spark, [1]), sigma=0.5)


def test_summary_of_nothing_is_healthy(spark):
    points = series(spark, [0.15] * 20)
    r = only(anomaly.anomaly_summary(points, anomaly.zscore_anomalies(points)))
    assert (r["status"], r["anomaly_rate"], r["points"], r["by_severity"]) == ("healthy", 0.0, 20, {})


def test_description(spark):
    df = spark.createDataFrame([("cpu", 2.0, 1.0, 3.25), ("cpu", 0.0, 0.0, 1.0)], "m string, v double, e double, s double")
    got = [r[0] for r in df.select(anomaly.describe("m", "v", "e", "s")).collect()]
    assert got[0] == "Significant anomaly detected. cpu is 100.0% above expected value (actual: 2.0000, expected: 1.0000, score: 3.25σ)"
    assert got[1].startswith("Minor anomaly detected. cpu is 0.0% below")


def test_holdout_short_series_uses_unit_scale(spark):
    got = {r["value"]: r["score"] for r in anomaly.holdout_zscore(series(spark, [1, 3, -4])).collect()}
    assert got == {3.0: 3.0, -4.0: 4.0}


# ---- features


def test_rolling_and_lags_with_gaps(spark):
    df = series(spark, [1, 2, None, 4, 5, 6])
    rows = features.rolling_features(features.lag_features(df, ["value", "absent"], keys=["name"], lags=[1]), ["value"], keys=["name"], windows=[3]).orderBy("seq").collect()
    assert [r["value_lag_1"] for r in rows] == [None, 1, 2, None, 4, 5]
    assert [r["value_roll_mean_3"] for r in rows] == [None, None, None, None, None, 5.0]
    assert rows[5]["value_roll_std_3"] == pytest.approx(1.0)


def test_pct_change_fills_forward_and_guards_zero(spark):
    rows = features.pct_change(series(spark, [2, None, 3, 0, 5]), ["value"], keys=["name"], periods=[1]).orderBy("seq").collect()
    assert [r["value_pct_change_1"] for r in rows] == [None, 0.0, 0.5, -1.0, None]


def test_transform_width(spark):
    df = series(spark, range(30)).select("name", "timestamp", F.col("value").alias("a"), (F.col("value") * 2).alias("b"))
    out = features.transform(df, keys=["name"])
    assert len(out.columns) == 4 + 9 + 2 * 23
    ready = features.prepare_for_training(out, "a")
    assert "timestamp" not in ready.columns and ready.count() == 18  # 12 rows lack the longest lag
    with pytest.raises(ValueError):
        features.prepare_for_training(out, "absent")


def test_calendar(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 6, 17, 30),), (datetime(2024, 1, 8, 18, 0),)], "timestamp timestamp")
    a, b = features.time_features(df).orderBy("timestamp").collect()
    assert (a["day_of_week"], a["is_weekend"], a["is_business_hours"], a["minute_of_day"]) == (5, 1, 1, 1050)
    assert (b["day_of_week"], b["is_weekend"], b["is_business_hours"]) == (0, 0, 0)
    assert b["hour_sin"] == pytest.approx(-1.0)


def test_lookback_target_is_two_after_the_newest_lag(spark):
    r = features.lookback_features(series(spark, range(20)), "value", keys=["name"]).orderBy("timestamp").first()
    assert (r["lag_12"], r["lag_1"], r["target"], r["roll_mean"]) == (0.0, 11.0, 13.0, 5.5)
    assert features.lookback_features(series(spark, range(13)), "value", keys=["name"]).count() == 0


def test_scale_of_a_constant(spark):
    rows = features.standard_scale(series(spark, [3, 3, 3]), ["value"], keys=["name"]).collect()
    assert {r["value"] for r in rows} == {0.0}


# ---- alignment and telemetry


def test_rounding_rules(spark):
    times = [datetime(2024, 1, 1, 0, 2, 30), datetime(2024, 1, 1, 0, 7, 30), datetime(2024, 1, 1, 0, 2, 31)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    got = [(r[0].minute, r[1].minute) for r in df.select(floor_to("t", 300), round_half_even_to("t", 300)).collect()]
    assert got == [(0, 0), (5, 10), (0, 5)]


def test_counter_reset(spark):
    r = only(align.align_delta(series(spark, [10, 15, 3, 4], step=60), keys=["name"], period=3600))
    assert r["value"] == 5 + 3 + 1
    assert only(align.align_rate(series(spark, [10, 15, 3, 4], step=60), keys=["name"], period=3600))["value"] == pytest.approx(9 / 3600)


def test_increase_needs_whole_steps(spark):
    with pytest.raises(ValueError):
        telemetry.increase(series(spark, [1]), keys=["name"], range_seconds=90, step_seconds=60)


def test_aligners(spark):
    df = spark.createDataFrame([("kubernetes.io/container/cpu/core_usage_time",), ("x/cpu/utilization",)], "m string")
    got = [tuple(r) for r in df.select(align.training_aligner("m"), align.collection_aligner("m")).collect()]
    assert got == [("ALIGN_RATE", "ALIGN_RATE"), ("ALIGN_MEAN", "ALIGN_MEAN")]


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 99.0)] + [("b", 900.0)], "k string, value double")
    b = telemetry.bucketize(df, [2.0, 10.0], by=["k"])
    got = {r["k"]: r["quantile"] for r in telemetry.histogram_quantile(b, 0.5, by=["k"]).collect()}
    assert got == {"a": pytest.approx(1.5), "b": 10.0}
    empty = telemetry.bucketize(df.where("false"), [2.0])
    assert only(telemetry.histogram_quantile(empty, 0.5))["quantile"] is None


def test_alert_pending_then_firing(spark):
    df = series(spark, [0, 9, 9, 9, 0, 9], step=60).withColumn("expression", F.lit("x"))
    rows = telemetry.alert_eval(df, [("A", "x", ">", 5.0, 2, "warning")], keys=["name"]).orderBy("timestamp").collect()
    assert [r["state"] for r in rows] == ["inactive", "pending", "pending", "firing", "inactive", "pending"]


def test_triggers_clamp(spark):
    df = spark.createDataFrame([(1, "w", "t", 95.0), (2, "w", "t", 0.1), (3, "w", "t", 3.2)], "timestamp int, workload string, trigger string, value double")
    rows = telemetry.trigger_eval(df, [("w", "t", 1.0, 0.5, 2, 10)]).orderBy("timestamp").collect()
    assert [(r["active_triggers"], r["replicas"]) for r in rows] == [(1, 10), (0, 2), (1, 4)]


# ---- recommendations


def test_predictions_drive_scale_out(spark):
    w = spark.createDataFrame([("shop", "api", 2, "100m", "500m")], "namespace string, workload string, replicas int, cpu_request string, cpu_limit string")
    p = spark.createDataFrame([("shop", "api", 0.85 + 0.02 * i) for i in range(6)], "namespace string, workload string, value double")
    rows = {r["action"]: r for r in recommend.recommend(recommend.effective_utilization(w, p)).collect()}
    assert set(rows) == {"scale_out", "scale_down"}
    assert rows["scale_out"]["target_replicas"] == 3 and rows["scale_out"]["confidence"] == pytest.approx(0.7)
    assert rows["scale_out"]["reason"] == "Current utilization (95.0%) exceeds threshold (85.0%). Recommend scaling from 2 to 3 replicas."
    assert rows["scale_down"]["target_cpu_request"] == "100m"
    assert only(recommend.scaling_action(recommend.effective_utilization(w)))["action"] == "no_action"
    with pytest.raises(ValueError):
        recommend.scaling_action(w, target=1.0)


def test_quantities(spark):
    df = spark.createDataFrame([("250m",), ("2",), ("512Mi",), ("1Gi",), ("2K",), ("bad",), ("",), (" 1Ti ",)], "q string")
    rows = [tuple(r) for r in df.select(cost_quantity("q"), millicores("q"), memory_bytes("q")).collect()]
    assert rows[0] == (0.25, 250.0, None)
    assert rows[1] == (2.0, 2000.0, 2.0)
    assert rows[2][0] == 0.5 and rows[2][2] == 512 * 1024.0**2
    assert rows[3][0] == 1.0 and rows[4][2] == 2000.0
    assert rows[5] == (0.0, None, None) and rows[6] == (0.0, None, None) and rows[7][0] == 1024.0


# ---- cost


def test_cost_by_hand(spark):
    w = spark.createDataFrame([("api", "shop", 2, 0.5, 1.0, 10.0, 0.4, 0.6)], "workload string, namespace string, replicas int, cpu_requested double, memory_requested double, disk double, cpu_usage double, memory_usage double")
    r = only(cost.workload_cost(w, storage="disk"))
    assert r["total_hourly"] == pytest.approx(0.0445 + 2 * 0.0049 + 20 * 0.0001)
    assert (r["total_monthly"], r["efficiency_score"]) == (pytest.approx(r["total_hourly"] * 720), 0.5)
    assert cost.workload_resources(w.withColumn("disk", F.lit(0.0)), storage="disk").count() == 2
    assert only(cost.resource_cost(spark.createDataFrame([("gpu", 2.0)], "resource string, quantity double")))["monthly_cost"] == 0.0


def test_efficiency_edges(spark):
    w = spark.createDataFrame([("a", "n", 0.0, 1.0, 1.0, 2.0), ("b", "n", 1.0, 0.1, 1.0, 0.1)], "workload string, namespace string, cpu_requested double, cpu_used double, memory_requested double, memory_used double")
    rows = {r["workload"]: r for r in cost.workload_efficiency(w).collect()}
    assert rows["a"]["overall_efficiency"] == pytest.approx(0.4) and not rows["a"]["is_oversized"]
    assert rows["b"]["is_oversized"] and rows["b"]["waste_cost_monthly"] == pytest.approx(0.9 * (0.0445 + 0.0049) * 720)
    texts = {(r["workload"], r["resource"]): r["recommendation"] for r in cost.resource_efficiency(w).collect()}
    assert texts[("b", "cpu")] == "Consider reducing cpu request by 90%"
    assert texts[("a", "memory")] == "Consider increasing memory request to handle peak load"


def test_cost_forecast_week_and_hourly(spark):
    now = datetime(2024, 1, 5)  # a Friday, so the first point is a Saturday
    current = spark.createDataFrame([("n", 24.0)], "namespace string, daily_cost double")
    week = cost.cost_forecast(current, "7d", as_of=F.lit(now)).orderBy("i").collect()
    assert len(week) == 7
    assert week[0]["predicted_cost"] == pytest.approx(24 * (1 + 0.02 / 30) * 0.9)
    assert (week[0]["confidence"], week[0]["upper_bound"]) == (0.95, pytest.approx(week[0]["predicted_cost"] * 1.1))
    hour = cost.cost_forecast(current, "24h", as_of=F.lit(now)).orderBy("i").first()
    compat = cost.cost_forecast(current, "24h", as_of=F.lit(now), reference_compat=True).orderBy("i").first()
    assert hour["predicted_cost"] == pytest.approx(1 + 0.02 / 720) and compat["predicted_cost"] == pytest.approx(1 + 0.02 / 30)


def test_trend_and_budget(spark):
    pts = spark.createDataFrame([("n", 0, 10.0), ("n", 1, 12.0)], "k string, i int, predicted_cost double")
    r = only(cost.cost_trend(pts, keys=["k"]))
    assert (r["trend"], r["trend_percent"], r["projected_total"]) == ("increasing", 20.0, 22.0)
    spend = spark.createDataFrame([(500.0, 100.0, 10), (500.0, 0.0, 0), (500.0, 0.0, 5), (100.0, 90.0, 10)], "monthly_budget double, current_spend double, days_elapsed int")
    a, b, c, d = cost.budget_status(spend).collect()
    assert (a["burn_rate"], a["projected_monthly"], a["on_track"], a["days_to_exhaustion"], a["overage_projected"]) == (10.0, 300.0, True, 40.0, 0.0)
    assert (b["on_track"], b["projected_monthly"], b["budget_remaining"], b["burn_rate"]) == (True, 0.0, 500.0, 0.0)
    assert c["days_to_exhaustion"] == float("inf")
    assert (d["on_track"], d["overage_projected"]) == (False, pytest.approx(170.0))


def test_scaling_up_saves_nothing(spark):
    ev = spark.createDataFrame([("w", "n", START, 1, 4), ("w", "n", START + timedelta(days=40), 2, 2), ("w", "n", START + timedelta(days=41), 3, 3)], "workload string, namespace string, timestamp timestamp, seq long, after_replicas int")
    rows = cost.scaling_event_savings(ev, cpu_per_replica=1.0, memory_per_replica=0.0).orderBy("seq").collect()
    assert [r["action_taken"] for r in rows] == ["No scaling change", "Scaled down from 4 to 2 replicas", "Scaled up from 2 to 3 replicas"]
    assert [r["savings_hourly"] for r in rows] == [0.0, pytest.approx(0.089), 0.0]
    summary = {r["level"]: r["total_savings"] for r in cost.savings_summary(cost.scaling_event_savings(ev, cpu_per_replica=1.0, memory_per_replica=0.0), "7d").collect()}
    assert summary["all"] == pytest.approx(0.089 * 720)


# ---- store and retraining


def test_liveness_and_paused(spark):
    rows = [(1, START, False), (2, START - timedelta(minutes=3), False), (3, START - timedelta(minutes=9), False), (4, START - timedelta(minutes=9), True)]
    df = spark.createDataFrame(rows, "agent_id int, last_seen timestamp, paused boolean")
    assert [r["status"] for r in store.agent_liveness(df).orderBy("agent_id").collect()] == ["online", "warning", "offline", "online"]


def test_deployment_names_stay_unique(spark):
    ev = [
        ("a", 1, "create", "web", None), ("b", 2, "create", "web", None), ("c", 3, "create", "Bad Name", None), ("d", 4, "create", "api", None),
        ("d", 5, "update", "web", "kept"), ("e", 6, "create", "old", None), ("e", 7, "delete", None, None),
    ]
    df = spark.createDataFrame([(i, START + timedelta(minutes=s), s, k, n, d, None) for i, s, k, n, d in ev], "id string, timestamp timestamp, seq long, kind string, name string, description string, environment string")
    got = {r["id"]: (r["name"], r["description"], r["environment"]) for r in store.deployment_registry(df).collect()}
    assert got == {"a": ("web", "", "development"), "d": ("api", "", "development")}
    agents = spark.createDataFrame([("x", "a"), ("y", "e")], "agent_id string, deployment_id string")
    assert [r["agent_id"] for r in store.cascade_delete(agents, store.deployment_registry(df)).collect()] == ["x"]


def test_unknown_agents_heartbeat_is_ignored(spark):
    cols = "agent_id int, seq long, timestamp timestamp, kind string, hostname string, agent_version string, deployment_id string, metrics_count long, metrics string, paused boolean, collection_interval long"
    ev = [
        (1, 1, START, "heartbeat", None, None, None, 9, "m", None, None),
        (2, 2, START, "heartbeat", None, None, None, 9, "m", None, None),
        (2, 3, START + timedelta(minutes=1), "register", "h", "v", "d", None, "n", None, None),
        (2, 4, START + timedelta(minutes=2), "config", None, None, None, None, None, True, 4),
    ]
    r = only(store.agent_registry(spark.createDataFrame(ev, cols)))
    assert (r["agent_id"], r["metrics_count"], r["metrics"], r["paused"], r["collection_interval"]) == (2, 0, "n", True, 15)
    gone = spark.createDataFrame([*ev, (2, 5, START + timedelta(minutes=3), "delete", None, None, None, None, None, None, None)], cols)
    assert store.agent_registry(gone, with_deletes=True).count() == 0


def test_champion_gate(spark):
    new = spark.createDataFrame([("a", 9.0), ("b", 9.6), ("c", 1.0), ("d", None)], "k string, rmse double")
    old = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("d", 10.0)], "k string, rmse double")
    assert {r["k"]: r["deployed"] for r in retrain.champion_challenger(new, old, keys=["k"]).collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_gates_for_absent_series(spark):
    wanted = spark.createDataFrame([("cpu",), ("gone",)], "name string")
    got = {r["name"]: (r["status"], r["error"]) for r in retrain.gates(series(spark, range(5)), keys=["name"], wanted=wanted).collect()}
    assert got == {"cpu": ("skipped", "Insufficient data: got 5, need 100"), "gone": ("skipped", "No data returned from monitoring platform")}


def test_names(spark):
    df = spark.createDataFrame([("CPUUtilization", "sum(rate(x[5m])) by (a)"), ("TargetResponseTime", "up")], "c string, q string")
    got = [tuple(r) for r in df.select(snake_case("c"), snake_case("c", True), query_name("q")).collect()]
    assert got == [("cpu_utilization", "c_p_u_utilization", "sum"), ("target_response_time", "target_response_time", "up")]
    one = spark.range(1).select(series_id(F.lit("m"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))))
    assert one.first()[0] == "m{a=1,b=2}"


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_values_that_are_none_hide_nothing(spark, bad):
    points = [float(10 + i % 3) for i in range(30)] + [bad, 1000.0]
    df = spark.createDataFrame([("a", i, datetime(2024, 1, 1) + timedelta(minutes=i), v) for i, v in enumerate(points)], "name string, seq long, timestamp timestamp, value double")
    assert [r["seq"] for r in anomaly.zscore_anomalies(df).collect()] == [31]
    assert [r["seq"] for r in anomaly.holdout_zscore(df).collect()] == [31]
    rules = [("high", "e", ">", 100.0, 0, "warning")]
    states = telemetry.alert_eval(df.withColumn("expression", F.lit("e")), rules, keys=["name"]).collect()
    assert [r["value"] for r in states if r["state"] != "inactive"] == [1000.0]


def test_agent_registry_takes_metric_lists(spark):
    rows = [("a", datetime(2024, 1, 1), 1, "register", ["cpu"]), ("a", datetime(2024, 1, 2), 2, "heartbeat", []), ("a", datetime(2024, 1, 3), 3, "heartbeat", ["cpu", "mem"])]
    df = spark.createDataFrame(rows, "agent_id string, timestamp timestamp, seq long, kind string, metrics array<string>")
    for name, kind in (("hostname", "string"), ("agent_version", "string"), ("deployment_id", "string"), ("metrics_count", "long"), ("paused", "boolean"), ("collection_interval", "int")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    assert store.agent_registry(df).first()["metrics"] == ["cpu", "mem"]


def names_after(spark, *events):
    rows = [(i, START + timedelta(minutes=n), n, k, name, None, None) for n, (i, k, name) in enumerate(events)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, seq long, kind string, name string, description string, environment string")
    return {r["id"]: r["name"] for r in store.deployment_registry(df.repartition(3)).collect()}


def test_a_name_is_judged_when_it_is_claimed(spark):
    assert names_after(spark, ("a", "create", "x"), ("b", "create", "x"), ("a", "update", "y")) == {"a": "y"}
    assert names_after(spark, ("a", "create", "x"), ("b", "create", "z"), ("b", "update", "x"), ("a", "delete", None)) == {"b": "z"}
    assert names_after(spark, ("a", "create", "x"), ("a", "delete", None), ("b", "create", "x"), ("c", "create", "y"), ("b", "update", "w"), ("c", "update", "x")) == {"b": "w", "c": "x"}
    assert names_after(spark, ("a", "create", "x"), ("b", "create", "y"), ("a", "update", "x"), ("a", "create", "q")) == {"a": "x", "b": "y"}
