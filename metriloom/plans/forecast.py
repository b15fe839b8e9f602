"""Forecast queries on the hourly series of every metric."""

from pyspark.sql import functions as F

from metriloom.operators import anomaly, changepoint, forecast, seasonal
from metriloom.plans.align import r
from metriloom.plans.features import rounded
from metriloom.plans.registry import query

NAME = ["name"]


def fit_sql(source, window=12, trend=24, name="fit"):
    return f"""{name}_p AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY name) AS n,
    avg(value) OVER (w ROWS {window - 1} PRECEDING) AS m FROM {source} WINDOW w AS (PARTITION BY name ORDER BY timestamp)),
{name} AS (SELECT name, count(*) AS n_points, max(timestamp) AS fitted_until, arg_max(value, timestamp) AS last_value,
    avg(value) FILTER (n - rn < {window}) AS moving_average,
    (arg_max(value, timestamp) - arg_min(value, timestamp) FILTER (n - rn < {trend})) / (least(count(*), {trend}) - 1) AS trend,
    stddev_pop(value - m) FILTER (rn >= {window}) AS std FROM {name}_p GROUP BY name)"""


STEPS12 = "(SELECT unnest(range(1, 13)) AS s)"


@query("p01_baseline_fit", "hourly", f"""WITH {fit_sql("hourly")}
SELECT name, n_points, 12 AS window, fitted_until, true AS is_fitted, round(last_value, 6) AS last_value, round(moving_average, 6) AS moving_average, round(trend, 6) AS trend, round(std, 6) AS std FROM fit""")
def p01(t):
    return rounded(forecast.baseline_fit(t.hourly, keys=NAME))


@query("p02_baseline_predict", "hourly", f"""WITH {fit_sql("hourly")}
SELECT name, CAST(s AS INT) AS step, round(moving_average + trend * s, 6) AS value,
  round(moving_average + trend * s - 1.96 * std * sqrt(s), 6) AS lower_bound, round(moving_average + trend * s + 1.96 * std * sqrt(s), 6) AS upper_bound
FROM fit, {STEPS12}""")
def p02(t):
    out = forecast.baseline_predict(forecast.baseline_fit(t.hourly, keys=NAME), 12)
    return rounded(out.select("name", "step", "value", "lower_bound", "upper_bound"))


CUT = "TIMESTAMP '2024-01-26'"
HOLDOUT = f"""past AS (SELECT * FROM hourly WHERE timestamp < {CUT}), {fit_sql("past")},
due AS (SELECT h.name, h.timestamp, h.value AS actual, last_value, moving_average + trend * (date_diff('hour', fitted_until, h.timestamp)) AS predicted,
  date_diff('hour', fitted_until, h.timestamp) AS step FROM hourly h JOIN fit USING (name) WHERE h.timestamp >= {CUT})"""


def holdout(t):
    cut = F.lit("2024-01-26").cast("timestamp_ntz")
    params = forecast.baseline_fit(t.hourly.where(F.col("timestamp") < cut), keys=NAME)
    later = t.hourly.where(F.col("timestamp") >= cut).withColumnRenamed("value", "actual")
    hours = ((F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.unix_seconds(F.col("fitted_until").cast("timestamp"))) / 3600).cast("bigint")
    return later.join(params, "name").withColumn("step", hours).withColumn("predicted", F.col("moving_average") + F.col("trend") * hours)


@query("p03_forecast_metrics", "hourly", f"""WITH {HOLDOUT}
SELECT name, count(*) AS n, round(avg(abs(actual - predicted)), 5) AS mae, round(avg((actual - predicted) ** 2), 4) AS mse, round(sqrt(avg((actual - predicted) ** 2)), 5) AS rmse,
  round(avg(abs((actual - predicted) / (actual + 1e-8))) * 100, 4) AS mape, round(1 - avg(abs(actual - predicted)) / avg(abs(actual - last_value)), 6) AS skill_score
FROM due GROUP BY name""")
def p03(t):
    out = forecast.forecast_metrics(holdout(t), by=NAME, naive="last_value")
    return out.select("name", "n", r("mae", 5), r("mse", 4), r("rmse", 5), r("mape", 4), r("skill_score"))


@query("p04_train_baseline", "hourly", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY name) AS total FROM hourly),
train AS (SELECT * FROM s WHERE i <= floor(total * 0.8)), {fit_sql("train", 6)},
due AS (SELECT s.name, value AS actual, f.*, moving_average + trend * (i - n_points) AS predicted FROM s JOIN fit f ON s.name = f.name WHERE i > floor(total * 0.8))
SELECT name, 6 AS window, n_points AS train_size, round(moving_average, 6) AS moving_average, round(trend, 6) AS trend, count(*) AS test_size,
  round(avg(abs(actual - predicted)), 5) AS mae, round(avg((actual - predicted) ** 2), 4) AS mse, round(sqrt(avg((actual - predicted) ** 2)), 5) AS rmse,
  round(avg(abs((actual - predicted) / (actual + 1e-8))) * 100, 4) AS mape, round(1 - avg(abs(actual - predicted)) / avg(abs(actual - last_value)), 6) AS skill_score
FROM due GROUP BY name, n_points, moving_average, trend""")
def p04(t):
    out = forecast.train_baseline(t.hourly, keys=NAME)
    return out.select(
        "name", "window", "train_size", r("moving_average"), r("trend"), "test_size", r("mae", 5), r("mse", 4), r("rmse", 5), r("mape", 4), r("skill_score")
    )


ONLINE = f"""p AS (SELECT *, row_number() OVER (PARTITION BY name, host ORDER BY timestamp DESC, seq DESC) AS k FROM samples),
o AS (SELECT name, host, count(*) AS n, arg_min(value, k) AS last, avg(value) FILTER (k <= 12) AS ma, avg(value) FILTER (k > 12) AS prev, stddev_pop(value) FILTER (k <= 12) AS sd FROM p WHERE k <= 24 GROUP BY 1, 2),
x AS (SELECT *, s AS step, CASE WHEN n < 12 THEN last ELSE greatest(0, ma + CASE WHEN n >= 24 THEN (ma - prev) / 12 ELSE 0 END * s) END AS value FROM o, {STEPS12})"""


@query("p05_online_baseline", "samples", f"WITH {ONLINE} SELECT name, host, CAST(step AS INT) AS step, round(value, 6) AS value FROM x")
def p05(t):
    out = forecast.online_baseline(t.samples, 12, keys=["name", "host"])
    return out.select("name", "host", "step", r("value"))


@query("p06_online_baseline_band", "samples", f"""WITH {ONLINE} SELECT name, host, CAST(step AS INT) AS step,
  round(CASE WHEN n < 12 THEN 0 ELSE greatest(0, value - 2.576 * sd) END, 6) AS lower_bound, round(CASE WHEN n < 12 THEN 1 ELSE value + 2.576 * sd END, 6) AS upper_bound FROM x""")
def p06(t):
    out = forecast.online_baseline(t.samples, 12, keys=["name", "host"], confidence=0.99)
    return out.select("name", "host", "step", r("lower_bound"), r("upper_bound"))


@query("p07_portable_forecast", "hourly", f"""WITH {fit_sql("hourly")}, x AS (SELECT *, s, greatest(0, moving_average + trend * s) AS v FROM fit, {STEPS12})
SELECT name, CAST(s AS INT) AS step, round(v, 6) AS value, round(greatest(0, v - 1.96 * std), 6) AS lower_bound, round(v + 1.96 * std, 6) AS upper_bound FROM x""")
def p07(t):
    out = forecast.portable_forecast(forecast.baseline_fit(t.hourly, keys=NAME), 12)
    return rounded(out.select("name", "step", "value", "lower_bound", "upper_bound"))


def seasonal_sql(source, keys="name", name="sea"):
    return f"""{name}_x AS (SELECT *, epoch_us(timestamp) / 86400000000.0 AS x, CAST(hour(timestamp) AS INT) AS h, CAST(isodow(timestamp) - 1 AS INT) AS d FROM {source}),
{name}_l AS (SELECT {keys}, regr_slope(value, x) AS slope, avg(x) AS mx, avg(value) AS my, count(*) AS n_points, max(timestamp) AS fitted_until FROM {name}_x GROUP BY {keys}),
{name}_t AS (SELECT *, my + slope * (x - mx) AS tr FROM {name}_x JOIN {name}_l USING ({keys})),
{name}_d AS (SELECT {keys}, h, avg(value / tr) AS daily FROM {name}_t GROUP BY {keys}, h),
{name}_w AS (SELECT {keys}, d, avg(value / tr / daily) AS weekly FROM {name}_t JOIN {name}_d USING ({keys}, h) GROUP BY {keys}, d),
{name} AS (SELECT {keys}, any_value(slope) AS slope, any_value(mx) AS mx, any_value(my) AS my, any_value(n_points) AS n_points, any_value(fitted_until) AS fitted_until,
   stddev_pop(value - tr * daily * weekly) AS std FROM {name}_t JOIN {name}_d USING ({keys}, h) JOIN {name}_w USING ({keys}, d) GROUP BY {keys})"""


@query("p08_seasonal_forecast", "hourly", f"""WITH {seasonal_sql("hourly")},
f AS (SELECT *, s AS step, fitted_until + to_hours(s) AS timestamp FROM sea, (SELECT unnest(range(1, 49)) AS s)),
v AS (SELECT f.*, my + slope * (epoch_us(timestamp) / 86400000000.0 - mx) AS tr, daily, weekly FROM f
  JOIN sea_d ON f.name = sea_d.name AND h = hour(timestamp) JOIN sea_w ON f.name = sea_w.name AND d = isodow(timestamp) - 1)
SELECT name, CAST(step AS INT) AS step, timestamp, round(tr, 5) AS trend, round(daily, 5) AS daily_component, round(weekly, 5) AS weekly_component, round(tr * daily * weekly, 5) AS predicted,
  round(tr * daily * weekly - 1.96 * std, 5) AS lower_bound, round(tr * daily * weekly + 1.96 * std, 5) AS upper_bound FROM v""")
def p08(t):
    out = seasonal.seasonal_forecast(seasonal.seasonal_fit(t.hourly, keys=NAME), 48, step_seconds=3600)
    cols = ["trend", "daily_component", "weekly_component", "predicted", "lower_bound", "upper_bound"]
    return out.select("name", "step", "timestamp", *[r(c, 5) for c in cols])


@query("p09_seasonal_evaluate", "hourly", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY name) AS total FROM hourly),
train AS (SELECT name, timestamp, value FROM s WHERE i <= floor(total * 0.8)), {seasonal_sql("train")},
v AS (SELECT s.name, value AS actual, n_points, std, (my + slope * (epoch_us(timestamp) / 86400000000.0 - mx)) * daily * weekly AS predicted FROM s JOIN sea USING (name)
  JOIN sea_d ON s.name = sea_d.name AND h = hour(timestamp) JOIN sea_w ON s.name = sea_w.name AND d = isodow(timestamp) - 1 WHERE i > floor(total * 0.8))
SELECT name, n_points AS train_size, count(*) AS test_size, round(avg(abs(actual - predicted)), 5) AS mae, round(avg((actual - predicted) ** 2), 4) AS mse,
  round(sqrt(avg((actual - predicted) ** 2)), 5) AS rmse, round(avg(abs((actual - predicted) / (actual + 1e-8))) * 100, 4) AS mape,
  round(avg(CAST(actual BETWEEN predicted - 1.96 * std AND predicted + 1.96 * std AS INT)) * 100, 5) AS coverage FROM v GROUP BY 1, 2""")
def p09(t):
    out = seasonal.seasonal_evaluate(t.hourly, keys=NAME)
    return out.select("name", "train_size", "test_size", r("mae", 5), r("mse", 4), r("rmse", 5), r("mape", 4), r("coverage", 5))


@query("p10_rolling_origin_cv", "hourly", f"""
WITH e AS (SELECT name, max(timestamp) - INTERVAL 24 HOUR AS last, min(timestamp) AS start FROM hourly GROUP BY 1),
c AS (SELECT name, last - to_hours(48 * k) AS cutoff FROM e, (SELECT unnest(range(0, 100)) AS k) WHERE last - to_hours(48 * k) >= start + INTERVAL 20 DAY),
train AS (SELECT name, cutoff, timestamp, value FROM hourly JOIN c USING (name) WHERE timestamp <= cutoff), {seasonal_sql("train", "name, cutoff")},
v AS (SELECT o.name, date_diff('hour', cutoff, timestamp) * 3600 AS horizon_seconds, value AS actual, std, (my + slope * (epoch_us(timestamp) / 86400000000.0 - mx)) * daily * weekly AS predicted
  FROM hourly o JOIN sea USING (name) JOIN sea_d USING (name, cutoff) JOIN sea_w USING (name, cutoff)
  WHERE h = hour(timestamp) AND d = isodow(timestamp) - 1 AND timestamp > cutoff AND timestamp <= cutoff + INTERVAL 24 HOUR)
SELECT name, horizon_seconds, count(*) AS n, round(avg(abs(actual - predicted)), 5) AS mae, round(avg((actual - predicted) ** 2), 4) AS mse, round(sqrt(avg((actual - predicted) ** 2)), 5) AS rmse,
  round(avg(abs((actual - predicted) / (actual + 1e-8))) * 100, 3) AS mape, round(avg(CAST(actual BETWEEN predicted - 1.96 * std AND predicted + 1.96 * std AS INT)), 5) AS coverage FROM v GROUP BY 1, 2""")
def p10(t):
    out = seasonal.rolling_origin_cv(
        t.hourly, keys=NAME, initial_seconds=20 * 86400, period_seconds=2 * 86400, horizon_seconds=86400
    )
    return out.select("name", "horizon_seconds", "n", r("mae", 5), r("mse", 4), r("rmse", 5), r("mape", 3), r("coverage", 5))


@query("p11_seasonal_components", "hourly", "SELECT name, 'multiplicative' AS mode, 0 AS n_changepoints, 'daily,weekly' AS seasonalities FROM hourly GROUP BY name")
def p11(t):
    out = seasonal.seasonal_components(seasonal.seasonal_fit(t.hourly, keys=NAME), keys=NAME)
    return out.withColumn("seasonalities", F.concat_ws(",", "seasonalities"))


# the design of the trend with changepoints as SQL: columns x[1..42], value last
BENT_DESIGN = f"""e AS (SELECT *, epoch_us(timestamp) AS us FROM hourly WHERE value IS NOT NULL),
g AS (SELECT name, min(us) AS a, max(us) - min(us) AS span, max(abs(value)) AS top FROM e GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT name, (us - a) / span AS t, 2 * pi() * (us % {changepoint.DAY}) / {changepoint.DAY} AS p, 2 * pi() * (us % {changepoint.WEEK}) / {changepoint.WEEK} AS q, value / top AS y FROM e JOIN g USING (name)),
x AS (SELECT name, list_concat([1.0, t], list_transform(range(1, {changepoint.CANDIDATES + 1}), lambda k: greatest(0.0, t - {changepoint.COVERED} * k / {changepoint.CANDIDATES})),
  list_transform(range(1, 5), lambda k: sin(k * p)), list_transform(range(1, 5), lambda k: cos(k * p)), list_transform(range(1, 4), lambda k: sin(k * q)), list_transform(range(1, 4), lambda k: cos(k * q)), [y]) AS x FROM d)"""


@query("p08_trend_gram", "hourly", f"""WITH {BENT_DESIGN}, n AS (SELECT unnest(range(1, {changepoint.TERMS + 2})) AS i), pairs AS (SELECT a.i, b.i AS j FROM n a JOIN n b ON a.i <= b.i)
SELECT name, CAST(i AS INT) AS row, CAST(j AS INT) AS column, round(sum(x[i] * x[j]), 4) AS product FROM x, pairs GROUP BY 1, 2, 3""")
def p08_gram(t):
    rows = changepoint.design_rows(t.hourly, keys=NAME)
    sums = changepoint.gram_sums(rows, NAME).select("name", F.posexplode("gram").alias("_at", "_sum"))
    place = F.array(*[F.struct(F.lit(int(i) + 1).alias("row"), F.lit(int(j) + 1).alias("column")) for i, j in zip(*changepoint.UPPER)])
    return sums.select("name", place[F.col("_at")].alias("_place"), r("_sum", 4).alias("product")).select("name", "_place.row", "_place.column", "product")


def bent(t):
    return changepoint.changepoint_fit(t.hourly, keys=NAME)


@query("p08_changepoint_forecast")
def p08_bent(t):
    out = changepoint.changepoint_forecast(bent(t), 48, step_seconds=3600)
    cols = ["trend", "daily_component", "weekly_component", "predicted", "lower_bound", "upper_bound"]
    return out.select("name", "step", "timestamp", *[r(c, 5) for c in cols])


@query("p09_changepoint_evaluate")
def p09_bent(t):
    out = changepoint.changepoint_evaluate(t.hourly, keys=NAME)
    return out.select("name", "train_size", "test_size", r("mae", 5), r("mse", 4), r("rmse", 5), r("mape", 4), r("coverage", 5))


@query("p11_changepoint_components")
def p11_bent(t):
    out = changepoint.changepoint_components(bent(t), keys=NAME)
    return out.select("name", "mode", "n_candidates", "n_changepoints", F.concat_ws(",", "seasonalities").alias("seasonalities"))


@query("p14_fixed_margin_band", "samples", """
SELECT seq, greatest(0, value / 400 - 0.1) AS lower_bound, least(1, value / 400 + 0.1) AS upper_bound, round(value / 400 * 0.9, 8) AS seasonal_lower, round(value / 400 * 1.1, 8) AS seasonal_upper FROM samples""")
def p14(t):
    base = t.samples.select("seq", (F.col("value") / 400).alias("value"))
    wide = forecast.relative_band(base).select("seq", "value", r("lower_bound", 8).alias("seasonal_lower"), r("upper_bound", 8).alias("seasonal_upper"))
    return forecast.fixed_margin_band(wide).select("seq", "lower_bound", "upper_bound", "seasonal_lower", "seasonal_upper")


@query("p15_forecast_many", "hourly", f"""WITH {fit_sql("hourly")}, {seasonal_sql("hourly")},
b AS (SELECT name, s AS step, 'baseline' AS model, moving_average + trend * s AS value, 1.96 * std * sqrt(s) AS m FROM fit, {STEPS12}),
f AS (SELECT *, s AS step, fitted_until + to_hours(s) AS ts FROM sea, {STEPS12}),
p AS (SELECT f.name, step, 'seasonal' AS model, (my + slope * (epoch_us(ts) / 86400000000.0 - mx)) * daily * weekly AS value, 1.96 * std AS m FROM f
  JOIN sea_d ON f.name = sea_d.name AND h = hour(ts) JOIN sea_w ON f.name = sea_w.name AND d = isodow(ts) - 1),
u AS (SELECT * FROM p UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM p))
SELECT name, CAST(step AS INT) AS step, (SELECT max(timestamp) FROM hourly) + to_minutes(5 * step) AS timestamp, model, round(value, 5) AS value, round(value - m, 5) AS lower_bound, round(value + m, 5) AS upper_bound FROM u""")
def p15(t):
    base = forecast.baseline_predict(forecast.baseline_fit(t.hourly, keys=NAME), 12)
    sea = seasonal.seasonal_forecast(seasonal.seasonal_fit(t.hourly, keys=NAME), 12, step_seconds=3600).withColumnRenamed("predicted", "value")
    out = forecast.forecast_many(
        {"baseline": base, "seasonal": sea}, "seasonal", keys=NAME, as_of=t.hourly.agg(F.max("timestamp")).scalar()
    )
    return out.select("name", "step", "timestamp", "model", r("value", 5), r("lower_bound", 5), r("upper_bound", 5))


@query("p16_compare_models", "hourly", f"""WITH {HOLDOUT}, {seasonal_sql("past")},
v AS (SELECT o.name, value AS actual, (my + slope * (epoch_us(timestamp) / 86400000000.0 - mx)) * daily * weekly AS predicted FROM hourly o JOIN sea USING (name)
  JOIN sea_d ON o.name = sea_d.name AND h = hour(timestamp) JOIN sea_w ON o.name = sea_w.name AND d = isodow(timestamp) - 1 WHERE timestamp >= {CUT}),
u AS (SELECT name, 'baseline' AS model, actual, predicted FROM due UNION ALL SELECT name, 'seasonal', actual, predicted FROM v),
g AS (SELECT name, model, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs((actual - predicted) / (actual + 1e-8))) * 100 AS mape FROM u GROUP BY 1, 2)
SELECT name, model, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(mape, 4) AS mape, round((b.base - mae) / b.base * 100, 4) AS improvement
FROM g JOIN (SELECT name, mae AS base FROM g WHERE model = 'baseline') b USING (name)""")
def p16(t):
    cut = F.lit("2024-01-26").cast("timestamp_ntz")
    base = forecast.forecast_metrics(holdout(t), by=NAME).withColumn("model", F.lit("baseline"))
    params = seasonal.seasonal_fit(t.hourly.where(F.col("timestamp") < cut), keys=NAME)
    later = t.hourly.where(F.col("timestamp") >= cut).withColumnRenamed("value", "actual").join(params, "name")
    sea = forecast.forecast_metrics(seasonal.seasonal_values(later), by=NAME).withColumn("model", F.lit("seasonal"))
    out = forecast.compare_models(base.unionByName(sea), keys=NAME)
    return out.select("name", "model", r("mae", 5), r("rmse", 5), r("mape", 4), r("improvement", 4))


@query("p17_forecast_summary", "samples", f"""WITH {ONLINE},
g AS (SELECT name, host, max(value) AS peak, avg(value) AS average, arg_max(value, step) AS latest, max(value) FILTER (step = 9) AS earlier FROM x GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN earlier > 0 THEN CAST(floor((latest - earlier) / earlier * 100 + 0.5) AS BIGINT) ELSE 0 END AS change_percent FROM g)
SELECT name, host, round(peak, 6) AS peak, round(average, 6) AS average, round(latest, 6) AS latest, change_percent,
  CASE WHEN change_percent > 5 THEN 'increasing' WHEN change_percent < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM c""")
def p17(t):
    out = forecast.forecast_summary(forecast.online_baseline(t.samples, 12, keys=["name", "host"]), keys=["name", "host"])
    return out.select("name", "host", r("peak"), r("average"), r("latest"), "change_percent", "trend")


@query("p18_forecast_vs_actual", "hourly", f"""WITH {HOLDOUT}
SELECT name, step * 60 AS horizon_minutes, count(*) AS n, round(avg(abs(actual - predicted)), 5) AS mae, round(avg((actual - predicted) ** 2), 4) AS mse,
  round(sqrt(avg((actual - predicted) ** 2)), 5) AS rmse, round(avg(abs((actual - predicted) / (actual + 1e-8))) * 100, 4) AS mape
FROM due WHERE step <= 24 GROUP BY 1, 2""")
def p18(t):
    cut = F.lit("2024-01-26").cast("timestamp_ntz")
    params = forecast.baseline_fit(t.hourly.where(F.col("timestamp") < cut), keys=NAME)
    stored = forecast.baseline_predict(params, 24).select(
        "name",
        (F.col("step") * 60).cast("bigint").alias("horizon_minutes"),
        (F.col("fitted_until") + F.make_dt_interval(hours="step")).alias("timestamp"),
        "value",
    )
    out = forecast.forecast_vs_actual(stored, t.hourly, keys=NAME, period=3600)
    return out.select("name", "horizon_minutes", "n", r("mae", 5), r("mse", 4), r("rmse", 5), r("mape", 4))


@query("n08_residual_over_std", "hourly", f"""WITH {HOLDOUT}, s AS (SELECT name, stddev_pop(abs(actual - predicted)) AS sd FROM due GROUP BY 1)
SELECT name, timestamp, round(abs(actual - predicted), 5) AS residual, round(abs(actual - predicted) / sd, 5) AS score FROM due JOIN s USING (name)""")
def n08(t):
    out = anomaly.residual_over_std(holdout(t), keys=NAME, actual="actual", predicted="predicted")
    return out.select("name", "timestamp", r("residual", 5), r("score", 5))


@query("n09_detector_evaluate", "hourly", f"""WITH {HOLDOUT}, s AS (SELECT name, stddev_pop(abs(actual - predicted)) AS sd FROM due GROUP BY 1),
x AS (SELECT name, actual > 70 AS truth, round(abs(actual - predicted) / sd, 5) AS score, round(abs(actual - predicted) / sd, 5) > 2.5 AS flag FROM due JOIN s USING (name)),
g AS (SELECT name, count(*) FILTER (flag) AS n_anomalies, count(*) FILTER (flag) / count(*) AS anomaly_rate, avg(score) AS mean_score, max(score) AS max_score, stddev_pop(score) AS std_score,
  count(*) FILTER (flag AND truth) / (count(*) FILTER (flag) + 1e-8) AS p, count(*) FILTER (flag AND truth) / (count(*) FILTER (truth) + 1e-8) AS r FROM x GROUP BY 1)
SELECT name, n_anomalies, round(anomaly_rate, 6) AS anomaly_rate, round(mean_score, 5) AS mean_score, max_score, round(std_score, 5) AS std_score,
  round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-8), 6) AS f1_score FROM g""")
def n09(t):
    scored = anomaly.residual_over_std(holdout(t), keys=NAME, actual="actual", predicted="predicted").withColumn("score", F.round("score", 5))
    marked = scored.withColumn("flag", F.col("score") > 2.5).withColumn("truth", F.col("actual") > 70)
    out = anomaly.detector_evaluate(marked, keys=NAME, label="truth")
    return out.select(
        "name", "n_anomalies", r("anomaly_rate"), r("mean_score", 5), "max_score", r("std_score", 5), r("precision"), r("recall"), r("f1_score")
    )
