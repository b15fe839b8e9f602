"""Queries that fit models, and the retraining job."""

from datetime import datetime

from pyspark.sql import functions as F

from metriloom.operators import boosted, isolation, model_store, retrain, store
from metriloom.operators import forecast as fc
from metriloom.operators import seasonal
from metriloom.plans.align import r
from metriloom.plans.forecast import CUT, HOLDOUT, NAME, holdout, seasonal_sql
from metriloom.plans.registry import query
from metriloom.session import new_path, written
from metriloom.sources import tables


def ratios(t):
    """Hourly series scaled into [0, 1], as the recursive forecast expects."""
    return t.hourly.withColumn("value", F.least(F.lit(1.0), F.col("value") / 150))


# A fitted model's digits are its own; the SQL states the rows, counts and relations that must hold.
@query("p12_boosted_forecaster_train", "hourly", """
WITH n AS (SELECT name, count(*) - 13 AS n FROM hourly GROUP BY name HAVING count(*) > 13), x AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS k FROM n),
s AS (SELECT name, least(1, value / 150) AS y, row_number() OVER (PARTITION BY name ORDER BY timestamp) AS i FROM hourly),
v AS (SELECT s.name, round(var_pop(y), 8) AS train_variance FROM s JOIN x USING (name) WHERE i > 13 AND i <= 13 + k GROUP BY 1)
SELECT name, k AS train_samples, n - k AS test_samples, train_variance, true AS learns FROM x JOIN v USING (name)""")
def p12(t):
    e = boosted.boosted_forecasters_train(ratios(t), keys=NAME).evaluation.where("train_samples > 0")
    return e.select("name", "train_samples", "test_samples", r("train_variance", 8), (F.col("train_mse") < 0.5 * F.col("train_variance")).alias("learns"))


@query("p13_recursive_forecast", "hourly", """
WITH s AS (SELECT name, count(*) AS n, least(1, arg_max(value, timestamp) / 150) AS last FROM hourly GROUP BY 1)
SELECT name, CAST(unnest(range(1, 13)) AS INT) AS step, n >= 14 AS has_model, CASE WHEN n < 14 THEN round(last, 8) END AS flat_value, true AS first_step_is_prediction FROM s""")
def p13(t):
    frame = ratios(t)
    fitted = boosted.boosted_forecasters_train(frame, keys=NAME)
    out = boosted.recursive_forecast(frame, fitted, 12, keys=NAME)
    # the first step once more, from the features of the newest rows and the stored trees
    again = boosted.next_values(frame, fitted, keys=NAME)
    joined = out.join(again, "name", "left")
    same = F.when((F.col("step") == 1) & F.col("next").isNotNull(), F.abs(F.col("value") - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("next")))) < 1e-9).otherwise(True)
    return joined.select(
        "name", F.col("step").cast("int").alias("step"), F.col("next").isNotNull().alias("has_model"),
        F.when(F.col("next").isNull(), F.round("value", 8)).alias("flat_value"), same.alias("first_step_is_prediction"),
    )


DETECTED = ["memory_usage", "rps", "latency", "joined"]
DEPLOYMENT = ["deployment"]


def detected(t):
    hours = F.unix_seconds(F.col("timestamp").cast("timestamp")) / 3600
    frame = t.wide_all.withColumn("key", hours.cast("bigint")).fillna(0.0, DETECTED)  # an hour without a sample of an input
    return frame, boosted.residual_detectors_fit(frame, "cpu_usage", DETECTED, keys=DEPLOYMENT, split_key="key")


# few rows can hold no outlier beyond the threshold, so how many are flagged is bounded from above only
@query("n06_residual_detector_fit", "wide_all", """
WITH c AS (SELECT deployment, count(*) AS rows, count(*) FILTER (CAST(epoch(timestamp) AS BIGINT) // 3600 % 5 <> 0) AS fitted_on FROM wide_all WHERE cpu_usage IS NOT NULL GROUP BY 1)
SELECT deployment, rows, true AS few_flagged, true AS threshold_is_the_higher FROM c WHERE fitted_on > 0""")
def n06(t):
    frame, fitted = detected(t)
    scored = boosted.residual_detectors_score(frame, fitted, keys=DEPLOYMENT)
    spread = scored.groupBy("deployment").agg(
        F.count("*").alias("rows"), F.count_if("flag").alias("flagged"), (F.avg("score") + 2.5 * F.stddev_pop("score")).alias("far"), F.percentile("score", 0.95).alias("top")
    )
    out = spread.join(fitted.models.select("deployment", "threshold"), "deployment")
    return out.select(
        "deployment", "rows", (F.col("flagged") <= F.ceil(F.col("rows") * 0.05)).alias("few_flagged"),
        (F.abs(F.col("threshold") - F.greatest("far", "top")) < 1e-9).alias("threshold_is_the_higher"),
    )


@query("n07_residual_detector_score", "wide_all", """
WITH c AS (SELECT *, CAST(epoch(timestamp) AS BIGINT) // 3600 % 5 <> 0 AS fitted_on FROM wide_all WHERE cpu_usage IS NOT NULL),
k AS (SELECT deployment FROM c GROUP BY 1 HAVING bool_or(fitted_on))
SELECT deployment, timestamp, round(cpu_usage, 6) AS cpu_usage, true AS is_residual, true AS is_flagged_above, 4 AS ranked_features FROM c JOIN k USING (deployment)""")
def n07(t):
    frame, fitted = detected(t)
    scored = boosted.residual_detectors_score(frame, fitted, keys=DEPLOYMENT)
    shares = boosted.series_importance(fitted, keys=DEPLOYMENT).groupBy("deployment").agg(
        F.count("*").cast("int").alias("ranked_features"), F.sum("importance").alias("whole")
    )
    out = scored.join(fitted.models.select("deployment", "threshold"), "deployment").join(shares, "deployment")
    return out.select(
        "deployment",
        "timestamp",
        r("cpu_usage"),
        (F.abs(F.col("score") - F.abs(F.col("cpu_usage") - F.col("prediction"))) < 1e-12).alias("is_residual"),
        (F.col("flag") == (F.col("score") > F.col("threshold"))).alias("is_flagged_above"),
        F.when(F.abs(F.col("whole") - 1) < 1e-9, F.col("ranked_features")).alias("ranked_features"),
    )


COMPLETE = "cpu_usage IS NOT NULL AND memory_usage IS NOT NULL AND rps IS NOT NULL AND latency IS NOT NULL"


def keyed_wide(t):
    hours = F.unix_seconds(F.col("timestamp").cast("timestamp")) / 3600
    return t.wide.withColumn("key", hours.cast("bigint"))


@query("n10_isolation_forest", "wide", """
WITH c AS (SELECT timestamp, cpu_usage, memory_usage FROM wide WHERE cpu_usage IS NOT NULL AND memory_usage IS NOT NULL)
SELECT timestamp, round(cpu_usage, 6) AS cpu_usage, round(memory_usage, 6) AS memory_usage, true AS in_range, true AS is_flagged_below, true AS share_holds FROM c""")
def n10(t):
    cols = ["cpu_usage", "memory_usage"]
    forest = isolation.isolation_forest_fit(keyed_wide(t), cols, key="key")
    scored = isolation.isolation_forest_score(keyed_wide(t), forest)
    # flagged are those below the 5 % point: at most that share, and one row of interpolation less
    share = scored.agg((F.abs(F.count_if("flag") - F.count("*") * 0.05) <= 1).alias("ok")).scalar()
    return scored.select(
        "timestamp",
        *[r(c) for c in cols],
        F.col("score_sample").between(-1, 0).alias("in_range"),
        (F.col("flag") == (F.col("decision") < 0)).alias("is_flagged_below"),
        share.alias("share_holds"),
    )


@query("n11_isolation_score_scaled", "samples", """
WITH m AS (SELECT name FROM samples GROUP BY 1 HAVING count(value) >= 5),
x AS (SELECT name, min(value) AS lowest, max(value) AS highest FROM samples JOIN m USING (name) GROUP BY 1)
SELECT name, round(lowest, 6) AS lowest, round(highest, 6) AS highest, true AS ends_score_most, true AS cut_holds, true AS of_samples FROM x""")
def n11(t):
    forest = isolation.isolation_forest_fit(keyed_wide(t), ["cpu_usage", "memory_usage"], key="key")
    # the scaled decision of a forest stays below 2.5 by construction, so all rows are scored and the cut is set on them
    scored = isolation.isolation_score_scaled(t.samples, forest, sigma=-1.0)
    flagged = isolation.isolation_score_scaled(t.samples, forest, sigma=0.5)
    own = t.samples.select("seq", F.col("value").alias("_v"))
    hits = flagged.join(own, "seq", "left").groupBy("name").agg(F.count("*").alias("_hits"), F.bool_and((F.col("value") == F.col("_v")) & (F.col("score") > 0.5)).alias("of_samples"))
    ends = scored.groupBy("name").agg(
        F.min("value").alias("lowest"), F.max("value").alias("highest"), F.max("score").alias("_most"),
        F.greatest(F.max_by("score", "value"), F.min_by("score", "value")).alias("_end"), F.count_if(F.col("score") > 0.5).alias("_over"),
    )
    # nothing is more isolated than the farther end of the values, and the rows returned are those over the cut
    out = ends.join(hits, "name", "left")
    return out.select(
        "name", r("lowest"), r("highest"), (F.col("_end") >= F.col("_most") - 1e-9).alias("ends_score_most"),
        (F.coalesce("_hits", F.lit(0)) == F.col("_over")).alias("cut_holds"), F.coalesce("of_samples", F.col("_over") == 0).alias("of_samples"),
    )


@query("n11_zscore_fallback", "samples", """
WITH m AS (SELECT name, avg(value) AS mean, greatest(stddev_pop(value), 0.001) AS std FROM samples GROUP BY 1 HAVING count(value) >= 5)
SELECT name, seq, value, round(abs(value - mean) / std, 6) AS score FROM samples JOIN m USING (name) WHERE abs(value - mean) / std > 2.5""")
def n11_fallback(t):
    return isolation.isolation_score_scaled(t.samples, None).select("name", "seq", "value", r("score"))


@query("s13_model_parameters", "hourly", "SELECT name, count(*) AS n_points, 'baseline' AS model, 3 AS version FROM hourly GROUP BY 1")
def s13(t):
    params = fc.baseline_fit(t.hourly, keys=NAME)
    path = new_path(t.spark, "parameters")
    for version in (1, 3):
        tables.write_parameters(params, path, model="baseline", version=version)
    return tables.read_parameters(t.spark, path, model="baseline", version=3).select(
        "name", "n_points", "model", F.col("version").cast("int").alias("version")
    )


STORED_AT = datetime(2024, 2, 1)  # the evaluation time of the stored versions and runs


@query("s13_model_store", "wide_all", """
WITH c AS (SELECT *, CAST(epoch(timestamp) AS BIGINT) // 3600 % 5 <> 0 AS fitted_on FROM wide_all WHERE cpu_usage IS NOT NULL),
k AS (SELECT deployment FROM c GROUP BY 1 HAVING bool_or(fitted_on))
SELECT deployment, timestamp, round(cpu_usage, 6) AS cpu_usage, true AS same_score, true AS same_flag FROM c JOIN k USING (deployment)""")
def s13_store(t):
    """Detectors stored, read in another session and scoring as they did."""
    frame, fitted = detected(t)
    root = new_path(t.spark, "store")
    model_store.save_version(t.spark, root, 1, {"detector": fitted}, keys=DEPLOYMENT, committed_at=STORED_AT)
    back = model_store.load(t.spark.newSession(), root, "detector")
    back = boosted.SeriesDetectors(t.spark.read.schema(back.models.schema).parquet(*back.models.inputFiles()), back.features, back.target)
    now = boosted.residual_detectors_score(frame, fitted, keys=DEPLOYMENT)
    then = boosted.residual_detectors_score(frame, back, keys=DEPLOYMENT).select(*DEPLOYMENT, "timestamp", F.col("score").alias("_score"), F.col("flag").alias("_flag"))
    both = now.join(then, [*DEPLOYMENT, "timestamp"])
    return both.select(*DEPLOYMENT, "timestamp", r("cpu_usage"), (F.col("score") == F.col("_score")).alias("same_score"), (F.col("flag") == F.col("_flag")).alias("same_flag"))


@query("j05_store_registry", "hourly", """
WITH n AS (SELECT name, count(*) AS n FROM hourly GROUP BY 1)
SELECT 'baseline' AS model, CAST(2 AS BIGINT) AS version, 'table' AS kind, count(*) AS n_series FROM n
UNION ALL SELECT 'forecaster', 1, 'series_forecasters', count(*) FILTER (n >= 15) FROM n""")
def j05_store(t):
    root = new_path(t.spark, "store")
    forecaster = boosted.boosted_forecasters_train(ratios(t), keys=NAME, trees=10)
    params = fc.baseline_fit(t.hourly, keys=NAME)
    model_store.save_version(t.spark, root, 1, {"baseline": params, "forecaster": forecaster}, committed_at=STORED_AT)
    model_store.save_version(t.spark, root, 2, {"baseline": params}, committed_at=STORED_AT)
    return model_store.registry(t.spark, root).select("model", "version", "kind", "n_series")


@query("j01_run_log", "hourly", """
SELECT name AS series, 'first' AS run_id, count(*) AS data_points, CASE WHEN count(*) >= 100 THEN 'completed' ELSE 'skipped' END AS status, count(*) >= 100 AS deployed,
  CASE WHEN count(*) < 100 THEN 'Insufficient data: got ' || count(*) || ', need 100' END AS error, count(*) >= 100 AS measured FROM hourly GROUP BY 1""")
def j01_log(t):
    root = new_path(t.spark, "job")
    run = {"keys": NAME, "store": f"{root}/store", "log": f"{root}/log", "run_id": "first", "version": 1, "started_at": STORED_AT, "target": "value"}
    rows = written(retrain.retrain_job(t.hourly, trees=20, **run), "run")
    model_store.append_runs(rows, run["log"], run["run_id"])  # a repeated write replaces the run
    logged = model_store.read_runs(t.spark, run["log"])
    return logged.select("series", "run_id", "data_points", "status", "deployed", "error", (F.size("metrics") > 0).alias("measured"))


@query("j01_gates", "samples", """
WITH h AS (SELECT name, deployment, count(DISTINCT date_trunc('hour', timestamp)) AS data_points FROM samples GROUP BY 1, 2)
SELECT name, deployment, data_points, CASE WHEN data_points >= 310 THEN 'ready' ELSE 'skipped' END AS status,
  CASE WHEN data_points < 310 THEN 'Insufficient data: got ' || data_points || ', need 310' END AS error FROM h""")
def j01(t):
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    frame = t.samples.groupBy("name", "deployment", hour).agg(F.avg("value").alias("value"))
    return retrain.gates(frame, keys=["name", "deployment"], min_points=310)


@query("j02_train_all", "hourly", """
WITH ready AS (SELECT name FROM hourly GROUP BY 1 HAVING count(*) >= 100),
m(model, metric) AS (VALUES ('baseline', 'rmse'), ('baseline', 'mae'), ('baseline', 'mape'), ('baseline', 'skill_score'), ('seasonal', 'rmse'), ('seasonal', 'mae'),
  ('seasonal', 'mape'), ('seasonal', 'coverage'), ('residual_detector', 'threshold'), ('residual_detector', 'mean_error'), ('residual_detector', 'anomalies'), ('residual_detector', 'anomaly_rate'))
SELECT name, model, metric, true AS measured, 0 AS failed_models FROM ready, m""")
def j02(t):
    rows, failed = retrain.train_all(t.hourly, keys=NAME, target="value")
    out = rows.select("name", "model", F.explode("metrics").alias("metric", "value"))
    return out.select("name", "model", "metric", F.col("value").isNotNull().alias("measured"), F.lit(len(failed)).alias("failed_models"))


@query("j03_champion_challenger", "hourly", f"""WITH {HOLDOUT}, {seasonal_sql("past")},
v AS (SELECT o.name, value AS actual, (my + slope * (epoch_us(timestamp) / 86400000000.0 - mx)) * daily * weekly AS predicted FROM hourly o JOIN sea USING (name)
  JOIN sea_d ON o.name = sea_d.name AND h = hour(timestamp) JOIN sea_w ON o.name = sea_w.name AND d = isodow(timestamp) - 1 WHERE timestamp >= {CUT}),
old AS (SELECT name, sqrt(avg((actual - predicted) ** 2)) AS rmse FROM due GROUP BY 1),
new AS (SELECT name, sqrt(avg((actual - predicted) ** 2)) AS rmse FROM v GROUP BY 1)
SELECT name, round(new.rmse, 5) AS rmse, round(old.rmse, 5) AS champion_rmse, round((old.rmse - new.rmse) / old.rmse, 6) AS improvement,
  old.rmse IS NULL OR (old.rmse - new.rmse) / old.rmse >= 0.05 AS deployed FROM new LEFT JOIN old USING (name)""")
def j03(t):
    cut = F.lit("2024-01-26").cast("timestamp_ntz")
    champion = fc.forecast_metrics(holdout(t), by=NAME)
    params = seasonal.seasonal_fit(t.hourly.where(F.col("timestamp") < cut), keys=NAME)
    later = t.hourly.where(F.col("timestamp") >= cut).withColumnRenamed("value", "actual").join(params, "name")
    challenger = fc.forecast_metrics(seasonal.seasonal_values(later), by=NAME)
    out = retrain.champion_challenger(challenger, champion, keys=NAME)
    return out.select("name", r("rmse", 5), r("champion_rmse", 5), r("improvement"), "deployed")


RUNS = """runs AS (SELECT name AS series, date_trunc('day', timestamp) AS started_at, count(*) AS data_points, CASE WHEN count(*) < 60 THEN 'skipped' ELSE 'completed' END AS status
  FROM samples GROUP BY 1, 2)"""


def runs(t):
    n = F.count("*")
    return t.samples.groupBy(F.col("name").alias("series"), F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("started_at")).agg(
        n.alias("data_points"), F.when(n < 60, "skipped").otherwise("completed").alias("status")
    )


@query("j04_run_history", "samples", f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY started_at DESC) AS rank FROM runs)
SELECT series, started_at, data_points, status, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""")
def j04(t):
    return retrain.run_history(runs(t), keys=["series"])


@query("j04_run_status", "samples", f"""WITH {RUNS}
SELECT series, count(*) AS total_runs, max(started_at) AS started_at, arg_max(data_points, started_at) AS data_points, arg_max(status, started_at) AS status FROM runs GROUP BY 1""")
def j04_status(t):
    return retrain.run_status(runs(t), keys=["series"])


@query("j05_model_registry", "hourly", """
SELECT name AS model, max(epoch(timestamp))::BIGINT AS version, max(timestamp) AS loaded_at, round(arg_max(value, timestamp), 6) AS rmse FROM hourly GROUP BY 1""")
def j05(t):
    models = t.hourly.select(
        F.col("name").alias("model"), F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("version"), F.col("timestamp").alias("loaded_at"), r("value").alias("rmse")
    )
    return retrain.model_registry(models)


CHANGES = """changes AS (SELECT concat('d', o_custkey % 40) AS id, o_orderdate AS timestamp, o_orderkey AS seq,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'create' WHEN '5-LOW' THEN 'delete' ELSE 'update' END AS kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN concat('dep-', o_custkey % 40) END AS name,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderpriority <> '5-LOW' THEN o_orderstatus END AS description,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW' THEN 'production' END AS environment FROM orders)"""


DEPLOYMENTS = f"""{CHANGES},
live AS (SELECT c.*, (timestamp, seq) AS k FROM changes c LEFT JOIN (SELECT id AS did, max((timestamp, seq)) AS gone FROM changes WHERE kind = 'delete' GROUP BY 1) ON did = id
  WHERE gone IS NULL OR (timestamp, seq) > gone),
made AS (SELECT id AS mid, min(k) AS first FROM live WHERE kind = 'create' GROUP BY 1),
e AS (SELECT live.* FROM live JOIN made ON mid = id WHERE k >= first),
registry AS (SELECT id, arg_min(name, k) FILTER (kind = 'create') AS name,
  coalesce(arg_max(description, k) FILTER (kind = 'update' AND description IS NOT NULL), arg_min(coalesce(description, ''), k) FILTER (kind = 'create'), '') AS description,
  coalesce(arg_max(environment, k) FILTER (kind = 'update' AND environment IS NOT NULL), arg_min(coalesce(environment, 'development'), k) FILTER (kind = 'create'), 'development') AS environment,
  min(timestamp) FILTER (kind = 'create') AS created_at,
  coalesce(max(timestamp) FILTER (kind = 'update' AND (description IS NOT NULL OR environment IS NOT NULL)), min(timestamp) FILTER (kind = 'create')) AS updated_at
  FROM e GROUP BY id)"""


def deployments(t):
    changes = t.table("orders").selectExpr(
        "concat('d', o_custkey % 40) AS id", "o_orderdate AS timestamp", "o_orderkey AS seq",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'create' WHEN '5-LOW' THEN 'delete' ELSE 'update' END AS kind",
        "CASE o_orderpriority WHEN '1-URGENT' THEN concat('dep-', o_custkey % 40) END AS name",
        "CASE WHEN o_orderkey % 3 <> 0 AND o_orderpriority <> '5-LOW' THEN o_orderstatus END AS description",
        "CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW' THEN 'production' END AS environment",
    )
    return store.deployment_registry(changes)


@query("q12_deployment_registry", "", f"WITH {DEPLOYMENTS} SELECT * FROM registry")
def q12(t):
    return deployments(t)


@query("q12_cascade", "agents", f"""WITH {DEPLOYMENTS}
SELECT agent_id, concat('d', agent_id % 40) AS deployment_id, metrics_count FROM agents WHERE concat('d', agent_id % 40) IN (SELECT id FROM registry)""")
def q12_cascade(t):
    agents = t.agents.select("agent_id", F.concat(F.lit("d"), F.col("agent_id") % 40).alias("deployment_id"), "metrics_count")
    return store.cascade_delete(agents, deployments(t)).select("agent_id", "deployment_id", "metrics_count")
