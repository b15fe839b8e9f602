"""Feature queries on the aligned frame of each deployment."""

from pyspark.sql import functions as F

from metriloom.functions.time import floor_to
from metriloom.operators import features
from metriloom.plans.registry import query

COLS = ["cpu_usage", "memory_usage"]
KEYS = ["deployment"]
W = "WINDOW w AS (PARTITION BY deployment ORDER BY timestamp)"
BASE = ["deployment", "timestamp"]

TIME_SQL = {
    "hour": "CAST(hour(timestamp) AS INT)",
    "hour_sin": "round(sin(2 * pi() * hour(timestamp) / 24), 6)",
    "hour_cos": "round(cos(2 * pi() * hour(timestamp) / 24), 6)",
    "day_of_week": "CAST(isodow(timestamp) - 1 AS INT)",
    "dow_sin": "round(sin(2 * pi() * (isodow(timestamp) - 1) / 7), 6)",
    "dow_cos": "round(cos(2 * pi() * (isodow(timestamp) - 1) / 7), 6)",
    "is_weekend": "CAST(isodow(timestamp) >= 6 AS INT)",
    "is_business_hours": "CAST(hour(timestamp) BETWEEN 9 AND 17 AS INT)",
    "minute_of_day": "CAST(hour(timestamp) * 60 + minute(timestamp) AS INT)",
}
LAG_SQL = {f"{c}_lag_{n}": f"round(lag({c}, {n}) OVER w, 6)" for c in COLS for n in (1, 2, 3, 6, 12)}
ROLL_SQL = {
    f"{c}_roll_{k}_{n}": f"CASE WHEN count({c}) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN round({fn}({c}) OVER (w ROWS {n - 1} PRECEDING), 6) END"
    for c in COLS
    for n in (3, 6, 12)
    for k, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
}
DIFF_SQL = {f"{c}_diff_{n}": f"round({c} - lag({c}, {n}) OVER w, 6)" for c in COLS for n in (1, 3, 6)}
PCT_SQL = {f"{c}_pct_change_{n}": f"round(ff_{c} / nullif(lag(ff_{c}, {n}) OVER w, 0) - 1, 6)" for c in COLS for n in (1, 3, 6)}
FILLED = "f AS (SELECT *, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY deployment ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS ff_{c}" for c in COLS
) + " FROM wide_by_dep)"


def columns_sql(parts):
    return ", ".join(f"{e} AS {c}" for c, e in parts.items())


def rounded(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@query("f01_time_features", "wide_by_dep", f"SELECT deployment, timestamp, {columns_sql(TIME_SQL)} FROM wide_by_dep")
def f01(t):
    return rounded(features.time_features(t.wide_by_dep.select(*BASE)))


@query("f02_lag_features", "wide_by_dep", f"SELECT deployment, timestamp, {columns_sql(LAG_SQL)} FROM wide_by_dep {W}")
def f02(t):
    return rounded(features.lag_features(t.wide_by_dep, [*COLS, "absent"], keys=KEYS).drop(*COLS))


@query("f03_rolling_features", "wide_by_dep", f"SELECT deployment, timestamp, {columns_sql(ROLL_SQL)} FROM wide_by_dep {W}")
def f03(t):
    return rounded(features.rolling_features(t.wide_by_dep, COLS, keys=KEYS).drop(*COLS))


@query("f04_pct_change", "wide_by_dep", f"WITH {FILLED} SELECT deployment, timestamp, {columns_sql(PCT_SQL)} FROM f {W}")
def f04(t):
    return rounded(features.pct_change(t.wide_by_dep, COLS, keys=KEYS).drop(*COLS))


@query("f05_diff", "wide_by_dep", f"SELECT deployment, timestamp, {columns_sql(DIFF_SQL)} FROM wide_by_dep {W}")
def f05(t):
    return rounded(features.diff(t.wide_by_dep, COLS, keys=KEYS).drop(*COLS))


EVERY = {**{c: f"round({c}, 6)" for c in COLS}, **TIME_SQL, **LAG_SQL, **ROLL_SQL, **PCT_SQL, **DIFF_SQL}
TRANSFORM = f"SELECT deployment, timestamp, {columns_sql(EVERY)} FROM f {W}"


@query("f06_transform", "wide_by_dep", f"WITH {FILLED} {TRANSFORM}")
def f06(t):
    return rounded(features.transform(t.wide_by_dep, keys=KEYS))


@query("f07_prepare_for_training", "", f"""WITH wide_by_dep AS (SELECT concat('dep', user_id % 5) AS deployment, time_bucket(INTERVAL 6 HOUR, ts) AS timestamp,
  avg(CASE WHEN event_type = 'view' THEN value END) AS cpu_usage, avg(CASE WHEN event_type = 'click' THEN value END) AS memory_usage FROM events GROUP BY 1, 2), {FILLED}, x AS ({TRANSFORM})
SELECT * EXCLUDE (timestamp) FROM x WHERE {" AND ".join(f"{c} IS NOT NULL" for c in EVERY)}""")
def f07(t):
    """One series per deployment, aligned to six hours."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    aligned = t.events.groupBy(F.concat(F.lit("dep"), F.col("user_id") % 5).alias("deployment"), floor_to("ts", 6 * 3600).alias("timestamp"))
    frame = features.transform(aligned.agg(mean("view").alias("cpu_usage"), mean("click").alias("memory_usage")), keys=KEYS)
    return rounded(features.prepare_for_training(frame, "cpu_usage", keep=KEYS))


@query("f08_lookback_features", "hourly", f"""
WITH x AS (SELECT name, timestamp, {", ".join(f"round(lag(value, {n}) OVER w, 7) AS lag_{n}" for n in range(12, 0, -1))},
  round(avg(value) OVER k, 7) AS roll_mean, round(stddev_pop(value) OVER k, 7) AS roll_std, round(min(value) OVER k, 7) AS roll_min, round(max(value) OVER k, 7) AS roll_max,
  round(hour(timestamp) / 24, 7) AS hour_part, round((isodow(timestamp) - 1) / 7, 7) AS dow_part,
  CAST(hour(timestamp) BETWEEN 9 AND 17 AS DOUBLE) AS is_business_hours, CAST(isodow(timestamp) >= 6 AS DOUBLE) AS is_weekend,
  round(lead(value) OVER w, 7) AS target, row_number() OVER w AS rn FROM hourly
  WINDOW w AS (PARTITION BY name ORDER BY timestamp), k AS (PARTITION BY name ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT * EXCLUDE (rn) FROM x WHERE rn > 12 AND target IS NOT NULL""")
def f08(t):
    return rounded(features.lookback_features(t.hourly, "value", keys=["name"]), 7)


@query("f09_ordered_split", "samples", """
WITH x AS (SELECT name, deployment, seq, row_number() OVER (PARTITION BY name, deployment ORDER BY timestamp, seq) AS row_index,
  count(*) OVER (PARTITION BY name, deployment) AS n FROM samples)
SELECT name, deployment, seq, row_index, row_index <= floor(n * CASE WHEN n < 50 THEN 0.6 ELSE 0.8 END) AS is_train FROM x""")
def f09(t):
    out = features.ordered_split(t.samples, keys=["name", "deployment"], tie="seq")
    return out.select("name", "deployment", "seq", "row_index", "is_train")


@query("f09_random_split", "samples", "SELECT seq, seq % 5 <> 0 AS is_train FROM samples")
def f09_random(t):
    return features.random_split(t.samples, "seq").select("seq", "is_train")


@query("f10_standard_scale", "wide_by_dep", """
WITH m AS (SELECT deployment, avg(cpu_usage) AS mc, stddev_pop(cpu_usage) AS sc, avg(memory_usage) AS mm, stddev_pop(memory_usage) AS sm FROM wide_by_dep GROUP BY 1)
SELECT deployment, timestamp, round((cpu_usage - mc) / sc, 5) AS cpu_usage, round((memory_usage - mm) / sm, 5) AS memory_usage FROM wide_by_dep JOIN m USING (deployment)""")
def f10(t):
    return rounded(features.standard_scale(t.wide_by_dep, COLS, keys=KEYS), 5)


@query("f11_domain_features", "wide_all", """
SELECT deployment, timestamp, CAST(hour(timestamp) BETWEEN 18 AND 23 AS INT) AS is_peak_hour,
  round(avg(rps) OVER (PARTITION BY deployment ORDER BY timestamp RANGE BETWEEN INTERVAL 3599 SECOND PRECEDING AND CURRENT ROW), 7) AS rps_rolling_1h,
  round(avg(rps) OVER (PARTITION BY deployment ORDER BY timestamp RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW), 7) AS rps_rolling_24h,
  round(memory_usage / greatest(latency, 1), 7) AS queue_pressure, round(1 - cpu_usage, 7) AS headroom, round(joined, 7) AS joined FROM wide_all""")
def f11(t):
    out = features.domain_features(
        t.wide_all, keys=KEYS, users="rps", waiting="memory_usage", running="latency", utilization="cpu_usage"
    )
    return rounded(out.select("deployment", "timestamp", "is_peak_hour", "rps_rolling_1h", "rps_rolling_24h", "queue_pressure", "headroom", "joined"), 7)
