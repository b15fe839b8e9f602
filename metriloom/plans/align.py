"""Alignment and merge queries."""

from datetime import datetime

from pyspark.sql import functions as F

from metriloom.operators import align
from metriloom.plans.registry import query
from metriloom.schemas import METRIC_FAMILIES

SERIES = ["name", "deployment"]
INC = """inc AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN counter_value < prev THEN counter_value ELSE counter_value - prev END AS increase
  FROM (SELECT *, lag(counter_value) OVER (PARTITION BY name, deployment ORDER BY timestamp, seq) AS prev FROM counters))"""


def r(name, digits=6):
    return F.round(name, digits).alias(name)


@query("a01_align_mean", "samples", """
SELECT name, deployment, time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, round(avg(value), 6) AS value FROM samples GROUP BY 1, 2, 3""")
def a01(t):
    return align.align_mean(t.samples, keys=SERIES, period=300).select(*SERIES, "timestamp", r("value"))


@query("a02_align_rate", "counters", f"""WITH {INC}
SELECT name, deployment, date_trunc('hour', timestamp) AS timestamp, round(sum(increase) / 3600, 6) AS counter_value FROM inc GROUP BY 1, 2, 3""")
def a02(t):
    return align.align_rate(t.counters, keys=SERIES, period=3600, value="counter_value").select(*SERIES, "timestamp", r("counter_value"))


@query("a03_align_delta", "counters", f"""WITH {INC}
SELECT name, deployment, date_trunc('hour', timestamp) AS timestamp, round(sum(increase), 4) AS counter_value FROM inc GROUP BY 1, 2, 3""")
def a03(t):
    return align.align_delta(t.counters, keys=SERIES, period=3600, value="counter_value").select(*SERIES, "timestamp", r("counter_value", 4))


@query("a04_choose_aligner", "counters", f"""WITH {INC},
m AS (SELECT *, CASE name WHEN 'view' THEN 'ALIGN_RATE' WHEN 'click' THEN 'ALIGN_DELTA' ELSE 'ALIGN_MEAN' END AS aligner FROM inc)
SELECT name, aligner, CASE WHEN contains(name, 'ur') THEN 'ALIGN_MEAN' ELSE 'ALIGN_RATE' END AS collected_as,
  deployment, date_trunc('hour', timestamp) AS timestamp,
  round(CASE aligner WHEN 'ALIGN_RATE' THEN sum(increase) / 3600 WHEN 'ALIGN_DELTA' THEN sum(increase) ELSE avg(counter_value) END, 8) AS value
FROM m GROUP BY 1, 2, 3, 4, 5""")
def a04(t):
    wanted = align.training_aligner("name", {"view": "ALIGN_RATE", "click": "ALIGN_DELTA"})
    rows = t.counters.withColumnRenamed("counter_value", "value")
    out = align.align_by_metric(rows, wanted, keys=SERIES, period=3600)
    return out.select(
        *SERIES, "aligner", align.collection_aligner("name", ["ur"]).alias("collected_as"), "timestamp", r("value", 8)
    )


@query("a05_reduce_mean", "samples", """
WITH a AS (SELECT name, deployment, date_trunc('hour', timestamp) AS timestamp, avg(value) AS value FROM samples GROUP BY 1, 2, 3)
SELECT name, timestamp, round(avg(value), 6) AS value FROM a GROUP BY 1, 2""")
def a05(t):
    aligned = align.align_mean(t.samples, keys=SERIES, period=3600)
    return align.reduce_mean(aligned, by=["name"]).select("name", "timestamp", r("value"))


def raw_wide(t):
    return t.events.select(
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("cpu_usage"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("memory_usage"),
    )


RAW_WIDE = """raw AS (SELECT ts AS timestamp, CASE WHEN event_type = 'view' THEN value END AS cpu_usage,
  CASE WHEN event_type = 'click' THEN value END AS memory_usage FROM events)"""


@query("a06_floor_mean", "", f"""WITH {RAW_WIDE}
SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, round(avg(cpu_usage), 6) AS cpu_usage, round(avg(memory_usage), 6) AS memory_usage FROM raw GROUP BY 1""")
def a06(t):
    return align.floor_mean(raw_wide(t)).select("timestamp", r("cpu_usage"), r("memory_usage"))


@query("a07_round_mean", "", f"""WITH {RAW_WIDE},
b AS (SELECT *, epoch_us(timestamp) // 300000000 AS k, epoch_us(timestamp) % 300000000 AS rest FROM raw),
n AS (SELECT *, CASE WHEN rest > 150000000 OR (rest = 150000000 AND k % 2 = 1) THEN k + 1 ELSE k END AS j FROM b)
SELECT make_timestamp(j * 300000000) AS timestamp, round(avg(cpu_usage), 6) AS cpu_usage, round(avg(memory_usage), 6) AS memory_usage FROM n GROUP BY 1""")
def a07(t):
    return align.round_mean(raw_wide(t)).select("timestamp", r("cpu_usage"), r("memory_usage"))


@query("a08_merge_metrics", "hourly", """
SELECT timestamp, round(v.value, 6) AS view, round(c.value, 6) AS click, round(p.value, 6) AS purchase
FROM (SELECT timestamp, value FROM hourly WHERE name = 'view') v
FULL JOIN (SELECT timestamp, value FROM hourly WHERE name = 'click') c USING (timestamp)
FULL JOIN (SELECT timestamp, value FROM hourly WHERE name = 'purchase') p USING (timestamp)""")
def a08(t):
    names = ["view", "click", "purchase"]
    return align.merge_metrics(t.hourly, {n: n for n in names}).select("timestamp", *[r(n) for n in names])


@query("a08_merge_frames", "hourly", """
SELECT timestamp, round(value, 6) AS latency, orders
FROM (SELECT timestamp, value FROM hourly WHERE name = 'error')
FULL JOIN (SELECT date_trunc('hour', ts + INTERVAL 2 DAY) AS timestamp, count(*) AS orders FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (timestamp)""")
def a08_frames(t):
    latency = t.hourly.where("name = 'error'").select("timestamp", F.col("value").alias("latency"))
    shifted = F.date_trunc("hour", F.col("ts") + F.expr("INTERVAL 2 DAYS")).cast("timestamp_ntz")
    orders = t.events.where("event_type = 'purchase'").groupBy(shifted.alias("timestamp")).agg(F.count("*").alias("orders"))
    return align.merge_frames([latency, orders]).select("timestamp", r("latency"), "orders")


FAMILY_METRICS = [m for family in METRIC_FAMILIES.values() for m in family]
_families = ", ".join(f"('{f}', '{m}', '{c}')" for f, names in METRIC_FAMILIES.items() for m, c in names.items())


@query("a09_metric_family", "samples", f"""
WITH m AS (SELECT * FROM (VALUES {_families}) AS v(family, metric, column_name)),
s AS (SELECT ({FAMILY_METRICS})[seq % {len(FAMILY_METRICS)} + 1] AS metric, deployment, timestamp, value FROM samples),
a AS (SELECT metric, deployment, date_trunc('hour', timestamp) AS timestamp, avg(value) AS value FROM s GROUP BY 1, 2, 3)
SELECT family, timestamp, column_name, round(avg(value), 6) AS value FROM a JOIN m USING (metric) GROUP BY 1, 2, 3""")
def a09(t):
    """All families, over samples that carry their metric names in turn; each is a wide frame, shown as rows."""
    names = F.array(*[F.lit(m) for m in FAMILY_METRICS])
    samples = t.samples.withColumn("name", names[(F.col("seq") % len(FAMILY_METRICS)).cast("int")])
    aligned = align.align_mean(samples, keys=SERIES, period=3600)
    out = None
    for family, columns in METRIC_FAMILIES.items():
        wide = align.metric_family(aligned, columns).unpivot(["timestamp"], list(columns.values()), "column_name", "value")
        part = wide.where("value IS NOT NULL").select(F.lit(family).alias("family"), "timestamp", "column_name", r("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a10_units_and_filters", "samples", """
SELECT seq, deployment, round(value * 1000000 / 1048576, 6) AS memory_mb FROM samples
WHERE name = 'view' AND deployment = 'dep1' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20 12:00:00'""")
def a10(t):
    rows = align.select_series(
        t.samples, labels={"name": "view", "deployment": "dep1"}, start=datetime(2024, 1, 5), end=datetime(2024, 1, 20, 12)
    )
    return rows.select("seq", "deployment", F.round(align.to_mebibytes(F.col("value") * 1000000), 6).alias("memory_mb"))
