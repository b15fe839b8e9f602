"""Anomaly queries over the event samples."""

from pyspark.sql import functions as F

from metriloom.operators import anomaly
from metriloom.plans.registry import query

SCORED = """
scored AS (
  SELECT s.*, m.mean AS expected, round(abs(s.value - m.mean) / m.std, 6) AS score
  FROM samples s JOIN (
    SELECT name, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-10 THEN 0.001 ELSE stddev_pop(value) END AS std
    FROM samples GROUP BY name HAVING count(value) >= 12) m USING (name)
), found AS (
  SELECT *, CASE WHEN score >= 4 THEN 'critical' WHEN score >= 3 THEN 'high' WHEN score >= 2.5 THEN 'medium' ELSE 'low' END AS severity
  FROM scored WHERE score > {sigma}
)"""


@query("n01_zscore_anomalies", "samples", f"""WITH {SCORED.format(sigma=2.5)}
SELECT name, seq, timestamp, value, round(expected, 6) AS expected, score, severity FROM found""")
def n01(t):
    found = anomaly.zscore_anomalies(t.samples)
    return found.select("name", "seq", "timestamp", "value", F.round("expected", 6).alias("expected"), "score", "severity")


@query("n02_severity", "samples", f"""WITH {SCORED.format(sigma=2.0)}
SELECT name, severity, count(*) AS anomalies, max(score) AS max_score FROM found GROUP BY name, severity""")
def n02(t):
    found = anomaly.zscore_anomalies(t.samples, sensitivity="high")
    return found.groupBy("name", "severity").agg(F.count("*").alias("anomalies"), F.max("score").alias("max_score"))


@query("n03_describe", "samples", f"""WITH {SCORED.format(sigma=2.5)},
r AS (SELECT *, round(expected, 4) AS e FROM found)
SELECT seq, CASE severity WHEN 'critical' THEN 'Critical anomaly detected!' WHEN 'high' THEN 'Significant anomaly detected.'
    WHEN 'medium' THEN 'Moderate anomaly detected.' ELSE 'Minor anomaly detected.' END
  || ' ' || name || ' is ' || format('{{:.1f}}', round(abs(value - e) / e * 100, 1)) || '% '
  || CASE WHEN value > e THEN 'above' ELSE 'below' END
  || ' expected value (actual: ' || format('{{:.4f}}', value) || ', expected: ' || format('{{:.4f}}', e)
  || ', score: ' || format('{{:.2f}}', round(score, 2)) || 'σ)' AS description
FROM r""")
def n03(t):
    found = anomaly.zscore_anomalies(t.samples).withColumn("expected", F.round("expected", 4))
    return found.select("seq", anomaly.describe("name", "value", "expected", "score").alias("description"))


@query("n04_anomaly_summary", "samples", f"""WITH {SCORED.format(sigma=2.5)},
sev AS (SELECT severity, count(*) AS n FROM found GROUP BY 1), met AS (SELECT name, count(*) AS n FROM found GROUP BY 1)
SELECT CASE WHEN (SELECT count(*) FROM found) = 0 THEN 'healthy'
            WHEN (SELECT count(*) FROM found WHERE severity = 'critical') > 0 THEN 'critical'
            WHEN (SELECT count(*) FROM found WHERE severity = 'high') > 0 THEN 'warning' ELSE 'attention' END AS status,
  round((SELECT count(*) FROM found) / (SELECT count(*) FROM samples), 6) AS anomaly_rate,
  (SELECT count(*) FROM found) AS anomalies, (SELECT count(*) FROM samples) AS points,
  (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM sev) AS by_severity,
  (SELECT string_agg(name || '=' || n, ',' ORDER BY name) FROM met) AS by_metric,
  (SELECT max(score) FROM found) AS max_score""")
def n04(t):
    def text(c):
        return F.concat_ws(",", F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias(c)

    out = anomaly.anomaly_summary(t.samples, anomaly.zscore_anomalies(t.samples))
    return out.select(
        "status", F.round("anomaly_rate", 6).alias("anomaly_rate"), "anomalies", "points", text("by_severity"), text("by_metric"), "max_score"
    )


@query("n04_anomaly_counts", "samples", f"""WITH {SCORED.format(sigma=2.5)}
SELECT 'severity' AS level, severity AS key, count(*) AS anomalies, max(score) AS max_score FROM found GROUP BY 2
UNION ALL SELECT 'metric', name, count(*), max(score) FROM found GROUP BY 2""")
def n04_counts(t):
    return anomaly.anomaly_counts(anomaly.zscore_anomalies(t.samples))


@query("n05_holdout_zscore", "samples", """
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp, seq) AS rn, count(*) OVER (PARTITION BY name) AS n FROM samples),
m AS (SELECT name, CASE WHEN max(n) > 10 THEN avg(CASE WHEN rn <= floor(n * 0.8) THEN value END) ELSE 0 END AS mean,
      CASE WHEN max(n) > 10 THEN greatest(stddev_pop(CASE WHEN rn <= floor(n * 0.8) THEN value END), 0.001) ELSE 1 END AS std
      FROM placed GROUP BY name)
SELECT name, seq, value, round(mean, 6) AS expected, round(abs(value - mean) / std, 6) AS score
FROM samples JOIN m USING (name) WHERE round(abs(value - mean) / std, 6) > 2.5""")
def n05(t):
    found = anomaly.holdout_zscore(t.samples)
    return found.select("name", "seq", "value", F.round("expected", 6).alias("expected"), "score")


@query("n12_contributing_features", "wide", """
WITH m AS (SELECT avg(cpu_usage) AS mc, stddev_pop(cpu_usage) AS sc, avg(memory_usage) AS mm, stddev_pop(memory_usage) AS sm,
    avg(rps) AS mr, stddev_pop(rps) AS sr, avg(latency) AS ml, stddev_pop(latency) AS sl FROM wide),
z AS (
  SELECT timestamp, 'cpu_usage' AS feature, abs(cpu_usage - mc) / sc AS z FROM wide, m UNION ALL
  SELECT timestamp, 'memory_usage', abs(memory_usage - mm) / sm FROM wide, m UNION ALL
  SELECT timestamp, 'rps', abs(rps - mr) / sr FROM wide, m UNION ALL
  SELECT timestamp, 'latency', abs(latency - ml) / sl FROM wide, m)
SELECT timestamp, feature, round(z / sum(z) OVER (PARTITION BY timestamp), 6) AS contribution,
  CAST(row_number() OVER (PARTITION BY timestamp ORDER BY z DESC, feature) AS INT) AS rank FROM z WHERE z IS NOT NULL""")
def n12(t):
    out = anomaly.contributing_features(t.wide, columns=["cpu_usage", "memory_usage", "rps", "latency"])
    return out.withColumn("contribution", F.round("contribution", 6))
