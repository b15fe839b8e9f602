"""Streaming queries: the event table is replayed as a stream and the written table is compared."""

from functools import cached_property

from pyspark.sql import functions as F

from metriloom.operators import forecast, store
from metriloom.plans.align import r
from metriloom.plans.registry import SQL, query
from metriloom.plans.sources import ENVELOPE_BODY, flat
from metriloom.plans.views import Tables
from metriloom.session import new_path
from metriloom.streaming import jobs, stateful

SERIES = ["name", "deployment"]


class StreamTables(Tables):
    """The same derived inputs, over the event table read as a stream."""

    @property
    def events(self):
        schema = self.table("events").schema
        return jobs.read_table_stream(self.spark, f"{self.folder}/events.parquet", schema, files_per_trigger=256)


class ShuffledTables(Tables):
    """The same, with the events dealt over files at random and read in ``BATCHES`` micro-batches.

    Every batch holds times of the whole span; the watermark's delay covers it.
    """

    BATCHES = 2

    @cached_property
    def events(self):
        source = self.table("events")
        files = max(2 * self.BATCHES, source.rdd.getNumPartitions())  # as many as the scan has splits
        path = new_path(self.spark, "shuffled")
        source.repartition(files, "event_id").write.parquet(path)
        return jobs.read_table_stream(self.spark, path, source.schema, files_per_trigger=-(-files // self.BATCHES))


def streamed(t):
    return StreamTables(t.spark, t.folder)


#: waits longer than the events span, and slots in which rows wait
ANY_ORDER = {"delay": "100 days", "slot_seconds": 6 * 3600}


def from_shuffled(t, label, make):
    """Rows of an ordered stream over shuffled samples; ``make`` builds it."""
    stream, close = jobs.closed_by(ShuffledTables(t.spark, t.folder).samples, "timestamp", new_path(t.spark, "end"))
    return jobs.replay(make(stream), label, close=close).where("NOT late")


def naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("t01_stream_ingest", "", SQL["s02_ingest_payload"])
def t01(t):
    rows = streamed(t).events.select("event_id", F.expr(ENVELOPE_BODY).alias("body"), F.expr("ts + INTERVAL 1 HOUR").alias("received_at"))
    samples, _ = jobs.stream_ingest(rows, keep=["event_id"])
    return flat(jobs.replay(samples.withColumn("date", F.to_date("timestamp")), "ingest", ["date"]))


@query("t01_stream_rejects", "", SQL["s02_ingest_rejects"])
def t01_rejects(t):
    rows = streamed(t).events.select("event_id", F.expr(ENVELOPE_BODY).alias("body"), F.expr("ts + INTERVAL 1 HOUR").alias("received_at"))
    _, rejects = jobs.stream_ingest(rows, keep=["event_id"])
    return jobs.replay(rejects, "rejects").select("event_id", "reason")


@query("t02_stream_align", "samples", """
SELECT name, time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(value) AS samples
FROM samples GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE <= (SELECT max(timestamp) FROM samples) - INTERVAL 10 MINUTE""")
def t02(t):
    out = jobs.replay(jobs.stream_align(streamed(t).samples, keys=["name"]), "align")
    return naive(out, "timestamp").select("name", "timestamp", r("mean"), r("total", 4), "samples")


@query("t02_stream_align_sliding", "samples", """
WITH w AS (SELECT deployment, value, unnest([0, 1, 2]) AS k, time_bucket(INTERVAL 5 MINUTE, timestamp) AS b FROM samples),
s AS (SELECT deployment, value, b - to_minutes(CAST(5 * k AS BIGINT)) AS start FROM w)
SELECT deployment, start AS timestamp, round(sum(value), 4) AS total, count(value) AS samples FROM s
GROUP BY 1, 2 HAVING start + INTERVAL 15 MINUTE <= (SELECT max(timestamp) FROM samples) - INTERVAL 10 MINUTE""")
def t02_sliding(t):
    out = jobs.replay(jobs.stream_align(streamed(t).samples, keys=["deployment"], period="15 minutes", slide="5 minutes"), "slide")
    return naive(out, "timestamp").select("deployment", "timestamp", r("total", 4), "samples")


@query("t03_stream_liveness", "", """
WITH b AS (SELECT user_id AS agent_id, ts, lag(ts) OVER w AS prev, lead(ts) OVER w AS next FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
wm AS (SELECT max(ts) - INTERVAL 1 MINUTE AS m FROM events WHERE event_type IN ('view', 'click'))
SELECT agent_id, 'online' AS status, ts AS at FROM b WHERE prev IS NULL OR ts - prev > INTERVAL 6 HOUR
UNION ALL SELECT agent_id, 'warning', ts + INTERVAL 6 HOUR FROM b, wm WHERE coalesce(next, m) - ts > INTERVAL 6 HOUR
UNION ALL SELECT agent_id, 'offline', ts + INTERVAL 12 HOUR FROM b, wm WHERE coalesce(next, m) - ts > INTERVAL 12 HOUR""")
def t03(t):
    beats = streamed(t).events.where(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("agent_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq")
    )
    return naive(jobs.replay(stateful.stream_liveness(beats, warning_seconds=6 * 3600, offline_seconds=12 * 3600), "liveness"), "at")


@query("t04_stream_cooldown", "", f"SELECT name, deployment, seq, timestamp, accepted FROM ({SQL['r06_cooldown']})")
def t04(t):
    out = from_shuffled(t, "cooldown", lambda s: stateful.stream_cooldown(s, keys=SERIES, cooldown_seconds=6 * 3600, **ANY_ORDER))
    return naive(out, "timestamp").select(*SERIES, "seq", "timestamp", "accepted")


@query("t05_stream_alerts", "samples", """
WITH e AS (SELECT *, value > 30 AS holds FROM samples),
g AS (SELECT *, count(*) FILTER (NOT holds) OVER (PARTITION BY name, deployment ORDER BY timestamp, seq) AS grp FROM e),
s AS (SELECT *, min(timestamp) FILTER (holds) OVER (PARTITION BY name, deployment, grp) AS since FROM g)
SELECT name, deployment, seq, timestamp, CASE WHEN NOT holds THEN 'inactive' WHEN timestamp - since >= INTERVAL 2 HOUR THEN 'firing' ELSE 'pending' END AS state FROM s""")
def t05(t):
    out = from_shuffled(t, "alerts", lambda s: stateful.stream_alerts(s, keys=SERIES, op=">", threshold=30.0, for_seconds=7200, **ANY_ORDER))
    return naive(out, "timestamp").select(*SERIES, "seq", "timestamp", "state")


@query("t06_stream_history", "", SQL["p05_online_baseline"])
def t06(t):
    keys = ["name", "host"]
    facts = from_shuffled(t, "history", lambda s: stateful.stream_history(s, keys=keys, **ANY_ORDER))
    newest = store.get_latest(facts, keys=keys, ts="until", tie="n")
    return forecast.online_values(newest, 12, keys=keys).select(*keys, "step", r("value"))


@query("t07_stream_zscore", "samples", """
WITH w AS (SELECT *, count(*) OVER p AS n, avg(value) OVER p AS mean, greatest(stddev_pop(value) OVER p, 0.001) AS std FROM samples
  WINDOW p AS (PARTITION BY name, deployment ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT name, deployment, seq, timestamp, value, round(mean, 8) AS expected, round(abs(value - mean) / std, 5) AS score FROM w WHERE n >= 12 AND round(abs(value - mean) / std, 5) > 2.5""")
def t07(t):
    out = from_shuffled(t, "zscore", lambda s: stateful.stream_zscore(s, keys=SERIES, digits=5, **ANY_ORDER))
    return naive(out, "timestamp").select(*SERIES, "seq", "timestamp", "value", r("expected", 8), r("score", 5))


@query("t08_stream_registry", "", SQL["q10_agent_registry"])
def t08(t):
    path = new_path(t.spark, "registry")
    jobs.stream_registry(streamed(t).registry_events, f"{path}/state", f"{path}/checkpoint", available_now=True).awaitTermination()
    return store.registry_view(jobs.state_version(t.spark, f"{path}/state"))
