"""The input shapes of the registered queries, as DataFrames and as the same SQL text for the oracle.

Every shape is derived from the given tables, so each query grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metriloom.operators.scale import running_sum
from metriloom.session import use_utc


def hour_of_ts():
    return F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")


class Tables:
    """Lazily built inputs over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        use_utc(spark)
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def samples(self) -> DataFrame:
        """Long metric table."""
        return self.events.select(
            F.col("event_id").alias("seq"),
            F.col("event_type").alias("name"),
            "value",
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("dep"), F.col("user_id") % 5).alias("deployment"),
            F.concat(F.lit("host"), F.col("user_id")).alias("host"),
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Aligned long table: one row per metric and hour."""
        return self.events.groupBy(F.col("event_type").alias("name"), hour_of_ts().alias("timestamp")).agg(
            F.avg("value").alias("value")
        )

    @cached_property
    def wide(self) -> DataFrame:
        """Wide frame: one row per hour, one column per metric, NULL where a metric has no sample."""
        picks = {"cpu_usage": "view", "memory_usage": "click", "rps": "purchase", "latency": "error"}
        return self.events.groupBy(hour_of_ts().alias("timestamp")).agg(
            *[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(c) for c, e in picks.items()]
        )

    @cached_property
    def wide_by_dep(self) -> DataFrame:
        """The wide frame for five deployments at once."""
        picks = {"cpu_usage": "view", "memory_usage": "click"}
        return self.events.groupBy(
            F.concat(F.lit("dep"), F.col("user_id") % 5).alias("deployment"), hour_of_ts().alias("timestamp")
        ).agg(*[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(c) for c, e in picks.items()])

    @cached_property
    def wide_all(self) -> DataFrame:
        """All five event types, by deployment and hour."""
        picks = {"cpu_usage": "view", "memory_usage": "click", "rps": "purchase", "latency": "error", "joined": "signup"}
        return self.events.groupBy(
            F.concat(F.lit("dep"), F.col("user_id") % 5).alias("deployment"), hour_of_ts().alias("timestamp")
        ).agg(*[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(c) for c, e in picks.items()])

    @cached_property
    def workloads(self) -> DataFrame:
        supplier, nation = self.table("supplier"), self.table("nation")
        per_supplier = self.table("lineitem").groupBy("l_suppkey").agg(
            F.count("*").alias("n"),
            F.sum("l_quantity").alias("qty"),
            F.sum(F.col("l_quantity") * F.col("l_discount")).alias("qty_disc"),
            F.sum("l_extendedprice").alias("price"),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("price_tax"),
        )
        key = F.col("s_suppkey")
        return (
            per_supplier.join(supplier, F.col("l_suppkey") == key)
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_name").alias("workload"),
                F.col("n_name").alias("namespace"),
                (1 + F.col("n") % 8).cast("int").alias("replicas"),
                (F.col("qty") / 1000).alias("cpu_requested"),
                (F.col("qty_disc") * (1 + key % 10) / 500).alias("cpu_used"),
                (F.col("price") / 1000000).alias("memory_requested"),
                (F.col("price_tax") * (1 + key % 7) / 250000).alias("memory_used"),
                F.concat(100 * (1 + key % 5), F.lit("m")).alias("cpu_request"),
                F.concat(100 * (1 + key % 13), F.lit("m")).alias("cpu_limit"),
                F.concat(256 * (1 + key % 4), F.lit("Mi")).alias("memory_request"),
            )
        )

    @cached_property
    def scaling_events(self) -> DataFrame:
        after = (1 + F.floor(F.col("o_totalprice") / 50000)).cast("int")
        base = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return base.select(
            F.col("c_name").alias("workload"),
            F.col("c_mktsegment").alias("namespace"),
            F.col("o_orderdate").alias("timestamp"),
            F.col("o_orderkey").alias("seq"),
            after.alias("after_replicas"),
        )

    @cached_property
    def counters(self) -> DataFrame:
        """Cumulative counters that restart each day."""
        rows = self.samples.withColumn("_day", F.to_date("timestamp"))
        summed = running_sum(rows, ["name", "deployment", "_day"], "timestamp", "seq", "value", "counter_value", 3600)
        # cents, so that the order of the additions leaves no trace
        return summed.select("name", "deployment", "timestamp", "seq", F.round("counter_value", 2).alias("counter_value"))

    @cached_property
    def agents(self) -> DataFrame:
        key = F.col("user_id")
        return self.events.groupBy(key.alias("agent_id")).agg(
            F.min("ts").alias("registered_at"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("metrics_count"),
            F.sort_array(F.collect_set("event_type")).alias("metrics"),  # at most the five event types
        ).select(
            "agent_id",
            F.concat(F.lit("host"), "agent_id").alias("hostname"),
            F.concat(F.lit("dep"), F.col("agent_id") % 5).alias("deployment_id"),
            "registered_at",
            "last_seen",
            "metrics_count",
            (F.col("agent_id") % 11 == 0).alias("paused"),
            "metrics",
        )

    @cached_property
    def registry_events(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "signup", "register")
            .when(F.col("event_type") == "purchase", "config")
            .when(F.col("event_type").isin("view", "click"), "heartbeat")
        )
        is_register, is_beat = kind == "register", kind == "heartbeat"
        return self.events.where(kind.isNotNull()).select(
            F.col("user_id").alias("agent_id"),
            F.col("event_id").alias("seq"),
            F.col("ts").alias("timestamp"),
            kind.alias("kind"),
            F.when(is_register, F.concat(F.lit("host"), F.col("user_id"))).alias("hostname"),
            F.when(is_register, F.concat(F.lit("v"), F.col("event_id") % 7)).alias("agent_version"),
            F.when(is_register, F.concat(F.lit("dep"), F.col("user_id") % 5)).alias("deployment_id"),
            F.when(is_beat, F.floor("value").cast("bigint")).alias("metrics_count"),
            F.when(is_beat & (F.col("event_id") % 3 == 0), F.lit(""))
            .when(is_beat | is_register, F.concat(F.lit("m"), F.col("event_id") % 4))
            .alias("metrics"),
            F.when((kind == "config") & (F.col("event_id") % 2 == 0), F.col("event_id") % 4 == 0).alias("paused"),
            F.when((kind == "config") & (F.col("event_id") % 3 != 0), (5 + F.floor("value")).cast("bigint")).alias(
                "collection_interval"
            ),
        )


_PLAIN = {
    "samples": """SELECT event_id AS seq, event_type AS name, value, ts AS timestamp,
       concat('dep', user_id % 5) AS deployment, concat('host', user_id) AS host FROM events""",
    "hourly": """SELECT event_type AS name, date_trunc('hour', ts) AS timestamp, avg(value) AS value
       FROM events GROUP BY 1, 2""",
    "wide": """SELECT date_trunc('hour', ts) AS timestamp,
       avg(CASE WHEN event_type = 'view' THEN value END) AS cpu_usage,
       avg(CASE WHEN event_type = 'click' THEN value END) AS memory_usage,
       avg(CASE WHEN event_type = 'purchase' THEN value END) AS rps,
       avg(CASE WHEN event_type = 'error' THEN value END) AS latency
       FROM events GROUP BY 1""",
    "wide_by_dep": """SELECT concat('dep', user_id % 5) AS deployment, date_trunc('hour', ts) AS timestamp,
       avg(CASE WHEN event_type = 'view' THEN value END) AS cpu_usage,
       avg(CASE WHEN event_type = 'click' THEN value END) AS memory_usage
       FROM events GROUP BY 1, 2""",
    "wide_all": """SELECT concat('dep', user_id % 5) AS deployment, date_trunc('hour', ts) AS timestamp,
       avg(CASE WHEN event_type = 'view' THEN value END) AS cpu_usage,
       avg(CASE WHEN event_type = 'click' THEN value END) AS memory_usage,
       avg(CASE WHEN event_type = 'purchase' THEN value END) AS rps,
       avg(CASE WHEN event_type = 'error' THEN value END) AS latency,
       avg(CASE WHEN event_type = 'signup' THEN value END) AS joined
       FROM events GROUP BY 1, 2""",
    "workloads": """SELECT s_name AS workload, n_name AS namespace, CAST(1 + count(*) % 8 AS INT) AS replicas,
       sum(l_quantity) / 1000 AS cpu_requested,
       sum(l_quantity * l_discount) * (1 + s_suppkey % 10) / 500 AS cpu_used,
       sum(l_extendedprice) / 1000000 AS memory_requested,
       sum(l_extendedprice * l_tax) * (1 + s_suppkey % 7) / 250000 AS memory_used,
       concat(100 * (1 + s_suppkey % 5), 'm') AS cpu_request,
       concat(100 * (1 + s_suppkey % 13), 'm') AS cpu_limit,
       concat(256 * (1 + s_suppkey % 4), 'Mi') AS memory_request
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       GROUP BY s_suppkey, s_name, n_name""",
    "scaling_events": """SELECT c_name AS workload, c_mktsegment AS namespace, o_orderdate AS timestamp, o_orderkey AS seq,
       CAST(1 + floor(o_totalprice / 50000) AS INT) AS after_replicas,
       lag(CAST(1 + floor(o_totalprice / 50000) AS INT))
         OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS before_replicas
       FROM orders JOIN customer ON o_custkey = c_custkey""",
    "counters": """SELECT event_type AS name, concat('dep', user_id % 5) AS deployment, ts AS timestamp, event_id AS seq,
       round(sum(value) OVER (PARTITION BY event_type, user_id % 5, date_trunc('day', ts)
                              ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS counter_value
       FROM events""",
    "agents": """SELECT user_id AS agent_id, concat('host', user_id) AS hostname, concat('dep', user_id % 5) AS deployment_id,
       min(ts) AS registered_at, max(ts) AS last_seen, count(*) AS metrics_count, user_id % 11 = 0 AS paused,
       list_sort(list(DISTINCT event_type)) AS metrics
       FROM events GROUP BY user_id""",
    "registry_events": """SELECT user_id AS agent_id, event_id AS seq, ts AS timestamp, kind,
       CASE WHEN kind = 'register' THEN concat('host', user_id) END AS hostname,
       CASE WHEN kind = 'register' THEN concat('v', event_id % 7) END AS agent_version,
       CASE WHEN kind = 'register' THEN concat('dep', user_id % 5) END AS deployment_id,
       CASE WHEN kind = 'heartbeat' THEN CAST(floor(value) AS BIGINT) END AS metrics_count,
       CASE WHEN kind = 'heartbeat' AND event_id % 3 = 0 THEN ''
            WHEN kind IN ('heartbeat', 'register') THEN concat('m', event_id % 4) END AS metrics,
       CASE WHEN kind = 'config' AND event_id % 2 = 0 THEN event_id % 4 = 0 END AS paused,
       CASE WHEN kind = 'config' AND event_id % 3 <> 0 THEN CAST(5 + floor(value) AS BIGINT) END AS collection_interval
       FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'config'
                       WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'heartbeat' END AS kind FROM events)
       WHERE kind IS NOT NULL""",
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views as common table expressions."""
    views = ",\n".join(f"{n} AS ({_PLAIN[n]})" for n in names.split())
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
