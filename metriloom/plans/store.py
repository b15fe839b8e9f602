"""Store queries over the event samples and the agents derived from them."""

from pyspark.sql import functions as F

from metriloom.operators import store
from metriloom.plans.registry import SQL, query
from metriloom.session import new_path
from metriloom.sources import tables

HOURS_6, HOURS_12 = 6 * 3600, 12 * 3600
LIVE = """live AS (SELECT *, CASE WHEN paused THEN 'online'
   WHEN (SELECT max(last_seen) FROM agents) - last_seen > INTERVAL 12 HOUR THEN 'offline'
   WHEN (SELECT max(last_seen) FROM agents) - last_seen > INTERVAL 6 HOUR THEN 'warning' ELSE 'online' END AS status FROM agents)"""


@query("q01_get_metrics", "samples", """
SELECT seq, name, value, timestamp, deployment FROM samples
WHERE name = 'view' AND deployment = 'dep2' AND timestamp > (SELECT max(timestamp) FROM samples) - INTERVAL 72 HOUR
ORDER BY timestamp DESC, seq DESC LIMIT 100""")
def q01(t):
    return store.get_metrics(t.samples, "view", deployment="dep2", hours=72).select("seq", "name", "value", "timestamp", "deployment")


@query("q02_get_latest", "samples", """
SELECT name, deployment, arg_max(seq, (timestamp, seq)) AS seq, arg_max(value, (timestamp, seq)) AS value, max(timestamp) AS timestamp
FROM samples GROUP BY name, deployment""")
def q02(t):
    return store.get_latest(t.samples, keys=["name", "deployment"]).select("name", "deployment", "seq", "value", "timestamp")


@query("q03_get_metric_names", "samples", "SELECT DISTINCT name FROM samples WHERE deployment = 'dep1' ORDER BY name")
def q03(t):
    return store.get_metric_names(t.samples, deployment="dep1")


@query("q04_metric_query", "samples", """
WITH d AS (SELECT seq, value, timestamp FROM samples
  WHERE name = 'click' AND timestamp > (SELECT max(timestamp) FROM samples) - INTERVAL 24 HOUR ORDER BY timestamp DESC, seq DESC LIMIT 100)
SELECT d.*, (SELECT count(*) FROM d) AS count, (SELECT arg_max(value, (timestamp, seq)) FROM d) AS latest_value, (SELECT max(timestamp) FROM d) AS latest_at FROM d""")
def q04(t):
    return store.metric_query(t.samples, "click").select("seq", "value", "timestamp", "count", "latest_value", "latest_at")


@query("q05_retention_trim", "samples", "SELECT * FROM samples ORDER BY timestamp DESC, seq DESC LIMIT 5000")
def q05(t):
    return store.retention_trim(t.samples, 5000)


@query("q06_deployment_rollup", "agents", f"""WITH {LIVE},
d AS (SELECT deployment_id AS id, min(registered_at) AS created_at FROM agents GROUP BY 1)
SELECT id, created_at, count(agent_id) AS agents_count, count(CASE WHEN status = 'online' THEN 1 END) AS agents_online,
  CAST(coalesce(sum(metrics_count), 0) AS BIGINT) AS metrics_count
FROM d LEFT JOIN live ON id = deployment_id GROUP BY 1, 2""")
def q06(t):
    deployments = t.agents.groupBy(F.col("deployment_id").alias("id")).agg(F.min("registered_at").alias("created_at"))
    return store.deployment_rollup(deployments, t.agents, warning_seconds=HOURS_6, offline_seconds=HOURS_12)


@query("q07_agent_liveness", "agents", f"WITH {LIVE} SELECT agent_id, last_seen, paused, status FROM live")
def q07(t):
    return store.agent_liveness(t.agents, warning_seconds=HOURS_6, offline_seconds=HOURS_12).select(
        "agent_id", "last_seen", "paused", "status"
    )


@query("q08_list_agents", "agents", f"WITH {LIVE} SELECT agent_id, hostname, metrics_count, status FROM live WHERE deployment_id = 'dep3'")
def q08(t):
    out = store.list_agents(t.agents, deployment="dep3", warning_seconds=HOURS_6, offline_seconds=HOURS_12)
    return out.select("agent_id", "hostname", "metrics_count", "status")


@query("q09_deployment_metrics", "agents", """
SELECT deployment_id, string_agg(DISTINCT m, ',' ORDER BY m) AS metrics FROM (SELECT deployment_id, unnest(metrics) AS m FROM agents) GROUP BY 1""")
def q09(t):
    return store.deployment_metrics(t.agents).withColumn("metrics", F.concat_ws(",", "metrics"))


@query("q10_agent_registry", "registry_events", """
WITH f AS (SELECT agent_id AS a, min((timestamp, seq)) AS first FROM registry_events WHERE kind = 'register' GROUP BY 1),
e AS (SELECT r.*, (timestamp, seq) AS k FROM registry_events r JOIN f ON a = agent_id WHERE (timestamp, seq) >= first)
SELECT agent_id,
  arg_min(deployment_id, k) FILTER (kind = 'register') AS deployment_id,
  arg_max(hostname, k) FILTER (kind = 'register') AS hostname,
  arg_max(agent_version, k) FILTER (kind = 'register') AS agent_version,
  min(timestamp) FILTER (kind = 'register') AS registered_at,
  max(timestamp) FILTER (kind <> 'config') AS last_seen,
  coalesce(arg_max(metrics_count, k) FILTER (kind = 'heartbeat'), 0) AS metrics_count,
  arg_max(metrics, k) FILTER (kind = 'register' OR (kind = 'heartbeat' AND metrics <> '')) AS metrics,
  coalesce(arg_max(paused, k) FILTER (kind = 'config' AND paused IS NOT NULL), false) AS paused,
  coalesce(arg_max(collection_interval, k) FILTER (kind = 'config' AND collection_interval IS NOT NULL), 15) AS collection_interval
FROM e GROUP BY agent_id""")
def q10(t):
    return store.agent_registry(t.registry_events)


IDENTITY_SQL = """SELECT CASE WHEN kind = 'register' AND seq % 5 = 0 THEN substr('server-of-' || agent_id, 1, 8) || '-' || substr(md5(CAST(seq AS VARCHAR)), 1, 4) ELSE 'a' || agent_id END AS agent_id,
  seq, timestamp, kind, CASE WHEN kind = 'register' THEN 'server-of-' || agent_id END AS hostname, deployment_id,
  CASE WHEN kind = 'register' THEN CASE seq % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' END END AS platform, CASE WHEN kind = 'register' THEN 'room ' || seq % 4 END AS location,
  CASE WHEN kind = 'register' AND seq % 2 = 0 THEN 'eu-west' END AS region, CASE WHEN kind = 'register' THEN '10.0.0.' || seq % 250 END AS ip_address FROM registry_events"""


def identified(t):
    """Registry events whose registrations say more of the agent; every fifth has no agent id."""
    register, seq = F.col("kind") == "register", F.col("seq")
    named = F.when(register & (seq % 5 == 0), F.lit(None)).otherwise(F.concat(F.lit("a"), "agent_id"))
    told = {
        "hostname": F.concat(F.lit("server-of-"), F.col("agent_id")),
        "platform": F.when(seq % 3 == 0, "linux").when(seq % 3 == 1, "windows"),
        "location": F.concat(F.lit("room "), (seq % 4).cast("string")),
        "region": F.when(seq % 2 == 0, "eu-west"),
        "ip_address": F.concat(F.lit("10.0.0."), (seq % 250).cast("string")),
    }
    events = t.registry_events.withColumns({c: F.when(register, v) for c, v in told.items()}).withColumn("agent_id", named)
    return store.with_default_ids(events)


@query("q10_agent_identity", "registry_events", f"""
WITH r AS ({IDENTITY_SQL}), f AS (SELECT agent_id AS a, min((timestamp, seq)) AS first FROM r WHERE kind = 'register' GROUP BY 1),
e AS (SELECT r.*, (timestamp, seq) AS k FROM r JOIN f ON a = agent_id WHERE (timestamp, seq) >= first),
n AS (SELECT agent_id, max(k) FILTER (kind = 'register') AS last, max(timestamp) FILTER (kind <> 'config') AS last_seen FROM e GROUP BY 1)
SELECT e.agent_id, hostname, platform, location, region, ip_address, last_seen FROM e JOIN n ON n.agent_id = e.agent_id AND e.k = n.last""")
def q10_identity(t):
    return store.agent_registry(identified(t)).select("agent_id", "hostname", "platform", "location", "region", "ip_address", "last_seen")


@query("q10_auto_deployments", "registry_events", """
WITH d AS (SELECT DISTINCT 'dep' || o_custkey % 3 AS id FROM orders),
g AS (SELECT deployment_id AS id, min(timestamp) AS created_at FROM registry_events WHERE kind = 'register' GROUP BY 1)
SELECT id, 'dep' AS name, '' AS description, 'production' AS environment, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at FROM d
UNION ALL SELECT id, id, 'Auto-created deployment', 'development', created_at, created_at FROM g WHERE id NOT IN (SELECT id FROM d)""")
def q10_auto(t):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    known = t.table("orders").select(F.concat(F.lit("dep"), (F.col("o_custkey") % 3).cast("string")).alias("id")).distinct()
    known = known.select("id", F.lit("dep").alias("name"), F.lit("").alias("description"), F.lit("production").alias("environment"), at.alias("created_at"), at.alias("updated_at"))
    return store.with_auto_deployments(known, t.registry_events)


@query("q13_trailing_history", "samples", """
SELECT name, seq, value, timestamp, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp DESC, seq DESC) AS rank FROM samples) WHERE rank <= 20""")
def q13(t):
    return store.trailing_history(t.samples, 20).select("name", "seq", "value", "timestamp", "rank")


@query("q14_metric_availability", "samples", """
WITH c AS (SELECT * FROM (VALUES ('traffic', 'view'), ('traffic', 'hits'), ('sales', 'purchase'), ('sales', 'orders'), ('faults', 'error')) v(friendly, metric_type)),
w AS (SELECT * FROM samples WHERE deployment = 'dep4' AND timestamp > (SELECT max(timestamp) FROM samples) - INTERVAL 24 HOUR)
SELECT friendly, metric_type, (SELECT count(*) FROM w WHERE name = metric_type) AS points,
  (SELECT count(*) FROM w WHERE name = metric_type) > 0 AS found,
  coalesce((SELECT string_agg(host, ',' ORDER BY host) FROM (SELECT DISTINCT host FROM w WHERE name = metric_type ORDER BY host LIMIT 3)), '') AS resources
FROM c""")
def q14(t):
    candidates = {"traffic": ["view", "hits"], "sales": ["purchase", "orders"], "faults": ["error"]}
    out = store.metric_availability(t.samples, candidates, hours=24, namespace="dep4")
    return out.withColumn("resources", F.concat_ws(",", "resources"))


def stored(t):
    """The samples in date folders."""
    path = new_path(t.spark, "by-date")
    tables.write_by_date(t.samples, path, order=["name"])
    return path


@query("q01_stored_metrics", "", SQL["q01_get_metrics"])
def q01_stored(t):
    rows, as_of = tables.read_recent(t.spark, stored(t), 72 * 3600)
    return store.get_metrics(rows, "view", deployment="dep2", hours=72, as_of=as_of).select("seq", "name", "value", "timestamp", "deployment")


@query("q04_stored_query", "", SQL["q04_metric_query"])
def q04_stored(t):
    rows, as_of = tables.read_recent(t.spark, stored(t), 24 * 3600)
    return store.metric_query(rows, "click", as_of=as_of).select("seq", "value", "timestamp", "count", "latest_value", "latest_at")


@query("q14_stored_availability", "", SQL["q14_metric_availability"])
def q14_stored(t):
    rows, as_of = tables.read_recent(t.spark, stored(t), 24 * 3600)
    candidates = {"traffic": ["view", "hits"], "sales": ["purchase", "orders"], "faults": ["error"]}
    out = store.metric_availability(rows, candidates, hours=24, namespace="dep4", as_of=as_of)
    return out.withColumn("resources", F.concat_ws(",", "resources"))
