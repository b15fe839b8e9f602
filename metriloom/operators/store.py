"""Store queries: filters, newest rows, distinct names, agent and deployment registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriloom.functions.time import add_seconds, seconds_between
from metriloom.operators.scale import attach_row, join_small, newest_per_key, newest_rows
from metriloom.session import written

SHORTEST_INTERVAL, LONGEST_INTERVAL = 5, 3600  # fixed values: allowed collection interval in seconds
DEPLOYMENT_NAME = r"^[a-z0-9-]+$"  # fixed value: allowed deployment names, 1 to 64 characters


def as_of_column(df: DataFrame, ts: str, as_of: datetime | Column | None) -> Column:
    """The evaluation time: given, or the newest time of the input as a scalar subquery."""
    if as_of is None:
        return df.agg(F.max(ts)).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def cutoff(df: DataFrame, ts: str, as_of: datetime | Column | None, seconds: int) -> Column:
    """The time ``seconds`` before the evaluation time, in the type of ``ts``.

    Without a given time it is one scalar subquery as a whole, so the comparison with the bare column
    can still be pushed into the scan.
    """
    kind = dict(df.dtypes)[ts]
    if as_of is None:
        return df.agg(add_seconds(F.max(ts), -seconds).cast(kind)).scalar()
    return add_seconds(as_of_column(df, ts, as_of), -seconds).cast(kind)


def get_metrics(
    df: DataFrame, name: str, *, deployment: str | None = None, hours: float = 24, limit: int = 100,
    as_of=None, ts: str = "timestamp", tie: str = "seq",
) -> DataFrame:
    """The newest ``limit`` samples of a metric in the last ``hours``, oldest first."""
    since = cutoff(df, ts, as_of, int(hours * 3600))
    rows = df.where((F.col("name") == name) & (F.col(ts) > since))
    if deployment is not None:
        rows = rows.where(F.col("deployment") == deployment)
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(limit).orderBy(ts, tie)


def get_latest(df: DataFrame, *, keys: Sequence[str] = ("name",), ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    """The newest sample of every key at once; ties go to the later arrival."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(tie)))
    return df.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def get_metric_names(df: DataFrame, *, deployment: str | None = None) -> DataFrame:
    rows = df if deployment is None else df.where(F.col("deployment") == deployment)
    return rows.select("name").distinct().orderBy("name")


def metric_query(df: DataFrame, name: str, *, ts: str = "timestamp", tie: str = "seq", **params) -> DataFrame:
    """Samples of a metric with the newest value and the number of returned rows on each."""
    data = get_metrics(df, name, ts=ts, tie=tie, **params)
    facts = data.agg(
        F.count("*").alias("count"),
        F.max_by("value", F.struct(ts, tie)).alias("latest_value"),
        F.max(ts).alias("latest_at"),
    )
    return attach_row(data, facts)


def retention_trim(df: DataFrame, max_points: int, *, ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    """Only the newest ``max_points`` samples overall."""
    return newest_rows(df, ts, tie, max_points)


def agent_liveness(
    agents: DataFrame, *, as_of=None, warning_seconds: float = 120, offline_seconds: float = 300, stored: str | None = None
) -> DataFrame:
    """Status from idle time; a paused agent keeps the status it had (``stored``, default online)."""
    idle = seconds_between(as_of_column(agents, "last_seen", as_of), F.col("last_seen"))
    kept = F.col(stored) if stored else F.lit("online")
    status = (
        F.when(F.col("paused"), kept)
        .when(idle > offline_seconds, "offline")
        .when(idle > warning_seconds, "warning")
        .otherwise("online")
    )
    return agents.withColumn("status", status)


def list_agents(agents: DataFrame, *, deployment: str | None = None, agent_id=None, **liveness) -> DataFrame:
    """Agents with fresh status, of one deployment or one id where asked."""
    out = agent_liveness(agents, **liveness)
    if deployment is not None:
        out = out.where(F.col("deployment_id") == deployment)
    if agent_id is not None:
        out = out.where(F.col("agent_id") == agent_id)
    return out


def deployment_rollup(deployments: DataFrame, agents: DataFrame, **liveness) -> DataFrame:
    """Agents, online agents and metric count per deployment, in order of creation."""
    counts = agent_liveness(agents, **liveness).groupBy("deployment_id").agg(
        F.count("*").alias("agents_count"),
        F.count_if(F.col("status") == "online").alias("agents_online"),
        F.sum("metrics_count").alias("metrics_count"),
    )
    joined = deployments.join(counts, deployments["id"] == counts["deployment_id"], "left").drop("deployment_id")
    return joined.fillna(0, ["agents_count", "agents_online", "metrics_count"]).orderBy("created_at")


def deployment_metrics(agents: DataFrame) -> DataFrame:
    """Sorted distinct metric names of the agents of each deployment."""
    return (
        agents.select("deployment_id", F.explode("metrics").alias("metric"))
        .groupBy("deployment_id")
        .agg(F.sort_array(F.collect_set("metric")).alias("metrics"))
    )


def default_agent_id(agent_id: Column, hostname: Column, salt: Column) -> Column:
    """The given id, else the first eight letters of the host and four of a hash."""
    return F.coalesce(agent_id, F.concat(F.substring(hostname, 1, 8), F.lit("-"), F.substring(F.md5(salt.cast("string")), 1, 4)))


def after_last_delete(events: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Events newer than the key's last delete (all events of keys never deleted)."""
    deletes = events.where(F.col("kind") == "delete").groupBy(*keys).agg(F.max(F.struct(ts, tie)).alias("_deleted"))
    kept = join_small(events, deletes, keys, "left")
    return kept.where(F.col("_deleted").isNull() | (F.struct(ts, tie) > F.col("_deleted"))).drop("_deleted")


FOLDED = ("hostname", "agent_version", "metrics_count", "metrics", "paused", "collection_interval")
#: what else an agent says of itself when it registers; folded where the events have it
IDENTITY = ("platform", "location", "region", "ip_address")
AUTO_DESCRIPTION = "Auto-created deployment"  # fixed value


def _identity(df: DataFrame) -> list[str]:
    return [c for c in IDENTITY if c in df.columns]


def with_default_ids(events: DataFrame, *, salt: str = "seq") -> DataFrame:
    """Events whose registrations without an ``agent_id`` get one from their host and ``salt``."""
    made = default_agent_id(F.col("agent_id"), F.col("hostname"), F.col(salt))
    return events.withColumn("agent_id", F.when(F.col("kind") == "register", made).otherwise(F.col("agent_id")))


def with_auto_deployments(deployments: DataFrame, events: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    """The deployments, and those that exist only because an agent has registered into them.

    Such a one is named by its id and created with its first registration.
    """
    made = events.where((F.col("kind") == "register") & F.col("deployment_id").isNotNull()).groupBy(F.col("deployment_id").alias("id")).agg(F.min(ts).alias("created_at"))
    missing = made.join(deployments.select("id"), "id", "left_anti")
    return deployments.unionByName(
        missing.select(
            "id", F.col("id").cast("string").alias("name"), F.lit(AUTO_DESCRIPTION).alias("description"), F.lit("development").alias("environment"),
            "created_at", F.col("created_at").alias("updated_at"),
        )
    )


def registry_partials(events: DataFrame, *, ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    """One row per agent: for each field the newest event that sets it, as struct (at, value).

    Register events set host, version and identity (``IDENTITY``, also to NULL), the first one also the deployment; heartbeats set the count
    and, where not empty, the metrics; config events set what is not NULL (an interval out of range is
    ignored). Two such tables can be merged again by the same maxima, see :func:`merge_partials`.
    """
    at = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("seq"))
    kind = F.col("kind")
    some = F.size("metrics") > 0 if dict(events.dtypes)["metrics"].startswith("array") else F.col("metrics") != ""
    register, beat, config = kind == "register", kind == "heartbeat", kind == "config"

    def newest(name: str, when: Column) -> Column:
        return F.max(F.when(when, F.struct(at.alias("at"), F.col(name).alias("v")))).alias(name)

    return events.groupBy("agent_id").agg(
        F.min(F.when(register, F.struct(at.alias("at"), F.col("deployment_id").alias("v")))).alias("first"),
        F.max(F.when(register | beat, at)).alias("seen"),
        newest("hostname", register),
        newest("agent_version", register),
        *[newest(c, register) for c in _identity(events)],
        newest("metrics_count", beat),
        newest("metrics", register | (beat & some)),
        newest("paused", config & F.col("paused").isNotNull()),
        newest("collection_interval", config & F.col("collection_interval").between(SHORTEST_INTERVAL, LONGEST_INTERVAL)),
    )


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Fold partial registries of consecutive batches into one."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("agent_id").agg(
        F.min("first").alias("first"), F.max("seen").alias("seen"), *[F.max(c).alias(c) for c in (*FOLDED, *_identity(union))]
    )


def registry_view(partials: DataFrame) -> DataFrame:
    """The current agents. A field set before the agent's first register does not count, and an agent
    that never registered is not shown."""

    def value(name: str, default=None) -> Column:
        kept = F.when(F.col(f"{name}.at") >= F.col("first.at"), F.col(f"{name}.v"))
        return (kept if default is None else F.coalesce(kept, F.lit(default))).alias(name)

    return partials.where(F.col("first").isNotNull()).select(
        "agent_id",
        F.col("first.v").alias("deployment_id"),
        value("hostname"),
        value("agent_version"),
        *[value(c) for c in _identity(partials)],
        F.col("first.at.ts").alias("registered_at"),
        F.col("seen.ts").alias("last_seen"),
        value("metrics_count", 0),
        value("metrics"),
        value("paused", False),
        value("collection_interval", 15),
    )


def agent_registry(events: DataFrame, *, ts: str = "timestamp", tie: str = "seq", with_deletes: bool = False) -> DataFrame:
    """Fold register, heartbeat and config events into the current agents: one aggregate, no sort."""
    if with_deletes:
        events = after_last_delete(events, ["agent_id"], ts, tie)
    return registry_view(registry_partials(events, ts=ts, tie=tie))


def registry_from_ingest(payloads: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """One registration per payload, from the labels of its first sample.

    ``payloads`` has ``metrics`` (array of samples), ``agent_version`` and any payload key. With
    ``agents`` given, the answer carries the agent's paused flag and interval.
    """
    labels = F.try_element_at("metrics", F.lit(1))["labels"]
    host = F.coalesce(labels["host"], labels["hostname"], F.lit("unknown"))
    out = payloads.withColumn("deployment_id", labels["deployment"]).withColumn("hostname", host)
    out = out.withColumn(
        "agent_id", F.concat(F.substring("hostname", 1, 8), F.lit("-"), F.substring("deployment_id", 1, 4))
    ).withColumns(
        {
            "received": F.size("metrics"),
            "agent_version": F.coalesce("agent_version", F.lit("unknown")),
            "metrics": F.array_sort(F.array_distinct(F.transform("metrics", lambda m: F.coalesce(m["name"], F.lit(""))))),
        }
    )
    if agents is not None:
        control = agents.select(F.col("agent_id").alias("_id"), "paused", "collection_interval")
        out = out.join(control, out["agent_id"] == control["_id"], "left").drop("_id")
    return out


def deployment_registry(events: DataFrame, *, ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    """Fold create, update and delete events into current deployments; names are unique and checked.

    A claim of a name is judged when it is made: a create or an update whose name another deployment holds
    at that moment is refused as a whole, and a name is free again once its holder leaves or renames. An id
    created again without a delete keeps its row; an update that sets nothing leaves ``updated_at``.

    Only ids that ever claim a common name depend on each other. They are grouped by that, and each group
    is folded in event order in one task; all other ids are groups of their own.
    """
    valid_name = F.col("name").rlike(DEPLOYMENT_NAME) & F.length("name").between(1, 64)
    usable = events.where((F.col("kind") == "delete") | F.col("name").isNull() | valid_name)
    groups = _name_groups(usable.where(F.col("name").isNotNull() & (F.col("kind") != "delete")).select("id", "name").distinct())
    grouped = usable.join(groups, "id", "left").withColumn("_group", F.coalesce("_group", "id"))
    kinds = dict(events.dtypes)
    schema = f"id {kinds['id']}, name string, description string, environment string, created_at {kinds[ts]}, updated_at {kinds[ts]}"
    columns = grouped.select("_group", "id", "kind", "name", "description", "environment", F.col(ts).alias("at"), F.col(tie).alias("tie"))
    return columns.groupBy("_group").applyInPandas(_fold_names, schema)


def _name_groups(claims: DataFrame) -> DataFrame:
    """``id, _group`` of ids that share a name with others, directly or through others: the smallest id reachable."""
    shared = claims.join(claims.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1"), "name", "left_semi")
    links = written(shared.select("id", "name"), "claims")
    groups = written(links.select("id", F.col("id").alias("_group")).distinct(), "groups")
    while True:
        by_name = links.join(groups, "id").groupBy("name").agg(F.min("_group").alias("_low"))
        lower = written(links.join(by_name, "name").groupBy("id").agg(F.min("_low").alias("_group")), "groups")
        changed = lower.join(groups.withColumnRenamed("_group", "_old"), "id").where(F.col("_group") != F.col("_old")).limit(1).count()
        groups = lower
        if not changed:
            return groups


def _fold_names(events):
    """Apply the events of one group in order (an ordered state machine, so a small loop per event)."""
    import pandas as pd

    live, holder = {}, {}
    for e in events.sort_values(["at", "tie"]).itertuples(index=False):
        key, row = e.id, live.get(e.id)
        name, *rest = (None if pd.isna(v) else v for v in (e.name, e.description, e.environment))
        given = dict(zip(("description", "environment"), rest))
        taken = name is not None and holder.get(name, key) != key
        if e.kind == "delete" and row:
            del holder[live.pop(key)["name"]]
        elif e.kind == "create" and not row and name is not None and not taken:
            live[key] = {"name": name, "description": given["description"] or "", "environment": given["environment"] or "development", "created_at": e.at, "updated_at": e.at}
            holder[name] = key
        elif e.kind == "update" and row and not taken:
            new = {c: v for c, v in {"name": name, **given}.items() if v is not None}
            if new:
                del holder[row["name"]]
                row.update(new, updated_at=e.at)
                holder[row["name"]] = key
    columns = ["id", "name", "description", "environment", "created_at", "updated_at"]
    return pd.DataFrame([{"id": k, **v} for k, v in live.items()], columns=columns)


def cascade_delete(agents: DataFrame, deployments: DataFrame) -> DataFrame:
    """Agents whose deployment still exists."""
    return agents.join(deployments.select(F.col("id").alias("deployment_id")), "deployment_id", "left_semi")


def trailing_history(df: DataFrame, n: int, *, keys: Sequence[str] = ("name",), ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    """The last ``n`` rows of each key, rank 1 the newest."""
    return newest_per_key(df, keys, [F.desc(ts), F.desc(tie)], n)


def metric_availability(
    df: DataFrame, candidates: Mapping[str, Sequence[str]], *, hours: float = 1, namespace: str | None = None,
    as_of=None, ts: str = "timestamp", metric: str = "name", resource: str = "host", namespace_col: str = "deployment",
) -> DataFrame:
    """Per friendly name and candidate metric: points in the window, found or not, up to three resources.

    The candidate table is a constant of this call, so it is the broadcast side. Resources are taken
    as the three smallest, found per resource first so that no group is gathered.
    """
    table = df.sparkSession.createDataFrame(
        [(f, m) for f, ms in candidates.items() for m in ms], "friendly string, metric_type string"
    )
    rows = df.where(F.col(ts) > cutoff(df, ts, as_of, int(hours * 3600)))
    rows = rows.where(F.col(metric).isin([m for ms in candidates.values() for m in ms]))
    if namespace is not None:
        rows = rows.where(F.col(namespace_col) == namespace)
    per_resource = rows.groupBy(metric, resource).agg(F.count("*").alias("_n"))
    ranked = per_resource.groupBy(metric).agg(F.sum("_n").alias("points"))
    sample = (
        newest_per_key(per_resource, [metric], [F.col(resource)], 3, "_rk")
        .groupBy(metric)
        .agg(F.sort_array(F.collect_list(resource)).alias("resources"))
    )
    found = ranked.join(sample, metric).withColumnRenamed(metric, "metric_type")
    out = found.join(F.broadcast(table), "metric_type", "right")
    return out.select(
        "friendly",
        "metric_type",
        F.coalesce("points", F.lit(0)).alias("points"),
        (F.coalesce("points", F.lit(0)) > 0).alias("found"),
        F.coalesce("resources", F.array().cast("array<string>")).alias("resources"),
    )
