"""Scaling recommendations, cooldown and the rule table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.functions.quantities import millicores
from metriloom.functions.time import MICROS, micros
from metriloom.operators.scale import chunk_number, join_small
from metriloom.session import written

# fixed values: thresholds and limits of the recommendations
SCALE_OUT_ABOVE, SCALE_IN_BELOW = 0.85, 0.3
MAX_REPLICAS, MIN_REPLICAS = 100, 1
LIMIT_FACTOR = 3


def effective_utilization(
    workloads: DataFrame, predictions: DataFrame | None = None, *, keys: Sequence[str] = ("namespace", "workload"), current: str = "current_utilization",
    value: str = "value",
) -> DataFrame:
    """The higher of current utilization (0.5 where unknown) and the highest predicted value."""
    now = F.coalesce(F.col(current), F.lit(0.5)) if current in workloads.columns else F.lit(0.5)
    if predictions is None:
        return workloads.withColumn("predicted_utilization", F.lit(None).cast("double")).withColumn("utilization", now)
    peak = predictions.groupBy(*keys).agg(F.max(value).alias("predicted_utilization"))
    out = workloads.join(peak, list(keys), "left")
    return out.withColumn("utilization", F.greatest(now, F.coalesce("predicted_utilization", F.lit(0.0))))


def scaling_action(df: DataFrame, *, target: float = 0.7) -> DataFrame:
    """One action per workload from ``utilization`` and ``replicas``: scale out, scale in, or none."""
    if not 0.1 <= target <= 0.95:
        raise ValueError("target utilization must lie between 0.1 and 0.95")
    u, n = F.col("utilization"), F.col("replicas")
    out, inn = u > SCALE_OUT_ABOVE, u < SCALE_IN_BELOW
    wanted = F.ceil(n * (u / target))
    placed = df.withColumn(
        "target_replicas",
        F.when(out, F.least(wanted, F.lit(MAX_REPLICAS))).when(inn, F.greatest(wanted, F.lit(MIN_REPLICAS))).cast("int"),
    )
    goal = F.col("target_replicas")
    change = F.format_string("Recommend scaling from %d to %d replicas.", n, goal)
    reason = (
        F.when(out, F.concat(F.format_string("Current utilization (%.1f%%) exceeds threshold (85.0%%). ", u * 100), change))
        .when(inn, F.concat(F.format_string("Current utilization (%.1f%%) is below threshold (30.0%%). ", u * 100), change))
        .otherwise(F.format_string("Utilization (%.1f%%) is within target range", u * 100))
    )
    return placed.withColumns(
        {
            "action": F.when(out, "scale_out").when(inn, "scale_in").otherwise("no_action"),
            "confidence": F.when(out, F.least(0.5 + (u - SCALE_OUT_ABOVE) * 2, F.lit(0.95)))
            .when(inn, F.least(0.4 + (SCALE_IN_BELOW - u), F.lit(0.85)))
            .otherwise(0.9),
            "reason": reason,
            "estimated_savings_percent": F.when(inn, F.when(n > goal, (n - goal) / n * 100).otherwise(0.0)),
        }
    )


def _oversized() -> Column:
    return millicores("cpu_limit") > millicores("cpu_request") * LIMIT_FACTOR


def _rightsizing_reason() -> Column:
    # fixed value: the sentence of this action
    return F.format_string(
        "CPU limit (%s) is significantly higher than request (%s). Consider right-sizing based on actual usage.", "cpu_limit", "cpu_request"
    )


def rightsizing(df: DataFrame) -> DataFrame:
    """An extra action where the cpu limit is more than three times the request."""
    return df.where(_oversized()).withColumns(
        {
            "action": F.lit("scale_down"),
            "target_cpu_request": F.col("cpu_request"),
            "confidence": F.lit(0.6),
            "reason": _rightsizing_reason(),
        }
    )


def recommend(df: DataFrame, *, target: float = 0.7) -> DataFrame:
    """All actions of every workload, one row each, from one reading of the input."""
    acted = scaling_action(df, target=target)
    sized = rightsizing(df)
    kinds = {**dict(sized.dtypes), **dict(acted.dtypes)}
    own, extra = set(df.columns), {"action": F.lit("scale_down"), "target_cpu_request": F.col("cpu_request"), "confidence": F.lit(0.6), "reason": _rightsizing_reason()}
    main = F.struct(*[(F.col(c) if c in acted.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    other = F.struct(*[extra.get(c, F.col(c) if c in own else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    rows = F.array_compact(F.array(main, F.when(_oversized(), other)))
    columns = [*acted.columns, *[c for c in kinds if c not in acted.columns]]
    return acted.select(F.inline(rows)).select(*columns)


# ---- cooldown ------------------------------------------------------------------------------


def _hops(times: np.ndarray, cooldown: int) -> np.ndarray:
    """Index of the first time that is at least ``cooldown`` after each time."""
    return np.searchsorted(times, times + cooldown, side="left")


def _chunk_exits(cooldown: int, chunk: int):
    """Per chunk: which last accepted time follows from each possible first one."""

    def one(number: int, times: np.ndarray) -> tuple[list, list]:
        n, hop = len(times), _hops(times, cooldown)
        end = np.where(hop < n, hop, np.arange(n))
        while True:  # every step doubles how far each time has followed its hops
            further = end[end]
            if np.array_equal(further, end):
                break
            end = further
        exits = times[end]
        # an earlier chunk can block at most the first cooldown of this one
        firsts = min(n, int(np.searchsorted(times, number * chunk + cooldown, side="left")) + 1)
        picked = np.flatnonzero(np.append(exits[1:firsts] != exits[: firsts - 1], True))
        return times[picked].tolist(), exits[picked].tolist()

    @F.pandas_udf("firsts array<bigint>, exits array<bigint>")
    def run(number: pd.Series, times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c, np.asarray(t)) for c, t in zip(number, times)], columns=["firsts", "exits"])

    return run


#: chunks, or nodes over chunks, that are composed into one node
FAN = 64


def _after(entry: np.ndarray, firsts: np.ndarray, exits: np.ndarray, cooldown: int) -> np.ndarray:
    """Last accepted time after a stretch, for last accepted times before it."""
    if not len(firsts):
        return entry
    j = np.searchsorted(firsts, entry + cooldown, side="left")
    return np.where(j < len(firsts), exits[np.minimum(j, len(firsts) - 1)], entry)


def _composed(cooldown: int):
    """Several consecutive maps from last accepted time to last accepted time as one.

    What passes the first stretch untouched lies before it by less than a cooldown, so it meets the next one at
    its first request. A composed map is thus at most one step longer than that of its first stretch.
    """

    @F.pandas_udf("firsts array<bigint>, exits array<bigint>")
    def run(parts: pd.Series) -> pd.DataFrame:
        out = []
        for group in parts:
            firsts, exits = np.empty(0, np.int64), np.empty(0, np.int64)
            for part in group:
                f, x = np.asarray(part["firsts"], np.int64), np.asarray(part["exits"], np.int64)
                firsts, exits = np.append(firsts, f[:1]), np.append(_after(exits, f, x, cooldown), x[:1]) if len(firsts) else x[:1]
                if len(firsts) == 1:
                    firsts, exits = f, x
                kept = np.append(exits[1:] != exits[:-1], True)
                firsts, exits = firsts[kept], exits[kept]
            out.append((firsts.tolist(), exits.tolist()))
        return pd.DataFrame(out, columns=["firsts", "exits"])

    return run


def _entered(cooldown: int):
    """Per node: the last accepted time before each of its parts, given the one before the node."""

    @F.pandas_udf("array<struct<node: bigint, entry: bigint>>")
    def run(parts: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for group, before in zip(parts, entry):
            last = None if pd.isna(before) else int(before)
            entries = []
            for part in group:
                entries.append({"node": int(part["node"]), "entry": last})
                if last is None:
                    last = int(part["exits"][0])
                else:
                    last = int(_after(np.array([last]), np.asarray(part["firsts"]), np.asarray(part["exits"]), cooldown)[0])
            out.append(entries)
        return pd.Series(out)

    return run


def _chunk_entries(exits: DataFrame, keys: Sequence[str], cooldown: int) -> DataFrame:
    """``chunk, entry`` per series: the last accepted time before each chunk (NULL before the first).

    Maps of ``FAN`` neighbours are composed level by level up to one node per series, and entries are handed down
    the same tree. No row holds more than ``FAN`` parts, however many chunks a series has.
    """
    ends = exits.agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).first()
    if ends["lo"] is None:
        return exits.select(*keys, "chunk", F.lit(None).cast("bigint").alias("entry"))
    part = F.struct("node", "firsts", "exits")

    def grouped(level: DataFrame) -> DataFrame:
        up = F.floor(F.col("node") / FAN).cast("bigint").alias("up")
        return level.groupBy(*keys, up).agg(F.array_sort(F.collect_list(part)).alias("parts"))

    levels = [exits.select(*keys, (F.col("chunk") - ends["lo"]).alias("node"), "firsts", "exits")]
    count = ends["hi"] - ends["lo"] + 1
    while True:
        count = -(-count // FAN)
        if count <= 1:
            break
        up = grouped(levels[-1]).select(*keys, F.col("up").alias("node"), _composed(cooldown)("parts").alias("x"))
        levels.append(written(up.select(*keys, "node", "x.firsts", "x.exits"), "cooldown-level"))
    entry = None
    for level in reversed(levels):
        nodes = grouped(level)
        if entry is None:
            placed = nodes.withColumn("entry", F.lit(None).cast("double"))
        else:
            placed = nodes.join(entry.select(*keys, F.col("node").alias("up"), F.col("entry").cast("double").alias("entry")), [*keys, "up"])
        entry = placed.select(*keys, F.inline(_entered(cooldown)("parts", "entry")))
    return entry.select(*keys, (F.col("node") + ends["lo"]).alias("chunk"), "entry")


def _accepted_positions(cooldown: int):
    """Per chunk: the positions of the accepted times, given the last accepted time before it."""

    @F.pandas_udf("array<int>")
    def run(times: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for t, last in zip(times, entry):
            t = np.asarray(t)
            hop, picked = _hops(t, cooldown), []
            i = 0 if pd.isna(last) else int(np.searchsorted(t, int(last) + cooldown, side="left"))
            while i < len(t):
                picked.append(i)
                i = int(hop[i])
            out.append(picked)
        return pd.Series(out)

    return run


def cooldown(
    requests: DataFrame, *, keys: Sequence[str] = ("namespace", "workload"), ts: str = "timestamp", tie: str = "seq", cooldown_seconds: int = 300,
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Mark each request accepted or not: accepted when the last accepted one is a cooldown ago.

    This is a sequential fold per series, cut into time chunks so that a busy series is spread over
    tasks. A chunk reports, for every first request it could accept, the last one it then accepts;
    these maps are composed in a tree over the chunks of a series to find how each chunk is entered; then each
    chunk marks its own requests. Requests at the same time are one step (the earliest by ``tie`` can win).
    """
    keys = list(keys)
    chunk_seconds = chunk_seconds or max(3600, cooldown_seconds)
    if cooldown_seconds > chunk_seconds:
        raise ValueError("a chunk must be at least one cooldown long")
    c, size = cooldown_seconds * MICROS, chunk_seconds * MICROS
    # of requests at the same time only the earliest arrival can win
    steps = requests.groupBy(*keys, chunk_number(ts, chunk_seconds).alias("chunk"), micros(ts).alias("us")).agg(F.min(tie).alias("tie"))
    steps = steps.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("us", "tie"))).alias("steps"))  # one chunk long
    times = F.transform("steps", lambda s: s["us"])
    exits = steps.select(*keys, "chunk", _chunk_exits(c, size)("chunk", times).alias("x"))
    entries = _chunk_entries(written(exits.select(*keys, "chunk", "x.firsts", "x.exits"), "cooldown-chunks"), keys, c)
    entry = F.col("entry").cast("double")  # below 2**53, so exact; NULL arrives as NaN
    marked = steps.join(entries, [*keys, "chunk"]).select(*keys, "steps", F.explode(_accepted_positions(c)(times, entry)).alias("at"))
    won = marked.select(*keys, F.col("steps")[F.col("at")].alias("s")).select(
        *keys, F.col("s.us").alias("_us"), F.col("s.tie").alias(tie), F.lit(True).alias("_won")
    )
    # at most one accepted request per series and cooldown, so usually few enough to broadcast
    out = join_small(requests.withColumn("_us", micros(ts)), won, [*keys, "_us", tie], "left").drop("_us")
    return out.withColumn("accepted", F.coalesce("_won", F.lit(False))).drop("_won")


def with_cooldown(actions: DataFrame) -> DataFrame:
    """Replace the action of requests that are not ``accepted``."""
    free = F.col("accepted")
    return actions.withColumns(
        {
            "action": F.when(free, F.col("action")).otherwise("no_action"),
            "confidence": F.when(free, F.col("confidence")).otherwise(1.0),
            "reason": F.when(free, F.col("reason")).otherwise("In cooldown period, no action recommended"),
        }
    )


# ---- rule table ----------------------------------------------------------------------------


def rule_actions(
    df: DataFrame, *, keys: Sequence[str], ts: str = "timestamp", cpu: str = "cpu_utilization", memory: str = "memory_utilization",
    predicted_cpu: str = "predicted_cpu", confidence: str = "confidence", predicted_traffic: str = "predicted_traffic",
    baseline_traffic: str = "baseline_traffic", severity: str | None = None,
) -> DataFrame:
    """Rows (keys, time, action) for every rule that holds, on an aligned frame."""
    hour = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-3600 * MICROS, 0)
    rules: list[tuple[str, Column]] = [
        ("SCALE_UP", (F.col(predicted_cpu) > 0.8) & (F.col(confidence) > 0.8)),
        ("SCALE_DOWN", F.col("_cpu_hour") < 0.2),
        ("INCREASE_MEMORY_LIMIT", F.col(memory) > 0.85),
        ("PREEMPTIVE_SCALE", F.col(predicted_traffic) > 2 * F.col(baseline_traffic)),
    ]
    if severity:
        rules += [("ALERT_CRITICAL", F.col(severity) == "critical"), ("ALERT_WARNING", F.col(severity).isin("high", "medium"))]
    placed = df.withColumn("_cpu_hour", F.max(cpu).over(hour))
    matched = F.filter(F.array(*[F.when(c, name) for name, c in rules]), lambda x: x.isNotNull())
    return placed.select(*keys, ts, F.explode(matched).alias("action"))
