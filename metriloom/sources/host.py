"""Host snapshots to samples, and the union of sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriloom.functions.names import literal_map, with_labels


def normalize_host_metrics(df: DataFrame, *, keep: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Wide host snapshots to long samples.

    Percentages become ratios; memory and network stay bytes; network values are counters. Input:
    ``host``, ``cpu_percent``, ``per_cpu`` (array), ``memory_percent``, ``memory_used``,
    ``memory_total``, ``disks`` (array of device, mountpoint, percent), ``bytes_recv``, ``bytes_sent``.
    NULL columns give no sample.
    """
    host = F.create_map(F.lit("host"), F.col("host"))

    def sample(name, value, labels=host, kind="gauge"):
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(kind).alias("type"), labels.alias("labels"))

    def tagged(key, value):
        return F.create_map(F.lit("host"), F.col("host"), F.lit(key), F.lit(value))

    fixed = F.array(
        sample("cpu_utilization", F.col("cpu_percent") / 100),
        sample("memory_utilization", F.col("memory_percent") / 100),
        sample("memory_bytes", F.col("memory_used"), tagged("type", "used")),
        sample("memory_bytes", F.col("memory_total"), tagged("type", "total")),
        sample("network_bytes_recv", F.col("bytes_recv"), kind="counter"),
        sample("network_bytes_sent", F.col("bytes_sent"), kind="counter"),
    )
    cpus = F.transform(
        "per_cpu",
        lambda p, i: sample("cpu_utilization", p / 100, F.create_map(F.lit("host"), F.col("host"), F.lit("cpu"), i.cast("string"))),
    )
    disks = F.transform(
        "disks",
        lambda d: sample(
            "disk_utilization",
            d["percent"] / 100,
            F.create_map(F.lit("host"), F.col("host"), F.lit("device"), d["device"], F.lit("mountpoint"), d["mountpoint"]),
        ),
    )
    none = F.slice(fixed, 1, 0)
    every = F.concat(fixed, F.coalesce(cpus, none), F.coalesce(disks, none))
    return df.select(*keep, ts, F.inline(every)).where("value IS NOT NULL").withColumn("source", F.lit("system"))


def merge_static_labels(df: DataFrame, static: dict[str, str]) -> DataFrame:
    """Configured labels override the sample's own."""
    return df.withColumn("labels", with_labels("labels", literal_map(static))) if static else df


def union_sources(sources: Sequence[DataFrame | None]) -> DataFrame:
    """All sources under one schema; a source that failed (None) is skipped."""
    present = [s for s in sources if s is not None]
    if not present:
        raise ValueError("no source returned data")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
