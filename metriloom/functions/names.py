"""Metric and label names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metriloom.functions.time import col


def snake_case(name: str | Column, every_capital: bool = False) -> Column:
    """CamelCase to snake_case. Runs of capitals stay one word (``CPUUtilization`` -> ``cpu_utilization``);
    with ``every_capital`` each capital starts a word."""
    boundary = "(?<!^)(?=[A-Z])" if every_capital else "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    return F.lower(F.regexp_replace(col(name), boundary, "_"))


def query_name(query: str | Column) -> Column:
    """Name of an expression: its text before the first bracket, lower case, blanks to underscores."""
    head = F.regexp_extract(F.trim(col(query)), r"^([^({\[]*)", 1)
    return F.lower(F.replace(F.trim(head), F.lit(" "), F.lit("_")))


def series_id(name: str | Column, labels: str | Column) -> Column:
    """Name and sorted labels as one text key."""
    entries = F.array_sort(F.map_entries(col(labels)))
    return F.concat(col(name), F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit("}"))


def labels_of(entries: Column) -> Column:
    """Map of (key, value) entries: NULL keys are dropped, the last of equal keys wins."""
    given = F.reverse(F.filter(entries, lambda e: e["key"].isNotNull()))
    keys = F.transform(given, lambda e: e["key"])
    last = F.filter(given, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(F.reverse(last))


def with_labels(labels: str | Column, extra: Column) -> Column:
    """Labels overridden by ``extra`` (later wins)."""
    base = F.coalesce(col(labels), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


def literal_map(labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]).cast("map<string,string>")
