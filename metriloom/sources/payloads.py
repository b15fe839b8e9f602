"""Payloads of monitoring back ends to the canonical sample table.

Every function takes a frame with one payload text per row (batch or stream) and returns samples
``(name, value, timestamp, type, labels, source)`` next to the columns named in ``keep``. Payloads are
read with a fixed schema, so nothing is inferred and a bad field becomes NULL instead of an error. Values
that are NaN or infinite are no values; of labels given twice the later counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriloom.functions.names import labels_of, literal_map, query_name, snake_case, with_labels
from metriloom.functions.quantities import finite
from metriloom.schemas import ENVELOPE

EMPTY = "map<string,string>"

PROMETHEUS = (
    "data struct<resultType: string, result: array<struct<metric: map<string,string>, value: array<string>, values: array<array<string>>>>>"
)
CLOUDWATCH = "Datapoints array<struct<Timestamp: string, Average: double>>"
CLOUD_MONITORING = (
    "timeSeries array<struct<metric: struct<type: string, labels: map<string,string>>, resource: struct<type: string, labels: map<string,string>>,"
    " points: array<struct<interval: struct<endTime: string>, value: struct<doubleValue: double, int64Value: string, boolValue: boolean,"
    " distributionValue: struct<mean: double>>>>>>"
)
AZURE = (
    "value array<struct<name: struct<value: string>, timeseries: array<struct<metadatavalues: array<struct<name: struct<value: string>, value: string>>,"
    " data: array<struct<timeStamp: string, average: double>>>>>>"
)
DATADOG = "series array<struct<metric: string, scope: string, pointlist: array<array<double>>>>"
LOADTEST = (
    "stats array<struct<name: string, safe_name: string, method: string, num_requests: string, num_failures: string, avg_response_time: string,"
    " avg: string, current_rps: string>>"
)


def _samples(df: DataFrame, name: Column, value: Column, time: Column, labels: Column, source: str, keep: Sequence[str], kind: str = "gauge") -> DataFrame:
    return df.select(
        *keep,
        name.alias("name"),
        value.cast("double").alias("value"),
        time.alias("timestamp"),
        F.lit(kind).alias("type"),
        F.coalesce(labels, F.create_map().cast(EMPTY)).alias("labels"),
        F.lit(source).alias("source"),
    )


#: seconds of the years 1 to 9999; other times are unreadable
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def _epoch(seconds: Column) -> Column:
    given = finite(seconds)
    return F.timestamp_micros(F.round(F.when(given.between(FIRST_SECOND, LAST_SECOND), given) * 1000000).try_cast("bigint"))


def _read_labels(labels: str | Column) -> Column:
    """Labels as parsed, which may hold a key twice."""
    return labels_of(F.map_entries(F.coalesce(F.col(labels) if isinstance(labels, str) else labels, F.create_map().cast(EMPTY))))


def _present(value: Column) -> Column:
    """``explode`` argument that keeps a row once if the value is there. A generator is not pushed below
    or merged into the parse, so the payload is parsed once; a filter on it would parse it again."""
    return F.filter(F.array(value), lambda v: v.isNotNull())


def ingest_payload(df: DataFrame, *, body: str = "body", received: str = "received_at", keep: Sequence[str] = (), source: str = "agent") -> tuple[DataFrame, DataFrame]:
    """Samples of posted envelopes, and the rejects.

    Missing name, value, labels or time get defaults (``unknown``, 0, none, the time of receipt); so
    does an unreadable time. An envelope whose ``metrics`` is not a list, and a sample whose value is
    not a number, go to the rejects with a reason.
    """
    # one row per sample, and one that holds none where there is no list, from one parse
    one = lambda listed, m: F.struct(F.lit(listed).alias("listed"), m.alias("m"))
    none = F.array(one(False, F.lit(None).cast(ENVELOPE["metrics"].dataType.elementType)))
    rows = F.coalesce(F.transform("_e", lambda m: one(True, m)), none)
    opened = df.withColumn("_e", F.from_json(body, ENVELOPE)["metrics"]).select(*keep, received, body, F.inline(rows))
    number = finite("m.value")
    bad = F.col("m.value").isNotNull() & number.isNull()
    samples = opened.where(F.col("listed") & ~bad).select(
        *keep,
        F.coalesce("m.name", F.lit("unknown")).alias("name"),
        F.coalesce(number, F.lit(0.0)).alias("value"),
        F.coalesce(F.col("m.timestamp").try_cast("timestamp"), F.col(received).cast("timestamp")).alias("timestamp"),
        F.coalesce("m.type", F.lit("gauge")).alias("type"),
        _read_labels("m.labels").alias("labels"),
        F.coalesce("m.source", F.lit(source)).alias("source"),
    )
    no_list = ~F.col("listed")
    rejects = opened.where(no_list | bad).select(
        *keep,
        F.when(no_list, "metrics is not a list").otherwise("value is not a number").alias("reason"),
        F.when(no_list, F.col(body)).otherwise(F.to_json("m")).alias("content"),
    )
    return samples, rejects


def envelopes(df: DataFrame, *, body: str = "body") -> DataFrame:
    """Envelopes with their samples still nested, for :func:`metriloom.operators.store.registry_from_ingest`."""
    with_list = F.filter(F.array(F.from_json(body, ENVELOPE)), lambda e: e["metrics"].isNotNull())
    return df.select(*[c for c in df.columns if c != body], F.inline(with_list)).drop("sent_at")


def _prometheus(df: DataFrame, body: str, query: str, keep: Sequence[str], point) -> DataFrame:
    rows = df.select(*keep, F.col(query).alias("_q"), F.explode(F.from_json(body, PROMETHEUS)["data"]["result"]).alias("r"))
    rows = rows.withColumn("_p", point(F.col("r"))).where("_p IS NOT NULL")
    labels = _read_labels("r.metric")
    number = finite(F.try_element_at("_p", F.lit(2)))
    time = _epoch(F.try_element_at("_p", F.lit(1)))
    name = F.coalesce(F.try_element_at(labels, F.lit("__name__")), query_name("_q"))
    rest = F.map_filter(labels, lambda k, _: k != "__name__")
    return _samples(rows.where(number.isNotNull() & time.isNotNull()), name, number, time, rest, "prometheus", keep)


def normalize_promql_vector(df: DataFrame, *, body: str = "body", query: str = "query", keep: Sequence[str] = ()) -> DataFrame:
    """Instant vectors. A missing value is 0 at time 0; an unreadable one is dropped."""
    zero = F.array(F.lit("0"), F.lit("0"))
    return _prometheus(df, body, query, keep, lambda r: F.coalesce(r["value"], zero))


def normalize_promql_matrix(df: DataFrame, *, body: str = "body", query: str = "query", keep: Sequence[str] = ()) -> DataFrame:
    """Range vectors: the last point of each series; series without points are dropped."""
    return _prometheus(df, body, query, keep, lambda r: F.when(F.size(r["values"]) > 0, F.element_at(r["values"], -1)))


def normalize_cloudwatch(
    df: DataFrame, *, body: str = "body", spec: str = "spec", dimensions: dict[str, str] | None = None, keep: Sequence[str] = (), every_capital: bool = False
) -> DataFrame:
    """The newest average per spec ``Namespace/Metric:Dim=Val,...``; other specs are dropped."""
    head, dims = F.split(F.col(spec), ":", 2)[0], F.coalesce(F.try_element_at(F.split(F.col(spec), ":", 2), F.lit(2)), F.lit(""))
    cut = F.regexp_extract(head, r"^(.+)/([^/]+)$", 1)
    metric = F.regexp_extract(head, r"^(.+)/([^/]+)$", 2)
    points = F.transform(
        F.from_json(body, CLOUDWATCH)["Datapoints"],
        lambda d: F.struct(d["Timestamp"].try_cast("timestamp").alias("at"), finite(F.coalesce(d["Average"], F.lit(0.0))).alias("v")),
    )
    newest = F.array_max(F.filter(points, lambda p: p["at"].isNotNull() & p["v"].isNotNull()))
    rows = df.select("*", cut.alias("_ns"), metric.alias("_metric")).where("_ns <> ''").select("*", F.explode(_present(newest)).alias("_p"))
    pairs = F.filter(F.split(dims, ","), lambda p: F.contains(p, F.lit("=")))
    given = labels_of(F.transform(pairs, lambda p: F.struct(F.split(p, "=", 2)[0].alias("key"), F.split(p, "=", 2)[1].alias("value"))))
    labels = with_labels(given, literal_map(dimensions)) if dimensions else given
    labels = with_labels(labels, F.create_map(F.lit("namespace"), F.col("_ns")))
    short = F.replace(F.regexp_replace(F.lower("_ns"), "^aws/", ""), F.lit("/"), F.lit("_"))
    name = F.concat(short, F.lit("_"), snake_case("_metric", every_capital))
    return _samples(rows, name, F.col("_p.v"), F.col("_p.at"), labels, "cloudwatch", keep)


def normalize_cloud_monitoring(
    df: DataFrame, *, body: str = "body", static_labels: dict[str, str] | None = None, newest_only: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """Time series with typed values; metric labels, prefixed resource labels, resource type, static labels."""
    rows = df.select(*keep, F.explode(F.from_json(body, CLOUD_MONITORING)["timeSeries"]).alias("s"))

    def point(p):
        v = p["value"]
        number = F.coalesce(v["doubleValue"], v["int64Value"].try_cast("double"), v["boolValue"].cast("double"), v["distributionValue"]["mean"], F.lit(0.0))
        return F.struct(p["interval"]["endTime"].try_cast("timestamp").alias("at"), finite(number).alias("v"))

    points = F.filter(F.transform("s.points", point), lambda p: p["at"].isNotNull() & p["v"].isNotNull())
    rows = rows.withColumn("_p", F.explode(_present(F.array_max(points)) if newest_only else points))
    prefixed = F.transform_keys(_read_labels("s.resource.labels"), lambda k, _: F.concat(F.lit("resource_"), k))
    labels = with_labels(_read_labels("s.metric.labels"), prefixed)
    labels = with_labels(labels, F.create_map(F.lit("resource_type"), F.coalesce("s.resource.type", F.lit(""))))
    if static_labels:
        labels = with_labels(labels, literal_map(static_labels))
    name = F.regexp_replace(F.regexp_replace("s.metric.type", "^[^/]*/", ""), "[/-]", "_")
    return _samples(rows, name, F.col("_p.v"), F.col("_p.at"), labels, "cloud_monitoring", keep)


def normalize_azure_monitor(df: DataFrame, *, body: str = "body", keep: Sequence[str] = (), every_capital: bool = False) -> DataFrame:
    """The newest non-null average of each time series; metadata values become labels."""
    metrics = df.select(*keep, F.explode(F.from_json(body, AZURE)["value"]).alias("m"))
    rows = metrics.select(*keep, F.col("m.name.value").alias("_name"), F.explode("m.timeseries").alias("t"))
    points = F.transform("t.data", lambda d: F.struct(d["timeStamp"].try_cast("timestamp").alias("at"), finite(d["average"]).alias("v")))
    newest = F.array_max(F.filter(points, lambda p: p["v"].isNotNull() & p["at"].isNotNull()))
    rows = rows.withColumn("_p", F.explode(_present(newest)))
    labels = labels_of(F.transform("t.metadatavalues", lambda v: F.struct(v["name"]["value"].alias("key"), v["value"].alias("value"))))
    words = F.replace(F.replace(snake_case("_name", every_capital), F.lit(" "), F.lit("_")), F.lit("%"), F.lit("pct"))
    return _samples(rows, words, F.col("_p.v"), F.col("_p.at"), labels, "azure_monitor", keep)


def normalize_datadog(df: DataFrame, *, body: str = "body", query: str = "query", keep: Sequence[str] = ()) -> DataFrame:
    """The last point of each series; a null value is 0; the scope text becomes labels."""
    rows = df.select(*keep, F.col(query).alias("_q"), F.explode(F.from_json(body, DATADOG)["series"]).alias("s")).where(F.size("s.pointlist") > 0)
    point = F.element_at("s.pointlist", -1)
    time = _epoch(F.floor(F.get(point, 0)) / 1000)
    number = F.when(F.get(point, 1).isNull(), 0.0).otherwise(finite(F.get(point, 1)))
    pairs = F.filter(F.split(F.coalesce("s.scope", F.lit("")), ","), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.split(p, ":", 2)[0]).alias("key"), F.trim(F.split(p, ":", 2)[1]).alias("value")))
    metric = F.coalesce("s.metric", F.col("_q"))
    name = F.replace(F.regexp_replace(metric, r"^(system|aws|azure|gcp)\.", ""), F.lit("."), F.lit("_"))
    return _samples(rows.where(number.isNotNull() & time.isNotNull()), name, number, time, labels_of(entries), "datadog", keep)


GAUGES = {"loadtest_request_count": "count", "loadtest_request_failures": "failures", "loadtest_request_rps": "rps", "loadtest_request_avg_ms": "avg_ms"}


def plain_number(text: str | Column) -> Column:
    """Number from text with thousands commas; anything else is 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"), F.lit(0.0))


def _loadtest_gauges(df: DataFrame, keep: Sequence[str], at: Column) -> DataFrame:
    gauges = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in GAUGES.items()])
    rows = df.select(*keep, "request", "method", at.alias("_at"), F.inline(gauges))
    labels = F.create_map(F.lit("request"), F.col("request"), F.lit("method"), F.col("method"))
    return _samples(rows, F.col("name"), F.col("value"), F.col("_at"), labels, "loadtest", keep)


def normalize_loadtest_json(df: DataFrame, *, body: str = "body", received: str = "received_at", keep: Sequence[str] = ()) -> DataFrame:
    """Four gauges per (request, method) of a statistics document."""
    rows = df.select(*keep, F.col(received).cast("timestamp").alias("_at"), F.explode(F.from_json(body, LOADTEST)["stats"]).alias("s"))

    def text(*names):
        return F.coalesce(*[F.when(F.col(f"s.{n}") != "", F.col(f"s.{n}")) for n in names])

    out = rows.select(
        *keep,
        "_at",
        F.coalesce(text("name", "safe_name"), F.lit("unknown")).alias("request"),
        F.coalesce(text("method"), F.lit("GET")).alias("method"),
        plain_number(text("num_requests")).alias("count"),
        plain_number(text("num_failures")).alias("failures"),
        plain_number(text("current_rps")).alias("rps"),
        plain_number(text("avg_response_time", "avg")).alias("avg_ms"),
    )
    return _loadtest_gauges(out, keep, F.col("_at"))


def normalize_loadtest_csv(df: DataFrame, *, at: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Four gauges per row of a statistics CSV read as text; a row with an empty type is the total."""
    is_total = F.coalesce(F.col("Type"), F.lit("")) == ""
    out = df.select(
        *keep,
        F.when(is_total, F.coalesce("Name", F.lit("Aggregated"))).otherwise(F.coalesce("Name", F.lit("unknown"))).alias("request"),
        F.when(is_total, "ALL").otherwise(F.col("Type")).alias("method"),
        plain_number("Request Count").alias("count"),
        plain_number("Failure Count").alias("failures"),
        plain_number("`Requests/s`").alias("rps"),
        plain_number("Average Response Time").alias("avg_ms"),
    )
    return _loadtest_gauges(out, keep, at)


def loadtest_failures(df: DataFrame) -> DataFrame:
    """Failure CSV rows (Method, Name, Error, Occurrences) summed per request and method."""
    return df.groupBy(F.col("Name").alias("request"), F.col("Method").alias("method")).agg(
        F.sum(plain_number("Occurrences")).alias("failures"), F.count_distinct("Error").alias("kinds")
    )
