"""Files and payload texts: good rows, missing fields, bad numbers and times, empty series."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from metriloom.operators import forecast, store
from metriloom.sources import host, payloads, tables

AT = datetime(2024, 1, 1)


def bodies(spark, *docs, **columns):
    rows = [(d if isinstance(d, str) else json.dumps(d), AT, *columns.values()) for d in docs]
    return spark.createDataFrame(rows, ", ".join(["body string", "received_at timestamp", *[f"{c} string" for c in columns]]))


def sample_frame(spark):
    rows = [
        ("cpu", 1.0, datetime(2024, 1, 1, 5), "gauge", {"host": "a"}, "s"),
        ("mem", 2.0, datetime(2024, 1, 2, 5), "gauge", {"host": "a"}, "s"),
        ("cpu", 3.0, datetime(2024, 1, 3, 5), "gauge", {}, "s"),
    ]
    return spark.createDataFrame(rows, "name string, value double, timestamp timestamp, type string, labels map<string,string>, source string")


def test_samples_round_trip_and_pruning(spark, tmp_path, capsys):
    path = str(tmp_path / "samples")
    tables.write_samples(sample_frame(spark), path)
    everything = tables.read_samples(spark, path)
    assert everything.count() == 3 and "series_id" in everything.columns
    part = tables.read_samples(spark, path, start=datetime(2024, 1, 2), end=datetime(2024, 1, 3), names=["mem"])
    part.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(date" in plan and "(date" in plan.split("PartitionFilters")[1].splitlines()[0]
    pushed = plan.split("PushedFilters")[1].splitlines()[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "EqualTo(name,mem)" in pushed
    assert [r["value"] for r in part.collect()] == [2.0]


def test_training_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), 1.5, None)], "timestamp timestamp, rps double, cpu_usage double")
    tables.write_training_csv(df, path)
    assert [tuple(r) for r in tables.read_training_csv(spark, path, ["rps", "cpu_usage"]).collect()] == [(datetime(2024, 1, 1, 0, 5), 1.5, None)]


def test_parameters_keep_other_versions(spark, tmp_path):
    path = str(tmp_path / "params")
    df = spark.createDataFrame([("cpu", i, AT, float(i)) for i in range(30)], "name string, seq int, timestamp timestamp, value double")
    params = forecast.baseline_fit(df.withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(mins="seq")), keys=["name"])
    for version in (1, 2, 2):
        tables.write_parameters(params, path, model="baseline", version=version)
    assert spark.read.parquet(path).count() == 2
    again = tables.read_parameters(spark, path, model="baseline", version=2)
    assert forecast.portable_forecast(again, 1).first()["value"] == pytest.approx(24.5)  # mean of 18..29 plus slope 1


def test_summary(spark):
    r = tables.data_summary(sample_frame(spark)).first()
    assert (r["n_records"], r["n_columns"], r["start"]) == (3, 6, datetime(2024, 1, 1, 5))
    assert tables.data_summary(spark.range(2)).first()["start"] is None


def test_ingest_defaults_and_rejects(spark):
    docs = [
        {"metrics": [{"name": "cpu", "value": 0.5, "timestamp": "2024-01-02T03:04:05Z", "labels": {"host": "h", "n": 3}}, {}], "agent_version": "1"},
        {"metrics": [{"name": "x", "value": "many"}, {"name": "y", "value": "2", "timestamp": "whenever"}]},
        {"metrics": {"name": "x"}},
        "no json",
        {"metrics": []},
    ]
    samples, rejects = payloads.ingest_payload(bodies(spark, *docs))
    rows = {r["name"]: r for r in samples.collect()}
    assert set(rows) == {"cpu", "unknown", "y"}
    assert rows["cpu"]["timestamp"] == datetime(2024, 1, 2, 3, 4, 5) and rows["cpu"]["labels"] == {"host": "h", "n": "3"}
    assert (rows["unknown"]["value"], rows["unknown"]["timestamp"], rows["unknown"]["labels"]) == (0.0, AT, {})
    assert (rows["y"]["value"], rows["y"]["timestamp"]) == (2.0, AT)
    assert sorted(r["reason"] for r in rejects.collect()) == ["metrics is not a list"] * 2 + ["value is not a number"]


def test_registration_carries_control(spark):
    docs = [{"metrics": [{"name": "a", "labels": {"deployment": "production", "hostname": "long-host-name"}}, {"name": "a"}]}]
    agents = spark.createDataFrame([("long-hos-prod", True, 30)], "agent_id string, paused boolean, collection_interval int")
    r = store.registry_from_ingest(payloads.envelopes(bodies(spark, *docs)), agents).first()
    assert (r["agent_id"], r["metrics"], r["received"], r["paused"], r["collection_interval"], r["agent_version"]) == ("long-hos-prod", ["a"], 2, True, 30, "unknown")


def test_prometheus(spark):
    vector = {"data": {"resultType": "vector", "result": [
        {"metric": {"__name__": "up", "job": "a"}, "value": [1704067200.5, "1"]},
        {"metric": {"job": "b"}, "value": [1704067200, "NaN"]},
        {"metric": {}, "value": [1704067200, "oops"]},
        {"metric": {"job": "c"}},
    ]}}
    rows = payloads.normalize_promql_vector(bodies(spark, vector, query="My Rate(x)"), query="query").collect()
    got = [(r["name"], r["labels"].get("job"), str(r["value"])) for r in rows]
    assert got == [("up", "a", "1.0"), ("my_rate", "c", "0.0")]
    assert rows[0]["timestamp"] == datetime(2024, 1, 1, 0, 0, 0, 500000)
    matrix = {"data": {"resultType": "matrix", "result": [{"metric": {"a": "b"}, "values": [[1, "2"], [2, "3"]]}, {"metric": {}, "values": []}]}}
    rows = payloads.normalize_promql_matrix(bodies(spark, matrix, query="q"), query="query").collect()
    assert [(r["name"], r["value"], r["timestamp"]) for r in rows] == [("q", 3.0, datetime(1970, 1, 1, 0, 0, 2))]


def test_cloudwatch(spark):
    doc = {"Datapoints": [{"Timestamp": "2024-01-01T00:05:00Z", "Average": 2.0}, {"Timestamp": "2024-01-01T00:00:00Z", "Average": 1.0}]}
    r = payloads.normalize_cloudwatch(bodies(spark, doc, spec="AWS/EC2/CPUUtilization:InstanceId=i-1,Zone=a=b"), dimensions={"Zone": "z"}).first()
    assert (r["name"], r["value"], r["labels"]) == ("ec2_cpu_utilization", 2.0, {"InstanceId": "i-1", "Zone": "z", "namespace": "AWS/EC2"})
    assert payloads.normalize_cloudwatch(bodies(spark, doc, spec="flat")).count() == 0
    assert payloads.normalize_cloudwatch(bodies(spark, {"Datapoints": []}, spec="A/B")).count() == 0


def test_cloud_monitoring_value_kinds(spark):
    def ts(value, points=True):
        p = [{"interval": {"endTime": "2024-01-01T00:00:00Z"}, "value": value}] if points else []
        return {"metric": {"type": "a.b.com/x/y-z", "labels": {"k": "v"}}, "resource": {"type": "r", "labels": {"zone": "1"}}, "points": p}

    doc = {"timeSeries": [ts({"doubleValue": 0.0}), ts({"int64Value": "7"}), ts({"boolValue": True}), ts({"distributionValue": {"mean": 2.5}}), ts({}), ts({}, False)]}
    rows = payloads.normalize_cloud_monitoring(bodies(spark, doc), static_labels={"k": "w"}).collect()
    assert [r["value"] for r in rows] == [0.0, 7.0, 1.0, 2.5, 0.0]
    assert (rows[0]["name"], rows[0]["labels"]) == ("x_y_z", {"k": "w", "resource_zone": "1", "resource_type": "r"})
    assert payloads.normalize_cloud_monitoring(bodies(spark, doc), newest_only=False).count() == 5


def test_azure_takes_newest_value(spark):
    data = [{"timeStamp": "2024-01-01T00:00:00Z", "average": 1.0}, {"timeStamp": "2024-01-01T00:01:00Z", "average": 2.0}, {"timeStamp": "2024-01-01T00:02:00Z"}]
    doc = {"value": [{"name": {"value": "Used %"}, "timeseries": [{"metadatavalues": [{"name": {"value": "vm"}, "value": "a"}], "data": data}, {"data": []}]}]}
    rows = payloads.normalize_azure_monitor(bodies(spark, doc)).collect()
    assert [(r["name"], r["value"], r["labels"]) for r in rows] == [("used_pct", 2.0, {"vm": "a"})]


def test_datadog(spark):
    doc = {"series": [{"metric": "system.cpu.user", "scope": "host:a, env:b:c,loose", "pointlist": [[0, 1.0], [1000, None]]}, {"metric": "my.own", "scope": "", "pointlist": [[2000, 4.0]]}, {"metric": "x", "pointlist": []}]}
    rows = payloads.normalize_datadog(bodies(spark, doc, query="q")).collect()
    assert [(r["name"], r["value"], r["labels"]) for r in rows] == [("cpu_user", 0.0, {"host": "a", "env": "b:c"}), ("my_own", 4.0, {})]


def test_loadtest_csv_and_json(spark, tmp_path):
    stats = tmp_path / "stats.csv"
    stats.write_text('Type,Name,Request Count,Failure Count,Average Response Time,Requests/s\nPOST,Search,"1,355",2,14.5,0.5\n,Aggregated,1355,2,14.5,0.5\n')
    df = spark.read.csv(str(stats), header=True)
    rows = payloads.normalize_loadtest_csv(df, at=F.lit(AT)).collect()
    assert len(rows) == 8
    assert {(r["name"], r["labels"]["method"]): r["value"] for r in rows}[("loadtest_request_count", "POST")] == 1355.0
    assert {r["labels"]["method"] for r in rows} == {"POST", "ALL"}
    doc = {"stats": [{"safe_name": "s", "num_requests": 5, "avg": 2.5}, {}]}
    got = {(r["name"], r["labels"]["request"], r["labels"]["method"]): r["value"] for r in payloads.normalize_loadtest_json(bodies(spark, doc)).collect()}
    assert got[("loadtest_request_avg_ms", "s", "GET")] == 2.5 and got[("loadtest_request_count", "unknown", "GET")] == 0.0
    failures = tmp_path / "failures.csv"
    failures.write_text("Method,Name,Error,Occurrences\nPOST,Search,E0,170\nPOST,Search,E1,3\n")
    r = payloads.loadtest_failures(spark.read.csv(str(failures), header=True)).first()
    assert (r["failures"], r["kinds"]) == (173.0, 2)


def test_host_snapshot_with_gaps(spark):
    cols = "host string, timestamp timestamp, cpu_percent double, per_cpu array<double>, memory_percent double, memory_used long, memory_total long, disks array<struct<device: string, mountpoint: string, percent: double>>, bytes_recv long, bytes_sent long"
    df = spark.createDataFrame([("a", AT, 50.0, [10.0, 90.0], 25.0, 1, 4, [("sda", "/", 80.0)], 7, 8), ("b", AT, None, None, 10.0, None, None, None, None, None)], cols)
    rows = host.normalize_host_metrics(df).collect()
    a = [r for r in rows if r["labels"]["host"] == "a"]
    assert len(a) == 9 and {r["type"] for r in a if r["name"].startswith("network")} == {"counter"}
    assert [r["value"] for r in a if r["labels"].get("cpu") == "1"] == [0.9]
    assert [(r["name"], r["value"]) for r in rows if r["labels"]["host"] == "b"] == [("memory_utilization", 0.1)]


def test_union_skips_failed_sources(spark):
    with pytest.raises(ValueError):
        host.union_sources([None])
    out = host.union_sources([None, host.merge_static_labels(sample_frame(spark), {"host": "fixed"})])
    assert {r["labels"]["host"] for r in out.collect()} == {"fixed"}
    assert date(2024, 1, 1) == out.select(F.to_date(F.min("timestamp"))).first()[0]


def test_repeated_missing_and_huge_fields_do_not_stop_a_job(spark):
    datadog = {"series": [{"metric": "m", "scope": "role:web,role:db", "pointlist": [[1704067200000.0, 2.0]]}, {"metric": "n", "pointlist": [[]]}, {"metric": "o", "pointlist": [[1e300, 1.0]]}]}
    got = payloads.normalize_datadog(bodies(spark, datadog, query="q"), query="query").collect()
    assert [(r["name"], r["labels"]) for r in got] == [("m", {"role": "db"})]
    cloudwatch = {"Datapoints": [{"Timestamp": "2024-01-02T03:04:05Z", "Average": 1.5}, {"Timestamp": "2024-01-03T03:04:05Z", "Average": float("nan")}]}
    r = payloads.normalize_cloudwatch(bodies(spark, cloudwatch, spec="AWS/EC2/CPU:A=1,A=2,B"), spec="spec").first()
    assert (r["labels"], r["value"]) == ({"A": "2", "namespace": "AWS/EC2"}, 1.5)
    meta = [{"name": {"value": "k"}, "value": "1"}, {"name": {"value": "k"}, "value": "2"}, {"value": "3"}]
    azure = {"value": [{"name": {"value": "Cpu"}, "timeseries": [{"metadatavalues": meta, "data": [{"timeStamp": "2024-01-02T03:04:05Z", "average": 4.0}]}]}]}
    assert payloads.normalize_azure_monitor(bodies(spark, azure)).first()["labels"] == {"k": "2"}
    vector = {"data": {"result": [{"metric": {}, "value": [1e300, "1"]}, {"metric": {}, "value": [5, "Infinity"]}, {"metric": {"a": "b"}, "value": [5, "7"]}]}}
    assert [r["value"] for r in payloads.normalize_promql_vector(bodies(spark, vector, query="q"), query="query").collect()] == [7.0]
    points = [{"interval": {"endTime": "2024-01-02T03:04:05Z"}, "value": {"doubleValue": float("nan")}}, {"interval": {"endTime": "2024-01-01T03:04:05Z"}, "value": {"int64Value": "3"}}]
    series = {"timeSeries": [{"metric": {"type": "a/b", "labels": {}}, "resource": {"type": "t", "labels": {"x": "1"}}, "points": points}]}
    assert [r["value"] for r in payloads.normalize_cloud_monitoring(bodies(spark, series)).collect()] == [3.0]
    samples, rejects = payloads.ingest_payload(bodies(spark, {"metrics": [{"name": "x", "value": "NaN"}, {"name": "y", "value": "-Infinity"}, {"name": "z", "value": 1}]}))
    assert [r["name"] for r in samples.collect()] == ["z"] and rejects.count() == 2


def test_store_scans_read_only_the_folders_of_their_interval(spark, tmp_path):
    """The newest time and the window come from the newest folders; older files are never opened."""
    start = datetime(2024, 1, 1)
    rows = [("m", float(i), start + timedelta(hours=i), i) for i in range(24 * 20)] + [("m", -1.0, None, -1)]
    df = spark.createDataFrame(rows, "name string, value double, timestamp timestamp_ntz, seq long")
    at = str(tmp_path / "by-date")
    tables.write_by_date(df, at, order=["name"])
    assert tables.stored_dates(spark, at)[:2] == ["2024-01-20", "2024-01-19"]
    for old in sorted((tmp_path / "by-date").glob("date=2024-01-0*/*.parquet")):
        old.write_bytes(b"not a table")  # whatever opens it fails
    assert tables.newest_time(spark, at) == start + timedelta(hours=479)
    recent, as_of = tables.read_recent(spark, at, 36 * 3600)
    plan = recent._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-19" in plan and "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    found = store.get_metrics(recent, "m", hours=36, limit=1000, as_of=as_of).collect()
    assert [r["seq"] for r in found] == list(range(480 - 36, 480)) and "date" not in recent.columns
    monthly = str(tmp_path / "by-month")
    tables.write_by_date(df, monthly, unit="month")
    assert tables.stored_dates(spark, monthly) == ["2024-01-01"] and tables.read_recent(spark, monthly, 3600, unit="month")[0].count() == 2
    empty = str(tmp_path / "none")
    tables.write_by_date(df.limit(0), empty)
    assert tables.stored_dates(spark, empty) == []


def test_ingest_of_null_samples_and_empty_lists(spark):
    df = bodies(spark, {"metrics": [None, {"name": "a", "value": "2"}]}, {"metrics": []}, {"metrics": None}, "no json")
    samples, rejects = payloads.ingest_payload(df)
    assert sorted((r["name"], r["value"]) for r in samples.collect()) == [("a", 2.0), ("unknown", 0.0)]
    assert [r["reason"] for r in rejects.collect()] == ["metrics is not a list"] * 2
