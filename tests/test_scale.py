"""The chunked building blocks against brute force, with one key holding most rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metriloom.operators import scale
from metriloom.operators.recommend import cooldown

START = datetime(2024, 1, 1)


def skewed(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.integers(5)}"
        rows.append((key, i, START + timedelta(seconds=int(rng.integers(0, 40_000))), float(rng.integers(0, 50))))
    return rows, spark.createDataFrame(rows, "key string, seq long, ts timestamp, v double")


@pytest.mark.parametrize("chunk", [60, 3600, 86400])
def test_numbered_and_previous(spark, chunk):
    rows, df = skewed(spark)
    numbers = {r["seq"]: (r["row_index"], r["series_rows"]) for r in scale.numbered(df, ["key"], "ts", "seq", chunk_seconds=chunk).collect()}
    prev = {r["seq"]: r["p"] for r in scale.with_previous(df, ["key"], "ts", "seq", {"v": "p"}, chunk_seconds=chunk).collect()}
    assert len(numbers) == len(prev) == len(rows)
    for key in {r[0] for r in rows}:
        series = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(series):
            assert numbers[r[1]] == (i + 1, len(series))
            assert prev[r[1]] == (series[i - 1][3] if i else None)


@pytest.mark.parametrize("chunk", [60, 3600])
def test_running_sum(spark, chunk):
    rows, df = skewed(spark)
    got = {r["seq"]: r["total"] for r in scale.running_sum(df, ["key"], "ts", "seq", "v", "total", chunk).collect()}
    for key in {r[0] for r in rows}:
        total = 0.0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            total += r[3]
            assert got[r[1]] == total


def test_previous_keeps_null_values(spark):
    df = spark.createDataFrame(
        [("a", 1, START, 1.0), ("a", 2, START + timedelta(hours=1), None), ("a", 3, START + timedelta(hours=2), 3.0)],
        "key string, seq long, ts timestamp, v double",
    )
    got = {r["seq"]: r["p"] for r in scale.with_previous(df, ["key"], "ts", "seq", {"v": "p"}, chunk_seconds=60).collect()}
    assert got == {1: None, 2: 1.0, 3: None}


@pytest.mark.parametrize("n", [1, 37, 599, 600, 5000])
def test_newest_rows(spark, n):
    rows, df = skewed(spark)
    want = sorted(rows, key=lambda r: (r[2], r[1]), reverse=True)[:n]
    got = scale.newest_rows(df, "ts", "seq", n, bins=7)
    assert sorted(r["seq"] for r in got.collect()) == sorted(r[1] for r in want)
    assert got.columns == df.columns


@pytest.mark.parametrize("n", [3, 300])
def test_newest_per_key(spark, n):
    from pyspark.sql import functions as F

    rows, df = skewed(spark)
    got = scale.newest_per_key(df, ["key"], [F.desc("ts"), F.desc("seq")], n).collect()
    for key in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]), reverse=True)[:n]
        assert [r["seq"] for r in sorted((g for g in got if g["key"] == key), key=lambda g: g["rank"])] == [w[1] for w in want]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("bins", [3, 2000])
def test_exact_percentile(spark, q, bins):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 500), np.full(200, 0.25), rng.normal(1e6, 1, 5)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = scale.exact_percentile(df, "v", q, bins=bins)
    assert got == pytest.approx(np.percentile(values, q * 100), abs=1e-9)


def test_percentile_of_nothing(spark):
    assert scale.exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_join_small_both_ways(spark, threshold):
    rows, df = skewed(spark)
    counts = df.groupBy("key").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joined = scale.join_small(df, counts, ["key"])
    assert joined.count() == len(rows)
    assert {(r["key"], r["count"]) for r in joined.collect()} == {(k, sum(1 for r in rows if r[0] == k)) for k in {r[0] for r in rows}}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("gap,chunk", [(60, 60), (300, 600), (300, 7200), (1777, 2000), (3600, 86400)])
def test_cooldown_is_exact(spark, gap, chunk):
    rows, df = skewed(spark, n=900, seed=gap)
    got = {r["seq"]: r["accepted"] for r in cooldown(df, keys=["key"], ts="ts", cooldown_seconds=gap, chunk_seconds=chunk).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            free = last is None or (r[2] - last).total_seconds() >= gap
            assert got[r[1]] == free, (key, r)
            last = r[2] if free else last


def test_newest_rows_of_one_moment(spark):
    """All rows have one time: the tie cuts, also where ties are repeated or null, and no task ranks."""
    rows = [(START, i, i % 7) for i in range(500)] + [(START - timedelta(days=1), 1, 1), (None, 9, 9)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, seq long, few int")
    for n in (1, 17, 499):
        out = scale.newest_rows(df, "ts", "seq", n, bins=5)
        assert sorted(r["seq"] for r in out.collect()) == list(range(500 - n, 500))
        assert "Window" not in out._jdf.queryExecution().toString()
    assert scale.newest_rows(df, "ts", "seq", 500).count() == 500 and scale.newest_rows(df, "ts", "seq", 501).count() == 501
    assert scale.newest_rows(df, "ts", "seq", 502).count() == 502 and scale.newest_rows(df, "ts", "seq", 0).count() == 0
    few = scale.newest_rows(df, "ts", "few", 100).groupBy("few").count().collect()
    assert {r["few"]: r["count"] for r in few} == {6: 71, 5: 29}
    nulls = spark.createDataFrame([(START, None)] * 5 + [(START, 3)], "ts timestamp_ntz, seq long")
    assert sorted(str(r["seq"]) for r in scale.newest_rows(nulls, "ts", "seq", 3).collect()) == ["3", "None", "None"]


def test_nth_largest(spark):
    rng = np.random.default_rng(4)
    values = [int(v) for v in rng.integers(-(2**62), 2**62, 300)] + [2**63 - 1, -(2**63), 5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    down = sorted(values, reverse=True)
    for n in (1, 2, 150, 151, 153, 305):
        found, above = scale.nth_largest(df, F.col("v"), n, bins=10)
        assert found == down[n - 1] and above == sum(v > found for v in values)
    assert scale.nth_largest(df, F.col("v"), 306) is None


def test_cooldown_composes_chunks_in_a_tree(spark, monkeypatch):
    """Many chunks and a small fan: entries come down several levels; no row holds more parts than the fan."""
    from metriloom.operators import recommend

    monkeypatch.setattr(recommend, "FAN", 3)
    rows, df = skewed(spark, n=900, seed=11)
    got = {r["seq"]: r["accepted"] for r in cooldown(df, keys=["key"], ts="ts", cooldown_seconds=97, chunk_seconds=97).collect()}
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            free = last is None or (r[2] - last).total_seconds() >= 97
            assert got[r[1]] == free, (key, r)
            last = r[2] if free else last


def test_cooldown_of_a_million_chunks(spark):
    """A series of 10**6 chunks: its entries follow from the maps, and rows stay small on every level."""
    from metriloom.operators import recommend

    n, size, gap = 1_000_000, 3_600 * 10**6, 5_000 * 10**6 // 2
    # one request a chunk, 700 to 2900 seconds into it
    at = F.col("id") * size + (700 + F.pmod(F.xxhash64("id"), F.lit(2_200))) * 10**6
    maps = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("chunk"), F.array(at).alias("firsts"), F.array(at).alias("exits"))
    entries = recommend._chunk_entries(maps, ["key"], gap).toPandas().sort_values("chunk")
    times = maps.select("chunk", F.col("firsts")[0].alias("t")).toPandas().sort_values("chunk")["t"].to_numpy()
    want, last = np.full(n, -1), None
    for i, t in enumerate(times.tolist()):
        want[i] = -1 if last is None else last
        last = t if last is None or t >= last + gap else last
    assert np.array_equal(entries["entry"].fillna(-1).to_numpy("int64"), want)
