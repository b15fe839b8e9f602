"""Streams over several files and micro-batches against brute force."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from metriloom.operators import store
from metriloom.streaming import jobs, stateful

START = datetime(2024, 1, 1)


@pytest.fixture(params=["in order", "shuffled"])
def source(request, spark, tmp_path):
    """Three files, read one per micro-batch: in time order, or each with rows of the whole span. One key has most rows."""
    rng = np.random.default_rng(5)
    seconds = np.sort(rng.integers(0, 20_000, 240))
    rows = [("hot" if rng.random() < 0.7 else "cold", i, START + timedelta(seconds=int(s)), float(rng.integers(0, 100))) for i, s in enumerate(seconds)]
    schema = spark.createDataFrame(rows[:1], "name string, seq long, timestamp timestamp, value double").schema
    folder = str(tmp_path / "in")
    dealt = rows if request.param == "in order" else [rows[i] for i in rng.permutation(240)]
    for part in range(3):
        spark.createDataFrame(dealt[part * 80 : part * 80 + 80], schema).coalesce(1).write.mode("append").parquet(folder)
    return rows, jobs.read_table_stream(spark, folder, schema, files_per_trigger=1)


def finished(stream, tmp_path, label, make):
    """Rows of an ordered stream after its end; nothing may be late."""
    closed, close = jobs.closed_by(stream, "timestamp", str(tmp_path / f"end-{label}"))
    out = jobs.replay(make(closed), label, close=close)
    assert out.where("late").count() == 0
    return out


def by_key(rows):
    return {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}


WAIT = {"delay": "6 hours", "slot_seconds": 60}


def test_cooldown(source, tmp_path):
    rows, stream = source
    out = finished(stream, tmp_path, "c", lambda s: stateful.stream_cooldown(s, keys=["name"], cooldown_seconds=300, **WAIT))
    got = {r["seq"]: r["accepted"] for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    for series in by_key(rows).values():
        last = None
        for r in series:
            free = last is None or (r[2] - last).total_seconds() >= 300
            last = r[2] if free else last
            assert got[r[1]] == free


def test_alert(source, tmp_path):
    rows, stream = source
    out = finished(stream, tmp_path, "a", lambda s: stateful.stream_alerts(s, keys=["name"], op=">", threshold=30.0, for_seconds=200, **WAIT))
    got = {r["seq"]: r["state"] for r in out.collect()}
    for series in by_key(rows).values():
        since = None
        for r in series:
            since = (since or r[2]) if r[3] > 30 else None
            want = "inactive" if since is None else "firing" if (r[2] - since).total_seconds() >= 200 else "pending"
            assert got[r[1]] == want


def test_history_and_zscore(source, tmp_path):
    rows, stream = source
    facts = finished(stream, tmp_path, "h", lambda s: stateful.stream_history(s, keys=["name"], size=30, **WAIT))
    newest = {r["name"]: r for r in store.get_latest(facts, keys=["name"], ts="until", tie="n").collect()}
    scored = finished(stream, tmp_path, "z", lambda s: stateful.stream_zscore(s, keys=["name"], sigma=1.5, **WAIT))
    found = {r["seq"]: r["score"] for r in scored.collect()}
    for name, series in by_key(rows).items():
        values = [r[3] for r in series]
        assert newest[name]["n"] == min(30, len(values)) and newest[name]["last"] == values[-1]
        assert newest[name]["ma"] == pytest.approx(np.mean(values[-12:])) and newest[name]["prev"] == pytest.approx(np.mean(values[-24:-12]))
        for i, r in enumerate(series):
            score = abs(r[3] - np.mean(values[:i])) / max(np.std(values[:i]), 0.001) if i >= 12 else 0
            if abs(score - 1.5) > 1e-6:
                assert (r[1] in found) == (score > 1.5)
            if r[1] in found:
                assert found[r[1]] == pytest.approx(score, abs=1e-6)


def minutes(spark, folder, *files):
    """A stream of one file per batch; a file is a list of (minute, value)."""
    schema, seq = "name string, seq long, timestamp timestamp, value double", 0
    for rows in files:
        full = [("a", seq + i, None if m is None else START + timedelta(minutes=m), v) for i, (m, v) in enumerate(rows)]
        seq += len(rows)
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_table_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def test_cooldown_of_files_that_come_out_of_order(spark, tmp_path):
    stream = minutes(spark, str(tmp_path / "in"), [(20, 1.0), (21, 1.0)], [(0, 1.0), (5, 1.0), (10, 1.0)])
    out = finished(stream, tmp_path, "o", lambda s: stateful.stream_cooldown(s, keys=["name"], cooldown_seconds=300, delay="30 minutes"))
    assert sorted((r["timestamp"] - START).seconds // 60 for r in out.where("accepted").collect()) == [0, 5, 10, 20]


def test_late_rows_go_to_a_second_table(spark, tmp_path):
    """Rows behind the watermark, and rows without a time, change nothing and are kept apart."""
    files = [(0, 50.0), (1, 50.0), (40, 50.0)], [(41, 50.0), (42, 1.0)], [(2, 1.0), (43, 50.0), (None, 50.0)], [(90, 1.0)], [(91, 50.0)]
    stream = minutes(spark, str(tmp_path / "in"), *files)
    alerts = stateful.stream_alerts(stream, keys=["name"], op=">", threshold=30.0, for_seconds=60, delay="5 minutes")
    at, late, checkpoint = (str(tmp_path / x) for x in ("table", "late", "checkpoint"))
    jobs.start_split(alerts, at, late, checkpoint, available_now=True).awaitTermination()
    rows = sorted((r["seq"], r["state"]) for r in spark.read.parquet(at).collect())
    assert rows == [(0, "pending"), (1, "firing"), (2, "firing"), (3, "firing"), (4, "inactive"), (6, "pending")]
    behind = sorted((r["seq"], r["state"], r["timestamp"]) for r in spark.read.parquet(late).collect())
    assert behind == [(5, None, START + timedelta(minutes=2)), (7, None, None)]


def test_liveness_across_batches(source, request):
    if "shuffled" in request.node.name:
        pytest.skip("liveness reads beats as they come")
    rows, stream = source
    got = [(r["name"], r["status"], r["at"]) for r in jobs.replay(stateful.stream_liveness(stream, keys=["name"], delay="1 second"), "l").collect()]
    want = []
    watermark = max(r[2] for r in rows) - timedelta(seconds=1)
    for name, series in by_key(rows).items():
        for i, r in enumerate(series):
            if i == 0 or (r[2] - series[i - 1][2]).total_seconds() > 120:
                want.append((name, "online", r[2]))
            until = series[i + 1][2] if i + 1 < len(series) else watermark
            want += [(name, s, r[2] + timedelta(seconds=w)) for s, w in (("warning", 120), ("offline", 300)) if (until - r[2]).total_seconds() > w]
    assert sorted(got) == sorted(want)


def test_align_drops_late_rows(spark, tmp_path):
    folder = str(tmp_path / "late")
    schema = "name string, seq long, timestamp timestamp, value double"
    first = [("a", 1, START, 1.0), ("a", 2, START + timedelta(minutes=40), 2.0)]
    second = [("a", 3, START + timedelta(minutes=41), 5.0)]
    third = [("a", 4, START + timedelta(minutes=1), 9.0), ("a", 5, START + timedelta(minutes=80), 3.0)]
    for rows in (first, second, third):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_table_stream(spark, folder, spark.createDataFrame(first, schema).schema, files_per_trigger=1)
    rows = jobs.replay(jobs.stream_align(stream, keys=["name"]), "align").orderBy("timestamp").collect()
    assert [(r["timestamp"], r["total"]) for r in rows] == [(START, 1.0), (START + timedelta(minutes=40), 7.0)]


def test_registry_batches_equal_one_fold(spark, tmp_path):
    cols = "agent_id int, seq long, timestamp timestamp, kind string, hostname string, agent_version string, deployment_id string, metrics_count long, metrics string, paused boolean, collection_interval long"
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        kind = ["register", "heartbeat", "config"][rng.integers(3)]
        reg, beat, conf = kind == "register", kind == "heartbeat", kind == "config"
        rows.append((
            int(rng.integers(6)), i, START + timedelta(minutes=i), kind, f"h{i}" if reg else None, f"v{i}" if reg else None, "d" if reg else None,
            i if beat else None, ["", f"m{i}"][i % 2] if beat or reg else None, bool(i % 2) if conf and i % 3 else None, i if conf else None,
        ))
    folder = str(tmp_path / "events")
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], cols).coalesce(1).write.mode("append").parquet(folder)
    whole = spark.createDataFrame(rows, cols)
    stream = jobs.read_table_stream(spark, folder, whole.schema, files_per_trigger=1)
    state = str(tmp_path / "state")
    jobs.stream_registry(stream, state, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert sorted(map(str, store.registry_view(jobs.state_version(spark, state)).collect())) == sorted(map(str, store.agent_registry(whole).collect()))
    jobs.registry_batch_writer(state)(whole.limit(0), 2)  # a repeated batch rewrites its own version only
    assert jobs.state_version(spark, state, before=2).count() > 0


def test_history_of_many_series_keeps_few_state_rows(spark, tmp_path):
    """State is kept by buckets of series: the rows of state written are fewer than the series."""
    rows = [(i % 1500 or None, f"h{i // 1500}", i, START + timedelta(minutes=j), float(i + j)) for i in range(6000) for j in range(3)]
    rows.append((1, "h0", -1, None, 7.0))
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "agent long, host string, seq long, timestamp timestamp, value double").write.parquet(folder)
    stream = jobs.read_table_stream(spark, folder, spark.read.parquet(folder).schema)
    closed, close = jobs.closed_by(stream, "timestamp", str(tmp_path / "end"))
    facts = stateful.stream_history(closed, keys=["agent", "host"], size=2, window=2, delay="1 day", slot_seconds=3600)
    updated = 0
    for _ in range(2):
        query = jobs.start(facts, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
        query.awaitTermination()
        updated += sum(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"])
        close()
    out = spark.read.schema(facts.schema).parquet(str(tmp_path / "out")).collect()
    assert [(r["agent"], r["host"], r["last"], r["until"]) for r in out if r["late"]] == [(1, "h0", 7.0, None)]
    got = {(r["agent"], r["host"]): (r["n"], r["last"], r["ma"], r["prev"], r["std"], r["until"]) for r in out if not r["late"]}
    assert len(got) == len(out) - 1 == 6000
    assert got == {(i % 1500 or None, f"h{i // 1500}"): (2, i + 2.0, i + 1.5, None, 0.5, START + timedelta(minutes=2)) for i in range(6000)}
    assert updated < 6000  # four a series, when each had a state of its own


class Held:
    """State of one grouping key in a dict."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        held = self.states.setdefault(name, {})
        calls = {"getValue": held.get, "updateValue": held.__setitem__, "removeKey": held.pop, "clear": held.clear, "keys": lambda: list(held)}
        return SimpleNamespace(**calls)

    def getValueState(self, name, *_):
        held = self.states.setdefault(name, {})
        return SimpleNamespace(exists=lambda: bool(held), get=lambda: held[0], update=lambda x: held.update({0: x}))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("rows_at_once", [1, 50, 10_000])
def test_history_releases_in_parts(rows_at_once):
    """Any number of rows read at once gives the same facts: one row per series and release, of complete slots only."""
    rng = np.random.default_rng(8)
    n, minute = 400, 60_000_000
    frame = pd.DataFrame({"bucket": 0, "k0": rng.choice(["a", "b", None], n), "tie": np.arange(n), "value": rng.integers(0, 50, n).astype(float)})
    frame["block"] = frame["k0"].eq("a").astype(int)
    frame[stateful.TIME] = rng.integers(0, 100, n) * minute
    frame.loc[frame["k0"].eq("b") & (frame[stateful.TIME] < 50 * minute), stateful.TIME] += 50 * minute  # b has rows in the second half only
    processor, handle = stateful.HistoryProcessor(["k0"], 600, 30, 12), Held()
    processor.ROWS = rows_at_once
    processor.init(handle)
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert not list(processor.handleInputRows((0,), iter([frame[:150].copy(), frame[150:].copy()]), clock(0)))
    mark = 0
    for until in (30, 60, 65, 10_000):
        mark = until * 60_000
        due = [x for x in handle.timers if x <= mark]
        out = []
        if due:
            handle.timers -= set(due)
            out = [r for f in processor.handleExpiredTimer((0,), clock(mark), None) for r in f.to_dict("records")]
        complete = frame[frame[stateful.TIME] < until // 10 * 10 * minute]
        new = complete[complete[stateful.TIME] >= {30: 0, 60: 30, 65: 60, 10_000: 60}[until] * minute]
        names = {None if k is None else k for k in new["k0"]}
        assert {r["k0"] for r in out} == names and len(out) == len(names)
        for r in out:
            own = complete[complete["k0"].isna() if r["k0"] is None else complete["k0"].eq(r["k0"])].sort_values([stateful.TIME, "tie"])
            values = own["value"].to_numpy()[-30:]
            assert (r["n"], r["last"], r["ma"]) == (len(values), values[-1], values[-12:].mean()) and r["std"] == pytest.approx(values[-12:].std())
            assert r["prev"] == values[-24:-12].mean() and r["until"] == pd.Timestamp(own[stateful.TIME].max(), unit="us")
    assert not handle.timers and not handle.states["pending"]
    late = frame[:1].copy()
    assert [x["late"].tolist() for x in processor.handleInputRows((0,), iter([late]), clock(mark))] == [[True]]
