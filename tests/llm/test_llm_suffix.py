import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpora import SCHEMA, awkward, prose
from pyspark.sql import functions as F

from metriloom.llm import suffix
from metriloom.llm.frames import forget_kept, kept_by_worker

LENGTH = 400


def brute(texts, length=LENGTH):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, dtype=bool)
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone[1:-1]])))
    return out


def corpus():
    rng = random.Random(8)
    passages = prose(6, seed=9, low=90, high=160)
    out = []
    for t in prose(90, seed=10):
        if rng.random() < 0.5:
            t += rng.choice(passages)[rng.randrange(0, 90) :] + " ".join(prose(1, seed=rng.randrange(10**6), low=20, high=60))
        if rng.random() < 0.1:
            t += "x" * rng.randrange(300, 900)
        if rng.random() < 0.1:
            t += "one line of text again and again\n" * rng.randrange(10, 40)
        out.append(t)
    return out + [out[3]] * 3 + [out[9][:-5] + "zz" + out[9][-3:]] * 2 + ["y" * 401, "é" * 300]


def removed(df, **options):
    rows = suffix.remove_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows)


@pytest.mark.parametrize("split", [suffix.SPLIT_SEGMENTS, 3])
def test_against_brute_force(spark, split):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(corpus())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert removed(df, split=split) == sorted((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 5_000)
    monkeypatch.setattr(suffix, "TEXT_BLOCK", 1_000)
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert removed(df) == sorted((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))


def test_suffix_array_is_sorted_to_the_depth():
    rng = np.random.default_rng(2)
    for data in (rng.integers(97, 99, 3000).astype(np.uint8), np.full(500, 7, np.uint8), np.tile(rng.integers(0, 256, 700).astype(np.uint8), 4)):
        order = suffix.suffix_array(data, 64)
        assert sorted(order) == list(range(len(data)))
        heads = [bytes(data[i : i + 64]) for i in order]
        assert heads == sorted(heads)


def test_classes_name_equal_windows():
    pieces = [t.encode() for t in corpus() if len(t.encode()) >= LENGTH]
    segment, inside, names = suffix.repeated_starts(pieces)
    texts = {}
    for s, i, n in zip(segment, inside, names):
        texts.setdefault(int(n), set()).add(pieces[s][i : i + LENGTH])
    assert all(len(v) == 1 for v in texts.values())
    assert len(texts) == len({w for v in texts.values() for w in v})


def test_equal_windows_have_equal_anchors():
    seen = {}
    for t in corpus():
        data = t.encode()
        anchors, first, last = suffix.segments(np.frombuffer(data, np.uint8))
        assert sum(last - first + 1) == max(0, len(data) - LENGTH + 1)
        for a, x, y in zip(anchors, first, last):
            for i in range(x, y + 1):
                assert seen.setdefault(data[i : i + LENGTH], a) == a


def test_whole_characters():
    data = "aé".encode() * 3 + b"zz"
    assert suffix.cut_runs(data, [(2, 2)], 4) == (data[:2] + data[6:], 4, 1)
    kept, n, spans = suffix.cut_runs(data, [(2, 2)], 4, whole_characters=True)
    assert kept.decode() == "aéaézz" and (n, spans) == (3, 1)


def test_clashing_columns_null_ids_and_empty_table(spark):
    t = corpus()[3]
    df = spark.createDataFrame([(None, t, "k", 1), (None, t, "l", 2), (7, None, "m", 3)], SCHEMA + ", kept string, _k1 int")
    out = suffix.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"]
    n = len(t.encode())
    assert sorted((r["n_bytes"], r["n_removed"]) for r in out.collect()) == [(0, 0), (n, n), (n, n)]
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).agg(F.count("*")).first()[0] == 0


def test_classes_over_several_arrays_name_equal_windows():
    pieces = [t.encode() for t in corpus() if len(t.encode()) >= LENGTH]
    segment, inside, names = suffix.window_classes(pieces, LENGTH, 5_000)
    assert sum(map(len, pieces)) > 50_000  # many arrays
    texts = {}
    for s, i, n in zip(segment.tolist(), inside.tolist(), names.tolist()):
        texts.setdefault(n, set()).add(pieces[s][i : i + LENGTH])
    assert len(segment) == sum(len(p) - LENGTH + 1 for p in pieces)
    assert all(len(v) == 1 for v in texts.values())
    assert len(texts) == len({w for v in texts.values() for w in v})


class Batches:
    """Stands for a table: gives the function that tasks would run."""

    def mapInArrow(self, run, schema):
        return run


def test_memory_of_an_anchor_with_many_segments():
    rng = np.random.default_rng(5)
    rows = np.tile(rng.integers(97, 123, 560, dtype=np.uint8), (5_000, 1))
    rows[np.arange(len(rows)), rng.integers(0, 560, len(rows))] = rng.integers(0, 97, len(rows))
    pieces = [r.tobytes() for r in rows]
    n = len(pieces)
    long, short = np.zeros(n, np.int64), np.zeros(n, np.int32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(long), pa.array(long), pa.array(long + 1), pa.array(long > 0), pa.array(np.arange(n)), pa.array(long), pa.array(short), pa.array(pieces, pa.binary())],
        names=["anchor", "shard", "shards", "known", "_k1", "_k2", "first", "piece"],
    )
    run = suffix._solve(Batches(), LENGTH)
    tracemalloc.start()
    out = pa.Table.from_batches(run(iter([batch]))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    segment, inside, names = suffix.repeated_starts(pieces)
    many = np.bincount(names)[names] > 1
    want = zip(*(x.tolist() for x in suffix._runs(segment[many], inside[many])))
    assert set(out["kind"]) == {0} and sorted(zip(out["_k1"], out["first"], out["last"])) == sorted(want)
    assert peak < 50 * sum(map(len, pieces))


def test_kept_objects_are_given_up():
    made = []
    kept_by_worker("one", lambda: made.append(1))
    kept_by_worker("one", lambda: made.append(1))
    forget_kept()
    forget_kept()
    kept_by_worker("one", lambda: made.append(1))
    forget_kept()
    assert len(made) == 2
