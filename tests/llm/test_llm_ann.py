import numpy as np
import pytest

from metriloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def answers(df, k=20, shard_vectors=300, queries="vec_id % 20 = 0"):
    index = ann.build_index(df, k=k, shard_vectors=shard_vectors)
    out = {}
    for r in ann.search(index, df.where(queries), k=k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def brute(ids, vectors, query, k=20):
    own = ids.index(query)
    scores = vectors @ vectors[own]
    order = [i for i in np.lexsort((ids, -scores)) if i != own][:k]
    return [(n + 1, ids[i], scores[i]) for n, i in enumerate(order)]


@pytest.mark.parametrize("shard_vectors", [200, 5000])
def test_recall_against_brute_force(spark, shard_vectors):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 24))
    v = (centres[rng.integers(25, size=1500)] + 0.6 * rng.normal(size=(1500, 24))).astype(np.float32)
    v *= rng.uniform(0.3, 2, size=(1500, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)], SCHEMA + ", score int").repartition(4)
    got = answers(df, shard_vectors=shard_vectors)
    hit = total = 0
    exact = v.astype(np.float64)
    for q, rows in got.items():
        want = brute(list(range(1500)), exact, q)
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert all(abs(s - exact[i] @ exact[q]) < 1e-9 for _, i, s in rows)
        hit += len({r[1] for r in rows} & {w[1] for w in want})
        total += 20
    assert len(got) == 75 and hit / total >= 0.95


def test_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [2.0, 0.0]), (201, None), (202, []), (220, [0.0, 0.0]), (240, [nan, 1.0]), (260, [inf, 1.0]), (280, [None, 1.0]), (300, [1.0, 2.0, 3.0]), (301, [1.0, 2.0, 3.0])]
    got = answers(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert set(got) == {0, 20, 40, 60, 80, 200, 300}
    for q in (0, 20, 80):
        assert [r[1] for r in got[q]] == [200, *[i for i in range(100) if i != q][:19]]
    assert [r[1] for r in got[200]] == list(range(20))
    assert got[300] == [(1, 301, 14.0)]


def test_repeated_ids_and_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [0.5, 0.0])], SCHEMA)
    index = ann.build_index(df)
    assert {r["vec_id"] for r in ann.search(index, df.where("vec_id = 1")).collect()} == {0}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert answers(df) == {}


def test_graph_survives_its_bytes():
    v = np.random.default_rng(3).normal(size=(700, 8)).astype(np.float32)
    graph = ann.Graph.build(v)
    again = ann.Graph.from_bytes(graph.to_bytes())
    a, b = graph.search(v[:50], 10), again.search(v[:50], 10)
    assert np.array_equal(a[0], b[0]) and (a[0][:, 0] == np.arange(50)).mean() > 0.98
    assert len(graph.levels) > 1


def test_equal_products_of_different_vectors_go_to_the_smaller_ids(spark):
    """Vectors (1, y) all have product 1 with (1, 0)."""
    rows = [(i, [1.0, float(i % 31) - 15 + i / 100]) for i in range(1, 61)] + [(0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = ann.search(ann.build_index(df), df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == list(range(1, 21)) and {r["score"] for r in out} == {1.0}
