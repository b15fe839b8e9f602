import re

import numpy as np
import pytest
import xxhash
from corpora import SCHEMA, awkward, prose

from metriloom.llm import components, simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(values):
    a = np.array(values, dtype=np.uint64)
    return [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)]


def cloud(seed=0, centres=150, n=1500):
    rng = np.random.default_rng(seed)
    found = [int(x) for x in rng.integers(0, 2**63, size=centres, dtype=np.uint64)]
    for _ in range(n):
        x = found[rng.integers(len(found))]
        for _ in range(rng.integers(1, 5)):
            x ^= 1 << int(rng.integers(64))
        found.append(x)
    return sorted(set(found))


def signed(values):
    return [(int(v),) for v in np.array(values, dtype=np.uint64).view(np.int64)]


@pytest.mark.parametrize("text", [t for _, t in awkward()] + ["A b", "a B c", "AÄ Éa b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_fingerprint_of_a_very_long_text():
    text = " ".join(str(i * i % 9973) for i in range(100_050))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("shard_rows,blocks", [(4096, None), (20, None), (4096, 5), (15, 6)])
def test_links_connect_what_brute_force_connects(spark, shard_rows, blocks):
    values = cloud()
    place = {v: i for i, v in enumerate(values)}
    edges = simhash.links(spark.createDataFrame(signed(values), "fp long"), 3, shard_rows, blocks).collect()
    got = roots(len(values), [(place[r["a"] % 2**64], place[r["b"] % 2**64]) for r in edges])
    assert got == roots(len(values), near(values))


def test_one_large_group_gives_few_rows(spark):
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a + 1, 64)} | {base})
    edges = simhash.links(spark.createDataFrame(signed(values), "fp long"), 3, 300).collect()
    place = {v: i for i, v in enumerate(values)}
    assert set(roots(len(values), [(place[r["a"] % 2**64], place[r["b"] % 2**64]) for r in edges])) == {0}
    assert len(edges) < 60 * len(values)


def test_block_choices_cover_every_pair():
    for blocks in (4, 5, 6):
        masks = [m % 2**64 for m in simhash.masks(3, blocks)]
        for bits in [(0, 1, 2), (0, 20, 40), (15, 16, 63), (10, 30, 50)]:
            difference = sum(1 << b for b in bits)
            assert any(not m & difference for m in masks)
    assert simhash.block_count(1000, 3) == 4 and simhash.block_count(10**12, 3) == 6


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (101, 100), (None, 5)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    texts = prose(60, low=40)
    rows = awkward() + [(100 + i, t) for i, t in enumerate(texts)] + [(300 + i, t + " more") for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", simhash int").repartition(4)
    got = sorted((r["doc_id"], r["simhash"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    ids, prints = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    root = roots(len(rows), near(prints))
    smallest = {x: min(ids[i] for i in range(len(rows)) if root[i] == x) for x in root}
    assert got == sorted((ids[i], prints[i], smallest[root[i]]) for i in range(len(rows)))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(smallest.values()))


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "only null here one two"), (None, "only null here one two"), (None, "a b c d"), (5, "a b c d")], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 0), (0, 5), (5, 5)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_of_null_and_repeated_ids(spark):
    texts = prose(6, seed=40, low=40, high=60)
    rows = [
        (None, texts[0], 1), (None, texts[1], 2), (None, texts[1], 2), (None, texts[2], 3), (4, texts[2], 4),
        (7, texts[3], 5), (7, texts[4], 6), (7, texts[4], 6), (9, texts[4], 7), (8, texts[5], 9), (8, texts[5], 8), (None, None, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", mark int")
    want = {(None, texts[0], 1), (None, texts[1], 2), (4, texts[2], 4), (7, texts[3], 5), (7, texts[4], 6), (None, None, 1)}
    runs = [simhash.keep_one(df.repartition(n)).collect() for n in (1, 5)]
    for run in runs:
        got = {tuple(r) for r in run}
        assert {r for r in got if r[0] != 8} == want and len(run) == len(want) + 1
    assert {tuple(r) for r in runs[0]} == {tuple(r) for r in runs[1]}
