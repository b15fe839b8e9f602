import random
import zlib

import numpy as np
import pytest
from corpora import SCHEMA, awkward, prose
from pyspark.sql import functions as F

from metriloom.llm import toxicity

LABELS = "doc_id long, toxic int"


def corpus(n=300):
    rng = random.Random(6)
    rows, labels = [], []
    for i, t in enumerate(prose(n, seed=12, low=20, high=80)):
        toxic = i % 5 == 0
        if toxic:
            w = t.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "vileness", "Vilest", "nasty"]))
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    learnt = spark.createDataFrame(labels + [(5, None), (None, 1), (99_999, 1), (0, 0)], LABELS).where("doc_id IS NULL OR doc_id % 4 <> 0")
    return rows, labels, docs, toxicity.fit(docs, learnt)


def test_held_out_accuracy_and_evidence(fitted):
    rows, labels, docs, index = fitted
    out = {r["doc_id"]: r for r in toxicity.score(docs.withColumn("score", F.lit("old")), index).collect()}
    truth = dict(labels)
    held = [i for i, _ in rows if i % 4 == 0]
    good = sum(out[i]["predicted"] == truth[i] for i in held) / len(held)
    assert good > 0.97 and all(0 <= r["score"] <= 1 for r in out.values())
    toxic = next(out[i] for i in held if truth[i])
    assert toxic["neighbours"] and all(n % 4 for n in toxic["neighbours"])
    assert len(toxic["cosines"]) == len(toxic["neighbours"]) and toxic["cosines"] == sorted(toxic["cosines"], reverse=True)


def test_block_reading_finds_the_exact_neighbours(fitted, monkeypatch):
    rows, _, _, index = fitted
    dense = np.zeros((len(index.toxic), len(index.terms)))
    for t in range(len(index.terms)):
        part = slice(index.starts[t], index.starts[t + 1])
        dense[index.examples[part], t] = index.weights[part]
    assert np.allclose((dense**2).sum(axis=1), 1)
    for k in (1, 5, 25):
        index.k = k
        for _, text in rows[::7]:
            at, w = index.vector(toxicity.word_counts(text), {})
            if not len(at):
                continue
            cosine = dense[:, at] @ w
            want = [i for i in np.lexsort((np.arange(len(cosine)), -cosine.round(12))) if cosine[i] > 0][:k]
            got, values = index.nearest(at, w)
            assert np.allclose(values, cosine[want]) and len(got) == len(want)
    index.k = toxicity.NEIGHBOURS


def test_block_bounds_hold(fitted):
    index = fitted[3]
    for t in range(len(index.terms)):
        part = slice(index.starts[t], index.starts[t + 1])
        for e, w in zip(index.examples[part], index.weights[part]):
            assert index.block_max[t, e // toxicity.BLOCK] >= w


def test_awkward_texts(spark, fitted):
    index = fitted[3]
    df = spark.createDataFrame(awkward() + [(20, "nasty " * 50_000)], SCHEMA).repartition(3)
    out = toxicity.score(df, index).collect()
    assert len(out) == len(awkward()) + 1
    assert {r["score"] for r in out if r["text"] in (None, "")} == {index.blank} and index.blank < 0.5
    assert next(r["predicted"] for r in out if r["doc_id"] == 20) == 1


def test_without_examples_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], SCHEMA)
    for labels, want in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        index = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
        assert {r["score"] for r in toxicity.score(docs, index).collect()} == {want}
    empty = spark.createDataFrame([], SCHEMA)
    index = toxicity.fit(empty, spark.createDataFrame([(1, 1), (2, 0)], LABELS))
    assert toxicity.score(empty, index).count() == 0


def test_held_out_rows(spark):
    got = spark.range(100).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
