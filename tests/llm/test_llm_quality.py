"""Positive-unlabelled quality: sums against a dense product, prior and accuracy on planted classes."""

import random
import zlib

import numpy as np
import pytest
from corpora import SCHEMA, awkward, prose

from metriloom.llm import quality


def planted(n: int, bad_share: float, seed: int = 4):
    """(doc_id, text, is good): prose, and the same spoilt in one of three ways."""
    rng = random.Random(seed)
    rows = []
    for i, t in enumerate(prose(n, seed=seed, low=30, high=120)):
        bad = rng.random() < bad_share
        if bad:
            t = rng.choice([t.upper, lambda t=t: " ".join(w + "###" for w in t.split()), lambda t=t: (t.split()[0] + " ") * 40])()
        rows.append((i, t, not bad))
    return rows


def bare_fit(bins, positive, prior, ridge, edges, passes):
    """The same descent over dense sums, without Spark."""
    x = np.zeros((len(bins), sum(len(e) + 1 for e in edges) + 1))
    x[np.arange(len(bins))[:, None], bins] = 1
    x[:, -1] = 1
    u, p = x.mean(axis=0), x[positive].mean(axis=0)
    scale = 0.25 * (len(edges) + 1) * u + ridge

    def look(w):
        z = x @ w
        s, soft = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
        up, pp = (x * s[:, None]).mean(axis=0), (x[positive] * s[positive, None]).mean(axis=0)
        negatives = soft.mean() - prior * soft[positive].mean()
        value = prior * np.logaddexp(0, -z[positive]).mean() + max(0, negatives) + ridge / 2 * (w @ w)
        rise = up - prior * pp
        return value, rise + prior * (pp - p) + ridge * w, quality.CORRECTION * rise / scale if negatives < 0 else None

    return quality._descend(look, np.zeros(x.shape[1]), scale, passes), look


@pytest.fixture(scope="module")
def corpus(spark):
    rows = planted(900, 0.3)
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA).repartition(4)
    return rows, quality.featured(docs).drop("text").persist()


def test_fit_equals_dense_descent(spark, corpus):
    rows, frame = corpus
    labels = spark.createDataFrame([(i, int(good)) for i, _, good in rows if i % 3 == 0], "doc_id long, quality int")
    model = quality.fit(frame, labels, prior=0.7)
    data = frame.toPandas()
    bins = model.bins(np.stack(data["features"].to_numpy()))
    positive = np.array([i % 3 == 0 and rows[i][2] for i in data["doc_id"]])
    dense, look = bare_fit(bins, positive, 0.7, float(np.clip(0.1 / positive.sum(), *quality.RIDGE)), model.edges, quality.PASSES)
    assert np.allclose(model.weights, dense, atol=1e-5)
    assert look(model.weights)[0] < look(np.zeros_like(dense))[0] / 3


def test_held_out_documents(spark, corpus):
    rows, frame = corpus
    labels = spark.createDataFrame([(i, int(good)) for i, _, good in rows], "doc_id long, quality int").where(~quality.held_out())
    model = quality.fit(frame, labels)
    assert abs(model.prior - 0.7) < 0.12
    found = {r["doc_id"]: r for r in quality.score(frame, model).collect()}
    held = [(found[i]["predicted"], good) for i, _, good in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == 1 for p, good in held if good]) >= 0.95 and np.mean([p == 0 for p, good in held if not good]) >= 0.8
    # labels of 0 are no negatives: without them the model is the same
    assert np.allclose(quality.fit(frame, labels.where("quality = 1")).weights, model.weights, atol=1e-9)


def test_negative_risk_is_corrected():
    """Few documents, more weights: the unbiased risk's negatives' part falls below 0 and is raised again."""
    rng = np.random.default_rng(1)
    edges = [np.linspace(-1, 1, 15) for _ in range(6)]
    model = quality.Model(edges, np.zeros(6 * 16 + 1), 0.5)
    bins = model.bins(rng.normal(size=(60, 6)))
    seen = []
    positive = np.arange(60) < 12
    w, look = bare_fit(bins, positive, 0.6, 1e-5, edges, 0)

    def watched(v):
        out = look(v)
        seen.append(out[2] is not None)
        return out

    best = quality._descend(watched, w, 0.25 * 7 * np.full(len(w), 1 / 16) + 1e-5, 40)
    assert any(seen) and not all(seen) and look(best)[0] < look(w)[0]


def test_awkward_rows(spark):
    rows = awkward()
    docs = spark.createDataFrame([(i, t, "kept", 9.0, 7) for i, t in rows] + [(None, "no id " * 9, "kept", 9.0, 7), (50, "x " * 200_000, "kept", 9.0, 7)], f"{SCHEMA}, features string, score double, predicted int")
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, None), (7, 0), (7, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    frame = quality.featured(docs)
    model = quality.fit(frame, labels)
    found = quality.score(frame, model).collect()
    assert len(found) == len(rows) + 2 and set(found[0].asDict()) == {"doc_id", "text", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if not r["text"]}) == 1


def test_no_positives_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    none = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    frame = quality.featured(docs)
    assert {r["score"] for r in quality.score(frame, quality.fit(frame, none)).collect()} == {0.5}
    empty = quality.featured(docs.where("doc_id > 5"))
    assert quality.score(empty, quality.fit(empty, none)).count() == 0


def test_features_of_plain_texts():
    at = {f: i for i, f in enumerate(quality.FEATURES)}
    x = quality.describe("AB cd!\nAB cd!")
    assert x[at["upper"]] == 4 / 13 and x[at["newline"]] == 1 / 13 and x[at["distinct_words"]] == 0.5 and x[at["distinct_lines"]] == 0.5 and x[at["stopped_lines"]] == 1.0
    assert not quality.describe("").any() and quality.describe("a a a b")[at["same_neighbours"]] == 0.5
