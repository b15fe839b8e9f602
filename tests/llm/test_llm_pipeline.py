"""The pipeline against brute force, stage by stage, on a small corpus with every awkward case."""

import random

import pytest
from corpora import awkward, prose
from test_llm_packing import check
from test_llm_simhash import near, plain_fingerprint, roots
from test_llm_suffix import brute

import corpus_pipeline
from metriloom.llm import toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = prose(150, seed=20, low=30, high=200)
    shared = " ".join(prose(1, seed=21, low=120, high=121))
    rows, labels = [(i, t) for i, t in awkward()], []
    for n, t in enumerate(texts):
        i = 100 + n
        if n % 6 == 0:
            t = t + "".join(f" {rng.choice(['nastyword', 'vileness'])} {w}" for w in t.split(" ")[:12])
        elif n % 10 == 1:
            t = t + " " + shared + " tail " + str(n)
        rows.append((i, t))
        labels.append((i, int(n % 6 == 0)))
    rows += [(1000 + n, texts[n]) for n in range(20, 40)] + [(1100 + n, texts[n] + " end") for n in range(40, 60)]
    path = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, "en", "s", len(t or ""), "own", 2.0) for i, t in rows]
    spark.createDataFrame(full, DOCUMENTS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before = docs.collect()

    def step(frame, n):
        out = corpus_pipeline.STAGES[n][1](spark, frame, folder)
        path = f"{folder}/stage{n}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    clean = step(docs, 0)
    kept = clean.collect()
    assert clean.columns == columns and {r["score"] for r in kept} == {2.0}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in kept}
    assert gone == {i for i, x in labels.items() if x}

    single = step(clean, 1)
    rows = [(r["doc_id"], r["text"]) for r in kept]
    root = roots(len(rows), near([plain_fingerprint(t) for _, t in rows]))
    want = sorted({min(rows[i][0] for i in range(len(rows)) if root[i] == x) for x in root})
    assert sorted(r["doc_id"] for r in single.collect()) == want and single.columns == columns

    cut = step(single, 2)
    given = {r["doc_id"]: r for r in single.collect()}
    results = dict(zip(given, brute([r["text"] for r in given.values()])))
    assert any(w[1] for w in results.values())
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and set(got) == {i for i, w in results.items() if w[1] == 0 or w[1] < w[0]}
    for i, r in got.items():
        _, removed, _, rest = results[i]
        if not removed:
            assert r["text"] == given[i]["text"]
        else:  # characters stay whole, so at most three bytes more are left at each end of a run
            assert len(rest) <= len(r["text"].encode()) <= len(rest) + 6 * results[i][2] and r["n_chars"] == len(r["text"])
        assert r["kept"] == "own"

    packed = corpus_pipeline.STAGES[3][1](spark, cut, folder).collect()
    assert {r["doc_id"] for r in packed} == set(got)
    check(packed, {i: r["text"] for i, r in got.items()})


def test_run_gives_the_rows_of_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder + "/")
    key = ("doc_id", "start", "length", "doc_tokens")
    assert sorted(tuple(r[k] for k in key) for r in out.collect()) == sorted(tuple(r[k] for k in key) for r in again.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix", "packing"]


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_corpus_keeps_everything(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, index).where("predicted = 0").count() == 2
