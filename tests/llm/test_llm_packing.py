import itertools
import json
import random

import numpy as np
import public_tokenizers as P
from corpora import SCHEMA, awkward, prose
from tokenizers import Tokenizer

from metriloom.llm import packing

PATH = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def cost(cuts, penalties, window):
    total, at = 0, 0
    for c in cuts:
        n = c - at
        if n > window:
            return None
        total += (0 if n & (n - 1) == 0 else window - n) + penalties[c]
        at = c
    return total


def test_cheapest_cuts_against_all_choices():
    rng = random.Random(4)
    for _ in range(60):
        points = sorted(rng.sample(range(1, 30), 7))
        points += [points[-1] + rng.randrange(1, 5)]
        if max(b - a for a, b in itertools.pairwise([0, *points])) > 16:
            continue
        penalties = {p: rng.choice([0, 1, 3]) for p in points}
        got = packing.best_cuts(points, [penalties[p] for p in points], 16)
        options = [
            cost([*c, points[-1]], penalties, 16) for n in range(len(points)) for c in itertools.combinations(points[:-1], n)
        ]
        assert cost(got, penalties, 16) == min(o for o in options if o is not None)


def test_long_stretches_get_cuts():
    ids, ends = np.ones(5000, dtype=np.uint32), np.array([5000])
    points, penalties = packing.allowed_cuts(ids, ends, np.zeros(10, dtype=bool))
    assert points[-1] == 5000 and penalties[-1] == 0
    assert max(b - a for a, b in itertools.pairwise([0, *points])) <= packing.FREE_RUN


def check(rows, docs, window=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        ids = TOKENIZER.encode(docs[key] or "", add_special_tokens=False).ids + [0]
        assert [i for r in pieces for i in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
        assert all(r["doc_tokens"] == len(ids) for r in pieces)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()] and n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding / sum(r["length"] for r in rows)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    rows = [r for r in dict(awkward()).items()] + [(100 + i, t) for i, t in enumerate(prose(150))]
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", start int").repartition(3)
    out = packing.pack(df, PATH).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    assert check(out, dict(rows)) < 0.2  # three short shards in small blocks


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three")], SCHEMA).coalesce(1)
    out = packing.pack(df, PATH).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 2 * (len(TOKENIZER.encode("one two").ids) + 1)
    assert any(r["doc_id"] is None for r in out)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_ranks_equal_the_tokenizer():
    with open(PATH, encoding="utf-8") as f:
        definition = f.read()
    assert packing.byte_ranks(json.loads(definition)) is not None
    _, _, cache, _ = packing._tools(definition)
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab  \n\té　\x1c!?'s12日😀 the") for _ in range(rng.randrange(40)))
        assert np.frombuffer(cache.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    changed = json.loads(definition)
    changed["model"]["merges"][0], changed["model"]["merges"][1] = changed["model"]["merges"][1], changed["model"]["merges"][0]
    assert packing.byte_ranks(changed) is None
