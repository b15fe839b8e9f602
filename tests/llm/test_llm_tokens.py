import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from corpora import SCHEMA, awkward, prose

from metriloom.llm import tokens

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = tokens.read_ranks(PATH)
ENCODING = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(cache, text):
    return np.frombuffer(cache.ids(text), "<u4").tolist()


def test_random_strings_match_the_library():
    cache, rng = tokens.chunk_encoder(RANKS, P.PATTERN), random.Random(1)
    letters = "ab  \n\t é　\x1c\x85!?'s12日本😀 the"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert ids_of(cache, text) == ENCODING.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "日" * 4_000, "=" * 3_000, " " * 5_000, "\n " * 2_000])
def test_long_matches(text):
    assert ids_of(tokens.chunk_encoder(RANKS, P.PATTERN), text) == ENCODING.encode_ordinary(text)


def test_leftmost_pair_first_and_ties():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaaa": 258}
    assert tokens.encode_match(b"aaaaa", ranks, 4) == [258, 97]
    assert tokens.encode_match(b"aab", ranks, 4) == [256, 98]


def test_small_cache_gives_the_same(monkeypatch):
    texts = prose(20)
    want = [ENCODING.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 7)
    cache = tokens.chunk_encoder(RANKS, P.PATTERN)
    assert [ids_of(cache, t) for t in texts] == want
    assert len(cache) <= 7 and len(cache.older) <= 7


def test_round_trip(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(prose(30))]
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], SCHEMA + ", ids string, decoded array<int>").repartition(3)
    out = tokens.decode(tokens.encode(df, PATH, P.PATTERN), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == ENCODING.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table_and_null_ids(spark):
    assert tokens.encode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in tokens.decode(df, PATH).collect()}
    word = {i: w for w, i in RANKS.items()}
    assert got == {1: b"", 2: b"", 3: word[0] + word[1]}
