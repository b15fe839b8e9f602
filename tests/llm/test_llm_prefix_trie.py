"""The prefix trie against brute force over prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from metriloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def md5(said):
    return hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()


def plain_turns(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, md5((role or "", text or "")), (role or "", text or "")))
    return {c: tuple(x[-1] for x in sorted(v)) for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, ())[:h] + own[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    saved = {p: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, m in members.items()}
    children, leaves, total = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            total[p[:d]] += saved[p]
    rows = []
    for p, m in members.items():
        own = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], total[p], hashlib.sha256(own.encode()).hexdigest()))
    return sorted(rows, key=str)


def awkward():
    rng = random.Random(5)
    said = [(r, t) for r in ("user", "assistant", "system", None, "") for t in ("a b", "a  b c\x0bd", "", None, "é ü", "x" * 50_000, "one word")]
    rows = []
    for c in [*range(-25, 45), 10**12, 10**12 + 7]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, 0, None]), *(said[0] if rng.random() < 0.5 else rng.choice(said)), "x"))
    rows += [(c, t, "user", f"t{t // 2}", "x") for c in range(200, 212) for t in range(70 if c % 3 else 64)]  # long, alike, many bands
    rows += [(c, t, "user", "copy", "x") for c in range(300, 400) for t in range(3)]  # a hot group of copies
    rows += [(401, 0, "user", "only", "x")] * 3 + [(None, 0, "user", "no id", "x")]
    rng.shuffle(rows)
    return rows


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("band", "block"), [(32, 32_768), (4, 7), (1, 50)])
def test_equals_brute_force(spark, band, block):
    rows = awkward()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    turns = prefix_trie.with_shared_starts(prefix_trie.turns_of(frame))
    assert got(prefix_trie.nodes(turns, band, block)) == plain_nodes(rebuilt(plain_turns(rows)))


def test_without_shared_starts(spark):
    rows = awkward()
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.nodes(turns, 8, 16)) == plain_nodes(plain_turns(rows))


def test_every_conversation_turnless(spark):
    """Conversations of one turn, whose base has none, lose it where h is above 0."""
    rows = [(c, 0, "user", "x y", None) for c in range(1, 20)]
    turns = prefix_trie.with_shared_starts(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA)))
    want = plain_nodes(rebuilt(plain_turns(rows)))
    assert got(prefix_trie.nodes(turns)) == want and any(r[1] == 0 and r[7] != prefix_trie.EMPTY for r in want)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.nodes(prefix_trie.with_shared_starts(prefix_trie.turns_of(frame))).count() == 0
