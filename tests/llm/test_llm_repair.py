"""Conversation repair against a plain search over whole audits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from metriloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = " \t\n\x0b\f\r"


def plain_audit(rows):
    """Cheapest (cost, audit, repaired lines) of (role, text, fault) by a search over (cost, audit)."""
    heap, seen = [(0, "", 0, "")], set()
    lines = {(0, "", ""): []}
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        state = out[-1:] if len(out) != 1 or out != "s" else "s"
        if (i, state) in seen:
            continue
        seen.add((i, state))
        had = lines[cost, audit, state]
        if i == len(rows) and (not out or state == "a"):
            return cost, audit, had

        def push(letter, more, j, to, line):
            if (j, to) not in seen:
                entry = (cost + more, audit + letter, j, to)
                lines.setdefault((entry[0], entry[1], to), [*had, *line])
                heapq.heappush(heap, entry)

        want = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        push("I", 3, i, want, [f"{name}:"])
        if i < len(rows):
            role, text, fault = rows[i]
            push("D", 4, i + 1, state, [])
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] == want or (role[:1] == "s" and not out):
                    push("K", more, i + 1, role[:1], [f"{role}:{text}"])
                push("R", 3 + more, i + 1, want, [f"{name}:{text}"])
    raise AssertionError


def plain_repair(table):
    found = {}
    for c, turn, role, text, *_ in table:
        found.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for c, rows in found.items():
        after = []
        for turn, role, text in rows:
            x = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            said = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            for copy in range({0: 0, 3: 2}.get(x, 1)):
                order = (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), copy)
                after.append((order, "user" if x == 4 else role, said))
        after.sort(key=lambda r: r[0])
        seen, marked = set(), []
        for _, role, text in after:
            rest = text.rstrip(SPACE)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[0][1] for r in after if r[0][0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [r[2] for r in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = plain_audit(marked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def awkward():
    rng = random.Random(9)
    texts = ["Fine.", "Yes!", "Why?\n ", "cut off", "", " \t", None, "é。", "Same.", "x" * 30_000 + ".", "...", "a.b"]
    roles = ["user", "assistant", "system", "tool", "", None, "uncle"]
    rows = []
    for c in [*range(-3, 120), 10**15]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, rng.choice([t, t, t, t + 3, 0, None]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts), "x"))
        rows += [rows[-1]] * rng.choice([0, 0, 0, 2])
    for c in (500, 501):  # long: several chunks in the small-chunk runs
        rows += [(c, t, rng.choice(roles[:4]), rng.choice([f"Text {t}.", f"Text {t // 3}", "", "Same."]), "x") for t in range(150)]
    rows += [(600, t, "user", "Same.", "x") for t in range(60)] + [(None, t, "user", f"N{t}.", "x") for t in range(4)] + [(601, 5, None, None, None)]
    rng.shuffle(rows)
    return rows


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


@pytest.mark.parametrize("chunk", [1_024, 16, 1])
def test_equals_plain_search(spark, chunk):
    rows = awkward()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain_repair(rows)
    assert any(r[7] and "D" in r[7] and "I" in r[7] and "R" in r[7] for r in want) and any(not r[7] for r in want)
    assert got(repair.repair(frame, chunk=chunk)) == want


def test_search_equals_plain_search():
    """Many short lattices, from every state to the accepting end and between states."""
    rng = random.Random(2)
    for _ in range(1_500):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "x", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(1, 9))]
        codes = [("", "blank", "duplicate", "truncated").index(f) for _, _, f in rows]
        cost, audit = repair.Lattice([r[0][0] for r in rows], codes, True).solve(0, None)
        assert (cost, audit) == plain_audit(rows)[:2]


def test_nothing_left_after_damage(spark):
    turn = next(t for t in range(1_000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(7, turn, "user", "Hi.", None)], SCHEMA)
    assert got(repair.repair(frame)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
