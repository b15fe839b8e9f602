import hashlib
import random
import re

import xxhash
from corpora import SCHEMA, awkward, prose
from pyspark.sql import functions as F

from metriloom.llm import order_minhash as omh

MASK = (1 << 64) - 1


def signed(x):
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def hash_text(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64(p.encode(), seed=h).intdigest()
    return h


def hash_longs(*values):
    h = 42
    for v, size in values:
        h = xxhash.xxh64((v & ((1 << 8 * size) - 1)).to_bytes(size, "little"), seed=h).intdigest()
    return h


def brute(text, k=omh.GRAM, least=omh.LEAST, orders=omh.ORDERS):
    text = re.sub(r"([^ \n]{16})(?=[^ \n])", "\\1 \x01", text)
    words = ["\x02", *text.replace("\n", " ").split(" "), "\x03"]
    low = omh.LOW
    count, found = {}, []
    for i in range(len(words) - k + 1):
        h = signed(hash_text(words[i : i + k])) & ~low
        n = count.get(h, 0)
        count[h] = n + 1
        if n:
            h = signed(hash_longs((h, 8), (n, 4))) & ~low
        found.append((h, i + 1))
    found.sort()
    out = []
    for i in range(orders):
        point = ((i * ((1 << 64) // orders)) & ~low) - (1 << 63)
        after = [f for f in found if f[0] >= point] + [f for f in found if f[0] < point]
        chosen = [after[j % len(after)] for j in range(least)]
        ordered = [h >> omh.POSITION_BITS for h, _ in sorted(chosen, key=lambda c: (c[1], c[0]))]
        out.append(hash_longs(*[(h, 8) for h in ordered]) >> 32)
    return out


def test_signature_against_brute_force(spark):
    texts = [t for _, t in awkward()] + prose(25) + ["a a a a a a", "x y x y x y x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: [v for v in r["signature"]] for r in omh.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t or ""), t


def test_order_matters_and_edits_lower_the_likeness(spark):
    base = prose(1, low=300, high=301)[0]
    words = base.split(" ")
    half = len(words) // 2
    texts = {"same": base, "edit": " ".join([*words[:150], "zzz", *words[151:]]), "moved": " ".join(words[half:] + words[:half]), "other": prose(1, seed=99, low=300, high=301)[0]}
    df = spark.createDataFrame([(0, base, n, t) for n, t in texts.items()], "id long, a string, name string, b string")
    got = {r["name"]: r["l"] for r in df.select("name", omh.likeness(omh.signature(F.col("a")), omh.signature(F.col("b"))).alias("l")).collect()}
    assert got["same"] == 1.0 and 1.0 > got["edit"] > 0.8 and got["edit"] > got["moved"] > got["other"] and got["other"] < 0.05


def neighbours(rows):
    """(doc_id, edited text) with the next row by descending id, the first after the last."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = []
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        out.append((i, t, t[: len(t) - n] + nxt[:n]))
    return out


def test_edited_neighbours(spark):
    rows = [(i * 3 - 50, t) for i, t in enumerate(prose(90))] + [(1000, None), (1001, ""), (1003, "short é"), (-(10**15), "far below")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", _bucket int").repartition(4)
    for partitions in (1, 2, 7, 60):
        got = {r["doc_id"]: r for r in omh.edited_neighbours(df, partitions=partitions).collect()}
        assert len(got) == len(rows)
        for i, t, e in neighbours(rows):
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    ordered = sorted(got, reverse=True)
    for a, b in zip(ordered, ordered[1:] + ordered[:1]):
        same = sum(x == y for x, y in zip(got[a]["signature"], got[b]["signature"]))
        assert got[a]["near_next"] == same / omh.ORDERS
        assert 0 <= got[a]["near_edited"] <= 1


def test_repeated_ids_single_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "one two three"), (5, "one two three"), (None, "four five six")], SCHEMA)
    assert df.count() == omh.edited_neighbours(df).count()
    one = omh.edited_neighbours(spark.createDataFrame([(1, "abcdef")], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert omh.edited_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "a b c")], SCHEMA)
    omh.edited_neighbours(df).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_without_blanks_are_like_their_edits(spark):
    """Two thirds of an unbroken text stay, in letters and in a script without blanks; other texts are unlike."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefgh", 300), ("天地玄黄宇宙洪荒日月盈昃辰宿列张", 420), ("xyzuvw😀", 2_000))]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in omh.edited_neighbours(df).collect():
        assert 0.2 < r["near_edited"] < 1.0 and r["near_next"] < 0.05, r


def test_very_long_text(spark):
    text = " ".join(f"w{i % 9_973}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + " end")], SCHEMA)
    first = {r["doc_id"]: r["near_next"] for r in omh.edited_neighbours(df).collect()}
    assert first[2] > 0.9
