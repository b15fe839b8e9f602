import re

from corpora import SCHEMA, awkward, prose

from metriloom.llm import licenses


def pairs(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return set(zip(w, w[1:]))


def brute(text):
    lines = (text or "").split("\n")
    best, n = (0.0, ""), 0
    for segment in lines + ([text] if len(lines) > 1 else []):
        a = pairs(segment or "")
        scores = [(2 * len(a & pairs(t)) / (len(a) + len(pairs(t))), name) for name, t in licenses.TEMPLATES.items()] if a else []
        good = [s for s in scores if s[0] >= licenses.THRESHOLD]
        n += bool(good)
        for s in good:
            if s[0] > best[0] or s[0] == best[0] and s[1] < best[1]:
                best = s
    return best[1] or None, round(best[0], 6), n


def test_against_brute_force(spark):
    t = licenses.TEMPLATES
    texts = [x for _, x in awkward()] + prose(30)
    texts += [p + "\n" + n for p, n in zip(prose(16, seed=5), t.values())] + list(t.values())
    texts += [t["MIT"].upper() + "!", t["MIT"] + " Or", "Released under MIT", t["GPL-3.0"].replace("version 3", "version 4"), "\n".join([t["MIT"], t["GPL-3.0"], t["MIT"]]), (t["MIT"] + " ") * 500]
    df = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(texts)], SCHEMA + ", license string").repartition(3)
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_segments"]) for r in licenses.scan(df).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        assert got[i] == brute(x), x


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, None)], SCHEMA)
    assert sorted(r["license"] or "" for r in licenses.scan(df).collect()) == ["", "MIT", "MIT"]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
