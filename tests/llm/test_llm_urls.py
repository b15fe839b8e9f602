import random
import re

import pytest

from metriloom.llm import urls

SCHEMA = "page_id long, url string"


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], best[0]
    return host, path, None, "block" if any(re.search(p, host + path) for _, p in urls.PATTERNS) else "allow"


GIVEN = [
    None, "", "no scheme", "http://", "http:///path", "HTTP://WWW.Example.ORG/es/a", "http://example.org/en/12", "http://example.org/en/2", "http://example.org",
    "http://example.org?x=/es/", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/FR/", "http://a.com/de/?q", "http://a.com/de", "http://com/de/x",
    "http://spam-farm.example.net/x", "http://x.net/casino/", "http://x.net/casinos/", "http://a.com:80/de/", "http://u@a.com/de/x#y", "a://b://c.com/de/", "http://é.org/é", "http://org.com/fr/x",
    "http://x.net/" + "a/" * 5000, "http://example.orgs/es/", "http://xorg/",
]


def test_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["http://", "www.", "example", ".org", ".com", "/en/", "/es/", "/de/", "/fr/", "1", "?a", "#b", "casino", "/", "xxx", "-"]
    given = GIVEN + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(300)] + GIVEN[:9]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given)], SCHEMA + ", verdict string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert len(got) == len(given)
    for i, u in enumerate(given):
        assert got[i] == brute(u), u


@pytest.mark.parametrize("limit", [0, 20_000])
def test_rules_sit_under_their_rarest_token(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    rules = [urls.host_rule("block", "example.org/en/1"), urls.host_rule("block", "example.org/en/1"), urls.host_rule("allow", "rare.example.org/")]
    assert rules[0].tokens == ("example", "org", "en")
    df = spark.createDataFrame([(1, "http://example.org/en/1"), (2, "http://example.org/"), (3, "http://en.net/")], SCHEMA)
    rows = urls.index_rules(df.selectExpr("substr(url, 8) AS _subject"), rules).collect()
    assert sorted((r["name"], r["token"]) for r in rows) == [("example.org/en/1", "en"), ("rare.example.org/", "rare")]
    assert sorted((r["page_id"], r["verdict"]) for r in urls.judge(df, rules).collect()) == [(1, "block"), (2, "allow"), (3, "allow")]


def test_rules_without_token_and_empty_table(spark):
    with pytest.raises(ValueError):
        urls.judge(spark.createDataFrame([(1, "x")], SCHEMA), [urls.Rule("", "block", ".", ())]).collect()
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hyphenated_uses_of_content_patterns(spark):
    # written out apart from the module
    pattern = re.compile(r"(^|\.)(spam-farm|adserver|doubleclick)\.|(^|[./-])(casino|xxx)([./-]|$)")
    given = [
        "http://a.casino-win.example.net/x", "http://best-casino.net/", "http://casino-win.net", "http://x.net/free-xxx-clips/1", "http://x.net/my-casino",
        "http://casinos-win.net/", "http://x.net/xxxl-shirts", "http://a.spam-farm.net/", "http://spam-farm-x.net/", "http://a-spam-farm.net/", "http://x.net/spam/farm", "http://my-adserver.net/",
    ]
    df = spark.createDataFrame(list(enumerate(given)), SCHEMA)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert got == {i: "block" if pattern.search(u[7:]) else "allow" for i, u in enumerate(given)}
    assert [got[i] for i in range(6)] == ["block"] * 5 + ["allow"]


def test_keys_of_hyphenated_rules(spark):
    rules = [urls.host_rule("block", "my-shop.example/a-b"), *urls.default_rules()]
    assert rules[0].tokens == ("my", "shop", "example", "a")
    df = spark.createDataFrame([("spam.net/",), ("x.spam-farm.net/",)], "_subject string")
    assert {r["token"] for r in urls.index_rules(df, rules).collect() if "spam" in r["pattern"]} == {"farm"}
    df = spark.createDataFrame([(1, "http://www.my-shop.example/a-bc"), (2, "http://not-my-shop.example/a-b")], SCHEMA)
    assert sorted((r["page_id"], r["verdict"]) for r in urls.judge(df, rules).collect()) == [(1, "block"), (2, "allow")]
