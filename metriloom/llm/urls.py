"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens (runs of letters and digits,
whole between other characters; hyphens part tokens too) that every match contains. Of these, the one that
fewest URLs hold is the rule's key. A URL fetches the rules of its own tokens, and only those run their expression.
Host rules (``host/path``: the host with all subdomains, and paths that start with ``/path``) are pattern
rules too. Among fitting host rules the longest decides, then block; a URL without one is blocked if any
content pattern fits, and else allowed.

Null URLs, and URLs without ``://``, have an empty host and path and are allowed. Repeated rows are judged
alike, rules given twice count once, an empty table gives an empty table, and columns named like the
results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the registered query.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: content patterns for URLs without a host rule: a token, and the expression it must sit in
PATTERNS = [
    ("spam-farm", r"(^|\.)spam-farm\."),
    ("casino", r"(^|[./-])casino([./-]|$)"),
    ("xxx", r"(^|[./-])xxx([./-]|$)"),
    ("adserver", r"(^|\.)adserver\."),
    ("doubleclick", r"(^|\.)doubleclick\."),
]
#: rules up to which the index is broadcast; a larger one is shuffled
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    name: str  # as given; content patterns have none
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, text: str) -> Rule:
    """The pattern of ``host/path``. A token at the end of the path may go on in the URL, so it is none."""
    host, _, path = text.partition("/")
    whole = re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", f"{host}/{path}")
    return Rule(text, verdict, rf"^([^/]*\.)?{_literal(host)}/{_literal(path)}", tuple(dict.fromkeys(whole)))


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def default_rules() -> list[Rule]:
    return [host_rule(v, r) for v, r in RULES] + [Rule("", "block", p, (t,)) for t, p in PATTERNS]


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(subject: Column) -> Column:
    """Different tokens of ``host + path``. Letters of the path keep their case, as rules compare it."""
    return F.array_distinct(F.filter(F.split(subject, "[^A-Za-z0-9]+"), lambda t: t != ""))


def index_rules(urls: DataFrame, rules: Sequence[Rule], subject: str = "_subject") -> DataFrame:
    """``token, name, verdict, pattern``: each rule under its token that fewest URLs hold (ties: first)."""
    spark = urls.sparkSession
    given = {r: [part for t in r.tokens for part in t.split("-") if part] for r in rules}
    if not all(given.values()):
        raise ValueError("a rule needs a literal token")
    schema = "name string, verdict string, pattern string, tokens array<string>"
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, parts) for r, parts in given.items()], schema)
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(tokens(F.col(subject))).alias("token"))
    counts = held.join(_few(wanted, len(given)), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    each = table.select("name", "verdict", "pattern", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    return each.groupBy("name", "verdict", "pattern").agg(rarest.alias("key")).select(F.col("key.token").alias("token"), "name", "verdict", "pattern")


def _few(rules: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rules) if n <= BROADCAST_RULES else rules


def judge(df: DataFrame, rules: Sequence[Rule] | None = None, url: str = "url") -> DataFrame:
    """All columns, and ``host, path, rule, verdict``."""
    rules = default_rules() if rules is None else list(rules)
    base = df.drop("host", "path", "rule", "verdict", "_subject")
    host, path = split_url(url)
    rows = base.withColumns({"host": host, "path": path}).withColumn("_subject", F.concat("host", "path"))
    # equal subjects are judged once; the tokens of a subject stay in its row until a rule asks for them
    subjects = rows.groupBy("_subject").agg(F.count("*").alias("_n"))
    candidates = subjects.select("_subject", F.explode(tokens(F.col("_subject"))).alias("token")).join(
        _few(index_rules(rows, rules), len(rules)), "token"
    )
    fitting = candidates.where(F.regexp(F.col("_subject"), F.col("pattern")))
    order = F.struct((F.col("name") != "").alias("named"), F.length("name").alias("size"), (F.col("verdict") == "block").alias("block"), "name", "verdict")
    best = fitting.groupBy("_subject").agg(F.max(order).alias("best"))
    judged = rows.join(best, "_subject", "left")
    rule = F.when(F.col("best.named"), F.col("best.name"))
    return judged.select(*base.columns, "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
