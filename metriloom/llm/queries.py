"""The registered queries of this package, with SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from metriloom.llm import ann, licenses, order_minhash, packing, prefix_trie, quality, repair, simhash, suffix, tokens, toxicity, urls, warc
from metriloom.plans.registry import query
from metriloom.session import new_path, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_byte_bpe")
def op1(t):
    encoded = tokens.encode(t.table("documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    decoded = tokens.decode(encoded.select("doc_id", "ids"), RANKS)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_packing")
def op4(t):
    pieces = packing.pack(t.table("documents"), TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op7_simhash")
def op7(t):
    found = simhash.near_duplicates(t.table("documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_suffix_dedup")
def op9(t):
    left = suffix.remove_repeats(t.table("documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_toxicity")
def op5(t):
    docs = t.table("documents").select("doc_id", "text")
    index = toxicity.fit(docs, t.table("labels").where(~toxicity.held_out()).select("doc_id", "toxic"))
    return toxicity.score(docs, index).withColumn("held_out", toxicity.held_out()).select("doc_id", "held_out", "score", "predicted", "neighbours")


def _base32_sql(digest: str) -> str:
    """Upper-case base32 of a 40-digit hexadecimal string, 40 bits at a time."""
    parts = " || ".join(f"to_base(('0x' || substr({digest}, {at}, 10))::BIGINT, 32, 8)" for at in (1, 11, 21, 31))
    return f"translate({parts}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


OP2_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, payload FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_base32_sql("digest")} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


@query("op2_warc", "", OP2_SQL)
def op2(t):
    path = warc.write_archive(t.table("pages"), new_path(t.spark, "archive"))
    records = warc.read_archive(t.spark, path).where(F.expr("verified or raise_error('payload bytes do not match their digest') is null"))
    return records.select(
        F.col("id").cast("bigint").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
    )


def _rules_sql() -> str:
    rules = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in urls.RULES)
    patterns = " OR ".join(f"regexp_matches(host || path, '{p}')" for _, p in urls.PATTERNS)
    return f"""
WITH r AS (SELECT * FROM (VALUES {rules}) AS v(verdict, rule_host, rule_path, rule)),
s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM s),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, CASE WHEN {patterns} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN b USING (page_id)"""


@query("op6_url_filter", "", _rules_sql())
def op6(t):
    return urls.judge(t.table("pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _licenses_sql() -> str:
    known = licenses.template_bigrams(licenses.TEMPLATES)
    rows = ", ".join(f"('{n}', {b})" for n, b in known.items())
    return f"""
WITH k AS (SELECT * FROM (VALUES {rows}) AS v(license, t)),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
s AS (SELECT r, unnest(list_concat(string_split(text, chr(10)), CASE WHEN contains(text, chr(10)) THEN [text] ELSE CAST([] AS VARCHAR[]) END)) AS segment FROM d),
w AS (SELECT r, regexp_extract_all(lower(segment), '[a-z0-9]+') AS w, row_number() OVER () AS q FROM s),
b AS (SELECT r, q, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
m AS (SELECT r, q, license, 2.0 * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice FROM b, k),
g AS (SELECT r, q, max(dice) AS dice, arg_max(license, (dice, -rank)) AS license FROM (SELECT *, dense_rank() OVER (ORDER BY license) AS rank FROM m WHERE dice >= {licenses.THRESHOLD}) GROUP BY r, q),
h AS (SELECT r, arg_max(license, (dice, -rank)) AS license, max(dice) AS dice, count(*) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY license) AS rank FROM g) GROUP BY r)
SELECT doc_id, license, coalesce(round(dice, 6), 0.0)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_segments FROM d LEFT JOIN h USING (r)"""


@query("op8_license_scan", "", _licenses_sql())
def op8(t):
    return licenses.scan(t.table("documents").select("doc_id", "text"))


@query("op3_order_minhash")
def op3(t):
    found = order_minhash.edited_neighbours(t.table("documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        order_minhash.as_text("signature").alias("fingerprint"),
        order_minhash.as_text("edited_signature").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op10_hnsw")
def op10(t):
    vectors = t.table("embeddings")
    index = written(ann.build_index(vectors), "graphs")
    return ann.search(index, vectors.where(F.col("vec_id") % 20 == 0))


#: the CRC-32 table by its rule (fixed polynomial 0xEDB88320), and CRC-32 of an ASCII string
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_table"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII SQL string, where ``crc_table`` is in scope."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))"
    step = "lambda c, b: xor(c // 256, crc_table[xor(c % 256, b) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step.replace('xor(c % 256, b)', 'xor(c, b) % 256')}), 4294967295)"


OP11_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}),
t AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, said, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, said) - 1 AS pos FROM t),
cv AS (SELECT c, c - c % 20 AS base, {crc32_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM o), crc),
sz AS (SELECT c AS base, count(*) AS n_base FROM o GROUP BY c),
r AS (SELECT cv.c, pos, said, words FROM cv JOIN o ON o.c = base WHERE pos < h
  UNION ALL SELECT c, pos - h + least(h, coalesce(n_base, 0)), said, words FROM cv JOIN o USING (c) LEFT JOIN sz USING (base) WHERE pos >= h),
q AS (SELECT c, coalesce(list(said ORDER BY pos) FILTER (said IS NOT NULL), CAST([] AS VARCHAR[])) AS saids, list(words ORDER BY pos) AS words FROM cv LEFT JOIN r USING (c) GROUP BY c),
p AS (SELECT c, d, len(saids) AS size, md5(array_to_string(saids[1:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(saids[1:d - 1], '')) END AS above,
  CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(len(saids) + 1)) AS d FROM q)),
n AS (SELECT node, d, any_value(above) AS above, min(c) AS conv, count(*) AS n, any_value(w) AS w,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS ends FROM p GROUP BY node, d),
k AS (SELECT above AS node, count(*) AS children FROM n WHERE d > 0 GROUP BY above),
f AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (node)),
s AS (SELECT p.node, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.w) AS saved FROM f JOIN p ON p.c = f.conv AND p.d <= f.d GROUP BY p.node)
SELECT f.conv AS conv_id, CAST(f.d AS BIGINT) AS depth, u.conv AS parent_conv_id, f.n AS n_convs, CAST(f.children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN n u ON f.above = u.node"""


@query("op11_prefix_trie", "", OP11_SQL)
def op11(t):
    return prefix_trie.nodes(prefix_trie.with_shared_starts(prefix_trie.turns_of(t.table("conversations")))).drop("k1", "k2")


OP13_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
g AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS own_role, coalesce(text, ' ') AS own_text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT g.*, {crc32_sql("k")} % 20 AS kind FROM g, crc),
e AS (SELECT c, turn, own_role, md5(own_text) AS own_md5, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE own_role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(own_text, '[.!?]', '', 'g') ELSE own_text END AS text FROM d WHERE kind <> 0),
o AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, own_role, own_md5, copy) AS i FROM e),
m AS (SELECT *, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS next_initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail,
  row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM o),
r AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
ins AS (SELECT * FROM (VALUES (0, 0, '', CAST([] AS VARCHAR[]), 0), (0, 2, 'I', ['user:'], 3), (0, 3, 'II', ['user:', 'assistant:'], 6), (1, 1, '', [], 0), (1, 2, 'I', ['user:'], 3),
  (1, 3, 'II', ['user:', 'assistant:'], 6), (2, 2, '', [], 0), (2, 3, 'I', ['assistant:'], 3), (3, 3, '', [], 0), (3, 2, 'I', ['user:'], 3)) AS v(was, s, letters, lines, cost)),
ed AS (SELECT * FROM (VALUES ('D', 0, 0, NULL, 4, NULL), ('D', 1, 1, NULL, 4, NULL), ('D', 2, 2, NULL, 4, NULL), ('D', 3, 3, NULL, 4, NULL),
  ('K', 0, 1, 's', 0, NULL), ('K', 0, 2, 'u', 0, NULL), ('K', 1, 2, 'u', 0, NULL), ('K', 3, 2, 'u', 0, NULL), ('K', 2, 3, 'a', 0, NULL),
  ('R', 0, 2, NULL, 3, 'user'), ('R', 1, 2, NULL, 3, 'user'), ('R', 3, 2, NULL, 3, 'user'), ('R', 2, 3, NULL, 3, 'assistant')) AS v(letter, s, t, need, cost, name)),
best AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM r
  UNION ALL
  SELECT c, i, s, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(lines, (cost, audit)) AS lines FROM (
    SELECT b.c, r.i, ed.t AS s, b.cost + ins.cost + ed.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END AS cost, b.audit || ins.letters || ed.letter AS audit,
      list_concat(b.lines, ins.lines, CASE WHEN letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(ed.name, r.role) || ':' || r.text] END) AS lines
    FROM best b JOIN r ON r.c IS NOT DISTINCT FROM b.c AND r.i = b.i + 1 JOIN ins ON ins.was = b.s JOIN ed ON ed.s = ins.s
    WHERE (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (need IS NULL OR need = initial)) AS x GROUP BY c, i, s),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (next_initial IS NOT NULL AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
z AS (SELECT b.c, min(b.cost + ins.cost) AS cost, arg_min(audit || letters, (b.cost + ins.cost, audit || letters)) AS audit,
  arg_min(list_concat(b.lines, ins.lines), (b.cost + ins.cost, audit || letters)) AS lines
  FROM best b JOIN n ON n.c IS NOT DISTINCT FROM b.c AND n.n = b.i JOIN ins ON ins.was = b.s WHERE ins.s IN (0, 3) GROUP BY b.c)
SELECT a.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS c FROM conversations) a LEFT JOIN n ON n.c IS NOT DISTINCT FROM a.c LEFT JOIN z ON z.c IS NOT DISTINCT FROM a.c"""


@query("op13_conversation_repair", "", OP13_SQL)
def op13(t):
    return repair.repair(t.table("conversations"))


@query("op12_quality")
def op12(t):
    rows = written(quality.featured(t.table("documents").select("doc_id", "text")).drop("text"), "features")
    model = quality.fit(rows, t.table("labels").where(~quality.held_out()).select("doc_id", "quality"))
    return quality.score(rows, model).withColumn("held_out", quality.held_out()).select("doc_id", "held_out", "score", "predicted")
