import base64
import hashlib

from metriloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(spark):
    rows = [
        (3, "http://a.example/x", "<p>one é</p>"),
        (1, "http://a.example/y", "<p>one é</p>"),
        (2, None, "two"),
        (4, "http://b.example/\r\nWARC-Type: evil", None),
        (5, "", ""),
        (6, "http://c.example/", "z" * 200_000),
        (7, "u", "repeated"),
        (7, "u", "repeated"),
        (None, "n", "two"),
        (None, "n", "alone"),
    ]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", payload string").repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = warc.write_archive(df, str(tmp_path / "archive"))
    got = warc.read_archive(spark, path).withColumn("record", warc.record()).collect()
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    want = sorted(
        (str(k or ""), len((h or "").encode()), digest(h), "response" if first.get(h or "") in (None, k) else "revisit", "" if first.get(h or "") in (None, k) else str(first[h or ""]))
        for k, _, h in rows
    )
    assert sorted((r["id"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"] or "") for r in got) == want
    assert all(r["verified"] for r in got)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    for r in got:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1") and fields["WARC-Type"] == r["type"] and len(rest) == int(fields["Content-Length"]) + 4
        body = rest[:-4].partition(b"\r\n\r\n")[2]
        assert body == (bytes(r["payload"]) if r["type"] == "response" else b"")


def test_small_payloads_are_all_stored_as_responses(spark):
    headers, _ = warc.to_records(pages(spark)[1], min_bytes=7)
    kinds = [bytes(r["warc_header"]).decode().split("\r\n")[1] for r in headers.collect()]
    assert kinds.count("WARC-Type: revisit") == 1


def test_a_changed_payload_is_found(spark, tmp_path):
    path = warc.write_archive(pages(spark)[1], str(tmp_path / "a"))
    from pyspark.sql import functions as F

    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.octet_length("payload") == 3, F.lit(b"TWO")).otherwise(F.col("payload")))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "b/headers"))
    assert warc.read_archive(spark, str(tmp_path / "b")).where("not verified").count() == 2


def test_empty_table(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "archive"))
    assert warc.read_archive(spark, path).count() == 0
