import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wedgeworks.llm import warc

LONG = "<p>" + "long payload " * 20
ROWS = [
    (5, "http://b/", LONG), (3, "http://a/ b\r\nX: y", LONG), (9, None, LONG), (9, None, LONG), (None, "http://n/", LONG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"),
    (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (8, "é", "ü" * 200_000), (10, "w", "x" * 99), (11, "w", "x" * 99), (12, "w", "y" * 100), (13, "w", "y" * 100),
]


def archive(spark, tmp_path, rows=ROWS):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as digest", "0 as n", "'z' as payload")
    warc.write_archive(pages, str(tmp_path / "a"))
    return str(tmp_path / "a")


def test_records_and_payloads(spark, tmp_path):
    path = archive(spark, tmp_path)
    first = {}
    for i, _, t in ROWS:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t in ROWS:
        b = (t or "").encode()
        again = len(b) >= 100 and i != first[t or ""]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[t or ""] if again else None))
    assert sorted(map(tuple, warc.verified(spark, path).collect()), key=repr) == sorted(want, key=repr)
    full = warc.restore_payloads(spark, path).select("header", "payload").collect()
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in full) == sorted(x[2] for x in want)
    assert spark.read.parquet(path + "/payloads").count() == len({x[2] for x in want})
    assert all(b"\r\nX: y" not in r.header for r in full)
    ids = [re.search(rb"WARC-Record-ID: (\S+)", r.header)[1] for r in full]
    assert len(set(ids)) == len(ids) and {re.search(rb"WARC-Refers-To: (\S+)", r.header)[1] for r in full if b"WARC-Refers-To:" in r.header} <= set(ids)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_come_back_byte_for_byte(spark, tmp_path, compression):
    path = archive(spark, tmp_path)
    warc.export_warc(spark, path, str(tmp_path / "out"), compression, max_records=4)
    got = sorted((bytes(r.header), bytes(r.payload)) for r in warc.import_warc(spark, str(tmp_path / "out")).collect())
    want = sorted((bytes(r.header), bytes(r.payload or b"")) for r in warc.read_records(spark, path).collect())
    assert got == want


def test_payloads_that_are_no_text(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "u", bytearray(rng.randbytes(rng.randint(0, 400)))) for i in range(40)] + [(90, "u", bytearray(b"\xff\x00\r\n\r\n\n" * 40)), (91, "u", bytearray(b"\xff\x00\r\n\r\n\n" * 40)), (92, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.verified(spark, str(tmp_path / "a")).collect()}
    assert got == {i: (len(b or b""), hashlib.sha256(b or b"").hexdigest(), "revisit" if i == 91 else "response") for i, _, b in rows}
    warc.export_warc(spark, str(tmp_path / "a"), str(tmp_path / "out"), max_records=7)
    back = sorted((bytes(r.header), bytes(r.payload)) for r in warc.import_warc(spark, str(tmp_path / "out")).collect())
    assert back == sorted((bytes(r.header), bytes(r.payload or b"")) for r in warc.read_records(spark, str(tmp_path / "a")).collect())


def test_damage_is_found(spark, tmp_path):
    path = archive(spark, tmp_path)
    stored = spark.read.parquet(path + "/payloads")
    bad = stored.withColumn("payload", F.when(F.col("n") == 99, F.lit(b"y" * 99)).otherwise(F.col("payload"))).toPandas()
    spark.createDataFrame(bad, stored.schema).write.mode("overwrite").parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(path + "/headers").write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged record"):
        warc.verified(spark, str(tmp_path / "b")).collect()


def test_empty(spark, tmp_path):
    assert warc.verified(spark, archive(spark, tmp_path, [])).count() == 0


def test_query_verifies_rebuilt_records(spark, tmp_path, monkeypatch):
    from wedgeworks.llm import warc

    path = f"file://{tmp_path}/rebuilt"
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200)], "page_id long, url string, html string"), path)
    assert warc.verified(spark, path).count() == 2
    real = warc.restore_payloads
    monkeypatch.setattr(warc, "restore_payloads", lambda *a: real(*a).selectExpr("digest", "n", "kind", "header", "substr(payload, 2) as payload"))
    try:
        warc.verified(spark, path).collect()
    except Exception as e:
        assert "damaged record" in str(e)
    else:
        raise AssertionError("rebuilt payloads were not looked at")
