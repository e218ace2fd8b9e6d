import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tsforge.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages():
    rows = [(i, f"http://h{i % 4}.example/p?q={i} ü", f"<html>{i % 9} " + "words and é " * (i % 50) + "</html>") for i in range(200)]
    rows += [(500, None, None), (501, "", ""), (502, "x\r\ny: z", ""), (503, "u", "<p>" + "long " * 100_000), (504, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
             (-7, "u", "<html>negative</html>"), (9_000_000_000_000, "far", "<html>far</html>"), (None, "no id", "x"), (505, "u", rows[3][2]), (505, "u", rows[3][2])]
    return rows


def brute(rows, least=0):
    first = {}
    rows = [(i, (h or "").encode()) for i, _, h in rows if i is not None]
    for i, h in rows:
        first[h] = min(first.get(h, i), i)
    return sorted((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if len(h) < least or first[h] == i else "revisit",
                   -1 if len(h) < least or first[h] == i else first[h]) for i, h in rows)


def answer(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in df.collect())


@pytest.mark.parametrize("least", [0, 40])
def test_round_trip(spark, least, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("shard", F.lit("x")).withColumn("refers_to", F.lit("y"))
    out = f"file://{tmp_path}/a"
    listed = warc.write(df, out, min_revisit=least, shard_bytes=9_000, roll_bytes=2_000).collect()
    got = warc.read(spark, out).cache()
    assert answer(got) == brute(rows, least)
    html = {i: (h or "").encode() for i, _, h in rows if i is not None}
    assert all(r.payload == html[r.page_id] for r in got.collect() if r.record_type == "response")
    assert sum(r.records for r in listed) == got.count() and len({r.shard for r in listed}) > 3
    assert any(r.file.endswith("-00001.warc.gz") for r in listed)
    for r in listed:
        raw = open(f"{tmp_path}/a/{r.file}", "rb").read()
        assert len(raw) == r.bytes and hashlib.sha256(raw).hexdigest() == r.sha256
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert os.listdir(tmp_path / "a/_temporary") == []


def test_same_files_however_the_pages_are_dealt(spark, tmp_path):
    rows = pages()
    sums = []
    for k in (1, 7):
        df = spark.createDataFrame(rows[::-1] if k > 1 else rows, SCHEMA).repartition(k)
        listed = warc.write(df, f"file://{tmp_path}/{k}", shard_bytes=9_000, roll_bytes=2_000).collect()
        sums.append(sorted((r.file, r.sha256, r.first_page, r.last_page) for r in listed))
    assert sums[0] == sums[1]


def test_empty_table(spark, tmp_path):
    out = f"file://{tmp_path}/e"
    assert warc.write(spark.createDataFrame([], SCHEMA), out).count() == 0
    assert warc.read(spark, out).count() == 0


def test_damage_is_found(spark, tmp_path):
    out = f"file://{tmp_path}/d"
    name = warc.write(spark.createDataFrame(pages()[:5], SCHEMA), out).first().file
    path = f"{tmp_path}/d/{name}"
    raw = gzip.decompress(open(path, "rb").read()).replace(b"<html>3", b"<html>4")
    open(path, "wb").write(gzip.compress(raw))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, out).collect()
