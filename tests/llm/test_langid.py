import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tsforge.llm import langid
from tsforge.llm.textcodes import slabs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_gradients_are_right():
    net = langid.ByteNet(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 256, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40)
    x[y == 1, ::7] = 65
    x[y == 2, ::9] = 200
    before = -np.log(net.probabilities(x)[np.arange(40), y]).mean()
    net.train(x, y, epochs=60)
    after = -np.log(net.probabilities(x)[np.arange(40), y]).mean()
    assert after < 0.3 * before


def test_windows_cover_whole_texts():
    net = langid.ByteNet(["a", "b"])
    texts = ["x" * 1000, "", "short", "é" * 700]
    s = next(slabs(pa.array(texts)))
    _, p = langid.predict(s, net)
    for t, got in zip(texts, p, strict=True):
        raw = t.encode()
        parts = [raw[i:i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
        want = sum((len(w) * net.probabilities(np.frombuffer(w.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0] for w in parts), np.zeros(2))
        assert abs(got - (want / max(1, len(raw))).max()) < 1e-5


def test_odd_rows(spark, nothing, small):
    assert langid.identify(nothing).count() == 0
    rows, df = small
    odd = df.withColumn("lang_pred", F.lit(3)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(odd, epochs=1).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        lettered = any(c.isalpha() for c in t or "")
        assert got[i].lang_pred == ("en" if lettered else "und") and (got[i].score == 0) == (not lettered)
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]
