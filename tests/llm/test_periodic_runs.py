import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tsforge.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least_words=6, least_periods=4):
    """Every period tried on every stretch."""
    n, out = len(w), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            part = w[i:i + length]
            if length >= max(least_words, least_periods * q) and not any(
                    all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def rows_of(df):
    return {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()}


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    rnd = random.Random(letters)
    texts = [[rnd.randrange(letters) for _ in range(rnd.randrange(60))] for _ in range(200)]
    for t in texts[::3]:  # repeated stretches, with a broken end
        part = [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))]
        t += part * rnd.randint(3, 7) + part[:rnd.randrange(len(part))]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    codes = np.array([x for t in texts for x in t], np.uint64)
    start, length, period = periodic_runs.find_runs(codes, bounds)
    want = [(b + s, n, q) for t, b in zip(texts, bounds.tolist()) for s, n, q in brute_runs(t)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want
    assert want


def test_nested_runs_and_other_bounds():
    w = ([7] * 6 + [1]) * 5  # six equal words in each period of seven
    codes, bounds = np.array(w, np.uint64), np.array([0, len(w)])
    got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(codes, bounds))))
    assert got == brute_runs(w) and (0, 35, 7) in got and (7, 6, 1) in got
    got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(codes, bounds, 3, 3))))
    assert got == brute_runs(w, 3, 3)
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs.periodic(None, least_periods=2)


def test_query_equals_brute_force(spark, small, tmp_path):
    rows, _ = small
    rnd = random.Random(2)
    texts = [t for _, t, *_ in rows] + [" ".join(rnd.choice("ab c d é".split(" ")) for _ in range(rnd.randrange(80))) for _ in range(300)]
    texts += ["ha " * 500, "a b " * 2 + "a", "x y z\n" * 4, "q" * 70_000]
    table = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a a a a a"), (5_000_000_000, "a " * 6)]
    path = str(tmp_path)
    spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS collapsed", "'x' AS start") \
        .write.parquet(f"{path}/documents.parquet")
    got = rows_of(queries.op13_periodic_runs(spark, path))
    assert got == {i: brute(i, t) for i, t in table if i is not None}
    assert any(v[0] > 1 for v in got.values())


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = {i: t for i, t in docs if len(t or "") < 4000}  # brute force takes the square of a text's words
    got = rows_of(queries.op13_periodic_runs(spark, sf))
    assert len(got) == len(docs)
    assert {i: got[i] for i in short} == {i: brute(i, t) for i, t in short.items()}


def test_repeated_rows_long_text_and_empty_table(spark, nothing):
    assert periodic_runs.periodic(nothing).count() == 0
    one = "alpha beta gamma " * 300_000 + "end"  # 5 MB
    got = spark.createDataFrame([(1, one), (1, one), (2, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic(got).collect())
    assert got == [(1, 900_001, [(0, 900_000, 3)], "alpha beta gamma end")] * 2 + [(2, 0, [], "")] * 2
