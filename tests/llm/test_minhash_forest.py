import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tsforge.llm import components, minhash_forest
from tsforge.llm.textcodes import slabs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    done = set()
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in where[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                done.add((i, j))
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def answer(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df, **options).collect()}


def test_equals_brute_force(small):
    rows, df = small
    want = brute(rows)
    assert answer(df) == want
    assert len({c for _, c, _ in want.values()}) < len(rows) - 5
    assert answer(df, region=3, tile=2) == want


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert answer(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_large_group_of_near_copies(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(i % 7):
            w[rnd.randrange(150)] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w).title()))
    rows += [(1000 + i, " ".join(rnd.choice(vocabulary) for _ in range(100))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert answer(df) == want
    assert answer(df, region=16, tile=40) == want


def test_empty_table_and_clashing_names(nothing, small):
    assert minhash_forest.near_duplicates(nothing).count() == 0
    _, df = small
    odd = df.withColumn("component", F.lit("x")).withColumn("h0", F.lit(1)).withColumn("class_id", F.lit(None).cast("int"))
    assert minhash_forest.near_duplicates(odd).count() == df.count()


def test_minima_estimate_similarity():
    rnd = random.Random(4)
    errors = []
    for k in (2, 8, 25):
        base = [f"w{rnd.random()}" for _ in range(400)]
        other = list(base)
        for _ in range(k):
            other[rnd.randrange(400)] = f"x{rnd.random()}"
        a, b = " ".join(base), " ".join(other)
        m = minhash_forest.Shingles(next(slabs(pa.array([a, b])))).minima()
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        errors.append(abs((m[0] == m[1]).mean() - true))
    assert max(errors) < 0.16


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(200)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    links += [(3000 + rnd.randrange(200), 3000 + rnd.randrange(200)) for _ in range(150)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "x long, y long").repartition(9)
    got = {r.id: r.component for r in components.connected(df).collect()}
    a, b = (np.array(x) for x in zip(*[p for p in links if p[0] != p[1]], strict=True))
    want = dict(zip(*(x.tolist() for x in components.stars(a, b)), strict=True))
    assert got == {i: want.get(i, i) for i in set(a.tolist()) | set(b.tolist())}
    assert got[300] == 0 and got[1199] == 1000
    assert components.connected(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_in_crowded_regions(spark):
    # 400 texts at similarity 0.45, in pairs at exactly 0.8: regions are far above 2 classes in every tree
    rows = []
    for k in range(200):
        both = [f"c{i}" for i in range(115)] + [f"t{k}x{i}" for i in range(48)]
        rows += [(2 * k + e, " ".join(both + [f"e{2 * k + e}x{i}" for i in range(20)])) for e in range(2)]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) * 10 == 8 * len(shingles(rows[0][1]) | shingles(rows[1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert answer(df, region=2) == {i: (180, i - i % 2, i % 2 == 0) for i in range(400)}


def test_regions_go_deeper_as_far_as_they_are_crowded():
    rnd = random.Random(3)
    rows = sorted(tuple([1, 1, 1] + [rnd.randrange(3) for _ in range(5)]) for _ in range(500))
    keys = np.array(rows, np.uint32)
    spans = list(minhash_forest._deeper(keys, 0, 500, 3, 20))
    assert [i for i, _ in spans[1:]] == [j for _, j in spans[:-1]] and spans[0][0] == 0 and spans[-1][1] == 500
    for i, j in spans:
        same = next(d for d in range(8, -1, -1) if (keys[i:j, :d] == keys[i, :d]).all())
        assert j - i <= 20 and same >= 3
        whole = (keys[:, :same] == keys[i, :same]).all(1).sum()
        assert same == 8 or whole <= 20 or whole == j - i or same > 3
    assert len(list(minhash_forest._deeper(np.ones((50, 8), np.uint32), 0, 50, 3, 20))) == 3


def test_a_third_of_all_rows_near_copies(spark, monkeypatch):
    """Texts of a dense group are sent a few times each, however many blocks it fills."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(120)] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rnd.choice(vocabulary) for _ in range(60))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sent = []
    plain = minhash_forest.tested
    monkeypatch.setattr(minhash_forest, "tested", lambda tiles, *a: sent.append(tiles.count()) or plain(tiles, *a))
    got = answer(df, tile=20, region=16)
    assert got == brute(rows)
    assert sum(sent) < 3 * 300  # 15 blocks: pairs of blocks would send each text 15 times
