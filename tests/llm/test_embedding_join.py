import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.llm import embedding_join

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.9):
    ids = [i for i, *_ in rows]
    width = max((len(v) for _, v, *_ in rows if v), key=[len(v) for _, v, *_ in rows if v].count)
    ok = [v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, *_ in rows]
    x = np.array([np.float32(v).astype(float) if k else np.zeros(width) for k, (_, v, *_) in zip(ok, rows, strict=True)])
    n = np.linalg.norm(x, axis=1)
    c = (x @ x.T) / np.where(n == 0, 1, n)[:, None] / np.where(n == 0, 1, n)[None]
    link = (c >= least) & ~np.eye(len(ids), dtype=bool)
    root = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(link), strict=True):
            low = min(root[ids[i]], root[ids[j]])
            changed |= root[ids[i]] != low or root[ids[j]] != low
            root[ids[i]] = root[ids[j]] = low
    return {i: (int(link[k].sum()), root[i], root[i] == i) for k, i in enumerate(ids)}


def answer(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicates(df, **options).collect()}


def vectors(n=300, width=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(3 * i + 5), rng.normal(size=width).tolist(), 0) for i in range(n)]
    for k in range(60):
        v = np.array(rows[k % 20][1]) + rng.normal(size=width) * 0.15
        rows.append((10_000 + k, (v * rng.random() * 9).tolist(), 1))
    rows += [(20_000 + k, rows[7][1], 1) for k in range(40)]
    rows += [(30_000, None, 0), (30_001, [], 0), (30_002, [0.0] * width, 0), (30_003, [None] + [1.0] * (width - 1), 0),
             (30_004, [float("nan")] + [1.0] * (width - 1), 0), (30_005, [float("inf")] * width, 0), (30_006, [1.0] * (width + 1), 0),
             (30_007, [1e-30] * width, 0), (30_008, [1e30] * width, 0)]
    return rows


@pytest.mark.parametrize("block", [6000, 25, 3])
def test_equals_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert max(n for n, *_ in want.values()) > 39
    assert answer(df, block=block) == want
    assert answer(df, block=block, least=0.97, dimensions=2) == brute(rows, 0.97)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert answer(df) == brute([tuple(r) for r in df.collect()])


def test_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert embedding_join.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None, 0), (2, [], 0), (None, [1.0], 0)], SCHEMA)
    assert answer(df) == {1: (0, 1, True), 2: (0, 2, True)}
    df = spark.createDataFrame(vectors(30), SCHEMA).withColumn("pair", F.lit("x")).withColumn("u", F.lit(1)).withColumn("block", F.lit(2))
    assert answer(df) == brute(vectors(30))


def test_each_vector_is_sent_once(spark, monkeypatch):
    """Disk grows with the vectors, not with the pairs of blocks: no copy of a vector is dealt to each partner."""
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sent, sort = [], type(df).sortWithinPartitions
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *a, **b: sent.append(self.count()) or sort(self, *a, **b))
    assert answer(df, block=25) == brute(rows)
    assert sum(sent) <= len(rows)


def test_large_cells_are_parted(spark):
    """A cell of more vectors than a block holds, with groups of near copies and one of equal vectors."""
    rng = np.random.default_rng(4)
    x = 3 * np.eye(1, 32)[0] + np.repeat(rng.normal(size=(30, 32)), 12, 0) + rng.normal(size=(360, 32)) * 0.05
    rows = [(int(k), v.tolist(), 0) for k, v in enumerate(np.concatenate([x, np.repeat(x[:1], 50, 0)]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert answer(df, block=20) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pieces_and_strips(spark, monkeypatch, kind):
    """Blocks of several pieces and several strips, and more strips than one job takes."""
    monkeypatch.setattr(embedding_join, "PIECE_BYTES", 32 * 7)
    monkeypatch.setattr(embedding_join, "STRIP_BYTES", 32 * 20)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).repartition(5)
    assert answer(df, block=50) == brute(rows)


def test_strips():
    first, many = embedding_join.cut_strips(np.array([3, 3, 3, 25, 2, 8]), 1, 8)
    assert first.tolist() == [0, 0, 1, 2, 6, 7] and many.tolist() == [1, 1, 1, 4, 1, 1]


def test_no_usable_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [float("nan"), 1.0], 0)], SCHEMA)
    assert answer(df) == {1: (0, 1, True), 2: (0, 2, True)}


def piece(x, first_id):
    x = x.astype("<f4")
    u = embedding_join.unit(x.astype(float))
    order, tiles = embedding_join.cut_tiles(u, 0.18)
    assert sorted(order.tolist()) == list(range(len(x)))
    centres, radii = embedding_join.balls(u[order], tiles)
    return embedding_join.Piece(np.arange(len(x)) + first_id, x[order], tiles.astype(np.int64), centres, radii)


@pytest.mark.parametrize("copies, noise", [(1, 0), (6, 0), (12, 0.01), (200, 0.01), (200, 0.1), (1500, 0.02)])
def test_tiles(copies, noise):
    """Tiles skipped, counted whole and multiplied give the links of all pairs."""
    rng = np.random.default_rng(copies)
    x = np.repeat(rng.normal(size=(1500 // copies, 32)), copies, 0)
    x = rng.permutation(x + noise * rng.normal(size=x.shape) * np.abs(x).max())
    a, b = piece(x, 0), piece(np.concatenate([x[:400] * 3, rng.normal(size=(300, 32))]), 10_000)
    u, v = (embedding_join.unit(p.x.astype(float)) for p in (a, b))
    found = embedding_join.join_pieces(a, b, 0.9)
    link = u @ v.T >= 0.9
    assert a.n.tolist() == link.sum(1).tolist() and b.n.tolist() == link.sum(0).tolist()
    same = lambda edges: dict(zip(*(z.tolist() for z in embedding_join.stars(*edges)), strict=True))
    i, j = np.nonzero(link)
    assert same([np.concatenate(z) for z in zip(*found, strict=True)]) == same((a.ids[i], b.ids[j]))
    a.n[:] = 0
    found = embedding_join.join_pieces(a, a, 0.9)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert a.n.tolist() == link.sum(1).tolist()
    i, j = np.nonzero(link)
    assert (same([np.concatenate(z) for z in zip(*found, strict=True)]) if found else {}) == same((a.ids[i], a.ids[j]))


def test_distant_intervals_are_skipped():
    low = np.array([[0, 0], [0, 9], [5, 0], [6, 1]])
    pairs = embedding_join.join_intervals(low, low)
    assert sorted(pairs) == [(0, 0), (1, 1), (2, 2), (2, 3), (3, 3)]
