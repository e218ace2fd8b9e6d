"""Gradient-boosted regression trees, many fits at once, from histograms of a binned matrix (M2, M3, M8).

* The training rows are binned once to one byte a feature and staged in blocks of BLOCK rows, with each row's fits as
  bits (presets and folds are fits of the same rows) and each fit's margin.
* One job grows a level of the current tree of all fits. Every block sends, per open node, a histogram (count and sum of
  residuals per feature and bin); they are added up per (fit, node), and only the best split of a node reaches the
  driver. The work and what is shuffled follow the blocks, not the driver.
* A node of at most LOCAL_ROWS rows is sent as rows instead, and the task of that (fit, node) grows the whole subtree
  from the same histograms. Both ways give the same tree: residuals are summed as whole multiples of a small unit, so sums do
  not depend on their order, nor on how rows are dealt out or a lost task is repeated.
* Rows are sampled by a hash of (series, time stamp), columns by the seed, once a tree. Margins are written into the
  blocks every REFRESH trees; in between, tasks apply the few trees since then.

Ties go to the first feature, then the least bin. Gains are those of squared loss, with ``l2`` added to counts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge import SERIES, TS
from tsforge.session import remove_path, ship_package, staged_table

BLOCK, LOCAL_ROWS, REFRESH = 32_768, 65_536, 20
BINS = 256
#: Residuals are counted in units of 2**-UNIT of their range.
UNIT = 26
#: Nodes whose histograms are in memory together.
_NODES = 32


@dataclass(frozen=True)
class Boosting:
    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    l2: float = 1.0
    least_rows: int = 1
    seed: int = 42

    def check(self) -> None:
        if self.trees < 1 or not 1 <= self.depth <= 14 or not 0 < self.rows <= 1 or not 0 < self.columns <= 1 or self.least_rows < 1 or self.l2 < 0:
            raise ValueError(f"parameters of boosted trees out of range: {self}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Flags of the rows that a tree is grown on."""
    if share >= 1:
        return np.ones(len(key), bool)
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1342543DE82EF95) % 2 ** 64)
    return _mix(key.astype(np.uint64) ^ _mix(np.array([salt], np.uint64))) < np.uint64(int(share * 2 ** 64))


def columns_of(p: Boosting, tree: int, width: int) -> np.ndarray:
    n = max(1, math.ceil(p.columns * width))
    return np.arange(width) if n >= width else np.sort(np.random.default_rng([p.seed, tree]).choice(width, n, replace=False))


def route(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row (children of k are 2k and 2k + 1, the root is 1); ``feature`` is -1 where a tree ends."""
    node, row = np.ones(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        right = x[row, np.where(inner, f, 0)] > cut[node]
        node = np.where(inner, 2 * node + right, node)
    return node


def histograms(x: np.ndarray, q: np.ndarray, slot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum of q) by slot, feature and bin."""
    width = x.shape[1]
    cell = ((slot[:, None] * width + np.arange(width)) * BINS + x).ravel()
    shape = (k, width, BINS)
    return np.bincount(cell, minlength=k * width * BINS).astype(float).reshape(shape), \
        np.bincount(cell, np.repeat(q, width), k * width * BINS).reshape(shape)


def best_splits(count: np.ndarray, total: np.ndarray, l2: float, least: int):
    """Per node: feature (-1: none), bin, gain, and count and sum left of the split and of the node."""
    n, g = count.cumsum(2), total.cumsum(2)
    all_n, all_g = n[:, :1, -1:], g[:, :1, -1:]
    right_n, right_g = all_n - n, all_g - g
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = g * g / (n + l2) + right_g * right_g / (right_n + l2)
        gain = parts - all_g * all_g / (all_n + l2)
    gain = np.where((n >= least) & (right_n >= least) & (gain > 1e-12 * parts), gain, 0.0).reshape(len(n), -1)
    at = gain.argmax(1)
    row = np.arange(len(n))
    gain = gain[row, at]
    feature = np.where(gain > 0, at // BINS, -1)
    return feature, at % BINS, gain, n.reshape(len(n), -1)[row, at], g.reshape(len(n), -1)[row, at], all_n[:, 0, 0], all_g[:, 0, 0]


def best_splits_of_rows(x: np.ndarray, q: np.ndarray, slot: np.ndarray, k: int, l2: float, least: int):
    """Feature, bin and gain as ``best_splits`` of the rows' histograms gives them, from the cells that rows fall in only:
    the way for nodes of few rows, whose histograms are nearly empty."""
    width = x.shape[1]
    cell = ((slot[:, None] * width + np.arange(width)) * BINS + x).ravel()
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    n, g = np.diff(np.append(first, len(cell))).astype(float).cumsum(), np.add.reduceat(np.repeat(q, width)[order], first).cumsum()
    cell = cell[first]
    column = cell // BINS  # node and feature
    head = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    last = np.append(head[1:], len(cell)) - 1
    size = last - head + 1
    before_n, before_g = np.append(0.0, n[last[:-1]]), np.append(0.0, g[last[:-1]])
    all_n, all_g = np.repeat(n[last] - before_n, size), np.repeat(g[last] - before_g, size)
    n, g = n - np.repeat(before_n, size), g - np.repeat(before_g, size)
    right_n, right_g = all_n - n, all_g - g
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = g * g / (n + l2) + right_g * right_g / (right_n + l2)
        gain = parts - all_g * all_g / (all_n + l2)
    gain = np.where((n >= least) & (right_n >= least) & (gain > 1e-12 * parts), gain, 0.0)
    node = column // width
    head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    top = np.maximum.reduceat(gain, head)
    at = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(head, len(node)))))
    at = at[np.unique(node[at], return_index=True)[1]]
    feature, cut, best = np.full(k, -1, np.int64), np.zeros(k, np.int64), np.zeros(k)
    own = node[at]
    best[own] = gain[at]
    feature[own], cut[own] = np.where(gain[at] > 0, column[at] % width, -1), cell[at] % BINS
    return feature, cut, best


def grow(x: np.ndarray, q: np.ndarray, root: int, depth: int, p: Boosting) -> list[tuple]:
    """(node, feature, bin, gain, n, g) of the subtree of ``root`` over its rows; ``depth`` more levels may follow."""
    out, node = [], np.full(len(x), root, np.int64)
    for level in range(depth + 1):
        names, slot = np.unique(node, return_inverse=True)
        if not len(names):
            break
        n, g = np.bincount(slot).astype(float), np.bincount(slot, q)
        split = np.full(len(names), -1, np.int64)
        cut, gain = np.zeros(len(names), np.int64), np.zeros(len(names))
        can = np.flatnonzero(n >= 2 * p.least_rows) if level < depth else np.zeros(0, np.int64)
        few = 5 * n[can].sum() < BINS * len(can)
        for i in range(0, len(can), len(can) if few else _NODES):
            part = can[i:] if few else can[i:i + _NODES]
            place = np.full(len(names), -1)
            place[part] = np.arange(len(part))
            rows = np.flatnonzero(place[slot] >= 0)
            own = x[rows], q[rows], place[slot[rows]], len(part)
            split[part], cut[part], gain[part] = best_splits_of_rows(*own, p.l2, p.least_rows) if few else best_splits(*histograms(*own), p.l2, p.least_rows)[:3]
        out += zip(names.tolist(), split.tolist(), cut.tolist(), gain.tolist(), n.tolist(), g.tolist(), strict=True)
        go = split[slot] >= 0
        x, q, node, slot = x[go], q[go], node[go], slot[go]
        node = 2 * node + (x[np.arange(len(x)), split[slot]] > cut[slot])
    return out


class BoostedTrees:
    """A fitted model; stands where a fitted ``PipelineModel`` stands (transform, write)."""

    def __init__(self, feats: list[str], edges: list[np.ndarray], init: float, params: Boosting, trees: list[dict]):
        self.feats, self.edges, self.init, self.params, self.trees = feats, edges, init, params, trees

    def binned(self, frame: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, frame[c].to_numpy(float), "left") for c, e in zip(self.feats, self.edges, strict=True)]).astype(np.uint8)

    def predict(self, frame: pd.DataFrame) -> np.ndarray:
        x, out = self.binned(frame), np.full(len(frame), self.init)
        for t in self.trees:
            out += t["value"][route(t["feature"], t["bin"], x, self.params.depth)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)  # as large as its trees

        @F.pandas_udf("double")
        def score(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value.predict(frame))

        return df.withColumn("prediction", score(F.struct(*[F.col(f"`{c}`").cast("double").alias(c) for c in self.feats])))

    def importances(self) -> np.ndarray:
        """Gain of each feature's splits, summing to 1."""
        gain = np.zeros(len(self.feats))
        for t in self.trees:
            inner = t["feature"] >= 0
            np.add.at(gain, t["feature"][inner], t["gain"][inner])
        return gain / gain.sum() if gain.sum() else gain

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, value, gain, rows): a row is on the left of a split if its feature is at most the threshold."""
        rows = []
        for k, t in enumerate(self.trees):
            for i in np.flatnonzero(t["rows"] > 0).tolist():
                f = int(t["feature"][i])
                rows.append((k, i, f if f >= 0 else None, float(self.edges[f][t["bin"][i]]) if f >= 0 else None,
                             float(t["value"][i]), float(t["gain"][i]), int(t["rows"][i]), int(t["bin"][i])))
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, value double, gain double, rows long, bin int")

    def write(self):
        return _Writer(self)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        p = Boosting(**about["params"])
        trees = [_empty(p.depth) for _ in range(about["trees"])]
        for r in spark.read.parquet(f"{path}/trees").collect():
            t = trees[r.tree]
            t["feature"][r.node], t["bin"][r.node] = -1 if r.feature is None else r.feature, r.bin
            t["value"][r.node], t["gain"][r.node], t["rows"][r.node] = r.value, r.gain, r.rows
        return cls(about["feats"], [np.array(e) for e in about["edges"]], about["init"], p, trees)


class _Writer:
    def __init__(self, model: BoostedTrees):
        self.model, self.mode = model, "error"

    def overwrite(self):
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        m, spark = self.model, SparkSession.active()
        m.table(spark).write.mode(self.mode).parquet(f"{path}/trees")
        about = {"params": asdict(m.params), "feats": m.feats, "edges": [e.tolist() for e in m.edges], "init": m.init, "trees": len(m.trees)}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(self.mode).text(f"{path}/about")


def _empty(depth: int) -> dict:
    n = 2 << depth
    return {"feature": np.full(n, -1, np.int16), "bin": np.zeros(n, np.uint8), "value": np.zeros(n), "gain": np.zeros(n), "rows": np.zeros(n, np.int64)}


_BLOCKS = "block long, n int, bins binary, label binary, key binary, member binary, margin binary"


def _blocks(rows: DataFrame, feats: list[str], edges: list[np.ndarray], inits: list[float]) -> Callable:
    from pyspark import TaskContext

    def run(batches):
        held, n, made = [], 0, 0

        def block():
            nonlocal made
            x, y, key, member = (np.concatenate(c) for c in zip(*held, strict=True))
            made += 1
            margin = np.repeat(np.array(inits), len(y))
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()), pa.array([len(y)], pa.int32()),
                 *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, key, member, margin))],
                names=["block", "n", "bins", "label", "key", "member", "margin"])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                get = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                x = np.column_stack([np.searchsorted(e, get(f"f{k}"), "left") for k, e in enumerate(edges)]).astype(np.uint8)
                held.append((x, get("label").astype(float), get("key").astype(np.int64), get("member").astype(np.int64)))
                n += len(x)
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return run


def _read_block(b: pa.RecordBatch, i: int, width: int, fits: int):
    n = b.column("n")[i].as_py()
    get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)
    return get("bins", np.uint8).reshape(n, width), get("label", float), get("key", np.int64), get("member", np.int64), get("margin", float).reshape(fits, n)


def fit_many(rows: DataFrame, feats: list[str], fits: dict[str, tuple[Boosting, Column]], label: str = "label",
             local_rows: int | None = None) -> dict[str, BoostedTrees]:
    """Boosted trees for each of ``fits``: name -> (parameters, which rows it learns from). Rows have a label and no missing
    features; a fit without rows is left out."""
    spark = rows.sparkSession
    ship_package(spark)
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    if len(fits) > 62:
        raise ValueError("at most 62 fits at once")
    names = list(fits)
    for p, _ in fits.values():
        p.check()
    key = F.xxhash64(*[F.col(c) for c in (SERIES, TS) if c in rows.columns] or [F.col(f"`{c}`") for c in feats])
    member = sum((F.when(w, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, w) in enumerate(fits.values())), F.lit(0).cast("long"))
    data = rows.where(F.col(label).isNotNull()).select(
        *[F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(feats)], F.col(label).cast("double").alias("label"),
        key.alias("key"), member.alias("member")).where("member <> 0")
    probs = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    own = lambda k: F.when(F.col("member").bitwiseAND(F.lit(1 << k)) != 0, F.col("label"))
    about = data.agg(F.count("*").alias("total"),
                     *[F.percentile_approx(f"f{k}", probs, F.lit(10_000)).alias(f"e{k}") for k in range(len(feats))],
                     *[x.alias(f"{c}{k}") for k in range(len(names)) for c, x in
                       (("n", F.count(own(k))), ("m", F.avg(own(k))), ("lo", F.min(own(k))), ("hi", F.max(own(k))))]).first()
    edges = [np.unique(np.array(about[f"e{k}"] or [], float)) for k in range(len(feats))]
    params = [p for p, _ in fits.values()]
    count = [about[f"n{k}"] for k in range(len(names))]
    init = [about[f"m{k}"] or 0.0 for k in range(len(names))]
    reach = [4 * max(abs(about[f"hi{k}"] - init[k]), abs(about[f"lo{k}"] - init[k]), 1e-300) if count[k] else 1.0 for k in range(len(names))]
    width = len(feats)
    dealt = data.repartition(max(1, math.ceil(about["total"] / BLOCK)), "key")
    blocks, path = staged_table(dealt.mapInArrow(_blocks(rows, feats, edges, init), _BLOCKS), "boosting-blocks")
    trees: list[list[dict]] = [[] for _ in names]
    fresh = [0] * len(names)  # trees that the blocks' margins hold

    def margins(k: int, x: np.ndarray, kept: np.ndarray, recent: list[dict]) -> np.ndarray:
        out = kept.copy()
        for t in recent:
            out += t["value"][route(t["feature"], t["bin"], x, params[k].depth)]
        return out

    def job(tree: int, now: dict[int, dict], frontier: dict[int, dict[int, float]]) -> list:
        """Entries (fit, node, feature, bin, gain, n, g) of all open nodes, or of their whole subtrees where they are small."""
        shared = spark.sparkContext.broadcast({k: (now[k], sorted(nodes), np.array([nodes[n] > local_rows for n in sorted(nodes)]),
                                                   columns_of(params[k], tree, width), trees[k][fresh[k]:]) for k, nodes in frontier.items()})

        def send(batches):
            for b in batches:
                for i in range(b.num_rows):
                    bins, y, key, member, kept = _read_block(b, i, width, len(names))
                    for k, (grown, nodes, big, cols, recent) in shared.value.items():
                        p = params[k]
                        inside = np.flatnonzero((member >> k) & 1)
                        inside = inside[sampled(key[inside], p.rows, p.seed, tree)]
                        x = bins[inside]
                        left = np.clip(y[inside] - margins(k, x, kept[k, inside], recent), -reach[k], reach[k])
                        q = np.rint(left * (2 ** UNIT / reach[k]))
                        node = route(grown["feature"], grown["bin"], x, p.depth)
                        x = x[:, cols]
                        at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                        at = np.where(np.array(nodes)[at] == node, at, -1)
                        for j in np.flatnonzero(~big).tolist():
                            own = np.flatnonzero(at == j)
                            if len(own):
                                yield _sent(k, nodes[j], False, x[own], q[own])
                        large = np.flatnonzero(big)
                        for c in range(0, len(large), _NODES):
                            part = large[c:c + _NODES]
                            place = np.full(len(nodes) + 1, -1)
                            place[part] = np.arange(len(part))
                            own = np.flatnonzero(place[at] >= 0)
                            if len(own):
                                n, g = histograms(x[own], q[own], place[at[own]], len(part))
                                for j, s in enumerate(part.tolist()):
                                    if n[j].any():
                                        yield _sent(k, nodes[s], True, n[j], g[j])

        def decide(batches):
            here, held = None, []

            def entries():
                k, node, big = here
                p, cols = params[k], shared.value[k][3]
                if not big:
                    x = np.concatenate([np.frombuffer(a, np.uint8).reshape(-1, len(cols)) for a, _ in held])
                    out = grow(x, np.concatenate([np.frombuffer(v) for _, v in held]), node, p.depth - node.bit_length() + 1, p)
                else:
                    n, g = (sum(np.frombuffer(h[c]).reshape(1, len(cols), BINS) for h in held) for c in (0, 1))
                    f, b, gain, ln, lg, an, ag = (v[0].item() for v in best_splits(n, g, p.l2, p.least_rows))
                    out = [(node, f, b, gain, an, ag)]
                    if f >= 0:
                        out += [(2 * node, -1, 0, 0.0, ln, lg), (2 * node + 1, -1, 0, 0.0, an - ln, ag - lg)]
                columns = [list(c) for c in zip(*out, strict=True)]
                columns[1] = [int(cols[f]) if f >= 0 else -1 for f in columns[1]]
                return pa.RecordBatch.from_arrays([pa.array([k] * len(out), pa.int32()), *(pa.array(c, t) for c, t in zip(
                    columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True))],
                    names=["fit", "node", "feature", "bin", "gain", "n", "g"])

            for b in batches:
                for i, which in enumerate(zip(*(b.column(c).to_pylist() for c in ("fit", "node", "big")), strict=True)):
                    if which != here and held:
                        yield entries()
                        held = []
                    here = which
                    a, v = b.column("x")[i].as_buffer(), b.column("q")[i].as_buffer()
                    if which[2] and held:  # histograms add up as they come
                        held = [(np.frombuffer(held[0][0]) + np.frombuffer(a), np.frombuffer(held[0][1]) + np.frombuffer(v))]
                    else:
                        held.append((a, v))
            if held:
                yield entries()

        keys = sum(len(x) for x in frontier.values())
        got = blocks.mapInArrow(send, "fit int, node long, big boolean, x binary, q binary") \
            .repartition(min(keys, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), "fit", "node") \
            .sortWithinPartitions("fit", "node").mapInArrow(decide, "fit int, node long, feature int, bin int, gain double, n double, g double").collect()
        shared.destroy()
        return got

    for tree in range(max(p.trees for p in params)):
        active = [k for k, p in enumerate(params) if tree < p.trees and count[k]]
        now = {k: _empty(params[k].depth) for k in active}
        frontier = {k: {1: float(count[k])} for k in active}
        while frontier:
            got = job(tree, now, frontier)
            asked, frontier = frontier, {}
            for r in sorted(got, key=lambda r: (r.fit, r.node)):
                t, p = now[r.fit], params[r.fit]
                t["feature"][r.node], t["bin"][r.node], t["gain"][r.node], t["rows"][r.node] = r.feature, r.bin, r.gain, int(r.n)
                t["value"][r.node] = p.rate * r.g * (reach[r.fit] / 2 ** UNIT) / (r.n + p.l2)
                parent = asked[r.fit].get(r.node // 2, 0) > local_rows
                if parent and r.feature < 0 and r.node not in asked[r.fit] and r.node.bit_length() <= p.depth and r.n >= 2 * p.least_rows:
                    frontier.setdefault(r.fit, {})[r.node] = r.n
        for k in active:
            trees[k].append(now[k])
        if any(len(trees[k]) - fresh[k] >= REFRESH for k in active) and tree + 1 < max(p.trees for p in params):
            late = spark.sparkContext.broadcast({k: trees[k][fresh[k]:] for k in active})

            def refresh(batches, late=late):
                for b in batches:
                    out = []
                    for i in range(b.num_rows):
                        bins, _, _, _, kept = _read_block(b, i, width, len(names))
                        kept = kept.copy()
                        for k, recent in late.value.items():
                            kept[k] = margins(k, bins, kept[k], recent)
                        out.append(kept.tobytes())
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=b.schema.names)

            old = path
            blocks, path = staged_table(blocks.mapInArrow(refresh, _BLOCKS), "boosting-blocks")
            remove_path(spark, old)
            for k in active:
                fresh[k] = len(trees[k])
    remove_path(spark, path)
    return {name: BoostedTrees(list(feats), edges, float(init[k]), params[k], trees[k]) for k, name in enumerate(names) if count[k]}


def _sent(fit: int, node: int, big: bool, x: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([node], pa.int64()), pa.array([big]),
                                       pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(q, float).tobytes()], pa.binary())],
                                      names=["fit", "node", "big", "x", "q"])
