"""Connected components of a link table, by alternating large and small stars.

Nothing is gathered on the driver: a round is joins and grouped minima on the links, its result is a
table in the shared folder, and rounds end when the links are stars. Every partition first
replaces its links by a star for each of its local components, so chains shorten before they are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.tables import staged, tidy

_HOLD = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the links a-b, without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            far = new[new]
            if (far == new).all():
                break
            new = far
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _contract(links: DataFrame) -> DataFrame:
    def run(batches):
        held = []
        for b in batches:
            held.append((b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)))
            if sum(len(x) for x, _ in held) > _HOLD:
                small = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                if len(small[0]) > _HOLD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in small], names=["a", "b"])
                    held = []
                else:
                    held = [small]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["a", "b"])

    return links.select(F.col(links.columns[0]).cast("long").alias("a"), F.col(links.columns[1]).cast("long").alias("b")) \
        .where("a <> b").mapInArrow(tidy(run), "a long, b long")


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: each node in one link, to a node that has none itself."""
    if not links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(id, component): each node of a link and the least node that it reaches, from the first two columns."""
    now = staged(_contract(links), "links")  # every row: a > b
    while not _settled(now):
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b AS a", "m AS b").where("a > b").unionByName(least.selectExpr("a", "m AS b")).distinct()
        now = staged(small, "links")
    return now.selectExpr("a AS id", "b AS component").unionByName(now.selectExpr("b AS id", "b AS component").distinct())
