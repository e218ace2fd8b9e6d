"""Exact quantiles by distributed selection.

``percentile`` in a grouped aggregate holds all distinct values of a group in one task. Here the
values are sorted over the cluster (range partitions, so a hot group or value is split), numbered
(:func:`tsforge.operators.sequence.with_row_index`), and only the one or two rows at each wanted rank are kept.

Of groups with more than ``DIRECT_ROWS`` values only those near a wanted rank are sorted: sketches of bounded error
(``percentile_approx``) give a stretch of values that certainly holds the rank, and one aggregate counts the values
below it. The result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.operators.sequence import with_row_index

DIRECT_ROWS = 1_000_000
#: The sketch's ranks are off by at most n / ACCURACY; the stretch reaches three times as far on both sides.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], keys: list[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """``(keys..., column, q array<double>)``: quantiles of the non-null values, interpolated between ranks.

    Groups without a value have no row.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])
    long = df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.column", "_e.x").where(F.col("x").isNotNull())
    group = [*keys, "column"]
    largest = long.groupBy(*group).count().agg(F.max("count")).first()[0]
    if largest is None or largest <= direct_rows:
        ranked = with_row_index(long, group, "x", "_i", "_n")
    else:
        ranked = _near_ranks(long, group, probs, direct_rows)
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    wanted = F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)])
    few = ranked.where(F.array_contains(wanted, F.col("_i"))).groupBy(*group, "_n").agg(
        F.map_from_entries(F.collect_set(F.struct("_i", "x"))).alias("_v"))

    def value(a: Column) -> Column:
        lo, hi = F.floor(a).cast("long"), F.ceil(a).cast("long")
        return F.when(lo == hi, F.col("_v")[lo]).otherwise((hi - a) * F.col("_v")[lo] + (a - lo) * F.col("_v")[hi])

    return few.select(*group, F.array(*[value(a) for a in at]).alias("q"))


def _near_ranks(long: DataFrame, group: list[str], probs: list[float], direct_rows: int) -> DataFrame:
    """Rows ``(group..., x, _i, _n)`` near the wanted ranks, numbered as among all rows of their group."""
    reach = 3 / ACCURACY
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-reach, reach)})
    sketch = long.groupBy(*group).agg(F.count("x").alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max"),
                                      F.percentile_approx("x", edges, ACCURACY).alias("_e"))
    exact = F.col("_n") <= direct_rows

    def edge(p: float, d: int) -> Column:
        e = p + d * reach
        end = F.col("_min") if d < 0 else F.col("_max")
        return end if not 0 < e < 1 else F.when(exact, end).otherwise(F.col("_e")[edges.index(e)])

    stretches = F.array(*[F.struct(F.lit(k).alias("k"), edge(p, -1).alias("lo"), edge(p, 1).alias("hi")) for k, p in enumerate(probs)])
    side = sketch.select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)], "_n", stretches.alias("_s"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    tagged = long.join(side, same).drop(*[f"_g{i}" for i in range(len(group))])
    below = tagged.groupBy(*group).agg(F.array(*[F.count_if(F.col("x") < F.col("_s")[k]["lo"]) for k in range(len(probs))]).alias("_below"))
    below = below.select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)], "_below")
    near = tagged.select(*group, "x", "_n", F.explode("_s").alias("_t")).where((F.col("x") >= F.col("_t.lo")) & (F.col("x") <= F.col("_t.hi"))) \
        .select(*group, F.col("_t.k").alias("_k"), "x", "_n")
    return with_row_index(near, [*group, "_k"], "x", "_i").join(below, same) \
        .select(*group, "x", "_n", (F.col("_i") + F.col("_below")[F.col("_k")]).alias("_i"))
