"""Result presentation for comparisons: fixed-precision doubles, one integer type,
zone-free time stamps. Applied only at the edge (registered queries), never inside jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 4


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # round(x * 10^d) / 10^d rounds the binary value the same way DuckDB does;
            # round(x, d) would round its decimal text (HALF_UP) and split ties differently.
            scale = float(10 ** digits)
            c = F.round(c.cast("double") * scale) / scale + F.lit(0.0)  # -0.0 -> 0.0
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long")
        elif isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.DoubleType):
            scale = float(10 ** digits)
            c = F.transform(c, lambda x: F.round(x * scale) / scale + F.lit(0.0))
        cols.append(c.alias(f.name))
    return df.select(*cols)
