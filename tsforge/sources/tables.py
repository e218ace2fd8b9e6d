"""Parquet scans with the two scan-time normalisations every series needs.

* ``timestamp_ntz`` columns become session-zone ``timestamp`` (the session is UTC,
  so the wall clock is kept); ``date_trunc`` then yields the same type everywhere.
* floating ``NaN`` becomes SQL NULL: Spark orders NaN as the largest value and
  ``avg``/``max``/``percentile`` return NaN once one is present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_scan(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        else:
            cols.append(c)
            continue
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one test table; ``columns`` prunes at the scan (ReadSchema)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return clean_scan(df)
