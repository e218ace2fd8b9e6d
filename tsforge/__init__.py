"""tsforge: time-series cleaning, feature, forecasting and evaluation jobs on Spark.

Every operator takes and returns a DataFrame in the *series frame* layout
``(series string, ts timestamp, <measures...>)``. Windows are always
``partitionBy(series[, chunk]).orderBy(ts)``; nothing is collected to the driver.
"""

SERIES = "series"
TS = "ts"

__all__ = ["SERIES", "TS"]
