"""Structured Streaming forms of the hourly resample (R1), of the merge of load and weather (J1) and of batch scoring.

Events arrive as files; the stream casts the event time, sets a watermark and keeps hourly means per series in
state until the watermark has passed them. Each micro-batch writes the hours it changed to its own ``epoch=<id>``
folder through ``foreachBatch``. An epoch that is repeated after a failure replaces its folder, so nothing is
counted twice; readers take the newest epoch of each hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge import SERIES, TS

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def hourly_means_stream(spark: SparkSession, path: str, watermark: str = "2 hours",
                        schema: str = EVENT_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(series, ts, value, n)``: hourly mean and count per event type."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    ev = r.parquet(path).select(F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp").alias(TS),
                                F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    return (ev.withWatermark(TS, watermark)
              .groupBy(SERIES, F.window(TS, "1 hour").alias("w"))
              .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
              .select(SERIES, F.col("w.start").alias(TS), "value", "n"))


def _write_epoch(batch: DataFrame, epoch: int, table_path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")


def run_available(stream: DataFrame, table_path: str, checkpoint: str) -> DataFrame:
    """Process everything available now; returns the newest state of every hour."""
    q = (stream.writeStream.outputMode("update").foreachBatch(lambda b, e: _write_epoch(b, e, table_path))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return newest(stream.sparkSession.read.parquet(table_path))


def newest(changes: DataFrame) -> DataFrame:
    """Of each (series, hour) the row of the last epoch that changed it."""
    others = [c for c in changes.columns if c not in (SERIES, TS, "epoch")]
    return changes.groupBy(SERIES, TS).agg(F.max_by(F.struct(*others), "epoch").alias("r")).select(SERIES, TS, "r.*")


def merge_streams(load: DataFrame, weather: DataFrame, delay: str = "2 hours", reach: str = "0 seconds") -> DataFrame:
    """J1 on two streams of hourly rows: each load row with the weather of its hour, or of up to ``reach`` before it.

    Rows wait in state for their partner, whichever comes first, until the other side's watermark (``delay`` behind its newest
    row) has passed the time it could still match; so state holds hours, not the history."""
    keys = [c for c in (SERIES,) if c in weather.columns]
    right = weather.withColumnsRenamed({TS: "_at", **{k: f"_w_{k}" for k in keys}}).withWatermark("_at", delay)
    on = F.col("_at").between(F.col(TS) - F.expr(f"INTERVAL {reach}"), F.col(TS))
    if reach.split()[0] == "0":
        on = F.col("_at") == F.col(TS)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_w_{k}"))
    return load.withWatermark(TS, delay).join(right, on, "inner").drop("_at", *[f"_w_{k}" for k in keys])


def run_appending(stream: DataFrame, table_path: str, checkpoint: str) -> DataFrame:
    """Process everything available now, one replaceable folder per epoch; all rows of all epochs so far."""
    q = (stream.writeStream.outputMode("append").foreachBatch(lambda b, e: _write_epoch(b, e, table_path))
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table_path).drop("epoch")


def score_stream(stream: DataFrame, score, table_path: str, checkpoint: str):
    """Batch scoring of arriving scenario rows (M13/M16 on a stream): ``score(batch_df)``, one replaceable folder per epoch."""
    return (stream.writeStream.foreachBatch(lambda b, e: _write_epoch(score(b), e, table_path))
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
