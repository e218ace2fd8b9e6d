"""The queries on the preprocessed load fill it without frames that are added up anew at every row."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tsforge.plans.catalog import QUERIES

T0 = dt.datetime(2024, 3, 1)
HOURS, TYPES = 300, ("purchase", "view", "click", "signup", "error")
#: A frame that begins at or behind the current row and ends with the last; frames of all rows are summed once.
LOOKING_AHEAD = re.compile(r"(?<!unboundedpreceding\$\(\)),unboundedfollowing")


@pytest.fixture
def tables(spark, tmp_path):
    """Two events an hour and type, some without a value, some hours empty."""
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("id") % 5 + 1).cast("int"))
    at = F.floor(F.col("id") / 10)
    value = F.when(F.col("id") % 23 != 7, 40 + F.col("id") * 37 % 53 + at % 24).cast("double")
    spark.range(HOURS * 10).where(at % 41 != 17).select(
        F.col("id").alias("event_id"), (F.lit(T0) + F.expr("make_dt_interval(0, cast(floor(id / 10) as int), cast(id % 10 * 5 as int))")).alias("ts"),
        (F.col("id") % 9).alias("user_id"), kind.alias("event_type"), value.alias("value"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


class Seen(Exception):
    """The filled load's plan has been looked at."""


@pytest.mark.parametrize("name", ["cv_fold_bounds", "frame_shape", "engineered_features", "end_to_end", "model_metrics_boosted"])
def test_no_fill_looks_ahead_row_by_row(spark, tables, monkeypatch, name):
    frames = type(spark.range(1))
    kept = frames.checkpoint

    def checkpoint(df, *a, **k):
        plan = re.sub(r"\s", "", df._jdf.queryExecution().optimizedPlan().toString().lower())
        assert not LOOKING_AHEAD.search(plan)
        if "_next_kwh" in plan:
            assert "windowspecdefinition" in plan
            raise Seen
        return kept(df, *a, **k)

    monkeypatch.setattr(frames, "checkpoint", checkpoint)
    with pytest.raises(Seen):
        QUERIES[name](spark, tables)
