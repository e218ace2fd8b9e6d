"""Intermediate tables in the cluster's shared folder, and the frame that operators start from."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm.textcodes import forget_powers
from tsforge.session import shared_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and read it back: a lost executor
    repeats its own tasks only, and no later reader computes the rows again."""
    path = shared_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_DRAWS = 1 << 63


def draw(*cols: str):
    """A number from 0 to 2**63 - 1 for each row, from a hash of ``cols``: for samples that do not depend on how rows lie."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def threshold(wanted: int, total: int) -> int:
    """Rows whose draw is at most this are about ``wanted`` of ``total``, however many there are; all if there are no more."""
    return _DRAWS - 1 if wanted >= total else max(0, wanted * _DRAWS // total - 1)


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch on the way to Python hold more than BATCH_BYTES (or one row): ten thousand whole
    texts, the usual batch, can be any size. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", (spark.conf.get(key, None) or "").lower())
    if now is None or int(now[1]) << 10 * " kmgt".index(now[2] or " ") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _give_back() -> None:
    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it has its own ways
        pass


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, handing freed memory back to the system when a task ends: Spark keeps its Python
    workers, and each would otherwise go on holding the most its tasks ever used."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on. Rows without an id are left out: no result can name them."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .where(F.col("doc_id").isNotNull())
