"""Shared folders, cut lineage and small column helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairline.sources.scratch import cut, drop, shared_dir, temporary  # noqa: F401

#: Rows and bytes in an Arrow batch: whole texts go to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20
#: Rows of a table that may be broadcast, once they are counted; parts over which the rows of one key are dealt in other joins.
BROADCAST_ROWS, SALTS = 50_000, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of the session to BATCH_ROWS rows and BATCH_BYTES bytes at most.

    The settings are read when a plan runs, after the operator has returned, so that they stay with the session.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", counted: bool = True) -> DataFrame:
    """left joined with right, which has at most one row for each combination of keys, however frequent a key is in left.

    Where right is small (it is counted, unless told otherwise) it is broadcast. Else the rows of a key are dealt over
    SALTS parts by the columns `by`, and right's row goes to those parts only that have rows.
    """
    if counted and right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), *by), F.lit(SALTS)).cast("int"))
    there = salted.select(*keys, "__salt").distinct().join(right, keys)
    return salted.join(there, [*keys, "__salt"], how).drop("__salt")
