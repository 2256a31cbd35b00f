"""Resumable runs: only what is pending is processed, and the output is appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def done_keys(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Keys with committed output rows; none if there is no output yet."""
    try:
        return spark.read.schema(f"{key} {kind}").parquet(path).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{key} {kind}")


def incremental_run(df: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Process the rows whose key has no output yet and append the result; gives the number of keys processed.

    Committed rows are the marker, so that a broken run is tried again and a run after a full one adds nothing; a null
    key is a key like others.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    done = done_keys(spark, path, key, kind).withColumnRenamed(key, "__done")
    pending = df.join(done, F.col(key).eqNullSafe(F.col("__done")), "left_anti")
    n = pending.select(key).distinct().count()
    if n:
        process(pending).write.mode("append").parquet(path)
    return n


def incremental_stream(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """The same for files that arrive in a folder: each is processed once, and the call returns when all that is there is done."""
    rows = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_keys(rows: DataFrame, key: str, seen: DataFrame | None) -> DataFrame:
    """(key): the different keys of rows that are not among seen (key); a null key is a key like others."""
    keys = rows.select(key).distinct()
    return keys if seen is None else keys.join(seen.select(F.col(key).alias("__seen")), F.col(key).eqNullSafe(F.col("__seen")), "left_anti")


def keyed_stream(spark: SparkSession, source: str, schema: str, key: str, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """As incremental_run for files that arrive in a folder: rows whose key came in an earlier batch are not processed again.

    With one file in a batch the rows are those of an incremental_run for each file; they do not depend on how files are cut as
    long as rows of one key are equal. What is done is in the checkpoint: a run after a stop, also in another session, goes on,
    and a batch that broke is done again under its number, in the place of what it left. Returns when all that is there is done.

    Each batch writes its new keys to `keys` in the checkpoint and is compared with those of the batches before it, by joins; a batch
    reads the column of all earlier keys, so that batches should be large beside the history.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    keys = f"{checkpoint.rstrip('/')}/keys"
    kind = rows.schema[key].dataType.simpleString()

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        seen = session.read.schema(f"`{key}` {kind}, batch bigint").parquet(keys).where(F.col("batch") < number) if number else None  # what a broken batch left is not read
        new_keys(df, key, seen).write.mode("overwrite").parquet(f"{keys}/batch={number}")
        new = session.read.schema(f"`{key}` {kind}").parquet(f"{keys}/batch={number}").withColumnRenamed(key, "__new")
        fresh = df.join(new, F.col(key).eqNullSafe(F.col("__new")), "left_semi")
        process(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
