"""Cut lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Only where the session names no shared folder, as in tests on one machine.
LOCAL_DIR = "/tmp/checkpoints"
#: The tables written in the innermost temporary() block, if there is one.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which only a session on one machine may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return (folder or LOCAL_DIR).rstrip("/") + "/pairline"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that cut() writes inside; what is read later has to be cut with lasting=True."""
    own: list[str] = []
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
        for folder in own:
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: what follows does not compute it anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting and (own := _written.get()) is not None:
        own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nobody reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if shared_dir(spark).split(":", 1)[-1].lstrip("/") not in folder:
            raise ValueError(f"{folder} is not below the shared folder")
        _delete(spark, folder)
