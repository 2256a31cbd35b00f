"""Substring search without a scan: posting lists of trigrams, and candidates verified on the text.

The index holds, for each trigram of the lower-cased texts of a column, the ids of the rows that have it, in lists of
bounded length: a task cuts its rows into blocks of BLOCK rows or BLOCK_CHARS characters, so that a trigram of every row is many lists, and
makes the lists of a block by itself: no row for each trigram of a text is shuffled. Lists are sorted by trigram, so that a look-up reads the row groups of the asked trigrams only. A term's rows have all its trigrams:
the rarest few are intersected, and what remains is compared with the term itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairline.operators.browse import facet_search
from pairline.sources.scratch import cut, drop

#: Characters of a gram (fixed by the layout), rows and characters of a block, trigrams of a term that are intersected, candidates that are pushed down or broadcast.
GRAM, BLOCK, BLOCK_CHARS, RAREST, PUSHED, BROADCAST = 3, 1 << 16, 1 << 23, 4, 1000, 200_000


def grams_of(term: str) -> list[str]:
    """The different trigrams of a lower-cased term; none for a shorter one."""
    t = term.lower()
    return sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)})


def posting_lists(most: int, chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map from (id, text) to (gram, block, n, ids), one row for each trigram of a block: up to `most` texts that follow each other in a task, with about `chars` characters.

    A trigram is a number of three times 21 bits here, so that a block is sorted as an array.
    """

    def block_of(ids: list[pa.Array], codes: list[np.ndarray], number: int) -> pa.RecordBatch:
        rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        flat = np.concatenate(codes)
        order = np.argsort(flat, kind="stable")
        grams, starts = np.unique(flat[order], return_index=True)
        offsets = np.append(starts, len(flat)).astype(np.int32)
        named = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        names = pa.array([named[i : i + GRAM] for i in range(0, len(named), GRAM)], pa.string())
        each = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(ids).take(pa.array(rows[order])))
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(grams), number)), pa.array(np.diff(offsets).astype(np.int64)), each], ["gram", "block", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        ids, codes, size, number = [], [], 0, 0
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                c = np.frombuffer(text.as_py().encode("utf-32-le"), "<u4").astype(np.int64)
                if len(c) < GRAM:
                    continue
                ids.append(batch.column("id").slice(i, 1))
                codes.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
                size += len(c)
                if len(codes) >= most or size >= chars:
                    yield block_of(ids, codes, base + number)
                    ids, codes, size, number = [], [], 0, number + 1
        if codes:
            yield block_of(ids, codes, base + number)

    return run


class GramIndex:
    """Posting lists of some text columns, as Parquet in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        """kind: the type of the ids."""
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def build(self, df: DataFrame, id_col: str, columns: tuple[str, ...]) -> None:
        """Index the columns of df, whose ids are unique and not null; null and shorter texts have no trigrams."""
        schema = f"gram string, block bigint, n bigint, ids array<{self.kind}>"
        for column in columns:
            texts = df.where(F.length(column) >= GRAM).select(F.col(id_col).cast(self.kind).alias("id"), F.lower(F.col(column)).alias("text"))
            lists = cut(texts.mapInArrow(posting_lists(BLOCK, BLOCK_CHARS), schema), "lists")  # the range sort reads it twice
            lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{self.path}/{column}")
            drop(lists)

    def lists(self, column: str) -> DataFrame:
        return self.spark.read.schema(f"gram string, block bigint, n bigint, ids array<{self.kind}>").parquet(f"{self.path}/{column}")

    def candidates(self, column: str, term: str) -> DataFrame | None:
        """(id) of the rows that have the rarest trigrams of the term; None for a term without trigrams."""
        grams = grams_of(term)
        if not grams:
            return None
        sizes = self.lists(column).where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # a row for each trigram of the term
        if len(sizes) < len(grams):
            return self.spark.createDataFrame([], f"id {self.kind}")
        rarest = [r["gram"] for r in sorted(sizes, key=lambda r: (r["n"], r["gram"]))[:RAREST]]
        asked = self.lists(column).where(F.col("gram").isin(rarest)).select("block", F.explode("ids").alias("id"))
        return asked.groupBy("id").count().where(F.col("count") == len(rarest)).select("id")


def indexed_search(df: DataFrame, index: GramIndex, id_col: str, statuses: list[str], classes: list[str], terms: dict[str, str]) -> DataFrame:
    """As browse.facet_search; terms of three characters and more are looked up in the index first."""
    rows = df
    for column, term in terms.items():
        found = index.candidates(column, term)
        if found is not None:
            few = found.limit(PUSHED + 1).collect()
            if len(few) <= PUSHED:
                rows = rows.where(F.col(id_col).isin([r["id"] for r in few]))  # reaches the scan
            else:
                found = found.withColumnRenamed("id", "__id")
                rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST else found, F.col(id_col) == F.col("__id"), "left_semi")
    return facet_search(rows, statuses, classes, terms)
