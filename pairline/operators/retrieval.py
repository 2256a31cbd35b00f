"""Nearest neighbours by normalised inner product, exactly; attributes of neighbours, pooling and tiles. quantised.py has the searches over codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairline.functions import vectors as vx
from pairline.sources.scratch import cut

#: Queries that are broadcast at once; the pool is read once for each block of them.
QUERY_BLOCK = 8192
#: Rows of a score matrix.
ROWS = 256


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vx.FLOOR)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(-scores[by_id], kind="stable")[:k]]


def vectors(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), F.col(vector_col).alias("v")).where(F.col(name).isNotNull() & F.col("v").isNotNull())


def knn_exact(pool: DataFrame, queries: DataFrame, k: int, id_col: str = "img_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest of the pool for each query; rows without id or vector take no part.

    The pool stays where it is: QUERY_BLOCK queries are broadcast at a time, each task compares them with its part of
    the pool and passes on the k best of each query. Queries have different ids.
    """
    spark = pool.sparkSession
    asked = vectors(queries, id_col, vector_col, "query_id")
    base = vectors(pool, id_col, vector_col, "id")
    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, id {pool.schema[id_col].dataType.simpleString()}, score double"
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def nearest(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            top = [(np.empty(0, object), np.empty(0)) for _ in names]
            floor = np.full(len(names), -np.inf)
            for batch in batches:
                if batch.empty or not len(names):
                    continue
                ids, p = batch["id"].to_numpy(), units(batch["v"])
                for low in range(0, len(names), ROWS):
                    scores = q[low : low + ROWS] @ p.T
                    least = floor[low : low + ROWS]
                    if len(ids) > k:
                        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                    hits = scores >= least[:, None]
                    for i in np.flatnonzero(hits.any(axis=1)):
                        old_ids, old = top[low + i]
                        all_ids, every = np.concatenate([old_ids, ids[hits[i]]]), np.concatenate([old, scores[i, hits[i]]])
                        kept = best(every, all_ids, k)
                        top[low + i] = all_ids[kept], every[kept]
                        if len(kept) == k:
                            floor[low + i] = every[kept[-1]]
            for low in range(0, len(names), ROWS):
                part = top[low : low + ROWS]
                sizes = [len(s) for _, s in part]
                if any(sizes):
                    yield pd.DataFrame({"query_id": np.repeat(names[low : low + ROWS], sizes), "id": list(np.concatenate([i for i, _ in part])), "score": np.concatenate([s for _, s in part])})

        return run

    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()  # a block of bounded size
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), units(rows["v"]) if len(rows) else np.empty((0, 0))))
        part = ranked(base.mapInPandas(nearest(shared), schema), k)
        if blocks == 1:
            return part
        found.append(cut(part, "nearest"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def gather_by_id(neighbours: DataFrame, attributes: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(query_id, one array for each column): attributes of the neighbours in order of rank; neighbours: (query_id, rank, id)."""
    joined = neighbours.join(attributes.select(F.col(id_col).alias("id"), *columns), "id")
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", *columns)))
    grouped = joined.groupBy("query_id").agg(rows.alias("rows"))
    return grouped.select("query_id", F.col("rows.id").alias("ids"), *[F.col(f"rows.{c}").alias(c) for c in columns])


def mean_pool(tokens: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """(key, pooled): the mean of each item's token vectors, normalised; vectors that are null or hold nulls take no part, one item's are equally long.

    Components above and below zero are summed apart, as lengths, and subtracted at the end: Summarizer's own mean is a running one, whose
    last bits depend on the order of rows, so that components that cancel do not give zero.
    """
    v = vx.doubles(F.col(vector_col))
    sides = F.concat(F.transform(v, lambda x: F.greatest(x, F.lit(0.0))), F.transform(v, lambda x: F.greatest(-x, F.lit(0.0))))
    whole = tokens.where(F.forall(vector_col, lambda x: x.isNotNull())).select(key, array_to_vector(sides).alias("v"))
    sums = whole.groupBy(key).agg(vector_to_array(Summarizer.normL1(F.col("v"))).alias("s"), F.count("*").alias("n"))
    half = (F.size("s") / 2).cast("int")
    mean = F.zip_with(F.slice("s", F.lit(1), half), F.slice("s", half + 1, half), lambda above, below: (above - below) / F.col("n"))
    return sums.select(key, vx.l2_normalise(mean).alias("pooled"))


def tile_grid(images: DataFrame, size: int, overlap: int, most: int, width: str = "w", height: str = "h") -> DataFrame:
    """images with the offsets (x, y) of their tiles: steps of size - overlap, the last tile flush with the border; an image is cut only if both sides are over `most`."""

    def offsets(side: str):
        last = F.col(side) - size
        steps = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(size - overlap)), lambda x: x < last)
        large = (F.col(width) > most) & (F.col(height) > most)
        return F.when(large, F.array_append(steps, last)).otherwise(F.array(F.lit(0)))

    return images.withColumn("x", F.explode(offsets(width))).withColumn("y", F.explode(offsets(height)))
