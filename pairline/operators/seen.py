"""Seen keys without rereading the history: Bloom filters beside a stored table of keys, and exact confirmation of hits.

A filter is a table: a row for each block with eight words of 64 bits. A key falls into one block and sets one bit in each
word, so that building is one aggregation with bit_or, merging two filters the same aggregation again, and a look-up one
join by block that tests eight bits. Every run appends the filter of its own keys; the history itself, dealt into
buckets by key, is read for the buckets of hits only, and not at all if nothing hits. A filter has no false negatives, and hits
are confirmed on the history, so that results are exact however full it is; a full one costs reading.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairline.sources.scratch import cut
from pairline.sources.store import Store

#: Words of a block and bits of a word (fixed by the layout); bits for each expected key, which leaves under one false hit in a hundred.
WORDS, BITS, BITS_PER_KEY = 8, 64, 12
NAMES = [f"w{j}" for j in range(WORDS)]


def n_blocks(expected: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, -(-expected * bits_per_key // (WORDS * BITS)))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def masks(key: Column) -> list[Column]:
    """For each word, the one bit of the key: six bits of one hash for each of the eight words."""
    bits = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(BITS - 1)).cast("int") for j in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 ... w7) of the keys that are not null."""
    rows = keys.where(F.col(key).isNotNull()).select(block_of(F.col(key), blocks).alias("block"), *[m.alias(n) for m, n in zip(masks(F.col(key)), NAMES, strict=True)])
    return rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in NAMES])


def merge_filters(*filters: DataFrame) -> DataFrame:
    """One filter for the keys of all; all have equally many blocks."""
    return reduce(DataFrame.unionByName, filters).groupBy("block").agg(*[F.bit_or(n).alias(n) for n in NAMES])


def may_hold(rows: DataFrame, key: str, bloom: DataFrame, blocks: int, name: str = "hit") -> DataFrame:
    """rows with `name`: false if the filter proves that the key is not among its own, else true; a null key is no hit."""
    own = rows.withColumn("__block", block_of(F.col(key), blocks))
    met = own.join(bloom.select(F.col("block").alias("__block"), *[F.col(n).alias(f"__{n}") for n in NAMES]), "__block", "left")
    all_set = reduce(Column.__and__, [F.col(f"__{n}").bitwiseAND(m) != 0 for n, m in zip(NAMES, masks(F.col(key)), strict=True)])
    return met.withColumn(name, F.coalesce(all_set, F.lit(False)) & F.col(key).isNotNull()).drop("__block", *[f"__{n}" for n in NAMES])


class SeenKeys:
    """The keys of one column that earlier runs saw, as a bucketed history with its filter."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", expected: int = 1_000_000, buckets: int = 64):
        """kind: the key's type; expected: how many keys the filter is laid out for."""
        self.spark, self.path = spark, path.rstrip("/")
        self.history = Store(spark, f"{self.path}/keys", ("key",), f"key {kind}", buckets)
        schema = "block bigint, " + ", ".join(f"{n} bigint" for n in NAMES) + ", blocks bigint"
        self.filters = Store(spark, f"{self.path}/filters", ("block",), schema, 1)
        first = self.filters.read().select("blocks").first()
        self.blocks = first["blocks"] if first else n_blocks(expected)
        #: buckets of the history that the last look-up read
        self.read_buckets: set[int] = set()

    def add(self, df: DataFrame, key: str) -> None:
        """Remember the keys of df that are not null. Twice the same is harmless.

        The filter is committed before the keys, so that a key in the history is in the filter whenever a run breaks.
        """
        keys = cut(df.select(F.col(key).alias("key")).where("key is not null").distinct(), "keys")
        self.filters.append(bloom_filter(keys, "key", self.blocks).withColumn("blocks", F.lit(self.blocks).cast("long")))
        self.history.append(keys)

    def unseen(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key was not added; a null key was never seen."""
        bloom = merge_filters(self.filters.read().drop("blocks"))
        asked = cut(may_hold(rows, key, bloom, self.blocks, "__hit"), "asked")
        hits = asked.where("__hit").select(F.col(key).alias("key"))
        self.read_buckets = self.history.touched(hits)
        clear = asked.where(~F.col("__hit"))
        if not self.read_buckets:
            return clear.drop("__hit")
        known = self.history.read(self.read_buckets).withColumnRenamed("key", "__key").distinct()
        missed = asked.where("__hit").join(known, F.col(key) == F.col("__key"), "left_anti")
        return clear.unionByName(missed).drop("__hit")


def resume_unseen(rows: DataFrame, seen: dict[str, SeenKeys]) -> DataFrame:
    """As curate.resume_unseen, with the seen keys of each column in a filter and a history."""
    for key, keys in seen.items():
        rows = keys.unseen(rows, key)
    return rows
