"""Contiguous indexes, numbers within groups, prefix scans and rows by rank that never bring a table or a group into one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairline.sources.scratch import cut, temporary

_LOW = (1 << 33) - 1


def index_rows(df: DataFrame, *order: Column | str, name: str = "idx", start: int = 0) -> DataFrame:
    """df with a gapless 0-based index in the declared order (its ties must be broken by the caller).

    A range sort numbers the rows inside each partition; a table with one row for each partition
    gives the offsets. The sorted rows are written once, so that both passes see the same partitions.
    """
    tagged = cut(df.orderBy(*order).withColumn("__tag", F.monotonically_increasing_id()), "index")
    part = F.shiftright("__tag", 33)
    counts = tagged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    # one row for each partition of the sort, so that the table is small by construction
    joined = tagged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__tag").bitwiseAND(F.lit(_LOW)) + F.lit(start)).drop("__part", "__tag", "__before")


def running_total(df: DataFrame, index: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """df with the sum of value over all rows of smaller index; index is gapless, so that chunks of it are even."""
    chunk = F.floor(F.col(index) / width)
    sums = df.groupBy(chunk.alias("__chunk")).agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = sums.select("__chunk", before.alias("__base"))
    return df.withColumn("__chunk", chunk).join(chunks, "__chunk").withColumn(name, F.col("__base") + inside).drop("__chunk", "__base")


def number_in_groups(df: DataFrame, groups: list[str], order: list[Column | str], name: str = "number", total: str | None = None) -> DataFrame:
    """df with each row's number from 1 in its group (ties must be broken by the caller) and, if asked for, the group's size.

    A range sort by group and order deals a large group over many partitions. Rows are numbered in each (partition, group);
    a table of the groups that lie in several partitions, at most two rows for each partition, gives the offsets.
    """
    tagged = cut(df.orderBy(*groups, *order).withColumn("__tag", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__tag", 33))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = {f"__g{i}": F.col(g) for i, g in enumerate(groups)}
    counts = tagged.groupBy("__part", *groups).agg(F.count("*").alias("__n"))
    spans = counts.withColumns({"__parts": F.count("*").over(whole), "__all": F.sum("__n").over(whole), "__before": F.coalesce(F.sum("__n").over(before), F.lit(0))}).where("__parts > 1")
    spans = spans.select(F.col("__part").alias("__p"), *[c.alias(n) for n, c in own.items()], "__all", "__before")
    here = Window.partitionBy("__part", *groups)
    counted = tagged.withColumn("__here", F.row_number().over(here.orderBy("__tag")))
    if total:
        counted = counted.withColumn("__size", F.count("*").over(here))
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(g)) for n, g in zip(own, groups, strict=True)], F.col("__p") == F.col("__part"))
    out = counted.join(F.broadcast(spans), same, "left").withColumn(name, F.col("__here") + F.coalesce("__before", F.lit(0)))
    if total:
        out = out.withColumn(total, F.coalesce("__all", "__size"))
    return out.drop("__tag", "__part", "__p", *own, "__all", "__before", "__here", "__size")


#: Operations of a scan: the aggregate of many values, and the same of two. Both skip nulls; they must be associative and commutative.
SUM = (F.sum, lambda a, b: F.coalesce(a + b, a, b))
MIN, MAX = (F.min, F.least), (F.max, F.greatest)


def scan(df: DataFrame, index: str, value: Column, operation: tuple[Callable, Callable], name: str, inclusive: bool = True, width: int = 1000, levels: int = 2) -> DataFrame:
    """df with the operation's result over the values of all rows up to each row, itself included or not; index is gapless from 0.

    Chunks of `width` rows are scanned each for itself; what stands before a chunk is a scan over the chunks' results,
    again by chunks, so that the one window without partitions has a row for width ** levels rows. A value that is the
    last one set is the largest of structs (index, value).
    """
    fold, two = operation
    chunk, known, base = f"__chunk{levels}", f"__of{levels}", f"__before{levels}"
    valued = df.withColumns({chunk: F.floor(F.col(index) / width), "__value": value})
    results = valued.groupBy(chunk).agg(fold("__value").alias("__result"))
    if levels > 1:
        chunks = scan(results, chunk, F.col("__result"), operation, base, False, width, levels - 1)
    else:
        chunks = results.withColumn(base, fold("__result").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)))
    inside = fold("__value").over(Window.partitionBy(chunk).orderBy(index).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    joined = valued.withColumn("__inside", inside).join(chunks.select(F.col(chunk).alias(known), base), F.col(chunk) == F.col(known))
    return joined.withColumn(name, two(F.col(base), F.col("__inside"))).drop(chunk, "__value", "__inside", known, *([] if name == base else [base]))


#: Intervals counted in a round of a selection; rows of the last interval that are sorted in the driver.
INTERVALS, LAST_ROWS = 1024, 10_000
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def nth_key(df: DataFrame, key: str, n: int) -> tuple[int, int]:
    """(the n-th smallest key, how many rows have a smaller one), n from 1 to the number of rows; key is a whole number.

    Each round counts the rows of INTERVALS equal intervals and goes on in the one that holds the n-th; null keys come first
    and are not counted.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // INTERVALS)
        inside = df.where(F.col(key).between(low, high))
        counted = inside.groupBy(F.expr(f"(cast(`{key}` as decimal(38, 0)) - {low}) div {width}").alias("at")).count().orderBy("at").collect()  # at most INTERVALS rows
        for r in counted:
            if below + r["count"] >= n:
                break
            below += r["count"]
        low, high = low + r["at"] * width, min(high, low + (r["at"] + 1) * width - 1)
        if low < high and r["count"] <= LAST_ROWS:
            rest = sorted(x[0] for x in df.where(F.col(key).between(low, high)).select(key).collect())  # at most LAST_ROWS
            found = rest[n - below - 1]
            return found, below + sum(x < found for x in rest)
    return low, below


def first_rows(df: DataFrame, key: str, n: int, *ties: Column | str) -> DataFrame:
    """The n rows of smallest key, then smallest ties (null keys first); all, if there are not more. Not in any order.

    Whole-number keys are selected by counting, so that no row is sorted or moved; other keys by a gapless index.
    """
    if n <= 0:
        return df.limit(0)
    if dict(df.dtypes)[key] not in INTEGRAL:
        return index_rows(df, key, *ties, name="__rank").where(F.col("__rank") < n).drop("__rank")
    with temporary(df.sparkSession):
        kept = cut(df.select(key), "keys")
        nulls, total = kept.where(F.col(key).isNull()).count(), kept.count()
        if nulls < n < total:
            last, below = nth_key(kept, key, n - nulls)
            same = kept.where(F.col(key) == last).count()
    if n >= total:
        return df
    if n <= nulls:
        return index_rows(df.where(F.col(key).isNull()), *(ties or [F.monotonically_increasing_id()]), name="__rank").where(F.col("__rank") < n).drop("__rank")
    more = n - nulls - below
    equal = df.where(F.col(key) == last)
    if more < same:
        equal = index_rows(equal, *(ties or [F.monotonically_increasing_id()]), name="__rank").where(F.col("__rank") < more).drop("__rank")
    return df.where(F.col(key).isNull() | (F.col(key) < last)).unionByName(equal)
