"""How filters interact: what each order of them removes, by sorted posting lists.

Rows get a gapless number in order of (part, id) from a range sort, and ranges of BLOCK numbers are blocks, so
that a part that holds a third of all rows lies in many of them. In each block a part has one posting list for each
filter, the ascending numbers of the rows that fail it, and one for each kind of row whose loss is counted. For
every filter and every set of other filters applied before it, the lists of the set are merged into their union,
the filter's list loses what the union holds (what it removes after them, whatever their order), and what is left
meets the lists of kinds. A merge looks up the shorter list's numbers in the longer one, each search going on
from the last, so that it gallops over stretches that only one list has. These sizes, k * 2**(k-1) for each block and part,
add up over blocks; the table of orders, k! * k fixed rows, picks from the sums.

Defined results: a null part is the empty string; a null condition is not failed; rows without an id come first and
count like others, but are neither copies nor copied; repeated rows each count; a row is of a kind if
any label of its id says so, of none if it has no label; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.llm.common import cut, spread_join
from pairline.operators.order import index_rows

#: Rows in a block; filters that are audited at most, as there are k! orders of them.
BLOCK, MOST_FILTERS = 1 << 16, 7


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of the ascending list a that the ascending list b has not."""
    if not len(a) or not len(b):
        return a
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        return a[b[np.minimum(at, len(b) - 1)] != a]
    at = np.searchsorted(a, b)
    at = at[a[np.minimum(at, len(a) - 1)] == b]
    keep = np.ones(len(a), bool)
    keep[at] = False
    return a[keep]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both lists' numbers, ascending."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    fresh = difference(short, long)
    return np.insert(long, np.searchsorted(long, fresh), fresh) if len(fresh) else long


def block_sizes(lists: list[np.ndarray], kinds: list[np.ndarray], n: int) -> list[tuple[int, ...]]:
    """(set, filter, kept, removed, redundant, one more for each kind) for all filters and sets of others; sets are bit masks."""
    unions = [np.zeros(0, np.int64)]
    for s in range(1, 1 << len(lists)):
        lowest = (s & -s).bit_length() - 1
        unions.append(union(unions[s & (s - 1)], lists[lowest]))
    out = []
    for s, before in enumerate(unions):
        for f, own in enumerate(lists):
            if not s >> f & 1:
                gone = difference(own, before)
                out.append((s, f, n - len(unions[s | 1 << f]), len(gone), len(own) - len(gone), *(len(gone) - len(difference(gone, k)) for k in kinds)))
    return out


def posting_lists(rows: DataFrame, filters: list[str], kinds: list[str], block: int = BLOCK) -> DataFrame:
    """(part, block, n and an ascending array of row numbers for each filter and kind); rows has part, id, place and these as booleans."""
    numbered = index_rows(rows, "part", "id", "place", name="number")
    lists = [F.array_sort(F.collect_list(F.when(F.col(c), F.col("number")))).alias(c) for c in [*filters, *kinds]]
    return numbered.groupBy("part", F.floor(F.col("number") / block).alias("block")).agg(F.count("*").alias("n"), *lists)


def set_sizes(postings: DataFrame, filters: list[str], kinds: list[str]) -> DataFrame:
    """(part, set, filter, kept, removed, redundant, a column for each kind), summed over blocks."""
    names = ["part", "set", "filter", "kept", "removed", "redundant", *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, n, *lists = (batch.column(c)[i] for c in range(batch.num_columns))
                lists = [x.values.to_numpy(zero_copy_only=False) for x in lists]
                sizes = block_sizes(lists[: len(filters)], lists[len(filters) :], n.as_py())
                columns = [pa.array([part.as_py()] * len(sizes), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*sizes, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(["part string", *[f"`{c}` long" for c in names[1:]]])
    sizes = postings.select("part", "n", *filters, *kinds).mapInArrow(run, schema)
    return sizes.groupBy("part", "set", "filter").agg(*[F.sum(c).alias(c) for c in names[3:]])


def orders(filters: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, filter, set of the ones before) for every order of the filters."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(filters[i] for i in order), step, f, before))
            before |= 1 << f
    return out


def repeats(rows: DataFrame, digest: str = "digest") -> DataFrame:
    """rows with `repeated`: whether a smaller id has the same digest."""
    firsts = rows.groupBy(digest).agg(F.min("id").alias("__first"), F.max("id").alias("__last")).where(F.col("__first") < F.col("__last")).drop("__last")
    return spread_join(rows, firsts, [digest], ["place"], "left").withColumn("repeated", F.coalesce(F.col("id") > F.col("__first"), F.lit(False))).drop("__first")


def audit(docs: DataFrame, failures: dict[str, Column], labels: DataFrame, kinds: dict[str, Column], part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", repeated: str | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each part, order and step.

    failures: by name, the condition under which a row of docs fails; repeated: name of one more filter, which fails a text that
    a smaller id has; kinds: by name, the condition on rows of labels (which has id_col) that makes losing the row count.
    The result has part, filter_order, step, kept, removed, redundant, unique_fails, a column for each kind, and shapley
    (what the step's filter removes, summed over all orders).
    """
    spark = docs.sparkSession
    filters = sorted([*failures, *([repeated] if repeated else [])])
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    marks = [F.coalesce(c, F.lit(False)).alias(f"f_{name}") for name, c in failures.items()]
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    place = F.monotonically_increasing_id().alias("place")
    rows = cut(docs.select(F.col(id_col).alias("id"), part, place, *marks, *([digest.alias("digest")] if repeated else [])), "audited")
    if repeated:
        rows = repeats(rows).withColumnRenamed("repeated", f"f_{repeated}").drop("digest")
    if kinds:
        told = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"k_{name}") for name, c in kinds.items()])
        rows = spread_join(rows, told, ["id"], ["place"], "left")
    filter_names, kind_names = [f"f_{x}" for x in filters], [f"k_{x}" for x in kinds]
    sizes = cut(set_sizes(posting_lists(rows, filter_names, kind_names, block), filter_names, kind_names), "sizes")
    everyone = (1 << len(filters)) - 1
    weight = F.element_at(F.array(*[F.lit(factorial(n) * factorial(len(filters) - 1 - n)) for n in range(len(filters))]), F.bit_count("set") + 1)
    alone = F.col("set") == reduce(lambda other, f: F.when(F.col("filter") == f, everyone ^ (1 << f)).otherwise(other), range(len(filters)), F.lit(None))
    whole = sizes.groupBy("part", "filter").agg(F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(weight * F.col("removed")).alias("shapley"))
    steps = spark.createDataFrame(orders(filters), "filter_order string, step int, filter long, set long")
    found = sizes.join(F.broadcast(steps), ["set", "filter"]).join(whole, ["part", "filter"])  # steps has as many rows as k filters have orders, times k
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[F.col(f"k_{x}").alias(x) for x in kinds], "shapley")
