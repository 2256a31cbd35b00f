"""Sharding by histogram sort: near-equal bytes in each shard, found by counting alone.

The sort key of a row is (hash of its text, hash of its id). Rounds of one aggregate each count
the exact bytes below candidate boundaries of the key, over all partitions; between rounds only
the interval that holds a splitter is probed more finely. A splitter stands as soon as a boundary is
within the tolerance. Equal texts have one first key, so that they stay in one shard, unless their
group holds so many bytes that no boundary around it is within `group_tolerance`; then the group is cut
by the second key. With the splitters known, a row's shard is an expression of its own key, and rows are
exchanged once, to be numbered in ranges of shards that are counted beforehand.

Defined results: a null text has no bytes and counts one byte, as each row does for its end; null texts
are one group; equal rows (same id and text) go to one shard; an empty table gives no rows; columns of
the input keep their names and values, result columns replace any of the same name.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairline.llm.common import cut

#: Allowed distance of a splitter from its ideal place, as a share of a shard; the same to keep equal texts together.
TOLERANCE, GROUP_TOLERANCE = 0.005, 0.05
#: Boundaries counted for each splitter in a round; rows in a range that one task numbers.
PROBES, RANGE_ROWS = 64, 4000
KEY_END = 1 << 63


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keys_of(id_col: str, text_col: str) -> dict[str, Column]:
    """First and second sort key, each uniform in [0, 2**63)."""
    return {"__k1": F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 1), "__k2": F.shiftrightunsigned(F.xxhash64(F.lit("shard"), F.col(id_col)), 1)}


def _histogram(keys: DataFrame, key: str, brackets: list[tuple[int, int]], probes: int) -> list[list[int]]:
    """Bytes in each of `probes` equal parts of each bracket [low, high); the brackets do not overlap."""
    part = F.lit(None).cast("long")
    for k, (low, high) in enumerate(brackets):
        width = -(-(high - low) // probes)
        inside = F.col(key).between(F.lit(low), F.lit(high - 1))
        part = F.when(inside, F.lit(k * probes) + F.expr(f"(`{key}` - {low}L) div {width}L")).otherwise(part)
    counted = keys.groupBy(part.alias("part")).agg(F.sum("__size").alias("bytes")).where("part is not null").collect()
    out = [[0] * probes for _ in brackets]
    for r in counted:  # at most brackets * probes rows
        out[r["part"] // probes][r["part"] % probes] = r["bytes"]
    return out


def _search(keys: DataFrame, key: str, targets: dict[int, float], base: int, tolerance: float, probes: int) -> tuple[dict[int, int], dict[int, tuple[int, int, int]]]:
    """Boundaries of `key` near the targets (bytes below), and, for targets inside one single key, (key, bytes below it, its bytes)."""
    found, single = {}, {}
    first = probes * max(1, len(targets))
    open_ = {j: (0, KEY_END, base) for j in targets}
    while open_:
        brackets = sorted({(low, high) for low, high, _ in open_.values()})
        n = first if len(brackets) == 1 else probes
        parts = dict(zip(brackets, _histogram(keys, key, brackets, n), strict=True))
        after = {}
        for j, (low, high, below) in open_.items():
            width = -(-(high - low) // n)
            at, here = low, below
            for k, held in enumerate(parts[low, high]):
                at = low + k * width
                if here + held > targets[j] or at + width >= high:
                    break
                here += held
            ends = [(abs(here - targets[j]), at), (abs(here + held - targets[j]), min(at + width, high))]
            if min(ends)[0] <= tolerance:
                found[j] = min(ends)[1]
            elif width == 1:
                single[j] = (at, here, held)
            else:
                after[j] = (at, min(at + width, high), here)
        open_ = after
    return found, single


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE, probes: int = PROBES) -> list[tuple[int, int]]:
    """shards - 1 boundaries (first key, second key) in order; keys has __k1, __k2 and __size."""
    total = keys.agg(F.sum("__size")).first()[0] or 0
    share = total / shards
    targets = {j: share * j for j in range(1, shards)}
    if not total or not targets:
        return [(0, 0)] * len(targets)
    found, single = _search(keys, "__k1", targets, 0, tolerance * share, probes)
    out = {j: (k1, 0) for j, k1 in found.items()}
    groups: dict[tuple[int, int], dict[int, float]] = {}
    for j, (k1, below, held) in single.items():
        off, at = min((abs(below - targets[j]), k1), (abs(below + held - targets[j]), k1 + 1))
        if off <= group_tolerance * share:
            out[j] = (at, 0)
        else:
            groups.setdefault((k1, below), {})[j] = targets[j]
    for (k1, below), own in groups.items():  # fewer than there are shards
        inner, ties = _search(keys.where(F.col("__k1") == k1), "__k2", own, below, tolerance * share, probes)
        out |= {j: (k1, k2) for j, k2 in inner.items()} | {j: (k1, k2) for j, (k2, _, _) in ties.items()}
    return [out[j] for j in sorted(out)]


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below the row's key."""
    shard = F.lit(0)
    for k1, k2 in bounds:
        if k1 >= KEY_END:
            continue
        above = F.col("__k1") > k1 if k2 >= KEY_END else (F.col("__k1") > k1) | ((F.col("__k1") == k1) & (F.col("__k2") >= k2))
        shard = shard + F.when(above, 1).otherwise(0)
    return shard.cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> DataFrame:
    """docs with size, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    kept = docs.select(*[c for c in docs.columns if c not in ("size", "shard", "slot", "__k1", "__k2", "__size")])
    keyed = kept.withColumns({**keys_of(id_col, text_col), "__size": size_of(F.col(text_col))})
    keys = cut(keyed.select("__k1", "__k2", "__size"), "keys")
    shard = shard_of(splitters(keys, shards, tolerance, group_tolerance))
    bits = max(0, min(16, ceil(log2(max(1, keys.count() / (shards * RANGE_ROWS))))))
    ranges = {"__shard": shard, "__range": F.shiftright("__k2", 63 - bits) if bits else F.lit(0).cast("long")}
    counts = keys.withColumns(ranges).groupBy("__shard", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__shard", "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    if shards << bits <= 1 << 16:
        offsets = F.broadcast(offsets)
    number = F.row_number().over(Window.partitionBy("__shard", "__range").orderBy("__k1", "__k2", "__size"))
    out = keyed.withColumns(ranges).withColumn("__number", number).join(offsets, ["__shard", "__range"])
    return out.select(*kept.columns, F.col("__size").alias("size"), F.col("__shard").alias("shard"), (F.col("__before") + F.col("__number") - 1).alias("slot"))
