"""Splits, shards and samples. All randomness is a hash of the row's key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.functions.hashing import hash_long, hash_uniform
from pairline.operators.order import first_rows, index_rows
from pairline.sources.scratch import cut

#: Rounds of a permutation; times that a value outside of the domain is permuted again: half of them or more are inside each time.
ROUNDS, WALK = 6, 128


def array_split_part(idx: Column, n: int, parts: int) -> Column:
    """Part of row idx when n rows are cut into contiguous parts, the first n mod parts being one longer."""
    size, longer = divmod(n, parts)
    edge = longer * (size + 1)
    rest = longer + F.floor((idx - edge) / size) if size else F.lit(parts)
    return F.when(idx < edge, F.floor(idx / (size + 1))).otherwise(rest).cast("long")


def permuted_partition(df: DataFrame, key: str, seed: str, parts: int) -> DataFrame:
    """df with its place in a seeded permutation and the part that it falls in."""
    indexed = index_rows(df.withColumn("__h", hash_long(seed, key)), "__h", key, name="place").drop("__h")
    return indexed.withColumn("part", array_split_part(F.col("place"), df.count(), parts))


def array_split(df: DataFrame, key: str, parts: int) -> DataFrame:
    indexed = index_rows(df, key)
    return indexed.withColumn("part", array_split_part(F.col("idx"), df.count(), parts))


def strided_shard(df: DataFrame, key: str, parts: int, pad: bool = False) -> DataFrame:
    """Row i in shard i mod parts; with pad the first rows are repeated until shards are equally long."""
    indexed = index_rows(df, key)
    if pad:
        n = df.count()
        indexed = cut(indexed, "indexed")
        short = -n % parts
        times = -(-short // n) if n else 0
        more = indexed.withColumn("__t", F.explode(F.sequence(F.lit(1), F.lit(max(times, 1))))).withColumn("idx", F.col("idx") + F.col("__t") * n).where(F.col("idx") < n + short).drop("__t")
        indexed = indexed.union(more) if short and n else indexed
    return indexed.withColumn("shard", F.pmod("idx", F.lit(parts)))


def even_shards_drop_tail(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Contiguous shards of floor(n / parts) rows; the rest is left out."""
    size = df.count() // parts
    return index_rows(df, key).where(F.col("idx") < size * parts).withColumn("shard", F.floor(F.col("idx") / max(size, 1)))


def budget_shards(prompts: DataFrame, key: str, n_samples: int, shards: int) -> DataFrame:
    """(key, shard, n): n_samples draws of each prompt cut into shards of equal budget; a prompt may lie in two, the last takes the rest."""
    total = prompts.count() * n_samples
    budget = max(1, -(-total // shards))
    first = F.col("idx") * n_samples
    spans = index_rows(prompts.select(key), key).withColumn("shard", F.explode(F.sequence(F.floor(first / budget), F.floor((first + n_samples - 1) / budget))))
    n = F.least(first + n_samples, (F.col("shard") + 1) * budget) - F.greatest(first, F.col("shard") * budget)
    return spans.select(key, "shard", n.cast("long").alias("n"))


def ratio_split(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.9, 0.05, 0.05)) -> DataFrame:
    """An ordered table cut at floor(ratio * n) into train, val and test; the ratios must add up to 1 exactly."""
    if sum(ratios) != 1:
        raise ValueError("ratios must add up to 1")
    n = df.count()
    a, b = math.floor(ratios[0] * n), math.floor((ratios[0] + ratios[1]) * n)
    return index_rows(df, key).withColumn("split", F.when(F.col("idx") < a, "train").when(F.col("idx") < b, "val").otherwise("test"))


def group_split(df: DataFrame, group: str, seed: str, train: float = 0.9, val: float = 0.05) -> DataFrame:
    """Groups shuffled and cut at floor(0.9 n) and floor(0.05 n) more; each row follows its group."""
    groups = df.select(group).distinct()
    placed = index_rows(groups.withColumn("__h", hash_long(seed, group)), "__h", group, name="__place").drop("__h")
    n = groups.count()
    a, b = int(train * n), int(train * n) + int(val * n)
    named = placed.select(group, F.when(F.col("__place") < a, "train").when(F.col("__place") < b, "val").otherwise("test").alias("split"))
    return df.join(named, group)


def first_n_accepted(df: DataFrame, key: str, accepted: Column, n: int, done: int = 0) -> DataFrame:
    """The first n - done accepted rows in order of key, selected by counting; any of equal keys."""
    return first_rows(df.where(accepted), key, n - done)


def sample_n(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first n rows of a seeded permutation, selected by counting; an error if there are fewer."""
    if df.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return first_rows(df.withColumn("__h", hash_long(seed, key)), "__h", n, key).drop("__h")


def one_per_group(df: DataFrame, group: str, member: str, seed: str) -> DataFrame:
    """One member of each group, drawn by hash."""
    return df.groupBy(group).agg(F.min_by(member, F.struct(hash_long(seed, group, member), F.col(member))).alias(member))


def permuted(i: Column, domain: int, seed: str, *keys: str) -> Column:
    """i's place in a permutation of 0 ... domain - 1 that depends on the seed and the keys.

    Rounds in turn change the upper bits by a hash of the lower ones and the lower by one of the upper, which can be undone, so
    that no two i meet. Where the domain is no power of two, what falls outside of it is permuted again until it is inside.
    """
    bits = max(1, (domain - 1).bit_length())
    low_bits = bits // 2
    high_bits = bits - low_bits

    def once(x: Column) -> Column:
        low, high = x.bitwiseAND(F.lit((1 << low_bits) - 1)), F.shiftright(x, low_bits)
        for r in range(ROUNDS):
            if r % 2:
                low = low.bitwiseXOR(F.pmod(hash_long(f"{seed}/{r}", *keys, high), F.lit(1 << low_bits)))
            else:
                high = high.bitwiseXOR(F.pmod(hash_long(f"{seed}/{r}", *keys, low), F.lit(1 << high_bits)))
        return F.shiftleft(high, low_bits).bitwiseOR(low)

    start = i.cast("long")
    if domain == 1 << bits:
        return once(start)
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(start), lambda x, _: F.when(x < domain, x).otherwise(once(x)))
    return F.when(F.assert_true(inside < domain, F.lit("a walk did not end")).isNull(), inside)


def draw_seeds(prompts: DataFrame, key: str, n: int, seed: str, redraw: bool = True, bits: int = 32) -> DataFrame:
    """(key, draw, seed): distinct seeds of each prompt. redraw: exactly n, by a permutation of all seeds; else up to n, collisions skipped."""
    if redraw and n > 1 << bits:
        raise ValueError(f"there are no {n} different seeds of {bits} bits")
    drawn = prompts.select(key).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>")))
    if redraw:
        return drawn.withColumn("seed", permuted(F.col("draw"), 1 << bits, seed, key))
    hashed = drawn.withColumn("seed", F.pmod(hash_long(seed, key, "draw"), F.lit(1 << bits)))
    return hashed.groupBy(key, "seed").agg(F.min("draw").alias("draw")).select(key, "draw", "seed")


def draw_params(draws: DataFrame, bounds: dict[str, tuple[float, float]], seed: str, *keys: str) -> DataFrame:
    """draws with a uniform value for each named parameter."""
    return draws.withColumns({c: F.lit(low) + hash_uniform(f"{seed}/{c}", *keys) * F.lit(high - low) for c, (low, high) in bounds.items()})


def flip_variant(variants: DataFrame, key: str, path: str, seed: str) -> DataFrame:
    """Of each row's variants that exist one by hash; an error if none exists."""
    best = F.min(F.when(F.col("exists"), F.struct(hash_long(seed, key, path).alias("h"), F.col(path).alias("path"))))
    drawn = variants.groupBy(key).agg(best.alias("__best"), F.count_if("exists").alias("n_variants"))
    check = F.assert_true(F.col("n_variants") > 0, F.concat(F.lit("no variant of "), F.col(key).cast("string")))
    return drawn.where(check.isNull()).select(key, F.col("__best.path").alias(path), "n_variants")


def seed_manifest(images: DataFrame) -> DataFrame:
    """(folder, seeds): each folder's seeds in the order of their file names (10_0 before 9_0)."""
    named = images.where("side = 0").select("folder", F.col("seed").cast("string").alias("seed")).distinct()
    ordered = F.array_sort(F.collect_list(F.concat("seed", F.lit("_0"))))
    return named.groupBy("folder").agg(ordered.alias("names")).select("folder", F.transform("names", lambda x: F.substring_index(x, "_", 1)).alias("seeds"))
