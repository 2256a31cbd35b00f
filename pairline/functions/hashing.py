"""Seeded, reproducible randomness: a hash of the row's key instead of a generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO60 = float(1 << 60)


def hash_long(seed: str, *keys: Column | str) -> Column:
    """The first 60 bits of md5('seed:key:...') as a long."""
    parts = [F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def hash_uniform(seed: str, *keys: Column | str) -> Column:
    """Uniform in [0, 1)."""
    return hash_long(seed, *keys).cast("double") / F.lit(TWO60)
