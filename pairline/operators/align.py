"""Global alignment of two captions' words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def align(x: list[str], y: list[str]) -> tuple[int, list[int]]:
    """Score and, for each word of y, the position in x that it is aligned with (-1: inserted).

    Match 1, mismatch -1, gap 0; walking back, ties prefer a gap in x, then a gap in y, then the diagonal.

    Two gaps beat a mismatch, so neighbouring cells of a row differ by 0 or 1. A row of the table is one integer, with
    bit j set where cell j + 1 is not above cell j, and follows from the row before in a few operations on
    integers. Only every sqrt(n)-th row is kept; the rows between are made again on the way back.
    """
    n, m = len(x), len(y)
    full, where = (1 << m) - 1, {}
    for j, word in enumerate(y):
        where[word] = where.get(word, 0) | 1 << j

    def following(row: int, word: str) -> int:
        met = row & where.get(word, 0)
        return (row + met | row - met) & full

    step, row, kept = math.isqrt(n) + 1, full, [full]
    for i, word in enumerate(x, 1):
        row = following(row, word)
        if i % step == 0:
            kept.append(row)
    score, mapped, i, first, rows = m - row.bit_count(), [-1] * m, n, n + 1, []
    rises = full & ~row  # of row i, up to the word of y that is reached
    while rises:
        j = rises.bit_length()
        if first > i - 1:
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for word in x[first : i - 1]:
                rows.append(following(rows[-1], word))
        above = ~rows[i - 1 - first] & (1 << j) - 1
        i -= 1
        if above.bit_count() == rises.bit_count():
            rises = above
        else:
            mapped[j - 1] = i
            rises = above & ~(1 << j - 1)
    return score, mapped


def align_captions(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, score, mapping) for each pair of word arrays; null arrays are empty ones."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [align([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(batch[before], batch[after], strict=True)]
            yield pd.DataFrame({key: batch[key], "score": [s for s, _ in both], "mapping": [m for _, m in both]})

    return pairs.select(key, before, after).mapInPandas(run, f"{key} {kind}, score long, mapping array<long>")
