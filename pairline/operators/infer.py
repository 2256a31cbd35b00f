"""Model-backed maps: one user function for batches, created once for each task."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

Batch = pd.DataFrame
Model = Callable[[Batch], Batch]


def by_length(batches: Iterator[Batch], column: str, most: int) -> Iterator[Batch]:
    """The same rows in the same order, in batches whose texts have `most` characters together at most; a longer text is alone.

    A batch goes on over the ends of Arrow batches, so that a model sees even loads however Spark cuts its input; null counts as empty.
    """
    held, size = [], 0
    for batch in batches:
        lengths = [len(t) if isinstance(t, str) else 0 for t in batch[column]]
        low = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield pd.concat([*held, batch.iloc[low:i]], ignore_index=True)
                held, size, low = [], 0, i
            size += n
        if low < len(batch):
            held.append(batch.iloc[low:])
    if held:
        yield pd.concat(held, ignore_index=True)


def batch_infer(df: DataFrame, init: Callable[[], Model], schema: str, profile: ResourceProfile | None = None, length_of: str | None = None, most: int = 1 << 16) -> DataFrame:
    """Apply init()(batch) to all rows; init runs once in each task.

    profile: what a task of this stage needs, a GPU for instance; other stages keep the session's resources. length_of: a
    text column by whose characters batches are cut, `most` in each, instead of by rows.
    """

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        model = init()
        for batch in by_length(batches, length_of, most) if length_of else batches:
            yield model(batch)

    return df.mapInPandas(run, schema, profile=profile)


def infer_with_retry(df: DataFrame, init: Callable[[], Callable[[Batch, int], Batch]], accept: Callable[[Batch], pd.Series], schema: str, attempts: int = 4, profile: ResourceProfile | None = None, length_of: str | None = None, most: int = 1 << 16) -> DataFrame:
    """Rows get up to `attempts` tries; each is taken only if accept() says so ('' or a reason). schema: the model's columns.

    profile, length_of and most are those of batch_infer. The result has `attempt` (the last one made), `reason` ('' if accepted) and the model's columns (of the last try).
    """

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        model = init()
        for batch in by_length(batches, length_of, most) if length_of else batches:
            left, done = batch.reset_index(drop=True), []
            for attempt in range(1, attempts + 1):
                if left.empty:
                    break
                out = model(left, attempt)
                reason = accept(out)
                last = (reason == "") | (attempt == attempts)
                done.append(out[last].assign(attempt=attempt, reason=reason[last]))
                left = left[~last.to_numpy()]
            if done:
                yield pd.concat(done, ignore_index=True)

    return df.mapInPandas(run, schema + ", attempt int, reason string", profile=profile)


def capture_errors(df: DataFrame, init: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Apply init()(row) row by row; a row that raises keeps its error in `error`, its other columns being null."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        model = init()
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append({**model(row), "error": None})
                except Exception as e:  # noqa: BLE001  the row's error is the result
                    rows.append({**{n: row.get(n) for n in names if n in row}, "error": traceback.format_exception_only(e)[-1].strip()})
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return df.mapInPandas(run, schema + ", error string")
