"""Token counts by offset-mapped attribution.

A row's text fields are joined by line feeds to one document, which is encoded once and whole with a byte-level
vocabulary. The tokens' byte lengths add up to their spans in the document; the spans of the sections (the lines of
each field, or whole fields) are intervals of the same axis, and sorting the token starts and ends into
the section starts joins the two. A token that crosses a boundary is allocated by the rule: "first" gives it to
the section of its first byte, "most" to the one that holds most of its bytes (the first of equals). The line feed
after a section belongs to it.

Defined results: a null field is an empty one; an empty document has no token and one section for each field; equal
rows are counted alike; sections without tokens count 0; an empty table gives no rows; columns of the
input keep their names and values, result columns replace any of the same name. Sections add up to n_tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairline.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Encoder:
    """A byte-level vocabulary with the byte length of each token."""

    def __init__(self, path: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte offset at which each token of the text ends."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


def section_starts(fields: list[str], by_line: bool) -> np.ndarray:
    """Byte offsets at which the sections of the joined fields start."""
    starts, at = [], 0
    for field in fields:
        starts.append(at)
        raw = field.encode()
        if by_line:
            feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            starts += (feeds + 1 + at).tolist()
        at += len(raw) + 1
    return np.array(starts, np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary."""
    if not len(ends):
        return np.zeros(len(starts), np.int64), 0
    begins = np.append(0, ends[:-1])
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    own, crossing = first.copy(), np.flatnonzero(first != last)
    if rule == "most":
        for i in crossing.tolist():
            edges = np.concatenate([[begins[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]])
            own[i] += int(np.diff(edges).argmax())
    return np.bincount(own, minlength=len(starts)), len(crossing)


def count_tokens(df: DataFrame, fields: list[str], by_line: bool = True, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with n_tokens, n_sections, n_crossing and section_tokens (in order of the sections)."""
    if rule not in ("first", "most"):
        raise ValueError(f"no such rule: {rule}")
    small_batches(df.sparkSession)
    added = ("n_tokens", "n_sections", "n_crossing", "section_tokens")
    kept = df.select(*[c for c in df.columns if c not in added])
    asked = kept.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__field{i}") for i, c in enumerate(fields)])
    encoder: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encoder:
            encoder.append(Encoder(vocabulary))
        for batch in batches:
            columns = batch.columns[: batch.num_columns - len(fields)]
            counts, totals, crossings = [], [], []
            for own in zip(*(c.to_pylist() for c in batch.columns[len(columns) :]), strict=True):
                starts = section_starts(list(own), by_line)
                each, crossing = attribute(encoder[0].ends("\n".join(own)), starts, rule)
                counts.append(each)
                totals.append(int(each.sum()))
                crossings.append(crossing)
            arrays = [*columns, pa.array(totals, pa.int64()), pa.array([len(c) for c in counts], pa.int64()), pa.array(crossings, pa.int64()), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[: len(columns)], *added])

    fields_out = [f"`{c.replace('`', '``')}` {t}" for c, t in kept.dtypes]
    return asked.mapInArrow(run, ", ".join([*fields_out, "n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"]))
