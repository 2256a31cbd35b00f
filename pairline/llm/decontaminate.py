"""Benchmark decontamination by Wu-Manber search of word windows.

The alphabet is words. A pattern is a window of `n` consecutive words of a benchmark item (an
item of fewer words is one window). For the windows of one length a shift table holds, for
each block of two neighbouring words, how far the search may move when the block stands at the
end of the position looked at; blocks that occur in no window skip a whole window length. Where
the shift is nought, the block's bucket is looked up and the words before it are compared
directly.

Windows are dealt into slices of bounded size; each slice is collected and broadcast, and the
documents pass the slices one after the other in narrow stages, without a shuffle. A slice is
made of single (window, item) pairs, so that neither a large item nor a window shared by many
items makes one too large. No more than IN_FLIGHT slices are broadcast at a time: where a benchmark has more, what each
few of them find in a text is written with the text's hash and their broadcasts are given up, and in the end the findings of a text are joined to
the documents with it.

Defined results: a null text has no words and is clean; a document without words is clean; equal
rows are judged alike and all stay; a window occurs wherever its words do, overlaps included;
benchmark rows without words do nothing, and windows of an item without an id count as hits, but not
as an item; empty tables give no rows or no hits; columns of the input keep their names and
values, the result columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairline.llm.common import cut, small_batches, spread_join

WINDOW_WORDS = 13
#: (window, item) pairs, and bytes of windows, in one broadcast slice.
SLICE_PAIRS, SLICE_BYTES = 100_000, 32 << 20
#: Slices that are broadcast at a time.
IN_FLIGHT = 2
#: Bytes of words stay, in lower case; all others part words. Bytes from 0x80 belong to words.
WORD_BYTES = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Windows of one length, each with its item ids."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern in windows:
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets.setdefault(pattern[-self.block :], {})[pattern[: -self.block]] = windows[pattern]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, item ids) of each occurrence, from left to right."""
        length, block, shift, default = self.length, self.block, self.shift, self.default
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            move = shift.get(key, default)
            if move:
                end += move
                continue
            items = self.buckets[key].get(tuple(words[end - length : end - block]))
            if items is not None:
                yield end - length, items
            end += 1


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping or touching [start, end) spans as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW_WORDS) -> DataFrame:
    """(item string, window string of words parted by blanks, length int), each pair once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("body"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                size = min(n, len(words))
                found = list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))) if words else []
                for part in range(0, len(found), 10_000):
                    some = found[part : part + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array([w.decode() for w in some], pa.string()), pa.array([size] * len(some), pa.int32())], ["item", "window", "length"])

    return items.mapInArrow(windows, "item string, window string, length int").distinct()


def searchers(rows: list) -> list[WuManber]:
    by_length: dict[int, dict] = {}
    for r in rows:
        items = by_length.setdefault(r["length"], {}).setdefault(tuple(r["window"].encode().split(b" ")), [])
        if r["item"] is not None:
            items.append(r["item"])
    return [WuManber(length, windows) for length, windows in sorted(by_length.items())]


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW_WORDS, keep_spans: bool = False) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated; with keep_spans also hit_spans and hit_items.

    hit_spans: [start, end) word positions, merged; hit_items: item ids in string order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pairs = cut(benchmark_windows(benchmark, item_col, item_text, n), "windows")
    count, volume = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    slices = max(1, -(-count // SLICE_PAIRS), -(-volume // SLICE_BYTES))
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "hit_items"]
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).cast("binary").alias("body"))
    if slices <= IN_FLIGHT:
        tables = [spark.sparkContext.broadcast(searchers(part.collect())) for part in _slices(pairs, slices)]
        out = rows.mapInArrow(_search(tables), _found(rows.schema["row"].dataType))
    else:
        text_hash = [F.xxhash64("body").alias("t1"), F.xxhash64(F.lit("2"), "body").alias("t2")]
        parts = list(_slices(pairs, slices))
        found = None
        for at in range(0, slices, IN_FLIGHT):
            tables = [spark.sparkContext.broadcast(searchers(part.collect())) for part in parts[at : at + IN_FLIGHT]]
            texts = rows.select(F.struct(*text_hash).alias("row"), "body")
            hits = texts.mapInArrow(_search(tables, only_hits=True), _found(texts.schema["row"].dataType))
            some = cut(hits.select("row.t1", "row.t2", "spans", "items").dropDuplicates(["t1", "t2"]), "hits")
            for broadcast in tables:
                broadcast.destroy()
            found = some if found is None else found.union(some)
        found = cut(found.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "found")
        keyed = rows.select("row", "body", *text_hash, F.xxhash64(*[F.col("row")[c] for c in kept if c != text_col]).alias("other"))
        joined = spread_join(keyed, found, ["t1", "t2"], ["other"], "left").select("row", "body", "spans", "items")
        out = joined.mapInArrow(_search([]), _found(rows.schema["row"].dataType))
    n_items = F.size("items").cast("long")
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    result = ["n_words", "n_hit", n_items.alias("n_items"), sha.alias("items_sha256"), contaminated.alias("contaminated")]
    spans = [F.col("spans").alias("hit_spans"), F.col("items").alias("hit_items")] if keep_spans else []
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *result, *spans)


def _found(row: T.DataType) -> T.StructType:
    out = T.StructType().add("row", row).add("n_words", T.LongType()).add("n_hit", T.LongType())
    return out.add("spans", T.ArrayType(T.ArrayType(T.LongType()))).add("items", T.ArrayType(T.StringType()))


def _slices(pairs: DataFrame, slices: int) -> Iterator[DataFrame]:
    for k in range(slices):
        yield pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == k) if slices > 1 else pairs


def _search(tables: list, only_hits: bool = False):
    """(row, body, and what is found already: spans, items) to (row, n_words, n_hit, spans, items), by all slices in tables; with only_hits just the rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_spans, all_items = [], [], []
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) if batch.num_columns > 2 else ((None, None) for _ in range(batch.num_rows))
            for body, (spans, items) in zip(batch.column(1), before, strict=True):
                words, spans, items = words_of(body.as_py()), [list(s) for s in spans or []], set(items or [])
                for searcher in (x for table in tables for x in table.value):
                    for start, ids in searcher.find(words):
                        if spans and spans[-1][0] <= start <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], start + searcher.length)
                        else:
                            spans.append([start, start + searcher.length])
                        items.update(ids)
                sizes.append(len(words))
                all_spans.append(merge_spans(spans))
                all_items.append(sorted(items))
            hits = [sum(end - start for start, end in spans) for spans in all_spans]
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(all_items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "n_hit", "spans", "items"])
            yield out.filter(pa.array([n > 0 for n in hits], pa.bool_())) if only_hits else out

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns of docs."""
    out = annotate(docs.select(F.struct(*docs.columns).alias("doc"), F.col(options.get("text_col", "text")).alias("text")), benchmark, **options | {"text_col": "text"})
    return out.where("not contaminated").select("doc.*")
