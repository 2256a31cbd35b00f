"""Periodic runs of words, found by recompression.

The texts of a chunk are one sequence of word numbers with a symbol of its own between any two. Rounds of recompression
turn it into a run-length grammar: block compression makes a block of equal symbols one symbol, pair compression
parts the alphabet in two halves and makes each pair of a left and a right symbol one symbol. What becomes of a symbol depends
on its neighbours only, so that equal stretches have equal symbols but near their ends. A round is a level; levels end
when no symbol stands twice.

The exact extension of two places (how far the words from them on, or before them, agree) climbs while symbols agree and steps
down from the first ones that differ; each level takes a constant number of steps, for whole arrays of places at once.
A run of period p and of at least max(MIN_LENGTH, TIMES * p) words holds a place i of each grid of step max(MIN_LENGTH - p,
(TIMES - 1) * p) whose word equals that at i + p; over all p these grids have about n log n places. The extensions of such
places to both sides are the maximal stretches of period p, and of those with equal ends the smallest period is the run's. No
hash and no suffix array takes part: symbols are numbers of distinct blocks and pairs.

Defined results: null, empty and blank texts have no words and no runs; equal rows are treated alike; a text of one word
repeated is one run of period 1; an empty table gives no rows; columns of the input keep their names and
values, result columns replace any of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairline.llm.common import small_batches

#: A run has at least MIN_LENGTH words and TIMES periods.
MIN_LENGTH, TIMES = 24, 3
#: Words of a chunk of texts (a longer text is a chunk of its own); places of grids, and pairs of places, compared at once.
CHUNK_WORDS, GRID_PLACES, QUERIES = 1 << 18, 1 << 20, 1 << 18


class Grammar:
    """Levels of symbols of a sequence; level 0 is the sequence itself, which begins and ends with symbols of their own.

    symbols[h] are a level's symbols, first[h][k] the place on level h - 1 of the first child of symbol k (one more entry ends
    the last), parent[h][k] the place on level h + 1 of the symbol that k is part of. Odd levels hold blocks, even ones pairs.
    """

    def __init__(self, sequence: np.ndarray):
        self.symbols, self.first, self.size, self.parent = [np.unique(sequence, return_inverse=True)[1]], [None], [None], []
        while not self._all_differ():
            now = self.symbols[-1]
            starts = self._blocks(now) if len(self.symbols) % 2 else self._pairs(now)
            sizes = np.diff(np.append(starts, len(now)))
            width = int(now.max()) + 1
            if len(self.symbols) % 2:
                made = now[starts] + sizes * width
            else:  # a symbol alone, or a pair of two
                made = now[starts] + np.where(sizes > 1, now[np.minimum(starts + 1, len(now) - 1)] + 1, 0) * width
            self.parent.append(np.repeat(np.arange(len(starts)), sizes))
            self.first.append(np.append(starts, len(now)))
            self.size.append(sizes)
            self.symbols.append(np.unique(made, return_inverse=True)[1])
        self.parent.append(None)

    def _all_differ(self) -> bool:
        return int(self.symbols[-1].max()) + 1 == len(self.symbols[-1])

    @staticmethod
    def _blocks(now: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.append(True, now[1:] != now[:-1]))

    def _pairs(self, now: np.ndarray) -> np.ndarray:
        """Where groups start if each left symbol before a right one is joined with it; halves by bits of a multiplied number."""
        salt = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.symbols))
        mixed = (now.astype(np.uint64) + np.uint64(len(self.symbols))) * salt
        left = ((mixed ^ (mixed >> np.uint64(29))) * salt >> np.uint64(63)).astype(bool)
        joined = left[:-1] & ~left[1:]
        other = ~left[:-1] & left[1:]
        if other.sum() > joined.sum():
            joined = other
        return np.flatnonzero(np.append(True, ~joined))

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from the places i and j on agree (or, going back, up to and with them); i and j differ."""
        step = -1 if back else 1
        p, q, top = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        climbing = np.flatnonzero(self.symbols[0][p] == self.symbols[0][q])
        for h in range(len(self.symbols) - 1):
            if not len(climbing):
                break
            up, first, size = self.parent[h], self.first[h + 1], self.size[h + 1]
            a, b = p[climbing], q[climbing]
            left_a, left_b = self._left(a, up, first, back), self._left(b, up, first, back)
            # from inside of groups both go to their ends as far as equal symbols reach
            inside = (left_a != size[up[a]]) | (left_b != size[up[b]])
            move = np.where(inside, np.minimum(left_a, left_b), 0)
            stuck = inside & (left_a != left_b) & self._in_block(h)
            a, b = a + step * move, b + step * move
            goes = ~stuck & (self.symbols[h][a] == self.symbols[h][b])
            ups = up[a], up[b]
            alike = goes & (self.symbols[h + 1][ups[0]] == self.symbols[h + 1][ups[1]])
            p[climbing], q[climbing] = np.where(alike, ups[0], a), np.where(alike, ups[1], b)
            top[climbing] = np.where(alike, h + 1, h)
            climbing = climbing[alike]
        for h in range(len(self.symbols) - 1, -1, -1):
            here = np.flatnonzero(top >= h)
            a, b = p[here], q[here]
            if h < len(self.symbols) - 1:
                lower = top[here] > h
                a[lower], b[lower] = self._child(h + 1, a[lower], back), self._child(h + 1, b[lower], back)
            same = np.flatnonzero(self.symbols[h][a] == self.symbols[h][b])
            if len(same) and h < len(self.symbols) - 1:
                up, first = self.parent[h], self.first[h + 1]
                move = 1
                if self._in_block(h):
                    move = np.minimum(self._left(a[same], up, first, back), self._left(b[same], up, first, back))
                a[same] += step * move
                b[same] += step * move
            p[here], q[here] = a, b
        return (p - i) * step

    def _in_block(self, h: int) -> bool:
        """Whether the symbols of level h are grouped to blocks by the next one."""
        return h % 2 == 0

    @staticmethod
    def _left(at: np.ndarray, up: np.ndarray, first: np.ndarray, back: bool) -> np.ndarray:
        """Symbols from `at` to the end of its group, going on or back, itself included."""
        return at - first[up[at]] + 1 if back else first[up[at] + 1] - at

    def _child(self, h: int, at: np.ndarray, back: bool) -> np.ndarray:
        return self.first[h][at + 1] - 1 if back else self.first[h][at]


def _grid(n: int, longest: int, min_length: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) for all periods that a text of `longest` words can hold, in pieces of bounded size."""
    periods = np.arange(1, longest // times + 1)
    steps = np.maximum(min_length - periods, (times - 1) * periods)
    sizes = np.maximum(0, -(-(n - periods) // steps))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(periods):
        low = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, low + GRID_PLACES, "right")))
        size = sizes[at:to]
        number = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        yield number * np.repeat(steps[at:to], size), np.repeat(periods[at:to], size)
        at = to


def runs_of(sequence: np.ndarray, longest: int, min_length: int = MIN_LENGTH, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence, by start and period.

    The sequence begins and ends with symbols of their own, and so do its texts; the longest text has `longest` symbols.
    """
    if longest < max(min_length, times):
        return np.zeros((0, 3), np.int64)
    candidates = [np.zeros((2, 0), np.int64)]
    for i, p in _grid(len(sequence), longest, min_length, times):
        met = sequence[i] == sequence[i + p]
        candidates.append(np.stack([i[met], p[met]]))
    i, p = np.concatenate(candidates, axis=1)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    grammar, found = Grammar(sequence), []
    for at in range(0, len(i), QUERIES):
        a, q = i[at : at + QUERIES], p[at : at + QUERIES]
        before, after = grammar.extension(a, a + q, back=True) - 1, grammar.extension(a, a + q)
        length = before + after + q
        enough = length >= np.maximum(min_length, times * q)
        found.append(np.unique(np.stack([a - before, length, q], axis=1)[enough], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length and period: the first of equal stretches has the smallest
    if len(rows):
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def text_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, times: int = TIMES) -> list[np.ndarray]:
    """Runs of each text, given as its words; the texts go through one grammar."""
    numbers: dict[bytes, int] = {}
    words = [w for text in texts for w in text]
    codes = np.fromiter(map(numbers.setdefault, words, count()), np.int64, len(words))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes + np.arange(1, len(texts) + 1)
    sequence = np.empty(len(words) + len(texts) + 1, np.int64)
    marks = np.append(0, starts + sizes)
    inner = np.ones(len(sequence), bool)
    inner[marks] = False
    sequence[inner], sequence[marks] = codes, -1 - np.arange(len(marks))
    rows = runs_of(sequence, int(sizes.max(initial=0)), min_length, times)
    cuts = np.searchsorted(rows[:, 0], starts)
    ends = np.append(cuts[1:], len(rows)) if len(cuts) else cuts
    return [rows[a:b] - np.array([s, 0, 0]) for a, b, s in zip(cuts.tolist(), ends.tolist(), starts.tolist(), strict=True)]


Edit = Callable[[list, str], list]
# result columns with their types in Spark and in Arrow; the last two hold whole texts and all runs
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COUNTS = ("n_words", "n_runs", "start", "length", "period", "exponent_milli")
RESULT = {c: ("long", pa.int64()) for c in COUNTS} | {c: ("string", pa.string()) for c in ("runs_sha256", "collapsed_sha256")}
WHOLE = {"collapsed": ("string", pa.string()), "runs": ("array<struct<start:long,length:long,period:long>>", pa.list_(RUN))}


def _answer(words: list[bytes], runs: np.ndarray, whole: bool) -> tuple:
    """The result columns of one text."""
    rows = [tuple(r) for r in runs.tolist()]
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in rows)
    best = (None,) * 4
    if rows:
        a, b, c = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (a, b, c, 1000 * b // c)
    kept = b" ".join([words[i] for i in np.flatnonzero(~dropped(len(words), runs)).tolist()] if rows else words)
    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    return (len(words), len(rows), *best, *digests) + ((kept.decode(errors="replace"), [dict(zip(("start", "length", "period"), r, strict=True)) for r in rows]) if whole else ())


def collapse_runs(docs: DataFrame, text_col: str = "text", id_col: str | None = None, edit: Edit | None = None, min_length: int = MIN_LENGTH, times: int = TIMES, whole: bool = True) -> DataFrame:
    """docs with n_words, n_runs, the run of greatest exponent, digests and, unless turned off, the collapsed text and all runs.

    edit, if given, changes a row's words first: edit(words, id as text).
    """
    small_batches(docs.sparkSession)
    result = RESULT | (WHOLE if whole else {})
    kept = docs.select(*[c for c in docs.columns if c not in result])
    names = [*kept.columns, *result]
    key = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    asked = docs.select(*kept.columns, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__text"), key.alias("__id"))

    def answers(texts: list[list[bytes]]) -> list[pa.Array]:
        found = [_answer(t, r, whole) for t, r in zip(texts, text_runs(texts, min_length, times), strict=True)]
        return [pa.array(c, kind) for c, (_, kind) in zip(zip(*found, strict=True), result.values(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, bodies, keys = batch.columns
            texts, first, held = [], 0, 0
            for i, (text, name) in enumerate(zip(bodies.to_pylist(), keys.to_pylist(), strict=True)):
                words = text.split()  # bytes part at the six ASCII blanks only
                texts.append(edit(words, name) if edit else words)
                held += len(words)
                if held >= CHUNK_WORDS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([c.slice(first, len(texts)) for c in own] + answers(texts), names)
                    texts, first, held = [], i + 1, 0

    schema = [f"`{c.replace('`', '``')}` {t}" for c, t in kept.dtypes] + [f"{c} {t}" for c, (t, _) in result.items()]
    return asked.mapInArrow(run, ", ".join(schema))
