"""Toxicity by a linear-chain conditional random field over words.

The labels name documents, not words. So token labels are derived first (distant supervision): a
word of a toxic document is labelled 1 if one of its features (the word, its prefixes of 3 to 6 letters) stands in
toxic documents far more often than in clean ones. The field is then trained on windows of labelled
tokens by gradient ascent of the log-likelihood. Scoring runs forward-backward over every whole text;
the marginals of its words give the offending spans and, through a logistic curve fitted on training documents
that the field has not seen, the score of the document.

Only the model is fitted on a sample, of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents of at
most SAMPLE_BYTES bytes each, taken in hash order of their ids. Rows whose crc32(id as text) mod 4 is 2 are never learned from.

Defined results: a null or empty text, or one without words, gets the score of a text without any evidence; rows
with a null id are scored and count as not held out; equal texts get equal scores; ids
labelled repeatedly count as toxic if one label says so, null labels are left out; without any label of one
kind every score is the share of toxic labels (0 where there are none); an empty table gives no rows; columns of the input keep
their names and values, result columns replace any of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.llm.common import small_batches

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 4000, 32768
THRESHOLD, SPAN_MARGINAL = 0.3, 0.5
WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
WINDOW, WINDOWS_PER_DOC, ROUNDS = 32, 6, 120
CACHE_WORDS = 300_000


def features(word: str) -> list[str]:
    word = word.lower()
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def _distinct(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without copies and near copies, so that the words of one copied text don't look frequent."""
    out, seen = [], set()
    for text, label in rows:
        words = {w.encode() for w in WORD.findall(text)}
        marks = {(s, min((xxhash.xxh3_64_intdigest(w, s) for w in words), default=0)) for s in range(3)}
        if len(marks & seen) < 2:
            out.append((text, label))
        seen |= marks
    return out


def _telling(rows: list[tuple[str, int]]) -> tuple[set[str], set[str]]:
    """Features that stand in toxic documents far more often than in clean ones, and features of three documents or more."""
    toxic, clean = Counter(), Counter()
    for text, label in rows:
        (toxic if label else clean).update({f for w in set(WORD.findall(text)) for f in features(w)})
    n1 = max(1, sum(label for _, label in rows))
    n0 = max(1, len(rows) - n1)
    bar = math.log(len(toxic) + 1) + 2
    telling = set()
    for f, a in toxic.items():
        b = clean[f]
        if a < 3 or a * n0 < 4 * b * n1:
            continue
        share = (a + b) / (n1 + n0)
        gain = a * math.log(a / (n1 * share)) + (b * math.log(b / (n0 * share)) if b else 0)
        gain += sum(k * math.log(k / (n * (1 - share))) for k, n in ((n1 - a, n1), (n0 - b, n0)) if k > 0)
        if gain > bar:
            telling.add(f)
    known = {f for f, a in toxic.items() if a + clean[f] >= 3} | {f for f, b in clean.items() if b >= 8}
    return telling, known


def _windows(rows: list[tuple[str, int]], telling: set[str]) -> tuple[list[list[str]], list[list[int]]]:
    """Windows around labelled or telling words, and two of each document at fixed places."""
    words_out, tags_out = [], []
    for text, label in rows:
        words = WORD.findall(text)
        told = [any(f in telling for f in features(w)) for w in words]
        places = [i // WINDOW for i, t in enumerate(told) if t]
        chosen = dict.fromkeys([*places[:WINDOWS_PER_DOC], 0, len(words) // (2 * WINDOW)])
        for k in chosen:
            part = words[k * WINDOW : (k + 1) * WINDOW]
            if part:
                words_out.append(part)
                tags_out.append([int(label and t) for t in told[k * WINDOW : (k + 1) * WINDOW]])
    return words_out, tags_out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def fit_field(rows: list[tuple[str, int]]) -> dict:
    """Weights of features, bias, start and transitions of the field, by Adam on the penalised log-likelihood."""
    telling, known = _telling(rows)
    words, tags = _windows(rows, telling)
    names = {f: i for i, f in enumerate(sorted(known))}
    n, width = len(words), WINDOW
    ids, offsets, gold, real = [], [0], np.zeros((n, width), int), np.zeros((n, width), bool)
    for i, (part, own) in enumerate(zip(words, tags, strict=True)):
        gold[i, : len(own)], real[i, : len(own)] = own, True
        for t in range(width):
            if t < len(part):
                ids += [names[f] for f in features(part[t]) if f in names]
            offsets.append(len(ids))
    ids, counts = np.array(ids, int), np.diff(offsets)
    cell = np.repeat(np.arange(n * width), counts)
    theta = np.zeros(len(names) + 1 + 4 + 1)  # features, bias, transitions by (from, to), start
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    follow = real[:, 1:]
    for step in range(1, ROUNDS + 1):
        emit = (np.bincount(cell, theta[ids], n * width).reshape(n, width) + theta[-6]) * real
        trans = theta[-5:-1].reshape(2, 2)
        score = np.stack([np.zeros_like(emit), emit], axis=2)
        ahead, back = np.zeros((width, n, 2)), np.zeros((width, n, 2))
        ahead[0] = score[:, 0] + np.array([0, theta[-1]])
        for t in range(1, width):
            moved = _log_sum(ahead[t - 1][:, :, None] + trans, 1) + score[:, t]
            ahead[t] = np.where(real[:, t, None], moved, ahead[t - 1])
        for t in range(width - 2, -1, -1):
            moved = _log_sum(trans + (score[:, t + 1] + back[t + 1])[:, None, :], 2)
            back[t] = np.where(real[:, t + 1, None], moved, 0)
        total = _log_sum(ahead[-1], 1)
        one = np.exp(ahead[:, :, 1] + back[:, :, 1] - total).T * real
        grad = np.zeros_like(theta)
        off = (gold - one) * real
        grad[: len(names)] = np.bincount(ids, off.ravel()[cell], len(names))
        grad[-6], grad[-1] = off.sum(), off[:, 0].sum()
        for i in (0, 1):
            for j in (0, 1):
                both = np.exp(ahead[:-1, :, i] + trans[i, j] + score[:, 1:, j].T + back[1:, :, j] - total).T * follow
                grad[-5 + 2 * i + j] = ((gold[:, :-1] == i) & (gold[:, 1:] == j) & follow).sum() - both.sum()
        grad -= 0.5 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    kept = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 0.01}
    return {"weights": kept, "bias": float(theta[-6]), "trans": np.exp(theta[-5:-1]).tolist(), "start": math.exp(theta[-1])}


def _scan(a: np.ndarray, b: np.ndarray, c: float, d: float, resets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c x[t-1] + d), and x[t] = at[t] where resets[t].

    Blocks are composed side by side as 2 x 2 matrices, then joined, then run: long texts cost no more steps.
    """
    n = len(a)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    pad = blocks * size - n
    a, b, low, one = (np.append(v, np.full(pad, f)).reshape(blocks, size).T for v, f in ((np.where(resets, 0, a), 0), (np.where(resets, at, b), 1), (np.where(resets, 0, c), 0), (np.where(resets, 1, d), 1)))
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(size):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, low[t] * p + one[t] * r, low[t] * q + one[t] * s
        scale = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    enter, x = np.empty(blocks), 1.0
    for k in range(blocks):
        enter[k] = x
        x = (p[k] * x + q[k]) / (r[k] * x + s[k])
    out = np.empty((size, blocks))
    for t in range(size):
        enter = (a[t] * enter + b[t]) / (low[t] * enter + one[t])
        out[t] = enter
    return out.T.ravel()[:n]


class Field:
    """A fitted field ready to tag: scores of words are looked up once and kept."""

    def __init__(self, model: dict):
        self.weights, self.bias = model["weights"], model["bias"]
        (self.t00, self.t01, self.t10, self.t11), self.start = model["trans"], model["start"]
        self.cache: dict[str, float] = {}

    def emission(self, word: str) -> float:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        x = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        self.cache[word] = x
        return x

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text's words the probability that the word is toxic."""
        cache, emission = self.cache, self.emission
        scores = []
        for words in texts:
            for w in words:
                x = cache.get(w)
                scores.append(emission(w) if x is None else x)
        sizes = np.array([len(w) for w in texts], int)
        if not scores:
            return [np.empty(0)] * len(texts)
        e = np.exp(np.clip(np.array(scores), -30, 30))
        ends = np.cumsum(sizes)[sizes > 0]
        begins = np.zeros(len(e), bool)
        begins[ends - sizes[sizes > 0]] = True
        last = np.zeros(len(e), bool)
        last[ends - 1] = True
        ahead = _scan(e * self.t11, e * self.t01, self.t10, self.t00, begins, e * self.start)
        odds = ahead * self._back(e, last)
        return np.split(odds / (1 + odds), np.cumsum(sizes)[:-1])

    def _back(self, e: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Backward odds: y[t] = (t11 e[t+1] y[t+1] + t10) / (t01 e[t+1] y[t+1] + t00), 1 at the end of a text.

        With z[t] = e[t] y[t] this is the forward form: z[t] = e[t] (t11 z[t+1] + t10) / (t01 z[t+1] + t00).
        """
        z = _scan((e * self.t11)[::-1], (e * self.t10)[::-1], self.t01, self.t00, last[::-1], e[::-1])[::-1]
        return z / e


def evidence(marginals: np.ndarray) -> tuple[float, float, float]:
    """What a document's score is made of: its strongest word, the expected number and the share of toxic words."""
    if not len(marginals):
        return -12.0, math.log(1e-4), math.log(1e-6)
    top = min(max(float(marginals.max()), 1e-6), 1 - 1e-6)
    total = float(marginals.sum())
    return math.log(top / (1 - top)), math.log(total + 1e-4), math.log(total / len(marginals) + 1e-6)


def fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, with a ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    return beta.tolist()


def fit(rows: list[tuple[str, int]]) -> dict:
    """The whole model from (text, label): the field from three quarters, the score curve from the rest."""
    share = sum(label for _, label in rows) / len(rows) if rows else 0.0
    if share in (0.0, 1.0):
        return {"constant": share}
    rows = _distinct(rows)
    own = [r for i, r in enumerate(rows) if i % 4]
    rest = [r for i, r in enumerate(rows) if not i % 4]
    if len({label for _, label in own}) < 2 or len({label for _, label in rest}) < 2:
        return {"constant": share}
    model = fit_field(own)
    field = Field(model)
    x = np.array([evidence(m) for m in field.marginals([WORD.findall(t) for t, _ in rest])])
    curve = fit_curve(x, np.array([label for _, label in rest], float))
    return model | {"curve": curve}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """The bounded sample of labelled texts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    order = F.xxhash64("__id")
    picked = known.where("__label = 1").orderBy(order).limit(SAMPLE_TOXIC).union(known.where("__label = 0").orderBy(order).limit(SAMPLE_CLEAN))
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.octet_length("__text") <= SAMPLE_BYTES)
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids are broadcast; an id that stands repeatedly counts once
    found = own.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__label").alias("__label")).orderBy(order)
    return [(r["__text"], r["__label"]) for r in found.collect()]


def score(docs: DataFrame, model: dict, text_col: str = "text", spans: bool = True) -> DataFrame:
    """docs with score and, if asked, spans: character offsets (start, end) of runs of toxic words, with their highest marginal."""
    added = ("score", "spans")
    kept = docs.select(*[c for c in docs.columns if c not in added])
    if "constant" in model:
        out = kept.withColumn("score", F.lit(float(model["constant"])))
        return out.withColumn("spans", F.expr("cast(array() as array<struct<start:int,end:int,marginal:double>>)")) if spans else out
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its features come from the bounded sample
    place = kept.columns.index(text_col)
    field: list[Field] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not field:
            field.append(Field(shared.value))
        curve = np.array(shared.value["curve"])
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            tagged = field[0].marginals([WORD.findall(t) for t in texts])
            x = np.array([evidence(m) for m in tagged]).reshape(-1, len(curve) - 1)
            values = 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))
            arrays = [*batch.columns, pa.array(values, pa.float64())]
            if spans:
                arrays.append(pa.array([offending(t, m) for t, m in zip(texts, tagged, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "score", *["spans"] * spans])

    fields = [f"`{c.replace('`', '``')}` {t}" for c, t in kept.dtypes] + ["score double"] + ["spans array<struct<start:int,end:int,marginal:double>>"] * spans
    return kept.mapInArrow(run, ", ".join(fields))


def offending(text: str, marginals: np.ndarray) -> list[dict]:
    """Runs of words whose marginal is SPAN_MARGINAL or more."""
    out: list[dict] = []
    hot = np.flatnonzero(marginals >= SPAN_MARGINAL)
    if not len(hot):
        return out
    places = [m.span() for m in WORD.finditer(text)]
    last = -2
    for i in hot.tolist():
        if i == last + 1:
            out[-1]["end"] = places[i][1]
            out[-1]["marginal"] = max(out[-1]["marginal"], float(marginals[i]))
        else:
            out.append({"start": places[i][0], "end": places[i][1], "marginal": float(marginals[i])})
        last = i
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", spans: bool = True) -> DataFrame:
    """docs with held_out, score, predicted and spans; the model is learned from rows that are not held out."""
    model = fit(training_rows(docs, labels, id_col, text_col, label_col))
    plain = docs.select(*[c for c in docs.columns if c not in ("held_out", "predicted", "score", "spans")])
    scored = score(plain, model, text_col, spans)
    return scored.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of docs."""
    return toxicity(docs, labels, spans=False, **options).where("predicted = 0").select(*docs.columns)
