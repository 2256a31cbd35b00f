"""Secret scan: a random forest removes the false positives among long unbroken strings and assigned values.

One pass over all texts counts character transitions and words; the transitions and the DICTIONARY commonest words say how
much a candidate looks like language. A second pass finds the candidates with their context: strings of 16 or more of the
characters of keys, and values of 8 or more characters of any kind but blanks and quotes, without a full stop or the like at
their end, that stand behind a credential's name and = or :.
Where two overlap, the one that starts first counts, and of two that start together the longer one.
A forest is trained on labelled findings and keeps the candidates that it holds for secrets; the word before a candidate is
among its features, in NEIGHBOURS buckets, but no rule that makes labels. Without a table of labelled findings the labels come
from fixed formats: issued keys and assignments to credential names are secrets; numbers, UUIDs, parts of addresses, digests
behind a digest's name, placeholders and names made of the dictionary's words are not; other candidates stay unlabelled.

Defined results: a null or empty text has no findings; ids may be null or stand repeatedly, each row is scanned; a text's
findings are in order of their place; without labels of both kinds all labelled as secrets are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairline.llm.common import cut, small_batches

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}")
DICTIONARY_WORD = re.compile(rb"(?<![a-z])[a-z]{3,16}(?![a-z])")
# Formats of issued keys, and names that credentials are assigned to.
ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[bp]-[A-Za-z0-9-]{20,}")
NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth")
PLACEHOLDER = re.compile(r"(?i)example|placeholder|your[_-]|xxxx|changeme|dummy")
ASSIGNED = re.compile(rf"(?i)(?:{'|'.join(NAMES)})[\"']?\s*[=:]\s*[\"']?$")
NUMBER = re.compile(r"[0-9\-]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?i)\b(?:sha-?[0-9]*|md5|commit|revision|digest|checksum)[\s:=\"']*$")
ADDRESS = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s\"'<>]*$")
VALUE = re.compile(rf"(?i)(?:{'|'.join(NAMES)})[\"']?\s*[=:]\s*[\"']?([^\s\"'<>]{{7,}}[^\s\"'<>.,;:)\]}}])")
CONTEXT, DICTIONARY = 40, 5000
#: Different words that a task counts before it hands its counts on.
COUNTED = 100_000
#: Labelled findings of each kind that the forest is trained on, about.
SAMPLE = 4000
TREES, DEPTH, KEEP = 40, 8, 0.5
#: Buckets for the word before a candidate.
NEIGHBOURS = 32
#: Letters in two cases, digits and the rest.
CLASSES = np.array([b - 97 if 97 <= b <= 122 else b - 39 if 65 <= b <= 90 else 52 if 48 <= b <= 57 else 53 for b in range(256)], np.int64)
KINDS = 54
FEATURES = ["length", "digits", "uppers", "switches", "entropy", "transitions", "covered", "hex", "quoted", "word_before", "word_after", "path_test", "path_depth", "neighbour"]


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, item, n): 't' character transitions and 'w' words of 3 to 16 letters of all texts."""
    bodies = docs.select(F.col(text_col).cast("binary").alias("body"))

    def counts(kind: str, items: list[str], numbers: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(items), pa.string()), pa.array(items, pa.string()), pa.array(numbers, pa.int64())], ["kind", "item", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, words = np.zeros(KINDS * KINDS, np.int64), Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body:
                    codes = CLASSES[np.frombuffer(body, np.uint8)]
                    moves += np.bincount(codes[:-1] * KINDS + codes[1:], minlength=KINDS * KINDS)
                    words.update(DICTIONARY_WORD.findall(body.lower()))
                if len(words) >= COUNTED:
                    yield counts("w", [w.decode() for w in words], list(words.values()))
                    words.clear()
        at = np.flatnonzero(moves)
        yield counts("t", [str(i) for i in at], moves[at].tolist())
        yield counts("w", [w.decode() for w in words], list(words.values()))

    return bodies.mapInArrow(run, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def language(counts: DataFrame) -> dict:
    """Log-probabilities of transitions (at most 54 * 54) and the DICTIONARY commonest words."""
    moves = np.ones((KINDS, KINDS))
    for r in counts.where("kind = 't'").collect():
        moves[divmod(int(r["item"]), KINDS)] += r["n"]
    words = counts.where("kind = 'w'").orderBy(F.desc("n"), "item").limit(DICTIONARY).collect()
    return {"moves": np.log(moves / moves.sum(axis=1, keepdims=True)), "words": {r["item"] for r in words}}


def covered(value: str, words: set[str]) -> float:
    """The largest share of characters that words of the dictionary can cover."""
    low = value.lower()
    best = [0] * (len(low) + 1)
    for end in range(1, len(low) + 1):
        best[end] = best[end - 1]
        for size in range(3, min(end, 16) + 1):
            if best[end - size] + size > best[end] and low[end - size : end] in words:
                best[end] = best[end - size] + size
    return best[-1] / len(low)


def describe(text: str, start: int, end: int, path: str, lang: dict) -> list[float]:
    value = text[start:end]
    n = len(value)
    codes = CLASSES[np.frombuffer(value.encode(), np.uint8)]
    kinds = np.where(codes < 26, 0, np.where(codes < 52, 1, codes))
    share = np.array(list(Counter(value).values())) / n
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    last, following = re.findall(r"[A-Za-z_]+", before)[-1:], re.findall(r"[A-Za-z_]+", after)[:1]
    known = lambda w: covered(w[0], lang["words"]) if w and len(w[0]) > 1 else 0.0
    return [
        float(n), float((codes == 52).mean()), float(((codes >= 26) & (codes < 52)).mean()), float((np.diff(kinds) != 0).mean()),
        float(-(share * np.log2(share)).sum()), float(lang["moves"][codes[:-1], codes[1:]].mean()), covered(value, lang["words"]),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))), float(before[-1:] in "\"'" and before != ""),
        known(last), known(following), float(bool(re.search(r"(?i)test|example|fixture|doc", path))), float(path.count("/")),
        float(zlib.crc32(last[0].lower().encode()) % NEIGHBOURS) if last else -1.0,
    ]


def label_of(text: str, start: int, end: int, coverage: float) -> int | None:
    """1: a secret by its format or assignment, 0: by its form or place something else, None: not labelled."""
    value, before = text[start:end], text[max(0, start - CONTEXT) : start]
    assigned = bool(ASSIGNED.search(before))
    if PLACEHOLDER.search(value):
        return 0
    if ISSUED.fullmatch(value) or assigned and re.search(r"\d", value):
        return 1
    if assigned:
        return None
    if NUMBER.fullmatch(value) or DIGEST.search(before) or ADDRESS.search(before):
        return 0
    letters = re.sub(r"[+/_\-]", "", value)
    return 0 if letters.isalpha() and coverage * len(value) >= 0.6 * len(letters) else None


def spans_of(text: str) -> list[tuple[int, int]]:
    """The candidates of a text, in order and without overlaps."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([m.span() for m in CANDIDATE.finditer(text)] + [m.span(1) for m in VALUE.finditer(text)], key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def candidates(docs: DataFrame, lang: dict, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """(id, start, end, value_sha256, label, and the features) of every candidate."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"), F.coalesce(F.col(path_col).cast("string"), F.lit("")))
    shared = docs.sparkSession.sparkContext.broadcast(lang)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at, spans, digests, labels, rows = [], [], [], [], []
            for i, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for span in spans_of(text or ""):
                    facts = describe(text, *span, path, own)
                    at.append(i)
                    spans.append(span)
                    digests.append(hashlib.sha256(text[slice(*span)].encode()).hexdigest())
                    labels.append(label_of(text, *span, facts[6]))
                    rows.append(facts)
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([s for s, _ in spans], pa.int32()), pa.array([e for _, e in spans], pa.int32()), pa.array(digests, pa.string()), pa.array(labels, pa.int32())]
            arrays += [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "end", "value_sha256", "label", *FEATURES])

    return rows.mapInArrow(run, f"id {kind}, start int, end int, value_sha256 string, label int, " + ", ".join(f"{f} double" for f in FEATURES))


def featured(found: DataFrame) -> DataFrame:
    """found with the vector `features`: the numbers, and a one in the bucket of the word before."""
    near = [(F.col("neighbour") == float(i)).cast("double") for i in range(NEIGHBOURS)]
    return found.withColumn("features", array_to_vector(F.array(*FEATURES[:-1], *near)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """(id, start, end, value_sha256, probability) of the findings kept; labelled: (value_sha256, label) of reviewed findings."""
    small_batches(docs.sparkSession)
    lang = language(cut(corpus_counts(docs, text_col), "counts"))
    found = cut(candidates(docs, lang, id_col, text_col, path_col), "candidates")
    if labelled is not None:
        reviewed = labelled.where("label is not null").groupBy("value_sha256").agg(F.max("label").alias("__label"))
        found = found.join(reviewed, "value_sha256", "left").withColumn("label", F.coalesce("__label", "label")).drop("__label")
    first = Window.partitionBy("value_sha256").orderBy("label", *FEATURES)  # equal values in other places: the same one at each run
    own = found.where("label is not null").withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if len(counts) < 2:
        return found.where("label = 1").select(F.col("id").alias(id_col), "start", "end", "value_sha256", F.lit(1.0).alias("probability"))
    every = F.when(F.col("label") == 1, max(1, math.ceil(counts[1] / SAMPLE))).otherwise(max(1, math.ceil(counts[0] / SAMPLE)))
    sample = featured(own.where(F.pmod(F.xxhash64("value_sha256"), every) == 0))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11).fit(sample.withColumn("label", F.col("label").cast("double")))
    scored = forest.transform(featured(found)).withColumn("probability", vector_to_array("probability")[1])
    return scored.where(F.col("probability") >= KEEP).select(F.col("id").alias(id_col), "start", "end", "value_sha256", "probability")
