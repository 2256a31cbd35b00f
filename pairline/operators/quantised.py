"""Nearest neighbours over compressed vectors: leaves, product-quantised residuals, exact re-ranking.

A vector is stored as its leaf and one byte for each block of DIMS components: the nearest of up to 256 code words of that block,
learned on what vectors differ from their leaf's centre by. A query's inner product with what the codes stand for is that
with the centre plus one entry of a table for each byte, so that a search reads bytes and not vectors; over the length of what they
stand for, it is a cosine, which tells near vectors apart where all inner products are almost one. Only the `reorder`
best candidates of a query, twice k by default, are scored on the vectors themselves. Codes are sorted by leaf and stay
where they are; queries are broadcast in blocks whose tables have a bounded size.

How many leaves a query has to look into depends on the data: measured_probes() takes a bounded sample of the pool's own
vectors, finds their exact neighbours and looks up how far down in a query's order of leaves these lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairline.functions import vectors as vx
from pairline.operators.retrieval import knn_exact, ranked, units, vectors
from pairline.sources.scratch import cut, temporary

#: Below the first an exact search is used, below the second one over codes without leaves.
EXACT_BELOW, HASH_BELOW = 20_000, 100_000
#: Components in a block, code words of a block, vectors that code words are learned on, rounds of learning.
DIMS, WORDS, SAMPLE, ROUNDS = 2, 256, 16_384, 12
#: Leaves at most; bytes of the tables of a block of queries; rows scored at once; candidates that a task holds before it drops the worse ones.
MOST_LEAVES, TABLE_BYTES, ROWS, HELD = 1 << 16, 64 << 20, 4096, 1 << 20
#: The pool's own vectors that are searched for to choose the number of probes; the share of their neighbours that probed leaves must hold.
MEASURED, TARGET = 256, 0.98
#: Candidates that are broadcast to the vectors at most; more are joined with them by a shuffle.
BROADCAST_CANDIDATES = 200_000


@dataclass(frozen=True)
class CodedPool:
    """codes: (id, leaf, code); vectors: (id, v); centres: a row for each leaf; books: (blocks, words, components)."""

    codes: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    books: np.ndarray


def _padded(x: np.ndarray, dims: int) -> np.ndarray:
    """Rows as (rows, blocks, dims), the last block filled up with noughts."""
    lack = -x.shape[1] % dims
    return np.pad(x, ((0, 0), (0, lack))).reshape(len(x), -1, dims)


def learn_words(x: np.ndarray, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Code words of one block: means of the rows that are nearest to them; the first ones are distinct rows, empty words become the rows that lie farthest off."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= words:
        return np.concatenate([distinct, np.repeat(distinct[-1:], words - len(distinct), axis=0)])
    book = distinct[np.linspace(0, len(distinct) - 1, words).astype(int)]
    for _ in range(rounds):
        near = np.empty(len(x), int)
        off = np.empty(len(x))
        for low in range(0, len(x), ROWS):
            d = _distances(x[low : low + ROWS], book)
            near[low : low + ROWS] = d.argmin(axis=1)
            off[low : low + ROWS] = d.min(axis=1)
        sizes = np.bincount(near, minlength=words)
        sums = np.stack([np.bincount(near, x[:, i], words) for i in range(x.shape[1])], axis=1)
        book = sums / np.maximum(sizes, 1)[:, None]
        empty = np.flatnonzero(sizes == 0)
        book[empty] = x[np.argsort(-off, kind="stable")[: len(empty)]]
    return book


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances up to a term of the row."""
    return (book**2).sum(axis=1) - 2 * x @ book.T + (x**2).sum(axis=1, keepdims=True)


def _centres(whole: DataFrame, n: int, leaves: int, seed: int) -> np.ndarray:
    """Unit centres of leaves, learned on a tenth of the pool, drawn by hash, if that is enough for every leaf."""
    if leaves == 1:
        return np.zeros((1, len(whole.first()["v"])))
    train = whole.where(F.pmod(F.xxhash64("id"), F.lit(10)) == 0) if n >= 100 * leaves else whole
    model = KMeans(k=leaves, seed=seed, distanceMeasure="cosine", maxIter=10).fit(train.select(array_to_vector("v").alias("features")))
    return np.array([np.asarray(c, float) for c in model.clusterCenters()])


def coded_pool(pool: DataFrame, id_col: str = "img_id", vector_col: str = "embedding", leaves: int | None = None, dims: int = DIMS, words: int = WORDS, seed: int = 5) -> CodedPool | None:
    """The codes of a pool, written to the shared folder; floor(sqrt(n)) leaves by default. None for a pool without any direction.

    Rows without id or vector take no part; a zero vector, which has no direction, is in leaf -1, which every query looks into.
    """
    if not 1 < words <= 256:
        raise ValueError("a code word's number is one byte")
    spark = pool.sparkSession
    unit = F.coalesce(vx.l2_normalise(vx.doubles(F.col("v"))), F.transform("v", lambda _: F.lit(0.0)))
    base = vectors(pool, id_col, vector_col, "id").select("id", unit.alias("v"))
    whole = base.where(F.exists("v", lambda x: x != 0))
    n = whole.count()
    if not n:
        return None
    leaves = min(leaves or max(1, math.isqrt(n)), MOST_LEAVES)
    centres = _centres(whole, n, leaves, seed)
    shared = spark.sparkContext.broadcast(centres)

    def placed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and residual of each row."""
        leaf = np.concatenate([(v[low : low + ROWS] @ shared.value.T).argmax(axis=1) for low in range(0, len(v), ROWS)])
        rest = v - shared.value[leaf]
        leaf[~v.any(axis=1)] = -1
        return leaf, rest

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                parts = _padded(placed(np.array(batch["v"].tolist(), float))[1], dims)
                for block in range(parts.shape[1]):
                    yield pd.DataFrame({"block": np.int32(block), "x": parts[:, block].tolist()})

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["x"].tolist(), float)
        book = learn_words(x[np.lexsort(x.T)], words)
        return pd.DataFrame({"block": [key[0]], "book": [book.ravel().tolist()]})

    sample = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)  # of a bounded size
    pieces = sample.mapInPandas(split, "block int, x array<double>")
    found = pieces.groupBy("block").applyInPandas(learn, "block int, book array<double>").collect()  # a row for each block of components
    books = np.array([r["book"] for r in sorted(found, key=lambda r: r["block"])]).reshape(len(found), words, dims)
    told = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                rows = batch.iloc[low : low + ROWS]
                leaf, rest = placed(np.array(rows["v"].tolist(), float))
                parts = _padded(rest, dims)
                codes = np.stack([_distances(parts[:, b], told.value[b]).argmin(axis=1) for b in range(parts.shape[1])], axis=1).astype(np.uint8)
                yield pd.DataFrame({"id": rows["id"].to_numpy(), "leaf": leaf.astype("int32"), "code": [c.tobytes() for c in codes]})

    kind = pool.schema[id_col].dataType.simpleString()
    codes = base.mapInPandas(encode, f"id {kind}, leaf int, code binary")
    if leaves > 1:  # a large leaf lies in several ranges
        codes = codes.repartitionByRange("leaf", F.xxhash64("id")).sortWithinPartitions("leaf")
    return CodedPool(cut(codes, "codes"), base, centres, books)


def leaf_order(index: CodedPool, asked: DataFrame, probes: int) -> DataFrame:
    """asked (query_id, q) with the numbers of its nearest leaves, nearest first."""
    shared = asked.sparkSession.sparkContext.broadcast(index.centres)
    kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                rows = batch.iloc[low : low + ROWS]
                near = np.argsort(-(np.array(rows["q"].tolist(), float) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": rows["query_id"].to_numpy(), "q": rows["q"].to_list(), "leaves": near.astype("int32").tolist()})

    return asked.mapInPandas(run, f"query_id {kind}, q array<double>, leaves array<int>")


def _asked(queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    unit = F.coalesce(vx.l2_normalise(vx.doubles(F.col("v"))), F.transform("v", lambda _: F.lit(0.0)))
    return vectors(queries, id_col, vector_col, "query_id").select("query_id", unit.alias("q"))


def query_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, blocks, words): each query's inner products with all code words; in slices, so that no second copy in double precision is held."""
    n_blocks, words, dims = books.shape
    out = np.empty((len(q), n_blocks, words), np.float32)
    for low in range(0, len(q), 128):
        out[low : low + 128] = np.einsum("qbd,bwd->qbw", _padded(q[low : low + 128], dims), books)
    return out


def best_of_each(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The `most` best rows of each query, best first, ties to the smaller id; the queries that have as many, and the worst score of each of these."""
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")]
    order = order[np.argsort(q[order], kind="stable")]
    sizes = np.unique(q, return_counts=True)[1]
    ends = np.cumsum(sizes)
    order = order[np.arange(len(q)) - np.repeat(ends - sizes, sizes) < most]
    last = np.cumsum(np.minimum(sizes, most))[sizes >= most] - 1
    return (q[order], ids[order], scores[order]), q[order[last]], scores[order[last]]


def candidates(index: CodedPool, asked: DataFrame, reorder: int, probes: int) -> DataFrame:
    """(query_id, rank, id, score): the `reorder` best of each query (query_id, q) by its tables, from its `probes` nearest leaves."""
    spark = asked.sparkSession
    n_blocks, words, dims = index.books.shape
    blocks = max(1, -(-asked.count() // max(1, TABLE_BYTES // (4 * n_blocks * words))))
    everywhere = probes >= len(index.centres)
    ordered = leaf_order(index, asked, 1 if everywhere else probes)
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.codes.schema['id'].dataType.simpleString()}, score double"
    known = spark.sparkContext.broadcast((index.centres, index.books))

    def scan(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q, probed = shared.value
            centres, books = known.value
            tables = query_tables(q, books) if len(q) else None
            floor, kept, held = np.full(len(names), -np.inf), [], 0

            def best(parts: list[tuple]) -> list[tuple]:
                rows, full, least = best_of_each(*map(np.concatenate, zip(*parts, strict=True)), reorder)
                floor[full] = least
                return [rows]

            for batch in batches:
                if tables is None or batch.empty:
                    continue
                leaves, ids = batch["leaf"].to_numpy(), batch["id"].to_numpy()
                codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), n_blocks)
                order = np.argsort(leaves, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
                    leaf = int(leaves[rows[0]])
                    own = np.arange(len(names)) if everywhere or leaf < 0 else probed.get(leaf, ())
                    centre = centres[leaf] if leaf >= 0 else np.zeros(centres.shape[1])
                    length = np.full(len(rows), centre @ centre)
                    with_centre = np.einsum("bd,bwd->bw", 2 * _padded(centre[None], dims)[0], books) + (books**2).sum(axis=2)
                    for b in range(n_blocks):
                        length += with_centre[b, codes[rows, b]]
                    length = np.sqrt(np.maximum(length, vx.FLOOR))
                    for low in range(0, len(own), 128):
                        some = own[low : low + 128]
                        scores = np.repeat((q[some] @ centre)[:, None], len(rows), axis=1)
                        for b in range(n_blocks if leaf >= 0 else 0):
                            scores += tables[some, b][:, codes[rows, b]]
                        scores /= length
                        if len(rows) > reorder:
                            least = np.partition(scores, -reorder, axis=1)[:, -reorder]
                            hits = scores >= np.maximum(least, floor[some])[:, None]
                        else:
                            hits = scores >= floor[some][:, None]
                        at, col = np.nonzero(hits)
                        kept.append((some[at], ids[rows[col]], scores[at, col]))
                        held += len(at)
                        if held > HELD:
                            kept, held = best(kept), 0
            if kept:
                own, near, scores = best(kept)[0]
                yield pd.DataFrame({"query_id": names[own], "id": near, "score": scores})

        return run

    found = []
    for block in range(blocks):
        rows = ordered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()  # a block of bounded size
        probed: dict[int, np.ndarray] = {}
        if not everywhere and len(rows):
            near = np.array(rows["leaves"].tolist())
            flat = np.argsort(near.ravel(), kind="stable")
            numbers, starts = np.unique(near.ravel()[flat], return_index=True)
            probed = dict(zip(numbers.tolist(), np.split(flat // near.shape[1], starts[1:]), strict=True))
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), np.array(rows["q"].tolist(), float), probed))
        codes = index.codes.where(F.col("leaf").isin([-1, *probed])) if probed and len(probed) <= 1000 else index.codes
        part = ranked(codes.mapInPandas(scan(shared), schema), reorder)
        if blocks == 1:
            return part
        found.append(cut(part, "candidates"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def search(index: CodedPool, queries: DataFrame, k: int, id_col: str = "img_id", vector_col: str = "embedding", probes: int | None = None, reorder: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best of the candidates of each query by their exact inner products of directions."""
    probes = probes or max(len(index.centres) // 20, 1)
    asked = _asked(queries, id_col, vector_col)
    near = cut(candidates(index, asked, reorder or 2 * k, probes).select("query_id", "id"), "near")
    small = near.count() <= BROADCAST_CANDIDATES
    met = index.vectors.join(F.broadcast(near) if small else near, "id").join(asked, "query_id")
    return ranked(met.select("query_id", "id", vx.dot(F.col("v"), F.col("q")).alias("score")), k)


def measured_probes(index: CodedPool, k: int, target: float = TARGET, most: int = MEASURED) -> int:
    """The fewest probes whose leaves hold `target` of the k nearest neighbours of `most` of the pool's vectors, drawn by hash."""
    if len(index.centres) == 1:
        return 1
    with temporary(index.codes.sparkSession):
        return _measured(index, k, target, most)


def _measured(index: CodedPool, k: int, target: float, most: int) -> int:
    drawn = index.vectors.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64(F.lit("probe"), "id"), "id").limit(most)
    asked = cut(drawn, "asked")
    near = knn_exact(index.vectors, asked, k + 1, "id", "v").where("id != query_id")
    order = leaf_order(index, asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), len(index.centres)).select("query_id", "leaves")
    met = index.codes.join(F.broadcast(near.select("query_id", "id")), "id").join(order, "query_id")  # k + 1 rows for each drawn vector
    places = met.groupBy(F.array_position("leaves", F.col("leaf")).alias("place")).count().orderBy("place").collect()  # a row for each leaf at most
    total, seen = sum(r["count"] for r in places), 0
    for r in places:
        seen += r["count"]
        if seen >= target * total:
            return int(r["place"])
    return 1


def knn_partitioned(pool: DataFrame, queries: DataFrame, k: int, id_col: str = "img_id", vector_col: str = "embedding", leaves: int | None = None, probes: int | None = None, reorder: int | None = None) -> DataFrame:
    """As knn_exact, but from leaves, codes and re-ranked candidates; as many leaves are looked into as measured_probes() asks for, if probes is not given."""
    index = coded_pool(pool, id_col, vector_col, leaves)
    if index is None:
        return knn_exact(pool, queries, k, id_col, vector_col)
    return search(index, queries, k, id_col, vector_col, probes or measured_probes(index, k), reorder)


def knn_hashed(pool: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """As knn_partitioned with one leaf: the codes of the whole pool are read."""
    return knn_partitioned(pool, queries, k, leaves=1, probes=1, **options)


def knn(pool: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Exact below EXACT_BELOW rows of the pool, over codes below HASH_BELOW, by leaves and codes above."""
    n = pool.count()
    return (knn_exact if n < EXACT_BELOW else knn_hashed if n < HASH_BELOW else knn_partitioned)(pool, queries, k, **options)
