"""Searches: exact, over codes, and over leaves with codes."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from compare import SF
from pyspark.sql import functions as F

from pairline.operators import quantised, retrieval

POOL = "img_id long, embedding array<double>"


def hits(found, true):
    return len({(r.query_id, r.id) for r in found.collect()} & true) / len(true)


def clustered(spark, n, clusters, spread, seed, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[np.arange(n) % clusters] + rng.normal(size=(n, dims)) * spread
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POOL).repartition(4)


def exact(pool, asked, k=10):
    return {(r.query_id, r.id) for r in retrieval.knn_exact(pool, asked, k).collect()}


@pytest.mark.parametrize("table", [SF, "/root/testdata/sf0.1"])
def test_recall_on_the_given_table(spark, table):
    pool = spark.read.parquet(f"{table}/embeddings.parquet").select(F.col("vec_id").alias("img_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = pool.where("img_id % 50 = 0")
    true = exact(pool, asked)
    for search in (quantised.knn_hashed, quantised.knn_partitioned):
        assert hits(search(pool, asked, 10), true) >= 0.9


@pytest.mark.parametrize(("clusters", "spread"), [(1, 1.0), (3, 0.05), (8, 0.001), (40, 0.3)])
def test_recall_on_clusters(spark, clusters, spread):
    pool = clustered(spark, 2500, clusters, spread, clusters)
    asked = pool.where("img_id < 40")
    true = exact(pool, asked)
    assert hits(quantised.knn_partitioned(pool, asked, 10), true) >= 0.9
    if spread >= 0.05:  # without leaves, codes are not finer than the whole table's spread allows
        assert hits(quantised.knn_hashed(pool, asked, 10), true) >= 0.9


def test_fewer_leaves_are_probed_where_neighbours_lie_together(spark):
    tight, even = (quantised.coded_pool(clustered(spark, 2500, c, s, 3)) for c, s in ((40, 0.1), (1, 1.0)))
    a, b = (quantised.measured_probes(x, 10) for x in (tight, even))
    assert a <= 10 < b <= len(even.centres)


def test_the_search_reads_codes_and_not_vectors_before_it_ranks_again(spark):
    index = quantised.coded_pool(clustered(spark, 600, 6, 0.2, 1, dims=15))
    assert index.codes.columns == ["id", "leaf", "code"] and index.books.shape == (8, 256, 2)
    assert all(len(r.code) == 8 for r in index.codes.collect())
    asked = index.vectors.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    plan = quantised.candidates(index, asked, 20, 2)._jdf.queryExecution().executedPlan().toString()
    assert "code" in plan and "array<double>" not in plan.split("ReadSchema")[1]


def test_code_words_are_means_of_what_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    book = quantised.learn_words(x, 16)
    near = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    first = quantised.learn_words(x, 16, rounds=1)
    assert near.min(axis=1).mean() < ((x[:, None] - first[None]) ** 2).sum(axis=2).min(axis=1).mean()
    assert len(np.unique(near.argmin(axis=1))) == 16
    few = quantised.learn_words(np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]]), 16)
    assert few.shape == (16, 2) and {tuple(w) for w in few} == {(1.0, 2.0), (3.0, 4.0)}


def test_queries_in_blocks_find_the_same(spark, monkeypatch):
    pool = clustered(spark, 500, 10, 0.3, 5)
    index, asked = quantised.coded_pool(pool), pool.where("img_id < 60")
    one = {(r.query_id, r.rank, r.id) for r in quantised.search(index, asked, 5, probes=6).collect()}
    monkeypatch.setattr(quantised, "TABLE_BYTES", 8 * 256 * 4 * 25)
    monkeypatch.setattr(quantised, "HELD", 50)
    monkeypatch.setattr(quantised, "BROADCAST_CANDIDATES", 10)
    assert {(r.query_id, r.rank, r.id) for r in quantised.search(index, asked, 5, probes=6).collect()} == one


def test_tables_of_queries_are_made_without_a_second_copy():
    rng = np.random.default_rng(6)
    q, books = rng.normal(size=(1000, 15)), rng.normal(size=(8, 256, 2))
    tracemalloc.start()
    try:
        made = quantised.query_tables(q, books)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * made.nbytes
    assert (made == np.einsum("qbd,bwd->qbw", np.pad(q, ((0, 0), (0, 1))).reshape(1000, 8, 2), books).astype(np.float32)).all()


def test_best_rows_of_each_query_are_found_in_little_memory():
    rng = np.random.default_rng(7)
    q, ids, scores = rng.integers(0, 2000, 400_000), rng.permutation(400_000), np.round(rng.normal(size=400_000), 2)
    tracemalloc.start()
    try:
        (a, b, c), full, least = quantised.best_of_each(q, ids, scores, 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    rows = pd.DataFrame({"q": q, "id": ids, "score": scores}).sort_values(["q", "score", "id"], ascending=[True, False, True])
    rows = rows[rows.groupby("q").cumcount() < 20]
    assert (a == rows["q"]).all() and (b == rows["id"]).all() and (c == rows["score"]).all()
    assert (full == np.arange(2000)).all() and (least == rows.groupby("q")["score"].min()).all()
    assert peak < 48 * len(q)
    (a, b, c), full, least = quantised.best_of_each(np.array([3, 1, 3]), np.array(["x", "y", "w"], object), np.array([0.5, 1.0, 0.5]), 2)
    assert (list(a), list(b), list(full), list(least)) == ([1, 3, 3], ["y", "w", "x"], [3], [0.5])


def test_searches_in_blocks_and_with_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[7]
    rows = [(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), (None, x[0].tolist()), ("zero", [0.0] * 8)]
    pool = spark.createDataFrame(rows, "img_id string, embedding array<double>").repartition(5)
    asked = pool.where("img_id like 'p0%' or img_id is null or embedding is null")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(100):
        scores = np.append(np.round(unit @ unit[i], 9), 0.0)
        names = np.array([f"p{j:03d}" for j in range(300)] + ["zero"])
        want[f"p{i:03d}"] = [str(names[j]) for j in np.lexsort((names, -scores))[:12]]
    copies = {f"p{j:03d}" for j in [7, *range(100, 200)]}

    def lists(found):
        out = {}
        for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
            out.setdefault(r.query_id, []).append(r.id)
        assert out.keys() == want.keys() and all(len(ids) == len(set(ids)) == 12 for ids in out.values())
        return {q: [i if i not in copies else "copy" for i in ids] for q, ids in out.items()}

    true = {q: [i if i not in copies else "copy" for i in ids] for q, ids in want.items()}
    assert lists(retrieval.knn_exact(pool, asked, 12)) == true
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 30)
    monkeypatch.setattr(retrieval, "ROWS", 7)
    assert lists(retrieval.knn_exact(pool, asked, 12)) == true
    assert lists(quantised.knn_partitioned(pool, asked, 12, leaves=4, probes=4, reorder=150)) == true
    for search in (retrieval.knn_exact, quantised.knn_partitioned, quantised.knn_hashed):
        assert search(pool.limit(0), asked, 3).count() == 0 and search(pool, asked.limit(0), 3).count() == 0
    zeros = pool.where("img_id = 'zero'")
    assert [r.score for r in quantised.knn_partitioned(zeros, asked.limit(1), 3).collect()] == [0.0]


def test_the_way_depends_on_the_size_of_the_pool(spark, monkeypatch):
    pool = clustered(spark, 300, 3, 0.3, 6)
    used = []
    for name in ("knn_exact", "knn_hashed", "knn_partitioned"):
        monkeypatch.setattr(quantised, name, lambda *a, name=name, **k: used.append(name))
    for low, high in ((301, 400), (300, 301), (100, 300)):
        monkeypatch.setattr(quantised, "EXACT_BELOW", low)
        monkeypatch.setattr(quantised, "HASH_BELOW", high)
        quantised.knn(pool, pool, 3)
    assert used == ["knn_exact", "knn_hashed", "knn_partitioned"]
