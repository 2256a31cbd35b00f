"""Near-duplicates, nearest neighbours and decontamination against brute force."""

import hashlib
import re

import numpy as np
import pytest
from compare import SF, same

from pyspark.sql import functions as F

from pairline.llm import ann, common, components, decontaminate, entries, near_dup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(docs)), key=str)


def drifting(n, seed):
    """Chains of copies that drift away from their start, so that neighbours link and ends do not."""
    rng = np.random.default_rng(seed)
    words, out = [f"v{i}" for i in rng.integers(0, 500, 60)], []
    for _ in range(n):
        words = list(words)
        words[rng.integers(0, 60)] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_sql(spark, duck):
    same(entries.op3_near_duplicates(spark, SF), duck.execute(entries.OP3_SQL).df())


def test_near_duplicates_chains_and_awkward_rows(spark, awkward):
    texts = drifting(60, 1) + drifting(40, 2)
    docs = [(r.doc_id, r.text) for r in awkward.collect()] + [(100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == brute_components(docs)


def test_families_that_share_bands_and_frequent_keys(spark, monkeypatch):
    """Pairs of a family that never joins are all tried in blocks, and joins deal frequent keys over parts."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(80)]
    family = [" ".join(base + [f"own{i}x{j}" for j in range(rng.integers(8, 60))]) for i in range(40)]
    texts = family + [" ".join(base)] * 30 + drifting(25, 4)
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("x").alias("component_id"), F.lit(1).alias("kept"), F.lit(2).alias("__key"), F.lit(3).alias("node"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == brute_components(docs)
    assert len(near_dup.drop_near_duplicates(df).columns) == len(df.columns)


def test_one_document_of_each_group_stays(spark, awkward):
    kept = near_dup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 4, 5, 6, 8]
    assert near_dup.drop_near_duplicates(awkward.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(40)}


# ---- nearest neighbours ---------------------------------------------------------------------


def gaussian(n=3000, width=64, seed=3):
    return np.random.default_rng(seed).normal(size=(n, width))


def one_long():
    x = gaussian()
    x[7] *= 10_000
    return x


def recall(spark, x, k=20, **options):
    """Share of the true k nearest found for each twentieth row; all scores are checked."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k, **options).toPandas()
    hits, level = 0, x / np.abs(x).max()
    for q, rows in got.groupby("query_id"):
        score = level @ level[q]
        score[q] = -np.inf
        assert list(rows.sort_values("rank")["rank"]) == list(range(1, k + 1))
        with np.errstate(all="ignore"):
            assert np.allclose(rows["score"], (x[rows["id"]] * x[q]).sum(axis=1), rtol=1e-12, atol=1e-12)
        hits += len(set(np.lexsort((np.arange(len(x)), -score))[:k]) & set(rows["id"]))
    assert got["query_id"].nunique() == -(-len(x) // 20)
    return hits / (k * -(-len(x) // 20))


@pytest.mark.parametrize("shard_points", [4096, 300])
@pytest.mark.parametrize("name", ["unequal", "one_long", "uneven", "unit"])
def test_recall_against_brute_force(spark, name, shard_points):
    x = {"unequal": gaussian, "one_long": one_long, "uneven": lambda: gaussian() * np.random.default_rng(1).lognormal(size=(3000, 1)), "unit": lambda: gaussian() / np.linalg.norm(gaussian(), axis=1, keepdims=True)}[name]()
    assert recall(spark, x, shard_points=shard_points) >= 0.95


@pytest.mark.parametrize("factor", [1e150, 1e-150, 1e120])
def test_components_near_the_ends_of_doubles(spark, factor):
    assert recall(spark, gaussian(1000) * factor * 1.0) >= 0.95


def clusters(n, spread, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 64))[np.arange(3000) % n] + rng.normal(size=(3000, 64)) * spread


@pytest.mark.parametrize(("n", "spread", "shard_points"), [(2, 0.3, 4096), (3, 0.01, 4096), (4, 1e-4, 4096), (4, 0.3, 700), (8, 0.01, 700), (30, 1e-4, 4096)])
def test_recall_on_clusters(spark, n, spread, shard_points):
    assert recall(spark, clusters(n, spread, n), shard_points=shard_points) >= 0.95


@pytest.mark.parametrize("n", [2, 3, 4, 8, 30, 100])
def test_graphs_of_clusters_are_searched_well(n):
    for spread in (0.3, 1e-4):
        x = ann.directions(clusters(n, spread, n + 1)[:1500])[0]
        graph, entries = ann.build_graph(x)
        beam = ann.checked_beam(graph, x, np.ones(len(x)), entries, np.random.default_rng(0))
        asked = x[::15]
        found, _ = ann.beam_search(graph, x, entries, asked, beam)
        true = np.argsort(-(asked @ x.T), axis=1)[:, :20]
        assert np.mean([len(set(f[:20]) & set(t)) for f, t in zip(found, true, strict=True)]) >= 19


def test_the_beam_is_widened_where_a_graph_is_poor():
    x = ann.directions(np.random.default_rng(5).normal(size=(600, 32)))[0]
    ring = np.column_stack([(np.arange(600) + 1) % 600, (np.arange(600) - 1) % 600]).astype(np.int32)
    assert ann.checked_beam(ring, x, np.ones(600), np.array([0]), np.random.default_rng(0), 32) > 256


def test_recall_on_the_table(spark):
    x = np.array(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").toPandas()["embedding"].tolist(), float)
    assert recall(spark, x) >= 0.95


def test_overflowing_scores_are_ranked(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e200]), (2, [3e200, 1e200]), (3, [-1e200, 1e100]), (4, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.id, r.score) for r in ann.nearest(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == [(2, np.inf), (1, np.inf), (4, pytest.approx(1e-100)), (3, -np.inf)]


def test_awkward_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [0.0, 1.0]), (61, [0.0, 0.0]), (62, None), (63, [1.0, None]), (64, [float("nan"), 1.0]), (65, []), (None, [1.0, 1.0]), (66, [1.0, 2.0, 3.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert [i for _, i, _ in sorted(got[0])] == list(range(1, 21))
    assert [i for _, i, _ in sorted(got[30])] == list(range(20))
    assert [s for _, _, s in sorted(got[60])] == [0.0] * 20 and [i for _, i, _ in sorted(got[60])] == list(range(20))
    assert set(got) == set(range(61))  # 66 has no candidate of its length
    assert ann.nearest(df.limit(0), df.limit(0), 3).count() == 0


def test_pruned_graph_keeps_degrees_and_reaches_all():
    x = ann.directions(np.random.default_rng(0).normal(size=(300, 8)))[0]
    graph, entries = ann.build_graph(x, degree=12, beam=24)
    assert len(set(entries.tolist())) == len(entries) == 300 or len(entries) > ann.FAR_ENTRIES
    assert graph.shape[0] == 300 and 12 <= graph.shape[1] <= 12 + ann.ADOPTED
    for i, row in enumerate(graph):
        own = row[row < 300]
        assert i not in own and len(set(own)) == len(own)
    lone = np.full((300, 4), 300, np.int32)  # a graph without edges
    seen = np.zeros(300, bool)
    ann.reached(ann.adopt(lone, x, int(entries[0])), entries[:1], seen)
    assert seen.all()


# ---- decontamination ------------------------------------------------------------------------


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(LOWER))
        k = min(13, len(own))
        for j in range(len(own) - k + 1 if own else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[j : j + k]:
                    hit |= set(range(i, i + k))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_sql(spark, duck):
    same(entries.op10_decontaminate(spark, SF), duck.execute(entries.OP10_SQL).df())


def test_few_slices_are_in_flight(spark, monkeypatch):
    """A benchmark of many slices is searched by few at a time, whose broadcasts are given up before the next."""
    monkeypatch.setattr(decontaminate, "SLICE_PAIRS", 5)
    alive, most, send = set(), [0], spark.sparkContext.broadcast

    def broadcast(value):
        held = send(value)
        alive.add(held)
        most[0] = max(most[0], len(alive))
        give_up = held.destroy
        held.destroy = lambda: (alive.discard(held), give_up())
        return held

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(18))) for i in range(8)]
    docs = [(i, f"start {items[i % 8][1]} middle {items[3][1]} end") for i in range(20)] + [(30, "clean"), (31, None)]
    got = {r.doc_id: tuple(r[2:]) for r in decontaminate.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_hits(t, items) for i, t in docs}
    assert not alive and most[0] == decontaminate.IN_FLIGHT


@pytest.mark.parametrize("pairs", [100_000, 7])
def test_windows_of_all_lengths(spark, awkward, pairs, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_PAIRS", pairs)
    text = " ".join(f"t{i % 5}" for i in range(40))
    items = [(1, text), (2, "Only two"), (3, None), (4, ""), (None, "lazy dog"), (2, "fox JUMPS over"), (10, "größe"), (5, text), (1, text)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = awkward.union(spark.createDataFrame([(20, "x y " + text + " t0 t1 z", "a", "en", 1, 1, 1.0, 1)], awkward.schema))
    got = sorted((str(r.doc_id), *r[-5:]) for r in decontaminate.annotate(docs, bench).collect())
    assert got == sorted((str(r.doc_id), *brute_hits(r.text, items)) for r in docs.collect())
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert decontaminate.annotate(docs.limit(0), bench).count() == 0
    assert decontaminate.annotate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_shift_table_agrees_with_plain_search():
    rng = np.random.default_rng(5)
    for length in (1, 2, 3, 13):
        words = [b"abc"[k : k + 1] for k in rng.integers(0, 3, 400)]
        windows = {tuple(words[i : i + length]): [str(i)] for i in rng.integers(0, 380, 12).tolist()}
        got = [i for i, _ in decontaminate.WuManber(length, windows).find(words)]
        assert got == [i for i in range(400 - length + 1) if tuple(words[i : i + length]) in windows]
