"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Equal vectors are one point (with the k + 1 smallest ids that it stands for). Points are dealt into bands of nearly equal
length, and a band into shards of bounded size by a hash, so that within a shard the largest inner product is close to the
smallest angle. The graph of a shard is built on directions alone and starts at random; greedy beam searches
propose neighbours of each point, and pruning keeps a candidate only if no kept one is closer
to it by the factor ALPHA, so that short and long edges in different directions stay. Reverse edges are added and pruned alike, and
a point that cannot be reached from the first entry afterwards is linked from its nearest reachable one. A shard that falls into clusters
larger than the beam would keep a search in the first of them: a search begins at the nearest of many entries, points chosen
farthest-first and at random, so that such a cluster has one. Each shard searches for a sample of its own points and widens its beam until
CHECKED_RECALL of their nearest are found.
A query's block visits every shard, where a beam search by inner product walks the graph; what it finds is scored again on the
original vectors in double precision and merged. Each row is indexed; nothing is sampled. Every shard gives k + 1 points where it
has as many, so that a query gets k rows wherever there are k candidates.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows without an id; vectors are compared with those of their own length only; an id that
stands repeatedly with one vector counts once, with several vectors each is a row, and a
query never finds its own id; ties go to the smaller id; scores beyond the range of a double are infinite (or zero) but ranked by
what they would be; fewer candidates than k give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairline.llm.common import cut, small_batches

SHARD_POINTS, QUERY_BLOCK = 4096, 1024
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, STEP = 32, 64, 128, 1.2, 4
BUILD_BLOCK, ADOPTED = 256, 4
#: Entries of a shard that are chosen farthest-first and at random; the nearest ones that a search begins with.
FAR_ENTRIES, RANDOM_ENTRIES, SEEDS = 64, 256, 16
#: Points of a shard that are searched for once it is built, how many of their nearest count, and which share must be found.
CHECKED, CHECKED_NEAREST, CHECKED_RECALL = 64, 21, 0.97
#: Bands of length for each doubling: the longest vector of a band is 9 % longer than its shortest.
BANDS_PER_OCTAVE = 8
#: There are at most 17,000 bands for each number of components; so many in all are broadcast. Tasks that build and search, at most.
BROADCAST_BANDS, TASKS = 20_000, 4096


def valid(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def band_of(vector: Column) -> Column:
    """The number of the band of length of a vector, whatever the size of its components."""
    v = F.transform(vector, lambda x: F.abs(x.cast("double")))
    top = F.array_max(v)
    start = F.struct(F.lit(0.0).alias("total"), top.alias("top"))  # the largest component is found once
    squares = F.aggregate(v, start, lambda s, x: F.struct((s["total"] + (x / s["top"]) * (x / s["top"])).alias("total"), s["top"].alias("top")), lambda s: s["total"])
    return F.floor((F.log2(top) + F.log2(squares) / 2) * BANDS_PER_OCTAVE + 0.5).cast("int")


# ---- the graph of one shard -----------------------------------------------------------------


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x in rows whose largest component is between a half and one, the powers of two taken out, and the rows' lengths then."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    part = np.ldexp(x, -power[:, None])
    return part, power, np.sqrt((part * part).sum(axis=1))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and their share of the length of the longest row."""
    part, power, length = scaled(x)
    logs = power + np.log2(length)
    return part / length[:, None], np.exp2(logs - logs.max())


def products(x: np.ndarray, chosen: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of each query with its chosen rows of x, and the order of those that a double cannot hold (0 for the others)."""
    part, power, _ = scaled(x)
    asked, turned, _ = scaled(queries)
    with np.errstate(all="ignore"):
        plain = np.einsum("qbd,qd->qb", x[chosen], queries)
        value = np.einsum("qbd,qd->qb", part[chosen], asked)
        size = power[chosen] + turned[:, None]
        score = np.where(np.isfinite(plain), plain, np.ldexp(value, size))
        lost = np.isinf(score) | (score == 0) & (value != 0)
        beyond = np.where(lost, np.sign(value) * (size + np.log2(np.abs(value)) + 5000), 0.0)
    return score, beyond


def beam_search(graph: np.ndarray, x: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` points found nearest to each query, best first, with their inner products; -1 where there are fewer."""
    q, n = len(queries), len(x)
    ids = np.full((q, beam), -1, np.int64)
    near = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    rows = np.arange(q)
    offered = queries @ x[entries].T
    seeds = min(SEEDS, beam, len(entries))
    first = np.argpartition(-offered, seeds - 1, axis=1)[:, :seeds]
    ids[:, :seeds], near[:, :seeds], done[:, :seeds] = entries[first], np.take_along_axis(offered, first, 1), False
    seen = np.zeros((q, n + 1), bool)  # the last column takes what is not there
    seen[rows[:, None], ids[:, :seeds]] = seen[:, n] = True
    step = min(STEP, beam)
    while True:
        open_ = np.where(done, -np.inf, near)
        pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (q, 1))
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        active = rows[live.any(axis=1)]
        if not len(active):
            return ids, near
        pick, live = pick[active], live[active]
        np.put_along_axis(done_part := done[active], pick, True, 1)
        done[active] = done_part
        chosen = np.where(live, np.take_along_axis(ids[active], pick, 1), n)
        found = np.append(graph, np.full((1, graph.shape[1]), n, graph.dtype), axis=0)[chosen].reshape(len(active), -1)
        found.sort(axis=1)
        fresh = ~seen[active[:, None], found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        width = int(fresh.sum(axis=1).max(initial=0))
        if not width:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        found = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(found, order, 1), n)
        seen[active[:, None], found] = True
        there = found < n
        value = np.einsum("qwd,qd->qw", x[np.where(there, found, 0)], queries[active])
        value = np.where(there, value, -np.inf)
        all_ids = np.concatenate([ids[active], np.where(there, found, -1)], axis=1)
        all_near = np.concatenate([near[active], value], axis=1)
        all_done = np.concatenate([done[active], ~there], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active], near[active], done[active] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_near, all_done))


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each point at most `degree` of its candidates (-1: none), nearest first, without those that a kept one covers."""
    b, c = candidates.shape
    alive = (candidates >= 0) & (candidates != points[:, None])
    ordered = np.sort(np.where(alive, candidates, len(x)), axis=1)
    alive = ordered < len(x)
    alive[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
    ids = np.where(alive, ordered, 0)
    near = np.where(alive, np.einsum("bcd,bd->bc", x[ids], x[points]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near, alive = (np.take_along_axis(v, order, 1) for v in (ids, near, alive))
    own = x[ids]
    length = (x[0] ** 2).sum()
    to_point = np.maximum(length - near, 0)  # half the squared distance, as all lengths are one
    between = np.maximum(length - own @ own.transpose(0, 2, 1), 0)
    out = np.full((b, degree), -1, np.int64)
    rows = np.arange(b)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = ids[rows, first][some]
        covered = alpha * alpha * between[rows, first] <= to_point
        alive &= ~(covered & some[:, None])
        alive[rows, first] = False
    return out


def choose_entries(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Different points: the one nearest to the mean, then each time the one farthest from those chosen, then random ones."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[chosen[0]]
    for _ in range(min(FAR_ENTRIES, len(x)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    others = rng.permutation(len(x))[:RANDOM_ENTRIES]
    return np.array(list(dict.fromkeys([*chosen, *others.tolist()])), np.int64)


def checked_beam(graph: np.ndarray, unit: np.ndarray, length: np.ndarray, entries: np.ndarray, rng: np.random.Generator, beam: int = SEARCH_BEAM) -> int:
    """The beam, doubled until searches for some of the points find CHECKED_RECALL of what comparing with all points finds.

    Inner products count, as in a search: where directions hardly differ, the longest points are nearest to all, and a graph
    of directions leads to them with a wide beam only.
    """
    asked, x = unit[rng.permutation(len(unit))[:CHECKED]], unit * length[:, None]
    k = min(CHECKED_NEAREST, len(x))
    exact = asked @ x.T
    least = np.partition(exact, -k, axis=1)[:, -k]
    while beam < len(x):
        found, near = beam_search(graph, x, entries, asked, beam)
        if (np.minimum(((near >= least[:, None] - 1e-12) & (found >= 0)).sum(axis=1), k)).sum() >= CHECKED_RECALL * k * len(asked):
            return beam
        beam *= 2
    return len(x)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists, n where there is none, and the entries, from the first of which all points are reached; x has rows of one length."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entries = choose_entries(x, rng)
    if n <= degree + 1:
        full = np.array([[j for j in range(n) if j != i] for i in range(n)], np.int64).reshape(n, n - 1)
        return np.column_stack([full, np.full((n, max(0, degree - n + 1)), n)]).astype(np.int32), entries
    graph = np.full((n, degree), n, np.int64)
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for alpha in (1.0, ALPHA):
        turns = rng.permutation(n)
        for at in range(0, n, BUILD_BLOCK):
            points = turns[at : at + BUILD_BLOCK]
            found, _ = beam_search(graph, x, entries, x[points], beam)
            old = np.where(graph[points] < n, graph[points], -1)
            chosen = robust_prune(x, points, np.concatenate([found, old], axis=1), alpha, degree)
            graph[points] = np.where(chosen >= 0, chosen, n)
            _reverse(graph, x, points, chosen, alpha, degree)
    return adopt(graph.astype(np.int32), x, int(entries[0])), entries


def reached(graph: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> None:
    """Mark in seen all points that the graph leads to from starts."""
    n = len(graph)
    seen[starts] = True
    while len(starts):
        ahead = np.unique(graph[starts])
        starts = ahead[ahead < n]
        starts = starts[~seen[starts]]
        seen[starts] = True


def adopt(graph: np.ndarray, x: np.ndarray, entry: int) -> np.ndarray:
    """The graph with an edge to each point that the entry does not reach, from its nearest reached one; each gets at most ADOPTED of these."""
    n, degree = graph.shape
    graph = np.column_stack([graph, np.full((n, ADOPTED), n, graph.dtype)])
    seen, used = np.zeros(n, bool), np.zeros(n, int)
    reached(graph, np.array([entry]), seen)
    while not seen.all():
        lost, free = np.flatnonzero(~seen)[:BUILD_BLOCK], np.flatnonzero(seen & (used < ADOPTED))
        parents = free[(x[lost] @ x[free].T).argmax(axis=1)]
        taken = []
        for point, parent in zip(lost.tolist(), parents.tolist(), strict=True):
            if used[parent] < ADOPTED:
                graph[parent, degree + used[parent]] = point
                used[parent] += 1
                taken.append(point)
        reached(graph, np.array(taken), seen)
    return graph[:, : degree + used.max()]


def _reverse(graph: np.ndarray, x: np.ndarray, points: np.ndarray, chosen: np.ndarray, alpha: float, degree: int) -> None:
    """Add the edge back from each chosen neighbour; lists that overflow are pruned."""
    n = len(x)
    back, to = np.repeat(points, chosen.shape[1]), chosen.ravel()
    back, to = back[to >= 0], to[to >= 0]
    there = (graph[to] == back[:, None]).any(axis=1)
    back, to = back[~there], to[~there]
    order = np.argsort(to, kind="stable")
    back, to = back[order], to[order]
    heads, begins, counts = np.unique(to, return_index=True, return_counts=True)
    if not len(heads):
        return
    more = np.full((len(heads), counts.max()), -1, np.int64)
    more[np.repeat(np.arange(len(heads)), counts), np.arange(len(to)) - np.repeat(begins, counts)] = back
    held = (graph[heads] < n).sum(axis=1)
    fits = held + counts <= degree
    for i in np.flatnonzero(fits):
        graph[heads[i], graph[heads[i]] == n] = np.append(more[i][: counts[i]], np.full(degree - held[i] - counts[i], n))
    over = np.flatnonzero(~fits)
    for at in range(0, len(over), BUILD_BLOCK):
        part = over[at : at + BUILD_BLOCK]
        old = np.where(graph[heads[part]] < n, graph[heads[part]], -1)
        kept = robust_prune(x, heads[part], np.concatenate([old, more[part]], axis=1), alpha, degree)
        graph[heads[part]] = np.where(kept >= 0, kept, n)


# ---- Spark: points, index, search -----------------------------------------------------------


def points_of(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(h1, h2, vector, ids, dim, band): each different vector once, with its `keep` smallest ids, which are cut before they are gathered."""
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit("point"), vector).alias("h2")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    least = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.select("id", "h1", "h2").distinct().withColumn("place", F.row_number().over(least)).where(F.col("place") <= keep)
    ids = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = rows.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).join(ids, ["h1", "h2"])
    return points.withColumns({"dim": F.size("vector"), "band": band_of(F.col("vector"))})


def layout_of(points: DataFrame, shard_points: int) -> DataFrame:
    """(dim, band, parts, base): how many shards a band has, and how many the bands before it."""
    bands = points.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_points).cast("int").alias("parts"))
    before = F.sum("parts").over(Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    return bands.withColumn("base", F.coalesce(before, F.lit(0)).cast("int"))


INDEX = "dim int, shard int, points long, ids binary, counts binary, vectors binary, graph binary, entries binary, beam int"


def build_index(points: DataFrame, layout: DataFrame) -> DataFrame:
    """One row for each shard: its points' vectors, their ids, and neighbour lists."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h1", "h2"])
        own = np.array(pdf["vector"].tolist(), np.float64)
        unit, length = directions(own)
        graph, entries = build_graph(unit)
        beam = checked_beam(graph, unit, length, entries, np.random.default_rng(11))
        counts = np.array([len(v) for v in pdf["ids"]], np.int64)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "points": len(own), "ids": np.concatenate(pdf["ids"].tolist()).astype(np.int64).tobytes(), "counts": counts.tobytes(), "vectors": own.tobytes(), "graph": graph.tobytes(), "entries": entries.tobytes(), "beam": beam}])

    bands, shards = layout.agg(F.count("*"), F.coalesce(F.sum("parts"), F.lit(0))).first()
    placed = points.join(F.broadcast(layout) if bands <= BROADCAST_BANDS else layout, ["dim", "band"])
    rows = placed.select("dim", (F.col("base") + F.pmod("h1", "parts")).cast("int").alias("shard"), "h1", "h2", "ids", "vector")
    # by ranges of the shards' numbers, so that no two large ones meet in a task by chance
    return rows.repartitionByRange(max(1, min(TASKS, shards)), "dim", "shard").groupBy("dim", "shard").applyInPandas(build, INDEX)


def best_ids(found: np.ndarray, score: np.ndarray, beyond: np.ndarray, ids: np.ndarray, counts: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score, beyond), the k best of each query by score and smaller id, its own id left out; found: points, -1 for none."""
    begins = np.cumsum(counts) - counts
    alone = (counts[found] == 1) & (ids[begins[found]] == own[:, None])
    score = np.where((found < 0) | alone, -np.inf, score)
    there = ~((found < 0) | alone)
    order = np.lexsort((ids[begins[found]], -beyond, -score, ~there), axis=1)[:, : k + 1]
    point, there = (np.take_along_axis(v, order, 1).ravel() for v in (found, there))
    value, rest = (np.take_along_axis(v, order, 1).ravel()[there] for v in (score, beyond))
    query, point = np.repeat(np.arange(len(found)), order.shape[1])[there], point[there]
    n = counts[point]
    at = np.repeat(begins[point], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    query, value, rest, each = np.repeat(query, n), np.repeat(value, n), np.repeat(rest, n), ids[at]
    other = each != own[query]
    query, value, rest, each = query[other], value[other], rest[other], each[other]
    order = np.lexsort((each, -rest, -value, query))
    query, value, rest, each = query[order], value[order], rest[order], each[order]
    first = np.searchsorted(query, np.arange(len(found)))
    kept = np.arange(len(query)) - first[query] < k
    return query[kept], each[kept], value[kept], rest[kept]


def search(index: DataFrame, layout: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, query_key, id, score, beyond): the k nearest ids found in each shard. queries: (query_id, vector, dim)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    keyed = queries.select("query_id", F.xxhash64("vector", F.lit("point")).alias("query_key"), "vector", "dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))

    def gather(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.column_stack([pdf["query_id"].to_numpy(np.int64), pdf["query_key"].to_numpy(np.int64)])
        return pd.DataFrame([{"dim": key[0], "query_ids": ids.tobytes(), "matrix": np.array(pdf["vector"].tolist(), np.float64).tobytes()}])

    packed = cut(keyed.groupBy("dim", "block").applyInPandas(gather, "dim int, query_ids binary, matrix binary"), "queries")
    numbers = layout.groupBy("dim").agg(F.sum("parts").cast("int").alias("shards"))  # a row for each number of components
    tasks = max(1, min(TASKS, 4 * (layout.agg(F.sum("parts")).first()[0] or 0)))
    work = packed.join(numbers, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    work = work.repartition(tasks, "dim", "shard").join(index.repartition(tasks, "dim", "shard"), ["dim", "shard"])
    width = max(beam, k + 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                own = np.frombuffer(r.vectors).reshape(r.points, r.dim)
                graph = np.frombuffer(r.graph, np.int32).reshape(r.points, -1)
                ids, counts = np.frombuffer(r.ids, np.int64), np.frombuffer(r.counts, np.int64)
                query_ids = np.frombuffer(r.query_ids, np.int64).reshape(-1, 2)
                asked = np.frombuffer(r.matrix).reshape(len(query_ids), r.dim)
                unit, length = directions(own)
                found, _ = beam_search(graph, unit * length[:, None], np.frombuffer(r.entries, np.int64), directions(asked)[0], min(max(width, r.beam), r.points))
                score, beyond = products(own, np.maximum(found, 0), asked)
                query, each, value, rest = best_ids(found, score, beyond, ids, counts, query_ids[:, 0], k)
                yield pd.DataFrame({"query_id": query_ids[query, 0], "query_key": query_ids[query, 1], "id": each, "score": value, "beyond": rest})

    return work.mapInPandas(walk, "query_id long, query_key long, id long, score double, beyond double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, id, score): for each row of queries the k nearest rows of vectors found, its own id left out."""
    small_batches(vectors.sparkSession)
    points = cut(points_of(vectors, id_col, vector_col, k + 1), "points")
    layout = cut(layout_of(points, shard_points), "layout")
    index = cut(build_index(points, layout), "graphs")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector")).where(F.col("query_id").isNotNull() & valid(F.col("vector"))).distinct().withColumn("dim", F.size("vector"))
    found = search(index, layout, asked, k, beam)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
