"""Indexes, splits, shards, samples and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairline.operators import split as sp
from pairline.operators.metrics import fixed_batches, next_index
from pairline.operators.order import index_rows
from pairline.plans import views
from pairline.plans.registry import query
from pairline.plans.views import H, U, with_views as V  # noqa: N812

DOCS = "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)"


def docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id")


def part_sql(idx: str, parts: int) -> str:
    return f"CASE WHEN {idx} < (n % {parts}) * (n // {parts} + 1) THEN {idx} // (n // {parts} + 1) ELSE n % {parts} + ({idx} - (n % {parts}) * (n // {parts} + 1)) // (n // {parts}) END"


@query("index_rows", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS idx FROM events")
def index_rows_(spark, d):
    return index_rows(views.table(spark, d, "events").select("event_id", "value"), "value", "event_id").select("event_id", "idx")


@query("permuted_partition", f"SELECT doc_id, place, {part_sql('place', 7)} AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY {H('perm', 'doc_id')}, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)")
def permuted_partition(spark, d):
    return sp.permuted_partition(docs(spark, d), "doc_id", "perm", 7)


@query("array_split", f"SELECT doc_id, idx, {part_sql('idx', 13)} AS part FROM {DOCS}")
def array_split(spark, d):
    return sp.array_split(docs(spark, d), "doc_id", 13)


@query("strided_shard", f"SELECT doc_id, i AS idx, i % 7 AS shard FROM {DOCS}, unnest([idx, idx + n]) AS t(i) WHERE i < n + (7 - n % 7) % 7")
def strided_shard(spark, d):
    return sp.strided_shard(docs(spark, d), "doc_id", 7, pad=True)


@query("even_shards_drop_tail", f"SELECT doc_id, idx, idx // (n // 7) AS shard FROM {DOCS} WHERE idx < n // 7 * 7")
def even_shards_drop_tail(spark, d):
    return sp.even_shards_drop_tail(docs(spark, d), "doc_id", 7)


@query("budget_shards", f"SELECT doc_id, shard, count(*) AS n FROM (SELECT doc_id, (idx * 6 + k) // b AS shard FROM (SELECT *, (n * 6 + 6) // 7 AS b FROM {DOCS}), range(0, 6) AS r(k)) GROUP BY ALL")
def budget_shards(spark, d):
    return sp.budget_shards(docs(spark, d), "doc_id", 6, 7)


@query("ratio_split", f"SELECT doc_id, idx, CASE WHEN idx < floor(0.9::DOUBLE * n) THEN 'train' WHEN idx < floor((0.9::DOUBLE + 0.05::DOUBLE) * n) THEN 'val' ELSE 'test' END AS split FROM {DOCS}")
def ratio_split(spark, d):
    return sp.ratio_split(docs(spark, d), "doc_id")


@query("group_split", f"""WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY {H('groups', 'c_nationkey')}, c_nationkey) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM customer))
  SELECT c_custkey, c_nationkey, CASE WHEN place < floor(0.9::DOUBLE * n) THEN 'train' WHEN place < floor(0.9::DOUBLE * n) + floor(0.05::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM customer JOIN g USING (c_nationkey)""")
def group_split(spark, d):
    return sp.group_split(views.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "groups")


@query("first_n_accepted", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40")
def first_n_accepted(spark, d):
    return sp.first_n_accepted(views.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", F.col("lang") == "en", 50, done=10).select("doc_id")


@query("sample_n", f"SELECT event_id FROM events ORDER BY {H('sample', 'event_id')}, event_id LIMIT 100")
def sample_n(spark, d):
    return sp.sample_n(views.table(spark, d, "events").select("event_id"), "event_id", "sample", 100)


@query("one_per_group", f"SELECT user_id, arg_min(event_id, {H('one', 'user_id', 'event_id')}) AS event_id FROM events GROUP BY user_id")
def one_per_group(spark, d):
    return sp.one_per_group(views.table(spark, d, "events"), "user_id", "event_id", "one")


def permuted_sql(domain_bits: int, seed: str, key: str) -> str:
    """Common table expressions r0 ... over draws(key, draw), the last with the permuted draw as `seed`."""
    low, high = domain_bits // 2, domain_bits - domain_bits // 2
    steps = [f"r0 AS (SELECT {key}, draw, draw::BIGINT % {1 << low} AS l, draw::BIGINT // {1 << low} AS h FROM draws)"]
    for r in range(sp.ROUNDS):
        changed = f"xor(l, {H(f'{seed}/{r}', key, 'h')} % {1 << low}) AS l, h" if r % 2 else f"l, xor(h, {H(f'{seed}/{r}', key, 'l')} % {1 << high}) AS h"
        steps.append(f"r{r + 1} AS (SELECT {key}, draw, {changed} FROM r{r})")
    return ", ".join(steps) + f" SELECT {key}, draw::INT AS draw, h * {1 << low} + l AS seed FROM r{sp.ROUNDS}"


@query("draw_seeds", "WITH draws AS (SELECT doc_id, draw FROM documents, range(0, 40) AS r(draw)), " + permuted_sql(6, "seeds", "doc_id"))
def draw_seeds(spark, d):
    """40 of 64 seeds for each document: drawn independently, half of them would collide."""
    return sp.draw_seeds(docs(spark, d), "doc_id", 40, "seeds", bits=6)


@query("draw_seeds_skip", f"SELECT doc_id, min(draw)::INT AS draw, seed FROM (SELECT doc_id, draw, {H('seeds', 'doc_id', 'draw')} % 64 AS seed FROM documents, range(0, 4) AS r(draw)) GROUP BY doc_id, seed")
def draw_seeds_skip(spark, d):
    return sp.draw_seeds(docs(spark, d), "doc_id", 4, "seeds", redraw=False, bits=6)


BOUNDS = {"cfg_scale": (3.0, 9.0), "p2p_threshold": (0.1, 0.9), "amplify_factor": (1.0, 2.0)}


@query("draw_params", "SELECT event_id, " + ", ".join(f"round({a}::DOUBLE + {U(f'params/{c}', 'event_id')} * {b - a}::DOUBLE, 6) AS {c}" for c, (a, b) in BOUNDS.items()) + " FROM events")
def draw_params(spark, d):
    drawn = sp.draw_params(views.table(spark, d, "events").select("event_id"), BOUNDS, "params", "event_id")
    return drawn.withColumns({c: F.round(c, 6) for c in BOUNDS})


FLIPS = "SELECT folder::VARCHAR || ':' || seed::VARCHAR AS sample, seed::VARCHAR || s AS path, s = '' OR (folder + seed) % 3 <> 0 AS e FROM scores, unnest(['', '_flip']) AS t(s)"


@query("flip_variant", V(f"SELECT sample, arg_min(path, {H('flip', 'sample', 'path')}) AS path, count(*) AS n_variants FROM ({FLIPS}) WHERE e GROUP BY sample", "scores"))
def flip_variant(spark, d):
    s = views.scores(spark, d).withColumn("s", F.explode(F.array(F.lit(""), F.lit("_flip"))))
    exists = (F.col("s") == "") | (F.pmod(F.col("folder") + F.col("seed"), F.lit(3)) != 0)
    return sp.flip_variant(s.select(F.concat_ws(":", "folder", "seed").alias("sample"), F.concat(F.col("seed").cast("string"), "s").alias("path"), exists.alias("exists")), "sample", "path", "flip")


@query("seed_manifest", "SELECT folder, list_transform(list_sort(list(seed::VARCHAR || '_0')), lambda x: string_split(x, '_')[1]) AS seeds FROM (SELECT o_custkey AS folder, o_orderkey AS seed FROM orders) GROUP BY folder")
def seed_manifest(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("seed"), F.lit(0).alias("side"))
    return sp.seed_manifest(o)


@query("next_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 + (SELECT max(item_id) + 1 FROM benchmark) AS idx FROM documents")
def next_index_(spark, d):
    return next_index(docs(spark, d), views.table(spark, d, "benchmark").select(F.col("item_id").alias("idx")), "doc_id")


@query("fixed_batches", f"SELECT idx // 16 AS batch, list(doc_id ORDER BY doc_id) AS members FROM {DOCS} GROUP BY batch")
def fixed_batches_(spark, d):
    return fixed_batches(docs(spark, d), "doc_id", 16)
