"""Readers and writers as round trips: a table derived from the driver's is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairline.operators import curate as cu
from pairline.operators import split as sp
from pairline.plans import views
from pairline.plans.curation_queries import MERGED, UPSERT, removed_scores, results
from pairline.plans.registry import query
from pairline.plans.split_queries import DOCS
from pairline.plans.views import with_views as V  # noqa: N812
from pairline.sources import io
from pairline.sources.scratch import shared_dir
from pairline.sources.store import Store
from pairline.streaming import incremental

TRIPLE = ("original_caption", "edit_instruction", "resulting_caption")
TRIPLE_SQL = "SELECT original_caption, edit_instruction, resulting_caption FROM prompts"


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_prompts_json", V(TRIPLE_SQL, "prompts"))
def read_prompts_json(spark, d):
    """Files that hold a JSON array each, one for each part of the prompts."""
    path = fresh(spark, "prompts-json")
    arrays = views.prompts(spark, d).groupBy(F.floor(F.col("prompt_idx") / 500).alias("part")).agg(F.to_json(F.collect_list(F.struct(*TRIPLE))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return io.read_prompts_json(spark, path).select(*TRIPLE)


@query("read_prompts_jsonl", V(TRIPLE_SQL, "prompts"))
def read_prompts_jsonl(spark, d):
    path = fresh(spark, "prompts-jsonl")
    io.write_json(views.prompts(spark, d).select(*TRIPLE), path)
    return io.read_prompts_jsonl(spark, path).select(*TRIPLE)


@query("write_json", V("SELECT prompt_idx AS index, original_caption, edit_instruction, resulting_caption, 'm' || (prompt_idx % 2)::VARCHAR AS model FROM prompts", "prompts"))
def write_json(spark, d):
    path = fresh(spark, "prompts-out")
    p = views.prompts(spark, d).select(F.col("prompt_idx").alias("index"), *TRIPLE, F.struct(F.concat(F.lit("m"), (F.col("prompt_idx") % 2).cast("string")).alias("model")).alias("metadata"))
    io.write_json(p, path)
    return io.read_prompts_jsonl(spark, path).select("index", *TRIPLE, "metadata.model")


@query("read_prompt_folders", "SELECT printf('%07d', s_suppkey) AS folder, s_name AS original_caption, 'nation ' || s_nationkey::VARCHAR AS edit_instruction, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -1 END AS global_index FROM supplier")
def read_prompt_folders(spark, d):
    """A folder for each supplier, every other record wrapped."""
    path = fresh(spark, "folders")
    bare = F.struct(F.col("s_name").alias("original_caption"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("edit_instruction"))
    wrapped = F.struct(bare.alias("prompt"), F.col("s_suppkey").alias("global_index"))
    s = views.table(spark, d, "supplier").select(F.format_string("f%07d", "s_suppkey").alias("folder"), F.when(F.col("s_suppkey") % 2 == 0, F.to_json(wrapped)).otherwise(F.to_json(bare)).alias("value"))
    io.write_folders(s, path, "text")
    read = io.read_prompt_folders(spark, path, "folder=*/*.txt")
    return read.select(F.regexp_replace("folder", "^folder=f", "").alias("folder"), "original_caption", "edit_instruction", F.coalesce("global_index", F.lit(-1)).alias("global_index"))


@query("read_folder_metadata", "SELECT l_suppkey AS folder, l_orderkey AS seed, l_discount AS sim_0, l_tax AS sim_1 FROM lineitem")
def read_folder_metadata(spark, d):
    path = fresh(spark, "metadata")
    rows = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("folder"), F.col("l_orderkey").alias("seed"), F.col("l_discount").alias("sim_0"), F.col("l_tax").alias("sim_1"))
    io.write_folders(rows, path, "json")
    read = io.read_folder_metadata(spark, path, "folder=*/*.json")
    return read.select(F.substring_index("folder", "=", -1).cast("long").alias("folder"), "seed", "sim_0", "sim_1")


@query("export_caption_files", "SELECT 'image_' || (row_number() OVER (ORDER BY page_id) - 1)::VARCHAR AS name, url AS caption, md5(html) AS image_md5 FROM pages")
def export_caption_files(spark, d):
    path = fresh(spark, "pairs")
    io.export_caption_files(views.table(spark, d, "pages").select("page_id", F.col("url").alias("caption"), F.col("html").cast("binary").alias("image")), path, "page_id")
    return spark.read.parquet(path).select("name", "caption", F.md5("image").alias("image_md5"))


@query("write_csv", V("SELECT prompt_idx, question, answer, reason FROM answers", "answers"))
def write_csv(spark, d):
    path = fresh(spark, "csv")
    io.write_csv(views.answers(spark, d), path)
    return io.read_csv(spark, path, "prompt_idx bigint, question string, answer bigint, reason string")


@query("append_samples", V("SELECT prompt_idx, seed, round(sim_dir, 6) AS sim_dir FROM samples_big", "samples_big"))
def append_samples(spark, d):
    """Two appended halves."""
    path = fresh(spark, "samples")
    s = views.samples_big(spark, d).select("prompt_idx", "seed", "sim_dir")
    for half in (0, 1):
        io.append_samples(s.where(F.col("seed") % 2 == half), path)
    return spark.read.schema("prompt_idx bigint, seed bigint, sim_dir double").json(path).select("prompt_idx", "seed", F.round("sim_dir", 6).alias("sim_dir"))


@query("write_splits", f"SELECT doc_id, idx, CASE WHEN idx < floor(0.9::DOUBLE * n) THEN 'train' WHEN idx < floor((0.9::DOUBLE + 0.05::DOUBLE) * n) THEN 'val' ELSE 'test' END AS split FROM {DOCS}")
def write_splits(spark, d):
    path = fresh(spark, "splits")
    io.write_splits(sp.ratio_split(views.table(spark, d, "documents").select("doc_id"), "doc_id"), path)
    return spark.read.schema("doc_id bigint, idx bigint, split string").json(path)


@query("read_embedding_pool", "SELECT vec_id AS img_id, len(embedding)::BIGINT AS n, label AS patch FROM embeddings")
def read_embedding_pool(spark, d):
    path = fresh(spark, "pool")
    views.table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), "embedding", F.array(F.col("label").cast("int")).alias("patch_coords")).write.parquet(path)
    return io.read_embedding_pool(spark, path).select("img_id", F.size("embedding").cast("long").alias("n"), F.col("patch_coords")[0].alias("patch"))


HISTORY = "SELECT event_id::VARCHAR AS id, props AS prompt, event_type AS model FROM events"


@query("read_history", HISTORY)
def read_history(spark, d):
    path = fresh(spark, "history")
    if io.read_history(spark, path).count():
        raise ValueError("a log that is not there must be empty")
    rows = views.table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), F.col("props").alias("prompt"), F.col("event_type").alias("model"))
    io.append_history(rows.where("event_id % 3 != 0"), path)
    io.append_history(rows.where("event_id % 3 = 0"), path)
    return io.read_history(spark, path).select("id", "prompt", "model")


@query("template_table", "SELECT 'folder=' || s_suppkey::VARCHAR || '_part' AS name, s_name || chr(10) AS text FROM supplier")
def template_table(spark, d):
    """A folder with one text for each supplier; a template's name is its path, whose file part Spark chooses."""
    path = fresh(spark, "templates")
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("folder"), F.col("s_name").alias("value"))
    io.write_folders(s, path, "text")
    return io.template_table(spark, path).select(F.regexp_replace("name", "_part-.*$", "_part").alias("name"), "text")


@query("incremental_run", "SELECT event_id, value * 2 AS doubled FROM events")
def incremental_run(spark, d):
    """Half of the input, all of it, and all again."""
    path = fresh(spark, "incremental")
    e = views.table(spark, d, "events").select("event_id", "value")
    for part in (e.where("event_id % 2 = 0"), e, e):
        incremental.incremental_run(part, "event_id", lambda x: x.select("event_id", (F.col("value") * 2).alias("doubled")), path)
    return spark.read.parquet(path)


@query("keyed_stream", "SELECT event_id, value * 2 AS doubled FROM events")
def keyed_stream(spark, d):
    """Events that arrive twice, in files cut otherwise the second time; a third run finds nothing new."""
    source, path, mark = (fresh(spark, n) for n in ("arrivals", "keyed", "keyed-mark"))
    e = views.table(spark, d, "events").select("event_id", "value")
    for part in (e.where("event_id % 2 = 0"), e.repartition("event_id"), e.limit(0)):
        part.write.mode("append").parquet(source)
        incremental.keyed_stream(spark, source, "event_id bigint, value double", "event_id", lambda x: x.select("event_id", (F.col("value") * 2).alias("doubled")), path, mark)
    return spark.read.schema("event_id bigint, doubled double").parquet(path).select("event_id", "doubled")


@query("store_append", V("SELECT prompt_idx, seed, round(sim_dir, 6) AS sim_dir FROM samples_big", "samples_big"))
def store_append(spark, d):
    """Two halves appended to a stored table."""
    s = views.samples_big(spark, d).select("prompt_idx", "seed", F.round("sim_dir", 6).alias("sim_dir"))
    store = Store(spark, fresh(spark, "store"), ("prompt_idx",), "prompt_idx bigint, seed bigint, sim_dir double", 16)
    for half in (0, 1):
        store.append(s.where(F.col("seed") % 2 == half))
    return store.read()


@query("store_upsert", UPSERT)
def store_upsert(spark, d):
    """Results that are stored and then updated in three steps, of which the last touches one bucket."""
    old, new = results(spark, d)
    store = Store(spark, fresh(spark, "store"), ("uid",), "uid bigint, prompt_input string, vision_input string, score double", 16)
    store.append(old)
    last = store.bucket_of() == 7
    for part in (new.where("uid % 2 = 0").where(~last), new.where("uid % 2 = 1").where(~last), new.where(last)):
        touched = store.update(part, cu.upsert_results)
    if touched > 1:
        raise ValueError("rows of one bucket must touch no other")
    store.vacuum()
    return store.read()


@query("store_merge_removed", MERGED)
def store_merge_removed(spark, d):
    stored, new = removed_scores(spark, d)
    store = Store(spark, fresh(spark, "store"), ("folder", "seed"), "folder bigint, seed bigint, overall_score double", 16)
    store.append(stored)
    store.update(new, cu.merge_removed)
    return store.read()
