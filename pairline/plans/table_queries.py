"""Metrics, logs, browsing and file lists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairline.functions.hashing import hash_uniform
from pairline.operators import browse as br
from pairline.operators import metrics as me
from pairline.operators.curate import filter_report
from pairline.operators.grams import GramIndex
from pairline.operators.grams import indexed_search as indexed
from pairline.plans import views
from pairline.plans.registry import query
from pairline.plans.views import U, with_views as V  # noqa: N812
from pairline.sources import io
from pairline.sources.scratch import shared_dir

Q = me.QUESTIONS
WIDE = "SELECT prompt_idx, " + ", ".join(f"max(answer) FILTER (question = '{q}') AS {q}_answer, max(reason) FILTER (question = '{q}') AS {q}_reason" for q in Q) + " FROM answers GROUP BY prompt_idx"
SCORE = " + ".join(f"{q}_answer" for q in Q)


@query("assessment_pivot", V(WIDE, "answers"))
def assessment_pivot(spark, d):
    return me.assessment_pivot(views.answers(spark, d))


@query("assessment_score", V(f"SELECT prompt_idx, {SCORE} AS score FROM ({WIDE})", "answers"))
def assessment_score(spark, d):
    return me.assessment_score(me.assessment_pivot(views.answers(spark, d))).select("prompt_idx", "score")


@query("assessment_total", V(f"SELECT sum({SCORE})::BIGINT AS total, count(*) * 40 AS most FROM ({WIDE})", "answers"))
def assessment_total(spark, d):
    return me.assessment_total(me.assessment_score(me.assessment_pivot(views.answers(spark, d))))


@query("flatten_assessment", V(f"SELECT w.*, source AS model, lang AS persona FROM ({WIDE}) w JOIN documents ON doc_id = prompt_idx", "answers"))
def flatten_assessment(spark, d):
    wide = me.assessment_pivot(views.answers(spark, d))
    both = F.struct(*[F.struct(F.col(f"{q}_answer").alias("answer"), F.col(f"{q}_reason").alias("reason")).alias(q) for q in Q])
    meta = views.table(spark, d, "documents").select(F.col("doc_id").alias("prompt_idx"), F.struct(F.col("source").alias("model"), F.col("lang").alias("persona")).alias("metadata"))
    return me.flatten_assessment(wide.select("prompt_idx", both.alias("answers")).join(meta, "prompt_idx"))


ASKED = [("edited", "Is {after} an edit of {before}?"), ("complete", "Does {after} do all of {edit}?"), ("same_words", "Does {after} keep the words of {before}?"), ("minimal", "Is {edit} done with least change?")]


@query("assessment_questions", V("SELECT prompt_idx, question, replace(replace(replace(t, '{before}', original_caption), '{after}', resulting_caption), '{edit}', edit_instruction) AS rendered FROM prompts, (VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in ASKED) + ") v(question, t)", "prompts"))
def assessment_questions(spark, d):
    return me.assessment_questions(views.prompts(spark, d), spark.createDataFrame(ASKED, "question string, template string"))


SIMS = ("sim_0", "sim_1", "sim_direction", "sim_image")


def swept(spark, d):
    rows = views.samples_big(spark, d).withColumnRenamed("sim_dir", "sim_direction")
    return me.sweep_grid(rows, [7.5], [1.0, 1.2, 1.4, 1.6])


@query("sweep_grid", V("SELECT seed, 7.5::DOUBLE AS scale_txt, s::DOUBLE AS scale_img FROM samples_big, unnest([1.0, 1.2, 1.4, 1.6]) AS t(s)", "samples_big"))
def sweep_grid(spark, d):
    return swept(spark, d).select("seed", "scale_txt", "scale_img")


@query("sweep_means", V("SELECT 7.5::DOUBLE AS scale_txt, (1 + (seed % 4) / 5.0)::DOUBLE AS scale_img, round(avg(sim_0), 6) AS sim_0, round(avg(sim_1), 6) AS sim_1, round(avg(sim_dir), 6) AS sim_direction, round(avg(sim_image), 6) AS sim_image, count(*) AS n FROM samples_big GROUP BY ALL", "samples_big"))
def sweep_means(spark, d):
    rows = views.samples_big(spark, d).withColumnRenamed("sim_dir", "sim_direction").withColumns({"scale_txt": F.lit(7.5), "scale_img": 1 + F.pmod("seed", F.lit(4)) / 5})
    return me.sweep_means(rows).withColumns({c: F.round(c, 6) for c in SIMS})


@query("weighted_epoch_mean", "SELECT event_type AS epoch, round(sum(v * n) / sum(n), 6) AS epoch_mean FROM (SELECT event_type, avg(value) AS v, count(*) AS n FROM events GROUP BY event_type, user_id) GROUP BY 1")
def weighted_epoch_mean(spark, d):
    b = views.table(spark, d, "events").groupBy(F.col("event_type").alias("epoch"), "user_id").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return me.weighted_epoch_mean(b, "epoch").withColumn("epoch_mean", F.round("epoch_mean", 6))


ACC = "SELECT vec_id, label, list_transform(list_sort(list_transform(range(1, 11), lambda i: {'x': -(embedding[i]::DOUBLE), 'i': i - 1}))[1:3], lambda p: p.i) AS top FROM embeddings"


@query("topk_accuracy", f"SELECT round(avg(list_contains(top, label)::INT), 6) AS accuracy, count(*) AS n FROM ({ACC})")
def topk_accuracy(spark, d):
    e = views.table(spark, d, "embeddings").select("label", F.slice("embedding", 1, 10).cast("array<double>").alias("s"))
    return me.topk_accuracy(e, "s", "label", 3).withColumn("accuracy", F.round("accuracy", 6))


@query("topk_accuracy_by_step", f"SELECT vec_id % 5 AS step, round(avg(list_contains(top, label)::INT), 6) AS accuracy, count(*) AS n FROM ({ACC}) GROUP BY 1")
def topk_accuracy_by_step(spark, d):
    e = views.table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("step"), "label", F.slice("embedding", 1, 10).cast("array<double>").alias("s"))
    return me.topk_accuracy(e, "s", "label", 3, "step").withColumn("accuracy", F.round("accuracy", 6))


@query("code_perplexity", "SELECT round(exp(-sum(p * ln(p + 1e-10))), 6) AS perplexity, count(*) AS used FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY user_id)")
def code_perplexity(spark, d):
    return me.code_perplexity(views.table(spark, d, "events").select(F.col("user_id").alias("code"))).withColumn("perplexity", F.round("perplexity", 6))


@query("throughput", "SELECT event_type, round(count(*) / nullif(sum(value), 0), 6) AS per_second FROM events GROUP BY event_type")
def throughput(spark, d):
    return me.throughput(views.table(spark, d, "events"), F.lit(1), F.col("value"), "event_type").withColumn("per_second", F.round("per_second", 6))


LOG = "SELECT day, v, row_number() OVER (ORDER BY day) AS r, min(v) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS best, min(v) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, min(value) AS v FROM events GROUP BY 1)"


@query("best_checkpoint", f"SELECT day::VARCHAR AS day, v, best, n_since, n_since >= 10 AS stopped, n_since = 0 AS is_best FROM (SELECT day, v, best, r - max(CASE WHEN before IS NULL OR v < before THEN r END) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS n_since FROM ({LOG}))")
def best_checkpoint(spark, d):
    log = views.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("value").alias("v"))
    return me.best_checkpoint(log, "day", "v")


@query("filter_report", V("SELECT count(*) FILTER (status = 'kept') AS n_filtered, count(*) AS n_total FROM hub", "hub"))
def filter_report_(spark, d):
    return filter_report(views.hub(spark, d), F.col("status") == "kept")


@query("facet_search", V("SELECT doc_id FROM hub WHERE coalesce(status, 'N/A') IN ('kept', 'N/A') AND coalesce(class_name, 'N/A') IN ('src1', 'src2', 'src3', 'N/A') AND contains(lower(coalesce(original_caption, '')), 'the e')", "hub"))
def facet_search(spark, d):
    return br.facet_search(views.hub(spark, d), ["kept", "N/A"], ["src1", "src2", "src3", "N/A"], {"original_caption": "The E"}).select("doc_id")


@query("indexed_search", V("SELECT doc_id, 'the e' AS term FROM hub WHERE coalesce(status, 'N/A') IN ('kept', 'N/A') AND contains(lower(coalesce(original_caption, '')), 'the e') UNION ALL SELECT doc_id, 'xyzzy' FROM hub WHERE coalesce(status, 'N/A') IN ('kept', 'N/A') AND contains(lower(coalesce(original_caption, '')), 'xyzzy') UNION ALL SELECT doc_id, 'ab' FROM hub WHERE coalesce(status, 'N/A') IN ('kept', 'N/A') AND contains(lower(coalesce(original_caption, '')), 'ab') UNION ALL SELECT doc_id, 'license' FROM hub WHERE coalesce(status, 'N/A') IN ('kept', 'N/A') AND contains(lower(coalesce(original_caption, '')), 'license')", "hub"))
def indexed_search(spark, d):
    """Terms that are frequent, absent, too short for the index, and rare."""
    hub, index = views.hub(spark, d), GramIndex(spark, f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}")
    index.build(hub, "doc_id", ("original_caption",))
    found = [indexed(hub, index, "doc_id", ["kept", "N/A"], [], {"original_caption": t}).select("doc_id", F.lit(t.lower()).alias("term")) for t in ("The E", "xyzzy", "ab", "License")]
    return reduce(DataFrame.unionByName, found)


@query("facet_values", V("SELECT DISTINCT coalesce(class_name, 'N/A') AS value FROM hub", "hub"))
def facet_values(spark, d):
    return br.facet_values(views.hub(spark, d), "class_name")


@query("paginate", V("SELECT doc_id, ceil(n / 20.0)::BIGINT AS n_pages, 41 AS first_shown, least(60, n) AS last_shown FROM (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY doc_id) AS r FROM hub WHERE status = 'kept') WHERE r BETWEEN 41 AND 60", "hub"))
def paginate(spark, d):
    return br.paginate(views.hub(spark, d).where("status = 'kept'").select("doc_id"), "doc_id", 3)


@query("highlight", V(r"SELECT doc_id, regexp_replace(original_caption, '(\Qthe e\E)', '<mark>\1</mark>', 'gi') AS shown FROM hub", "hub"))
def highlight(spark, d):
    return views.hub(spark, d).select("doc_id", br.display_text("original_caption", "the e").alias("shown"))


@query("history_newest_first", "SELECT event_id, user_id, n - r + 1 AS number, (r - 1) // 3 AS display_row FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)")
def history_newest_first(spark, d):
    return br.history_newest_first(views.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "number", "display_row")


@query("sample_paths", V("SELECT folder, seed, 'c' || (folder % 9)::VARCHAR || '/' || seed::VARCHAR || '_0.jpg' AS input_image, 'c' || (folder % 9)::VARCHAR || '/' || seed::VARCHAR || '_1.jpg' AS output_image, seed::VARCHAR || '_0.pt' AS latent, seed AS seed_back FROM scores", "scores"))
def sample_paths(spark, d):
    s = views.scores(spark, d).select("folder", "seed", F.concat(F.lit("c"), (F.col("folder") % 9).cast("string")).alias("class_name"))
    return br.sample_paths(s).drop("class_name")


@query("image_ext_filter", V("SELECT path FROM images WHERE NOT ends_with(path, '.txt')", "images"))
def image_ext_filter(spark, d):
    return br.image_ext_filter(views.images(spark, d).select("path"))


@query("ignore_and_subset", V("""SELECT relpath, string_split(relpath, '/')[1] AS class_name, a - k AS n_ignored, k AS n_kept FROM (SELECT *, (SELECT count(*) FROM filelist) AS a, count(*) OVER () AS k FROM filelist WHERE relpath NOT IN (SELECT relpath FROM filelist WHERE page_id % 10 = 0))
  WHERE string_split(relpath, '/')[1] IN (SELECT string_split(relpath, '/')[1] FROM filelist WHERE page_id % 7 = 0)""", "filelist"))
def ignore_and_subset(spark, d):
    f = views.filelist(spark, d)
    classes = f.where("page_id % 7 = 0").select(F.substring_index("relpath", "/", 1).alias("class_name")).distinct()
    return br.ignore_and_subset(f.select("relpath"), f.where("page_id % 10 = 0"), classes)


@query("label_join", "SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label, length(source)::BIGINT AS original, upper(source) AS human FROM documents")
def label_join(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "source")
    names = docs.select("source").distinct().select("source", F.length("source").cast("long").alias("original"), F.upper("source").alias("human"))
    return br.label_join(docs, "source", names)


@query("paired_by_name", V("SELECT replace(path, '.png', '_mask.png') AS mask_path, path AS image_path FROM (SELECT DISTINCT replace(path, '.PNG', '.png') AS path FROM images WHERE ends_with(path, '.PNG') AND folder % 3 <> 0)", "images"))
def paired_by_name(spark, d):
    every = views.images(spark, d).where("path like '%.PNG'").select("folder", F.replace("path", F.lit(".PNG"), F.lit(".png")).alias("path"))
    masks = every.where("folder % 3 != 0").select(F.replace("path", F.lit(".png"), F.lit("_mask.png")).alias("path"))
    return br.paired_by_name(masks, every)


@query("read_filelist", V("SELECT relpath, '/data/' || relpath AS abspath FROM filelist", "filelist"))
def read_filelist(spark, d):
    return io.filelist(views.filelist(spark, d).select("relpath"), "/data/")


@query("read_label_dict", V("SELECT relpath AS key, page_id::VARCHAR AS value FROM filelist WHERE page_id % 2 = 0 UNION ALL SELECT page_id::VARCHAR, 'name: ' || relpath FROM filelist WHERE page_id % 2 = 1", "filelist"))
def read_label_dict(spark, d):
    """Lines of both shapes: 'value: key', inverted, and 'key rest of the line'."""
    f = views.filelist(spark, d)
    number = F.col("page_id").cast("string")
    first = f.where("page_id % 2 = 0").select(F.concat(number, F.lit(": "), "relpath").alias("value"))
    second = f.where("page_id % 2 = 1").select(F.concat(number, F.lit(" name: "), "relpath").alias("value"))
    return io.parse_label_lines(first).union(io.parse_label_lines(second, " "))


@query("hash_uniform", f"SELECT event_id, round({U('u', 'event_id')}, 6) AS u FROM events")
def hash_uniform_(spark, d):
    return views.table(spark, d, "events").select("event_id", F.round(hash_uniform("u", "event_id"), 6).alias("u"))
