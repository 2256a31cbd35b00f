"""Curation: filters, set differences, top-k, judge scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairline.functions import vectors as vx
from pairline.functions.hashing import hash_long, hash_uniform
from pairline.functions.text import folder_key
from pairline.operators import curate as cu
from pairline.operators import infer, judge, seen
from pairline.plans import views
from pairline.plans.prompt_queries import DIFF
from pairline.plans.registry import query
from pairline.plans.views import H, U, with_views as V  # noqa: N812
from pairline.sources import io
from pairline.sources.scratch import shared_dir

#: The driver's vectors are nearly orthogonal, so that the presets keep none of them.
FIXTURE = cu.Thresholds(text=-0.05, direction=-0.05, image=0.1, max_out=4, overall=2.0)
BIG = cu.Thresholds(text=0.2, direction=0.2, image=0.7, max_out=4)
SIMS = ("sim_0", "sim_1", "sim_dir", "sim_image")


def rounded(df, *columns):
    return df.withColumns({c: vx.rounded(F.col(c)) for c in columns})


@query("drop_flagged", V("SELECT gen_order FROM captions WHERE gen_order NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "captions"))
def drop_flagged(spark, d):
    flags = views.table(spark, d, "labels").select(F.col("doc_id").alias("gen_order"), (F.col("toxic") == 1).alias("flagged"))
    return cu.drop_flagged(views.captions(spark, d), flags, "gen_order").select("gen_order")


@query("nsfw_filter", f"SELECT doc_id FROM labels WHERE {U('nsfw', 'doc_id')} < 0.85")
def nsfw_filter(spark, d):
    score = hash_uniform("nsfw", "doc_id")
    both = F.array(F.struct(F.lit("normal").alias("label"), (1 - score).alias("score")), F.struct(F.lit("nsfw").alias("label"), score.alias("score")))
    return cu.nsfw_filter(views.table(spark, d, "labels").select("doc_id", both.alias("labels"))).select("doc_id")


PASS = "sim_image >= 0.7::DOUBLE AND sim_dir >= 0.2::DOUBLE AND sim_0 >= 0.2::DOUBLE AND sim_1 >= 0.2::DOUBLE"
SIX = ", ".join(f"round({c}, 6) AS {c}" for c in SIMS)


@query("threshold_filter", V(f"SELECT prompt_idx, seed, {SIX} FROM samples_big WHERE {PASS}", "samples_big"))
def threshold_filter(spark, d):
    return rounded(cu.threshold_filter(views.samples_big(spark, d), BIG), *SIMS)


@query("topk_per_prompt", V(f"SELECT prompt_idx, seed, {SIX}, rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_idx ORDER BY sim_dir DESC, seed DESC)::INT AS rank FROM samples_big WHERE {PASS}) WHERE rank <= 4", "samples_big"))
def topk_per_prompt(spark, d):
    return rounded(cu.topk_per_prompt(views.samples_big(spark, d), BIG), *SIMS)


@query("rank_unfiltered", V("SELECT prompt_idx, seed, row_number() OVER (PARTITION BY prompt_idx ORDER BY sim_dir DESC, seed DESC)::INT AS rank FROM samples_big", "samples_big"))
def rank_unfiltered(spark, d):
    return cu.rank_unfiltered(views.samples_big(spark, d)).select("prompt_idx", "seed", "rank")


@query("vie_score", V("SELECT folder, seed, semantics_score, quality_score, round(overall_score, 6) AS overall_score FROM overall", "overall"))
def vie_score(spark, d):
    return rounded(views.overall(spark, d), "overall_score")


ROUTED = "SELECT folder, seed, CASE WHEN overall_score < 2 THEN 'removed' ELSE 'kept' END AS status FROM scores LEFT JOIN overall USING (folder, seed)"


@query("route_by_score", V(ROUTED, "overall"))
def route_by_score(spark, d):
    scored = views.scores(spark, d).select("folder", "seed").join(views.overall(spark, d), ["folder", "seed"], "left")
    return cu.route_by_score(scored, 2.0).select("folder", "seed", "status")


def removed(spark, d):
    return views.overall(spark, d).where("overall_score < 2")


@query("drop_removed", V("SELECT folder, seed FROM scores ANTI JOIN (SELECT * FROM overall WHERE overall_score < 2) USING (folder, seed)", "overall"))
def drop_removed(spark, d):
    return cu.drop_removed(views.scores(spark, d).select("folder", "seed"), removed(spark, d))


@query("removal_report", V("SELECT folder, count(*) AS n_seeds, count(*) * 2 AS n_images FROM overall WHERE overall_score < 2 GROUP BY folder", "overall"))
def removal_report(spark, d):
    return cu.removal_report(removed(spark, d))


MERGED = V("SELECT folder, seed, coalesce(a.s, b.s) AS overall_score FROM (SELECT folder, seed, 1.0::DOUBLE AS s FROM overall WHERE overall_score < 2 AND folder % 2 = 0) a FULL JOIN (SELECT folder, seed, round(overall_score, 6) AS s FROM overall WHERE overall_score < 2) b USING (folder, seed)", "overall")


def removed_scores(spark, d):
    """Stored and new scores of removed samples."""
    new = rounded(removed(spark, d), "overall_score").select("folder", "seed", "overall_score")
    return new.where("folder % 2 = 0").withColumn("overall_score", F.lit(1.0)), new


@query("merge_removed", MERGED)
def merge_removed(spark, d):
    return cu.merge_removed(*removed_scores(spark, d))


UPSERT = """SELECT coalesce(a.uid, b.uid) AS uid, coalesce(nullif(b.p, ''), a.p) AS prompt_input, coalesce(nullif(b.v, ''), a.v) AS vision_input, coalesce(b.s, a.s) AS score
  FROM (SELECT o_orderkey AS uid, o_orderpriority AS p, o_orderstatus AS v, o_totalprice AS s FROM orders WHERE o_orderkey % 3 <> 0) a
  FULL JOIN (SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'new' END AS p, o_orderstatus || 'x' AS v, CASE WHEN o_orderkey % 5 <> 0 THEN 1.0::DOUBLE END AS s FROM orders WHERE o_orderkey % 4 <> 0) b ON a.uid = b.uid"""


def results(spark, d):
    """Old and new results of orders."""
    o = views.table(spark, d, "orders").withColumnRenamed("o_orderkey", "uid")
    old = o.where("uid % 3 != 0").select("uid", F.col("o_orderpriority").alias("prompt_input"), F.col("o_orderstatus").alias("vision_input"), F.col("o_totalprice").alias("score"))
    new = o.where("uid % 4 != 0").select("uid", F.when(F.col("uid") % 2 == 0, "").otherwise("new").alias("prompt_input"), F.concat("o_orderstatus", F.lit("x")).alias("vision_input"), F.when(F.col("uid") % 5 != 0, 1.0).alias("score"))
    return old, new


@query("upsert_results", UPSERT)
def upsert_results(spark, d):
    return cu.upsert_results(*results(spark, d))


@query("pending_prompts", "SELECT o_orderkey AS folder FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_prompts(spark, d):
    done = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("folder"))
    return cu.pending_prompts(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("folder")), done)


@query("pending_scores", V("SELECT DISTINCT o_orderkey AS folder FROM orders WHERE o_orderkey IN (SELECT folder FROM scores) AND o_orderkey NOT IN (SELECT folder FROM scores WHERE scored)", "scores"))
def pending_scores(spark, d):
    s = views.scores(spark, d)
    return cu.pending_scores(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("folder")).distinct(), s.select("folder"), s.where("scored").select("folder"))


@query("resume_unseen", V("SELECT gen_order FROM captions WHERE caption NOT IN (SELECT caption FROM captions WHERE gen_order % 10 = 0) AND url NOT IN (SELECT url FROM captions WHERE gen_order % 10 = 0)", "captions"))
def resume_unseen(spark, d):
    c = views.captions(spark, d)
    return cu.resume_unseen(c, c.where("gen_order % 10 = 0")).select("gen_order")


@query("resume_unseen_filtered", V("SELECT gen_order FROM captions WHERE caption NOT IN (SELECT caption FROM captions WHERE gen_order % 10 = 0) AND url NOT IN (SELECT url FROM captions WHERE gen_order % 10 = 0)", "captions"))
def resume_unseen_filtered(spark, d):
    """As resume_unseen; the seen captions and urls were added by two runs."""
    c = views.captions(spark, d)
    keys = {k: seen.SeenKeys(spark, f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}", expected=100_000, buckets=16) for k in ("caption", "url")}
    for part in (0, 10):
        for name, known in keys.items():
            known.add(c.where(F.col("gen_order") % 20 == part), name)
    return seen.resume_unseen(c, keys).select("gen_order")


@query("pending_prompts_filtered", "SELECT o_orderkey AS folder FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_prompts_filtered(spark, d):
    done = seen.SeenKeys(spark, f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}", "bigint", expected=20_000, buckets=16)
    done.add(views.table(spark, d, "lineitem"), "l_orderkey")
    return done.unseen(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("folder")), "folder")


@query("complete_pairs", V("SELECT folder, seed, bool_or(side = 0) AND bool_or(side = 1) AS complete FROM images GROUP BY folder, seed", "images"))
def complete_pairs(spark, d):
    return cu.complete_pairs(views.images(spark, d))


@query("attach_prompt", V("SELECT seed, folder, o_orderpriority AS caption FROM scores JOIN orders ON o_orderkey = folder AND o_orderkey % 3 <> 0", "scores"))
def attach_prompt(spark, d):
    p = views.table(spark, d, "orders").where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("folder"), F.col("o_orderpriority").alias("caption"))
    return cu.attach_prompt(views.scores(spark, d).select("folder", "seed"), p)


CURATE = """SELECT t.prompt_idx, t.seed, t.rank, round(sim_0, 6) AS sim_0, round(sim_1, 6) AS sim_1, round(sim_dir, 6) AS sim_dir, round(sim_image, 6) AS sim_image, round(o, 6) AS overall_score, CASE WHEN o < 2 THEN 'removed' ELSE 'kept' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY prompt_idx ORDER BY sim_dir DESC, seed DESC)::INT AS rank FROM metrics WHERE sim_image >= 0.1::DOUBLE AND sim_dir >= -0.05::DOUBLE AND sim_0 >= -0.05::DOUBLE AND sim_1 >= -0.05::DOUBLE) t
  LEFT JOIN (SELECT prompt_idx, seed, sqrt(least(a, b) * least(b, c)) AS o FROM (SELECT prompt_idx, seed, """ + ", ".join(f"({H(f'judge{n}', 'prompt_idx', 'seed')} % 11)::DOUBLE AS {c}" for n, c in ((1, "a"), (2, "b"), (3, "c"))) + """ FROM samples WHERE """ + H("judge", "prompt_idx", "seed") + """ % 7 <> 0)) s USING (prompt_idx, seed)
  WHERE rank <= 4"""


def judged(samples):
    h = hash_long("judge", "prompt_idx", "seed")
    a, b, c = (F.pmod(hash_long(f"judge{n}", "prompt_idx", "seed"), F.lit(11)).cast("double") for n in (1, 2, 3))
    return samples.where(F.pmod(h, F.lit(7)) != 0).select("prompt_idx", "seed", F.array(a, b).alias("sc"), F.array(b, c).alias("pq"))


@query("curate", V(CURATE, "metrics"))
def curate(spark, d):
    from pairline.functions.vectors import pair_metrics_clip

    s = views.samples(spark, d)
    rated = s.select("prompt_idx", "seed", *[v.alias(k) for k, v in pair_metrics_clip(F.col("image0"), F.col("image1"), F.col("text0"), F.col("text1")).items()])
    out = cu.curate(rated, judged(s.select("prompt_idx", "seed")), FIXTURE)
    return rounded(out, *SIMS, "overall_score").select("prompt_idx", "seed", "rank", *SIMS, "overall_score", "status")


PREFIXED = ", ".join(f"CASE WHEN starts_with({c}, '{views.PHRASE}') THEN {c} ELSE '{views.PHRASE}' || {c} END AS {c}" for c in ("original_caption", "resulting_caption"))
PAIRS = f"""SELECT c.* EXCLUDE (status), original_caption, resulting_caption, edit_instruction, amplify, suppress, shared FROM ({CURATE}) c
  LEFT JOIN (SELECT * FROM phrased JOIN ({DIFF.replace("FROM prompts", "FROM phrased")}) USING (prompt_idx)) USING (prompt_idx) WHERE status = 'kept'"""


@query("curate_pairs", V("SELECT * FROM metrics", "metrics", "prompts").removesuffix("SELECT * FROM metrics") + f", phrased AS MATERIALIZED (SELECT prompt_idx, edit_instruction, {PREFIXED} FROM prompts) {PAIRS}")
def curate_pairs(spark, d):
    """Prompts by their number; the pictures of a prompt without a number among them have no captions."""
    s = views.samples(spark, d)
    out = cu.curate_pairs(views.prompts(spark, d), s, judged(s.select("prompt_idx", "seed")), FIXTURE, views.PHRASE)
    return rounded(out, *SIMS, "overall_score").select("prompt_idx", "seed", "rank", *SIMS, "overall_score", "original_caption", "resulting_caption", "edit_instruction", "amplify", "suppress", "shared")


PREFER = """SELECT pair, a.semantics_score AS left_score, b.semantics_score AS right_score, CASE WHEN left_score > right_score THEN 'left' WHEN right_score > left_score THEN 'right' ELSE 'tie' END AS winner
  FROM (SELECT folder * 10 + seed AS pair, semantics_score FROM overall) a JOIN (SELECT folder * 10 + seed - 1 AS pair, semantics_score FROM overall) b USING (pair)"""


@query("pairwise_preference", V(PREFER, "overall"))
def pairwise_preference(spark, d):
    """Each scored sample beside the next one of its folder."""
    o = views.overall(spark, d).select((F.col("folder") * 10 + F.col("seed")).alias("pair"), F.col("semantics_score").alias("overall_score"))
    return cu.pairwise_preference(o, o.withColumn("pair", F.col("pair") - 1), "pair")


# ---- judge ----------------------------------------------------------------------------------

JUDGE_SQL = """SELECT folder, seed, k, CASE k WHEN 0 THEN '{"score": [' || a::VARCHAR || ', ' || b::VARCHAR || '], "reasoning": "fine"}' WHEN 1 THEN 'so: ||V^=^V||{"score": ' || a::VARCHAR || ', "reasoning": "one"}||V^=^V|| end'
  WHEN 2 THEN 'I say [' || a::VARCHAR || ', ' || b::VARCHAR || ']' WHEN 3 THEN a::VARCHAR WHEN 4 THEN 'rate_limit_exceeded'
  WHEN 6 THEN '{"edit": null, "score": [' || a::VARCHAR || ', ' || b::VARCHAR || ']}' WHEN 7 THEN '{score: ' || a::VARCHAR || ', reasoning: looks fine}' WHEN 9 THEN '[' || a::VARCHAR || ', ' || b::VARCHAR || ']'
  WHEN 10 THEN '[score1: ' || a::VARCHAR || ', score2: ' || b::VARCHAR || ']' ELSE 'no idea' END AS answer, a, b
  FROM (SELECT folder, seed, (folder + seed) % 11 AS k, sc[1]::INT AS a, sc[2]::INT AS b FROM scores)"""


def judge_text(spark, d):
    s = views.scores(spark, d).select("folder", "seed", F.pmod(F.col("folder") + F.col("seed"), F.lit(11)).alias("k"), F.col("sc")[0].cast("int").cast("string").alias("a"), F.col("sc")[1].cast("int").cast("string").alias("b"))
    text = F.when(F.col("k") == 0, F.concat(F.lit('{"score": ['), "a", F.lit(", "), "b", F.lit('], "reasoning": "fine"}')))
    text = text.when(F.col("k") == 1, F.concat(F.lit('so: ||V^=^V||{"score": '), "a", F.lit(', "reasoning": "one"}||V^=^V|| end')))
    text = text.when(F.col("k") == 2, F.concat(F.lit("I say ["), "a", F.lit(", "), "b", F.lit("]"))).when(F.col("k") == 3, F.col("a"))
    text = text.when(F.col("k") == 6, F.concat(F.lit('{"edit": null, "score": ['), "a", F.lit(", "), "b", F.lit("]}")))
    text = text.when(F.col("k") == 7, F.concat(F.lit("{score: "), "a", F.lit(", reasoning: looks fine}"))).when(F.col("k") == 9, F.concat(F.lit("["), "a", F.lit(", "), "b", F.lit("]")))
    text = text.when(F.col("k") == 10, F.concat(F.lit("[score1: "), "a", F.lit(", score2: "), "b", F.lit("]")))
    return s.withColumn("answer", text.when(F.col("k") == 4, "rate_limit_exceeded").otherwise("no idea"))


PARSED = f"""SELECT folder, seed, CASE WHEN k IN (0, 2, 6, 9) THEN [a::DOUBLE, b::DOUBLE] WHEN k IN (1, 3, 7) THEN [a::DOUBLE] WHEN k = 8 THEN [({H('again', 'folder', 'seed')} % 11)::DOUBLE] END AS score,
  CASE k WHEN 0 THEN 'fine' WHEN 1 THEN 'one' WHEN 6 THEN answer WHEN 7 THEN 'looks fine' END AS reasoning,
  (['json', 'json', 'list', 'number', 'rate_limited', 'failed', 'edit', 'repaired', 'guessed', 'list', 'failed'])[k + 1] AS method FROM ({JUDGE_SQL})"""


@query("parse_judge_output", V(PARSED, "scores"))
def parse_judge_output(spark, d):
    """All methods; one form of answer may be guessed."""
    guessed = judge.parse_judge_output(F.col("answer"), give_up=True, seed="again", key=F.concat_ws(":", "folder", "seed"))
    p = F.when(F.col("k") == 8, guessed).otherwise(judge.parse_judge_output(F.col("answer")))
    return judge_text(spark, d).withColumn("p", p).select("folder", "seed", "p.score", "p.reasoning", "p.method")


@query("validate_scores", V(f"SELECT folder, seed, k = 1 AS two_delimiters, k = 3 AS whole_score, k = 9 AS score_list, k = 10 AS named_scores FROM ({JUDGE_SQL})", "scores"))
def validate_scores(spark, d):
    v = judge.validate_scores(F.col("answer"))
    return judge_text(spark, d).select("folder", "seed", *[c.alias(name) for name, c in v.items()])


REPAIRED = f"""SELECT folder, seed, CASE k % 5 WHEN 0 THEN '{{"score": [' || a || '], "reasoning": "looks fine"}}' WHEN 1 THEN '{{"score": [' || a || ']}}' WHEN 2 THEN '{{"score": [-' || a || '.5], "ok": true, "why": null}}'
  WHEN 3 THEN '{{"reasoning": "good", "score": [' || a || ', ' || b || ']}}' END AS repaired FROM ({JUDGE_SQL})"""


@query("repair_json", V(REPAIRED, "scores"))
def repair_json(spark, d):
    """Bare keys, texts and numbers; text around and a second object; constants; a list as it is; no object."""
    a, b, form = F.col("a"), F.col("b"), F.pmod("k", F.lit(5))
    near = F.when(form == 0, F.concat(F.lit("{score: "), a, F.lit(", reasoning: looks fine}"))).when(form == 1, F.concat(F.lit('so {"score": '), a, F.lit("} and {x: 1}")))
    near = near.when(form == 2, F.concat(F.lit("{score: -"), a, F.lit(".5, ok: true, why: null}"))).when(form == 3, F.concat(F.lit("{reasoning: good, score: ["), a, F.lit(", "), b, F.lit("]}")))
    return judge_text(spark, d).select("folder", "seed", judge.repair_json(near.otherwise("no object")).alias("repaired"))


TASKS = sorted(judge.RULES.items())


@query("render_judge_prompt", V("SELECT prompt_idx, task, '" + judge.CONTEXT_TEXT + "' || chr(10) || replace(replace(rule, '<prompt>', edit_instruction), '<instruction>', edit_instruction) AS judge_prompt FROM (SELECT *, (['t2i', 't2v', 'tie'])[prompt_idx % 3 + 1] AS task FROM prompts) JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TASKS) + ") r(task, rule) USING (task)", "prompts"))
def render_judge_prompt(spark, d):
    p = views.prompts(spark, d).withColumn("task", F.element_at(F.array(*[F.lit(k) for k, _ in TASKS]), (F.pmod("prompt_idx", F.lit(3)) + 1).cast("int")))
    return judge.render_judge_prompt(p, spark.createDataFrame(TASKS, "task string, rule string"), "edit_instruction").select("prompt_idx", "task", "judge_prompt")


@query("scores_map_to_rows", V("SELECT folder, seed, semantics_score, quality_score, round(overall_score, 6) AS overall_score FROM overall", "overall"))
def scores_map_to_rows(spark, d):
    """Scores written as one JSON object for each folder and read back."""
    s = F.struct(F.col("semantics_score").alias("sementics_score"), "quality_score", "overall_score")
    maps = views.overall(spark, d).groupBy("folder").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("seed").cast("string"), s)))).alias("scores_json"))
    return rounded(judge.scores_map_to_rows(maps), "overall_score")


# ---- model-backed maps ----------------------------------------------------------------------


@query("batch_infer", V("SELECT prompt_idx, length(original_caption)::BIGINT AS n FROM prompts", "prompts"))
def batch_infer(spark, d):
    def init():
        return lambda batch: batch[["prompt_idx"]].assign(n=batch["original_caption"].str.len())

    return infer.batch_infer(views.prompts(spark, d).select("prompt_idx", "original_caption"), init, "prompt_idx long, n long")


@query("batch_infer_by_length", V("SELECT prompt_idx, length(original_caption)::BIGINT AS n, true AS within FROM prompts", "prompts"))
def batch_infer_by_length(spark, d):
    """Batches of 2,000 characters at most, or of one longer caption."""

    def init():
        def model(batch):
            sizes = batch["original_caption"].str.len()
            return batch[["prompt_idx"]].assign(n=sizes, within=bool(sizes.sum() <= 2000 or len(batch) == 1))

        return model

    return infer.batch_infer(views.prompts(spark, d).select("prompt_idx", "original_caption"), init, "prompt_idx long, n long, within boolean", length_of="original_caption", most=2000)


@query("infer_with_retry", V("SELECT prompt_idx, least(prompt_idx % 6 + 1, 4)::INT AS attempt, CASE WHEN prompt_idx % 6 < 4 THEN '' ELSE 'refused' END AS reason FROM prompts", "prompts"))
def infer_with_retry(spark, d):
    """A stub that succeeds at try prompt_idx mod 6 + 1."""

    def init():
        return lambda batch, attempt: batch.assign(ok=batch["prompt_idx"] % 6 < attempt)

    def accept(out):
        return out["ok"].map({True: "", False: "refused"})

    rows = infer.infer_with_retry(views.prompts(spark, d).select("prompt_idx"), init, accept, "prompt_idx long, ok boolean")
    return rows.select("prompt_idx", "attempt", "reason")


def guess_sql(side: str) -> str:
    return f"[({H('again:' + side, 'folder', 'seed')} % 11)::DOUBLE]"


JUDGED_AGAIN = f"""SELECT folder, seed, attempt, CASE WHEN attempt = 1 THEN first WHEN (folder + seed) % 2 = 0 THEN [9.0::DOUBLE, 8.0::DOUBLE] ELSE {guess_sql('sc')} END AS sc,
  CASE WHEN attempt = 2 AND (folder + seed) % 2 = 0 THEN [7.0::DOUBLE] ELSE [(folder % 11)::DOUBLE] END AS pq
  FROM (SELECT folder, seed, CASE WHEN k IN (5, 8, 10) THEN 2 ELSE 1 END AS attempt, CASE WHEN k IN (0, 2, 6, 9) THEN [a::DOUBLE, b::DOUBLE] WHEN k IN (1, 3, 7) THEN [a::DOUBLE] END AS first FROM ({JUDGE_SQL}))"""


@query("score_with_retry", V(JUDGED_AGAIN, "scores"))
def score_with_retry(spark, d):
    """A stub that answers with the row's text at first, and better at the second attempt for every other row."""

    def init():
        def model(batch, attempt):
            better = ((batch["folder"] + batch["seed"]) % 2 == 0) & (attempt == 2)
            quality = '{"score": [' + (batch["folder"] % 11).astype(str) + '], "reasoning": ""}'
            return batch.assign(sc_answer=batch["answer"].mask(better, '{"score": [9, 8]}'), pq_answer=quality.mask(better, '{"score": 7}'))

        return model

    rows = judge.score_with_retry(judge_text(spark, d).select("folder", "seed", "answer"), init, ["folder", "seed"])
    return rows.select("folder", "seed", "attempt", "sc", "pq")


@query("capture_errors", V("SELECT folder, seed, CASE WHEN folder % 9 = 0 THEN 'ValueError: no picture' END AS error FROM scores", "scores"))
def capture_errors(spark, d):
    def init():
        def model(row):
            if row["folder"] % 9 == 0:
                raise ValueError("no picture")
            return row

        return model

    return infer.capture_errors(views.scores(spark, d).select("folder", "seed"), init, "folder long, seed long")


@query("list_image_files", V("SELECT folder::BIGINT AS folder, seed, side::INT AS side FROM images", "images"))
def list_image_files(spark, d):
    """The listing's parser over the paths of the images table."""
    parsed = io.parse_image_paths(views.images(spark, d).select("path"))
    return parsed.select(F.col("folder").cast("long").alias("folder"), "seed", F.col("side").cast("int").alias("side"))
