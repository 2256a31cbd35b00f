"""Prompt tables and caption text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairline.functions import text as tx
from pairline.operators import align, prompts
from pairline.plans import views
from pairline.plans.registry import query
from pairline.plans.views import H, with_views

V = with_views
PUNCT = r"""[!-/:-@\[-`{-~]"""
PHRASE = views.PHRASE


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def tokens_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace({c}, '{PUNCT}', '', 'g'), '\s+'), lambda w: w <> '')"


@query("prepend_if_missing", V(f"SELECT prompt_idx, CASE WHEN starts_with(original_caption, '{PHRASE}') THEN original_caption ELSE '{PHRASE}' || original_caption END AS original_caption, CASE WHEN starts_with(resulting_caption, '{PHRASE}') THEN resulting_caption ELSE '{PHRASE}' || resulting_caption END AS resulting_caption FROM prompts", "prompts"))
def prepend_if_missing(spark, d):
    return prompts.style_captions(views.prompts(spark, d), PHRASE).select("prompt_idx", "original_caption", "resulting_caption")


@query("clean_caption", V(f"SELECT prompt_idx, replace(original_caption, '{prompts.STYLE}', '') AS caption FROM prompts", "prompts"))
def clean_caption(spark, d):
    return views.prompts(spark, d).select("prompt_idx", tx.remove_literal(F.col("original_caption"), prompts.STYLE).alias("caption"))


FINETUNE = "SELECT prompt_idx, original_caption || chr(10) || '##' || chr(10) AS prompt, edit_instruction || chr(10) || '%%' || chr(10) || resulting_caption || chr(10) || 'END' AS completion FROM prompts"


@query("format_finetune", V("SELECT prompt, completion FROM (" + FINETUNE + ")", "prompts"))
def format_finetune(spark, d):
    p = views.prompts(spark, d).select(F.col("original_caption").alias("input"), F.col("edit_instruction").alias("edit"), F.col("resulting_caption").alias("output"))
    return prompts.format_finetune(p)


# every fifth completion has one part too many
COMPLETIONS = "SELECT prompt_idx, CASE WHEN prompt_idx % 5 = 0 THEN edit_instruction ELSE edit_instruction || chr(10) || '%%' || chr(10) || resulting_caption END AS completion FROM prompts"


@query("split_completion", V(f"SELECT prompt_idx, p[1] AS edit, p[2] AS output FROM (SELECT prompt_idx, string_split(completion, chr(10) || '%%' || chr(10)) AS p FROM ({COMPLETIONS})) WHERE len(p) = 2", "prompts"))
def split_completion(spark, d):
    both = F.concat("edit_instruction", F.lit(prompts.EDIT_END), "resulting_caption")
    p = views.prompts(spark, d).select("prompt_idx", F.when(F.pmod("prompt_idx", F.lit(5)) == 0, F.col("edit_instruction")).otherwise(both).alias("completion"))
    return prompts.split_completion(p).select("prompt_idx", "edit", "output")


# every fourth edit changes blanks and the end only
NOOPS = "SELECT prompt_idx, original_caption, CASE WHEN prompt_idx % 4 = 0 THEN '  ' || original_caption || '!?' ELSE resulting_caption END AS resulting_caption FROM prompts"


def normal_sql(c: str) -> str:
    return f"lower(trim({strip_sql(c)}, '.!?'))"


@query("drop_noop_edits", V(f"SELECT prompt_idx FROM ({NOOPS}) WHERE {normal_sql('original_caption')} <> {normal_sql('resulting_caption')}", "prompts"))
def drop_noop_edits(spark, d):
    after = F.when(F.pmod("prompt_idx", F.lit(4)) == 0, F.concat(F.lit("  "), "original_caption", F.lit("!?"))).otherwise(F.col("resulting_caption"))
    return prompts.drop_noop_edits(views.prompts(spark, d).withColumn("resulting_caption", after)).select("prompt_idx")


@query("unify_prompt_schema", V("SELECT prompt_idx, original_caption, edit_instruction, resulting_caption FROM prompts", "prompts"))
def unify_prompt_schema(spark, d):
    """Records of four shapes, by prompt_idx mod 4, in one permissive table."""
    p, k = views.prompts(spark, d), F.pmod("prompt_idx", F.lit(4))
    o, e, r = F.col("original_caption"), F.col("edit_instruction"), F.col("resulting_caption")
    mixed = p.select(
        "prompt_idx", F.when(k == 0, o).alias("original_caption"), F.when(k == 0, e).alias("edit_instruction"), F.when(k == 0, r).alias("resulting_caption"), F.when(k == 1, o).alias("caption"), F.when(k == 2, o).alias("input"),
        F.when(k.isin(1, 2), e).alias("edit"), F.when(k.isin(1, 2), r).alias("output"), F.when(k == 3, F.struct(o.alias("original_caption"), e.alias("edit_instruction"), r.alias("resulting_caption"))).alias("prompt"))
    return prompts.unify_prompt_schema(mixed)


@query("persona_name", f"SELECT DISTINCT {strip_sql('string_split(persona, chr(44))[1]')} AS name FROM (SELECT chr(10) || ' ' || c_mktsegment || ' buyer, of nation ' || c_nationkey::VARCHAR AS persona FROM customer)")
def persona_name(spark, d):
    persona = F.concat(F.lit("\n "), "c_mktsegment", F.lit(" buyer, of nation "), F.col("c_nationkey").cast("string"))
    return views.table(spark, d, "customer").select(tx.persona_name(persona).alias("name")).distinct()


@query("generation_grid", """SELECT (m.place * 125 + t.place * 25 + p.place)::BIGINT AS call, model, temperature, persona FROM
  (SELECT r_regionkey AS place, r_name AS model FROM region) m, (SELECT t AS place, (t / 10.0)::DOUBLE AS temperature FROM range(0, 5) AS r(t)) t, (SELECT n_nationkey AS place, n_name AS persona FROM nation) p""")
def generation_grid(spark, d):
    models = views.table(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("value"))
    personas = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("value"))
    temperatures = spark.range(5).select(F.col("id").alias("place"), (F.col("id") / 10).alias("value"))
    return prompts.generation_grid(models, temperatures, personas)


@query("expand_samples", V("SELECT prompt_idx, draw::INT AS draw FROM prompts, range(0, 4) AS r(draw)", "prompts"))
def expand_samples(spark, d):
    return prompts.expand_samples(views.prompts(spark, d).select("prompt_idx"), 4)


@query("explode_captions", V("SELECT doc_id, source, (i - 1)::INT AS place, captions[i] AS caption FROM lists, unnest(range(1, len(captions) + 1)) AS t(i)", "lists"))
def explode_captions(spark, d):
    return prompts.explode_captions(views.lists(spark, d))


@query("explode_instructions", V("SELECT doc_id, source, (i - 1)::INT AS place, captions[i] AS edit_instruction FROM lists, unnest(range(1, least(3, len(captions)) + 1)) AS t(i)", "lists"))
def explode_instructions(spark, d):
    return prompts.explode_instructions(views.lists(spark, d), "captions")


@query("assemble_prompt", V("SELECT prompt_idx AS index, original_caption, edit_instruction, resulting_caption, 'm' || (prompt_idx % 2)::VARCHAR AS meta_model, (prompt_idx % 11)::DOUBLE / 10 AS meta_temperature, 'p' || (prompt_idx % 13)::VARCHAR AS meta_persona FROM prompts", "prompts"))
def assemble_prompt(spark, d):
    p = views.prompts(spark, d)
    meta = {"model": F.concat(F.lit("m"), (F.col("prompt_idx") % 2).cast("string")), "temperature": (F.col("prompt_idx") % 11).cast("double") / 10, "persona": F.concat(F.lit("p"), (F.col("prompt_idx") % 13).cast("string"))}
    nested = prompts.assemble_prompt(p.withColumns(meta))
    return nested.select("index", "original_caption", "edit_instruction", "resulting_caption", *[F.col(f"metadata.{c}").alias(f"meta_{c}") for c in meta])


@query("dedupe_first", V("SELECT caption, min(gen_order) AS gen_order, arg_min(model, gen_order) AS model, arg_min(persona, gen_order) AS persona, arg_min(url, gen_order) AS url FROM captions GROUP BY caption", "captions"))
def dedupe_first(spark, d):
    return prompts.dedupe_first(views.captions(spark, d))


@query("dedupe_progress", V("SELECT call, coalesce(n_new, 0) AS n_new, (sum(coalesce(n_new, 0)) OVER (ORDER BY call))::BIGINT AS n_total FROM (SELECT DISTINCT gen_order // 100 AS call FROM captions) LEFT JOIN (SELECT call, count(*) AS n_new FROM (SELECT min(gen_order // 100) AS call FROM captions GROUP BY caption) GROUP BY call) USING (call)", "captions"))
def dedupe_progress(spark, d):
    return prompts.dedupe_progress(views.captions(spark, d).withColumn("call", F.floor(F.col("gen_order") / 100)), "call")


@query("clean_tokens", V(f"SELECT prompt_idx, {tokens_sql('original_caption')} AS tokens FROM prompts", "prompts"))
def clean_tokens(spark, d):
    return views.prompts(spark, d).select("prompt_idx", tx.clean_tokens(F.col("original_caption")).alias("tokens"))


DIFF = f"""SELECT prompt_idx, list_sort(list_distinct(list_filter(b, lambda w: NOT list_contains(a, w)))) AS amplify, list_sort(list_distinct(list_filter(a, lambda w: NOT list_contains(b, w)))) AS suppress,
  list_sort(list_distinct(list_filter(a, lambda w: list_contains(b, w)))) AS shared FROM (SELECT prompt_idx, {tokens_sql('original_caption')} AS a, {tokens_sql('resulting_caption')} AS b FROM prompts)"""


@query("caption_diff", V(DIFF, "prompts"))
def caption_diff(spark, d):
    return prompts.caption_diff(views.prompts(spark, d)).select("prompt_idx", "amplify", "suppress", "shared")


@query("diff_stats", V(f"SELECT word, count(*) FILTER (kind = 'a') AS n_added, count(*) FILTER (kind = 'r') AS n_removed, count(*) FILTER (kind = 's') AS n_shared FROM (SELECT 'a' AS kind, unnest(amplify) AS word FROM ({DIFF}) UNION ALL SELECT 'r', unnest(suppress) FROM ({DIFF}) UNION ALL SELECT 's', unnest(shared) FROM ({DIFF})) GROUP BY word", "prompts"))
def diff_stats(spark, d):
    return prompts.diff_stats(views.prompts(spark, d))


@query("phrase_position", V(f"SELECT prompt_idx, CASE WHEN len(t) >= 2 THEN list_position(list_transform(range(1, len(t)), lambda i: t[i:i + 1]), list_value(t[len(t) // 2], t[len(t) // 2 + 1])) - 1 END AS position FROM (SELECT prompt_idx, {tokens_sql('original_caption')} AS t FROM prompts)", "prompts"))
def phrase_position(spark, d):
    """The two words in the middle of each caption; null for captions of fewer."""
    t = views.prompts(spark, d).select("prompt_idx", tx.clean_tokens(F.col("original_caption")).alias("t"))
    middle = F.greatest(F.floor(F.size("t") / 2), F.lit(1)).cast("int")
    phrase = F.when(F.size("t") >= 2, F.slice("t", middle, F.lit(2)))
    return t.select("prompt_idx", tx.phrase_position(F.col("t"), phrase).cast("long").alias("position"))


@query("word_positions", V("SELECT prompt_idx, list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i] = 'the' THEN (i - 1)::INT END), lambda i: i IS NOT NULL) AS positions FROM (SELECT prompt_idx, string_split(original_caption, ' ') AS p FROM prompts)", "prompts"))
def word_positions(spark, d):
    return views.prompts(spark, d).select("prompt_idx", tx.word_positions(F.col("original_caption"), F.lit("the")).alias("positions"))


REPLACED = "SELECT prompt_idx, original_caption AS a, CASE WHEN prompt_idx % 2 = 0 THEN replace(original_caption, 'e', 'a') ELSE resulting_caption END AS b FROM prompts"


@query("replaced_words", V(f"SELECT prompt_idx, len(x) <> len(y) AS unequal, CASE WHEN len(x) = len(y) THEN list_transform(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i]), lambda i: (i - 1)::VARCHAR || ':' || x[i] || '>' || y[i]) END AS replaced FROM (SELECT prompt_idx, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({REPLACED}))", "prompts"))
def replaced_words(spark, d):
    p = views.prompts(spark, d).withColumn("b", F.when(F.pmod("prompt_idx", F.lit(2)) == 0, F.replace("original_caption", F.lit("e"), F.lit("a"))).otherwise(F.col("resulting_caption")))
    found = tx.replaced_words(F.col("original_caption"), F.col("b"))
    return p.select("prompt_idx", found.isNull().alias("unequal"), F.transform(found, lambda r: F.concat(r["position"].cast("string"), F.lit(":"), r["old"], F.lit(">"), r["new"])).alias("replaced"))


# The table row by row (each is made from the one before), then the walk back from its corner: left, up, diagonal.
ALIGN = V(f""", pairs AS MATERIALIZED (SELECT prompt_idx, {tokens_sql('original_caption')} AS a, {tokens_sql('resulting_caption')} AS b FROM prompts),
grid AS (
  SELECT prompt_idx, 0::BIGINT AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS row FROM pairs
  UNION ALL
  SELECT g.prompt_idx, g.i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda j: [j::BIGINT])),
    lambda done, x: list_append(done, greatest(done[x[1]], g.row[x[1] + 1], g.row[x[1]] + CASE WHEN b[x[1]] = a[g.i + 1] THEN 1 ELSE -1 END)))
  FROM grid g JOIN pairs p ON g.prompt_idx = p.prompt_idx WHERE g.i < len(a)),
steps AS (
  SELECT g.prompt_idx, g.i, list_transform(range(1, len(g.row)), lambda j: CASE WHEN g.row[j + 1] = g.row[j] THEN 0 WHEN g.row[j + 1] = up.row[j + 1] THEN 1 ELSE 2 END) AS step
  FROM grid g LEFT JOIN grid up ON g.prompt_idx = up.prompt_idx AND g.i = up.i + 1),
walk AS (
  SELECT prompt_idx, len(a)::BIGINT AS i, len(b)::BIGINT AS j, -1::BIGINT AS x, -1::BIGINT AS y FROM pairs
  UNION ALL
  SELECT w.prompt_idx, w.i - (step[w.j] > 0)::INT, w.j - (step[w.j] <> 1)::INT, CASE WHEN step[w.j] = 2 THEN w.i - 1 ELSE -1 END, CASE WHEN step[w.j] = 2 THEN w.j - 1 ELSE -1 END
  FROM walk w JOIN steps s ON w.prompt_idx = s.prompt_idx AND w.i = s.i WHERE w.j > 0),
met AS (SELECT prompt_idx, map_from_entries(list((y, x))) AS m FROM walk WHERE y >= 0 GROUP BY prompt_idx)
SELECT p.prompt_idx, g.row[len(b) + 1] AS score, list_transform(range(len(b)), lambda y: coalesce(m[y], -1)) AS mapping
FROM pairs p JOIN grid g ON g.prompt_idx = p.prompt_idx AND g.i = len(a) LEFT JOIN met ON met.prompt_idx = p.prompt_idx""", "prompts").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n, pairs", ", pairs", 1)


@query("align_captions", ALIGN)
def align_captions(spark, d):
    p = views.prompts(spark, d).select("prompt_idx", tx.clean_tokens(F.col("original_caption")).alias("a"), tx.clean_tokens(F.col("resulting_caption")).alias("b"))
    return align.align_captions(p, "prompt_idx", "a", "b")


@query("folder_key", V("SELECT prompt_idx, printf('%07d', prompt_idx * 37000) AS folder FROM prompts", "prompts"))
def folder_key(spark, d):
    return views.prompts(spark, d).select("prompt_idx", tx.folder_key(F.col("prompt_idx") * 37000).alias("folder"))


@query("render_generation_prompt", V("SELECT prompt_idx, step, replace(replace(replace(template, '{persona}', 'p' || (prompt_idx % 13)::VARCHAR), '{caption}', original_caption), '{instruction}', edit_instruction) AS prompt FROM prompts, (VALUES " + ", ".join(f"('{k}', '{v.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}')" for k, v in prompts.STEP_TEMPLATES.items()) + ") t(step, template)", "prompts"))
def render_generation_prompt(spark, d):
    p = views.prompts(spark, d).select("prompt_idx", F.concat(F.lit("p"), (F.col("prompt_idx") % 13).cast("string")).alias("persona"), F.col("original_caption").alias("caption"), F.col("edit_instruction").alias("instruction"))
    return prompts.render_generation_prompt(p, spark.createDataFrame(list(prompts.STEP_TEMPLATES.items()), "step string, template string")).select("prompt_idx", "step", "prompt")
