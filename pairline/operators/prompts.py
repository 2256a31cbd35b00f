"""Prompt tables: captions, instructions, edited captions and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairline.functions import text as tx
from pairline.operators.order import SUM, index_rows, scan

STYLE = "Neutral Gray Background, "
INPUT_END, EDIT_END, OUTPUT_END = "\n##\n", "\n%%\n", "\nEND"


def style_captions(df: DataFrame, phrase: str, columns: tuple[str, ...] = ("original_caption", "resulting_caption")) -> DataFrame:
    """The style phrase before both captions; columns that df lacks are passed over."""
    return df.withColumns({c: tx.prepend_if_missing(F.col(c), phrase) for c in columns if c in df.columns})


def format_finetune(df: DataFrame) -> DataFrame:
    """(prompt, completion) from (input, edit, output)."""
    prompt = F.concat("input", F.lit(INPUT_END))
    return df.select(prompt.alias("prompt"), F.concat("edit", F.lit(EDIT_END), "output", F.lit(OUTPUT_END)).alias("completion"))


def split_completion(df: DataFrame, column: str = "completion") -> DataFrame:
    """df with edit and output; completions of other than two parts are left out."""
    parts = F.split(F.col(column), EDIT_END, -1)
    return df.where(F.size(parts) == 2).withColumns({"edit": parts[0], "output": parts[1]})


def drop_noop_edits(df: DataFrame, before: str = "original_caption", after: str = "resulting_caption") -> DataFrame:
    return df.where(tx.normal_caption(F.col(before)) != tx.normal_caption(F.col(after)))


def unify_prompt_schema(df: DataFrame) -> DataFrame:
    """One triple from records of either generation, wrapped ones included: the first field that is there counts."""
    names = {"original_caption": ("original_caption", "caption", "input"), "edit_instruction": ("edit_instruction", "edit"), "resulting_caption": ("resulting_caption", "output")}
    inner = df.schema["prompt"].dataType.names if "prompt" in df.columns and df.schema["prompt"].dataType.typeName() == "struct" else []

    def first(options: tuple[str, ...]) -> Column:
        found = [F.col(o) for o in options if o in df.columns] + [F.col(f"prompt.{o}") for o in options if o in inner]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return df.select(*[c for c in df.columns if c in ("record_id", "prompt_idx")], *[first(o).alias(c) for c, o in names.items()])


def generation_grid(models: DataFrame, temperatures: DataFrame, personas: DataFrame) -> DataFrame:
    """Every call of the caption factory, numbered in nested-loop order; the inputs have (place, value) and are constants of a run."""
    m, t, p = (df.select(F.col("place").alias(f"p{k}"), F.col("value").alias(f"v{k}")) for k, df in enumerate((models, temperatures, personas)))
    # three short lists, crossed on purpose
    grid = m.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(p))
    order = F.row_number().over(Window.orderBy("p0", "p1", "p2")) - 1
    return grid.select(order.cast("long").alias("call"), F.col("v0").alias("model"), F.col("v1").alias("temperature"), F.col("v2").alias("persona"))


def expand_samples(prompts: DataFrame, n: int) -> DataFrame:
    """n draws of each prompt, numbered from 0."""
    return prompts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def explode_captions(calls: DataFrame, column: str = "captions") -> DataFrame:
    """A row for each caption of a call, with its place and the call's columns."""
    return calls.select("*", F.posexplode(column).alias("place", "caption")).drop(column)


def explode_instructions(captions: DataFrame, column: str = "instructions", most: int = 3) -> DataFrame:
    """A row for each of the first `most` instructions of a caption."""
    return captions.select("*", F.posexplode(F.slice(column, 1, most)).alias("place", "edit_instruction")).drop(column)


def assemble_prompt(df: DataFrame) -> DataFrame:
    """The nested record {index, captions, metadata}."""
    return df.select(F.col("prompt_idx").alias("index"), "original_caption", "edit_instruction", "resulting_caption", F.struct("model", "temperature", "persona").alias("metadata"))


def dedupe_first(captions: DataFrame) -> DataFrame:
    """Each caption once, with the metadata of its first generation."""
    rest = [c for c in captions.columns if c not in ("caption", "gen_order")]
    first = F.min(F.struct("gen_order", *rest)).alias("first")
    return captions.groupBy("caption").agg(first).select("caption", "first.gen_order", *[f"first.{c}" for c in rest])


def dedupe_progress(captions: DataFrame, call: str) -> DataFrame:
    """For each call the captions not seen before, and the running total."""
    firsts = captions.groupBy("caption").agg(F.min(call).alias(call)).groupBy(call).agg(F.count("*").alias("n_new"))
    every = captions.select(call).distinct().join(firsts, call, "left").select(call, F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return scan(index_rows(every, call, name="__n"), "__n", F.col("n_new"), SUM, "n_total").drop("__n")


def caption_diff(df: DataFrame, before: str = "original_caption", after: str = "resulting_caption") -> DataFrame:
    """df with the sorted word sets amplify (added), suppress (removed) and shared."""
    a, b = F.col(before), F.col(after)
    return df.withColumns({"amplify": tx.words_added(a, b), "suppress": tx.words_removed(a, b), "shared": tx.words_shared(a, b)})


def diff_stats(df: DataFrame, before: str = "original_caption", after: str = "resulting_caption") -> DataFrame:
    """How often each word is added, removed and shared over all triples."""
    kinds = {"added": tx.words_added, "removed": tx.words_removed, "shared": tx.words_shared}
    tagged = F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col(before), F.col(after)).alias("words")) for k, f in kinds.items()])
    each = df.select(F.explode(tagged).alias("t")).select("t.kind", F.explode("t.words").alias("word"))
    return each.groupBy("word").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


# Own wording of the three generation steps; {name} marks an input.
STEP_TEMPLATES = {
    "captions": "You are {persona}. Write captions of single objects for product photographs.",
    "instructions": "Caption: {caption}\nWrite three short instructions that change one thing in the picture.",
    "edited": "Caption: {caption}\nInstruction: {instruction}\nWrite the caption after the edit and change as few words as you can.",
}


def render_generation_prompt(df: DataFrame, templates: DataFrame) -> DataFrame:
    """df crossed with the few templates (step, template), inputs filled in; a null input fills in nothing."""
    filled = F.col("template")
    for name in ("persona", "caption", "instruction"):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    return df.crossJoin(F.broadcast(templates)).withColumn("prompt", filled).drop("template")
