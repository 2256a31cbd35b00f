"""Aggregates over scores, sweeps and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.operators.order import MAX, MIN, index_rows, scan
from pairline.sources.scratch import cut

QUESTIONS = ("edited", "complete", "same_words", "minimal")
PER_ROW = 40


def assessment_pivot(answers: DataFrame, key: str = "prompt_idx") -> DataFrame:
    """Four answered questions of a prompt as one row."""
    wide = answers.groupBy(key).pivot("question", list(QUESTIONS)).agg(F.max("answer").alias("answer"), F.max("reason").alias("reason"))
    return wide.select(key, *[F.col(f"{q}_{part}") for q in QUESTIONS for part in ("answer", "reason")])


def assessment_score(wide: DataFrame) -> DataFrame:
    return wide.withColumn("score", sum((F.col(f"{q}_answer") for q in QUESTIONS[1:]), F.col(f"{QUESTIONS[0]}_answer")))


def assessment_total(scored: DataFrame) -> DataFrame:
    """The sum of scores and the most that it could be."""
    return scored.agg(F.sum("score").alias("total"), (F.count("*") * PER_ROW).alias("most"))


def flatten_assessment(df: DataFrame) -> DataFrame:
    """Nested metadata and answers as flat columns."""
    return df.select("prompt_idx", "metadata.*", *[F.col(f"answers.{q}.{p}").alias(f"{q}_{p}") for q in QUESTIONS for p in ("answer", "reason")])


def assessment_questions(prompts: DataFrame, templates: DataFrame) -> DataFrame:
    """Four rendered questions for each prompt; templates (question, template) are few."""
    crossed = prompts.crossJoin(F.broadcast(templates))
    filled = F.replace(F.replace("template", F.lit("{before}"), "original_caption"), F.lit("{after}"), "resulting_caption")
    return crossed.select("prompt_idx", "question", F.replace(filled, F.lit("{edit}"), "edit_instruction").alias("rendered"))


def sweep_means(rows: DataFrame, keys: tuple[str, ...] = ("scale_txt", "scale_img")) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("sim_0", "sim_1", "sim_direction", "sim_image")], F.count("*").alias("n"))


def sweep_grid(rows: DataFrame, text_scales: list[float], image_scales: list[float]) -> DataFrame:
    """Each row once for every pair of scales; both lists are constants of a run."""
    crossed = rows.withColumn("scale_txt", F.explode(F.array(*map(F.lit, text_scales))))
    return crossed.withColumn("scale_img", F.explode(F.array(*map(F.lit, image_scales))))


def weighted_epoch_mean(batches: DataFrame, epoch: str, value: str = "value", size: str = "n") -> DataFrame:
    return batches.groupBy(epoch).agg((F.sum(F.col(value) * F.col(size)) / F.nullif(F.sum(size), F.lit(0))).alias("epoch_mean"))


def topk_accuracy(df: DataFrame, scores: str, label: str, k: int, step: str | None = None) -> DataFrame:
    """Share of rows whose label is among the k largest scores (ties: the smaller index), overall or for each step."""
    placed = F.transform(F.col(scores), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    hit = F.array_contains(F.transform(F.slice(F.array_sort(placed), 1, k), lambda p: p["i"]), F.col(label).cast("int"))
    rated = df.select(*([step] if step else []), hit.cast("double").alias("hit"))
    grouped = rated.groupBy(step) if step else rated.groupBy()
    return grouped.agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n"))


def code_perplexity(codes: DataFrame, code: str = "code") -> DataFrame:
    """exp of the entropy of code shares, and the number of used codes."""
    counts = codes.groupBy(code).agg(F.count("*").alias("n"))
    shares = counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select((F.col("n") / F.col("total")).alias("p"))
    return shares.agg(F.exp(-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("perplexity"), F.count("*").alias("used"))


def throughput(batches: DataFrame, n: Column, seconds: Column, *keys: str) -> DataFrame:
    """Samples a second; null where no time has passed."""
    return batches.groupBy(*keys).agg((F.sum(n) / F.nullif(F.sum(seconds), F.lit(0.0))).alias("per_second"))


def best_checkpoint(log: DataFrame, step: str, value: str, patience: int = 10) -> DataFrame:
    """A training log (one run, different steps) with the best value so far, the rows since it came, whether the row is it, and whether patience is exhausted.

    Two scans over the steps: the smallest value before each, then the last improvement up to each.
    """
    before = cut(scan(index_rows(log, step, name="__n"), "__n", F.col(value), MIN, "__before", inclusive=False), "log")
    improved = F.coalesce(F.col(value) < F.col("__before"), F.lit(True))
    out = scan(before, "__n", F.when(improved, F.col("__n")), MAX, "__last").withColumns({"best": F.least("__before", value), "n_since": F.col("__n") - F.col("__last")})
    return out.withColumns({"stopped": F.col("n_since") >= patience, "is_best": F.col("n_since") == 0}).drop("__n", "__before", "__last")


def next_index(df: DataFrame, existing: DataFrame, order: str, idx: str = "idx") -> DataFrame:
    """df numbered on from the largest existing index, from 0 when there is none."""
    start = existing.agg(F.coalesce(F.max(idx) + 1, F.lit(0))).first()[0]
    return index_rows(df, order, name=idx, start=int(start))


def fixed_batches(df: DataFrame, key: str, n: int) -> DataFrame:
    """(batch, members): consecutive batches of n keys, the last one short."""
    indexed = index_rows(df.select(key), key).withColumn("batch", F.floor(F.col("idx") / n))
    return indexed.groupBy("batch").agg(F.array_sort(F.collect_list(key)).alias("members"))
