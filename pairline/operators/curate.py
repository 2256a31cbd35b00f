"""Curation of candidate pairs: filters, resumable set differences, top-k for each prompt, judge scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairline.functions.text import prepend_if_missing
from pairline.functions.vectors import pair_metrics_clip
from pairline.operators.order import number_in_groups
from pairline.operators.prompts import caption_diff


@dataclass(frozen=True)
class Thresholds:
    """Inclusive lower bounds and the number of samples kept for a prompt."""

    text: float
    direction: float
    image: float
    max_out: int
    overall: float = 2.0


# The presets of the pipelines.
PRESETS = {
    "v2": Thresholds(0.2, 0.2, 0.95, 10),
    "sd15": Thresholds(0.2, 0.2, 0.7, 4),
    "flux": Thresholds(0.1, 0.1, 0.6, 4),
    "sdxl": Thresholds(0.15, 0.15, 0.9, 4),
    "shuttle": Thresholds(0.1, 0.1, 0.8, 4),
    "unfiltered": Thresholds(0.0, 0.0, 0.0, 4),
}


def drop_flagged(df: DataFrame, flags: DataFrame, key: str, flag: str = "flagged") -> DataFrame:
    """Rows whose key is not flagged; a key without a flag is not flagged."""
    return df.join(flags.where(F.col(flag)).select(key), key, "left_anti")


def nsfw_filter(df: DataFrame, column: str = "labels", most: float = 0.85) -> DataFrame:
    """Rows whose score of the label nsfw is below `most`; rows without the label go."""
    return df.where(F.get(F.filter(column, lambda x: x["label"] == "nsfw"), F.lit(0))["score"] < most)


def threshold_filter(samples: DataFrame, t: Thresholds) -> DataFrame:
    ok = (F.col("sim_image") >= t.image) & (F.col("sim_dir") >= t.direction) & (F.col("sim_0") >= t.text) & (F.col("sim_1") >= t.text)
    return samples.where(ok)


def route_by_score(scored: DataFrame, least: float) -> DataFrame:
    """scored with status: removed if overall_score < least, else kept; an unscored row is kept."""
    return scored.withColumn("status", F.when(F.col("overall_score") < least, "removed").otherwise("kept"))


def pending_prompts(prompts: DataFrame, done: DataFrame, key: str = "folder") -> DataFrame:
    """Prompts without output rows."""
    return prompts.join(done.select(key).distinct(), key, "left_anti")


def pending_scores(folders: DataFrame, with_metadata: DataFrame, with_scores: DataFrame, key: str = "folder") -> DataFrame:
    return folders.join(with_metadata, key, "left_semi").join(with_scores, key, "left_anti")


def resume_unseen(rows: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("caption", "url")) -> DataFrame:
    """Rows none of whose keys was seen; a null key was never seen."""
    for key in keys:
        rows = rows.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows


def complete_pairs(images: DataFrame) -> DataFrame:
    """(folder, seed, complete): whether both sides of a sample are there."""
    sides = images.groupBy("folder", "seed").agg(F.bool_or(F.col("side") == 0).alias("has_0"), F.bool_or(F.col("side") == 1).alias("has_1"))
    return sides.select("folder", "seed", (F.col("has_0") & F.col("has_1")).alias("complete"))


def attach_prompt(samples: DataFrame, prompts: DataFrame, key: str = "folder", strict: bool = False) -> DataFrame:
    """Samples with their prompt. A sample without one is left out or, if strict, an error when rows are read."""
    if not strict:
        return samples.join(prompts, key)
    marked = samples.join(prompts.withColumn("__there", F.lit(True)), key, "left")
    check = F.assert_true(F.col("__there").isNotNull(), F.concat(F.lit("no prompt for "), F.col(key).cast("string")))
    return marked.where(check.isNull()).drop("__there")


def drop_removed(samples: DataFrame, removed: DataFrame, keys: tuple[str, ...] = ("folder", "seed")) -> DataFrame:
    """Samples that were not removed; those without a score stay."""
    return samples.join(removed.select(*keys), list(keys), "left_anti")


def merge_removed(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("folder", "seed")) -> DataFrame:
    """Stored and new removed scores; where both have a key, the stored row stands whole."""
    rest = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.struct(*rest).alias("__old"))
    b = new.select(*keys, F.struct(*rest).alias("__new"))
    both = a.join(b, list(keys), "full").withColumn("__row", F.coalesce("__old", "__new"))
    return both.select(*keys, *[f"__row.{c}" for c in rest])


def upsert_results(old: DataFrame, new: DataFrame, key: str = "uid", text_fields: tuple[str, ...] = ("prompt_input", "vision_input")) -> DataFrame:
    """Field-wise update: fields of new overwrite unless they are null, text fields unless they are empty."""
    fields = [c for c in old.columns if c != key]

    def merged(c: str) -> Column:
        value = F.nullif(F.col(f"n.{c}"), F.lit("")) if c in text_fields else F.col(f"n.{c}")
        return F.coalesce(value, F.col(f"o.{c}")).alias(c)

    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *[merged(c) if c in new.columns else F.col(f"o.{c}") for c in fields])


def _best_first() -> Window:
    return Window.partitionBy("prompt_idx").orderBy(F.desc("sim_dir"), F.desc("seed"))


def topk_per_prompt(samples: DataFrame, t: Thresholds) -> DataFrame:
    """Filtered samples, the max_out best of each prompt by sim_dir, ties to the larger seed; with rank from 1."""
    return threshold_filter(samples, t).withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= t.max_out)


def rank_unfiltered(samples: DataFrame) -> DataFrame:
    """All samples in the same order, without filter and cap; the samples of a large prompt are dealt over partitions."""
    return number_in_groups(samples, ["prompt_idx"], [F.desc("sim_dir"), F.desc("seed")], "rank").withColumn("rank", F.col("rank").cast("int"))


def removal_report(removed: DataFrame, key: str = "folder") -> DataFrame:
    """Removed seeds and images (two for each) of a folder."""
    return removed.groupBy(key).agg(F.count("*").alias("n_seeds"), (F.count("*") * 2).alias("n_images"))


def filter_report(df: DataFrame, kept: Column) -> DataFrame:
    return df.agg(F.count_if(kept).alias("n_filtered"), F.count("*").alias("n_total"))


def vie_score(df: DataFrame, semantics: str = "sc", quality: str = "pq") -> DataFrame:
    """df with the judge's scores: the worst of each list, and the root of their product."""
    s, q = F.array_min(semantics), F.array_min(quality)
    return df.withColumns({"semantics_score": s, "quality_score": q, "overall_score": F.sqrt(s * q)})


def curate(samples: DataFrame, scores: DataFrame, t: Thresholds) -> DataFrame:
    """From candidates with similarities to the kept ones: filter, cap, judge, route; (prompt_idx, seed) joins the scores."""
    top = topk_per_prompt(samples, t)
    judged = top.join(vie_score(scores).select("prompt_idx", "seed", "overall_score"), ["prompt_idx", "seed"], "left")
    return route_by_score(judged, t.overall)


def kept_samples(routed: DataFrame) -> DataFrame:
    """After removal: unscored samples stay."""
    return routed.where("status = 'kept'")


def curate_pairs(prompts: DataFrame, samples: DataFrame, scores: DataFrame, t: Thresholds, phrase: str) -> DataFrame:
    """The whole run: captions with their phrase and word differences, candidates rated by their vectors, curated, and the kept ones.

    prompts: (prompt_idx, original_caption, edit_instruction, resulting_caption), each prompt once; samples: (prompt_idx, seed
    and the vectors image0, image1, text0, text1); a kept sample without a prompt has null captions.
    """
    captions = ("original_caption", "resulting_caption")
    texts = caption_diff(prompts.select("prompt_idx", "edit_instruction", *[prepend_if_missing(F.col(c), phrase).alias(c) for c in captions]))
    metrics = pair_metrics_clip(*map(F.col, ("image0", "image1", "text0", "text1")))
    routed = curate(samples.select("prompt_idx", "seed", *[v.alias(k) for k, v in metrics.items()]), scores, t)
    return kept_samples(routed).drop("status").join(texts, "prompt_idx", "left")


def pairwise_preference(left: DataFrame, right: DataFrame, key: str = "prompt_idx") -> DataFrame:
    """Two scored candidates of a prompt side by side, with the winner (tie if equal, the scored one if one is not)."""
    a = left.select(key, F.col("overall_score").alias("left_score"))
    b = right.select(key, F.col("overall_score").alias("right_score"))
    x, y = F.coalesce("left_score", F.lit(-1.0)), F.coalesce("right_score", F.lit(-1.0))
    return a.join(b, key).withColumn("winner", F.when(x > y, "left").when(y > x, "right").otherwise("tie"))
