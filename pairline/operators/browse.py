"""Browsing of the result and the generation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.functions import text as tx
from pairline.operators.order import INTEGRAL, index_rows, nth_key, number_in_groups
from pairline.sources.scratch import cut, temporary

MISSING = "N/A"
CLEANED = "Neutral Gray Background, "
TEXT_COLUMNS = ("original_caption", "edit_instruction", "resulting_caption")


def facet(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(MISSING))


def contains_any_case(c: str, term: str) -> Column:
    """A literal substring in any case; an empty term is everywhere."""
    return F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower())) if term else F.lit(True)


def facet_search(df: DataFrame, statuses: list[str], classes: list[str], terms: dict[str, str]) -> DataFrame:
    """Rows of a chosen status and class (no class chosen: all) that hold all search terms; no status chosen: none."""
    ok = facet("status").isin(statuses) if statuses else F.lit(False)
    if classes:
        ok = ok & facet("class_name").isin(classes)
    for column, term in terms.items():
        ok = ok & contains_any_case(column, term)
    return df.where(ok)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(facet(column).alias("value")).distinct().orderBy("value")


def paginate(df: DataFrame, key: str, page: int, size: int = 20) -> DataFrame:
    """Page `page` (from 1) in order of key, with the number of pages and the range shown; a page is bounded by its size.

    For a whole-number key without nulls the keys at the ends of the page are found by counting, so that what lies before is not sorted.
    """
    total = df.count()
    pages, first = -(-total // size), (page - 1) * size
    last, rows, skipped = min(first + size, total), df, first
    if dict(df.dtypes)[key] in INTEGRAL and 0 <= first < total and not df.where(F.col(key).isNull()).count():
        with temporary(df.sparkSession):
            keys = cut(df.select(key), "keys")
            (low, before), (high, _) = nth_key(keys, key, first + 1), nth_key(keys, key, last)
        rows, skipped = df.where(F.col(key).between(low, high)), first - before
    shown = rows.orderBy(key).offset(skipped).limit(size)
    return shown.withColumns({"n_pages": F.lit(pages).cast("long"), "first_shown": F.lit(min(first + 1, total)).cast("long"), "last_shown": F.lit(last).cast("long")})


def display_text(c: str, term: str) -> Column:
    """Cleaned and with the search term marked."""
    return tx.highlight(tx.remove_literal(F.col(c), CLEANED), term)


def history_newest_first(history: DataFrame, user: str, order: list[str], per_row: int = 3) -> DataFrame:
    """Each user's log, newest first, with number #n counted from the oldest and the display row; a long log is dealt over partitions."""
    placed = number_in_groups(history, [user], [F.desc(c) for c in order], "__place", "__n")
    return placed.withColumns({"number": F.col("__n") - F.col("__place") + 1, "display_row": F.floor((F.col("__place") - 1) / per_row)}).drop("__place", "__n")


def sample_paths(df: DataFrame, seed: str = "seed", class_name: str = "class_name") -> DataFrame:
    """df with the file names of a sample, relative to its class, and the seed read back from the name."""
    first, second = F.format_string("%d_0.jpg", F.col(seed)), F.format_string("%d_1.jpg", F.col(seed))
    out = df.withColumns({"input_image": F.concat_ws("/", class_name, first), "output_image": F.concat_ws("/", class_name, second), "latent": F.concat(F.replace(first, F.lit(".jpg"), F.lit("")), F.lit(".pt"))})
    return out.withColumn("seed_back", F.substring_index(F.substring_index("input_image", "/", -1), "_", 1).cast("long"))


IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")


def image_ext_filter(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*IMAGE_SUFFIXES))


def ignore_and_subset(files: DataFrame, ignored: DataFrame, classes: DataFrame, path: str = "relpath") -> DataFrame:
    """Files that are not ignored and whose first path segment is a chosen class, with how many were taken out by either step."""
    kept = files.join(ignored.select(path), path, "left_anti")
    chosen = kept.withColumn("class_name", F.substring_index(path, "/", 1)).join(classes, "class_name", "left_semi")
    counts = files.agg(F.count("*").alias("n_all")).crossJoin(kept.agg(F.count("*").alias("n_kept")))
    report = counts.select((F.col("n_all") - F.col("n_kept")).alias("n_ignored"), "n_kept")
    return chosen.crossJoin(F.broadcast(report)).select(path, "class_name", "n_ignored", "n_kept")  # one row of counts


def label_join(files: DataFrame, class_column: str, original: DataFrame) -> DataFrame:
    """files with the dense label (rank of the sorted classes), the original index and the human name; original: (class, idx, human)."""
    dense = index_rows(files.select(class_column).distinct(), class_column, name="label")
    return files.join(dense, class_column).join(original, class_column, "left")


def paired_by_name(masks: DataFrame, images: DataFrame, path: str = "path") -> DataFrame:
    """Mask rows with the image of the derived name."""
    keyed = masks.select(F.col(path).alias("mask_path"), F.replace(path, F.lit("_mask.png"), F.lit(".png")).alias("image_path"))
    return keyed.join(images.select(F.col(path).alias("image_path")), "image_path")
