"""Line deduplication by distinct-site spread: boilerplate is what many sites have in common.

Each line's hash gets a HyperLogLog sketch of the sites that it stands on; sketches merge by aggregation, so
that a line of a third of all rows is small before anything is shuffled. Lines whose estimate is clearly
at or above the threshold are boilerplate; lines near it get an exact distinct count. Which lines go from a text depends on
its text alone, so that the removals are joined by the text's hash, whatever the ids are.

Defined results: lines part at line feeds only; blank lines (nothing but spaces) are never boilerplate; a null site is no
site; a null text has no lines and stays null; equal rows are treated alike and all stay; hashes are of 128
bits; an empty table gives no rows; columns of the input keep their names and values, result columns replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.llm.common import cut, spread_join

#: Distinct sites from which a line is boilerplate; log2 of a sketch's registers (deviation 1.04 / 2**6); share of the threshold that counts as near.
MIN_SITES, LOG_REGISTERS, NEAR = 8, 12, 0.15


def hash128(x: Column) -> list[Column]:
    return [F.xxhash64(x), F.xxhash64(F.lit("2"), x)]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that stand on min_sites sites or more."""
    lines = docs.select(F.col(site_col).alias("site"), F.explode(lines_of(F.col(text_col))).alias("line")).where("trim(line) != '' and site is not null")
    h1, h2 = hash128(F.col("line"))
    lines = lines.select("site", h1.alias("h1"), h2.alias("h2"))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"))
    band = max(1.0, NEAR * min_sites)
    spread = cut(spread.where(F.col("sites") >= min_sites - band), "spread")
    near = cut(spread.where(F.col("sites") <= min_sites + band).select("h1", "h2"), "near")
    pairs = spread_join(lines, near, ["h1", "h2"], ["site"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") > min_sites + band).select("h1", "h2").union(exact.select("h1", "h2"))


def remove_lines(docs: DataFrame, lines: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the lines (h1, h2) taken out of the text, and n_lines, n_removed. lines is a table that is cheap to read."""
    added = ("n_lines", "n_removed")
    kept = docs.select(*[c for c in docs.columns if c not in added])
    text = F.col(text_col)
    t1, t2 = hash128(text)
    each = kept.select(t1.alias("t1"), t2.alias("t2"), F.explode(F.array_distinct(lines_of(text))).alias("line"))
    h1, h2 = hash128(F.col("line"))
    each = each.select("t1", "t2", h1.alias("h1"), h2.alias("h2"))
    met = spread_join(each, lines, ["h1", "h2"], ["t1"]).distinct()  # the copies of a text are one here
    held = met.groupBy("t1", "t2").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    # the rows of one text are told apart by their other columns
    keyed = kept.select(F.struct(*kept.columns).alias("row"), t1.alias("t1"), t2.alias("t2"), F.xxhash64(*[c for c in kept.columns if c != text_col]).alias("other"))
    text = F.col("row")[text_col]
    all_lines = lines_of(text)
    stays = F.filter(all_lines, lambda x: ~F.array_contains(F.col("gone"), F.struct(hash128(x)[0].alias("h1"), hash128(x)[1].alias("h2"))))
    out = spread_join(keyed, held, ["t1", "t2"], ["other"], "left", counted=False).withColumn("rest", F.when(F.col("gone").isNull(), all_lines).otherwise(stays))
    n = F.when(text.isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    left = F.when(text.isNull(), 0).otherwise(F.size("rest")).cast("long")
    return out.select(*[F.array_join("rest", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept.columns], n.alias("n_lines"), (n - left).alias("n_removed"))


def dedup_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs without cross-site boilerplate lines; with n_lines and n_removed."""
    return remove_lines(docs, cut(boilerplate(docs, text_col, site_col, min_sites), "boilerplate"), text_col)
