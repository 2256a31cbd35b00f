"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from pairline.llm import ann, decontaminate, filter_audit, licence_scan, line_dedup, mixing, near_dup, periodic_runs, secret_scan, sharding, token_counts, token_files, toxicity
from pairline.llm.common import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20).withColumnRenamed("id", "vec_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs).select("doc_id", F.col("n_shingles").cast("long"), "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i:i + least(5, len(w)) - 1] AS g
  FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = licence_scan.scan(docs).withColumn("families", F.array_join("families", ","))
    return rows.select("doc_id", "n_paragraphs", "n_licences", "families", F.size("findings").cast("long").alias("n_predicted"), F.size(F.filter("findings", lambda x: x.family == licence_scan.UNKNOWN)).cast("long").alias("n_unknown"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.shard_documents(docs.withColumn("text_crc32", F.crc32("text")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = line_dedup.dedup_lines(docs)
    return rows.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP6_SQL = """
WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
common AS (SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 8),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS own, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x)) AS rest
  FROM documents, (SELECT coalesce(list(line), []) AS gone FROM common))
SELECT doc_id, len(own)::BIGINT AS n_lines, (len(own) - len(rest))::BIGINT AS n_removed, length(array_to_string(rest, chr(10)))::BIGINT AS kept_chars, md5(array_to_string(rest, chr(10))) AS kept_md5
FROM cut
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, ["text"]).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.annotate(docs, table(spark, sf_dir, "benchmark")).drop("text")


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
found AS (
  SELECT r, i, n, item_id FROM (
    SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)) JOIN windows USING (n, win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(spark, token_files.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _with_period(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The contract's edit: the words of a tenth of the documents repeat from a place on."""
    h, n = zlib.crc32((doc_id or "").encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic_runs.collapse_runs(docs, id_col="doc_id", edit=_with_period, whole=False)
    return rows.select("doc_id", *[c for c in periodic_runs.RESULT if c != "n_words"])


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (
  SELECT r, doc_id, w, len(w) AS n,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) AS h
  FROM docs),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
stepped AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
texts AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w
  FROM stepped),
words AS (SELECT r, n, i, w[i + 1] AS word FROM texts, unnest(range(n)) AS t(i)),
met AS (
  SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT r, i, p, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM met),
stretches AS (
  SELECT r, min(i) AS start, count(*) + p AS length, p FROM islands GROUP BY r, p, g HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT r, start, length, min(p) AS period FROM stretches GROUP BY r, start, length),
best AS (
  SELECT r, arg_min(struct_pack(start := start, length := length, period := period), k) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs) GROUP BY r),
lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN lines USING (r) LEFT JOIN kept USING (r)
"""


def _conditions() -> dict:
    """The contract's filters but the last: when a text fails."""
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return {
        "A": F.size(words) < 50,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * F.size(words),
        "C": F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(5) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kinds = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    return filter_audit.audit(docs, _conditions(), table(spark, sf_dir, "labels"), kinds, repeated="E")


OP13_SQL = r"""
WITH told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * e::INT AS mask
  FROM docs LEFT JOIN told USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(string_split('ABCDE', '')) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (
  SELECT o, s, 1 << (ascii(o[s]) - 65) AS f, list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65)))::BIGINT AS before
  FROM orders, unnest(range(1, 6)) AS t(s)),
sums AS (
  SELECT part, o, s, f,
    sum(n) FILTER (mask & (f | coalesce(before, 0)) = 0) AS kept, sum(n) FILTER (mask & f <> 0 AND mask & coalesce(before, 0) = 0) AS removed,
    sum(n) FILTER (mask & f <> 0 AND mask & coalesce(before, 0) <> 0) AS redundant, sum(n) FILTER (mask = f) AS unique_fails,
    sum(good) FILTER (mask & f <> 0 AND mask & coalesce(before, 0) = 0) AS good_lost, sum(toxic) FILTER (mask & f <> 0 AND mask & coalesce(before, 0) = 0) AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM sums
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline, "op1_nearest": op1_nearest, "op2_mix": op2_mix, "op3_near_duplicates": op3_near_duplicates, "op4_licences": op4_licences, "op5_shard": op5_shard, "op6_line_dedup": op6_line_dedup, "op7_secrets": op7_secrets, "op8_token_counts": op8_token_counts, "op9_toxicity": op9_toxicity, "op10_decontaminate": op10_decontaminate, "op11_token_files": op11_token_files, "op12_periodic_runs": op12_periodic_runs, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict:
    return {"op3_near_duplicates": OP3_SQL, "op6_line_dedup": OP6_SQL, "op10_decontaminate": OP10_SQL, "op12_periodic_runs": OP12_SQL, "op13_filter_audit": OP13_SQL}
