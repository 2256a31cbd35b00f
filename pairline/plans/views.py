"""Stand-in tables built from the driver's: the same rows as Spark plans and as SQL texts.

SQL[name] is the text of a common table expression; NEEDS[name] says which others it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairline.functions.hashing import hash_long, hash_uniform
from pairline.operators.order import index_rows
from pairline.operators.prompts import STYLE

#: Rows of a partition of spread().
SPREAD = 500_000
PHRASE = STYLE + "studio shot, "


def H(seed: str, *cols: str) -> str:  # noqa: N802
    """SQL of hash_long."""
    key = " || ':' || ".join(f"({c})::VARCHAR" for c in cols)
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


def U(seed: str, *cols: str) -> str:  # noqa: N802
    """SQL of hash_uniform."""
    return f"({H(seed, *cols)}::DOUBLE / 1152921504606846976.0::DOUBLE)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys into as many partitions as keep each at about SPREAD rows, so that what a task holds does not grow with the table; rows are counted."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SPREAD)), *keys)


def captions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    url = F.concat(F.lit("u"), F.pmod(hash_long("url", "doc_id"), F.lit(400)).cast("string"))
    return docs.select(F.col("text").alias("caption"), F.col("source").alias("model"), F.col("lang").alias("persona"), F.col("doc_id").alias("gen_order"), url.alias("url"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations")
    after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("resulting_caption"))
    pairs = talk.select("conv_id", "turn", F.col("text").alias("original_caption")).join(after, ["conv_id", "turn"])
    items = table(spark, d, "benchmark")
    n = items.count()
    indexed = index_rows(pairs, "conv_id", "turn", name="prompt_idx").withColumn("item_id", F.pmod("prompt_idx", F.lit(n)))
    styled = F.when(F.pmod("prompt_idx", F.lit(3)) == 0, F.concat(F.lit(PHRASE), "original_caption")).otherwise(F.col("original_caption"))
    return indexed.join(items.select("item_id", F.col("text").alias("edit_instruction")), "item_id").select("prompt_idx", styled.alias("original_caption"), "edit_instruction", "resulting_caption", "conv_id", "turn")


def lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.split("text", "\n", -1).alias("captions"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Candidates: vector i with the eight next ones; the texts are their successors; five vectors make a prompt."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.count()
    pairs = e.select(F.col("vec_id").alias("i"), F.col("v").alias("image0")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("j", F.pmod(F.col("i") + F.col("draw"), F.lit(n)))
    keys = {"image1": F.col("j"), "text0": F.pmod(F.col("i") + 1, F.lit(n)), "text1": F.pmod(F.col("j") + 1, F.lit(n))}
    for name, at in keys.items():
        pairs = pairs.withColumn("vec_id", at).join(e.withColumnRenamed("v", name), "vec_id").drop("vec_id")
    return pairs.select(F.floor(F.col("i") / 5).alias("prompt_idx"), (F.col("i") * 100 + F.col("draw")).alias("seed"), "image0", "image1", "text0", "text1")


def samples_big(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("prompt_idx"), F.col("event_id").alias("seed"))
    return e.withColumns({c: hash_uniform(c, "seed") for c in ("sim_0", "sim_1", "sim_dir", "sim_image")})


def scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("folder"), F.col("l_linenumber").cast("long").alias("seed"), "l_quantity")
    lines = spread(rows, "folder", "seed").groupBy("folder", "seed").agg(F.max("l_quantity").cast("long").alias("q"))
    h = hash_long("score", "folder", "seed")
    lists_ = {"sc": F.array(F.pmod("q", F.lit(11)).cast("double"), F.pmod(h, F.lit(11)).cast("double")), "pq": F.array(F.pmod(F.col("q") + 3, F.lit(11)).cast("double"), F.pmod(hash_long("score2", "folder", "seed"), F.lit(11)).cast("double"))}
    return lines.withColumns(lists_).withColumn("scored", F.pmod(hash_long("there", "folder", "seed"), F.lit(5)) != 0)


def overall(spark: SparkSession, d: str) -> DataFrame:
    from pairline.operators.curate import vie_score

    return vie_score(scores(spark, d).where("scored")).select("folder", "seed", "semantics_score", "quality_score", "overall_score")


def images(spark: SparkSession, d: str) -> DataFrame:
    """Two files of each sample; side 1 is missing for some, suffixes vary."""
    keys = scores(spark, d).select("folder", "seed").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    h = hash_long("side", "folder", "seed", "side")
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".webp", ".txt"))), (F.pmod(h, F.lit(4)) + 1).cast("int"))
    there = keys.where((F.col("side") == 0) | (F.pmod(h, F.lit(7)) != 0))
    return there.withColumn("path", F.concat(F.format_string("%07d", "folder"), F.lit("/"), F.col("seed").cast("string"), F.lit("_"), F.col("side").cast("string"), suffix))


def hub(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "kept").when(F.col("quality") == 0, "removed")
    return docs.select("doc_id", status.alias("status"), F.when(F.pmod("doc_id", F.lit(17)) != 0, F.col("source")).alias("class_name"), F.col("text").alias("original_caption"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("prompt_idx"))
    each = docs.withColumn("question", F.explode(F.array(*map(F.lit, ("edited", "complete", "same_words", "minimal")))))
    answer = F.pmod(hash_long("answer", "prompt_idx", "question"), F.lit(10)) + 1
    return each.withColumn("answer", answer).withColumn("reason", F.concat(F.lit("r"), F.col("answer").cast("string")))


def filelist(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where("url is not null")
    return pages.select("page_id", F.regexp_replace("url", r"^https?://[^/]*/|\?.*$", "").alias("relpath")).where("relpath != ''")


SQL = {
    "captions": f"SELECT text AS caption, source AS model, lang AS persona, doc_id AS gen_order, 'u' || ({H('url', 'doc_id')} % 400)::VARCHAR AS url FROM documents",
    "prompts": f"""SELECT prompt_idx, CASE WHEN prompt_idx % 3 = 0 THEN '{PHRASE}' || a ELSE a END AS original_caption, b.text AS edit_instruction, c AS resulting_caption, conv_id, turn
      FROM (SELECT row_number() OVER (ORDER BY x.conv_id, x.turn) - 1 AS prompt_idx, x.text AS a, y.text AS c, x.conv_id, x.turn FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) p
      JOIN benchmark b ON b.item_id = prompt_idx % (SELECT count(*) FROM benchmark)""",
    "lists": "SELECT doc_id, source, string_split(text, chr(10)) AS captions FROM documents",
    "vecs": """SELECT vec_id, v, n, list_transform(v, lambda x: x / size) AS u
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v, count(*) OVER () AS n, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings)""",
    "places": "SELECT vec_id AS i, draw, (vec_id + draw) % n AS j, (vec_id + 1) % n AS k, ((vec_id + draw) % n + 1) % n AS l FROM vecs, range(1, 9) AS r(draw)",
    "samples": """SELECT i // 5 AS prompt_idx, i * 100 + draw AS seed, a.v AS image0, b.v AS image1, s.v AS text0, t.v AS text1
      FROM places JOIN vecs a ON a.vec_id = i JOIN vecs b ON b.vec_id = j JOIN vecs s ON s.vec_id = k JOIN vecs t ON t.vec_id = l""",
    # the cosine of two differences of unit vectors, from their inner products
    "metrics": """SELECT prompt_idx, seed, sim_0, sim_1, sim_image, (sim_0 + sim_1 - list_dot_product(n1, m0) - list_dot_product(n0, m1)) / sqrt((2 - 2 * sim_image) * (2 - 2 * list_dot_product(m1, m0))) AS sim_dir
      FROM (SELECT i // 5 AS prompt_idx, i * 100 + draw AS seed, a.u AS n0, b.u AS n1, s.u AS m0, t.u AS m1, list_dot_product(a.u, s.u) AS sim_0, list_dot_product(b.u, t.u) AS sim_1, list_dot_product(a.u, b.u) AS sim_image
        FROM places JOIN vecs a ON a.vec_id = i JOIN vecs b ON b.vec_id = j JOIN vecs s ON s.vec_id = k JOIN vecs t ON t.vec_id = l)""",
    "samples_big": f"SELECT user_id AS prompt_idx, event_id AS seed, {', '.join(f'{U(c, chr(101) + 'vent_id')} AS {c}' for c in ('sim_0', 'sim_1', 'sim_dir', 'sim_image'))} FROM events",
    "scores": f"""SELECT folder, seed, q, [(q % 11)::DOUBLE, ({H('score', 'folder', 'seed')} % 11)::DOUBLE] AS sc, [((q + 3) % 11)::DOUBLE, ({H('score2', 'folder', 'seed')} % 11)::DOUBLE] AS pq, {H('there', 'folder', 'seed')} % 5 <> 0 AS scored
      FROM (SELECT l_orderkey AS folder, l_linenumber::BIGINT AS seed, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)""",
    "overall": "SELECT folder, seed, list_min(sc) AS semantics_score, list_min(pq) AS quality_score, sqrt(list_min(sc) * list_min(pq)) AS overall_score FROM scores WHERE scored",
    "images": f"""SELECT folder, seed, side, printf('%07d', folder) || '/' || seed::VARCHAR || '_' || side::VARCHAR || (['.jpg', '.PNG', '.webp', '.txt'])[h % 4 + 1] AS path
      FROM (SELECT folder, seed, side, {H('side', 'folder', 'seed', 'side')} AS h FROM scores, range(0, 2) AS r(side)) WHERE side = 0 OR h % 7 <> 0""",
    "hub": """SELECT d.doc_id, CASE quality WHEN 1 THEN 'kept' WHEN 0 THEN 'removed' END AS status, CASE WHEN d.doc_id % 17 <> 0 THEN source END AS class_name, text AS original_caption
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "answers": f"SELECT prompt_idx, question, answer, 'r' || answer::VARCHAR AS reason FROM (SELECT doc_id AS prompt_idx, question, {H('answer', 'doc_id', 'question')} % 10 + 1 AS answer FROM documents, unnest(['edited', 'complete', 'same_words', 'minimal']) AS t(question))",
    "filelist": "SELECT page_id, relpath FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*/|\\?.*$', '', 'g') AS relpath FROM pages) WHERE relpath <> ''",
}
NEEDS = {"places": ["vecs"], "samples": ["places"], "metrics": ["samples"], "overall": ["scores"], "images": ["scores"]}


def with_views(sql: str, *names: str) -> str:
    """sql with the views that it names, and those that these need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('vecs', 'places', 'prompts', 'metrics') else ''}({SQL[n]})" for n in order) + "\n" + sql
