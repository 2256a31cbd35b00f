"""Vector arithmetic and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairline.functions import vectors as vx
from pairline.operators import quantised
from pairline.operators import retrieval as re_
from pairline.plans import views
from pairline.plans.registry import query
from pairline.plans.views import with_views as V  # noqa: N812
from pairline.sources.scratch import cut


def pool(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def six(v):
    return F.transform(v, lambda x: vx.rounded(x))


@query("l2_normalise", "SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def l2_normalise(spark, d):
    return pool(spark, d).select(F.col("img_id").alias("vec_id"), six(vx.l2_normalise(F.col("embedding"))).alias("unit"))


@query("pair_cosine", V("SELECT seed, round(list_cosine_similarity(image0, image1), 6) AS cosine FROM samples", "samples"))
def pair_cosine(spark, d):
    return views.samples(spark, d).select("seed", vx.rounded(vx.cosine(F.col("image0"), F.col("image1"))).alias("cosine"))


@query("direction_similarity", V("SELECT seed, round(sim_dir, 6) AS sim_dir FROM metrics", "metrics"))
def direction_similarity(spark, d):
    unit = [vx.l2_normalise(F.col(c)) for c in ("image0", "image1", "text0", "text1")]
    return views.samples(spark, d).select("seed", vx.rounded(vx.direction_similarity(*unit)).alias("sim_dir"))


@query("pair_metrics_clip", V("SELECT prompt_idx, seed, round(sim_0, 6) AS sim_0, round(sim_1, 6) AS sim_1, round(sim_dir, 6) AS sim_dir, round(sim_image, 6) AS sim_image FROM metrics", "metrics"))
def pair_metrics_clip(spark, d):
    m = vx.pair_metrics_clip(*map(F.col, ("image0", "image1", "text0", "text1")))
    return views.samples(spark, d).select("prompt_idx", "seed", *[vx.rounded(v).alias(k) for k, v in m.items()])


@query("pair_metrics_dino", V("SELECT prompt_idx, seed, 1.0::DOUBLE AS sim_0, 1.0::DOUBLE AS sim_1, 1.0::DOUBLE AS sim_dir, round(list_cosine_similarity(image0, image1), 6) AS sim_image FROM samples", "samples"))
def pair_metrics_dino(spark, d):
    m = vx.pair_metrics_dino(F.col("image0"), F.col("image1"))
    return views.samples(spark, d).select("prompt_idx", "seed", *[vx.rounded(v).alias(k) for k, v in m.items()])


@query("mean_pool", """SELECT item, list_transform(p, lambda x: round(x / sqrt(list_dot_product(p, p)), 6)) AS pooled FROM (SELECT item, list(x ORDER BY i) AS p FROM (SELECT item, i, avg(v[i]) AS x FROM (SELECT vec_id // 7 AS item, embedding::DOUBLE[] AS v FROM embeddings), range(1, 65) AS r(i) GROUP BY item, i) GROUP BY item)""")
def mean_pool(spark, d):
    tokens = pool(spark, d).withColumn("item", F.expr("img_id div 7"))
    return re_.mean_pool(tokens, "item").select("item", six(F.col("pooled")).alias("pooled"))


MEAN, STD = [0.48, 0.46, 0.41], [0.27, 0.26, 0.28]


@query("channel_normalise", f"""SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: round((v[i] - ({MEAN}::DOUBLE[])[(i - 1) % 3 + 1]) / ({STD}::DOUBLE[])[(i - 1) % 3 + 1], 6)) AS normal,
  list_transform(v, lambda x: round(x * 2 / 255 - 1, 6)) AS by_255, list_transform(v, lambda x: round(x / 127.5 - 1, 6)) AS by_127 FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def channel_normalise(spark, d):
    v = F.col("embedding")
    return pool(spark, d).select(F.col("img_id").alias("vec_id"), six(vx.channel_normalise(v, MEAN, STD)).alias("normal"), six(vx.scale_255(v)).alias("by_255"), six(vx.scale_127(v)).alias("by_127"))


@query("psnr", V("SELECT seed, round(20 * log10(255 / sqrt(list_sum(list_transform(list_zip(image0, image1), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(image0))), 6) AS psnr FROM samples", "samples"))
def psnr(spark, d):
    return views.samples(spark, d).select("seed", vx.rounded(vx.psnr(F.col("image0"), F.col("image1"))).alias("psnr"))


KNN = """SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank
  FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"""


def exact(spark, d):
    p = pool(spark, d)
    return re_.knn_exact(p, p.where("img_id % 50 = 0"), 10)


@query("knn_exact", KNN)
def knn_exact(spark, d):
    return exact(spark, d).withColumn("score", vx.rounded(F.col("score")))


@query("knn_partitioned")
def knn_partitioned(spark, d):
    p = pool(spark, d)
    return quantised.knn_partitioned(p, p.where("img_id % 50 = 0"), 10)


@query("knn_hashed")
def knn_hashed(spark, d):
    p = pool(spark, d)
    return quantised.knn_hashed(p, p.where("img_id % 50 = 0"), 10)


@query("knn_recall", "SELECT unnest(['knn_hashed', 'knn_partitioned']) AS search, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS n_queries, 10::BIGINT AS fewest, true AS reached")
def knn_recall(spark, d):
    """For both searches over codes: the queries, the fewest rows of one, and whether 90 of 100 exact neighbours were found."""
    p, rows = cut(pool(spark, d), "pool"), []
    asked = p.where("img_id % 50 = 0")
    true = cut(re_.knn_exact(p, asked, 10).select("query_id", "id", F.lit(1).alias("hit")), "true")
    for name, search in (("knn_hashed", quantised.knn_hashed), ("knn_partitioned", quantised.knn_partitioned)):
        each = search(p, asked, 10).join(true, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
        rows.append(each.agg(F.lit(name).alias("search"), F.count("*").alias("n_queries"), F.min("n").alias("fewest"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("reached")))
    return rows[0].unionByName(rows[1])


@query("gather_by_id", f"SELECT query_id, list(id ORDER BY rank) AS ids, list(label ORDER BY rank) AS label FROM ({KNN}) JOIN embeddings ON vec_id = id GROUP BY query_id")
def gather_by_id(spark, d):
    attributes = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), "label")
    return re_.gather_by_id(exact(spark, d), attributes, "img_id", ["label"])


@query("tile_grid", """SELECT p_partkey, x, y FROM (SELECT p_partkey, p_size * 100 AS w, floor(p_retailprice)::INT AS h FROM part), LATERAL (SELECT unnest(CASE WHEN w > 800 AND h > 800 THEN list_append(range(0, greatest(w - 512, 0), 448), w - 512) ELSE [0] END) AS x), LATERAL (SELECT unnest(CASE WHEN w > 800 AND h > 800 THEN list_append(range(0, greatest(h - 512, 0), 448), h - 512) ELSE [0] END) AS y)""")
def tile_grid(spark, d):
    dims = views.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).cast("int").alias("w"), F.floor("p_retailprice").cast("int").alias("h"))
    return re_.tile_grid(dims, 512, 64, 800).select("p_partkey", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
