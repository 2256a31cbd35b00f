"""Numbers in groups, scans and rows by rank, whatever the sizes of groups and the ties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairline.operators import browse, curate, metrics, order, prompts, split


def test_numbers_in_groups_of_any_size(spark):
    rows = [("hot", i) for i in range(3000)] + [(None, i) for i in range(900)] + [(f"g{i % 50}", i) for i in range(1000)] + [("last", 7)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(6)
    got = order.number_in_groups(df, ["g"], [F.desc("i")], "n", "size").collect()
    sizes = {}
    for g, _ in rows:
        sizes[g] = sizes.get(g, 0) + 1
    assert len(got) == len(rows) and all(r["size"] == sizes[r.g] for r in got)
    for g in ("hot", None, "g7", "last"):
        mine = sorted((r.n, -r.i) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(1, sizes[g] + 1)) and mine == sorted(mine, key=lambda x: x[1])
    assert order.number_in_groups(df.limit(0), ["g"], ["i"]).count() == 0
    plan = order.number_in_groups(df, ["g"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__part" in plan and "SinglePartition" not in plan


def test_a_hot_group_lies_in_several_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), "id")
    tagged = df.orderBy("g", "id").withColumn("p", F.spark_partition_id()).groupBy("p").count()
    assert tagged.count() > 1
    logs = browse.history_newest_first(df, "g", ["id"])
    assert sorted((r.id, r.number, r.display_row) for r in logs.collect()) == [(i, i + 1, (3999 - i) // 3) for i in range(4000)]
    samples = df.select(F.lit(1).alias("prompt_idx"), (F.col("id") % 7).cast("double").alias("sim_dir"), F.col("id").alias("seed"))
    want = sorted(((-(i % 7), -i) for i in range(4000)))
    assert [(-(r.seed % 7), -r.seed) for r in sorted(curate.rank_unfiltered(samples).collect(), key=lambda r: r["rank"])] == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9)), max_size=60), st.integers(2, 5))
def test_scans(spark, values, width):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(3)
    for operation, fold in ((order.SUM, sum), (order.MIN, min), (order.MAX, max)):
        for inclusive in (True, False):
            got = {r.i: r.x for r in order.scan(df, "i", F.col("v"), operation, "x", inclusive, width, 3).collect()}
            for i in range(len(values)):
                seen = [v for v in values[: i + inclusive] if v is not None]
                assert got[i] == (fold(seen) if seen else None)


def test_the_last_value_that_was_set_is_a_largest_struct(spark):
    df = spark.range(50).withColumn("v", F.when(F.col("id") % 7 == 3, F.col("id") * 10))
    last = F.when(F.col("v").isNotNull(), F.struct("id", "v"))
    got = {r.id: r.x and r.x.v for r in order.scan(df, "id", last, order.MAX, "x", width=4).collect()}
    assert got == {i: (i - (i - 3) % 7) * 10 if i >= 3 else None for i in range(50)}


def test_a_checkpoint_log_row_by_row(spark):
    values = [5.0, 4.0, 4.0, 6.0, 3.0] + [3.5] * 1500 + [1.0, 2.0]
    log = spark.createDataFrame([(f"s{i:05d}", v) for i, v in enumerate(values)], "step string, v double").repartition(4)
    got = {r.step: r for r in metrics.best_checkpoint(log, "step", "v").collect()}
    best, since = float("inf"), 0
    for i, v in enumerate(values):
        since = 0 if v < best else since + 1
        best = min(best, v)
        r = got[f"s{i:05d}"]
        assert (r.best, r.n_since, r.stopped, r.is_best) == (best, since, since >= 10, since == 0)


def test_progress_over_many_calls(spark):
    df = spark.range(5000).select((F.col("id") % 1700).cast("string").alias("caption"), F.floor(F.col("id") / 2).alias("call"))
    got = sorted(prompts.dedupe_progress(df, "call").collect(), key=lambda r: r.call)
    assert len(got) == 2500 and [r.n_total for r in got[:3]] == [2, 4, 6] and got[-1].n_total == 1700 and got[-1].n_new == 0


KEYS = st.lists(st.one_of(st.none(), st.integers(-5, 5), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(KEYS, st.data())
def test_first_rows_by_counting(spark, keys, data):
    n = data.draw(st.integers(0, len(keys) + 1))
    df = spark.createDataFrame(list(enumerate(keys)), "i long, k long").repartition(3)
    got = order.first_rows(df, "k", n, "i").collect()
    assert sorted(r.i for r in got) == sorted(sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))[:n])


def test_the_nth_key_is_found_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(order, "INTERVALS", 4)
    monkeypatch.setattr(order, "LAST_ROWS", 3)
    keys = [7] * 20 + [i * i for i in range(100)] + [10**15, -(10**15)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    ordered = sorted(keys)
    for n in (1, 2, 5, 15, 25, 60, 121, 122):
        assert order.nth_key(df, "k", n) == (ordered[n - 1], sum(k < ordered[n - 1] for k in keys))


def test_samples_are_not_sorted(spark):
    df = spark.range(20_000).withColumn("name", F.col("id").cast("string"))
    half = split.sample_n(df, "id", "s", 10_000)
    assert "TakeOrdered" not in half._jdf.queryExecution().executedPlan().toString()
    ids = {r.id for r in half.select("id").collect()}
    assert len(ids) == 10_000 and ids == {r.id for r in df.orderBy(split.hash_long("s", "id")).limit(10_000).collect()}
    assert sorted(r.id for r in split.first_n_accepted(df, "id", F.col("id") % 3 == 0, 500, done=20).collect()) == list(range(0, 1440, 3))
    names = sorted(r.name for r in split.first_n_accepted(df, "name", F.col("id") < 200, 50).collect())
    assert names == sorted(map(str, range(200)))[:50]
    assert split.first_n_accepted(df, "id", F.lit(True), 5, done=9).count() == 0


@pytest.mark.parametrize("page", [1, 2, 50, 51, 99])
def test_deep_pages(spark, page):
    df = spark.range(1003).select((F.col("id") * 3 - 500).alias("k")).repartition(4)
    got = browse.paginate(df, "k", page, 20)
    first = (page - 1) * 20
    assert [r.k for r in got.collect()] == [i * 3 - 500 for i in range(1003)][first : first + 20]
    if page < 52:
        r = got.first()
        assert (r.n_pages, r.first_shown, r.last_shown) == (51, first + 1, min(first + 20, 1003))
    ties = spark.createDataFrame([(5,)] * 30 + [(6,)] * 30 + [(None,)] * 0, "k long")
    assert [r.k for r in browse.paginate(ties, "k", 2, 25).collect()] == [5] * 5 + [6] * 20
