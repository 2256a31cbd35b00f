"""Stored tables that change, streams by key, seen keys and indexes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairline.operators import browse, curate, grams, seen, split
from pairline.sources.scratch import cut, drop, shared_dir, temporary
from pairline.sources.store import Store
from pairline.streaming import incremental

ROW = "uid long, prompt_input string, vision_input string, score double"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), ("uid",), ROW, 8)
    s.append(spark.createDataFrame([(i, f"p{i}", "v", float(i)) for i in range(200)], ROW))
    return s


def folders(store):
    return store._manifest()["folders"]


def test_one_changed_row_rewrites_one_bucket(spark, store):
    before = folders(store)
    assert store.update(spark.createDataFrame([(5, "", "new", None)], ROW), curate.upsert_results) == 1
    after = folders(store)
    assert sum(before[b] != after[b] for b in before) == 1
    rows = {r.uid: r for r in store.read().collect()}
    assert len(rows) == 200 and (rows[5].prompt_input, rows[5].vision_input, rows[5].score) == ("p5", "new", 5.0)
    assert {r.uid: r.vision_input for r in store.read(version=1).collect()}[5] == "v"
    assert store.vacuum() == 0  # the first folder still holds seven buckets


def test_a_run_broken_half_way_leaves_the_old_version(spark, store):
    new, old = spark.createDataFrame([(i, "n", "n", 0.0) for i in range(300)], ROW), store.read().collect()
    with pytest.raises(Exception, match="broken"):
        store.update(new, lambda a, b: curate.upsert_results(a, b).where(F.when(F.col("uid") == 299, F.raise_error(F.lit("broken")).cast("boolean")).otherwise(True)))
    assert store.version() == 1 and sorted(store.read().collect()) == sorted(old)
    assert store.vacuum() <= 1  # what the broken run may have left
    again = Store(spark, store.path)
    assert again.update(new, curate.upsert_results) == 8 and again.read().count() == 300
    assert store.vacuum() == 1 and sorted(r.uid for r in store.read().collect()) == list(range(300))


def test_the_second_of_two_writers_fails(spark, store):
    other, row = Store(spark, store.path), spark.createDataFrame([(1, "x", "x", 0.0)], ROW)

    def merge(a, b):
        other.append(row)
        return curate.upsert_results(a, b)

    with pytest.raises(RuntimeError, match="another writer"):
        store.update(row, merge)
    assert store.read().where("uid = 1").count() == 2 and store.version() == 2


def test_store_awkward(spark, tmp_path, store):
    assert store.update(store.read().limit(0), curate.upsert_results) == 0 and store.append(store.read().limit(0)) == 0 and store.version() == 1
    store.append(spark.createDataFrame([(None, None, None, None), (None, "a", "b", 1.0)], ROW))
    assert store.read().where("uid is null").count() == 2
    assert store.update(spark.createDataFrame([(7, "", "", 0.0)], ROW), lambda old, new: old.join(new, "uid", "left_anti")) == 1
    assert store.read().where("uid = 7").count() == 0
    empty = Store(spark, str(tmp_path / "none"), ("uid",), ROW)
    assert empty.read().count() == 0 and empty.version() == 0
    assert empty.update(spark.createDataFrame([(1, "a", "b", 1.0)], ROW), curate.upsert_results) == 1 and empty.read().count() == 1


@pytest.mark.parametrize("cuts", [[10], [3, 4, 3], [1] * 10])
def test_a_keyed_stream_does_what_runs_for_each_file_do(spark, tmp_path, cuts):
    keys = [1, 2, 1, None, 3, 2, 4, None, 1, 5]
    source, out, mark, other = (str(tmp_path / n) for n in ("in", "out", "mark", "other"))
    work = lambda d: d.withColumn("v", F.col("k") * 2)
    at = 0
    for n in cuts:
        part = spark.createDataFrame([(k,) for k in keys[at : at + n]], "k long").coalesce(1)
        part.write.mode("append").parquet(source)
        incremental.incremental_run(part, "k", work, other)
        at += n
        if at in (4, 7):  # stopped and started again on the way
            incremental.keyed_stream(spark, source, "k long", "k", work, out, mark, files_per_batch=1)
    for _ in range(2):
        incremental.keyed_stream(spark, source, "k long", "k", work, out, mark, files_per_batch=1)
    key = lambda r: (r.k is not None, r.k)
    got = spark.read.schema("k long, v long").parquet(out).select("k", "v").collect()
    assert sorted(got, key=key) == sorted(spark.read.schema("k long, v long").parquet(other).collect(), key=key)
    assert {r.k for r in got} == set(keys)


def test_a_stream_that_breaks_does_its_batch_again(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(6).coalesce(1).write.parquet(source)

    def broken(df):
        df.write.mode("overwrite").parquet(f"{out}/batch=0")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        incremental.keyed_stream(spark, source, "id long", "id", broken, out, mark)
    for _ in range(2):
        incremental.keyed_stream(spark, source, "id long", "id", lambda d: d, out, mark)
    assert sorted(r.id for r in spark.read.schema("id long").parquet(out).collect()) == list(range(6))


def test_a_keyed_stream_joins_with_the_keys_of_earlier_batches_only(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(100_000).write.parquet(source)
    spark.range(100_000).write.parquet(f"{mark}/keys/batch=0")  # as a batch leaves them that broke before it was committed
    incremental.keyed_stream(spark, source, "id long", "id", lambda d: d, out, mark)
    assert spark.read.schema("id long").parquet(out).count() == 100_000
    spark.range(50_000, 150_000).write.mode("append").parquet(source)
    incremental.keyed_stream(spark, source, "id long", "id", lambda d: d, out, mark)
    assert sorted(r.id for r in spark.read.schema("id long").parquet(out).collect()) == list(range(150_000))
    assert spark.read.schema("id long").parquet(f"{mark}/keys").distinct().count() == 150_000
    assert not (tmp_path / "mark" / "state").exists()  # no row for each key in Python


def test_scores_are_dealt_by_their_number(spark, monkeypatch):
    from compare import SF

    from pairline.operators.curate import complete_pairs
    from pairline.plans import views

    want = sorted(complete_pairs(views.images(spark, SF)).collect())
    monkeypatch.setattr(views, "SPREAD", 500)
    got = complete_pairs(views.images(spark, SF))
    sizes = [len(part) for part in got.rdd.glom().collect()]
    assert len(sizes) >= len(want) // 500 and max(sizes) <= 1000
    assert sorted(got.collect()) == want


def test_filters_have_no_false_negatives_and_few_false_hits(spark):
    keys = spark.range(20_000).select((F.col("id") * 7 - 3).alias("k"))
    blocks = seen.n_blocks(20_000)
    whole = seen.bloom_filter(keys, "k", blocks)
    parts = [seen.bloom_filter(keys.where(F.pmod("k", F.lit(3)) == i), "k", blocks) for i in range(3)]
    assert sorted(whole.collect()) == sorted(seen.merge_filters(*parts).collect())
    assert whole.count() <= blocks
    asked = spark.range(140_000).select((F.col("id") - 3).alias("k"))
    hits = seen.may_hold(asked, "k", whole, blocks).where("hit")
    assert hits.where(F.pmod(F.col("k") + 3, F.lit(7)) == 0).count() == 20_000
    assert hits.count() - 20_000 <= 0.015 * 120_000
    assert seen.may_hold(spark.createDataFrame([(None,)], "k long"), "k", whole, blocks).first()["hit"] is False


def test_the_history_is_read_for_hits_only(spark, tmp_path):
    known = seen.SeenKeys(spark, str(tmp_path / "seen"), "bigint", expected=5000, buckets=32)
    new = spark.range(1_000_000, 1_000_050).withColumnRenamed("id", "k")
    assert known.unseen(new, "k").count() == 50 and known.read_buckets == set()
    known.add(spark.range(3000), "id")
    known.add(spark.range(2500, 4000), "id")
    assert known.unseen(new, "k").count() == 50 and len(known.read_buckets) <= 3
    mixed = spark.createDataFrame([(5, "a"), (5, "b"), (9999, "c"), (None, "d")], "k long, v string")
    again = seen.SeenKeys(spark, str(tmp_path / "seen"), "bigint")
    assert again.blocks == known.blocks
    assert sorted(r.v for r in again.unseen(mixed, "k").collect()) == ["c", "d"] and 1 <= len(again.read_buckets) <= 2
    assert again.unseen(mixed.limit(0), "k").count() == 0
    again.add(mixed.limit(0), "k")
    full = seen.SeenKeys(spark, str(tmp_path / "full"), "bigint", expected=1)  # every look-up hits, and is confirmed
    full.add(spark.range(2000), "id")
    assert full.unseen(spark.range(4000), "id").count() == 2000


TEXTS = ["The quick\nbrown fox", "quick", "QUICK fox", None, "", "ab", "über \U0001f600 fox \U0001f600\U0001f600x", "a.b*c\\", "foxfox" * 40, "İstanbul fox"]


@pytest.mark.parametrize("pushed", [0, 1000])
def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(grams, "PUSHED", pushed)
    monkeypatch.setattr(grams, "BLOCK", 3)
    df = spark.createDataFrame([(i, t, "kept" if i % 2 else None, f"c{i % 3}") for i, t in enumerate(TEXTS)], "n long, caption string, status string, class_name string")
    index = grams.GramIndex(spark, str(tmp_path / "grams"))
    index.build(df, "n", ("caption",))
    assert index.lists("caption").agg(F.max("n")).first()[0] <= len(TEXTS) and index.lists("caption").groupBy("gram").count().agg(F.max("count")).first()[0] > 1
    for term in ("fox", "QUICK", "quick\nb", "\U0001f600\U0001f600x", "a.b*c\\", "none of them", "", "ab", "İst", "foxfoxfox", "k\nbro"):
        for statuses, classes in ((["kept", "N/A"], []), (["kept"], ["c1"])):
            want = browse.facet_search(df, statuses, classes, {"caption": term})
            assert sorted(r.n for r in grams.indexed_search(df, index, "n", statuses, classes, {"caption": term}).collect()) == sorted(r.n for r in want.collect()), term
    plan = index.lists("caption").where(F.col("gram").isin(grams.grams_of("quick")))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan.split("PushedFilters")[1]


def test_the_index_shuffles_lists_of_blocks(spark, tmp_path, monkeypatch):
    df = spark.range(600).coalesce(1).select("id", F.concat(F.lit("the same words \U0001f600 "), F.col("id").cast("string")).alias("t"))
    index = grams.GramIndex(spark, str(tmp_path / "rows"))
    index.build(df, "id", ("t",))
    assert index.lists("t").where("gram = 'the'").count() == 1  # one list for a task's rows, as they fill no block
    monkeypatch.setattr(grams, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(grams, "BLOCK", 100)
    index = grams.GramIndex(spark, str(tmp_path / "blocks"))
    index.build(df, "id", ("t",))
    found = index.lists("t").where("gram = 'the'").collect()
    assert sorted(i for r in found for i in r.ids) == list(range(600)) and len(found) >= 10 and max(r.n for r in found) <= 60
    assert index.lists("t").where("n != size(ids)").count() == 0 and index.lists("t").groupBy("gram", "block").count().where("count > 1").count() == 0
    assert index.candidates("t", "s \U0001f600 59").count() == 11 and index.candidates("t", "E WORDS").count() == 600
    strings = grams.GramIndex(spark, str(tmp_path / "strings"), "string")
    strings.build(df.withColumn("id", F.concat(F.lit("x"), F.col("id").cast("string"))), "id", ("t",))
    assert strings.candidates("t", "words").where("id = 'x7'").count() == 1


@pytest.mark.parametrize(("n", "bits"), [(64, 6), (40, 6), (2, 1), (1, 3), (0, 4), (100, 32)])
def test_seeds_are_exactly_as_many_as_asked_for(spark, n, bits):
    prompts = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    rows = split.draw_seeds(prompts, "k", n, "s", bits=bits).collect()
    assert len(rows) == 3 * n and all(0 <= r.seed < 1 << bits for r in rows)
    assert all(len({r.seed for r in rows if r.k == k}) == n for k in ("a", "b", None))
    if n > 30:
        assert [r.seed for r in sorted(rows, key=lambda r: r.draw) if r.k == "a"] != [r.seed for r in sorted(rows, key=lambda r: r.draw) if r.k == "b"]


def test_permutations_of_any_domain(spark):
    for domain in (1, 2, 3, 37, 1000, 1025):
        got = [r.x for r in spark.range(domain).select(split.permuted(F.col("id"), domain, "p").alias("x")).collect()]
        assert sorted(got) == list(range(domain)), domain
    with pytest.raises(ValueError, match="different seeds"):
        split.draw_seeds(spark.range(1), "id", 65, "s", bits=6)


def test_temporary_tables_go(spark):
    def names():
        made = Path(shared_dir(spark).removeprefix("file:"))
        return {p.name.split("-")[0] for p in made.iterdir() if p.name.startswith("temporary")}

    with temporary(spark):
        first = cut(spark.range(3), "temporarygone")
        with temporary(spark):
            cut(first, "temporaryinner")
        assert names() == {"temporarygone"} and first.count() == 3
        kept = cut(first, "temporarykept", lasting=True)
    assert kept.count() == 3 and names() == {"temporarykept"}
    with pytest.raises(ValueError), temporary(spark):
        cut(spark.range(3), "temporarybroken")
        raise ValueError
    outside = cut(spark.range(1), "temporaryoutside")
    assert names() == {"temporarykept", "temporaryoutside"}
    for table in (kept, outside):
        drop(table)
    assert not names()
