"""Golden cases of quirks, properties, plans and files."""

import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairline.functions import text as tx
from pairline.functions import vectors as vx
from pairline.operators import align, curate, judge, metrics, split
from pairline.operators.order import index_rows, running_total
from pairline.sources import io
from pairline.streaming import incremental


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_ties_go_to_the_larger_seed_and_bounds_are_inclusive(spark):
    t = curate.Thresholds(0.2, 0.2, 0.5, 2)
    rows = [(1, 5, 0.2, 0.2, 0.4, 0.5), (1, 9, 0.2, 0.3, 0.4, 0.5), (1, 7, 0.9, 0.9, 0.3, 0.9), (2, 1, 0.1, 0.9, 0.9, 0.9)]
    s = spark.createDataFrame(rows, "prompt_idx long, seed long, sim_0 double, sim_1 double, sim_dir double, sim_image double")
    assert [(r.seed, r.rank) for r in curate.topk_per_prompt(s, t).orderBy("rank").collect()] == [(9, 1), (5, 2)]
    plan = curate.topk_per_prompt(s, t)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_unscored_samples_survive_and_the_score_bound_is_strict(spark):
    s = spark.createDataFrame([(1, 2.0), (2, 1.9), (3, None)], "seed long, overall_score double")
    assert {r.seed for r in curate.kept_samples(curate.route_by_score(s, 2.0)).collect()} == {1, 3}


def test_dino_direction_is_one_or_nought(spark):
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    m = vx.pair_metrics_dino(F.col("a"), F.col("b"))
    assert [round(r.x, 6) for r in v.select(m["sim_dir"].alias("x")).collect()] == [1.0, 0.0]


def test_null_keys_were_never_seen(spark):
    rows = spark.createDataFrame([("a", None), (None, "u"), ("b", "u"), ("c", "v")], "caption string, url string")
    seen = spark.createDataFrame([(None, "u"), ("c", None)], "caption string, url string")
    assert [(r.caption, r.url) for r in curate.resume_unseen(rows, seen).collect()] == [("a", None)]


def test_attach_prompt_strict(spark):
    s, p = spark.createDataFrame([("x", 1)], "folder string, seed long"), spark.createDataFrame([], "folder string, caption string")
    assert curate.attach_prompt(s, p).count() == 0
    with pytest.raises(Exception, match="no prompt for x"):
        curate.attach_prompt(s, p, strict=True).collect()


@pytest.mark.parametrize(
    ("answer", "method", "score"),
    [
        ("rate_limit_exceeded", "rate_limited", None),
        ('||V^=^V||{"score": [3, 4],\n "reasoning": "x"}||V^=^V||', "json", [3, 4]),
        ('text {"score": 7, "reasoning": "y"} more', "json", [7]),
        ("{score: 5, reasoning: all good}", "repaired", [5]),
        ("about [2, 9] I think", "list", [2, 9]),
        (" 8 ", "number", [8]),
        ("11", "failed", None),
        ("nothing", "failed", None),
        (None, "failed", None),
    ],
)
def test_parse_judge_output(spark, answer, method, score):
    got = one(spark, judge.parse_judge_output(F.col("a").cast("string")), a=answer)
    assert (got.method, got.score) == (method, score)


def test_giving_up_comes_before_a_valid_list(spark):
    got = one(spark, judge.parse_judge_output(F.col("a"), give_up=True), a="[2, 9]")
    assert got.method == "guessed" and 0 <= got.score[0] <= 10


def test_validate_scores(spark):
    v = judge.validate_scores(F.col("a"))
    got = lambda a: one(spark, F.struct(v["score_list"].alias("l"), v["named_scores"].alias("n")), a=a)
    assert got("[1, 10]").l and not got("[1, 11]").l and not got("x").l
    assert got("[score1: 3, score2: 4]").n and not got("[score2: 3, score1: 4]").n


def test_words(spark):
    assert one(spark, tx.clean_tokens(F.col("a")), a="It's a V-neck,\tnot  a shirt!") == ["Its", "a", "Vneck", "not", "a", "shirt"]
    assert one(spark, tx.normal_caption(F.col("a")), a="\t A Cup?! ") == "a cup"
    assert one(spark, tx.folder_key(F.col("a")), a=123456789) == "123456789"
    assert one(spark, tx.highlight(F.col("a"), "a.b"), a="xA.Bx a-b") == "x<mark>A.B</mark>x a-b"
    assert one(spark, tx.persona_name(F.col("a")), a="\n Ann Lee, a cook, 30") == "Ann Lee"
    assert one(spark, tx.phrase_position(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))), a=1) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_alignment_score_is_the_longest_common_subsequence(x, y):
    score, mapped = align.align(x, y)
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (a == b))
    assert score == table[-1][-1]
    used = [m for m in mapped if m >= 0]
    assert used == sorted(used) and all(x[m] == y[j] for j, m in enumerate(mapped) if m >= 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_alignment_walks_back_by_the_tie_rule(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            table[i][j] = max(table[i][j - 1], table[i - 1][j], table[i - 1][j - 1] + (1 if a == b else -1))
    mapped, i, j = [-1] * len(y), len(x), len(y)
    while j:
        if table[i][j] == table[i][j - 1]:
            j -= 1
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            mapped[j] = i
    assert align.align(x, y) == (table[-1][-1], mapped)


def test_long_captions_are_aligned_whole(spark):
    from compare import SF

    from pairline.plans import registry, views

    words = {r.prompt_idx: (r.a, r.b) for r in views.prompts(spark, SF).select("prompt_idx", tx.clean_tokens(F.col("original_caption")).alias("a"), tx.clean_tokens(F.col("resulting_caption")).alias("b")).collect()}
    got = {r.prompt_idx: (r.score, r.mapping) for r in registry.queries()["align_captions"](spark, SF).collect()}
    assert got.keys() == words.keys() and any(len(a) > 60 and len(b) > 60 for a, b in words.values())
    assert all(len(got[k][1]) == len(b) for k, (_, b) in words.items())
    tail = [f"w{i}" for i in range(5000)]
    score, mapped = align.align(["x"] * 100 + tail, ["y"] * 70 + tail)
    assert score == 5000 and mapped == [-1] * 70 + list(range(100, 5100))


def test_index_and_running_total(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 13).alias("v"))
    indexed = index_rows(df, F.desc("id"))
    assert sorted((r.id, r.idx) for r in indexed.collect()) == [(i, 999 - i) for i in range(1000)]
    got = {r.idx: r.t for r in running_total(indexed, "idx", "v", "t", width=37).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += (999 - i) * 7 % 13
    assert index_rows(df.limit(0), "id").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9))
def test_array_split_is_a_partition(spark, n, parts):
    got = [r.part for r in split.array_split(spark.range(n), "id", parts).orderBy("idx").collect()]
    sizes = [n // parts + (i < n % parts) for i in range(parts)]
    assert got == [i for i, s in enumerate(sizes) for _ in range(s)]


def test_groups_do_not_leak(spark):
    df = spark.range(400).withColumn("g", F.col("id") % 40)
    out = split.group_split(df, "g", "s")
    assert out.count() == 400
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split: r.n for r in out.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()} == {"train": 36, "val": 2, "test": 2}


def test_sampling_errors(spark):
    with pytest.raises(ValueError):
        split.sample_n(spark.range(3), "id", "s", 4)
    with pytest.raises(ValueError):
        split.ratio_split(spark.range(3), "id", (0.9, 0.05, 0.06))
    none = spark.createDataFrame([(1, "a", False)], "k long, path string, exists boolean")
    with pytest.raises(Exception, match="no variant of 1"):
        split.flip_variant(none, "k", "path", "s").collect()


def test_seeds_sort_as_paths(spark):
    images = spark.createDataFrame([("f", s, 0) for s in (9, 10, 100)], "folder string, seed long, side int")
    assert split.seed_manifest(images).first().seeds == ["100", "10", "9"]


def test_perplexity_of_even_codes(spark):
    row = metrics.code_perplexity(spark.range(100).select((F.col("id") % 4).alias("code"))).first()
    assert round(row.perplexity, 6) == 4.0 and row.used == 4


def test_rounding_keeps_the_sign_of_what_becomes_zero(spark, duck):
    values = [-3e-7, 3e-7, -0.0, 0.0, -5e-7, 2.5e-6, 3.5e-6, 0.1234565, -1.0000005, 12345.6789012, 1e303, float("inf"), float("nan"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", vx.rounded(F.col("v")).alias("x")).orderBy("i")
    want = duck.execute("SELECT list_transform($1::DOUBLE[], lambda x: round(x, 6))", [values]).fetchone()[0]
    assert [repr(r.x) for r in got.collect()] == [repr(x) for x in want]


@pytest.mark.parametrize("name", ["l2_normalise", "mean_pool", "knn_exact"])
def test_vectors_with_components_near_zero_give_what_sql_gives(spark, tmp_path, name):
    import duckdb
    from compare import same

    from pairline.plans import registry

    rows = [(i, [-1e-9 * (i + 1)] + [0.01 * (j % 7 - 3) + 0.001 * (i + 1) for j in range(62)] + [1e-8], i % 3) for i in range(14)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        same(registry.queries()[name](spark, str(tmp_path)), con.execute(registry.oracle_sql()[name]).df())


def test_components_that_cancel_pool_to_zero_as_in_sql(spark, tmp_path):
    import duckdb
    from compare import same

    from pairline.plans import registry

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 64)).astype(np.float32)
    for i in range(0, 700, 7):
        x[i + 3 : i + 6, :40] = -x[i : i + 3, :40]
        x[i + 6, :40] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(-3, x[0].tolist(), 0), (2**53 * 7 + 6, x[6].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        same(registry.queries()["mean_pool"](spark, str(tmp_path)), con.execute(registry.oracle_sql()["mean_pool"]).df())


def test_psnr_of_equal_and_unequal_arrays(spark):
    assert one(spark, vx.psnr(F.array(F.lit(1.0)), F.array(F.lit(1.0))), a=1) == float("inf")
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vx.psnr(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), a=1)


def test_files(spark, tmp_path):
    root = tmp_path / "out"
    for name, body in {"0000001": {"original_caption": "a", "edit_instruction": "b", "resulting_caption": "c"}, "0000002": {"prompt": {"original_caption": "x"}, "global_index": 4}}.items():
        (root / name).mkdir(parents=True)
        (root / name / "prompt.json").write_text(json.dumps(body, indent=1))
        (root / name / "metadata.jsonl").write_text('{"seed": 4294967295, "sim_0": 0.5}\n')
        (root / name / "7_0.jpg").write_bytes(b"x")
    got = {r.folder: (r.original_caption, r.global_index) for r in io.read_prompt_folders(spark, str(root)).collect()}
    assert got == {"0000001": ("a", None), "0000002": ("x", 4)}
    assert {(r.folder, r.seed) for r in io.read_folder_metadata(spark, str(root)).collect()} == {("0000001", 4294967295), ("0000002", 4294967295)}
    images = io.list_image_files(spark, str(root))
    assert {(r.folder, r.seed, r.side) for r in images.collect()} == {("0000001", 7, 0), ("0000002", 7, 0)}
    scan = images._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in scan or "content" not in scan
    array = tmp_path / "p.json"
    array.write_text(json.dumps([{"original_caption": "a"}, {"caption": "b"}], indent=1))
    assert io.read_prompts_json(spark, str(array)).count() == 2
    lines = tmp_path / "p.jsonl"
    lines.write_text('{"input": "a"}\n{"input": "b"}\n')
    assert io.read_prompts_jsonl(spark, str(lines)).count() == 2


@pytest.mark.parametrize("name", ["read_folder_metadata", "read_prompt_folders", "template_table"])
def test_folders_are_written_by_more_than_one_task(spark, name):
    from compare import SF

    from pairline.plans import registry

    files = registry.queries()[name](spark, SF).inputFiles()
    assert len(files) == 10 and len({Path(f).name.split("-")[1] for f in files}) > 1


def test_folders_with_odd_names_and_other_depths(spark, tmp_path):
    root = tmp_path / "a b+(c)%20" / "{0}"
    for place in ("1", "1/2", "x=y z", "."):
        (root / place).mkdir(parents=True, exist_ok=True)
        (root / place / "prompt.json").write_text('{"original_caption": "a"}')
        (root / place / "other.json").write_text('{"original_caption": "b"}')
    root = str(root.parent / "*")  # Spark takes braces for a pattern
    read = io.read_prompt_folders(spark, root)
    assert sorted(r.original_caption for r in read.collect()) == ["a", "a"]
    assert io.read_prompt_folders(spark, root, "x=*/*.json").count() == 2


def test_tasks_are_dealt_folders_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FOLDERS", 5)
    df = spark.range(90).select((F.col("id") % 45).alias("folder"), F.col("id").cast("string").alias("value"))
    io.write_folders(df, str(tmp_path / "f"), "text")
    files = list(Path(tmp_path / "f").glob("folder=*/*.txt"))
    assert len(files) == 45 and len({f.name.split("-")[1] for f in files}) > 4
    assert sorted(int(r.value) for r in spark.read.text(str(tmp_path / "f"), recursiveFileLookup=True).collect()) == list(range(90))


def test_no_process_is_started_for_a_folder(spark, tmp_path):
    def started():
        return int(next(x for x in Path("/proc/stat").read_text().splitlines() if x.startswith("processes")).split()[1])

    df = spark.range(1500).select(F.col("id").alias("folder"), F.lit("x").alias("value"))
    before = started()
    io.write_folders(df, str(tmp_path / "f"), "text")
    assert started() - before < 1500
    assert len(list(Path(tmp_path / "f").glob("folder=*/*.txt"))) == 1500


@pytest.mark.parametrize("kind", ["text", "json"])
def test_folders_are_those_of_sparks_writer(spark, tmp_path, kind):
    keys = ["a", "", None, "x=y", "a/b", "c:d?*", "ü %41", "{q}", "[r]^", "t\tu", '"s"', "back\\slash", "end "]
    rows = [(k, f"{i}\nzwei" if i % 5 else None, 0.5 * i) for i, k in enumerate(keys * 40)]
    df = spark.createDataFrame(rows, "folder string, value string, more double")
    df = df.drop("more") if kind == "text" else df
    io.write_folders(df, str(tmp_path / "ours"), kind)
    df.repartition(1).write.partitionBy("folder").format(kind).save(str(tmp_path / "spark"))

    def content(root):
        names = {p.parent.name for p in root.glob(f"*/*.{ {'text': 'txt'}.get(kind, kind) }")}
        return {n: sorted(b"".join(p.read_bytes() for p in (root / n).glob("part-*")).splitlines()) for n in names}

    assert content(tmp_path / "ours") == content(tmp_path / "spark") and len(content(tmp_path / "ours")) == 12
    assert not [p for p in (tmp_path / "ours").rglob(".*")] and (tmp_path / "ours" / "_SUCCESS").exists()
    with pytest.raises(FileExistsError):
        io.write_folders(df, str(tmp_path / "ours"), kind)
    io.write_folders(df.limit(0), str(tmp_path / "none"), kind)
    assert io.template_table(spark, str(tmp_path / "none")).count() == 0


def test_folders_are_listed_by_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "LISTING", 7)
    for i in range(60):
        (tmp_path / "t" / str(i)).mkdir(parents=True)
        (tmp_path / "t" / str(i) / "a.txt").write_text("é\n" * (i % 3 + 1))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was, status = spark.conf.get(name), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    try:
        got = io.template_table(spark, str(tmp_path / "t"))
        jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup("listing")]
        tasks = [status.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks == [7] and spark.conf.get(name) == was
    assert {(r.name, r.text) for r in got.collect()} == {(f"{i}_a", "é\n" * (i % 3 + 1)) for i in range(60)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", one'), (2, "two\nlines")], "prompt_idx long, caption string")
    io.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "csv"), "prompt_idx long, caption string").collect())) == sorted(map(tuple, df.collect()))
    io.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    for _ in range(2):
        io.append_samples(df, str(tmp_path / "samples"))
    assert spark.read.json(str(tmp_path / "samples")).count() == 4
    io.write_splits(df.withColumn("split", F.when(F.col("prompt_idx") == 1, "train").otherwise("val")), str(tmp_path / "splits"))
    assert {p.name for p in Path(tmp_path / "splits").glob("split=*")} == {"split=train", "split=val"}
    io.export_caption_files(df.withColumn("image", F.lit(b"x")), str(tmp_path / "pairs"), "prompt_idx")
    assert [r.name for r in spark.read.parquet(str(tmp_path / "pairs")).orderBy("name").collect()] == ["image_0", "image_1"]
    assert io.read_history(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "history.json").write_text('{"id": "1", "prompt": "p"}\nbroken\n')
    assert io.read_history(spark, str(tmp_path / "history.json")).count() == 1
    (tmp_path / "rules" / "a").mkdir(parents=True)
    (tmp_path / "rules" / "a" / "b.txt").write_text("text")
    assert [tuple(r) for r in io.template_table(spark, str(tmp_path / "rules")).collect()] == [("a_b", "text")]
    spark.createDataFrame([(1, [1.0])], "img_id long, embedding array<float>").withColumn("patch_coords", F.array(F.lit(1))).write.parquet(str(tmp_path / "pool"))
    assert io.read_embedding_pool(spark, str(tmp_path / "pool")).count() == 1


def test_a_second_incremental_run_adds_nothing(spark, tmp_path):
    df, out = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "done")
    work = lambda d: d.withColumn("v", F.col("k") * 2)
    assert incremental.incremental_run(df.where("k < 6"), "k", work, out) == 6
    assert incremental.incremental_run(df, "k", work, out) == 4
    assert incremental.incremental_run(df, "k", work, out) == 0
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [2 * i for i in range(10)]
    more = df.union(spark.createDataFrame([(None,)], "k long"))
    assert [incremental.incremental_run(more, "k", work, out) for _ in range(2)] == [1, 0]


def test_incremental_stream(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        incremental.incremental_stream(spark, source, "id long", lambda d: d, out, mark)
        incremental.incremental_stream(spark, source, "id long", lambda d: d, out, mark)
    assert spark.read.parquet(out).count() == 8
