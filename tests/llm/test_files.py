"""Token files, periodic runs and the audit of filters."""

import hashlib
import zlib
from itertools import permutations

import numpy as np
import pytest
from compare import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairline.llm import entries, filter_audit, periodic_runs, token_files

ENCODER = token_files.Encoder()


def whole(texts):
    """Ids of whole texts, each with the end id."""
    return [[*e.ids, 1] for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files_hold_what_whole_texts_encode_to(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(entries.op11_token_files(spark, SF).collect())
    assert len(got) == len(docs)
    start = 0
    for d, r, ids in zip(docs, got, whole([d.text or "" for d in docs]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


PIECES = st.sampled_from(["a", "b's", "'", "s", "12", "ß", "Σ", "İ", "e", "́", "̧", "日本", "\U0001f600", " ", "\t", "\x0b", "\n\n", "\x1c", "\x85", "\xa0", " ", " ", "​", "<|endoftext|>", "<|start", "Ñu", "ÿ", "ÐÞ", "×", "÷", "µ", "\xad", "'LL", "T'", "\x00", ".", "!?"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=5))
def test_words_one_after_another_are_the_whole_text(texts):
    ids, lengths = ENCODER.encode([t.encode() for t in texts])
    assert ENCODER.by_words
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == whole(texts)


def test_other_vocabularies_encode_whole_texts_in_four_bytes(spark, tmp_path):
    encoder = token_files.Encoder("byte_bpe_50k.json", 70_000)
    assert not encoder.by_words and encoder.dtype == np.dtype("<u4")
    docs = spark.createDataFrame([(2, " two  words\n"), (1, "'s one")], "doc_id long, text string")
    folder = token_files.write_token_files(docs, f"{tmp_path}/other", vocabulary="byte_bpe_50k.json", end_id=70_000)
    got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect())
    assert [r.ids for r in got] == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 70_000] for t in ("'s one", " two  words\n")]


def test_token_files_awkward(spark, awkward, tmp_path):
    folder = token_files.write_token_files(awkward, f"{tmp_path}/tokens", part_bytes=1000)
    rows = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert len(rows) == awkward.count()
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and keys[:2] == [None, None]
    texts = awkward.withColumn("t", F.coalesce("text", F.lit(""))).groupBy("doc_id").agg(F.collect_list("t").alias("t")).collect()
    for r in texts:
        assert sorted(whole(r.t)) == sorted(x.ids for x in rows if x.doc_id == r.doc_id)
    flat = [i for r in rows for i in r.ids]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    reader = token_files.TokenReader(token_files.manifest(spark, folder).collect(), folder)
    assert len(reader.parts) > 1 and len(reader) == len(rows)
    assert all(reader[i].tolist() == r.ids for i, r in enumerate(rows))
    for start, n in ((0, 50), (3, 70_000), (len(flat) - 5, 10), (len(flat), 3)):
        assert reader.stretch(start, n).tolist() == flat[start : start + n]
    empty = token_files.write_token_files(awkward.limit(0), f"{tmp_path}/none")
    assert token_files.read_token_files(spark, empty).count() == 0
    text_keys = token_files.write_token_files(awkward.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body")), f"{tmp_path}/keys", "name", "body")
    assert dict(token_files.read_token_files(spark, text_keys, "name").dtypes)["name"] == "string"


def test_a_part_that_runs_again_has_the_same_bytes(spark, awkward, tmp_path):
    folders = [token_files.write_token_files(awkward, f"{tmp_path}/{i}", part_bytes=100_000) for i in range(2)]
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / str(i)).glob("part-*")} for i in range(2))
    assert a == b and len(a) >= 6 and len(folders) == 2
    assert not list((tmp_path / "0").glob(".[0-9]*"))


def agree(spark, duck, name):
    """The registered query's rows and its SQL's, as they are."""
    got, wanted = entries.queries()[name](spark, SF), duck.execute(entries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(wanted.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_filter_audit"])
def test_same_rows_as_sql(spark, duck, name):
    agree(spark, duck, name)


def brute_runs(words, least=24, times=3):
    """Every period, every maximal stretch; of equal stretches the smallest period."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted((a, n, p) for (a, n), p in found.items())


PATTERN = st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7), st.integers(1, 30))
REPEATED = st.lists(PATTERN, max_size=6).map(lambda parts: [w for words, n in parts for w in (words * n)[: len(words) * n - n % 3]])


@settings(max_examples=150, deadline=None)
@given(st.lists(REPEATED, max_size=4), st.sampled_from([(24, 3), (1, 2), (10, 4)]))
def test_runs_are_those_of_brute_force(texts, bounds):
    got = periodic_runs.text_runs(texts, *bounds)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(t, *bounds) for t in texts]


@settings(max_examples=100, deadline=None)
@given(REPEATED.filter(lambda x: len(x) > 1), st.data())
def test_extensions_agree_with_comparing_word_by_word(words, data):
    sequence = np.array([-1, *(b"abc".index(w) for w in words), -2])
    grammar = periodic_runs.Grammar(sequence)
    places = st.integers(1, len(words))
    i, j = data.draw(places), data.draw(places)
    if i == j:
        return
    i, j = min(i, j), max(i, j)
    on = next(k for k in range(len(sequence)) if sequence[i + k] != sequence[j + k])
    back = next(k for k in range(len(sequence)) if sequence[i - k] != sequence[j - k])
    a, b = np.array([i]), np.array([j])
    assert (grammar.extension(a, b)[0], grammar.extension(a, b, back=True)[0]) == (on, back)


def test_levels_of_a_long_repeated_text_are_few():
    words = [b"a", b"b", b"c", b"b", b"d"] * 40_000
    sequence = np.array([-1, *(b"abcd".index(w) for w in words), -2])
    assert len(periodic_runs.Grammar(sequence).symbols) < 90
    assert periodic_runs.text_runs([words])[0].tolist() == [[0, 200_000, 5]]


def test_periodic_runs_awkward(spark, awkward):
    docs = awkward.withColumn("runs", F.lit("mine")).withColumn("period", F.lit(2.5))
    extra = docs.limit(1).select(*[F.lit(v).alias(c) for c, v in zip(docs.columns, [9, "\ty " * 30 + "x y x", "a", "en", 1, 7, 0.5, 3, "mine", 2.5], strict=True)])
    docs = docs.unionByName(extra)
    rows = periodic_runs.collapse_runs(docs).collect()
    assert len(rows) == 12 and rows[0].source is not None
    for r in rows:
        if r.doc_id == 9:
            assert [tuple(x) for x in r.runs] == [(0, 30, 1)] and (r.start, r.length, r.period, r.exponent_milli) == (0, 30, 1, 30_000)
            assert r.collapsed == "y x y x" and r.runs_sha256 == hashlib.sha256(b"0,30,1\n").hexdigest()
        elif r.doc_id in (6, 7):
            assert (r.start, r.length, r.period, r.n_runs) == (0, 60_000, 977, 1)
            assert r.collapsed.split() == [f"w{i}" for i in range(977)] + ["and", "more"] * (r.doc_id == 7)
        else:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs) == (0, None, None, None, None, [])
            text = docs.where(F.col("doc_id").eqNullSafe(r.doc_id)).first().text if r.doc_id else None
            assert r.doc_id is None or r.collapsed == " ".join((text or "").encode().split() and [w.decode() for w in text.encode().split()])
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    split = periodic_runs.collapse_runs(docs.repartition(5)).select("doc_id", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(str, split)) == sorted(str(r) for r in periodic_runs.collapse_runs(docs).select("doc_id", "runs_sha256", "collapsed_sha256").collect())


def test_a_row_of_edits(spark):
    words = [b"%d" % i for i in range(50)]
    planted = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in planted:
        g = zlib.crc32(str(i).encode()) // 10
        a, p = g % 50, 1 + (50 - g % 50) // (3 + g % 8)
        assert entries._with_period(words, str(i)) == [words[k if k < a else a + (k - a) % p] for k in range(50)]
    assert planted and entries._with_period([], str(planted[0])) == [] and entries._with_period(words, None) == words


SORTED = st.lists(st.integers(0, 60), max_size=40).map(lambda x: np.array(sorted(set(x)), np.int64))


@settings(max_examples=200, deadline=None)
@given(SORTED, SORTED)
def test_merges_of_lists(a, b):
    assert filter_audit.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert filter_audit.union(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


def brute_audit(rows, names):
    """rows: (part, failed names, good). Filters applied row by row in every order."""
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations(names):
            left = [r for r in rows if r[0] == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in everyone) - len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, sum(r[1] == {f} for r in everyone), sum(r[2] for r in gone))
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_awkward(spark, awkward):
    docs = awkward.withColumns({"part": F.lit(1), "id": F.lit(0), "place": F.lit("x"), "number": F.lit(None), "digest": F.lit(2), "k_good": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (6, 0), (7, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    conditions = {"X": F.col("n_chars") > 3, "Y": F.col("lang") == "en"}
    first = {}
    for r in docs.collect():
        if r.doc_id is not None:
            first[r.text or ""] = min(r.doc_id, first.get(r.text or "", r.doc_id))
    rows = []
    for r in docs.collect():
        failed = {"X"} if (r.n_chars or 0) > 3 else set()
        failed |= {"Y"} if r.lang == "en" else set()
        failed |= {"Z"} if r.doc_id is not None and r.doc_id > first[r.text or ""] else set()
        rows.append((r.source or "", failed, r.doc_id in (1, 7)))
    wanted = brute_audit(rows, "XYZ")
    for block in (1, 3, 1 << 16):
        got = filter_audit.audit(docs, conditions, labels, {"good": F.col("quality") == 1}, repeated="Z", block=block).collect()
        assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good, r.shapley) for r in got} == wanted and len(got) == len(wanted)
    assert filter_audit.audit(docs.limit(0), conditions, labels, {}).count() == 0
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(docs, {}, labels, {})


def test_copies_of_many_texts_are_met_in_parts(spark, monkeypatch):
    from pairline.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i // 6}", f"s{i % 2}") for i in range(300)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 7)], "doc_id long, quality int")
    got = filter_audit.audit(docs, {"A": F.length("text") < 3}, labels, {"good": F.col("quality") == 1}, repeated="E", block=32).where("step = 1 and filter_order = 'EA'").collect()
    first = {}
    for i in range(300):
        first.setdefault("hot" if i % 3 else f"t{i // 6}", i)
    again = [i for i in range(300) if first["hot" if i % 3 else f"t{i // 6}"] < i]
    assert {r.part: (r.removed, r.good) for r in got} == {f"s{k}": (sum(i % 2 == k for i in again), sum(i % 2 == k and i % 7 == 0 for i in again)) for k in range(2)}
