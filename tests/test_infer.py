"""Model maps: batches by length, stage profiles."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from pairline.operators import infer


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text("ab", max_size=9)), max_size=6), max_size=6), st.integers(1, 12))
def test_batches_by_length_keep_all_rows_in_order(parts, most):
    frames = [pd.DataFrame({"t": pd.Series(p, dtype=object), "n": range(len(p))}) for p in parts]
    out = list(infer.by_length(iter(frames), "t", most))
    assert [(t, n) for b in out for t, n in zip(b["t"], b["n"], strict=True)] == [(t, n) for f in frames for t, n in zip(f["t"], f["n"], strict=True)]
    sizes = [[len(t or "") for t in b["t"]] for b in out]
    assert all(sizes) and all(sum(s) <= most or len([x for x in s if x]) == 1 for s in sizes)
    for a, b in zip(sizes, sizes[1:], strict=False):  # no batch ends early
        assert sum(a) + b[0] > most


@pytest.mark.parametrize("rows", ["1", "7", "10000"])
@pytest.mark.parametrize("most", [1, 30, 10**6])
def test_results_are_equal_for_all_cuts(spark, rows, most):
    df = spark.range(60).select("id", F.repeat(F.lit("x"), (F.col("id") % 13).cast("int")).alias("t"))

    def init():
        return lambda batch: pd.DataFrame({"id": batch["id"], "n": batch["t"].str.len()})

    def retry():
        return lambda batch, attempt: batch[["id"]].assign(ok=batch["id"] % 3 < attempt)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = infer.batch_infer(df, init, "id long, n long", length_of="t", most=most).collect()
        tried = infer.infer_with_retry(df, retry, lambda out: out["ok"].map({True: "", False: "no"}), "id long, ok boolean", length_of="t", most=most).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.id, r.n) for r in got) == [(i, i % 13) for i in range(60)]
    assert sorted((r.id, r.attempt, r.reason) for r in tried) == [(i, i % 3 + 1, "") for i in range(60)]


def test_the_profile_is_the_stage_s_own(spark):
    gpu = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", 1)).build
    df = spark.range(5).withColumn("t", F.lit("x"))
    plans = [
        infer.batch_infer(df, lambda: lambda b: b, "id long, t string", profile=gpu),
        infer.infer_with_retry(df, lambda: lambda b, n: b, lambda out: out["t"], "id long, t string", profile=gpu),
    ]
    for plan in plans:
        node = plan.select("id")._jdf.queryExecution().analyzed().children().head()
        assert "gpu" in node.profile().get().toString() and "amount: 1.0" in node.profile().get().toString()
    assert not infer.batch_infer(df, lambda: lambda b: b, "id long, t string")._jdf.queryExecution().analyzed().profile().isDefined()
