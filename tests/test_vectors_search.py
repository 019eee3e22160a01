from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vector
from millrace.operators import metrics, search

DOCS = "id long, embedding array<float>, content string, cosine_similarity string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, [1.0, 0.0], "one", "x"), (2, [1.0, 0.0], "", "x"), (3, [2.0, 0.0], "three", "x"), (4, [0.6, 0.8], "four", "x"), (5, [0.0, 0.0], "zero", "x"),
        (6, None, "null", "x"), (7, [], "empty", "x"), (8, [1.0], "narrow", "x"), (9, [math.nan, 1.0], "nan", "x"), (10, [-1.0, 0.0], None, "x"), (11, [1.0, None], "hole", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_top_k_orders_ties_by_id_and_leaves_unusable_vectors_out(docs):
    hits = [(r.id, r.cosine_similarity) for r in search.top_k(docs, [1.0, 0.0], k=2).collect()]
    assert hits == [(3, 1.0), (2, 1.0)]
    assert {r.id for r in search.top_k(docs, [1.0, 0.0], threshold=-1.0).collect()} == {1, 2, 3, 4, 10}


def test_threshold_zero_is_a_threshold(docs):
    assert {r.id for r in search.top_k(docs, [1.0, 0.0], threshold=0.0).collect()} == {1, 2, 3, 4}


def test_nan_is_never_at_least(spark):
    rows = spark.createDataFrame([(math.nan,), (None,), (0.5,)], "s double")
    assert rows.where(vector.at_least(F.col("s"), 0.3)).count() == 1


def test_plan_keeps_k_rows_per_task(docs):
    plan = search.top_k(docs, [1.0, 0.0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_contents_context_and_prompt(docs):
    ranked = search.with_contents(search.top_k(docs, [1.0, 0.0], threshold=-1.0), docs)
    assert [(r.rank, r.id) for r in ranked.orderBy("rank").collect()] == [(1, 3), (2, 1), (3, 4)]  # empty and null contents drop out
    text = search.context(ranked).first().context
    assert text == "[Doc 1] (CosSim: 1.0000)\nthree\n[Doc 2] (CosSim: 1.0000)\none\n[Doc 3] (CosSim: 0.6000)\nfour"
    assert search.prompt("why?", search.context(ranked)).first().prompt.endswith(text + "\n")


def test_batch_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8)).astype("f4")
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(5)
    got = search.batch_top_k(rows, rows.where("id % 50 = 0 or id = 3").select(F.col("id").alias("query_id"), "embedding"), 4, 8).collect()
    u = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    for q in {r.query_id for r in got}:
        order = [i for i in np.lexsort((np.arange(300), -c[q])) if i != q][:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == order


def test_empty_tables(docs):
    none = docs.where("false")
    assert search.top_k(none, [1.0, 0.0]).count() == 0
    assert search.batch_top_k(none, none.select(F.col("id").alias("query_id"), "embedding"), 3, 2).count() == 0
    assert search.distinct_vectors(none).count() == 0
    assert metrics.embedding_metrics(none).first().vectors == 0


def test_distinct_vectors(spark):
    rows = spark.createDataFrame([(3, [0.1, 0.2]), (1, [0.10001, 0.2]), (2, [0.3, 0.2]), (4, None), (5, [math.nan, 0.0])], "id long, embedding array<float>")
    assert {(r.id, r.copies) for r in search.distinct_vectors(rows).collect()} == {(1, 2), (2, 1)}


def test_states_and_metrics(docs):
    states = {r.state: r.n for r in metrics.embedding_states(docs, 2).collect()}
    assert states == {"null": 1, "empty": 1, "width": 1, "nan": 2, "zero": 1, "ok": 5}
    assert metrics.embedding_metrics(docs).first().zero_vectors == 2  # all zero, and empty


@pytest.mark.parametrize("text,want", [("[1, 2.5,-3e1]", [1.0, 2.5, -30.0]), ("[1,x]", None), ("1,2", None), ("[]", None), (None, None), ("[1,,2]", None), (" [1] ", [1.0])])
def test_parsed(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(vector.parsed(F.col("t")).alias("v")).first().v == want


def test_answers_come_from_the_model_or_are_null(spark):
    def model(prompt):
        if "fail" in prompt:
            raise ValueError("no")
        return prompt.upper()

    rows = spark.createDataFrame([("a",), ("fail",), (None,)], "prompt string")
    assert {(r.prompt, r.answer) for r in search.answered(rows, model).collect()} == {("a", "A"), ("fail", None), (None, None)}
