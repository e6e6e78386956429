from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.functions.text import collapse_ws, contains, estimate_tokens, norm_text, ordered_text
from millrace.functions.vectors import cosine, embedding_dimension, json_cosine, vector_literal, vector_to_json
from millrace.operators import checks
from millrace.operators.delta import delta, merge, version_guard
from millrace.operators.evaluation import evaluate, nonconforming, ungrounded
from millrace.operators.knowledge import knowledge_base
from millrace.operators.metadata import attach_metadata, dependency_violations
from millrace.operators.search import CellIndex, recall, search_all, vector_search


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


CHUNK = "chunk_id string, partition_key string, chunk_seq long, source_rows array<string>, chunk_text string, n_source_rows long, title string, exceeds_target boolean"


def chunks(spark):
    return spark.createDataFrame([("1::1", "1", 1, ["a"], "hello", 1, "own", False), ("2::1", "2", 1, ["b"], "", 1, "own", False), ("n", None, 1, ["c"], None, 1, "own", False)], CHUNK)


def test_attach_metadata(spark):
    meta = spark.createDataFrame([(1, "T", None), (1, "T", None), (None, "N", "u"), (7, "x", "y")], "doc int, title string, url string")
    out = attach_metadata(chunks(spark).drop("title"), meta, "doc", ["title", "url"], in_text=True)
    assert out.columns == ["chunk_id", "partition_key", "chunk_seq", "source_rows", "chunk_text", "n_source_rows", "token_estimate", "title", "url", "content_hash"]
    assert values(out, "chunk_id", "chunk_text", "title", "token_estimate") == [
        ("1::1", "title: T\nurl: \n---\nhello", "T", 6), ("2::1", "title: \nurl: \n---\n", None, 5), ("n", None, None, None),
    ]
    both = meta.unionByName(spark.createDataFrame([(1, "U", None)], meta.schema))
    assert attach_metadata(chunks(spark), both, "doc", ["title"]).filter("chunk_id = '1::1'").count() == 2
    assert values(dependency_violations(both, "doc", ["title", "url"])) == [(1, 2)]
    assert attach_metadata(chunks(spark), meta.limit(0), "doc", ["title"]).count() == 3
    for bad in ([], ["chunk_text"]):
        with pytest.raises(ValueError):
            attach_metadata(chunks(spark), meta.withColumn("chunk_text", F.lit("")), "doc", bad)


def test_knowledge_base(spark):
    t = spark.createDataFrame([("t1", "acme", "late", [1.0, 0.0], datetime(2024, 1, 1, 5), "u", "bug")], "id string, acc string, body string, e array<float>, at timestamp_ntz, url string, cls string")
    c = spark.createDataFrame([(7, "acme", None, None, date(2024, 2, 1)), (None, "x", "", [0.5, 0.5], None)], "id int, acc string, body string, e array<float>, at date")
    a = {"relation": t, "source_type": "ticket", "source_id": "id", "account_key": "acc", "text": "body", "embedding": "e", "timestamp": "at", "citation_url": "url", "classification": F.col("cls")}
    b = {"relation": c, "source_type": "call", "source_id": "id", "account_key": "acc", "text": "body", "embedding": "e", "timestamp": "at"}
    kb = knowledge_base([a, b])
    assert values(kb, "source_key", "ts", "citation_url", "classification") == [
        ("call::7", datetime(2024, 2, 1), None, None), ("ticket::t1", datetime(2024, 1, 1, 5), "u", "bug"), (None, None, None, None),
    ]
    keyed = kb.filter("source_key is not null")
    b = {**b, "relation": c.filter("id is not null")}
    assert knowledge_base([a, b], stored=keyed).count() == 0
    moved = {**a, "account_key": "'other'"}
    assert values(knowledge_base([moved, b], stored=keyed), "source_key") == [("ticket::t1",)]
    with pytest.raises(ValueError, match="source 2 has no 'text'"):
        knowledge_base([a, {k: v for k, v in b.items() if k != "text"}])
    with pytest.raises(TypeError):
        knowledge_base([a, {**b, "embedding": "cast(e as array<double>)"}])
    with pytest.raises(ValueError):
        knowledge_base([])


def test_delta_truth_table(spark):
    stored = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("n", None)], "k string, h string")
    batch = spark.createDataFrame([("a", "h1"), ("a", "hX"), ("a", None), ("new", "h9"), ("new", None), ("n", "h5"), ("n", None)], "k string, h string")
    assert values(delta(batch, stored, "k", "h")) == [("a", "hX"), ("n", "h5"), ("new", "h9"), ("new", None)]
    assert delta(batch, None, "k", "h").count() == 7 and delta(batch, stored.limit(0), "k", "h").count() == 7
    assert values(delta(batch, stored, "k"), "k") == [("new",), ("new",)]
    with pytest.raises(Exception, match="null key"):
        delta(spark.createDataFrame([(None, "h")], batch.schema), stored, "k", "h").collect()
    plan = delta(batch, stored, "k", "h")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert values(merge(stored, spark.createDataFrame([("b", "z"), ("c", "y")], stored.schema), "k")) == [("a", "h1"), ("b", "z"), ("c", "y"), ("n", None)]


def test_version_guard(spark):
    rows = spark.createDataFrame([("v1",), ("v1",)], "model_version string")
    assert not version_guard(rows, "v1")
    assert version_guard(rows, "v2") and version_guard(None, "v1") and version_guard(rows.limit(0), "v1")
    assert version_guard(rows.withColumnRenamed("model_version", "x"), "v1")
    assert version_guard(rows.unionByName(spark.createDataFrame([(None,)], rows.schema)), "v1")


def test_search_ties_nulls_and_filters(spark):
    rows = spark.createDataFrame([("d1", [1.0, 0.0]), ("tie_b", [0.0, 1.0]), ("tie_a", [0.0, 2.0]), ("zero", [0.0, 0.0]), ("none", None)], "id string, v array<float>")
    assert [r["id"] for r in vector_search(rows, "v", [1, 0.1], top_k=2).collect()] == ["d1", "tie_a"]
    assert [tuple(r) for r in vector_search(rows, "v", [0, 1], top_k=9, digits=6, where="id <> 'd1'").collect()][2:] == [("none", None), ("zero", None)]
    with pytest.raises(Exception, match="unequal dimension"):
        vector_search(rows, "v", [1, 0, 0]).collect()
    plan = vector_search(rows, "v", [1, 0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan


def test_search_in_blocks_and_index(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 12))
    x = [list(map(float, centers[i % 8] + 0.3 * rng.normal(size=12))) for i in range(900)]
    rows = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(x)] + [(900, None, ""), (901, [0.0] * 12, ""), (None, x[0], "")], "id int, v array<double>, query_id string")
    asked = rows.filter("id % 50 = 0")
    exact = search_all(rows, asked, "v", "id", top_k=5, block_rows=100, query_rows=7)
    m = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 900, 50) for i in np.lexsort((np.arange(900), -(m @ m[q])))[:5]}
    assert {(r.query_id, r.id) for r in exact.collect()} == want
    index = CellIndex.build(rows, "v", "id", fit_rows=400, attributes=["query_id"], name="own", part_rows=20)
    assert index.cells.count() == 901 and 1 <= index.probes < len(index.centroids) == 25 and index.parts > 1
    assert recall(index.search(asked, "v", "id", top_k=5), exact).first()["recall"] >= 0.9
    again = CellIndex(spark, index.path)
    assert (again.name, again.attributes, again.distance, again.probes) == ("own", ["query_id"], "cosine", index.probes)
    assert recall(again.search(asked, "v", "id", top_k=5, probes=25), exact).first()["recall"] == 1.0
    assert again.search(asked, "v", "id", where="query_id = 'none'").count() == 0
    dots = CellIndex.build(rows.filter("id < 900"), "v", "id", cells=2, distance="dot").search(asked, "v", "id", top_k=1, probes=2)
    x = np.array(x)
    assert {(r.query_id, r.id) for r in dots.collect()} == {(q, int(np.argmax(x @ x[q]))) for q in range(0, 900, 50)}
    assert CellIndex.build(rows.limit(0), "v", "id").search(asked, "v", "id").count() == 0
    with pytest.raises(ValueError):
        CellIndex.build(rows, "v", "id", distance="other")
    assert search_all(rows.limit(0), asked, "v", "id").count() == 0 and search_all(rows, asked.limit(0), "v", "id").count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), (None,)], "v array<float>")
    assert values(rows, embedding_dimension("v").alias("d"), F.round(json_cosine("v", vector_to_json("v")), 9).alias("c")) == [(2, 1.0), (None, None)]
    assert rows.select(cosine("v", vector_literal([0, 0]))).first()[0] is None


def test_evaluation(spark):
    labels = [("pain", "pain"), ("pain", "pain"), ("req", "req"), ("req", "req"), ("obj", "obj"), ("buy", "buy"), ("pain", "obj"), ("req", "other")]
    rows = spark.createDataFrame(labels, "p string, e string")
    got = {(r.metric, r.label): r.value for r in evaluate(rows, "p", "e").collect()}
    assert got["accuracy", "__overall__"] == 0.75 and got["precision", "obj"] == 1.0 and got["recall", "obj"] == 0.5
    assert got["precision", "other"] is None and len(got) == 11
    assert [tuple(r) for r in evaluate(rows.limit(0), "p", "e", prompt_version="v1").collect()] == [("v1", "accuracy", "__overall__", None)]
    ev = spark.createDataFrame([("The  Load\nbroke", "the load broke at night"), ("", "x"), (None, "x"), ("gone", "x"), ("a", None)], "ev string, src string")
    assert values(ungrounded(ev, "ev", "src"), "_evidence") == [("",), ("gone",), (None,)]
    assert ungrounded(ev, "ev", "src", strict=True).count() == 4 and ungrounded(ev, "ev", "src", ignore_case=False).count() == 4
    schema = '{"properties": {"kind": {"enum": ["x", "a"]}}}'
    assert values(nonconforming(ev, "src", schema)) == [("the load broke at night",), (None,)]
    assert nonconforming(ev, "src", schema, allow_null=True).count() == 1


def test_checks(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert values(checks.not_unique(rows, "k")) == [("a", 2)]
    assert checks.is_null(rows, "k").count() == 2 and values(checks.not_accepted(rows, "k", ["a"])) == [("b", 1)]
    assert values(checks.broken_relationships(rows, "k", rows.filter("k = 'a'"), "k")) == [("b",)]
    assert not checks.run_check("x", rows).passed and checks.run_check("x", rows, "warn").passed


def test_text_and_hashes(spark):
    rows = spark.createDataFrame([(2, "b", "g"), (1, "", "g"), (None, "z", "g"), (3, None, "g")], "o int, s string, g string")
    assert rows.groupBy("g").agg(ordered_text("s", "|", "o").alias("x")).first()["x"] == "|b|z"
    one = spark.createDataFrame([("  A\t\n b ", 5)], "s string, n int")
    assert one.select(collapse_ws("s"), norm_text("s"), contains("s", F.lit("A")), estimate_tokens("s")).first()[:] == ("A b", "a b", True, 2)
    plain, framed = (one.select(H.joined_hash(F.lit("a|b"), F.lit("c"), framed=f), H.joined_hash(F.lit("a"), F.lit("b|c"), framed=f)).first() for f in (False, True))
    assert plain[0] == plain[1] and framed[0] != framed[1]
    base = dict(target_tokens=1, overlap_tokens=0, join_separator="\n", id_column="i", order_column="o", text_column="t")
    seen = {H.chunk_fn_fingerprint(**{**base, **change}) for change in ({}, {"target_tokens": 2}, {"overlap_tokens": 1}, {"id_column": "j"}, {"label_column": "l"}, {"extra": "x"})}
    assert len(seen) == 6
    with pytest.raises(ValueError):
        H.embedding_fn_fingerprint(None)
