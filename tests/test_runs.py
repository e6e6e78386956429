import json
import warnings
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.ai.functions import AiFunctions, register_provider
from millrace.ai.gates import AiCallRefused
from millrace.ai.provider import LocalProvider
from millrace.functions import prompts as P
from millrace.functions.hashing import call_closure, logic_hash
from millrace.operators.canary import PROBES, canary_baseline, check_canary, drifted, embedding_canary, model_delta, of_other_dimension, stale_logic
from millrace.operators.cost import BatchCeilingExceeded, dev_sample, estimate_call_tokens, guard_agg_batch, guard_batch
from millrace.plans.config import EngineConfig
from millrace.plans.runlog import RunLog, never_completed
from millrace.plans.runner import Model, Runner
from millrace.plans.session import ensure_checkpoint_dir
from millrace.plans.state import StateTable
from millrace.sources.readers import csv_seed, relation
from millrace.streaming.delta_stream import merge_stream

PROMPT = "Pick a kind.\n\nText:\n{{ input }}"
SCHEMA = '{"properties": {"kind": {"type": "string", "enum": ["bug", "praise"]}, "n": {"type": ["integer", "null"]}, "odd": {"type": "boolean"}}}'
ON = EngineConfig(ai_functions_enabled="True ", model_generate="m", embedding_model="e", cost_per_1k_tokens=2.0)


def texts(spark):
    return spark.createDataFrame([("1", "a bug, 42 times?"), ("2", "much praise"), ("3", None), ("4", "")], "id string, body string")


def test_model_calls(spark):
    ai = AiFunctions(ON)
    out = texts(spark).select("id", ai.classify("body", PROMPT, SCHEMA).alias("k"), ai.extract("body", PROMPT, SCHEMA).alias("x"), ai.embed("body").alias("e"), ai.generate("body", PROMPT).alias("g"))
    rows = {r.id: r for r in out.select("*", P.field_of("x", "n", "bigint").alias("n"), P.field_of("x", "odd", "boolean").alias("odd")).collect()}
    assert (rows["1"].k, rows["2"].k, rows["3"].k) == ("bug", "praise", None)
    assert (rows["1"].n, rows["1"].odd, rows["2"].odd) == (42, True, False)
    assert len(rows["1"].e) == 64 and rows["3"].e is None and rows["2"].g == "Pick a kind. Text: much praise"

    class Plain(LocalProvider):  # local, so that it is pickled by value
        structured = False

        def complete_batch(self, prompts, model, *, schema, options):
            return [p.splitlines()[0] if "allowed values" not in p else " bug " for p in prompts]

    register_provider("plain", Plain())
    assert texts(spark).limit(1).select(AiFunctions(ON, provider="plain").classify("body", PROMPT, SCHEMA)).first()[0] == "bug"
    groups = spark.createDataFrame([("g", 2, "second"), ("g", 1, "first"), (None, 1, "alone")], "g string, o int, t string")
    assert {r.group_key: r.result for r in ai.ai_agg(groups, "g", "t", "Sum up:", order="o").collect()} == {"g": "Sum up: first second", None: "Sum up: alone"}
    with pytest.raises(BatchCeilingExceeded, match="g \\(4\\)"):
        AiFunctions(replace(ON, max_agg_group_tokens=3)).ai_agg(groups, "g", "t", "Sum up:")


def test_gates():
    for config, kw, word in (
        (EngineConfig(), {}, "off"),
        (EngineConfig(ai_functions_enabled="yes"), {}, "true or false"),
        (ON, {"materialized": "view"}, "view"),
        (ON, {"materialized": "incremental"}, "full_refresh"),
    ):
        with pytest.raises(AiCallRefused, match=word):
            AiFunctions(config, **kw)._gate("embed")
    AiFunctions(ON, materialized="incremental", full_refresh=False)._gate("embed")
    with pytest.raises(ValueError):
        EngineConfig().model_for("classify")


def test_prompts(spark):
    registry = P.PromptRegistry()
    registry.add("sort", "v1", PROMPT, SCHEMA)
    assert registry.resolve(None, None, {"ai_prompt": {"name": "sort", "version": "v1"}}) == (PROMPT, SCHEMA)
    assert registry.resolve("own", None, {"ai_prompt": {"name": "sort", "version": "v1"}}) == ("own", None)
    for call in (lambda: registry.prompt("sort", "v2"), lambda: registry.schema("other", "v1")):
        with pytest.raises(KeyError):
            call()
    row = spark.createDataFrame([("it's \\ here", None)], "a string, b string")
    assert row.select(P.render_prompt("x {{input}} y {{ input }}", "a"), P.render_prompt("x {{ input }}", "b"), P.render_prompt("const", None), P.render_prompt("", "a")).first()[:] == ("x it's \\ here y it's \\ here", None, "const", "")
    for bad in ((None, "a"), ("{{ input }}", None)):
        with pytest.raises(ValueError):
            P.render_prompt(*bad)
    assert P.augment_prompt(PROMPT, None) == PROMPT and P.augment_prompt(PROMPT, '{"properties": {"a": {}}}') == PROMPT
    assert "bug, praise" in P.augment_prompt(PROMPT, SCHEMA) and P.augment_prompt(PROMPT, SCHEMA).endswith(PROMPT)
    assert "n (integer)" in P.shape_instruction(SCHEMA, "json") and P.shape_instruction(None, "json") == ""
    assert P.schema_struct(SCHEMA).simpleString() == "struct<kind:string,n:bigint,odd:boolean>"
    assert P.schema_enum(SCHEMA) == ["bug", "praise"] and P.schema_label_field(SCHEMA) == "kind"
    assert P.generation_params() == {} and P.generation_params(5, 0)["generationConfig"] == {"maxOutputTokens": 5, "thinkingConfig": {"thinkingBudget": 0}}
    for bad in ("{}", '{"properties": {"a": {}}}'):
        with pytest.raises(ValueError):
            P.schema_enum(bad)
    bad_json = spark.createDataFrame([("{not",), ('{"n": "x"}',)], "r string")
    assert [r[0] for r in bad_json.select(P.field_of("r", "n", "int", strict=False)).collect()] == [None, None]
    with pytest.raises(Exception):
        bad_json.select(P.field_of("r", "n", "int")).collect()
    assert P.sql_literal("it's") == "'it''s'"


def test_cost_guards(spark):
    rows = texts(spark)
    assert rows.select(estimate_call_tokens("body", prompt=PROMPT, schema="{}", output_tokens=10)).first()[0] == 4 + -(-(len(PROMPT) - 11 + 2) // 4) + 10
    assert rows.select(estimate_call_tokens("body", config=EngineConfig(max_output_tokens=7))).first()[0] == 11
    assert guard_batch(rows, "body", config=EngineConfig(max_batch_rows=4, max_est_tokens=7)) == (4, 7)
    for config in (EngineConfig(max_batch_rows=3), EngineConfig(max_est_tokens=6)):
        with pytest.raises(BatchCeilingExceeded):
            guard_batch(rows, "body", config=config)
    assert guard_batch(rows, "body", where="id = '1'", config=EngineConfig(max_batch_rows=1)) == (1, 4)
    with pytest.raises(BatchCeilingExceeded, match="1 \\(4\\)"):
        guard_agg_batch(rows, "body", "id", config=EngineConfig(max_agg_group_tokens=3))
    guard_agg_batch(rows, "body", "id", config=EngineConfig(max_agg_group_tokens=4))
    assert dev_sample(rows, 2).count() == 2 and dev_sample(rows, None).count() == 4


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), "run-a")
    log.bootstrap()
    log.bootstrap()
    assert log.read().count() == 0
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        log.started("classify", "m", texts(spark), "body", node_id="n", config=ON)
    assert any("prompt" in str(w.message) for w in caught)
    log.started("embed", "m", node_id="n")
    log.completed("embed", "m", node_id="n")
    first = log.read().filter("function_name = 'classify'").first()
    assert (first.row_count, int(first.est_tokens), float(first.est_cost), first.event) == (4, 7, 0.014, "started")
    assert [r.function_name for r in never_completed(log.read()).collect()] == ["classify"]


def source(rows):
    return lambda spark: spark.createDataFrame(rows, "k string, part string, h string, body string")


def test_incremental_models(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.bootstrap()
    runner = Runner(spark, str(tmp_path / "state"), ON, log)
    ai = AiFunctions(ON, materialized="incremental", full_refresh=False)
    body = lambda rows: rows.withColumn("e", ai.embed("body")).withColumn("model_version", F.lit("v1"))
    rows = [("a", "p", "1", "x"), ("b", "p", "1", "y"), ("c", "q", "1", "z")]

    def model(rows, **kw):
        return Model("emb", source(rows), body, "incremental", "k", "h", full_refresh=False, function="embed", text="body", **kw)

    assert runner.run(model(rows)).count() == 3
    edited = [("a", "p", "2", "xx"), ("b", "p", "1", "y"), ("d", "q", "1", "w")]
    out = runner.run(model(edited))
    assert runner.ran["emb"] == 2 and {(r.k, r.h) for r in out.collect()} == {("a", "2"), ("b", "1"), ("c", "1"), ("d", "1")}
    runner.run(model(edited, pinned_version="v1"))
    assert runner.ran["emb"] == 0
    runner.run(model(edited, pinned_version="v2"))
    assert runner.ran["emb"] == 3
    runner.run(model(edited), full_refresh=True)
    assert runner.ran["emb"] == 0
    before = runner.table("emb").version()
    tight = Runner(spark, str(tmp_path / "state"), EngineConfig(ai_functions_enabled=True, embedding_model="e", max_batch_rows=0), log)
    with pytest.raises(BatchCeilingExceeded):
        tight.run(model([("z", "q", "1", "w")]))
    assert runner.table("emb").version() == before
    events = [r.event for r in log.read().collect()]
    assert events.count("started") == events.count("completed") == 5
    assert runner.teardown(["emb", "none"]) == ["emb"] and runner.table("emb").version() == before
    assert runner.table("emb").drop_old() and runner.teardown(["emb"], dry_run=False) == ["emb"] and runner.table("emb").version() is None


def test_partition_replacement_views_and_tables(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), EngineConfig())
    model = lambda rows: Model("parts", source(rows), materialized="incremental", unique_key="part", hash_column="h")
    runner.run(model([("a", "p", "1", ""), ("b", "p", "1", ""), ("c", "q", "1", "")]))
    out = runner.run(model([("a", "p", "2", "")]))
    assert {(r.k, r.h) for r in out.collect()} == {("a", "2"), ("c", "1")}
    assert runner.run(Model("t", source([("a", "p", "1", "")]))).count() == 1 and runner.run(Model("t", source([]))).count() == 0
    runner.run(Model("v", source([("a", "p", "1", "")]), materialized="view"))
    assert spark.table("v").count() == 1
    for bad in (Model("x", source([]), materialized="other"), Model("x", source([]), materialized="incremental")):
        with pytest.raises(ValueError):
            runner.run(bad)


def test_stream_merge(spark, tmp_path):
    incoming, table = str(tmp_path / "in"), StateTable(spark, str(tmp_path / "state"), "kb", "k")
    schema = "k string, h string, at int"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(schema).parquet(incoming)
        merge_stream(stream, table, "k", "h", "at", str(tmp_path / "ck")).awaitTermination()
        return {r.k: r.h for r in table.read().collect()}

    assert deliver([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)]) == {"a": "2", "b": "1"}
    version = table.version()
    assert deliver([("a", "2", 3)]) == {"a": "2", "b": "1"} and table.version() == version
    assert deliver([("b", "3", 4), ("c", "1", 4)]) == {"a": "2", "b": "3", "c": "1"}


def test_canary(spark):
    live = embedding_canary(spark, AiFunctions(ON))
    assert {r.probe_id for r in live.collect()} == set(PROBES)
    blessed = canary_baseline(live)
    assert drifted(live, blessed).count() == 0
    other = embedding_canary(spark, AiFunctions(EngineConfig(ai_functions_enabled=True, embedding_model="f")))
    assert drifted(live, canary_baseline(other)).count() == 0  # another fingerprint: not compared
    moved = blessed.withColumn("baseline_vector", F.lit(json.dumps([1.0] * 64)))
    assert drifted(live, moved).count() == 4
    assert model_delta(live, other).filter("similarity < 0.9").count() >= 3


def test_readers_and_session(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,body\n1,"a, ""b"""\n2,\n')
    rows = csv_seed(spark, str(tmp_path / "s.csv"), "id int, body string")
    assert [tuple(r) for r in rows.collect()] == [(1, 'a, "b"'), (2, None)]
    rows.write.parquet(str(tmp_path / "p"))
    rows.createOrReplaceTempView("seeded")
    assert relation(spark, str(tmp_path / "p")).count() == relation(spark, "seeded").count() == relation(spark, rows).count() == 2
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_the_whole_prompt_is_read(spark):
    ai = AiFunctions(ON)
    text = "first line\nsecond line\n" + "x " * 500 + "\nzz praise praise bug 7"
    rows = spark.createDataFrame([(text,)], "body string")
    got = rows.select(ai.generate("body", "{{ input }}").alias("g"), ai.classify("body", "{{ input }}", SCHEMA).alias("k"), ai.extract("body", "{{ input }}", SCHEMA).alias("x")).first()
    assert got.g == " ".join(text.split()) and got.k == "praise" and json.loads(got.x)["n"] == 7


def test_a_changed_row_rewrites_its_bucket_alone(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), "t", "k", buckets=8)
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, v int")
    assert table.write(rows).count() == 200
    first = table.version()
    one = spark.createDataFrame([("k7", -1)], rows.schema)
    assert table.merge(one).filter("v = -1").count() == 1 and table.read().count() == 200
    assert len(table.touched) == 1
    assert [p.name for p in (tmp_path / "t" / table.version() / "rows").glob("__part=*")] == [f"__part={table.touched[0]}"]
    assert StateTable(spark, str(tmp_path), "t", "k", buckets=2).merge(spark.createDataFrame([("new", 5)], rows.schema)).count() == 201
    assert table.drop_old() != [first] and table.read().count() == 201  # the first version still holds most buckets
    nothing = table.version()
    assert table.merge(one.limit(0)).count() == 201 and table.version() == nothing
    plain = StateTable(spark, str(tmp_path), "p")
    assert plain.read() is None and plain.write(rows.limit(0)).count() == 0 and plain.merge(rows).count() == 200 and plain.drop_old()


def test_settings_are_used(spark, tmp_path):
    config = replace(ON, run_log_path=str(tmp_path / "log"), ai_sample_rows=2, embedding_model="e")
    registry = P.PromptRegistry()
    registry.add("sort", "v1", PROMPT, SCHEMA)
    runner = Runner(spark, str(tmp_path / "state"), config, prompts=registry, keep_old=False)
    rows = [(k, "p", "1", "a bug") for k in "abcd"]
    kinds = lambda batch, prompt, schema: batch.select("k", AiFunctions(ON).classify("body", prompt, schema).alias("kind"))
    model = Model("kinds", source(rows), kinds, function="classify", text="body", meta={"ai_prompt": {"name": "sort", "version": "v1"}})
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always", UserWarning)
        assert [r.kind for r in runner.run(model).collect()] == ["bug", "bug"] and runner.ran["kinds"] == 2
    assert not any("prompt" in str(w.message) for w in caught)
    started = runner.log.read().filter("event = 'started'").first()
    assert (started.row_count, int(started.est_tokens)) == (2, 2 * (2 + -(-(len(PROMPT) - 11 + len(SCHEMA)) // 4)))
    assert abs(started.run_at - datetime.now(UTC).replace(tzinfo=None)) < timedelta(minutes=5)
    with pytest.raises(ValueError, match="no prompts"):
        Runner(spark, str(tmp_path / "other"), config).run(model)
    runner.run(model)
    assert len(list((tmp_path / "state" / "kinds").glob("v-*"))) == 1
    grouped = Model("agg", source(rows), lambda b: b, function="ai_agg", text="body", group_by="part", call={"prompt": "x"})
    with pytest.raises(BatchCeilingExceeded, match="p"):
        Runner(spark, str(tmp_path / "state"), replace(config, max_agg_group_tokens=3)).run(grouped)
    embed = Model("emb", source(rows), lambda b: b, "incremental", "k", "h", full_refresh=True, function="embed", text="body")
    runner.run(embed)
    with pytest.raises(AiCallRefused, match="allow_full_reembed"):
        runner.run(embed)
    Runner(spark, str(tmp_path / "state"), replace(config, allow_full_reembed=True)).run(embed)


def test_canary_settings_and_logic_hash(spark):
    ai = AiFunctions(replace(ON, embedding_canary_vector_dimension=64))
    live = embedding_canary(spark, ai)
    blessed = canary_baseline(live)
    assert [(c.name, c.failures, c.passed) for c in check_canary(live, blessed, ai)] == [("canary_drift", 0, True), ("canary_dimension", 0, True), ("canary_logic_hash", 0, True)]
    strict = AiFunctions(replace(ON, embedding_canary_severity="error"))
    moved = blessed.withColumn("baseline_vector", F.lit(json.dumps([1.0] * 64)))
    assert [c.passed for c in check_canary(live, moved, strict)] == [False, False, True]
    assert of_other_dimension(live, config=ON).count() == 4 and of_other_dimension(live, config=replace(ON, embedding_canary_vector_dimension=None)).count() == 0
    assert drifted(live, moved, config=replace(ON, embedding_canary_similarity_threshold=-1.0)).count() == 0
    odd = live.withColumn("embedding_logic_hash", F.when(F.col("probe_id") == "brief", None).when(F.col("probe_id") == "letters", "AB").otherwise(F.col("embedding_logic_hash")))
    assert {r.probe_id for r in stale_logic(odd, ai).collect()} == {"brief", "letters"}
    names = {f.__qualname__ for f in call_closure(AiFunctions.embed)}
    assert {"AiFunctions.embed", "AiFunctions._gate", "require_enabled", "ship"} <= names
    assert logic_hash(AiFunctions.embed) != logic_hash(AiFunctions.ai_agg) and len(logic_hash(AiFunctions.embed)) == 64
