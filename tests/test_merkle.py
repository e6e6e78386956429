import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.merkle import MerkleStore, build_tree, changed_leaves, changed_records, latest, saved_state, succeeded_runs, with_leaf

SCHEMA = "model_name string, record_key string, state_hash string, leaf int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def changed(spark, now, then, depth=2):
    out = changed_records(frame(spark, now), frame(spark, then), depth=depth)
    return sorted((r[0], r[1]) for r in out.collect())


def test_every_case_of_nulls(spark):
    now = [("m", "same", "H1"), ("m", "edit", "h9"), ("m", "frozen", None), ("m", "new", "h2"), ("m", "newnull", None), ("m", "nullstored", "h5"), ("m", "bothnull", None), ("m", None, "h1"), ("n", "same", "h1")]
    then = [("m", "same", "h1"), ("m", "edit", "h3"), ("m", "frozen", "h4"), ("m", "nullstored", None), ("m", "bothnull", None), ("m", "gone", "h7")]
    want = [("m", "edit"), ("m", "new"), ("m", "newnull"), ("m", "nullstored"), ("n", "same")]
    assert changed(spark, now, then) == want


def test_empty_inputs(spark):
    assert changed(spark, [], [("m", "a", "h")]) == []
    assert changed(spark, [("m", "a", "h")], []) == [("m", "a")]
    assert changed(spark, [], []) == []


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_against_brute_force_at_every_depth(spark, depth):
    rng = random.Random(5)
    then = {f"k{i}": f"h{rng.randint(0, 3)}" for i in range(400)}
    now = {k: (f"h{rng.randint(4, 9)}" if rng.random() < 0.05 else h) for k, h in then.items() if rng.random() < 0.9} | {f"x{i}": "h" for i in range(5)}
    want = sorted(("m", k) for k, h in now.items() if then.get(k) != h)
    got = changed(spark, [("m", k, h) for k, h in now.items()], [("m", k, h) for k, h in then.items()], depth=depth)
    assert got == want


def test_only_leaves_that_differ_are_descended(spark):
    rows = [("m", f"k{i}", "h") for i in range(300)]
    edited = [("m", k, "z" if k == "k7" else h) for _, k, h in rows]
    trees = [build_tree(with_leaf(frame(spark, r), 2), 2) for r in (rows, edited)]
    assert changed_leaves(*trees, 2).count() == 1
    assert changed_leaves(trees[0], trees[0], 2).count() == 0
    assert trees[0].filter("level = 0").first()["n"] == 300


def test_the_plan_grows_by_a_join_a_level(spark):
    def exchanges(depth):
        trees = [build_tree(with_leaf(frame(spark, [("m", "a", h)]), depth), depth) for h in "xy"]
        return changed_leaves(*trees, depth)._jdf.queryExecution().executedPlan().toString().count("Exchange")

    few, more, most = exchanges(2), exchanges(4), exchanges(8)
    assert (more - few) * 2 == most - more and most <= 8 * 3


def test_a_failed_run_skips_and_repeats_nothing(spark, tmp_path):
    store = MerkleStore(spark, str(tmp_path / "state"))
    first = frame(spark, [("m", "a", "h1"), ("m", "b", "h1")])
    assert store.read("output") is None
    assert sorted(r[1] for r in store.run(first).collect()) == ["a", "b"]
    second = frame(spark, [("m", "a", "h2"), ("m", "b", None), ("m", "c", "h1")])

    def broken(changed):
        return changed.withColumn("state_hash", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        store.run(second, process=broken)
    assert sorted(r[1] for r in store.read("output").collect()) == ["a", "b"]
    assert sorted(r[1] for r in store.run(second).collect()) == ["a", "c"]
    assert store.run(second).count() == 0
    assert {r["record_key"]: r["state_hash"] for r in store.read("records").collect()} == {"a": "h2", "b": "h1", "c": "h1"}
    assert store.read("tree").filter("level = 0").first()["n"] == 3


def test_state_of_successful_runs(spark):
    log = spark.createDataFrame(
        [("r1", "m", 1, "started "), ("r1", "m", 2, "COMPLETED"), ("r2", "m", 1, "completed"), ("r2", "m", 3, "failed"), ("r3", "m", 1, "failed"), ("r3", "m", 2, " completed")],
        "invocation_id string, model_name string, run_at int, event string",
    )
    assert sorted(r[0] for r in succeeded_runs(log).collect()) == ["r1", "r3"]
    state = spark.createDataFrame(
        [("m", "a", "H1", "r1", 1), ("m", "a", "h2", "r2", 5), ("m", "a", None, "r3", 4), ("m", "b", "h", "unknown", 9), ("m", None, "h", "r1", 1)],
        "model_name string, record_key string, state_hash string, invocation_id string, recorded_at int",
    )
    assert [tuple(r) for r in saved_state(state, log).collect()] == [("m", "a", None)]
    ties = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "z", None)], "k string, v string, at int")
    assert [tuple(r) for r in latest(ties, ["k"], "v", "at").collect()] == [("a", "y")]


def test_a_run_reads_and_writes_the_changed_folders_alone(spark, tmp_path):
    root = tmp_path / "state"
    rows = [("m", f"k{i}", "h") for i in range(400)]
    store = MerkleStore(spark, str(root), depth=3, digits=1)
    assert store.run(frame(spark, rows)).count() == 400 and store.folders_read == []
    edited = [("m", k, "z" if k == "k7" else h) for _, k, h in rows]
    again = MerkleStore(spark, str(root))
    assert (again.depth, again.digits) == (3, 1)
    assert [tuple(r) for r in again.run(frame(spark, edited)).collect()] == [("m", "k7", "z")]
    assert len(again.folders_read) == 1
    version = (root / "CURRENT").read_text()
    assert [f.name for f in (root / version / "rows").glob("__part=*")] == [f"__part={again.folders_read[0]}"]
    state = {r["record_key"]: r["state_hash"] for r in again.read("records").collect()}
    assert state == {k: h for _, k, h in edited}
    whole = build_tree(with_leaf(frame(spark, edited), 3), 3)
    assert changed_leaves(whole, again.read("tree"), 3).count() == 0
    assert again.run(frame(spark, edited)).count() == 0 and again.folders_read == []
    again.drop_old()
    assert {r["record_key"]: r["state_hash"] for r in again.read("records").collect()} == state
    assert again.run(frame(spark, rows)).count() == 1


@pytest.mark.parametrize("step", ["_write_records", "_write_tree", "pointer"])
def test_a_crash_at_any_step_publishes_nothing(spark, tmp_path, monkeypatch, step):
    store = MerkleStore(spark, str(tmp_path / "state"), depth=2, digits=1)
    store.run(frame(spark, [("m", "a", "h1"), ("m", "b", "h1")]))
    later = frame(spark, [("m", "a", "h2"), ("m", "b", "h1"), ("m", "c", None)])

    def stop(*_):
        raise RuntimeError("stop")

    with monkeypatch.context() as broken:
        broken.setattr(store._versions.pointer if step == "pointer" else store, "set" if step == "pointer" else step, stop)
        with pytest.raises(RuntimeError):
            store.run(later)
    assert store.read("records").count() == 2
    assert sorted(r[1] for r in store.run(later).collect()) == ["a", "c"]
    assert store.run(later).count() == 0
    assert store.drop_old()


def test_a_source_that_moves_is_read_once(spark, tmp_path):
    folder = str(tmp_path / "source")
    frame(spark, [("m", "a", "h1")]).write.parquet(folder)

    def arrives(changed):
        frame(spark, [("m", "late", "h1")]).write.mode("append").parquet(folder)
        return changed

    store = MerkleStore(spark, str(tmp_path / "state"), depth=2, digits=1)
    assert [r[1] for r in store.run(spark.read.parquet(folder), process=arrives).collect()] == ["a"]
    assert [r[1] for r in store.run(spark.read.parquet(folder)).collect()] == ["late"]


def test_empty_runs(spark, tmp_path):
    store = MerkleStore(spark, str(tmp_path / "state"), depth=2, digits=1)
    assert store.run(frame(spark, [])).count() == 0
    assert store.read("records").count() == 0
    assert store.run(frame(spark, [("m", "a", None), ("m", None, "h")])).count() == 1
    assert store.run(frame(spark, [])).count() == 0 and store.read("records").count() == 1
