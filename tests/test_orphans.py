import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.orphans import find_orphans, plain_key

REF = "k string, t timestamp_ntz, valid_from string"
TGT = "k string, f timestamp_ntz, u timestamp_ntz, t int"
DAY = datetime(2024, 3, 1)


def run(spark, refs, targets, **kw):
    r = spark.createDataFrame([(k, t, "x") for k, t in refs], REF)
    s = spark.createDataFrame([(*x, 0) for x in targets], TGT)
    out = find_orphans(r, s, ["k"], ref_time="t", valid_from="f", valid_to="u", **kw)
    assert out.columns == ["k", "ref_month"]
    return sorted((tuple(x) for x in out.collect()), key=str)


def test_spans_decide_by_time(spark):
    d = [DAY + timedelta(days=n) for n in range(80)]
    refs = [("a", d[0]), ("a", d[10]), ("a", d[20]), ("a", d[40]), ("b", d[5]), ("b", d[5]), (None, d[1])]
    targets = [("a", d[10], d[20]), ("a", d[30], None), ("c", d[0], None)]
    # at a span's begin it is valid, at its end no longer; b never existed; null is no reference
    assert run(spark, refs, targets) == [("a", "2024-03"), ("b", "2024-03")]
    assert run(spark, [("a", d[10]), ("a", d[19]), ("a", d[30])], targets) == []


def test_null_bounds_empty_spans_and_missing_times(spark):
    d = [DAY + timedelta(days=n) for n in range(9)]
    assert run(spark, [("a", d[0])], [("a", None, None)]) == []
    assert run(spark, [("a", d[5])], [("a", d[6], d[2])]) == [("a", "2024-03")]
    assert run(spark, [("a", None), ("b", None)], [("a", d[0], d[1])]) == [("b", None)]
    assert run(spark, [], [("a", d[0], None)]) == []
    assert run(spark, [("a", d[0])], []) == [("a", "2024-03")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.4 else rng.choice("abcdefgh")
    at = lambda: DAY + timedelta(hours=rng.randint(0, 24 * 70))
    refs = [(key(), at()) for _ in range(600)]
    targets = []
    for _ in range(120):
        f = at()
        targets.append((key(), f, None if rng.random() < 0.1 else f + timedelta(hours=rng.randint(0, 60))))
    want = {(k, t.strftime("%Y-%m")) for k, t in refs if not any(k == x and f <= t and (u is None or t < u) for x, f, u in targets)}
    assert run(spark, refs, targets) == sorted(want)


def test_match_semantics_of_partly_null_keys(spark):
    r = spark.createDataFrame([("p", "1", DAY), (None, "1", DAY), (None, "9", DAY), ("p", None, DAY), (None, None, DAY)], "a string, b string, t timestamp_ntz")
    s = spark.createDataFrame([("p", "1", DAY, None)], "a string, b string, f timestamp_ntz, u timestamp_ntz")

    def found(**kw):
        return {tuple(x)[:2] for x in find_orphans(r, s, ["a", "b"], ref_time="t", valid_from="f", valid_to="u", **kw).collect()}

    assert found(match="simple") == set()
    assert found(match="full") == {(None, "1"), (None, "9"), ("p", None)}
    assert found(match="partial") == {(None, "9")}
    assert found(match="partial", required=["b"]) == {(None, "9")}
    with pytest.raises(ValueError):
        found(match="loose")


def test_plain_key(spark):
    rows = spark.createDataFrame([(" A b\t",), (" 　",), (None,), ("",)], "k string")
    assert [r[0] for r in rows.select(plain_key("k")).collect()] == ["ab", None, None, None]
    assert rows.select(plain_key(F.col("k"))).count() == 4
