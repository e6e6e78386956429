import pytest

from millrace.llm.mixing import plan_quotas, sample_mix, source_key

DOCS = "doc long, source string, n int, w double, copies int, mix_name string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int, doc int"


def docs(spark):
    rows = [(i, ["big", "BIG ", "b_i-g"][i % 3], 10 + i % 7, 1.0 + i % 4, 0, "") for i in range(3000)]
    rows += [(10_000 + i, "small", 20, 1.0, 0, "") for i in range(20)]
    rows += [(20_000 + i, None, 50, 1.0, 0, "") for i in range(5)] + [(None, "big", 50, 1.0, 0, ""), (30_000, "big", 0, 1.0, 0, ""), (30_001, "big", None, 1.0, 0, ""), (0, "big", 10, 1.0, 0, "")]
    return spark.createDataFrame(rows, DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TARGETS)


def test_shares_repeats_and_missing_sources(spark):
    t = targets(spark, [("m", "Big", 0.5, 1), ("m", "small", 0.3, 4), ("m", "absent", 0.2, 3), (None, "big", 1.0, 1), ("m", None, 1.0, 1)])
    mixed, report = sample_mix(docs(spark), "doc", "source", "n", t)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"Big", "small", "absent"}
    assert (rep["absent"].mixed_tokens, rep["absent"].actual_share, rep["absent"].available_tokens) == (0, 0.0, 0)
    assert rep["small"].mixed_tokens == 1600 and rep["small"].most_copies == 4
    assert abs(rep["Big"].actual_share - 0.625) < 0.005 and rep["Big"].most_copies == 1
    rows = mixed.collect()
    assert len({(r.mix_name, r.doc) for r in rows}) == len(rows)
    assert sum(r.copies * r.n_tokens for r in rows) == sum(r.mixed_tokens for r in rep.values())
    again = sample_mix(docs(spark).repartition(7), "doc", "source", "n", t, buckets=8)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    assert {r.doc for r in sample_mix(docs(spark), "doc", "source", "n", t, seed=2)[0].collect()} != {r.doc for r in rows}


def test_given_total_fills_up_from_other_sources(spark):
    t = targets(spark, [("m", "big", 0.5, 2), ("m", "small", 0.5, 3)])
    _, report = sample_mix(docs(spark), "doc", "source", "n", t, total=30_000)
    rep = {r.source: r for r in report.collect()}
    assert rep["small"].mixed_tokens == 1200 and abs(rep["big"].mixed_tokens - 28_800) <= 9 and rep["big"].most_copies == 1


def test_whole_copies_are_certain(spark):
    t = targets(spark, [("m", "big", 1.0, 3)])
    mixed, report = sample_mix(docs(spark), "doc", "source", "n", t, total=60_000)
    rep = report.first()
    copies = {r.copies for r in mixed.collect()}
    assert copies == {1, 2} and mixed.count() == 3000 and abs(rep.mixed_tokens - 60_000) <= 9


def test_unequal_weights(spark):
    t = targets(spark, [("m", "big", 1.0, 2)])
    mixed, report = sample_mix(docs(spark), "doc", "source", "n", t, weight="w", total=20_000)
    assert abs(report.first().mixed_tokens - 20_000) < 60
    taken = [0.0] * 4
    for r in mixed.collect():
        taken[r.doc % 4] += r.copies
    # expected copies grow with the weight
    rates = [x / 750 for x in taken]
    assert rates[0] < rates[1] < rates[2] < rates[3] and abs(rates[3] / rates[0] - 4) < 1.2


def test_empty_tables(spark):
    t = targets(spark, [("m", "big", 1.0, 2)])
    mixed, report = sample_mix(docs(spark).limit(0), "doc", "source", "n", t)
    assert mixed.count() == 0 and report.first().actual_share == 0.0
    mixed, report = sample_mix(docs(spark), "doc", "source", "n", t.limit(0))
    assert mixed.count() == 0 and report.count() == 0


def test_quotas():
    q = plan_quotas([("m", "a", 0.5, 1, 100), ("m", "b", 0.5, 2, 10)])
    assert [x.wanted for x in q] == [20, 20]
    q = plan_quotas([("m", "a", 0.5, 1, 100), ("m", "b", 0.5, 2, 10)], 1000)
    assert [x.wanted for x in q] == [100, 20]


def test_source_key(spark):
    rows = spark.createDataFrame([("Call-Transcripts ",), ("call_transcripts",), ("call transcripts",), (" ",), (None,)], "s string")
    assert [r[0] for r in rows.select(source_key("s")).collect()] == ["calltranscripts"] * 3 + [None, None]


@pytest.mark.parametrize("copies", [1])
def test_targets_named_twice_add_up(spark, copies):
    t = targets(spark, [("m", "big", 0.2, copies), ("m", "BIG", 0.2, 2), ("m", "small", 0.6, 1)])
    rep = {r.source: r for r in sample_mix(docs(spark), "doc", "source", "n", t)[1].collect()}
    assert len(rep) == 2 and abs(rep["small"].actual_share - 0.6) < 0.02
