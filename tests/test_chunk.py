import random
from hashlib import sha256

import pytest

import millrace.operators.chunk as chunk_module
from millrace.functions.hashing import chunk_fn_fingerprint
from millrace.operators.chunk import chunk, oversized_chunks
from millrace.operators.split import split_sentences
from millrace.plans.config import EngineConfig

UNITS = "unit_id string, turn int, pk string, body string, speaker string, chunk_id string"
KW = {"id_column": "unit_id", "order_column": "turn", "text_column": "body"}

CALLS = [
    ("1", 1, "call_001", "rep", 73), ("2", 2, "call_001", "customer", 70), ("3", 3, "call_001", "customer", 60), ("4", 4, "call_001", "rep", 67),
    ("5", 5, "call_001", "customer", 76), ("6", 6, "call_001", "rep", 76), ("7", 1, "call_002", "rep", 66), ("8", 2, "call_002", "customer", 68), ("9", 3, "call_002", "customer", 59), ("10", 4, "call_002", "rep", 78),
]


def units(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], UNITS)


def edges():
    sizes = [("e1", 1, "adr", 72), ("e2", 2, "adr", 68), ("e3", 3, "adr", 100), ("e4", 4, "adr", 48), ("e5", 5, "adr", 120), ("o1", 1, "over", 16), ("o2", 2, "over", 1600), ("o3", 3, "over", 16), ("i1", 1, "one", 40)]
    rows = [(u, t, p, "x" * n, "S") for u, t, p, n in sizes]
    for u, p, mid in (("n", "null_mid", None), ("m", "empty_mid", "")):
        rows += [(f"{u}1", 1, p, "j" * 40, "S"), (f"{u}2", 2, p, mid, "S"), (f"{u}3", 3, p, "k" * 40, "S")]
    return rows + [("z1", 1, "all_null", None, "S"), ("z2", 2, "all_null", None, "S")]


def shape(df):
    return sorted((r.partition_key, r.chunk_seq, ",".join(r.source_rows), r.token_estimate, r.exceeds_target, len(r.chunk_text)) for r in df.collect())


def test_soft_cap_and_edges(spark):
    assert shape(chunk(units(spark, edges()), **KW, partition_column="pk", target_tokens=40)) == [
        ("adr", 1, "e1,e2,e3", 61, True, 242),
        ("adr", 2, "e4,e5", 43, True, 169),
        ("all_null", 1, "z1,z2", 1, False, 1),
        ("empty_mid", 1, "m1,m2,m3", 21, False, 82),
        ("null_mid", 1, "n1,n2,n3", 21, False, 82),
        ("one", 1, "i1", 10, False, 40),
        ("over", 1, "o1,o2", 405, True, 1617),
        ("over", 2, "o3", 4, False, 16),
    ]


def call_units(spark):
    return units(spark, [(u, t, p, "y" * n, s) for u, t, p, s, n in CALLS])


def test_labels_and_overlap(spark):
    plain = chunk(call_units(spark), **KW, partition_column="pk", label_column="speaker", target_tokens=40)
    assert [(p, ids) for p, _, ids, *_ in shape(plain)] == [("call_001", "1,2"), ("call_001", "3,4,5"), ("call_001", "6"), ("call_002", "7,8,9"), ("call_002", "10")]
    lapped = chunk(call_units(spark), **KW, partition_column="pk", label_column="speaker", target_tokens=40, overlap_tokens=15)
    assert [(p, ids) for p, _, ids, *_ in shape(lapped)] == [
        ("call_001", "1,2"), ("call_001", "3,4"), ("call_001", "4,5"), ("call_001", "5,6"), ("call_002", "7,8,9"), ("call_002", "9,10"), ("call_002", "10"),
    ]
    labelled = chunk(units(spark, [r for r in edges() if r[2] == "null_mid"]), **KW, partition_column="pk", label_column="speaker", target_tokens=40)
    assert [len(r.chunk_text) for r in labelled.collect()] == [91]


def packed(rows, target, overlap):
    """A plain packer, one unit after another."""
    step, out, before = target - overlap, {}, 0
    for uid, _, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        k = before // step
        out.setdefault(k, []).append(uid)
        if overlap and k and before - k * step < overlap:
            out.setdefault(k - 1, []).append(uid)
        before += -(-len(text) // 4)
    return [ids for _, ids in sorted(out.items())]


@pytest.mark.parametrize(("seed", "target", "overlap"), [(1, 30, 0), (2, 30, 10), (3, 7, 3)])
def test_random_units_against_a_plain_packer(spark, seed, target, overlap):
    rng = random.Random(seed)
    rows = [(f"u{i:04d}", rng.choice([None, *range(40)]), "p" if rng.random() < 0.8 else "q", "w" * rng.choice([0, 1, 5, 40, 300]), "s") for i in range(500)]
    got = chunk(units(spark, rows), **KW, partition_column="pk", target_tokens=target, overlap_tokens=overlap)
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.partition_key, r.chunk_seq)):
        by.setdefault(r.partition_key, []).append(list(r.source_rows))
        assert r.chunk_id == f"{r.partition_key}::{r.chunk_seq}" and r.n_source_rows == len(r.source_rows)
    assert by == {p: packed([(u, t, x) for u, t, k, x, _ in rows if k == p], target, overlap) for p in "pq"}


def test_without_partition_null_partition_and_nothing(spark):
    whole = chunk(units(spark, edges()).filter("pk = 'adr'"), **KW, target_tokens=40).collect()
    assert [(r.chunk_id, r.partition_key) for r in sorted(whole, key=lambda r: r.chunk_seq)] == [("1", None), ("2", None)]
    nulls = chunk(units(spark, [("a", 1, None, "x", "s"), ("b", 1, None, "x", "s"), ("b", 1, None, "x", "s")]), **KW, partition_column="pk").collect()
    assert [list(r.source_rows) for r in nulls] == [["a", "b", "b"]] and nulls[0].chunk_id is None
    assert chunk(units(spark, edges()).limit(0), **KW, partition_column="pk").count() == 0


def test_dirty_partitions_only(spark):
    rows = edges()
    kw = {**KW, "partition_column": "pk", "target_tokens": 40}
    stored = chunk(units(spark, rows), **kw)
    edited = [(u, t, p, ("z" + x[1:]) if u == "e4" else x, s) for u, t, p, x, s in rows if p != "one"] + [("f1", 1, "fresh", "x", "s")]
    assert {r.partition_key for r in chunk(units(spark, edited), **kw, stored=stored).collect()} == {"adr", "fresh"}
    renamed = units(spark, rows).withColumnRenamed("turn", "nr")
    assert chunk(renamed, **{**kw, "order_column": "nr"}, stored=stored).select("partition_key").distinct().count() == 6
    assert oversized_chunks(stored).count() == 3


def test_bad_sizes(spark):
    for target, overlap in ((0, 0), (10, -1), (10, 10), (10, 5)):
        with pytest.raises(ValueError):
            chunk(units(spark, edges()), **KW, target_tokens=target, overlap_tokens=overlap)
    with pytest.raises(ValueError):
        chunk(units(spark, edges()), **KW, stored=units(spark, []))


def test_sentences(spark):
    docs = spark.createDataFrame([("d", "Section 3.2 is ready. Ship it."), ("e", "...Wait!? Really"), ("f", None), ("g", ""), ("h", " \n "), (None, "x.")], "sentence_id string, body string")
    rows = {(r.document_id, r.sentence_index): r.sentence_text for r in split_sentences(docs, "sentence_id", "body").collect()}
    assert rows == {("d", 1): "Section 3.", ("d", 2): "2 is ready.", ("d", 3): "Ship it.", ("e", 1): "Wait!?", ("e", 2): "Really", ("h", 1): "\n", (None, 1): "x."}


def test_partition_hashes(spark):
    rows = [("b", 2, "p", "two", "s"), ("a", 1, "p", "one", "s"), ("c", None, "p", None, "s"), ("d", 1, None, "x", "s")]
    kw = {**KW, "partition_column": "pk"}
    fp = chunk_fn_fingerprint(target_tokens=512, overlap_tokens=0, join_separator="\n", id_column="unit_id", order_column="turn", text_column="body", partition_column="pk")
    got = {r.partition_key: r.partition_hash for r in chunk(units(spark, rows), **kw).collect()}
    assert got == {"p": sha256(f"{fp}::a:one|b:two|c:".encode()).hexdigest(), None: sha256(f"{fp}::d:x".encode()).hexdigest()}
    with pytest.raises(ValueError, match="joined_max_chars"):
        chunk(units(spark, rows), **kw, joined_max_chars=5)
    with pytest.raises(ValueError):
        chunk(units(spark, rows), **kw, hashing="other")

    def tree(rows):
        return {r.partition_key: r.partition_hash for r in chunk(units(spark, rows), **kw, hashing="tree").collect()}

    base = tree(rows)
    assert base == tree(rows[::-1]) and len(base["p"]) == 64
    edits = [("b", 2, "p", "two!", "s"), ("b2", 2, "p", "two", "s"), ("b", 3, "p", "two", "s"), ("b", None, "p", "two", "s")]
    seen = {tree([edit, *rows[1:]])["p"] for edit in edits} | {tree(rows[1:])["p"], tree([rows[0], *rows])["p"], base["p"]}
    assert len(seen) == 7
    sized = chunk(units(spark, rows), **kw, config=EngineConfig(chunk_target_tokens=1)).collect()
    assert len(sized) == 4


def test_clean_partitions_are_not_packed(spark):
    kw = {**KW, "partition_column": "pk", "target_tokens": 40}
    stored = chunk(units(spark, edges()), **kw)
    again = chunk(units(spark, edges()), **kw, stored=stored)
    assert again.count() == 0
    seen = []
    ranged = chunk_module._ranged
    chunk_module._ranged = lambda u: seen.append(u.count()) or ranged(u)
    try:
        edited = [(u, t, p, ("z" + x[1:]) if u == "e4" else x, s) for u, t, p, x, s in edges()]
        assert chunk(units(spark, edited), **kw, stored=stored).count() == 2
    finally:
        chunk_module._ranged = ranged
    assert seen == [5]
