import random

import pytest

from millrace.llm.pieces import boundaries, piece_spans, split_oversized
from millrace.llm.sentences import train

SCHEMA = "src string, id string, body string, item string, piece_no int"
LIMIT, OVERLAP = 200, 24


def pieces(spark, texts, **kw):
    rows = spark.createDataFrame([("s", str(n), t, "clash", 0) for n, t in enumerate(texts)], SCHEMA)
    out = split_oversized(rows, ["src", "id"], "body", limit_tokens=LIMIT // 4, overlap_tokens=OVERLAP // 4, **kw)
    by = {}
    for r in sorted(out.collect(), key=lambda r: (r.id, r.piece_no)):
        by.setdefault(int(r.id), []).append(r)
    return by


def greedy(text):
    """The same cuts, one after another."""
    at, kinds = boundaries(text, LIMIT, OVERLAP)
    kind, size, out, j = dict(zip(at, kinds)), len(text), [], 0
    while j < size:
        def start_of():
            if j == 0:
                return 0
            back = [p for p in at if j - OVERLAP <= p < j]
            for least in (3, 2):
                some = [p for p in back if kind[p] >= least and p > 0 or p == 0]
                if some:
                    return min(some)
            return max(0, j - OVERLAP) if kind[j] == 1 else j

        def natural(s):
            if size - s <= LIMIT:
                return size
            reach = [p for p in at if j < p <= s + LIMIT]
            for least in (5, 4, 3, 2):
                some = [p for p in reach if kind[p] >= least]
                if some and max(some) - s >= LIMIT // 2:
                    return max(some)
            some = [p for p in reach if kind[p] >= 2]
            return max(some) if some else None

        s = start_of()
        e = natural(s)
        if e is None and (e := natural(j)) is not None:
            s = j
        if e is None:
            if kind[j] != 1 or s == j:
                s = j
            e = max(p for p in at if j < p <= s + LIMIT)
        out.append((s, e))
        j = e
    return out


def random_text(rng):
    parts = []
    for _ in range(rng.randint(5, 60)):
        x = rng.random()
        word = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
        parts.append(word + (". " if x < 0.1 else "\n" if x < 0.15 else "\n\n" if x < 0.2 else "。" if x < 0.3 else " "))
        if rng.random() < 0.04:
            parts.append("z" * rng.choice([150, 190, 201, 230, 700]))
        if rng.random() < 0.02:
            parts.append(" " * rng.choice([15, 40, 300]))
        if rng.random() < 0.02:
            parts.append("!" * rng.choice([9, 250, 700]))
    return "".join(parts)


def test_random_texts_against_one_cut_after_another(spark):
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(200)]
    by = pieces(spark, texts)
    assert set(by) == {n for n, t in enumerate(texts) if len(t) > LIMIT}
    for n, rows in by.items():
        text = texts[n]
        assert [(r.start_pos, r.end_pos) for r in rows] == greedy(text)
        assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
        assert rows[0].start_pos == 0 and rows[-1].end_pos == len(text)
        for r in rows:
            assert r.piece_text == text[r.start_pos : r.end_pos] and 0 < len(r.piece_text) <= LIMIT
        for a, b in zip(rows, rows[1:]):
            assert a.start_pos < b.start_pos <= a.end_pos < b.end_pos and a.end_pos - b.start_pos <= OVERLAP


def test_kinds_of_cuts(spark):
    by = pieces(spark, ["word " * 100, "A sentence of words. " * 30, ("A line.\n" * 12 + "\n") * 5, "q" * 500, "字" * 150 + "。" + "字" * 150, "x" * 200, "y" * 201])
    kinds = {n: {r.cut_kind for r in rows} for n, rows in by.items()}
    assert kinds == {0: {"word", "end"}, 1: {"sentence", "end"}, 2: {"paragraph", "end"}, 3: {"forced", "end"}, 4: {"sentence", "end"}, 6: {"forced", "end"}}
    assert 5 not in by


def test_nulls_repeats_and_long_texts(spark):
    rows = spark.createDataFrame([(None, "w " * 150), (None, "w " * 150), ("a", None), ("b", ""), ("c", "short"), ("d", "one. " * 40_000), ("d", "two. " * 50)], "id string, body string")
    out = split_oversized(rows, ["id"], "body", limit_tokens=50, overlap_tokens=6, texts=False)
    n = {r["id"]: r["count"] for r in out.groupBy("id").count().collect()}
    assert set(n) == {None, "d"} and n[None] % 2 == 0 and n["d"] > 1000
    assert split_oversized(rows.limit(0), ["id"], "body").count() == 0
    with pytest.raises(ValueError):
        split_oversized(rows, ["id"], "body", limit_tokens=10, overlap_tokens=5)


def test_cuts_of_mixed_kinds_reach_the_end(spark):
    # A paragraph, a line and a sentence cut in turn, each just half full: 132 pieces in 3,112 characters.
    chars = list("x " * 1556)
    for at in range(32, len(chars), 70):
        for end, mark in ((at, "\n\n"), (at + 18, "x\n"), (at + 36, ". ")):
            if end <= len(chars):
                chars[end - 2 : end] = mark
    text = "".join(chars)
    spans = piece_spans(spark.createDataFrame([("a", text)], "item string, t string"), "t", limit=64, overlap=14).orderBy("piece_no").collect()
    assert len(spans) > 128 and spans[0].start_pos == 0 and spans[-1].end_pos == len(text)
    assert all(b.start_pos <= a.end_pos < b.end_pos for a, b in zip(spans, spans[1:]))


def test_sentences_of_the_model(spark):
    text = " ".join(f"Dr. Arden paid Mr. Foley {n} coins." for n in range(40))
    rows = spark.createDataFrame([("a", text)], "id string, body string")

    def ends(**kw):
        pieces = split_oversized(rows, ["id"], "body", limit_tokens=20, overlap_tokens=4, **kw)
        return [r.piece_text.strip()[-4:] for r in pieces.collect() if r.cut_kind == "sentence"]

    assert any(e.endswith(("Dr.", "Mr.")) for e in ends())
    told = ends(model=train())
    assert told and all(e.endswith("ns.") for e in told)
