import random
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import quality as Q
from millrace.llm import quality_counts as C
from millrace.llm.quality_learn import written
from millrace.llm.quality_rules import RULES
from millrace.llm.quality_seeds import labelled


@pytest.fixture(scope="module")
def rules(spark):
    return Q.rule_lists()


PROSE = "The river was high after the storm, so nobody could cross it. We waited at the old mill until the rain stopped. Then the boat came back for us."
TABLE = "| name | size | price |\n|---|---|---|\n| lamp | 4 | 3.5 |\n| boat | 12 | n/a |\n| map | 7 | 1.0 |\n| rope | 3 | 2.2 |"
LIST = "- garden gate\n- old bridge\n- market day (4)\n- lamp oil\n- winter coat\n- train ticket\n- tea: green"
JUNK = "qwzrt plkmn xcvbb dfghjk wrtzpl mnbvcx ghjklq trzwpm bvcxys kljhgf wrtpzx mnbklq dfghtr wqxzpl"


def judged(texts, rules):
    """The kinds of single blocks."""
    owner, counts = C.count_blocks(texts)
    assert list(owner) == list(range(len(texts)))
    return Q.apply_lists(rules, np.column_stack([C.figure(counts, f) for f in Q.FEATURES]))


def test_held_out_accuracy(rules):
    x, y = Q.table_of(labelled(3000, 4242))
    got = Q.apply_lists(rules, x)
    right = {k: float((got[y == k] == k).mean()) for k in ("prose", *Q.KINDS)}
    assert all(v > 0.93 for v in right.values()), right


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("junk", "import os\n\ndef main(a, b):\n    for x in a:\n        print(x, b)\n    return os.path.join(a, b)\n\nif __name__ == '__main__':\n    main([1], 2)".replace("\n\n", "\n")),
        ("junk", '#include <stdio.h>\nint main(void) {\n    int i;\n    for (i = 0; i < 10; i++) {\n        printf("%d\\n", i);\n    }\n    return 0;\n}'),
        ("table", "\\begin{tabular}{lrr}\nName & Age & City \\\\\n\\hline\nAnna & 12 & Rome \\\\\nBob & 14 & Paris \\\\\nCara & 16 & Oslo \\\\\n\\end{tabular}"),
        ("junk", 'version: 2\nservices:\n  web:\n    image: nginx:latest\n    ports:\n      - "80:80"\n    environment:\n      DEBUG: "true"\n  db:\n    image: postgres'),
        ("prose", "Сегодня утром мы вышли из дома и долго шли вдоль реки. Вода была холодной, но солнце уже грело. Никто не хотел возвращаться."),
        ("prose", "Wczoraj wieczorem poszliśmy nad rzekę. Woda była zimna, ale nikt nie chciał wracać do domu."),
        ("prose", "אתמול בערב הלכנו אל הנהר. המים היו קרים, אבל אף אחד לא רצה לחזור הביתה."),
        ("prose", "The woods are lovely, dark and deep,\nBut I have promises to keep,\nAnd miles to go before I sleep,\nAnd miles to go before I sleep."),
        ("list", "Apples\nPears\nPlums\nCherries\nGrapes\nFigs\nDates"),
        ("table", "id,name,price\n1,chair,20.5\n2,table,80\n3,lamp,12\n4,rug,44"),
        ("junk", '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326\n127.0.0.1 - - [10/Oct/2000:13:55:39 -0700] "GET /x.gif HTTP/1.0" 404 12'),
        ("prose", "昨天晚上我们沿着河边散步。水很冷，但是没有人想回家。月亮升起来的时候，孩子们已经睡着了。"),
        ("prose", "ok so i went to the shop yesterday and they had no bread left\nlike none at all\nso i got some rice instead\nanyway how are you doing today"),
        ("junk", ".nav { margin: 0; padding: 4px; }\n.nav li { display: inline; }\n#top a:hover { color: #fff; }"),
        ("junk", "SELECT a.id, b.name FROM orders a JOIN users b ON a.uid = b.id WHERE a.total > 100 GROUP BY b.name ORDER BY 2 DESC LIMIT 10;"),
        ("prose", "The committee met on 3 May 2019 (a Friday) to discuss the budget; 14 members were present. It was agreed, after a long debate, to spend $3,000 on repairs."),
    ],
)
def test_texts_of_other_origin(rules, kind, text):
    assert list(judged([text], rules)) == [kind]


def test_counts_against_plain_python():
    rng = random.Random(3)
    pieces = ["the ", "Old", " bridge", "\n", ". ", "12", "-3.5", "\t", "  ", "| ", "桥", "水很", "ประตู", "é", "!", "\n- ", "\n1. ", "x_y", " = ", ": ", "“q”", ",", "; "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    owner, counts = C.count_blocks(texts)
    apart = 0
    for k, text in enumerate(texts):
        want, held = [], []
        for line in [*text.split("\n"), ""]:
            if line.strip():
                held.append(line)
            elif held:
                want.append("\n".join(held).rstrip())
                held = []
        mine = owner == k
        got = {name: counts[name][mine] for name in counts}
        terms = [[m.group(0).lower() for m in regex.finditer(r"[\p{L}\p{M}]+", block)] for block in want]
        plain = {
            "n": [len(b) for b in want],
            "lines": [b.count("\n") + 1 for b in want],
            "letters": [sum(unicodedata.category(c)[0] in "LM" for c in b) for b in want],
            "digits": [sum(unicodedata.category(c)[0] == "N" for c in b) for b in want],
            "blanks": [sum(c.isspace() for c in b) for b in want],
            "terms": [len(t) for t in terms],
            "tokens": [len(b.split()) for b in want],
            "pipes": [b.count("|") for b in want],
            "commas": [b.count(",") for b in want],
        }
        for name, values in plain.items():
            assert got[name].sum() == sum(values), (name, text)
        if len(got["n"]) == len(want):
            apart += 1
            assert all(list(got[name]) == values for name, values in plain.items())
            assert list(got["distinct_terms"]) == [len(set(t)) for t in terms]
    assert apart > 200


def test_a_block_ends_where_running_text_meets_a_list():
    prose, rows = "The old bridge was closed after the storm.", "- lamp oil\n- rope\n- tea"
    text = f"{prose}\n{rows}\n{prose}  \n| a | b |\n| c | d |\n{prose}"
    owner, counts = C.count_blocks([text, f"- one\n{rows}", f"{prose}\n{prose}"])
    assert list(owner) == [0, 0, 0, 0, 0, 1, 2]
    assert counts["n"][:5].sum() == len(text) and list(counts["lines"]) == [1, 3, 1, 2, 1, 4, 2]
    assert counts["blanks"][:5].sum() == sum(c.isspace() for c in text)


def test_figures_of_scripts_without_blanks(spark, rules):
    texts = ["昨天晚上我们沿着河边散步。水很冷，但是没有人想回家。", "ประตูเปิดแล้ว เด็กอ่านหนังสือที่บ้าน", "The old bridge isn't closed."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, body string")
    zh, th, en = sorted(Q.text_quality(rows, "doc", "body", rules).collect(), key=lambda r: r.doc)
    assert (zh.n_words, zh.mean_word_length) == (12, round(23 / 12, 6)) and zh.common_word_share > 0
    assert (th.n_words, th.mean_word_length) == (9, round(35 / 9, 6)) and th.common_word_share > 0
    assert (en.n_words, en.n_chars, en.symbol_ratio) == (5, 28, round(2 / 28, 6))


def test_long_texts_are_counted_in_parts_that_change_nothing(spark, rules, monkeypatch):
    text = "\r\n\r\n".join([PROSE, LIST, TABLE] * 40)
    row = spark.createDataFrame([(1, text)], "doc int, body string")
    whole = Q.text_quality(row, "doc", "body", rules).first()
    assert Q._judged([text, None, ""], ["variety"]).to_pylist()[1:] == [[], []]
    monkeypatch.setattr(Q, "SLICE", 500)
    assert len(Q._parts(text)) > 10 and Q._judged([text], ["variety"]).equals(Q._judged([text], ["variety"]))
    parts = Q._judged([text], ["variety"])
    monkeypatch.setattr(Q, "SLICE", 10**9)
    assert parts.equals(Q._judged([text], ["variety"])) and whole.n_lines == 40 * (1 + LIST.count("\n") + 1 + TABLE.count("\n") + 1)


def test_the_rules_file_is_what_learning_writes(rules):
    namespace = {}
    exec(written(rules), namespace)
    assert namespace["RULES"] == RULES and len(rules) == 3
    few = Q.learn(labelled_blocks=900, lists=2, kept=1)
    assert len(few) == 1 and len(few[0]) > 3


def test_the_vote_in_spark_is_that_of_the_lists(spark, rules):
    x, _ = Q.table_of(labelled(400, 9))
    frame = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], ["k", *[f"f_{f}" for f in Q.FEATURES]])
    frame = frame.withColumn("c", F.struct(*[F.col(f"f_{f}") for f in Q.FEATURES]))
    for lists in (rules, rules[:1], rules[:2]):
        got = frame.select("k", Q.voted_kind(lists, F.col("c")).alias("kind")).orderBy("k").collect()
        assert [r.kind for r in got] == list(Q.apply_lists(lists, x))


def test_kinds_by_their_share_of_characters(spark, rules):
    texts = [PROSE, TABLE, LIST, JUNK, PROSE + "\n\n" + LIST, LIST + "\r\n\r\n" + TABLE * 2, None, "", " \n ", PROSE + "\n \n" + (LIST + "\n\n") * 3]
    rows = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "doc long, body string, n_chars string")
    got = {r.doc: r for r in Q.text_quality(rows, "doc", "body", rules).collect()}
    kinds = [got[n].text_kind for n in range(len(texts))]
    assert kinds == ["prose", "table", "list", "junk", "prose", "table", None, None, None, "list"]
    assert (got[6].n_chars, got[6].n_words, got[6].mean_word_length, got[8].n_lines) == (0, 0, None, 0)
    one = got[0]
    assert (one.n_chars, one.n_lines, one.n_words, one.ended_line_share) == (len(PROSE), 1, 29, 1.0) and one.common_word_share > 0.3
    assert abs(sum(got[4][f"{k}_share"] for k in ("prose", "list", "table", "junk")) - 1) < 1e-5


def test_repeats_long_texts_and_empty_table(spark, rules):
    rows = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, LIST), (2, (PROSE + "\n\n") * 2000)], "doc long, body string")
    got = [(r.doc, r.text_kind) for r in Q.text_quality(rows, "doc", "body", rules).collect()]
    assert sorted(got, key=str) == [(1, "prose"), (1, "prose"), (2, "prose"), (None, "list")]
    assert Q.text_quality(rows.limit(0), "doc", "body", rules).count() == 0


def test_no_shuffle_and_rules_in_the_plan(spark, rules):
    rows = spark.createDataFrame([(1, PROSE)], "doc long, body string")
    plan = Q.text_quality(rows, "doc", "body", rules).filter("text_kind <> 'prose'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1 and "CASE WHEN" in plan


def test_induction_on_a_known_concept():
    rng = np.random.default_rng(1)
    x = rng.random((1500, len(Q.FEATURES)))
    y = np.where(x[:, 3] > 0.8, "junk", np.where((x[:, 5] <= 0.2) & (x[:, 7] > 0.5), "list", "prose")).astype(object)
    rules = Q.induce(x, y, precise=0.8)
    fresh = rng.random((800, len(Q.FEATURES)))
    want = np.where(fresh[:, 3] > 0.8, "junk", np.where((fresh[:, 5] <= 0.2) & (fresh[:, 7] > 0.5), "list", "prose"))
    assert (Q.apply_rules(rules, fresh) == want).mean() > 0.97
    assert Q.kind_of([], F.lit(1)) is not None
