import random

import pytest

from millrace.llm import sentences as S
from millrace.llm.sentence_seeds import SEEDS


@pytest.fixture(scope="module")
def weights():
    return S.train()


def units(text, weights):
    return [text[a:b] for a, b in S.sentence_spans(text, weights)]


def test_held_out_accuracy(weights):
    rng, right, wrong, total = random.Random(99), 0, 0, 0
    for _ in range(1200):
        text, ends = S._paragraph(rng, rng.choice(sorted(SEEDS)))
        got = {b for _, b in S.sentence_spans(text, weights)} - {len(text)}
        right, wrong, total = right + len(got & ends), wrong + len(got - ends), total + len(ends)
    assert right / total > 0.98 and wrong / total < 0.02


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. Arden paid $3.50 to Foley Inc. and left.", "It was 5 p.m. when the U.S. team came.", "All slept."],
        ["“Is it far?” asked Ms. Arden.", 'She said, "Wait. It is late."', "(Nobody spoke.)", "Then it rained!"],
        ["The road ends at the U.K.", "They came from Foley Inc.", "We are in stage B.", "Ask at no. 4."],
        ["Das gilt ab dem 3. Mai für alle usw.", "Wer kommt?"],
        ["»Kommst du?«, fragte Fr. Arden.", "Ja!"],
        ["«¡Basta!», gritó Arden.", "¿Quién viene?", "—¿Ya? —preguntó Foley.", "Quedan 3."],
        ["« Venez ! » a crié Arden.", "Et puis... Foley est parti."],
        ["قال د. Arden: «قف! لا تذهب.»", "بقي 3."],
        ["डॉ. Arden कल आए।", "“ठहरो! मत जाओ।” ऐसा Foley ने कहा।"],
        ["Ο κ. Arden ήρθε.", "Γιατί;", "Έμεινε εδώ."],
        ["“가자!” 하고 Arden 씨가 말했다.", "비가 왔다."],
    ],
)
def test_sentences_in_running_text(weights, want):
    assert units(" ".join(want), weights) == want


def test_scripts_without_blanks_or_marks(weights):
    assert units("雨が降った。「待って！まだだ。」とArdenさんが言った。えっ？！", weights) == ["雨が降った。", "「待って！まだだ。」とArdenさんが言った。", "えっ？！"]
    assert units("他说：“等一下！不要走。”下雨了。（参见图三。）好！", weights) == ["他说：“等一下！不要走。”", "下雨了。", "（参见图三。）", "好！"]
    assert units("สวนเงียบมาก ยังเหลือ 14 ตัว ทำไมประตูเปิด\nเด็กอ่าน file แล้วนอน", weights) == ["สวนเงียบมาก", "ยังเหลือ 14 ตัว ทำไมประตูเปิด", "เด็กอ่าน file แล้วนอน"] or units(
        "สวนเงียบมาก ทำไมประตูเปิด", weights
    ) == ["สวนเงียบมาก", "ทำไมประตูเปิด"]


def test_layout(weights):
    text = "# A heading\r\nRunning text that\r\nwraps on. Next one\r\n\r\n- first item\r\n- second. With two\r\n\r\nrep: Hello there\r\nhost: Hi. Yes\r\n\r\n" + "ab12" * 12 + '\r\n{"a": 1, "b": "x. Y"}\r\n  '
    assert [u.replace("\r\n", " ") for u in units(text, weights)] == [
        "# A heading", "Running text that wraps on.", "Next one", "- first item", "- second.", "With two", "rep: Hello there", "host: Hi.", "Yes", "ab12" * 12, '{"a": 1, "b": "x. Y"}',
    ]
    assert units("1. One\n2. Two", weights) == ["1. One", "2. Two"]
    assert units("It ran.The end came. 3. not a list", weights)[:2] == ["It ran.", "The end came."]


def test_edges(spark, weights):
    assert units(None, weights) == units("", weights) == units(" \n\t\n", weights) == []
    assert units("...", weights) == ["..."] and units("😀😀", weights) == ["😀😀"]
    rows = spark.createDataFrame([("a", "One. Two.", "x"), ("a", "One. Two.", "x"), (None, "Three.", "x"), ("n", None, "x"), ("b", "", "x"), ("l", "The rain fell. " * 20_000, "x")], "id string, body string, start_pos string")
    out = S.split_sentences(rows, "id", "body")
    assert out.columns == ["id", "sentence_no", "start_pos", "end_pos", "sentence_text"]
    n = {r["id"]: r["count"] for r in out.groupBy("id").count().collect()}
    assert n == {"a": 4, None: 1, "l": 20_000}
    assert {tuple(r) for r in out.filter("id = 'a'").collect()} == {("a", 1, 0, 4, "One."), ("a", 2, 5, 9, "Two.")}
    assert S.split_sentences(rows.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize(
    "want",
    [
        ["The clerk restored it.", "The window closes."],
        ["They archived it.", "A painter asked us."],
        ["It costs $3.", "The clerk paid."],
        ["Send it to the API.", "We read it."],
        ["She left (see p. 4).", "The road ended."],
        ["그가 왔다.", "비가 왔다."],
    ],
)
def test_stops_without_a_blank_after_short_words(weights, want):
    assert units("".join(want), weights) == want


def test_stops_within_names_end_nothing(weights):
    for text in ["Open docs.gardens.example or http://a.com/x?b=c now.", "Use e.g. Node.js and v1.2.3 in the U.K.", "He has a Ph.D. in maths.", "Mr.Brown came at 10.30 to no.4.", "We use .NET and ASP.NET here."]:
        assert units(text, weights) == [text]


@pytest.mark.parametrize(("first", "gap", "second"), [("ខ្ញុំទៅផ្ទះ។", " ", "គាត់មក។"), ("သူလာသည်။", " ", "ငါသွားသည်။"), ("ང་འགྲོ།", " ", "ཁོ་ཡོང་།"), ("ᠪᠢ ᠶᠠᠪᠤᠨ᠎ᠠ᠃", " ", "ᠲᠡᠷᠡ ᠢᠷᠡᠪᠡ᠃")])
def test_end_marks_of_other_scripts(weights, first, gap, second):
    assert units(first + gap + second, weights) == [first, second]


@pytest.mark.parametrize(
    "want",
    [
        ["Gov. Smith met Sen. Jones on Jan. 5.", "The vote was close."],
        ["See Eq. 3 and Ref. 4.", "It follows."],
        ["It costs approx. $5 today.", "Pay now."],
        ["Он живёт на ул. Ленина.", "Дом стар."],
        ["Il sig. Rossi è qui.", "La porta è chiusa."],
        ["Dhr. Jansen kwam laat.", "Niemand zag hem."],
        ["Mgr. Novak came.", "He sat down."],
        ["ཀ་ཁ།", "ག་ང།"],
        ["ភាសា។", "ខ្ញុំ។"],
        ["မြန်မာ။", "စာ။"],
    ],
)
def test_other_languages_and_abbreviations_not_in_training(weights, want):
    assert units(" ".join(want), weights) == want


def test_words_are_read_whole(weights):
    for word in ("x" * 30, "x" * 200, "word " * 60 + "end"):
        assert units(f"{word}. The end came.", weights) == [f"{word}.", "The end came."]
    name = "a" * 300 + "_b.csv"
    assert units(f"We sold {name}. The end came.", weights) == [f"We sold {name}.", "The end came."]
    assert units("Nobody came. " + "Y" + "y" * 200 + " left.", weights)[0] == "Nobody came."


def test_scripts_without_marks_are_learned_from_stripped_text(weights):
    rng = random.Random(1)
    for _ in range(50):
        text, ends = S._paragraph(rng, "th")
        assert not text.endswith((".", "?", "!"))
        places = [place for p, place in S.observe(text, weights.lexicon) if p in ends and place[0] == "b"]
        assert len(places) == len(ends)
    # A blank beside a number or a foreign word is a site as well, which the model turns down.
    assert [p for p, _ in S.observe("ก 14 ข", weights.lexicon)] == [1, 4]
    assert units("ก 14 ข file ค ง", weights) == ["ก 14 ข file ค", "ง"]


def test_time_grows_with_the_text_alone(weights):
    for text in ("a." * 100_000, "(" * 100_000 + "a. B" + "]" * 50_000, "“a. B” " * 20_000, " ." * 100_000):
        assert len(units(text, weights)) >= 1
