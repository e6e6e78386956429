"""Sentence boundaries across languages and scripts.

Lines are first grouped into blocks by layout (paragraphs, headings, list items, speaker turns, lines of
data), whose ends are ends of units. Within a block a linear-chain model tags characters as boundary or
inside, decoded by Viterbi; characters that cannot end a sentence have no score as boundary and are passed
over. The weights are learned by an averaged structured perceptron on the sentences of
``sentence_seeds``, whose punctuation is stripped for scripts that write no end marks. Abbreviations and words
that open sentences are learned from the same sentences; others are judged by length, case, vowels and
what follows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sentence_seeds import COMMA, COUNTED, FILES, GERMAN_MONTHS, LABELLED, MONTHS, NAMES, OPENERS, SEEDS, STARTERS, TITLES, UNBLANKED, UNMARKED
from millrace.plans.session import ship

ROLES = set("customer rep agent engineer user assistant system speaker host guest interviewer moderator caller support client q a".split())

_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "‘": "’", "‹": "›", '"': '"', "'": "'"}
_BRACKETS = "（([「『《〈"
# Sentence_Terminal of Unicode beyond ASCII, with the section and verse marks of Tibetan, Khmer and Mongolian.
_WIDE_MARKS = (
    "。！？｡．।॥۔؟։።፧…؝؞܀܁܂߹࠷࠹࠽࠾၊။፨᙮᜵᜶។៕᠃᠉᥄᥅᪨᪩᪪᪫᭎᭏᭚᭛᭞᭟᭽᭾᭿᰻᰼᱾᱿།༎༏༐༑‼‽⁇⁈⁉⸼⹓⹔꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗"
    "\U00010a56\U00010a57\U00011047\U00011048\U000110be\U000110bf\U000110c0\U000110c1\U00011141\U00011142\U00011143\U000111c5\U000111c6\U000111cd\U000111de\U000111df"
)
_NO_MARKS = r"฀-๏๚-๿ກ-໏ໜ-໿"
_MARK = rf"(?P<m>[.!?;{_WIDE_MARKS}]+(?: [!?]+)?)(?P<c>(?:[”“»«」』》〉）)\]}}’›\"']|\s(?=[»›]))*)"
_MARK_SITE = re.compile(_MARK)
#: In scripts without end marks any blank beside one of their letters is a site too.
_BLANK_SITE = re.compile(_MARK + rf"|(?<=[{_NO_MARKS}])\s+(?=\S)|(?<=\S)\s+(?=[{_NO_MARKS}])")
_UNMARKED = re.compile(rf"[{_NO_MARKS}]")
_QUOTE = re.compile("[" + re.escape("".join(dict.fromkeys("".join(_PAIRS) + "".join(_PAIRS.values())))) + "]")
_WORD_ENDS = frozenset(" \t\n\r\f\v\u00a0\u3000“„«»「『《（([‘‹\"'.…!?—–")
_LETTERS = re.compile(r"[^\W\d_]*")
_BLANKS = re.compile(r"\s*")
_NAME_LIKE = re.compile(r"[\w/-]*_|[a-z]+\.[a-z]|v\d+\.\d")
_VOWEL = re.compile(r"[aeiouyàâäéèêëíîïóôöúùûüąęаеёиоуыэюяієїα-ωάέήίόύώ]")
_ACRONYM = re.compile(r"[^\W\d_](\.[^\W\d_])+")
_RAN_ON = re.compile(r"[^\W\d_]{3,}\.[A-Z]$")
_PATH, _DECIMAL = re.compile(r"[/@_\\]|(?<!\S)www\."), re.compile(r"\d\.\d")
#: No word that training tells by its letters is longer; longer words count by their length and shape.
_WORD_MOST = 24


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    if ch.isdigit():
        return "9"
    if not ch.isalpha():
        return "M" if unicodedata.category(ch)[0] == "M" else "_"
    o = ord(ch)
    if 0x0E00 <= o <= 0x0EFF:
        return "T"
    if 0x3040 <= o <= 0x30FF:
        return "J"
    if 0x3400 <= o <= 0x9FFF:
        return "H"
    if ch.isupper():
        return "U"
    return "l" if ch.islower() else "c"


def _quotes(text: str) -> list[tuple[int, int]]:
    """Spans (open, close) of quotations and brackets, nested or apart; an opening mark without its closing one is ignored."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    wanted: Counter = Counter()
    size = len(text)
    for m in _QUOTE.finditer(text):
        i, ch = m.start(), m.group(0)
        closed = False
        if wanted[ch]:
            # An apostrophe stands between letters; a closing quote does not open one.
            if not (ch in "'\"’" and 0 < i < size - 1 and text[i + 1].isalnum() and text[i - 1].isalnum()):
                while stack:
                    o, want = stack.pop()
                    wanted.subtract(want)
                    if ch in want:
                        spans.append((o, i))
                        closed = True
                        break
        if closed or ch not in _PAIRS:
            continue
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if ch in "'\"‘" and (before.isalnum() or not after or after.isspace()) and not (ch != "'" and before and _script(before) in "HJ"):
            continue
        if ch == "“" and stack and stack[-1][1] == "“”":
            continue
        if ch == "»" and before.isalnum():
            continue
        stack.append((i, _PAIRS[ch]))
        wanted.update(_PAIRS[ch])
    return spans


def _may_begin(ch: str) -> bool:
    """Whether ``ch`` can stand first in a sentence: no comma, closing bracket or the like."""
    return ch in _PAIRS or ch in "¿¡#@&*§†‡/\\_" or unicodedata.category(ch) in ("Pd", "Ps", "Pi") or unicodedata.category(ch)[0] in "LNS"


class Lexicon:
    """What training has seen of words: abbreviations by what follows them, words that open sentences, words
    that a letter follows at a sentence's end ("stage B."), and others told apart."""

    def __init__(self, abbreviations: dict[str, str] | None = None, starters: frozenset = frozenset(), known: frozenset = frozenset(), labels: frozenset = frozenset()) -> None:
        self.abbreviations, self.starters, self.known, self.labels = abbreviations or {}, starters, known, labels


def _shape(word: str, length: int) -> str:
    """Length, case, vowels and inner stops of a word that training has not seen before a stop."""
    if word and not word[-1].isalnum() and _script(word[-1]) != "M":
        return "closed"
    if word[-1:].isdigit():
        return "ordinal" if word.isdigit() and length <= 2 else "number"
    if length > 1 and _ACRONYM.fullmatch(word):
        return "acro"
    case = "A" if word.isupper() and length > 1 else _script(word[0]) if word else "none"
    vowel = "v" if _VOWEL.search(word.lower()) else "c"
    return f"{case}{min(length, 6)}{vowel}{'.' if '.' in word else ''}"


def observe(text: str, lexicon: Lexicon) -> list[tuple[int, tuple]]:
    """(position after the possible end, what the model knows there) for the characters that may end a sentence.

    One pass from left to right; what is known is a tuple of small values, so that equal places share one score.
    Words are read whole, whatever their length.
    """
    spans = sorted(_quotes(text))
    closes = {c: o for o, c in spans}
    size, solid = len(text), len(text.rstrip())
    label, marker = _LABEL.match(text), _MARKER.match(text)
    lead_end = max(label.end() - 1 if label else 0, marker.end() if marker else 0)
    out: list[tuple[int, tuple]] = []
    inner: list[tuple[int, int]] = []
    next_span, word_from, last_end, last_stop = 0, 0, -1, False
    token, token_end, path_at, number_at, stop_at = -1, -1, size, size, size
    for m in (_BLANK_SITE if _UNMARKED.search(text) else _MARK_SITE).finditer(text):
        at, mark = m.start(), m["m"]
        if mark is None:
            out.append((at, ("b", _script(text[at - 1]), _script(text[m.end()]))))
            continue
        stop = at + len(mark)
        # The word before: back to a delimiter, or on through a single stop to the word before that.
        start = at
        while start > last_end and start > 0 and text[start - 1] not in _WORD_ENDS:
            start -= 1
        if start == last_end and last_stop and start < at:
            start = word_from
        word_from, last_end, last_stop = start, stop, mark == "."
        # Closing marks that close nothing begin what follows ("ends. “New").
        end = stop
        for k in range(stop, m.end()):
            if k in closes:
                end = k + 1
            elif not text[k].isspace():
                break
        if end >= solid:
            continue
        if ";" in mark and (mark != ";" or not ("Ͱ" <= text[at - 1 : at] <= "Ͽ" or "ἀ" <= text[at - 1 : at] <= "῿")):
            continue
        nxt = text[end]
        wide = not mark.isascii()
        if not nxt.isspace() and not wide and not _may_begin(nxt) and (mark[0] == "." or end == stop):
            # Commas and dashes after a quotation are read by the model.
            continue
        while next_span < len(spans) and spans[next_span][0] < end - 1:
            inner.append(spans[next_span])
            next_span += 1
        while inner and inner[-1][1] < end:
            inner.pop()
        opened = closes.get(end - 1)
        where = "in" if inner else "after" if opened is not None else "plain"
        # What follows.
        rest = _BLANKS.match(text, end).end()
        gap = "gap" if rest > end else "tight"
        nxt = text[rest : rest + 1]
        ahead = _LETTERS.match(text, rest)
        nword = ahead.group(0) if ahead.end() - rest <= _WORD_MOST else ""
        letters = ahead.end() - rest
        cased = _script(nxt) if nxt else "end"
        if _NAME_LIKE.match(text, rest):
            nc = "id"
        elif cased == "l" and 1 < letters <= 5 and not _VOWEL.search(nword):
            nc = "brand"
        elif nxt in ",;:)]}»”’」』）、，":
            nc = "punct"
        elif nxt in "–—-" and (rest + 1 >= size or text[rest + 1].isspace() or _script(text[rest + 1]) == "l"):
            nc = "dash"
        elif nxt in _PAIRS or nxt in "¿¡—":
            nc = "open"
        else:
            nc = cased
        low_next = nword.lower()
        if nc == "U" and low_next in lexicon.starters:
            nc = "Ustart"
        plain = mark.replace(" ", "")
        kind = "ell" if plain.startswith(("...", "…", "．．")) else "." if plain == "." else "w" if not plain[0].isascii() and plain[0] not in "！？؟" else "?"
        wc = ident = prior = shape = ""
        if kind == ".":
            word = text[max(start, at - _WORD_MOST) : at]
            low, length = word.lower(), at - start
            if low not in lexicon.abbreviations and "." in low and (low.rpartition(".")[2] in lexicon.abbreviations or _RAN_ON.search(word)):
                word = word.rpartition(".")[2]  # the sentence before ran on without a blank
                low, length = word.lower(), len(word)
            if length == 1 and word.isupper():
                wc = "initial"
                k = at - 1
                while k > 0 and text[k - 1].isspace():
                    k -= 1
                j = k
                while j > 0 and k - j <= _WORD_MOST and not text[j - 1].isspace():
                    j -= 1
                prior = text[j:k].lower().strip("(")
                prior = "label" if prior in lexicon.labels else "x"
            elif low in lexicon.abbreviations:
                wc, ident, shape = lexicon.abbreviations[low], low, _shape(word, length)
            else:
                wc = "known" if low in lexicon.starters else _shape(word, length)
        seen = low_next if wc in ("ordinal", "number") and low_next in lexicon.known else ""
        char = nxt if cased in "JHc" and where == "after" else ""
        tight = quote = turned = ()
        if gap == "tight" and mark[0] in ".!?":
            if at >= token_end:
                token = at
                while token > 0 and not text[token - 1].isspace():
                    token -= 1
                blank = _SPACE.search(text, at)
                token_end = blank.start() if blank else size
                first = _PATH.search(text, token, token_end)
                path_at = first.start() if first else size
                first = _DECIMAL.search(text, token, token_end)
                number_at = first.end() if first else size + 1
                stop_at = text.find(".", token, token_end)
            tight = _tight(text, at, token, path_at < at, number_at <= at, 0 <= stop_at < at, nc, rest, letters, nword)
        if where == "in":
            quote = ("bracket" if text[inner[-1][0]] in _BRACKETS else "quote",)
        elif where == "after":
            k = opened
            while k > 0 and text[k - 1].isspace():
                k -= 1
            lead = text[k - 1 : k] if k > 0 and not (lead_end and k <= lead_end) and not (label and opened <= label.end() - 1) else ""
            side = "start" if not lead or lead in ".!?" + _WIDE_MARKS + "”»」』）)’" or text[opened - 1 : opened] == "\n" and not lead.isalnum() else "colon" if lead in ":：" else "comma" if lead in ",，" else "mid"
            quote = ("b" if text[opened] in "（([" else "q", side, text[opened])
        if kind == "ell":
            k = at
            while k > 0 and text[k - 1].isspace():
                k -= 1
            was = text[k - 1 : k]
            two = text[rest : rest + 2]
            turned = (was, _script(was) if was else "", two if cased in "JH" and two in lexicon.known else "x")
        out.append((end, ("m", kind, wc, ident, shape, prior, nc, seen, gap, where, char, quote, turned, tight)))
    return out


_SPACE = re.compile(r"\s")


def _tight(text: str, at: int, token: int, path: bool, number: bool, dots: bool, nc: str, rest: int, letters: int, nword: str) -> tuple:
    """What tells a sentence end without a blank after it from a file, an address, a version or an abbreviation."""
    k = at
    while k > token and at - k < 3 and text[k - 1].isalnum():
        k -= 1
    left = _script(text[at - 1]) if at > token else "none"
    # A single letter before another stop is part of an abbreviation, before a blank a word.
    follow = text[rest + letters : rest + letters + 1]
    beyond = text[rest + letters + 1 : rest + letters + 2]
    then = "dots" if follow == "." and (beyond.isalnum() or beyond == "_") else "stop" if follow == "." else "blank" if not follow or follow.isspace() else "part" if follow in "_/@-" or follow.isdigit() else "other"
    shape = "A" if letters > 1 and nword.isupper() else ""
    return ("path" if path else "number" if number else "dots" if dots else "plain", left, at - k, f"{nc}{shape}:{min(letters, 2)}:{then}")


def features(place: tuple, identity: bool = True) -> list[str]:
    """The names of what the model weighs at a place; without ``identity`` words count by shape alone."""
    if place[0] == "b":
        _, before, after = place
        return [f"blank:{before}:{after}"]
    _, kind, wc, ident, shape, prior, nc, seen, gap, where, char, quote, turned, tight = place
    if not identity and ident and (shape[0] in "UA" or "c" in shape[1:]):
        wc, ident = shape, ""  # only capitals and a lack of vowels tell an abbreviation by its shape
    w = wc or "any"
    f = [f"k={kind}", f"k={kind}|n={nc}|{where}", f"w={w}|n={nc}", f"w={w}", f"where={where}", f"{gap}|k={kind}", f"w={w}|{gap}"]
    if ident:
        f += [f"i={ident}", f"i={ident}|n={nc}"]
    if prior:
        f += [f"prior={prior}", f"prior={prior}|n={nc}"]
    if wc in ("ordinal", "number"):
        f.append(f"w={wc}|seen={seen}")
    if tight:
        path, left, size, right = tight
        f += [f"T|k={kind}|n={nc}", f"T|r={right}|k={kind}", f"T|l={left}|n={nc}", f"T|{path}|n={nc}", f"T|{path}|k={kind}"]
        if kind == ".":
            f += [f"T|s={size}|n={nc}", f"T|w={w}|n={nc}", f"T|w={w}|s={size}", f"T|l={left}|s={size}|r={right}"]
    if where == "in":
        f.append(f"in|{quote[0]}")
    if where == "after":
        shape = f"{quote[0]}:{quote[1]}"
        f += [f"af={shape}", f"af={shape}|n={nc}", f"af={shape}|k={kind}", f"q={quote[2]}|{quote[1]}", f"q={quote[2]}|{quote[1]}|k={kind}"]
        if char:
            f.append(f"af={shape}|c={char}")
    if kind == "ell":
        f += [f"ell|n={nc}|{gap}", f"ell|before={turned[1]}", f"ell|after={turned[2]}|{nc}"]
        if turned[1] and turned[1] in "JHc":
            f.append(f"ell|was={turned[0]}")
    return f


def _viterbi(gains: list[float], step: list[list[float]]) -> list[bool]:
    """The best tags (boundary or not) of a chain of sites, from each one's score as boundary and those of the steps."""
    if not gains:
        return []
    (s00, s01), (s10, s11) = step
    off, on = 0.0, gains[0]
    back = []
    for gain in gains[1:]:
        a0, a1 = on + s10 > off + s00, on + s11 > off + s01
        back.append((a0, a1))
        off, on = (on + s10 if a0 else off + s00), (on + s11 if a1 else off + s01) + gain
    tag = on > off
    tags = [tag]
    for from_off, from_on in reversed(back):
        tag = from_on if tag else from_off
        tags.append(tag)
    tags.reverse()
    return tags


_SLOT = re.compile(r"\{(\w)\}")
_STRIPPED = "".join(ch for ch in ".!?;,:" + _WIDE_MARKS)


def _paragraph(rng: random.Random, lang: str) -> tuple[str, set[int]]:
    """A random paragraph of training sentences and the positions of its boundaries.

    Sentences of scripts without end marks are stripped of their punctuation, as their texts are.
    """

    def fill(slot: re.Match) -> str:
        kind = slot[1]
        if kind == "x":
            return f"{rng.randint(0, 40)}{',' if lang in COMMA else '.'}{rng.randint(0, 99)}"
        if kind in "dy":
            return str(rng.randint(1, 900 if kind == "d" else 31))
        return rng.choice({"N": NAMES, "f": FILES, "F": OPENERS, "T": TITLES, "R": COUNTED, "m": MONTHS, "M": GERMAN_MONTHS, "L": LABELLED, "i": "ABCDEFGHJKLMNOPRSTV"}[kind])

    text, ends = "", set()
    glue = "" if lang in UNBLANKED else " "
    for _ in range(rng.randint(2, 8)):
        if text:
            ends.add(len(text))
            tight = rng.random() < 0.08 and lang not in UNMARKED and not text.endswith(("etc.", "Inc.", "Ltd.", "usw.", "C.", "D.", "B.", "ecc.", "enz.", "itd.", "m.m.", "dll.", "vb.", "v.v.", "д.", "Jan."))
            text += glue if not tight else ""
        sentence = rng.choice(SEEDS[lang])
        if lang in UNMARKED:
            sentence = sentence.rstrip(_STRIPPED)
        text += _SLOT.sub(fill, sentence)
    return text, ends


def learn_lexicon(data: list[tuple[str, set[int]]], least: int = 2) -> Lexicon:
    """Abbreviations, starters and telling words from training paragraphs: what was seen ``least`` times or more.

    A word is an abbreviation if a stop after it ended nothing; its class says what followed most (a capital, a
    number or else) and whether it has ended sentences too.
    """
    inner: dict[str, Counter] = defaultdict(Counter)
    final: Counter = Counter()
    starters: Counter = Counter()
    other: Counter = Counter()
    letters: dict[str, Counter] = defaultdict(Counter)
    bare = Lexicon()
    for text, ends in data:
        for p in ends:
            word = _LETTERS.match(text, _BLANKS.match(text, p).end()).group(0)
            if word[:1].isupper():
                starters[word.lower()] += 1
        for p, place in observe(text, bare):
            if place[0] == "b":
                continue
            after = _BLANKS.match(text, p).end()
            other[text[after : after + 2]] += 1
            other[_LETTERS.match(text, after).group(0).lower()] += 1
            if place[1] != "." or place[8] == "tight" or place[9] != "plain":
                continue
            k = p - 1
            while k > 0 and (text[k - 1] not in _WORD_ENDS or text[k - 1] == "." and k > 1 and text[k - 2] not in _WORD_ENDS):
                k -= 1
            word = text[k : p - 1].lower()
            for before in text[: max(0, k)].lower().split()[-1:]:
                if place[2] == "initial":
                    letters[before.strip("(")][p in ends] += 1
            if not word or place[2] == "initial" or word[-1].isdigit() or len(word) > _WORD_MOST or "." in word and not _ACRONYM.fullmatch(word) and max(map(len, word.split("."))) > 2:
                continue
            if p in ends:
                final[word] += 1
            else:
                inner[word][{"U": "U", "9": "9"}.get(_script(text[after]) if after < len(text) else "", "l")] += 1
    found = {w: f"{'both' if final[w] else 'inner'}{c.most_common(1)[0][0]}" for w, c in inner.items() if sum(c.values()) >= least}
    names = {n.lower() for n in NAMES}
    return Lexicon(found, frozenset(w for w, n in starters.items() if n >= least and w not in names) | frozenset(STARTERS.split()), frozenset(w for w, n in other.items() if n >= least and w and w not in names), frozenset(w for w, c in letters.items() if c[True] > c[False]))


@dataclass(frozen=True)
class Model:
    """Weights of features and of steps between tags, and the words they rest on."""

    weights: dict[str, float]
    lexicon: Lexicon

    @property
    def step(self) -> list[list[float]]:
        return [[self.weights.get(f"t:{a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)]


@lru_cache(maxsize=2)
def train(paragraphs: int = 6000, rounds: int = 6, seed: int = 7, blind: float = 0.2, margin: float = 2.0) -> Model:
    """Weights by an averaged structured perceptron on ``paragraphs`` random training paragraphs (a fixed bound).

    In a share ``blind`` of the paragraphs words count by length and shape alone, so that abbreviations
    that training has not seen are judged by those it has. A right tag must win by ``margin``.
    """
    rng = random.Random(seed)
    picks = [lang for lang in sorted(SEEDS) for _ in range(max(1, len(SEEDS[lang]) // 5))]
    texts = [_paragraph(rng, rng.choice(picks)) for _ in range(paragraphs)]
    lexicon = learn_lexicon(texts)
    names: dict[tuple, list[str]] = {}
    data = []
    for text, ends in texts:
        places, sighted = observe(text, lexicon), rng.random() >= blind
        for _, place in places:
            if (place, sighted) not in names:
                names[place, sighted] = features(place, sighted)
        data.append(([names[place, sighted] for _, place in places], [p in ends for p, _ in places]))
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    count = 1
    for _ in range(rounds):
        rng.shuffle(data)
        for feats, gold in data:
            guess = _viterbi([sum(weights[f] for f in fs) + (-margin if tag else margin) for fs, tag in zip(feats, gold)], [[weights[f"t:{a}{b}"] for b in (0, 1)] for a in (0, 1)])
            if guess != gold:
                change: Counter = Counter()
                for tags, sign in ((gold, 1), (guess, -1)):
                    for n, tag in enumerate(tags):
                        if tag:
                            for f in feats[n]:
                                change[f] += sign
                        if n:
                            change[f"t:{int(tags[n - 1])}{int(tag)}"] += sign
                for f, v in change.items():
                    weights[f] += v
                    total[f] += v * count
            count += 1
    return Model({f: w - total[f] / count for f, w in weights.items() if w - total[f] / count}, lexicon)


_HEADING = re.compile(r"\s{0,3}#{1,6}\s")
_ITEM = re.compile(r"\s*(?:[-*•・+◦▪–]|\d{1,3}[.)]|\(\d{1,3}\)|[a-z]\))\s+\S")
_MARKER = re.compile(r"\s*(?:[-*•・+◦▪–]|\d{1,3}[.)]|\(\d{1,3}\)|[a-z]\)|#{1,6})")
_LABEL = re.compile(r"\s*(?:\[\d{1,2}:\d\d(?::\d\d)?\]\s*)?(?P<l>[^\W\d_][\w.'-]{0,18}(?: [\w.'-]{1,12})?)(?::|>)\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")


def _is_data(line: str) -> bool:
    s = line.strip()
    if len(s) >= 2 and s[0] in "{[" and s[-1] in "}]" and re.search(r"[\"'][^\"']*[\"']\s*:|^\[[-\d\s.,\"]+\]$", s):
        return True
    if re.match(r"\d{4}-\d\d-\d\d[T ]\d{1,2}:\d\d(:\d\d)?\S*\s+(DEBUG|INFO|WARN|ERROR|TRACE|FATAL)\b", s):
        return True
    if len(s) >= 24 and not re.search(r"\s", s) and s.isascii():
        return bool(re.fullmatch(r"[A-Za-z0-9+/=_-]{32,}|[0-9a-f]{24,}|\w+://\S+|[\[{]\S*[:,]\S*", s))
    return False


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is data) of the stretches of text whose end ends a unit."""
    lines = [(m.start(), m.start() + len(m.group(0).rstrip("\r\n"))) for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
    labels = Counter(m["l"].lower() for a, b in lines if (m := _LABEL.match(text[a:b])))
    out: list[list] = []
    state, fenced = "gap", False
    for a, b in lines:
        line = text[a:b]
        if not line.strip():
            state = "gap"
            continue
        label = _LABEL.match(line)
        if _FENCE.match(line):
            out.append([a, b, True])
            state, fenced = "data", not fenced
        elif fenced or _is_data(line):
            out.append([a, b, True])
            state = "data"
        elif _HEADING.match(line):
            out.append([a, b, False])
            state = "head"
        elif label and (label["l"].lower() in ROLES or labels[label["l"].lower()] > 1):
            out.append([a, b, False])
            state = "turn"
        elif _ITEM.match(line) and state in ("gap", "head", "list", "data"):
            out.append([a, b, False])
            state = "list"
        elif state in ("run", "turn", "list"):
            out[-1][1] = b
        else:
            out.append([a, b, False])
            state = "run"
    return [(a, b, d) for a, b, d in out]


def sentence_spans(text: str | None, model: Model, scores: dict[tuple, float] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of ``text``, without outer white space; ``scores`` keeps places already scored."""
    scores = {} if scores is None else scores
    weights, step, spans = model.weights, model.step, []
    for a, b, data in blocks(text or ""):
        own = text[a:b]
        cuts = []
        if not data:
            places = observe(own, model.lexicon)
            gains = []
            for _, place in places:
                gain = scores.get(place)
                if gain is None:
                    gain = scores[place] = sum(weights.get(f, 0.0) for f in features(place))
                gains.append(gain)
            first = -1
            if places and (skip := _ITEM.match(own)):
                first = skip.end() - 1
            elif places and (skip := _HEADING.match(own)):
                first = skip.end()
            cuts = [p for (p, _), tag in zip(places, _viterbi(gains, step)) if tag and p > max(first, 0)]
        at = 0
        for p in [*cuts, len(own)]:
            unit = own[at:p]
            bare = unit.strip()
            if bare:
                s = a + at + len(unit) - len(unit.lstrip())
                spans.append((s, s + len(bare)))
            at = p
    return spans


def split_sentences(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(``doc``, sentence_no, start_pos, end_pos, sentence_text): the sentence units of every text.

    Defined cases: null and blank texts have no units; a null id keeps its units under a null id; repeated
    rows give their units once per row; very long texts are read whole, block by block; other columns are
    ignored, whatever their names. Positions count code points from 0; end_pos is after the last character.
    """
    ship(docs.sparkSession)
    model = train()

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores: dict[tuple, float] = {}
        for batch in batches:
            spans = [sentence_spans(t, model, scores) for t in batch["t"]]
            yield pd.DataFrame({"d": batch["d"], "t": batch["t"], "s": [[x for x, _ in u] for u in spans], "e": [[y for _, y in u] for u in spans]})

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).filter(F.col("t").rlike(r"\S"))
    units = rows.mapInPandas(found, f"d {kind}, t string, s array<int>, e array<int>").select("d", "t", F.posexplode(F.arrays_zip("s", "e")).alias("n", "u"))
    return units.select(F.col("d").alias(doc), (F.col("n") + 1).cast("long").alias("sentence_no"), F.col("u.s").cast("long").alias("start_pos"), F.col("u.e").cast("long").alias("end_pos"), _cut("t", "u.s", "u.e").alias("sentence_text"))


def _cut(text: str, start: str, end: str) -> Column:
    return F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))
