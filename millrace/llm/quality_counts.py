"""Statistics of blocks of text, counted for many texts at once in arrays of code points.

A block is a paragraph: lines between blank ones. Most counts are taken on the skeleton of a block, in which each
run of letters is one ``a`` and each run of digits one ``9``: it is a third as long as the text and shows the
layout and the marks of any language alike. Where a line of running text meets a list, rows or addresses without a
blank line, a block ends too. Nothing here loops over characters, words or lines.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from millrace.llm.sentence_seeds import SEEDS

# Common words of the languages at hand; for scripts without blanks, common short strings.
COMMON_WORDS = (
    "the a an of to in and is was were be are for on at by with as it its that this these those not no or but so if when while once until before after because we you i they he she our your nobody somebody all still only about than rather do does did can please "
    "der die das ein eine einen den dem des und ist war nicht zu von mit für auf bei nach vor seit wegen trotz obwohl niemand wer warum bitte am im es er sie wir hier "
    "le la les un une des du de et est a pas pour dans par sur avec mais personne pourquoi il elle nous notre depuis "
    "el los las una y es no por para con en se lo nadie que qué del al cuando "
    "o os as um uma e é não por para com em que ninguém nossa foi do da dos das ao "
    "ο η το οι τα του της τον την και δεν από σε με για αλλά κανείς που χωρίς "
    "من في على إلى عن هل لماذا قال دون بعد قبل أحد ولم التي الذي "
    "کا کی کے کو سے میں پر اور ہے ہیں نے کیوں بغیر گیا "
    "का की के को से में पर और है हैं ने क्यों नहीं गया किसी "
    "እና ከ ወደ ያለ ነው ነበር ለምን ገና "
    "և է էր ոչ ոք բայց առանց որ "
    "및 왜 그러나 아무도 아직 두 많은"
)
LISTED = "en de fr es pt el ar ur hi am hy ko ja zh th".split()
COMMON_STRINGS = "的 了 是 在 和 没有 什么 请 从 把 但是 如果 の を は に が で と も た。 まし てい ที่ และ แล จึ ทำ ไม กร จา เป โด".split()

#: What is kept of a block whatever the rules name.
STATISTICS = ("n", "lines", "words", "letters", "digits", "blanks", "ended", "common")
#: Features that are one count over another.
RATIOS = {
    **{k: (k, "lines") for k in ("ended", "bullets", "numbered", "leaders", "urls", "pipes", "tabs", "gaps", "assigned", "keyed", "closed", "indents", "signs")},
    **{f"{k}_word": (k, "words") for k in ("commas", "semicolons", "slashes", "quotes", "bangs", "calls", "glued", "vowelless", "clusters", "mixed", "latin", "inner", "odd", "common")},
    **{f"{k}_char": (k, "n") for k in ("cells", "tags", "rules", "ends")},
    **{f"{k}_token": (k, "tokens") for k in ("tight", "numbers", "dots", "marks")},
    "line_length": ("n", "lines"),
    "words_line": ("words", "lines"),
    "letters": ("letters", "n"),
    "digits": ("digits", "n"),
    "blanks": ("blanks", "n"),
    "word_length": ("letters", "words"),
    "token_length": ("n", "tokens"),
    "same_lines": ("distinct_lines", "lines"),
    "same_cells": ("distinct_cells", "lines"),
    "same_keys": ("distinct_keys", "keys"),
    "same_parts": ("distinct_parts", "parts"),
}
FEATURES = (*RATIOS, "separators_end", "variety", "words", "lines")

_TOP = 0x20000
SPACED, PAIRED, FOURS, NUMBER, BREAK, WHITE = 1, 2, 3, 4, 5, 6
#: Letters of scripts that write no blanks between words; so many of them count as a word.
_UNSPACED = ((PAIRED, 2, ((0x3040, 0x30FF), (0x3400, 0x9FFF))), (FOURS, 4, ((0x0E00, 0x0EFF), (0x0F40, 0x0FBC), (0x1000, 0x109F), (0x1780, 0x17D3))))
_ENDS, _CLOSERS = ".!?…。！？｡।॥؟۔։።;", "\"'”’»›」』）)]"
_A, _9, _NL = ord("a"), ord("9"), 10


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below ``_TOP``; the last entry stands for those above."""
    kinds, low = np.zeros(_TOP + 1, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    for o in range(_TOP):
        ch = chr(o)
        kind = unicodedata.category(ch)[0]
        if kind in "LM":
            kinds[o] = SPACED
        elif kind == "N":
            kinds[o] = NUMBER
        elif ch.isspace():
            kinds[o] = WHITE
        lower = ch.lower()
        if len(lower) == 1:
            low[o] = ord(lower)
    for kind, _, ranges in _UNSPACED:
        for a, b in ranges:
            part = kinds[a : b + 1]
            part[part == SPACED] = kind
    kinds[_NL], kinds[_TOP] = BREAK, PAIRED
    return kinds, np.minimum(low, _TOP)


def _mix(values: np.ndarray, offsets: np.ndarray | int = 0) -> np.ndarray:
    """64 bits of each (value, offset); sums of them tell sequences apart."""
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(offsets).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hash(word: str) -> int:
    _, low = _tables()
    codes = np.minimum(np.array([ord(c) for c in word], np.uint32), _TOP)
    return int(_mix(low[codes], np.arange(len(codes))).sum())


@lru_cache(maxsize=1)
def common_words() -> tuple[str, ...]:
    """The common words; of other languages the short ones that two or more of their training sentences hold."""
    words = dict.fromkeys(COMMON_WORDS.split())
    for lang in sorted(set(SEEDS) - set(LISTED)):
        seen: dict[str, int] = {}
        for sentence in SEEDS[lang]:
            for w in {w.strip(".,;:!?\"'“”«»()„‘’¿¡").lower() for w in sentence.split(" ")}:
                if w.isalpha() and len(w) <= 5:
                    seen[w] = seen.get(w, 0) + 1
        words |= dict.fromkeys(w for w, n in seen.items() if n > 1)
    return tuple(words)


@lru_cache(maxsize=1)
def _common() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the common words, and the common strings as single code points and pairs."""
    hashes = np.unique(np.array([_word_hash(w) for w in common_words()], np.uint64))
    single = np.array(sorted(ord(s) for s in COMMON_STRINGS if len(s) == 1), np.uint32)
    double = np.array(sorted((ord(s[0]) << 21) + ord(s[1]) for s in COMMON_STRINGS if len(s) > 1), np.uint64)
    return hashes, single, double


def _one_of(codes: np.ndarray, marks: str) -> np.ndarray:
    """Where ``codes`` are among ``marks``."""
    table = np.zeros(_TOP + 1, bool)
    table[[ord(m) for m in marks]] = True
    return table[codes]


def _found(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def _distinct(owner: np.ndarray, values: np.ndarray, owners: int) -> np.ndarray:
    """Distinct ``values`` per owner."""
    _, first = np.unique(_mix(owner, 7) + values, return_index=True)
    return np.bincount(owner[first], minlength=owners)


def count_blocks(texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(text of each block, counts): the counts of all blocks of ``texts``, in their order."""
    kinds, lower = _tables()
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.minimum(raw, _TOP)
    kind = kinds[raw]
    breaks = np.flatnonzero(kind == BREAK)
    starts = np.concatenate(([0], breaks[:-1] + 1))
    lines = len(starts)
    filled = np.add.reduceat((kind < BREAK).view(np.uint8), starts, dtype=np.int64) > 0
    sizes = np.array([len(t) + 1 for t in texts])
    line_text = np.searchsorted(np.cumsum(sizes), starts, side="right")
    letter = (kind >= SPACED) & (kind <= FOURS)
    number = kind == NUMBER

    def begins(mask: np.ndarray) -> np.ndarray:
        return mask & np.concatenate(([True], ~mask[:-1]))

    # The skeleton.
    keep = (~letter & ~number) | begins(letter) | begins(number)
    at = np.flatnonzero(keep)
    s = raw[at]
    s = np.where(letter[at], _A, np.where(number[at], _9, s)).astype(np.uint32)
    line_at = np.searchsorted(starts, at, side="right") - 1
    nl = np.uint32(_NL)
    nxt, nxt2, nxt3, nxt4 = (np.concatenate((s[k:], np.full(k, nl))) for k in (1, 2, 3, 4))
    prv = np.concatenate(([nl], s[:-1]))
    is_a, is_9 = s == _A, s == _9
    blank = kind[at] == WHITE
    gap = blank | (s == _NL)
    next_gap, prev_gap = np.concatenate((gap[1:], [True])), np.concatenate(([True], gap[:-1]))
    next_blank = np.concatenate((blank[1:], [False]))
    next_a, next_9 = nxt == _A, nxt == _9
    prev_a, prev_9 = prv == _A, prv == _9
    ends = _one_of(s, _ENDS)
    # Lines: their first and last visible element, and what stands there.
    shown = np.flatnonzero(~gap)
    first, last, alnum = (np.full(lines, -1, np.int64) for _ in range(3))
    last[line_at[shown]] = shown
    first[line_at[shown[::-1]]] = shown[::-1]
    plain = np.flatnonzero(is_a | is_9)
    alnum[line_at[plain]] = plain
    final_end = np.full(lines, -1, np.int64)
    marks_at = np.flatnonzero(ends)
    final_end[line_at[marks_at]] = marks_at
    here = np.flatnonzero(filled)
    f, z = first[here], last[here]
    ended = final_end[here] > alnum[here]
    opener = _one_of(nxt, "\"'«“¿¡「『《(_[") | next_a
    lead = s[f]
    spaced_on = next_blank[f] & ~gap[np.minimum(f + 2, len(s) - 1)]
    bullet = _one_of(lead, "-*•・+◦▪–☐☑☒") & (spaced_on | opener[f] & (lead != ord("-")))
    box = (lead == ord("[")) & ((nxt[f] == ord("]")) | (nxt2[f] == ord("]")) & ((nxt[f] == _A) | (nxt[f] == 32)))
    point = _one_of(nxt[f], ".):")
    simple = (lead == _9) & point & _is_blank(nxt2[f]) & (nxt3[f] != _9)
    framed = (lead == ord("(")) & (nxt[f] == _9) & (nxt2[f] == ord(")"))
    double = (lead == _9) & (nxt[f] == ord(".")) & (nxt2[f] == _9) & _is_blank(nxt3[f]) & ((nxt4[f] == _A) | (nxt4[f] == ord("_")))
    numbered = simple | framed | double
    # A block ends at a blank line, and where running text meets a list, rows or addresses.
    words_to = np.concatenate(([0], np.cumsum(begins(letter))))
    line_words = np.diff(words_to[np.concatenate((starts, [len(raw)]))])[here]
    pipes_to = np.concatenate(([0], np.cumsum((s == ord("|")) | (s == 9))))
    gaps_to = np.cumsum(gap)
    url = (lead == _A) & (nxt[f] == ord(":")) & (nxt2[f] == ord("/")) & (nxt3[f] == ord("/")) & (gaps_to[z] == gaps_to[f])
    style = np.select([url, bullet | box | numbered, pipes_to[z + 1] - pipes_to[f] > 1], [3, 1, 2], 0)
    running = (style == 0) & ended & (line_words >= 6)
    meets = np.zeros(lines, bool)
    if len(here) > 1:
        turn = (here[1:] == here[:-1] + 1) & (style[1:] != style[:-1]) & (running[1:] | running[:-1])
        meets[here[1:][turn]] = True
    first_line = filled & np.concatenate(([True], ~filled[:-1] | (line_text[1:] != line_text[:-1])))
    opens = first_line | meets
    total = int(opens.sum())
    out: dict[str, np.ndarray] = {}
    if not total:
        return np.zeros(0, int), {k: np.zeros(0, int) for k in _NAMES}
    block_of_line = np.where(filled, np.cumsum(opens) - 1, total)
    owner_text = line_text[opens]
    width = np.diff(np.concatenate((starts, [len(raw)])))
    owner = np.repeat(block_of_line, width).astype(np.int32)
    own, of = owner[at], block_of_line[here]

    def tally(mask_or_places: np.ndarray, owners: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(mask_or_places) if mask_or_places.dtype == bool else mask_or_places
        return np.bincount(owners[places], minlength=total + 1)[:total]

    def lines_with(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=total + 1)[:total]

    # Each block ends with its last visible character; the line end before a turn belongs to what follows it.
    visible = np.flatnonzero(kind < BREAK)
    last_visible = np.zeros(total, np.int64)
    last_visible[owner[visible]] = visible
    joined_on = (meets & ~first_line)[opens].astype(np.int64)
    out["n"] = last_visible - starts[opens] + 1 + joined_on
    out["lines"] = np.bincount(block_of_line, minlength=total + 1)[:total]
    out["letters"], out["digits"] = tally(letter, owner), tally(number, owner)
    inside = np.arange(len(raw)) <= np.append(last_visible, -1)[owner]
    tails = np.zeros(total, np.int64)
    if joined_on.any():
        # Blanks between the last visible character before a turn and its line end.
        turns = np.flatnonzero(joined_on)
        tails[turns] = starts[opens][turns] - 1 - (last_visible[turns - 1] + 1)
        out["n"] = out["n"] + tails
    out["blanks"] = tally((kind >= BREAK) & inside, owner) + joined_on + tails
    runs = tally(begins(kind == SPACED), owner)
    joins = tally(prev_a & next_a & _one_of(s, "'’-"), own)
    out["words"] = np.maximum(runs - joins, 0) + sum(-(-tally(kind == k, owner) // each) for k, each, _ in _UNSPACED)
    next_ends = np.concatenate((ends[1:], [False]))
    out["pipes"], out["tabs"] = tally(s == ord("|"), own), tally(s == 9, own)
    out["commas"] = tally(_one_of(s, ",，、"), own)
    out["semicolons"] = tally((s == ord(";")) & next_blank, own)
    out["slashes"] = tally((s == ord("/")) & prev_gap & next_blank, own)
    out["quotes"] = tally(_one_of(s, '"`'), own)
    out["bangs"] = tally(_one_of(s, "!！"), own)
    out["calls"] = tally(prev_a & _one_of(s, "([{<"), own)
    out["glued"] = tally(prev_a & _one_of(s, ".:/\\@_=") & ((nxt == _A) | (nxt == ord("_")) | (_one_of(nxt, ":/>=") & ((nxt2 == _A) | (nxt2 == ord("_"))))), own)
    out["marks"] = tally(_one_of(s, "{}[]<>=;|\\$&*+#~^%@_"), own)
    separator = _one_of(s, ",;")
    out["tight"] = tally(separator & ~next_gap & ~(prev_9 & next_9), own)
    out["numbers"] = tally(is_9 & (prev_gap | (prv == ord("-"))) & (next_gap | (_one_of(nxt, ".,") & (nxt2 == _9))), own)
    out["mixed"] = tally((is_a & next_9) | (is_9 & next_a), own)
    out["ends"] = tally(ends & ~next_ends & ~next_9 & (next_gap | next_a & (s > 127) | _one_of(nxt, _CLOSERS)), own)
    out["tokens"] = tally(~gap & prev_gap, own)
    out["latin"] = tally((s >= 0x80) & (s <= 0xBF), own)
    out["inner"] = tally(prev_a & next_a & ~gap & ~_one_of(s, ".,:;!?'’‘“”\"«»·_/()-–—…，、。：；？！「」『』（）《》a9"), own)
    out["odd"] = tally(_one_of(s, "¦§¤�~^") | (s >= 0x80) & (s <= 0x9F), own)
    out["dots"] = tally(_one_of(s, "·|>»") & prev_gap & next_blank, own)
    out["gaps"] = tally(blank & next_blank & ~prev_gap & (s == 32), own)
    # Runs of one symbol.
    change = np.concatenate(([True], s[1:] != s[:-1]))
    where = np.flatnonzero(change)
    length = np.diff(np.concatenate((where, [len(s)])))
    long = (length >= 8) & ~is_a[where] & ~is_9[where] & ~gap[where]
    out["rules"] = np.bincount(own[where[long]], weights=length[long], minlength=total + 1)[:total].astype(np.int64)
    dotted = np.flatnonzero((s == ord(".")) & (nxt == ord(".")) & (nxt2 == ord(".")))
    has_dots = np.zeros(lines, bool)
    has_dots[line_at[dotted]] = True
    out["leaders"] = lines_with(has_dots[here] & (s[z] == _9))
    out["urls"] = lines_with(url)
    out["ended"], out["bullets"], out["numbered"] = lines_with(ended), lines_with(bullet | box), lines_with(numbered)
    out["closed"] = lines_with(_one_of(s[z], ";{}>\\(["))
    out["signs"] = lines_with(_one_of(lead, "%#/@.\\$}<{&"))
    begin = starts[here]
    out["indents"] = lines_with((raw[begin] == 9) | (raw[begin] == 32) & (raw[np.minimum(begin + 1, len(raw) - 1)] == 32))
    # Keys: what stands before the first colon or sign of equality of a line.
    ends_to = np.concatenate(([0], np.cumsum(ends & (s != ord(";")))))

    def first_of(mask: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(mask)[::-1]
        found = np.full(lines, -1, np.int64)
        found[line_at[places]] = places
        return found[here]

    colon = first_of((s == ord(":")) & next_gap)
    clear = (colon >= 0) & (colon > f) & (colon - f <= 14)
    out["keyed"] = lines_with(clear & (ends_to[np.maximum(colon, 0)] == ends_to[f]) & (colon < z))
    equal = first_of((s == ord("=")) & prev_gap & next_gap)
    out["assigned"] = lines_with((equal > f) & (equal - f <= 16))
    # Words: hashes of the runs of letters.
    places = np.flatnonzero(letter)
    new = np.concatenate(([True], np.diff(places) > 1)) if len(places) else np.zeros(0, bool)
    word_first = np.flatnonzero(new)
    if len(places):
        index = np.cumsum(new) - 1
        hashes = np.add.reduceat(_mix(lower[raw[places]], np.arange(len(places)) - word_first[index]), word_first)
        word_at = places[word_first]
        word_owner = owner[word_at]
        hard = np.zeros(_TOP + 1, bool)
        hard[[ord(c) for c in "bcdfghjklmnpqrstvwxz"]] = True
        soft = np.add.reduceat((~hard[lower[raw[places]]]).view(np.uint8), word_first, dtype=np.int64)
        long_enough = np.diff(np.concatenate((word_first, [len(places)]))) >= 3
        out["vowelless"] = tally(word_at[(soft == 0) & long_enough], owner)
        consonant = hard[lower[raw[places]]]
        turn = np.flatnonzero(np.concatenate(([True], (consonant[1:] != consonant[:-1]) | new[1:])))
        run = np.diff(np.concatenate((turn, [len(places)])))
        out["clusters"] = tally(places[turn[consonant[turn] & (run >= 5)]], owner)
        # Parts: what stands between end marks and line ends; equal words make equal parts.
        marks = np.sort(np.concatenate((at[marks_at], breaks)))
        part = np.searchsorted(marks, word_at)
        part_first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        parts = np.add.reduceat(_mix(hashes, np.arange(len(hashes)) - part_first[np.cumsum(np.concatenate(([True], part[1:] != part[:-1]))) - 1]), part_first)
        out["parts"] = tally(word_at[part_first], owner)
        out["distinct_parts"] = _distinct(word_owner[part_first], parts, total + 1)[:total]
    else:
        hashes, word_at, word_owner = np.zeros(0, np.uint64), places, places
        out |= {k: np.zeros(total, int) for k in ("vowelless", "clusters", "parts", "distinct_parts")}
    known, single, double_ = _common()
    out["terms"] = tally(word_at, owner)
    out["distinct_terms"] = _distinct(word_owner, hashes, total + 1)[:total]
    out["common"] = np.bincount(word_owner[_found(hashes, known)], minlength=total + 1)[:total]
    foreign = np.flatnonzero((kind == PAIRED) | (kind == FOURS))
    if len(foreign):
        codes = raw[foreign]
        pairs = (codes.astype(np.uint64) << np.uint64(21)) + raw[np.minimum(foreign + 1, len(raw) - 1)]
        out["common"] = out["common"] + tally(foreign[_found(codes, single) | _found(pairs, double_)], owner)
    sep = first_of((s == ord(":")) | (s == ord("=")))
    with_key = (sep > f) & (sep - f <= 14)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
    a, b = np.searchsorted(word_at, begin[with_key]), np.searchsorted(word_at, at[sep[with_key]])
    out["keys"] = lines_with(with_key)
    out["distinct_keys"] = _distinct(of[with_key], upto[b] - upto[a], total + 1)[:total] if with_key.any() else np.zeros(total, int)
    # Lines alike: by their skeleton without blanks and leaders, and by their separators.
    solid = ~gap & ~((s == ord(".")) & (prv == ord(".")))
    order = np.cumsum(solid)
    offset = order - order[np.maximum(np.searchsorted(line_at, np.arange(lines)), 0).clip(max=len(s) - 1)][line_at]
    sums = np.zeros(lines, np.uint64)
    chosen = np.flatnonzero(solid)
    _add(sums, line_at[chosen], _mix(s[chosen], offset[chosen]))
    out["distinct_lines"] = _distinct(of, sums[here], total + 1)[:total]
    cells = np.zeros(lines, np.uint64)
    chosen = np.flatnonzero(_one_of(s, ",;|\t"))
    _add(cells, line_at[chosen], _mix(s[chosen]))
    out["distinct_cells"] = _distinct(of, cells[here], total + 1)[:total]
    # Tags, and those of tables among them.
    tag = np.flatnonzero((raw[:-2] == ord("<")) & (((kind[1:-1] == SPACED)) | (raw[1:-1] == ord("/")) & (kind[2:] == SPACED))) if len(raw) > 2 else np.zeros(0, int)
    name = np.where(raw[np.minimum(tag + 1, len(raw) - 1)] == ord("/"), tag + 2, tag + 1)
    one, two, three = (lower[raw[np.minimum(name + k, len(raw) - 1)]] for k in range(3))
    cell = (one == ord("t")) & (_one_of(two, "drh")) & ~((three >= ord("a")) & (three <= ord("z")))
    table = (one == ord("t")) & _one_of(two, "ab") | cell
    out["cells"] = tally(tag[cell & (name == tag + 1)], owner)
    out["tags"] = tally(tag[~table], owner)
    return owner_text, out


_NAMES = tuple(dict.fromkeys([*STATISTICS, *(x for pair in RATIOS.values() for x in pair), "terms", "distinct_terms"]))


def _is_blank(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | (codes == 9) | (codes == 0xA0) | (codes == 0x3000)


def _add(sums: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    """Add ``values``, which are ordered by owner, to ``sums``."""
    if len(owner):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sums[owner[first]] = np.add.reduceat(values, first)


def figure(counts: dict[str, np.ndarray], name: str) -> np.ndarray:
    """A feature of all blocks; a ratio to nothing is 0."""
    if name in RATIOS:
        a, b = (counts[k].astype(float) for k in RATIOS[name])
        return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    if name == "separators_end":
        return (counts["commas"] + counts["semicolons"] + counts["slashes"]) / (counts["ends"] + 1.0)
    if name == "variety":
        # Guiraud's index: unlike a share of distinct words it falls only slowly with length.
        return counts["distinct_terms"] / np.sqrt(np.maximum(counts["terms"], 1))
    return counts[name].astype(float)
