"""Splitting oversized items at natural boundaries, by pointer doubling.

Every boundary of an item is joined to its farthest legal successor, overlap included. That table is then
squared again and again (successor of the successor) while the set of boundaries reached from the start
doubles, which gives all cuts of the greedy walk in as many rounds as the logarithm of the pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.sentences import Model, sentence_spans
from millrace.plans.session import cut, ship

#: Kinds of boundary, the more natural the higher.
FORCED, WORD, SENTENCE, LINE, PARAGRAPH, END = 1, 2, 3, 4, 5, 6
KIND_NAMES = {FORCED: "forced", WORD: "word", SENTENCE: "sentence", LINE: "line", PARAGRAPH: "paragraph", END: "end"}

_CLOSERS = r"[\"'”’»›」』）)\]}】》〉]*"
# An end mark of a script that writes no blank after it, or a common one before a blank or such a script.
_STRONG = re.compile(
    r"(?P<par>\r?\n[^\S\n]*\r?\n\s*)|(?P<line>\r?\n\s*)"
    rf"|(?P<end>(?:[。！？｡．।॥։؟۔።፧…]+{_CLOSERS}|[.!?]+{_CLOSERS}(?=[^\S\n]|[぀-ヿ㐀-鿿가-힯]))[^\S\n]*+(?!\r?\n))"
)
_MARKS = "。！？｡．।॥։؟۔።፧….!?"
_WORD = re.compile(r"\s+")
_BLANKS = re.compile(r"\s*")


def boundaries(text: str, limit: int, overlap: int, sentence_ends: Sequence[int] | None = None) -> tuple[list[int], list[int]]:
    """Positions (after any white space) and kinds at which ``text`` may be cut, with 0 and its end.

    Sentences end at ``sentence_ends`` if given, else at end marks.

    Words count only in gaps wider than the overlap. Within a stretch over ``limit`` characters that has
    neither white space nor a sentence end, forced boundaries stand ``limit - overlap`` apart.
    """
    size, kinds = len(text), {}
    for m in _STRONG.finditer(text):
        if sentence_ends is None or m.lastgroup != "end":
            kinds[m.end()] = max(kinds.get(m.end(), 0), PARAGRAPH if m.lastgroup == "par" else LINE if m.lastgroup == "line" else SENTENCE)
    for end in sentence_ends or ():
        kinds.setdefault(_BLANKS.match(text, end).end(), SENTENCE)
    kinds.pop(0, None)
    kinds[size] = END
    before = 0
    for here in sorted(kinds):
        if here - before > overlap:
            for m in _WORD.finditer(text, before, here):
                if before < m.end() < here:
                    kinds.setdefault(m.end(), WORD)
                if m.end() - m.start() > 16 and m.start() > before:
                    kinds.setdefault(m.start(), WORD)
        before = here
    step, before, grid = limit - overlap, 0, {}
    for here in sorted(kinds):
        if here - before > step:
            blank = _WORD.search(text, before, here)
            edge = blank.start() if blank else here
            solid = edge
            while solid > before and text[solid - 1] in _MARKS:
                solid -= 1
            forced, points = solid - before > limit, []
            if forced:
                points += range(before + step, edge, step)
            elif edge - before > limit:
                points.append(solid if solid > before else before + step)
            # From a point inside the gap the next is no farther than a step, so that a walk never sticks.
            if here - (points[-1] if points else before) > (step if points else limit) and (points[-1] if points else before) < edge < here:
                points.append(edge)
            while here - (points[-1] if points else before) > (step if points else limit):
                points.append((points[-1] if points else before) + step)
            grid.update({p: FORCED if forced and p < solid else WORD for p in points})
        before = here
    for p, kind in grid.items():
        kinds.setdefault(p, kind)
    at = [0, *sorted(kinds)]
    return at, [END, *[kinds[p] for p in at[1:]]]


def _last(value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window)


def _successors(nodes: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(item, pos, start, next): the piece after a cut at ``pos`` runs from ``start`` to ``next``.

    Of the ends within the limit the most natural kind wins whose farthest leaves the piece at least half
    full, else the farthest of all; where only a forced end is in reach, the overlap is given up before a
    forced end is taken. Two sorted passes, no join of ranges.
    """
    none = F.lit(None)
    here = nodes.filter(F.col("kind") < END).unionByName(nodes.filter((F.col("kind") == END) & (F.col("pos") == 0)))
    # The start of the next piece: the first sentence, else word, in the stretch of text that may be shared.
    asked = here.select("item", (F.col("pos") - overlap).alias("at"), F.lit(1).alias("ask"), "pos", "kind", "size")
    given = nodes.select("item", F.col("pos").alias("at"), F.lit(0).alias("ask"), "pos", "kind", "size")
    back = Window.partitionBy("item").orderBy(F.desc("at"), "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    node = F.col("ask") == 0
    start = F.coalesce(
        F.when(F.col("pos") == 0, F.lit(0)),
        F.when(F.col("s") < F.col("pos"), F.col("s")),
        F.when(F.col("w") < F.col("pos"), F.col("w")),
        F.when(F.col("kind") == FORCED, F.greatest(F.col("pos") - overlap, F.lit(0))),
        F.col("pos"),
    )
    started = (
        asked.unionByName(given)
        .withColumn("s", _last(F.when(node & (F.col("kind") >= SENTENCE), F.col("at")), back))
        .withColumn("w", _last(F.when(node & (F.col("kind") >= WORD), F.col("at")), back))
        .filter(~node)
        .select("item", "pos", "size", start.alias("start"), ((F.col("kind") == FORCED) & (start < F.col("pos"))).alias("inside"))
    )
    # The farthest boundary of each kind within the limit, with the overlap (ask 1) and without (ask 2).
    asked = started.select(
        "item", "pos", "size", "start", "inside", F.explode(F.array(F.struct(F.lit(1).alias("ask"), F.col("start").alias("s0")), F.struct(F.lit(2).alias("ask"), F.col("pos").alias("s0")))).alias("q")
    ).select("item", (F.col("q.s0") + limit).alias("at"), "q.ask", "pos", none.cast("int").alias("kind"), "start", "inside", "size")
    given = nodes.select("item", F.col("pos").alias("at"), F.lit(0).alias("ask"), "pos", "kind", none.cast("int").alias("start"), none.cast("boolean").alias("inside"), "size")
    ahead = Window.partitionBy("item").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = asked.unionByName(given)
    for name, kind in (("f5", PARAGRAPH), ("f4", LINE), ("f3", SENTENCE), ("f2", WORD), ("f1", FORCED)):
        far = far.withColumn(name, _last(F.when(node & (F.col("kind") >= kind), F.col("at")), ahead))
    s0 = F.when(F.col("ask") == 1, F.col("start")).otherwise(F.col("pos"))
    full = [F.when((F.col(f) > F.col("pos")) & (F.col(f) - s0 >= limit // 2), F.col(f)) for f in ("f5", "f4", "f3", "f2")]
    natural = F.coalesce(F.when(F.col("size") - s0 <= limit, F.col("size")), *full, F.when(F.col("f2") > F.col("pos"), F.col("f2")))
    far = far.filter(F.col("ask") > 0).withColumn("n", natural)
    pick = lambda ask, c: F.max(F.when(F.col("ask") == ask, F.col(c)))
    # Before a forced end only a forced cut shares text: a piece never holds the whole of the one before.
    lapped = F.col("n1").isNotNull() | (F.col("n2").isNull() & F.col("inside"))
    return (
        far.groupBy("item", "pos", "size", "start", "inside")
        .agg(pick(1, "n").alias("n1"), pick(2, "n").alias("n2"), pick(1, "f1").alias("f"), pick(2, "f1").alias("g"))
        .select("item", "pos", "size", F.when(lapped, F.col("start")).otherwise(F.col("pos")).alias("start"), F.coalesce("n1", "n2", F.when(F.col("inside"), F.col("f")), "g").alias("next"))
        .withColumn("next", F.when(F.col("next") > F.col("pos"), F.col("next")).otherwise(F.raise_error(F.lit("a piece without an end")).cast("int")))
    )


def piece_spans(items: DataFrame, text: str, *, limit: int, overlap: int, model: Model | None = None) -> DataFrame:
    """(item, piece_no, start_pos, end_pos, cut_kind) for the texts of ``items`` (item, ``text``) over ``limit`` characters."""
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be at least 0 and less than half the limit")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [boundaries(t, limit, overlap, None if model is None else [e for _, e in sentence_spans(t, model)]) for t in batch["text"]]
            yield pd.DataFrame({"item": batch["item"], "size": [len(t) for t in batch["text"]], "at": [b[0] for b in both], "kinds": [b[1] for b in both]})

    ship(items.sparkSession)
    over = items.select("item", F.col(text).alias("text")).filter(F.length("text") > limit)
    nodes = cut(
        over.mapInPandas(found, "item string, size int, at array<int>, kinds array<int>")
        .select("item", "size", F.explode(F.arrays_zip("at", "kinds")).alias("b"))
        .select("item", "size", F.col("b.at").alias("pos"), F.col("b.kinds").alias("kind"))
        .distinct()
    )
    succ = cut(_successors(nodes, limit, overlap))
    jump = succ.select("item", "size", "pos", "next")
    reached = cut(succ.filter(F.col("pos") == 0).select("item", F.col("pos")))
    count = reached.count()
    # No bound on the pieces is assumed: the doubling ends when no walk is left inside its text.
    while count:
        moved = reached.join(jump, ["item", "pos"]).filter(F.col("next") < F.col("size")).select("item", F.col("next").alias("pos"))
        reached = cut(reached.unionByName(moved))
        before, count = count, reached.count()
        if count == before:
            break
        ahead = jump.select("item", F.col("pos").alias("next"), F.col("next").alias("then"))
        # Walks that have ended drop out: the next table holds only jumps that still land inside the text.
        jump = cut(jump.join(ahead, ["item", "next"]).select("item", "size", "pos", F.col("then").alias("next")))
    walk = Window.partitionBy("item").orderBy("pos")
    kinds = nodes.select("item", F.col("pos").alias("next"), "kind")
    short = F.lead("pos").over(walk).isNull() & (F.col("next") != F.col("size"))
    return (
        reached.join(succ, ["item", "pos"])
        .withColumn("piece_no", F.row_number().over(walk))
        .withColumn("next", F.when(short, F.raise_error(F.lit("the pieces end before their text")).cast("int")).otherwise(F.col("next")))
        .join(kinds, ["item", "next"])
        .select("item", "piece_no", F.col("start").alias("start_pos"), F.col("next").alias("end_pos"), F.col("kind").alias("cut_kind"))
    )


def split_oversized(
    items: DataFrame, ids: Sequence[str], text: str, *, limit_tokens: int = 512, overlap_tokens: int = 64, chars_per_token: int = 4, texts: bool = True, model: Model | None = None
) -> DataFrame:
    """``ids``..., piece_no, start_pos, end_pos, cut_kind and, if ``texts``, piece_text of every item over the limit.

    ``limit_tokens`` and ``overlap_tokens`` are estimates of ``chars_per_token`` characters each, rounded up.
    With ``model`` sentences are the units of ``llm.sentences``, else what end marks end.
    ``cut_kind`` names what ends a piece: paragraph, line, sentence, word, forced or end. Pieces cover the
    text in order; neighbours share at most the overlap; no piece is over the limit.

    Defined cases: null, empty and short texts have no pieces (they are under the limit); repeated rows give
    their pieces once per row; items of equal ids and different texts are split each on its own; ids may be
    null; other columns are ignored, whatever their names.
    """
    limit, overlap = limit_tokens * chars_per_token, overlap_tokens * chars_per_token
    held = [f"__i{n}" for n in range(len(ids))]
    key = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(h).cast("string")), F.lit("n")) for h in held], F.col("__text")))
    keyed = items.select(*[F.col(i).alias(h) for i, h in zip(ids, held)], F.col(text).alias("__text")).filter(F.length("__text") > limit).withColumn("item", key)
    spans = piece_spans(keyed.select("item", "__text"), "__text", limit=limit, overlap=overlap, model=model)
    name = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    rows = (keyed if texts else keyed.drop("__text")).join(spans, "item")
    return rows.select(
        *[F.col(h).alias(i) for i, h in zip(ids, held)],
        "piece_no",
        "start_pos",
        "end_pos",
        name[F.col("cut_kind")].alias("cut_kind"),
        *([F.substring("__text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("piece_text")] if texts else []),
    )
