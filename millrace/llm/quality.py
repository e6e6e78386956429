"""Per-document text quality statistics, and which documents are not natural prose.

Ordered rule lists are induced by incremental reduced-error pruning on labelled blocks of text. Their learned
thresholds are exported as SQL CASE expressions, which Spark applies natively, block by block within a row:
no shuffle touches the documents. Three lists vote. The statistics come in Arrow batches from ``quality_counts``, which counts
all blocks of a batch at once; only those that the rules name leave the worker. (Counted by regular expressions
in the JVM they took seven times the CPU time.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.quality_counts import FEATURES, STATISTICS, count_blocks, figure
from millrace.llm.quality_rules import RULES
from millrace.llm.quality_seeds import labelled
from millrace.plans.session import ship

KINDS = ("junk", "table", "list")
#: Characters counted at once; a longer text is counted in parts that end at blank lines.
SLICE = 250_000


@dataclass(frozen=True)
class Rule:
    """A kind and its conditions (feature, over, threshold): all must hold."""

    kind: str
    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        """Which rows of features (in the order of ``FEATURES``) the rule takes."""
        columns = [(x[:, FEATURES.index(f)], up, v) for f, up, v in self.conditions]
        return reduce(np.logical_and, [c > v if up else c <= v for c, up, v in columns], np.ones(len(x), bool))

    def sql(self, c: Column) -> Column:
        return reduce(Column.__and__, [c[f"f_{f}"] > v if up else c[f"f_{f}"] <= v for f, up, v in self.conditions])


def _best(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The condition of the greatest information gain for the positives of ``y`` (FOIL's)."""
    p0, n0 = y.sum(), (~y).sum()
    base = np.log2(p0 / (p0 + n0))
    found: tuple[float, tuple[str, bool, float] | None] = (1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        total = np.arange(1, len(v) + 1)
        for up, p, t in ((False, pos[cuts], total[cuts]), (True, p0 - pos[cuts], len(v) - total[cuts])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > found[0]:
                found = (float(gain[k]), (FEATURES[f], up, float(f"{(v[cuts[k]] + v[cuts[k] + 1]) / 2:.6g}")))
    return found


def apply_rules(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """The kinds of rows of features, as the CASE expression gives them."""
    out = np.full(len(x), "prose", dtype=object)
    for rule in reversed(rules):
        out[rule.covers(x)] = rule.kind
    return out


def induce(x: np.ndarray, labels: np.ndarray, *, seed: int = 3, most_rules: int = 40, attempts: int = 6, precise: float = 0.85) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning; what no rule covers is prose.

    Kinds are learned in the order of ``KINDS``, each against those not yet covered. A rule is grown on two
    thirds of the rows until it covers no negative, pruned on the rest by (p - n) / (p + n), and kept if
    that is over ``precise`` there (prose is most of any corpus, so rules that take some of it cost more than
    they find); a kind is done after ``attempts`` splits in a row without one.
    """
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), bool)
    for kind in KINDS:
        failed = 0
        while failed < attempts and sum(r.kind == kind for r in rules) < most_rules:
            rows = np.flatnonzero(left)
            y = labels[rows] == kind
            if y.sum() < 3:
                break
            grow = rng.random(len(rows)) < 2 / 3
            gx, gy, px, py = x[rows[grow]], y[grow], x[rows[~grow]], y[~grow]
            conditions: list[tuple[str, bool, float]] = []
            mask = np.ones(len(gx), bool)
            while gy[mask].any() and (~gy[mask]).any() and len(conditions) < 8:
                _, c = _best(gx[mask], gy[mask])
                if c is None:
                    break
                conditions.append(c)
                mask &= Rule(kind, (c,)).covers(gx)
            if not conditions:
                break

            def worth(k: int) -> float:
                hit = Rule(kind, tuple(conditions[:k])).covers(px)
                p, n = (hit & py).sum(), (hit & ~py).sum()
                return (p - n) / (p + n) if p + n else -1.0

            best = max(range(len(conditions), 0, -1), key=worth)
            if worth(best) <= precise:
                failed += 1
                continue
            failed = 0
            rule = Rule(kind, tuple(conditions[:best]))
            rules.append(rule)
            left[rows] &= ~rule.covers(x[rows])
    return rules


def table_of(blocks_of_text: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features, in the order of ``FEATURES``, and labels of (label, block)."""
    owner, counts = count_blocks([block for _, block in blocks_of_text])
    x = np.column_stack([figure(counts, f) for f in FEATURES])
    return x, np.array([label for label, _ in blocks_of_text], dtype=object)[owner]


def apply_lists(lists: list[list[Rule]], x: np.ndarray) -> np.ndarray:
    """The kinds by the vote of several rule lists; of a tie the first of prose, junk, table, list."""
    kinds = np.array(("prose", *KINDS), dtype=object)
    votes = sum(np.stack([apply_rules(rules, x) == k for k in kinds], axis=1).astype(int) for rules in lists)
    return kinds[votes.argmax(axis=1)]


def learn(*, labelled_blocks: int = 60000, seed: int = 11, lists: int = 8, kept: int = 3) -> list[list[Rule]]:
    """The rule lists learned from ``labelled_blocks`` labelled blocks (a fixed bound, whatever the data's size).

    ``lists`` ordered rule lists are induced on three quarters of the blocks, each with splits of its own into
    blocks to grow and to prune on; the ``kept`` best on the rest vote. (A single list is as good on blocks of
    the same making, but errs more on texts of other origin.)
    """
    x, y = table_of(labelled(labelled_blocks, seed))
    held = np.random.default_rng(seed).random(len(x)) < 0.25
    found = [induce(x[~held], y[~held], seed=k) for k in range(lists)]
    return sorted(found, key=lambda rules: -(apply_rules(rules, x[held]) == y[held]).mean())[:kept]


def rule_lists() -> list[list[Rule]]:
    """The rule lists that ``python -m millrace.llm.quality_learn`` has written."""
    return [[Rule(kind, tuple((f, sign == ">", v) for f, sign, v in conditions)) for kind, conditions in rules] for rules in RULES]


def _parts(text: str) -> list[str]:
    """``text`` with plain line ends, in parts of about ``SLICE`` characters that end at blank lines."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts, at = [], 0
    while len(text) - at > 2 * SLICE and (cut := text.find("\n\n", at + SLICE)) >= 0:
        parts.append(text[at:cut])
        at = cut
    parts.append(text[at:])
    return parts


def _judged(texts: list[str | None], features: list[str]) -> pa.Array:
    """One list of structs (statistics, features) per text: its blocks in order."""
    parts = [(k, part) for k, text in enumerate(texts) if text for part in _parts(text)]
    owners, columns, at = [], [], 0
    while at < len(parts):
        upto, size = at, 0
        while upto < len(parts) and size < SLICE:
            size, upto = size + len(parts[upto][1]), upto + 1
        owner, counts = count_blocks([part for _, part in parts[at:upto]])
        owners.append(np.array([k for k, _ in parts[at:upto]], dtype=np.int64)[owner])
        columns.append([counts[c].astype(np.int32) for c in STATISTICS] + [figure(counts, f) for f in features])
        at = upto
    names = [*STATISTICS, *[f"f_{f}" for f in features]]
    if not columns:
        kinds = [pa.int32()] * len(STATISTICS) + [pa.float64()] * len(features)
        blocks = pa.StructArray.from_arrays([pa.array([], k) for k in kinds], names)
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), blocks)
    per_text = np.bincount(np.concatenate(owners), minlength=len(texts))
    offsets = np.concatenate(([0], np.cumsum(per_text))).astype(np.int32)
    blocks = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns)], names)
    return pa.ListArray.from_arrays(pa.array(offsets), blocks)


def kind_of(rules: list[Rule], c: Column) -> Column:
    """The CASE expression of the rules over a struct of features."""
    out = F
    for rule in rules:
        out = out.when(rule.sql(c), rule.kind)
    return out.otherwise("prose") if rules else F.lit("prose")


def voted_kind(lists: list[list[Rule]], c: Column) -> Column:
    """The kind for which most rule lists' CASE expressions vote; of a tie the first of prose, junk, table, list."""

    def most(votes: Column) -> Column:
        def count(kind: str) -> Column:
            return F.size(F.filter(votes, lambda v: v == kind))

        n = {k: count(k) for k in ("prose", *KINDS)}
        return F.when(n["prose"] >= F.greatest(n["junk"], n["table"], n["list"]), "prose").when(n["junk"] >= F.greatest(n["table"], n["list"]), "junk").when(n["table"] >= n["list"], "table").otherwise("list")

    return F.transform(F.array(F.array(*[kind_of(rules, c) for rules in lists])), most)[0]


def text_quality(docs: DataFrame, doc: str, text: str, lists: list[list[Rule]] | None = None) -> DataFrame:
    """Statistics per row: ``doc``, n_chars, n_lines, n_words, mean_word_length, symbol_ratio,
    ended_line_share, common_word_share, prose_share, list_share, table_share, junk_share, text_kind.

    ``text_kind`` is prose, or the largest other kind where more than half of the characters are not prose.

    Defined cases: null and blank texts have zero counts, null ratios and a null kind; of kinds of equal size
    the first of junk, table, list holds; repeated rows come out once per row; texts are read whole; other
    columns are ignored, whatever their names.
    """
    lists = rule_lists() if lists is None else lists
    features = list(dict.fromkeys(f for rules in lists for rule in rules for f, _, _ in rule.conditions))
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _judged(batch.column(1).to_pylist(), features)], names=["__d", "b"])

    kind = docs.schema[doc].dataType.simpleString()
    fields = ", ".join([f"{c}: int" for c in STATISTICS] + [f"f_{f}: double" for f in features])
    counted = docs.select(F.col(doc).alias("__d"), F.col(text).alias("__t")).mapInArrow(count, f"__d {kind}, b array<struct<{fields}>>")
    judged = F.transform("b", lambda c: F.struct(voted_kind(lists, c).alias("kind"), *[c[s].alias(s) for s in STATISTICS]))
    # The one-element explode keeps filters on the result from being pushed below, where they would judge every block again.
    rows = counted.select("__d", F.explode(F.array(judged)).alias("b"))

    def total(name: str, kind: str | None = None) -> Column:
        some = F.col("b") if kind is None else F.filter("b", lambda s: s.kind == kind)
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, s: a + s[name])

    n, words = total("n"), total("words")
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    sums = rows.select(
        "__d",
        n.alias("n_chars"),
        total("lines").alias("n_lines"),
        words.alias("n_words"),
        total("letters").alias("letters"),
        (n - total("letters") - total("digits") - total("blanks")).alias("symbols"),
        total("ended").alias("ended"),
        total("common").alias("common"),
        *[total("n", k).alias(k) for k in ("prose", *KINDS)],
    )
    other = F.greatest(*KINDS)
    return sums.select(
        F.col("__d").alias(doc),
        "n_chars",
        "n_lines",
        "n_words",
        share(F.col("letters"), F.col("n_words")).alias("mean_word_length"),
        share(F.col("symbols"), F.col("n_chars")).alias("symbol_ratio"),
        share(F.col("ended"), F.col("n_lines")).alias("ended_line_share"),
        share(F.col("common"), F.col("n_words")).alias("common_word_share"),
        *[share(F.col(k), F.col("n_chars")).alias(f"{k}_share") for k in ("prose", "list", "table", "junk")],
        F.when(F.col("n_chars") == 0, None)
        .when(2 * F.col("prose") >= F.col("n_chars"), "prose")
        .when(F.col("junk") == other, "junk")
        .when(F.col("table") == other, "table")
        .otherwise("list")
        .alias("text_kind"),
    )
