"""References to records that do not exist.

The references are grouped by the null mask of their composite key; each mask is anti-joined with the
targets on its non-null columns, under declared match semantics. References whose key exists are then
tested against the spans in which the target is valid by a two-level running sum, so neither a hot key
nor a long history ever becomes one task or a quadratic join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.session import cut

#: SIMPLE: a key with any null is no reference. FULL: all null is no reference, partly null is an orphan.
#: PARTIAL: all null is no reference, partly null must match on its non-null columns.
MATCHES = ("simple", "full", "partial")

#: Java's White_Space property: blanks, tabs, line ends, no-break, ideographic and other Unicode spaces.
WHITE_SPACE = r"\p{IsWhite_Space}+"


def plain_key(column: Column | str) -> Column:
    """Key text without letter case or white space of any kind; blank keys become null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, WHITE_SPACE, "")), F.lit(""))


def _uncovered(refs: DataFrame, spans: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, month) of references at whose time no span of their key is open. Linear in both inputs.

    Events are summed per (key, moment), then per (key, hour) for the number of spans open at the start of
    each hour; within an hour a running sum goes on from there. A hot key is thus split by hour. Events are
    brought together by key and hour once, which serves both sums.
    """
    begin = spans.select(*cols, F.col("__from").alias("__t"), F.lit(1).cast("long").alias("__d"))
    end = spans.filter(F.col("__to").isNotNull()).select(*cols, F.col("__to").alias("__t"), F.lit(-1).cast("long").alias("__d"))
    events = (
        refs.select(*cols, "__t", F.lit(0).cast("long").alias("__d"), F.lit(True).alias("__ref"))
        .unionByName(begin.unionByName(end).withColumn("__ref", F.lit(False)))
        .withColumn("__hour", F.date_trunc("hour", "__t"))
        .repartition(*cols, "__hour")
        .groupBy(*cols, "__hour", "__t")
        .agg(F.sum("__d").alias("__d"), F.max("__ref").alias("__ref"))
    )
    before = Window.partitionBy(*cols).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = events.groupBy(*cols, "__hour").agg(F.sum("__d").alias("__net"), F.max("__ref").alias("__any"))
    hours = hours.select(*cols, "__hour", "__any", F.coalesce(F.sum("__net").over(before), F.lit(0)).alias("__open")).filter("__any").drop("__any")
    within = Window.partitionBy(*cols, "__hour").orderBy("__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        events.join(hours, [*cols, "__hour"])
        .withColumn("__now", F.col("__open") + F.sum("__d").over(within))
        .filter(F.col("__ref") & (F.col("__now") <= 0))
        .select(*cols, F.date_format("__t", "yyyy-MM").alias("ref_month"))
    )


def _asks(held: list[tuple[str, str]], required: Sequence[str], match: str) -> Column:
    """Whether a row is a reference at all: by its required columns, and by the nulls of its key."""
    there = [F.col(a).isNotNull() for a, _ in held]
    asks = reduce(Column.__and__ if match == "simple" else Column.__or__, there)
    return reduce(Column.__and__, [c for c, (_, k) in zip(there, held) if k in required], asks)


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    *,
    ref_time: str,
    valid_from: str,
    valid_to: str,
    match: str = "simple",
    required: Sequence[str] = (),
) -> DataFrame:
    """Distinct (``keys``..., ``ref_month``) with a reference to no target valid at its time.

    ``refs`` and ``targets`` both hold the columns ``keys`` in one spelling (see ``plain_key``); other
    columns are ignored, whatever their names. A target is valid from ``valid_from`` until before ``valid_to``.

    Defined cases: null ``valid_from``: valid since ever; null ``valid_to``: still valid; a span that ends
    before it begins is never valid; several or overlapping spans of a key add up; repeated rows count once;
    a null in a ``required`` column: no reference; other nulls by ``match`` (see ``MATCHES``); a reference
    without time is an orphan (month null) only if its key never existed; either table may be empty.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    keys = list(keys)
    ever = F.to_timestamp(F.lit("0001-01-01 00:00:00")).cast("timestamp_ntz")
    held = [(f"__k{i}", k) for i, k in enumerate(keys)]
    bit = [F.when(F.col(a).isNull(), 1 << i).otherwise(0) for i, (a, _) in enumerate(held)]
    # Each side is read once; the null masks that occur are the only ones planned.
    refs = cut(refs.select(*[F.col(k).alias(a) for a, k in held], F.col(ref_time).cast("timestamp_ntz").alias("__t")).filter(_asks(held, required, match)).withColumn("__mask", reduce(Column.__add__, bit)).distinct())
    spans = cut(
        targets.select(
            *[F.col(k).alias(a) for a, k in held],
            F.coalesce(F.col(valid_from).cast("timestamp_ntz"), ever).alias("__from"),
            F.col(valid_to).cast("timestamp_ntz").alias("__to"),
        ).filter(F.col("__to").isNull() | (F.col("__to") > F.col("__from")))
    )
    masks = sorted(r[0] for r in refs.select("__mask").distinct().collect())  # at most 2 ** len(keys) numbers
    parts = []
    for mask in masks:
        null = [bool(mask >> i & 1) for i in range(len(keys))]
        there = [a for (a, _), n in zip(held, null) if not n]
        group = refs.filter(F.col("__mask") == mask)
        months = group.select(*there, F.date_format("__t", "yyyy-MM").alias("ref_month")).distinct()
        if mask and match == "full":
            found = months
        else:
            own = spans.select(*there, "__from", "__to").filter(reduce(Column.__and__, [F.col(a).isNotNull() for a in there]))
            known = own.select(*there).distinct()
            never = months.join(known, there, "left_anti")
            timed = group.filter(F.col("__t").isNotNull()).select(*there, "__t").join(known, there, "left_semi")
            found = never.unionByName(_uncovered(timed, own, there))
        parts.append(found.select(*[(F.lit(None).cast(refs.schema[a].dataType) if n else F.col(a)).alias(k) for (a, k), n in zip(held, null)], "ref_month"))
    if not parts:
        return refs.select(*[F.col(a).alias(k) for a, k in held], F.date_format("__t", "yyyy-MM").alias("ref_month")).limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()
