"""Packing ordered units into token-bounded chunks, with lineage.

A unit belongs to chunk ``floor(tokens before it / step)`` of its partition: a soft cap without lookahead,
which a running sum decides. The sum is taken in two levels over order ranges and the numbering in two
levels over chunks, so a partition that holds a third of all units is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import chunk_fn_fingerprint
from millrace.functions.text import estimate_tokens, ordered, ordered_text
from millrace.plans.config import EngineConfig
from millrace.plans.session import cut

#: Chunks per second-level group of numbering.
GROUP = 1024


def check_sizes(target_tokens: int, overlap_tokens: int) -> None:
    if target_tokens <= 0:
        raise ValueError("chunk: target_tokens must be positive")
    if overlap_tokens < 0 or overlap_tokens >= target_tokens:
        raise ValueError("chunk: overlap_tokens must be at least 0 and below target_tokens")
    if overlap_tokens and 2 * overlap_tokens >= target_tokens:
        raise ValueError("chunk: twice overlap_tokens must be below target_tokens")


def unit_text(text: Column, label: Column | None) -> Column:
    body = F.coalesce(text, F.lit(""))
    return body if label is None else F.concat(F.coalesce(label, F.lit("")), F.lit(": "), body)


def _ranged(units: DataFrame) -> DataFrame:
    """``units`` in ranges of their order, each with its range ``__r``, written down once."""
    return cut(units.repartitionByRange("p", F.col("o").asc_nulls_last(), "id").withColumn("__r", F.spark_partition_id()))


def _running(ranged: DataFrame) -> DataFrame:
    """``ranged`` units (p, o, id, t, tok, __r) with ``before``: the tokens before each within its partition."""
    part = [F.col("p")]
    upto = Window.partitionBy(*part).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("p", "__r").agg(F.sum("tok").alias("__s")).withColumn("__off", F.coalesce(F.sum("__s").over(upto), F.lit(0))).drop("__s")
    within = Window.partitionBy("p", "__r").orderBy(F.col("o").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__in", F.coalesce(F.sum("tok").over(within), F.lit(0)))
    s = sums.select(F.col("p").alias("__p"), F.col("__r").alias("__q"), "__off")
    return local.join(s, F.col("p").eqNullSafe(F.col("__p")) & (F.col("__r") == F.col("__q"))).withColumn("before", F.col("__off") + F.col("__in")).drop("__p", "__q", "__off", "__in", "__r")


def _numbered(keys: DataFrame) -> DataFrame:
    """Distinct (p, k) with ``seq``: the rank of k within p, from 1."""
    keys = keys.withColumn("__g", F.floor(F.col("k") / GROUP))
    upto = Window.partitionBy("p").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    offs = keys.groupBy("p", "__g").count().withColumn("__off", F.coalesce(F.sum("count").over(upto), F.lit(0))).select(F.col("p").alias("__p"), F.col("__g").alias("__h"), "__off")
    within = Window.partitionBy("p", "__g").orderBy("k")
    return (
        keys.withColumn("__n", F.row_number().over(within))
        .join(offs, F.col("p").eqNullSafe(F.col("__p")) & (F.col("__g") == F.col("__h")))
        .select("p", "k", (F.col("__off") + F.col("__n")).cast("long").alias("seq"))
    )


def _line() -> Column:
    return F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("t"))


def joined_hashes(units: DataFrame, fingerprint: str, most: int) -> DataFrame:
    """(p, partition_hash): SHA-256 over the fingerprint and the ordered ids and texts of a partition in one string.

    Sizes are summed before any partition is brought together; one over ``most`` characters raises.
    """
    over = units.groupBy("p").agg(F.sum(F.length("t")).alias("n")).filter(F.col("n") > most).limit(1).collect()
    if over:
        raise ValueError(f"chunk: partition {over[0][0]!r} has {over[0][1]} characters, over joined_max_chars; use hashing='tree'")
    order = F.struct(F.col("o").isNull().alias("n"), F.col("o").alias("o"), F.col("id").alias("i"))
    return units.groupBy("p").agg(F.sha2(F.concat(F.lit(fingerprint + "::"), ordered_text(_line(), "|", order)), 256).alias("partition_hash"))


def tree_hashes(units: DataFrame, fingerprint: str, *, prime: int = (1 << 61) - 1) -> DataFrame:
    """(p, partition_hash): a hash over the sums of four 61-bit digests of (rank order keys, id, text) of the units.

    Each unit's digest binds its order key, id and text, so any change of one, a new unit or a lost one changes
    the sums; sums combine before the shuffle, so a partition of any size is never brought together. Repeated
    units count as often as they stand.
    """
    parts = [F.pmod(F.xxhash64(F.lit(k), F.col("o"), F.col("o").isNull(), F.col("id"), F.sha2(_line(), 256)), F.lit(prime)).cast("decimal(20,0)") for k in range(4)]
    sums = units.groupBy("p").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(parts)])
    return sums.select("p", F.sha2(F.concat_ws("::", F.lit(fingerprint), F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("partition_hash"))


def chunk(
    units: DataFrame,
    id_column: str,
    order_column: str,
    text_column: str,
    *,
    partition_column: str | None = None,
    label_column: str | None = None,
    target_tokens: int | None = None,
    overlap_tokens: int | None = None,
    join_separator: str = "\n",
    extra: str | None = None,
    stored: DataFrame | None = None,
    hashing: str = "joined",
    joined_max_chars: int = 1 << 28,
    config: EngineConfig = EngineConfig(),
) -> DataFrame:
    """(chunk_id, partition_key, chunk_seq, source_rows, chunk_text, n_source_rows, token_estimate, exceeds_target, partition_hash).

    A unit that crosses the target joins the current chunk; no unit is divided. With an overlap a unit
    among the first ``overlap_tokens`` of a chunk also closes the one before. ``stored`` is the table of
    an earlier run: partitions whose key and hash it holds are left out before the packing (whole partitions
    are replaced). Sizes not given are those of ``config``.

    ``hashing`` says what ``partition_hash`` is over: "joined", the fingerprint and the ordered ``id:text`` of
    all units joined by ``|``, which holds a partition's text in one task and therefore raises for one over
    ``joined_max_chars``; or "tree", for partitions of any size, a hash over sums of hashes that marks the
    same changes by other values.

    Defined cases: null text counts as empty, null label too; units of equal order are taken by id; null
    order keys come last; a null partition key is a partition; without a partition column there is one, its
    key null and its chunk ids plain numbers; an empty input has no chunks; repeated rows are units of
    their own; other columns are ignored, whatever their names.
    """
    target_tokens = config.chunk_target_tokens if target_tokens is None else target_tokens
    overlap_tokens = config.chunk_overlap_tokens if overlap_tokens is None else overlap_tokens
    check_sizes(target_tokens, overlap_tokens)
    if stored is not None and partition_column is None:
        raise ValueError("chunk: only partitions can be left out; name partition_column")
    if hashing not in ("joined", "tree"):
        raise ValueError("chunk: hashing must be joined or tree")
    step = target_tokens - overlap_tokens
    fingerprint = chunk_fn_fingerprint(
        target_tokens=target_tokens, overlap_tokens=overlap_tokens, join_separator=join_separator, id_column=id_column, order_column=order_column, text_column=text_column, partition_column=partition_column, label_column=label_column, extra=extra
    )
    text = unit_text(F.col(text_column), F.col(label_column) if label_column else None)
    base = units.select(
        (F.col(partition_column) if partition_column else F.lit(None).cast("string")).alias("p"), F.col(order_column).alias("o"), F.col(id_column).alias("id"), text.alias("t")
    ).withColumn("tok", estimate_tokens("t"))
    # Hashes first: partitions that have not changed are neither sorted nor packed.
    base = base if stored is not None else _ranged(base)
    hashes = joined_hashes(base, fingerprint, joined_max_chars) if hashing == "joined" else tree_hashes(base, fingerprint)
    if stored is not None:
        old = stored.select(F.col("partition_key").alias("__sp"), F.col("partition_hash").alias("__sh")).distinct()
        hashes = cut(hashes.join(old, F.col("p").eqNullSafe(F.col("__sp")) & F.col("partition_hash").eqNullSafe(F.col("__sh")), "left_anti"))
        dirty = hashes.select(F.col("p").alias("__dp"))
        base = _ranged(base.join(dirty, F.col("p").eqNullSafe(F.col("__dp")), "left_semi"))
    hashes = hashes.select(F.col("p").alias("__hp"), "partition_hash")
    placed = cut(_running(base).withColumn("k0", F.floor(F.col("before") / step)))  # the running sum is read three times below
    own = F.array("k0")
    if overlap_tokens:
        again = (F.col("k0") > 0) & (F.col("before") - F.col("k0") * step < overlap_tokens)
        own = F.when(again, F.array(F.col("k0"), F.col("k0") - 1)).otherwise(own)
    copies = placed.withColumn("k", F.explode(own))
    order = F.struct(F.col("o").isNull().alias("n"), F.col("o").alias("o"), F.col("id").alias("i"))
    groups = copies.groupBy("p", "k").agg(ordered(F.struct("id", "t"), order).alias("u"))
    numbered = _numbered(groups.select("p", "k")).select(F.col("p").alias("__np"), F.col("k").alias("__nk"), "seq")
    body = F.array_join(F.transform("u", lambda x: x.t), join_separator)
    size = estimate_tokens("chunk_text")
    name = F.col("seq").cast("string") if partition_column is None else F.concat(F.col("p").cast("string"), F.lit("::"), F.col("seq").cast("string"))
    return (
        groups.join(numbered, F.col("p").eqNullSafe(F.col("__np")) & (F.col("k") == F.col("__nk")))
        .join(hashes, F.col("p").eqNullSafe(F.col("__hp")))
        .withColumn("chunk_text", body)
        .select(
            name.alias("chunk_id"),
            F.col("p").alias("partition_key"),
            F.col("seq").alias("chunk_seq"),
            F.transform("u", lambda x: x.id).alias("source_rows"),
            "chunk_text",
            F.size("u").cast("long").alias("n_source_rows"),
            size.alias("token_estimate"),
            (size > target_tokens).alias("exceeds_target"),
            "partition_hash",
        )
    )


def oversized_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks over their target: none is a pass."""
    return chunks.filter("exceeds_target")
