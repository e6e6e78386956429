"""Processing only new or changed records: a Merkle tree over ranges of hashed keys.

Records fall into leaves by the leading hex digits of a hash of their key; a node's digest combines those
of its children without regard to order. The current and the saved tree are compared from the root down,
only below nodes that differ; the records of the leaves that differ are extracted and compared exactly.
Output and tree are published together under one pointer, so a failed run leaves the last state in force.

A tree has at most ``16 ** depth`` leaves a model, however many records there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.plans.session import cut
from millrace.plans.state import Versions

DIGEST = ("d1", "d2", "n")
TREE = "model_name string, node string, level int, d1 long, d2 long, n long"
_SCHEMA = StructType([StructField(c, StringType()) for c in ("model_name", "record_key", "leaf", "state_hash")])


def with_leaf(records: DataFrame, depth: int, group: str = "model_name", key: str = "record_key") -> DataFrame:
    """``records`` with ``leaf``, the first ``depth`` hex digits of a hash of the key: the key's range."""
    return records.withColumn("leaf", F.substring(F.lpad(F.lower(F.hex(F.xxhash64(group, key))), 16, "0"), 1, depth))


def build_tree(records: DataFrame, depth: int) -> DataFrame:
    """(model_name, level, node, d1, d2, n) of ``records`` (model_name, record_key, state_hash, leaf).

    Keys must be unique per model. A null hash has a digest of its own, so it differs from any other.
    Two 64-bit sums by exclusive or, with the count, stand for a node.
    """
    null_safe = [F.col("record_key"), F.col("state_hash").isNull(), F.coalesce("state_hash", F.lit(""))]
    leaves = (
        records.groupBy("model_name", F.col("leaf").alias("node"))
        .agg(F.bit_xor(F.xxhash64(*null_safe)).alias("d1"), F.bit_xor(F.xxhash64(F.lit("b"), *null_safe)).alias("d2"), F.count("*").alias("n"))
        .withColumn("level", F.lit(depth))
    )
    return with_upper_levels(leaves, depth)


def with_upper_levels(leaves: DataFrame, depth: int) -> DataFrame:
    """The whole tree of ``leaves`` (model_name, node, d1, d2, n): one expansion and one small aggregation."""
    return (
        leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .withColumn("node", F.expr("substring(node, 1, level)"))
        .groupBy("model_name", "level", "node")
        .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))
        .select("model_name", "node", "level", "d1", "d2", "n")
    )


def changed_leaves(current: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """(model_name, leaf) where the trees differ, found by descending only below nodes that differ.

    The trees are laid side by side once; each level then keeps those of its unlike nodes whose parent was
    kept, so the plan grows by one join a level.
    """
    on = ["model_name", "level", "node"]
    now = current.select(*on, *[F.col(d).alias(f"c_{d}") for d in DIGEST])
    then = saved.select(*on, *[F.col(d).alias(f"s_{d}") for d in DIGEST])
    same = [F.col(f"c_{d}").eqNullSafe(F.col(f"s_{d}")) for d in DIGEST]
    unlike = cut(now.join(then, on, "full_outer").filter(~(same[0] & same[1] & same[2])).select(*on))
    kept = unlike.filter("level = 0").select("model_name", "node")
    for level in range(1, depth + 1):
        parents = kept.select("model_name", F.col("node").alias("__p"))
        below = unlike.filter(F.col("level") == level).select("model_name", "node", F.expr(f"substring(node, 1, {level - 1})").alias("__p"))
        kept = below.join(parents, ["model_name", "__p"], "left_semi").select("model_name", "node")
    return kept.withColumnRenamed("node", "leaf")


def _of_records(df: DataFrame, depth: int) -> DataFrame:
    return with_leaf(df.filter(F.col("record_key").isNotNull()).select("model_name", "record_key", F.lower("state_hash").alias("state_hash")), depth)


def _new_or_changed(now: DataFrame, then: DataFrame, leaves: DataFrame) -> DataFrame:
    """The records of ``now`` in ``leaves`` that ``then`` does not hold or holds otherwise."""
    on = ["model_name", "leaf"]
    old = then.join(leaves, on, "left_semi").select("model_name", "record_key", F.col("state_hash").alias("__old"), F.lit(True).alias("__known"))
    return (
        now.join(leaves, on, "left_semi")
        .join(old, ["model_name", "record_key"], "left")
        .filter(F.col("__known").isNull() | (F.col("state_hash").isNotNull() & ~F.col("state_hash").eqNullSafe(F.col("__old"))))
        .select("model_name", "record_key", "state_hash")
    )


def changed_records(current: DataFrame, saved: DataFrame, *, depth: int = 4) -> DataFrame:
    """(model_name, record_key, state_hash) of the records of ``current`` new or changed against ``saved``.

    Both hold (model_name, record_key, state_hash), keys unique per model; other columns are ignored. Both
    trees are built here, for states that are kept as a table of rows; ``MerkleStore`` keeps its tree.
    ``depth`` is the trees' height in hex digits; it decides no result.

    Defined cases: a null key is no record; letter case of hashes has no meaning; a key without saved row is
    new, whatever its hash; a null current hash of a known key is no change; a null saved hash differs from
    any current one; saved keys that no longer exist are no result; either input may be empty.
    """
    now, then = cut(_of_records(current, depth)), cut(_of_records(saved, depth))
    leaves = cut(changed_leaves(build_tree(now, depth), build_tree(then, depth), depth))
    return _new_or_changed(now, then, leaves)


def latest(rows: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """``value`` of the row with the latest ``at`` per key (null ``at`` first; of a tie the greatest value)."""
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("__m")).select(*keys, F.col("__m.v").alias(value))


def succeeded_runs(log: DataFrame) -> DataFrame:
    """(invocation_id, model_name) whose last event by run_at is completed; case and outer blanks do not count.

    Of events at the same moment the one later in a run's course holds: failed, completed, started.
    """
    event = F.lower(F.trim("event"))
    rank = F.when(event == "failed", 2).when(event == "completed", 1).otherwise(0)
    return (
        log.withColumn("model_name", F.lower(F.trim("model_name")))
        .groupBy("invocation_id", "model_name")
        .agg(F.max(F.struct(F.col("run_at"), rank.alias("r"), event.alias("e"))).alias("__m"))
        .filter(F.col("__m.e") == "completed")
        .select("invocation_id", "model_name")
    )


def saved_state(state: DataFrame, log: DataFrame) -> DataFrame:
    """(model_name, record_key, state_hash) as successful runs left it."""
    kept = state.filter(F.col("record_key").isNotNull()).join(succeeded_runs(log), ["invocation_id", "model_name"], "left_semi")
    return latest(kept.withColumn("state_hash", F.lower("state_hash")), ["model_name", "record_key"], "state_hash", "recorded_at")


class MerkleStore:
    """Published states under ``root``, with their tree (see ``Versions``).

    A version holds ``output`` (what its run made), ``tree`` and the records in folders by the first ``digits``
    of the leaf, of which it holds only those that its run changed. A run compares the tree of the current records with the saved one, and reads and writes
    the saved records of the folders with leaves that differ, no others.

    The pointer moves last, by a rename. A run that dies before has published nothing, so the next one finds
    the same changes again; one that dies after has published all. One writer at a time; readers always see
    one whole version. ``depth`` and ``digits`` are those of the first version ever after.
    """

    def __init__(self, spark: SparkSession, root: str, *, depth: int = 4, digits: int = 2) -> None:
        if not 1 <= digits <= min(depth, 3):
            raise ValueError("digits must be at least 1 and no more than depth or 3")
        self.spark, self._versions = spark, Versions(spark, root)
        settings = self._versions.manifest()[2]
        self.depth, self.digits = settings.get("depth", depth), settings.get("digits", digits)
        #: Folders whose saved records the last run has read.
        self.folders_read: list[str] = []

    def read(self, part: str) -> DataFrame | None:
        """``output``, ``records`` or ``tree`` of the published version, None before the first."""
        at = self._versions.current()
        if at is None:
            return None
        if part == "records":
            return self._versions.rows(self._versions.manifest()[0], _SCHEMA)
        return self.spark.read.parquet(f"{self._versions.base(at)}/{part}")

    def run(self, current: DataFrame, *, process: Callable[[DataFrame], DataFrame] = lambda changed: changed) -> DataFrame:
        """Process the records of ``current`` changed since the last published run and publish output and tree.

        ``current`` is read once and written down, so a source that moves meanwhile cannot mark a record as
        done that was not processed. Records that vanished stay in the state; a null current hash keeps the
        stored one (the leaves of such records are read again each time).
        """
        held = self._versions.manifest()[0]
        now = cut(_of_records(current, self.depth))
        saved_tree = self.read("tree") if held else self.spark.createDataFrame([], TREE)
        leaves = cut(changed_leaves(build_tree(now, self.depth), saved_tree, self.depth))
        # Names of folders, at most 16 ** digits.
        folders = sorted(r[0] for r in leaves.select(F.substring("leaf", 1, self.digits)).distinct().collect())
        self.folders_read = [f for f in folders if f in held]
        then = self._versions.rows(held, _SCHEMA, folders)
        output = process(_new_or_changed(now, then, leaves))
        version = self._versions.new()
        base = self._versions.base(version)
        output.write.parquet(f"{base}/output")
        self._write_records(version, now, then, folders)
        self._write_tree(version, saved_tree, folders)
        self._versions.publish(version, held | dict.fromkeys(folders, version), _SCHEMA, {"depth": self.depth, "digits": self.digits})
        return self.spark.read.parquet(f"{base}/output")

    def _write_records(self, version: str, now: DataFrame, then: DataFrame, folders: list[str]) -> None:
        """The changed folders' records as this run leaves them."""
        folder = F.substring("leaf", 1, self.digits)
        merged = (
            now.filter(folder.isin(folders) if folders else F.lit(False))
            .withColumn("__now", F.lit(1))
            .unionByName(then.withColumn("__now", F.lit(0)))
            .groupBy("model_name", "record_key", "leaf")
            .agg(F.max_by("state_hash", F.when(F.col("state_hash").isNotNull(), F.col("__now"))).alias("state_hash"))
        )
        self._versions.write_rows(version, merged, folder)

    def _write_tree(self, version: str, saved_tree: DataFrame, folders: list[str]) -> None:
        """The saved tree with the leaves of the changed folders replaced."""
        fresh = self._versions.rows(dict.fromkeys(folders, version), _SCHEMA)
        inside = F.substring("node", 1, self.digits).isin(folders) if folders else F.lit(False)
        kept = saved_tree.filter((F.col("level") == self.depth) & ~inside)
        made = build_tree(fresh, self.depth).filter(F.col("level") == self.depth)
        with_upper_levels(kept.unionByName(made).drop("level"), self.depth).write.parquet(f"{self._versions.base(version)}/tree")

    def drop_old(self) -> list[str]:
        """Remove what no reader of the published version needs; returns the versions that went whole."""
        return self._versions.drop_old()
