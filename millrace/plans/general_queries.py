"""Queries on general data problems (p1, p3) over the tables of one folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.merkle import MerkleStore, changed_records, latest, saved_state
from millrace.operators.orphans import MATCHES, find_orphans, plain_key
from millrace.plans.session import cut, read_table, scratch


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, key and month."""
    chunks = find_orphans(
        read_table(spark, folder, "attach_metadata_delta").withColumn("k", plain_key("chunk_id")),
        read_table(spark, folder, "orphan_chunks").withColumn("k", plain_key("chunk_id")),
        ["k"],
        ref_time="built_at",
        valid_from="built_at",
        valid_to="dropped_at",
    )
    key = plain_key("source_key")
    at = F.locate("::", key)
    items = find_orphans(
        read_table(spark, folder, "orphan_kb").select(plain_key("source_type").alias("source_type"), plain_key("item_id").alias("item_id"), "ts"),
        read_table(spark, folder, "orphan_kb_valid_keys").select(
            F.nullif(key.substr(F.lit(1), at - 1), F.lit("")).alias("source_type"), F.when(at > 0, key.substr(at + 2, F.length(key))).alias("item_id"), "valid_from", "deleted_at"
        ),
        ["source_type", "item_id"],
        ref_time="ts",
        valid_from="valid_from",
        valid_to="deleted_at",
        match="partial",
        required=["item_id"],
    )
    return chunks.select(F.lit("attach_metadata_delta").alias("table_name"), F.col("k").alias("ref_key"), "ref_month").unionByName(
        items.select(F.lit("orphan_kb").alias("table_name"), F.concat(F.coalesce("source_type", F.lit("")), F.lit("::"), "item_id").alias("ref_key"), "ref_month")
    )


def orphans_partial_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Composite keys with nulls on both sides, by a fixed rule, under each of the three match semantics."""
    item, kind = plain_key("item_id"), plain_key("source_type")
    refs = read_table(spark, folder, "orphan_kb").select(F.when(~item.endswith("3"), kind).alias("a"), F.when(~item.endswith("4"), item).alias("b"), "ts")
    key = plain_key("source_key")
    at = F.locate("::", key)
    targets = read_table(spark, folder, "orphan_kb_valid_keys").select(F.when(~key.endswith("7"), key.substr(F.lit(1), at - 1)).alias("a"), key.substr(at + 2, F.length(key)).alias("b"), "valid_from", "deleted_at")
    found = [find_orphans(refs, targets, ["a", "b"], ref_time="ts", valid_from="valid_from", valid_to="deleted_at", match=m).withColumn("semantics", F.lit(m)) for m in MATCHES]
    return found[0].unionByName(found[1]).unionByName(found[2])


_PARTIAL_SQL = r"""
WITH i AS (SELECT nullif(lower(regexp_replace(source_type, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g')), '') AS s, nullif(lower(regexp_replace(item_id, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g')), '') AS k, ts FROM orphan_kb),
r AS (SELECT CASE WHEN k NOT LIKE '%3' THEN s END AS a, CASE WHEN k NOT LIKE '%4' THEN k END AS b, ts FROM i),
v AS (SELECT lower(regexp_replace(source_key, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g')) AS k, valid_from AS f, deleted_at AS u FROM orphan_kb_valid_keys),
t AS (SELECT CASE WHEN k NOT LIKE '%7' THEN substr(k, 1, instr(k, '::') - 1) END AS a, substr(k, instr(k, '::') + 2) AS b, f, u FROM v),
o AS (SELECT r.*, a IS NULL AND b IS NULL AS none, a IS NULL OR b IS NULL AS part,
NOT EXISTS (SELECT 1 FROM t WHERE (r.a IS NULL OR t.a = r.a) AND (r.b IS NULL OR t.b = r.b) AND coalesce(t.f, '-infinity') <= r.ts AND (t.u IS NULL OR r.ts < t.u)) AS lost FROM r)
SELECT DISTINCT a, b, strftime(ts, '%Y-%m') AS ref_month, 'simple' AS semantics FROM o WHERE NOT part AND lost
UNION SELECT a, b, strftime(ts, '%Y-%m'), 'full' FROM o WHERE NOT none AND (part OR lost)
UNION SELECT a, b, strftime(ts, '%Y-%m'), 'partial' FROM o WHERE NOT none AND lost
"""


def p1_orphans_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """The report: orphan keys per table and month."""
    return p1_found(spark, folder).groupBy("table_name", "ref_month").agg(F.count("*").alias("orphan_keys"))


_P1_SQL = r"""
WITH k1 AS (SELECT lower(regexp_replace(chunk_id, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g')) AS k, built_at AS t FROM attach_metadata_delta),
t1 AS (SELECT lower(regexp_replace(chunk_id, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g')) AS k, built_at AS f, dropped_at AS u FROM orphan_chunks),
k2 AS (SELECT lower(regexp_replace(coalesce(source_type, '') || '::' || nullif(regexp_replace(item_id, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g'), ''), '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g')) AS k, ts AS t FROM orphan_kb),
t2 AS (SELECT lower(regexp_replace(source_key, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g')) AS k, valid_from AS f, deleted_at AS u FROM orphan_kb_valid_keys),
found AS (
SELECT DISTINCT 'attach_metadata_delta' AS table_name, k AS ref_key, strftime(t, '%Y-%m') AS ref_month FROM k1
WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.k = k1.k AND coalesce(t1.f, '-infinity') <= k1.t AND (t1.u IS NULL OR k1.t < t1.u))
UNION ALL
SELECT DISTINCT 'orphan_kb', k, strftime(t, '%Y-%m') FROM k2
WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM t2 WHERE t2.k = k2.k AND coalesce(t2.f, '-infinity') <= k2.t AND (t2.u IS NULL OR k2.t < t2.u)))
"""


def current_records(spark: SparkSession, folder: str) -> DataFrame:
    """(model_name, record_key, state_hash): each record with the hash of its row with the latest built_at."""
    parts = [
        latest(
            read_table(spark, folder, table).filter(F.col(key).isNotNull()).select(F.lit(table).alias("model_name"), F.col(key).alias("record_key"), F.lower(hashed).alias("state_hash"), "built_at"),
            ["model_name", "record_key"],
            "state_hash",
            "built_at",
        )
        for table, key, hashed in (
            ("attach_metadata_delta", "chunk_id", "content_hash"),
            ("chunk_edges", "partition_key", "partition_hash"),
            ("kb_delta", "source_key", "content_hash"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records new or changed against what successful runs left in delta_state."""
    state = read_table(spark, folder, "delta_state")
    saved = saved_state(state, read_table(spark, folder, "ai_run_log"))
    return changed_records(current_records(spark, folder), saved).select("model_name", "record_key")


def _store_of_saved(spark: SparkSession, folder: str) -> MerkleStore:
    """A store, in the shared folder, that holds what successful runs have left, as its first version."""
    store = MerkleStore(spark, scratch(spark, "merkle"))
    store.run(saved_state(read_table(spark, folder, "delta_state"), read_table(spark, folder, "ai_run_log")))
    return store


def p3_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The same through the saved tree of a store: what its next run processes."""
    return _store_of_saved(spark, folder).run(current_records(spark, folder)).select("model_name", "record_key")


def p3_repeated_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run over records that the run before has processed: none is processed again."""
    store = _store_of_saved(spark, folder)
    current = cut(current_records(spark, folder))
    store.run(current)
    return store.run(current).agg(F.count("*").alias("processed"))


_P3_SQL = """
WITH cur AS (
SELECT 'attach_metadata_delta' AS model_name, chunk_id AS record_key, lower(content_hash) AS h, built_at FROM attach_metadata_delta
UNION ALL SELECT 'chunk_edges', partition_key, lower(partition_hash), built_at FROM chunk_edges
UNION ALL SELECT 'kb_delta', source_key, lower(content_hash), built_at FROM kb_delta),
now AS (SELECT model_name, record_key, h FROM (SELECT *, row_number() OVER (PARTITION BY model_name, record_key ORDER BY built_at DESC, h DESC NULLS LAST) r FROM cur WHERE record_key IS NOT NULL) WHERE r = 1),
ok AS (SELECT invocation_id, model_name FROM (SELECT *, row_number() OVER (PARTITION BY invocation_id, model_name ORDER BY run_at DESC, CASE lower(trim(event)) WHEN 'failed' THEN 2 WHEN 'completed' THEN 1 ELSE 0 END DESC) r FROM ai_run_log) WHERE r = 1 AND lower(trim(event)) = 'completed'),
st AS (SELECT model_name, record_key, h FROM (SELECT s.model_name, s.record_key, lower(s.state_hash) AS h, row_number() OVER (PARTITION BY s.model_name, s.record_key ORDER BY s.recorded_at DESC, lower(s.state_hash) DESC NULLS LAST) r FROM delta_state s SEMI JOIN ok USING (invocation_id, model_name)) WHERE r = 1)
SELECT now.model_name, now.record_key FROM now LEFT JOIN st ON st.model_name = now.model_name AND st.record_key = now.record_key
WHERE st.record_key IS NULL OR (now.h IS NOT NULL AND now.h IS DISTINCT FROM st.h)
"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_period": p1_orphans_by_period, "orphans_partial_keys": orphans_partial_keys, "p3_found": p3_found, "p3_incremental": p3_incremental, "p3_repeated_run": p3_repeated_run}
SQL = {
    "p1_found": _P1_SQL + "SELECT * FROM found",
    "p1_orphans_by_period": _P1_SQL + "SELECT table_name, ref_month, count(*) AS orphan_keys FROM found GROUP BY ALL",
    "orphans_partial_keys": _PARTIAL_SQL,
    "p3_found": _P3_SQL,
    "p3_incremental": _P3_SQL,
    "p3_repeated_run": "SELECT CAST(0 AS BIGINT) AS processed",
}
