"""Queries that run models, the log, the gates and the stream over the tables of one folder, with their SQL.

What they write lies in the session's shared folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.ai import gates
from millrace.functions.hashing import content_hash
from millrace.operators.knowledge import knowledge_base
from millrace.plans.config import EngineConfig
from millrace.plans.runlog import RunLog
from millrace.plans.runner import Model, Runner
from millrace.plans.session import cut, read_table, scratch
from millrace.plans.state import StateTable
from millrace.streaming.delta_stream import merge_stream

ON = EngineConfig(ai_functions_enabled=True, model_generate="local", embedding_model="local", cost_per_1k_tokens=0.5)
_EDIT = "case when doc_id % 5 = 0 then concat(text, ' edited') else text end"


def _hashed(spark: SparkSession, folder: str, where: str, text: str = "text") -> DataFrame:
    return read_table(spark, folder, "documents").filter(where).select("doc_id", "lang", content_hash(F.expr(text)).alias("content_hash"))


def _twice(spark: SparkSession, folder: str) -> tuple[Runner, Model, Model]:
    """A model after its first run over two thirds of the documents, and the model of the next run over all, some edited."""
    runner = Runner(spark, scratch(spark, "models"))
    first, later = (Model("docs", lambda _, rows=rows: rows, materialized="incremental", unique_key="doc_id", hash_column="content_hash") for rows in (_hashed(spark, folder, "doc_id % 3 <> 0"), _hashed(spark, folder, "true", _EDIT)))
    runner.run(first)
    return runner, first, later


def run_incremental_model(spark: SparkSession, folder: str) -> DataFrame:
    """The table after an incremental run over new and edited rows."""
    runner, _, later = _twice(spark, folder)
    return runner.run(later)


def run_processed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows an incremental run, a repeated one and a full refresh process."""
    runner, first, later = _twice(spark, folder)
    rows = []
    for name, model, refresh in (("changed", later, False), ("again", later, False), ("refresh", first, True)):
        out = runner.run(model, full_refresh=refresh)
        rows.append((name, runner.ran["docs"], out.count()))
    return spark.createDataFrame(rows, "run string, processed long, stored long")


def run_table_model(spark: SparkSession, folder: str) -> DataFrame:
    """A table rebuilt by each run: the second holds the later rows alone."""
    runner = Runner(spark, scratch(spark, "models"), keep_old=False)
    for where in ("doc_id % 2 = 0", "doc_id % 3 = 0"):
        out = runner.run(Model("docs", lambda _, where=where: _hashed(spark, folder, where)))
    return out


def run_log_events(spark: SparkSession, folder: str) -> DataFrame:
    """What the log holds after a call that completed and one that did not."""
    log = RunLog(spark, scratch(spark, "log"), "run-1")
    log.bootstrap()
    docs = read_table(spark, folder, "documents")
    log.started("embed", "docs", docs, "text", node_id="model.docs", config=ON)
    log.completed("embed", "docs", node_id="model.docs")
    log.started("classify", "kinds", docs.filter("lang = 'en'"), "text", node_id="model.kinds", config=ON, prompt="Sort: {{ input }}", output_tokens=5)
    return log.read().select("invocation_id", "model_name", "function_name", "row_count", F.col("est_tokens").cast("long").alias("est_tokens"), F.round(F.col("est_cost").cast("double"), 6).alias("est_cost"), "event", "node_id")


def gate_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Which calls the gates refuse."""

    def refused(check, *args) -> bool:
        try:
            check(*args)
        except gates.AiCallRefused:
            return True
        return False

    rows = [
        ("off", refused(gates.require_enabled, "embed", EngineConfig())),
        ("on", refused(gates.require_enabled, "embed", ON)),
        ("unclear", refused(gates.require_enabled, "embed", EngineConfig(ai_functions_enabled="yes"))),
        ("view", refused(gates.require_safe_materialization, "embed", "view")),
        ("table", refused(gates.require_safe_materialization, "embed", "table")),
        ("incremental", refused(gates.require_full_refresh_gate, "embed", "incremental", None)),
        ("incremental, told", refused(gates.require_full_refresh_gate, "embed", "incremental", False)),
        ("embed anew", refused(gates.require_reembed_allowed, "embed", True, ON)),
        ("embed anew, allowed", refused(gates.require_reembed_allowed, "embed", True, replace(ON, allow_full_reembed=True))),
    ]
    return spark.createDataFrame(rows, "name string, refused boolean")


def stream_merge_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The table after two deliveries to a stream, the later with edited rows."""
    base = scratch(spark, "stream")
    table = StateTable(spark, base, "docs", "doc_id")
    for at, rows in enumerate((_hashed(spark, folder, "doc_id % 3 <> 0"), _hashed(spark, folder, "doc_id % 2 = 0", _EDIT))):
        rows.withColumn("at", F.lit(at)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("doc_id long, lang string, content_hash string, at int").parquet(f"{base}/in")
        merge_stream(stream, table, "doc_id", "content_hash", "at", f"{base}/offsets").awaitTermination()
    return table.read().select("doc_id", "lang", "content_hash", "at")


def knowledge_base_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of two sources that are new or changed against a stored knowledge base, source by source."""
    none = "cast(null as array<float>)"

    def sources(text: str, where: str) -> list[dict]:
        items, docs = read_table(spark, folder, "orphan_kb").filter("item_id is not null").select("item_id", "account_key", "body", "ts").distinct(), read_table(spark, folder, "documents").filter(where)
        return [
            {"relation": items, "source_type": "item", "source_id": "item_id", "account_key": "account_key", "text": "body", "embedding": none, "timestamp": "ts"},
            {"relation": docs, "source_type": "doc", "source_id": "doc_id", "account_key": "account_key", "text": text, "embedding": none, "timestamp": "created_at"},
        ]

    stored = cut(knowledge_base(sources("text", "doc_id % 3 <> 0")))
    return knowledge_base(sources(_EDIT, "true"), stored=stored).select("source_key", F.md5("text").alias("text_md5"), "content_hash")


_TOK = "CAST(sum((len(text) + 3) // 4) AS BIGINT)"
_SQL_EDIT = "CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END"
_HASH = "sha256(coalesce(account_key, '') || '|' || coalesce({text}, '') || '|' || coalesce(CAST(created_at AS VARCHAR), '') || '||')"

QUERIES = {f.__name__: f for f in (run_incremental_model, run_processed_rows, run_table_model, run_log_events, gate_decisions, stream_merge_documents, knowledge_base_delta)}
SQL = {
    "run_incremental_model": f"SELECT doc_id, lang, sha256({_SQL_EDIT}) AS content_hash FROM documents",
    "run_processed_rows": """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0 OR (doc_id % 5 = 0 AND text IS NOT NULL)) AS changed, count(*) FILTER (doc_id % 3 <> 0) AS first FROM documents)
SELECT 'changed' AS run, changed AS processed, n AS stored FROM c UNION ALL SELECT 'again', 0, n FROM c UNION ALL SELECT 'refresh', first, first FROM c""",
    "run_table_model": "SELECT doc_id, lang, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0",
    "run_log_events": f"""
WITH a AS (SELECT count(*)::INT AS n, {_TOK} AS t FROM documents), b AS (SELECT count(*)::INT AS n, CAST(sum((len(text) + 3) // 4 + CASE WHEN text IS NOT NULL THEN 7 END) AS BIGINT) AS t FROM documents WHERE lang = 'en')
SELECT 'run-1' AS invocation_id, 'docs' AS model_name, 'embed' AS function_name, n AS row_count, t AS est_tokens, round(t / 1000.0 * 0.5, 6)::DOUBLE AS est_cost, 'started' AS event, 'model.docs' AS node_id FROM a
UNION ALL SELECT 'run-1', 'docs', 'embed', NULL, NULL, NULL, 'completed', 'model.docs'
UNION ALL SELECT 'run-1', 'kinds', 'classify', n, t, round(t / 1000.0 * 0.5, 6)::DOUBLE, 'started', 'model.kinds' FROM b""",
    "gate_decisions": "SELECT * FROM (VALUES ('off', true), ('on', false), ('unclear', true), ('view', true), ('table', false), ('incremental', true), ('incremental, told', false), ('embed anew', true), ('embed anew, allowed', false)) AS t(name, refused)",
    # A known row whose hash is null, or is the same, stays as the first delivery left it.
    "stream_merge_documents": f"""
WITH d AS (SELECT *, doc_id % 3 <> 0 AS one, doc_id % 2 = 0 AS two, doc_id % 5 = 0 AND text IS NOT NULL AS edited FROM documents)
SELECT doc_id, lang, sha256(CASE WHEN two THEN {_SQL_EDIT} ELSE text END) AS content_hash, CASE WHEN two AND (NOT one OR edited) THEN 1 ELSE 0 END::INT AS at FROM d WHERE one OR two""",
    "knowledge_base_delta": f"""
SELECT 'doc::' || doc_id AS source_key, md5({_SQL_EDIT}) AS text_md5, {_HASH.format(text=_SQL_EDIT)} AS content_hash FROM documents
WHERE doc_id % 3 = 0 OR {_HASH.format(text=_SQL_EDIT)} <> {_HASH.format(text='text')}""",
}
