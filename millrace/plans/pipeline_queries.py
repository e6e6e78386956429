"""Queries of the context pipeline over the tables of one folder, with their SQL where SQL can say them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.ai.functions import AiFunctions
from millrace.functions import prompts as P
from millrace.functions.hashing import chunk_fn_fingerprint, content_hash
from millrace.functions.text import estimate_tokens
from millrace.functions.vectors import embedding_dimension, json_cosine, vector_to_json
from millrace.operators import checks
from millrace.operators.aggregate import agg_inputs
from millrace.operators.canary import canary_baseline, check_canary, drifted, embedding_canary
from millrace.operators.chunk import chunk, oversized_chunks
from millrace.operators.cost import batch_size, dev_sample, estimate_call_tokens, oversized_groups
from millrace.operators.delta import delta, merge, version_guard
from millrace.operators.evaluation import evaluate, nonconforming, ungrounded
from millrace.operators.knowledge import knowledge_base
from millrace.operators.metadata import attach_metadata, dependency_violations
from millrace.operators.search import CellIndex, recall, search_all, vector_search
from millrace.operators.split import split_sentences
from millrace.plans.config import EngineConfig
from millrace.plans.runlog import never_completed
from millrace.plans.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PROMPT = "Sort the text into one kind.\nQuote what shows it.\n\nText:\n{{ input }}"
SCHEMA = '{"type": "object", "properties": {"kind": {"type": "string", "enum": ["bug", "howto", "guide", "draft"]}, "quote": {"type": "string"}, "size": {"type": ["integer", "null"]}}, "required": ["kind"]}'
LOCAL = EngineConfig(ai_functions_enabled=True, model_generate="local", embedding_model="local")
AI = AiFunctions(LOCAL)

# Sentences and chunks

_SENTENCES = """
s AS (SELECT {id} AS document_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {id}, regexp_extract_all({text}, '[^.!?]+[.!?]*') AS l FROM {table})),
sentences AS (SELECT document_id || '-' || i AS sentence_id, document_id, CAST(i AS BIGINT) AS sentence_index, trim(s, ' ') AS sentence_text FROM s WHERE trim(s, ' ') <> '')"""


@query("WITH " + _SENTENCES.format(id="doc_id", text="text", table="documents") + " SELECT sentence_id, document_id, sentence_index, md5(sentence_text) AS text_md5 FROM sentences")
def split_sentences_documents(spark: SparkSession, folder: str) -> DataFrame:
    s = split_sentences(read_table(spark, folder, "documents"), "doc_id", "text")
    return s.select("sentence_id", "document_id", "sentence_index", F.md5("sentence_text").alias("text_md5"))


def _chunk_sql(units: str, target: int, overlap: int, fingerprint: str, *, partitioned: bool = True) -> str:
    """CTEs ending in ``chunks`` over ``units``, a query of (p, o, id, t)."""
    step = target - overlap
    p = "p" if partitioned else "CAST(NULL AS VARCHAR) AS p"
    copies = f"UNION ALL SELECT *, k0 - 1 AS k FROM placed WHERE k0 > 0 AND before - k0 * {step} < {overlap}" if overlap else ""
    name = "groups.p || '::' || seq" if partitioned else "CAST(seq AS VARCHAR)"
    return f"""
u0 AS ({units}),
u AS (SELECT {p}, o, id, t, CAST((len(t) + 3) // 4 AS BIGINT) AS tok FROM u0),
run AS (SELECT *, CAST(coalesce(sum(tok) OVER (PARTITION BY p ORDER BY o NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM u),
placed AS (SELECT *, before // {step} AS k0 FROM run),
copies AS (SELECT *, k0 AS k FROM placed {copies}),
grouped AS (SELECT p, k, string_agg(id, ',' ORDER BY o NULLS LAST, id) AS source_rows, string_agg(t, chr(10) ORDER BY o NULLS LAST, id) AS chunk_text, count(*) AS n_source_rows FROM copies GROUP BY p, k),
groups AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY p ORDER BY k) AS BIGINT) AS seq FROM grouped),
hashes AS (SELECT p, sha256('{fingerprint}::' || string_agg(coalesce(id, '') || ':' || t, '|' ORDER BY o NULLS LAST, id)) AS partition_hash FROM u GROUP BY p),
chunks AS (SELECT {name} AS chunk_id, groups.p AS partition_key, seq AS chunk_seq, source_rows, chunk_text, n_source_rows, CAST((len(chunk_text) + 3) // 4 AS BIGINT) AS token_estimate, ((len(chunk_text) + 3) // 4) > {target} AS exceeds_target, partition_hash
FROM groups JOIN hashes ON groups.p IS NOT DISTINCT FROM hashes.p)"""


_BARE = "chunk_id, partition_key, chunk_seq, {rows} AS source_rows, md5(chunk_text) AS text_md5, n_source_rows, token_estimate, exceeds_target"
_SHOWN = _BARE + ", partition_hash"


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "partition_key", "chunk_seq", F.array_join("source_rows", ",").alias("source_rows"), F.md5("chunk_text").alias("text_md5"), "n_source_rows", "token_estimate", "exceeds_target", "partition_hash")


_DOC = {"id_column": "sentence_id", "order_column": "sentence_index", "text_column": "sentence_text", "partition_column": "document_id"}
_PLAIN = chunk_fn_fingerprint(target_tokens=128, overlap_tokens=0, join_separator="\n", **_DOC)
_LAPPED = chunk_fn_fingerprint(target_tokens=40, overlap_tokens=15, join_separator="\n", label_column="document_id", **_DOC)
_WHOLE = chunk_fn_fingerprint(target_tokens=512, overlap_tokens=64, join_separator="\n", id_column="sentence_id", order_column="sentence_id", text_column="sentence_text")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "fixture_documents").select("document_id", "document_text").distinct()
    return chunk(split_sentences(docs, "document_id", "document_text"), **_DOC, target_tokens=128)


_CHUNKS = (
    "WITH docs AS (SELECT DISTINCT document_id, document_text FROM fixture_documents),"
    + _SENTENCES.format(id="document_id", text="document_text", table="docs")
    + ","
    + _chunk_sql("SELECT document_id AS p, sentence_index AS o, sentence_id AS id, sentence_text AS t FROM sentences", 128, 0, _PLAIN)
)


@query(_CHUNKS + " SELECT " + _SHOWN.format(rows="source_rows") + " FROM chunks")
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(document_chunks(spark, folder))


def _stored_units(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "split_docs").distinct()


@query(
    "WITH "
    + _chunk_sql("SELECT DISTINCT document_id AS p, sentence_index AS o, sentence_id AS id, coalesce(document_id, '') || ': ' || coalesce(sentence_text, '') AS t FROM split_docs", 40, 15, _LAPPED)
    + " SELECT "
    + _SHOWN.format(rows="source_rows")
    + " FROM chunks"
)
def chunk_labelled_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(chunk(_stored_units(spark, folder), **_DOC, label_column="document_id", target_tokens=40, overlap_tokens=15))


@query(
    "WITH "
    + _chunk_sql("SELECT DISTINCT sentence_id AS o, sentence_id AS id, coalesce(sentence_text, '') AS t FROM split_docs", 512, 64, _WHOLE, partitioned=False)
    + " SELECT "
    + _BARE.format(rows="source_rows")
    + " FROM chunks"
)
def chunk_unpartitioned(spark: SparkSession, folder: str) -> DataFrame:
    units = _stored_units(spark, folder).select("sentence_id", "sentence_text").distinct()
    # All units are one partition: the hash of any size, whose value SQL cannot say.
    return _shown(chunk(units, "sentence_id", "sentence_id", "sentence_text", overlap_tokens=64, hashing="tree")).drop("partition_hash")


@query(_CHUNKS + " SELECT chunk_id, token_estimate FROM chunks WHERE exceeds_target")
def chunk_oversized(spark: SparkSession, folder: str) -> DataFrame:
    return oversized_chunks(document_chunks(spark, folder)).select("chunk_id", "token_estimate")


@query(_CHUNKS + " SELECT (SELECT count(*) FROM sentences) AS units, CAST(sum(n_source_rows) AS BIGINT) AS placed FROM chunks")
def chunk_lineage_exactly_once(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "fixture_documents").select("document_id", "document_text").distinct()
    units = split_sentences(docs, "document_id", "document_text").agg(F.count("*").alias("units"))
    return units.join(document_chunks(spark, folder).agg(F.sum("n_source_rows").alias("placed")))  # two one-row results


_EDITED = "CASE WHEN document_id LIKE '%7' THEN replace(document_text, 'the', 'this') ELSE document_text END"


@query(
    "WITH docs AS (SELECT DISTINCT document_id, document_text FROM fixture_documents),"
    + _SENTENCES.format(id="document_id", text="document_text", table="docs")
    + f", docs2 AS (SELECT DISTINCT document_id, {_EDITED} AS document_text FROM fixture_documents WHERE document_id NOT LIKE '%3'),"
    + _SENTENCES.format(id="document_id", text="document_text", table="docs2").replace("\ns AS", "\ns2 AS").replace("FROM s WHERE", "FROM s2 WHERE").replace("sentences AS", "sentences2 AS")
    + """,
old AS (SELECT document_id, string_agg(sentence_id || ':' || sentence_text, '|' ORDER BY sentence_index) AS h FROM sentences GROUP BY document_id),
new AS (SELECT document_id, string_agg(sentence_id || ':' || sentence_text, '|' ORDER BY sentence_index) AS h FROM sentences2 GROUP BY document_id)
SELECT n.document_id AS partition_key, (SELECT count(*) FROM sentences2 z WHERE z.document_id = n.document_id) AS units FROM new n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.document_id = n.document_id AND old.h = n.h)"""
)
def chunk_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """A second run over edited documents: which partitions are packed again, and their units."""
    edited = read_table(spark, folder, "fixture_documents").filter("document_id not like '%3'").select("document_id", F.expr(_EDITED).alias("document_text")).distinct()
    again = chunk(split_sentences(edited, "document_id", "document_text"), **_DOC, target_tokens=128, stored=document_chunks(spark, folder))
    return again.groupBy("partition_key").agg(F.sum("n_source_rows").alias("units"))


@query("""
WITH u0 AS (SELECT DISTINCT document_id AS p, sentence_index AS o, sentence_id AS id, coalesce(document_id, '') || ': ' || coalesce(sentence_text, '') AS t FROM split_docs),
run AS (SELECT *, coalesce(sum((len(t) + 3) // 4) OVER (PARTITION BY p ORDER BY o NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u0)
SELECT id AS unit_id, 1 + CAST(before >= 25 AND before % 25 < 15 AS INT) AS copies FROM run""")
def chunk_overlap_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """In how many chunks each unit stands: two where it opens a chunk within the overlap, else one."""
    chunks = chunk(_stored_units(spark, folder), **_DOC, label_column="document_id", target_tokens=40, overlap_tokens=15)
    return chunks.select("chunk_seq", F.posexplode("source_rows").alias("n", "unit_id")).groupBy("unit_id").agg(F.count("*").cast("int").alias("copies"))


# Metadata and knowledge base

_META = """, meta AS (SELECT DISTINCT document_id, title, citation_url FROM fixture_documents),
joined AS (SELECT c.chunk_id, c.partition_key, c.chunk_seq, {text} AS chunk_text, c.n_source_rows, m.title, m.citation_url FROM chunks c LEFT JOIN meta m ON c.partition_key = m.document_id)
SELECT chunk_id, partition_key, chunk_seq, n_source_rows, CAST((len(chunk_text) + 3) // 4 AS BIGINT) AS token_estimate, title, citation_url, sha256(chunk_text || '|' || coalesce(title, '') || '|' || coalesce(citation_url, '')) AS content_hash FROM joined"""


def _attached(spark: SparkSession, folder: str, in_text: bool) -> DataFrame:
    meta = read_table(spark, folder, "fixture_documents")
    return attach_metadata(document_chunks(spark, folder), meta, "document_id", ["title", "citation_url"], in_text=in_text).drop("source_rows", "chunk_text")


@query(_CHUNKS + _META.format(text="c.chunk_text"))
def attach_metadata_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _attached(spark, folder, False)


@query(_CHUNKS + _META.format(text="'title: ' || coalesce(m.title, '') || chr(10) || 'citation_url: ' || coalesce(m.citation_url, '') || chr(10) || '---' || chr(10) || c.chunk_text"))
def attach_metadata_in_text(spark: SparkSession, folder: str) -> DataFrame:
    return _attached(spark, folder, True)


@query("SELECT partition_key AS key, count(*) AS variants FROM (SELECT DISTINCT partition_key, title, citation_url FROM attach_metadata_delta) GROUP BY 1 HAVING count(*) > 1")
def metadata_dependency_violations(spark: SparkSession, folder: str) -> DataFrame:
    return dependency_violations(read_table(spark, folder, "attach_metadata_delta"), "partition_key", ["title", "citation_url"])


def _kb(spark: SparkSession, folder: str) -> DataFrame:
    none = "cast(null as array<float>)"
    return knowledge_base(
        [
            {"relation": read_table(spark, folder, "kb_delta"), "source_type": "ticket", "source_id": "source_id", "account_key": "account_key", "text": "text", "embedding": "embedding", "timestamp": "ts", "citation_url": "citation_url", "classification": "classification"},
            {"relation": read_table(spark, folder, "orphan_kb"), "source_type": "item", "source_id": "item_id", "account_key": "account_key", "text": "body", "embedding": none, "timestamp": "cast(ts as date)", "citation_url": "citation_url"},
            {"relation": read_table(spark, folder, "orders"), "source_type": "order", "source_id": "o_orderkey", "account_key": "o_custkey", "text": "o_orderpriority", "embedding": none, "timestamp": "o_orderdate", "classification": "'order'"},
        ]
    )


@query("""
WITH arms AS (
SELECT 'ticket' AS source_type, source_id, account_key, text, len(embedding) AS dimension, ts, citation_url, classification FROM kb_delta
UNION ALL SELECT 'item', item_id, account_key, body, NULL, CAST(CAST(ts AS DATE) AS TIMESTAMP), citation_url, NULL FROM orphan_kb
UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderpriority, NULL, CAST(o_orderdate AS TIMESTAMP), NULL, 'order' FROM orders)
SELECT source_type, source_id, account_key, md5(text) AS text_md5, CAST(dimension AS INT) AS dimension, ts, citation_url, classification, source_type || '::' || source_id AS source_key,
sha256(coalesce(account_key, '') || '|' || coalesce(text, '') || '|' || coalesce(CAST(ts AS VARCHAR), '') || '|' || coalesce(citation_url, '') || '|' || coalesce(classification, '')) AS content_hash FROM arms""")
def knowledge_base_union(spark: SparkSession, folder: str) -> DataFrame:
    return _kb(spark, folder).select("source_type", "source_id", "account_key", F.md5("text").alias("text_md5"), embedding_dimension("embedding").alias("dimension"), "ts", "citation_url", "classification", "source_key", "content_hash")


# Search

_KB_QUERY = [0.3, -0.5, 0.8]
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), {q})"


def _first_vector(spark: SparkSession, folder: str) -> list[float]:
    return read_table(spark, folder, "embeddings").filter("vec_id = 0").first()["embedding"]


_V0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, label, round({_COS.format(q=_V0)}, 6) AS score FROM embeddings ORDER BY {_COS.format(q=_V0)} DESC, vec_id LIMIT 10")
def vector_search_top10(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_search(read_table(spark, folder, "embeddings"), "embedding", _first_vector(spark, folder), top_k=10, id_column="vec_id", select=["label"])
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round({_COS.format(q=_V0)}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COS.format(q=_V0)} DESC, vec_id LIMIT 5")
def vector_search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_search(read_table(spark, folder, "embeddings"), "embedding", _first_vector(spark, folder), top_k=5, id_column="vec_id", where="label = 3")
    return found.withColumn("score", F.round("score", 6))


@query("""
WITH twice AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings)
SELECT vec_id, round(""" + _COS.format(q=_V0) + ", 6) AS score FROM twice ORDER BY " + _COS.format(q=_V0) + " DESC, vec_id LIMIT 7")
def vector_search_ties(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    twice = e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 1000000))
    return vector_search(twice, "embedding", _first_vector(spark, folder), top_k=7, id_column="vec_id").withColumn("score", F.round("score", 6))


@query(f"""
WITH kb AS (SELECT DISTINCT source_key, account_key, embedding FROM kb_delta WHERE source_key IS NOT NULL AND embedding IS NOT NULL AND account_key IS NOT NULL)
SELECT source_key, account_key, CASE WHEN NOT isnan(c) THEN round(c, 6) END AS score FROM (SELECT source_key, account_key, {_COS.format(q=str(_KB_QUERY) + "::DOUBLE[]")} AS c FROM kb) ORDER BY score DESC NULLS LAST, source_key LIMIT 10""")
def kb_search(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the knowledge base most similar to a vector, equal rows once."""
    kb = read_table(spark, folder, "kb_delta").select("source_key", "account_key", "embedding").distinct()
    return vector_search(kb, "embedding", _KB_QUERY, top_k=10, id_column="source_key", select=["account_key"], digits=6, where="source_key is not null and embedding is not null and account_key is not null")


def _asked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, folder, "embeddings")
    return e, e.filter("vec_id % 50 = 0")


@query("""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 10""")
def search_every_query(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _asked(spark, folder)
    return search_all(rows, asked, "embedding", "vec_id").select("query_id", "id", "rank")


_MIXED = "CASE WHEN vec_id % 7 = 3 THEN embedding[1:48] ELSE embedding END"


@query(f"""
WITH m AS (SELECT vec_id, CAST({_MIXED} AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.v, r.v) AS score FROM m q JOIN m r ON len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 10""")
def search_mixed_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """Every query against all rows, where a seventh of the vectors has another dimension."""
    rows = read_table(spark, folder, "embeddings").withColumn("embedding", F.expr("case when vec_id % 7 = 3 then slice(embedding, 1, 48) else embedding end"))
    return search_all(rows, rows.filter("vec_id % 50 = 0"), "embedding", "vec_id").select("query_id", "id", "rank")


@query("SELECT true AS enough, count(*) > 0 AS indexed FROM embeddings")
def cell_index_is_enough(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index finds nine tenths of the exact matches and holds every row."""
    rows, asked = _asked(spark, folder)
    index = CellIndex.build(rows, "embedding", "vec_id")
    found = recall(index.search(asked, "embedding", "vec_id"), search_all(rows, asked, "embedding", "vec_id")).select((F.col("recall") >= 0.9).alias("enough"))
    held = index.cells.agg((F.count("*") == rows.count()).alias("indexed"))
    return found.join(held)  # two one-row results


@query()
def cell_index_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the index against the exact search, over all queries."""
    rows, asked = _asked(spark, folder)
    index = CellIndex.build(rows, "embedding", "vec_id")
    return recall(index.search(asked, "embedding", "vec_id"), search_all(rows, asked, "embedding", "vec_id"))


# Evaluation and checks

_GUESS = "CASE WHEN text LIKE '%?%' THEN 'howto' WHEN text LIKE '%was%' THEN 'bug' ELSE classification END"


@query(f"""
WITH b AS (SELECT {_GUESS} AS p, classification AS e FROM kb_delta),
pr AS (SELECT p AS label, count(*) AS pp, sum(CASE WHEN p = e THEN 1 ELSE 0 END) AS tp FROM b GROUP BY p),
ac AS (SELECT e AS label, count(*) AS ap FROM b GROUP BY e),
l AS (SELECT coalesce(pr.label, ac.label) AS label, coalesce(tp, 0) AS tp, pp, ap FROM pr FULL OUTER JOIN ac ON pr.label = ac.label)
SELECT 'v1' AS prompt_version, 'accuracy' AS metric, '__overall__' AS label, CAST(sum(CASE WHEN p = e THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0) AS value FROM b
UNION ALL SELECT 'v1', 'precision', label, CAST(tp AS DOUBLE) / nullif(pp, 0) FROM l
UNION ALL SELECT 'v1', 'recall', label, CAST(tp AS DOUBLE) / nullif(ap, 0) FROM l""")
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "kb_delta").select(F.expr(_GUESS).alias("p"), F.col("classification").alias("e"))
    return evaluate(rows, "p", "e", prompt_version="v1")


@query("SELECT classification AS _value FROM kb_delta WHERE classification IS NULL OR classification NOT IN ('bug', 'howto', 'guide', 'draft')")
def conforms_violations(spark: SparkSession, folder: str) -> DataFrame:
    return nonconforming(read_table(spark, folder, "kb_delta"), "classification", SCHEMA)


_NORM = r"lower(regexp_replace(trim({c}, ' '), '[\t\n\f\r ]+', ' ', 'g'))"


@query(f"""
SELECT md5(s.sentence_text) AS evidence_md5, md5(d.t) AS source_md5 FROM split_docs s JOIN (SELECT DISTINCT document_id, regexp_replace(document_text, '\\.', ';', 'g') AS t FROM fixture_documents) d USING (document_id)
WHERE coalesce(s.sentence_text IS NULL OR trim({_NORM.format(c='s.sentence_text')}, ' ') = '' OR NOT contains({_NORM.format(c='d.t')}, {_NORM.format(c='s.sentence_text')}), false)""")
def grounded_violations(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "fixture_documents").select("document_id", F.regexp_replace("document_text", r"\.", ";").alias("t")).distinct()
    rows = read_table(spark, folder, "split_docs").join(docs, "document_id")
    return ungrounded(rows, "sentence_text", "t").select(F.md5("_evidence").alias("evidence_md5"), F.md5("_source").alias("source_md5"))


@query("SELECT chunk_id FROM attach_metadata_delta a WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orphan_chunks o WHERE o.chunk_id = a.chunk_id)")
def relationships_violations(spark: SparkSession, folder: str) -> DataFrame:
    return checks.broken_relationships(read_table(spark, folder, "attach_metadata_delta"), "chunk_id", read_table(spark, folder, "orphan_chunks"), "chunk_id").select("chunk_id")


@query("SELECT source_key AS value, count(*) AS n FROM kb_delta WHERE source_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    return checks.not_unique(read_table(spark, folder, "kb_delta"), "source_key")


@query("SELECT 'null_keys' AS name, count(*) AS n FROM kb_delta WHERE source_key IS NULL UNION ALL SELECT 'odd_events', count(*) FROM ai_run_log WHERE event NOT IN ('started', 'completed', 'failed')")
def value_checks(spark: SparkSession, folder: str) -> DataFrame:
    nulls = checks.is_null(read_table(spark, folder, "kb_delta"), "source_key").agg(F.lit("null_keys").alias("name"), F.count("*").alias("n"))
    odd = checks.not_accepted(read_table(spark, folder, "ai_run_log"), "event", ["started", "completed", "failed"])
    return nulls.unionByName(odd.agg(F.lit("odd_events").alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


# Cost

_TOK = "CAST((len(text) + 3) // 4 AS BIGINT)"
_OVER = -(-P.prompt_overhead_chars(PROMPT, SCHEMA) // 4)


@query(f"SELECT source, count(*) AS n, CAST(sum({_TOK}) AS BIGINT) AS tokens FROM documents GROUP BY source")
def estimate_tokens_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(estimate_tokens("text")).alias("tokens"))


@query(f"SELECT doc_id, {_TOK} + {_OVER + 50} AS call_tokens FROM documents")
def estimate_tokens_of_calls(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", estimate_call_tokens("text", prompt=PROMPT, schema=SCHEMA, output_tokens=50).alias("call_tokens"))


@query(f"SELECT count(*) AS n_rows, CAST(coalesce(sum({_TOK} + {_OVER}), 0) AS BIGINT) AS est_tokens FROM documents WHERE lang = 'en'")
def guard_batch_sizing(spark: SparkSession, folder: str) -> DataFrame:
    return batch_size(read_table(spark, folder, "documents"), "text", where="lang = 'en'", prompt=PROMPT, schema=SCHEMA)


@query(f"SELECT account_key AS group_key, CAST(sum({_TOK}) AS BIGINT) AS est_tokens FROM documents GROUP BY 1 HAVING sum({_TOK}) > 1000")
def guard_agg_offenders(spark: SparkSession, folder: str) -> DataFrame:
    return oversized_groups(read_table(spark, folder, "documents"), "text", "account_key", max_tokens=1000)


# Hashes, deltas, versions


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", content_hash("text").alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_hash_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").filter("text is not null").select("doc_id", content_hash("text").alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


def _batch(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    batch = read_table(spark, folder, "attach_metadata_delta").filter("chunk_id is not null").select("chunk_id", F.lower("content_hash").alias("content_hash")).distinct()
    stored = read_table(spark, folder, "delta_state").filter("model_name = 'attach_metadata_delta'").select(F.col("record_key").alias("chunk_id"), F.lower("state_hash").alias("content_hash"))
    return batch, stored


_BATCH = """
WITH b AS (SELECT DISTINCT chunk_id, lower(content_hash) AS content_hash FROM attach_metadata_delta WHERE chunk_id IS NOT NULL),
st AS (SELECT record_key AS chunk_id, lower(state_hash) AS content_hash FROM delta_state WHERE model_name = 'attach_metadata_delta'),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.chunk_id = b.chunk_id AND (b.content_hash IS NULL OR st.content_hash = b.content_hash)))
"""


@query(_BATCH + "SELECT * FROM d")
def delta_new_changed(spark: SparkSession, folder: str) -> DataFrame:
    return delta(*_batch(spark, folder), "chunk_id", "content_hash")


@query(_BATCH + "SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.chunk_id = st.chunk_id) UNION ALL SELECT * FROM d")
def incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    batch, stored = _batch(spark, folder)
    return merge(stored, delta(batch, stored, "chunk_id", "content_hash"), "chunk_id")


@query("SELECT model_name, count(*) AS reprocessed FROM delta_state WHERE invocation_id <> 'run-1' GROUP BY 1")
def version_guard_reprocess(spark: SparkSession, folder: str) -> DataFrame:
    state = read_table(spark, folder, "delta_state")
    if not version_guard(state, "run-1", "invocation_id"):
        state = state.limit(0)
    return state.groupBy("model_name").agg(F.count("*").alias("reprocessed"))


@query("""
WITH l AS (SELECT invocation_id, function_name, model_name, node_id, lower(trim(event)) AS event FROM ai_run_log)
SELECT invocation_id, function_name, model_name, node_id FROM l WHERE event = 'started' AND NOT EXISTS (SELECT 1 FROM l c WHERE c.event = 'completed' AND c.invocation_id = l.invocation_id
AND c.function_name IS NOT DISTINCT FROM l.function_name AND c.model_name IS NOT DISTINCT FROM l.model_name AND c.node_id IS NOT DISTINCT FROM l.node_id)""")
def run_log_never_completed(spark: SparkSession, folder: str) -> DataFrame:
    log = read_table(spark, folder, "ai_run_log").withColumn("event", F.lower(F.trim("event")))
    return never_completed(log).select("invocation_id", "function_name", "model_name", "node_id")


# Prompts, fields, groups


@query(f"SELECT doc_id, md5({P.sql_literal(PROMPT.split('{{ input }}')[0])} || text) AS prompt_md5 FROM documents")
def render_prompt_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", F.md5(P.render_prompt(PROMPT, "text")).alias("prompt_md5"))


@query(f"SELECT doc_id, md5({P.sql_literal(P.augment_prompt(PROMPT, SCHEMA).split('{{ input }}')[0])} || text || {P.sql_literal(P.shape_instruction(SCHEMA, 'json'))}) AS prompt_md5 FROM documents")
def augment_prompt_documents(spark: SparkSession, folder: str) -> DataFrame:
    prompt = P.augment_prompt(PROMPT, SCHEMA) + P.shape_instruction(SCHEMA, "json")
    return read_table(spark, folder, "documents").select("doc_id", F.md5(P.render_prompt(prompt, "text")).alias("prompt_md5"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def field_typed(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select("event_id", P.field_of("props", "k").alias("k_text"), P.field_of("props", "k", "bigint").alias("k"), P.field_of("props", "none").alias("missing"))


@query("""
SELECT partition_key AS group_key, md5('Sum up:' || chr(10) || chr(10) || string_agg(chunk_text, chr(10) ORDER BY chunk_seq NULLS LAST, chunk_text)) AS input_md5
FROM (SELECT DISTINCT partition_key, chunk_seq, chunk_text FROM chunk_overlap) GROUP BY 1 HAVING count(chunk_text) > 0""")
def ai_agg_transcript_input(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "chunk_overlap").select("partition_key", "chunk_seq", "chunk_text").distinct()
    spoken = rows.groupBy("partition_key").agg(F.count("chunk_text").alias("n")).filter("n > 0").drop("n")
    return agg_inputs(rows.join(spoken, "partition_key"), "partition_key", "chunk_text", "Sum up:", order="chunk_seq").select("group_key", F.md5("agg_input").alias("input_md5"))


# Embedding canary


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dimension, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM embeddings")
def canary_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "embeddings")
    return e.select("vec_id", embedding_dimension("embedding").alias("dimension"), F.round(json_cosine("embedding", vector_to_json("embedding")), 6).alias("similarity"))


_TURNED = (0.9999, 0.999, 0.99, 0.95)


@query("SELECT vec_id, c AS expected_similarity, c AS observed_similarity FROM embeddings, (VALUES (0.9999::DOUBLE), (0.999), (0.99), (0.95)) AS t(c)")
def canary_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against itself turned to a known cosine: ``c v + sqrt(1 - c^2) w``, w being v with its pairs of entries swapped and one negated."""
    e = read_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    turned = F.expr("transform(sequence(0, size(v) - 1), i -> c * v[i] + sqrt(1 - c * c) * if(i % 2 = 0, -v[i + 1], v[i - 1]))")
    rows = e.withColumn("c", F.explode(F.array(*[F.lit(c) for c in _TURNED]))).select("vec_id", "v", F.col("c").alias("expected_similarity"), turned.alias("w"))
    return rows.select("vec_id", "expected_similarity", F.round(json_cosine("v", vector_to_json("w")), 6).alias("observed_similarity"))


@query("""
SELECT CAST(vec_id AS VARCHAR) AS probe_id, 'spark' AS adapter, 'fp' AS embedding_fn_fingerprint, 0.95::DOUBLE AS observed_similarity FROM embeddings WHERE label = 3""")
def canary_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Drift at the default threshold: vectors of one label are turned to a cosine of 0.95 and those of another to 0.9999 of their baseline."""
    e = read_table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = F.when(F.col("label") == 3, 0.95).when(F.col("label") == 4, 0.9999).otherwise(1.0)
    turned = F.expr("transform(sequence(0, size(v) - 1), i -> c * v[i] + sqrt(1 - c * c) * if(i % 2 = 0, -v[i + 1], v[i - 1]))")
    named = e.withColumn("c", c).select(F.col("vec_id").cast("string").alias("probe_id"), F.lit("spark").alias("adapter"), F.lit("fp").alias("embedding_fn_fingerprint"), F.lit("m").alias("model_version"), turned.alias("embedding"), "v")
    blessed = canary_baseline(named.withColumn("embedding", F.col("v")))
    return drifted(named, blessed).withColumn("observed_similarity", F.round("observed_similarity", 6))


@query("SELECT 0::BIGINT AS failures, 'canary_drift' AS name UNION ALL SELECT 0, 'canary_dimension' UNION ALL SELECT 0, 'canary_logic_hash'")
def canary_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The checks of a build of the local provider's probes under the settings."""
    ai = AiFunctions(replace(LOCAL, embedding_canary_vector_dimension=64))
    live = embedding_canary(spark, ai)
    return spark.createDataFrame([(r.failures, r.name) for r in check_canary(live, canary_baseline(live), ai)], "failures long, name string")


# Model calls of the local provider, whose answers SQL can say


@query()
def embed_local(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "split_docs").select("sentence_id", AI.embed("sentence_text").alias("embedding"))


_ASKED = f"{P.sql_literal(PROMPT.split('{{ input }}')[0])} || sentence_text"
_TIMES = {v: f"((len(lower({_ASKED})) - len(replace(lower({_ASKED}), '{v}', ''))) // {len(v)})" for v in P.schema_enum(SCHEMA)}
_MOST = "greatest(" + ", ".join(_TIMES.values()) + ")"
_KIND = f"CASE WHEN sentence_text IS NULL THEN NULL {' '.join(f'WHEN {n} = {_MOST} THEN {P.sql_literal(v)}' for v, n in _TIMES.items())} END"
_COLLAPSED = r"trim(regexp_replace({c}, '[\t\n\f\r ]+', ' ', 'g'), ' ')"


@query(f"SELECT sentence_id, {_KIND} AS kind FROM split_docs")
def classify_local(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "split_docs").select("sentence_id", AI.classify("sentence_text", PROMPT, SCHEMA).alias("kind"))


@query(f"SELECT sentence_id, {_KIND} AS kind, md5({_COLLAPSED.format(c=_ASKED)}) AS quote_md5, CASE WHEN sentence_text IS NOT NULL THEN TRY_CAST(coalesce(nullif(regexp_extract({_ASKED}, '[0-9]+'), ''), '0') AS BIGINT) END AS size FROM split_docs")
def extract_local(spark: SparkSession, folder: str) -> DataFrame:
    out = read_table(spark, folder, "split_docs").select("sentence_id", AI.extract("sentence_text", PROMPT, SCHEMA).alias("r"))
    return out.select("sentence_id", P.field_of("r", "kind").alias("kind"), F.md5(P.field_of("r", "quote")).alias("quote_md5"), P.field_of("r", "size", "bigint", strict=False).alias("size"))


@query(f"SELECT sentence_id, md5({_COLLAPSED.format(c=_ASKED)}) AS answer_md5 FROM split_docs")
def generate_local(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "split_docs").select("sentence_id", F.md5(P.text_of(AI.generate("sentence_text", PROMPT))).alias("answer_md5"))


@query(f"""
WITH g AS (SELECT partition_key AS group_key, 'Sum up:' || chr(10) || chr(10) || coalesce(string_agg(chunk_text, chr(10) ORDER BY chunk_seq NULLS LAST, chunk_text), '') AS asked FROM chunk_overlap GROUP BY 1)
SELECT group_key, md5({_COLLAPSED.format(c='asked')}) AS result_md5 FROM g""")
def ai_agg_local(spark: SparkSession, folder: str) -> DataFrame:
    out = AI.ai_agg(read_table(spark, folder, "chunk_overlap"), "partition_key", "chunk_text", "Sum up:", order="chunk_seq")
    return out.select("group_key", F.md5("result").alias("result_md5"))


@query()
def dev_sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A sampling operator: 20 random rows."""
    return dev_sample(read_table(spark, folder, "documents"), 20).select("doc_id")
