"""Queries on training data over the tables of one folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.mixing import sample_mix, source_key
from millrace.llm.packing import fill_report, pack_all
from millrace.llm.pieces import split_oversized
from millrace.llm.quality import text_quality
from millrace.llm.sentences import split_sentences, train
from millrace.llm.tokens import sized
from millrace.plans.session import read_table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read_table(spark, folder, "fixture_documents")
        .select(F.lit("fixture_documents").alias("source_table"), F.col("document_id").alias("item_id"), F.col("document_text").alias("item_text"))
        .unionByName(
            read_table(spark, folder, "chunk_overlap").select(F.lit("chunk_overlap").alias("source_table"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("item_text"))
        )
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items over the limit, and whether some cut had to be forced."""
    pieces = split_oversized(_items(spark, folder), ["source_table", "item_id"], "item_text", texts=False)
    forced = F.max(F.col("cut_kind") == "forced")
    return pieces.groupBy("source_table", "item_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut_class"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces themselves."""
    return split_oversized(_items(spark, folder), ["source_table", "item_id"], "item_text")


def p2_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces where sentences are the units of the boundary model."""
    return split_oversized(_items(spark, folder), ["source_table", "item_id"], "item_text", model=train(), texts=False)


def p2_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per item over the limit: that its pieces are in order, cover its text, keep to the limit and share no more than the overlap."""
    pieces = p2_pieces(spark, folder).distinct()
    size = F.length("piece_text")
    facts = pieces.groupBy("source_table", "item_id").agg(
        F.max("end_pos").alias("text_chars"),
        F.max(size).alias("longest"),
        F.min(size == F.col("end_pos") - F.col("start_pos")).alias("sound"),
        F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos"))), lambda p: F.struct(p.start_pos.alias("s"), p.end_pos.alias("e"))).alias("p"),
    )
    after = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: (b.s <= a.e) & (b.s > a.s) & (b.e > a.e) & (a.e - b.s <= 256))
    return facts.select("source_table", "item_id", "text_chars", ((F.col("longest") <= 2048) & F.col("sound")).alias("within"), (F.forall(after, lambda x: x) & (F.col("p")[0].s == 0)).alias("covered"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every document, as positions."""
    units = split_sentences(read_table(spark, folder, "fixture_documents"), "document_id", "document_text")
    return units.select("document_id", "start_pos", "end_pos").distinct()


def p4_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every row, with their text."""
    return split_sentences(read_table(spark, folder, "fixture_documents"), "document_id", "document_text")


def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the digest of the visible characters of its units, in order: none is lost or doubled."""
    units = p4_sentences(spark, folder).distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence_text"))), lambda u: u.sentence_text), "")
    return units.groupBy("document_id").agg(F.md5(F.regexp_replace(text, r"[\p{IsWhite_Space}\x1c-\x1f]+", "")).alias("visible_md5"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return sized(read_table(spark, folder, "documents"), "text")


def _capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    """A table of settings: one row per kind of container."""
    return {r["container_type"]: r["capacity_tokens"] for r in read_table(spark, folder, "container_specs").collect()}


def p5_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a container of each kind."""
    return pack_all(_sizes(spark, folder), "doc_id", "n_tokens", _capacities(spark, folder))


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p5_containers(spark, folder), _capacities(spark, folder))


def p5_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind: documents held, that no container is over its capacity, and that only longer texts are divided."""
    capacities = _capacities(spark, folder)
    room = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])[F.col("container_type")]
    packed = p5_containers(spark, folder)
    full = packed.groupBy("container_type", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("container_type").agg(F.max(F.col("t") - room).alias("over"))
    items = packed.groupBy("container_type", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("t"))
    whole = items.groupBy("container_type").agg(F.count("*").alias("documents"), F.min((F.col("pieces") == 1) | (F.col("t") > room)).alias("undivided"))
    return whole.join(full, "container_type").select("container_type", "documents", (F.col("over") <= 0).alias("within"), "undivided")


def _mix(spark: SparkSession, folder: str, **kw) -> tuple[DataFrame, DataFrame]:
    return sample_mix(_sizes(spark, folder), "doc_id", "source", "n_tokens", read_table(spark, folder, "mix_targets"), **kw)


def p6_filled_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of mixes of a stated size, half of what all documents hold: sources too small give all they may, the others fill up."""
    total = _sizes(spark, folder).agg(F.sum("n_tokens")).first()[0] // 2
    return _mix(spark, folder, total=total)[1]


def p6_weighted_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares where short documents are preferred: a document's copies are in proportion to the root of its size, inverted."""
    docs = _sizes(spark, folder).withColumn("weight", 1 / F.sqrt("n_tokens"))
    return sample_mix(docs, "doc_id", "source", "n_tokens", read_table(spark, folder, "mix_targets"), weight="weight")[1]


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per mix and source of the targets: that its repeats are kept, and that its share is what its documents allow,
    but for a hundredth, or for one document of the largest taken where the mix is so small that this is more."""
    mixed, report = _mix(spark, folder)
    largest = mixed.groupBy("mix_name").agg(F.max("n_tokens").alias("largest"))
    report = report.join(largest, "mix_name", "left").withColumn("slack", F.greatest(F.lit(0.01), F.try_divide("largest", F.sum("mixed_tokens").over(Window.partitionBy("mix_name")))))
    live = F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).over(Window.partitionBy("mix_name"))
    due = F.when(F.col("available_tokens") > 0, F.col("target_share") / live).otherwise(0.0)
    return report.select("mix_name", source_key("source").alias("source"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("actual_share") - due) <= F.col("slack")).alias("share_met"))


def p6_mixes(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    return _mix(spark, folder)[0]


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares per mix and source."""
    return _mix(spark, folder)[1]


def p7_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of every document."""
    return text_quality(read_table(spark, folder, "documents"), "doc_id", "text")


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The plain figures of every document, which SQL can say."""
    return p7_statistics(spark, folder).select("doc_id", "n_chars", "n_lines")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents more than half of which is not natural prose, with the kind of that part."""
    return p7_statistics(spark, folder).filter(F.col("text_kind") != "prose").select("doc_id", "text_kind").distinct()


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_sentence_pieces": p2_sentence_pieces,
    "p2_invariants": p2_invariants,
    "p4_found": p4_found,
    "p4_sentences": p4_sentences,
    "p4_coverage": p4_coverage,
    "p5_containers": p5_containers,
    "p5_fill": p5_fill,
    "p5_invariants": p5_invariants,
    "p6_mixes": p6_mixes,
    "p6_shares": p6_shares,
    "p6_filled_shares": p6_filled_shares,
    "p6_weighted_shares": p6_weighted_shares,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_statistics": p7_statistics,
    "p7_counts": p7_counts,
}

#: White space as Unicode has it, in DuckDB's patterns.
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

SQL = {
    "p2_invariants": """
SELECT DISTINCT source_table, item_id, len(t)::INT AS text_chars, true AS within, true AS covered FROM (
SELECT 'fixture_documents' AS source_table, document_id AS item_id, document_text AS t FROM fixture_documents
UNION ALL SELECT 'chunk_overlap', chunk_id, chunk_text FROM chunk_overlap) WHERE len(t) > 2048
""",
    "p4_coverage": f"SELECT DISTINCT document_id, md5(regexp_replace(document_text, '{_WHITE}+', '', 'g')) AS visible_md5 FROM fixture_documents WHERE regexp_replace(document_text, '{_WHITE}+', '', 'g') <> ''",
    "p5_invariants": f"SELECT container_type, (SELECT count(DISTINCT doc_id) FROM documents WHERE regexp_replace(text, '{_WHITE}+', '', 'g') <> '') AS documents, true AS within, true AS undivided FROM container_specs",
    "p6_invariants": r"SELECT DISTINCT mix_name, lower(regexp_replace(source, '[\s_./+&:-]+', '', 'g')) AS source, true AS repeats_kept, true AS share_met FROM mix_targets",
    "p7_counts": f"""
WITH d AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents),
v AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
s AS (SELECT *, len(regexp_replace(line, '{_WHITE}+$', '')) AS solid FROM v),
b AS (SELECT *, sum(CASE WHEN solid = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
k AS (SELECT doc_id, count(*) AS n, sum(len(line) + 1) - 1 - max_by(len(line) - solid, i) AS c FROM b WHERE solid > 0 GROUP BY doc_id, g),
t AS (SELECT doc_id, sum(c) AS c, sum(n) AS n FROM k GROUP BY doc_id)
SELECT documents.doc_id, coalesce(t.c, 0)::BIGINT AS n_chars, coalesce(t.n, 0)::BIGINT AS n_lines FROM documents LEFT JOIN t USING (doc_id)
""",
    "p2_found": r"""
WITH items AS (
SELECT 'fixture_documents' AS source_table, document_id AS item_id, document_text AS t FROM fixture_documents
UNION ALL SELECT 'chunk_overlap', chunk_id, chunk_text FROM chunk_overlap),
stretches AS (
SELECT source_table, item_id, max(len(s)) AS longest FROM (
SELECT source_table, item_id, unnest(regexp_split_to_array(regexp_replace(t, '([.!?]+)([\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}])', '\1 \2', 'g'), '[\s\x{00A0}\x{3000}。！？｡．।॥։؟۔።፧…]+')) AS s FROM items WHERE len(t) > 2048)
GROUP BY source_table, item_id)
SELECT source_table, item_id, CASE WHEN longest > 2048 THEN 'forced' ELSE 'natural' END AS cut_class FROM stretches
""",
}
