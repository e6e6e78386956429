"""Embedding drift: a few fixed probes, embedded on every build and compared with a blessed baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.ai.functions import AiFunctions
from millrace.functions.hashing import embedding_fn_fingerprint, logic_hash
from millrace.functions.text import utc_now
from millrace.functions.vectors import cosine, embedding_dimension, json_cosine, vector_to_json
from millrace.operators.checks import CheckResult, run_check
from millrace.plans.config import EngineConfig

# The probes. Changing one voids every baseline.
PROBES = {
    "letters": "sphinx of black quartz, judge my vow",
    "brief": "ok",
    "passage": "A river rises in the hills, gathers smaller streams on its way, and reaches the sea slow and wide, having carried the soil of every field it passed.",
    "scripts": "žluťoučký kůň 🐎 ñandú 東京 Ωμέγα",
}


def embedding_logic_hash(ai: AiFunctions) -> str:
    """Which revision of the embedding code is at work: ``embed``, its provider and all that they call."""
    return logic_hash(AiFunctions.embed, type(ai.embedder()).embed_batch)


def embedding_canary(spark: SparkSession, ai: AiFunctions, *, adapter: str = "spark", dimension: int | None = None) -> DataFrame:
    """(probe_id, probe_text, model_version, embedding_fn_fingerprint, observed_at, embedding, adapter, embedding_logic_hash)."""
    model = ai.config.model_for("embed")
    probes = spark.createDataFrame(sorted(PROBES.items()), "probe_id string, probe_text string")
    return probes.select(
        "probe_id",
        "probe_text",
        F.lit(model).alias("model_version"),
        F.lit(embedding_fn_fingerprint(model, dimension)).alias("embedding_fn_fingerprint"),
        utc_now().alias("observed_at"),
        ai.embed("probe_text").alias("embedding"),
        F.lit(adapter).alias("adapter"),
        F.lit(embedding_logic_hash(ai)).alias("embedding_logic_hash"),
    )


def canary_baseline(canary: DataFrame) -> DataFrame:
    """What to bless: (probe_id, adapter, embedding_fn_fingerprint, model_version, baseline_vector)."""
    return canary.select("probe_id", "adapter", "embedding_fn_fingerprint", "model_version", vector_to_json("embedding").alias("baseline_vector"))


def drifted(canary: DataFrame, baseline: DataFrame, threshold: float | None = None, *, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(probe_id, adapter, embedding_fn_fingerprint, observed_similarity) below the threshold; no baseline, no row.

    Without ``threshold`` it is ``embedding_canary_similarity_threshold``.
    """
    threshold = config.embedding_canary_similarity_threshold if threshold is None else threshold
    keys = ["probe_id", "adapter", "embedding_fn_fingerprint"]
    return canary.join(baseline.select(*keys, "baseline_vector"), keys).select(*keys, json_cosine("embedding", "baseline_vector").alias("observed_similarity")).filter(F.col("observed_similarity") < threshold)


def of_other_dimension(canary: DataFrame, *, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(probe_id, dimension) of probes whose vector is not ``embedding_canary_vector_dimension`` long; none if that is not set."""
    size = embedding_dimension("embedding")
    return canary.select("probe_id", size.alias("dimension")).filter(~F.col("dimension").eqNullSafe(F.lit(config.embedding_canary_vector_dimension)) if config.embedding_canary_vector_dimension else F.lit(False))


def stale_logic(canary: DataFrame, ai: AiFunctions) -> DataFrame:
    """(probe_id, embedding_logic_hash) of probes whose hash is not 64 lower-case hex digits or not that of the code at work."""
    h = F.col("embedding_logic_hash")
    sound = h.rlike("^[0-9a-f]{64}$") & (h == embedding_logic_hash(ai))
    return canary.select("probe_id", "embedding_logic_hash").filter(~F.coalesce(sound, F.lit(False)))


def check_canary(canary: DataFrame, baseline: DataFrame, ai: AiFunctions) -> list[CheckResult]:
    """The checks of a build's probes under the settings of ``ai``; drift and dimension have ``embedding_canary_severity``."""
    severity = ai.config.embedding_canary_severity
    return [
        run_check("canary_drift", drifted(canary, baseline, config=ai.config), severity),
        run_check("canary_dimension", of_other_dimension(canary, config=ai.config), severity),
        run_check("canary_logic_hash", stale_logic(canary, ai)),
    ]


def model_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(probe_id, similarity) of the probes under two models."""
    return a.select("probe_id", F.col("embedding").alias("__a")).join(b.select("probe_id", F.col("embedding").alias("__b")), "probe_id").select("probe_id", cosine("__a", "__b").alias("similarity"))
