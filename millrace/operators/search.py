"""Ranking by cosine similarity: one query, many queries in blocks, and an index of cells."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.plans.session import scratch, ship


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of lists, flat, and the length of each list (-1 for null)."""
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False), lengths


def _cosines(column: pa.Array, query: np.ndarray) -> np.ndarray:
    """Cosine of each vector with ``query``; NaN for null, empty and zero vectors; other dimensions raise."""
    flat, lengths = _vectors(column)
    if ((lengths >= 0) & (lengths != len(query))).any():
        raise ValueError("cosine: vectors of unequal dimension")
    out = np.full(len(lengths), np.nan)
    rows = flat.reshape(-1, len(query)) if len(query) else np.zeros((int((lengths >= 0).sum()), 0))
    norm = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    with np.errstate(invalid="ignore", divide="ignore"):
        out[lengths >= 0] = np.where(norm > 0, rows @ query / norm, np.nan)
    return out


def vector_search(
    rows: DataFrame, embedding: str, query: Sequence[float], *, top_k: int = 10, id_column: str = "id", select: Sequence[str] = (), where: Column | str | None = None, digits: int | None = None
) -> DataFrame:
    """(id, ``select``..., score): the ``top_k`` rows most similar to ``query``; ``where`` applies before ranking.

    Scores are taken in Arrow batches, of which only rows that can be among the best go on. Ties go to the
    smaller id. Null vectors and vectors of length zero have a null score and come last; other dimensions raise;
    repeated rows are ranked each; with ``digits`` the rounded scores rank. No shuffle: each task keeps its best.
    """
    ship(rows.sparkSession)
    some = rows if where is None else rows.filter(where)
    asked, slack = np.array([float(x) for x in query]), 0.0 if digits is None else 10.0**-digits
    kept = some.select(id_column, *select, F.col(embedding).alias("__v"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _cosines(batch.column(batch.num_columns - 1), asked)
            sound = found[~np.isnan(found)]
            least = np.partition(sound, -top_k)[-top_k] - slack if len(sound) >= top_k > 0 else None
            keep = found >= least if least is not None else np.ones(len(found), bool)
            columns = [*batch.columns[:-1], pa.array(found, pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score"]).filter(pa.array(keep))

    scored = kept.mapInArrow(score, StructType([*kept.schema.fields[:-1], StructField("score", DoubleType())]))
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return scored.orderBy(F.desc_nulls_last("score"), F.asc(id_column)).limit(top_k)


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows scaled to length one; null and zero vectors and those of another dimension become NaN."""
    out = np.full((len(vectors), width), np.nan)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[k] = v
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm > 0, out / norm, np.nan)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, top_k: int) -> pd.DataFrame:
    """The best ``top_k`` of each row of ``scores``, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    ranked = np.argsort(np.where(np.isnan(scores), np.inf, -scores), axis=1, kind="stable")[:, :top_k]
    q, r = np.repeat(np.arange(len(query_ids)), ranked.shape[1]), ranked.ravel()
    frame = pd.DataFrame({"query_id": query_ids[q], "id": ids[r], "score": scores[q, r]})
    return frame[frame["score"].notna()]


def _raw(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows as they are, zero vectors as NaN."""
    out = np.array([np.asarray(v, float) for v in vectors]).reshape(-1, width)
    return np.where((out != 0).any(axis=1, keepdims=True), out, np.nan)


def _products(a: pd.DataFrame, q: pd.DataFrame, top_k: int, dot: bool = False) -> pd.DataFrame:
    """The best ``top_k`` rows of ``a`` for each query of ``q``, each dimension by itself."""
    wide, asked = (df["v"].map(lambda v: 0 if v is None else len(v)).to_numpy() for df in (a, q))
    found = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
    for width in np.intersect1d(wide[wide > 0], asked[asked > 0]):
        x, y = a[wide == width], q[asked == width]
        scaled = _raw if dot else _unit
        found.append(_best(y["id"].to_numpy(), x["id"].to_numpy(), scaled(y["v"], width) @ scaled(x["v"], width).T, top_k))
    return pd.concat(found[1:]) if len(found) > 1 else found[0]


def search_all(rows: DataFrame, queries: DataFrame, embedding: str, id_column: str, *, top_k: int = 10, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): for every query its ``top_k`` most similar rows, exactly, itself included.

    Both sides are cut into blocks by a hash of their id and each pair of blocks is one matrix product, whose
    best ``top_k`` per query go on to the final ranking. Block counts follow the inputs' sizes.

    Defined cases: null, empty and zero vectors match nothing and have no matches; vectors of another
    dimension than the query's match nothing; ties go to the smaller id; repeated ids are ranked each; either
    input may be empty; ids must be whole numbers.
    """
    ship(rows.sparkSession)
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    left = rows.select(F.col(id_column).cast("long").alias("id"), F.col(embedding).alias("v")).filter("id is not null").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    right = queries.select(F.col(id_column).cast("long").alias("id"), F.col(embedding).alias("v")).filter("id is not null").withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def product(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(q):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _products(a, q, top_k)

    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(product, "query_id long, id long, score double")
    return _ranked(found, top_k)


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def _read_parts(folder: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(f"{folder}/about", wholetext=True).first()[0])


class CellIndex:
    """A stored inverted index: centroids fitted on a bounded sample, every row written to the cell of its nearest.

    ``build`` makes one under ``path`` (by default in the shared folder), ``CellIndex(spark, path)`` opens it.
    ``attributes`` are columns kept beside the id, by which a search may filter. Distance is cosine or dot.
    Opt-in: no operator builds one by itself.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")
        about = _read_parts(self.path, spark)
        self.name, self.width, self.probes, self.parts = about["name"], about["width"], about["probes"], about["parts"]
        self.distance, self.attributes = about["distance"], about["attributes"]
        self.centroids = np.array(about["centroids"]).reshape(-1, self.width)
        self.cells = spark.read.parquet(f"{self.path}/rows")

    @classmethod
    def build(
        cls,
        rows: DataFrame,
        embedding: str,
        id_column: str,
        *,
        name: str = "index",
        path: str | None = None,
        attributes: Sequence[str] = (),
        distance: str = "cosine",
        cells: int | None = None,
        target_recall: float = 0.95,
        fit_rows: int = 20_000,
        part_rows: int = 16_384,
        seed: int = 1,
    ) -> CellIndex:
        """Fit on at most ``fit_rows`` rows, index all.

        ``cells`` is by default the square root of the row count, but no more than a sixteenth of ``fit_rows``.
        ``probes``, the cells a search reads, is the least that finds ``target_recall`` of the ten nearest of
        sampled vectors within the sample. Cells are read in parts of about ``part_rows`` rows.
        """
        if distance not in ("cosine", "dot"):
            raise ValueError("distance must be cosine or dot")
        spark = rows.sparkSession
        ship(spark)
        path = path or scratch(spark, name)
        held = rows.select(F.col(id_column).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), *attributes).filter("id is not null and v is not null and size(v) > 0")
        n = held.count()
        sample = held.orderBy(F.xxhash64("id", F.lit(seed))).limit(fit_rows).select("v").toPandas()["v"]
        # The cells are those of the sample's commonest dimension; vectors of another lie in cell 0.
        width = int(sample.map(len).mode().iloc[0]) if len(sample) else 1
        x = _unit(sample, width)
        x = x[~np.isnan(x).any(axis=1)]
        cells = cells or max(1, min(round(n**0.5), fit_rows // 16))
        centroids = cls._fit(x, cells, seed) if len(x) else np.zeros((1, width))
        probes = cls._probes(x, centroids, target_recall, seed)

        def nearest(vectors: pd.Series) -> pd.Series:
            return pd.Series(np.nan_to_num(_unit(vectors, width) @ centroids.T, nan=-2.0).argmax(axis=1))

        placed = held.withColumn("cell", F.pandas_udf(nearest, "long")("v"))
        placed.write.parquet(f"{path}/rows")
        parts = max(1, -(-n // (len(centroids) * part_rows)))
        about = {"name": name, "width": width, "probes": probes, "parts": parts, "distance": distance, "attributes": list(attributes), "centroids": [float(c) for c in centroids.ravel()]}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        return cls(spark, path)

    @staticmethod
    def _probes(x: np.ndarray, centroids: np.ndarray, target: float, seed: int, asked: int = 200, nearest: int = 10) -> int:
        """The cells to read so that ``target`` of the nearest are found, measured within the sample."""
        if len(x) <= nearest:
            return len(centroids)
        own = (x @ centroids.T).argmax(axis=1)
        q = x[np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)]
        best = np.argsort(-(q @ x.T), axis=1)[:, : nearest + 1]
        place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
        ranks = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1

    @staticmethod
    def _fit(x: np.ndarray, cells: int, seed: int, rounds: int = 15) -> np.ndarray:
        """Spherical k-means."""
        rng = np.random.default_rng(seed)
        centers = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            own = (x @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
        return centers

    def search(self, queries: DataFrame, embedding: str, id_column: str, *, top_k: int = 10, probes: int | None = None, where: Column | str | None = None) -> DataFrame:
        """(query_id, id, score, rank) from the ``probes`` nearest cells of each query; ``where`` is on the attributes.

        Rows of the cells meet the queries that probe them, a part of a cell at a time.
        """
        centroids, width, probes, dot = self.centroids, self.width, probes or self.probes, self.distance == "dot"

        def near(vectors: pd.Series) -> pd.Series:
            sims = np.nan_to_num(_unit(vectors, width) @ centroids.T, nan=-2.0)
            return pd.Series([list(map(int, r[:probes])) for r in np.argsort(-sims, axis=1, kind="stable")])

        asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
        asked = asked.withColumn("cell", F.explode(F.pandas_udf(near, "array<long>")("v"))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)).cast("array<long>")))
        held = (self.cells if where is None else self.cells.filter(where)).select("id", "v", "cell").withColumn("s", F.pmod(F.xxhash64("id"), F.lit(self.parts)))

        def product(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(q):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            return _products(a, q, top_k, dot)

        found = held.groupBy("cell", "s").cogroup(asked.groupBy("cell", "s")).applyInPandas(product, "query_id long, id long, score double")
        return _ranked(found, top_k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(matches, found, recall) of an approximate search against the exact one."""
    hit = approximate.select("query_id", "id", F.lit(1).alias("hit")).distinct()
    return exact.join(hit, ["query_id", "id"], "left").agg(F.count("*").alias("matches"), F.count("hit").alias("found"), F.round(F.try_divide(F.count("hit"), F.count("*")), 6).alias("recall"))
