"""Approximate vector search by an inverted file.

Cells are k-means centres of a bounded sample; every vector lies in its
nearest cell with a code, the signs of what it differs from the centre, one bit
a dimension, and their mean size. The index is stored partitioned by cell, so a
search that names its cells reads only those folders. Of the ``probes`` nearest
cells of a query, codes give estimates, and only vectors whose estimate is among
the best ``keep`` of all (a quantile over a bounded sample) are compared
exactly. A cell may hold any share of the vectors: it is searched in parts of
about ``part_rows``, each of which returns its own top-k. Recall and the share
of pairs compared are measured apart (``search_quality``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.retrieval import top_k

#: Rows that the centres are fitted on, at most; drawn by hash.
SAMPLE_ROWS = 50_000
#: Coded vectors that place a query's threshold, at most.
SCALE_ROWS = 2_048


@dataclass
class CellIndex:
    """``vectors`` (id, vector, ``cell``, ``code``, ``size``), the cells'
    centres, and the decoded vectors of a sample; both matrices are bounded."""

    vectors: DataFrame
    centres: np.ndarray
    sample: np.ndarray
    item_id: str
    vec: str


def _units(column: pd.Series) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def fit_centres(vectors: DataFrame, n_cells: int, item_id: str = "vec_id", vec: str = "embedding", sample_rows: int = SAMPLE_ROWS,
                seed: int = 42) -> np.ndarray:
    """k-means centres of the vectors' directions, on at most ``sample_rows``
    vectors; what reaches the driver is the centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = vectors.where(F.pmod(F.xxhash64(F.col(item_id), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = drawn.select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    units = Normalizer(inputCol="v", outputCol="features", p=2.0).transform(rows).select("features")
    model = KMeans(k=n_cells, seed=seed, maxIter=10, initMode="k-means||").fit(units)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _nearest(centres: np.ndarray, how_many: int):
    """Row-wise ids of the nearest centres, nearest first."""
    def near(column: pd.Series) -> np.ndarray:
        scores = _units(column) @ centres.T
        return np.argsort(-scores, axis=1, kind="stable")[:, :how_many]

    return near


def _decoded(codes: pd.Series, sizes: pd.Series, centres: np.ndarray) -> np.ndarray:
    """What codes tell of their vectors; ``centres`` row by row or one for all."""
    dims = centres.shape[-1]
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)[:, :dims]
    return centres + (2.0 * bits - 1.0) * sizes.to_numpy()[:, None]


def coded(vectors: DataFrame, centres: np.ndarray, vec: str) -> DataFrame:
    """``vectors`` with their ``cell``, ``code`` and ``size``. The centres are
    bounded by their number, so they travel with the task."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()),
                           T.StructField("size", T.DoubleType())])

    def each(frames):
        for pdf in frames:
            if pdf.empty:
                continue
            units = _units(pdf[vec])
            cells = _nearest(shared.value, 1)(pdf[vec])[:, 0]
            rest = units - shared.value[cells]
            codes = [row.tobytes() for row in np.packbits(rest > 0, axis=1)]
            yield pdf.assign(cell=cells.astype(np.int32), code=codes, size=np.abs(rest).mean(axis=1))

    return vectors.mapInPandas(each, schema)


def _probing(queries: DataFrame, index: "CellIndex", probes: int, keep: float, q_vec: str) -> DataFrame:
    """One row per query and nearest cell, with the least ``estimate`` that is
    among the best ``keep`` of all."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.sample))
    schema = T.StructType([*queries.schema.fields, T.StructField("estimate", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def each(frames):
        centres, sample = shared.value
        for pdf in frames:
            if pdf.empty:
                continue
            near = _nearest(centres, min(probes, len(centres)))(pdf[q_vec])
            if keep < 1:
                pdf = pdf.assign(estimate=np.quantile(_units(pdf[q_vec]) @ sample.T, 1 - keep, axis=1))
            else:
                pdf = pdf.assign(estimate=-np.inf)
            for k in range(near.shape[1]):
                yield pdf.assign(cell=near[:, k].astype(np.int32))

    return queries.mapInPandas(each, schema)


def build(vectors: DataFrame, n_cells: int | None = None, item_id: str = "vec_id", vec: str = "embedding", seed: int = 42) -> CellIndex:
    """The index of ``vectors``; about sqrt(rows) cells unless told otherwise."""
    rows = vectors.where(F.col(item_id).isNotNull() & F.col(vec).isNotNull()).select(item_id, vec)
    n_cells = n_cells or max(1, math.isqrt(rows.count()))
    centres = fit_centres(rows, n_cells, item_id, vec, seed=seed)
    vectors = coded(rows, centres, vec)
    drawn = vectors.orderBy(F.xxhash64(F.col(item_id), F.lit(seed)), item_id).select("cell", "code", "size").limit(SCALE_ROWS).toPandas()
    sample = _decoded(drawn["code"], drawn["size"], centres[drawn["cell"].to_numpy()]) if len(drawn) else np.empty((0, centres.shape[1]))
    return CellIndex(vectors, centres, sample, item_id, vec)


def write(index: CellIndex, path: str) -> None:
    """Vectors partitioned by cell (a cell's rows in as many files as tasks
    wrote them), centres as a small table; nothing there is overwritten."""
    spark = index.vectors.sparkSession
    salted = index.vectors.withColumn("_salt", F.pmod(F.xxhash64(index.item_id), F.lit(8)))  # no cell in one task
    salted.repartition("cell", "_salt").drop("_salt").write.partitionBy("cell").parquet(f"{path}/vectors")
    for name in ("centres", "sample"):  # bounded matrices
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(getattr(index, name))]
        spark.createDataFrame(rows, "at int, row array<double>").coalesce(1).write.parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, item_id: str = "vec_id", vec: str = "embedding") -> CellIndex:
    def matrix(name):
        return np.array([r["row"] for r in spark.read.parquet(f"{path}/{name}").orderBy("at").collect()])

    return CellIndex(spark.read.parquet(f"{path}/vectors"), matrix("centres"), matrix("sample"), item_id, vec)


def _scan(k: int, q_id: str, item_id: str, q_vec: str, vec: str, shared):
    """The best k of a cell's part per query, and how many were compared."""
    def scan(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {q_id: [], item_id: [], "score": [], "compared": []}
        if len(held) and len(asked):
            centre = shared.value[int(held["cell"].iloc[0])]
            about, units, ids = _decoded(held["code"], held["size"], centre), _units(held[vec]), held[item_id].to_numpy()
            q = _units(asked[q_vec])
            for at in range(0, len(q), 256):  # bounds the matrix of estimates
                near = q[at : at + 256] @ about.T >= asked["estimate"].to_numpy()[at : at + 256, None]
                for r, own in enumerate(near):
                    rows = np.flatnonzero(own)
                    scores = units[rows] @ q[at + r]
                    best = np.lexsort((ids[rows], -np.round(scores, 9)))[:k]
                    out[q_id] += [asked[q_id].iloc[at + r]] * (len(best) + 1)
                    out[item_id] += [*ids[rows[best]], None]
                    out["score"] += [*scores[best], None]
                    out["compared"] += [*[0] * len(best), len(rows)]
        return pd.DataFrame(out).astype({item_id: "Int64" if len(held) and held[item_id].dtype.kind == "i" else object,
                                         "score": "float64", "compared": "int64"})

    return scan


def _scanned(index: CellIndex, queries: DataFrame, k: int, probes: int, keep: float, q_id: str, q_vec: str, part_rows: int) -> DataFrame:
    item_id, vec = index.item_id, index.vec
    asked = _probing(queries.select(q_id, q_vec), index, probes, keep, q_vec)
    sizes = index.vectors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))  # a row per cell
    held = index.vectors.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64(item_id), F.col("parts")).cast("int"))
    spread = asked.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    schema = T.StructType([queries.schema[q_id], index.vectors.schema[item_id], T.StructField("score", T.DoubleType()),
                           T.StructField("compared", T.LongType())])
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)
    return held.select("cell", "part", item_id, vec, "code", "size").groupBy("cell", "part").cogroup(
        spread.select("cell", "part", q_id, q_vec, "estimate").groupBy("cell", "part")).applyInPandas(
        _scan(k, q_id, item_id, q_vec, vec, shared), schema)


def search(index: CellIndex, queries: DataFrame, k: int = 5, probes: int = 8, keep: float = 0.15, q_id: str = "qid", q_vec: str = "qvec",
           part_rows: int = 20_000) -> DataFrame:
    """(q_id, rank, id, score): the k nearest by cosine that the codes of each
    query's ``probes`` nearest cells bring up; ``keep`` 1 compares all of them."""
    found = _scanned(index, queries, k, probes, keep, q_id, q_vec, part_rows)
    return top_k(found.where(F.col(index.item_id).isNotNull()), q_id, index.item_id, k)


def search_quality(index: CellIndex, queries: DataFrame, exact: DataFrame, k: int = 5, probes: int = 8, keep: float = 0.15,
                   q_id: str = "qid", q_vec: str = "qvec", part_rows: int = 20_000) -> DataFrame:
    """One row: n_queries, recall (share of exact hits found), candidate_share
    (pairs compared exactly, of all pairs)."""
    found = _scanned(index, queries, k, probes, keep, q_id, q_vec, part_rows)
    pairs = found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("pairs"))
    approx = top_k(found.where(F.col(index.item_id).isNotNull()), q_id, index.item_id, k)
    hit = exact.join(approx.select(q_id, index.item_id, F.lit(1).alias("hit")), [q_id, index.item_id], "left")
    recall = hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    counts = queries.agg(F.count(F.lit(1)).alias("n_queries"))
    total = index.vectors.agg(F.count(F.lit(1)).alias("total"))
    row = counts.join(F.broadcast(recall)).join(F.broadcast(pairs)).join(F.broadcast(total))  # single rows
    return row.select("n_queries", F.round("recall", 6).alias("recall"),
                      F.round(F.col("pairs") / (F.col("n_queries") * F.col("total")), 6).alias("candidate_share"))
