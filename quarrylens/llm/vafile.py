"""Exact top-k search with a vector-approximation file.

Every vector of integers gets an approximation: per dimension, the number of
the cell it lies in, of ``CELLS`` equal cells between the dimension's least and
greatest value. A search scans approximations only: a cell's edges bound each
product, so a candidate's inner product is bounded from both sides. The k-th
best lower bound of a query rules out every candidate with a lesser upper
bound. What remains is read exactly in order of its upper bound (for inner
products, the lower bound of a distance): first ``FIRST_READ`` times k
vectors, then those whose bound still reaches the k-th exact score, after
which the result is certain. Scores are integers; ties go to the smaller id.

Queries and approximations meet in blocks of at most ``QUERY_BLOCK`` by about
``ROW_BLOCK``; each pair of blocks is one group, which returns bounds of its
surviving candidates only. Of equal vectors at most the k + 1 smallest ids can
be among any k results besides the query's own, so only those are searched.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor rows without vec_id; of rows that repeat a
vec_id, the one with the least vector counts; vectors of different length are
not compared; a score beyond 64 bits raises; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import stored

CELLS = 256
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
FIRST_READ = 2


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) per component, of the usable rows."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & finite)
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return usable.select("vec_id", ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def cell_marks(vectors: DataFrame) -> DataFrame:
    """(dim, lows, highs): least and greatest value per dimension, for each
    vector length."""
    each = vectors.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x"))
    ends = each.groupBy("dim", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return ends.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))).alias("m")).select(
        "dim", F.col("m.lo").alias("lows"), F.col("m.hi").alias("highs"))


def approximate(vectors: DataFrame, marks: DataFrame) -> DataFrame:
    """The approximation file: (vec_id, dim, code), one byte per dimension that
    numbers its cell."""
    rows = vectors.withColumn("dim", F.size("v")).join(F.broadcast(marks), "dim")  # one row per vector length
    cell = F.transform("v", lambda x, i: F.floor(
        (x - F.get("lows", i)).cast("double") * CELLS / (F.get("highs", i) - F.get("lows", i) + 1).cast("double")
    ))
    byte = F.transform(cell, lambda c: F.lpad(F.hex(F.least(c, F.lit(CELLS - 1)).cast("int")), 2, "0"))
    return rows.select("vec_id", "dim", F.unhex(F.array_join(byte, "")).alias("code"))


def _bounds(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value per dimension and cell, widened by one cell's
    rounding."""
    span = (highs - lows + 1).astype(np.float64)[:, None] / CELLS
    c = np.arange(CELLS)[None, :]
    base = lows.astype(np.float64)[:, None]
    slack = 1 + 1e-9 * span * CELLS
    return np.floor(base + c * span - slack), np.ceil(base + (c + 1) * span + slack)


def _scan(k: int):
    def scan(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in
                              (("query_id", "int64"), ("vec_id", "int64"), ("lower", "float64"), ("upper", "float64"))})
        if queries.empty or rows.empty:
            return empty
        lows, highs = (np.array(queries[c].iloc[0], dtype=np.int64) for c in ("lows", "highs"))
        least, most = _bounds(lows, highs)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        dims = np.arange(codes.shape[1])
        lo, hi = least[dims, codes].T, most[dims, codes].T
        q = np.stack(queries["v"].to_numpy()).astype(np.float64)
        qp, qm = np.maximum(q, 0), np.minimum(q, 0)
        ids, own = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        out = []
        for at in range(0, len(q), 128):
            up = qp[at : at + 128] @ hi + qm[at : at + 128] @ lo
            low = qp[at : at + 128] @ lo + qm[at : at + 128] @ hi
            slack = 1 + 1e-9 * np.abs(q[at : at + 128]) @ np.maximum(np.abs(lo), np.abs(hi))
            up, low = up + slack, low - slack
            self_ = own[at : at + 128, None] == ids[None, :]
            low[self_] = up[self_] = -np.inf
            if len(ids) > k:
                kth = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None]
            else:
                kth = np.full((len(low), 1), -np.inf)
            i, j = np.nonzero((up >= kth) & ~self_)
            out.append(pd.DataFrame({"query_id": own[at + i], "vec_id": ids[j], "lower": low[i, j], "upper": up[i, j]}))
        return pd.concat(out) if out else empty

    return scan


def _score(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows, for each
    row of ``vectors`` (vec_id, v) that is a query."""
    vectors = stored(vectors, "vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    row_blocks = max(1, math.ceil(total["n"] / ROW_BLOCK))
    query_blocks = max(1, math.ceil(total["q"] / QUERY_BLOCK))
    marks = cell_marks(vectors)
    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    searched = vectors.withColumn("_k", copies).where(F.col("_k") <= k + 1).drop("_k")
    blocked = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    codes = stored(approximate(searched, marks), "va-file").select(
        "vec_id", "dim", "code", blocked(row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asked = vectors.where(is_query)
    queries = asked.withColumn("dim", F.size("v")).join(F.broadcast(marks), "dim").select(
        "vec_id", "dim", "v", "lows", "highs", blocked(query_blocks).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    key = ["dim", "rb", "qb"]
    found = queries.groupBy(*key).cogroup(codes.groupBy(*key)).applyInPandas(
        _scan(k), "query_id long, vec_id long, lower double, upper double")

    # the k best lower bounds of each task meet before a query's do
    found = stored(found, "va-bounds")
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    floor = found.withColumn("_l", F.row_number().over(by_lower)).where(F.col("_l") <= k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("_floor"))
    left = stored(found.join(floor, "query_id").where(F.col("_floor").isNull() | (F.col("upper") >= F.col("_floor"))).select(
        "query_id", "vec_id", "upper"), "va-candidates")

    def exact(candidates: DataFrame) -> DataFrame:
        a = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("_q"))
        return candidates.join(vectors, "vec_id").join(a, "query_id").select(
            "query_id", "vec_id", _score(F.col("_q"), F.col("v")).alias("score"))

    by_upper = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    nearest = left.withColumn("_u", F.row_number().over(by_upper)).where(F.col("_u") <= FIRST_READ * k)
    first = stored(exact(nearest), "va-first-read")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    more = left.join(kth, "query_id").where(F.col("upper") >= F.col("_kth")).join(first, ["query_id", "vec_id"], "left_anti")
    scored = first.unionByName(exact(more))
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH u AS (
  SELECT vec_id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, min(list_transform(e, lambda x: floor(1024.0 * x::DOUBLE)::BIGINT)) AS v FROM u GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(integer_vectors(table), F.col("vec_id") % 100 == 0, 10)
