"""N-gram Jaccard join with Bayesian candidate pruning.

Words are what stands between white space (ASCII), A-Z in lower case; a
document's set holds its five-word shingles, or all its words as one shingle
if it has fewer than five. Two documents are linked if the Jaccard similarity
of their sets is at least ``THRESHOLD``.

1. Every set is digested to ``BANDS`` band keys of ``ROWS`` MinHash values.
   Documents with equal sets are copies; the least doc_id stands for them.
2. Sets that share a band key belong to one candidate cluster (components).
   A pair at the threshold shares none with probability (1 - t^5)^40 = 1.3e-7.
3. A cluster is compared in pairs of blocks of about ``BLOCK`` sets: MinHash
   values ``STEP`` at a time; a pair goes as soon as the posterior probability
   that its similarity reaches the threshold, under a uniform prior, is below
   ``TOLERANCE``; the other pairs' sets are intersected exactly. A pair of
   blocks returns a row per linked set, with its number of links and its local
   component, never a row per pair.
4. The components of the exact links are the classes.

Result: doc_id, class_id (least doc_id of the class), n_links (documents it is
linked to, copies among them).

Defined cases: texts without words (null and empty ones too) have no shingle
and link to nothing; rows that repeat a doc_id count as one document (the one
with the least set digest); rows without doc_id are left out; extra columns
are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from quarrylens.llm._common import stored
from quarrylens.llm.components import components

WORDS, THRESHOLD = 5, "0.8"
BANDS, ROWS = 40, 5
BLOCK, STEP, TOLERANCE = 256, 20, 1e-9

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    width = min(WORDS, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _BASE + w[k : n - width + 1 + k]
    return np.unique(_mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, unsigned 32-bit."""
    out = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 2048):
        values = (_MULTIPLIERS[:, None] * shingles[None, at : at + 2048]) >> np.uint64(32)
        out = np.minimum(out, values.min(axis=1).astype(np.uint32))
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _BASE + v[:, k])
    return h.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return xxh3_128_digest(shingles.tobytes())


def digest_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands) per row; digest null where there is no word."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sets = [shingle_set(t.as_py()) for t in rows.column(1)]
                keys = [_digest(s) if len(s) else None for s in sets]
                bands = [band_keys(signature(s)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "bands"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(
        each, f"doc_id {kind}, digest binary, bands array<long>")


def candidate_clusters(sets: DataFrame) -> DataFrame:
    """(rep, cluster) of the sets (rep, bands) that share a band key."""
    rows = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    least = rows.groupBy("band", "key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = rows.join(least, ["band", "key"]).where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    found = stored(components(edges), "candidate-clusters")
    heads = found.select(F.col("least").alias("rep")).distinct()
    return found.select(F.col("node").alias("rep"), F.col("least").alias("cluster")).union(
        heads.select("rep", F.col("rep").alias("cluster")))


@lru_cache
def least_matches(threshold: str, values: int) -> tuple[int, ...]:
    """Per comparison step, the fewest equal values of those compared so far
    with which P(similarity >= threshold) is at least ``TOLERANCE``."""
    t, out = float(threshold), []
    for n in range(STEP, values + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE and m < n:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving_pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks that the posterior leaves."""
    i, j = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices((len(a), len(b))))
    equal = np.zeros(len(i), np.int32)
    for step, least in enumerate(least_matches(threshold, a.shape[1])):
        part = slice(step * STEP, step * STEP + STEP)
        for at in range(0, len(i), 65536):
            cut = slice(at, at + 65536)
            equal[cut] += (a[i[cut], part] == b[j[cut], part]).sum(axis=1, dtype=np.int32)
        keep = equal >= least
        i, j, equal = i[keep], j[keep], equal[keep]
    return i, j


def common_shingles(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections a[i] & b[j]."""
    ua, ub = np.unique(i), np.unique(j)
    flat = np.concatenate([a[x] for x in ua] + [b[x] for x in ub])
    if len(i) * len(flat) / (len(ua) + len(ub)) * 2 < len(ua) * len(ub) * len(flat) / 50:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    names, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(ua) + len(ub)), [len(a[x]) for x in ua] + [len(b[x]) for x in ub])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(ua), len(ub)), np.float64)
    for at in range(0, len(names), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(ua) + len(ub), min(4096, len(names) - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        total += part[: len(ua)] @ part[len(ua) :].T
    return total[np.searchsorted(ua, i), np.searchsorted(ub, j)].astype(np.int64)


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(threshold: str):
    limit = Fraction(threshold)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep").sort_values("rep", ignore_index=True)
        same = rows["low"].iloc[0] == rows["high"].iloc[0]
        first = np.flatnonzero((rows["chunk"] == rows["low"]).to_numpy())
        second = first if same else np.flatnonzero((rows["chunk"] != rows["low"]).to_numpy())
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        marks = np.stack([np.frombuffer(s, np.uint32) for s in rows["signature"]])
        i, j = surviving_pairs(marks[first], marks[second], bool(same), threshold)
        if len(i):
            both = common_shingles([sets[x] for x in first], [sets[x] for x in second], i, j)
            i, j = first[i], second[j]
            size = np.array([len(s) for s in sets], np.int64)
            linked = both * limit.denominator >= limit.numerator * (size[i] + size[j] - both)
            i, j = i[linked], j[linked]
        copies, rep = rows["copies"].to_numpy(), rows["rep"].to_numpy()
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        at = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[at], "links": links[at].astype(np.int64), "least": rep[_least_reachable(len(rows), i, j)][at]})

    return compare


def similarity_classes(docs: DataFrame, threshold: str = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) per document."""
    kind = dict(docs.dtypes)["doc_id"]
    every = stored(digest_sets(docs).groupBy("doc_id").agg(F.min(F.struct("digest", "bands")).alias("s")).select(
        "doc_id", "s.digest", "s.bands"), "shingle-digests")
    # documents with equal sets have equal bands
    reps = stored(every.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "set-copies")
    sets = every.join(reps, [every["digest"] == reps["digest"], every["doc_id"] == reps["rep"]]).select("rep", "bands")
    clusters = stored(candidate_clusters(sets), "clusters")

    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    sized = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select("cluster", chunks.alias("chunks"))
    placed = clusters.join(sized, "cluster").join(reps, "rep").select(
        "rep", "cluster", "copies", "digest", "chunks", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"))

    def with_sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                made = [shingle_set(t.as_py()) for t in rows.column("text")]
                right = [_digest(s) == d.as_py() for s, d in zip(made, rows.column("digest"))]
                rows = rows.filter(pa.array(right, pa.bool_()))
                made = [s for s, ok in zip(made, right) if ok]
                columns = [rows.column(c) for c in ("rep", "cluster", "copies", "chunks", "chunk")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([s.tobytes() for s in made], pa.binary()),
                     pa.array([signature(s).tobytes() for s in made], pa.binary())],
                    names=["rep", "cluster", "copies", "chunks", "chunk", "shingles", "signature"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(placed, "rep")
    full = texts.mapInArrow(with_sets, f"rep {kind}, cluster {kind}, copies long, chunks int, chunk int, shingles binary, signature binary")
    other = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = other.select(
        "rep", "cluster", "copies", "chunk", "shingles", "signature",
        F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    linked = stored(blocks.groupBy("cluster", "low", "high").applyInPandas(
        _compare(threshold), f"rep {kind}, links long, least {kind}"), "exact-links")

    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    found = reps.join(links, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("least", "rep").alias("class_id"))
    # texts without words share no key to be joined on
    alone = every.where("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return every.select("doc_id", "digest").join(found, "digest").select("doc_id", "class_id", "n_links").union(alone)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(a) - 3, 2)), lambda i: array_to_string(a[i:i + 4], ' '))) AS g
  FROM w WHERE len(a) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE 5 * c >= 4 * (x.n + y.n - c)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
k AS (SELECT u, min(v) AS class_id FROM r GROUP BY u),
l AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT k.u AS doc_id, k.class_id, coalesce(l.n, 0) AS n_links FROM k LEFT JOIN l ON l.u = k.u
"""


def query(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
