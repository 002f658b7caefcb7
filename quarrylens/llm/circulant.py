"""Near-dedup by circulant MinHash.

Words are what stands between white space (ASCII), A-Z in lower case; a
document's set holds its distinct three-word shingles, or all its words as one
shingle if it has fewer. Documents are linked if their sets' intersection is at
least ``PERCENT`` in a hundred of their union.

1. Signatures. Two permutations of the 32-bit numbers: the first shuffles a
   set's hashes, the second, shifted circularly by 0, 1, 2, ..., gives as many
   coordinates as wanted, each the least value over the set. ``BANDS`` keys of
   ``ROWS`` coordinates each are its bands. Equal sets are copies; the least
   doc_id stands for them.
2. Candidates are sets that share a band key: a pair at the threshold shares
   none with probability (1 - 0.85^5)^30 = 2e-8. Clusters are the components
   of shared keys.
3. Verification, exact, in groups of at most about ``WEIGHT`` shingles. A small
   cluster is one group. In a large one every set is first compared with the
   least set among those it shares a key with; what is linked so needs no
   further comparison. Only keys that still hold several components are looked
   at again, by pairs of blocks that share such a key. In a group a pair counts
   if it lies in different components, shares a band and agrees in ``LEAST``
   coordinates (a linked pair has fewer with probability under 1e-9), and its
   sets are then intersected. A group returns one row per linked set, with its
   local component, never a row per pair.
4. The components of all links are the result.

Result: doc_id, n_shingles, component_id (least doc_id reachable), kept.

Defined cases: texts without words (null and empty ones too) have no shingles
and stay alone; rows that repeat a doc_id count as one document (the one with
the least set digest); rows without doc_id are left out; an empty table gives
no rows; extra columns are ignored; a very long text is one set, in a group of
its own where it exceeds ``WEIGHT``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from quarrylens.llm._common import stored
from quarrylens.llm.components import components
from quarrylens.llm.jaccard import common_shingles

WORDS, PERCENT = 3, 85
BANDS, ROWS, LEAST = 30, 5, 95
#: Shingles per group; a set counts as WEIGHT / SETS at least.
WEIGHT, SETS = 1 << 20, 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


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
    return np.unique(_mix64(h))


def _permuted(y: np.ndarray) -> np.ndarray:
    """The second permutation: each step is a bijection of 32-bit numbers."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        y ^= y >> np.uint32(shift)
        y *= np.uint32(factor)
    y ^= y >> np.uint32(16)
    return y


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second permutation of the
    first one's values, moved back by k around the circle of 2^32."""
    placed = (_mix64(shingles ^ _BASE) >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), 1024):
        out = np.minimum(out, _permuted(placed[None, at : at + 1024] - _SHIFTS).min(axis=1))
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix64(h * _BASE + v[:, k])
    return h.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return xxh3_128_digest(shingles.tobytes())


def signed_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, bands) per document; digest null without words."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sets = [shingle_set(t.as_py()) for t in rows.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([band_keys(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "n", "bands"])

    made = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(each, f"doc_id {kind}, digest binary, n long, bands array<long>")
    return made.groupBy("doc_id").agg(F.min(F.struct("digest", "n", "bands")).alias("s")).select("doc_id", "s.*")


def shared_keys(sets: DataFrame) -> DataFrame:
    """(rep, keys, heads) of the sets that share a band key: those keys, as
    (band, key), and the least other sets behind them, ``BANDS`` at most."""
    rows = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    heads = rows.groupBy("band", "key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(heads, ["band", "key"]).groupBy("rep").agg(
        F.collect_list(F.struct("band", "key")).alias("keys"), F.collect_set(F.when(F.col("rep") != F.col("head"), F.col("head"))).alias("heads"))


def _parts(weight: str) -> Column:
    return F.ceil(F.sum(weight) / WEIGHT).cast("int")


def _dealt(parts: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")


def _local(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(percent: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "side"]).sort_values("rep", ignore_index=True)
        side, comp = rows["side"].to_numpy(), rows["comp"].to_numpy()
        whole = (side == 0).all()
        first = np.flatnonzero(side < 2)
        second = np.flatnonzero(side != 1)
        marks = np.stack([np.frombuffer(s, np.uint32) for s in rows["signature"]])
        size = rows["n"].to_numpy()
        found_i, found_j = [], []
        for a, row in enumerate(first):
            others = second[a + 1 :] if whole else second
            others = others[(comp[others] != comp[row]) & (100 * np.minimum(size[others], size[row]) >= percent * np.maximum(size[others], size[row]))]
            equal = marks[others] == marks[row]
            near = (equal.sum(axis=1) >= LEAST) & equal.reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)
            found_j.append(others[near])
            found_i.append(np.full(int(near.sum()), row))
        i, j = np.concatenate(found_i).astype(np.int64), np.concatenate(found_j).astype(np.int64)
        if len(i):
            sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            both = common_shingles(sets, sets, i, j)
            linked = 100 * both >= percent * (size[i] + size[j] - both)
            i, j = i[linked], j[linked]
        rep, least = rows["rep"].to_numpy(), _local(len(rows), i, j)
        at = np.unique(np.concatenate([i, j]))
        return pd.DataFrame({"u": rep[at], "v": rep[least[at]]})

    return compare


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, n, shingles, signature) of the documents ``wanted`` (rep, digest)."""
    kind = dict(docs.dtypes)["doc_id"]

    def with_sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                made = [shingle_set(t.as_py()) for t in rows.column("text")]
                right = [_digest(s) == d.as_py() for s, d in zip(made, rows.column("digest"))]
                made = [s for s, ok in zip(made, right) if ok]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rep").filter(pa.array(right, pa.bool_())), pa.array([len(s) for s in made], pa.int64()),
                     pa.array([s.tobytes() for s in made], pa.binary()), pa.array([signature(s).tobytes() for s in made], pa.binary())],
                    names=["rep", "n", "shingles", "signature"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep")
    return texts.select("rep", "text", "digest").mapInArrow(with_sets, f"rep {kind}, n long, shingles binary, signature binary")


def _verified(full: DataFrame, plan: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Links (u, v) found in the groups of ``plan`` (rep, comp, side, *key):
    pairs of sides 1 and 2, or all pairs where the side is 0."""
    kind = dict(full.dtypes)["rep"]
    return full.join(plan, "rep").groupBy(*key).applyInPandas(_compare(percent), f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document."""
    every = stored(signed_sets(docs), "circulant-sets")
    reps = stored(every.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), "circulant-copies")
    sets = every.join(reps, [every["digest"] == reps["digest"], every["doc_id"] == reps["rep"]]).select("rep", "n", "bands")
    shared = stored(shared_keys(sets), "circulant-keys")

    found = stored(components(shared.select(F.col("rep").alias("u"), F.explode("heads").alias("v"))), "circulant-clusters")
    heads = found.select(F.col("least").alias("rep")).distinct()
    clusters = found.select(F.col("node").alias("rep"), F.col("least").alias("cluster")).union(heads.select("rep", F.col("rep").alias("cluster")))
    weight = F.greatest(F.col("n"), F.lit(WEIGHT // SETS)).alias("weight")
    members = clusters.join(every.select(F.col("doc_id").alias("rep"), weight), "rep").join(shared, "rep")
    members = stored(members.select("rep", "cluster", "weight", "keys", F.array_min("heads").alias("head")), "circulant-members")
    sized = stored(members.groupBy("cluster").agg(_parts("weight").alias("parts")), "circulant-sizes")
    members = members.join(sized, "cluster")

    # small clusters whole; in large ones each set with the least one it shares a key with
    small = members.where("parts = 1").select("rep", F.col("rep").alias("comp"), F.lit(0).alias("side"), F.col("cluster").alias("group"), F.lit(0).alias("part"))
    large = members.where("parts > 1").drop("parts")
    star = large.where("head IS NOT NULL")
    star_parts = star.groupBy("head").agg(_parts("weight").alias("parts"))
    spokes = star.join(star_parts, "head").select("rep", F.col("rep").alias("comp"), F.lit(2).alias("side"), F.col("head").alias("group"), _dealt("parts").alias("part"))
    hubs = star_parts.select(F.col("head").alias("rep"), F.col("head").alias("comp"), F.lit(1).alias("side"), F.col("head").alias("group"),
                             F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # the texts are read once; the sets of the candidates are kept, some are needed again
    full = stored(_full_sets(docs, members.select("rep").join(reps, "rep")), "circulant-candidates")
    links = stored(_verified(full, small.union(spokes).union(hubs), ["group", "part"], percent), "circulant-links")
    if sized.where("parts > 1").limit(1).count():
        links = links.union(_residual_links(full, large, links, percent))

    least = components(links).select(F.col("node").alias("rep"), "least")
    named = reps.join(least, "rep", "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    # texts without words share no key to be joined on
    alone = every.where("digest IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = every.select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id").union(alone)
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), "component_id",
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _residual_links(full: DataFrame, large: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the components that ``links`` leaves of large clusters:
    pairs of blocks that share a key with several components in it."""
    known = components(links.join(large.select(F.col("rep").alias("u")), "u", "left_semi")).select(F.col("node").alias("rep"), "least")
    comps = stored(large.join(known, "rep", "left").withColumn("comp", F.coalesce("least", "rep")).drop("least"), "circulant-comps")
    rows = comps.select("comp", F.explode("keys").alias("k"))
    mixed = stored(rows.groupBy("k").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select("k"), "circulant-mixed")

    # blocks: a large component in parts of its own, the others of a cluster dealt out by component
    own = comps.groupBy("comp").agg(_parts("weight").alias("own"))
    rest = comps.groupBy("cluster").agg(_parts("weight").alias("all"))
    placed = comps.join(own, "comp").join(rest, "cluster").select(
        "rep", "comp", "keys", F.when(F.col("own") > 1, F.col("comp")).alias("pure"),
        F.when(F.col("own") > 1, F.xxhash64(F.lit(1), "comp", _dealt("own"))).otherwise(
            F.xxhash64(F.lit(2), "cluster", F.pmod(F.xxhash64("comp"), F.col("all")))).alias("block"))
    placed = stored(placed, "circulant-blocks")
    held = placed.select(F.explode("keys").alias("k"), "block", "pure").distinct().join(mixed, "k").select("k.band", "k.key", "block", "pure")
    other = held.select("band", "key", F.col("block").alias("high"), F.col("pure").alias("_pure"))
    pairs = held.withColumnRenamed("block", "low").join(other, ["band", "key"]).where(
        "low <= high AND NOT coalesce(pure = _pure, false)").select("low", "high").distinct()
    sides = stored(pairs, "circulant-pairs").select("low", "high", F.explode(F.when(F.col("low") == F.col("high"), F.array(
        F.struct(F.col("low").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(
            F.struct(F.col("low").alias("block"), F.lit(1).alias("side")), F.struct(F.col("high").alias("block"), F.lit(2).alias("side"))))).alias("s"))
    plan = sides.select("low", "high", "s.block", "s.side").join(placed, "block").select("rep", "comp", "side", "low", "high")
    return stored(_verified(full, plan, ["low", "high"], percent), "circulant-more-links")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(a) - 1, 2)), lambda i: array_to_string(a[i:i + 2], ' '))) AS g
  FROM w WHERE len(a) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
k AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT k.u AS doc_id, coalesce(z.n, 0) AS n_shingles, k.component_id, k.u = k.component_id AS kept FROM k LEFT JOIN z ON z.doc_id = k.u
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
