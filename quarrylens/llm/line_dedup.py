"""Line dedup: repeated three-line windows, found over all documents.

Lines are cut at ``\\n`` and compared without surrounding blanks. Blank lines
belong to no window and always stay. A window is three consecutive non-blank
lines; windows overlap, one starts at every line. A document with one or two
non-blank lines has one window, all its lines. The first occurrence of a
window, by (doc_id, place), stays; at every later one its lines are covered,
and the union of the covered lines is removed.

Only window hashes (128 bit), never texts, are grouped. A window that a third
of all documents share is one pre-aggregated row per task and then one row.

Defined cases: null text is the empty text and keeps zero lines; rows that
repeat a (doc_id, text) count as one document and get the same result; rows
with one doc_id and different texts are documents of their own, ordered by
their text's hash; a null doc_id sorts first; extra columns pass through,
but columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import let, stored

WIDTH = 3
BLANKS = " \t\r\f\v"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per window: (doc_id, _th, at, places, k1, k2); ``at`` counts a
    document's windows, ``places`` are the lines (from 0) it covers, and
    (k1, k2) is the hash of its lines."""
    lines = F.filter(
        F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("p"), _trimmed(x).alias("x"))),
        lambda s: s["x"] != "",
    )
    hashed = F.transform(
        lines,
        lambda s: F.struct(s["p"].alias("p"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit(7), s["x"]).alias("b")),
    )
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), hashed.alias("_l"))
    base = base.where(F.size("_l") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_l") - width, F.lit(0)))
    rows = base.select("doc_id", "_th", "_l", F.explode(starts).alias("at"))
    part = F.slice("_l", F.col("at") + 1, F.lit(width))
    rows = rows.select("doc_id", "_th", "at", part.alias("_w"))
    return rows.select(
        "doc_id", "_th", "at", F.col("_w.p").alias("places"),
        F.xxhash64("_w.a").alias("k1"), F.xxhash64(F.lit(7), F.col("_w.b")).alias("k2"),
    )


def covered_lines(windows: DataFrame) -> DataFrame:
    """(doc_id, _th, covered): the lines of every occurrence after the first."""
    me = F.struct("doc_id", "_th", "at")
    first = (
        windows.groupBy("k1", "k2")
        .agg(F.min(me).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("k1", "k2", "_first")
    )
    later = windows.join(first, ["k1", "k2"]).where(~me.eqNullSafe(F.col("_first")))
    return later.groupBy("doc_id", "_th").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("covered")
    )


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``text`` less its repeated windows, and ``n_lines``,
    ``n_removed`` (counted in lines of the input text)."""
    windows = stored(line_windows(docs, width), "line-windows")
    covered = covered_lines(windows).select(F.col("doc_id").alias("_id"), "_th", "covered")
    base = docs.drop("n_lines", "n_removed").withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = base.join(
        covered, F.col("doc_id").eqNullSafe(F.col("_id")) & (base["_th"] == covered["_th"]), "left"
    ).drop(covered["_th"])
    lines = _lines(F.col("text"))
    joined_up = let(lines, lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("covered")), lambda p: F.get(x, p)), "\n"))
    text = F.when(
        F.col("covered").isNull(), F.coalesce(F.col("text"), F.lit(""))
    ).otherwise(joined_up)
    n = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long")
    out = joined.withColumns({
        "n_lines": n,
        "n_removed": F.coalesce(F.size("covered"), F.lit(0)).cast("long"),
        "_text": text,
    })
    return out.drop("_id", "_th", "covered").withColumn("text", F.col("_text")).drop("_text")


ORACLE = """
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, t, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM s),
nb AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS x FROM l
  WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
o AS (
  SELECT doc_id, pos, x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n,
         lead(pos, 1) OVER w AS p1, lead(pos, 2) OVER w AS p2, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2
  FROM nb WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (
  SELECT doc_id, i, pos, p1, p2,
         row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, i) AS k
  FROM o WHERE i <= greatest(n - 3, 0)),
c AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest([pos, p1, p2]) AS p FROM g WHERE k > 1) WHERE p IS NOT NULL),
r AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.p IS NULL) AS kept,
         count(*) AS n_lines, count(c.p) AS n_removed
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.p GROUP BY l.doc_id)
SELECT r.doc_id, CASE WHEN s.t = '' THEN 0 ELSE r.n_lines END AS n_lines, r.n_removed, coalesce(kept, '') AS text
FROM r JOIN s ON r.doc_id = s.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
