"""Merkle dataset manifest: one root over all rows, and every row's proof.

A row's leaf is H (lowercase hex SHA-256) of its fields, each ``-`` if null,
else its UTF-8 byte count, ``:`` and its value. Per source, leaves ascend by
doc_id, and while there are several nodes every ``FANOUT`` consecutive ones
become the H of their digests; what remains is the source's subroot. The
subroots, by source (null first, then by bytes), give the root likewise.

1. Places. Leaves are range-sorted by (source, doc_id); a partition's share of
   a source is counted, so a source with a third of all rows spreads over many
   tasks and no window runs over more than one row per partition.
2. Superblocks. ``FANOUT ** LEVELS`` consecutive leaves of a source reduce to
   one node in one group. These nodes are the leaves of a smaller tree, proved
   the same way (a step per ``LEVELS`` levels), and the subroots one more tree.
3. Exchange. Leaves are cogrouped with the one row that their superblock needs
   from outside: the siblings above it. The group finishes the local levels,
   joins both parts of each proof, and folds the leaf at hand up to the root.

Result of ``manifest``: doc_id, source, leaf, subroot, root, proof (the digests
beside the path, two strings a level: those left and those right of the node,
concatenated), folded_root (from the checked leaf and the proof), verified.

Defined cases: rows that repeat a doc_id in a source are leaves of their own,
ordered by their digest; a null doc_id comes first in its source and ``-`` in
the leaf; null fields are ``-`` and empty ones ``0:``; a source with one row
has that leaf as its subroot; an empty table gives no rows; other columns are
ignored, whatever their names; nothing depends on a text's length.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import stored

FANOUT, LEVELS = 3, 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each with its length, so that no two rows run together."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)), 256)


def grown(digests: list[str], levels: int | None) -> list[list[str]]:
    """The levels of the tree over ``digests``, up to one node or, where
    ``levels`` is set, exactly so many above them."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        row = out[-1]
        out.append([digest("".join(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[str]:
    """What lies left and right of node i's path in its runs, level by level."""
    out = []
    for row in tree[:-1]:
        first = i - i % FANOUT
        out += ["".join(row[first:i]), "".join(row[i + 1 : first + FANOUT])]
        i //= FANOUT
    return out


def fold(leaf: str, proof: list[str]) -> str:
    """The root that ``leaf`` and the proof's digests give."""
    for left, right in zip(proof[::2], proof[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place (from 0) in their ``tree`` by
    ``order``, and ``n``, the tree's number of rows."""
    keys = ["tree", *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # written once: both uses below must see the same partitions
    held = stored(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "merkle-places")
    shares = held.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    here = Window.partitionBy("tree").orderBy("_part")  # a row per partition that holds some of the tree
    before = F.sum("_rows").over(here) - F.col("_rows")
    total = F.sum("_rows").over(Window.partitionBy("tree"))
    shares = shares.select("tree", "_part", (before - F.col("_first")).alias("_shift"), total.alias("n"))
    return held.join(shares, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _local(rows: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock's rows in order, and their levels."""
    rows = rows.sort_values("pos", ignore_index=True)
    return rows, grown(rows["digest"].tolist(), levels if rows["n"].iloc[0] > FANOUT**levels else None)


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / FANOUT**levels).cast("long")


def superblocks(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, n, digest): the top of every run of ``FANOUT ** levels``
    consecutive nodes (tree, pos, n, digest)."""
    span = FANOUT**levels

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _local(rows, levels)
        return pd.DataFrame({"tree": rows["tree"][:1], "pos": rows["pos"][:1] // span, "n": -(-rows["n"][:1] // span), "digest": [tree[-1][0]]})

    return nodes.select("tree", "pos", "n", "digest").groupBy("tree", _block(levels).alias("block")).applyInPandas(
        top, "tree string, pos long, n long, digest string")


def proved(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, proof, top) of nodes (tree, pos, n, digest): the digests
    beside the path to the tree's top node, and that node."""
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select("tree", "pos", F.array().cast("array<string>").alias("proof"), F.col("digest").alias("top"))
    outer = proved(stored(superblocks(nodes, levels), "merkle-blocks"), levels)

    def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _local(rows, levels)
        rest, top = above["proof"].iloc[0], above["top"].iloc[0]
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "top": top,
                             "proof": [siblings(tree, i) + list(rest) for i in range(len(rows))]})

    return nodes.select("tree", "pos", "n", "digest").groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "pos")).applyInPandas(
        finish, "tree string, pos long, top string, proof array<string>").select("tree", "pos", "proof", "top")


def manifest(docs: DataFrame, checked: Column | None = None, when: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaves, roots and proofs of ``docs``; every row's proof is folded with
    the leaf of its text or, where ``when`` holds, of the text ``checked``."""
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select(*FIELDS, (F.lit(None).cast("string") if checked is None else checked).alias("_checked"),
                      F.coalesce(F.lit(checked is not None) if when is None else when, F.lit(False)).alias("_when"))
    leaves = stored(own.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("tree"), leaf_digest(*map(F.col, FIELDS)).alias("digest"),
        F.when(F.col("_when"), leaf_digest(*map(F.col, FIELDS[:-1]), F.col("_checked"))).alias("shown")), "merkle-leaves")
    leaves = stored(placed(leaves, ["doc_id", "digest"]), "merkle-leaves-placed")
    within = stored(proved(stored(superblocks(leaves, levels), "merkle-blocks"), levels), "merkle-sources")
    subroots = within.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("top").alias("digest"))
    subroots = stored(placed(subroots, ["member"]), "merkle-subroots")
    across = proved(subroots, levels).select("pos", F.col("proof").alias("proof_above"), F.col("top").alias("root"))
    across = subroots.join(across, "pos").select(F.col("member").alias("tree"), "proof_above", "root")
    outer = within.join(across, "tree").select("tree", "pos", "top", "root", F.concat("proof", "proof_above").alias("proof"))

    def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _local(rows, levels)
        rest, top, root = (above[c].iloc[0] for c in ("proof", "top", "root"))
        proofs = [siblings(tree, i) + list(rest) for i in range(len(rows))]
        shown = rows["shown"].where(rows["shown"].notna(), rows["digest"])
        folded = [fold(*x) for x in zip(shown, proofs)]
        return pd.DataFrame({"doc_id": rows["doc_id"], "source": rows["source"], "leaf": rows["digest"], "subroot": top, "root": root,
                             "proof": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    return leaves.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "pos")).applyInPandas(
        finish, f"doc_id {kind}, source string, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({s}) + 1), lambda i:
    [ord(({s})[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, v:
    CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string expression, in DuckDB SQL."""
    return _CRC.format(s=text)


def _field(name: str) -> str:
    return f"coalesce(strlen(({name})::VARCHAR)::VARCHAR || ':' || ({name})::VARCHAR, '-')"


_HEAD = " || ".join(map(_field, FIELDS[:-1]))

ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, {crc32_sql("doc_id::VARCHAR")} % 2 = 0 AS odd FROM documents),
h AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256({_HEAD} || {_field("text")}) AS leaf,
         CASE WHEN odd THEN sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) END AS shown FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS n FROM h),
a(tree, lvl, pos, x, n) AS (
  SELECT tree, 0, pos, leaf, n FROM p
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)), any_value((n + 2) // 3) FROM a WHERE n > 1 GROUP BY tree, lvl, pos // 3),
s AS (SELECT tree, x AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b(lvl, pos, x, n) AS (
  SELECT 0, pos, subroot, n FROM s
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)), any_value((n + 2) // 3) FROM b WHERE n > 1 GROUP BY lvl, pos // 3),
sa AS (SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(o.x, '' ORDER BY o.pos) FILTER (WHERE o.pos < a.pos), '') AS l,
              coalesce(string_agg(o.x, '' ORDER BY o.pos) FILTER (WHERE o.pos > a.pos), '') AS r
       FROM a JOIN a o ON o.tree = a.tree AND o.lvl = a.lvl AND o.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.pos),
sb AS (SELECT b.lvl, b.pos, coalesce(string_agg(o.x, '' ORDER BY o.pos) FILTER (WHERE o.pos < b.pos), '') AS l,
              coalesce(string_agg(o.x, '' ORDER BY o.pos) FILTER (WHERE o.pos > b.pos), '') AS r
       FROM b JOIN b o ON o.lvl = b.lvl AND o.pos // 3 = b.pos // 3 WHERE b.n > 1 GROUP BY b.lvl, b.pos),
fa(id, tree, lvl, pos, x, proof, done) AS (
  SELECT id, tree, 0, pos, coalesce(shown, leaf), '', n = 1 FROM p
  UNION ALL SELECT f.id, f.tree, f.lvl + 1, f.pos // 3, sha256(sa.l || f.x || sa.r), f.proof || sa.l || sa.r,
                   NOT EXISTS (SELECT 1 FROM a WHERE a.tree = f.tree AND a.lvl = f.lvl + 1 AND a.n > 1)
  FROM fa f JOIN sa ON sa.tree = f.tree AND sa.lvl = f.lvl AND sa.pos = f.pos),
fb(id, lvl, pos, x, proof, done) AS (
  SELECT f.id, 0, s.pos, f.x, f.proof, s.n = 1 FROM fa f JOIN s ON s.tree = f.tree WHERE f.done
  UNION ALL SELECT f.id, f.lvl + 1, f.pos // 3, sha256(sb.l || f.x || sb.r), f.proof || sb.l || sb.r,
                   NOT EXISTS (SELECT 1 FROM b WHERE b.lvl = f.lvl + 1 AND b.n > 1)
  FROM fb f JOIN sb ON sb.lvl = f.lvl AND sb.pos = f.pos),
root AS (SELECT x AS root FROM b WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = root.root AS verified
FROM p JOIN s ON s.tree = p.tree JOIN fb f ON f.id = p.id AND f.done, root
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = manifest(docs, F.replace("text", F.lit("\n"), F.lit("")), tampered)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified")
