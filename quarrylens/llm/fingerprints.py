"""Document fingerprints: a Merkle tree over paragraphs and sections.

Tree: a paragraph is a line; its node is the md5 of the line. A section is a
run of paragraphs that ends after a blank line, or after a paragraph whose
hash is divisible by ``SECTION_EVERY`` (cut by content, so an edit moves the
cuts next to it only), or with the text; its node is the md5 of its
paragraphs' nodes. The root is the sha256 of the sections' nodes, so two texts
have one root exactly if they are equal. Every paragraph also lists a 31-bit
label per run of words, so that an edit inside a paragraph is located and
short texts compare too. A run ends after the first word of its line, after a
word whose hash is divisible by ``RUN_EVERY`` (cut by content, as sections
are), and with the line.

Fingerprint: ``root/section[paragraph:label.label,...];section[...]`` with the
first 8 hex digits of section and paragraph nodes. ``diff_branches`` walks two
trees from the root and returns the paragraphs of the second that the first
lacks. ``likeness`` is 1 for equal roots, else twice the common distinct
labels over both numbers of distinct labels plus one, so below 1.

Defined cases: null text is the empty text, which has one empty paragraph and
no label; doc_id is the key: of rows that repeat one, the row with the least
text counts; rows without doc_id have no place in the order and are left out;
extra columns are ignored. With one document, its next document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import stored

SECTION_EVERY = 8
RUN_EVERY = 4
#: A word with the white space after it (the first one: around it), or a blank line.
WORD = r"\s*\S+\s*|\s+"


def runs(line: Column) -> Column:
    """array<string>: the line's runs of words; together they are the line."""
    words = F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
    ends = lambda w, i: (i == 0) | (F.pmod(F.xxhash64(F.regexp_extract(w, r"^\S*", 0)), F.lit(RUN_EVERY)) == 0)
    marked = F.transform(words, lambda w, i: F.when(ends(w, i), F.concat(w, F.lit("\n"))).otherwise(w))  # a line holds no line break
    return F.filter(F.split(F.array_join(marked, ""), "\n", -1), lambda r: r != "")


def paragraphs(text: Column) -> Column:
    """array<struct<h md5, b labels, e ends a section>>, one per line."""
    lines = F.split(text, "\n", -1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.md5(x).alias("h"),
            F.transform(runs(x), lambda u: F.hash(u).bitwiseAND(0x7FFFFFFF)).alias("b"),
            ((F.trim(x) == "") | (F.pmod(F.xxhash64(x), F.lit(SECTION_EVERY)) == 0)).alias("e"),
        ),
    )


def sections(paras: Column) -> Column:
    """array<array<paragraph>>: runs that end at a paragraph with ``e``."""
    n = F.size(paras)
    ends = F.array_union(
        F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(paras, i)["e"]), F.array(n)
    )
    before = F.concat(F.array(F.lit(0)), ends)
    return F.transform(ends, lambda e, i: F.slice(paras, F.get(before, i) + 1, e - F.get(before, i)))


def _with_tree(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: struct<root, labels, fingerprint> of the text column."""
    p, s, h = f"_{out}_p", f"_{out}_s", f"_{out}_h"
    df = df.withColumn(p, paragraphs(F.col(text)))
    df = df.withColumn(s, sections(F.col(p)))
    df = df.withColumn(h, F.transform(s, lambda x: F.md5(F.concat_ws("", x["h"]))))
    root = F.sha2(F.concat_ws("", F.col(h)), 256)
    body = F.concat_ws(";", F.transform(s, lambda x, i: F.concat(
        F.substring(F.get(F.col(h), i), 1, 8), F.lit("["),
        F.concat_ws(",", F.transform(x, lambda q: F.concat(
            F.substring(q["h"], 1, 8), F.lit(":"),
            F.concat_ws(".", F.transform(q["b"], F.hex)),
        ))), F.lit("]"))))
    df = df.withColumn(out, F.struct(
        root.alias("root"),
        F.array_distinct(F.flatten(F.col(f"{p}.b"))).alias("labels"),
        F.concat(root, F.lit("/"), body).alias("fingerprint"),
    ))
    return df.drop(p, s, h)


def fingerprint(docs: DataFrame, out: str = "tree") -> DataFrame:
    """``docs`` with the struct column ``out``: root, labels, fingerprint."""
    base = docs.withColumn("_fp_text", F.coalesce(F.col("text"), F.lit("")))
    return _with_tree(base, "_fp_text", out).drop("_fp_text")


def likeness(a_root: Column, a_labels: Column, b_root: Column, b_labels: Column) -> Column:
    both = F.size(F.array_intersect(a_labels, b_labels))
    return F.when(a_root == b_root, F.lit(1.0)).otherwise(2.0 * both / (F.size(a_labels) + F.size(b_labels) + 1.0))


def diff_branches(a: str, b: str) -> Column:
    """Paragraphs of fingerprint column ``b`` whose branch is not in ``a``:
    sections equal to one of ``a`` are skipped whole, then paragraphs."""
    def branches(c: str) -> Column:
        return F.split(F.element_at(F.split(F.col(c), "/"), 2), ";")

    changed = F.array_except(branches(b), branches(a))
    inner = lambda s: F.split(F.regexp_extract(s, r"\[(.*)\]", 1), ",")
    old = F.flatten(F.transform(F.array_except(branches(a), branches(b)), inner))
    new = F.flatten(F.transform(changed, inner))
    return F.when(F.col(a) == F.col(b), F.array().cast("array<string>")).otherwise(F.array_except(new, old))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next greater doc_id, after the last the first.

    Ids alone are dealt out by range and numbered by task once, in a stored
    table; a window within each task finds the next id, and each task's last
    id takes the first one of the next task, from one row per task."""
    ids = stored(
        docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
        .repartitionByRange("doc_id").withColumn("task", F.spark_partition_id()),
        "doc-ids",
    )
    firsts = ids.groupBy("task").agg(F.min("doc_id").alias("_first"))
    order = Window.orderBy("task")  # one row per task
    firsts = firsts.select(
        "task",
        F.coalesce(F.lead("_first").over(order),
                   F.first("_first").over(order)).alias("_after"),
    )
    inside = ids.withColumn("_next", F.lead("doc_id").over(Window.partitionBy("task").orderBy("doc_id")))
    return inside.join(firsts, "task").select("doc_id", F.coalesce("_next", "_after").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document: its text, the text with its last half replaced by the
    start of the next document's, and both trees and the next one's.

    The texts are shuffled once, by doc_id (the three uses read one
    exchange); only the part of a next text that is used, and its labels,
    travel on to the document before it."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    base = (
        docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_k", rank).where("_k = 1").drop("_k")
    )
    pairs = stored(next_ids(docs), "next-ids")
    needs = base.join(pairs, "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_for"),
        F.floor(F.char_length("text") / 2).cast("int").alias("_half"),
    )
    heads = fingerprint(base.join(needs, "doc_id"), "_t").select(
        F.col("_for").alias("doc_id"),
        F.expr("left(text, _half)").alias("_head"),
        F.col("_t.root").alias("next_root"), F.col("_t.labels").alias("next_labels"),
    )
    out = fingerprint(base.join(heads, "doc_id"), "tree").withColumn("n_chars", F.char_length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    out = out.withColumn("edited", F.concat(F.left("text", kept), F.col("_head")))
    return _with_tree(out, "edited", "edited_tree")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = edited_pairs(docs)
    like = lambda b_root, b_labels: likeness(F.col("tree.root"), F.col("tree.labels"), b_root, b_labels)
    return t.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.fingerprint").alias("fingerprint"),
        F.col("edited_tree.fingerprint").alias("edited_fingerprint"),
        like(F.col("edited_tree.root"), F.col("edited_tree.labels")).alias("near_edited"),
        like(F.col("next_root"), F.col("next_labels")).alias("near_next"),
    )
