"""Corpus pipeline: documents in, packed training sequences out.

Four stages, each over all rows that the one before it kept: toxic documents
go; repeated three-line windows are cut out of the texts; of every class of
near duplicates one document stays; what is left is cut into pieces and packed
into sequences. All but the last return the columns of ``documents``.

Defined cases: null texts are empty texts, which no stage rejects; rows that
repeat a doc_id and its text are one document for the near-duplicate stage, of
which one row stays; rows that repeat a doc_id with another text are documents
of their own there; rows without doc_id pass it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.llm import jaccard, line_dedup, packing, toxicity
from quarrylens.llm._common import stored


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, whatever their names."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))


def _unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from ``labels``; what it
    decides is joined to nothing: scoring passes the rows through."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.score(_packed(docs), model).where("predicted = 0"), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go; documents left with nothing but white
    space by that go with them, those that came so stay. ``n_chars`` follows."""
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = line_dedup.dedup_lines(_packed(docs)).where((F.col("n_removed") == 0) | worded)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        own = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("_rest.n_chars"))
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", own))
    return _unpacked(out, docs.columns)


def _document_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_key``: a number for each (doc_id, text), in order of
    doc_id; the doc_id itself where none has several texts. Ids too great to be
    multiplied by the most texts of one id raise."""
    marked = rows.withColumn("_mark", F.md5(F.coalesce("text", F.lit(""))))
    each = marked.select("doc_id", "_mark").distinct()
    several = stored(each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pipeline-ids")
    most = several.agg(F.max("n")).first()[0]
    if most is None:
        return rows.withColumn("_key", F.col("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_mark")) - 1
    placed = each.join(several.select("doc_id"), "doc_id", "left_semi").withColumn("_place", place)
    key = F.col("doc_id").cast("long") * F.lit(most) + F.coalesce("_place", F.lit(0))
    return marked.join(placed, ["doc_id", "_mark"], "left").withColumn("_key", key).drop("_mark", "_place")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the least doc_id stays."""
    packed = _packed(docs)
    rows = _document_keys(packed.where("doc_id IS NOT NULL"))
    classes = jaccard.similarity_classes(rows.select(F.col("_key").alias("doc_id"), "text"))
    heads = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_key"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("text"))
    kept = rows.join(heads, "_key", "left_semi").withColumn("_row", first).where("_row = 1").drop("_row", "_key")
    return _unpacked(kept.unionByName(packed.where("doc_id IS NULL")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_duplicates", keep_one_of_near), ("packing", pack)]

#: The toxicity model can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
