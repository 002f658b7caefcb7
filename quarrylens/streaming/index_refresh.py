"""Incremental narrative-index refresh as a Structured Streaming job.

New narrative files land in a folder; each micro-batch keeps rows with an
id and a text, drops ids repeated inside the batch, anti-joins against the
index table and appends the rest - the documents and their term
frequencies (the lexical index's postings input). ``availableNow`` runs
every file that has landed and stops, so the same job serves a scheduled
refresh and a backfill.

Exactly-once without a transactional sink: the file source records which
files a batch read, and a retried batch (say, after an executor was lost
mid-write) anti-joins against what is already in the index, so ids written
by the failed attempt are not written twice. The checkpoint lives under the
shared folder named by ``spark.checkpoint.dir``.

A batch stores a segment: its documents' term frequencies and, as a delta, its
document frequencies. Search sums the deltas, a row per term and segment, and
never counts postings again. ``compact`` joins all segments so far into one;
it writes a folder of its own, which counts once it is complete, and changes
nothing that a reader may have open. A segment counts where the documents table
has documents of its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.retrieval import LexicalIndex, new_for_index, term_frequencies, weighted_index
from quarrylens.session import ensure_checkpoint_dir
from quarrylens.sources.io import exists

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
])


def _existing_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids stored at ``path``; none where nothing was written yet. A storage
    error rises: taken for "nothing there", it would append the corpus again."""
    if not exists(spark, path):
        return spark.createDataFrame([], "doc_id long")
    return spark.read.parquet(path).select("doc_id")


def _compacted(spark: SparkSession, index_path: str) -> tuple[int, str | None]:
    """(last batch in it, folder) of the latest complete compaction."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{index_path}/compacted/upto=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    folders = [f.getPath().getParent().toString() for f in found]
    return max(((int(f.rsplit("=", 1)[1].split("-")[0]), f) for f in folders), default=(-1, None))


def refresh_batch(batch: DataFrame, batch_id: int, index_path: str) -> None:
    """One micro-batch: C16 + dedup + J3 anti-join, then append term
    frequencies, their document frequencies and the docs, all partitioned by
    batch. Known ids come from the docs alone, never from all postings; a retry
    after a failure between the writes skips the ids whose postings that
    attempt at the batch wrote. After a compaction batches are numbered from
    beyond it, also those of a new checkpoint. Runs as ordinary batch jobs, so
    AQE applies."""
    spark = batch.sparkSession
    number = batch_id + _compacted(spark, index_path)[0] + 1
    batch = batch.persist()
    try:
        docs_path, terms_path = f"{index_path}/docs", f"{index_path}/terms"
        new_docs = new_for_index(batch, _existing_ids(spark, docs_path), "doc_id", "text")
        # of the postings, only a failed attempt at this batch can hold ids that docs lack
        tried = f"{terms_path}/indexed_batch={number}"
        new_terms = new_for_index(new_docs, _existing_ids(spark, tried), "doc_id", "text")
        term_frequencies(new_terms, "doc_id", "text").withColumn("indexed_batch", F.lit(number)) \
            .write.mode("append").partitionBy("indexed_batch").parquet(terms_path)
        if exists(spark, tried):  # the batch's own folder, of which no reader knows before its docs are there
            spark.read.parquet(tried).groupBy("term").agg(F.count(F.lit(1)).alias("df")) \
                .write.mode("overwrite").parquet(f"{index_path}/dfs/indexed_batch={number}")
        new_docs.withColumn("indexed_batch", F.lit(number)) \
            .write.mode("append").partitionBy("indexed_batch").parquet(docs_path)
    finally:
        batch.unpersist()


def _segments(spark: SparkSession, index_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, dfs, docs) of all committed batches: the latest compaction and
    the segments since, without those of batches that never committed."""
    upto, folder = _compacted(spark, index_path)
    docs = spark.read.parquet(f"{index_path}/docs").select("doc_id", "indexed_batch")
    recent = docs.where(F.col("indexed_batch") > upto)
    parts = {"terms": ["doc_id", "term", "tf"], "dfs": ["term", "df"]}
    out = []
    for name, columns in parts.items():
        rows = spark.read.parquet(f"{index_path}/{name}").where(F.col("indexed_batch") > upto)
        key = ["doc_id", "indexed_batch"] if name == "terms" else ["indexed_batch"]
        rows = rows.join(recent.select(*key).distinct(), key, "left_semi").select(*columns)
        if folder:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/{name}").select(*columns))
        out.append(rows)
    return out[0], out[1], docs.select("doc_id")


def compact(spark: SparkSession, index_path: str) -> str:
    """Joins all committed segments into one; returns its folder. Segments that
    it covers may be deleted once no reader uses them any more."""
    from uuid import uuid4

    last = spark.read.parquet(f"{index_path}/docs").agg(F.max("indexed_batch")).first()[0]
    terms, dfs, _ = _segments(spark, index_path)
    folder = f"{index_path}/compacted/upto={last}-{uuid4().hex}"
    terms.repartition("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/terms")
    dfs.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/dfs")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()
    return folder


def start_refresh(spark: SparkSession, landing_path: str, index_path: str,
                  name: str = "narrative_index", max_files_per_trigger: int | None = None,
                  checkpoint: str | None = None):
    """Start the refresh; returns the ``StreamingQuery`` (``availableNow``).
    ``checkpoint`` defaults to ``<spark.checkpoint.dir>/streams/<name>``."""
    reader = spark.readStream.schema(DOC_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(landing_path)
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    return (src.writeStream.queryName(name)
            .option("checkpointLocation", ckpt)
            .foreachBatch(lambda df, bid: refresh_batch(df, bid, index_path))
            .trigger(availableNow=True)
            .start())


def refreshed_index(spark: SparkSession, index_path: str, persist: bool = False) -> LexicalIndex:
    """The searchable index of all committed batches; idf comes from the stored
    document frequencies. With ``persist`` the caller releases it
    (``LexicalIndex.unpersist``)."""
    terms, dfs, docs = _segments(spark, index_path)
    return weighted_index(terms, docs, persist=persist, dfreq=dfs.groupBy("term").agg(F.sum("df").alias("df")))


def index_meta(spark: SparkSession, index_path: str) -> DataFrame:
    """R3 over the refreshed table: rows added per batch and running total
    (the window runs over one row per batch, not over documents)."""
    docs = spark.read.parquet(f"{index_path}/docs")
    w = Window.orderBy("indexed_batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (docs.groupBy("indexed_batch").agg(F.count(F.lit(1)).alias("newly_added"))
            .withColumn("total_indexed", F.sum("newly_added").over(w)))
