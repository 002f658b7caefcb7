"""Streaming index refresh: overlapping landings are indexed once."""

from pyspark.sql import functions as F

from quarrylens_testdata import SF_SMALL
from quarrylens.plans.bindings import table
from quarrylens.streaming import index_refresh as ir


def test_refresh_adds_only_new_ids(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    landing, index = str(tmp_path / "landing"), str(tmp_path / "index")
    docs.filter(F.col("doc_id") < 300).coalesce(1).write.parquet(f"{landing}/b1")
    q = ir.start_refresh(spark, f"{landing}/*", index, name="t1", max_files_per_trigger=1,
                         checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    assert spark.read.parquet(f"{index}/docs").count() == 300
    # second landing overlaps the first on 100 ids
    docs.filter((F.col("doc_id") >= 200) & (F.col("doc_id") < 500)).coalesce(1).write.parquet(f"{landing}/b2")
    q = ir.start_refresh(spark, f"{landing}/*", index, name="t1", max_files_per_trigger=1,
                         checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(f"{index}/docs")
    assert got.count() == 500 and got.select("doc_id").distinct().count() == 500
    meta = [(r["newly_added"], r["total_indexed"]) for r in ir.index_meta(spark, index).orderBy("indexed_batch").collect()]
    assert meta == [(300, 300), (200, 500)]
    # a fresh checkpoint re-reads every file, and still adds nothing
    q = ir.start_refresh(spark, f"{landing}/*", index, name="t2", checkpoint=str(tmp_path / "ckpt2"))
    q.awaitTermination(300)
    assert spark.read.parquet(f"{index}/docs").count() == 500
    terms = spark.read.parquet(f"{index}/terms")
    worded = docs.filter((F.col("doc_id") < 500) & F.col("text").rlike(r"\w"))
    assert terms.select("doc_id").distinct().count() == worded.count()
    assert terms.count() == terms.dropDuplicates(["doc_id", "term"]).count()


def test_two_refreshes_search_like_one_full_build(spark, tmp_path):
    from quarrylens.operators import retrieval

    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang", "source")
    landing, index = str(tmp_path / "landing"), str(tmp_path / "index")
    for part, rows in (("b1", docs.where("doc_id < 90")), ("b2", docs.where("doc_id >= 70"))):
        rows.coalesce(1).write.parquet(f"{landing}/{part}")
        ir.start_refresh(spark, f"{landing}/*", index, checkpoint=str(tmp_path / "ckpt")).awaitTermination(300)
    asked = table(spark, SF_SMALL, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = [sorted(map(tuple, retrieval.lexical_search(i, asked, k=5).collect()))
            for i in (ir.refreshed_index(spark, index), retrieval.lexical_index(docs))]
    assert hits[0] == hits[1] and hits[0]


def test_compaction_and_deltas_equal_one_full_build(spark, tmp_path):
    from quarrylens.operators import retrieval

    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang", "source")
    landing, index, ckpt = str(tmp_path / "landing"), str(tmp_path / "index"), str(tmp_path / "ckpt")
    asked = table(spark, SF_SMALL, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))

    def land(name, rows, checkpoint=ckpt):
        rows.coalesce(1).write.parquet(f"{landing}/{name}")
        ir.start_refresh(spark, f"{landing}/*", index, checkpoint=checkpoint).awaitTermination(300)

    def answers(built):
        return sorted(map(tuple, retrieval.lexical_search(built, asked, k=5).collect()))

    land("b1", docs.where("doc_id < 60"))
    land("b2", docs.where("doc_id >= 50 AND doc_id < 120"))
    # a batch that wrote its postings and was never committed counts nowhere
    spark.createDataFrame([(1, "orphan", 3, 77)], "doc_id long, term string, tf long, indexed_batch int").write.mode("append") \
        .partitionBy("indexed_batch").parquet(f"{index}/terms")
    spark.createDataFrame([("orphan", 1)], "term string, df long").write.parquet(f"{index}/dfs/indexed_batch=77")
    before = answers(ir.refreshed_index(spark, index))
    folder = ir.compact(spark, index)
    assert answers(ir.refreshed_index(spark, index)) == before == answers(retrieval.lexical_index(docs.where("doc_id < 120"), persist=False))
    (tmp_path / "index" / "compacted" / "upto=99-halfway").mkdir()  # an attempt that was lost
    # later batches are numbered beyond the compaction, also under a new checkpoint, whose ids start again at 0
    land("b3", docs.where("doc_id >= 110"), str(tmp_path / "ckpt2"))
    built = ir.refreshed_index(spark, index)
    assert answers(built) == answers(retrieval.lexical_index(docs, persist=False))
    assert built.idf.where("term = 'orphan'").count() == 0
    read = built.idf.inputFiles()
    assert read and not any("/terms/" in f for f in read)  # idf reads no postings
    assert folder.startswith(index) and spark.read.parquet(f"{folder}/dfs").count() > 0
