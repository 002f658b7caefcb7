"""Retrieval: tiny corpus golden hit, exact vector top-k vs brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens_testdata import SF_SMALL
from quarrylens.operators import retrieval
from quarrylens.plans.bindings import table

CORPUS = [
    ("doc1", "Miner struck by falling rock in underground coal mine roof fall."),
    ("doc2", "Electrician received electrical shock from damaged cable on continuous miner."),
    ("doc3", "Haul truck operator caught between equipment and rib while backing up."),
]


def test_lexical_top_hit(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id string, text string")
    q = spark.createDataFrame([("q1", "falling rock roof underground"),
                               ("q2", "electrical shock cable")], "qid string, query string")
    hits = retrieval.lexical_topk(corpus, q, k=2).collect()
    top = {r["qid"]: r["doc_id"] for r in hits if r["rank"] == 1}
    assert top == {"q1": "doc1", "q2": "doc2"}
    assert all(0 < r["score"] <= 1 for r in hits)


def test_hits_context_and_keywords(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id string, text string")
    q = spark.createDataFrame([("q1", "falling rock roof")], "qid string, query string")
    hits = retrieval.lexical_topk(corpus, q, k=2)
    s = retrieval.hits_as_structs(hits, corpus, "qid", "doc_id", "text")
    row = s.select(retrieval.context_text("hits").alias("ctx"),
                   retrieval.keyword_hit(F.col("hits")[0]["narrative"],
                                         F.array(F.lit("ROCK"), F.lit("zzz"))).alias("kw")).collect()[0]
    assert row["ctx"].startswith("Document doc1 (score=")
    assert row["kw"] is True


def test_vector_topk_matches_brute_force(spark):
    vecs = table(spark, SF_SMALL, "embeddings")
    q = vecs.filter(F.col("label") == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    got = retrieval.vector_topk(vecs, q, k=3, n_blocks=4).collect()
    pdf = vecs.toPandas()
    m = np.vstack(pdf.embedding.map(lambda a: np.asarray(a, dtype="float64")))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = pdf.vec_id.to_numpy()
    qpdf = pdf[pdf.label == 0]
    expect = {}
    for qid, qv in zip(qpdf.vec_id, qpdf.embedding):
        qv = np.asarray(qv, dtype="float64")
        s = m @ (qv / np.linalg.norm(qv))
        order = sorted(range(len(ids)), key=lambda i: (-round(s[i], 9), ids[i]))[:3]
        expect[qid] = [int(ids[i]) for i in order]
    have = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        have.setdefault(r["qid"], []).append(r["vec_id"])
    assert have == expect


def test_lsh_recall_reported(spark):
    vecs = table(spark, SF_SMALL, "embeddings")
    q = vecs.limit(20).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = retrieval.vector_topk(vecs, q, k=5, n_blocks=2)
    approx = retrieval.vector_topk_lsh(vecs, q, k=5)
    rec = retrieval.recall_at_k(approx, exact, "qid", "vec_id").agg(F.avg("recall")).collect()[0][0]
    assert rec > 0.9


def test_incremental_index_adds_only_new(spark):
    idx = spark.createDataFrame([("doc1", "a")], "doc_id string, text string")
    cand = spark.createDataFrame([("doc1", "a"), ("doc2", "b"), ("doc2", "b"), ("doc3", None)],
                                 "doc_id string, text string")
    new = retrieval.new_for_index(cand, idx, "doc_id", "text")
    assert [r[0] for r in new.collect()] == ["doc2"]
    meta = retrieval.index_meta(idx, new).collect()[0]
    assert (meta["previously_indexed"], meta["newly_added"], meta["total_indexed"]) == (1, 1, 2)


def _brute_lexical(docs, queries, k):
    """TF-IDF cosine top-k in plain Python."""
    import math
    import re
    from collections import Counter

    tf = {i: Counter(re.findall(r"\w+", t.lower(), re.ASCII)) for i, t in docs}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log(len(tf) / n) for t, n in df.items()}
    weights = {i: {t: n * idf[t] for t, n in c.items()} for i, c in tf.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    out = {}
    for q, text in queries:
        w = {t: n * idf.get(t, 0) for t, n in Counter(re.findall(r"\w+", text.lower(), re.ASCII)).items()}
        scores = [(sum(x * d.get(t, 0) for t, x in w.items()) / (norm(w) * norm(d)), i) for i, d in weights.items() if norm(d) and norm(w)]
        out[q] = [i for s, i in sorted(((-round(s, 9), i) for s, i in scores if s > 0))[:k]]
    return out


@pytest.mark.parametrize("n_blocks,seeds", [(1, 1), (5, 2), (200, 1)])
def test_lexical_search_is_exact_for_any_blocks(spark, n_blocks, seeds):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text").where("text IS NOT NULL")
    q = table(spark, SF_SMALL, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    idx = retrieval.lexical_index(docs)
    hits = retrieval.lexical_search(idx, q, k=5, n_blocks=n_blocks, seed_blocks=seeds).collect()
    idx.unpersist()
    got = {}
    for r in sorted(hits, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["doc_id"])
    assert got == _brute_lexical([tuple(r) for r in docs.collect()], [tuple(r) for r in q.collect()], 5)


def test_lexical_search_stays_in_the_jvm(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    q = docs.limit(3).select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    plan = retrieval.lexical_search(retrieval.lexical_index(docs, persist=False), q)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


def test_a_stored_index_is_not_appended_to(spark, tmp_path):
    docs = spark.createDataFrame(CORPUS, "doc_id string, text string")
    idx = retrieval.lexical_index(docs, persist=False)
    retrieval.write_index(idx, str(tmp_path / "i"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        retrieval.write_index(idx, str(tmp_path / "i"))
    q = spark.createDataFrame([("q1", "falling rock")], "qid string, query string")
    assert retrieval.lexical_search(retrieval.read_index(spark, str(tmp_path / "i")), q, 1).collect()[0]["doc_id"] == "doc1"


def test_cells_find_nearly_all_neighbours(spark, tmp_path):
    from quarrylens.operators import ann

    vecs = table(spark, "/root/testdata/sf0.01", "embeddings")
    q = vecs.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    ann.write(ann.build(vecs), str(tmp_path / "cells"))
    index = ann.read(spark, str(tmp_path / "cells"))
    assert index.vectors.count() == vecs.count() == index.vectors.select("vec_id").distinct().count()
    pruned = index.vectors.where("cell IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in pruned and "cell#" in pruned.split("PartitionFilters: [")[1].split("]")[0]
    exact = retrieval.vector_topk(vecs, q, k=5)
    row = ann.search_quality(index, q, exact, 5, round(0.8 * len(index.centres)), 0.15).collect()[0]
    assert row["n_queries"] == q.count() and row["recall"] >= 0.9 and row["candidate_share"] < 0.2
    # all cells probed, a cell in several parts: the exact answer
    whole = ann.search(index, q, 5, len(index.centres), 1.0, part_rows=7)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in exact.collect())
    assert ann.search(index, q.limit(0), 5).count() == 0


def test_search_shuffles_no_pairs_of_query_and_document(spark, tmp_path):
    import os
    import re

    docs = spark.createDataFrame([(i, f"rock w{i % 7} w{i % 11} w{i}") for i in range(300)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i % 11}") for i in range(20)], "qid long, query string")
    retrieval.write_index(retrieval.lexical_index(docs, persist=False), str(tmp_path / "i"))
    # no table of a term's maxima per block, none of a second copy of the postings
    assert sorted(os.listdir(tmp_path / "i")) == ["idf", "norms", "postings"]
    hits = retrieval.lexical_search(retrieval.read_index(spark, str(tmp_path / "i")), q, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, doc_id#", plan) and not re.search(r"hashpartitioning\(doc_id#\d+L?, term#", plan)
    assert hits.where("rank = 1 AND qid = doc_id").count() == 20


@pytest.mark.parametrize("most", [500_000, 10])
def test_term_frequencies_are_never_broadcast(spark, monkeypatch, most):
    """Documents whose files are small, as the planner sees them, still have
    postings too many for the driver: the few idf rows are broadcast, or none."""
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", most)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("t"), F.col("id") % 7), F.concat(F.lit("w"), "id")).alias("text"))
    idx = retrieval.lexical_index(docs)
    plan = idx.postings._jdf.queryExecution().optimizedPlan().toString() + idx.postings.select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    assert ("BuildRight" in plan.split("idf")[0] or "SortMergeJoin" not in plan) if most > 10 else "SortMergeJoin" in plan
    assert idx.postings.count() == 200 * 2  # "common" weighs nothing
    idx.unpersist()
