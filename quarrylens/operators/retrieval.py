"""Narrative retrieval.

Two exact engines and one approximate one:

* ``lexical_topk`` - TF-IDF cosine over a term join, all in the JVM. Documents
  are tokenised by Spark (``regexp_extract_all``) where their text was dealt to
  by id, so that term frequencies need no shuffle of postings. A search keeps
  the postings of its queries' terms, deals them out by document and scores
  them there: no (query, document) pair is shuffled but each task's best k.
* ``vector_topk`` - exact cosine top-k over dense vectors without a cross
  join: vectors are hashed into blocks, queries are replicated once per
  block, and ``cogroup(...).applyInPandas`` scores one block against its
  queries with a NumPy matrix product, emitting only the block's top-k per
  query. A final ``row_number() <= k`` merges the per-block candidates.
* ``vector_topk_lsh`` - MLlib random-projection LSH (approximate), reported
  with its recall against the exact answer; ``operators.ann`` holds the
  inverted file.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.spec import METADATA_COLUMNS

TOKEN_PATTERN = r"\w+"


def tokens(c) -> Column:
    """R1 tokeniser: lower-cased ``\\w+`` runs (ASCII word characters)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), 0)


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) - one partial/final aggregate."""
    return (df.select(id_col, F.explode(tokens(text_col)).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


@dataclass
class LexicalIndex:
    """R1 + S9: the lexical "vector table".

    ``postings`` = (doc_id, term, w) with w = tf * idf; ``norms`` = (doc_id,
    dnorm), the L2 norm of each document's weights; ``idf`` = (term, idf).
    All three are persisted (or written with ``write_index``) so every
    search reads the tokenised corpus once instead of re-tokenising it per
    branch of the plan. Norms are kept apart from the postings: a search
    joins them to the postings of its terms only.
    """

    postings: DataFrame
    idf: DataFrame
    doc_id: str
    norms: DataFrame | None = None

    def unpersist(self) -> None:
        for df in (self.postings, self.idf, self.norms):
            if df is not None:
                df.unpersist()


#: Documents that one task tokenises or scores, about.
TASK_DOCS = 2048
#: Terms up to which they are broadcast: those of all queries together, counted per
#: query, or those of an index, with their idf.
BROADCAST_TERMS = 500_000


def lexical_index(corpus: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  persist: bool = True) -> LexicalIndex:
    """Tokenise once: tf per (doc, term), idf = ln(N / df), doc norms.

    A term found in every document has idf 0 and adds nothing to any dot
    product or norm, so its postings are dropped (exact); these are also the
    hottest join keys. Texts are dealt out by id first: they are shorter than
    their postings, which then stay where they are counted.
    """
    parts = max(1, -(-corpus.count() // TASK_DOCS))
    corpus = corpus.filter(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull())
    dealt = corpus.select(doc_id, doc_text).repartition(parts, doc_id)
    return weighted_index(term_frequencies(dealt, doc_id, doc_text), corpus.select(doc_id), doc_id, persist)


def weighted_index(dtf: DataFrame, docs: DataFrame, doc_id: str = "doc_id", persist: bool = True,
                   dfreq: DataFrame | None = None) -> LexicalIndex:
    """The index of term frequencies (doc_id, term, tf) over ``docs``; idf and
    norms follow from all of it. ``dfreq`` (term, df) spares the count of the
    postings where document frequencies are already known."""
    if persist:
        dtf = dtf.persist(StorageLevel.MEMORY_AND_DISK)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    if dfreq is None:
        dfreq = dtf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # n_docs is a single aggregated row: broadcasting it is bounded.
    idf = (dfreq.join(F.broadcast(n_docs), how="inner", on=F.lit(True))
           .select("term", F.log(F.col("n_docs") / F.col("df")).alias("idf")))
    if persist:
        idf = idf.persist(StorageLevel.MEMORY_AND_DISK)
    # The planner guesses the term frequencies from the size of the documents' files and the
    # idf as a product of two tables: left to it, all term frequencies go through the driver.
    few = persist and idf.count() <= BROADCAST_TERMS
    useful = idf.filter(F.col("idf") > 0)
    postings = (dtf.join(F.broadcast(useful) if few else useful.hint("merge"), "term")
                .select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("w")))
    if persist:
        postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
    norms = (postings.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dnorm"))
             .filter(F.col("dnorm") > 0))
    if persist:
        norms = norms.persist(StorageLevel.MEMORY_AND_DISK)
    return LexicalIndex(postings, idf, doc_id, norms)


def lexical_search(index: LexicalIndex, queries: DataFrame, k: int = 5, q_id: str = "qid",
                   q_text: str = "query", n_blocks: int | None = None, seed_blocks: int = 4) -> DataFrame:
    """R4 (lexical): (q_id, rank, doc_id, score) by TF-IDF cosine, exact.

    Postings of the queries' terms are dealt out by document to ``n_blocks``
    tasks (about ``TASK_DOCS`` documents each) and meet the queries there.
    Every document is scored in full, so nothing is seeded: ``seed_blocks``
    is accepted for the callers of the bounded search and changes nothing.
    """
    doc_id = index.doc_id
    if n_blocks is None:
        n_blocks = max(1, -(-index.norms.count() // TASK_DOCS))
    qtf = term_frequencies(queries, q_id, q_text)
    # measured, as the planner's guess of a joined table is far too large
    held = F.broadcast if qtf.count() <= BROADCAST_TERMS else (lambda df: df)
    qw = (held(qtf).join(index.idf, "term")
          .select(q_id, "term", (F.col("tf") * F.col("idf")).alias("qw"))
          .filter(F.col("qw") > 0))
    qnorm = qw.groupBy(q_id).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    qx = qw.join(qnorm, q_id).select(q_id, "term", (F.col("qw") / F.col("qnorm")).alias("qx"))
    asked = index.postings.join(held(qtf.select("term").distinct()), "term", "left_semi").repartition(n_blocks, doc_id)
    impacts = asked.join(index.norms, doc_id).select(doc_id, "term", (F.col("w") / F.col("dnorm")).alias("x"))
    scored = impacts.join(held(qx), "term").groupBy(q_id, doc_id).agg(F.sum(F.col("qx") * F.col("x")).alias("score"))
    return top_k(scored, q_id, doc_id, k)


def lexical_topk(corpus: DataFrame, queries: DataFrame, k: int = 5,
                 doc_id: str = "doc_id", doc_text: str = "text",
                 q_id: str = "qid", q_text: str = "query") -> DataFrame:
    """R1 + R4: index the corpus and search it (see ``lexical_index``).

    idf = ln(N / df); weights tf * idf; score = dot / (|q| |d|), rounded to
    6 places; ties broken by round(score, 9) then doc id.
    """
    return lexical_search(lexical_index(corpus, doc_id, doc_text), queries, k, q_id, q_text)


def write_index(index: LexicalIndex, path: str) -> None:
    """Store a whole index as Parquet. Where one is stored already this
    raises: idf and norms hold for all documents together, so a second
    batch is no append (``streaming.index_refresh`` stores batches)."""
    for name in ("postings", "norms", "idf"):
        getattr(index, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_index(spark, path: str, doc_id: str = "doc_id") -> LexicalIndex:
    """Scan a stored index."""
    parts = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "idf", "norms")]
    return LexicalIndex(parts[0], parts[1], doc_id, parts[2])


def top_k(scored: DataFrame, q_id: str, item_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(q_id).orderBy(F.desc(F.round("score", 9)), F.asc(item_id))
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(q_id, "rank", item_id, F.round("score", 6).alias("score")))


def _block_topk_fn(k: int, q_id: str, item_id: str, q_vec: str, vec: str):
    def fn(vdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        if vdf.empty or qdf.empty:
            return pd.DataFrame({q_id: pd.Series([], dtype="int64"),
                                 item_id: pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        V = np.vstack(vdf[vec].to_numpy()).astype(np.float64)
        Q = np.vstack(qdf[q_vec].to_numpy()).astype(np.float64)
        vn = np.linalg.norm(V, axis=1)
        qn = np.linalg.norm(Q, axis=1)
        ids = vdf[item_id].to_numpy()
        out_q, out_i, out_s = [], [], []
        kk = min(k, len(ids))
        qids = qdf[q_id].to_numpy()
        for start in range(0, len(Q), 256):  # bound the score matrix per step
            S = (Q[start:start + 256] @ V.T) / np.outer(qn[start:start + 256], vn)
            R = np.round(S, 9)
            # k-th best rounded score per row (vectorised); every score at or
            # above it - ties included - is a candidate, so the top-k by
            # (round(score, 9) desc, id asc) is exact.
            kth = -np.partition(-R, kk - 1, axis=1)[:, kk - 1]
            for r in range(S.shape[0]):
                cand = np.nonzero(R[r] >= kth[r])[0]
                order = cand[np.lexsort((ids[cand], -R[r, cand]))][:kk]
                out_q.extend([qids[start + r]] * kk)
                out_i.extend(ids[order].tolist())
                out_s.extend(S[r, order].tolist())
        return pd.DataFrame({q_id: np.asarray(out_q, dtype="int64"),
                             item_id: np.asarray(out_i, dtype="int64"),
                             "score": np.asarray(out_s, dtype="float64")})
    return fn


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5,
                item_id: str = "vec_id", vec: str = "embedding",
                q_id: str = "qid", q_vec: str = "qvec", n_blocks: int | None = None,
                q_blocks: int | None = None, block_rows: int = 50_000,
                q_block_rows: int = 10_000) -> DataFrame:
    """J10 + R4: exact cosine top-k of every query over every vector.

    Work is |Q| x |V| dot products (inherent to exact search) but only
    |Q| x k x n_blocks rows are ever materialised; no cross join. A group
    holds 1/n_blocks of the vectors and 1/q_blocks of the queries, so both
    should grow with their tables to keep one group within executor memory
    (vectors are copied q_blocks times, queries n_blocks times).
    Ids must be integral. Without explicit block counts they are sized
    from the table counts (two count jobs, nothing collected) so a group
    holds at most ``block_rows`` vectors and ``q_block_rows`` queries.
    """
    if n_blocks is None:
        n = vectors.count()
        slots = vectors.sparkSession.sparkContext.defaultParallelism
        n_blocks = max(1, -(-n // block_rows), min(slots, n // 256))  # work for every slot, where there is enough
    if q_blocks is None:
        q_blocks = max(1, -(-queries.count() // q_block_rows))

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    v = (vectors.select(F.col(item_id).cast("bigint").alias(item_id), vec)
         .withColumn("_blk", F.pmod(F.xxhash64(item_id), F.lit(n_blocks)))
         .withColumn("_qblk", spread(q_blocks)))
    q = (queries.select(F.col(q_id).cast("bigint").alias(q_id), q_vec)
         .withColumn("_qblk", F.pmod(F.xxhash64(q_id), F.lit(q_blocks)))
         .withColumn("_blk", spread(n_blocks)))
    schema = T.StructType([T.StructField(q_id, T.LongType()), T.StructField(item_id, T.LongType()),
                           T.StructField("score", T.DoubleType())])
    cand = (v.groupBy("_blk", "_qblk").cogroup(q.groupBy("_blk", "_qblk"))
            .applyInPandas(_block_topk_fn(k, q_id, item_id, q_vec, vec), schema))
    return top_k(cand, q_id, item_id, k)


def vector_topk_lsh(vectors: DataFrame, queries: DataFrame, k: int = 5,
                    item_id: str = "vec_id", vec: str = "embedding", q_id: str = "qid",
                    q_vec: str = "qvec", bucket_length: float = 0.5, num_tables: int = 4,
                    max_distance: float = 1.2, seed: int = 42) -> DataFrame:
    """Approximate top-k with BucketedRandomProjectionLSH on unit vectors
    (cosine = 1 - d^2 / 2). Candidates are the pairs sharing a hash bucket
    within ``max_distance``; the result is approximate by design."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    vv = Normalizer(inputCol="_v", outputCol="features", p=2.0).transform(
        vectors.select(item_id, array_to_vector(F.col(vec).cast("array<double>")).alias("_v")))
    qq = Normalizer(inputCol="_v", outputCol="features", p=2.0).transform(
        queries.select(q_id, array_to_vector(F.col(q_vec).cast("array<double>")).alias("_v")))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                      bucketLength=bucket_length, numHashTables=num_tables,
                                      seed=seed).fit(vv)
    pairs = lsh.approxSimilarityJoin(qq, vv, max_distance, distCol="dist")
    scored = pairs.select(F.col(f"datasetA.{q_id}").alias(q_id),
                          F.col(f"datasetB.{item_id}").alias(item_id),
                          (1 - F.col("dist") * F.col("dist") / 2).alias("score"))
    return top_k(scored, q_id, item_id, k)


def recall_at_k(approx: DataFrame, exact: DataFrame, q_id: str, item_id: str) -> DataFrame:
    """Share of exact hits the approximate answer found, per query."""
    hit = exact.join(approx.select(q_id, item_id).withColumn("_f", F.lit(1)), [q_id, item_id], "left")
    return hit.groupBy(q_id).agg(F.round(F.avg(F.coalesce("_f", F.lit(0))), 6).alias("recall"))


def metadata_struct(df: DataFrame, columns=METADATA_COLUMNS) -> Column:
    """Metadata as a struct; missing or null -> ''."""
    return F.struct(*[
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(""))
        .alias(c) for c in columns])


def hits_as_structs(hits: DataFrame, docs: DataFrame, q_id: str, doc_id: str,
                    text_col: str, metadata=()) -> DataFrame:
    """One row per query with ``hits`` = array of (rank, doc, score, text
    [, metadata struct (C19)]) sorted by rank (k elements per query, bounded)."""
    held = docs.select(doc_id, text_col, *([metadata_struct(docs, metadata).alias("metadata")] if metadata else []))
    j = hits.join(held, doc_id)
    packed = F.struct(F.col("rank"), F.col(doc_id).cast("string").alias("document_no"),
                      F.col("score"), F.col(text_col).alias("narrative"), *(["metadata"] if metadata else []))
    return j.groupBy(q_id).agg(F.array_sort(F.collect_list(packed)).alias("hits"))


def context_text(hits_col: str = "hits") -> Column:
    """R7: 'Document X (score=s): text' blocks joined by blank lines."""
    return F.array_join(F.transform(F.col(hits_col), lambda h: F.format_string(
        "Document %s (score=%s): %s", h["document_no"], h["score"].cast("string"),
        h["narrative"])), "\n\n")


def keyword_hit(top_text: Column, keywords: Column) -> Column:
    """The top hit contains any keyword (case-insensitive)."""
    return F.exists(keywords, lambda kw: F.lower(top_text).contains(F.lower(kw)))


def new_for_index(candidates: DataFrame, index: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """R2 + C16 + J3: rows with text and id whose id is not indexed yet,
    one row per id."""
    fresh = candidates.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    fresh = fresh.dropDuplicates([id_col])
    return fresh.join(index.select(id_col), id_col, "left_anti")


def index_meta(index_before: DataFrame, added: DataFrame) -> DataFrame:
    """Totals before/after one incremental build."""
    a = index_before.agg(F.count(F.lit(1)).alias("previously_indexed"))
    b = added.agg(F.count(F.lit(1)).alias("newly_added"))
    return a.join(F.broadcast(b), how="inner", on=F.lit(True)).select(
        "previously_indexed", "newly_added",
        (F.col("previously_indexed") + F.col("newly_added")).alias("total_indexed"))
