"""Registered classifier and retrieval queries (M*, R*, J10)."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import ann, retrieval, severity, split, tools
from quarrylens.plans.bindings import DRIVER_SPEC, INCIDENTS_SQL, incident_table, table


def _pairs(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("quality").cast("string").alias("truth"),
                      F.col("toxic").cast("string").alias("pred"))


def confusion_matrix(spark: SparkSession, sf_dir: str):
    return severity.confusion_long(_pairs(spark, sf_dir))


def class_metrics(spark: SparkSession, sf_dir: str):
    return severity.class_metrics(_pairs(spark, sf_dir))


def balanced_weights(spark: SparkSession, sf_dir: str):
    target = severity.select_target(incident_table(spark, sf_dir), DRIVER_SPEC)
    w = severity.class_weights(target, DRIVER_SPEC.target)
    return w.select(DRIVER_SPEC.target, "n_c", F.round("weight", 9).alias("weight"))


HOLDOUT_TREES = 100
MODEL_TABLES = ["orders", "customer", "nation", "region"]


def holdout_split(spark, sf_dir):
    """P4 + S3: the stratified train/test split of the incident table,
    written once per input version and read by every query that trains,
    scores or profiles it (the original wrote its train and test tables)."""
    from quarrylens.plans.artifacts import data_version, table_or_build

    return table_or_build(spark, "holdout_split",
                          lambda: split.stratified_split(incident_table(spark, sf_dir), DRIVER_SPEC),
                          sf_dir=sf_dir, data=data_version(spark, sf_dir, MODEL_TABLES))


def _model_key(spark, sf_dir, num_trees):
    from quarrylens.plans.artifacts import data_version

    return {"sf_dir": sf_dir, "trees": num_trees, "features": DRIVER_SPEC.features, "data": data_version(spark, sf_dir, MODEL_TABLES)}


def holdout_model(spark, sf_dir, num_trees: int = HOLDOUT_TREES):
    """The one holdout model (100 trees, as in the original), trained on
    the stratified train split once and loaded by every query that serves
    it (predictions, request scoring, the classifier system of the runs)."""
    def train():
        s = holdout_split(spark, sf_dir)
        return severity.fit(s.filter(F.col("split") == "train"), DRIVER_SPEC, num_trees=num_trees)

    return severity.fit_or_load(spark, "severity_holdout", train, spec=DRIVER_SPEC, **_model_key(spark, sf_dir, num_trees))


def model_info(spark: SparkSession, sf_dir: str):
    """What the stored model was trained to do, without loading it."""
    holdout_model(spark, sf_dir)
    info = severity.stored_info(spark, "severity_holdout", **_model_key(spark, sf_dir, HOLDOUT_TREES))
    return info.select(F.concat_ws(",", "features").alias("features"), F.concat_ws(",", "labels").alias("labels"), "n_trees", "max_depth",
                       "include_context", "target")


def _fit_holdout(spark, sf_dir, num_trees=HOLDOUT_TREES):
    model = holdout_model(spark, sf_dir, num_trees)
    test = holdout_split(spark, sf_dir).filter(F.col("split") == "test")
    return model, test


def forest_predict(spark: SparkSession, sf_dir: str):
    model, test = _fit_holdout(spark, sf_dir)
    pred = severity.predict_rows(model, test, keep=["DOCUMENT_NO", "DEGREE_INJURY_CD"])
    return pred.select("DOCUMENT_NO", F.lpad("DEGREE_INJURY_CD", 2, "0").alias("truth"),
                       F.col("predicted_code").alias("pred"))


def forest_report(spark: SparkSession, sf_dir: str):
    """M9 + M10: holdout and out-of-time metrics, context ablation off/on.

    All cells use as many trees as the stored holdout model, which is the
    holdout cell without context; the other three are fitted here. Rows:
    overall metrics (label ``*``: the four of M7/M8, n_train, n_test) and
    support, recall, precision and f1 per class.
    """
    inc = incident_table(spark, sf_dir)
    cols = ["DOCUMENT_NO", "DEGREE_INJURY_CD", "split", *DRIVER_SPEC.features,
            *DRIVER_SPEC.mine_context]
    s = holdout_split(spark, sf_dir).select(*cols)
    oot = split.out_of_time(inc, DRIVER_SPEC).select(*cols)
    cells = [(name, frame, ctx) for name, frame in (("holdout", s), ("out_of_time", oot))
             for ctx in (False, True)]

    def model_of(name, frame, ctx):
        if name == "holdout" and not ctx:
            return holdout_model(spark, sf_dir)
        train = frame.filter(F.col("split") == "train")
        return severity.fit(train, DRIVER_SPEC, include_context=ctx, num_trees=HOLDOUT_TREES)

    def confusion(cell):
        """The cell's (truth, pred, n), a row per pair of labels: scored here
        once, whatever reads it."""
        name, frame, ctx = cell
        model, test = model_of(name, frame, ctx), frame.filter(F.col("split") == "test")
        pairs = severity.predicted_pairs(model, test, severity.feature_columns(test, DRIVER_SPEC, ctx), "DEGREE_INJURY_CD")
        counts = pairs.groupBy("truth", "pred").agg(F.sum("n").alias("n"))
        return spark.createDataFrame(counts.collect(), counts.schema)

    # One cell after the other: each fit has tasks for the whole cluster, and
    # the driver holds and sends one model at a time.
    confusions = [confusion(cell) for cell in cells]
    parts = []
    for (name, frame, ctx), pairs in zip(cells, confusions):
        sizes = frame.groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.concat(F.lit("n_"), "split").alias("metric"), F.lit("*").alias("label"), "value")
        parts.append(severity.class_metrics(pairs, weight="n").unionByName(sizes).select(
            F.lit(name).alias("split_name"), F.lit(ctx).alias("context"), "metric", "label", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def serve_rows(spark: SparkSession, sf_dir: str):
    """M11 + M5: score raw request rows (partial codes) with the fitted model."""
    model, test = _fit_holdout(spark, sf_dir)
    req = test.select("DOCUMENT_NO", *DRIVER_SPEC.features)
    # Requests arrive with lower-case codes and gaps; complete them first.
    req = req.withColumn("COAL_METAL_IND", F.lower("COAL_METAL_IND"))
    done = severity.complete_requests(req, DRIVER_SPEC, keep=["DOCUMENT_NO"])
    return severity.predict_rows(model, done, keep=["DOCUMENT_NO"])


# ---------------------------------------------------------------- retrieval
def _centroids(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    parts = (emb.select("label", F.posexplode("embedding").alias("pos", "x"))
             .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    return (parts.groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ps"))
            .select(F.col("label").alias("qid"), F.transform("ps", lambda p: p["m"]).alias("qvec")))


def vector_topk(spark: SparkSession, sf_dir: str):
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), k=5)


def vector_topk_lsh(spark: SparkSession, sf_dir: str):
    emb = table(spark, sf_dir, "embeddings")
    q = _centroids(spark, sf_dir)
    approx = retrieval.vector_topk_lsh(emb, q, k=5)
    exact = retrieval.vector_topk(emb, q, k=5)
    rec = retrieval.recall_at_k(approx, exact, "qid", "vec_id")
    return approx.join(rec, "qid", "left")


#: Share of the cells whose codes a query reads, and of all vectors that it compares exactly.
PROBE_SHARE, KEEP = 0.8, 0.15
#: Queries of the recall measurement: vectors whose id this divides, against all.
RECALL_EVERY = 50


def embeddings_index(spark: SparkSession, sf_dir: str):
    """R5 + S9: the inverted file of ``embeddings``, stored once per input
    version, partitioned by cell."""
    from quarrylens.plans.artifacts import artifact_path, committed, data_version, new_version, publish

    path = artifact_path(spark, "indexes", "embeddings_cells", sf_dir=sf_dir, data=data_version(spark, sf_dir, ["embeddings"]))
    found = committed(spark, path)
    if found is None:
        version = new_version(path)
        ann.write(ann.build(table(spark, sf_dir, "embeddings")), version)
        publish(spark, version)
        found = committed(spark, path)
    return ann.read(spark, found)


def _own_queries(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % RECALL_EVERY == 0)
    return emb.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def vector_topk_cells(spark: SparkSession, sf_dir: str):
    """The five nearest vectors of each query, by its nearest cells' codes."""
    index = embeddings_index(spark, sf_dir)
    return ann.search(index, _own_queries(spark, sf_dir), 5, math.ceil(PROBE_SHARE * len(index.centres)), KEEP)


def vector_cells_recall(spark: SparkSession, sf_dir: str):
    """Recall of the inverted file and the share of pairs it compares."""
    index, q = embeddings_index(spark, sf_dir), _own_queries(spark, sf_dir)
    exact = retrieval.vector_topk(table(spark, sf_dir, "embeddings"), q, k=5)
    return ann.search_quality(index, q, exact, 5, math.ceil(PROBE_SHARE * len(index.centres)), KEEP)


def _lexical(spark, sf_dir, k=5):
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                     F.col("text").alias("query"))
    return retrieval.lexical_search(documents_index(spark, sf_dir), bench, k=k)


def documents_index(spark: SparkSession, sf_dir: str):
    """R1 + S9: the lexical index of ``documents``, built once per input
    version and stored under the shared checkpoint folder (the original
    persisted its vector store and searched it from every tool)."""
    from quarrylens.plans.artifacts import artifact_path, data_version

    path = artifact_path(spark, "indexes", "documents_lexical", sf_dir=sf_dir,
                         data=data_version(spark, sf_dir, ["documents"]))
    from quarrylens.plans.artifacts import committed, new_version, publish

    found = committed(spark, path)
    if found is None:
        idx, version = retrieval.lexical_index(table(spark, sf_dir, "documents")), new_version(path)
        try:
            retrieval.write_index(idx, version)
        finally:
            idx.unpersist()
        publish(spark, version)
        found = committed(spark, path)
    return retrieval.read_index(spark, found)


def lexical_topk(spark: SparkSession, sf_dir: str):
    return _lexical(spark, sf_dir)


def context_assembly(spark: SparkSession, sf_dir: str):
    hits = retrieval.hits_as_structs(_lexical(spark, sf_dir), table(spark, sf_dir, "documents"),
                                     "qid", "doc_id", "text")
    # R7 assembles whole narratives (no truncation) for every query.
    ctx = hits.select("qid", retrieval.context_text("hits").alias("context"))
    return ctx.select("qid", F.length("context").alias("context_len"),
                      F.md5("context").alias("context_md5"))


HIT_METADATA = ("lang", "source", "n_chars")


def hits_metadata(spark: SparkSession, sf_dir: str):
    """R6 + C19: each query's hits with the metadata of their documents."""
    hits = retrieval.hits_as_structs(_lexical(spark, sf_dir), table(spark, sf_dir, "documents"), "qid", "doc_id", "text", HIT_METADATA)
    h = hits.select("qid", F.explode("hits").alias("h"))
    return h.select("qid", F.col("h.rank").alias("rank"), F.col("h.document_no").alias("document_no"), "h.metadata.*")


#: Words shorter than this are no keywords (articles, prepositions and the like).
MIN_KEYWORD_CHARS = 7


def keyword_relevance(spark: SparkSession, sf_dir: str):
    bench = table(spark, sf_dir, "benchmark")
    kws = bench.select(F.col("item_id").alias("qid"), F.array_distinct(F.filter(
        retrieval.tokens("text"), lambda t: F.length(t) >= MIN_KEYWORD_CHARS)).alias("keywords"))
    top = _lexical(spark, sf_dir, k=1).join(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    j = top.join(kws, "qid")
    out = j.select("qid", F.col("doc_id").alias("top_doc"),
                   retrieval.keyword_hit(F.col("text"), F.col("keywords")).alias("hit"))
    # R8 judgement: the share over all queries is one aggregated row
    # (a one-row broadcast), not a window that gathers every row in one task.
    share = out.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("share_hit"))
    return out.join(F.broadcast(share), how="inner", on=F.lit(True))


def search_request_table(spark: SparkSession, sf_dir: str):
    """Q13 input: one search request per benchmark passage, with and without a
    depth; of every ten one is cut JSON, one lacks its query, one asks for no
    count and one names no tool there is."""
    b = table(spark, sf_dir, "benchmark")
    kind = F.col("item_id") % 10
    good = F.to_json(F.struct(F.col("text").alias("query"), F.when(kind % 2 == 0, (kind + 1).cast("int")).alias("top_k")))
    args = (F.when(kind == 6, F.left(good, F.length(good) - 1)).when(kind == 7, F.lit('{"top_k": 2}'))
            .when(kind == 8, F.to_json(F.struct(F.col("text").alias("query"), F.lit("many").alias("top_k")))).otherwise(good))
    return b.select(F.col("item_id").alias("request_id"), F.when(kind == 9, F.lit("search_web")).otherwise(F.lit(tools.SEARCH)).alias("tool"),
                    args.alias("args"))


def tool_search_requests(spark: SparkSession, sf_dir: str):
    """Q13: search requests answered in bulk, with their error rows."""
    asked = tools.dispatch(search_request_table(spark, sf_dir))
    hits = tools.search_requests(asked["search"], documents_index(spark, sf_dir)).withColumn("error", F.lit(None).cast("string"))
    return hits.unionByName(asked["errors"].drop("tool"), allowMissingColumns=True)


def tool_classify_requests(spark: SparkSession, sf_dir: str):
    """Q13 + M11: classifier requests of the test records, named in lower case;
    of every seven one lacks its first code, one its last two."""
    model, test = _fit_holdout(spark, sf_dir)
    n = F.col("DOCUMENT_NO").cast("long") % 7
    features = list(DRIVER_SPEC.features)
    codes = F.struct(*[F.when(~((n == 0) & F.lit(i == 0)) & ~((n == 1) & F.lit(i >= len(features) - 2)), F.lower(F.col(c))).alias(c.lower())
                       for i, c in enumerate(features)])
    requests = test.select(F.col("DOCUMENT_NO").alias("request_id"), F.lit(tools.CLASSIFY).alias("tool"), F.to_json(codes).alias("args"))
    return tools.classify_requests(tools.dispatch(requests)["classify"], model, DRIVER_SPEC)


def anti_join_new(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    indexed = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    added = retrieval.new_for_index(docs, indexed, "doc_id", "text")
    return retrieval.index_meta(indexed, added)


QUERIES = {
    "confusion_matrix": confusion_matrix,
    "class_metrics": class_metrics,
    "balanced_weights": balanced_weights,
    "model_info": model_info,
    "forest_predict": forest_predict,
    "forest_report": forest_report,
    "serve_rows": serve_rows,
    "vector_topk": vector_topk,
    "vector_topk_lsh": vector_topk_lsh,
    "vector_topk_cells": vector_topk_cells,
    "vector_cells_recall": vector_cells_recall,
    "lexical_topk": lexical_topk,
    "context_assembly": context_assembly,
    "keyword_relevance": keyword_relevance,
    "hits_metadata": hits_metadata,
    "anti_join_new": anti_join_new,
    "tool_search_requests": tool_search_requests,
    "tool_classify_requests": tool_classify_requests,
}

_PAIRS = """WITH pairs AS (SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS pred
FROM labels),
labs AS (SELECT DISTINCT truth AS l FROM pairs UNION SELECT DISTINCT pred FROM pairs),
cm AS (SELECT a.l AS truth, b.l AS pred, CAST(count(p.truth) AS BIGINT) AS n
       FROM labs a, labs b LEFT JOIN pairs p ON p.truth = a.l AND p.pred = b.l
       GROUP BY a.l, b.l)"""

_CENTROIDS = """WITH e AS (SELECT label, unnest(embedding) AS x,
                  generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label AS qid, list(m ORDER BY pos) AS qvec
      FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY label, pos)
      GROUP BY label),
s AS (SELECT c.qid, v.vec_id,
        list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.qvec) AS score
      FROM c, embeddings v),
r AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid
        ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""

_LEX = r"""WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
dtf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
idf AS (SELECT term, ln((SELECT n FROM nd) / count(*)) AS idf FROM dtf GROUP BY term),
dw AS (SELECT doc_id, term, tf * idf AS w FROM dtf JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dnorm FROM dw GROUP BY doc_id),
qt AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM benchmark),
qtf AS (SELECT qid, term, count(*) AS tf FROM qt GROUP BY ALL),
qw AS (SELECT qid, term, tf * idf AS qw FROM qtf JOIN idf USING (term)),
qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY qid),
dots AS (SELECT qid, doc_id, sum(qw * w) AS dot FROM qw JOIN dw USING (term) GROUP BY ALL),
sc AS (SELECT qid, doc_id, dot / (qnorm * dnorm) AS score FROM dots JOIN qn USING (qid)
       JOIN dn USING (doc_id) WHERE qnorm > 0 AND dnorm > 0),
r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid
        ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""

ORACLE = {
    "confusion_matrix": _PAIRS + "\nSELECT truth, pred, n FROM cm",
    "class_metrics": _PAIRS + """,
per AS (SELECT truth AS label, sum(n) AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS tp
        FROM cm GROUP BY truth),
prd AS (SELECT pred AS label, sum(n) AS pred_n FROM cm GROUP BY pred),
p AS (SELECT label, support, tp,
        CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
        CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0 END AS precision
      FROM per JOIN prd USING (label)),
f AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision)
        ELSE 0 END AS f1 FROM p)
SELECT 'support' AS metric, label, round(CAST(support AS DOUBLE), 6) AS value FROM f
UNION ALL SELECT 'recall', label, round(recall, 6) FROM f
UNION ALL SELECT 'precision', label, round(precision, 6) FROM f
UNION ALL SELECT 'f1', label, round(f1, 6) FROM f
UNION ALL SELECT 'accuracy', '*', round(sum(tp) / sum(support), 6) FROM f
UNION ALL SELECT 'macro_f1', '*', round(avg(f1), 6) FROM f
UNION ALL SELECT 'weighted_f1', '*', round(sum(f1 * support) / sum(support), 6) FROM f
UNION ALL SELECT 'majority_accuracy', '*', round(max(support) / sum(support), 6) FROM f""",
    "model_info": "WITH " + INCIDENTS_SQL + f"""
SELECT '{",".join(DRIVER_SPEC.features)}' AS features,
       (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT DISTINCT lpad(DEGREE_INJURY_CD, 2, '0') AS code FROM incidents)) AS labels,
       {HOLDOUT_TREES} AS n_trees, 10 AS max_depth, false AS include_context, '{DRIVER_SPEC.target}' AS target""",
    "balanced_weights": """WITH c AS (SELECT CASE WHEN length(substring(o_orderpriority, 1, 1)) < 2
  THEN lpad(substring(o_orderpriority, 1, 1), 2, '0') ELSE substring(o_orderpriority, 1, 1) END AS code
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT code AS DEGREE_INJURY_CD, count(*) AS n_c FROM c GROUP BY code)
SELECT DEGREE_INJURY_CD, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 9) AS weight FROM n""",
    "vector_topk": _CENTROIDS + "\nSELECT qid, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "lexical_topk": _LEX + "\nSELECT qid, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "context_assembly": _LEX + """,
ctx AS (SELECT r.qid, string_agg('Document ' || CAST(r.doc_id AS VARCHAR) || ' (score=' ||
          CAST(round(r.score, 6) AS VARCHAR) || '): ' || d.text, chr(10) || chr(10) ORDER BY r.rank) AS context
        FROM r JOIN documents d USING (doc_id) WHERE r.rank <= 5 GROUP BY r.qid)
SELECT qid, length(context) AS context_len, md5(context) AS context_md5 FROM ctx""",
    "hits_metadata": _LEX + """
SELECT r.qid, r.rank, CAST(r.doc_id AS VARCHAR) AS document_no, coalesce(d.lang, '') AS lang, coalesce(d.source, '') AS source,
       coalesce(CAST(d.n_chars AS VARCHAR), '') AS n_chars FROM r JOIN documents d USING (doc_id) WHERE r.rank <= 5""",
    "tool_search_requests": _LEX + """
SELECT qid AS request_id, rank, CAST(doc_id AS VARCHAR) AS document_no, round(score, 6) AS score, NULL::VARCHAR AS error FROM r
WHERE qid % 10 NOT IN (6, 7, 8, 9) AND rank <= CASE WHEN qid % 2 = 0 THEN qid % 10 + 1 ELSE 5 END
UNION ALL SELECT item_id, NULL, NULL, NULL, CASE item_id % 10 WHEN 6 THEN 'Arguments are not a JSON object' WHEN 7 THEN 'Missing argument: query'
  WHEN 8 THEN 'Not a count: top_k=many' ELSE 'Unknown tool: search_web' END FROM benchmark WHERE item_id % 10 IN (6, 7, 8, 9)""",
    "keyword_relevance": _LEX + r""",
kw AS (SELECT item_id AS qid, list_distinct(list_filter(regexp_extract_all(lower(text), '\w+'),
         lambda t: length(t) >= 7)) AS keywords FROM benchmark),
top AS (SELECT r.qid, r.doc_id, d.text FROM r JOIN documents d USING (doc_id) WHERE r.rank = 1),
h AS (SELECT top.qid, top.doc_id AS top_doc,
        len(list_filter(kw.keywords, lambda k: contains(lower(top.text), lower(k)))) > 0 AS hit
      FROM top JOIN kw USING (qid))
SELECT qid, top_doc, hit, round(avg(CAST(hit AS DOUBLE)) OVER (), 6) AS share_hit FROM h""",
    "anti_join_new": """WITH idx AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
          AND doc_id NOT IN (SELECT doc_id FROM idx))
SELECT (SELECT count(*) FROM idx) AS previously_indexed, (SELECT count(*) FROM fresh) AS newly_added,
       (SELECT count(*) FROM idx) + (SELECT count(*) FROM fresh) AS total_indexed""",
}
