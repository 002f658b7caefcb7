"""Question-bank building (B1-B4, C15, J11, A6) and offline runs.

The bank is built from the data the way the original built it: a seeded
sample of records becomes classification items, count specs evaluated in
one cube pass become trend items, and retrieval results for seed queries and
narrative snippets become case items. References are flattened into
nullable ``ref_*`` columns keyed by ``ref_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.text import canonical_code, md5_order
from quarrylens.operators import split
from quarrylens.spec import TOOL_CLASSIFY, TOOL_SEARCH, TOOL_TRENDS

BANK_COLUMNS = ["question_id", "category", "question", "expected_tools", "ref_type", "ref_value",
                "ref_document_no", "ref_year", "ref_period_a", "ref_period_b", "ref_counts",
                "ref_query", "ref_documents", "ref_must_include"]


def _empty_refs() -> dict:
    return {
        "ref_value": F.lit(None).cast("string"),
        "ref_document_no": F.lit(None).cast("string"),
        "ref_year": F.lit(None).cast("int"),
        "ref_period_a": F.lit(None).cast("string"),
        "ref_period_b": F.lit(None).cast("string"),
        "ref_counts": F.lit(None).cast("array<bigint>"),
        "ref_query": F.lit(None).cast("string"),
        "ref_documents": F.lit(None).cast("array<string>"),
        "ref_must_include": F.lit(None).cast("string"),
    }


def _finish(df: DataFrame, **cols) -> DataFrame:
    refs = _empty_refs()
    refs.update(cols)
    return df.select(*[refs[c].alias(c) if c in refs else F.col(c) for c in BANK_COLUMNS])


def classification_items(records: DataFrame, field_map: list[tuple[str, str]], key: str,
                         target: str, n: int = 20, seed: int = 42) -> DataFrame:
    """B1: n seeded records -> 'Predict injury degree for: k=v, ...' items.

    ``field_map`` lists (question key, record column) in question order.
    Ids follow the sample order (CLS-01, ...); the window is over n rows.
    """
    s = split.seeded_sample(records, key, n, seed).withColumn("_h", md5_order(key, F.lit(str(seed))))
    s = s.withColumn("_i", F.row_number().over(Window.orderBy("_h", key)))
    body = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in field_map])
    s = s.select(F.format_string("CLS-%02d", F.col("_i")).alias("question_id"),
                 F.lit("classification").alias("category"),
                 F.concat(F.lit("Predict injury degree for: "), body, F.lit(".")).alias("question"),
                 F.array(F.lit(TOOL_CLASSIFY)).alias("expected_tools"),
                 F.lit("degree_code").alias("ref_type"),
                 canonical_code(target).alias("_v"), F.col(key).cast("string").alias("_d"))
    return _finish(s, ref_value=F.col("_v"), ref_document_no=F.col("_d"))


def trend_items(series: DataFrame, count_specs: DataFrame, period_specs: DataFrame,
                year_col: str, partial_year: int) -> DataFrame:
    """B2: count items (value = the year's count, partial year excluded as
    in T1) and period items (two inclusive-range totals, as in T4).

    ``series`` is ``spec_year_series`` output for all spec ids.
    """
    s = series.filter(F.col(year_col) != partial_year)
    counts = (count_specs.alias("q")
              .join(s.alias("s"), (F.col("q.spec_id") == F.col("s.spec_id")) &
                    (F.col("q.year") == F.col(f"s.{year_col}")), "left")
              .select(F.col("q.spec_id").alias("question_id"), F.lit("trend").alias("category"),
                      F.col("q.question"), F.array(F.lit(TOOL_TRENDS)).alias("expected_tools"),
                      F.lit("count").alias("ref_type"),
                      F.coalesce(F.col("s.injury_count"), F.lit(0)).cast("string").alias("_v"),
                      F.col("q.year").cast("int").alias("_y")))
    counts = _finish(counts, ref_value=F.col("_v"), ref_year=F.col("_y"))
    y = F.col(f"s.{year_col}")
    per = (period_specs.alias("q").join(series.alias("s"), F.col("q.spec_id") == F.col("s.spec_id"), "left")
           .groupBy("q.spec_id", "q.question", "q.a0", "q.a1", "q.b0", "q.b1")
           .agg(F.sum(F.when(y.between(F.col("q.a0"), F.col("q.a1")), F.col("s.injury_count"))
                      .otherwise(0)).alias("na"),
                F.sum(F.when(y.between(F.col("q.b0"), F.col("q.b1")), F.col("s.injury_count"))
                      .otherwise(0)).alias("nb")))
    per = per.select(F.col("spec_id").alias("question_id"), F.lit("trend").alias("category"),
                     "question", F.array(F.lit(TOOL_TRENDS)).alias("expected_tools"),
                     F.lit("period_compare").alias("ref_type"),
                     F.format_string("%d-%d", "a0", "a1").alias("_pa"),
                     F.format_string("%d-%d", "b0", "b1").alias("_pb"),
                     F.array(F.coalesce("na", F.lit(0)).cast("bigint"),
                             F.coalesce("nb", F.lit(0)).cast("bigint")).alias("_c"))
    per = _finish(per, ref_period_a=F.col("_pa"), ref_period_b=F.col("_pb"), ref_counts=F.col("_c"))
    return counts.unionByName(per)


def case_queries(seed_texts: DataFrame, corpus: DataFrame, doc_id: str, text: str,
                 n_seed: int = 10, n_snippets: int = 10, seed_a: int = 42, seed_b: int = 7,
                 snippet_len: int = 80) -> DataFrame:
    """B3 inputs: (question_id, question, query, must_include).

    Seed items are whole texts from ``seed_texts`` (item_id, text); snippet
    items are the first ``snippet_len`` characters of narratives longer
    than that (C15) - the snippet *is* the question, as in the original.
    """
    a = split.seeded_sample(seed_texts, "item_id", n_seed, seed_a) \
        .withColumn("_h", md5_order("item_id", F.lit(str(seed_a))))
    a = a.select(F.row_number().over(Window.orderBy("_h", "item_id")).alias("_i"),
                 F.col("text").alias("query"), F.lit(None).cast("string").alias("must_include"))
    long_docs = corpus.filter(F.length(text) > snippet_len)
    b = split.seeded_sample(long_docs, doc_id, n_snippets, seed_b) \
        .withColumn("_h", md5_order(doc_id, F.lit(str(seed_b))))
    b = b.select((F.row_number().over(Window.orderBy("_h", doc_id)) + n_seed).alias("_i"),
                 F.substring(text, 1, snippet_len).alias("query"),
                 F.col(doc_id).cast("string").alias("must_include"))
    a = a.withColumn("question", F.concat(F.lit("Find historical incidents similar to: "), "query"))
    b = b.withColumn("question", F.concat(F.lit("Find incidents similar to this narrative snippet: "),
                                          "query"))
    return a.unionByName(b).select(F.format_string("CASE-%02d", "_i").alias("question_id"),
                                   "question", "query", "must_include")


def case_items(queries: DataFrame, hits: DataFrame, doc_id: str) -> DataFrame:
    """Attach the top-k document ids (by rank) to each case query."""
    ids = (hits.groupBy("qid").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.col(doc_id).cast("string").alias("d")))).alias("_l"))
        .select("qid", F.transform("_l", lambda x: x["d"]).alias("_docs")))
    j = queries.join(ids, queries.question_id == ids.qid, "left")
    j = j.select("question_id", F.lit("case_grounded").alias("category"), "question",
                 F.array(F.lit(TOOL_SEARCH)).alias("expected_tools"),
                 F.lit("document_set").alias("ref_type"), "query", "must_include",
                 F.coalesce("_docs", F.array().cast("array<string>")).alias("_docs"))
    return _finish(j, ref_query=F.col("query"), ref_documents=F.col("_docs"),
                   ref_must_include=F.col("must_include"))


def category_counts(bank: DataFrame) -> DataFrame:
    """A6."""
    return bank.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


RUN_SCHEMA = T.StructType([
    T.StructField("question_id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("system", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("tools_used", T.ArrayType(T.StringType())),
    T.StructField("usage", T.StructType([T.StructField("prompt_tokens", T.LongType()),
                                        T.StructField("completion_tokens", T.LongType()),
                                        T.StructField("total_tokens", T.LongType())])),
    T.StructField("latency_s", T.DoubleType()), T.StructField("error", T.StringType())])


def no_usage():
    return F.struct(F.lit(0).cast("bigint").alias("prompt_tokens"),
                    F.lit(0).cast("bigint").alias("completion_tokens"),
                    F.lit(0).cast("bigint").alias("total_tokens"))
