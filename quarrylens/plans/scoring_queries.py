"""Scoring, accuracy, failure and significance queries with SQL oracles
(E1-E6, E8-E11, E13-E15, J6, Q11).

The run table of ``qa_queries`` holds answers of a trained forest, so it can't
be rebuilt in SQL. Here every labelled document is one question, its reference
and three systems' answers are derived from its own row, and latency, tokens
and errors are read from the event whose id is the document's: wrong and
missing answers, counts of seven digits and more, references of every type,
unknown types, missing references and errored runs all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import evaluation
from quarrylens.plans.bindings import table
from quarrylens.spec import SYSTEMS, TOOL_CLASSIFY, TOOL_SEARCH, TOOL_TRENDS

_CATEGORIES = ["classification", "trend", "trend", "case_grounded", "other"]
_TYPES = ["degree_code", "count", "period_compare", "document_set", "essay"]


def _pick(names: list[str]):
    return F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 5).cast("int"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference per question; every seventh question has none."""
    d = _labelled(spark, sf_dir).where("doc_id % 7 <> 3")
    n, kind = F.col("n_chars"), _pick(_TYPES)
    docs = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("#"), (F.col("doc_id") + i).cast("string"), F.lit(".")))
    return d.select(
        "question_id", kind.alias("ref_type"),
        F.when(kind == "degree_code", F.lpad((n % 12 + 1).cast("string"), 2, "0"))
        .when(kind == "count", (n * 1000 + F.col("doc_id")).cast("string")).alias("ref_value"),
        F.when(kind == "period_compare", F.array(n, n * 3)).alias("ref_counts"),
        F.when(kind == "document_set", docs).alias("ref_documents"),
        F.when((kind == "document_set") & (F.col("quality") == 0), F.get(docs, F.lit(1))).alias("ref_must_include"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn(
        "question_id", F.format_string("CASE-%06d", "doc_id"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: question x system run rows with answer, tools, usage, latency, error."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("value").alias("latency_s"), "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    d = _labelled(spark, sf_dir).join(ev, "doc_id", "left")
    x = d.withColumn("system", F.explode(F.array(*[F.lit(s) for s in SYSTEMS])))
    off = F.when(F.col("system") == SYSTEMS[0], F.col("toxic")).when(
        F.col("system") == SYSTEMS[1], 1 - F.col("quality")).otherwise(F.lit(1))
    x = x.withColumn("off", off)
    n, kind = F.col("n_chars"), _pick(_TYPES)
    grouped = F.format_number((n * 1000 + F.col("doc_id") + F.col("off")).cast("bigint"), 0)
    second = n * 3 + F.floor(n * 3 * 0.04 * F.col("off")).cast("bigint") + F.when(F.col("system") == SYSTEMS[2], n).otherwise(0)
    answer = (
        F.when(kind == "degree_code", F.concat(F.lit("Predicted degree code "), F.lpad(((n + F.col("off")) % 12 + 1).cast("string"), 2, "0"), F.lit(".")))
        .when(kind == "count", F.concat(F.lit("There were "), grouped, F.lit(" records.")))
        .when(kind == "period_compare", F.concat(F.lit("First "), n.cast("string"), F.lit(", second "), second.cast("string"), F.lit(".")))
        .when((kind == "document_set") & (F.col("off") == 1), F.concat(F.lit("See #"), (F.col("doc_id") + 5).cast("string"), F.lit(". only")))
        .when(kind == "document_set", F.concat(F.lit("See #"), (F.col("doc_id") + 1 + n % 3).cast("string"), F.lit(". and more")))
    )
    tools = F.when(F.col("system") == SYSTEMS[0], F.array(_pick([TOOL_CLASSIFY, TOOL_TRENDS, TOOL_SEARCH, TOOL_SEARCH, TOOL_TRENDS]))) \
        .when(F.col("system") == SYSTEMS[1], F.array(F.lit(TOOL_CLASSIFY))).otherwise(F.array(F.lit(TOOL_TRENDS)))
    return x.select(
        "question_id", _pick(_CATEGORIES).alias("category"), "system", answer.alias("answer"), tools.alias("tools_used"),
        F.array(_pick([TOOL_CLASSIFY, TOOL_TRENDS, TOOL_TRENDS, TOOL_SEARCH, TOOL_SEARCH])).alias("expected_tools"),
        F.struct(F.lit(None).cast("bigint").alias("prompt_tokens"), F.lit(None).cast("bigint").alias("completion_tokens"),
                 F.col("k").alias("total_tokens")).alias("usage"),
        "latency_s", F.when((F.col("event_type") == "error") & (F.col("off") == 1), F.lit("timeout")).alias("error"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + E6: a run without a reference stays, scored false."""
    return evaluation.score_rows(runs(spark, sf_dir).join(references(spark, sf_dir), "question_id", "left"))


def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("question_id", "system", "correct", "reason")


def score_case_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy_sets(scored(spark, sf_dir))


def score_case_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failure_table(scored(spark, sf_dir))


def score_case_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.all_comparisons(scored(spark, sf_dir), SYSTEMS[0], SYSTEMS[1:]).select(
        "label", "n_questions", "a_right_b_wrong", "a_wrong_b_right", "system_a_correct", "system_b_correct")


QUERIES = {
    "score_cases": score_cases,
    "score_case_accuracy": score_case_accuracy,
    "score_case_failures": score_case_failures,
    "score_case_significance": score_case_significance,
}



def _sql_pick(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "][doc_id % 5 + 1]"


_SCORED = f"""
WITH d AS (
  SELECT l.doc_id, l.toxic, l.quality, n_chars AS n, printf('CASE-%06d', l.doc_id) AS question_id, {_sql_pick(_TYPES)} AS kind,
         e.value AS latency_s, e.event_type, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k
  FROM labels l JOIN documents USING (doc_id) LEFT JOIN events e ON e.event_id = l.doc_id),
x AS (
  SELECT d.*, s.system, CASE s.system WHEN '{SYSTEMS[0]}' THEN toxic WHEN '{SYSTEMS[1]}' THEN 1 - quality ELSE 1 END AS off
  FROM d, (SELECT unnest({list(SYSTEMS)}) AS system) s),
r AS (
  SELECT x.*, {_sql_pick(_CATEGORIES)} AS category, doc_id % 7 <> 3 AS has_ref,
    CASE kind WHEN 'degree_code' THEN 'Predicted degree code ' || lpad(CAST((n + off) % 12 + 1 AS VARCHAR), 2, '0') || '.'
              WHEN 'count' THEN 'There were ' || format('{{:,}}', n * 1000 + doc_id + off) || ' records.'
              WHEN 'period_compare' THEN 'First ' || n || ', second ' || (n * 3 + CAST(floor(CAST(n * 3 AS DOUBLE) * 0.04 * off) AS BIGINT)
                   + CASE WHEN system = '{SYSTEMS[2]}' THEN n ELSE 0 END) || '.'
              WHEN 'document_set' THEN CASE WHEN off = 1 THEN 'See #' || (doc_id + 5) || '. only' ELSE 'See #' || (doc_id + 1 + n % 3) || '. and more' END
    END AS answer,
    CASE system WHEN '{SYSTEMS[0]}' THEN {_sql_pick([TOOL_CLASSIFY, TOOL_TRENDS, TOOL_SEARCH, TOOL_SEARCH, TOOL_TRENDS])}
         WHEN '{SYSTEMS[1]}' THEN '{TOOL_CLASSIFY}' ELSE '{TOOL_TRENDS}' END AS used,
    {_sql_pick([TOOL_CLASSIFY, TOOL_TRENDS, TOOL_TRENDS, TOOL_SEARCH, TOOL_SEARCH])} AS expected,
    CASE WHEN event_type = 'error' AND off = 1 THEN 'timeout' END AS error,
    CASE WHEN kind = 'document_set' AND quality = 0 THEN '#' || (doc_id + 2) || '.' END AS must
  FROM x),
num AS (
  SELECT r.*, list_transform(regexp_extract_all(replace(coalesce(answer, ''), ',', ''), '\\b(\\d{{1,18}})\\b', 1), lambda v: CAST(v AS BIGINT)) AS nums,
         regexp_extract_all(coalesce(answer, ''), '\\b(0[1-9]|10)\\b', 1) AS codes
  FROM r),
c AS (
  SELECT num.*, CASE WHEN NOT has_ref THEN false
    WHEN kind = 'degree_code' THEN list_contains(codes, lpad(CAST(n % 12 + 1 AS VARCHAR), 2, '0'))
    WHEN kind = 'count' THEN nums[1] IS NOT DISTINCT FROM n * 1000 + doc_id
    WHEN kind = 'period_compare' THEN
      len(list_filter(nums, lambda v: abs(v - n) <= greatest(1, CAST(floor(n * 0.05) AS BIGINT)))) > 0
      AND len(list_filter(nums, lambda v: abs(v - n * 3) <= greatest(1, CAST(floor(n * 3 * 0.05) AS BIGINT)))) > 0
    WHEN kind = 'document_set' AND must IS NOT NULL THEN contains(answer, must)
    WHEN kind = 'document_set' THEN contains(answer, '#' || (doc_id + 1) || '.') OR contains(answer, '#' || (doc_id + 2) || '.')
      OR contains(answer, '#' || (doc_id + 3) || '.')
    ELSE false END AS correct
  FROM num),
scored AS (
  SELECT c.*, CASE WHEN NOT has_ref OR kind = 'essay' THEN 'unknown reference type'
    WHEN kind = 'degree_code' THEN CASE WHEN correct THEN 'degree code matched' ELSE 'missing expected degree code' END
    WHEN kind = 'count' THEN 'expected ' || (n * 1000 + doc_id) || ', got ' || coalesce(CAST(nums[1] AS VARCHAR), 'None')
    WHEN kind = 'period_compare' THEN CASE WHEN correct THEN 'period totals matched' ELSE 'period totals not found within tolerance' END
    WHEN must IS NOT NULL THEN 'must include document ' || must
    WHEN correct THEN 'document cited' ELSE 'top retrieved document not cited' END AS reason,
    CASE WHEN system = '{SYSTEMS[0]}' THEN used = expected WHEN system = '{SYSTEMS[1]}' THEN used = '{TOOL_CLASSIFY}'
         ELSE used = '{TOOL_SEARCH}' END AS tool_ok
  FROM c)"""

_FIELDS = """round(avg(CAST(correct AS DOUBLE)), 4) AS accuracy, count(*) AS n"""

ORACLE = {
    "score_cases": _SCORED + " SELECT question_id, system, correct, reason FROM scored",
    "score_case_accuracy": _SCORED + f"""
SELECT system, category, {_FIELDS}, CAST(NULL AS DOUBLE) AS tool_rate, CAST(NULL AS DOUBLE) AS mean_latency_s,
       CAST(NULL AS DOUBLE) AS mean_tokens, CAST(NULL AS BIGINT) AS total_tokens FROM scored GROUP BY system, category
UNION ALL
SELECT system, 'overall', {_FIELDS}, round(avg(CAST(tool_ok AS DOUBLE)), 4), round(avg(coalesce(latency_s, 0)), 3),
       round(avg(coalesce(k, 0)), 1), CAST(sum(coalesce(k, 0)) AS BIGINT) FROM scored GROUP BY system""",
    "score_case_failures": _SCORED + """
SELECT question_id, system, category, reason, error, substring(coalesce(answer, ''), 1, 300) AS answer_excerpt
FROM scored WHERE NOT correct OR error IS NOT NULL""",
    "score_case_significance": _SCORED + f""",
p AS (SELECT a.question_id, b.system, a.correct AS x, b.correct AS y FROM scored a JOIN scored b
      ON a.question_id = b.question_id AND a.system = '{SYSTEMS[0]}' AND b.system <> a.system)
SELECT '{SYSTEMS[0]}_vs_' || system AS label, count(*) AS n_questions, count(*) FILTER (x AND NOT y) AS a_right_b_wrong,
       count(*) FILTER (y AND NOT x) AS a_wrong_b_right, count(*) FILTER (x) AS system_a_correct, count(*) FILTER (y) AS system_b_correct
FROM p GROUP BY system""",
}
