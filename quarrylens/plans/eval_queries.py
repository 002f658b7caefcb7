"""Registered scoring-side queries with SQL oracles (E7, E9, E10, E12-E16,
J4, J5, J7, J12, Q12, C20, S8).

The run table of ``qa_queries`` goes through the trained forest, so the
queries there are checked on rows only. The queries here bind the same
operators to inputs that DuckDB can rebuild exactly:

* tool choice - the routed question bank (tools do not depend on answers);
* paired correctness - ``labels`` joined to ``documents``: three systems
  predict ``quality`` (agent: ``1 - toxic``; classifier baseline: the
  majority class 1; retrieval baseline: ``n_chars >= 200``);
* run events - ``events`` (event type = system, value = latency, ``props.k``
  = tokens) and ``conversations`` (a conversation is a run, a turn an event).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import evaluation, questions
from quarrylens.plans import qa_queries as qa
from quarrylens.plans.bindings import table
from quarrylens.spec import SYSTEMS, TOOL_CLASSIFY, TOOL_SEARCH, TOOL_TRENDS

# Category -> the tool the question expects (bank items carry it too).
EXPECTED_TOOL = {"classification": TOOL_CLASSIFY, "trend": TOOL_TRENDS, "case_grounded": TOOL_SEARCH}
# C20: the subset of systems a resumed run covers.
RESUME_SYSTEMS = ["agent", "rag_baseline"]
LONG_DOC_CHARS = 200


def select_systems(names: list[str]) -> list[str]:
    """C20: a subset of the known systems; an unknown name raises."""
    unknown = sorted(set(names) - set(SYSTEMS))
    if unknown:
        raise ValueError(f"unknown systems: {unknown}")
    return [s for s in SYSTEMS if s in names]


def _systems_col(names: list[str]):
    return F.explode(F.array(*[F.lit(s) for s in names])).alias("system")


def tool_correct_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + J12 (+ J5): every question x system with the tools it used."""
    b = qa.question_bank(spark, sf_dir).select("question_id", "question", "category", "expected_tools")
    p = questions.parse_questions(b, trend_rules=qa.DRIVER_TREND_RULES)
    x = p.select("question_id", "category", "expected_tools", "route", _systems_col(SYSTEMS))
    used = (F.when(F.col("system") == "agent", questions.tools_for(F.col("route")))
            .when(F.col("system") == "classifier_baseline", F.array(F.lit(TOOL_CLASSIFY)))
            .otherwise(F.array(F.lit(TOOL_SEARCH))))
    s = evaluation.tool_correct(x.withColumn("tools_used", used))
    return s.select("question_id", "system", F.array_join("tools_used", ",").alias("tools_used"),
                    "tool_correct")


def tool_rate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-selection rate per system, rounded to 4."""
    return tool_correct_q(spark, sf_dir).groupBy("system").agg(
        F.round(F.avg(F.col("tool_correct").cast("double")), 4).alias("tool_rate"),
        F.count(F.lit(1)).alias("n"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + J5 + Q12 + C20: (question, system) pairs still to run.

    The checkpoint holds the agent's trend answers; merged partial runs are
    deduplicated per key (newest wins) before the anti-join.
    """
    systems = select_systems(RESUME_SYSTEMS)
    bank = qa.question_bank(spark, sf_dir).select("question_id")
    pairs = bank.select("question_id", _systems_col(systems))
    done = (qa.answer_trends_bulk(spark, sf_dir)
            .select("question_id", F.lit("agent").alias("system"), "answer",
                    F.lit(1).alias("run_seq")))
    # a second partial run answered every other question again
    done = done.unionByName(done.where(F.crc32("question_id") % 2 == 0).withColumn("run_seq", F.lit(2)))
    done = evaluation.latest_per_key(done, ["system", "question_id"], "run_seq")
    return pairs.join(done.select("system", "question_id"), ["system", "question_id"], "left_anti")


def labelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems' correctness per labelled document (J6 analogue)."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id", "left")
    pred = (F.when(F.col("system") == "agent", 1 - F.col("toxic"))
            .when(F.col("system") == "classifier_baseline", F.lit(1))
            .otherwise(F.when(F.col("n_chars") >= LONG_DOC_CHARS, 1).otherwise(0)))
    x = j.select(F.format_string("DOC-%05d", F.col("doc_id")).alias("question_id"), "quality",
                 "toxic", "n_chars", _systems_col(SYSTEMS))
    return x.select("question_id", "system", (pred == F.col("quality")).alias("correct"))


def correctness_pivot_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question x system correctness grid."""
    return evaluation.correctness_pivot(labelled_runs(spark, sf_dir), SYSTEMS)


def paired_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13 + E14 + E15 + J7: agent against each baseline."""
    return evaluation.all_comparisons(labelled_runs(spark, sf_dir), SYSTEMS[0], SYSTEMS[1:])


def latency_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean latency, mean and total tokens per system."""
    ev = table(spark, sf_dir, "events")
    tok = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0).cast("bigint"))
    return ev.groupBy(F.col("event_type").alias("system")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce(F.col("value"), F.lit(0.0))), 3).alias("mean_latency_s"),
        F.round(F.avg(tok), 1).alias("mean_tokens"),
        F.sum(tok).alias("total_tokens"))


def _word_count(c):
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), 0)).cast("bigint")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as run-log events."""
    conv = table(spark, sf_dir, "conversations")
    kind = (F.when(F.col("role") == "user", F.lit("question"))
            .when(F.col("role") == "assistant", F.lit("final_answer"))
            .otherwise(F.lit("reasoning")))
    words = _word_count(F.col("text"))
    prompt = F.when(F.col("role") != "assistant", words).otherwise(F.lit(0).cast("bigint"))
    completion = F.when(F.col("role") == "assistant", words).otherwise(F.lit(0).cast("bigint"))
    return conv.select(F.format_string("RUN-%05d", F.col("conv_id")).alias("run_id"),
                       F.lit("agent").alias("system"), kind.alias("event_type"),
                       F.col("turn").cast("double").alias("elapsed_s"),
                       prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
                       (prompt + completion).alias("total_tokens"),
                       F.col("text").alias("answer"))


def usage_by_run_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E16 + S8: per run event counts, summed usage, duration, last answer."""
    u = evaluation.usage_by_run(run_events(spark, sf_dir))
    return u.select("run_id", "system", "events", "tool_calls", "prompt_tokens", "completion_tokens",
                    "total_tokens", "duration_s", F.md5(F.coalesce("final_answer", F.lit("")))
                    .alias("final_answer_md5"))


QUERIES = {
    "tool_correct": tool_correct_q,
    "tool_rate": tool_rate_q,
    "resume_pending": resume_pending,
    "correctness_pivot": correctness_pivot_q,
    "paired_mcnemar": paired_mcnemar,
    "latency_tokens": latency_tokens,
    "usage_by_run": usage_by_run_q,
}


# --------------------------------------------------------------------------
# DuckDB oracle SQL
# --------------------------------------------------------------------------
def _oracle() -> dict:
    qa_sql = qa.ORACLE
    sys_list = "[" + ", ".join(f"'{s}'" for s in SYSTEMS) + "]"
    exp_case = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in EXPECTED_TOOL.items())
    o = {}
    tc = f"""WITH r AS ({qa_sql['question_route']}),
b AS ({qa_sql['question_bank']}),
x AS (
  SELECT b.question_id, r.route, CASE b.category {exp_case} END AS expected, s.system
  FROM b JOIN r USING (question_id), (SELECT unnest({sys_list}) AS system) s),
u AS (
  SELECT *, CASE WHEN system = 'agent' THEN
                   CASE route WHEN 'classification' THEN '{TOOL_CLASSIFY}' WHEN 'case' THEN '{TOOL_SEARCH}'
                              WHEN 'trend' THEN '{TOOL_TRENDS}' ELSE '' END
                 WHEN system = 'classifier_baseline' THEN '{TOOL_CLASSIFY}'
                 ELSE '{TOOL_SEARCH}' END AS tools_used
  FROM x)
SELECT question_id, system, tools_used,
       CASE WHEN system = 'agent' THEN tools_used <> '' AND tools_used = coalesce(expected, '')
            WHEN system = 'classifier_baseline' THEN tools_used = '{TOOL_CLASSIFY}'
            ELSE tools_used = '{TOOL_SEARCH}' END AS tool_correct
FROM u"""
    o["tool_correct"] = tc
    o["tool_rate"] = f"""SELECT system, round(avg(CAST(tool_correct AS DOUBLE)), 4) AS tool_rate,
       count(*) AS n FROM ({tc}) t GROUP BY system"""
    res_list = "[" + ", ".join(f"'{s}'" for s in RESUME_SYSTEMS) + "]"
    o["resume_pending"] = f"""WITH b AS ({qa_sql['question_bank']}),
a AS ({qa_sql['answer_trends_bulk']})
SELECT b.question_id, s.system
FROM b, (SELECT unnest({res_list}) AS system) s
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.question_id = b.question_id AND s.system = 'agent')"""
    runs = f"""runs AS (
  SELECT printf('DOC-%05d', l.doc_id) AS question_id, s.system,
         (CASE WHEN s.system = 'agent' THEN 1 - l.toxic
               WHEN s.system = 'classifier_baseline' THEN 1
               ELSE CASE WHEN d.n_chars >= {LONG_DOC_CHARS} THEN 1 ELSE 0 END END) = l.quality AS correct
  FROM labels l LEFT JOIN documents d USING (doc_id), (SELECT unnest({sys_list}) AS system) s)"""
    o["correctness_pivot"] = f"""WITH {runs}
SELECT question_id,
       {", ".join(f"CAST(max(CASE WHEN system = '{s}' THEN CAST(correct AS INTEGER) END) AS BOOLEAN) AS {s}" for s in SYSTEMS)}
FROM runs GROUP BY question_id"""
    pairs = " UNION ALL ".join(
        f"""SELECT '{SYSTEMS[0]}_vs_{o_}' AS label, a.correct AS a_ok, b.correct AS b_ok
  FROM runs a JOIN runs b ON a.question_id = b.question_id AND a.system = '{SYSTEMS[0]}' AND b.system = '{o_}'"""
        for o_ in SYSTEMS[1:])
    o["paired_mcnemar"] = f"""WITH {runs},
p AS ({pairs}),
c AS (
  SELECT label, count(*) AS n_questions,
         count(*) FILTER (WHERE a_ok AND b_ok) AS both_correct,
         count(*) FILTER (WHERE NOT a_ok AND NOT b_ok) AS both_wrong,
         count(*) FILTER (WHERE a_ok AND NOT b_ok) AS a_right_b_wrong,
         count(*) FILTER (WHERE NOT a_ok AND b_ok) AS a_wrong_b_right,
         count(*) FILTER (WHERE a_ok) AS system_a_correct,
         count(*) FILTER (WHERE b_ok) AS system_b_correct
  FROM p GROUP BY label),
pv AS (
  SELECT label,
         CASE WHEN a_right_b_wrong + a_wrong_b_right = 0 THEN 1.0 ELSE
           least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))
                           FROM (SELECT a_right_b_wrong + a_wrong_b_right AS n) t,
                                range(0, least(a_right_b_wrong, a_wrong_b_right) + 1) r(i)))
         END AS p
  FROM c)
SELECT c.label, n_questions, both_correct, both_wrong, a_right_b_wrong, a_wrong_b_right,
       a_right_b_wrong + a_wrong_b_right AS discordant,
       system_a_correct, round(system_a_correct / n_questions, 4) AS system_a_accuracy,
       system_b_correct, round(system_b_correct / n_questions, 4) AS system_b_accuracy,
       round(pv.p, 4) AS exact_mcnemar_p_value, pv.p < 0.05 AS significant_at_0_05
FROM c JOIN pv USING (label)"""
    o["latency_tokens"] = """SELECT event_type AS system, count(*) AS n,
       round(avg(coalesce(value, 0.0)), 3) AS mean_latency_s,
       round(avg(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)), 1) AS mean_tokens,
       CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS total_tokens
FROM events GROUP BY event_type"""
    o["usage_by_run"] = """WITH e AS (
  SELECT printf('RUN-%05d', conv_id) AS run_id, 'agent' AS system,
         CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'final_answer' ELSE 'reasoning' END
           AS event_type,
         CAST(turn AS DOUBLE) AS elapsed_s,
         len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words, role, text
  FROM conversations),
t AS (
  SELECT *, CASE WHEN role <> 'assistant' THEN words ELSE 0 END AS prompt_tokens,
            CASE WHEN role = 'assistant' THEN words ELSE 0 END AS completion_tokens
  FROM e)
SELECT run_id, system, count(*) AS events,
       count(*) FILTER (WHERE event_type = 'tool_call') AS tool_calls,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
       max(elapsed_s) AS duration_s,
       md5(coalesce(arg_max(text, elapsed_s) FILTER (WHERE event_type = 'final_answer'), '')) AS final_answer_md5
FROM t GROUP BY run_id, system"""
    return o


ORACLE = _oracle()
