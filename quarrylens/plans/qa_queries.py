"""Registered question-bank, answering and scoring queries on the driver tables.

Pipeline: incidents + documents + benchmark -> question bank (B1-B4) ->
parsed questions (Q1-Q7) -> offline answers of three systems (Q8-Q11) ->
scores (E1-E11) -> paired significance (E12-E15).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators import bank, evaluation, questions, retrieval, runs, severity, trends
from quarrylens.plans.artifacts import artifact_path, new_version, table_or_build
from quarrylens.plans.bindings import DRIVER_SPEC, incident_table, table
from quarrylens.spec import NO_COUNT_ANSWER, SYSTEMS, TOOL_CLASSIFY, TOOL_SEARCH

SPEC = DRIVER_SPEC

# Driver vocabulary for the trend parser (same rule shapes as the original).
DRIVER_TREND_RULES = questions.TrendRules(
    degree_cues=(("urgent", "01"), ("high-priority", "02")),
    cues=(
        ("fulfilled", "coal_metal", "F"),
        ("open order", "coal_metal", "O"),
        ("pending", "coal_metal", "P"),
        ("building segment", "classification", "BUILDING"),
        ("machinery segment", "classification", "MACHINERY"),
        ("household segment", "classification", "HOUSEHOLD"),
        (" in nation_7", "state", "NATION_7"),
        (" in nation_12", "state", "NATION_12"),
        ("middle east", "occupation", "middle east"),
        ("europe", "occupation", "europe"),
    ))
FILTER_DIMS = {"degree_code": "DEGREE_INJURY_CD", "coal_metal": "COAL_METAL_IND",
               "state": "STATE", "classification": "CLASSIFICATION", "occupation": "OCCUPATION"}
CONTAINS_DIMS = ("OCCUPATION",)

# Question key -> incident column used to template classification items.
FIELD_MAP = [
    ("subunit_cd", "PRICE_BAND_CD"),
    ("classification_cd", "CLASSIFICATION"),
    ("occupation_cd", "STATE"),
    ("activity_cd", "MONTH_CD"),
    ("injury_source_cd", "ACCT_BAND_CD"),
    ("nature_injury_cd", "PRICE_FINE_CD"),
    ("inj_body_part_cd", "MKT_SEGMENT"),
    ("mining_equip_cd", "MINE_ID"),
    ("coal_metal_ind", "COAL_METAL_IND"),
    ("accident_type_cd", "OCCUPATION"),
]
# Parsed field (original name) -> model feature column.
SERVE_MAP = {"COAL_METAL_IND": "COAL_METAL_IND", "CLASSIFICATION": "CLASSIFICATION_CD",
             "STATE": "OCCUPATION_CD", "OCCUPATION": "ACCIDENT_TYPE_CD",
             "PRICE_BAND_CD": "SUBUNIT_CD", "MONTH_CD": "ACTIVITY_CD"}

# (id, question, year, filters) count items and (id, question, a, b, filters) periods.
COUNT_SPECS = [
    ("TRD-01", "How many urgent orders (degree code 01) occurred in 1996?", 1996, {"degree_code": "01"}),
    ("TRD-02", "How many urgent orders occurred in 2000?", 2000, {"degree_code": "01"}),
    ("TRD-03", "How many fulfilled orders were placed in nation_7 in 1997?", 1997,
     {"coal_metal": "F", "state": "NATION_7"}),
    ("TRD-04", "How many building segment orders occurred in 1999?", 1999, {"classification": "BUILDING"}),
    ("TRD-05", "How many orders from the middle east occurred in 1998?", 1998, {"occupation": "middle east"}),
    ("TRD-06", "How many open orders from europe occurred in 1995?", 1995,
     {"coal_metal": "O", "occupation": "europe"}),
    ("TRD-07", "How many degree-code-03 orders occurred in 1997?", 1997, {"degree_code": "03"}),
    ("TRD-08", "How many degree-code-05 orders occurred in 2000?", 2000, {"degree_code": "05"}),
    ("TRD-09", "How many machinery segment orders occurred in 1996?", 1996, {"classification": "MACHINERY"}),
    ("TRD-10", "How many household segment orders occurred in 1998?", 1998, {"classification": "HOUSEHOLD"}),
]
PERIOD_SPECS = [
    ("TRD-11", "Compare fulfilled order counts between 1995-1996 and 1997-1998.", (1995, 1996),
     (1997, 1998), {"coal_metal": "F"}),
    ("TRD-12", "Compare urgent order counts between 1995-1997 and 1998-2000.", (1995, 1997),
     (1998, 2000), {"degree_code": "01"}),
]
FILLER_SPECS = ([(y, "02") for y in range(1995, 2001)] + [(1996, "04"), (1999, "04")])


def _all_count_specs():
    specs = list(COUNT_SPECS)
    for i, (year, code) in enumerate(FILLER_SPECS, start=13):
        specs.append((f"TRD-{i:02d}", f"How many high-priority orders (degree code {code}) "
                      f"occurred in {year}?", year, {"degree_code": code}))
    return specs


def _spec_frame(spark, rows):
    """rows: (spec_id, question, year, a0, a1, b0, b1, filters) -> spec table."""
    fields = [T.StructField("spec_id", T.StringType()), T.StructField("question", T.StringType()),
              T.StructField("year", T.IntegerType())] + \
             [T.StructField(n, T.IntegerType()) for n in ("a0", "a1", "b0", "b1")] + \
             [T.StructField(f"f_{c}", T.StringType()) for c in FILTER_DIMS.values()]
    data = [(sid, q, y, a0, a1, b0, b1, *[f.get(k) for k in FILTER_DIMS]) for
            sid, q, y, a0, a1, b0, b1, f in rows]
    return spark.createDataFrame(data, T.StructType(fields))


def _trend_spec_frames(spark):
    counts = [(s, q, y, None, None, None, None, f) for s, q, y, f in _all_count_specs()]
    periods = [(s, q, None, a[0], a[1], b[0], b[1], f) for s, q, a, b, f in PERIOD_SPECS]
    return _spec_frame(spark, counts), _spec_frame(spark, periods)


BANK_TABLES = ["orders", "customer", "nation", "region", "documents", "benchmark"]


def question_bank(spark: SparkSession, sf_dir: str, index=None):
    """B4 + S6: the bank, built once per input version and stored (the
    original wrote questions and reference answers to files once)."""
    from quarrylens.plans.artifacts import data_version

    return table_or_build(spark, "question_bank", lambda: build_question_bank(spark, sf_dir, index),
                          sf_dir=sf_dir, data=data_version(spark, sf_dir, BANK_TABLES))


def build_question_bank(spark: SparkSession, sf_dir: str, index=None):
    inc = incident_table(spark, sf_dir)
    cls = bank.classification_items(inc, FIELD_MAP, "DOCUMENT_NO", SPEC.target, 20, 42)
    count_specs, period_specs = _trend_spec_frames(spark)
    all_specs = count_specs.unionByName(period_specs)
    series = trends.spec_year_series(inc, all_specs, list(FILTER_DIMS.values()), SPEC, CONTAINS_DIMS)
    trd = bank.trend_items(series, count_specs, period_specs, SPEC.year, SPEC.partial_year)
    docs = table(spark, sf_dir, "documents")
    cq = bank.case_queries(table(spark, sf_dir, "benchmark"), docs, "doc_id", "text")
    if index is None:
        from quarrylens.plans.model_queries import documents_index

        index = documents_index(spark, sf_dir)
    hits = retrieval.lexical_search(index, cq.select(F.col("question_id").alias("qid"),
                                                     F.col("query")), k=5)
    case = bank.case_items(cq, hits, "doc_id")
    return cls.unionByName(trd).unionByName(case)


def question_bank_view(spark: SparkSession, sf_dir: str):
    b = question_bank(spark, sf_dir)
    return b.select("question_id", "category", "question", "ref_type", "ref_value",
                    "ref_document_no", "ref_year", "ref_period_a", "ref_period_b",
                    F.array_join(F.col("ref_counts").cast("array<string>"), ",").alias("ref_counts"),
                    F.array_join("ref_documents", ",").alias("ref_documents"), "ref_must_include")


def question_fields_q(spark: SparkSession, sf_dir: str):
    b = question_bank(spark, sf_dir).select("question_id", "question")
    f = questions.question_fields(b)
    return f.select("question_id", "n_found", "field_source",
                    *[c for _, c in questions.FIELD_KEYS])


def question_filters_q(spark: SparkSession, sf_dir: str):
    b = question_bank(spark, sf_dir).select("question_id", "question", "category")
    p = questions.parse_questions(b, trend_rules=DRIVER_TREND_RULES)
    return p.drop("question", "category", "route", "retrieval_query")


def question_route_q(spark: SparkSession, sf_dir: str):
    b = question_bank(spark, sf_dir).select("question_id", "question", "category")
    no_cat = questions.parse_questions(b, category=None, trend_rules=DRIVER_TREND_RULES)
    with_cat = questions.parse_questions(b, trend_rules=DRIVER_TREND_RULES)
    return (with_cat.select("question_id", "route", "retrieval_query")
            .join(no_cat.select("question_id", F.col("route").alias("route_blind")), "question_id"))


def _trend_answers(spark, sf_dir, parsed):
    """Q8 + Q9: answers for trend-routed questions via one cube pass."""
    t = parsed.filter(F.col("route") == "trend")
    specs = t.select(F.col("question_id").alias("spec_id"),
                     *[F.col(f"f_{k}").alias(f"f_{c}") for k, c in FILTER_DIMS.items()])
    series = trends.spec_year_series(incident_table(spark, sf_dir), specs, list(FILTER_DIMS.values()),
                                     SPEC, CONTAINS_DIMS)
    y = SPEC.year
    ser = series.groupBy("spec_id").agg(
        F.array_sort(F.collect_list(F.struct(y, "injury_count"))).alias("rows"))
    j = t.join(ser, t.question_id == ser.spec_id, "left").drop("spec_id")
    rows = F.coalesce(F.col("rows"), F.array().cast(f"array<struct<{y}:int,injury_count:bigint>>"))
    full = F.filter(rows, lambda r: r[y] != SPEC.partial_year)
    in_a = F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, r: acc + F.when(
        r[y].between(F.col("period_a0"), F.col("period_a1")), r["injury_count"]).otherwise(0))
    in_b = F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, r: acc + F.when(
        r[y].between(F.col("period_b0"), F.col("period_b1")), r["injury_count"]).otherwise(0))
    hit = F.filter(full, lambda r: r[y] == F.col("target_year"))
    last5 = F.slice(full, F.greatest(F.size(full) - 4, F.lit(1)), 5)
    answer = (F.when(F.col("period_a0").isNotNull(), questions.format_period_answer(
        F.format_string("%d-%d", "period_a0", "period_a1"), in_a,
        F.format_string("%d-%d", "period_b0", "period_b1"), in_b))
        .when(F.size(hit) > 0, questions.format_count_answer(hit[0]["injury_count"],
                                                             F.col("target_year")))
        .otherwise(F.concat(F.lit(NO_COUNT_ANSWER[0]),
                            F.coalesce(F.col("target_year").cast("string"), F.lit("None")),
                            F.lit(NO_COUNT_ANSWER[1]), F.to_json(last5))))
    return j.select("question_id", answer.alias("answer"))


#: Each question is also asked for a year without records, for the partial
#: year (which counts exclude), and without a year.
YEAR_VARIANTS = {"-absent": "in 2099", "-partial": f"in {SPEC.partial_year}", "-none": "at any time"}


def answer_trends_bulk(spark: SparkSession, sf_dir: str):
    """Q8 + Q9: answers to the bank's trend questions and their year variants."""
    b = question_bank(spark, sf_dir).select("question_id", "question", "category")
    asked = F.array(F.struct("question_id", "question"), *[
        F.struct(F.concat("question_id", F.lit(tag)).alias("question_id"),
                 F.regexp_replace("question", r"in \d{4}", text).alias("question")) for tag, text in YEAR_VARIANTS.items()])
    b = b.select("category", F.explode(asked).alias("x")).select("x.question_id", "x.question", "category")
    parsed = questions.parse_questions(b, trend_rules=DRIVER_TREND_RULES)
    return _trend_answers(spark, sf_dir, parsed)


TOOL_GROUP_COLUMN = "state"
TOOL_TOP_N = 5


def tool_request_table(spark: SparkSession, sf_dir: str):
    """Q13 input: the agent's ``analyze_trends`` calls (request_id, tool,
    args JSON) for every trend question - a period comparison and a group
    breakdown for period questions; counts by year, year-over-year change
    and a group breakdown for the others."""
    b = question_bank(spark, sf_dir).select("question_id", "question", "category")
    p = questions.parse_questions(b, trend_rules=DRIVER_TREND_RULES).filter(F.col("route") == "trend")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"f_{k}").alias("value"))
                        for k in FILTER_DIMS])
    filters = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    types = F.when(F.col("period_a0").isNotNull(),
                   F.array(F.lit("compare_periods"), F.lit("count_by_group"))) \
             .otherwise(F.array(F.lit("count_by_year"), F.lit("year_over_year_change"),
                                F.lit("count_by_group")))
    x = p.select("question_id", filters.alias("filters"), "period_a0", "period_a1", "period_b0",
                 "period_b1", F.explode(types).alias("qt"))
    args = F.to_json(F.struct(F.col("qt").alias("query_type"), "filters",
                              F.lit(TOOL_GROUP_COLUMN).alias("group_column"),
                              F.lit(TOOL_TOP_N).alias("top_n"),
                              F.col("period_a0").alias("period_a_start"),
                              F.col("period_a1").alias("period_a_end"),
                              F.col("period_b0").alias("period_b_start"),
                              F.col("period_b1").alias("period_b_end")))
    return x.select(F.concat_ws(":", "question_id", "qt").alias("request_id"),
                    F.lit(trends.TOOL_NAME).alias("tool"), args.alias("args"))


def tool_requests(spark: SparkSession, sf_dir: str):
    """Q13 + T5 + T6: execute the trend tool requests in bulk."""
    keys = {k: c for k, c in FILTER_DIMS.items()}
    return trends.execute_trend_requests(incident_table(spark, sf_dir), tool_request_table(spark, sf_dir),
                                         keys, SPEC, CONTAINS_DIMS)


def _hits(spark, sf_dir, parsed, index):
    docs = table(spark, sf_dir, "documents")
    q = parsed.select(F.col("question_id").alias("qid"), F.col("retrieval_query").alias("query"))
    hits = retrieval.lexical_search(index, q, k=5)
    return retrieval.hits_as_structs(hits, docs, "qid", "doc_id", "text")


def _classifier_answers(spark, sf_dir, bank_df):
    f = questions.question_fields(bank_df.select("question_id", "question"))
    req = f.select("question_id", "field_source",
                   *[F.col(src).alias(dst) for dst, src in SERVE_MAP.items()])
    from quarrylens.plans.model_queries import holdout_model

    model = holdout_model(spark, sf_dir)
    pred = severity.predict(model, req, keep=["question_id", "field_source"])
    return pred.select("question_id", questions.format_classifier_answer(
        F.col("field_source"), F.col("predicted_code")).alias("answer"))


def build_run_table(spark: SparkSession, sf_dir: str):
    """Q10 + Q11: three offline systems x every question, one union. Each
    part (classifier, search, trends) answers in one stored, timed job."""
    from quarrylens.plans.model_queries import documents_index, holdout_model

    index = documents_index(spark, sf_dir)
    holdout_model(spark, sf_dir)  # stored before the clock runs, as is the index
    b = question_bank(spark, sf_dir, index).select("question_id", "question", "category")
    parsed = questions.parse_questions(b, trend_rules=DRIVER_TREND_RULES)

    def searched():
        hits = _hits(spark, sf_dir, parsed, index)
        all_ = parsed.select("question_id").join(hits, F.col("question_id") == F.col("qid"), "left")
        none = F.array().cast(hits.schema["hits"].dataType)
        return all_.select("question_id", questions.format_agent_case_answer(F.coalesce("hits", none)).alias("case_answer"),
                           questions.format_retrieval_answer(F.col("hits")).alias("search_answer"))

    made = new_version(artifact_path(spark, "runs", "parts", sf_dir=sf_dir))
    parts = {
        "classification": runs.run_part(b, lambda: _classifier_answers(spark, sf_dir, b).withColumnRenamed(
            "answer", "class_answer"), ("class_answer",), f"{made}/classification"),
        "search": runs.run_part(b, searched, ("case_answer", "search_answer"), f"{made}/search"),
        "trend": runs.run_part(parsed.where("route = 'trend'"), lambda: _trend_answers(spark, sf_dir, parsed).withColumnRenamed(
            "answer", "trend_answer"), ("trend_answer",), f"{made}/trend"),
    }
    answered = runs.with_parts(parsed.select("question_id", "category", "question", "route"), parts)
    route = F.col("route")
    agent = (F.when(route == "classification", F.col("class_answer")).when(route == "case", F.col("case_answer"))
             .when(route == "trend", F.col("trend_answer")).otherwise(F.lit(questions.UNROUTABLE_ANSWER)))
    part = F.when(route == "case", F.lit("search")).when(route.isin("classification", "trend"), route)
    a = runs.run_rows(answered, SYSTEMS[0], agent, questions.tools_for(route), part, parts)
    c = runs.run_rows(answered, SYSTEMS[1], F.col("class_answer"), F.array(F.lit(TOOL_CLASSIFY)), "classification", parts)
    r = runs.run_rows(answered, SYSTEMS[2], F.col("search_answer"), F.array(F.lit(TOOL_SEARCH)), "search", parts)
    return a.unionByName(c).unionByName(r)


RUN_TABLES = BANK_TABLES


def run_table(spark: SparkSession, sf_dir: str):
    """S7 + Q11: the run table, built once per input version and stored
    (the original wrote its run rows to JSONL and scored from the file)."""
    from quarrylens.plans.artifacts import data_version

    return table_or_build(spark, "run_table", lambda: build_run_table(spark, sf_dir),
                          sf_dir=sf_dir, data=data_version(spark, sf_dir, RUN_TABLES))


def _scored(spark, sf_dir):
    """Stored runs joined to their references (J6) and scored; a run whose
    question has no reference is kept and scored false."""
    made = run_table(spark, sf_dir)
    b = question_bank(spark, sf_dir).drop("category", "question")
    scored = evaluation.score_rows(made.join(b, "question_id", "left"))
    return scored


def bank_category_counts(spark: SparkSession, sf_dir: str):
    """Questions per category of the stored bank."""
    return bank.category_counts(question_bank(spark, sf_dir))


def answer_baselines(spark: SparkSession, sf_dir: str):
    """Q10: the answers of the two baselines (classifier, retrieval only)."""
    return run_table(spark, sf_dir).where(F.col("system") != SYSTEMS[0]).select(
        "question_id", "system", "answer", F.array_join("tools_used", ",").alias("tools_used"))


def score_rows_q(spark: SparkSession, sf_dir: str):
    return _scored(spark, sf_dir).select("question_id", "system", "correct", "reason")


def accuracy_sets_q(spark: SparkSession, sf_dir: str):
    return evaluation.accuracy_sets(_scored(spark, sf_dir))


def failure_table_q(spark: SparkSession, sf_dir: str):
    return evaluation.failure_table(_scored(spark, sf_dir))


def significance_runs(spark: SparkSession, sf_dir: str):
    return evaluation.all_comparisons(_scored(spark, sf_dir), SYSTEMS[0], SYSTEMS[1:])


QUERIES = {
    "question_bank": question_bank_view,
    "question_fields": question_fields_q,
    "question_filters": question_filters_q,
    "question_route": question_route_q,
    "answer_trends_bulk": answer_trends_bulk,
    "tool_requests": tool_requests,
    "run_table": run_table,
    "bank_category_counts": bank_category_counts,
    "answer_baselines": answer_baselines,
    "score_rows": score_rows_q,
    "accuracy_sets": accuracy_sets_q,
    "failure_table": failure_table_q,
    "significance_runs": significance_runs,
}

ORACLE: dict = {}


# --------------------------------------------------------------------------
# DuckDB oracle SQL
# --------------------------------------------------------------------------
def _oracle_sql() -> dict:
    from quarrylens.plans.bindings import INCIDENTS_SQL
    from quarrylens.plans.sqlgen import canon

    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    def lex(qsrc: str, p: str) -> str:
        """Lexical top-k CTEs over ``qsrc(qid, query)``; names prefixed by p."""
        return rf"""
{p}dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term
          FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
{p}dtf AS (SELECT doc_id, term, count(*) AS tf FROM {p}dt GROUP BY ALL),
{p}nd AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
{p}idf AS (SELECT term, ln((SELECT n FROM {p}nd) / count(*)) AS idf FROM {p}dtf GROUP BY term),
{p}dw AS (SELECT doc_id, term, tf * idf AS w FROM {p}dtf JOIN {p}idf USING (term)),
{p}dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dnorm FROM {p}dw GROUP BY doc_id),
{p}qt AS (SELECT qid, unnest(regexp_extract_all(lower(query), '\w+')) AS term FROM {qsrc}),
{p}qtf AS (SELECT qid, term, count(*) AS tf FROM {p}qt GROUP BY ALL),
{p}qw AS (SELECT qid, term, tf * idf AS qw FROM {p}qtf JOIN {p}idf USING (term)),
{p}qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM {p}qw GROUP BY qid),
{p}dots AS (SELECT qid, doc_id, sum(qw * w) AS dot FROM {p}qw JOIN {p}dw USING (term) GROUP BY ALL),
{p}sc AS (SELECT qid, doc_id, dot / (qnorm * dnorm) AS score FROM {p}dots JOIN {p}qn USING (qid)
          JOIN {p}dn USING (doc_id) WHERE qnorm > 0 AND dnorm > 0),
{p}r AS (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid
          ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}sc)"""

    body = ", ".join(f"'{k}=' || CAST({c} AS VARCHAR)" for k, c in FIELD_MAP)
    dims = list(FILTER_DIMS.values())
    spec_rows = []
    for s, q, y, f in _all_count_specs():
        spec_rows.append((s, q, y, None, None, None, None, f))
    for s, q, a, b, f in PERIOD_SPECS:
        spec_rows.append((s, q, None, a[0], a[1], b[0], b[1], f))
    values = ",\n  ".join(
        "(" + ", ".join([lit(s), lit(q), "NULL" if y is None else str(y)] +
                        ["NULL" if v is None else str(v) for v in (a0, a1, b0, b1)] +
                        [lit(f.get(k)) for k in FILTER_DIMS]) + ")"
        for s, q, y, a0, a1, b0, b1, f in spec_rows)
    fcols = ", ".join(f"f_{c}" for c in dims)
    match = " AND ".join(
        f"(s.f_{c} IS NULL OR {canon('i.' + c)} = {canon('s.f_' + c)})" if c == SPEC.target else
        f"(s.f_{c} IS NULL OR contains(lower(i.{c}), lower(s.f_{c})))" if c in CONTAINS_DIMS else
        f"(s.f_{c} IS NULL OR lower(i.{c}) = lower(s.f_{c}))" for c in dims)
    bank_sql = "WITH " + INCIDENTS_SQL + f""",
cls0 AS (SELECT *, md5(DOCUMENT_NO || '|42') AS h FROM incidents ORDER BY h, DOCUMENT_NO LIMIT 20),
cls AS (SELECT printf('CLS-%02d', row_number() OVER (ORDER BY h, DOCUMENT_NO)) AS question_id,
          'classification' AS category,
          'Predict injury degree for: ' || concat_ws(', ', {body}) || '.' AS question,
          'degree_code' AS ref_type, {canon('DEGREE_INJURY_CD')} AS ref_value,
          DOCUMENT_NO AS ref_document_no, CAST(NULL AS INTEGER) AS ref_year,
          CAST(NULL AS VARCHAR) AS ref_period_a, CAST(NULL AS VARCHAR) AS ref_period_b,
          CAST(NULL AS VARCHAR) AS ref_counts, CAST(NULL AS VARCHAR) AS ref_documents,
          CAST(NULL AS VARCHAR) AS ref_must_include FROM cls0),
specs(spec_id, question, year, a0, a1, b0, b1, {fcols}) AS (VALUES
  {values}),
ser AS (SELECT s.spec_id, i.{SPEC.year} AS yr, count(*) AS n FROM specs s JOIN incidents i ON {match}
        WHERE i.{SPEC.year} IS NOT NULL GROUP BY ALL),
cnt AS (SELECT s.spec_id AS question_id, 'trend' AS category, s.question, 'count' AS ref_type,
          CAST(coalesce(r.n, 0) AS VARCHAR) AS ref_value, CAST(NULL AS VARCHAR) AS ref_document_no,
          s.year AS ref_year, CAST(NULL AS VARCHAR) AS ref_period_a, CAST(NULL AS VARCHAR) AS ref_period_b,
          CAST(NULL AS VARCHAR) AS ref_counts, CAST(NULL AS VARCHAR) AS ref_documents,
          CAST(NULL AS VARCHAR) AS ref_must_include
        FROM specs s LEFT JOIN ser r ON r.spec_id = s.spec_id AND r.yr = s.year
          AND r.yr <> {SPEC.partial_year}
        WHERE s.year IS NOT NULL),
per AS (SELECT s.spec_id AS question_id, 'trend' AS category, s.question, 'period_compare' AS ref_type,
          CAST(NULL AS VARCHAR) AS ref_value, CAST(NULL AS VARCHAR) AS ref_document_no,
          CAST(NULL AS INTEGER) AS ref_year, s.a0 || '-' || s.a1 AS ref_period_a,
          s.b0 || '-' || s.b1 AS ref_period_b,
          CAST(coalesce(sum(CASE WHEN r.yr BETWEEN s.a0 AND s.a1 THEN r.n ELSE 0 END), 0) AS VARCHAR)
          || ',' ||
          CAST(coalesce(sum(CASE WHEN r.yr BETWEEN s.b0 AND s.b1 THEN r.n ELSE 0 END), 0) AS VARCHAR)
          AS ref_counts,
          CAST(NULL AS VARCHAR) AS ref_documents, CAST(NULL AS VARCHAR) AS ref_must_include
        FROM specs s LEFT JOIN ser r ON r.spec_id = s.spec_id WHERE s.year IS NULL
        GROUP BY s.spec_id, s.question, s.a0, s.a1, s.b0, s.b1),
ca AS (SELECT item_id, text FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR) || '|42'), item_id
       LIMIT 10),
cb AS (SELECT doc_id, text FROM documents WHERE length(text) > 80
       ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id LIMIT 10),
cq AS (SELECT printf('CASE-%02d', row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR) || '|42'), item_id))
              AS qid, 'Find historical incidents similar to: ' || text AS question, text AS query,
              CAST(NULL AS VARCHAR) AS must_include FROM ca
       UNION ALL
       SELECT printf('CASE-%02d', 10 + row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id)),
              'Find incidents similar to this narrative snippet: ' || substring(text, 1, 80),
              substring(text, 1, 80), CAST(doc_id AS VARCHAR) FROM cb),
{lex('cq', 'x_')},
cs AS (SELECT cq.qid AS question_id, 'case_grounded' AS category, cq.question, 'document_set' AS ref_type,
         CAST(NULL AS VARCHAR) AS ref_value, CAST(NULL AS VARCHAR) AS ref_document_no,
         CAST(NULL AS INTEGER) AS ref_year, CAST(NULL AS VARCHAR) AS ref_period_a,
         CAST(NULL AS VARCHAR) AS ref_period_b, CAST(NULL AS VARCHAR) AS ref_counts,
         coalesce(string_agg(CAST(r.doc_id AS VARCHAR), ',' ORDER BY r.rank), '') AS ref_documents,
         cq.must_include AS ref_must_include
       FROM cq LEFT JOIN x_r r ON r.qid = cq.qid AND r.rank <= 5
       GROUP BY cq.qid, cq.question, cq.must_include),
bank AS (SELECT * FROM cls UNION ALL SELECT * FROM cnt UNION ALL SELECT * FROM per
         UNION ALL SELECT * FROM cs)"""

    fields = ",\n  ".join(
        f"CASE WHEN regexp_extract(lower(question), '{k}\\s*[=:]\\s*(\\w+)', 1) = '' THEN NULL "
        f"ELSE upper(regexp_extract(lower(question), '{k}\\s*[=:]\\s*(\\w+)', 1)) END AS x_{c}"
        for k, c in questions.FIELD_KEYS)
    rules = questions.REFERENCE_DEFAULT_RULES
    base = dict(rules.base)

    def dflt(c):
        expr = f"'{base.get(c, 'UNK')}'"
        for subs, col, val in rules.cues:
            if col == c:
                cond = " OR ".join(f"contains(lower(question), '{s}')" for s in subs)
                expr = f"CASE WHEN {cond} THEN '{val}' ELSE {expr} END"
        if c == "SUBUNIT_CD":
            expr = (f"CASE WHEN regexp_matches(lower(question), '{questions.DEGREE_DEFAULT_REGEX}') "
                    f"OR contains(lower(question), 'fatalit') THEN '{rules.degree_subunit}' ELSE {expr} END")
        return expr
    nfound = " + ".join(f"CAST(x_{c} IS NOT NULL AS INTEGER)" for _, c in questions.FIELD_KEYS)
    final = ",\n  ".join(
        f"CASE WHEN n_found >= 8 THEN coalesce(x_{c}, 'UNK') ELSE coalesce(x_{c}, {dflt(c)}) END AS {c}"
        for _, c in questions.FIELD_KEYS)
    fields_sql = bank_sql + f""",
fx AS (SELECT question_id, question, {fields} FROM bank),
fn AS (SELECT *, {nfound} AS n_found FROM fx)
SELECT question_id, n_found,
  CASE WHEN n_found >= 8 THEN 'structured field codes from question'
       WHEN n_found >= 1 THEN 'partial field codes plus inferred defaults'
       ELSE 'inferred defaults only' END AS field_source,
  {final}
FROM fn"""

    tr = DRIVER_TREND_RULES
    deg = "CAST(NULL AS VARCHAR)"
    for sub, code in reversed(list(tr.degree_cues)):
        deg = f"CASE WHEN contains(lower(question), '{sub}') THEN '{code}' ELSE {deg} END"
    dre = questions.DEGREE_CODE_REGEX
    fparts = [f"CASE WHEN regexp_extract(lower(question), '{dre}', 1) <> '' THEN "
              f"regexp_extract(lower(question), '{dre}', 1) ELSE {deg} END AS f_degree_code"]
    for key in tr.keys:
        v = "CAST(NULL AS VARCHAR)"
        for sub, k, val in tr.cues:
            if k == key:
                v = f"CASE WHEN contains(lower(question), '{sub}') THEN '{val}' ELSE {v} END"
        fparts.append(f"{v} AS f_{key}")
    pre = questions.PERIOD_REGEX
    yre = questions.YEAR_REGEX

    def grp(i, name):
        e = f"regexp_extract(question, '{pre}', {i})"
        return f"CAST(CASE WHEN {e} = '' THEN NULL ELSE {e} END AS INTEGER) AS {name}"
    ye = f"regexp_extract(question, '{yre}', 1)"
    parsed_cols = ",\n  ".join(fparts + [grp(1, "period_a0"), grp(2, "period_a1"), grp(3, "period_b0"),
                                          grp(4, "period_b1"),
                                          f"CAST(CASE WHEN {ye} = '' THEN NULL ELSE {ye} END AS INTEGER) "
                                          "AS target_year"])
    filters_sql = bank_sql + f"\nSELECT question_id, {parsed_cols} FROM bank"

    def route(cat):
        c = f"coalesce({cat}, '')"
        return (f"CASE WHEN {c} = 'classification' OR contains(lower(question), 'subunit_cd=') "
                f"THEN 'classification' WHEN {c} = 'case_grounded' OR contains(lower(question), "
                f"'similar to') THEN 'case' WHEN {c} = 'trend' OR starts_with(lower(question), "
                f"'how many') OR starts_with(lower(question), 'compare') THEN 'trend' ELSE 'none' END")
    ws = "'^\\s+|\\s+$'"
    ends = ", ".join(f"CASE WHEN instr(lower(question), '{m}') > 0 THEN instr(lower(question), '{m}') + {len(m)} ELSE 1 END"
                     for m in questions.RETRIEVAL_MARKERS)
    rq = f"regexp_replace(substring(question, greatest({ends})), {ws}, '', 'g')"
    route_sql = bank_sql + f"""
SELECT question_id, {route('category')} AS route, {rq} AS retrieval_query,
       {route("CAST(NULL AS VARCHAR)")} AS route_blind FROM bank"""

    pmatch = " AND ".join(
        f"(p.f_{k} IS NULL OR {canon('i.' + c)} = {canon('p.f_' + k)})" if c == SPEC.target else
        f"(p.f_{k} IS NULL OR contains(lower(i.{c}), lower(p.f_{k})))" if c in CONTAINS_DIMS else
        f"(p.f_{k} IS NULL OR lower(i.{c}) = lower(p.f_{k}))" for k, c in FILTER_DIMS.items())
    variants = " UNION ALL ".join(
        f"SELECT question_id || '{tag}', category, regexp_replace(question, 'in \\d{{4}}', '{text}') FROM bank"
        for tag, text in YEAR_VARIANTS.items())
    answers_sql = bank_sql + f""",
asked AS (SELECT question_id, category, question FROM bank UNION ALL {variants}),
p AS (SELECT question_id, {route('category')} AS route, {parsed_cols} FROM asked),
t AS (SELECT * FROM p WHERE route = 'trend'),
s AS (SELECT p.question_id, i.{SPEC.year} AS yr, count(*) AS n FROM t p JOIN incidents i ON {pmatch}
      WHERE i.{SPEC.year} IS NOT NULL GROUP BY ALL),
a AS (SELECT t.question_id, t.period_a0, t.period_a1, t.period_b0, t.period_b1, t.target_year,
        sum(CASE WHEN s.yr BETWEEN t.period_a0 AND t.period_a1 THEN s.n ELSE 0 END) AS na,
        sum(CASE WHEN s.yr BETWEEN t.period_b0 AND t.period_b1 THEN s.n ELSE 0 END) AS nb,
        max(CASE WHEN s.yr = t.target_year AND s.yr <> {SPEC.partial_year} THEN s.n END) AS hit
      FROM t LEFT JOIN s USING (question_id) GROUP BY ALL),
l5 AS (SELECT question_id, '[' || string_agg('{{"{SPEC.year}":' || yr || ',"injury_count":' || n || '}}', ',' ORDER BY yr) || ']' AS j
       FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY yr DESC) AS r FROM s WHERE yr <> {SPEC.partial_year})
       WHERE r <= 5 GROUP BY question_id)
SELECT question_id, CASE
  WHEN period_a0 IS NOT NULL THEN 'Period ' || period_a0 || '-' || period_a1 || ': ' || coalesce(na, 0)
       || ' injuries' || chr(10) || 'Period ' || period_b0 || '-' || period_b1 || ': ' || coalesce(nb, 0)
       || ' injuries'
  WHEN hit IS NOT NULL THEN 'There were ' || hit || ' matching injuries in ' || target_year || '.'
  ELSE 'No count found for year ' || coalesce(CAST(target_year AS VARCHAR), 'None') || '. Tool rows: '
       || coalesce(j, '[]') END AS answer
FROM a LEFT JOIN l5 USING (question_id)"""

    req = bank_sql + f""",
tp0 AS (SELECT question_id, {route('category')} AS route, {parsed_cols} FROM bank),
tt AS (SELECT * FROM tp0 WHERE route = 'trend'),
p AS (SELECT question_id || ':' || u.qt AS request_id, u.qt, t.*
      FROM tt AS t, unnest(CASE WHEN t.period_a0 IS NOT NULL THEN ['compare_periods', 'count_by_group']
                     ELSE ['count_by_year', 'year_over_year_change', 'count_by_group'] END) AS u(qt)),
tm AS (SELECT p.request_id, p.qt, i.{SPEC.year} AS yr, i.STATE AS grp FROM p JOIN incidents i ON {pmatch}),
tser AS (SELECT request_id, qt, yr, count(*) AS n FROM tm
        WHERE qt IN ('count_by_year', 'year_over_year_change') AND yr IS NOT NULL AND yr <> {SPEC.partial_year}
        GROUP BY ALL),
tlag AS (SELECT *, lag(n) OVER (PARTITION BY request_id ORDER BY yr) AS prev FROM tser),
tper AS (SELECT p.request_id, x.lo, x.hi FROM p,
        (SELECT 1) d, unnest([{{'lo': p.period_a0, 'hi': p.period_a1}}, {{'lo': p.period_b0, 'hi': p.period_b1}}]) AS u(x)
        WHERE p.qt = 'compare_periods'),
tpc AS (SELECT tper.request_id, tper.lo, tper.hi, count(tm.yr) AS n FROM tper
       LEFT JOIN tm ON tm.request_id = tper.request_id AND tm.yr BETWEEN tper.lo AND tper.hi GROUP BY ALL),
tg AS (SELECT request_id, grp, count(*) AS n FROM tm WHERE qt = 'count_by_group' AND grp IS NOT NULL GROUP BY ALL),
tgr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, grp) AS r FROM tg)
SELECT request_id, 'count_by_year' AS query_type, CAST(yr AS VARCHAR) AS key, n, CAST(NULL AS BIGINT) AS change,
       CAST(NULL AS DOUBLE) AS pct, CAST(NULL AS VARCHAR) AS error FROM tlag WHERE qt = 'count_by_year'
UNION ALL
SELECT request_id, 'year_over_year_change', CAST(yr AS VARCHAR), n, n - prev, round((n - prev) / prev * 100, 2),
       NULL FROM tlag WHERE qt = 'year_over_year_change' AND prev IS NOT NULL
UNION ALL
SELECT request_id, 'compare_periods', lo || '-' || hi, n, NULL, NULL, NULL FROM tpc
UNION ALL
SELECT request_id, 'count_by_group', grp, n, NULL, NULL, NULL FROM tgr WHERE r <= {TOOL_TOP_N}"""

    view = bank_sql + """
SELECT question_id, category, question, ref_type, ref_value, ref_document_no, ref_year, ref_period_a,
       ref_period_b, ref_counts, ref_documents, ref_must_include FROM bank"""
    return {"question_bank": view, "question_fields": fields_sql, "question_filters": filters_sql,
            "question_route": route_sql, "answer_trends_bulk": answers_sql, "tool_requests": req,
            "bank_category_counts": f"SELECT category, count(*) AS n FROM ({view}) GROUP BY category"}


ORACLE = _oracle_sql()
