"""Tool requests (Q13): one dispatch for the three tools of the agent.

A request is (request_id, tool, args), args a JSON object. Arguments are read
as a VARIANT, so each tool takes its own by path and type; whatever can't be
taken as asked becomes an error row, never a null answer. Requests are executed
in bulk: trends from one cube (``trends.execute_trend_requests``), searches in
one search, classifications in one scoring pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import retrieval, severity, trends
from quarrylens.spec import ACCIDENT_SPEC, SchemaSpec

SEARCH, CLASSIFY = "search_narratives", "classify_injury_risk"
TOOLS = (trends.TOOL_NAME, SEARCH, CLASSIFY)
DEFAULT_TOP_K = 5


def dispatch(requests: DataFrame) -> dict[str, DataFrame]:
    """The requests by tool: ``trend`` as they came, ``search`` (request_id,
    query, top_k), ``classify`` (request_id, codes, a map by upper-case name),
    and ``errors`` (request_id, tool, error) of those that can't be executed."""
    v, tool = F.col("_v"), F.col("tool")
    a = requests.select("request_id", "tool", "args", F.try_parse_json("args").alias("_v"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    top_k = F.try_variant_get(v, "$.top_k", "int")
    asked = F.try_variant_get(v, "$.top_k", "string")
    query = F.try_variant_get(v, "$.query", "string")
    error = (F.when(tool.isNull() | ~tool.isin(*TOOLS), F.concat(F.lit("Unknown tool: "), F.coalesce(tool, F.lit("None"))))
             .when(~is_object, F.lit("Arguments are not a JSON object"))
             .when((tool == SEARCH) & query.isNull(), F.lit("Missing argument: query"))
             .when((tool == SEARCH) & asked.isNotNull() & (top_k.isNull() | (top_k < 1)), F.concat(F.lit("Not a count: top_k="), asked)))
    a = a.withColumn("error", error)
    fine = a.where("error IS NULL")
    codes = F.transform_keys(F.try_variant_get(v, "$", "map<string,string>"), lambda k, _: F.upper(k))
    return {
        "trend": fine.where(tool == trends.TOOL_NAME).select("request_id", "tool", "args"),
        "search": fine.where(tool == SEARCH).select("request_id", query.alias("query"), F.coalesce(top_k, F.lit(DEFAULT_TOP_K)).alias("top_k")),
        "classify": fine.where(tool == CLASSIFY).select("request_id", codes.alias("codes")),
        "errors": a.where("error IS NOT NULL").select("request_id", "tool", "error"),
    }


def search_requests(search: DataFrame, index: retrieval.LexicalIndex) -> DataFrame:
    """(request_id, rank, document_no, score): every request's own ``top_k``.
    One search for all of them, as deep as the greatest; the driver sees that
    one number."""
    deepest = search.agg(F.max("top_k")).first()[0] or DEFAULT_TOP_K
    hits = retrieval.lexical_search(index, search, deepest, "request_id", "query")
    return hits.join(search.select("request_id", "top_k"), "request_id").where("rank <= top_k").select(
        "request_id", "rank", F.col(index.doc_id).cast("string").alias("document_no"), "score")


def classify_requests(classify: DataFrame, model, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """(request_id, predicted_degree_code); codes that a request lacks are
    completed as ``severity.complete_requests`` does."""
    rows = classify.select("request_id", *[F.col("codes").getItem(c).alias(c) for c in spec.features])
    scored = severity.predict_rows(model, severity.complete_requests(rows, spec, keep=["request_id"]), keep=["request_id"])
    return scored.withColumnRenamed("predicted_code", "predicted_degree_code")
