"""Tool requests: dispatch, defaults and error rows."""

from quarrylens.operators import retrieval, tools


def test_dispatch_reads_arguments_and_names_errors(spark):
    rows = [("t", "analyze_trends", '{"query_type": "count_by_year"}'), ("s1", "search_narratives", '{"query": "roof fall"}'),
            ("s2", "search_narratives", '{"query": "cable", "top_k": "1"}'), ("s3", "search_narratives", '{"query": "cable", "top_k": 0}'),
            ("s4", "search_narratives", '{"top_k": 2}'), ("s5", "search_narratives", '["roof"]'), ("s6", "search_narratives", '{"query": '),
            ("s7", "search_narratives", None), ("c", "classify_injury_risk", '{"state": "x", "Occupation": 7}'), ("u", "nothing", "{}"), ("n", None, "{}")]
    asked = tools.dispatch(spark.createDataFrame(rows, "request_id string, tool string, args string"))
    assert [r["request_id"] for r in asked["trend"].collect()] == ["t"]
    assert {tuple(r) for r in asked["search"].collect()} == {("s1", "roof fall", 5), ("s2", "cable", 1)}
    assert [(r["request_id"], r["codes"]) for r in asked["classify"].collect()] == [("c", {"STATE": "x", "OCCUPATION": "7"})]
    assert {(r["request_id"], r["error"]) for r in asked["errors"].collect()} == {
        ("s3", "Not a count: top_k=0"), ("s4", "Missing argument: query"), ("s5", "Arguments are not a JSON object"),
        ("s6", "Arguments are not a JSON object"), ("s7", "Arguments are not a JSON object"), ("u", "Unknown tool: nothing"), ("n", "Unknown tool: None")}
    docs = spark.createDataFrame([("d1", "roof fall rock"), ("d2", "cable shock"), ("d3", "cable rib roof")], "doc_id string, text string")
    hits = tools.search_requests(asked["search"], retrieval.lexical_index(docs, persist=False)).collect()
    assert {(r["request_id"], r["rank"], r["document_no"]) for r in hits} == {("s1", 1, "d1"), ("s1", 2, "d3"), ("s2", 1, "d2")}
