"""Q11: run rows with latency, and failures as error rows."""

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import evaluation, runs
from quarrylens.spec import SYSTEMS

ASKED = [("q1", "x", "how many"), ("q2", "x", "where"), ("q3", "y", " "), ("q4", "y", "which")]


def _asked(spark):
    return spark.createDataFrame(ASKED, "question_id string, category string, question string")


def test_missing_answers_and_failed_jobs_become_error_rows(spark, tmp_path):
    asked = _asked(spark)
    good = runs.run_part(asked, lambda: asked.where("question_id <> 'q2'").select("question_id", F.upper("question").alias("a")), ("a",), f"{tmp_path}/a")
    bad = runs.run_part(asked, lambda: asked.select("question_id", F.col("question").cast("int").cast("string").alias("b")), ("b",), f"{tmp_path}/b")
    lost = runs.run_part(asked, lambda: asked.select("question_id", F.col("no_such_column").alias("c")), ("c",), f"{tmp_path}/c")
    assert good.error is None and good.seconds > 0 and bad.rows.count() == 0
    assert "CAST_INVALID_INPUT" in bad.error and "no_such_column" in lost.error
    parts = {"good": good, "bad": bad, "lost": lost}
    tools = F.array(F.lit("tool"))
    answered = runs.with_parts(asked, parts)
    got = {r["question_id"]: r for r in runs.run_rows(answered, "s", F.col("a"), tools, "good", parts).collect()}
    assert {q: (r["answer"], r["tools_used"], r["error"]) for q, r in got.items()} == {
        "q1": ("HOW MANY", ["tool"], None), "q2": ("", [], "No answer: good"), "q3": ("", [], "Empty question"), "q4": ("WHICH", ["tool"], None)}
    assert all(r["latency_s"] == round(good.seconds, 6) for r in got.values())
    rows = runs.run_rows(answered, "s", F.col("b"), tools, "bad", parts).collect()
    assert len(rows) == 4 and all(r["error"] == bad.error and r["answer"] == "" and r["tools_used"] == [] for r in rows)
    # a question without a part is answered at no cost
    routed = F.when(F.col("question_id") != "q4", F.lit("good"))
    free = runs.run_rows(answered, "s", F.coalesce("a", F.lit("none")), tools, routed, parts).where("question_id = 'q4'").first()
    assert (free["answer"], free["latency_s"], free["error"]) == ("WHICH", 0.0, None)
    # errors reach the failure table and the mean latency the accuracy table
    null = F.lit(None).cast("string")
    table = runs.run_rows(answered, SYSTEMS[1], F.col("a"), tools, "good", parts).select(
        "*", F.lit("document_set").alias("ref_type"), null.alias("ref_value"), F.lit(None).cast("array<long>").alias("ref_counts"),
        null.alias("ref_must_include"), F.array(F.lit("WHICH"), F.lit("MANY")).alias("ref_documents"), tools.alias("expected_tools"))
    scored = evaluation.score_rows(table)
    assert {(r["question_id"], r["error"]) for r in evaluation.failure_table(scored).collect()} == {("q2", "No answer: good"), ("q3", "Empty question")}
    whole = evaluation.accuracy_sets(scored).where("category = 'overall'").first()
    assert whole["mean_latency_s"] == pytest.approx(good.seconds, abs=1e-3) and whole["accuracy"] == 0.5


def test_storage_errors_rise(spark, tmp_path):
    asked = _asked(spark)
    (tmp_path / "taken").write_text("a file, no folder")
    with pytest.raises(Exception):  # noqa: B017 - whatever the file system raises
        runs.run_part(asked, lambda: asked.select("question_id", F.col("question").alias("a")), ("a",), f"{tmp_path}/taken/below")


def test_empty_question_table(spark, tmp_path):
    none = _asked(spark).limit(0)
    part = runs.run_part(none, lambda: none.select("question_id", F.col("question").alias("a")), ("a",), f"{tmp_path}/none")
    assert part.error is None and runs.run_rows(runs.with_parts(none, {"p": part}), "s", F.col("a"), F.array(F.lit("t")), "p", {"p": part}).count() == 0
