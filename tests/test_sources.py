"""Scan/sink round trips (S1, S3-S7, S10-S12) in a fresh temp folder."""

import json
import os

from pyspark.sql import functions as F

from quarrylens.sources import io
from quarrylens.spec import ESS_ITEMS


def test_raw_scan_latin1_pipe(spark, tmp_path):
    p = tmp_path / "raw.txt"
    p.write_bytes('DOCUMENT_NO|MINE_ID|NARRATIVE\n 1 |"m1"|caf\xe9 roof\n2|N/A|"a|b"\n'.encode("latin-1"))
    df = io.read_raw(spark, str(p))
    assert df.schema.simpleString() == "struct<DOCUMENT_NO:string,MINE_ID:string,NARRATIVE:string>"
    got = [tuple(r) for r in df.orderBy("DOCUMENT_NO").collect()]
    assert got == [("1", "m1", "café roof"), ("2", None, "a|b")]


def test_processed_round_trip_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("1", 2010), ("2", 2011)], "DOCUMENT_NO string, CAL_YR int")
    io.write_processed(df, str(tmp_path / "clean"))
    assert sorted(d for d in os.listdir(tmp_path / "clean") if d.startswith("CAL_YR=")) == \
        ["CAL_YR=2010", "CAL_YR=2011"]
    back = io.read_processed(spark, str(tmp_path / "clean")).filter(F.col("CAL_YR") == 2011)
    assert [r[0] for r in back.collect()] == ["2"]


def test_report_and_question_bank(spark, tmp_path):
    io.write_report(spark.createDataFrame([("a", 1)], "k string, v long"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 1
    bank = {"version": 1, "total_questions": 2, "category_counts": {"trend": 1, "classification": 1},
            "notes": [], "questions": [
                {"id": "TRD-01", "category": "trend", "question": "How many?",
                 "expected_tools": ["analyze_trends"],
                 "reference": {"type": "count", "value": 29, "year": 2020, "filters": {"degree_code": "01"}}},
                {"id": "CLS-01", "category": "classification", "question": "Predict",
                 "expected_tools": ["classify_injury_risk"],
                 "reference": {"type": "degree_code", "value": "07", "document_no": "D1"}}]}
    (tmp_path / "q.json").write_text(json.dumps(bank, indent=2))
    q = {r["question_id"]: r for r in io.read_question_bank(spark, str(tmp_path / "q.json")).collect()}
    assert q["TRD-01"]["ref_value"] == "29" and q["TRD-01"]["ref_year"] == 2020
    assert q["CLS-01"]["ref_value"] == "07" and q["CLS-01"]["ref_document_no"] == "D1"


def test_run_append_resume(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert io.read_runs(spark, path).count() == 0
    first = spark.createDataFrame([("q1", "agent", "a1")], "question_id string, system string, answer string")
    io.append_runs(first, path)
    io.append_runs(spark.createDataFrame([("q2", "agent", "a2")], first.schema), path)
    back = io.read_runs(spark, path)
    assert sorted(r[0] for r in back.select("question_id").collect()) == ["q1", "q2"]


def test_responses_csv_and_grouped_sink(spark, tmp_path):
    cols = io.RESPONSE_COLUMNS
    rows = [dict({c: "" for c in cols}, participant_id=p, stimulus_id="S001", **{i: "3" for i in ESS_ITEMS})
            for p in ("P1", "P2")]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows],
                               ", ".join(f"`{c}` string" for c in cols))
    io.write_grouped_csv(df, str(tmp_path / "sheets"), "participant_id")
    parts = sorted(d for d in os.listdir(tmp_path / "sheets") if d.startswith("participant_id="))
    assert parts == ["participant_id=P1", "participant_id=P2"]
    io.write_grouped_csv(df, str(tmp_path / "flat"), "stimulus_id")
    files = [str(tmp_path / "flat" / "stimulus_id=S001")]
    back = spark.read.option("header", True).csv(files)
    assert back.count() == 2


def test_model_save_load(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from quarrylens.operators import severity
    from quarrylens.spec import ACCIDENT_SPEC

    feats = list(ACCIDENT_SPEC.features)
    rows = [tuple(s if c == "SUBUNIT_CD" else "X" for c in feats) + (d,)
            for s, d in (("01", "01"), ("02", "06"), ("01", "01"), ("02", "06"))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in feats) + ", DEGREE_INJURY_CD string")
    m = severity.fit(df, ACCIDENT_SPEC, num_trees=3, seed=1)
    m.write().overwrite().save(str(tmp_path / "model"))
    m2 = PipelineModel.load(str(tmp_path / "model"))
    a = sorted(r["predicted_code"] for r in severity.predict(m, df).collect())
    b = sorted(r["predicted_code"] for r in severity.predict(m2, df).collect())
    assert a == b


def test_run_events_and_usage(spark, tmp_path):
    from quarrylens.operators import evaluation

    lines = [
        {"run_id": "r1", "system": "agent", "event_type": "question", "elapsed_s": 0.0, "question": "q"},
        {"run_id": "r1", "system": "agent", "event_type": "tool_call", "elapsed_s": 1.0, "tool_name": "t",
         "usage": {"prompt_tokens": 10, "completion_tokens": 2, "total_tokens": 12}},
        {"run_id": "r1", "system": "agent", "event_type": "final_answer", "elapsed_s": 2.5, "answer": "42",
         "usage": {"prompt_tokens": 5, "completion_tokens": 3, "total_tokens": 8}},
    ]
    (tmp_path / "ev.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    ev = io.read_run_events(spark, str(tmp_path / "ev.jsonl"))
    u = evaluation.usage_by_run(ev).collect()[0]
    assert (u["events"], u["tool_calls"], u["total_tokens"], u["duration_s"], u["final_answer"]) == \
        (3, 1, 20, 2.5, "42")


def test_index_round_trip(spark, tmp_path):
    from quarrylens.operators import retrieval

    docs = spark.createDataFrame([("d1", "roof fall rock"), ("d2", "cable shock"), ("d3", "truck rib")],
                                 "doc_id string, text string")
    idx = retrieval.lexical_index(docs)
    retrieval.write_index(idx, str(tmp_path / "idx"))
    back = retrieval.read_index(spark, str(tmp_path / "idx"))
    q = spark.createDataFrame([("q", "rock fall")], "qid string, query string")
    a = retrieval.lexical_search(idx, q, k=2).collect()
    b = retrieval.lexical_search(back, q, k=2).collect()
    assert a == b and a[0]["doc_id"] == "d1"


def test_read_responses_union(spark, tmp_path):
    cols = io.RESPONSE_COLUMNS
    for n, p in enumerate(("P1", "P2")):
        row = {c: "" for c in cols}
        row.update(participant_id=p, stimulus_id="S001", **{i: "4" for i in ESS_ITEMS})
        (tmp_path / f"r{n}.csv").write_text(",".join(cols) + "\n" + ",".join(row[c] for c in cols) + "\n")
    df = io.read_responses(spark, [str(tmp_path / "r0.csv"), str(tmp_path / "r1.csv")])
    got = sorted((r["participant_id"], r["source_file"].rsplit("/", 1)[-1]) for r in df.collect())
    assert got == [("P1", "r0.csv"), ("P2", "r1.csv")]


def test_malformed_lines_are_rejects_not_nulls(spark, tmp_path):
    from quarrylens.sources import io

    lines = ["A|B|C", '1|"x|y"|ok', "2|only two", "3|too|many|fields", "4|b\x85d|byte", "5||", "6|caf\xe9|fine"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.txt").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "raw" / "two.txt").write_bytes("A|B|C\n7|b|c\n8\n".encode("latin-1"))
    rows, rejects = io.read_raw_checked(spark, str(tmp_path / "raw"), ["A", "B", "C"])
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "x|y", "ok"), ("5", None, None), ("6", "café", "fine"), ("7", "b", "c")]
    got = {(r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in rejects.collect()}
    assert got == {("one.txt", "2|only two", "short"), ("one.txt", "3|too|many|fields", "long"), ("one.txt", "4|b\x85d|byte", "bad_byte"), ("two.txt", "8", "short")}
