"""Rating study: selection sizes, blinding, sheets, Likert mapping."""

import hashlib
import math
from collections import Counter
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import study
from quarrylens.spec import EMPTY_ANSWER_PLACEHOLDER, ESS_ITEMS, LIKERT_SCALE

SYSTEMS = ["agent", "classifier_baseline", "rag_baseline"]


@pytest.fixture(scope="module")
def runs(spark):
    rows = []
    for cat in ("CLS", "TRD", "CASE"):
        for i in range(1, 5):
            for s in SYSTEMS:
                ans = "" if (cat, i, s) == ("TRD", 1, "agent") else f"{s} answer {cat}-{i}"
                rows.append((f"{cat}-{i:02d}", cat.lower(), f"question {cat}-{i}", s, ans))
    return spark.createDataFrame(rows, "question_id string, category string, question string, "
                                       "system string, answer string")


def test_selection_and_blinding(runs):
    ids = study.select_question_ids(runs, 2, 42)
    per_cat = {r[0]: r[1] for r in ids.groupBy("category").count().collect()}
    assert per_cat == {"CLS": 2, "TRD": 2, "CASE": 2}
    stimuli, key, errors = study.blind(runs, ids, 42)
    assert errors.count() == 0
    assert key.count() == 18
    assert "system" not in stimuli.columns and "system_actual" not in stimuli.columns
    labels = stimuli.groupBy("question_id").agg(F.sort_array(F.collect_list("system_blinded_label")))
    assert all(r[1] == ["A", "B", "C"] for r in labels.collect())
    sids = sorted(r[0] for r in stimuli.select("stimulus_id").collect())
    assert sids == [f"S{i:03d}" for i in range(1, 19)]
    # same seed, same assignment
    _, key2, _ = study.blind(runs, study.select_question_ids(runs, 2, 42), 42)
    assert sorted(key.collect()) == sorted(key2.collect())


def test_blank_answer_placeholder_and_error_rows(spark, runs):
    ids = spark.createDataFrame([("TRD-01", "TRD", 4)], "question_id string, category string, pool long")
    stimuli, _, _ = study.blind(runs, ids, 42)
    texts = {r["answer_text"] for r in stimuli.collect()}
    assert EMPTY_ANSWER_PLACEHOLDER in texts
    short = runs.filter(~((F.col("question_id") == "TRD-01") & (F.col("system") == "agent")))
    _, _, errors = study.blind(short, ids, 42)
    assert [(r[0], r[1]) for r in errors.collect()] == [("TRD-01", 2)]


def test_sheets_and_blocks(spark, runs):
    stimuli, _, _ = study.blind(runs, study.select_question_ids(runs, 2, 42), 42)
    people = spark.createDataFrame([("P1",), ("P2",)], "participant_id string")
    sheets = study.participant_sheets(people, stimuli, 7)
    for p in ("P1", "P2"):
        orders = sorted(r[0] for r in sheets.filter(F.col("participant_id") == p)
                        .select("display_order").collect())
        assert orders == list(range(1, 19))
    blocks = study.question_blocks(sheets)
    assert blocks.count() == 12 and blocks.filter(~F.col("complete")).count() == 0
    # within a question block the labels are consecutive A, B, C
    one = sheets.filter(F.col("participant_id") == "P1").orderBy("display_order").collect()
    assert [r["system_blinded_label"] for r in one[:3]] == ["A", "B", "C"]


def test_likert_and_completeness(spark):
    df = spark.createDataFrame([(LIKERT_SCALE[0],), (LIKERT_SCALE[4],), ("nonsense",), (None,)], "v string")
    assert [r[0] for r in df.select(study.likert_score("v")).collect()] == [1, 5, None, None]
    g = spark.createDataFrame([(0,), (4,), (5,), (-1,)], "i int")
    assert [r[0] for r in g.select(study.grid_score("i")).collect()] == [1, 5, None, None]
    full = {i: "4" for i in ESS_ITEMS}
    part = dict(full, **{"ESS-3": " "})
    resp = spark.createDataFrame([dict(participant_id="P1", stimulus_id="S001", **full),
                                  dict(participant_id="P1", stimulus_id="S002", **part)])
    good, bad = study.completeness(resp)
    assert [r["stimulus_id"] for r in good.collect()] == ["S001"]
    assert good.collect()[0]["ess_mean"] == 4.0
    assert [r["stimulus_id"] for r in bad.collect()] == ["S002"]


def test_strict_completeness_raises(spark):
    full = {i: "3" for i in ESS_ITEMS}
    ok = spark.createDataFrame([dict(participant_id="P1", stimulus_id="S001", **full)])
    assert study.require_complete(ok).collect()[0]["ess_mean"] == 3.0
    bad = spark.createDataFrame([dict(participant_id="P2", stimulus_id="S004", **dict(full, **{"ESS-9": ""}))])
    with pytest.raises(ValueError, match="participant P2 stimulus S004"):
        study.require_complete(bad)


def test_item_registry_keeps_items_of_four_digits(spark):
    items = spark.createDataFrame([("S999 comment", "i1", "comment"), ("S1000 comment", "i2", "comment"), ("no item", "i3", "comment")],
                                  "title string, item_id string, role string")
    assert {r["stimulus_id"]: r["comment_item"] for r in study.item_registry(items).collect()} == {"S999": "i1", "S1000": "i2"}


def test_landed_payloads_of_both_forms(spark):
    import json

    one = lambda v: {"answers": [{"value": v}]}
    payload = {"answers": {
        "q1": {"choiceQuestion": one(LIKERT_SCALE[2])}, "q2": {"textAnswers": one(" fine ")}, "q3": {"choiceQuestion": {"answers": []}},
        "g": {"gridAnswers": {"answers": [{"rowIndex": 0, "columnIndex": 0}, {"rowIndex": 8, "columnIndex": 4}, {"rowIndex": 1, "columnIndex": 7}]}}}}
    df = spark.createDataFrame([("P1", json.dumps(payload)), ("P2", None), ("P3", '{"answers": {}}')], "participant_id string, payload string")
    got = {(r["participant_id"], r["item_id"]): r["value"] for r in study.landed_answers(df).collect()}
    assert got == {("P1", "q1"): LIKERT_SCALE[2], ("P1", "q2"): " fine ", ("P1", "q3"): None,
                   ("P1", "g#0"): LIKERT_SCALE[0], ("P1", "g#8"): LIKERT_SCALE[4], ("P1", "g#1"): None}


def test_incomplete_blocks_are_balanced(spark):
    people = spark.range(7 * 6 * 2).select(F.format_string("P%03d", "id").alias("participant_id"))
    stimuli = spark.range(7).select(F.format_string("S%03d", F.col("id") + 1).alias("stimulus_id"))
    forms = {}
    for r in study.assigned_blocks(people, stimuli, 3, 42).collect():
        forms.setdefault(r["participant_id"], []).append(r["stimulus_id"])
    assert len(forms) == 84 and all(len(set(f)) == 3 for f in forms.values())
    raters = Counter(s for f in forms.values() for s in f)
    pairs = Counter(frozenset((a, b)) for f in forms.values() for a in f for b in f if a < b)
    assert set(raters.values()) == {36} and set(pairs.values()) == {12}  # every stimulus and every pair equally often
    few = study.assigned_blocks(people, stimuli.limit(2), 3, 42)
    assert few.count() == 2 * 84  # no more slots than stimuli
    assert study.assigned_blocks(people, stimuli.limit(0), 3, 42).count() == 0
    assert all(12 // math.gcd(12, s) >= 5 for s in study.block_steps(12, 5))


def test_hashed_rank_is_a_permutation(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    got = {r["k"]: r["rank"] for r in study.hashed_rank(rows, "k", 7).collect()}
    order = sorted(got, key=lambda k: (hashlib.md5(f"{k}|7".encode()).hexdigest(), k))
    assert [got[k] for k in order] == list(range(5000))


def test_every_answered_stimulus_is_rated(spark):
    """flatten_responses against plain Python: every answer lands on the participant's own form."""
    import json

    from quarrylens.plans import study_queries as q

    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").collect()
    stimuli = {r["stimulus_id"] for r in q.blind_stimuli(spark, sf).collect()}
    forms = {(r["participant_id"], r["slot"]): r["stimulus_id"] for r in q.block_assignment(spark, sf).collect()}
    until, last = {}, {}
    for e in events:
        if e["event_type"] == "signup":
            until[e["user_id"]] = max(until.get(e["user_id"], e["ts"]), e["ts"])
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        if e["event_type"] != "signup" and e["user_id"] in until and e["ts"] <= until[e["user_id"]]:
            last[e["user_id"], int(json.loads(e["props"])["k"]) * 20 // 100] = e
    want = {}
    for (user, item), e in last.items():
        stimulus, at, v = forms[f"P{user:04d}", item // 10], item % 10, int(e["value"] // 1) % 11
        if v == 0 and int(stimulus[1:]) % 2 and at < 9:
            continue
        row = want.setdefault((f"P{user:04d}", stimulus), [None] * 9 + [""])
        row[at] = (e["event_type"] if v < 6 else "") if at == 9 else (v - 1) % 5 + 1 if v else None
    got = {(r["participant_id"], r["stimulus_id"]): [*(r[i] for i in ESS_ITEMS), r["comment"]] for r in q.flatten_responses(spark, sf).collect()}
    assert got == want
    complete = {k[1] for k, row in want.items() if None not in row[:9]}
    assert complete == stimuli  # every stimulus has at least one complete row
    summary = {(r["scope"], r["name"]): r["n"] for r in q.rating_summary(spark, sf).collect()}
    n = sum(None not in row[:9] for row in want.values())
    assert summary["rejected", "incomplete"] == len(want) - n and summary["overall", "all"] == n
    assert {s for s, _ in summary} == {"overall", "system", "category", "item", "participants", "rejected"}
