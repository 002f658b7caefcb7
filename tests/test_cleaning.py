"""Golden cleaning table (4 hand-computed rows) plus the added dirty cases."""

from pyspark.sql import functions as F

from quarrylens.functions.text import canonical_code, clean_string, invalid_code
from quarrylens.operators import cleaning, joins
from quarrylens.plans.bindings import RAW_SPEC
from quarrylens.spec import ACCIDENT_SPEC, FEATURE_COLUMNS

COLS = ["DOCUMENT_NO", "MINE_ID", "DEGREE_INJURY_CD", "CAL_YR", "SUBUNIT_CD", "CLASSIFICATION_CD",
        "OCCUPATION_CD", "ACTIVITY_CD", "INJURY_SOURCE_CD", "NATURE_INJURY_CD", "INJ_BODY_PART_CD",
        "MINING_EQUIP_CD", "COAL_METAL_IND", "ACCIDENT_TYPE_CD", "NARRATIVE", "ACCIDENT_DT",
        "DEGREE_INJURY"]
COMMON = {"SUBUNIT_CD": "01", "CLASSIFICATION_CD": "01", "OCCUPATION_CD": "100", "ACTIVITY_CD": "001",
          "INJURY_SOURCE_CD": "001", "NATURE_INJURY_CD": "001", "INJ_BODY_PART_CD": "001",
          "COAL_METAL_IND": "C", "ACCIDENT_TYPE_CD": "01"}


def _row(doc, mine, deg, yr, equip, narr, dt, label):
    base = dict(COMMON, DOCUMENT_NO=doc, MINE_ID=mine, DEGREE_INJURY_CD=deg, CAL_YR=yr,
                MINING_EQUIP_CD=equip, NARRATIVE=narr, ACCIDENT_DT=dt, DEGREE_INJURY=label)
    return tuple(base[c] for c in COLS)


GOLDEN = [
    _row("1", "0100001", "03", "2010", "01", "Valid record kept.", "01/01/2010", "DAYS AWAY FROM WORK ONLY"),
    _row("2", "0100002", "?", "2010", "01", "Invalid degree removed.", "01/01/2010", "NO VALUE FOUND"),
    _row("3", "0100003", "00", "2025", "?", "Excluded degree code 00.", "01/01/2025", "ACCIDENT ONLY"),
    _row("4", "0100004", "06", "2015", "?", "Missing equip imputed to UNK.", "01/01/2015",
         "NO DYS AWY FRM WRK,NO RSTR ACT"),
]


def _frame(spark, data):
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in COLS))


def test_golden_rows_kept_and_imputed(spark):
    out = cleaning.clean(_frame(spark, GOLDEN), ACCIDENT_SPEC)
    got = {r["DOCUMENT_NO"]: r for r in out.collect()}
    assert set(got) == {"1", "4"}
    assert got["4"]["MINING_EQUIP_CD"] == "UNK"
    assert got["1"]["MINING_EQUIP_CD"] == "01"
    assert got["1"]["CAL_YR"] == 2010


def test_golden_waterfall(spark):
    log = cleaning.waterfall(cleaning.tag_rules(_frame(spark, GOLDEN), ACCIDENT_SPEC), ACCIDENT_SPEC)
    steps = {r["step"]: r for r in log.collect()}
    assert steps["raw_loaded"]["rows_after"] == 4
    assert steps["drop_invalid_degree_injury_cd"]["rows_removed"] == 1
    assert steps["drop_excluded_degree_injury_cd_for_classifier"]["rows_removed"] == 1
    # rows 3 and 4 are both still present when the impute step runs
    assert steps["impute_missing_equipment_as_UNK"]["rows_imputed"] == 2
    assert "drop_duplicate_key" not in steps  # listed only when it removes rows
    # every step: before - removed = after, and the chain is continuous
    ordered = sorted(log.collect(), key=lambda r: r["step_no"])
    for prev, cur in zip(ordered, ordered[1:]):
        assert cur["rows_before"] == prev["rows_after"]
        assert cur["rows_before"] - cur["rows_removed"] == cur["rows_after"]
    assert ordered[-1]["rows_after"] == 2


def test_dirty_cases(spark):
    extra = [
        _row("5", "0100005", "03", "2012", "01", "dup a", "01/01/2012", "X"),
        _row("5", "0100005", "03", "2012", "01", "dup b", "01/01/2012", "X"),
        _row("  ", "0100006", "03", "2012", "01", "blank key", "01/01/2012", "X"),
        _row("7", "0100007", "03", "1999", "01", "too old", "01/01/1999", "X"),
        _row("8", "0100008", "03", "abc", "01", "bad year", "01/01/2012", "X"),
        _row("9", "0100009", "03", "2012", "01", "   ", "01/01/2012", "X"),
        _row("10", "0100010", "3", "2012", "01", "bad date kept", "2012-13-45", "X"),
    ]
    out = cleaning.clean(_frame(spark, GOLDEN + extra), ACCIDENT_SPEC)
    got = {r["DOCUMENT_NO"]: r for r in out.collect()}
    assert set(got) == {"1", "4", "10"}  # both copies of 5 dropped (drop-all)
    assert got["10"]["ACCIDENT_DT"] is None
    log = cleaning.waterfall(cleaning.tag_rules(_frame(spark, GOLDEN + extra)), ACCIDENT_SPEC)
    steps = {r["step"]: r for r in log.collect()}
    assert steps["drop_duplicate_key"]["rows_removed"] == 2
    assert steps["drop_duplicate_key"]["dup_surplus"] == 1
    assert steps["drop_calendar_year_before_2000"]["rows_removed"] == 2


def test_string_normalise_and_codes(spark):
    df = spark.createDataFrame([('  "abc" ',), ("N/A",), ("nan",), ("\tx\n",), (None,)], "s string")
    got = [r[0] for r in df.select(clean_string("s")).collect()]
    assert got == ["abc", None, None, "x", None]
    codes = spark.createDataFrame([("1",), ("3",), ("09",), ("10",), ("123",)], "c string")
    assert [r[0] for r in codes.select(canonical_code("c")).collect()] == ["01", "03", "09", "10", "123"]
    inv = spark.createDataFrame([(None,), ("",), (" ",), ("?",), ("01",)], "c string")
    assert [r[0] for r in inv.select(invalid_code("c")).collect()] == [True, True, True, True, False]


def test_left_join_flag_and_dimension_dedup(spark):
    acc = spark.createDataFrame([("1", "m1"), ("2", "m2"), ("3", "m9")], "DOCUMENT_NO string, MINE_ID string")
    mines = spark.createDataFrame([("m1", "A", 1), ("m1", "B", 2), ("m2", "C", 1)],
                                  "MINE_ID string, STATE string, ord int")
    dim = cleaning.keep_first(mines, "MINE_ID", ["ord"])
    assert sorted(r["STATE"] for r in dim.collect()) == ["A", "C"]
    j = joins.left_join_flagged(acc, dim.drop("ord"), "MINE_ID")
    flags = {r["DOCUMENT_NO"]: r["MINE_MATCH"] for r in j.collect()}
    assert flags == {"1": True, "2": True, "3": False}
    audit = joins.join_audit(j).collect()[0].asDict()
    assert list(audit.values())[:3] == [3, 2, 1]


def test_feature_list_is_fixed():
    assert len(FEATURE_COLUMNS) == 10 and FEATURE_COLUMNS[0] == "SUBUNIT_CD"


def test_key_join_and_overlap(spark):
    resp = spark.createDataFrame([("S001", "P1", "wrong"), ("S009", "P1", "x")],
                                 "stimulus_id string, participant_id string, category string")
    key = spark.createDataFrame([("S001", "trend", "agent")], "stimulus_id string, category string, system_actual string")
    joined, missing = joins.attach_key(resp, key, "stimulus_id")
    j = joined.collect()
    assert len(j) == 1 and j[0]["category"] == "trend" and j[0]["system_actual"] == "agent"  # key columns win
    assert [r["stimulus_id"] for r in missing.collect()] == ["S009"]
    a = spark.createDataFrame([("k1",), ("k2",)], "k string")
    b = spark.createDataFrame([("k2",), ("k3",)], "k string")
    assert joins.overlap_count(a, b, "k").collect()[0][0] == 1
    assert [r[0] for r in joins.new_rows_only(b, a, "k").collect()] == ["k3"]


def test_clean_joins_narratives_to_rows_that_pass_the_other_rules_only(spark):
    cols = ["DOCUMENT_NO", "MINE_ID", "DEGREE_INJURY_CD", "CAL_YR", "SUBUNIT_CD", "CLASSIFICATION_CD", "OCCUPATION_CD",
            "ACTIVITY_CD", "MINING_EQUIP_CD", "ACCIDENT_DT"]
    spec = RAW_SPEC
    good = ["m", "A", "1999", "F", "1", "2", "3", "4", "01/02/1999"]
    rows = [("a", *good), ("b", "", *good[1:]), ("c", *good), ("c", *good), ("d", *good[:2], "1990", *good[3:]), (None, *good), ("e", *good)]
    left = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    texts = spark.createDataFrame([("a", "fell"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "?")], "doc string, NARRATIVE string")
    df = left.join(texts, left["DOCUMENT_NO"] == texts["doc"], "left").drop("doc")
    out = cleaning.clean(df, spec)
    assert [r["DOCUMENT_NO"] for r in out.collect()] == ["a"] and out.columns == df.columns
    # the year rule is applied before the narratives are joined: it lies deeper than a join with them
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    year = next(i for i, line in enumerate(plan) if "Filter" in line and "1996" in line)
    assert any("Join Inner" in line for line in plan[:year])
