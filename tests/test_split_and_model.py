"""Split invariants on driver data, seeded samples, leakage guard, forest."""

import pytest
from pyspark.sql import functions as F

from quarrylens_testdata import SF_SMALL
from quarrylens.operators import severity, split
from quarrylens.plans.bindings import DRIVER_SPEC, incidents
from quarrylens.spec import ACCIDENT_SPEC

SPEC = DRIVER_SPEC


@pytest.fixture(scope="module")
def inc(spark):
    return incidents(spark, SF_SMALL).cache()


def test_stratified_split_exact_and_disjoint(inc):
    s = split.stratified_split(inc, SPEC).cache()
    n = s.count()
    n_test = s.filter(F.col("split") == "test").count()
    assert abs(n_test - n * 0.2) < 1
    train = s.filter(F.col("split") == "train").select(SPEC.key)
    test = s.filter(F.col("split") == "test").select(SPEC.key)
    assert train.intersect(test).count() == 0
    # re-running on a repartitioned input picks the same rows
    again = split.stratified_split(inc.repartition(3), SPEC).filter(F.col("split") == "test")
    assert sorted(r[0] for r in again.select(SPEC.key).collect()) == sorted(r[0] for r in test.collect())


def test_seeded_samples_are_stable(inc):
    a = [r[0] for r in split.seeded_sample(inc, SPEC.key, 10, 42).select(SPEC.key).collect()]
    b = [r[0] for r in split.seeded_sample(inc.repartition(5), SPEC.key, 10, 42).select(SPEC.key).collect()]
    assert a == b and len(a) == 10
    per = split.sample_per_category(inc, "COAL_METAL_IND", SPEC.key, 3, 42)
    assert {r[1] for r in per.groupBy("COAL_METAL_IND").count().collect()} == {3}


def test_out_of_time(inc):
    s = split.out_of_time(inc, SPEC)
    bad = s.filter(((F.col("split") == "train") & (F.col(SPEC.year) > SPEC.oot_train_max)) |
                   ((F.col("split") == "test") & (F.col(SPEC.year) < SPEC.oot_test_min)))
    assert bad.count() == 0


def test_leakage_guard(spark):
    cols = list(ACCIDENT_SPEC.features) + ["DAYS_LOST", "NARRATIVE", ACCIDENT_SPEC.target]
    df = spark.createDataFrame([tuple("1" for _ in cols)], ", ".join(f"{c} string" for c in cols))
    feats = severity.feature_columns(df, ACCIDENT_SPEC)
    assert "DAYS_LOST" not in feats and "NARRATIVE" not in feats and ACCIDENT_SPEC.target not in feats
    with pytest.raises(ValueError):
        severity.feature_columns(df.drop("SUBUNIT_CD"), ACCIDENT_SPEC)
    with pytest.raises(ValueError):
        severity.feature_columns(df, ACCIDENT_SPEC.with_(features=("SUBUNIT_CD", "DEGREE_INJURY_CD")))
    t = spark.createDataFrame([("1",), ("3",), ("09",), ("10",)], "DEGREE_INJURY_CD string")
    assert [r[0] for r in severity.select_target(t, ACCIDENT_SPEC).collect()] == ["01", "03", "09", "10"]


def test_separable_forest(spark):
    feats = list(ACCIDENT_SPEC.features)
    rows = []
    for sub, deg in (("01", "01"), ("02", "06"), ("03", "03")):
        for _ in range(2):
            rows.append(tuple(sub if c == "SUBUNIT_CD" else "X" for c in feats) + (deg,))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in feats) + ", DEGREE_INJURY_CD string")
    model = severity.fit(df, ACCIDENT_SPEC, num_trees=5, seed=1)
    pred = severity.predict(model, df)
    got = {r["predicted_code"] for r in pred.collect()}
    assert got <= {"01", "03", "06"} and pred.count() == 6


def test_request_completion(spark):
    req = spark.createDataFrame([("r1", "c", None)], "rid string, COAL_METAL_IND string, SUBUNIT_CD string")
    out = severity.complete_requests(req, ACCIDENT_SPEC, keep=["rid"]).collect()[0].asDict()
    assert out["COAL_METAL_IND"] == "C" and out["SUBUNIT_CD"] == "" and out["MINING_EQUIP_CD"] == "UNK"
    assert list(out)[0] == "rid" and len(out) == 1 + len(ACCIDENT_SPEC.features)


def test_weighted_combinations_stand_for_the_records(spark):
    from pyspark.sql import functions as F

    from quarrylens.operators import severity

    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("f"), F.when(F.col("id") < 900, "01").otherwise("06").alias("y"))
    table = severity.weighted_combinations(rows, "y", units=4)
    assert table.count() == 6 * 4  # of 1000 records
    old = severity.with_weights(rows, "y").groupBy("f", "y").agg(F.sum("weight").alias("w"))
    new = table.groupBy("f", "y").agg(F.sum("weight").alias("w"))
    assert {(r[0], r[1]): round(r[2], 9) for r in old.collect()} == {(r[0], r[1]): round(r[2], 9) for r in new.collect()}


def test_stored_model_keeps_its_metadata(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarrylens.operators import severity
    from quarrylens.spec import ACCIDENT_SPEC

    spec = ACCIDENT_SPEC.with_(features=("A", "B"), mine_context=("C",))
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("A"), (F.col("id") % 2).cast("string").alias("B"),
                                  (F.col("id") % 5).cast("string").alias("C"), F.concat(F.lit("0"), F.col("id") % 3 + 1).alias(spec.target))
    key = {"unique": str(tmp_path)}
    for context in (False, True):
        fit = lambda: severity.fit(rows, spec, include_context=context, num_trees=3, max_depth=4)  # noqa: E731,B023
        severity.fit_or_load(spark, "tiny", fit, include_context=context, spec=spec, **key)
        again = severity.fit_or_load(spark, "tiny", lambda: 1 / 0, include_context=context, spec=spec, **key)  # loaded, not fitted
        info = severity.stored_info(spark, "tiny", include_context=context, **key).collect()[0]
        assert info["features"] == (["A", "B", "C"] if context else ["A", "B"]) and info["labels"] == ["01", "02", "03"]
        assert (info["n_trees"], info["max_depth"], info["include_context"], info["target"]) == (3, 4, context, spec.target)
        assert info["n_nodes"] == severity.model_info(again)["n_nodes"] > 3
        pred = severity.predict(again, rows, keep=[spec.target])
        assert pred.where(F.col("predicted_code") == F.col(spec.target)).count() == 60
    with pytest.raises(ValueError, match="no stored model"):
        severity.stored_info(spark, "never", **key)


def test_report_scores_each_combination_once(inc):
    """The same metrics as from scored records, from far fewer of them."""
    s = split.stratified_split(inc, SPEC)
    model = severity.fit(s.where("split = 'train'"), SPEC, num_trees=3, max_depth=4)
    test = s.where("split = 'test'").unionByName(s.where("split = 'test'"))  # every record twice
    pairs = severity.predicted_pairs(model, test, severity.feature_columns(test, SPEC), "DEGREE_INJURY_CD").cache()
    each = severity.predict(model, test, keep=["DEGREE_INJURY_CD"]).select(
        F.lpad("DEGREE_INJURY_CD", 2, "0").alias("truth"), F.col("predicted_code").alias("pred"))
    assert 2 * pairs.count() <= each.count() == pairs.agg(F.sum("n")).first()[0]
    assert sorted(severity.class_metrics(pairs, weight="n").collect()) == sorted(severity.class_metrics(each).collect())


def test_requests_are_scored_once_per_combination_of_codes(spark, monkeypatch):
    """Requests of the same codes share one scoring; null codes and repeated
    requests keep their rows."""
    from quarrylens.operators import severity, tools

    spec = SPEC.with_(features=("A", "B"), mine_context=())
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("A"), (F.col("id") % 2).cast("string").alias("B"),
                                  F.concat(F.lit("0"), F.col("id") % 3 + 1).alias(spec.target))
    model = severity.fit(rows, spec, num_trees=3, max_depth=4)
    with_nulls = rows.withColumn("A", F.when(F.col(spec.target) != "01", F.col("A")))
    plain, scored = severity.predict, []

    def counted(m, df, keep=None):
        scored.append(df.count())
        return plain(m, df, keep)

    expected = sorted(plain(model, with_nulls, [spec.target]).collect())
    monkeypatch.setattr(severity, "predict", counted)
    assert sorted(severity.predict_rows(model, with_nulls, [spec.target]).collect()) == expected and len(expected) == 60
    classify = spark.range(90).select((F.col("id") % 45).alias("request_id"), F.create_map(F.lit("A"), (F.col("id") % 3).cast("string")).alias("codes"))
    got = tools.classify_requests(classify, model, spec).collect()
    assert scored == [6, 3] and len(got) == 90
    assert all(r["predicted_degree_code"] == f"0{r['request_id'] % 3 + 1}" for r in got)
