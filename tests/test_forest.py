"""The forest grown from a contingency table of codes, beside MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import forest, severity
from quarrylens.spec import ACCIDENT_SPEC

SPEC = ACCIDENT_SPEC.with_(features=("A", "B", "C"), mine_context=())


def _rows(spark, n=3000):
    """Labels that follow A in two of three rows; B has nulls, C many codes."""
    u = F.xxhash64("id")
    return spark.range(n).select(
        F.pmod(u, F.lit(4)).cast("string").alias("A"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string")).alias("B"),
        F.pmod(F.shiftright(u, 9), F.lit(12)).cast("string").alias("C"),
        F.concat(F.lit("0"), F.when(F.col("id") % 3 > 0, F.pmod(u, F.lit(4))).otherwise(F.pmod(F.shiftright(u, 5), F.lit(4))) + 1).alias(SPEC.target))


@pytest.fixture
def grown_from_codes(monkeypatch):
    monkeypatch.setattr(severity, "MLLIB_ROWS", 0, raising=False)


def _table(seed=0, n=400, sizes=(3, 5, 2)):
    """A table with unseen codes (equal to their column's size) and counts above one."""
    rng = np.random.default_rng(seed)
    codes = [rng.integers(0, size + 1, n) for size in sizes]
    label = np.where(rng.random(n) < 0.6, codes[0] % 3, rng.integers(0, 3, n))
    return forest.CodeTable(codes, list(sizes), label, 3, rng.integers(1, 20, n))


def test_forest_does_not_depend_on_partitions(spark, grown_from_codes):
    """MLlib draws its bags partition by partition."""
    rows = _rows(spark)
    texts = [severity.fit(x, SPEC, num_trees=3, max_depth=4).stages[-1].toDebugString.partition("\n")[2]
             for x in (rows, rows.repartition(5, F.rand(7)), rows.coalesce(1).orderBy(F.desc("C")))]
    assert texts[0] == texts[1] == texts[2] and "Tree 2" in texts[0]


def test_nodes_hold_what_their_records_say():
    """Every node against the bagged records that reach it, one by one."""
    table = _table()
    weights = table.weights()
    bag = np.random.default_rng([42, 1]).poisson(table.count)
    nodes = forest.preorder(forest.grow(table, 5, np.random.default_rng([42, 1])), weights)
    one_hot = np.concatenate([np.arange(size) == code[:, None] for code, size in zip(table.codes, table.sizes)], axis=1)
    gini = lambda w: 1 - ((w / w.sum()) ** 2).sum()

    def check(i, reach, depth):
        stats = np.bincount(table.label, bag * reach, 3) * weights
        assert nodes["id"][i] == i and depth <= 5
        assert np.allclose(nodes["impurityStats"][i], stats) and nodes["rawCount"][i] == (bag * reach).sum() > 0
        assert nodes["prediction"][i] == stats.argmax() and np.isclose(nodes["impurity"][i], gini(stats))
        left, right, feature = nodes["leftChild"][i], nodes["rightChild"][i], nodes["featureIndex"][i]
        if left < 0:
            assert right == feature == -1 and nodes["gain"][i] == -1
            return 1
        has = one_hot[:, feature]
        n = check(left, reach & ~has, depth + 1)
        assert left == i + 1 and right == left + n
        n += check(right, reach & has, depth + 1)
        a, b = nodes["impurityStats"][left], nodes["impurityStats"][right]
        gain = gini(stats) - (a.sum() * gini(a) + b.sum() * gini(b)) / stats.sum()
        assert np.isclose(nodes["gain"][i], gain) and gain > 0
        leaves = nodes["leftChild"][[left, right]] < 0
        assert not leaves.all() or nodes["prediction"][left] != nodes["prediction"][right]
        return n + 1

    assert check(0, np.ones(len(bag), bool), 0) == len(nodes["id"]) > 9


def test_best_of_the_asked_features_is_taken():
    """Two features: each node asks for both (ceil of the root of 2)."""
    table = _table(3, sizes=(2,))
    weights = table.weights()
    root = forest.grow(table, 1, np.random.default_rng(5))[0]
    bag = np.random.default_rng(5).poisson(table.count)
    side = lambda keep: np.bincount(table.label, bag * keep, 3)
    gains = [forest._gains(side(bag >= 0)[None], side(table.codes[0] == f)[None, None], weights)[0, 0] for f in (0, 1)]
    assert root.feature[0] == np.argmax(gains) and np.isclose(root.gain[0], max(gains))


def test_leaves_drop_out_and_pure_nodes_stay():
    """Labels that one code decides: the nodes that it makes are pure; the rest goes on."""
    codes = [np.arange(60) % 3, np.arange(60) % 5]
    table = forest.CodeTable(codes, [3, 5], (np.arange(60) % 3 == 1).astype(int), 2, np.full(60, 50))
    levels = forest.grow(table, 9, np.random.default_rng(1))
    nodes = forest.preorder(levels, table.weights())
    leaves = nodes["leftChild"] < 0
    assert np.allclose(nodes["impurity"][leaves], 0) and {*nodes["prediction"][leaves]} == {0.0, 1.0}
    one = forest.CodeTable([codes[0]], [3], np.zeros(60, int), 2, np.ones(60, int))  # one label: a root alone
    assert len(forest.preorder(forest.grow(one, 9, np.random.default_rng(1)), one.weights())["id"]) == 1


def test_grown_forest_is_as_good_as_mllib(spark, grown_from_codes, monkeypatch):
    rows = _rows(spark)
    shares = []
    for at_most in (0, 10**9):
        monkeypatch.setattr(severity, "MLLIB_ROWS", at_most)
        model = severity.fit(rows, SPEC, num_trees=20, max_depth=6)
        pairs = severity.predicted_pairs(model, rows, list(SPEC.features), SPEC.target)
        shares.append(pairs.agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))) / F.sum("n")).first()[0])
    assert shares[0] > 0.7 and abs(shares[0] - shares[1]) < 0.02


def test_grown_forest_is_stored_and_loaded(spark, grown_from_codes, tmp_path):
    """Null labels don't train; null and unseen codes are scored; the stored model says what it is."""
    rows = _rows(spark, 500)
    train = rows.withColumn(SPEC.target, F.when(F.col("C") != "5", F.col(SPEC.target)))
    key = {"unique": str(tmp_path)}
    severity.fit_or_load(spark, "grown", lambda: severity.fit(train, SPEC, num_trees=4, max_depth=3, seed=9), spec=SPEC, **key)
    model = severity.fit_or_load(spark, "grown", lambda: 1 / 0, spec=SPEC, **key)
    info = severity.stored_info(spark, "grown", **key).first()
    assert (info["features"], info["n_trees"], info["max_depth"], info["labels"]) == (["A", "B", "C"], 4, 3, ["01", "02", "03", "04"])
    trees = model.stages[-1]
    assert trees.numFeatures == 4 + 3 + 11 and trees.getOrDefault("seed") == 9 and trees.treeWeights == [1.0] * 4
    asked = spark.createDataFrame([("0", None, "1"), ("none", "none", "none")], "A string, B string, C string")
    assert severity.predict(model, asked).where(F.col("predicted_code").isin(*info["labels"])).count() == 2


@pytest.mark.parametrize("bound", ["TABLE_ROWS", "TABLE_CODES"])
def test_what_no_task_can_hold_is_left_to_mllib(spark, grown_from_codes, monkeypatch, bound):
    monkeypatch.setattr(forest, bound, 3)
    monkeypatch.setattr(forest, "fit", lambda *x: 1 / 0)
    assert severity.fit(_rows(spark, 200), SPEC, num_trees=2, max_depth=2).stages[-1].getNumTrees == 2


def test_each_combination_of_features_is_scored_once(spark, monkeypatch):
    """Whatever truths it comes with; null truths and codes keep their rows."""
    rows = _rows(spark, 900).withColumn(SPEC.target, F.when(F.col("A") != "3", F.col(SPEC.target)))
    model = severity.fit(rows, SPEC, num_trees=2, max_depth=3)
    plain, scored = severity.predict, []

    def counted(m, df, keep=None):
        scored.append(df.count())
        return plain(m, df, keep)

    monkeypatch.setattr(severity, "predict", counted)
    pairs = severity.predicted_pairs(model, rows, list(SPEC.features), SPEC.target).groupBy("truth", "pred").agg(F.sum("n").alias("n"))
    each = plain(model, rows, [SPEC.target]).groupBy(F.col(SPEC.target).alias("truth"), F.col("predicted_code").alias("pred")).agg(F.count("*").alias("n"))
    assert scored == [rows.select(*SPEC.features).distinct().count()]
    assert pairs.columns == ["truth", "pred", "n"] and {*pairs.collect()} == {*each.collect()}
