"""The forest's trees, grown from a contingency table of codes (M4).

MLlib passes over every (row, tree) pair once a level. Here the table (one row
per combination of codes and label, with its number of records) travels to the
tasks once, and each tree is grown whole in one of them, level by level. Trees
are MLlib's: bagged records, Gini with class weights, a new draw of ceil(sqrt)
one-hot features at every node, two leaves of the same prediction merged. The
result is an MLlib model, loaded from the node rows it is stored as.

A tree draws from (seed, tree) over the sorted table, so the forest doesn't
depend on how its input is partitioned. A task holds the whole table: callers
count its rows first and leave tables beyond ``TABLE_ROWS`` to MLlib.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import ensure_checkpoint_dir

#: Rows of a table that a task can hold: some 100 bytes a row for eight code columns.
TABLE_ROWS = 2_000_000
#: Codes of all its columns, at most: a level has a cell for each node and code.
TABLE_CODES = 20_000
#: Random numbers drawn at once.
DRAW_CELLS = 1_000_000
#: Share of a tree's rows still at work under which the others are dropped.
DROP_AT = 0.7
#: Impurity under which a node counts as pure, as in MLlib.
PURE = 2.0 ** -52
#: Parameters of the forest that its trees don't have.
FOREST_PARAMS = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")

NODE_SCHEMA = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
               "leftChild int, rightChild int, featureIndex int")


@dataclass
class CodeTable:
    """``codes`` (an array per column, of codes under its size or, unseen, equal
    to it), ``label`` and ``count`` of each row, in sorted order."""

    codes: list[np.ndarray]
    sizes: list[int]
    label: np.ndarray
    n_labels: int
    count: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, codes: list[str], sizes: list[int], label: str, n_labels: int, count: str) -> "CodeTable":
        """From rows of integer codes; they are collected."""
        got = rows.select(*[F.col(c).cast("int") for c in (*codes, label)], F.col(count).cast("long")).toArrow()
        columns = [x.to_numpy().astype(np.min_scalar_type(size)) for x, size in zip(got.columns, (*sizes, n_labels))]
        order = np.lexsort(columns)
        columns = [x[order] for x in columns]
        return cls(columns[:-1], list(sizes), columns[-1], n_labels, got.columns[-1].to_numpy()[order])

    def weights(self) -> np.ndarray:
        """M3: the balanced weight n / (K * n_c) of each label."""
        seen = np.bincount(self.label, self.count, self.n_labels)
        return seen.sum() / (np.count_nonzero(seen) * np.maximum(seen, 1))


@dataclass
class Level:
    """Nodes of one depth: bagged records by label, the feature a node asks, its
    gain, and its left child's place in the next level (-1: a leaf)."""

    seen: np.ndarray
    feature: np.ndarray
    gain: np.ndarray
    left: np.ndarray


def _gini(weighted: np.ndarray) -> np.ndarray:
    total = np.maximum(weighted.sum(-1, keepdims=True), 1e-300)
    return 1.0 - ((weighted / total) ** 2).sum(-1)


def _gains(seen: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Decrease of impurity where ``right`` (node, feature, label) goes apart;
    -inf where nothing would remain on one side."""
    left = seen[:, None] - right
    a, b, whole = (left * weights).sum(-1), (right * weights).sum(-1), (seen * weights).sum(-1)[:, None]
    gain = _gini(seen * weights)[:, None] - a / whole * _gini(left * weights) - b / whole * _gini(right * weights)
    return np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), gain, -np.inf)


def _drawn(rng: np.random.Generator, n_nodes: int, n_features: int, n_asked: int) -> np.ndarray:
    """The features that each node asks for, drawn without replacement."""
    step = max(1, DRAW_CELLS // n_features)
    return np.concatenate([rng.random((min(step, n_nodes - i), n_features)).argpartition(n_asked - 1)[:, :n_asked]
                           for i in range(0, n_nodes, step)])


def grow(table: CodeTable, max_depth: int, rng: np.random.Generator) -> list[Level]:
    """One tree on its own bag of the table's records."""
    weights, n_labels = table.weights(), table.n_labels
    # every code, unseen ones too, has a place of its own, counted through the columns
    starts = np.concatenate([[0], np.cumsum(np.array(table.sizes) + 1)])
    places = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, table.sizes)]).astype(np.intp)  # of the features
    n_asked = math.ceil(math.sqrt(len(places)))

    drawn = rng.poisson(table.count)
    bag = np.flatnonzero(drawn)
    label, count = table.label[bag].astype(np.intp), drawn[bag].astype(np.float64)
    columns = [c[bag].astype(np.intp) + s for c, s in zip(table.codes, starts)]
    node, n_nodes, levels = np.zeros(len(bag), np.intp), 1, []
    for depth in range(max_depth + 1):
        seen = np.bincount(node * n_labels + label, count, n_nodes * n_labels).reshape(n_nodes, n_labels)
        none = np.full(n_nodes, -1, np.intp)
        level = Level(seen, none, none.astype(np.float64), none.copy())
        levels.append(level)
        mixed = np.flatnonzero(_gini(seen * weights) > PURE)
        if depth == max_depth or not len(mixed) or not len(places):
            break
        asked = _drawn(rng, len(mixed), len(places), n_asked)
        # where a node's features count by label; what it doesn't ask for counts in its slot 0
        cells = n_nodes * (n_asked + 1) * n_labels
        slots = np.zeros((n_nodes, int(starts[-1])), np.int32)
        slots[mixed[:, None], places[asked]] = np.arange(1, n_asked + 1)
        slots += np.arange(n_nodes, dtype=np.int32)[:, None] * (n_asked + 1)
        slots = slots.ravel() * np.int32(n_labels)
        at, right = node * int(starts[-1]), np.zeros(cells)
        for column in columns:
            right += np.bincount(slots.take(at + column, mode="clip") + label, count, cells)
        gains = _gains(seen[mixed], right.reshape(n_nodes, n_asked + 1, n_labels)[mixed, 1:], weights)
        best = gains.argmax(1)
        gain, feature = gains[np.arange(len(mixed)), best], asked[np.arange(len(mixed)), best]
        split = np.flatnonzero(gain > 0)
        inner = mixed[split]
        level.feature[inner], level.gain[inner], level.left[inner] = feature[split], gain[split], 2 * np.arange(len(inner))
        if not len(inner):
            break
        wanted, goes_on = np.where(level.feature >= 0, places[level.feature], -1)[node], level.left[node] >= 0
        to_right = columns[0] == wanted
        for column in columns[1:]:
            to_right |= column == wanted
        # records of leaves count no more; they are dropped when they are many
        node, n_nodes = np.maximum(level.left[node], 0) + to_right, 2 * len(inner)
        count *= goes_on
        if np.count_nonzero(count) < DROP_AT * len(count):
            left = np.flatnonzero(count)
            node, label, count, columns = node[left], label[left], count[left], [c[left] for c in columns]
    return levels


def preorder(levels: list[Level], weights: np.ndarray) -> dict[str, np.ndarray]:
    """The tree's nodes as MLlib stores them: two leaves of the same prediction
    are merged into their parent, ids count through left before right."""
    predicted = [(x.seen * weights).argmax(1) for x in levels]
    sizes: list[np.ndarray] = [np.ones(len(x.left), np.intp) for x in levels]
    for d in range(len(levels) - 2, -1, -1):
        level, leaf, below = levels[d], levels[d + 1].left < 0, predicted[d + 1]
        inner = np.flatnonzero(level.left >= 0)
        a = level.left[inner]
        merged = inner[leaf[a] & leaf[a + 1] & (below[a] == below[a + 1])]
        level.left[merged] = level.feature[merged] = -1
        level.gain[merged] = -1
        inner = np.flatnonzero(level.left >= 0)
        a = level.left[inner]
        sizes[d][inner] += sizes[d + 1][a] + sizes[d + 1][a + 1]
    ids = [np.full(len(x.left), -1, np.intp) for x in levels]
    ids[0][0] = 0
    parts = []
    for d, level in enumerate(levels):
        inner = np.flatnonzero(level.left >= 0)
        lefts, rights = np.full((2, len(level.left)), -1, np.intp)
        if len(inner):
            a = level.left[inner]
            ids[d + 1][a] = lefts[inner] = ids[d][inner] + 1
            ids[d + 1][a + 1] = rights[inner] = ids[d][inner] + 1 + sizes[d + 1][a]
        kept = ids[d] >= 0
        stats = level.seen * weights
        parts.append([x[kept] for x in (ids[d], predicted[d].astype(np.float64), _gini(stats), stats, level.seen.sum(1).astype(np.int64),
                                        level.gain, lefts, rights, level.feature)])
    columns = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(columns[0])
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")[1:]]
    return {name: x[order] for name, x in zip(names, columns)}


def _batch(tree: int, nodes: dict[str, np.ndarray]) -> pa.RecordBatch:
    n, stats = len(nodes["id"]), nodes["impurityStats"]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
    flat = {"treeID": np.full(n, tree), **nodes}
    columns = {k: lists if k == "impurityStats" else pa.array(v if v.dtype != np.intp or k == "rawCount" else v.astype(np.int32))
               for k, v in flat.items()}
    return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def grown(spark, shared: Broadcast, num_trees: int, max_depth: int, seed: int) -> DataFrame:
    """Rows of NODE_SCHEMA from the broadcast CodeTable; a few trees a task."""
    def each(batches):
        weights = shared.value.weights()
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                levels = grow(shared.value, max_depth, np.random.default_rng([seed, tree]))
                yield _batch(tree, preorder(levels, weights))

    tasks = min(num_trees, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, num_trees, 1, tasks).mapInArrow(each, NODE_SCHEMA)


def fit(spark, table: CodeTable, forest: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest that ``forest`` asks for, on the one-hot features of the
    table's codes, stored in MLlib's layout under the shared folder and loaded."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forests/{uuid.uuid4().hex}"
    n_trees = forest.getNumTrees()
    split = F.struct(F.col("featureIndex"), F.when(F.col("featureIndex") >= 0, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
                     .alias("leftCategoriesOrThreshold"), F.when(F.col("featureIndex") >= 0, 2).otherwise(-1).alias("numCategories"))
    node = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
    shared = spark.sparkContext.broadcast(table)
    try:
        nodes = grown(spark, shared, n_trees, forest.getMaxDepth(), forest.getSeed())
        nodes.select("treeID", node.alias("nodeData")).write.parquet(f"{path}/data")
    finally:
        shared.destroy()

    own, default = ({p.name: v for p, v in x.items()} for x in (forest._paramMap, forest._defaultParamMap))
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    tree = {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", **head,
            "paramMap": {k: v for k, v in own.items() if k not in FOREST_PARAMS},
            "defaultParamMap": {k: v for k, v in default.items() if k not in FOREST_PARAMS}}
    trees = [(i, json.dumps({**tree, "uid": f"dtc_{uuid.uuid4().hex[-12:]}"}), 1.0) for i in range(n_trees)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", **head, "uid": forest.uid, "paramMap": own,
             "defaultParamMap": default, "numFeatures": sum(table.sizes), "numClasses": table.n_labels, "numTrees": n_trees}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
