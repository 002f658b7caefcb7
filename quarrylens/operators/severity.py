"""Leakage-safe features, severity forest and metric tables.

The model is an MLlib ``Pipeline``: one ``StringIndexer`` per code column
(unseen codes go to an extra slot that ``OneHotEncoder(dropLast=True)``
drops, i.e. an all-zero block, like ignoring unknown categories), a
``VectorAssembler`` and a ``RandomForestClassifier`` with balanced class
weights. Metrics are plain aggregates over a (truth, prediction) table, so
they are checked against SQL and never collect predictions.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import canonical_code
from quarrylens.operators import forest
from quarrylens.spec import ACCIDENT_SPEC, RANDOM_SEED, SchemaSpec


def feature_columns(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC,
                    include_context: bool = False) -> list[str]:
    """C17: fixed feature list (+ context columns that exist); raises on a
    missing feature or on any denylisted column."""
    cols = list(spec.features)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing classifier feature columns: {missing}")
    if include_context:
        cols += [c for c in spec.mine_context if c in df.columns and c not in cols]
    leaked = sorted(set(cols) & set(spec.leakage))
    if leaked:
        raise ValueError(f"Leakage columns selected as features: {leaked}")
    return cols


def select_features(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC,
                    include_context: bool = False) -> DataFrame:
    return df.select(*feature_columns(df, spec, include_context))


def select_target(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """C18 + M1: the target, canonicalised to a 2-character code."""
    if spec.target not in df.columns:
        raise ValueError(f"Missing target column: {spec.target}")
    return df.select(canonical_code(spec.target).alias(spec.target))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M3: balanced weight n / (K * n_c) per class (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(1))
    return counts.select(label, "n_c", (F.sum("n_c").over(w) /
                                        (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """Attach the class weight to each row. The weight table has one row
    per class (bounded by the code domain), so it is broadcast."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)


def build_pipeline(features: list[str], label: str = "label_code", num_trees: int = 100,
                   max_depth: int = 10, seed: int = RANDOM_SEED) -> Pipeline:
    """M2 + M4."""
    # One multi-column indexer: one pass over the data for all code columns.
    idx = [StringIndexer(inputCols=list(features), outputCols=[f"{c}__idx" for c in features],
                         handleInvalid="keep", stringOrderType="alphabetAsc")]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in features],
                        outputCols=[f"{c}__vec" for c in features], dropLast=True)
    asm = VectorAssembler(inputCols=[f"{c}__vec" for c in features], outputCol="features")
    lab = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                numTrees=num_trees, maxDepth=max_depth,
                                featureSubsetStrategy="sqrt", seed=seed,
                                maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
    return Pipeline(stages=[*idx, ohe, asm, lab, rf])


def fit(train: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC, include_context: bool = False,
        num_trees: int = 100, max_depth: int = 10, seed: int = RANDOM_SEED) -> PipelineModel:
    """M4: fit on the guarded features; codes are cast to string. Tables of at
    most ``MLLIB_ROWS`` combinations, and those that no task can hold, are
    fitted by MLlib, the others by ``forest``."""
    feats = feature_columns(train, spec, include_context)
    rows = train.select(*[F.col(c).cast("string").alias(c) for c in feats],
                        canonical_code(spec.target).alias("label_code"))
    pipeline = build_pipeline(feats, "label_code", num_trees, max_depth, seed)
    table = rows.where(F.col("label_code").isNotNull()).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if MLLIB_ROWS < table.count() <= forest.TABLE_ROWS and (model := _fit_codes(pipeline, table)):
            return model
    finally:
        table.unpersist()
    # MLlib makes one pass per tree level: keep the (narrow, distinct)
    # training rows materialised instead of re-running their lineage each pass.
    prepared = weighted_combinations(rows, "label_code").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(prepared)
    finally:
        prepared.unpersist()


#: Combinations of codes and label up to which MLlib's passes are cheap: it fits them, as ever, to the same models.
MLLIB_ROWS = 20_000


def _fit_codes(pipeline: Pipeline, table: DataFrame) -> PipelineModel | None:
    """The pipeline with its last stage, the forest, grown from the codes that
    the other stages give to ``table`` (combinations and their number ``_n``);
    None if there are too many different codes."""
    *encoders, trees = pipeline.getStages()
    fitted = Pipeline(stages=encoders).fit(table).stages
    codes, label = fitted[0], fitted[-1]
    sizes = [len(x) for x in codes.labelsArray]
    if sum(sizes) > forest.TABLE_CODES:
        return None
    coded = label.transform(codes.transform(table))
    known = forest.CodeTable.of(coded, codes.getOutputCols(), sizes, label.getOutputCol(), len(label.labels), "_n")
    return PipelineModel(stages=[*fitted, forest.fit(table.sparkSession, known, trees)])


#: Rows that stand for one combination of codes, at most: the units of bagging.
BAG_UNITS = 8


def weighted_combinations(rows: DataFrame, label: str, units: int = BAG_UNITS) -> DataFrame:
    """The distinct rows with a ``weight``: their number times their class
    weight (M3). A combination seen n times becomes min(n, ``units``) rows, so
    that bagging still draws parts of it. Trees split on sums of weights only,
    so training reads the contingency table, whose size the codes bound, and
    never the records."""
    table = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    sizes = table.groupBy(label).agg(F.sum("_n").alias("_class"))  # one row per class
    whole = Window.partitionBy(F.lit(1))
    weights = sizes.select(label, (F.sum("_class").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_class"))).alias("_w"))
    parts = F.least("_n", F.lit(units))
    return (table.join(F.broadcast(weights), label).withColumn("weight", F.col("_w") * F.col("_n") / parts)
            .withColumn("_part", F.explode(F.sequence(F.lit(1), parts.cast("int")))).select(*rows.columns, "weight"))


def predicted_pairs(model: PipelineModel, test: DataFrame, features: list[str], target: str) -> DataFrame:
    """(truth, pred, n): a prediction depends on the features alone, so each
    combination of them is scored once and stands for the ``n`` rows of each
    truth that it came with."""
    table = test.groupBy(target, *features).agg(F.count(F.lit(1)).alias("n"))
    seen = F.collect_list(F.struct(F.lpad(target, 2, "0").alias("truth"), "n"))  # an entry per label at most
    # scoring is work for all tasks, though its rows are few: a number given is not coalesced
    tasks = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = table.repartition(tasks, *features).groupBy(*features).agg(seen.alias("_seen"))
    scored = predict(model, asked, keep=["_seen"])
    return scored.select(F.col("predicted_code").alias("pred"), F.explode("_seen").alias("_row")).select("_row.truth", "pred", "_row.n")


def predict_rows(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """M5 for many rows: ``keep`` and ``predicted_code`` of every row. Each
    combination of codes is scored once and joined back (null codes are equal
    within a struct); a left join, so that the rows are never broadcast."""
    codes = F.struct(*[F.col(c).cast("string").alias(c) for c in model_features(model)])
    asked = df.select(*keep, codes.alias("_codes"))
    scored = predict(model, asked.select("_codes").distinct().select("_codes", "_codes.*"), keep=["_codes"])
    return asked.join(scored, "_codes", "left").select(*keep, "predicted_code")


def model_features(model: PipelineModel) -> list[str]:
    """The columns that a fitted pipeline reads, in order."""
    return [c for s in model.stages if s.hasParam("outputCols") and s.isDefined("outputCols")
            and s.getOutputCols()[0].endswith("__idx") for c in s.getInputCols()]


def predict(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """M5: adds ``predicted_code`` (the original code string)."""
    label_model = [s for s in model.stages if s.hasParam("outputCol") and s.isDefined("outputCol")
                   and s.getOutputCol() == "label"]
    labels = label_model[0].labels
    ready = df
    for c in model_features(model):
        ready = ready.withColumn(c, F.col(c).cast("string"))
    if "label_code" not in ready.columns:
        ready = ready.withColumn("label_code", F.lit(labels[0]))  # placeholder, unused
    out = model.transform(ready)
    conv = IndexToString(inputCol="prediction", outputCol="predicted_code", labels=labels)
    out = conv.transform(out)
    cols = (keep or []) + ["predicted_code"]
    return out.select(*cols)


def complete_requests(requests: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC,
                      keep: list[str] | None = None) -> DataFrame:
    """Complete raw request rows before scoring - codes upper-cased,
    a missing feature becomes "", a missing equipment code the sentinel
    ``UNK`` (as the cleaning step imputes it)."""
    cols = []
    for c in spec.features:
        v = F.upper(F.col(c).cast("string")) if c in requests.columns else F.lit(None).cast("string")
        fill = F.lit("UNK") if c == spec.equipment else F.lit("")
        cols.append(F.coalesce(v, fill).alias(c))
    return requests.select(*(keep or []), *cols)


def confusion_long(pairs: DataFrame, truth: str = "truth", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """M6: (truth, pred, n) over the full label x label grid of the union
    label set (missing cells are 0). A pair counts once, or ``weight`` times
    where it stands for so many. The grid is built from one array of
    distinct labels (bounded by the code domain) exploded twice."""
    counts = pairs.groupBy(truth, pred).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    labels = (pairs.select(F.col(truth).alias("l")).union(pairs.select(F.col(pred).alias("l")))
              .agg(F.array_sort(F.collect_set("l")).alias("ls")))
    grid = (labels.select(F.explode("ls").alias(truth), "ls")
            .select(truth, F.explode("ls").alias(pred)))
    return (grid.join(counts, [truth, pred], "left")
            .select(truth, pred, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def class_metrics(pairs: DataFrame, truth: str = "truth", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """M7 + M8 + M12: long table (metric, label, value).

    Per label: support, recall, precision, f1 (zero_division = 0).
    Overall (label = '*'): accuracy, macro_f1, weighted_f1, majority_accuracy.
    """
    cm = confusion_long(pairs, truth, pred, weight)
    per = cm.groupBy(F.col(truth).alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cm.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("pred_n"))
    p = per.join(predicted, "label")
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    precision = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    p = p.withColumn("recall", recall).withColumn("precision", precision)
    p = p.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0,
                                  2 * F.col("recall") * F.col("precision") /
                                  (F.col("recall") + F.col("precision"))).otherwise(0.0))
    per_rows = p.select("label", F.explode(F.array(
        F.struct(F.lit("support").alias("metric"), F.col("support").cast("double").alias("value")),
        F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("value")),
        F.struct(F.lit("precision").alias("metric"), F.col("precision").alias("value")),
        F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("value")))).alias("m")
    ).select(F.col("m.metric").alias("metric"), "label", F.col("m.value").alias("value"))
    overall = p.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.max("support") / F.sum("support")).alias("majority_accuracy"))
    over_rows = overall.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("accuracy", "macro_f1", "weighted_f1", "majority_accuracy")])).alias("m")
    ).select(F.col("m.metric").alias("metric"), F.lit("*").alias("label"),
             F.col("m.value").alias("value"))
    return per_rows.unionByName(over_rows).withColumn("value", F.round("value", 6))


def model_path(spark, name: str, **params) -> str:
    """Where a trained model lives - under the shared folder named by
    ``spark.checkpoint.dir`` (never a machine-local path on a cluster), keyed
    by a hash of the training parameters so a changed setup retrains."""
    from quarrylens.plans.artifacts import artifact_path

    return artifact_path(spark, "models", name, **params)


def model_info(model: PipelineModel) -> dict:
    """What a fitted pipeline was trained to do: its features and labels, in
    order, and the forest's size."""
    index = next(st for st in model.stages if st.hasParam("outputCols") and st.isDefined("outputCols") and st.getOutputCols()[0].endswith("__idx"))
    label = next(st for st in model.stages if st.hasParam("outputCol") and st.isDefined("outputCol") and st.getOutputCol() == "label")
    trees = model.stages[-1]
    return {"features": list(index.getInputCols()), "labels": list(label.labels), "n_trees": trees.getNumTrees,
            "max_depth": trees.getMaxDepth(), "n_nodes": trees.totalNumNodes}


INFO_SCHEMA = ("features array<string>, labels array<string>, n_trees int, max_depth int, n_nodes long, include_context boolean, target string")


def fit_or_load(spark, name: str, train_fn, include_context: bool = False, spec: SchemaSpec = ACCIDENT_SPEC, **params) -> PipelineModel:
    """Load the committed pipeline if there is one, else fit, save and
    publish it with a row of metadata (the original trained once and loaded the
    artifact for serving). A storage error rises; it never retrains."""
    from quarrylens.plans.artifacts import committed, new_version, publish

    path = model_path(spark, name, context=include_context, **params)
    found = committed(spark, path)
    if found is None:
        version = new_version(path)
        model = train_fn()
        model.write().save(f"{version}/model")
        row = {**model_info(model), "include_context": include_context, "target": spec.target}
        spark.createDataFrame([row], INFO_SCHEMA).coalesce(1).write.parquet(f"{version}/info")
        publish(spark, version)
        found = committed(spark, path)
    return PipelineModel.load(f"{found}/model")


def stored_info(spark, name: str, include_context: bool = False, **params) -> DataFrame:
    """The metadata row of a stored model."""
    from quarrylens.plans.artifacts import committed

    found = committed(spark, model_path(spark, name, context=include_context, **params))
    if found is None:
        raise ValueError(f"no stored model {name}")
    return spark.read.schema(INFO_SCHEMA).parquet(f"{found}/info")
