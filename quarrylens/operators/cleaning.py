"""Rule-ordered cleaning with an audit log.

The original applies eight rules one after another, counting survivors after
each. Here every row is tagged once with the index of the *first* rule it
fails; the kept rows are the untagged ones and the waterfall log comes from
``groupBy(rule).count()`` plus a running sum over the (tiny) per-rule table.
One scan produces both, and nothing is collected to the driver.

Duplicate detection uses ``groupBy(key).count()`` (partial aggregation, so a
hot key is combined map-side) joined back, not a window over the key: a key
holding a third of all rows would otherwise land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.text import canonical_code, clean_string, invalid_code, strip_ws
from quarrylens.spec import ACCIDENT_SPEC, SchemaSpec


def normalise_strings(df: DataFrame) -> DataFrame:
    """Strip + quote-strip + NA tokens -> null on every string column."""
    return df.select(*[
        clean_string(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f.name) for f in df.schema.fields])


def year_value(c) -> Column:
    """Numeric coercion of a year column (bad text -> null)."""
    return F.expr(f"try_cast(`{c}` AS double)") if isinstance(c, str) else c.try_cast("double")


def rule_list(spec: SchemaSpec) -> list[tuple[str, Column]]:
    """Ordered (step name, fails-predicate). Duplicates are handled separately."""
    rules: list[tuple[str, Column]] = []
    for c in (spec.key, spec.mine_key):
        rules.append((f"drop_missing_{c.lower()}", invalid_code(c)))
    rules.append((f"drop_invalid_{spec.target.lower()}", invalid_code(spec.target)))
    y = year_value(spec.year)
    rules.append((f"drop_calendar_year_before_{spec.min_year}", y.isNull() | (y < spec.min_year)))
    for c in spec.core_features:
        rules.append((f"drop_invalid_{c.lower()}", invalid_code(c)))
    rules.append(("impute_missing_equipment_as_UNK", None))
    rules.append(("drop_missing_narrative", invalid_code(spec.text)))
    rules.append((f"drop_excluded_{spec.target.lower()}_for_classifier",
                  F.coalesce(F.col(spec.target).isin(*spec.excluded_codes), F.lit(False))))
    return rules


DUP_STEP = "drop_duplicate_key"


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys seen more than once, with their copy count (map-side combined)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
            .filter(F.col("_copies") > 1))


def tag_rules(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """Add ``_rule`` (1-based index of the first failing rule, null = kept),
    ``_copies`` (copies of a duplicated key) and ``_equip_invalid``.

    Rule 1 drops *every* copy of a duplicated key (the original behaviour).
    The row-local rules are evaluated before the duplicate-key join, so a
    caller that needs only the tags (waterfall, summaries) lets Catalyst
    prune wide columns such as the narrative before that shuffle.
    """
    tag = None
    for i, (_, pred) in enumerate(rule_list(spec), start=2):
        if pred is not None:
            tag = F.when(pred, F.lit(i)) if tag is None else tag.when(pred, F.lit(i))
    rows = (df.withColumn("_row_rule", tag)
            .withColumn("_equip_invalid", invalid_code(spec.equipment)))
    dups = duplicate_keys(df, spec.key).withColumnRenamed(spec.key, "_dup_key")
    j = rows.join(dups, F.col(spec.key).eqNullSafe(F.col("_dup_key")), "left").drop("_dup_key")
    rule = F.when(F.col("_copies").isNotNull(), F.lit(1)).otherwise(F.col("_row_rule"))
    return j.withColumn("_rule", rule).drop("_row_rule")


def step_names(spec: SchemaSpec) -> list[str]:
    return [DUP_STEP] + [name for name, _ in rule_list(spec)]


def waterfall(tagged: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """(step_no, step, rows_before, rows_after, rows_removed, rows_imputed).

    step 0 is ``raw_loaded``. The duplicate step is listed only when it
    removes rows (as in the original). ``rows_removed`` is the true drop
    (all copies), and ``dup_surplus`` keeps the original's surplus count.
    """
    names = step_names(spec)
    impute_no = names.index("impute_missing_equipment_as_UNK") + 1
    per_rule = (tagged.groupBy(F.coalesce("_rule", F.lit(0)).alias("step_no"))
                .agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("_equip_invalid")).alias("n_equip"),
                     F.sum(F.when(F.col("_rule") == 1, F.lit(1) / F.col("_copies")))
                     .alias("key_share")))
    spark = tagged.sparkSession
    steps = spark.createDataFrame([(i, n) for i, n in enumerate(["raw_loaded"] + names)],
                                  "step_no int, step string")
    j = steps.join(per_rule, "step_no", "left").fillna(0, ["n", "n_equip"])
    w_all = Window.orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_upto = Window.orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(w_all)
    removed = F.when(F.col("step_no") == 0, F.lit(0)).otherwise(F.col("n"))
    # Kept rows (rule 0) are counted in "n" of step 0; dropped-at-or-before.
    dropped_upto = F.sum(F.when(F.col("step_no") == 0, 0).otherwise(F.col("n"))).over(w_upto)
    # Rows still kept when the impute step runs that have an invalid code.
    imputed = F.sum(F.when((F.col("step_no") == 0) | (F.col("step_no") > impute_no),
                           F.col("n_equip")).otherwise(0)).over(w_all)
    out = (j.withColumn("total", total)
           .withColumn("rows_removed", removed.cast("bigint"))
           .withColumn("rows_after", (F.col("total") - dropped_upto).cast("bigint"))
           .withColumn("rows_before", F.when(F.col("step_no") == 0, F.lit(0))
                       .otherwise(F.col("rows_after") + F.col("rows_removed")).cast("bigint"))
           .withColumn("rows_after", F.when(F.col("step_no") == 0, F.col("total"))
                       .otherwise(F.col("rows_after")).cast("bigint"))
           .withColumn("rows_imputed", F.when(F.col("step_no") == impute_no, imputed)
                       .cast("bigint"))
           .withColumn("dup_surplus", F.when(F.col("step_no") == 1,
                                            F.col("n") - F.round(F.col("key_share")))
                       .cast("bigint")))
    out = out.filter(~((F.col("step_no") == 1) & (F.col("rows_removed") == 0)))
    return out.select("step_no", "step", "rows_before", "rows_after", "rows_removed",
                      "rows_imputed", "dup_surplus")


def finalise(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """C11: date parse (formats tried in order, bad -> null), year to int,
    optional numeric columns coerced (bad -> null)."""
    out = df
    if spec.date in df.columns and isinstance(df.schema[spec.date].dataType, T.StringType):
        parsed = F.coalesce(*[F.try_to_timestamp(F.col(spec.date), F.lit(fmt))
                              for fmt in spec.date_formats])
        out = out.withColumn(spec.date, parsed)
    out = out.withColumn(spec.year, year_value(spec.year).cast("int"))
    for c in spec.numeric_columns:
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("string").try_cast("double"))
    return out


def clean(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """Rows that pass every rule, equipment imputed, types final.

    Each rule is a filter of its own, so that those on the columns of one input
    are applied before that input is joined or shuffled; a narrative travels
    only with rows that pass the others. Copies are counted over all rows."""
    kept = df
    for _, pred in rule_list(spec):
        if pred is not None:
            kept = kept.filter(~pred)
    kept = drop_keys(kept, duplicate_keys(df, spec.key), spec.key)
    kept = kept.withColumn(spec.equipment, F.when(invalid_code(spec.equipment), F.lit("UNK"))
                           .otherwise(F.col(spec.equipment)))
    return finalise(kept, spec)


def impute_sentinel(df: DataFrame, column: str, sentinel: str = "UNK") -> DataFrame:
    """C7 on its own: invalid code -> sentinel, plus a flag column."""
    bad = invalid_code(column)
    return df.withColumn(f"{column}_imputed", bad).withColumn(
        column, F.when(bad, F.lit(sentinel)).otherwise(F.col(column)))


def drop_duplicates_all(df: DataFrame, key: str) -> DataFrame:
    """C2 (mode drop_all): keep only keys that occur exactly once.

    ``left_anti`` against the duplicated-key table: both sides are keyed by
    ``key``; AQE splits a skewed left partition.
    """
    return drop_keys(df, duplicate_keys(df, key), key)


def drop_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``; columns keep their order."""
    return df.join(keys.select(key), key, "left_anti").select(*df.columns)


def keep_first(df: DataFrame, key: str, order_cols: list[str],
               keep_cols: list[str] | None = None) -> DataFrame:
    """One row per key, the smallest by ``order_cols`` (explicit order,
    since files have no row order in Spark).

    ``min(struct(order..., rest...))`` is an ordinary aggregate, so Spark
    combines map-side and a hot key never gathers its rows in one task.
    """
    rest = [c for c in (keep_cols or df.columns) if c != key and c not in order_cols]
    packed = F.min(F.struct(*[F.col(c) for c in order_cols + rest])).alias("_r")
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(packed)
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in order_cols + rest])


def invalid_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, invalid count and share (one aggregate pass)."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(invalid_code(c)).alias(f"_bad_{i}") for i, c in enumerate(columns)]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_bad_{i}").alias("n_invalid"))
        for i, c in enumerate(columns)])).alias("r")
    return one.select("_n", rows).select(
        "r.column_name", "r.n_invalid",
        F.round(F.col("r.n_invalid") / F.col("_n"), 6).alias("share_invalid"))


def target_code(spec: SchemaSpec = ACCIDENT_SPEC) -> Column:
    return canonical_code(spec.target)


__all__ = ["normalise_strings", "tag_rules", "waterfall", "clean", "finalise", "impute_sentinel",
           "drop_duplicates_all", "keep_first", "invalid_profile", "strip_ws"]
