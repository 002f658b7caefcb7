"""Distributions and the ingestion summary.

Each output is one small aggregate; the summary is a union of
(section, name, value) rows so it can be written as one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import canonical_code
from quarrylens.spec import ACCIDENT_SPEC, SchemaSpec


def class_distribution(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC,
                       split_col: str | None = None) -> DataFrame:
    """A1/A4: count per target code (canonical) + a label, optionally per split.

    The label is ``min`` over non-null labels (deterministic; the original
    took the first one in file order).
    """
    keys = ([split_col] if split_col else []) + [canonical_code(spec.target).alias("code")]
    out = (df.groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n"), F.min(spec.target_label).alias("label")))
    return out.orderBy(*([split_col] if split_col else []), "code")


def year_distribution(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """A2: count per year, ascending."""
    return (df.filter(F.col(spec.year).isNotNull()).groupBy(spec.year)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(spec.year))


def year_range(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """A3: min and max year."""
    return df.agg(F.min(spec.year).alias("min_year"), F.max(spec.year).alias("max_year"))


def ingestion_summary(raw: DataFrame, cleaned: DataFrame, split_df: DataFrame,
                      joined_flag: DataFrame | None, spec: SchemaSpec = ACCIDENT_SPEC,
                      flag: str = "MINE_MATCH") -> DataFrame:
    """A5: (section, name, value) rows: raw/clean counts, split sizes,
    join audit, year range, and class distribution per split.

    Three passes, one per input: a count of the raw rows; one aggregate
    over the cleaned rows (count, year range and - when the cleaned rows
    carry the join flag - matched/unmatched); one ``rollup(split, code)``
    over the split rows, which yields the distribution and the split sizes
    from the same shuffle.
    """
    def rows(df, section, pairs):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(k).alias("name"), v.cast("bigint").alias("value"))
            for k, v in pairs])).alias("r")).select("r.*")

    raw_part = rows(raw.agg(F.count(F.lit(1)).alias("n")), "rows", [("raw", F.col("n"))])
    same = joined_flag is not None and joined_flag is cleaned
    aggs = [F.count(F.lit(1)).alias("n"), F.min(spec.year).alias("a"), F.max(spec.year).alias("b")]
    if same:
        aggs += [F.count_if(F.col(flag)).alias("m"), F.count_if(~F.col(flag)).alias("u")]
    c = cleaned.agg(*aggs)
    parts = [raw_part, rows(c, "rows", [("cleaned", F.col("n"))]),
             rows(c, "years", [("min", F.col("a")), ("max", F.col("b"))])]
    if same:
        parts.append(rows(c, "join", [("matched", F.col("m")), ("unmatched", F.col("u"))]))
    elif joined_flag is not None:
        j = joined_flag.agg(F.count_if(F.col(flag)).alias("m"), F.count_if(~F.col(flag)).alias("u"))
        parts.append(rows(j, "join", [("matched", F.col("m")), ("unmatched", F.col("u"))]))
    r = (split_df.rollup("split", canonical_code(spec.target).alias("code"))
         .agg(F.count(F.lit(1)).cast("bigint").alias("value"), F.grouping_id().alias("_g"))
         .filter(F.col("split").isNotNull() & (F.col("_g") < 3)))
    parts.append(r.select(
        F.when(F.col("_g") == 0, F.concat(F.lit("distribution_"), F.col("split")))
        .otherwise(F.lit("split")).alias("section"),
        F.when(F.col("_g") == 0, F.col("code")).otherwise(F.col("split")).alias("name"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingestion_report(summary: DataFrame, log: DataFrame, cleaned: DataFrame, split_df: DataFrame,
                     spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """A5 whole: the ``ingestion_summary`` with the cleaning log (rows removed
    and codes imputed per step), the strata of the split, and the overall class
    and year distributions, which one pass over the cleaned rows gives."""
    row = lambda section, name, value: F.struct(
        F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("bigint").alias("value"))
    steps = log.select(F.explode(F.array(row("removed", F.col("step"), F.col("rows_removed")), row("imputed", F.col("step"), F.col("rows_imputed")))).alias("r"))
    of = cleaned.select(F.explode(F.array(
        F.struct(F.lit("class").alias("section"), canonical_code(spec.target).alias("name")),
        F.struct(F.lit("year").alias("section"), F.col(spec.year).cast("string").alias("name")))).alias("k"))
    counts = of.where("k.name IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    strata = split_df.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least"))
    strata = strata.select(F.explode(F.array(row("strata", F.lit("number"), F.col("n")), row("strata", F.lit("fewest_rows"), F.col("least")))).alias("r"))
    return (summary.unionByName(steps.select("r.*")).unionByName(strata.select("r.*"))
            .unionByName(counts.select("k.section", "k.name", F.col("n").cast("bigint").alias("value"))))
