"""Splits and seeded samples.

Every random choice is an md5 of ``key|seed``, so Spark and DuckDB pick the
same rows and a re-run on a re-partitioned input picks the same rows too
(``rand()`` depends on partitioning).

The exact stratified split (P4) avoids a window over whole strata: with a
handful of strata (target codes x year buckets) a per-stratum
``row_number`` would put a third of the table in one task. Instead the
first 20 bits of the hash give a per-stratum histogram (a small aggregate),
a running sum over that histogram finds each stratum's threshold bucket,
and only the rows inside that one boundary bucket are ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import canonical_code, md5_order
from quarrylens.spec import ACCIDENT_SPEC, RANDOM_SEED, TEST_FRACTION, SchemaSpec


def year_bucket(year, spec: SchemaSpec = ACCIDENT_SPEC) -> Column:
    """Label of the bucket a year falls in (edges are exclusive uppers)."""
    y = F.col(year) if isinstance(year, str) else year
    edges, labels = list(spec.bucket_edges), list(spec.bucket_labels)
    expr = F.when(y < edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        expr = expr.when(y < edge, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def stratum_label(spec: SchemaSpec = ACCIDENT_SPEC) -> Column:
    """P2: '<target>_<year bucket>' (the target as stored, like the original)."""
    return F.concat_ws("_", F.col(spec.target).cast("string"), year_bucket(spec.year, spec))


def collapse_rare(labels: DataFrame, min_count: int = 2) -> DataFrame:
    """P3 in closed form over a (label, n) table.

    Stage 1: labels with n < min_count -> '<prefix>_OTHER'. Stage 2: labels
    still rare after stage 1 -> the modal label (largest n, ties by label).
    Returns (label, stratum, n, stage) with stage 0/1/2.
    """
    w_all = Window.partitionBy(F.lit(1))
    has_rare = F.min("n").over(w_all) < min_count
    s1 = labels.withColumn(
        "stratum1", F.when(has_rare & (F.col("n") < min_count),
                           F.concat(F.split("label", "_").getItem(0), F.lit("_OTHER")))
        .otherwise(F.col("label")))
    n1 = s1.groupBy("stratum1").agg(F.sum("n").alias("n1"))
    by_size = (Window.partitionBy(F.lit(1)).orderBy(F.desc("n1"), F.asc("stratum1"))
               .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    j = s1.join(n1, "stratum1").withColumn("modal", F.first("stratum1").over(by_size))
    return j.select(
        "label", "n",
        F.when(F.col("n1") < min_count, F.col("modal")).otherwise(F.col("stratum1")).alias("stratum"),
        F.when(F.col("n1") < min_count, 2).when(F.col("stratum1") != F.col("label"), 1)
        .otherwise(0).alias("stage"))


def strata_quotas(strata: DataFrame, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """Largest-remainder test quotas per stratum summing to ceil(f * N).

    Runs on the per-stratum count table (one row per stratum).
    """
    w_all = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(w_all)
    s = strata.withColumn("total", total).withColumn(
        "n_test", F.ceil(F.lit(test_fraction) * F.col("total")).cast("bigint"))
    s = (s.withColumn("prod", F.col("n") * F.col("n_test"))
         .withColumn("base", F.floor(F.col("prod") / F.col("total")).cast("bigint"))
         .withColumn("rem", F.col("prod") - F.col("base") * F.col("total")))
    left = F.col("n_test") - F.sum("base").over(w_all)
    order = Window.orderBy(F.desc("rem"), F.asc("stratum"))
    s = s.withColumn("extra", F.when(F.row_number().over(order) <= left, 1).otherwise(0))
    return s.select("stratum", "n", (F.col("base") + F.col("extra")).alias("quota"))


def assign_by_hash_quota(df: DataFrame, group: str, quota: DataFrame, key: str,
                         seed: int = RANDOM_SEED, bits: int = 20) -> DataFrame:
    """Mark ``_pick`` = True for the ``quota`` rows of each group with the
    smallest md5(key|seed) (key as tie-break), without ranking whole groups.

    ``quota`` has columns (group, quota). Equivalent to
    ``row_number() OVER (PARTITION BY group ORDER BY md5, key) <= quota``.
    """
    hex_chars = bits // 4
    h = df.withColumn("_h", md5_order(key, F.lit(str(seed)))) \
          .withColumn("_b", F.conv(F.substring("_h", 1, hex_chars), 16, 10).cast("bigint"))
    hist = h.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # per group the one bucket in which the quota runs out, and what it still takes from it
    cut = (hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
           .join(quota.select(group, "quota"), group)
           .where(F.col("_before") + F.col("_cnt") > F.col("quota"))
           .groupBy(group).agg(F.min(F.struct(F.col("_b").alias("cut"), (F.col("quota") - F.col("_before")).alias("need"))).alias("_c")))
    j = h.join(cut.select(group, "_c.cut", "_c.need"), group, "left")
    at_cut = F.coalesce(F.col("_b") == F.col("cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h", key))
    edge = j.where(at_cut).withColumn("_pick", rank <= F.col("need"))
    rest = j.where(~at_cut).withColumn("_pick", F.coalesce(F.col("_b") < F.col("cut"), F.lit(True)))
    return edge.unionByName(rest).drop("_h", "_b", "cut", "need")


def stratified_split(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC,
                     test_fraction: float = TEST_FRACTION, seed: int = RANDOM_SEED,
                     min_count: int = 2) -> DataFrame:
    """Adds ``split`` in {'train','test'} and the collapsed ``stratum``.

    Exactly ceil(f*N) test rows, proportional per stratum (largest
    remainder). The label -> stratum map is one row per distinct label
    (target codes x year buckets), so it is broadcast.
    """
    labelled = df.withColumn("label", stratum_label(spec))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    mapping = collapse_rare(counts, min_count)
    strata = mapping.groupBy("stratum").agg(F.sum("n").alias("n"))
    quotas = strata_quotas(strata, test_fraction)
    with_stratum = labelled.join(F.broadcast(mapping.select("label", "stratum")), "label")
    picked = assign_by_hash_quota(with_stratum, "stratum", quotas, spec.key, seed)
    return picked.withColumn("split", F.when(F.col("_pick"), "test").otherwise("train")) \
                 .drop("_pick", "label")


def split_info(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC, min_count: int = 2) -> DataFrame:
    """A7 + P3 report: strata count and rare labels merged per stage."""
    counts = (df.withColumn("label", stratum_label(spec))
              .groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    m = collapse_rare(counts, min_count)
    return m.agg(F.countDistinct("stratum").alias("strata_count"),
                 F.count_if(F.col("n") < min_count).alias("rare_stage1"),
                 F.countDistinct(F.when(F.col("stage") == 2, F.col("label"))).alias("rare_stage2"),
                 F.count(F.lit(1)).alias("labels"))


def out_of_time(df: DataFrame, spec: SchemaSpec = ACCIDENT_SPEC) -> DataFrame:
    """P5: 'train' up to oot_train_max, 'test' from oot_test_min; others dropped.

    Both bounds are plain year predicates, so a year-partitioned table is
    pruned at the scan.
    """
    y = F.col(spec.year)
    return (df.filter((y <= spec.oot_train_max) | (y >= spec.oot_test_min))
            .withColumn("split", F.when(y <= spec.oot_train_max, "train").otherwise("test")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest md5(key|seed) (TakeOrderedAndProject)."""
    return (df.withColumn("_h", md5_order(key, F.lit(str(seed))))
            .orderBy("_h", key).limit(n).drop("_h"))


def sample_per_category(df: DataFrame, category: str, key: str, n: int, seed: int) -> DataFrame:
    """N rows per category by md5 order. ``row_number() <= n`` plans as a
    WindowGroupLimit, which trims each category map-side before the shuffle."""
    w = Window.partitionBy(category).orderBy("_h", key)
    return (df.withColumn("_h", md5_order(key, F.lit(str(seed))))
            .withColumn("_rank", F.row_number().over(w))
            .filter(F.col("_rank") <= n).drop("_h"))


def pool_shortfall(df: DataFrame, category: str, n: int) -> DataFrame:
    """P7 guard: categories whose pool is smaller than n (empty = fine)."""
    return (df.groupBy(category).agg(F.count(F.lit(1)).alias("pool"))
            .filter(F.col("pool") < n))


def target_canonical(spec: SchemaSpec = ACCIDENT_SPEC) -> Column:
    return canonical_code(spec.target)
