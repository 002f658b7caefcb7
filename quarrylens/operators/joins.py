"""Joins and set operations.

No join here forces a broadcast: the site dimension grows with the data, so
the choice is left to AQE, which broadcasts a side only after measuring it
under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise keeps a
sort-merge join whose skewed partitions it splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_flagged(left: DataFrame, right: DataFrame, key: str,
                      flag: str = "MINE_MATCH") -> DataFrame:
    """Left equi-join keeping every left row, with a match flag.

    ``right`` must be unique on ``key`` (dedup it with ``keep_first``);
    otherwise left rows would multiply.
    """
    marked = right.withColumn("_matched", F.lit(True))
    j = left.join(marked, key, "left")
    return j.withColumn(flag, F.coalesce(F.col("_matched"), F.lit(False))).drop("_matched")


def join_audit(joined: DataFrame, flag: str = "MINE_MATCH") -> DataFrame:
    """Total, matched and unmatched counts in one aggregate."""
    return joined.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.count_if(F.col(flag)).alias("matched_rows"),
                      F.count_if(~F.col(flag)).alias("unmatched_rows"))


def new_rows_only(candidates: DataFrame, existing: DataFrame, keys) -> DataFrame:
    """Rows whose key is not present yet (NOT EXISTS)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return candidates.join(existing.select(*keys), keys, "left_anti")


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of keys present on both sides (0 for a disjoint split)."""
    return (a.select(key).join(b.select(key), key, "left_semi")
            .agg(F.count(F.lit(1)).alias("overlap")))


def attach_key(rows: DataFrame, key_table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows joined to a key table (key-table columns win) plus the rows
    whose key is missing there (the original raised on the first one)."""
    dup = [c for c in rows.columns if c in key_table.columns and c != key]
    joined = rows.drop(*dup).join(key_table, key, "inner")
    missing = rows.join(key_table.select(key), key, "left_anti")
    return joined, missing
