"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import ensure_checkpoint_dir


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once per row, however often
    ``then`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder in ``spark.checkpoint.dir``
    and read it back: later jobs re-read it, also after a lost executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
