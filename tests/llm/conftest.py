import os
import sys

import pytest
from pyspark.sql import types as T

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(os.path.dirname(HERE))]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with extra string columns."""
    def make(rows, extra=()):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               *[T.StructField(c, T.StringType()) for c in extra]])
        return spark.createDataFrame([(i, t, *["x"] * len(extra)) for i, t in rows], schema)

    return make
