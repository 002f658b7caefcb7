"""Driver contract: entry runs, every oracle has a query, smoke-run a few."""

import __spark_entry__ as E
from quarrylens_testdata import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["CAL_YR", "injury_count", "prev_count", "absolute_change", "percent_change"]
    assert df.count() == 5


def test_oracles_have_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_some_queries_run_at_small_scale(spark):
    q = E.queries()
    for name in ("trend_count_by_year", "clean_waterfall", "blind_stimuli", "paired_mcnemar",
                 "latency_tokens", "lexical_topk"):
        assert q[name](spark, SF_SMALL).count() > 0, name
