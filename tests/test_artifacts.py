"""Stored artifacts: built once, reused, rebuilt when not committed."""

import os
import uuid

import pytest

from quarrylens.plans import artifacts


def test_table_or_build_reuses_committed_and_rebuilds_partial(spark):
    spark.conf.set(artifacts.SCOPE_CONF, f"test-{uuid.uuid4().hex[:8]}")
    try:
        calls = []

        def build():
            calls.append(1)
            return spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")

        a = artifacts.table_or_build(spark, "t", build, x=1)
        b = artifacts.table_or_build(spark, "t", build, x=1)
        assert a.count() == b.count() == 2 and len(calls) == 1
        # different parameters -> a different artifact
        artifacts.table_or_build(spark, "t", build, x=2)
        assert len(calls) == 2
        # a folder without the commit marker is rebuilt
        path = artifacts.artifact_path(spark, "tables", "t", x=1)
        version = artifacts.committed(spark, path)
        os.remove(os.path.join(version.removeprefix("file:"), "_SUCCESS"))
        assert artifacts.committed(spark, path) is None
        artifacts.table_or_build(spark, "t", build, x=1)
        assert len(calls) == 3 and artifacts.committed(spark, path) not in (None, version)
    finally:
        spark.conf.unset(artifacts.SCOPE_CONF)


def test_data_version_changes_with_files(spark, tmp_path):
    d = tmp_path / "sf"
    (d / "nation.parquet").mkdir(parents=True)
    (d / "orders.parquet").write_bytes(b"x")
    (d / "nation.parquet" / "part-0.parquet").write_bytes(b"x")
    for path in (str(d), f"file:{d}"):  # a URI like any store's
        v1 = artifacts.data_version(spark, path, ["orders", "nation"])
        assert artifacts.data_version(spark, path, ["orders", "nation"]) == v1
        (d / "orders.parquet").write_bytes((d / "orders.parquet").read_bytes() + b"y")
        v2 = artifacts.data_version(spark, path, ["orders", "nation"])
        (d / "nation.parquet" / f"part-{len(path)}.parquet").write_bytes(b"x")
        assert len({v1, v2, artifacts.data_version(spark, path, ["orders", "nation"])}) == 3
    with pytest.raises(Exception):
        artifacts.data_version(spark, str(d), ["missing"])


def test_checkpoint_dir_is_never_machine_local_on_a_cluster():
    from types import SimpleNamespace as N

    from quarrylens.session import ensure_checkpoint_dir

    context = N(getCheckpointDir=lambda: None, master="spark://head:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(N(conf=N(get=lambda *a: None), sparkContext=context))
