"""Merkle manifest against SQL, a plain recomputation, and edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import SF_SMALL, duck

from quarrylens.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, n string, tree string, digest string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def _climb(nodes):
    """All levels of a plain ternary tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, i):
    """(place in the run, the others of the run) per level."""
    for row in levels[:-1]:
        run = row[i // 3 * 3 : i // 3 * 3 + 3]
        yield i % 3, run[: i % 3] + run[i % 3 + 1 :]
        i //= 3


def _brute(rows):
    """One tuple per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in sources}
    grown = {s: _climb([_leaf(r) for r in trees[s]]) for s in sources}
    top = _climb([grown[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            path = [*_path(grown[s], i), *_path(top, k)]
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = _leaf((*r[:4], r[4].replace("\n", "") if odd and r[4] is not None else r[4]))
            for at, others in path:
                node = _h(*others[:at], node, *others[at:])
            root = top[-1][0]
            out.append((r[0], _leaf(r), grown[s][-1][0], root, _h(*(x for _, o in path for x in o)), node, node == root))
    return sorted(out, key=str)


def _query_rows(docs, levels):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = manifest.manifest(docs, F.replace("text", F.lit("\n"), F.lit("")), tampered, levels)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256), "folded_root", "verified").collect()), key=str)


def test_query_matches_sql_and_recount(spark):
    got = sorted((tuple(r) for r in manifest.query(spark, SF_SMALL).collect()), key=str)
    assert got == sorted(duck(manifest.ORACLE, SF_SMALL), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*manifest.FIELDS).collect()]
    assert got == _brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_blocks_of_any_height_and_edges(spark, levels):
    rows = [(i, "big", "en", i, f"line\n{i}") for i in range(90)]  # several superblocks, and superblocks of those
    rows += [(200 + i, f"s{i}", "é", None, "a\nb") for i in range(12)]  # trees of one leaf
    rows += [(300, None, None, None, None), (301, None, "", 0, ""), (302, "", "", 0, ""), (None, "big", "en", 1, "x\ny"), (None, "big", "en", 1, "x\ny"),
             (7, "big", "en", 7, "line\n7"), (7, "big", "en", 7, "another"), (400, "ü", "en", 3, "a\nb"), (401, "long", "en", 1, "w\n" * 300_000)]
    table = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    assert _query_rows(table, levels) == _brute(rows)


def test_empty_table_and_single_row(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = manifest.manifest(spark.createDataFrame([(5, None, None, None, None, *"xxxx")], SCHEMA)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == [] and one["verified"]


def test_proofs_tell_changed_rows(spark):
    """Without a checked text every proof folds to the root; with one, only where it is the same."""
    docs = spark.createDataFrame([(i, "a", "en", i, f"text {i}", *"xxxx") for i in range(20)], SCHEMA)
    plain = manifest.manifest(docs).collect()
    assert all(r["verified"] and manifest.fold(r["leaf"], r["proof"]) == r["root"] for r in plain)
    changed = manifest.manifest(docs, F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text"))).collect()
    assert [r["doc_id"] for r in changed if not r["verified"]] == [3]
