"""Exact top-k, the Jaccard join, components and the pipeline."""

import random

import numpy as np
import pytest
from tests_llm_helpers import CLASH, SF_SMALL, by_id, duck

from pyspark.sql import functions as F
from quarrylens.llm import components, jaccard, vafile


def test_topk_matches_sql(spark):
    got = sorted(tuple(r) for r in vafile.query(spark, SF_SMALL).collect())
    assert got == sorted(duck(vafile.ORACLE, SF_SMALL)) and got


def test_topk_ties_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(vafile, "ROW_BLOCK", 40)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 4) / 1024).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, -1.0, 0.5, 2.0]) for i in range(60)]  # copies of one vector
    rows += [(900, [1.0, -1.0, 0.5, 2.0]), (1, [9.0, 9.0, 9.0, 9.0]), (2000, None), (2001, [1.0, None, 2.0, 3.0]), (2002, []),
             (2003, [float("nan"), 1.0, 1.0, 1.0]), (2004, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (2100, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, code string")
    got = {}
    for r in vafile.top_k(vafile.integer_vectors(table), F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ints = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
            whole[i] = min(whole.get(i, ints), ints)
    for q, v in whole.items():
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v))[:10]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert 2100 not in got  # no other vector of its length
    assert vafile.top_k(vafile.integer_vectors(table.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def _brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        sets[i] = s
    links = {i: {j for j in sets if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


def test_join_matches_sql(spark):
    got = by_id(jaccard.query(spark, SF_SMALL), "class_id", "n_links")
    assert got == {r[0]: (r[1], r[2]) for r in duck(jaccard.ORACLE, SF_SMALL)}


def test_join_large_groups_and_edges(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # many blocks in one cluster
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base[: rng.randint(95, 120)] + [word() for _ in range(rng.randint(0, 12))])) for i in range(90)]
    rows += [(100 + i, " ".join(base)) for i in range(40)]  # exact copies
    rows += [(200 + i, " ".join(word() for _ in range(60))) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "two words"), (304, "Two  WORDS"), (305, "words two")]
    docs = docs_of(rows + [(None, "two words"), (303, "two words")], CLASH)
    assert by_id(jaccard.similarity_classes(docs), "class_id", "n_links") == _brute(rows)
    assert jaccard.similarity_classes(docs_of([])).count() == 0


def test_posterior_bounds():
    """The pruning table against the posterior integrated numerically."""
    least, x = jaccard.least_matches("0.8", 40), np.linspace(0, 1, 200_001)
    for step, m in enumerate(least):
        n = (step + 1) * jaccard.STEP

        def tail(k):
            d = x**k * (1 - x) ** (n - k)
            return d[x >= 0.8].sum() / d.sum()

        assert tail(m) >= jaccard.TOLERANCE * 0.99 and (m == 0 or tail(m - 1) < jaccard.TOLERANCE * 1.01)


@pytest.mark.parametrize("dense", [True, False])
def test_common_shingles(dense):
    rng = np.random.default_rng(1)
    make = lambda: np.unique(rng.integers(0, 900 if dense else 10**6, 300).astype(np.uint64))
    a, b = [make() for _ in range(30)], [make() for _ in range(25)]
    i, j = (x.ravel() for x in np.indices((30, 25)))
    if not dense:
        i, j = i[:3], j[:3]
    assert jaccard.common_shingles(a, b, i, j).tolist() == [len(set(a[x].tolist()) & set(b[y].tolist())) for x, y in zip(i, j)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    rng.shuffle(edges)
    got = {r["node"]: r["least"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: root(n) for n in linked if root(n) != n}
