"""Circulant MinHash near-dedup against SQL, brute force and edge cases."""

import random

import numpy as np
import pytest
from tests_llm_helpers import CLASH, SF_SMALL, by_id, duck

from quarrylens.llm import circulant


def _brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
    links = {i: {j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), min(seen), min(seen) == i)
    return out


def test_query_matches_sql(spark):
    got = by_id(circulant.query(spark, SF_SMALL), "n_shingles", "component_id", "kept")
    assert got == {r[0]: r[1:] for r in duck(circulant.ORACLE, SF_SMALL)}
    assert any(not r[2] for r in got.values())


@pytest.mark.parametrize("weight,sets", [(1 << 20, 256), (1 << 10, 16), (1, 1)])
def test_large_groups_and_edges(docs_of, monkeypatch, weight, sets):
    """One group for all, some, and as many blocks and stars as can be."""
    monkeypatch.setattr(circulant, "WEIGHT", weight)
    monkeypatch.setattr(circulant, "SETS", sets)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, other = [word() for _ in range(120)], [word() for _ in range(200)]
    rows = [(i, " ".join(base[: rng.randint(95, 120)] + [word() for _ in range(rng.randint(0, 12))])) for i in range(90)]
    rows += [(100 + i, " ".join(base)) for i in range(40)]  # exact copies
    rows += [(200 + i, " ".join(word() for _ in range(60))) for i in range(20)]
    rows += [(400 + i, " ".join(other[i : i + 150])) for i in range(50)]  # a chain: only neighbours are linked
    rows += [(500 + i, " ".join(base[:110] + [word()] * rng.randint(0, 9))) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "two words"), (304, "Two  WORDS"), (305, "words two"), (306, "three little words")]
    docs = docs_of(rows + [(None, "two words"), (303, "two words")], CLASH)
    assert by_id(circulant.near_duplicates(docs), "n_shingles", "component_id", "kept") == _brute(rows)


def test_empty_and_long(docs_of):
    assert circulant.near_duplicates(docs_of([])).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    got = by_id(circulant.near_duplicates(docs_of([(1, long), (2, long + " end"), (3, "w1 w2 w3")])), "n_shingles", "component_id")
    assert got == {1: (149_998, 1), 2: (149_999, 1), 3: (1, 3)}


def test_signature_is_circulant_and_unbiased():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    ys = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(circulant._permuted(ys.copy()))) == len(ys)
    # coordinate k is the k-th shift: one element's coordinates walk backwards through the same permutation
    placed = (circulant._mix64(values[:1] ^ circulant._BASE) >> np.uint64(32)).astype(np.uint32)
    want = [int(circulant._permuted(placed - np.uint32(k))[0]) for k in range(150)]
    assert circulant.signature(values[:1]).tolist() == want
    errors = []
    for common in (400, 850, 950):
        for at in range(0, 1000, 100):
            a = values[at : at + 1000]
            b = np.r_[a[:common], rng.integers(0, 1 << 63, 1000 - common).astype(np.uint64)]
            j = common / (2000 - common)
            errors.append((circulant.signature(a) == circulant.signature(b)).mean() - j)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.15
