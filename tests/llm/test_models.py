"""Toxicity and LM scoring: rules, edges, held-out quality."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tests_llm_helpers import CLASH, by_id

from quarrylens.llm import gated_lm, toxicity

SF = "/root/testdata/sf0.01"


def _characters(texts):
    table, total = toxicity._class_table(), np.zeros(toxicity.CLASSES**3, np.int64)
    for t in texts:
        c = table[np.frombuffer(f"  {t.lower()}  ".encode("utf-32-le"), "<u4")].astype(np.int64)
        np.add.at(total, (c[:-2] * toxicity.CLASSES + c[1:-1]) * toxicity.CLASSES + c[2:], 1)
    return toxicity.CharacterModel(total)


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(_characters(["the idiot and the loser were here", "worthless trash", "stupid moron clown", "scum of the hill"] * 5))


def test_disguised_words_are_restored(restorer):
    assert restorer.words("an 1d10t and a l0ser") == ["an", "idiot", "and", "a", "loser"]
    assert restorer.words("looooser!!! you m0r0n") == ["loser", "you", "moron"]
    assert restorer.words("l o s e r and s.c.u.m") == ["loser", "and", "scum"]
    assert restorer.words("w0rthl3ss tra5h") == ["worthless", "trash"]


@pytest.mark.parametrize("disguise", ["l.o.s.e.r", "l-o-s-e-r", "l_o_s_e_r", "l/o/s/e/r", "l..o..s..e..r", "l.-o.-s.-e.-r",
                                      "l,o,s,e,r", "l o s e r", "l. o. s. e. r", "l0ser", "10$er", "1os3r", "looooser"])
@pytest.mark.parametrize("around", ["{}", "{}.", "{}, and", "{}!", "({})", '"{}"', "\u201c{}\u201d;", "['{}'].", "what, {}?"])
def test_disguises_within_punctuation_are_restored(restorer, disguise, around):
    assert "loser" in restorer.words(around.format(disguise))


def test_signs_at_the_edge_of_a_word_are_restored():
    restorer = toxicity.Restorer(_characters(["scum of the los angeles hill"] * 20))
    assert restorer.words('"5cum" (l0$) \'l0$,') == ["scum", "los", "los"]
    assert len(restorer.words("!" * 5_000 + "." * 5_000 + "a" + "-!" * 5_000)) <= 1  # no backtracking


def test_plain_words_stay(restorer):
    text = "The hill, 24 items (4th) of 108.51.216.133: all good! It's fine"
    assert restorer.words(text)[:3] == ["the", "hill", "items"]
    assert [w for w in restorer.words("all good hills") if w] == ["all", "good", "hills"]
    assert restorer.words("") == [] and len(restorer.words("a" * 30_000)) == 1


def test_decode_is_the_best_path(restorer):
    """Viterbi against all paths of a small lattice."""
    from itertools import product

    model, lattice = restorer.model, toxicity.lattice_of("1d10t", False)
    def total(path):
        classes = [0, 0, *(toxicity._class_of(c) for c in "".join(t for t, _ in path)), 0]
        return sum(c for _, c in path) + sum(float(model.log[classes[i - 2], classes[i - 1], classes[i]]) for i in range(2, len(classes)))
    best = max(product(*lattice), key=total)
    assert model.decode(lattice) == "".join(t for t, _ in best)


def test_toxicity_query_on_held_out_rows(spark):
    got = by_id(toxicity.query(spark, SF.replace("0.01", "0.1")), "held_out", "score", "predicted")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(SF.replace("0.01", "0.1") + "/labels.parquet").collect()}
    assert len(got) == 10_000 and all(g[0] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, g in got.items())
    assert all(0 <= g[1] <= 1 and g[2] == (g[1] >= 0.3) for g in got.values())
    held = [(got[i][2], t) for i, t in labels.items() if got[i][0]]
    found = sum(p for p, t in held if t) / sum(t for _, t in held)
    wrong = sum(p for p, t in held if not t) / sum(1 - t for _, t in held)
    assert found > 0.85 and wrong < 0.02


def test_toxicity_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "what an idiot"), (None, "idiot"), (3, "what an idiot")], [c for c in CLASH if c not in ("score", "predicted")] + ["score"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert {r["score"] < 1e-100 for r in toxicity.score(docs, model).collect()} == {True}
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [(i, "a calm text" if n % 2 else "such an idiot here") for n, i in enumerate(train)]
    labels = spark.createDataFrame([(i, 1 - n % 2) for n, i in enumerate(train)] + [(train[0], 1), (train[1], None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(texts), labels)
    got = [(r["doc_id"], r["predicted"], r["score"]) for r in toxicity.score(docs, model).collect()]
    assert sorted(i for i, _, _ in got if i is not None) == [1, 2, 3, 3] and len(got) == 5
    scores = {i: s for i, _, s in got}
    assert scores[1] == scores[2] < scores[3]  # empty texts have the prior's score
    assert all(p == (s >= 0.3) for _, p, s in got) and all(p == 1 for i, p, _ in got if i in (3, None))
    assert toxicity.score(docs_of([]), model).count() == 0
    assert {r["doc_id"]: r["restored"] for r in toxicity.restore(docs_of([(1, "1d10t"), (2, None)]), model).collect()}[2] == ""


def _base(docs):
    counts = Counter()
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    for i, ts in tokens.items():
        if not held[i]:
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    out = {i: (held[i], len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
           for i, ts in tokens.items()}
    return out, counts


def test_lm_query_base_counts_and_quality(spark):
    got = by_id(gated_lm.query(spark, SF), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = _base(docs)
    assert {i: g[:4] for i, g in got.items()} == {i: w[:4] for i, w in want.items()}
    assert all(abs(got[i][4] - want[i][4]) < 1e-6 * max(1, abs(want[i][4])) for i in want)
    held = [g for g in got.values() if g[0]]
    assert sum(g[5] for g in held) > sum(g[4] for g in held)  # better than the unigram base on held-out rows


def test_lm_small_table_joins_the_rest(spark, monkeypatch, docs_of):
    monkeypatch.setattr(gated_lm, "TABLE", 40)
    monkeypatch.setattr(gated_lm, "CLASSES", 3)
    monkeypatch.setattr(gated_lm, "PER_CLASS", 4)
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 60))) for i in range(80)] + [(500, None), (501, ""), (502, "never seen Words")]
    docs = docs_of(rows, CLASH)
    training = docs.where(~gated_lm.held_out())
    counts = gated_lm.stored(gated_lm.token_counts(training), "counts")
    v = gated_lm.vocabulary(counts)
    got = by_id(gated_lm.score(docs, counts, v, None), "n_tokens", "n_known", "base_score", "score")
    want, seen = _base(rows)
    for i, w in want.items():
        assert got[i][:2] == w[1:3] and abs(got[i][2] - w[4]) < 1e-6
    # the untrained model is the unigram base, up to one unseen token per group
    share = (v.total + 0.5 * (v.distinct + 1)) / (v.total + 0.5 * (v.distinct + gated_lm.GROUPS))
    assert all(abs(got[i][3] - (want[i][4] + want[i][1] * math.log10(share))) < 1e-3 * want[i][1] for i in want)


def test_lm_state_is_carried_over_windows(monkeypatch):
    v = gated_lm.Vocabulary([b"", b"a", b"b"], np.array([9, 5, 4]), np.full(gated_lm.GROUPS, 0.5), 18, 3, 3)
    model = gated_lm.GatedModel(v)
    model.flat[:] = np.random.default_rng(1).normal(0, 0.3, len(model.flat))
    docs = [np.random.default_rng(n).integers(0, 3, n).astype(np.int32) for n in (3, 200, 47, 48, 49, 1, 120)]
    whole = gated_lm.log_likelihoods(model, docs)
    monkeypatch.setattr(gated_lm, "SCORE_WINDOW", 7)
    monkeypatch.setattr(gated_lm, "SCORE_LANES", 2)
    assert np.allclose(whole, gated_lm.log_likelihoods(model, docs), rtol=1e-4)
    assert np.allclose(whole, [gated_lm.log_likelihoods(model, [d])[0] for d in docs], rtol=1e-4)


def test_lm_probabilities_sum_to_one_and_gradients():
    v = gated_lm.Vocabulary([f"w{i}".encode() for i in range(12)], np.arange(30, 18, -1), np.full(gated_lm.GROUPS, 3.0), 500, 20, 12)
    model, rng = gated_lm.GatedModel(v), np.random.default_rng(0)
    model.flat[:] = rng.normal(0, 0.3, len(model.flat))
    k = v.frequent + gated_lm.GROUPS
    h = np.repeat(rng.normal(0, 1, (1, gated_lm.HIDDEN)).astype(np.float32), k, axis=0)
    own = np.exp(model.log_prob(h, np.arange(k))[0])
    padding = 1 - own.sum()  # classes have PER_CLASS places, of which the vocabulary fills the first
    assert -1e-4 < padding < 1
    x, y = rng.integers(0, k, (5, 3)).astype(np.int32), rng.integers(0, k, (5, 3)).astype(np.int32)
    resets, state = rng.random((5, 3)) < 0.2, rng.normal(0, 0.5, (3, gated_lm.HIDDEN)).astype(np.float32)

    def loss():
        return -model.log_prob(model.states(x, resets, state).reshape(-1, gated_lm.HIDDEN), y.ravel())[0].astype(np.float64).mean()

    before = model.flat.copy()
    model.learn_window(x, y, resets, state, 15)
    grad = model.grad.copy()
    model.flat[:] = before
    for j in rng.choice(np.flatnonzero(np.abs(grad) > 1e-3), 40):
        model.flat[j] = before[j] + 1e-2
        up = loss()
        model.flat[j] = before[j] - 1e-2
        down = loss()
        model.flat[j] = before[j]
        assert abs((up - down) / 2e-2 - grad[j]) < 2e-3 + 0.06 * abs(grad[j])


def _plain_forward(model, v, symbols):
    """ln P of one document, symbol by symbol, in plain Python floats."""
    p = {k: x.astype(float).tolist() for k, x in model.p.items()}
    size, k = gated_lm.HIDDEN, v.frequent
    sig = lambda a: 1 / (1 + math.exp(-a))
    log_share = lambda a, at: a[at] - math.log(sum(map(math.exp, a)))
    h, total, x = [0.0] * size, 0.0, model.start
    for y in symbols:
        e = p["x"][x]
        a = [sum(h[i] * p["u"][i][j] for i in range(size)) for j in range(3 * size)]
        z = [sig(e[j] + a[j]) for j in range(size)]
        r = [sig(e[size + j] + a[size + j]) for j in range(size)]
        n = [math.tanh(e[2 * size + j] + r[j] * a[2 * size + j]) for j in range(size)]
        h = [(1 - z[j]) * h[j] + z[j] * n[j] for j in range(size)]
        cls = y // gated_lm.PER_CLASS if y < k else gated_lm.CLASSES + y - k
        total += log_share([sum(h[i] * p["c"][i][j] for i in range(size)) + p["cb"][j] for j in range(len(p["cb"]))], cls)
        if y < k:
            inner = [sum(h[i] * p["w"][cls][j][i] for i in range(size)) + p["wb"][cls][j] for j in range(gated_lm.PER_CLASS)]
            total += log_share(inner, y % gated_lm.PER_CLASS)
        x = y
    return total


def test_lm_forward_pass_in_plain_python():
    v = gated_lm.Vocabulary([f"w{i}".encode() for i in range(40)], np.arange(90, 50, -1), np.full(gated_lm.GROUPS, 3.0), 5000, 90, 40)
    model, rng = gated_lm.GatedModel(v), np.random.default_rng(3)
    model.flat[:] = rng.normal(0, 0.4, len(model.flat))
    docs = [rng.integers(0, 40 + gated_lm.GROUPS, n).astype(np.int32) for n in (1, 2, 30, 70)]
    assert np.allclose(gated_lm.log_likelihoods(model, docs), [_plain_forward(model, v, d.tolist()) for d in docs], rtol=1e-4)


def _scored(spark, docs):
    counts = gated_lm.stored(gated_lm.token_counts(docs.where(~gated_lm.held_out())), "counts")
    v = gated_lm.vocabulary(counts)
    coded = gated_lm.stored(gated_lm.encode(docs, v), "symbols")
    flat = gated_lm.fit(coded.where(~gated_lm.held_out()), v)
    return by_id(gated_lm.score_encoded(coded, counts, v, flat), "n_tokens", "n_known", "base_score", "score")


def test_lm_without_training_rows_and_empty(spark, docs_of):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    rows = list(zip(held, ["some words", "", None, "x " * 3000, "some words"]))
    got = _scored(spark, docs_of(rows))
    for i, text in rows:
        # every token is unseen: (0 + 0.5) / (0 + 0.5 * (0 + 1)) = 1
        assert got[i][:2] == (len((text or "").split()) + 1, 0) and abs(got[i][2]) < 1e-9 and math.isfinite(got[i][3])
    assert _scored(spark, docs_of([])) == {}


def test_lm_long_documents_and_null_ids(spark, docs_of):
    """A text longer than a training segment scores as its windows in a row do; a null id is not held out."""
    base = " ".join(f"w{(7 * k) % 31}" for k in range(gated_lm.SEGMENT + 500))
    rows = [(i, base if i % 3 else f"short text {i}") for i in range(30)] + [(None, "no id here")]
    docs = docs_of(rows, CLASH)
    assert docs.where(gated_lm.held_out()).where("doc_id IS NULL").count() == 0
    got = _scored(spark, docs)
    want, _ = _base([(i, t) for i, t in rows if i is not None])
    long = [i for i, _ in rows if i is not None and i % 3]
    assert all(got[i][0] == gated_lm.SEGMENT + 501 for i in long) and got[None][0] == 4
    assert len({round(got[i][3], 3) for i in long}) == 1 and got[long[0]][3] > got[long[0]][2]
