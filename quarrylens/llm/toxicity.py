"""Toxicity: restore disguised words, then score the restored text.

Noisy channel. A disguised word is a lattice: a digit or sign may stand for
a letter ("1d10t"), three or more equal letters for one or two ("looooser"),
and signs or blanks between single letters for nothing ("l.o.s.e.r",
"l o s e r"). Punctuation around a word is no part of it. Viterbi decoding finds the path with the best sum of the channel's
costs and the log-probability under a character trigram model, whose counts
are taken over all documents. A word whose lattice has one path is that path.

Score. A logistic model over the distinct words of the restored text and their
beginnings (4 to 6 letters), so that unseen endings count too, as far as they go with toxic rows (log-
likelihood ratio of at least ``ASSOCIATION``). It learns from
labelled rows whose crc32(doc_id as text) mod 4 is not 2: at most
``SAMPLE_PER_CLASS`` rows of each class, drawn by hash of the doc_id; the
prior is that of all labelled rows it may learn from.

Defined cases: null text is the empty text, scored by the prior; a null doc_id
is not held out and has no label; of repeated labels the highest counts; null
labels are none; without labels of both classes the score is the prior (0
without any) for every text; repeated rows give repeated rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import stored

SAMPLE_PER_CLASS = 2000
FEATURES = 3000
LEAST_ROWS = 3
ASSOCIATION = 8.0
RIDGE = 1e-4
THRESHOLD = 0.3
#: Entries kept of words already looked up, per Python worker.
CACHE = 200_000

# What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: Log-probabilities of the channel: a sign for a letter, a shortened run, a separator that stays.
SIGN, RUN, GAP = -2.0, -1.0, -3.0

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
BREAK, OTHER_LETTER, DIGIT = 0, len(LETTERS) + 1, len(LETTERS) + 2
CLASSES = DIGIT + 1

_WORDS = re.compile(r"[^\W\d_]+").findall
_SIGNS = re.escape("".join(LEET))
#: What may stand for a letter, and what separates letters; no character is both.
_SINGLE, _SEPARATOR = r"(?:[^\W_]|[@$!|+])", r"(?:[^\w\s@$!|+]|_)"
_DISGUISED = re.compile(
    rf"[^\W\d_].*[{_SIGNS}].*[^\W\d_]|^[{_SIGNS}]+[^\W\d_]|[^\W\d_][{_SIGNS}]+$|([^\W\d_])\1\1"
    rf"|^(?:{_SINGLE}{_SEPARATOR}+){{2,}}{_SINGLE}"
).search
_SPACED = re.compile(rf"(?:{_SINGLE}{_SEPARATOR}+){{2,}}{_SINGLE}[@$!|+]*$").match
_is_separator = re.compile(_SEPARATOR).match
_ONE = re.compile(rf"{_SEPARATOR}*(?:[^\W_][\W_]*|[@$!|+]{_SEPARATOR}*)$").match
_RUN = re.compile(b"\x01{3,}").finditer


def _class_of(c: str) -> int:
    if (i := LETTERS.find(c)) >= 0:
        return i + 1
    return OTHER_LETTER if c.isalpha() else DIGIT if c.isdigit() else BREAK


def _class_table() -> np.ndarray:
    return np.array([_class_of(chr(i)) for i in range(0x10000)], dtype=np.int32)


def character_counts(docs: DataFrame) -> DataFrame:
    """(cell, n): trigrams of character classes over all texts; at most
    ``CLASSES`` cubed rows, whatever the input."""
    def each(batches):
        table, total = _class_table(), np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            texts, size = [], 0
            for text in [*batch.column(0).to_pylist(), None]:
                if text is not None:
                    texts.append(text.lower())
                    size += len(text)
                if texts and (text is None or size > 500_000):
                    joined = "  ".join(["", *texts, ""])
                    c = table[np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4"), 0xFFFF)]
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
                    texts, size = [], 0
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells])], names=["cell", "n"])

    counts = docs.select("text").where("text IS NOT NULL").mapInArrow(each, "cell int, n long")
    return counts.groupBy("cell").agg(F.sum("n").alias("n"))


@dataclass
class CharacterModel:
    """log p(class | two classes before), interpolated with shorter contexts."""

    counts: np.ndarray = field(repr=False)

    @cached_property
    def log(self) -> np.ndarray:
        n3 = self.counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 0.5) / (n1 + 0.5).sum()
        p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5)
        return np.log(p3).astype(np.float32)

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The best string through a lattice: per step, strings with their
        channel log-probability. Of equal paths the first listed stays."""
        log, states = self.log, {(BREAK, BREAK): (0.0, ())}
        for options in lattice:
            after: dict = {}
            for (a, b), (score, path) in states.items():
                for text, cost in options:
                    x, y, s = a, b, score + cost
                    for c in text:
                        z = _class_of(c)
                        s += float(log[x, y, z])
                        x, y = y, z
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, (path, text))
            states = after
        _, path = max((s + float(log[x, y, BREAK]), p) for (x, y), (s, p) in states.items())
        out = []
        while path:
            path, text = path
            out.append(text)
        return "".join(reversed(out))


def lattice_of(chunk: str, gaps: bool) -> list[list[tuple[str, float]]]:
    """Steps of a lower-case chunk; ``gaps``: separators may vanish."""
    steps, i = [], 0
    while i < len(chunk):
        c, j = chunk[i], i + 1
        while j < len(chunk) and chunk[j] == c and c.isalpha():
            j += 1
        if j - i > 2:
            steps.append([(c * (j - i), 0.0), (c, RUN), (c + c, RUN)])
        elif c in LEET:
            steps.append([(c, 0.0), *((x, SIGN) for x in LEET[c])])
        elif gaps and not c.isalnum():
            steps.append([("", 0.0), (" ", GAP)])
        else:
            steps.append([(chunk[i:j], 0.0)])
        i = j
    return steps


def core_of(chunk: str) -> str:
    """The chunk without the separators around it."""
    i, j = 0, len(chunk)
    while i < j and _is_separator(chunk[i]):
        i += 1
    while j > i and _is_separator(chunk[j - 1]):
        j -= 1
    return chunk[i:j]


@dataclass
class Restorer:
    """Texts to their restored words, for one character model."""

    model: CharacterModel

    def chunk(self, chunk: str) -> list[str]:
        """The words of a chunk without blanks."""
        low = chunk.lower()
        if not (low[:1].isalnum() and low[-1:].isalnum()):
            low = core_of(low)
        if not _DISGUISED(low):
            return _WORDS(low)
        return _WORDS(self.model.decode(lattice_of(low, bool(_SPACED(low)))))

    def spaced(self, chunks: list[str]) -> list[str]:
        """The words of chunks of one character each, blanks between them."""
        return _WORDS(self.model.decode(lattice_of(core_of(" ".join(chunks).lower()), True)))

    @staticmethod
    def runs(chunks: list[str]):
        """(start, stop) of runs of at least three chunks of one character,
        whatever the punctuation around it."""
        flags = bytes([len(c) == 1 or (not c.isalnum() and _ONE(c) is not None) for c in chunks])
        for run in _RUN(flags):
            yield run.span()

    def words(self, text: str) -> list[str]:
        chunks, out, at = text.split(), [], 0
        for start, stop in self.runs(chunks):
            for c in chunks[at:start]:
                out += self.chunk(c)
            out += self.spaced(chunks[start:stop])
            at = stop
        for c in chunks[at:]:
            out += self.chunk(c)
        return out


def word_features(word: str) -> list[str]:
    """The word, and its beginnings marked with ``*``."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


@dataclass
class ToxicityModel:
    characters: CharacterModel
    weights: dict[str, float]
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        restorer, weights = Restorer(self.characters), self.weights
        known = self.__dict__.setdefault("_known", {})

        def hits(words: list[str]) -> frozenset:
            return frozenset(f for w in words for f in word_features(w) if f in weights)

        out = np.empty(len(texts))
        for n, text in enumerate(texts):
            chunks, found = text.split(), set()
            for start, stop in restorer.runs(chunks):
                found |= hits(restorer.spaced(chunks[start:stop]))
            for c in set(chunks):
                if (h := known.get(c)) is None:
                    if len(known) >= CACHE:
                        known.clear()
                    h = known[c] = hits(restorer.chunk(c))
                if h:
                    found |= h
            out[n] = self.bias + sum(weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(remainder: int = 2, modulus: int = 4):
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the rows that are not held out. What reaches the driver is
    bounded: the trigram cells, and the sample's hits of ``FEATURES`` features."""
    cells = character_counts(docs).collect()
    counts = np.zeros(CLASSES**3, dtype=np.int64)
    for r in cells:
        counts[r["cell"]] = r["n"]
    model = CharacterModel(counts)

    marks = (
        labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    )
    of_class = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = of_class.get(1, 0), of_class.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(model, {}, 500.0 if n1 else -500.0)
    drawn = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for t in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")

    def features(batches):
        restorer = Restorer(model)
        for batch in batches:
            ids, marks, names = [], [], []
            for i, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                found = {f for w in set(restorer.words(text or "")) for f in word_features(w)}
                ids += [i] * len(found)
                marks += [toxic] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(marks, pa.int32()), pa.array(names, pa.string())],
                names=["doc_id", "toxic", "feature"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(sample.mapInArrow(features, f"doc_id {kind}, toxic int, feature string"), "toxicity-features")
    m1, m0 = min(n1, SAMPLE_PER_CLASS), min(n0, SAMPLE_PER_CLASS)
    seen = rows.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    best = (
        seen.where((F.col("a") + F.col("b") >= LEAST_ROWS) & (F.col("a") * m0 > F.col("b") * m1))
        .withColumn("g", _association(F.col("a"), F.col("b"), m1, m0)).where(F.col("g") >= ASSOCIATION)
        .orderBy(F.col("g").desc(), "feature").limit(FEATURES).select("feature")
    )
    hits = rows.join(F.broadcast(best), "feature").groupBy("doc_id", "toxic").agg(F.sort_array(F.collect_list("feature")).alias("f"))
    texts = hits.orderBy("doc_id").collect()
    weights, bias = _logistic([r["f"] for r in texts], [r["toxic"] for r in texts], n1 / m1, n0 / m0, m1, m0)
    return ToxicityModel(model, weights, bias)


def _association(a, b, m1: int, m0: int):
    """Log-likelihood ratio statistic of a feature in a of m1 toxic and b of
    m0 other rows."""
    n, k = m1 + m0, a + b

    def part(seen, expected):
        return F.when(seen > 0, 2.0 * seen * F.log(seen / expected)).otherwise(0.0)

    return part(a, m1 * k / n) + part(b, m0 * k / n) + part(m1 - a, m1 * (n - k) / n) + part(m0 - b, m0 * (n - k) / n)


def _logistic(found: list[list[str]], toxic: list[int], w1: float, w0: float, m1: int, m0: int) -> tuple[dict[str, float], float]:
    """Weighted L2 logistic regression over sets of features, by gradient
    steps scaled per feature (Adam); sampled rows without any feature count through the bias."""
    names = sorted({f for fs in found for f in fs})
    index = {f: i for i, f in enumerate(names)}
    y = np.array(toxic + [1] * (m1 - sum(toxic)) + [0] * (m0 - (len(toxic) - sum(toxic))), dtype=np.float32)
    x = np.zeros((len(y), len(names)), dtype=np.float32)
    for i, fs in enumerate(found):
        x[i, [index[f] for f in fs]] = 1
    weight = np.where(y == 1, w1, w0).astype(np.float32)
    weight /= weight.sum()
    share = float(weight[y == 1].sum())
    w = np.zeros(len(names) + 1, np.float32)  # the last is the bias
    w[-1] = np.log(share / (1 - share))
    x = np.hstack([x, np.ones((len(y), 1), np.float32)])
    ridge = np.r_[np.full(len(names), RIDGE, np.float32), np.float32(0)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 301):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y)) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    b = float(w[-1])
    return {f: float(w[i]) for f, i in index.items()}, b


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with ``score`` (0 to 1)
    and ``predicted``."""
    own = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*own).dtypes) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES and CLASSES
    text = own.index("text") if "text" in own else len(own)

    def each(batches):
        model = shared.value
        for batch in batches:
            p = np.concatenate([np.zeros(0), *(
                model.score([t or "" for t in batch.column(text).slice(at, 256).to_pylist()]) for at in range(0, batch.num_rows, 256))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(own)], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*own, "score", "predicted"])

    given = docs.select(*own) if "text" in own else docs.select(*own, "text")
    return given.mapInArrow(each, schema)


def restore(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, restored): the restored words of each text, blanks between."""
    kind, shared = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(model.characters)

    def each(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            out = [" ".join(restorer.words(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, restored string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
