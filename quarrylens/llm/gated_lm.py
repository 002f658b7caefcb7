"""LM scoring: a gated recurrent language model over whole documents.

Tokens are words between white space (ASCII), A-Z in lower case, and one end
per document. Token counts over all training documents give the unigram base
score, and the model's vocabulary: the most frequent tokens, in classes of
like frequency, and a class per group of all other tokens (by their last two
letters). The output softmax is factored by class: P(class | state) times, for
a frequent token, P(token | class, state), and for another one its smoothed
share (c + 0.5) of its group's counts, an unseen token counting as one with
c = 0. Output biases start at the log shares, so the untrained model is the
unigram base, and training adds what the state tells.

The state comes from a gated recurrent unit in numpy, trained by truncated
backpropagation through ``WINDOW`` steps: documents run side by side in lanes,
and a lane's state is carried from window to window, in scoring up to the
document's end, in training up to ``SEGMENT`` tokens. A first model is fitted on ``WARM_DOCS`` documents
drawn by hash; from it every task trains on all training documents of its
partition, and Spark averages the tasks' parameters, weighted by their tokens,
so the model depends, if little, on how the rows are dealt out to tasks.

Texts are cut and looked up once: every document is stored as the symbols that
the model knows, its known tokens' base score and its tokens beyond the table;
training and scoring read symbols only.

Tokens beyond the ``TABLE`` most frequent are looked up by a join with the
counts, so nothing that grows with the vocabulary is broadcast or collected.

Defined cases: null text is the empty text, one end token; a null doc_id is
not held out; rows that repeat a doc_id each learn and are scored; without
training documents every token counts as unseen; extra columns are ignored.
Every unseen token gets the whole unseen share of its group, so ``score`` is
no distribution over texts with unseen words (nor is the base score).
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import stored

HIDDEN, CLASSES, PER_CLASS, GROUPS = 16, 24, 32, 48
TABLE = 1 << 17
WARM_DOCS = 600
WINDOW, LANES = 16, 256
SCORE_WINDOW, SCORE_LANES = 48, 256
RATE, WARM_STEPS = 0.1, 10
#: Tokens that one lane learns in one go; longer documents learn in several lanes.
SEGMENT = 2048
#: Tokens per block of documents that run together; distinct tokens kept per count flush and word cache.
BLOCK, FLUSH, CACHE = 6_000_000, 400_000, 500_000
END = ""


def held_out(remainder: int = 1, modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Tokens but for the end: bytes.lower() changes A-Z only, and
    bytes.split() cuts at the blank and 0x09 to 0x0D only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over the texts of ``docs``; the end is the empty token."""
    def each(batches):
        seen: Counter = Counter()

        def rows():
            names = pa.array([t.decode("utf-8") for t in seen], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                seen.update(words)
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select("text").mapInArrow(each, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def group_of(token: Column) -> Column:
    """The group of an infrequent token."""
    core = F.rtrim(token, F.lit(".,;:!?"))
    return F.pmod(F.crc32(F.right(core, F.lit(2)).cast("binary")), F.lit(GROUPS)).cast("int")


def _group(token: bytes) -> int:
    return zlib.crc32(token.decode("utf-8").rstrip(".,;:!?")[-2:].encode()) % GROUPS


@dataclass
class Vocabulary:
    """What every task needs of the counts: at most ``TABLE`` + 1 of the most
    frequent tokens, most frequent first, and totals per group."""

    table: list[bytes]
    counts: np.ndarray
    group_mass: np.ndarray  # per group: counts + 0.5 of its tokens beyond the frequent ones, + 0.5
    total: int  # N
    distinct: int  # V
    frequent: int  # the first so many of the table are symbols of the model

    def without_table(self) -> "Vocabulary":
        """What the model itself needs."""
        return Vocabulary([], self.counts[: self.frequent], self.group_mass, self.total, self.distinct, self.frequent)

    def prepared(self) -> "Codes":
        if "_codes" not in self.__dict__:
            self.__dict__["_codes"] = Codes(self)
        return self.__dict__["_codes"]


class Codes(dict):
    """Token to code: its place in the table, or the table's size plus its
    group. ``symbol`` and ``log10`` map codes to model symbols and to
    log10(c + 0.5), 0 beyond the table."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__((t, i) for i, t in enumerate(v.table))
        self.base, self.size = dict(self), len(v.table)
        groups = [v.frequent + _group(t) for t in v.table[v.frequent :]]
        self.symbol = np.array([*range(v.frequent), *groups, *range(v.frequent, v.frequent + GROUPS)], np.int32)
        self.log10 = np.r_[np.log10(v.counts + 0.5), np.zeros(GROUPS)]
        #: what the end adds where no document taught it: it is looked up nowhere else
        self.end = 0.0 if b"" in self.base else float(np.log10(0.5))

    def __missing__(self, token: bytes) -> int:
        if len(self) > self.size + CACHE:
            self.clear()
            self.update(self.base)
        code = self[token] = self.size + _group(token)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        """Codes of a document's tokens, the end among them."""
        return np.fromiter(map(self.__getitem__, [*words, b""]), np.int32, len(words) + 1)


def _table_cut(counts: DataFrame) -> int:
    """The least count c, at the edge of an eighth of an octave, with at most
    ``TABLE`` tokens that frequent; the driver sees one number per eighth."""
    eighth = F.floor(8 * F.log2(F.col("c").cast("double"))).cast("int")
    cut, held = 1 << 62, 0
    for r in sorted(counts.groupBy(eighth.alias("e")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), reverse=True):
        held += r["n"]
        if held > TABLE:
            break
        cut = r["least"]
    return cut


def vocabulary(counts: DataFrame) -> Vocabulary:
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.where((F.col("c") >= _table_cut(counts)) | (F.col("token") == END)).collect()  # at most TABLE + 1
    top.sort(key=lambda r: (r["token"] != END, -r["c"], r["token"]))
    table, c = [r["token"].encode() for r in top], np.array([r["c"] for r in top], np.int64)
    order = np.argsort(-c, kind="stable")
    if len(order):  # the end is always among the frequent ones
        end = table.index(b"")
        head = [end, *(i for i in order[: CLASSES * PER_CLASS].tolist() if i != end)][: CLASSES * PER_CLASS]
        head = sorted(head, key=lambda i: (-int(c[i]), i))
        inside = set(head)
        order = np.array(head + [i for i in order.tolist() if i not in inside])
    table, c = [table[i] for i in order], c[order] if len(order) else c
    frequent = min(CLASSES * PER_CLASS, len(table))
    mass = np.full(GROUPS, 0.5)
    for r in counts.groupBy(group_of(F.col("token")).alias("g")).agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("m")).collect():
        mass[r["g"]] += r["m"]
    for t, n in zip(table[:frequent], c[:frequent].tolist()):
        mass[_group(t)] -= n + 0.5
    return Vocabulary(table, c, mass, int(totals["n"] or 0), int(totals["v"]), frequent)


class GatedModel:
    """Parameters in one flat vector, and the passes over lanes."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None) -> None:
        h, k = HIDDEN, v.frequent
        self.symbols, self.start = k, k + GROUPS
        shapes = {"x": (k + GROUPS + 1, 3 * h), "u": (h, 3 * h),
                  "c": (h, CLASSES + GROUPS), "cb": (CLASSES + GROUPS,), "w": (CLASSES, PER_CLASS, h), "wb": (CLASSES, PER_CLASS)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat.astype(np.float32)
        self.grad = np.zeros_like(self.flat)
        self.square = np.full_like(self.flat, 1e-6)
        self.steps = 0
        self.p = {n: part.reshape(s) for (n, s), part in zip(shapes.items(), np.split(self.flat, ends[:-1]))}
        self.g = {n: part.reshape(s) for (n, s), part in zip(shapes.items(), np.split(self.grad, ends[:-1]))}
        # classes: frequent symbols in order of frequency, PER_CLASS each; then one per group
        symbol = np.arange(k + GROUPS)
        self.cls = np.where(symbol < k, symbol // PER_CLASS, CLASSES + symbol - k).astype(np.int16)  # short: sorted by radix
        self.place = np.where(symbol < k, symbol % PER_CLASS, -1).astype(np.int64)
        if flat is None:
            rng = np.random.default_rng(8)
            for n, scale in (("x", 0.1), ("u", h**-0.5)):
                self.p[n][...] = rng.normal(0, scale, self.p[n].shape)
            mass = np.zeros(CLASSES + GROUPS)
            np.add.at(mass, self.cls[:k], v.counts[:k] + 0.5)
            mass[CLASSES:] = v.group_mass
            self.p["cb"][...] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum()), -30)
            self.p["wb"][...] = -30
            self.p["wb"][self.cls[:k], self.place[:k]] = np.log((v.counts[:k] + 0.5) / mass[self.cls[:k]])

    def states(self, inputs: np.ndarray, resets: np.ndarray, h: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States after each of the T steps over n lanes, from h (n, H);
        ``resets`` marks document starts. The reset gate acts on what the
        state contributes, so one product per step serves all gates; arrays
        are laid out feature by feature."""
        size, lanes = HIDDEN, inputs.shape[1]
        table, weights = np.ascontiguousarray(self.p["x"].T), np.ascontiguousarray(self.p["u"].T)
        out = np.empty((len(inputs), size, lanes), np.float32)
        h = np.ascontiguousarray(h.T)
        for t in range(len(inputs)):
            if (new := np.flatnonzero(resets[t])).size:
                h = h.copy()
                h[:, new] = 0
            x, a = np.take(table, inputs[t], axis=1), weights @ h
            zr = x[: 2 * size]
            zr += a[: 2 * size]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r, n, q = zr[:size], zr[size:], x[2 * size :], a[2 * size :]
            n += r * q
            np.tanh(n, out=n)
            if tape is not None:
                tape.append((h, z, r, n, q))
            h = h + z * (n - h)
            out[t] = h
        return np.ascontiguousarray(out.transpose(0, 2, 1))

    def log_prob(self, h: np.ndarray, y: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P(symbol y | state h) per row, without what a group shares out;
        with ``learn`` also gradients: added to ``g``, and by h returned."""
        p, g = self.p, self.g
        order = np.argsort(self.cls[y], kind="stable")
        hs, cls, place = h[order], self.cls[y[order]], self.place[y[order]]

        def part(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray):
            """ln softmax at ``at`` per row of x, and the softmax less one there."""
            a = x @ weights
            a += bias
            np.minimum(a, 80, out=a)
            rows = np.arange(len(at))
            logs = a[rows, at]
            e = np.exp(a, out=a)
            total = e.sum(axis=1)
            if learn:
                e /= total[:, None]
                e[rows, at] -= 1
            return logs - np.log(total), e

        logs, d = part(hs, p["c"], p["cb"], cls)
        dh = None
        if learn:
            g["c"] += hs.T @ d
            g["cb"] += d.sum(0)
            dh = d @ p["c"].T
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = slice(cuts[c], cuts[c + 1])
            if cuts[c] == cuts[c + 1]:
                continue
            inner, d = part(hs[at], p["w"][c].T, p["wb"][c], place[at])
            logs[at] += inner
            if learn:
                g["w"][c] += d.T @ hs[at]
                g["wb"][c] += d.sum(0)
                dh[at] += d @ p["w"][c]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return logs[back], dh[back] if learn else None

    def learn_window(self, inputs: np.ndarray, targets: np.ndarray, resets: np.ndarray, h: np.ndarray, full: int) -> np.ndarray:
        """One step of truncated backpropagation; the state after it. ``full``:
        tokens of a window with all lanes, so that windows with a few last
        lanes weigh less."""
        g, size, tape = self.g, HIDDEN, []
        states = self.states(inputs, resets, h, tape)
        live = targets >= 0
        every = bool(live.all())
        self.grad[:] = 0
        _, dh_live = self.log_prob(states.reshape(-1, size) if every else states[live], targets[live], True)
        if every:
            dhs = dh_live.reshape(states.shape)
        else:
            dhs = np.zeros(states.shape, np.float32)
            dhs[live] = dh_live
        dhs = np.ascontiguousarray(dhs.transpose(0, 2, 1))
        steps, lanes = inputs.shape
        # per step, by feature: update gate, reset gate, what the state adds to the new one, what the input adds
        parts = np.empty((steps, 4 * size, lanes), np.float32)
        back = np.zeros((size, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, z, r, n, q = tape[t]
            dz, dr, dnr, dn = parts[t].reshape(4, size, lanes)
            d = dhs[t] + back
            np.multiply(d, z, out=dz)
            np.multiply(dz, 1 - n * n, out=dn)
            rest = 1 - z
            dz *= n - h0
            dz *= rest
            np.multiply(dn, r, out=dnr)
            np.multiply(dnr, q, out=dr)
            dr *= 1 - r
            back = d * rest
            back += self.p["u"] @ parts[t, : 3 * size]
            back[:, resets[t]] = 0
        before = np.stack([step[0] for step in tape])
        g["u"] += np.matmul(before, parts[:, : 3 * size].transpose(0, 2, 1)).sum(axis=0)
        rows = np.empty((steps, lanes, 3 * size), np.float32)
        rows[..., : 2 * size] = parts[:, : 2 * size].transpose(0, 2, 1)
        rows[..., 2 * size :] = parts[:, 3 * size :].transpose(0, 2, 1)
        flat, rows = inputs.ravel(), rows.reshape(-1, 3 * size)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        names = flat[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        g["x"][names[first]] += np.add.reduceat(rows[order], first, axis=0)
        self.grad /= max(1, int(live.sum()))
        self.square += self.grad * self.grad
        self.steps += 1
        self.flat -= np.float32(RATE * min(1, self.steps / WARM_STEPS) * live.sum() / full) * self.grad / np.sqrt(self.square)
        return states[-1]


def lanes(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Documents dealt out to at most ``width`` lanes of like total length,
    longest lane first, long and short documents mixed within each."""
    heap = [(0, i) for i in range(min(width, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heap[0]
        out[i].append(d)
        heapq.heapreplace(heap, (n + int(lengths[d]), i))
    mixed = np.random.default_rng(4).permutation(len(lengths))
    out = [sorted(ds, key=mixed.__getitem__) for ds in out]
    return sorted(out, key=lambda ds: -int(lengths[ds].sum()))


def arranged(symbols: list[np.ndarray], start: int, width: int):
    """(inputs, targets, resets, owner), each (steps, lanes); targets and
    owners are -1 past a lane's end."""
    lengths = np.array([len(s) for s in symbols])
    dealt = lanes(lengths, width)
    steps = max(int(lengths[ds].sum()) for ds in dealt)
    targets = np.full((steps, len(dealt)), -1, np.int32)
    inputs, owner = np.full_like(targets, start), np.full_like(targets, -1)
    resets = np.zeros(targets.shape, bool)
    for i, ds in enumerate(dealt):
        y = np.concatenate([symbols[d] for d in ds])
        n, ends = len(y), np.cumsum(lengths[ds])
        targets[:n, i], inputs[1:n, i] = y, y[:-1]
        starts = np.r_[0, ends[:-1]]
        inputs[starts, i], resets[starts, i] = start, True
        owner[:n, i] = np.repeat(ds, lengths[ds])
    return inputs, targets, resets, owner


def learn(model: GatedModel, symbols: list[np.ndarray], width: int = LANES) -> None:
    parts = [s[at : at + SEGMENT] for s in symbols for at in range(0, len(s), SEGMENT)]
    inputs, targets, resets, _ = arranged(parts, model.start, width)
    h = np.zeros((targets.shape[1], HIDDEN), np.float32)
    for t in range(0, len(targets), WINDOW):
        part = slice(t, t + WINDOW)
        n = int((targets[t] >= 0).sum())  # lanes end in order
        h = model.learn_window(inputs[part, :n], targets[part, :n], resets[part, :n], h[:n], WINDOW * targets.shape[1])


def log_likelihoods(model: GatedModel, symbols: list[np.ndarray]) -> np.ndarray:
    """ln P per document, state carried from its start to its end."""
    inputs, targets, resets, owner = arranged(symbols, model.start, SCORE_LANES)
    h, out = np.zeros((targets.shape[1], HIDDEN), np.float32), np.zeros(len(symbols))
    for t in range(0, len(targets), SCORE_WINDOW):
        n = int((targets[t] >= 0).sum())
        part = (slice(t, t + SCORE_WINDOW), slice(0, n))
        states = model.states(inputs[part], resets[part], h[:n])
        live = targets[part] >= 0
        logs, _ = model.log_prob(states[live], targets[part][live])
        out += np.bincount(owner[part][live], logs.astype(np.float64), len(symbols))
        h = states[-1]
    return out


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Per row of ``docs`` its tokens' symbols (16 bits each) and what needs no
    model: (row, doc_id, n_tokens, known, base, tail, symbols, rare). ``base``
    sums log10(c + 0.5) over the table's tokens, ``tail`` those of them that
    the model knows by group only, less their groups' masses; ``rare`` are the
    words beyond the table."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(v)  # bounded by TABLE

    def each(batches):
        v = shared.value
        codes = v.prepared()
        shares = np.r_[np.zeros(v.frequent), np.log10(v.group_mass)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                out: list[tuple] = []
                for text in rows.column(1):
                    words = words_of(text.as_py())
                    c = codes.of(words)
                    s, logs = codes.symbol[c], codes.log10[c]
                    tail = float(logs[s >= v.frequent].sum() - shares[s].sum()) + codes.end
                    rare = [words[k].decode("utf-8") for k in np.flatnonzero(c[:-1] >= codes.size)]
                    out.append((len(c), int((c < codes.size).sum()), float(logs.sum()) + codes.end, tail, s.astype(np.uint16).tobytes(), rare))
                columns = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, t) for x, t in zip(columns, types))],
                                                 names=["doc_id", "n_tokens", "known", "base", "tail", "symbols", "rare"])

    made = docs.select("doc_id", "text").mapInArrow(
        each, f"doc_id {kind}, n_tokens long, known long, base double, tail double, symbols binary, rare array<string>")
    return made.withColumn("row", F.monotonically_increasing_id())


def _blocks(batches, column: int):
    """(rows, symbols per document) in blocks of about ``BLOCK`` tokens."""
    for batch in batches:
        start, symbols, size = 0, [], 0
        for i, coded in enumerate(batch.column(column)):
            symbols.append(np.frombuffer(coded.as_py(), np.uint16).astype(np.int32))
            size += len(symbols[-1])
            if size >= BLOCK or i + 1 == batch.num_rows:
                yield batch.slice(start, len(symbols)), symbols
                start, symbols, size = i + 1, [], 0


def _trained(coded: DataFrame, v: Vocabulary, flat: np.ndarray | None, width: int) -> np.ndarray | None:
    """Parameters after a pass of every task over its documents, averaged by
    their tokens; what is collected is bounded by the number of parameters."""
    shared = coded.sparkSession.sparkContext.broadcast((v.without_table(), flat))

    def each(batches):
        v, flat = shared.value
        model, seen = GatedModel(v, flat), 0
        for _, symbols in _blocks(batches, 0):
            learn(model, symbols, width)
            seen += sum(map(len, symbols))
        if seen:
            at = np.arange(len(model.flat), dtype=np.int32)
            n = np.full(len(at), seen, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model.flat.astype(np.float64) * seen), pa.array(n)], names=["i", "w", "n"])

    sums = coded.select("symbols").mapInArrow(each, "i int, w double, n long").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w"))
    rows = sums.toArrow()
    if not rows.num_rows:
        return flat
    out = np.zeros(rows.num_rows, np.float32)
    out[rows.column("i").to_numpy()] = rows.column("w").to_numpy()
    return out


def fit(coded: DataFrame, v: Vocabulary, width: int = LANES) -> np.ndarray | None:
    """Trained parameters: a first model, then a pass over all documents, as
    ``encode`` gives them, in ``width`` lanes."""
    warm = coded.orderBy(F.xxhash64("doc_id"), "doc_id").select("symbols").limit(WARM_DOCS).coalesce(1)
    return _trained(coded, v, _trained(warm, v, None, width), width)


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, flat: np.ndarray | None) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of ``docs``."""
    return score_encoded(stored(encode(docs, v), "lm-symbols"), counts, v, flat)


def score_encoded(coded: DataFrame, counts: DataFrame, v: Vocabulary, flat: np.ndarray | None) -> DataFrame:
    """``score`` of stored rows of ``encode``."""
    kind = dict(coded.dtypes)["doc_id"]
    shared = coded.sparkSession.sparkContext.broadcast((v.without_table(), flat))

    def each(batches):
        v, flat = shared.value
        model = GatedModel(v, flat)
        for batch, symbols in _blocks(batches, 5):
            model_log = log_likelihoods(model, symbols) / np.log(10) + batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(model_log)], names=["row", "doc_id", "n_tokens", "known", "base", "model"])

    rows = coded.select("row", "doc_id", "n_tokens", "known", "base", "symbols", "tail").mapInArrow(
        each, f"row long, doc_id {kind}, n_tokens long, known long, base double, model double")
    uses = coded.select("row", F.explode("rare").alias("token"))
    looked_up = uses.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log"), F.count_if(F.col("c") > 0).alias("more"))
    log, size = F.coalesce("log", F.lit(0.0)), F.log10(F.lit(v.total + 0.5 * (v.distinct + 1)))
    return rows.join(looked_up, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + log - F.col("n_tokens") * size).alias("base_score"), (F.col("model") + log).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = stored(token_counts(docs.where(~held_out())), "token-counts")
    v = vocabulary(counts)
    coded = stored(encode(docs, v), "lm-symbols")
    scored = score_encoded(coded, counts, v, fit(coded.where(~held_out()), v))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"),
        "base_score", "score")
