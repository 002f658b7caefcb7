"""Best-fit packing: documents into sequences of at most ``capacity`` tokens.

A document's ids are the tokenizer's (no special tokens) and then id 0. Only
documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids;
the last piece may be shorter. Null text is the empty text: one id.

Best-two-fit: a sequence takes the longest unpacked piece, then greedily the
longest that still fits; then its smallest piece gives way to the two unpacked
pieces that together fill the widened gap most tightly, if they fill more than
it did. Pieces of one length are interchangeable, so this runs over counts by
length (at most ``capacity`` numbers, whatever the input): the plan is a list
of fillings, each with the number of sequences that get it, which is as often
as the counts last. Spark then deals the pieces out: their rank within their
length says which sequence and place is theirs. Ranks are counted per (length,
salt) and shifted by the smaller salts' counts, so a length that a third of
all pieces have is no single group.

Defined cases: repeated rows are packed as often as they come; rows without
doc_id too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import stored

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
ROWS_PER_SALT = 50_000
#: Entries kept of words already encoded, per Python worker; it starts anew when full.
CACHE = 500_000
#: Characters that end a chunk after its word.
PUNCTUATION = string.punctuation


class WordTokenizer:
    """Ids of a tokenizer that lower-cases, drops white space and ends words
    with ``</w>``: texts are cut at blanks and line ends, which no token
    crosses, and each distinct chunk is encoded once per worker."""

    _own: dict[str, "WordTokenizer"] = {}

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        """The worker's tokenizer for ``path``, with what it has encoded so far."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.normalizers import Sequence

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        # the same model for plain lower-case words with blanks between, which need no more cutting
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        ends = np.zeros(self.lib.get_vocab_size() + 1, dtype=bool)
        for token, i in self.lib.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.plain = regex.compile(r"[!-~¡-¬®-ɏ]+").fullmatch
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.chunks: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {"": b""}

    def _direct(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):  # a word that is more or less than one word to the library
                self.known.update((w, self._direct(w)) for w in part)
                continue
            data = ids.tobytes()
            self.known.update(zip(part, [data[at:cut] for at, cut in zip([0, *cuts], cuts)]))

    def _learn(self, chunks: set[str]) -> None:
        if len(self.chunks) + len(chunks) > CACHE:
            self.chunks = {"": b""}
        if len(self.known) > CACHE:
            self.known = {"": b""}
        # most chunks are one word of letters and a run of punctuation or none: two words at
        # most, held in lists side by side; the others are cut by the pattern or encoded whole
        heads, stems, tails = [], [], []
        others: dict[str, list[str]] = {}
        whole = []
        for c in chunks:
            low = c.lower()
            stem = low.rstrip(PUNCTUATION)
            if not (c.isascii() or self.plain(c)):
                whole.append(c)
            elif stem.isalpha():
                heads.append(c)
                stems.append(stem)
                tails.append(low[len(stem) :])
            elif self.plain(c):
                others[c] = self.words(low)
            else:
                whole.append(c)
        known = self.known
        words = set().union(stems, tails, *others.values())
        self._learn_words(list(words.difference(known)))
        get = known.__getitem__
        self.chunks.update(zip(heads, map(add, map(get, stems), map(get, tails))))
        self.chunks.update((c, b"".join(map(get, ws))) for c, ws in others.items())
        self.chunks.update((c, self._direct(c)) for c in whole)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids per text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if new := set().union(*split).difference(self.chunks):
            kept = len(self.chunks) + len(new) <= CACHE
            self._learn(new if kept else {c for chunks in split for c in chunks})
        get = self.chunks.__getitem__
        return (b"".join(map(get, chunks)) for chunks in split)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        lib = WordTokenizer.of(tokenizer_path)
        width = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], [], []]
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for doc, ids in zip(rows.column(0).to_pylist(), lib.encode(texts)):
                    ids += b"\0\0\0\0"
                    for piece, i in enumerate(range(0, len(ids), width)):
                        part = ids[i : i + width]
                        for column, value in zip(out, (doc, piece, i // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                types = [rows.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types)], names=names[:n])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit over piece counts by length: (sequences, {length: pieces
    in each}) per filling."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan: list[tuple[int, dict[int, int]]] = []
    while lengths:
        used: dict[int, int] = {}

        def fill(gap: int) -> int:
            top = bisect_right(lengths, gap) - 1
            while gap and top >= 0:
                n = lengths[top]
                k = min(left[n] - used.get(n, 0), gap // n)
                if k:
                    used[n] = used.get(n, 0) + k
                    gap -= k * n
                top = min(top - 1, bisect_right(lengths, gap) - 1)
            return gap

        if (gap := fill(capacity)) and (pair := _two(lengths, left, used, gap)):
            small = min(used)
            used[small] -= 1
            if not used[small]:
                del used[small]
            for n in pair:
                used[n] = used.get(n, 0) + 1
            fill(gap + small - sum(pair))
        times = min(left[n] // k for n, k in used.items())
        plan.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
        lengths = [n for n in lengths if left[n]]
    return plan


def _two(lengths: list[int], left: dict[int, int], used: dict[int, int], gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths that fill the gap without the sequence's
    smallest piece best, if they fill more than that piece."""
    small = min(used)
    room = gap + small
    free = [n for n in lengths[: bisect_right(lengths, room)] if left[n] > used.get(n, 0)]
    if not free:
        return None
    a = np.array(free)
    spare = np.array([left[n] - used.get(n, 0) for n in free])
    other = np.searchsorted(a, room - a, side="right") - 1
    same = (other == np.arange(len(a))) & (spare < 2)
    other = np.where(same, other - 1, other)
    total = np.where(other >= 0, a + a[other], 0)
    best = int(np.argmax(total[::-1]))
    best = len(a) - 1 - best
    return (free[best], free[int(other[best])]) if total[best] > small else None


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with ``sequence_id``
    and ``offset``; every sequence is filled gapless from offset 0."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("piece lengths must lie between 1 and the capacity")
    rows: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    given, sequence = dict.fromkeys(counts, 0), 0
    for times, used in plan_sequences(counts, capacity):
        at = 0
        for n in sorted(used, reverse=True):
            rows[n].append((given[n], sequence, used[n], at))
            given[n] += times * used[n]
            at += used[n] * n
        sequence += times
    slots = {n: np.array(r, dtype=np.int64).T for n, r in rows.items()}

    salts = max(1, math.ceil(sum(counts.values()) / ROWS_PER_SALT))
    own = pieces.columns
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in own if c != "ids"]), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("length", "_salt").orderBy(*[c for c in own if c not in ("length", "ids")])
    ranked = (
        salted.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(shifts, ["length", "_salt"])
        .select(*own, (F.col("_rank") + F.col("_shift")).cast("long").alias("_rank"))
    )
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"

    def deal(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                first, sequences, each, place = slots[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                j = rank[at] - first[k]
                seq[at] = sequences[k] + j // each[k]
                off[at] = place[k] + j % each[k] * n
            columns = [batch.column(c) for c in own] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "sequence_id", "offset"])

    return ranked.mapInArrow(deal, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents cut into pieces and packed; the pieces are stored once,
    as they are counted and dealt out."""
    return pack(stored(token_pieces(docs, tokenizer_path, capacity, with_ids), "token-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed ids joined up, from ``pack``
    over pieces with ids. A sequence has at most ``capacity`` pieces."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(placed, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))
