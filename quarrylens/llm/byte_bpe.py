"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encoded texts form a monoid: ``join`` turns the encodings of two neighbouring
strings into that of their concatenation, so a text is encoded as a tree, both
halves first. Two such trees are stacked.

Bytes of one match of the split pattern (``RankCoder``). Short strings are
merged directly: the neighbouring pair with the least rank first, the leftmost
of equals. For longer ones both halves are encoded and joined: a window of
tokens on both sides of the boundary is re-encoded and grows until the tokens
outside provably stay. A token sequence is the encoding of its bytes exactly
if every two neighbours are the encoding of their own concatenation; inside
the window and outside of it that holds already, so it remains to check the
pair at each end of the window.

Text (``TextCoder``). Halves of a text are split into matches on their own.
A match depends only on what lies right of its start, and the pattern looks at
most ``LOOK`` characters past the end of a match, other than to the end of a
run of white space, which the last match then reaches. So a left half keeps
its matches that end ``LOOK`` characters before its end, but for the last one;
what follows is matched again into the right half, until a match ends where
one of the right half's matches does: from there on the right half's matches
stay.

Decoding joins the tokens' bytes up the same kind of tree.

Defined cases: null text is the empty text, zero ids; texts are ordinary text
throughout (no special tokens); extra columns are ignored; repeated rows give
repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a match, and characters up to which a text, is a leaf.
LEAF_BYTES, LEAF_CHARS = 24, 1 << 15
#: Characters past its end that a match can depend on.
LOOK = 3
#: Entries kept of what is already encoded, per Python worker; it starts anew when full.
CACHE = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankCoder:
    """Byte strings to token ids, each string as one match."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the least rank, leftmost first."""
        if len(data) > 8 * LEAF_BYTES:
            return self._merge_long(data)
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        none = 1 << 62
        found = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while found and (least := min(found)) != none:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their concatenation."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > CACHE:
                self.pairs = {}
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of what ``left`` and ``right`` encode, side by side."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        back, on = 1, 1
        while True:
            back, on = min(back, len(left)), min(on, len(right))
            inside = left[-back:] + right[:on]
            data = b"".join([self.bytes_of[t] for t in inside])
            window = self.merge(data)
            before = back == len(left) or self.stays(left[-back - 1], window[0])
            after = on == len(right) or self.stays(window[-1], right[on])
            if before and after:
                return left[: len(left) - back] + window + right[on:]
            back, on = back * (1 if before else 2), on * (1 if after else 2)

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for long strings, with a heap of candidate pairs."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0: none starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(data[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextCoder:
    """Whole texts to token ids, each match of the pattern on its own."""

    _own: dict[tuple[str, str], "TextCoder"] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "TextCoder":
        """The worker's coder, with what it has encoded so far."""
        if (path, pattern) not in cls._own:
            cls._own[path, pattern] = cls(read_ranks(path), pattern)
        return cls._own[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.coder = RankCoder(ranks)
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).finditer
        self.matches: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def ids_of(self, matches: list[str]) -> bytes:
        known = self.matches
        try:
            return b"".join([known[m] for m in matches])
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for m in matches:
                if m not in known:
                    known[m] = np.array(self.coder.encode(m.encode()), dtype="<u4").tobytes()
            return b"".join([known[m] for m in matches])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(text) <= LEAF_CHARS:
            return self._leaf(text)
        return self.ids_of(self.matches_of(text))

    def matches_of(self, text: str) -> list[str]:
        """The pattern's matches, by halves."""
        if len(text) <= LEAF_CHARS:
            return self.split(text)
        half = len(text) // 2
        return self.join(self.matches_of(text[:half]), text[half:], self.matches_of(text[half:]))

    def join(self, left: list[str], text: str, right: list[str]) -> list[str]:
        """The matches of a whole, from those of its halves; ``text`` is the
        right half, which ``right`` covers."""
        keep, over = len(left), 0
        while keep and (over < LOOK or keep == len(left)):
            keep -= 1
            over += len(left[keep])
        tail = "".join(left[keep:])
        ends, at = {0: 0}, 0  # of right's matches, as far as looked at
        on = 4 * LOOK
        while True:
            while len(ends) <= len(right) and at <= on:
                at += len(right[len(ends) - 1])
                ends[at] = len(ends)
            whole = on >= len(text)
            window, again = tail + text[:on], []
            for match in self.scan(window):
                if not whole and match.end() > len(window) - LOOK:
                    break
                if not whole and match.end() == len(window):
                    break
                again.append(match.group())
                if (n := ends.get(match.end() - len(tail))) is not None and match.end() > len(tail):
                    return left[:keep] + again + right[n:]
            else:
                if whole:
                    return left[:keep] + again
            on *= 2

    def _leaf(self, text: str) -> bytes:
        """A text whose blanks and line ends each stand between two
        characters that are no white space is cut before each blank and
        around each line end, where a match always ends; any other is matched
        as a whole."""
        lines, out = text.split("\n"), []
        known = self.chunks
        for n, line in enumerate(lines):
            if n:
                out.append("\n")
            words = line.split(" ")
            if not all(words) or words[0][0].isspace() or line[-1].isspace():
                return self.ids_of(self.split(text))
            out.append(words[0])
            out += [" " + w for w in words[1:]]
        try:
            return b"".join([known[c] for c in out])
        except KeyError:
            pass
        for c in out:
            if c not in known:
                inner = c[1:] if c[0] == " " else c
                if c != "\n" and (inner[0].isspace() or inner[-1].isspace()):
                    return self.ids_of(self.split(text))
                if len(known) > CACHE:
                    known.clear()
                    return self._leaf(text) if len(out) < CACHE else self.ids_of(self.split(text))
                known[c] = self.ids_of(self.split(c))
        return b"".join([known[c] for c in out])

    def decode(self, ids: bytes) -> bytes:
        return self.coder.decode(np.frombuffer(ids, dtype="<u4").tolist())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids binary[, decoded binary]) per document."""
    def run(columns, coder):
        ids = [coder.encode(t or "") for t in columns[1]]
        return [ids] + ([[coder.decode(i) for i in ids]] if decode else [])

    return _per_document(docs, ranks_path, pattern, run, ["ids binary", "decoded binary"][: 1 + decode])


def _per_document(docs: DataFrame, ranks_path: str, pattern: str, run, columns: list[str]) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches):
        coder = TextCoder.of(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                made = run([c.to_pylist() for c in rows.columns], coder)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *map(pa.array, made)], names=["doc_id", *(c.split()[0] for c in columns)]
                )

    return docs.select("doc_id", "text").mapInArrow(each, ", ".join([f"doc_id {kind}", *columns]))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the round trip of every
    text, digested where it is made."""
    def run(columns, coder):
        ids = [coder.encode(t or "") for t in columns[1]]
        return [
            [len(i) // 4 for i in ids],
            [hashlib.sha256(i).hexdigest() for i in ids],
            [hashlib.sha256(coder.decode(i)).hexdigest() for i in ids],
        ]

    return _per_document(docs, ranks_path, pattern, run, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
