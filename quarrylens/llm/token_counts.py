"""Token counts: unigram segmentation by Viterbi, counting pieces only.

The vocabulary is a list of pieces with scores (by default the 32k
sentencepiece file, its scores read as unigram scores). A text is normalised
as that file says: a blank is put before it and blanks become ``▁``. Aho-
Corasick enumerates every vocabulary piece that ends at each place; dynamic
programming keeps, per place, the best score and the number of pieces on that
path, no back pointers. Tie rules are those of the unigram tokenizers: a later
start replaces an earlier one only if strictly better, so of equal paths the
longer last piece stays; a character that is no piece of its own may be
unknown, scored ten below the least score, after all pieces, and counts as one
piece per UTF-8 byte (byte fallback).

No piece holds a ``▁`` after another character or a line end, which is checked
when the vocabulary is read, so every path passes through those places and the
parts between them are counted on their own, each distinct one once per worker.

Defined cases: null and empty texts have 0 tokens; extra columns are ignored;
repeated rows give repeated rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Entries kept of parts already counted, per Python worker, and their length in characters.
CACHE, CACHE_CHARS = 1_000_000, 64
_PART = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces and their scores: no control, unknown or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return {sp.id_to_piece(i): sp.get_score(i) for i in ids}


class PieceCounter:
    _own: dict[str, "PieceCounter"] = {}

    @classmethod
    def of(cls, path: str) -> "PieceCounter":
        """The worker's counter, with what it has counted so far."""
        if path not in cls._own:
            cls._own[path] = cls(read_pieces(path))
        return cls._own[path]

    def __init__(self, pieces: dict[str, float]) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.parts = not any(re.search("[^▁]▁|.\n|\n.", p) for p in pieces)
        self.known: dict[str, int] = {}

    def count_part(self, text: str) -> int:
        """Pieces on the best path over normalised text."""
        n = len(text)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        none, unknown = float("-inf"), self.unknown
        at, top, count, single = 0, none, 0, False  # of the place being filled: its index, best so far
        for end, (length, score) in self._matches(text):
            while at < end:  # places that matches no longer reach
                if not single and (s := best[at - 1] + unknown if at else none) > top:
                    top, count = s, pieces[at - 1] + len(text[at - 1].encode())
                best[at], pieces[at] = (top, count) if at else (0.0, 0)
                at, top, count, single = at + 1, none, 0, False
            if length:
                if (s := best[end - length] + score) > top:
                    top, count = s, pieces[end - length] + 1
                single = single or length == 1
        return pieces[n]

    def _matches(self, text: str):
        """(place after the match, (length, score)), longest first per place;
        then the place after the text."""
        for last, match in self.found.iter(text):
            yield last + 1, match
        yield len(text) + 1, (0, 0.0)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = "▁" + text.replace(" ", "▁")
        if not self.parts:
            return self.count_part(text)
        parts, known = _PART.findall(text), self.known
        try:
            return sum([known[p] for p in parts])
        except KeyError:
            pass
        total = 0
        for p in parts:
            if (n := known.get(p)) is None:
                n = self.count_part(p)
                if len(p) <= CACHE_CHARS:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = n
            total += n
        return total


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens) per document."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches):
        count = PieceCounter.of(model_path).count
        for batch in batches:
            n = [count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path(MODEL))
