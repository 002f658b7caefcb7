"""Packing, token counts and byte-level BPE against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_helpers import CLASH, SF_SMALL, by_id
from tokenizers import Tokenizer, models

from quarrylens.llm import byte_bpe, packing, token_counts

ODD = ["a", "b", "aa", " ", "  ", "\n", " \n", "'s", "'", "r", "e", "'re", "ll", "the", " the", "é", "1", "23", "!!", "日本", "\t",
       "　", "x" * 40, "ing", "<|endoftext|>", "İ", "ß", "é", "\x1c", "▁"]


@pytest.fixture(scope="module")
def word_bpe():
    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    lib.encode_special_tokens = True
    return lib


@pytest.fixture(scope="module")
def byte_lib():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(lib, docs):
    out = []
    for i, t in docs:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(i, p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    return sorted(out, key=repr)


def _check_packed(rows, most):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= most


def test_packing_query_matches_library(spark, word_bpe):
    rows = packing.query(spark, SF_SMALL).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = _pieces(word_bpe, docs)
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr)
    assert got == want
    _check_packed(rows, 1.02 * sum(w[3] for w in want) / 2048 + 2)


def test_packing_edges(docs_of, word_bpe):
    docs = [(1, None), (2, ""), (2, ""), (3, "word " * 5000), (None, "no id"), *[(i, "same text " * (i % 7)) for i in range(10, 300)]]
    rows = packing.pack_documents(docs_of(docs, CLASH), public_tokenizers.path(packing.TOKENIZER)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == _pieces(word_bpe, docs)
    _check_packed(rows, 6)
    assert packing.pack_documents(docs_of([]), public_tokenizers.path(packing.TOKENIZER)).count() == 0


def test_packed_ids_join_up(docs_of, word_bpe):
    docs = [(i, f"document {i} of many words") for i in range(30)]
    packed = packing.pack_documents(docs_of(docs), public_tokenizers.path(packing.TOKENIZER), 64, with_ids=True)
    joined = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4").tolist()
    assert all(len(ids) <= 64 for ids in joined.values())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 60), max_size=15))
def test_plan_places_every_piece(counts):
    placed = dict.fromkeys(counts, 0)
    sequences = 0
    for times, used in packing.plan_sequences(counts, 50):
        assert times > 0 and sum(n * k for n, k in used.items()) <= 50
        sequences += times
        for n, k in used.items():
            placed[n] += times * k
    assert placed == counts
    gaps = []  # first fit, longest first
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, gap in enumerate(gaps) if gap >= n), None)
        if at is None:
            gaps.append(50 - n)
        else:
            gaps[at] -= n
    assert sequences <= 1.1 * len(gaps) + 1


def test_two_fit_replaces_the_smallest():
    # 6 + 2 leaves a gap of 2; 2 gives way to 3 + 1
    assert packing._two([1, 2, 3, 6], {1: 1, 2: 1, 3: 1, 6: 1}, {6: 1, 2: 1}, 2) == (3, 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=40))
def test_word_ids_equal_the_library(word_bpe, parts):
    text = "".join(parts)
    own = packing.WordTokenizer.of(public_tokenizers.path(packing.TOKENIZER))
    assert np.frombuffer(next(iter(own.encode([text]))), "<u4").tolist() == word_bpe.encode(text, add_special_tokens=False).ids


def test_words_with_punctuation_need_no_pattern(word_bpe):
    """Words of letters with or without a run of punctuation are cut without the
    pattern, and with the library's ids; whatever differs still takes the pattern."""
    own = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))

    def same(text):
        return np.frombuffer(next(iter(own.encode([text]))), "<u4").tolist() == word_bpe.encode(text, add_special_tokens=False).ids

    assert same("don't it's' 's' x'll'' İ, İİ ǅ. ª! a­. (a) 3. a3, ßß?! é. \U00010400. Å, <|endoftext|> </w> a</w>")
    own.words = lambda low: pytest.fail(f"cut by the pattern: {low}")
    assert same("Hello, WORLD... café!? naïve a' Straße;")


def test_byte_bpe_query_round_trip(spark, byte_lib):
    got = by_id(byte_bpe.query(spark, SF_SMALL), "n_tokens", "ids_sha256", "decoded_sha256")
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = np.array(byte_lib[1].encode_ordinary(r["text"]), "<u4")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


@pytest.mark.parametrize("chars, size", [(6, 2), (17, 3), (40, 8)])
def test_byte_bpe_small_leaves(byte_lib, monkeypatch, chars, size):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", chars)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", size)
    coder, rng = byte_bpe.TextCoder(byte_lib[0], public_tokenizers.PATTERN), random.Random(chars)
    for _ in range(1500):
        text = "".join(rng.choices(ODD, k=rng.randint(0, 50)))
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == byte_lib[1].encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_byte_bpe_edges(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "x y" * 30_000), (4, "z" * 20_000), (4, "z" * 20_000), (None, "q")], CLASH)
    rows = byte_bpe.encode_documents(docs, public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN, decode=True).collect()
    assert len(rows) == 6 and {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows} == {
        1: "", 2: "", 3: "x y" * 30_000, 4: "z" * 20_000, None: "q"}


def _unigram(pieces):
    vocabulary = [("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *pieces.items()]
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def _normal(text):
    return "▁" + text.replace(" ", "▁") if text else ""


def test_token_counts_query_matches_library(spark):
    lib = _unigram(token_counts.read_pieces(public_tokenizers.path(token_counts.MODEL)))
    got = by_id(token_counts.query(spark, SF_SMALL), "n_tokens")
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        assert got[r["doc_id"]] == (len(lib.encode(_normal(r["text"])).ids),)


def test_token_counts_tie_rules():
    rng = random.Random(5)
    for _ in range(150):
        pieces = {c: float(rng.randint(-4, 0)) for c in ["a", "b", "▁", "ab", "ba", "aa", "aab", "▁a", "bb", "abab", "é"] if rng.random() < 0.8} or {"a": 0.0}
        own, lib = token_counts.PieceCounter(pieces), _unigram(pieces)
        own.unknown = min(0.0, *pieces.values()) - 10  # the library's least score includes its byte pieces
        for _ in range(20):
            text = "".join(rng.choices("ab éc", k=rng.randint(0, 12)))
            assert own.count(text) == len(lib.encode(_normal(text)).ids), (pieces, text)


def test_token_counts_edges(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a" * 50_000), (4, " "), (4, " "), (None, "x")], CLASH)
    rows = token_counts.count_tokens(docs, public_tokenizers.path(token_counts.MODEL)).collect()
    got = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert len(rows) == 6 and got[1] == got[2] == 0 and got[3] > 1000 and got[None] == 1
    assert token_counts.count_tokens(docs_of([]), public_tokenizers.path(token_counts.MODEL)).count() == 0
