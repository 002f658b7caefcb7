"""Very long texts and empty tables where the other files have none."""

import zlib

import public_tokenizers

from quarrylens.llm import byte_bpe, fingerprints, jaccard, toxicity


def test_fingerprint_of_a_very_long_text(docs_of):
    long = "\n".join(f"Line {i} tells of thing {i * i % 977} and of {i % 89} others." for i in range(30_000))
    rows = [(1, long), (2, long), (3, long.replace("Line 15000 ", "Line 15000, changed, ")), (4, "short")]
    marks = {r["doc_id"]: r["tree"]["fingerprint"] for r in fingerprints.fingerprint(docs_of(rows)).collect()}
    assert marks[1] == marks[2] != marks[3] != marks[4]


def test_toxicity_of_a_very_long_text(spark, docs_of):
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [(i, "a calm text" if n % 2 else "such an idiot here") for n, i in enumerate(train)]
    labels = spark.createDataFrame([(i, 1 - n % 2) for n, i in enumerate(train)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(texts), labels)
    calm = "a calm text " * 40_000
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of([(1, calm), (2, "such an id10t here " * 20_000), (3, "x" * 300_000)]), model).collect()}
    assert len(got) == 3 and all(0 <= s <= 1 for s in got.values()) and got[1] < got[2]


def test_bpe_of_an_empty_table(docs_of):
    assert byte_bpe.digests(docs_of([]), public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN).count() == 0


def test_join_of_very_long_texts(docs_of):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:110_000])), (3, " ".join(words[60_000:])), (4, "w1 w2 w3 w4 w5")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_classes(docs_of(rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
