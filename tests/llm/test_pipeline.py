"""The corpus pipeline, stage by stage, against plain Python."""

import corpus_pipeline
from tests_llm_helpers import SF_SMALL, duck

from quarrylens.llm import line_dedup
from test_search import _brute


def test_stages_on_the_small_tables(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    clean = {r["doc_id"]: r["text"] for r in kept["toxicity"].collect()}
    assert set(clean) < set(start) and all(start[i] == t for i, t in clean.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert sum(i not in clean for i, t in labels.items() if not t) <= 2

    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/toxicity/*.parquet')")
    want = {r[0]: r[3] for r in con.execute(line_dedup.ORACLE).fetchall() if not r[2] or r[3].strip()}
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()}
    assert lines == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].collect())

    near = {r["doc_id"] for r in kept["near_duplicates"].collect()}
    assert near == {i for i, (c, _) in _brute(list(lines.items())).items() if i == c}
    packed = kept["packing"].collect()
    assert {r["doc_id"] for r in packed} == near and sum(r["piece"] == 0 for r in packed) == len(near)


def test_stages_on_edges(spark, docs_of, tmp_path):
    rows = [(1, None), (2, ""), (3, "a text of some words that is not long"), (3, "a text of some words that is not long"),
            (4, "a text of some words that is not long"), (None, "no id here")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, given in (("rows", rows), ("none", [])):
        docs_of(given, ["n_removed", "score", "_row"]).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()}
        assert got == ({1, 2, 3, None} if given else set())


def test_one_id_with_several_texts(spark, docs_of):
    prose = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"term{i}" for i in range(40))
    rows = [(7, prose), (7, prose), (7, other), (7, None), (7, ""), (-2, other + " and a tail"), (9, prose + " end"), (11, "unlike all"), (None, prose)]
    docs = docs_of(rows, ["_key", "_mark", "_place", "n"])
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near(spark, docs, "").where("doc_id IS NOT NULL").fillna("").collect())
    # the other text of 7 is near that of -2; its first one is the least of its own class, empty texts are one document
    assert got == [(-2, other + " and a tail"), (7, ""), (7, prose), (11, "unlike all")]
    out = corpus_pipeline.keep_one_of_near(spark, docs, "")
    assert out.columns == docs.columns and out.where("doc_id IS NULL").count() == 1


def test_left_over_white_space_goes(spark, docs_of):
    shared = "a first line\na second line\na third line"
    docs = docs_of([(1, shared), (2, shared), (3, shared + "\n\t"), (4, shared + "\n\x0b \nmore"), (5, " \t"), (6, None)])
    got = {r["doc_id"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1, 4, 5, 6}


def test_stages_on_a_very_long_text(spark, docs_of, tmp_path):
    long = "\n".join(" ".join(f"w{i * 7 + j}" for j in range(10)) for i in range(20_000))
    docs_of([(1, long), (2, long + "\nits last line"), (3, "short and different")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3}  # of 2 only the line of its own is left
    assert sum(r["length"] for r in out if r["doc_id"] == 1) > 200_000
