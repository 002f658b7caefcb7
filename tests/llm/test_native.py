"""Fingerprints, license scan and line dedup: fixtures, edges and brute force."""

import hashlib
import random


from tests_llm_helpers import CLASH, SF_SMALL, by_id, duck

from quarrylens.llm import fingerprints, licenses, line_dedup
from pyspark.sql import functions as F


def test_line_dedup_matches_sql(spark):
    rows = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.query(spark, SF_SMALL).collect()}
    sql = duck(line_dedup.ORACLE, SF_SMALL)
    assert rows == {r[0]: r[1:] for r in sql}


def test_line_dedup_windows_merge_and_edges(docs_of):
    five = "a\nb\nc\nd\ne"
    docs = docs_of([(1, five), (2, "x\n" + five + "\ny"), (3, None), (4, ""), (5, "one"), (6, "one"), (7, "a\n\n b \nc\nz"),
                    (8, "q\nq\nq\nq\nq"), (9, "\n\n\n"), (9, "\n\n\n"), (None, "one"), (10, "b\nd\nc")], ["n_lines"])
    out = line_dedup.dedup_lines(docs).collect()
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out}
    assert got[1] == (five, 0)
    assert got[2] == ("x\ny", 5)  # three overlapping windows cover five lines
    assert got[3] == got[4] == ("", 0)
    assert got[None] == ("one", 0) and got[5] == got[6] == ("", 1)  # a null doc_id comes first
    assert got[7] == ("\nz", 3)  # blank lines belong to no window and stay
    assert got[8] == ("q", 4)  # the repeats within one document, merged, cover all but its first line
    assert got[9] == ("\n\n\n", 0) and len(out) == 12
    assert got[10] == ("b\nd\nc", 0)
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_line_dedup_long_text(docs_of):
    long = "\n".join(f"line {i}" for i in range(20_000))
    got = by_id(line_dedup.dedup_lines(docs_of([(1, long), (2, long + "\nend")])), "n_lines", "n_removed", "text")
    assert got[1] == (20_000, 0, long) and got[2] == (20_001, 20_000, "end")


def _edited(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest())
    return out


def test_fingerprint_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = fingerprints.query(spark, SF_SMALL).collect()
    want = _edited([(r["doc_id"], r["text"] or "") for r in docs])
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == want
    text, mark = {r["doc_id"]: r["text"] for r in docs}, {r["doc_id"]: r["fingerprint"] for r in rows}
    assert len(set(mark.values())) == len(set(text.values()))  # equal exactly if the texts are
    assert all((text[a] == text[b]) == (mark[a] == mark[b]) for a in list(text)[:40] for b in list(text)[:40])
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_fingerprint_edges(spark, docs_of, tmp_path):
    rows = [(5, None), (7, ""), (9, "é日本 text"), (9, "é日本 text"), (2**40, "a b\n\nc d"), (None, "no id")]
    docs_of(rows, CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    want = _edited([(5, ""), (7, ""), (9, "é日本 text"), (2**40, "a b\n\nc d")])
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in out.items()} == want
    assert out[5]["near_next"] == 1.0 and out[5]["fingerprint"] == out[7]["fingerprint"]
    docs_of([(1, "only one document")]).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [r["near_next"] for r in fingerprints.query(spark, f"{tmp_path}/one").collect()] == [1.0]
    docs_of([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.query(spark, f"{tmp_path}/none").count() == 0


def test_fingerprint_of_short_lines_and_shifted_words(spark, docs_of, tmp_path):
    words = "seven grey geese were seen over the northern lake at dawn before rain came down".split()
    rows = [(n, " ".join(words[n % 3 :][:n])) for n in range(4, 13)] + [(n, " ".join(words[:n])) for n in (13, 14, 15)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = fingerprints.query(spark, str(tmp_path)).collect()
    assert len(out) == 12 and all(0 < r["near_edited"] < 1 for r in out)
    # a word inserted at the start of a long line shifts no later run
    line = " ".join(f"word{i * i % 211}" for i in range(200))
    t = fingerprints.fingerprint(docs_of([(1, line), (2, "Indeed " + line)])).select("doc_id", "tree")
    a, b = (r["tree"] for r in t.orderBy("doc_id").collect())
    assert len(set(a["labels"]) & set(b["labels"])) >= len(a["labels"]) - 2 > 20
    # the runs are the line
    kept = docs_of([(1, line), (2, "  led by blanks\tand a tab "), (3, ""), (4, " ")]).select("text", fingerprints.runs(F.col("text")).alias("r")).collect()
    assert all("".join(r["r"]) == r["text"] for r in kept)
    assert {r["r"][0] for r in kept if r["r"]} >= {"  led ", " "}


def test_differing_branches_locate_the_edit(docs_of):
    lines = [f"paragraph {i} of the text" for i in range(60)]
    other = list(lines)
    other[33] = "an edited paragraph"
    t = fingerprints.fingerprint(docs_of([(1, "\n".join(lines)), (2, "\n".join(other))])).select("doc_id", "tree.fingerprint")
    pair = t.where("doc_id = 1").select(F.col("fingerprint").alias("a")).crossJoin(t.where("doc_id = 2").select(F.col("fingerprint").alias("b")))
    found = pair.select(fingerprints.diff_branches("a", "b").alias("d")).first()["d"]
    assert [x.split(":")[0] for x in found] == [hashlib.md5(other[33].encode()).hexdigest()[:8]]


def test_licenses_match_sql(spark):
    rows = [(r["doc_id"], r["license_id"], r["n_shingles"], r["matched"]) for r in licenses.query(spark, SF_SMALL.replace("0.001", "0.01")).collect()]
    sql = [tuple(r[:4]) for r in duck(licenses.ORACLE, SF_SMALL.replace("0.001", "0.01"))]
    assert sorted(rows) == sorted(sql) and rows


def test_licenses_long_templates_and_edges(docs_of):
    permission = licenses.TEMPLATES["MIT-permission"]
    words = permission.split()
    changed = " ".join([*words[:20], "otherwise", *words[21:]])
    half = " ".join(words[: len(words) // 2])
    filler = "some words of prose that are no license at all and go on " * 200
    docs = docs_of([(1, filler + permission.upper() + " " + filler), (2, filler + changed), (3, half), (4, None), (5, "four words are few"),
                    (6, "Released\nunder the MIT license!"), (6, "Released\nunder the MIT license!"), (None, permission)], CLASH)
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in licenses.scan(docs).collect()}
    assert got[1, "MIT-permission"] == 1.0 and 0.8 <= got[2, "MIT-permission"] < 1
    assert set(got) == {(1, "MIT-permission"), (2, "MIT-permission"), (6, "MIT")}
    assert licenses.scan(docs_of([])).count() == 0


def test_licenses_whole_notices_and_bands(docs_of):
    filler = "some words of prose that are no license at all and go on "
    whole = {k: v for k, v in licenses.TEMPLATES.items() if k.endswith(("-text", "-notice"))}
    assert len(whole) >= 6 and all(len(v.split()) > 90 for v in whole.values())
    spoilt = {}
    for k, v in whole.items():  # every thirtieth word is another one: a sixth of the shingles go
        spoilt[k] = " ".join("otherwise" if i % 30 == 29 else w for i, w in enumerate(v.split()))
    texts = [*whole.values(), *spoilt.values()]
    docs = docs_of([(i, filler * (i % 7) + t + " " + filler * 3) for i, t in enumerate(texts)] + [(99, filler * 50)])
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in licenses.scan(docs).collect()}
    for i, k in enumerate(whole):
        assert got[i, k] == 1.0 and 0.8 <= got[i + len(whole), k] < 0.95
    assert 99 not in {d for d, _ in got}
    # the bands alone find them, wherever they begin in a window
    of = licenses.template_shingles(docs.sparkSession, {"Zlib-text": whole["Zlib-text"]})
    at = [(i, "word " * i + " ".join(whole["Zlib-text"].split()[20:34])) for i in range(12)] + [(50, filler * 9), (51, ""), (52, None)]
    assert {r["doc_id"] for r in licenses.retrieve(docs_of(at), of).collect()} == set(range(12))


def test_band_keys_collide_as_often_as_stated(spark):
    # a window of 12 and a run of 9 of its shingles, then with one and with two of them missing
    draw = random.Random(7)
    hashes = lambda n: [draw.getrandbits(64) - (1 << 63) for _ in range(n)]
    rows = [(n, k, hashes(9)) for n in range(400) for k in (0, 1, 2)]
    runs = licenses.band_keys(spark.createDataFrame(rows, "n int, k int, window array<bigint>"))
    wide = [(n, k, r[: 9 - k] + hashes(3 + k)) for n, k, r in rows]
    windows = licenses.band_keys(spark.createDataFrame(wide, "n int, k int, window array<bigint>"))
    shared = {r["k"]: r["share"] for r in runs.join(windows, ["n", "k", "key"]).groupBy("k").agg(
        (F.count("key") / (400 * licenses.BANDS)).alias("share")).collect()}
    for k, similarity in ((0, 9 / 12), (1, 8 / 13), (2, 7 / 14)):
        assert abs(shared[k] - similarity**licenses.ROWS) < 0.05
