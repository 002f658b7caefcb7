"""Conversation repair against SQL, exhaustive search and edge cases."""

import hashlib
import itertools
import random
import re

import duckdb
from pyspark.sql import functions as F
from tests_llm_helpers import SF_SMALL

from quarrylens.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, copies string, audit string, kind string"
LEGAL = re.compile("(s?(ua)+)?")


def _sql(table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM {table}")
    return sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({repair.ORACLE})").fetchall()), key=str)


def _exhaustive(rows):
    """(cost, audit) by trying every edit of every row, with up to two insertions in each gap."""
    best = None
    insertions = ["", "u", "a", "ua", "au"]
    for edits in itertools.product("KRrD", repeat=len(rows)):
        if any(e != "D" and fault == "d" for e, (_, fault) in zip(edits, rows)):
            continue
        cost = sum({"K": 0, "R": 1, "r": 1, "D": 2}[e] + 5 * (e != "D" and f == "t") for e, (_, f) in zip(edits, rows))
        if best and cost > best[0]:
            continue
        own = [{"K": k, "R": "u", "r": "a", "D": ""}[e] for e, (k, _) in zip(edits, rows)]
        for gaps in itertools.product(insertions, repeat=len(rows) + 1):
            n = cost + 5 * sum(map(len, gaps))
            if best and n > best[0]:
                continue
            if LEGAL.fullmatch(gaps[0] + "".join(o + g for o, g in zip(own, gaps[1:]))):
                audit = "I" * len(gaps[0]) + "".join(e.upper() + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                best = min(best or (n, audit), (n, audit))
    return best


def _spans(rows, span=None):
    s = repair.Spans()
    for r in rows:
        s.add_row(*r)
    return repair.parse(s.cell())


def test_chart_matches_exhaustive_search():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice(["", "", "t", "d"])) for _ in range(rng.randint(0, 4))]
        assert _spans(rows) == _exhaustive(rows), rows


def _left_to_right(rows):
    """The same optimum by one pass over the rows, state by state."""
    now = {p: repair.EMPTY[repair._AT[0, p]] for p in range(4) if repair.EMPTY[repair._AT[0, p]]}
    for r in rows:
        cell, then = repair.row_cell(*r), {}
        for (p, q), c in zip(repair.CELLS, cell):
            if c and p in now:
                option = (now[p][0] + c[0], now[p][1] + c[1])
                then[q] = min(then.get(q, option), option)
        now = then
    return min(now[q] for q in (0, 3) if q in now)


def test_long_conversations_join_spans():
    rng = random.Random(6)
    for n in (15, 16, 17, 300, 2000):
        rows = [(rng.choice("uauasx"), rng.choice(["", "", "", "t", "d"])) for _ in range(n)]
        assert _spans(rows) == _left_to_right(rows)
        halves = []
        for part in (rows[: n // 3], rows[n // 3 :]):  # as two tasks would see it
            s = repair.Spans()
            for r in part:
                s.add_row(*r)
            halves.append(s.cell())
        assert repair.parse(repair.joined(*halves)) == _spans(rows)


def test_query_matches_sql(spark):
    got = sorted((tuple(r) for r in repair.query(spark, SF_SMALL).select(*COLUMNS).collect()), key=str)
    assert got == _sql(f"read_parquet('{SF_SMALL}/conversations.parquet')") and any(r[6] for r in got)


def test_edges_match_sql_over_many_tasks(spark, tmp_path):
    """Nulls, empty and repeated rows, gaps, odd roles, and one conversation spread over tasks."""
    rng = random.Random(8)
    texts = ["Yes.", "No!", "and then", "", " \t\n", None, "What?", "Fine. ", "é …", "x" * 400_000 + "."]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "", None, "tool", "User"]),
             rng.choice(texts)) for _ in range(60)]
    rows += [(50, k, rng.choice(["user", "assistant"]), f"Turn {rng.randint(0, 150)}{rng.choice(['.', '', '?'])}") for k in range(400)]
    rows += [(51, 4, "user", "again.")] * 30 + [(52, None, None, None)] + [(60 + k, 0, "user", "Hi.") for k in range(40)]
    # rows of one turn are ordered by role and text; their first 256 characters decide, so no two long ones share a turn here
    rows = list({(c, t, str(r), str(x)[:256]): (c, t, r, x) for c, t, r, x in rows}.values()) + [(51, 4, "user", "again.")] * 3
    table = spark.createDataFrame([(*r, "9", "K", "s") for r in rows], SCHEMA)
    table.write.parquet(str(tmp_path / "c"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the small partitions apart
    try:
        damaged = repair.damaged(spark.read.parquet(str(tmp_path / "c")))
        found = repair.reports(damaged, "copies")
        hashes = repair.repaired_digests(damaged, found, "copies").select(F.col("conv_id").alias("c"), "repaired_sha256")
        out = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")))
        got = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str)
        turns = repair.repaired_turns(damaged, found, "copies").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == _sql(f"read_parquet('{tmp_path}/c/*.parquet')")
    said = {}
    for r in sorted(turns, key=lambda r: (str(r["conv_id"]), r["place"])):
        said.setdefault(r["conv_id"], []).append(r)
    for row in got:
        mine = said.get(row[0], [])
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert LEGAL.fullmatch("".join(r["role"][0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == row[8]
        assert [r["edit"] for r in mine] == [e for e in row[7] if e != "D"]


def test_undamaged_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.reports(empty).count() == 0
    assert repair.repaired_digests(empty, repair.reports(empty)).count() == 0
    fine = spark.createDataFrame([(1, 0, "system", "Be kind.", *"9Ks"), (1, 1, "user", "Hi!", *"9Ks"), (1, 2, "assistant", "Hello.", *"9Ks"),
                                  (2, 7, "system", "Alone.", *"9Ks"), (3, 0, "user", "One?", *"9Ks"), (3, 3, "user", "Two?", *"9Ks")], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.reports(fine).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "KKK")
    assert got[2] == (0, 0, 0, 0, 0, 2, "D")  # a lone system turn is no conversation
    assert got[3] == (2, 0, 0, 0, 1, 1, "KR")
    dropped = repair.reports(fine.withColumn("times", F.lit(0)), "times").collect()
    assert {tuple(r) for r in dropped} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)}
