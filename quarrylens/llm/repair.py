"""Conversation repair: weighted CYK parsing of turns into a legal dialogue.

The role initials of a sound conversation are ``(s?(ua)+)?``. A row may be kept
(cost 0), given the role user or assistant (1) or deleted (2); an empty user or
assistant turn may be inserted anywhere (5). Rows without any text, and rows
whose role and text were seen before in their conversation, must be deleted; a
row whose text does not end a sentence costs 5 more unless it is deleted.

The grammar is in Chomsky normal form. The nonterminal [p>q] derives the spans
of rows that lead a dialogue from state p to state q (0 nothing yet, 1 after
the system turn, 2 after a user turn, 3 after an assistant turn), with the
rules [p>q] -> [p>r] [r>q]; a row's edits are the terminals, insertions derive
the empty span and are closed into every row's cell on both sides. A cell holds
per nonterminal the least (cost, audit); audit is the edits' initials (D, I, K,
R) in order. Two audits of one span and cost never are prefixes of each other
(both spend a letter on each row, and what one has beyond that are insertions,
which cost), so the least concatenation is made of least parts.

Cells are combined bottom-up by span length: first over the rows of a
conversation, ``SPAN`` rows to a chart, then over the spans so found. As any
run of consecutive rows has a cell, a conversation with a third of all rows is
range-sorted over many tasks, each of which sends one cell. Equal rows are
counted before anything is sorted, and what was seen before is an aggregate
joined back on, never a gathered conversation. The repaired text follows the
audit through the rows, sorted within their conversation, one row at a time; a
SHA-256 has to be fed in order, so one task streams (and never holds) one
conversation's rows.

Defined cases: null roles and texts are one blank, and a null conv_id or turn
counts as one blank where ids are hashed; rows without turn come first; rows
of one turn are ordered by role, then by text (its first ``HEAD`` characters,
then its hash); a null conv_id is a conversation of its own; one without rows
gets zeros, an empty audit and the hash of the empty string; an empty table
gives no rows; other columns are ignored; texts of any length are only hashed
and looked at from their end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import stored
from quarrylens.llm.manifest import crc32_sql

RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPAN, HEAD = 16, 256
BLANKS = " \t\n\v\f\r"

#: Nonterminals [p>q], and the legal steps from state to state.
CELLS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
_AT = {c: i for i, c in enumerate(CELLS)}
RULES = [(_AT[p, r], _AT[r, q], _AT[p, q]) for p, r in CELLS for r2, q in CELLS if r == r2 and (p, q) in _AT]

Cell = list  # per nonterminal: (cost, audit) or None


def joined(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """The best parses of two neighbouring spans together."""
    out = [None] * len(CELLS) if into is None else into
    for i, j, k in RULES:
        if (a := left[i]) is None or (b := right[j]) is None:
            continue
        cost, best = a[0] + b[0], out[k]
        if best is None or cost < best[0]:
            out[k] = (cost, a[1] + b[1])
        elif cost == best[0] and (audit := a[1] + b[1]) < best[1]:
            out[k] = (cost, audit)
    return out


def _cell(options: Iterable[tuple[tuple[int, int], int, str]]) -> Cell:
    out: Cell = [None] * len(CELLS)
    for step, cost, audit in options:
        at = _AT[step]
        if out[at] is None or (cost, audit) < out[at]:
            out[at] = (cost, audit)
    return out


_STATES = range(4)
#: The empty span: nothing, or the insertions that lead from state to state.
EMPTY = _cell([*(((p, p), 0, "") for p in _STATES), *((s, INSERT, "I") for s in STEPS["u"] + STEPS["a"]),
               *(((p, 3), 2 * INSERT, "II") for p in (0, 1))])


@lru_cache(1 << 14)
def row_cell(kind: str, fault: str, copies: int = 1) -> tuple:
    """The cell of a row: ``kind`` is its role's initial, s, u, a or another,
    ``fault`` one of "", "t" (truncated), "d" (to be deleted); ``copies`` more
    rows to be deleted count with it."""
    options = [((p, p), DELETE * copies, "D" * copies) for p in _STATES]
    if fault != "d":
        extra = TRUNCATED if fault == "t" else 0
        options += [(step, extra, "K") for step in STEPS.get(kind, [])]
        options += [(step, RELABEL + extra, "R") for step in STEPS["u"] + STEPS["a"]]
    return tuple(joined(joined(EMPTY, _cell(options)), EMPTY))


def chart(leaves: list) -> Cell:
    """CYK over consecutive spans: cells of all runs of them, by length."""
    if not leaves:
        return EMPTY
    cells = {(i, i + 1): leaf for i, leaf in enumerate(leaves)}
    for length in range(2, len(leaves) + 1):
        for i in range(len(leaves) - length + 1):
            into: Cell = [None] * len(CELLS)
            for cut in range(i + 1, i + length):
                joined(cells[i, cut], cells[cut, i + length], into)
            cells[i, i + length] = into
    return cells[0, len(leaves)]


@lru_cache(1 << 15)
def _rows_chart(rows: tuple) -> tuple:
    return tuple(chart([row_cell(*r) for r in rows]))


class Spans:
    """Cells of a run of rows, however long: at most ``SPAN`` per level."""

    def __init__(self) -> None:
        self.rows: list = []
        self.levels: list[list] = []

    def add_row(self, *row) -> None:
        self.rows.append(row)
        if len(self.rows) == SPAN:
            self.add(_rows_chart(tuple(self.rows)))
            self.rows = []

    def add(self, cell, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(cell)
        if len(self.levels[level]) == SPAN:
            whole, self.levels[level] = chart(self.levels[level]), []
            self.add(whole, level + 1)

    def cell(self) -> Cell:
        out = _rows_chart(tuple(self.rows)) if self.rows else EMPTY
        for level in self.levels:  # higher levels come before lower ones
            if level:
                out = joined(chart(level), out)
        return out


def parse(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of the cheapest legal dialogue over a cell's rows."""
    return min(c for c in (cell[_AT[0, 0]], cell[_AT[0, 3]]) if c)


class Summary:
    """What one run of a conversation's rows tells about it."""

    COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]

    def __init__(self) -> None:
        self.spans, self.first, self.last, self.low, self.high = Spans(), None, None, None, None
        self.counts = dict.fromkeys(self.COUNTS, 0)

    def _turn(self, low, high, turns: int) -> None:
        if low is None:
            return
        self.counts["turns"] += turns - (self.high == low)
        self.low, self.high = low if self.low is None else self.low, high

    def _roles(self, first: str, last: str) -> None:
        if self.last is not None:
            self.counts["illegal"] += self.last + first not in ("su", "ua", "au")
        self.first, self.last = first if self.first is None else self.first, last

    def add_rows(self, kind: str, blank: bool, seen: bool, truncated: bool, copies: int, turn) -> None:
        """``copies`` equal rows; ``seen``: also before them."""
        whole = not (blank or seen)
        self._turn(turn, turn, 1)
        self._roles(kind, kind)
        self.counts["illegal"] += copies - 1
        self.counts["blank"] += copies if blank else 0
        self.counts["duplicate"] += 0 if blank else copies - whole
        self.counts["truncated"] += whole and truncated
        if whole:
            self.spans.add_row(kind, "t" if truncated else "")
        if copies > whole:
            self.spans.add_row(kind, "d", copies - whole)

    def add_run(self, run: dict) -> None:
        self._turn(run["low"], run["high"], run["turns"])
        self._roles(run["first"], run["last"])
        for c in self.COUNTS[:-1]:
            self.counts[c] += run[c]
        self.spans.add([(c, a) if a is not None else None for c, a in zip(run["costs"], run["audits"])])

    def record(self) -> dict:
        cell = self.spans.cell()
        return {"first": self.first, "last": self.last, "low": self.low, "high": self.high, **self.counts,
                "costs": [c[0] if c else None for c in cell], "audits": [c[1] if c else None for c in cell]}


_RUN = "first string, last string, low long, high long, blank long, duplicate long, truncated long, illegal long, turns long, costs array<long>, audits array<string>"
_RUN_TYPES = [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), *((c, pa.int64()) for c in Summary.COUNTS),
              ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]


def _order(text: Column) -> list[Column]:
    """Sort keys of a text, short whatever its length."""
    return [F.left(text, F.lit(HEAD)).alias("_head"), F.sha2(text, 256).alias("_hash")]


def _plain(rows: DataFrame, copies: str | None) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", blank("role"), blank("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of (conv_id, turn, role, text, copies), without texts:
    kind, blank, truncated, seen (role and text occur before), copies."""
    end = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise(F.lit("x"))
    keys = ["conv_id", "turn", "role", "_head", "_hash", "kind", "blank", "truncated"]
    distinct = rows.select(
        "conv_id", "turn", "role", *_order(F.col("text")), kind.alias("kind"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies").groupBy(*keys).agg(F.sum("copies").alias("copies"))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn")  # orders null turns first
    first = distinct.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_hash").alias("_h")).agg(F.min(turn).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_hash") == F.col("_h"))
    return distinct.join(first, same).select(*keys, "copies", (turn > F.col("_first")).alias("seen"))


def runs(found: DataFrame) -> DataFrame:
    """One ``Summary`` per conversation and task, over range-sorted rows."""
    kind = dict(found.dtypes)["conv_id"]
    keys = ["conv_id", "turn", "role", "_head", "_hash"]
    ordered = found.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", "kind", "blank", "seen", "truncated", "copies", F.col("turn").cast("long").alias("turn"))

    def each(batches):
        now, at, first = None, None, True

        def done():
            row = now.record()
            return pa.RecordBatch.from_arrays([pa.array([at], conv_type), *(pa.array([row[n]], t) for n, t in _RUN_TYPES)],
                                              names=["conv_id", *(n for n, _ in _RUN_TYPES)])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if first or conv != at:
                    if now is not None:
                        yield done()
                    now, at, first = Summary(), conv, False
                now.add_rows(*row)
        if now is not None:
            yield done()

    placed = ordered.mapInArrow(each, f"conv_id {kind}, {_RUN}")
    return placed.withColumn("part", F.spark_partition_id())


def reports(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per
    conversation of (conv_id, turn, role, text). ``copies`` names a column
    with how often each row stands there; rows of no copies only name their
    conversation."""
    rows = _plain(conversations, copies)
    kind = dict(rows.dtypes)["conv_id"]
    counts = ["gaps", *Summary.COUNTS[:-1], "cost"]

    def whole(batches):
        """Joins the runs of each conversation, in the order of their tasks."""
        held, conv_type, now, at = [], None, None, None

        def report():
            cost, audit = parse(now.spans.cell())
            gaps = 0 if now.low is None else now.high - now.low + 1 - now.counts["turns"]
            held.append((at, gaps, *(now.counts[c] for c in Summary.COUNTS[:-1]), cost, audit))

        def out():
            c = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c[0], conv_type), *(pa.array(x, pa.int64()) for x in c[1:-1]), pa.array(c[-1], pa.string())],
                                              names=["conv_id", *counts, "audit"])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for run in batch.to_pylist():
                if now is None or run["conv_id"] != at:
                    if now is not None:
                        report()
                    now, at = Summary(), run["conv_id"]
                now.add_run(run)
            if held:
                yield out()
                held.clear()
        if now is not None:
            report()
            yield out()

    parts = runs(faults(rows.where("copies > 0"))).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    parsed = parts.mapInArrow(whole, ", ".join([f"conv_id {kind}", *(f"{c} long" for c in counts), "audit string"]))
    parsed = parsed.select(F.col("conv_id").alias("_c"), *counts, "audit")
    every = rows.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    return every.join(parsed, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


class Editor:
    """Follows an audit through a conversation's rows."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _step(self, role: str | None) -> str:
        """The role at this place, by default what the state asks for."""
        role = role if role is not None else "assistant" if self.state == 2 else "user"
        self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._step(None), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns up to and with this row's own."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, self._step(role if edit == "K" else None), text


def _sorted_rows(conversations: DataFrame, audits: DataFrame, copies: str | None) -> DataFrame:
    """Every conversation's audit and then its rows, in order."""
    rows = _plain(conversations, copies).where("copies > 0").select("conv_id", "turn", "role", "text", "copies", *_order(F.col("text")), F.lit(1).alias("_tag"))
    heads = audits.select("conv_id", F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
                          F.lit(0).cast("long").alias("copies"), F.lit("").alias("_head"), F.lit("").alias("_hash"), F.lit(0).alias("_tag"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "_tag", "turn", "role", "_head", "_hash").select(
        "conv_id", "_tag", "role", "text", "copies")


def _edited(batches) -> Iterator[tuple[object, bool, str | None, str | None, str | None]]:
    """(conv_id, at its end, edit, role, text) over sorted rows."""
    now, at = None, None
    for batch in batches:
        for conv, tag, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if tag == 0:
                if now is not None:
                    yield from ((at, False, *turn) for turn in now.inserted())
                    yield at, True, None, None, None
                now, at = Editor(text), conv
            for _ in range(copies):
                yield from ((at, False, *turn) for turn in now.row(role, text))
    if now is not None:
        yield from ((at, False, *turn) for turn in now.inserted())
        yield at, True, None, None, None


def repaired_turns(conversations: DataFrame, audits: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations' turns;
    ``audits`` holds (conv_id, audit), as ``reports`` gives them."""
    kind = dict(conversations.dtypes)["conv_id"]

    def each(batches):
        held, place, conv_type = [], 0, None

        def rows():
            c = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c[0], conv_type), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:])],
                                              names=["conv_id", "place", "edit", "role", "text"])

        def typed():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv_id").type
                yield batch

        for conv, end, edit, role, text in _edited(typed()):
            if end:
                place = 0
                continue
            held.append((conv, place, edit, role, text))
            place += 1
            if len(held) == 1024:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return _sorted_rows(conversations, audits, copies).mapInArrow(each, f"conv_id {kind}, place long, edit string, role string, text string")


def repaired_digests(conversations: DataFrame, audits: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired turns' ``role:text``, joined
    by newlines, fed to the hash turn by turn."""
    kind = dict(conversations.dtypes)["conv_id"]

    def each(batches):
        out, conv_type, sha, some = [], None, hashlib.sha256(), False

        def typed():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv_id").type
                yield batch

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], conv_type), pa.array([h for _, h in out], pa.string())],
                                              names=["conv_id", "repaired_sha256"])

        for conv, end, _, role, text in _edited(typed()):
            if end:
                out.append((conv, sha.hexdigest()))
                sha, some = hashlib.sha256(), False
                if len(out) == 4096:
                    yield rows()
                    out.clear()
                continue
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
        if out:
            yield rows()

    return _sorted_rows(conversations, audits, copies).mapInArrow(each, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's faults: rows dropped (no copies), emptied, robbed of their
    sentence ends, repeated (two copies) or given the role user, by id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return conversations.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies"))


_KEY = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"

ORACLE = f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_KEY)} % 20 AS k FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM x),
g AS (SELECT *, ends = '' AS blank, ends <> '' AND seen AS duplicate, ends <> '' AND NOT seen AND right(ends, 1) NOT IN ('.', '!', '?') AS truncated,
             row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair
      FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
e(p, q, c, a, t) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
  (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
s(p, q, z) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
o AS (SELECT g.conv_id, g.i, p, p AS q, 2 AS c, 'D' AS a, '' AS t FROM g, range(4) r(p)
      UNION ALL SELECT g.conv_id, g.i, s.p, s.q, 5 * truncated::INT, 'K', chr(10) || role || ':' || text
      FROM g JOIN s ON left(role, 1) = s.z WHERE NOT blank AND NOT duplicate
      UNION ALL SELECT g.conv_id, g.i, s.p, s.q, 1 + 5 * truncated::INT, 'R', chr(10) || CASE s.z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
      FROM g JOIN s ON s.z <> 's' WHERE NOT blank AND NOT duplicate),
v(conv_id, i, q, m) AS (
  SELECT c.conv_id, 0::BIGINT, e.q, {{'c': e.c::BIGINT, 'a': e.a, 't': e.t}} FROM (SELECT DISTINCT conv_id FROM conversations) c, e WHERE e.p = 0
  UNION ALL
  SELECT v.conv_id, v.i + 1, e.q, min({{'c': v.m.c + o.c + e.c, 'a': v.m.a || o.a || e.a, 't': v.m.t || o.t || e.t}})
  FROM v JOIN o ON o.conv_id IS NOT DISTINCT FROM v.conv_id AND o.i = v.i + 1 AND o.p = v.q JOIN e ON e.p = o.q GROUP BY v.conv_id, v.i, e.q),
n AS (SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate,
             sum(truncated::INT) AS truncated, sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM g GROUP BY conv_id),
b AS (SELECT v.conv_id, min(m) AS m, any_value(n.gaps) AS gaps, any_value(n.blank) AS blank, any_value(n.duplicate) AS duplicate,
             any_value(n.truncated) AS truncated, any_value(n.illegal) AS illegal
      FROM v LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id WHERE v.i = coalesce(n.n, 0) AND v.q IN (0, 3) GROUP BY v.conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, m.c AS cost, m.a AS audit,
       sha256(substr(m.t, 2)) AS repaired_sha256 FROM b
"""


def query(spark, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = stored(reports(rows, "copies"), "repair-reports")
    hashes = repaired_digests(rows, found, "copies").select(F.col("conv_id").alias("_c"), "repaired_sha256")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
