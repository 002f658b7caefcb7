"""Blinded rating study.

Randomisation is md5-ordered (reproducible, unlike a salted Python hash).
Windows here are either per question (exactly three rows) or per
participant sheet (questions x 3 rows, bounded by the study design), never
over raw records. The only global window ranks the selected question ids,
a list bounded by ``per_category x categories``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import md5_order, strip_ws
from quarrylens.spec import EMPTY_ANSWER_PLACEHOLDER, ESS_ITEMS, LIKERT_SCALE, SYSTEM_LABELS

STIMULUS_REGEX = r"\b(S\d{3,})\b"  # S%03d: three digits or more


def question_category(qid) -> Column:
    """H1: text before the first '-'."""
    c = F.col(qid) if isinstance(qid, str) else qid
    return F.substring_index(c, "-", 1)


def display_answer(answer) -> Column:
    """H6: blank answers get the fixed placeholder."""
    a = F.col(answer) if isinstance(answer, str) else answer
    s = strip_ws(F.coalesce(a, F.lit("")))
    return F.when(s == "", F.lit(EMPTY_ANSWER_PLACEHOLDER)).otherwise(s)


def select_question_ids(runs: DataFrame, per_category: int, seed: int) -> DataFrame:
    """P7 for the study: ``per_category`` question ids per category (from the
    id prefix), md5-ordered. Returns (question_id, category, pool).

    ``row_number() <= k`` plans as ``WindowGroupLimit``: every map task keeps
    only its own top k per category before the shuffle, so a category that
    holds most of the questions still ships k rows per task, not all of them.
    The pool size is an ordinary (map-side combined) count.
    """
    q = runs.select("question_id").distinct().withColumn("category", question_category("question_id"))
    w = Window.partitionBy("category").orderBy("_h", "question_id")
    top = (q.withColumn("_h", md5_order("category", "question_id", F.lit(str(seed))))
           .withColumn("_r", F.row_number().over(w))
           .filter(F.col("_r") <= per_category))
    pool = q.groupBy("category").agg(F.count(F.lit(1)).alias("pool"))
    return top.join(pool, "category").select("question_id", "category", "pool")


def blind(runs: DataFrame, question_ids: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H2: (stimuli, key, errors).

    Each selected question must have exactly three answers; they are
    shuffled by md5(question|system|seed) and labelled A/B/C; stimulus ids
    are global, S001... in question-id order.
    """
    sel = runs.join(question_ids.select("question_id"), "question_id", "left_semi")
    cnt = sel.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_answers"))
    errors = cnt.filter(F.col("n_answers") != len(SYSTEM_LABELS))
    ok = sel.join(cnt.filter(F.col("n_answers") == len(SYSTEM_LABELS)).select("question_id"),
                  "question_id", "left_semi")
    qrank = (ok.select("question_id").distinct()
             .withColumn("_q", F.row_number().over(Window.orderBy("question_id"))))
    w = Window.partitionBy("question_id").orderBy("_h", "system")
    labels = F.array(*[F.lit(x) for x in SYSTEM_LABELS])
    b = (ok.join(qrank, "question_id")
         .withColumn("_h", md5_order("question_id", "system", F.lit(str(seed))))
         .withColumn("_i", F.row_number().over(w))
         .withColumn("system_blinded_label", F.element_at(labels, F.col("_i")))
         .withColumn("stimulus_id", F.format_string("S%03d", (F.col("_q") - 1) * 3 + F.col("_i")))
         .withColumn("category", F.coalesce(F.col("category"), question_category("question_id"))))
    stimuli = b.select("stimulus_id", "question_id", "category", "system_blinded_label", "question",
                       display_answer("answer").alias("answer_text"))
    key = b.select("stimulus_id", "question_id", "category", "system_blinded_label",
                   F.col("system").alias("system_actual"))
    return stimuli, key, errors


def participant_sheets(participants: DataFrame, stimuli: DataFrame, seed: int) -> DataFrame:
    """H3 + H4 + J9: every participant rates every stimulus; questions in a
    per-participant md5 order, answers A/B/C within a question; running
    ``display_order``; blank rating columns.

    This is a product by design (the study shows every stimulus to every
    participant). The stimulus side is the study set, bounded by
    per_category x categories x 3 rows; no hint is given, so Spark
    broadcasts it only when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    j = participants.select("participant_id").join(stimuli, how="inner", on=F.lit(True))
    w = Window.partitionBy("participant_id").orderBy("_h", "question_id", "system_blinded_label")
    j = (j.withColumn("_h", md5_order("participant_id", "question_id", F.lit(str(seed))))
         .withColumn("display_order", F.row_number().over(w)).drop("_h"))
    return j.select("participant_id", "display_order", *stimuli.columns,
                    *[F.lit("").alias(i) for i in ESS_ITEMS], F.lit("").alias("comment"))


def hashed_rank(rows: DataFrame, key: str, seed: int, rank: str = "rank") -> DataFrame:
    """``rows`` (distinct ``key``) with their rank, from 0, in md5 order. Ranks
    are taken within the 4096 md5 prefixes, whose counts give the offsets, so
    no window holds more than one prefix."""
    h = rows.withColumn("_h", md5_order(key, F.lit(str(seed)))).withColumn("_p", F.substring("_h", 1, 3))
    counts = h.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_p")  # at most 4096 rows
    offsets = counts.select("_p", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_p").orderBy("_h", key)
    return (h.join(F.broadcast(offsets), "_p").withColumn(rank, F.col("_before") + F.row_number().over(within) - 1)
            .drop("_h", "_p", "_before"))


def block_steps(n_stimuli: int, size: int) -> list[int]:
    """The rotations of an incomplete block design: steps with which ``size``
    places around a circle of ``n_stimuli`` are all different."""
    from math import gcd

    return [s for s in range(1, n_stimuli) if n_stimuli // gcd(n_stimuli, s) >= size] or [0]


def assigned_blocks(participants: DataFrame, stimuli: DataFrame, size: int, seed: int) -> DataFrame:
    """H3 as an incomplete block design: each participant rates ``size``
    stimuli, rotated over all of them. The participant of md5 rank r gets the
    stimuli r, r + step, r + 2 step, ... around the circle, and the step
    changes with every turn: stimuli are rated equally often (within one turn's
    remainder), and over all steps each pair of places comes together equally
    often. Rows: participant_id, ``slot`` (from 0) and the stimulus columns.

    One row per participant and slot joins its stimulus by number, so the
    product of participants and stimuli is never formed."""
    numbered = stimuli.withColumn("_at", F.row_number().over(Window.orderBy("stimulus_id")) - 1)  # the study set, bounded by its design
    n = numbered.count()
    size = min(size, n)
    steps = block_steps(n, size) if n else [0]
    turns = participants.sparkSession.createDataFrame(list(enumerate(steps)), "_turn long, _step long")
    ranked = hashed_rank(participants.select("participant_id").distinct(), "participant_id", seed, "_r")
    ranked = ranked.withColumn("_turn", F.floor(F.col("_r") / max(n, 1)) % len(steps)).join(turns, "_turn")
    slots = ranked.select("participant_id", "_r", "_step", F.explode(F.sequence(F.lit(0), F.lit(max(size, 1) - 1))).alias("slot"))
    slots = slots.withColumn("_at", (F.col("_r") + F.col("slot") * F.col("_step")) % max(n, 1))
    return slots.join(numbered, "_at").select("participant_id", "slot", *stimuli.columns)


def question_blocks(sheets: DataFrame) -> DataFrame:
    """H7: one row per (participant, question) with its answers in label
    order and a flag for blocks that do not hold exactly three answers."""
    packed = F.struct("system_blinded_label", "stimulus_id", "answer_text")
    g = sheets.groupBy("participant_id", "question_id", "category", "question").agg(
        F.array_sort(F.collect_list(packed)).alias("answers"),
        F.min("display_order").alias("first_display"))
    return g.withColumn("complete", F.size("answers") == len(SYSTEM_LABELS))


def latest_submission(responses: DataFrame, pid: str = "participant_id",
                      ts: str = "lastSubmittedTime") -> DataFrame:
    """H8: newest submission per participant (an aggregate, not a window)."""
    rest = [c for c in responses.columns if c != pid]
    return (responses.groupBy(pid).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_r"))
            .select(pid, "_r.*"))


def likert_score(value) -> Column:
    """Label text -> 1..5; unknown text -> null (array_position gives 0)."""
    v = F.col(value) if isinstance(value, str) else value
    pos = F.array_position(F.array(*[F.lit(s) for s in LIKERT_SCALE]), strip_ws(v))
    return F.when(pos > 0, pos.cast("int"))


def grid_score(column_index) -> Column:
    """0-based grid column -> 1..5; out of range -> null (flag it)."""
    c = F.col(column_index) if isinstance(column_index, str) else column_index
    return F.when((c >= 0) & (c < len(LIKERT_SCALE)), (c + 1).cast("int"))


def item_registry(items: DataFrame, title: str = "title", item_id: str = "item_id",
                  role: str = "role") -> DataFrame:
    """Form items -> stimulus id by ``STIMULUS_REGEX`` in the title; one
    row per stimulus with the comment item and the 9 rating items in order.
    ``role`` is 'comment' or 'ESS-<n>'."""
    x = items.withColumn("stimulus_id", F.regexp_extract(title, STIMULUS_REGEX, 1)) \
             .filter(F.col("stimulus_id") != "")
    return x.groupBy("stimulus_id").agg(
        F.max(F.when(F.col(role) == "comment", F.col(item_id))).alias("comment_item"),
        *[F.max(F.when(F.col(role) == e, F.col(item_id))).alias(e) for e in ESS_ITEMS])


#: A landed form response: answers by question id, each a choice, a text or a grid.
_VALUES = "struct<answers: array<struct<value: string>>>"
LANDED_SCHEMA = ("answers map<string, struct<choiceQuestion: " + _VALUES + ", textAnswers: " + _VALUES
                 + ", gridAnswers: struct<answers: array<struct<rowIndex: int, columnIndex: int>>>>>")


def landed_answers(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """H9: landed response payloads (participant_id, JSON) -> answer rows
    (participant_id, item_id, value), first value of each choice or text. A
    grid's rows become items ``<question>#<row>`` with the label of their
    0-based column (H10); a column outside the scale gives a null value."""
    parsed = payloads.select("participant_id", F.explode(F.from_json(payload, LANDED_SCHEMA)["answers"]).alias("item_id", "a"))
    single = F.coalesce(F.get(F.col("a.choiceQuestion.answers.value"), F.lit(0)),
                        F.get(F.col("a.textAnswers.answers.value"), F.lit(0)))
    scale = F.array(*[F.lit(s) for s in LIKERT_SCALE])
    grid = F.transform(F.col("a.gridAnswers.answers"), lambda g: F.struct(
        F.concat(F.col("item_id"), F.lit("#"), g["rowIndex"].cast("string")).alias("item_id"),
        F.get(scale, grid_score(g["columnIndex"]) - 1).alias("value")))
    rows = F.when(F.col("a.gridAnswers").isNotNull(), grid).otherwise(
        F.array(F.struct(F.col("item_id"), single.alias("value"))))
    return parsed.select("participant_id", F.explode(rows).alias("r")).select("participant_id", "r.item_id", "r.value")


def flatten_answers(answers: DataFrame, registry: DataFrame) -> DataFrame:
    """H9: (participant_id, item_id, value) answer rows + registry ->
    one row per (participant, stimulus) with ESS-1..9 scores and comment."""
    reg = registry.select("stimulus_id", F.explode(F.array(
        *[F.struct(F.lit(e).alias("role"), F.col(e).alias("item_id")) for e in ESS_ITEMS],
        F.struct(F.lit("comment").alias("role"), F.col("comment_item").alias("item_id")))).alias("r")
    ).select("stimulus_id", "r.role", "r.item_id").filter(F.col("item_id").isNotNull())
    j = answers.join(reg, "item_id")
    out = j.groupBy("participant_id", "stimulus_id").agg(
        *[F.max(F.when(F.col("role") == e, likert_score(F.col("value")))).alias(e) for e in ESS_ITEMS],
        F.coalesce(F.max(F.when(F.col("role") == "comment", strip_ws(F.col("value")))),
                   F.lit("")).alias("comment"))
    return out


def score_items(responses: DataFrame) -> DataFrame:
    """H12 + H13 in one projection: items as doubles, ``complete`` flag and
    ``ess_mean`` (null when any item is missing)."""
    vals = [F.expr(f"try_cast(nullif(trim(`{i}`), '') AS double)") for i in ESS_ITEMS]
    x = responses.select(*[c for c in responses.columns if c not in ESS_ITEMS],
                         F.array(*vals).alias("_items"))
    complete = ~F.exists("_items", lambda v: v.isNull())
    x = x.withColumn("complete", complete).withColumn(
        "ess_mean", F.when(F.col("complete"), F.aggregate("_items", F.lit(0.0), lambda a, v: a + v)
                           / len(ESS_ITEMS)))
    return x.select("*", *[F.col("_items")[n].alias(i) for n, i in enumerate(ESS_ITEMS)]).drop("_items")


def require_complete(responses: DataFrame) -> DataFrame:
    """H12 strict mode (the original's behaviour): raise when any response
    misses an item; otherwise return the scored rows. One count job; only
    the number of bad rows and one example id reach the driver."""
    scored = score_items(responses)
    bad = scored.filter(~F.col("complete"))
    n_bad = bad.count()
    if n_bad:
        first = bad.select("participant_id", "stimulus_id").orderBy("participant_id", "stimulus_id").first()
        raise ValueError(f"{n_bad} incomplete responses, e.g. participant {first[0]} stimulus {first[1]}")
    return scored


def completeness(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H12 + H13: (complete rows with ``ess_mean``, rejected rows).

    Items arrive as strings; blank or non-numeric = missing. The original
    raised on the first incomplete row; here they are returned for review.
    """
    vals = [F.expr(f"try_cast(nullif(trim(`{i}`), '') AS double)") for i in ESS_ITEMS]
    x = responses.select("*", F.array(*vals).alias("_items"))
    bad = F.exists("_items", lambda v: v.isNull())
    good = x.filter(~bad).withColumn(
        "ess_mean", F.aggregate("_items", F.lit(0.0), lambda a, v: a + v) / len(ESS_ITEMS))
    for n, i in enumerate(ESS_ITEMS):
        good = good.withColumn(i, F.col("_items")[n])
    return good.drop("_items"), x.filter(bad).drop("_items")


def summarize(joined: DataFrame, status: str | None = None,
              reasons: tuple = ("incomplete", "unknown_stimulus")) -> DataFrame:
    """Long table (scope, name, value, n): overall, by system, by
    category, by item (3 decimals), distinct participants; with ``status``
    (values 'ok' or a reject reason) also one ('rejected', reason) row each.

    One pass: every response row is exploded into the (scope, name, value)
    entries it contributes to, then a single grouped aggregate (partial +
    final, one shuffle of at most 13 entries per row) computes them all.
    """
    ok = F.lit(True) if status is None else (F.col(status) == "ok")

    def entry(scope, name, v):
        return F.struct(F.lit(scope).alias("scope"), name.alias("name"), v.alias("v"))

    mean = F.col("ess_mean").cast("double")
    good = F.array(entry("overall", F.lit("all"), mean),
                   entry("system", F.col("system_actual").cast("string"), mean),
                   entry("category", F.col("category").cast("string"), mean),
                   *[entry("item", F.lit(i), F.col(i).cast("double")) for i in ESS_ITEMS],
                   entry("participants", F.lit("distinct"), F.lit(None).cast("double")))
    bad = F.array(entry("rejected", F.col(status) if status else F.lit(""), F.lit(None).cast("double")))
    e = joined.select("participant_id", F.explode(F.when(ok, good).otherwise(bad)).alias("e"))
    g = e.groupBy("e.scope", "e.name").agg(F.avg("e.v").alias("_avg"), F.count(F.lit(1)).alias("n"),
                                           F.countDistinct("participant_id").alias("_people"))
    value = (F.when(F.col("scope") == "participants", F.col("_people").cast("double"))
             .when(F.col("scope") == "rejected", F.col("n").cast("double"))
             .otherwise(F.round("_avg", 3)))
    out = g.select("scope", "name", value.alias("value"), "n")
    if status is None:
        return out
    # Every reject reason is reported, with 0 when no row has it: the
    # aggregated table (a few dozen rows) is topped up and re-summed.
    zeros = joined.sparkSession.createDataFrame(
        [("rejected", r, 0.0, 0) for r in reasons], "scope string, name string, value double, n bigint")
    rej = (out.filter(F.col("scope") == "rejected").unionByName(zeros)
           .groupBy("scope", "name").agg(F.sum("value").alias("value"), F.sum("n").alias("n")))
    return out.filter(F.col("scope") != "rejected").unionByName(rej)
