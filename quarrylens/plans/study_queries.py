"""Registered rating-study queries (H1-H14, J8, J9) on the driver tables.

Binding (all derived from the driver tables, so the work grows with them):

* runs - ``conversations``: a conversation is a question (its first user
  turn), its assistant turns are the answers of the three systems in turn
  order (a 4th+ turn is an extra system). The id prefix - the category -
  is ``CTX`` when the conversation carries a system turn, else ``OPEN``.
  Conversations without exactly three answers are the blinding error path.
* participants - the distinct ``events.user_id``.
* forms - every participant rates ``RATED`` stimuli, dealt out by the
  incomplete block design, ten items each.
* landed form submissions - each participant's ``signup`` events
  (submission id = event id, submitted at = ts). The answers of a
  submission are the participant's other events up to it: ``k`` is the place
  on the participant's own form in percent, a later answer to an item replaces
  an earlier one. They are landed as one nested JSON payload per participant,
  half of the stimuli in the label form and half in the grid form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.operators import study
from quarrylens.plans.bindings import table
from quarrylens.spec import EMPTY_ANSWER_PLACEHOLDER, ESS_ITEMS, LIKERT_SCALE, SYSTEMS

STUDY_SEED = 42
PER_CATEGORY = 4
#: Stimuli on each participant's form.
RATED = 2
ROLES = ESS_ITEMS + ["comment"]


def study_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    head = conv.groupBy("conv_id").agg(
        F.max((F.col("role") == "system").cast("int")).alias("_ctx"),
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("question"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    systems = F.array(*[F.lit(s) for s in SYSTEMS])
    ans = (conv.filter(F.col("role") == "assistant")
           .withColumn("_k", F.row_number().over(w))
           .select("conv_id", F.col("text").alias("answer"),
                   F.when(F.col("_k") <= len(SYSTEMS), F.element_at(systems, F.col("_k")))
                   .otherwise(F.concat(F.lit("extra_"), F.col("_k").cast("string"))).alias("system")))
    cat = F.when(F.col("_ctx") == 1, F.lit("CTX")).otherwise(F.lit("OPEN"))
    return ans.join(head, "conv_id").select(
        F.format_string("%s-%04d", cat, F.col("conv_id")).alias("question_id"),
        cat.alias("category"), "question", "system", "answer")


def _blinded(spark, sf_dir):
    runs = study_runs(spark, sf_dir)
    ids = study.select_question_ids(runs, PER_CATEGORY, STUDY_SEED)
    stimuli, key, errors = study.blind(runs, ids, STUDY_SEED)
    return ids, stimuli, key, errors


STUDY_TABLES = ["conversations"]
STIMULUS_COLUMNS = ["stimulus_id", "question_id", "category", "system_blinded_label", "question",
                    "answer_text"]


def _study_key(spark, sf_dir) -> DataFrame:
    """The blinded stimulus table with its randomisation key, written
    once per input version (the original wrote both as files) and read by
    the sheets, the form items and the summary."""
    from quarrylens.plans.artifacts import data_version, table_or_build

    def build():
        _, stimuli, key, _ = _blinded(spark, sf_dir)
        return stimuli.join(key.select("stimulus_id", "system_actual"), "stimulus_id")

    return table_or_build(spark, "study_key", build, sf_dir=sf_dir, seed=STUDY_SEED,
                          per_category=PER_CATEGORY, data=data_version(spark, sf_dir, STUDY_TABLES))


def _stimuli(spark, sf_dir) -> DataFrame:
    return _study_key(spark, sf_dir).select(*STIMULUS_COLUMNS)


def blind_stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 H2 H6: public stimulus rows with the randomisation key attached."""
    return _study_key(spark, sf_dir)


def study_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: one row - seed, per-category size, selected questions, stimuli,
    blinding errors, participants."""
    ids, _, _, errors = _blinded(spark, sf_dir)
    stimuli = _stimuli(spark, sf_dir)
    parts = [
        ids.agg(F.count(F.lit(1)).alias("n_selected"),
                F.concat_ws(",", F.array_sort(F.collect_set("category"))).alias("categories"),
                F.min("pool").alias("min_pool")),
        stimuli.agg(F.count(F.lit(1)).alias("n_stimuli")),
        errors.agg(F.count(F.lit(1)).alias("n_blinding_errors")),
        _participants(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_participants")),
    ]
    # Four single-row aggregates stacked and folded into one row.
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    cols = ["n_selected", "categories", "min_pool", "n_stimuli", "n_blinding_errors", "n_participants"]
    return stacked.agg(*[F.max(c).alias(c) for c in cols]).select(
        F.lit(STUDY_SEED).alias("seed"), F.lit(PER_CATEGORY).alias("per_category"), *cols)


def _participants(spark, sf_dir):
    return (table(spark, sf_dir, "events").select("user_id").distinct()
            .select(F.format_string("P%04d", F.col("user_id")).alias("participant_id")))


def _sheets(spark, sf_dir):
    return study.participant_sheets(_participants(spark, sf_dir), _stimuli(spark, sf_dir), STUDY_SEED)


def participant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant's sheet in display order."""
    s = _sheets(spark, sf_dir)
    return s.select("participant_id", F.col("display_order").cast("bigint").alias("display_order"),
                    "stimulus_id", "question_id", "system_blinded_label", "answer_text",
                    F.col("ESS-1").alias("ess_1_blank"))


def _assigned(spark, sf_dir, rated: int = RATED):
    return study.assigned_blocks(_participants(spark, sf_dir), _stimuli(spark, sf_dir), rated, STUDY_SEED)


def block_assignment(spark: SparkSession, sf_dir: str, rated: int = RATED) -> DataFrame:
    """H3 for a study too long for one person: the stimuli on each
    participant's form, an incomplete block design."""
    return _assigned(spark, sf_dir, rated).select("participant_id", F.col("slot").cast("bigint").alias("slot"), "stimulus_id", "question_id",
                                                  "system_blinded_label")


def question_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: per participant and question, the A/B/C block and its first slot."""
    b = study.question_blocks(_sheets(spark, sf_dir))
    return b.select("participant_id", "question_id", "category",
                    F.col("first_display").cast("bigint").alias("first_display"),
                    F.size("answers").cast("bigint").alias("n_answers"),
                    F.concat_ws(",", F.col("answers.stimulus_id")).alias("stimulus_ids"),
                    "complete")


def _latest_submissions(spark, sf_dir):
    """H8 over submission headers (one row per landed submission)."""
    subs = (table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
            .select(F.format_string("P%04d", F.col("user_id")).alias("participant_id"),
                    F.col("event_id").alias("submission_id"),
                    F.col("ts").alias("lastSubmittedTime")))
    subs = subs.withColumn("_order", F.struct("lastSubmittedTime", "submission_id"))
    return study.latest_submission(subs, ts="_order").drop("_order")


def _items(stimuli: DataFrame) -> DataFrame:
    """Form items titled with the stimulus id: one per role for stimuli of
    even number, for the others one comment item and one grid, whose rows are
    the rating items."""
    x = stimuli.select("stimulus_id", _number("stimulus_id").alias("n"), F.posexplode(F.array(*[F.lit(r) for r in ROLES])).alias("at", "role"))
    title = F.format_string("%s - %s", F.col("stimulus_id"), F.col("role"))
    own = F.substring(F.md5(title), 1, 12)
    grid = F.substring(F.md5(F.concat("stimulus_id", F.lit(" - grid"))), 1, 12)
    in_grid = (F.col("n") % 2 == 1) & (F.col("role") != "comment")
    item = F.when(in_grid, F.concat(grid, F.lit("#"), F.col("at").cast("string"))).otherwise(own)
    return x.select(item.alias("item_id"), title.alias("title"), "role", "stimulus_id")


def _number(stimulus_id: str):
    return F.substring(stimulus_id, 2, 18).cast("int")


def _landed_payloads(spark, sf_dir, rated: int = RATED):
    """H9 input: per participant the payload of the latest submission. An
    event is an answer: its ``k`` is the place on the participant's form, in
    percent, its value the label or, for a comment, whether its type is the
    text; the last answer to an item up to the submission counts."""
    latest = _latest_submissions(spark, sf_dir)
    place = F.floor(F.get_json_object("props", "$.k").cast("int") * (rated * len(ROLES)) / 100).cast("int")
    ev = table(spark, sf_dir, "events").where("event_type <> 'signup'").select(
        F.format_string("P%04d", "user_id").alias("participant_id"), "event_id", "ts", "event_type", "value", place.alias("item"))
    given = ev.join(latest, "participant_id").where(F.col("ts") <= F.col("lastSubmittedTime"))
    last = given.groupBy("participant_id", "item").agg(
        F.max_by(F.struct("value", "event_type"), F.struct("ts", "event_id")).alias("e"))
    forms = _assigned(spark, sf_dir, rated).select("participant_id", "slot", F.col("stimulus_id").alias("s"))
    slot, at = F.floor(F.col("item") / len(ROLES)), F.col("item") % len(ROLES)
    last = last.withColumn("slot", slot.cast("int")).join(forms, ["participant_id", "slot"])
    v = F.floor("e.value").cast("int") % 11
    label = F.when(v == 0, F.lit("")).otherwise(F.get(F.array(*[F.lit(x) for x in LIKERT_SCALE]), (v - 1) % 5))
    comment = F.when(v < 6, F.col("e.event_type")).otherwise(F.lit(""))
    x = last.select("participant_id", "s", (_number("s") % 2 == 1).alias("odd"), at.cast("int").alias("at"), v.alias("v"),
                    label.alias("label"), comment.alias("comment"))
    is_comment = F.col("at") == len(ROLES) - 1
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("at"))
    title = F.when(F.col("odd") & ~is_comment, F.concat("s", F.lit(" - grid"))).otherwise(F.concat("s", F.lit(" - "), role))
    cell = F.when(F.col("odd") & ~is_comment & (F.col("v") > 0), F.struct(
        F.col("at").alias("rowIndex"), ((F.col("v") - 1) % 5).alias("columnIndex")))
    one = lambda c: F.struct(F.array(F.struct(c.alias("value"))).alias("answers"))
    # a form has a bounded number of items, so has each participant's map
    per_item = x.groupBy("participant_id", F.substring(F.md5(title), 1, 12).alias("q")).agg(
        F.max(F.when(is_comment, F.col("comment"))).alias("text"),
        F.max(F.when(~is_comment & ~F.col("odd"), F.col("label"))).alias("choice"),
        F.sort_array(F.collect_list(cell)).alias("cells"), F.bool_or(F.col("odd") & ~is_comment).alias("grid"))
    answer = F.struct(
        F.when(F.col("choice").isNotNull(), one(F.col("choice"))).alias("choiceQuestion"),
        F.when(F.col("text").isNotNull(), one(F.col("text"))).alias("textAnswers"),
        F.when(F.col("grid"), F.struct(F.col("cells").alias("answers"))).alias("gridAnswers"))
    return per_item.groupBy("participant_id").agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("q", answer))).alias("answers"))).alias("payload"))


def _landed_answers(spark, sf_dir):
    return study.landed_answers(_landed_payloads(spark, sf_dir)), _items(_stimuli(spark, sf_dir))


def flatten_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest submission, answers joined to the item
    registry, Likert labels scored 1..5, one row per participant x stimulus."""
    answers, items = _landed_answers(spark, sf_dir)
    reg = study.item_registry(items)
    return study.flatten_answers(answers, reg)


def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness check, key join, summary table - one
    aggregate over the flattened responses (rejected rows counted by
    reason: incomplete, unknown stimulus)."""
    key = _study_key(spark, sf_dir)
    flat = flatten_responses(spark, sf_dir)
    as_text = flat.select("participant_id", "stimulus_id", "comment",
                          *[F.col(i).cast("string").alias(i) for i in ESS_ITEMS])
    scored = study.score_items(as_text)
    joined = scored.join(key.select("stimulus_id", "category", "system_actual"), "stimulus_id", "left")
    status = (F.when(~F.col("complete"), F.lit("incomplete"))
              .when(F.col("system_actual").isNull(), F.lit("unknown_stimulus"))
              .otherwise(F.lit("ok")))
    return study.summarize(joined.withColumn("_status", status), status="_status")


QUERIES = {
    "blind_stimuli": blind_stimuli,
    "study_manifest": study_manifest,
    "participant_order": participant_order,
    "question_blocks": question_blocks,
    "block_assignment": block_assignment,
    "flatten_responses": flatten_responses,
    "rating_summary": rating_summary,
}


# --------------------------------------------------------------------------
# DuckDB oracle SQL
# --------------------------------------------------------------------------
def _md5(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

_RUNS = f"""
runs_head AS (
  SELECT conv_id,
         max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS ctx,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS question
  FROM conversations GROUP BY conv_id),
runs_ans AS (
  SELECT conv_id, text AS answer,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
  FROM conversations WHERE role = 'assistant'),
runs AS (
  SELECT printf('%s-%04d', CASE WHEN h.ctx = 1 THEN 'CTX' ELSE 'OPEN' END, h.conv_id) AS question_id,
         CASE WHEN h.ctx = 1 THEN 'CTX' ELSE 'OPEN' END AS category,
         h.question,
         CASE WHEN a.k <= {len(SYSTEMS)} THEN {_sql_list(SYSTEMS)}[a.k]
              ELSE 'extra_' || CAST(a.k AS VARCHAR) END AS system,
         a.answer
  FROM runs_ans a JOIN runs_head h USING (conv_id)),
qids AS (
  SELECT DISTINCT question_id, split_part(question_id, '-', 1) AS category FROM runs),
ranked AS (
  SELECT question_id, category,
         row_number() OVER (PARTITION BY category
                            ORDER BY {_md5('category', 'question_id', f"'{STUDY_SEED}'")}, question_id) AS r,
         count(*) OVER (PARTITION BY category) AS pool
  FROM qids),
selected AS (SELECT question_id, category, pool FROM ranked WHERE r <= {PER_CATEGORY}),
sel_runs AS (SELECT * FROM runs WHERE question_id IN (SELECT question_id FROM selected)),
cnt AS (SELECT question_id, count(*) AS n_answers FROM sel_runs GROUP BY question_id),
ok AS (SELECT * FROM sel_runs WHERE question_id IN (SELECT question_id FROM cnt WHERE n_answers = 3)),
qrank AS (SELECT question_id, row_number() OVER (ORDER BY question_id) AS q
          FROM (SELECT DISTINCT question_id FROM ok)),
blinded AS (
  SELECT o.*, qr.q,
         row_number() OVER (PARTITION BY o.question_id
                            ORDER BY {_md5('o.question_id', 'o.system', f"'{STUDY_SEED}'")}, o.system) AS i
  FROM ok o JOIN qrank qr USING (question_id)),
stim AS (
  SELECT printf('S%03d', (q - 1) * 3 + i) AS stimulus_id, question_id, category,
         ['A', 'B', 'C'][i] AS system_blinded_label, question,
         CASE WHEN {_STRIP.format(x="coalesce(answer, '')")} = '' THEN '{EMPTY_ANSWER_PLACEHOLDER}'
              ELSE {_STRIP.format(x="coalesce(answer, '')")} END AS answer_text,
         system AS system_actual
  FROM blinded),
participants AS (SELECT DISTINCT printf('P%04d', user_id) AS participant_id FROM events),
sheets AS (
  SELECT p.participant_id, s.*,
         row_number() OVER (PARTITION BY p.participant_id
                            ORDER BY {_md5('p.participant_id', 's.question_id', f"'{STUDY_SEED}'")},
                                     s.question_id, s.system_blinded_label) AS display_order
  FROM participants p, stim s)
"""

_RESP = f"""
subs AS (
  SELECT printf('P%04d', user_id) AS participant_id, event_id AS submission_id, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type = 'signup'),
size AS (SELECT count(*) AS n, least(count(*), {RATED}) AS b FROM stim),
steps AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS turn, count(*) OVER () AS turns
          FROM size, range(1, (SELECT n FROM size)) t(s) WHERE n // gcd(n, s) >= b),
ranks AS (SELECT participant_id, row_number() OVER (ORDER BY {_md5('participant_id', f"'{STUDY_SEED}'")}, participant_id) - 1 AS r FROM participants),
forms AS (SELECT r.participant_id, slot, st.stimulus_id, st.question_id, st.system_blinded_label,
                 CAST(substr(st.stimulus_id, 2) AS INTEGER) % 2 = 1 AS odd
          FROM ranks r, size JOIN steps ON steps.turn = (r.r // size.n) % steps.turns, range(0, {RATED}) t(slot)
          JOIN stim st ON CAST(substr(st.stimulus_id, 2) AS INTEGER) - 1 = (r.r + slot * steps.s) % size.n),
given AS (
  SELECT printf('P%04d', e.user_id) AS participant_id, e.value, e.event_type,
         CAST(json_extract_string(e.props, '$.k') AS INTEGER) * {RATED * len(ROLES)} // 100 AS item,
         row_number() OVER (PARTITION BY e.user_id, CAST(json_extract_string(e.props, '$.k') AS INTEGER) * {RATED * len(ROLES)} // 100
                            ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM events e JOIN (SELECT participant_id, max(ts) AS last_ts FROM subs GROUP BY participant_id) l
       ON l.participant_id = printf('P%04d', e.user_id)
  WHERE e.event_type <> 'signup' AND e.ts <= l.last_ts),
valued0 AS (
  SELECT g.participant_id, f.stimulus_id, f.odd, {_sql_list(ROLES)}[item % {len(ROLES)} + 1] AS role,
         CASE WHEN item % {len(ROLES)} = {len(ROLES) - 1} THEN (CASE WHEN CAST(floor(value) AS INTEGER) % 11 < 6 THEN event_type ELSE '' END)
              WHEN CAST(floor(value) AS INTEGER) % 11 = 0 THEN ''
              ELSE {_sql_list(LIKERT_SCALE)}[(CAST(floor(value) AS INTEGER) % 11 - 1) % 5 + 1] END AS value
  FROM given g JOIN forms f ON f.participant_id = g.participant_id AND f.slot = item // {len(ROLES)} WHERE rn = 1),
valued AS (  -- a blank cell of a grid (stimuli of odd number) is no answer at all
  SELECT * FROM valued0 WHERE NOT (value = '' AND odd AND role <> 'comment')),
flat AS (
  SELECT participant_id, stimulus_id,
         {", ".join(f'''max(CASE WHEN role = '{e}' THEN CAST(nullif(list_position({_sql_list(LIKERT_SCALE)}, {_STRIP.format(x="value")}), 0) AS INTEGER) END) AS "{e}"''' for e in ESS_ITEMS)},
         coalesce(max(CASE WHEN role = 'comment' THEN {_STRIP.format(x="value")} END), '') AS comment
  FROM valued GROUP BY participant_id, stimulus_id)
"""


def _oracle() -> dict:
    o = {}
    o["blind_stimuli"] = f"""WITH {_RUNS}
SELECT stimulus_id, question_id, category, system_blinded_label, question, answer_text, system_actual
FROM stim"""
    o["study_manifest"] = f"""WITH {_RUNS}
SELECT {STUDY_SEED} AS seed, {PER_CATEGORY} AS per_category,
       (SELECT count(*) FROM selected) AS n_selected,
       (SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM selected) AS categories,
       (SELECT min(pool) FROM selected) AS min_pool,
       (SELECT count(*) FROM stim) AS n_stimuli,
       (SELECT count(*) FROM cnt WHERE n_answers <> 3) AS n_blinding_errors,
       (SELECT count(*) FROM participants) AS n_participants"""
    o["participant_order"] = f"""WITH {_RUNS}
SELECT participant_id, display_order, stimulus_id, question_id, system_blinded_label, answer_text,
       '' AS ess_1_blank
FROM sheets"""
    o["question_blocks"] = f"""WITH {_RUNS}
SELECT participant_id, question_id, category, min(display_order) AS first_display,
       count(*) AS n_answers,
       string_agg(stimulus_id, ',' ORDER BY system_blinded_label) AS stimulus_ids,
       count(*) = 3 AS complete
FROM sheets GROUP BY participant_id, question_id, category, question"""
    o["block_assignment"] = f"""WITH {_RUNS}, {_RESP}
SELECT participant_id, CAST(slot AS BIGINT) AS slot, stimulus_id, question_id, system_blinded_label FROM forms"""
    o["flatten_responses"] = f"""WITH {_RUNS}, {_RESP}
SELECT * FROM flat"""
    ess = [f'"{e}"' for e in ESS_ITEMS]
    o["rating_summary"] = f"""WITH {_RUNS}, {_RESP},
good AS (
  SELECT f.*, ({" + ".join(ess)}) / {len(ESS_ITEMS)}.0 AS ess_mean
  FROM flat f WHERE {" AND ".join(f"{e} IS NOT NULL" for e in ess)}),
j AS (SELECT g.*, s.category, s.system_actual FROM good g LEFT JOIN stim s USING (stimulus_id)),
jm AS (SELECT * FROM j WHERE system_actual IS NOT NULL),
stacked AS (
  {" UNION ALL ".join(f"SELECT '{e}' AS item, CAST({q} AS DOUBLE) AS v FROM jm" for e, q in zip(ESS_ITEMS, ess))})
SELECT 'overall' AS scope, 'all' AS name, round(avg(ess_mean), 3) AS value, count(*) AS n FROM jm
UNION ALL
SELECT 'system', system_actual, round(avg(ess_mean), 3), count(*) FROM jm GROUP BY system_actual
UNION ALL
SELECT 'category', category, round(avg(ess_mean), 3), count(*) FROM jm GROUP BY category
UNION ALL
SELECT 'item', item, round(avg(v), 3), count(*) FROM stacked GROUP BY item
UNION ALL
SELECT 'participants', 'distinct', CAST(count(DISTINCT participant_id) AS DOUBLE), count(*) FROM jm
UNION ALL
SELECT 'rejected', 'incomplete', CAST(count(*) AS DOUBLE), count(*) FROM flat
  WHERE NOT ({" AND ".join(f"{e} IS NOT NULL" for e in ess)})
UNION ALL
SELECT 'rejected', 'unknown_stimulus', CAST(count(*) AS DOUBLE), count(*) FROM j WHERE system_actual IS NULL"""
    return o


ORACLE = _oracle()
