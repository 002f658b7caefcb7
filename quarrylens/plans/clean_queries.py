"""Registered ingest queries: cleaning, joins, splits, samples, profile."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import invalid_code
from quarrylens.operators import cleaning, joins, profile, split
from quarrylens.plans.bindings import (
    DRIVER_SPEC, INCIDENTS_SQL, RAW_INCIDENTS_SQL, RAW_SPEC, SITES_SQL, incident_table, raw_incidents, sites, table,
)
from quarrylens.plans.sqlgen import canon, cleaned_cte, inv, rule_case, split_cte, tagged_cte

CODE_COLUMNS = ["DOCUMENT_NO", "MINE_ID", "DEGREE_INJURY_CD", "CAL_YR", "SUBUNIT_CD",
                "CLASSIFICATION_CD", "OCCUPATION_CD", "ACTIVITY_CD", "MINING_EQUIP_CD",
                "NARRATIVE"]


def string_normalise(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    norm = cleaning.normalise_strings(docs.select("doc_id", "text", "lang", "source"))
    return norm.select("doc_id", F.length("text").alias("text_len"),
                       F.md5("text").alias("text_md5"), "lang", "source",
                       invalid_code("text").alias("text_invalid"))


def clean_waterfall(spark: SparkSession, sf_dir: str):
    return cleaning.waterfall(cleaning.tag_rules(raw_incidents(spark, sf_dir), RAW_SPEC), RAW_SPEC)


def clean_rows(spark: SparkSession, sf_dir: str):
    c = cleaning.clean(raw_incidents(spark, sf_dir), RAW_SPEC)
    return c.select("DOCUMENT_NO", "MINE_ID", "DEGREE_INJURY_CD", "CAL_YR", "MINING_EQUIP_CD",
                    F.date_format("ACCIDENT_DT", "yyyy-MM-dd").alias("ACCIDENT_DAY"), "DAYS_LOST")


def dedup_drop_all(spark: SparkSession, sf_dir: str):
    return cleaning.drop_duplicates_all(raw_incidents(spark, sf_dir, narrative=False), "DOCUMENT_NO") \
        .select("DOCUMENT_NO", "PART_NO", "MINE_ID")


def dedup_keep_first(spark: SparkSession, sf_dir: str):
    return cleaning.keep_first(raw_incidents(spark, sf_dir, narrative=False), "DOCUMENT_NO",
                               ["PART_NO", "MINE_ID", "DAYS_LOST"],
                               keep_cols=["DOCUMENT_NO", "PART_NO", "MINE_ID", "DAYS_LOST"])


def impute_sentinel(spark: SparkSession, sf_dir: str):
    imp = cleaning.impute_sentinel(raw_incidents(spark, sf_dir, narrative=False), "MINING_EQUIP_CD")
    return (imp.groupBy("MINING_EQUIP_CD", "MINING_EQUIP_CD_imputed")
            .agg(F.count(F.lit(1)).alias("n")))


def invalid_profile(spark: SparkSession, sf_dir: str):
    return cleaning.invalid_profile(raw_incidents(spark, sf_dir), CODE_COLUMNS)


#: Suppliers up to which the site dimension is broadcast.
BROADCAST_SITES = 500_000
MERGED_TABLES = ["lineitem", "documents", "supplier", "nation"]


def build_merged(spark, sf_dir):
    cleaned = cleaning.clean(raw_incidents(spark, sf_dir), RAW_SPEC)
    site = cleaning.keep_first(sites(spark, sf_dir), "MINE_ID", ["CURRENT_MINE_TYPE"])
    # measured: a dimension of so few short rows is broadcast, and narratives stay where they are
    if table(spark, sf_dir, "supplier").count() <= BROADCAST_SITES:
        site = F.broadcast(site)
    return joins.left_join_flagged(cleaned, site, "MINE_ID")


def _joined(spark, sf_dir):
    """S3 + S4: the cleaned, site-joined table, written once per input
    version and read back (the original wrote its processed tables and
    split from the file). Summaries and splits then scan a stored table
    instead of re-running cleaning and both joins once per branch."""
    from quarrylens.plans.artifacts import data_version, table_or_build

    return table_or_build(spark, "merged_incidents", lambda: build_merged(spark, sf_dir),
                          sf_dir=sf_dir, data=data_version(spark, sf_dir, MERGED_TABLES))


def left_join_flagged(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    return joins.left_join_flagged(docs, labels, "doc_id", flag="LABEL_MATCH")


def join_audit(spark: SparkSession, sf_dir: str):
    return joins.join_audit(_joined(spark, sf_dir))


def _holdout(spark, sf_dir):
    from quarrylens.plans.model_queries import holdout_split

    return holdout_split(spark, sf_dir)


def split_stratified(spark: SparkSession, sf_dir: str):
    s = _holdout(spark, sf_dir)
    return s.select("DOCUMENT_NO", "stratum", "split")


def split_disjoint(spark: SparkSession, sf_dir: str):
    s = _holdout(spark, sf_dir)
    train = s.filter(F.col("split") == "train")
    test = s.filter(F.col("split") == "test")
    return joins.overlap_count(train, test, "DOCUMENT_NO")


def split_out_of_time(spark: SparkSession, sf_dir: str):
    o = split.out_of_time(incident_table(spark, sf_dir), DRIVER_SPEC)
    return o.groupBy("split", "CAL_YR").agg(F.count(F.lit(1)).alias("n"))


def rare_strata_collapse(spark: SparkSession, sf_dir: str):
    spec = DRIVER_SPEC.with_(target="PRICE_FINE_CD")
    inc = incident_table(spark, sf_dir)
    counts = inc.withColumn("label", split.stratum_label(spec)).groupBy("label") \
        .agg(F.count(F.lit(1)).alias("n"))
    m = split.collapse_rare(counts)
    return m.agg(F.countDistinct("stratum").alias("strata_count"),
                 F.count_if(F.col("stage") == 1).alias("rare_stage1"),
                 F.count_if(F.col("stage") == 2).alias("rare_stage2"),
                 F.count(F.lit(1)).alias("labels"),
                 F.max(F.when(F.col("stage") == 2, F.col("stratum"))).alias("modal_target"))


def sample_seeded(spark: SparkSession, sf_dir: str):
    return split.seeded_sample(incident_table(spark, sf_dir), "DOCUMENT_NO", 20, 42) \
        .select("DOCUMENT_NO", "DEGREE_INJURY_CD", "CAL_YR")


def sample_per_category(spark: SparkSession, sf_dir: str):
    s = split.sample_per_category(incident_table(spark, sf_dir), "CLASSIFICATION", "DOCUMENT_NO", 3, 7)
    return s.select("CLASSIFICATION", "DOCUMENT_NO", F.col("_rank").alias("rank_in_category"))


def class_distribution(spark: SparkSession, sf_dir: str):
    s = _holdout(spark, sf_dir)
    return profile.class_distribution(s, DRIVER_SPEC, split_col="split")


def year_distribution(spark: SparkSession, sf_dir: str):
    return profile.year_distribution(incident_table(spark, sf_dir), DRIVER_SPEC)


def ingest_summary(spark: SparkSession, sf_dir: str):
    raw = raw_incidents(spark, sf_dir)
    joined = _joined(spark, sf_dir)
    s = split.stratified_split(joined, RAW_SPEC)
    return profile.ingestion_summary(raw, joined, s, joined, RAW_SPEC)


def ingest_report(spark: SparkSession, sf_dir: str):
    """A5: the whole ingestion report of one run, as one long table."""
    joined = _joined(spark, sf_dir)
    s = split.stratified_split(joined, RAW_SPEC)
    return profile.ingestion_report(ingest_summary(spark, sf_dir), clean_waterfall(spark, sf_dir), joined, s, RAW_SPEC)


QUERIES = {
    "string_normalise": string_normalise,
    "clean_waterfall": clean_waterfall,
    "clean_rows": clean_rows,
    "dedup_drop_all": dedup_drop_all,
    "dedup_keep_first": dedup_keep_first,
    "impute_sentinel": impute_sentinel,
    "invalid_profile": invalid_profile,
    "left_join_flagged": left_join_flagged,
    "join_audit": join_audit,
    "split_stratified": split_stratified,
    "split_disjoint": split_disjoint,
    "split_out_of_time": split_out_of_time,
    "rare_strata_collapse": rare_strata_collapse,
    "sample_seeded": sample_seeded,
    "sample_per_category": sample_per_category,
    "class_distribution": class_distribution,
    "year_distribution": year_distribution,
    "ingest_summary": ingest_summary,
    "ingest_report": ingest_report,
}


# --------------------------------------------------------------------------
# DuckDB oracle SQL
# --------------------------------------------------------------------------
_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in
                ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])


def _clean_sql(c: str) -> str:
    s = f"regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '^\"+|\"+$', '', 'g')"
    return f"(CASE WHEN {s} IN ({_NA}) THEN NULL ELSE {s} END)"


WR = "WITH " + RAW_INCIDENTS_SQL
WI = "WITH " + INCIDENTS_SQL
_case, _names = rule_case(RAW_SPEC)
_steps = ", ".join(f"({i}, '{n}')" for i, n in enumerate(["raw_loaded"] + _names))
_impute_no = _names.index("impute_missing_equipment_as_UNK") + 1

_WATERFALL = WR + "," + tagged_cte("raw_incidents", RAW_SPEC) + f""",
steps(step_no, step) AS (VALUES {_steps}),
per AS (SELECT coalesce(rule, 0) AS step_no, count(*) AS n, count(*) FILTER (WHERE equip_bad) AS n_equip,
        sum(CASE WHEN rule = 1 THEN 1.0 / copies END) AS key_share
        FROM tagged GROUP BY 1),
j AS (SELECT s.step_no, s.step, coalesce(p.n, 0) AS n, coalesce(p.n_equip, 0) AS n_equip, p.key_share
      FROM steps s LEFT JOIN per p USING (step_no)),
w AS (SELECT *, sum(n) OVER () AS total,
        sum(CASE WHEN step_no = 0 THEN 0 ELSE n END) OVER (ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dropped,
        sum(CASE WHEN step_no = 0 OR step_no > {_impute_no} THEN n_equip ELSE 0 END) OVER () AS imputed
      FROM j)
SELECT step_no, step,
  CAST(CASE WHEN step_no = 0 THEN 0 ELSE total - dropped + n END AS BIGINT) AS rows_before,
  CAST(CASE WHEN step_no = 0 THEN total ELSE total - dropped END AS BIGINT) AS rows_after,
  CAST(CASE WHEN step_no = 0 THEN 0 ELSE n END AS BIGINT) AS rows_removed,
  CAST(CASE WHEN step_no = {_impute_no} THEN imputed END AS BIGINT) AS rows_imputed,
  CAST(CASE WHEN step_no = 1 THEN n - round(key_share) END AS BIGINT) AS dup_surplus
FROM w WHERE NOT (step_no = 1 AND n = 0)"""

_JOINED = WR + ", " + SITES_SQL + "," + cleaned_cte("raw_incidents", RAW_SPEC) + """,
site1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY MINE_ID ORDER BY CURRENT_MINE_TYPE) AS rn
          FROM sites WHERE MINE_ID IS NOT NULL) WHERE rn = 1),
joined AS (SELECT c.*, s.STATE, s.NO_EMPLOYEES, s.CURRENT_MINE_TYPE, s.MINE_ID IS NOT NULL AS MINE_MATCH
           FROM cleaned c LEFT JOIN site1 s USING (MINE_ID))"""

_SPLIT_I = WI + "," + split_cte("incidents", DRIVER_SPEC)

ORACLE = {
    "string_normalise": f"""
SELECT doc_id, length(t) AS text_len, md5(t) AS text_md5, l AS lang, s AS source,
       {inv('t')} AS text_invalid
FROM (SELECT doc_id, {_clean_sql('text')} AS t, {_clean_sql('lang')} AS l, {_clean_sql('source')} AS s
      FROM documents)""",
    "clean_waterfall": _WATERFALL,
    "clean_rows": WR + "," + cleaned_cte("raw_incidents", RAW_SPEC) + """
SELECT DOCUMENT_NO, MINE_ID, DEGREE_INJURY_CD, CAL_YR, MINING_EQUIP_CD,
       strftime(strptime(ACCIDENT_DT, '%m/%d/%Y'), '%Y-%m-%d') AS ACCIDENT_DAY,
       try_cast(DAYS_LOST AS DOUBLE) AS DAYS_LOST
FROM cleaned""",
    "dedup_drop_all": WR + """
SELECT DOCUMENT_NO, PART_NO, MINE_ID FROM raw_incidents
WHERE DOCUMENT_NO NOT IN (SELECT DOCUMENT_NO FROM raw_incidents GROUP BY 1 HAVING count(*) > 1)""",
    "dedup_keep_first": WR + """
SELECT DOCUMENT_NO, PART_NO, MINE_ID, DAYS_LOST FROM (
  SELECT *, row_number() OVER (PARTITION BY DOCUMENT_NO ORDER BY PART_NO, MINE_ID, DAYS_LOST) AS rn
  FROM raw_incidents WHERE DOCUMENT_NO IS NOT NULL) WHERE rn = 1""",
    "impute_sentinel": WR + f"""
SELECT CASE WHEN {inv('MINING_EQUIP_CD')} THEN 'UNK' ELSE MINING_EQUIP_CD END AS MINING_EQUIP_CD,
       {inv('MINING_EQUIP_CD')} AS MINING_EQUIP_CD_imputed, count(*) AS n
FROM raw_incidents GROUP BY ALL""",
    "invalid_profile": WR + ", p AS (SELECT count(*) AS n, " + ", ".join(
        f"count(*) FILTER (WHERE {inv(c)}) AS b{i}" for i, c in enumerate(CODE_COLUMNS))
    + " FROM raw_incidents)\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, b{i} AS n_invalid, round(b{i} / n, 6) AS share_invalid FROM p"
        for i, c in enumerate(CODE_COLUMNS)),
    "left_join_flagged": """
SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS LABEL_MATCH
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "join_audit": _JOINED + """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE MINE_MATCH) AS matched_rows,
       count(*) FILTER (WHERE NOT MINE_MATCH) AS unmatched_rows FROM joined""",
    "split_stratified": _SPLIT_I + "\nSELECT DOCUMENT_NO, stratum, split FROM split",
    "split_disjoint": _SPLIT_I + """
SELECT count(*) AS overlap FROM (SELECT DOCUMENT_NO FROM split WHERE split = 'train'
  INTERSECT SELECT DOCUMENT_NO FROM split WHERE split = 'test')""",
    "split_out_of_time": WI + f"""
SELECT CASE WHEN CAL_YR <= {DRIVER_SPEC.oot_train_max} THEN 'train' ELSE 'test' END AS split,
       CAL_YR, count(*) AS n
FROM incidents WHERE CAL_YR <= {DRIVER_SPEC.oot_train_max} OR CAL_YR >= {DRIVER_SPEC.oot_test_min}
GROUP BY ALL""",
    "rare_strata_collapse": WI + "," + split_cte(
        "incidents", DRIVER_SPEC.with_(target="PRICE_FINE_CD")) + """
SELECT count(DISTINCT stratum) AS strata_count, count(*) FILTER (WHERE stage = 1) AS rare_stage1,
       count(*) FILTER (WHERE stage = 2) AS rare_stage2, count(*) AS labels,
       max(CASE WHEN stage = 2 THEN stratum END) AS modal_target FROM smap""",
    "sample_seeded": WI + """
SELECT DOCUMENT_NO, DEGREE_INJURY_CD, CAL_YR FROM incidents
ORDER BY md5(DOCUMENT_NO || '|42'), DOCUMENT_NO LIMIT 20""",
    "sample_per_category": WI + """
SELECT CLASSIFICATION, DOCUMENT_NO, rank_in_category FROM (
  SELECT CLASSIFICATION, DOCUMENT_NO, row_number() OVER (PARTITION BY CLASSIFICATION
     ORDER BY md5(DOCUMENT_NO || '|7'), DOCUMENT_NO) AS rank_in_category FROM incidents)
WHERE rank_in_category <= 3""",
    "class_distribution": _SPLIT_I + f"""
SELECT split, {canon('DEGREE_INJURY_CD')} AS code, count(*) AS n, min(DEGREE_INJURY) AS label
FROM split GROUP BY ALL""",
    "year_distribution": WI + """
SELECT CAL_YR, count(*) AS n FROM incidents WHERE CAL_YR IS NOT NULL GROUP BY 1""",
    "ingest_summary": _JOINED + "," + split_cte("joined", RAW_SPEC) + f"""
SELECT 'rows' AS section, 'raw' AS name, CAST(count(*) AS BIGINT) AS value FROM raw_incidents
UNION ALL SELECT 'rows', 'cleaned', count(*) FROM joined
UNION ALL SELECT 'split', split, count(*) FROM split GROUP BY split
UNION ALL SELECT 'years', 'min', min(CAL_YR) FROM joined
UNION ALL SELECT 'years', 'max', max(CAL_YR) FROM joined
UNION ALL SELECT 'distribution_' || split, {canon('DEGREE_INJURY_CD')}, count(*) FROM split GROUP BY ALL
UNION ALL SELECT 'join', 'matched', count(*) FILTER (WHERE MINE_MATCH) FROM joined
UNION ALL SELECT 'join', 'unmatched', count(*) FILTER (WHERE NOT MINE_MATCH) FROM joined""",
}
ORACLE["ingest_report"] = f"""
SELECT * FROM ({ORACLE["ingest_summary"]})
UNION ALL SELECT 'removed', step, rows_removed FROM ({_WATERFALL})
UNION ALL SELECT 'imputed', step, rows_imputed FROM ({_WATERFALL})
UNION ALL SELECT * FROM ({_JOINED + "," + split_cte("joined", RAW_SPEC)}
  SELECT 'strata', 'number', count(DISTINCT stratum) FROM split
  UNION ALL SELECT 'strata', 'fewest_rows', min(n) FROM (SELECT count(*) AS n FROM split GROUP BY stratum)
  UNION ALL SELECT 'class', {canon('DEGREE_INJURY_CD')}, count(*) FROM joined GROUP BY ALL
  UNION ALL SELECT 'year', CAST(CAL_YR AS VARCHAR), count(*) FROM joined GROUP BY ALL)"""
