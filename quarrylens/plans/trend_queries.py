"""Registered trend queries (T1-T8, C13, C14) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators import trends
from quarrylens.plans.bindings import DRIVER_SPEC, INCIDENTS_SQL, incident_table

SPEC = DRIVER_SPEC


def trend_count_by_year(spark: SparkSession, sf_dir: str):
    return trends.count_by_year(incident_table(spark, sf_dir), {"coal_metal": "f"}, spec=SPEC)


def trend_yoy(spark: SparkSession, sf_dir: str):
    return trends.year_over_year_change(incident_table(spark, sf_dir), {"degree_code": "1"}, spec=SPEC)


def trend_topn_group(spark: SparkSession, sf_dir: str):
    return trends.count_by_group(incident_table(spark, sf_dir), "state", {"occupation": "east"},
                                 top_n=5, spec=SPEC)


def trend_compare_periods(spark: SparkSession, sf_dir: str):
    return trends.compare_periods(incident_table(spark, sf_dir), (1995, 1997), (1998, 2001),
                                  {"classification": "Building"}, spec=SPEC)


def trend_partial_note(spark: SparkSession, sf_dir: str):
    return trends.partial_year_note(incident_table(spark, sf_dir), {"coal_metal": "O"}, spec=SPEC)


def filter_list_vs_scalar(spark: SparkSession, sf_dir: str):
    filters = {" State ": ["NATION_1", "NATION_2", "nation_3"], "Classification": "machinery",
               "degree_code": ["1", "02", 3]}
    return trends.count_by_group(incident_table(spark, sf_dir), "coal_metal", filters, spec=SPEC)


#: Requests whose answers ``trend_envelope`` serialises.
ENVELOPES = [
    {"query_type": "count_by_year", "filters": {"coal_metal": "f"}},
    {"query_type": "year_over_year_change", "filters": {"degree_code": "1"}},
    {"query_type": "count_by_group", "group_column": "state", "filters": {"occupation": "east"}},
    {"query_type": "compare_periods", "period_a_start": 1995, "period_a_end": 1997, "period_b_start": 1998, "period_b_end": 2001,
     "filters": {"classification": "Building"}},
    {"query_type": "count_by_year", "filters": {"state": "nowhere"}},
]


def trend_envelope(spark: SparkSession, sf_dir: str, chunk_rows: int = 2):
    """T5: every answer as numbered chunks of JSON rows, in order, with notes."""
    table = incident_table(spark, sf_dir)
    parts = [trends.run_trend(table, request, SPEC).to_chunks(chunk_rows) for request in ENVELOPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_type", "filters", F.concat_ws(" | ", "notes").alias("notes"), F.col("chunk").cast("int").alias("chunk"), "rows")


# (spec_id, year, degree_code, coal_metal, state, classification): null = unset.
BULK_SPECS = [
    ("TRD-01", 1996, "1", None, None, None),
    ("TRD-02", 2000, "1", None, None, None),
    ("TRD-03", 1997, None, "F", "NATION_7", None),
    ("TRD-04", 1999, None, None, None, "HOUSEHOLD"),
    ("TRD-05", 1998, None, "O", None, "building"),
    ("TRD-06", 1995, "3", "P", None, None),
    ("TRD-07", 2001, "5", None, None, None),
    ("TRD-08", 1994, "2", None, None, None),
]


def trend_bulk_specs(spark: SparkSession, sf_dir: str):
    schema = T.StructType([T.StructField("spec_id", T.StringType()),
                           T.StructField("year", T.IntegerType()),
                           T.StructField("f_DEGREE_INJURY_CD", T.StringType()),
                           T.StructField("f_COAL_METAL_IND", T.StringType()),
                           T.StructField("f_STATE", T.StringType()),
                           T.StructField("f_CLASSIFICATION", T.StringType())])
    specs = spark.createDataFrame(BULK_SPECS, schema)
    return trends.bulk_count_specs(incident_table(spark, sf_dir), specs, ["DEGREE_INJURY_CD", "COAL_METAL_IND", "STATE",
                                                "CLASSIFICATION"], spec=SPEC)


def _bulk_values_sql() -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'"
    rows = ",\n    ".join(f"('{s}', {y}, {lit(d)}, {lit(c)}, {lit(st)}, {lit(cl)})"
                          for s, y, d, c, st, cl in BULK_SPECS)
    return rows


QUERIES = {
    "trend_count_by_year": trend_count_by_year,
    "trend_yoy": trend_yoy,
    "trend_topn_group": trend_topn_group,
    "trend_compare_periods": trend_compare_periods,
    "trend_partial_note": trend_partial_note,
    "filter_list_vs_scalar": filter_list_vs_scalar,
    "trend_bulk_specs": trend_bulk_specs,
    "trend_envelope": trend_envelope,
}

W = "WITH " + INCIDENTS_SQL

ORACLE = {
    "trend_count_by_year": W + """
SELECT CAL_YR, count(*) AS injury_count FROM incidents
WHERE lower(COAL_METAL_IND) = 'f' AND CAL_YR IS NOT NULL AND CAL_YR <> 2001
GROUP BY CAL_YR ORDER BY CAL_YR""",
    "trend_yoy": W + """,
c AS (SELECT CAL_YR, count(*) AS injury_count FROM incidents
      WHERE lpad(DEGREE_INJURY_CD, 2, '0') = '01' AND CAL_YR <> 2001 GROUP BY CAL_YR),
l AS (SELECT CAL_YR, injury_count, lag(injury_count) OVER (ORDER BY CAL_YR) AS prev_count FROM c)
SELECT CAL_YR, injury_count, prev_count, injury_count - prev_count AS absolute_change,
       round((injury_count - prev_count) / prev_count * 100, 2) AS percent_change
FROM l WHERE prev_count IS NOT NULL ORDER BY CAL_YR""",
    "trend_topn_group": W + """
SELECT STATE, count(*) AS injury_count FROM incidents
WHERE contains(lower(OCCUPATION), 'east') AND STATE IS NOT NULL
GROUP BY STATE ORDER BY injury_count DESC, STATE LIMIT 5""",
    "trend_compare_periods": W + """
SELECT period, injury_count FROM (
  SELECT '1995-1997' AS period, count(*) FILTER (WHERE CAL_YR BETWEEN 1995 AND 1997) AS injury_count
  FROM incidents WHERE lower(CLASSIFICATION) = 'building'
  UNION ALL
  SELECT '1998-2001', count(*) FILTER (WHERE CAL_YR BETWEEN 1998 AND 2001)
  FROM incidents WHERE lower(CLASSIFICATION) = 'building')""",
    "trend_partial_note": W + """
SELECT excluded, CASE WHEN excluded > 0 THEN 'Excluded ' || excluded ||
       ' records from CAL_YR=2001 (partial year in current extract).' END AS note
FROM (SELECT count(*) FILTER (WHERE CAL_YR = 2001) AS excluded FROM incidents
      WHERE lower(COAL_METAL_IND) = 'o')""",
    "filter_list_vs_scalar": W + """
SELECT COAL_METAL_IND, count(*) AS injury_count FROM incidents
WHERE STATE IN ('NATION_1', 'NATION_2', 'nation_3') AND lower(CLASSIFICATION) = 'machinery'
  AND lpad(DEGREE_INJURY_CD, 2, '0') IN ('01', '02', '03') AND COAL_METAL_IND IS NOT NULL
GROUP BY COAL_METAL_IND ORDER BY injury_count DESC, COAL_METAL_IND""",
    "trend_envelope": W + """,
y1 AS (SELECT CAL_YR, count(*) AS injury_count FROM incidents WHERE lower(COAL_METAL_IND) = 'f' AND CAL_YR <> 2001 GROUP BY CAL_YR),
y2 AS (SELECT CAL_YR, count(*) AS injury_count FROM incidents WHERE lpad(DEGREE_INJURY_CD, 2, '0') = '01' AND CAL_YR <> 2001 GROUP BY CAL_YR),
yy AS (SELECT CAL_YR, injury_count, lag(injury_count) OVER (ORDER BY CAL_YR) AS prev_count FROM y2),
st AS (SELECT STATE, count(*) AS injury_count FROM incidents WHERE contains(lower(OCCUPATION), 'east') AND STATE IS NOT NULL GROUP BY STATE),
pe AS (SELECT '1995-1997' AS period, count(*) FILTER (WHERE CAL_YR BETWEEN 1995 AND 1997) AS injury_count FROM incidents WHERE lower(CLASSIFICATION) = 'building'
       UNION ALL SELECT '1998-2001', count(*) FILTER (WHERE CAL_YR BETWEEN 1998 AND 2001) FROM incidents WHERE lower(CLASSIFICATION) = 'building'),
note1 AS (SELECT count(*) AS n FROM incidents WHERE lower(COAL_METAL_IND) = 'f' AND CAL_YR = 2001),
note2 AS (SELECT count(*) AS n FROM incidents WHERE lpad(DEGREE_INJURY_CD, 2, '0') = '01' AND CAL_YR = 2001),
r AS (
  SELECT 1 AS q, row_number() OVER (ORDER BY CAL_YR) AS k, '{"CAL_YR":' || CAL_YR || ',"injury_count":' || injury_count || '}' AS j FROM y1
  UNION ALL SELECT 2, row_number() OVER (ORDER BY CAL_YR) AS k, '{"CAL_YR":' || CAL_YR || ',"injury_count":' || injury_count || ',"prev_count":' || prev_count ||
    ',"absolute_change":' || (injury_count - prev_count) || ',"percent_change":' || round((injury_count - prev_count) / prev_count * 100, 2) || '}' FROM yy WHERE prev_count IS NOT NULL
  UNION ALL SELECT 3, row_number() OVER (ORDER BY injury_count DESC, STATE), '{"STATE":"' || STATE || '","injury_count":' || injury_count || '}' FROM st
  UNION ALL SELECT 4, row_number() OVER (ORDER BY period), '{"period":"' || period || '","injury_count":' || injury_count || '}' FROM pe),
c AS (SELECT q, ((k - 1) // 2 + 1)::INTEGER AS chunk, '[' || string_agg(j, ',' ORDER BY k) || ']' AS rows FROM r GROUP BY q, (k - 1) // 2 + 1),
h(q, query_type, filters, notes) AS (
  SELECT 1, 'count_by_year', '{"coal_metal": "f"}', (SELECT CASE WHEN n > 0 THEN 'Excluded ' || n || ' records from CAL_YR=2001 (partial year in current extract).' ELSE '' END FROM note1)
  UNION ALL SELECT 2, 'year_over_year_change', '{"degree_code": "1"}',
    (SELECT CASE WHEN n > 0 THEN 'Excluded ' || n || ' records from CAL_YR=2001 (partial year in current extract).' ELSE '' END FROM note2)
  UNION ALL SELECT 3, 'count_by_group', '{"group_column": "STATE", "occupation": "east", "top_n": null}', ''
  UNION ALL SELECT 4, 'compare_periods', '{"classification": "Building", "period_a": [1995, 1997], "period_b": [1998, 2001]}',
    'Ranges including 2001 may reflect partial-year reporting.'
  UNION ALL SELECT 5, 'count_by_year', '{"state": "nowhere"}', '')
SELECT query_type, filters, notes, coalesce(chunk, 1) AS chunk, coalesce(rows, '[]') AS rows FROM h LEFT JOIN c USING (q)""",
    "trend_bulk_specs": W + f""",
specs(spec_id, year, f_d, f_c, f_s, f_cl) AS (VALUES
    {_bulk_values_sql()})
SELECT s.spec_id, s.year, CAST(count(i.DOCUMENT_NO) AS BIGINT) AS injury_count
FROM specs s LEFT JOIN incidents i ON i.CAL_YR = s.year
  AND (s.f_d IS NULL OR lpad(i.DEGREE_INJURY_CD, 2, '0') = lpad(s.f_d, 2, '0'))
  AND (s.f_c IS NULL OR lower(i.COAL_METAL_IND) = lower(s.f_c))
  AND (s.f_s IS NULL OR lower(i.STATE) = lower(s.f_s))
  AND (s.f_cl IS NULL OR lower(i.CLASSIFICATION) = lower(s.f_cl))
GROUP BY s.spec_id, s.year""",
}
