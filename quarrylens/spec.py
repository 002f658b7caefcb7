"""Column bindings and fixed values.

Operators never hard-code column names; they receive a ``SchemaSpec``.
``ACCIDENT_SPEC`` names the columns of the original incident files; the
driver-table binding in ``plans.bindings`` renames its inputs onto the same
logical names, so one operator serves both.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# These must equal the original pipeline's values for results
# to agree. Kept in their natural order.
# ---------------------------------------------------------------------------

# Classifier input codes, in order.
FEATURE_COLUMNS = [
    "SUBUNIT_CD",
    "CLASSIFICATION_CD",
    "OCCUPATION_CD",
    "ACTIVITY_CD",
    "INJURY_SOURCE_CD",
    "NATURE_INJURY_CD",
    "INJ_BODY_PART_CD",
    "MINING_EQUIP_CD",
    "COAL_METAL_IND",
    "ACCIDENT_TYPE_CD",
]
TARGET_COLUMN = "DEGREE_INJURY_CD"
EXCLUDED_TARGET_CODES = ["00"]
# Columns that must never reach the classifier (outcome or identifier).
LEAKAGE_COLUMNS = [
    "DEGREE_INJURY_CD",
    "DEGREE_INJURY",
    "DAYS_LOST",
    "DAYS_RESTRICT",
    "SCHEDULE_CHARGE",
    "RETURN_TO_WORK_DT",
    "TRANS_TERM",
    "NO_INJURIES",
    "IMMED_NOTIFY_CD",
    "IMMED_NOTIFY",
    "NARRATIVE",
    "DOCUMENT_NO",
    "CLOSED_DOC_NO",
]
MINE_CONTEXT_COLUMNS = [
    "CURRENT_MINE_TYPE",
    "CURRENT_MINE_STATUS",
    "PRIMARY_CANVASS",
    "NO_EMPLOYEES",
    "STATE",
]
MIN_CALENDAR_YEAR = 2000
PARTIAL_CALENDAR_YEAR = 2026
OUT_OF_TIME_TRAIN_MAX_YEAR = 2020
OUT_OF_TIME_TEST_MIN_YEAR = 2021
TEST_FRACTION = 0.2
RANDOM_SEED = 42
RAW_ENCODING = "ISO-8859-1"
RAW_DELIMITER = "|"
# Year-bucket upper edges (exclusive) and labels for stratification.
YEAR_BUCKET_EDGES = [2005, 2010, 2015, 2020]
YEAR_BUCKET_LABELS = ["2000-2004", "2005-2009", "2010-2014", "2015-2019", "2020-2026"]
# Filter aliases accepted by trend queries (key is matched after strip+lower).
FILTER_COLUMN_ALIASES = {
    "occupation": "OCCUPATION",
    "occupation_code": "OCCUPATION_CD",
    "injury_type": "NATURE_INJURY",
    "injury_type_code": "NATURE_INJURY_CD",
    "classification": "CLASSIFICATION",
    "classification_code": "CLASSIFICATION_CD",
    "equipment": "MINING_EQUIP",
    "equipment_code": "MINING_EQUIP_CD",
    "mine_id": "MINE_ID",
    "state": "STATE",
    "commodity": "PRIMARY_CANVASS",
    "coal_metal": "COAL_METAL_IND",
    "degree": "DEGREE_INJURY",
    "degree_code": "DEGREE_INJURY_CD",
    "accident_type": "ACCIDENT_TYPE",
    "body_part": "INJ_BODY_PART",
}
# Metadata carried with every indexed narrative.
METADATA_COLUMNS = [
    "DOCUMENT_NO",
    "MINE_ID",
    "CAL_YR",
    "OCCUPATION",
    "NATURE_INJURY",
    "CLASSIFICATION",
    "DEGREE_INJURY",
    "STATE",
]
# Read-time tokens that mean "missing" (pandas read_csv defaults plus the
# stringified None/nan the original strip step maps to null).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Tool names and system names of the question-answering runs.
TOOL_CLASSIFY = "classify_injury_risk"
TOOL_TRENDS = "analyze_trends"
TOOL_SEARCH = "search_narratives"
SYSTEMS = ["agent", "classifier_baseline", "rag_baseline"]
# Rating-study scale, items and blinded labels.
LIKERT_SCALE = [
    "1 - I disagree strongly",
    "2 - I disagree somewhat",
    "3 - I'm neutral about it",
    "4 - I agree somewhat",
    "5 - I agree strongly",
]
ESS_ITEMS = [f"ESS-{i}" for i in range(1, 10)]
SYSTEM_LABELS = ["A", "B", "C"]
EMPTY_ANSWER_PLACEHOLDER = "[No response was generated.]"


@dataclass(frozen=True)
class SchemaSpec:
    """Logical roles -> physical column names, plus rule parameters."""

    key: str = "DOCUMENT_NO"
    mine_key: str = "MINE_ID"
    year: str = "CAL_YR"
    target: str = TARGET_COLUMN
    target_label: str = "DEGREE_INJURY"
    text: str = "NARRATIVE"
    date: str = "ACCIDENT_DT"
    equipment: str = "MINING_EQUIP_CD"
    contains_column: str = "OCCUPATION"
    features: tuple = tuple(FEATURE_COLUMNS)
    mine_context: tuple = tuple(MINE_CONTEXT_COLUMNS)
    leakage: tuple = tuple(LEAKAGE_COLUMNS)
    excluded_codes: tuple = tuple(EXCLUDED_TARGET_CODES)
    min_year: int = MIN_CALENDAR_YEAR
    partial_year: int = PARTIAL_CALENDAR_YEAR
    oot_train_max: int = OUT_OF_TIME_TRAIN_MAX_YEAR
    oot_test_min: int = OUT_OF_TIME_TEST_MIN_YEAR
    bucket_edges: tuple = tuple(YEAR_BUCKET_EDGES)
    bucket_labels: tuple = tuple(YEAR_BUCKET_LABELS)
    aliases: dict = field(default_factory=lambda: dict(FILTER_COLUMN_ALIASES))
    numeric_columns: tuple = ("DAYS_LOST", "DAYS_RESTRICT")
    date_formats: tuple = ("M/d/yyyy", "yyyy-MM-dd", "M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss")

    @property
    def core_features(self) -> list[str]:
        return [c for c in self.features if c != self.equipment]

    def with_(self, **kw) -> "SchemaSpec":
        return replace(self, **kw)


ACCIDENT_SPEC = SchemaSpec()

# Fixed texts of answers, notes and reasons, as stored results hold them.
PARTIAL_YEAR_NOTE = "Excluded %d records from %s=%d (partial year in current extract)."
PARTIAL_RANGE_NOTE = "Ranges including {year} may reflect partial-year reporting."
NO_COUNT_ANSWER = ("No count found for year ", ". Tool rows: ")
AGENT_CASE_HEADER = "Retrieved similar incidents:\n"
AGENT_CASE_LINE = "Document %s (score=%s): %s"
RETRIEVAL_LINE = "Based on retrieved incidents, document %s (score=%s): %s"
REASONS = {
    "degree_right": "degree code matched",
    "degree_wrong": "missing expected degree code",
    "count": "expected %s, got %s",
    "period_right": "period totals matched",
    "period_wrong": "period totals not found within tolerance",
    "document_named": "must include document ",
    "document_right": "document cited",
    "document_wrong": "top retrieved document not cited",
    "unknown": "unknown reference type",
}
