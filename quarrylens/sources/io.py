"""Sources and sinks.

All readers take explicit schemas (no inference); all writers are Spark
writers to a path the caller owns (on a cluster: shared storage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.cleaning import normalise_strings
from quarrylens.spec import ESS_ITEMS, RAW_DELIMITER, RAW_ENCODING


def read_raw(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """S1 + S2: pipe-delimited, latin-1, header row, every column a string,
    then whitespace/quote strip and NA tokens -> null.

    ``columns`` pins the schema (all strings); without it the header names
    are used, still as strings (no type inference).
    """
    reader = (spark.read.option("header", True).option("sep", RAW_DELIMITER)
              .option("encoding", RAW_ENCODING).option("quote", '"').option("escape", '"')
              .option("mode", "PERMISSIVE"))
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    return normalise_strings(reader.csv(path))


#: Control characters that a text file in latin-1 has no use for.
BAD_BYTES = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def read_raw_checked(spark: SparkSession, path, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """S1 with nothing lost unseen: (rows, rejects). A line with too few or too
    many fields, or with bytes that are no text, is no row but a reject (file,
    line, reason): ``short``, ``long`` or ``bad_byte``. Both come from one scan
    definition; rejects keep their line as it stands in the file."""
    fields = [T.StructField(c, T.StringType()) for c in columns]
    scan = (spark.read.option("header", True).option("enforceSchema", True).option("sep", RAW_DELIMITER).option("encoding", RAW_ENCODING)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
            .schema(T.StructType([*fields, T.StructField("_line", T.StringType())])).csv(path).withColumn("_file", F.col("_metadata.file_path")))
    bad = F.exists(F.array(*[F.col(f"`{c}`") for c in columns]), lambda v: F.coalesce(v.rlike(BAD_BYTES), F.lit(False)))
    # a short line leaves its last field null, a long one fills it
    reason = (F.when(F.col("_line").isNotNull() & F.col(f"`{columns[-1]}`").isNull(), F.lit("short"))
              .when(F.col("_line").isNotNull(), F.lit("long")).when(bad, F.lit("bad_byte")))
    marked = scan.withColumn("_reason", reason)
    rows = marked.where(F.col("_reason").isNull()).select(*[F.col(f"`{c}`") for c in columns])
    whole = F.coalesce("_line", F.concat_ws(RAW_DELIMITER, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]))
    rejects = marked.where(F.col("_reason").isNotNull()).select(F.col("_file").alias("file"), whole.alias("line"), F.col("_reason").alias("reason"))
    return normalise_strings(rows), rejects


def write_processed(df: DataFrame, path: str, partition_by: str | None = "CAL_YR",
                    mode: str = "overwrite") -> None:
    """S3: Parquet, partitioned by year so year filters prune files."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines. Reports are aggregates (a bounded number of rows),
    so they are written as one file for readability."""
    df.coalesce(1).write.mode(mode).json(path)


REFERENCE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("document_no", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("filters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("period_a", T.ArrayType(T.IntegerType())),
    T.StructField("period_b", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.StructType([
        T.StructField("period", T.StringType()), T.StructField("injury_count", T.LongType())]))),
    T.StructField("query", T.StringType()),
    T.StructField("document_numbers", T.ArrayType(T.StringType())),
    T.StructField("top_narrative", T.StringType()), T.StructField("must_include", T.StringType()),
])
QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_tools", T.ArrayType(T.StringType())),
    T.StructField("reference", REFERENCE_SCHEMA)])
BANK_FILE_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("total_questions", T.IntegerType()),
    T.StructField("category_counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("notes", T.ArrayType(T.StringType())),
    T.StructField("questions", T.ArrayType(QUESTION_SCHEMA))])


def read_question_bank(spark: SparkSession, path: str) -> DataFrame:
    """One bank file -> one row per question with flattened references
    (the tagged union becomes nullable ``ref_*`` columns)."""
    raw = spark.read.option("multiLine", True).schema(BANK_FILE_SCHEMA).json(path)
    q = raw.select(F.explode("questions").alias("q")).select("q.*")
    r = "reference"
    return q.select(
        F.col("id").alias("question_id"), "category", "question", "expected_tools",
        F.col(f"{r}.type").alias("ref_type"), F.col(f"{r}.value").alias("ref_value"),
        F.col(f"{r}.document_no").alias("ref_document_no"), F.col(f"{r}.year").alias("ref_year"),
        F.concat_ws("-", *[F.col(f"{r}.period_a")[i].cast("string") for i in (0, 1)]).alias("ref_period_a"),
        F.concat_ws("-", *[F.col(f"{r}.period_b")[i].cast("string") for i in (0, 1)]).alias("ref_period_b"),
        F.transform(F.col(f"{r}.counts"), lambda c: c["injury_count"]).alias("ref_counts"),
        F.col(f"{r}.query").alias("ref_query"),
        F.col(f"{r}.document_numbers").alias("ref_documents"),
        F.col(f"{r}.must_include").alias("ref_must_include"))


RUN_FILE_SCHEMA = T.StructType([
    T.StructField("question_id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("system", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("tools_used", T.ArrayType(T.StringType())),
    T.StructField("usage", T.StructType([T.StructField("prompt_tokens", T.LongType()),
                                        T.StructField("completion_tokens", T.LongType()),
                                        T.StructField("total_tokens", T.LongType())])),
    T.StructField("latency_s", T.DoubleType()), T.StructField("log_path", T.StringType()),
    T.StructField("error", T.StringType())])


def append_runs(df: DataFrame, path: str) -> None:
    """Append finished run rows as JSON lines (one file set per batch)."""
    cols = [f.name for f in RUN_FILE_SCHEMA.fields]
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(RUN_FILE_SCHEMA[c].dataType).alias(c)
                      for c in cols])
    out.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read appended run rows (empty frame if nothing was written; any
    other storage error rises, so a resumed run never starts from nothing by
    mistake)."""
    if not exists(spark, path):
        return spark.createDataFrame([], RUN_FILE_SCHEMA)
    return spark.read.schema(RUN_FILE_SCHEMA).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of its own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


EVENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("system", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("timestamp", T.DoubleType()),
    T.StructField("elapsed_s", T.DoubleType()), T.StructField("question", T.StringType()),
    T.StructField("tool_name", T.StringType()), T.StructField("answer", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("usage", T.StructType([T.StructField("prompt_tokens", T.LongType()),
                                        T.StructField("completion_tokens", T.LongType()),
                                        T.StructField("total_tokens", T.LongType())]))])


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """Run-log JSONL events with the envelope schema; token usage
    flattened for E16."""
    ev = spark.read.schema(EVENT_SCHEMA).json(path)
    return ev.select("*", F.col("usage.prompt_tokens").alias("prompt_tokens"),
                     F.col("usage.completion_tokens").alias("completion_tokens"),
                     F.col("usage.total_tokens").alias("total_tokens")).drop("usage")


RESPONSE_COLUMNS = ["participant_id", "stimulus_id", "question_id", "category", *ESS_ITEMS, "comment"]


def read_responses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of completed response CSVs (all strings) + source file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RESPONSE_COLUMNS])
    df = spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(paths)
    return df.withColumn("source_file", F.input_file_name())


def write_grouped_csv(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """One CSV folder per group value (e.g. one sheet per participant)."""
    df.write.mode(mode).option("header", True).partitionBy(by).csv(path)
