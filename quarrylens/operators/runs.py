"""Benchmark runs in bulk (Q11): who answers what, how long it took, what failed.

The original asks one question after the other and notes the seconds and the
exception of each call. Here a *part* (the classifier, the search, the trend
tool) answers all of its questions in one Spark job, whose rows are written at
once: a question's latency is the job's seconds shared by the questions asked
of it. A question that its part leaves without an answer becomes an error row
of its own; a job that Spark itself rejects or fails on the data is noted as
the error of all of its questions, and the other parts still run. What is no
matter of the query (storage, lost clusters) rises.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.bank import no_usage

#: Most characters of an error that a run row keeps.
ERROR_CHARS = 500


@dataclass
class Part:
    """Stored answers (question_id and one string column per ``answers``), the
    seconds of one question, and the error of the whole job, if it failed."""

    rows: DataFrame
    answers: tuple[str, ...]
    seconds: float
    error: str | None = None


def run_part(asked: DataFrame, build: Callable[[], DataFrame], answers: tuple[str, ...], path: str) -> Part:
    """Run one part over the questions ``asked`` (one row each) and store what
    it answers at ``path``, which must be new."""
    spark = asked.sparkSession
    n = asked.count()
    start, error = time.perf_counter(), None
    try:
        build().select("question_id", *answers).write.parquet(path)
    except PySparkException as failed:
        condition = failed.getCondition()
        if condition is None:  # raised by the task or its storage, not by the query
            raise
        error = str(failed).split("\n")[0][:ERROR_CHARS] or condition
    seconds = (time.perf_counter() - start) / max(n, 1)
    if error is not None:
        rows = spark.createDataFrame([], "question_id string, " + ", ".join(f"{a} string" for a in answers))
    else:
        rows = spark.read.parquet(path)
    return Part(rows, answers, seconds, error)


def with_parts(questions: DataFrame, parts: dict[str, Part]) -> DataFrame:
    """All answers beside each question."""
    for part in parts.values():
        questions = questions.join(part.rows, "question_id", "left")
    return questions


def run_rows(answered: DataFrame, system: str, answer: Column, tools: Column, part: Column | str, parts: dict[str, Part]) -> DataFrame:
    """The run rows of one system. ``part`` names the part that answers a
    question (null: none is needed, as for a question that fits no tool). An
    error leaves an empty answer, no tools, and the time that was spent."""
    part = F.lit(part) if isinstance(part, str) else part
    failed, seconds = F.lit(None).cast("string"), F.lit(0.0)
    for name, p in parts.items():
        here = part == name
        failed = F.when(here, F.lit(p.error).cast("string")).otherwise(failed)
        seconds = F.when(here, F.lit(p.seconds)).otherwise(seconds)
    error = F.coalesce(failed, F.when(F.col("question").isNull() | (F.trim("question") == ""), F.lit("Empty question")),
                       F.when(answer.isNull(), F.concat(F.lit("No answer: "), F.coalesce(part, F.lit("no tool")))))
    return answered.select("question_id", "category", "question", answer.alias("_answer"), tools.alias("_tools"),
                           error.alias("error"), seconds.alias("_seconds")).select(
        "question_id", "category", "question", F.lit(system).alias("system"),
        F.when(F.col("error").isNull(), F.col("_answer")).otherwise("").alias("answer"),
        F.when(F.col("error").isNull(), F.col("_tools")).otherwise(F.array().cast("array<string>")).alias("tools_used"),
        no_usage().alias("usage"), F.round("_seconds", 6).alias("latency_s"), "error")
