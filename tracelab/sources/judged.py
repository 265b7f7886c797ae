"""Answers, judged answers and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGED_SCHEMA = (
    "index BIGINT, question STRING, label ARRAY<STRING>, answer STRING, temperature DOUBLE, "
    "is_hallucination STRING, explanation STRING"
)


def read_judged(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Judged answers; JSON lines, or whole JSON arrays with ``multi_line``.

    A JSON array file is read by one task, so large sets should be JSON lines.
    """
    return spark.read.schema(JUDGED_SCHEMA).option("multiLine", multi_line).json(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """JSON lines in index order over all files."""
    answers.repartitionByRange("index").sortWithinPartitions("index").write.json(path)


def user_message(question: str = "question"):
    return F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("content")))


def load_triviaqa(source: DataFrame) -> DataFrame:
    """Gold answer first, then the aliases that differ from it."""
    gold = F.col("answer.value")
    return source.select(
        "id", user_message().alias("messages"), "question",
        F.concat(F.array(gold), F.filter("answer.aliases", lambda a: a != gold)).alias("label"),
    )


def load_naturalquestions(source: DataFrame) -> DataFrame:
    """Distinct short answers in order; questions without one are skipped."""
    texts = F.flatten(F.col("annotations.short_answers.text"))
    labelled = source.select(
        "id", F.col("question.text").alias("question"),
        F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != ""))).alias("label"),
    ).where(F.size("label") > 0)
    return labelled.select("id", user_message().alias("messages"), "question", "label")


def load_hotpotqa(source: DataFrame) -> DataFrame:
    return source.select("id", user_message().alias("messages"), "question", F.array("answer").alias("label"))
