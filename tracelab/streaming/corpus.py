"""Record-at-a-time corpus preparation as Structured Streaming.

Every step is stateless, so the stream needs no watermark and the batch functions apply unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelab.operators import corpus


def read_stream(spark: SparkSession, pattern: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files matching a glob, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def filter_long_rows(stream: DataFrame, max_length: int) -> DataFrame:
    return stream.where(F.col("input_ids").isNotNull() & (F.size("input_ids") <= max_length))


def filter_long_prompts(stream: DataFrame, max_length: int) -> DataFrame:
    """Rows whose prompt fits; rows without a prompt length go, when the stream has that column."""
    if "prompt_len" not in stream.columns:
        return stream
    return stream.where(F.col("prompt_len").isNotNull() & (F.col("prompt_len") <= max_length))


def clip_right(stream: DataFrame, max_length: int) -> DataFrame:
    return corpus.clip_rows(stream, max_length, "right")


def clip_keep_prompt(stream: DataFrame, max_length: int, side: str = "right") -> DataFrame:
    return corpus.clip_keep_prompt(stream, max_length, side)


def prepare(stream: DataFrame, mode: str, max_length: int) -> DataFrame:
    """``filter`` drops long rows; ``right`` drops long prompts and clips the rest."""
    if mode == "filter":
        return filter_long_rows(stream, max_length)
    if mode == "right":
        return clip_right(filter_long_prompts(stream, max_length), max_length)
    raise ValueError(f"unknown mode {mode!r}")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what is there now into Parquet files below ``path``; exactly once per input file."""
    out = step(stream) if step else stream
    query = (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
