"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.session import checkpoint_dir


class Scratch:
    """Parquet tables of one job under ``spark.checkpoint.dir``; each can be removed after its last reader.

    Tables that a returned (lazy) DataFrame still reads are left to the owner of the folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of one Arrow batch (or one longer row): what the JVM and Python each hold of a task's input at a time.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session makes Arrow batches of ``BATCH_BYTES`` from now on, so that the memory
    of a task does not follow the length of the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(work: Work) -> Work:
    """``work``, after which the Python worker gives free memory back: workers live on between the stages of a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


def with_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, cast to the types an operator works on.

    Operators start with this, so that further columns of the input never clash with theirs.
    """
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in wanted.items()])


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for at, length in enumerate(lengths):
            if at > start and total + length > size:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += length
        if len(lengths) > start:
            yield batch.slice(start)


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; every machine has the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)
