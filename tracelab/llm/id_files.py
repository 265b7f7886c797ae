"""Token ids in ORC files, in ascending order of document ids.

Ids are an ``array<int>`` column, which ORC stores as run-length encoded integers in stripes; each
stripe and each stride of rows has its own minimum and maximum of ``doc_id`` and a Bloom filter, so
that a reader of some documents skips stripes by metadata and a reader of all works on stripes in parallel. A manifest
with one row per partition holds the global offset of its first token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm.packing import encoded_rows
from tracelab.llm.store import in_batches, tidy, with_columns

ROWS = "part int, start_in_part bigint, doc_id bigint, n_tokens bigint, ids array<int>"
DIGEST = "part int, start_in_part bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
ORC = {
    "orc.compress": "SNAPPY",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, drops_space: bool = True) -> None:
    """Write ``folder/ids`` (ORC) and ``folder/manifest``: the ids of each document and its end id.

    Documents are range-partitioned and sorted by id, rows of one id by a hash of the text. Null ids
    come first; a null text is empty; repeated rows are written as often as they come; an empty table
    leaves files without rows; further columns are ignored.
    """
    by = ["doc_id", F.xxhash64("text")]
    rows = with_columns(docs, doc_id="bigint", text="string").repartitionByRange(*by).sortWithinPartitions(*by)
    lists = encoded_rows(rows, tokenizer, end_id, drops_space, as_lists=True)
    lists.write.options(**ORC).orc(f"{folder}/ids")
    totals = read_rows(docs.sparkSession, folder).groupBy("part").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("documents"),
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).write.orc(f"{folder}/manifest")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows; filters on ``doc_id`` reach the stripe statistics and Bloom filters."""
    return spark.read.schema(ROWS).orc(f"{folder}/ids")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    kind = "part int, n bigint, documents bigint, first_id bigint, last_id bigint, base bigint"
    return spark.read.schema(kind).orc(f"{folder}/manifest")


def with_starts(rows: DataFrame, folder: str) -> DataFrame:
    """Add ``start``, the number of ids of all documents before; the manifest has a row per partition."""
    manifest = read_manifest(rows.sparkSession, folder).select("part", "base")
    return rows.join(F.broadcast(manifest), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(sums, pa.int64()))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: (doc_id, start, n_tokens, ids_crc32)."""
    rows = in_batches(read_rows(spark, folder)).mapInArrow(tidy(_digest), DIGEST)
    return with_starts(rows, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
