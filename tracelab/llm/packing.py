"""Concatenate and cut: token pieces of whole documents in sequences of a fixed length.

Two passes. The first encodes each partition in its order, writes the ids with their offset inside
the partition, and leaves one total per partition. A prefix sum over these totals gives each partition its global offset.
The second pass needs nothing but a row and its partition's offset: windows of ``length``
tokens cut the document, and each cut leaves a boundary record (piece) of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.store import Scratch, in_batches, slices, tidy, with_columns
from tracelab.llm.token_ids import word_ids

ENCODED = "part int, start_in_part bigint, doc_id bigint, n_tokens bigint, ids binary"


def encoded_rows(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool = False, as_lists: bool = False, cache: int | None = None) -> DataFrame:
    """First pass: (part, start_in_part, doc_id, n_tokens, ids) of (doc_id, text) rows, in their order.

    ``ids`` are little-endian unsigned 32-bit integers (or an array of them, ``as_lists``) and end
    with ``end_id``; a null text is empty.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = word_ids(tokenizer, drops_space, cache), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, bounds = ended(*own.columns(batch.column("text")), end_id)
            n = np.diff(bounds)
            yield pa.record_batch({
                "part": pa.array(np.full(len(n), part, dtype=np.int32)),
                "start_in_part": pa.array(before + bounds[:-1]),
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(n),
                "ids": lists(ids, bounds) if as_lists else binaries(ids, bounds),
            })
            before += int(bounds[-1])

    return in_batches(docs).mapInArrow(tidy(rows), ENCODED.replace("binary", "array<int>") if as_lists else ENCODED)


def ended(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with an end id after each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view("<i4")))


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values from the bytes of an array between bounds."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def part_offsets(encoded: DataFrame) -> DataFrame:
    """(part, base): tokens of all partitions before a partition; one row per partition."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def cut(start: Column, n: Column, ids: Column, length: int) -> Column:
    """Boundary records of one document: an array with a struct per window it lies in."""

    def piece(window: Column) -> Column:
        low = F.greatest(start, window * length)
        high = F.least(start + n, (window + 1) * length)
        return F.struct(
            (low - start).alias("start"),
            (high - low).alias("length"),
            F.crc32(F.substring(ids, ((low - start) * 4 + 1).cast("int"), ((high - low) * 4).cast("int"))).alias("ids_crc32"),
            window.alias("sequence_id"),
            (low - window * length).alias("offset"),
        )

    return F.transform(F.sequence(F.floor(start / length), F.floor((start + n - 1) / length)), piece)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048,
    order: Sequence[str] | None = None, with_ids: bool = False, cache: int | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens, only the last of which is shorter.

    One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with its
    ids if ``with_ids``. ``order`` names the columns that order the stream (ties by doc_id and text);
    without it, documents follow in the order of the table's splits. A null or empty text is one end
    token. Null and repeated ids and repeated rows are packed like any other; an empty table gives no
    piece; further columns are ignored. A piece is found again by (sequence_id, offset). ``cache`` bounds
    the words whose ids a Python worker remembers; it changes time and memory only.
    """
    spark = docs.sparkSession
    if order:
        keys = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
        rows = docs.select(*keys, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        by = [*[f"_order{i}" for i in range(len(order))], "doc_id", F.xxhash64("text")]
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    else:
        rows = with_columns(docs, doc_id="bigint", text="string")
    scratch = Scratch(spark, "packing")
    encoded = scratch.save(encoded_rows(rows, tokenizer, end_id, cache=cache), "encoded")
    located = encoded.join(F.broadcast(part_offsets(encoded)), "part")
    start = F.col("base") + F.col("start_in_part")
    pieces = located.select("doc_id", F.col("n_tokens").alias("doc_tokens"), *["ids"] * with_ids, F.inline(cut(start, F.col("n_tokens"), F.col("ids"), length)))
    if with_ids:
        pieces = pieces.withColumn("ids", F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
