"""Sums of matrices over all rows: one partial sum per task and key, added up map-side and once more per key.

For statistics of all pairs of columns. A task sends one array per key, whatever its rows; no row is copied per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: What a task adds to the sum of each key: (key, array) for one Arrow batch.
Partial = Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]]


def summed(rows: DataFrame, keys: dict[str, str], partial: Partial) -> DataFrame:
    """(*keys, total): the element-wise sum of the arrays that ``partial`` gives for a key. ``keys`` are names and types."""
    names = list(keys)
    schema = StructType.fromDDL(", ".join([*[f"{n} {t}" for n, t in keys.items()], "part array<double>"]))
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[:-1]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, array in partial(batch):
                    sums[key] = sums[key] + array if key in sums else array
        for key, array in sums.items():
            part = pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), pa.array(array.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*[pa.array([k], kind) for k, kind in zip(key, kinds)], part], [*names, "part"])

    parts = rows.mapInArrow(work, schema)
    return parts.groupBy(*names).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("part")))).alias("total"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array column of a fixed length as a matrix; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def groups(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, row numbers) of the groups of a batch; without columns, all rows under the key (0,)."""
    if not by:
        yield (0,), np.arange(batch.num_rows)
        return
    numbered = pa.table({**{c: batch.column(c) for c in by}, "_row": pa.array(np.arange(batch.num_rows))})
    for group in numbered.group_by(by).aggregate([("_row", "list")]).to_pylist():
        yield tuple(group[c] for c in by), np.array(group["_row_list"])
