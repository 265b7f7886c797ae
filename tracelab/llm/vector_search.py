"""The frame of both vector searches: shards with a tree each, searched in waves for blocks of queries.

Vectors are dealt to shards by a hash of the whole row, about ``shard_rows`` each, and every shard becomes
one index row with its tree. Of equal rows only k are kept: no result can hold more. A bounded block of queries is broadcast at a time. The first wave searches a few
shards; the k-th best score of each query so far is then shared with all tasks of the next wave, which has
four times the shards, and so on: later shards start with a tight bound and return few rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.store import Scratch, in_batches, tidy, with_columns

INDEX = "shard int, size int, tree binary"
FOUND = "query_id bigint, vec_id bigint, score {kind}"
FIRST_WAVE = 4


class Kernel(Protocol):
    """What a search adds to the frame."""

    kind: str

    def build(self, ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]: ...

    def queries(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray) -> Any: ...

    def search(self, tree: dict[str, np.ndarray], state: Any) -> None: ...

    def found(self, state: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...


def clean(vectors: DataFrame, id_column: str, vector_column: str, keep_zero: bool) -> tuple[DataFrame, int, int]:
    """(vec_id, vec) rows that take part, their number and the longest length.

    Null ids, null and empty vectors and vectors with null or non-finite components take no part;
    shorter vectors are filled up with zeros.
    """
    rows = with_columns(vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vec")), vec_id="bigint", vec="array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    if not keep_zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width or 0) - F.size("vec")))
    return rows.select("vec_id", padded.alias("vec")), count, width or 0


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    import io

    with np.load(io.BytesIO(data)) as stored:
        return {k: stored[k] for k in stored.files}


def build_index(rows: DataFrame, count: int, width: int, kernel: Kernel, shard_rows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """One row per shard with its tree, written to the shared folder."""
    shards = max(1, math.ceil(count / shard_rows))

    def build(table: pa.Table) -> pa.Table:
        ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("vec"), width)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        return pa.table({
            "shard": table.column("shard").slice(0, 1).cast(pa.int32()),
            "size": pa.array([len(ids)], pa.int32()),
            "tree": pa.array([_pack(kernel.build(ids, vectors))], pa.binary()),
        })

    parts = min(shards, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec", "copy"), F.lit(shards)).cast("int"))
    built = sharded.repartition(parts, "shard").groupBy("shard").applyInArrow(build, INDEX)
    return scratch.save(built, "index"), shards


def search(
    rows: DataFrame, count: int, width: int, is_query: Callable[[Column], Column], k: int, kernel: Kernel,
    shard_rows: int = 4096, query_block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query by the kernel, ties to smaller ids.

    Rows that share an id are candidates of their own; as queries they share one result, the k best of all of them.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    scratch = Scratch(spark, "vector-search")
    schema = FOUND.format(kind=kernel.kind)
    if count == 0:
        return spark.createDataFrame([], schema.replace("vec_id", "rank int, vec_id"))
    copies = F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))
    kept = rows.groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies")).select("vec_id", "vec", F.explode(copies).alias("copy"))
    index, shards = build_index(kept, count, width, kernel, shard_rows, scratch)
    queries = scratch.save(kept.where(is_query(F.col("vec_id"))), "queries")
    blocks = max(1, math.ceil(queries.count() / query_block))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def cut(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    written = False
    for block in range(blocks):
        # At most about query_block rows by the hash; this is the only thing that is broadcast.
        own = queries.where(F.pmod(F.xxhash64("vec_id", "vec", "copy", F.lit(1)), F.lit(blocks)) == block).toArrow()
        ids, vectors = own.column("vec_id").to_numpy(), _matrix(own.column("vec"), width)
        low, wave, floors = 0, FIRST_WAVE, np.full(len(ids), -np.inf)
        found, names = None, []
        while low < shards and len(ids):
            shared = context.broadcast((ids, vectors, floors))

            def look(batches: Iterator[pa.RecordBatch], shared: Any = shared) -> Iterator[pa.RecordBatch]:
                state = None
                for batch in batches:
                    for tree in batch.column("tree"):
                        state = state or kernel.queries(*shared.value)
                        kernel.search(_unpack(tree.as_py()), state)
                if state:
                    yield pa.record_batch(dict(zip(("query_id", "vec_id", "score"), map(pa.array, kernel.found(state)))))

            part = in_batches(index.where((F.col("shard") >= low) & (F.col("shard") < low + wave)).select("tree")).mapInArrow(tidy(look), schema)
            names.append(f"found-{block}-{low}")
            found = scratch.save(part, names[-1]) if found is None else found.unionByName(scratch.save(part, names[-1]))
            low, wave = low + wave, 4 * wave
            if low < shards:
                kth = cut(found).where(F.col("rank") == k).select("query_id", "score").toArrow()
                known = dict(zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist()))
                floors = np.array([-np.inf if known.get(i) is None else floor_of(known[i]) for i in ids.tolist()])
            shared.unpersist()
        if found is not None:
            written = True
            cut(found).drop("rank").write.mode("append").parquet(scratch.path("best"))
            scratch.drop(*names)
    scratch.drop("queries", "index")
    if not written:
        return spark.createDataFrame([], schema.replace("vec_id", "rank int, vec_id"))
    return cut(spark.read.schema(schema).parquet(scratch.path("best"))).select("query_id", "rank", "vec_id", "score")


def floor_of(score: int | float) -> float:
    """A double that is not above the score, which may be a long beyond 2^53."""
    value = float(score)
    return float(np.nextafter(value, -np.inf)) if abs(value) >= 2.0**53 else value


class TopK:
    """The k best (score, id) of each query of a block, and the score that a candidate must reach."""

    def __init__(self, ids: np.ndarray, k: int, floors: np.ndarray, kind: type) -> None:
        self.ids, self.k = ids, k
        self.floors = floors.copy()
        self.scores = np.full((len(ids), k), -np.inf) if kind is float else np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), -1, dtype=np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates ``ids`` with their scores (rows x ids) for the queries in ``rows``."""
        useful = (scores >= self.floors[rows, None]) & (ids[None, :] != self.ids[rows, None])
        for at in np.flatnonzero(useful.any(axis=1)):
            row, own = rows[at], useful[at]
            held = self.found[row] >= 0
            new_scores = np.concatenate([self.scores[row][held], scores[at, own]])
            new_ids = np.concatenate([self.found[row][held], ids[own]])
            if len(new_ids) > 4 * self.k:  # ties at the k-th score stay
                kth = np.partition(new_scores, len(new_scores) - self.k)[len(new_scores) - self.k]
                keep = new_scores >= kth
                new_scores, new_ids = new_scores[keep], new_ids[keep]
            best = np.lexsort((new_ids, -new_scores))[: self.k]
            n = len(best)
            self.scores[row, :n], self.found[row, :n] = new_scores[best], new_ids[best]
            if n == self.k:
                self.floors[row] = max(self.floors[row], floor_of(new_scores[best[-1]]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = self.found >= 0
        return np.broadcast_to(self.ids[:, None], held.shape)[held], self.found[held], self.scores[held]
