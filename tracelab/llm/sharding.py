"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in parts of known sizes and go to blocks of known sizes, the consecutive slot ranges of the shards.
How many rows of each part go to each block in a uniform permutation of all rows is a matrix with these two margins
and a multivariate hypergeometric law. It is drawn by halving the parts: of the places of a node, so many
of each block belong to its first half. Every node has a random stream of its own, so a task draws the row of its part along the
path from the root, and nobody holds the matrix.

Then a part permutes its rows and deals them out by its row of counts, the rows are exchanged, and every block permutes
what it received: the place of a row is uniform over all slots, and sizes are exact, not just expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tracelab.llm.store import Scratch, in_batches, tidy

#: Rows of a part and slots of a block at most: what a task permutes at a time (8 MB).
BLOCK_ROWS = 1 << 20
#: NumPy draws from urns of fewer balls; larger ones are drawn below.
NUMPY_URN = 1_000_000_000
#: Of the standard deviation, to each side of the mode: the rest of the law weighs less than 1e-30.
REACH = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good balls among ``draws`` balls of an urn without replacement, for urns of any size."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if draws == good + bad:
        return good
    if good + bad < NUMPY_URN:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    deviation = (draws / total * good * (bad / total) * ((total - draws) / (total - 1))) ** 0.5
    low, high = max(low, mode - int(REACH * deviation) - 20), min(high, mode + int(REACH * deviation) + 20)
    # Logarithms of the ratios of neighbouring probabilities, summed from the lower end.
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def multivariate(rng: np.random.Generator, places: np.ndarray, draws: int) -> np.ndarray:
    """How many of each kind are among ``draws`` places drawn without replacement."""
    places = np.asarray(places, dtype=np.int64)
    total = int(places.sum())
    if draws == total:
        return places.copy()
    if total < NUMPY_URN:
        return rng.multivariate_hypergeometric(places, draws, method="marginals")
    out, left = np.zeros(len(places), dtype=np.int64), draws
    for i, here in enumerate(places.tolist()):
        total -= here
        out[i] = hypergeometric(rng, here, total, left)
        left -= int(out[i])
        if not left:
            break
    return out


@dataclass(frozen=True)
class Plan:
    """Margins of the matrix: ``starts`` counts the rows before each part, ``blocks`` are sizes of the targets."""

    starts: np.ndarray
    blocks: np.ndarray
    seed: int

    def row(self, part: int) -> np.ndarray:
        """Rows of a part for each block."""
        low, high, places = 0, len(self.starts) - 1, self.blocks
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, 0, low, high])
            first = multivariate(rng, places, int(self.starts[middle] - self.starts[low]))
            if part < middle:
                high, places = middle, first
            else:
                low, places = middle, places - first
        return places


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; the first shards have one more."""
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], dtype=np.int64)


def block_table(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of each block: shards cut into ranges of at most ``block_rows`` slots, as even as can be."""
    sizes = shard_sizes(rows, shards)
    pieces = np.maximum(1, -(-sizes // block_rows))
    shard = np.repeat(np.arange(shards), pieces)
    number = np.arange(len(shard)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size, rest = sizes[shard] // pieces[shard], sizes[shard] % pieces[shard]
    return shard, number * size + np.minimum(number, rest), size + (number < rest)


def numbered(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` with ``_part`` and ``_at``: the number of a run of at most ``block_rows`` rows of a task, and the place in it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            at = seen + np.arange(batch.num_rows, dtype=np.int64)
            seen += batch.num_rows
            yield batch.append_column("_part", pa.array(task + at // block_rows)).append_column("_at", pa.array(at % block_rows))

    fields = [*rows.schema.fields, StructField("_part", LongType()), StructField("_at", LongType())]
    return in_batches(rows).mapInArrow(tidy(number), StructType(fields))


def shuffled(docs: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` and ``_shard`` and ``_slot``, a uniform random permutation of the rows.

    Shard sizes are at most one apart, and slots count from 0 without gaps in every shard. Rows are dealt
    whatever they hold: nulls, empty and very long texts and repeated rows are rows like any other, and equal rows need not share a
    shard. An empty table gives no rows; with fewer rows than shards the last shards are empty. Columns of the input named
    ``_part``, ``_at``, ``_block``, ``_shard`` or ``_slot`` are replaced. The rows are written once in the shared folder, which the result reads:
    a task that is run again deals its rows as before. The driver sees one number per part.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    # Bare places for names: the caller's may clash in any way.
    own = [(f"column{i}", c) for i, c in enumerate(docs.columns)]
    kept = [(place, c) for place, c in own if c not in ("_part", "_at", "_block", "_shard", "_slot")]
    plain = docs.toDF(*[place for place, _ in own]).select(*[place for place, _ in kept])
    written = scratch.save(numbered(plain, block_rows), "rows")
    counts = written.groupBy("_part").count().orderBy("_part").collect()
    parts = np.array([r[0] for r in counts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([r[1] for r in counts], dtype=np.int64)]).astype(np.int64)
    shard, first_slot, size = block_table(int(starts[-1]), shards, block_rows)
    plan = Plan(starts, size, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, target = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            part, at = batch.column("_part").to_numpy(), batch.column("_at").to_numpy()
            block = np.empty(len(part), dtype=np.int64)
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                if part[a] != known:
                    known, place = part[a], int(np.searchsorted(parts, part[a]))
                    target = np.repeat(np.arange(len(size)), plan.row(place))
                    np.random.default_rng([seed, 1, place]).shuffle(target)
                block[a:b] = target[at[a:b]]
            yield batch.append_column("_block", pa.array(block, pa.int32()))

    dealt = in_batches(written).mapInArrow(tidy(deal), StructType([*written.schema.fields, StructField("_block", IntegerType())]))
    exchanged = dealt.repartitionById(len(size), "_block").sortWithinPartitions("_block", "_part", "_at")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, order = None, 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            block = batch.column("_block").to_numpy()
            slot = np.empty(len(block), dtype=np.int64)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]):
                if block[a] != known:
                    known, seen = block[a], 0
                    order = np.random.default_rng([seed, 2, int(known)]).permutation(size[known])
                slot[a:b] = first_slot[known] + order[seen : seen + b - a]
                seen += b - a
            rows = batch.drop_columns(["_part", "_at", "_block"])
            yield rows.append_column("_shard", pa.array(shard[block], pa.int32())).append_column("_slot", pa.array(slot))

    fields = [*plain.schema.fields, StructField("_shard", IntegerType()), StructField("_slot", LongType())]
    return in_batches(exchanged).mapInArrow(tidy(place), StructType(fields)).toDF(*[c for _, c in kept], "_shard", "_slot")


def write_shards(dealt: DataFrame, folder: str) -> None:
    """Parquet files under ``folder/_shard=<n>``, each in the order of slots."""
    dealt.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(folder)


def sized(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32): bytes of the text and ``overhead``, and the checksum; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
