"""Ranks and running totals over groups of any size.

A window over a whole run would put the run into one task. Here the rows are first range-partitioned by the
order column and written, each with the number of its partition, so that one (group, partition) holds about 1/partitions of the
data even when a single group holds most of it. The table is what later steps read, so the input is evaluated for it only. Totals per partition are
aggregated map-side, their running sum (one small row per group and partition) gives each partition its offset, and
the window runs inside the partition only. Any number of partitions is a number in a column, not an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.session import written

BUCKET = "_bucket"


def default_buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_bucket(hash_col: Column, buckets: int) -> Column:
    """Bucket of a 64-bit hash by its top bits, two to four times as many as asked for; keeps the hash order and needs no pass."""
    bits = max(1, int(2 * buckets).bit_length())
    return F.shiftright(hash_col, 64 - bits).cast("int")


def seeded_hash(seed: int, *cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def bucketize(df: DataFrame, order: str, buckets: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Rows in a written table, with the number of their range of (order, ties); numbers follow the order, nulls first."""
    ranged = df.repartitionByRange(buckets or default_buckets(df), order, *ties)
    return written(ranged.withColumn(BUCKET, F.spark_partition_id()))


Stat = tuple[Column, Callable[[str], Column]]
"""An aggregate per bucket, and how the buckets of a group combine."""


def _offsets(bucketed: DataFrame, group: list[str], sums: dict[str, Column], stats: dict[str, Stat], descending: bool) -> DataFrame:
    """One small row per group and bucket: sums of the buckets before it, statistics of its group."""
    small = bucketed.groupBy(*group, BUCKET).agg(
        *[c.alias(n) for n, c in sums.items()], *[c.alias(n) for n, (c, _) in stats.items()]
    )
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return small.select(
        *group, BUCKET,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[combine(n).over(whole).alias(n) for n, (_, combine) in stats.items()],
    )


def running_totals(
    df: DataFrame,
    group: list[str],
    order: str,
    values: dict[str, str],
    descending: bool = False,
    buckets: int | None = None,
    stats: dict[str, Stat] | None = None,
) -> DataFrame:
    """Add ``new = running sum of old`` for each ``old -> new`` in ``values``, current row included.

    Rows of one group need distinct ``order`` values. ``stats`` adds whole-group statistics from the same small table, which spares a join on the group, whose
    few keys would be hot.
    """
    cut = bucketize(df, order, buckets)
    offsets = _offsets(cut, group, {old: F.sum(old) for old in values}, stats or {}, descending)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*group, BUCKET).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, [*group, BUCKET])
    out = out.withColumns({new: F.sum(old).over(inside) + F.col(f"_before_{old}") for old, new in values.items()})
    return out.drop(BUCKET, *[f"_before_{old}" for old in values])


def row_numbers(
    df: DataFrame,
    group: list[str],
    order: str,
    ties: Sequence[str] = (),
    name: str = "row_no",
    hashed: bool = False,
    buckets: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, by ``order`` and then ``ties``.

    ``hashed`` says that ``order`` is a 64-bit hash, whose top bits serve as bucket (``df`` is then read twice); ``size``
    names a column for the number of rows of the group.
    """
    if hashed:
        cut = df.withColumn(BUCKET, hash_bucket(F.col(order), buckets or default_buckets(df)))
    else:
        cut = bucketize(df, order, buckets, ties)
    stats = {size: (F.count(F.lit(1)), F.sum)} if size else {}
    offsets = _offsets(cut, group, {"n": F.count(F.lit(1))}, stats, descending=False)
    inside = Window.partitionBy(*group, BUCKET).orderBy(order, *ties)
    return (
        cut.join(offsets, [*group, BUCKET])
        .withColumn(name, F.row_number().over(inside) + F.col("_before_n"))
        .drop(BUCKET, "_before_n")
    )
