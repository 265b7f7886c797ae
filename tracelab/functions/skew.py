"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.session import materialize

SHARE = 0.001
LEAST = 100_000
MOST_SALTS = 10_000
BROADCAST_ROWS = 500_000


def hot_keys(rows: DataFrame, keys: list[str], share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(*keys, _salts) of the keys that hold more than ``share`` of all rows, and more than ``least``: at most 1/share keys.

    ``_salts`` grows with the rows of a key, so that one salt has about ``least`` of them.
    """
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least))
    total = rows.agg(F.count(F.lit(1))).scalar()
    salts = F.least(F.ceil(F.col("_n") / F.lit(max(1, least))), F.lit(MOST_SALTS)).cast("int").alias("_salts")
    return counts.where(F.col("_n") > total * share).select(*keys, salts)


def skew_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
    hot: DataFrame | None = None, least: int = LEAST,
) -> DataFrame:
    """``big.join(small, keys, how)`` with the rows of hot keys spread over as many tasks as they need.

    ``spread`` are columns of ``big`` that tell the rows of one key apart. ``small`` is repeated
    only for hot keys, of which there are at most 1/SHARE; that bound also lets the list of hot keys
    be broadcast.
    """
    hot = hot_keys(big, keys, least=least) if hot is None else hot
    if hot.isEmpty():
        return big.join(small, keys, how)
    mark = F.broadcast(hot)
    salt = F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_salts") > 1, F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    left = big.join(mark, keys, "left").withColumn("_salt", salt).drop("_salts")
    right = small.join(mark, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, least: int = LEAST
) -> DataFrame:
    """``big.join(small, keys, how)`` for a dictionary: broadcast when its counted rows fit, else salted by the counts of ``big``."""
    kept = materialize(small)
    if kept.count() <= max_rows:
        return big.join(F.broadcast(kept), keys, how)
    return skew_join(big, kept, keys, spread, how, least=least)
