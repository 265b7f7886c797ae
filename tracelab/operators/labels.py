"""Labels, splits, folds and samples.

Positions and ranks come from ``functions.ordering``, so none of these puts a run or a class into
one task. Random choices are ranks of a seeded hash of the row's id: they do not depend on how the
rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.ordering import row_numbers, seeded_hash


def label_rule(value: Column, mode: str) -> Column:
    """1 for a hallucination, 0 for none.

    ``yes``: yes is 1, anything else 0. ``not_no``: no is 0, anything else 1. ``strict``: yes or no
    in any case, anything else NULL. ``missing_no``: as ``yes``, a missing answer counts as no.
    """
    if mode == "yes":
        return F.when(value == "yes", 1).otherwise(0)
    if mode == "not_no":
        return F.when(value == "no", 0).otherwise(1)
    if mode == "strict":
        return F.when(F.lower(value) == "yes", 1).when(F.lower(value) == "no", 0)
    if mode == "missing_no":
        return F.when(F.coalesce(value, F.lit("no")) == "yes", 1).otherwise(0)
    raise ValueError(f"unknown label rule {mode!r}")


def dedup_first(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """First row of each key by ordinal, as a partial aggregate (copies are dropped map-side)."""
    kept = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), ordinal).alias("kept")
    return rows.groupBy(*keys).agg(kept).select(*keys, "kept.*")


def label_pool(judged: DataFrame) -> DataFrame:
    """Usable rows: first copy of each index, and only then yes/no labels."""
    first = dedup_first(judged, ["run_id", "index"])
    return first.withColumn("label", label_rule(F.col("is_hallucination"), "strict")).where("label IS NOT NULL")


def sequential_split(pool: DataFrame, ratio: float = 0.8, ordinal: str = "ordinal") -> DataFrame:
    """``split``: train for the first int(ratio * n) rows of a run by ordinal, test for the rest."""
    ranked = row_numbers(pool, ["run_id"], ordinal, name="_no", size="_n")
    cut = F.floor(F.col("_n") * F.lit(ratio))
    return ranked.withColumn("split", F.when(F.col("_no") <= cut, "train").otherwise("test")).drop("_no", "_n")


def hash_ranks(rows: DataFrame, group: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """``rank`` 1.. of a seeded hash inside each group, and the group's size ``group_n``."""
    hashed = rows.withColumn("_hash", seeded_hash(seed, *ids))
    return row_numbers(hashed, group, "_hash", ids, name="rank", hashed=True, size="group_n").drop("_hash")


def balanced_sample(rows: DataFrame, n: int, group: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """n // 2 rows of each class, fewer where a class is smaller."""
    return hash_ranks(rows, group, ids, seed).where(F.col("rank") <= n // 2).drop("rank", "group_n")


def shuffled_head(rows: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """The first n rows of a seeded shuffle."""
    ranked = row_numbers(rows.withColumn("_hash", seeded_hash(seed, *ids)), [], "_hash", ids, name="shuffled_no", hashed=True)
    return ranked.where(F.col("shuffled_no") <= n).drop("_hash")


def stratified_part(rows: DataFrame, share: float, group: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """``picked``: the first ``share`` of each class by seeded hash."""
    ranked = hash_ranks(rows, group, ids, seed)
    return ranked.withColumn("picked", F.col("rank") <= F.floor(F.col("group_n") * F.lit(share))).drop("rank", "group_n")


def stratified_folds(rows: DataFrame, folds: int, group: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """``fold`` 0 .. folds - 1, classes spread evenly."""
    ranked = hash_ranks(rows, group, ids, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "group_n")


def subsample(rows: DataFrame, fraction: float, round_no: int, group: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """max(int(n * fraction), 2) rows without replacement; every round draws anew."""
    ranked = hash_ranks(rows, group, ids, seed * 1_000_003 + round_no)
    size = F.greatest(F.floor(F.col("group_n") * F.lit(fraction)), F.lit(2))
    return ranked.where(F.col("rank") <= size).drop("rank", "group_n")


def fixed_batches(rows: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """``batch`` id and ``slot`` 0.. of consecutive groups of ``size`` rows in a run."""
    ranked = row_numbers(rows, ["run_id"], ordinal, name="_no")
    return ranked.withColumns(
        {
            "batch": F.floor((F.col("_no") - 1) / size).cast("bigint"),
            "slot": ((F.col("_no") - 1) % size).cast("int"),
        }
    ).drop("_no")


def positional_labels(samples: DataFrame, labels: DataFrame, position: str = "sample_id") -> DataFrame:
    """Label found at the row ordinal that the sample names, in the judged file of its run."""
    return samples.join(labels.select("run_id", F.col("ordinal").alias(position), "label"), ["run_id", position])


def strict_align(labels: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that raises when a label has no trace."""
    found = traces.withColumn("_found", F.lit(True))
    joined = labels.join(found, keys, "left")
    checked = F.when(F.col("_found"), True).otherwise(
        F.raise_error(F.concat(F.lit("no trace for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("boolean")
    )
    return joined.withColumn("_found", checked).where("_found").drop("_found")
