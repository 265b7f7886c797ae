"""Cell-level operators: reveal flags, changes, running costs, unmask order, token text.

Every window here stays inside one sample, whose size the sampler bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.skew import lookup_join
from tracelab.session import KEY


def by_pos():
    return Window.partitionBy(*KEY, "pos").orderBy("step")


def so_far():
    return by_pos().rowsBetween(Window.unboundedPreceding, 0)


def first_revealed(cells: DataFrame) -> DataFrame:
    """Flag the first step at which a position is not masked."""
    first = F.min(F.when(~F.col("masked"), F.col("step"))).over(Window.partitionBy(*KEY, "pos"))
    return cells.withColumn("first_revealed", F.coalesce(F.col("step") == first, F.lit(False)))


def effective_mask(cells: DataFrame) -> DataFrame:
    return cells.withColumn("effective", F.col("masked_in") & ~F.col("padding"))


def h_score(cells: DataFrame) -> DataFrame:
    """prob - unmask_prob, its clamp to [0, 1], and the cells that may be masked again."""
    h = F.col("prob") - F.col("unmask_prob")
    return cells.withColumns(
        {
            "h_score": h,
            "remask_prob": F.when(h < 0, F.lit(0.0)).when(h > 1, F.lit(1.0)).otherwise(h),
            "remask_candidate": (h > 0) & ~F.col("masked"),
        }
    )


def step_change(cells: DataFrame) -> DataFrame:
    """x0 differs from the step before; the first step counts as unchanged."""
    previous = F.lag("x0_id").over(by_pos())
    return cells.withColumn("changed", F.coalesce(F.col("x0_id") != previous, F.lit(False)).cast("int"))


def cumulative_changes(cells: DataFrame) -> DataFrame:
    return step_change(cells).withColumn("n_changes", F.sum("changed").over(so_far()))


def entropic_cost(cells: DataFrame) -> DataFrame:
    """Running sum over steps of entropy where a still-masked token changed."""
    cost = F.col("changed") * F.col("masked_in").cast("int") * F.col("entropy")
    return step_change(cells).withColumn("entropic_cost", F.sum(cost).over(so_far()))


def step_levenshtein(cells: DataFrame, text: str = "token") -> DataFrame:
    """Edit distance between the proposed texts of consecutive steps; one row less per position."""
    return (
        cells.withColumn("distance", F.levenshtein(F.col(text), F.lag(text).over(by_pos())))
        .where("step > 0")
        .select(*KEY, "step", "pos", "distance")
    )


def lag_entropy(cells: DataFrame) -> DataFrame:
    return cells.withColumn("entropy_before", F.lag("entropy").over(by_pos()))


def unmask_steps(cells: DataFrame) -> DataFrame:
    """First step >= 1 with masked before and not now; the number of steps if never.

    The last-step rule of ``just_unmasked`` does not apply, so cells still masked are excluded.
    """
    revealed = F.col("just_unmasked_in") & ~F.col("masked_in")
    aggs = [F.coalesce(F.min(F.when(revealed, F.col("step"))), F.max("n_steps")).alias("unmask_step")]
    if "padding" in cells.columns:
        aggs.append(F.max("padding").alias("padding"))
    return cells.groupBy(*KEY, "pos").agg(*aggs, F.max("n_steps").alias("n_steps"))


def unmask_order(cells: DataFrame) -> DataFrame:
    """Rank 0.. of the revealed, non-padding positions by unmask step, then position."""
    found = unmask_steps(cells).where(F.col("unmask_step") < F.col("n_steps"))
    if "padding" in found.columns:
        found = found.where(~F.col("padding"))
    order = Window.partitionBy(*KEY).orderBy("unmask_step", "pos")
    return found.select(*KEY, "pos", "unmask_step", (F.row_number().over(order) - 1).alias("rank"))


def evenly_spaced(ranked: DataFrame, n: int = 10) -> DataFrame:
    """n ranks evenly spaced from first to last; every rank when there are fewer than n."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("size") - 1) / (n - 1)))
    return (
        ranked.withColumn("size", size)
        .where((F.col("size") < n) | F.array_contains(picks, F.col("rank").cast("bigint")))
        .drop("size")
    )


def token_rows(cells: DataFrame, token: str = "x0_id") -> DataFrame:
    """Token ids of each step as one array."""
    packed = F.array_sort(F.collect_list(F.struct("pos", token)))
    return cells.groupBy(*KEY, "step").agg(packed[token].alias("tokens"))


def decode_tokens(cells: DataFrame, vocab: DataFrame, token: str = "x0_id") -> DataFrame:
    """Token text of each cell; ids outside the vocabulary give an empty text."""
    names = vocab.select(F.col("token_id").alias(token), F.col("text").alias("token"))
    return lookup_join(cells, names, [token], [*KEY, "step", "pos"], "left").withColumn("token", F.coalesce("token", F.lit("")))


def step_text(decoded: DataFrame) -> DataFrame:
    """Text of each step, tokens joined by blanks."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return decoded.groupBy(*KEY, "step").agg(F.array_join(packed["token"], " ").alias("text"))


def write_step_text(decoded: DataFrame, path: str) -> None:
    """One text line per step, in step order inside a sample, plus the final sentence."""
    lines = step_text(decoded)
    last = lines.groupBy(*KEY).agg(
        F.max("step").alias("step"), F.concat(F.lit("Final sentence: "), F.max_by("text", "step")).alias("value")
    )
    rows = lines.select(*KEY, "step", F.lit(0).alias("part"), F.concat_ws(" . ", F.col("step").cast("string"), "text").alias("value"))
    both = rows.unionByName(last.withColumn("part", F.lit(1)))
    both.repartition(*KEY).sortWithinPartitions(*KEY, "step", "part").select("value").write.text(path)
