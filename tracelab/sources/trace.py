"""Trace tables: one stored row per sample, one analytic row per cell.

A stored row holds each channel as ``ARRAY<ARRAY<..>>`` (steps, then positions). It is what a
sampler writes, it is compact, and one sample never spans two files. ``explode_trace`` turns rows
into cells. It hash-partitions the compact rows by (run_id, sample_id) first, so that every later
grouping or window below a sample (by step, by position, by cell) needs no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.session import KEY

# What a missing cell of a channel is filled with.
CHANNEL_FILLS = {
    "x_id": "pad",
    "x0_id": "pad",
    "prob": 0.0,
    "unmask_prob": 0.0,
    "entropy": 0.0,
    "h_score": 0.0,
    "sem_entropy": 0.0,
    "sem_dispersion": 0.0,
    "sem_prob": 0.0,
    "sem_label": 0,
    "masked": True,
    "accepted": False,
    "remasked": False,
}

_grid = lambda t: T.ArrayType(T.ArrayType(t))

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("sample_id", T.LongType(), False),
        T.StructField("start_idx", T.IntegerType()),
        T.StructField("max_new_tokens", T.IntegerType()),
        T.StructField("block_size", T.IntegerType()),
        T.StructField("post_commit", T.BooleanType()),
        T.StructField("x_id", _grid(T.IntegerType())),
        T.StructField("x0_id", _grid(T.IntegerType())),
        T.StructField("prob", _grid(T.DoubleType())),
        T.StructField("unmask_prob", _grid(T.DoubleType())),
        T.StructField("entropy", _grid(T.DoubleType())),
        T.StructField("masked", _grid(T.BooleanType())),
        T.StructField("accepted", _grid(T.BooleanType())),
        T.StructField("remasked", _grid(T.BooleanType())),
        T.StructField("sem_entropy", _grid(T.DoubleType())),
        T.StructField("sem_dispersion", _grid(T.DoubleType())),
        T.StructField("sem_prob", _grid(T.DoubleType())),
        T.StructField("sem_label", _grid(T.IntegerType())),
        T.StructField("n_transfer", T.ArrayType(T.IntegerType())),
    ]
)


def read_trace(spark: SparkSession, *paths: str) -> DataFrame:
    """All shards below ``paths``; the schema is enforced, ``run_id=`` folders are partitions."""
    return spark.read.schema(TRACE_SCHEMA).parquet(*paths)


def write_trace(rows: DataFrame, path: str) -> None:
    """One folder per run, samples in order inside each file.

    Writers are spread by sample, so that one large run is not written by a single task.
    """
    rows.repartition(*KEY).sortWithinPartitions(*KEY).write.partitionBy("run_id").parquet(path)


def write_trace_table(rows: DataFrame, table: str, buckets: int) -> None:
    """Bucketed by sample: a job that reads this table explodes without any exchange."""
    rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)


def merge_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Union of shard batches; channels that a batch lacks become NULL."""
    merged = batches[0]
    for other in batches[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def order_shards(rows: DataFrame, ordinal: str = "sample_id") -> DataFrame:
    """Global order by ordinal as range partitions, each sorted (no single-task sort)."""
    return rows.repartitionByRange(ordinal).sortWithinPartitions(ordinal)


def interleave_shards(rows: DataFrame, shards: int, ordinal: str = "sample_id") -> DataFrame:
    """Shard number of each row: shard r takes ordinals r, r + shards, ..."""
    return rows.withColumn("shard", F.pmod(F.col(ordinal), F.lit(shards)).cast("int"))


def _fill(channel: str, pad_id: int) -> Column:
    value = CHANNEL_FILLS[channel]
    return F.lit(pad_id if value == "pad" else value)


def window_rows(rows: DataFrame, channels: Sequence[str], pad_id: int = 0) -> DataFrame:
    """Cut every channel to [start_idx, start_idx + max_new_tokens) and right-pad ragged steps.

    Works inside the row, so nothing is shuffled.
    """
    offsets = F.sequence(F.col("start_idx"), F.col("start_idx") + F.col("max_new_tokens") - 1)

    def cut(channel: str) -> Column:
        fill = _fill(channel, pad_id)
        return F.transform(
            F.col(channel), lambda step: F.transform(offsets, lambda i: F.coalesce(F.get(step, i), fill))
        )

    return rows.withColumns({c: cut(c) for c in channels})


def _shifted(channel: Column, kind: str = "boolean") -> Column:
    """Channel of the step before; NULL at the first step."""
    blank = F.transform(channel[0], lambda _: F.lit(None).cast(kind))
    return F.concat(F.array(blank), F.slice(channel, F.lit(1), F.size(channel) - 1))


def _masked_going_in(mask: Column, post_commit: Column) -> Column:
    full = F.transform(mask[0], lambda _: F.lit(True))
    late = F.concat(F.array(full), F.slice(mask, F.lit(1), F.size(mask) - 1))
    return F.when(post_commit, late).otherwise(mask)


def _padding_row(pad_id: int) -> Column:
    """Per position: masked at least once, and the pad id proposed at every masked step.

    A fold over the steps whose lambdas use only their own arguments: 0 not masked so far, 1 only
    the pad id so far, 2 something else.
    """
    codes = F.zip_with(
        "masked", "x0_id",
        lambda ms, xs: F.zip_with(ms, xs, lambda m, x: F.when(~m, 0).when(x == pad_id, 1).otherwise(2)),
    )
    none = F.array_repeat(F.lit(0), F.size(F.col("masked")[0]))
    seen = F.aggregate(codes, none, lambda acc, row: F.zip_with(acc, row, lambda a, r: F.greatest(a, r)))
    return F.transform(seen, lambda a: a == 1)


def explode_trace(
    rows: DataFrame,
    channels: Sequence[str] = ("entropy", "prob", "x0_id", "masked"),
    keep: Sequence[str] = (),
    pad_id: int | None = None,
    colocate: bool = True,
    with_lag: bool = False,
) -> DataFrame:
    """Cells (run_id, sample_id, step, pos, channels) with the mask history flags.

    Flags: ``masked_in`` (masked going into the step), ``just_unmasked`` (from the recorded mask),
    ``just_unmasked_in`` (from ``masked_in``), with ``pad_id`` ``padding``, and with ``with_lag``
    ``entropy_before`` (entropy one step earlier). They come from array
    shifts inside the row, which spares the sort that a lag window over cells would need. Pass
    ``colocate=False`` for a table already bucketed by sample.
    """
    base = rows.select(*KEY, *keep, "post_commit", *channels)
    if colocate:
        base = base.repartition(*KEY)
    base = base.withColumn("masked_in", _masked_going_in(F.col("masked"), F.col("post_commit")))
    grids = [*channels, "masked_in", "prev_masked", "prev_masked_in"]
    extra = {"prev_masked": _shifted(F.col("masked")), "prev_masked_in": _shifted(F.col("masked_in"))}
    if with_lag:
        extra["entropy_before"] = _shifted(F.col("entropy"), "double")
        grids.append("entropy_before")
    meta = [*KEY, *keep, "n_steps"]
    base = base.withColumns({**extra, "n_steps": F.size("masked")})
    if pad_id is not None:
        base = base.withColumn("padding", _padding_row(pad_id))
        meta.append("padding")
    steps = base.select(
        *meta, F.posexplode(F.arrays_zip(*grids)).alias("step", "row")
    )
    zipped = [F.col("row")[c].alias(c) for c in grids]
    if pad_id is not None:
        steps = steps.select(*meta, "step", *zipped)
        cells = steps.select(
            *KEY, *keep, "n_steps", "step",
            F.posexplode(F.arrays_zip(*grids, "padding")).alias("pos", "cell"),
        )
        grids = [*grids, "padding"]
    else:
        steps = steps.select(*meta, "step", *zipped)
        cells = steps.select(
            *KEY, *keep, "n_steps", "step", F.posexplode(F.arrays_zip(*grids)).alias("pos", "cell")
        )
    cells = cells.select(
        *KEY, *keep, "n_steps", "step", "pos", *[F.col("cell")[c].alias(c) for c in grids]
    )
    return cells.withColumns(
        {
            "just_unmasked": just_unmasked("masked", "prev_masked"),
            "just_unmasked_in": just_unmasked("masked_in", "prev_masked_in"),
        }
    ).drop("prev_masked", "prev_masked_in")


def just_unmasked(masked: str, previous: str) -> Column:
    """Masked before and not now; at the last step also every cell still masked."""
    return (F.coalesce(F.col(previous), F.lit(False)) & ~F.col(masked)) | (
        (F.col("step") == F.col("n_steps") - 1) & F.col(masked)
    )


def densify(cells: DataFrame, steps: int, width: int, fills: dict[str, object]) -> DataFrame:
    """Complete long cells to the steps x width grid of every sample, missing cells filled."""
    grid = (
        cells.select(*KEY)
        .distinct()
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    )
    joined = grid.join(cells, [*KEY, "step", "pos"], "left")
    return joined.select(
        *KEY, "step", "pos", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fills.items()]
    )


def window_slice(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells in [start_idx, start_idx + max_new_tokens), positions re-based to 0."""
    return (
        cells.join(samples.select(*KEY, "start_idx", "max_new_tokens"), KEY)
        .where((F.col("pos") >= F.col("start_idx")) & (F.col("pos") < F.col("start_idx") + F.col("max_new_tokens")))
        .withColumn("pos", F.col("pos") - F.col("start_idx"))
        .drop("start_idx", "max_new_tokens")
    )


def crop_or_zero(rows: DataFrame, channel: str) -> DataFrame:
    """The window of one channel, or all zeros when the window exceeds the recorded width."""
    width = F.size(F.col(channel)[0])
    fits = F.col("start_idx") + F.col("max_new_tokens") <= width
    cut = F.transform(
        F.col(channel),
        lambda step: F.when(fits, F.slice(step, F.col("start_idx") + 1, F.col("max_new_tokens"))).otherwise(
            F.array_repeat(F.lit(0.0), F.col("max_new_tokens"))
        ),
    )
    return rows.withColumn(channel, cut)


def assemble_matrix(cells: DataFrame, channel: str) -> DataFrame:
    """Back from cells to one ARRAY<ARRAY<DOUBLE>> per sample, non-finite values as 0.

    A sample has a fixed, small number of cells, so its matrix fits a row.
    """
    clean = finite_or_zero(F.col(channel))
    steps = cells.groupBy(*KEY, "step").agg(
        F.array_sort(F.collect_list(F.struct("pos", clean.alias("v")))).alias("vs")
    )
    matrix = steps.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("step", F.col("vs.v").alias("row")))).alias("rows")
    )
    return matrix.select(
        *KEY,
        F.col("rows.row").alias("matrix"),
        F.transform(F.col("rows.step"), lambda s: (s + 1).cast("double")).alias("times"),
    )


def finite_or_zero(value: Column) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def with_history(cells: DataFrame, pad_id: int | None = None) -> DataFrame:
    """The flags of ``explode_trace`` for cells stored in long form, by windows.

    One lag window per (sample, pos); a sample is bounded, so no window partition can grow large.
    """
    by_pos = Window.partitionBy(*KEY, "pos").orderBy("step")
    whole = Window.partitionBy(*KEY)
    post = F.col("post_commit") if "post_commit" in cells.columns else F.lit(False)
    out = (
        cells.withColumn("_prev", F.lag("masked").over(by_pos))
        .withColumn("masked_in", F.when(post, F.coalesce(F.col("_prev"), F.lit(True))).otherwise(F.col("masked")))
        .withColumn("_prev_in", F.lag("masked_in").over(by_pos))
        .withColumn("n_steps", F.max("step").over(whole) + 1)
    )
    out = out.withColumns(
        {
            "just_unmasked": just_unmasked("masked", "_prev"),
            "just_unmasked_in": just_unmasked("masked_in", "_prev_in"),
        }
    ).drop("_prev", "_prev_in")
    if pad_id is not None:
        proposed = F.when(F.col("masked"), F.col("x0_id") == pad_id)
        always = F.bool_and(proposed).over(Window.partitionBy(*KEY, "pos"))
        out = out.withColumn("padding", F.coalesce(always, F.lit(False)))
    return out


def padding_mask(cells: DataFrame, pad_id: int) -> DataFrame:
    """(sample, pos, padding): pad id proposed at all masked steps; never masked is not padding."""
    proposed = F.when(F.col("masked"), F.col("x0_id") == pad_id)
    return cells.groupBy(*KEY, "pos").agg(F.coalesce(F.bool_and(proposed), F.lit(False)).alias("padding"))
