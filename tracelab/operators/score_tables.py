"""Score tables: one row per sample, one column per detector; merging, auditing and reporting them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.functions.text import strip
from tracelab.session import KEY

# Columns filled only where empty, columns that hold fitted scores, the out-of-pool mark.
FILLED = ["label_hallucination", "split"]
TRAINED = ["lexical_similarity", "baseline", "markov", "baseline_markov"]
OUT_OF_POOL = "excluded"


def _empty(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def upsert_scores(scores: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` for matching samples, add missing samples, keep everything else.

    Label and split are only filled where they are empty.
    """
    return _merge(scores, new, columns, "full")


def update_scores(scores: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """As ``upsert_scores`` for matching samples only; nothing is inserted."""
    return _merge(scores, new.select(*KEY, *columns), columns, "left")


def _merge(scores: DataFrame, new: DataFrame, columns: list[str], how: str) -> DataFrame:
    fresh = new.select(*KEY, F.struct(*[c for c in new.columns if c not in KEY]).alias("_new"))
    joined = scores.join(fresh, KEY, how)
    out = []
    names = scores.columns + [c for c in columns if c not in scores.columns]
    for name in names:
        if name in KEY:
            out.append(F.col(name))
        elif name in columns:
            old = F.col(name) if name in scores.columns else F.lit(None)
            out.append(F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(old).alias(name))
        elif name in FILLED and name in new.columns:
            out.append(F.when(_empty(F.col(name)), F.col("_new")[name]).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def write_version(scores: DataFrame, base: str) -> str:
    """Write a complete new version below ``base``; readers never see a half-written table."""
    path = f"{base}/version={uuid.uuid4().hex}"
    scores.write.parquet(path)
    return path


class StaleVersion(Exception):
    """Another writer has committed the version that this one meant to write."""


def _files(spark: SparkSession, base: str):
    """(Path class, file context) of the store that holds ``base``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(base)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return hadoop.Path, hadoop.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, base: str) -> tuple[int, str | None]:
    """(number, folder) of the newest committed version; (0, None) before the first.

    Commits are files ``commits/<number>`` that hold the folder's name and never change.
    """
    Path, files = _files(spark, base)
    folder = Path(f"{base}/commits")
    if not files.util().exists(folder):
        return 0, None
    names = [s.getPath().getName() for s in files.util().listStatus(folder)]
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return 0, None
    text = spark.read.text(f"{base}/commits/{max(numbers):020d}").first()[0]
    return max(numbers), f"{base}/{text}"


def current_scores(spark: SparkSession, base: str) -> tuple[DataFrame | None, int]:
    """The committed table and its number; a reader that has started keeps its version when a newer one is committed."""
    number, folder = current_version(spark, base)
    return (spark.read.parquet(folder) if folder else None), number


def commit_scores(scores: DataFrame, base: str, expected: int) -> int:
    """Write a version and make it the current one, if ``expected`` still is; else ``StaleVersion``, and nothing changes.

    The pointer is written aside and renamed to the number after ``expected``. Renaming fails where that number exists, so of
    two writers that read the same version one is told, and no update is lost.
    """
    spark = scores.sparkSession
    if current_version(spark, base)[0] != expected:
        raise StaleVersion(f"version {expected} is no longer the current one")
    folder = write_version(scores, base)
    Path, files = _files(spark, base)
    target, aside = Path(f"{base}/commits/{expected + 1:020d}"), f"{base}/aside-{uuid.uuid4().hex}"
    spark.createDataFrame([(folder.rsplit("/", 1)[1],)], "value STRING").coalesce(1).write.text(aside)
    part = next(s.getPath() for s in files.util().listStatus(Path(aside)) if s.getPath().getName().startswith("part-"))
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.mkdir(target.getParent(), None, True)
        files.rename(part, target, options)
    except Exception as e:  # noqa: BLE001 - py4j wraps what the store raises
        files.delete(Path(folder), True)
        if files.util().exists(target):
            raise StaleVersion(f"version {expected + 1} was committed by another writer") from e
        raise
    finally:
        files.delete(Path(aside), True)
    return expected + 1


def swap_scores(spark: SparkSession, base: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 5) -> int:
    """Commit ``change(current table)``, anew on top of what another writer has committed in between."""
    for left in range(attempts - 1, -1, -1):
        table, number = current_scores(spark, base)
        try:
            return commit_scores(change(table), base, number)
        except StaleVersion:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


def consolidate(results: list[DataFrame]) -> DataFrame:
    """One row per sample across detectors; the first detector's label and split stand.

    A union and one partial aggregate take the place of a chain of full outer joins.
    """
    tagged = [r.withColumn("_no", F.lit(i)) for i, r in enumerate(results)]
    stacked = tagged[0]
    for other in tagged[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    value_columns = [c for c in stacked.columns if c not in (*KEY, *FILLED, "_no")]
    return stacked.groupBy(*KEY).agg(
        *[F.min_by(c, "_no").alias(c) for c in FILLED if c in stacked.columns],
        *[F.max(c).alias(c) for c in value_columns],
    )


def read_scores(spark: SparkSession, path: str, schema: str, split: str = "test") -> DataFrame:
    """All score CSV files below ``path`` with their folder as ``model``; unlabelled rows and other splits dropped."""
    rows = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
        .withColumn("model", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    )
    wanted = F.col("split").isin("train", "test") if split == "all" else F.col("split") == split
    return rows.where((F.col("label_hallucination") != -1) & wanted)


def sync_split(scores: DataFrame, pool: DataFrame) -> DataFrame:
    """Each sample with its old and its due split; samples outside the pool become ``excluded``."""
    old = scores.withColumnRenamed("split", "old_split").withColumn("in_scores", F.lit(True))
    due = pool.select(*KEY, F.col("split").alias("pool_split"))
    joined = old.join(due, KEY, "full")
    return joined.withColumns(
        {
            "in_scores": F.coalesce("in_scores", F.lit(False)),
            "old_split": F.coalesce(strip(F.col("old_split")), F.lit("")),
            "split": F.coalesce("pool_split", F.lit(OUT_OF_POOL)),
        }
    )


def sync_report(synced: DataFrame, trained: list[str] = TRAINED) -> DataFrame:
    """Counts of fixed, flipped, excluded and missing samples, and of fitted scores gone stale."""
    here = F.col("in_scores")
    fixed = here & (F.col("old_split") != F.col("split"))
    flipped = fixed & F.col("old_split").isin("train", "test") & F.col("split").isin("train", "test")
    present = [c for c in trained if c in synced.columns]
    return synced.groupBy("run_id").agg(
        F.count_if(F.col("pool_split").isNotNull()).alias("n_pool"),
        F.count_if(here).alias("n_rows"),
        F.count_if(fixed).alias("n_fixed"),
        F.count_if(flipped).alias("n_flipped"),
        F.count_if(here & F.col("pool_split").isNull()).alias("n_out_of_pool"),
        F.count_if(~here).alias("n_missing"),
        *[F.count_if(flipped & ~_empty(F.col(c))).alias(f"stale_{c}") for c in present],
    )


def last_writer(shards: DataFrame, keys: list[str], shard: str = "shard") -> DataFrame:
    """Union of shard results: the row of the highest shard stands, with the number of lost rows."""
    rest = [c for c in shards.columns if c not in keys]
    return shards.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), shard).alias("kept"), (F.count(F.lit(1)) - 1).alias("n_lost")
    ).select(*keys, "kept.*", "n_lost")


def consolidated_report(results: DataFrame, runs: DataFrame, detectors: list[str], log: DataFrame | None = None) -> DataFrame:
    """Every run x registered detector; a detector without result keeps NULL metrics.

    ``log`` of isolated jobs (score_name, seconds, error) adds how long each took and what went wrong.
    """
    names = F.explode(F.array(*[F.lit(d) for d in detectors])).alias("score_name")
    grid = runs.select("run_id").distinct().select("run_id", names)
    report = grid.join(results, ["run_id", "score_name"], "left").withColumn("failed", F.col("roc_auc").isNull())
    return report if log is None else report.join(log.select("score_name", "seconds", "error"), "score_name", "left")


def score_difference(base: DataFrame, other: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``other`` minus ``base`` for each metric, where both have the key."""
    right = other.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    return base.join(right, keys).select(*keys, *[(F.col(f"_{m}") - F.col(m)).alias(f"{m}_diff") for m in metrics])


def complete_models(table: DataFrame, pairs: int = 9, models: int = 2) -> DataFrame:
    """Settings where a model has all train x test pairs, and at least two such models."""
    full = (
        table.groupBy("model", "steps", "tokens", "method")
        .agg(F.count_distinct("train", "test").alias("n_pairs")).where(F.col("n_pairs") == pairs)
    )
    settings = full.groupBy("steps", "tokens", "method").agg(F.count(F.lit(1)).alias("n_models")).where(F.col("n_models") >= models)
    return full.join(settings, ["steps", "tokens", "method"])


def cross_pivot(table: DataFrame, tests: list[str], order: list[str]) -> DataFrame:
    """Rows by train set, columns test x (roc, pr), models in the given order, unknown ones last."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model")), F.lit(0))
    wide = (
        table.groupBy("model", "steps", "tokens", "method", "train")
        .pivot("test", tests).agg(F.first("roc").alias("roc"), F.first("pr").alias("pr"))
    )
    return wide.withColumn("model_rank", F.when(rank > 0, rank - 1).otherwise(F.lit(len(order))).cast("int"))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def write_metrics(report: DataFrame, path: str) -> None:
    """One JSON record per run: detector -> metrics; NaN becomes null."""
    metrics = [c for c in report.columns if c not in ("run_id", "score_name")]
    clean = [
        null_if_nan(F.col(c)).alias(c) if dict(report.dtypes)[c] == "double" else F.col(c) for c in metrics
    ]
    record = F.map_from_entries(F.collect_list(F.struct("score_name", F.struct(*clean))))
    report.groupBy("run_id").agg(record.alias("results")).write.json(path)


def generation_metrics(requests: DataFrame) -> DataFrame:
    """Per-request record with its ratios; NULL where nothing valid was generated."""
    valid = F.when(F.col("new_valid_tokens") > 0, F.col("new_valid_tokens"))
    return requests.withColumns(
        {
            "denoising_forwards_per_valid_token": F.col("decoder_forward_passes") / valid,
            "seconds_per_sample": F.col("batch_generation_seconds") / F.greatest("batch_size", F.lit(1)),
            "new_token_slots": F.greatest(F.lit(0), F.col("sequence_tokens") - F.col("prompt_tokens")),
        }
    )
