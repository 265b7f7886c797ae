"""Run names and the run registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats of run names.
CROSS_NAME = (
    r"^([a-z]+)_(\d+)steps_(\d+)tokens_([a-z]+)_(\d+)samples_eval_([a-z]+)_seed(\d+)$"
)
CROSS_FIELDS = ["model", "steps", "tokens", "train", "n", "test", "seed"]
RUN_NAME = r"^([a-z]+)_(\d+)steps_(\d+)tokens_([a-z]+)_(\d+)samples_seed(\d+)$"
RUN_FIELDS = ["model", "steps", "tokens", "dataset", "n", "seed"]
NUMBERS = {"steps", "tokens", "n", "seed"}


def parse_names(runs: DataFrame, pattern: str, fields: list[str], name: str = "run_id") -> DataFrame:
    """Columns read from the run name; a name that does not fit raises."""
    fits = F.col(name).rlike(pattern)
    bad = F.raise_error(F.concat(F.lit("run name not recognised: "), F.col(name))).cast("string")
    checked = F.when(fits, F.col(name)).otherwise(bad)
    parts = {
        f: F.regexp_extract(checked, pattern, i + 1).cast("int" if f in NUMBERS else "string")
        for i, f in enumerate(fields)
    }
    return runs.withColumns(parts)


def run_name(model: Column, steps: Column, tokens: Column, dataset: Column, n: Column, seed: Column) -> Column:
    return F.format_string("%s_%dsteps_%dtokens_%s_%dsamples_seed%d", model, steps, tokens, dataset, n, seed)


def model_folder(name: Column) -> Column:
    lowered = F.lower(name)
    return F.when(lowered.contains("gemma"), "gemma").when(lowered.contains("dream"), "dream").otherwise("llada")


def run_pairs(runs: DataFrame) -> DataFrame:
    """Train x test pairs of runs with the same model, steps and tokens, the diagonal included."""
    same = ["model", "steps", "tokens"]
    train = runs.select(*same, F.col("dataset").alias("train"), F.col("run_id").alias("train_run"))
    test = runs.select(*same, F.col("dataset").alias("test"), F.col("run_id").alias("test_run"))
    return train.join(test, same)
