"""From raw documents to packed token sequences, in five stages.

Each stage takes the documents that its predecessor kept, as a table that was written and is read again, and returns
documents with the same columns; the last returns the pieces of the packed sequences. Null and repeated ids and
repeated rows are documents like any other, null texts are empty, texts are never cut, and an empty table stays empty. Columns other
than doc_id, text and source are passed on as they are, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import importance, mixing, packing, shingle_join, toxic_passages
from tracelab.llm.store import Scratch, tokenizer_file

#: Units that a Python worker remembers while packing (about 30 MB): executors come from the other stages with full heaps.
WORD_CACHE = 300_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_own_names(stage: Stage) -> Stage:
    """A stage that keeps the other columns of the documents apart from the names that operators use."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in ("doc_id", "text", "source") else f"column{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run


@with_own_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half, by a model of the labelled ones among them. Empty texts have a score too."""
    model = toxic_passages.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_passages.with_score(docs, model).where(F.col("_toxicity") < 0.5).select(*docs.columns)


@with_own_names
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards the labelled good ones; equal rows are drawn alike."""
    fitted = importance.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return importance.with_keys(docs, fitted).where("_kept").select(*docs.columns)


@with_own_names
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles.

    Documents without words, and those with a null id, are copies of nothing and stay.
    """
    return shingle_join.one_per_component(docs, words=5, percent=80)


@with_own_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which Pfair scheduling interleaves their sources; the null source is one of them."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("_position").sortWithinPartitions("_position").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, in the order of the files that ``docs`` was read from.

    Documents that do not come straight from files are taken in the order of their ids.
    """
    try:
        ordered = docs.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
        order = ["_file", "_row"]
    except AnalysisException:
        ordered, order = docs, ["doc_id"]
    return packing.pack(ordered, tokenizer_file("byte_bpe_50k.json"), end_id=1, length=2048, order=order, cache=WORD_CACHE)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained models nor the tokenizer; a test holds each stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last leaves a table that the next one reads."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
