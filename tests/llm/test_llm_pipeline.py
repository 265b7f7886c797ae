"""Each pipeline stage on what its predecessor kept, against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_texts import plain_components

import corpus_pipeline
from tracelab.llm import importance, toxic_passages
from tracelab.llm.store import Scratch, tokenizer_file


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents and what each stage left, written and read again."""
    scratch = Scratch(spark, "test-pipeline")
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(scratch.save(stage(spark, tables[-1], sf_dir), name))
    return tables


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_are_those_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "packing"]
    assert all(table.columns == stages[0].columns for table in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxic_passages.score(stages[0], toxic_passages.train(stages[0], labels))
    assert ids(stages[1]) == ids(scores.where("score < 0.5"))
    gone = ids(stages[0]) - ids(stages[1])
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    clean = [i for i in ids(stages[0]) if known.get(i) == 0]
    assert sum(i in gone for i in clean) <= 0.05 * len(clean)


def test_rejected_quality_goes(spark, sf_dir, stages):
    kept = importance.resample(stages[1], spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    assert ids(stages[2]) == ids(kept)


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    first = {}
    for (i, _), root in zip(rows, plain_components(rows, 5, 80)):
        first[root] = min(i, first.get(root, i))
    assert ids(stages[3]) == Counter(first.values())


def test_mixing_keeps_all(stages):
    assert ids(stages[4]) == ids(stages[3])


def test_packed_ids_are_those_of_the_texts(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    rows = stages[5].orderBy("sequence_id", "offset").collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == want
    assert stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).where(F.col("n") < 1).isEmpty()
    ends = np.cumsum([r["length"] for r in rows])
    assert [2048 * r["sequence_id"] + r["offset"] for r in rows] == [0, *ends[:-1].tolist()]
    assert ends[-1] == sum(want.values())


def test_run_returns_the_last_stage(spark, sf_dir, stages):
    again = corpus_pipeline.run(spark, sf_dir)
    assert set(again.columns) == set(stages[5].columns)
    assert again.agg(F.sum("length")).first() == stages[5].agg(F.sum("length")).first()
