"""Every pipeline stage on awkward rows, each on what its predecessor left; and the order that mixing writes."""

from collections import Counter

import pytest
from edge_docs import CLASHING, edge_docs, no_docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from tracelab.llm import mixing
from tracelab.llm.store import Scratch

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels: some for ids of the documents, some for none, null ids and labels."""
    folder = str(tmp_path_factory.mktemp("edges"))
    rows = [(i, int(i % 4 > 0), int(i % 3 == 0)) for i in (1, 2, 3, 4, 8, 9, 10, 11, 14, 50, 51)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def tables(spark, folder):
    """What each stage left of the awkward documents, written and read again."""
    scratch = Scratch(spark, "edges")
    tables = {"": scratch.save(edge_docs(spark), "documents")}
    last = ""
    for name, stage in corpus_pipeline.STAGES:
        tables[name] = scratch.save(stage(spark, tables[last], folder), name)
        last = name
    return tables


def rows(table):
    return Counter((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())


def test_stages_pass_on_rows_as_they_are(tables):
    """Kept rows are rows of the predecessor with all their columns, as often as they were there or less."""
    names = ["", *STAGES]
    for before, after in zip(names[:-2], names[1:-1]):
        assert tables[after].columns == tables[before].columns
        assert not rows(tables[after]) - rows(tables[before])
        assert tables[after].where(" OR ".join(f"{c} <> 'clash'" for c in CLASHING)).isEmpty()


def test_near_copies_keep_what_has_no_words(tables):
    empty = lambda table: sum(n for (_, t), n in rows(table).items() if not (t or "").strip(" \t\n"))
    assert empty(tables["near_copies"]) == empty(tables["quality"])


def test_mixing_keeps_every_row(tables):
    assert rows(tables["mixing"]) == rows(tables["near_copies"])


def test_packing_covers_every_row(tables):
    documents = tables["mixing"].count()
    pieces = tables["packing"]
    assert pieces.where("start = 0").count() == documents
    spans = sorted((2048 * r["sequence_id"] + r["offset"], r["length"]) for r in pieces.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_an_empty_table(spark, folder, name):
    assert STAGES[name](spark, no_docs(spark), folder).count() == 0


def test_stages_on_repeated_rows_and_one_class(spark, folder, tmp_path):
    """Rows that are all the same, and labels of one class: nothing to tell apart."""
    docs = spark.createDataFrame([(7, prose(3, 60), "a")] * 40, "doc_id bigint, text string, source string")
    spark.createDataFrame([(7, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = STAGES["toxicity"](spark, docs, str(tmp_path))
    assert kept.count() in (0, 40)
    assert STAGES["quality"](spark, docs, str(tmp_path)).count() in (0, 40)
    assert STAGES["near_copies"](spark, docs, str(tmp_path)).count() == 1
    assert STAGES["mixing"](spark, docs, str(tmp_path)).count() == 40
    assert STAGES["packing"](spark, docs, str(tmp_path)).where("start = 0").count() == 40


def test_mixing_writes_the_interleaved_order(spark, sf_dir, tmp_path):
    """Files read in their order give the positions of the schedule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    STAGES["mixing"](spark, docs, sf_dir).write.parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    written = [r["doc_id"] for r in read.orderBy("f", "i").collect()]
    assert written == [r["doc_id"] for r in mixing.mix(docs).orderBy("_position").collect()]
