"""The shuffle into shards: exact sizes, whole rows, and the law of the communication matrix."""

import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from edge_docs import ROWS, edge_docs, no_docs
from pyspark.sql import functions as F

from tracelab.llm import queries, sharding


def check_places(rows, shards, total):
    by = {}
    for shard, slot in rows:
        by.setdefault(shard, []).append(slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    sizes = [len(by.get(s, ())) for s in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1


def test_query_over_documents(spark, sf_dir):
    rows = queries.QUERIES["op13_shard_shuffle"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    check_places([(r.shard, r.slot) for r in rows], 40, len(docs))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_awkward_rows_and_names(spark, block_rows):
    docs = edge_docs(spark).withColumn("_slot", F.lit("clash")).withColumn("a`b.c", F.lit(1))
    dealt = sharding.shuffled(docs.repartition(4), shards=5, seed=3, block_rows=block_rows)
    assert dealt.columns == [c for c in docs.columns if c != "_slot"] + ["_shard", "_slot"]
    rows = dealt.collect()
    check_places([(r["_shard"], r["_slot"]) for r in rows], 5, len(ROWS))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, _ in ROWS)
    assert sharding.shuffled(no_docs(spark), shards=5).count() == 0


def test_same_seed_same_places(spark, sf_dir):
    docs = sharding.sized(spark.read.parquet(f"{sf_dir}/documents.parquet")).repartition(3, "doc_id")
    one, two, other = (sorted(map(tuple, sharding.shuffled(docs, 7, seed, block_rows=16).collect())) for seed in (1, 1, 2))
    assert one == two != other


def test_written_shards_are_in_slot_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    sharding.write_shards(sharding.shuffled(docs, 4, block_rows=20), str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == docs.count()
    for shard in range(4):
        files = read.where(F.col("_shard") == shard).select("_slot", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
        by_file = [r[0] for r in files.orderBy("f", "i").collect()]
        assert by_file == sorted(by_file)


def test_matrix_margins_and_law():
    starts, blocks = np.array([0, 2, 3, 6]), np.array([1, 3, 2])
    seen = Counter()
    trials = 20_000
    for seed in range(trials):
        rows = [sharding.Plan(starts, blocks, seed).row(p) for p in range(3)]
        assert [r.sum() for r in rows] == [2, 1, 3] and (sum(rows) == blocks).all()
        seen[tuple(map(tuple, rows))] += 1
    exact = Counter()  # every order of six rows over six slots is as likely as any other
    owner, target = [0, 0, 1, 2, 2, 2], [0, 1, 1, 1, 2, 2]
    for order in permutations(range(6)):
        matrix = np.zeros((3, 3), dtype=int)
        for row, slot in enumerate(order):
            matrix[owner[row], target[slot]] += 1
        exact[tuple(map(tuple, matrix.tolist()))] += 1 / 720
    assert set(seen) == set(exact)
    assert sum((seen[m] - trials * p) ** 2 / (trials * p) for m, p in exact.items()) < 3 * len(exact)


def test_large_urns(monkeypatch):
    rng = np.random.default_rng(5)
    want = rng.hypergeometric(300, 500, 90, 20_000)
    monkeypatch.setattr(sharding, "NUMPY_URN", 10)
    got = np.array([sharding.hypergeometric(rng, 300, 500, 90) for _ in range(20_000)])
    assert abs(got.mean() - want.mean()) < 0.15 and abs(got.std() / want.std() - 1) < 0.03
    big = sharding.multivariate(rng, np.full(40, 10**9), 7 * 10**9)
    assert big.sum() == 7 * 10**9 and abs(big / (7 * 10**9 / 40) - 1).max() < 1e-3
