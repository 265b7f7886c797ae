"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.llm import ball_tree, vp_tree

SCHEMA = "vec_id bigint, embedding array<float>, label string, score string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(250)]  # one very common vector: ties
    return rows


BAD = [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 16), (2003, [float("inf")] + [0.0] * 15), (2004, []), (None, [1.0] * 16)]


def brute(rows, every, k, transform, zero=True):
    """All rows against all rows; the rows of one query id share a result."""
    known = [
        (i, tuple(v)) for i, v in rows
        if not (i is None or not v or any(x is None or not np.isfinite(x) for x in v) or (not zero and not any(v)))
    ]
    width = max((len(v) for _, v in known), default=0)
    ids = np.array([i for i, _ in known])
    data = transform(np.array([list(v) + [0.0] * (width - len(v)) for _, v in known], dtype=np.float64).reshape(len(ids), width))
    found = {}
    for at, i in enumerate(ids.tolist()):
        if i % every == 0:
            total = np.zeros(len(ids))
            for c in range(width):  # left to right, as a fold
                total += data[at, c] * data[:, c]
            found.setdefault(i, []).extend((-total[j], int(ids[j])) for j in np.flatnonzero(ids != i))
    return sorted((i, r + 1, v, -s) for i, best in found.items() for r, (s, v) in enumerate(sorted(best)[:k]))


REPEATED = [(7, [9.0, 9.0]), (3000, [0.5, -0.25]), (3000, [0.5, -0.25]), (50, [0.25, 4.0]), (50, [0.25, 4.0])] + [(3001, [8.0] * 16)] * 30


def test_repeated_ids_as_in_sql(spark):
    import duckdb

    from tracelab.llm.queries import TOP_K_SQL

    rows = [(50, [1.0, 0.0]), (1, [0.25, 0.0]), (1, [0.75, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (100, [0.5, 1.0]), (100, [0.25, 0.125])]
    got = ball_tree.exact_top_k(frame(spark, rows), k=5)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(TOP_K_SQL).fetchall())
    near = vp_tree.nearest(frame(spark, rows), k=3, query_every=50, factor=1.0)
    assert sorted(map(tuple, near.collect())) == brute(rows, 50, 3, lambda x: x, zero=False)


def test_ball_tree_is_exact(spark, vectors):
    rows = vectors + BAD + REPEATED
    got = ball_tree.exact_top_k(frame(spark, rows), k=5, query_every=25, shard_rows=60, query_block=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 25, 5, lambda x: np.floor(256 * x))


def test_ball_tree_beyond_doubles(spark):
    rows = [(50, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [-4e7, 1.0])]
    got = ball_tree.exact_top_k(frame(spark, rows), k=2, scale=2**10)
    whole = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] for i, v in rows}
    want = sorted(((sum(a * b for a, b in zip(whole[50], whole[i])), i) for i in (1, 2, 3)), key=lambda x: (-x[0], x[1]))[:2]
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(50, n + 1, i, s) for n, (s, i) in enumerate(want)]


def test_vantage_points_exact_with_factor_one(spark, vectors):
    rows = vectors + BAD + REPEATED + [(4000, [0.0] * 16), (4001, [2.0])]
    got = vp_tree.nearest(frame(spark, rows), k=20, query_every=25, factor=1.0, shard_rows=60, query_block=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 25, 20, lambda x: x, zero=False)


def test_vantage_points_recall(spark, sf_dir):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = {(q, v) for q, _, v, _ in brute(rows, 20, 20, lambda x: x, zero=False)}
    got = vp_tree.nearest(table, shard_rows=1000).collect()
    assert len(got) == len(want)
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def test_few_and_no_vectors(spark):
    two = frame(spark, [(0, [1.0, 2.0]), (20, [2.0, 1.0])])
    assert vp_tree.nearest(two).count() == 2 and ball_tree.exact_top_k(two, query_every=20).count() == 2
    for rows in ([], BAD, [(1, [1.0])]):
        assert vp_tree.nearest(frame(spark, rows)).count() == 0 and ball_tree.exact_top_k(frame(spark, rows)).count() == 0
    assert vp_tree.nearest(frame(spark, [])).columns == ["query_id", "rank", "vec_id", "score"]


def test_extra_columns_are_ignored(spark):
    rows = frame(spark, [(0, [1.0, 2.0]), (20, [2.0, 1.0])]).withColumns({c: F.lit("x") for c in ("shard", "tree", "vec", "kth", "rank", "query_id")})
    assert vp_tree.nearest(rows).count() == 2
