"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

For a ball with centre c and radius r, no member has a larger inner product with q than
q.c + |q| r. Children are visited in the order of this bound, and a ball is left out when its bound is below the
current k-th score, which is shared between the leaves of a shard, the shards of a task and, from wave
to wave, all tasks. Components are integers, so that scores and ties are exact.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm import vector_search
from tracelab.llm.vector_search import TopK

EXACT = 2.0**53


def split_halves(vectors: np.ndarray) -> np.ndarray | None:
    """Mask of the half nearer to one of two far members; None if all members are equal."""
    centre = vectors.mean(axis=0)
    one = vectors[np.argmax(((vectors - centre) ** 2).sum(axis=1))]
    apart = ((vectors - one) ** 2).sum(axis=1)
    if apart.max() == 0:
        return None
    along = vectors @ (vectors[np.argmax(apart)] - one)
    order = np.argsort(along, kind="stable")
    half = np.zeros(len(vectors), dtype=bool)
    half[order[: len(order) // 2]] = True
    return half


class BallTree:
    kind = "bigint"

    def __init__(self, k: int, scale: int, leaf: int = 128) -> None:
        self.k, self.scale, self.leaf = k, scale, leaf

    def integers(self, vectors: np.ndarray) -> np.ndarray:
        return np.floor(self.scale * vectors)

    def build(self, ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Nodes in depth-first order: rows [start, end), centre, radius, and the right child (0: leaf)."""
        vectors = self.integers(vectors)
        order, nodes = np.arange(len(ids)), []

        def grow(start: int, end: int) -> int:
            own = vectors[order[start:end]]
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            at = len(nodes)
            nodes.append([start, end, centre, radius, 0])
            half = split_halves(own) if end - start > self.leaf else None
            if half is not None:
                order[start:end] = np.concatenate([order[start:end][half], order[start:end][~half]])
                middle = start + int(half.sum())
                grow(start, middle)
                nodes[at][4] = grow(middle, end)
            return at

        grow(0, len(ids))
        return {
            "ids": ids[order], "vectors": vectors[order], "rows": np.array([n[:2] for n in nodes], dtype=np.int64),
            "centres": np.array([n[2] for n in nodes]), "radii": np.array([n[3] for n in nodes]),
            "right": np.array([n[4] for n in nodes], dtype=np.int64),
        }

    def queries(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray) -> Any:
        vectors = self.integers(vectors)
        return vectors, np.sqrt((vectors**2).sum(axis=1)), TopK(ids, self.k, floors, int)

    def scores(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Exact integer products; beyond 2^53 with Python integers, saturating at the ends of a long."""
        bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
        if bound < EXACT:
            return (queries @ vectors.T).astype(np.int64)
        whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in vectors]
        limit = np.iinfo(np.int64)
        exact = [[min(max(sum(a * b for a, b in zip(q, v)), limit.min + 1), limit.max) for v in whole[1]] for q in whole[0]]
        return np.array(exact, dtype=np.int64).reshape(len(queries), len(vectors))

    def search(self, tree: dict[str, np.ndarray], state: Any) -> None:
        queries, norms, top = state

        def bounds(node: int, rows: np.ndarray) -> np.ndarray:
            reach = norms[rows] * tree["radii"][node]
            product = queries[rows] @ tree["centres"][node]
            return product + reach + 1e-9 * (np.abs(product) + reach) + 1e-6  # above any rounding

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            rows = rows[bound >= top.floors[rows]]
            if not len(rows):
                return
            if not tree["right"][node]:
                start, end = tree["rows"][node]
                top.add(rows, tree["ids"][start:end], self.scores(queries[rows], tree["vectors"][start:end]))
                return
            left, right = node + 1, int(tree["right"][node])
            to_left, to_right = bounds(left, rows), bounds(right, rows)
            first = to_left >= to_right
            visit(left, rows[first], to_left[first])
            visit(right, rows[~first], to_right[~first])
            visit(left, rows[~first], to_left[~first])
            visit(right, rows[first], to_right[first])

        rows = np.arange(len(queries))
        visit(0, rows, bounds(0, rows))

    def found(self, state: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return state[2].rows()


def exact_top_k(
    vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_column: str = "vec_id",
    vector_column: str = "embedding", shard_rows: int = 4096, query_block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of floor(scale * x).

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but the
    query's own id; ties go to the smaller id; with fewer than k candidates all are returned. Null
    ids, null or empty vectors and those with null or non-finite components take no part; shorter vectors
    count as filled up with zeros; rows that share an id are candidates of their own and, as queries, have one result for all of
    them; an empty table gives an empty result; further columns are ignored.
    """
    rows, count, width = vector_search.clean(vectors, id_column, vector_column, keep_zero=True)
    return vector_search.search(rows, count, width, lambda i: F.pmod(i, F.lit(query_every)) == 0, k, BallTree(k, scale), shard_rows, query_block)
