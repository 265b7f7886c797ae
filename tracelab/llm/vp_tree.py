"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by a relaxed triangle inequality.

Nearness is the largest inner product. With one more component, sqrt(M^2 - |v|^2) for a vector and 0
for a query (M at least the largest norm), the squared Euclidean distance is |q|^2 + M^2 - 2 q.v, a
metric with the same order. A node keeps the range of distances from its vantage point to each half of its members; the triangle
inequality bounds the distance of a query to a half from below, and the half is left out when that
bound exceeds ``factor`` times the distance of the current k-th neighbour. Factor 1 is exact; smaller
factors leave out more. Scores are inner products of the original vectors in double precision, summed from the
first component to the last, so that equal vectors have equal scores.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm import vector_search
from tracelab.llm.vector_search import TopK


class VantagePointTree:
    kind = "double"

    def __init__(self, k: int, factor: float, limit: float, leaf: int = 128) -> None:
        self.k, self.factor, self.limit, self.leaf = k, factor, limit, leaf

    def build(self, ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Nodes in depth-first order: rows, vantage row, ranges of distances to both halves, right child (0: leaf)."""
        height = np.sqrt(np.maximum(self.limit**2 - (vectors**2).sum(axis=1), 0.0))
        points = np.column_stack([vectors, height])
        order, nodes = np.arange(len(ids)), []

        def grow(start: int, end: int) -> int:
            at = len(nodes)
            nodes.append([start, end, start, 0.0, 0.0, 0.0, 0.0, 0])
            if end - start <= self.leaf:
                return at
            own = order[start:end]
            middle = points[own].mean(axis=0)
            # A point at the edge splits the others into wider ranges than one in the middle.
            vantage = int(own[np.argmax(((points[own] - middle) ** 2).sum(axis=1))])
            apart = np.sqrt(((points[own] - points[vantage]) ** 2).sum(axis=1))
            if apart.max() == 0:
                return at
            by = np.argsort(apart, kind="stable")
            order[start:end], apart = own[by], apart[by]
            half = (end - start) // 2
            nodes[at][2:7] = [vantage, apart[0], apart[half - 1], apart[half], apart[-1]]
            grow(start, start + half)
            nodes[at][7] = grow(start + half, end)
            return at

        grow(0, len(ids))
        vantages = vectors[[n[2] if n[7] else 0 for n in nodes]]
        return {
            "ids": ids[order], "vectors": vectors[order], "rows": np.array([n[:2] for n in nodes], dtype=np.int64),
            "vantages": vantages, "ranges": np.array([n[3:7] for n in nodes]), "right": np.array([n[7] for n in nodes], dtype=np.int64),
        }

    def queries(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray) -> Any:
        return vectors, (vectors**2).sum(axis=1), TopK(ids, self.k, floors, float)

    def search(self, tree: dict[str, np.ndarray], state: Any) -> None:
        queries, squares, top = state

        def distance(rows: np.ndarray, score: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squares[rows] + self.limit**2 - 2 * score, 0.0))

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            # The last term is above any rounding, so that factor 1 stays exact.
            rows = rows[bound <= self.factor * distance(rows, top.floors[rows]) + 1e-7 * self.limit]
            if not len(rows):
                return
            if not tree["right"][node]:
                start, end = tree["rows"][node]
                self.leaf_scores(queries, rows, tree["ids"][start:end], tree["vectors"][start:end], top)
                return
            left, right = node + 1, int(tree["right"][node])
            away = distance(rows, queries[rows] @ tree["vantages"][node])
            in_low, in_high, out_low, out_high = tree["ranges"][node]
            to_left = np.maximum(np.maximum(away - in_high, in_low - away), 0)
            to_right = np.maximum(np.maximum(away - out_high, out_low - away), 0)
            first = to_left <= to_right
            visit(left, rows[first], to_left[first])
            visit(right, rows[~first], to_right[~first])
            visit(left, rows[~first], to_left[~first])
            visit(right, rows[first], to_right[first])

        rows = np.arange(len(queries))
        visit(0, rows, np.zeros(len(rows)))

    @staticmethod
    def leaf_scores(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: TopK) -> None:
        """Candidates by a fast product, with a margin; their scores by a sum from left to right."""
        own = queries[rows]
        fast = own @ vectors.T
        margin = 1e-12 * np.sqrt((own**2).sum(axis=1)[:, None] * (vectors**2).sum(axis=1)[None, :]) * own.shape[1]
        at, of = np.nonzero(fast + margin >= top.floors[rows, None])
        total = np.zeros(len(at))
        for component in range(own.shape[1]):
            total += own[at, component] * vectors[of, component]
        exact = np.full(fast.shape, -np.inf)
        exact[at, of] = total
        useful = np.unique(at)
        top.add(rows[useful], ids, exact[useful])

    def found(self, state: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return state[2].rows()


def nearest(
    vectors: DataFrame, k: int = 20, query_every: int = 20, factor: float = 0.17, id_column: str = "vec_id",
    vector_column: str = "embedding", shard_rows: int = 4096, query_block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products, exactly those for ``factor`` 1.

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but the query's own id; ties
    go to the smaller id; with fewer than k candidates all are returned. Null ids, null, empty or
    zero vectors and those with null or non-finite components take no part; shorter vectors count as
    filled up with zeros; rows that share an id are candidates of their own and, as queries, have one result for all of them; an
    empty table gives an empty result; further columns are ignored.
    """
    rows, count, width = vector_search.clean(vectors, id_column, vector_column, keep_zero=False)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    largest = rows.agg(F.max(square)).first()[0] if count else None
    kernel = VantagePointTree(k, factor, float(np.sqrt(largest or 0.0)))
    return vector_search.search(rows, count, width, lambda i: F.pmod(i, F.lit(query_every)) == 0, k, kernel, shard_rows, query_block)
