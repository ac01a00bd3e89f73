"""Exact top-k inner products of a query set against all vectors, by dual-tree search.

The rows are cut into blocks of bounded size by a hash of their id, the queries into groups of
bounded size; one task takes a block and a query group, builds a cover tree on each and walks
both trees together. A pair of nodes is left out when

    <q, p> + |q| * radius(p) + |p| * radius(q) + radius(q) * radius(p)

for their centres q and p is below the worst k-th score that the queries under q hold so far. A leaf of
the query tree is a few queries, each of which then keeps its own bound, <q, p> + |q| * radius(p),
against its own k-th score, nodes with the highest bounds first.
The k best of every (query, block) are then merged per query, in two levels, so that what one
task merges does not grow with the number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points and queries under which a node of their cover tree is not divided any more, and nodes that a leaf of queries takes at a time.
LEAF, QUERY_LEAF, TAKEN = 8, 4, 32


class CoverTree:
    """A cover tree over the rows of ``points`` (float64): nodes with a centre, a covering radius and children.

    A node of level s holds points within 2**s of its centre; the centres of its children, of
    level s - 1, lie over 2**(s - 1) apart. Nodes are kept in arrays; ``rows`` lists each
    node's points as a slice of ``order``.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.centres: list[int] = []
        self.radii: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            self._build()

    def _node(self, centre: int, rows: np.ndarray, gaps: np.ndarray) -> int:
        self.centres.append(centre)
        self.radii.append(float(gaps.max()))
        self.children.append([])
        self.rows.append(rows)
        return len(self.centres) - 1

    def _gaps(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _build(self) -> None:
        rows = np.arange(len(self.points))
        gaps = self._gaps(0, rows)
        open_nodes = [(self._node(0, rows, gaps), gaps)]
        while open_nodes:
            node, gaps = open_nodes.pop()
            rows, radius = self.rows[node], self.radii[node]
            if len(rows) <= self.leaf or radius == 0:    # equal points stay together, however many
                continue
            reach = 2.0 ** (math.ceil(math.log2(radius)) - 1)
            centre = self.centres[node]
            while len(rows):
                near = gaps <= reach
                child = self._node(centre, rows[near], gaps[near])
                self.children[node].append(child)
                open_nodes.append((child, gaps[near]))
                rows, gaps = rows[~near], gaps[~near]
                if len(rows):
                    centre = int(rows[np.argmax(gaps)])
                    gaps = self._gaps(centre, rows)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int,
                compared: list[int] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, scores) of each query's k best points other than itself; integer rows, exact int64 scores.

    Ties go to the smaller id. ``compared`` gets the numbers of pairs whose scores were taken.
    """
    if not len(queries) or not len(points):
        return []
    best_scores = [np.empty(0, dtype=np.int64)] * len(queries)
    best_ids = [np.empty(0, dtype=ids.dtype)] * len(queries)
    worst = np.full(len(queries), -np.inf)          # k-th best score so far
    q_tree, p_tree = CoverTree(queries.astype(np.float64), QUERY_LEAF), CoverTree(points.astype(np.float64))
    q_norm, p_norm = (np.sqrt((t.points ** 2).sum(axis=1)) for t in (q_tree, p_tree))
    p_centres, p_radii = np.array(p_tree.centres), np.array(p_tree.radii)
    # Sums below 2**53 are exact in floats, whose products are far faster.
    exact = len(queries[0]) * float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) < 2.0 ** 53
    left, right = (q_tree.points, p_tree.points) if exact else (queries, points)

    def reached(a: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may hold a point for a query under ``a``, with their bounds."""
        qc, qr = q_tree.centres[a], q_tree.radii[a]
        centres, radii = p_centres[nodes], p_radii[nodes]
        limits = p_tree.points[centres] @ q_tree.points[qc] + q_norm[qc] * radii + p_norm[centres] * qr + qr * radii
        limits += 1e-9 * (1 + (q_norm[qc] + qr) * (p_norm[centres] + radii))    # rounding of the floats
        near = limits >= worst[q_tree.rows[a]].min()                            # an equal bound may still hold a tie
        return nodes[near], limits[near]

    def own(a: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may hold a point for a query of the leaf ``a`` by the query's own bound, and the greatest bounds."""
        asked = q_tree.rows[a]
        centres, radii = p_centres[nodes], p_radii[nodes]
        limits = q_tree.points[asked] @ p_tree.points[centres].T + q_norm[asked, None] * radii
        limits += 1e-9 * (1 + q_norm[asked, None] * (p_norm[centres] + radii))
        near = (limits >= worst[asked, None]).any(axis=0)
        return nodes[near], limits.max(axis=0, initial=-np.inf)[near]

    def compare(a: int, rows: np.ndarray) -> None:
        if compared is not None:
            compared.append(len(rows) * len(q_tree.rows[a]))
        for at in range(0, len(rows), 4096):
            some = rows[at:at + 4096]
            near, scores = ids[some], left[q_tree.rows[a]] @ right[some].T
            for q, line in zip(q_tree.rows[a], scores):
                good = (line >= worst[q]) & (near != query_ids[q])
                if good.any():
                    s, i = np.concatenate([best_scores[q], line[good].astype(np.int64)]), np.concatenate([best_ids[q], near[good]])
                    if len(s) > 4 * k:                  # only what can be among the k best, ties included
                        high = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, i = s[high], i[high]
                    top = np.lexsort((i, -s))[:k]
                    best_scores[q], best_ids[q] = s[top], i[top]
                    if len(top) == k:
                        worst[q] = s[top[-1]]

    def children(nodes: np.ndarray) -> np.ndarray:
        return np.array([c for node in nodes for c in p_tree.children[node]], dtype=np.int64)

    def joined(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])

    inner = np.array([bool(c) for c in p_tree.children])
    stack = [(0, np.zeros(1, dtype=np.int64))]
    while stack:
        a, nodes = stack.pop()
        nodes, limits = reached(a, nodes)
        while (large := inner[nodes] & (p_radii[nodes] >= q_tree.radii[a])).any():      # divide the larger side first
            nodes, limits = joined((nodes[~large], limits[~large]), reached(a, children(nodes[large])))
        if q_tree.children[a]:
            stack += [(child, nodes) for child in q_tree.children[a]]
            continue
        nodes, limits = own(a, nodes)
        while len(nodes):                           # a leaf of queries: the highest bounds first
            order = np.argsort(-limits)
            some, nodes, limits = nodes[order[:TAKEN]], nodes[order[TAKEN:]], limits[order[TAKEN:]]
            some, _ = own(a, some)                  # scores have risen since
            if not len(some):
                if len(limits) and limits[0] < worst[q_tree.rows[a]].min():
                    break
                continue
            if len(rows := [p_tree.rows[node] for node in some[~inner[some]]]):
                compare(a, np.concatenate(rows))
            if len(below := children(some[inner[some]])):
                nodes, limits = joined((nodes, limits), own(a, below))
    return [(q, best_ids[q], best_scores[q]) for q in range(len(queries)) if len(best_ids[q])]


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as array<long>; null if the vector or a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull() | odd, F.lit(None)).otherwise(whole)


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
                 block_rows: int = 2_000, group_rows: int = 2_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors`` other than itself.

    The score is the integer inner product of the floors of ``scale`` times the components; it
    must fit a long. Equal scores go to the smaller id; a query with fewer partners gets them
    all. A vector that is null or holds null or non-finite components takes no part, nor does a
    row without an id; vectors of different lengths are compared as if zeros followed the
    shorter one. Repeated rows of one id count once, and of different vectors with one id the
    id gets its best score. Other columns are not looked at; empty tables give an empty result.

    Scale: block and group sizes bound a task's memory; every vector is sent once to each
    query group, as comparing a query set against all rows takes. Blocks are dealt by a hash
    of the id, so a vector that many rows hold is spread evenly.
    """
    def clean(df: DataFrame) -> DataFrame:
        whole = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
        return whole.where("id IS NOT NULL AND v IS NOT NULL").distinct()

    points, asked = clean(vectors), clean(queries)
    n_blocks = max(1, math.ceil(vectors.count() / block_rows))
    n_groups = max(1, math.ceil(queries.count() / group_rows))
    block, group = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).cast("int") for seed, n in ((7, n_blocks), (11, n_groups)))
    point_cells = points.select("id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"))
    query_cells = asked.select("id", "v", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, [*left["v"], *right["v"]]), default=0)

        def matrix(rows: pd.Series) -> np.ndarray:
            out = np.zeros((len(rows), width), dtype=np.int64)
            for i, v in enumerate(rows):
                out[i, :len(v)] = v
            return out

        q_ids, p_ids = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        found = dual_search(matrix(left["v"]), q_ids, matrix(right["v"]), p_ids, k)
        return pd.DataFrame({"query_id": np.repeat(q_ids[[q for q, _, _ in found]], [len(i) for _, i, _ in found]) if found else np.empty(0, np.int64),
                             "vec_id": np.concatenate([i for _, i, _ in found]) if found else np.empty(0, np.int64),
                             "score": np.concatenate([s for _, _, s in found]) if found else np.empty(0, np.int64),
                             "block": int(right["block"].iloc[0]) if len(right) else 0})

    cells = (query_cells.groupBy("group", "block").cogroup(point_cells.groupBy("group", "block"))
             .applyInPandas(search, "query_id long, vec_id long, score long, block int"))
    cells = cells.groupBy("query_id", "vec_id", "block").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    some = Window.partitionBy("query_id", F.col("block") % 64).orderBy(*order)
    every = Window.partitionBy("query_id").orderBy(*order)
    return (cells.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
