"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

Inner products become distances by one more component: a vector gets what its norm lacks to the
largest norm, a query gets 0. The tree is fitted on a sample bounded by ``sample`` (lowest hashes of the
id); every row is then put into a leaf by descent. A query visits leaves best bin first: a priority queue
holds the branches not taken, ordered by the distance of their centre, and the nearest one is opened next.

How many leaves are visited is calibrated: for ``probes`` queries the exact neighbours are found by
scanning all rows, and the number of visits is widened until at least ``recall`` of them lie in visited leaves.
With every leaf visited the search is exact.

Pairs (query, leaf) meet the rows of the leaf in tiles: a leaf's rows and its queries are each dealt
into blocks of bounded size, so a leaf that holds a third of all rows is many tasks, and each tile returns
at most ``k`` rows for a query. Scores are added up component by component in double precision, so equal
vectors tie exactly, and ties go to the smaller id.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
with a null id, nor vectors of another length than the most frequent one (ties: the shortest). A row is no
neighbour of a query with its id; repeated rows are candidates each, and a repeated query id is answered once,
for its smallest vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import materialize

SAMPLE, PROBES, BRANCHES, LEAF_SAMPLE, ROUNDS = 8_192, 256, 8, 256, 8
#: Rows and queries of a leaf that meet in one tile at most, on average.
TILE_ROWS, TILE_QUERIES = 4_096, 1_024
RECALL = 0.97


def _kmeans(points: np.ndarray, k: int, seed: np.random.Generator) -> np.ndarray:
    """Cluster of each point; equal points fall into one cluster."""
    centres = points[seed.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        used = np.unique(near)
        centres = np.array([points[near == c].mean(axis=0) for c in used])
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


class Tree:
    """Hierarchical k-means over augmented vectors; a node is (centres of its children, children, leaf number or -1)."""

    def __init__(self, largest: float, nodes: list[tuple]):
        self.largest, self.nodes = largest, nodes
        self.leaves = sum(leaf >= 0 for _, _, leaf in nodes)

    @classmethod
    def fit(cls, sample: np.ndarray, largest: float, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE) -> Tree:
        tree, nodes, leaves = cls(largest, []), [(None, [], -1)], 0
        seed = np.random.default_rng(0)
        pending = [(0, tree.augment(sample))]
        while pending:
            at, points = pending.pop()
            groups = _kmeans(points, branches, seed) if len(points) > max(leaf_sample, branches) else np.zeros(len(points), dtype=int)
            found = np.unique(groups)
            if len(found) < 2:
                nodes[at] = (None, [], leaves)
                leaves += 1
                continue
            parts = [points[groups == g] for g in found]
            children = list(range(len(nodes), len(nodes) + len(parts)))
            nodes[at] = (np.array([p.mean(axis=0) for p in parts]), children, -1)
            nodes.extend((None, [], -1) for _ in parts)
            pending.extend(zip(children, parts, strict=True))
        return cls(largest, nodes)

    def augment(self, vectors: np.ndarray) -> np.ndarray:
        lacking = np.maximum(self.largest**2 - (vectors**2).sum(axis=1), 0)
        return np.column_stack([vectors, np.sqrt(lacking)])

    def descend(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        out = np.empty(len(vectors), dtype=np.int32)
        pending = [(0, np.arange(len(vectors)))]
        points = self.augment(vectors)
        while pending:
            at, rows = pending.pop()
            centres, children, leaf = self.nodes[at]
            if leaf >= 0:
                out[rows] = leaf
                continue
            near = np.argmin((centres**2).sum(1) - 2 * points[rows] @ centres.T, axis=1)
            pending.extend((child, rows[near == c]) for c, child in enumerate(children) if (near == c).any())
        return out

    def visit(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first."""
        point, out, queue = np.append(query, 0.0), [], [(0.0, 0)]
        while queue and len(out) < visits:
            centres, children, leaf = self.nodes[heapq.heappop(queue)[1]]
            if leaf >= 0:
                out.append(leaf)
                continue
            away = ((centres - point) ** 2).sum(axis=1)
            for distance, child in zip(away.tolist(), children, strict=True):
                heapq.heappush(queue, (distance, child))
        return out


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best ``k`` rows of a block for each query: positions of queries and rows, and scores."""
    rough = queries @ rows.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(queries).sum(axis=1) * np.abs(rows).max(initial=0))
    if rows.shape[0] > k:
        least = np.partition(rough, -k, axis=1)[:, -k] - slack
    else:
        least = np.full(len(queries), -np.inf)
    q, r = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
    scores = np.zeros(len(q))
    for component in range(queries.shape[1]):  # in order, whatever the block
        scores += queries[q, component] * rows[r, component]
    order = np.lexsort((ids[r], -scores, q))
    q, r, scores = q[order], r[order], scores[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], r[rank < k], scores[rank < k]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def valid_vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows (``id`` long, ``vector`` array of double) that take part, of whatever length."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def _top(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "query_id long, vec_id long, score double, leaf int"


def search(
    df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL, sample: int = SAMPLE, probes: int = PROBES
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows found for each row where ``is_query`` (on column ``id``)."""
    spark = df.sparkSession
    rows = valid_vectors(df, id, vector)
    length = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = length.dim
    rows = rows.where(F.size("vector") == dim)
    largest = rows.agg(F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    chosen = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).select("vector").collect()
    tree = Tree.fit(np.array([r.vector for r in chosen]), largest)
    shared = spark.sparkContext.broadcast((tree.largest, tree.nodes))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = Tree(*shared.value).descend(_vectors(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], names=["id", "vector", "leaf"])

    indexed = materialize(rows.mapInArrow(put, "id long, vector array<double>, leaf int"), "ann-index")
    asked = F.expr("id") if is_query is None else is_query
    queries = indexed.withColumnRenamed("id", id).where(asked).withColumnRenamed(id, "id")
    queries = materialize(queries.groupBy("id").agg(F.min("vector").alias("vector")), "ann-queries")

    visits = _calibrate(indexed, queries, tree, dim, k, recall, probes)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tree = Tree(*shared.value)
                leaves = [tree.visit(q, visits) for q in _vectors(batch.column(1), dim)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves, pa.list_(pa.int32()))], names=["id", "vector", "leaves"])

    planned = queries.mapInArrow(plan, "id long, vector array<double>, leaves array<int>").select("id", "vector", F.explode("leaves").alias("leaf"))
    # blocks per leaf, for rows and for queries; both tables have a row per leaf at most
    row_blocks = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("row_blocks"))
    query_blocks = planned.groupBy("leaf").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("query_blocks"))
    sizes = {r.leaf: (r.row_blocks, r.query_blocks) for r in row_blocks.join(query_blocks, "leaf").collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_leaf = F.create_map(*[F.lit(x) for leaf, (a, b) in sorted(sizes.items()) for x in (leaf, a * 65536 + b)]) if max(b for _, b in sizes.values()) < 65536 else None
    if by_leaf is None:
        raise ValueError("more queries for a leaf than tiles can be numbered for: ask in several calls")
    blocks = F.element_at(by_leaf, F.col("leaf"))
    row_count, query_count = F.shiftright(blocks, 16), blocks.bitwiseAND(65535)

    def dealt(rows: DataFrame, own: Column, others: Column, kind: int) -> DataFrame:
        """Each row with its own block, once for every block of the other side."""
        mine = F.pmod(F.xxhash64("id", F.lit(kind)), own).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), others - 1))
        dealt = rows.where(blocks.isNotNull()).select("leaf", "id", "vector", mine.alias("mine"), theirs.alias("theirs"))
        tile = ("mine", "theirs") if kind == 0 else ("theirs", "mine")
        return dealt.select("leaf", F.col(tile[0]).alias("row_block"), F.col(tile[1]).alias("query_block"), "id", "vector")

    def tile(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, query_ids = left["id"].to_numpy(), right["id"].to_numpy()
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            rows, asked = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
            for at in range(0, len(asked), 256):
                for row in range(0, len(rows), TILE_ROWS):
                    q, r, scores = nearest(query_ids[at : at + 256], asked[at : at + 256], ids[row : row + TILE_ROWS], rows[row : row + TILE_ROWS], k)
                    found["query_id"].append(query_ids[at + q])
                    found["vec_id"].append(ids[row + r])
                    found["score"].append(scores)
        columns = {c: np.concatenate(v) if v else np.array([]) for c, v in found.items()}
        return pd.DataFrame(columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    place = ["leaf", "row_block", "query_block"]
    left = dealt(indexed, row_count, query_count, 0).groupBy(*place)
    right = dealt(planned, query_count, row_count, 1).groupBy(*place)
    near = left.cogroup(right).applyInPandas(tile, "query_id long, vec_id long, score double")
    return _top(near, k).select("query_id", "rank", "vec_id", "score")


def _calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float, probes: int) -> int:
    """Leaf visits at which ``recall`` of the exact neighbours of the probes lie in visited leaves."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(probes).collect()
    if not asked:
        return 1
    probe_ids, probe_vectors = np.array([r.id for r in asked]), np.array([r.vector for r in asked])
    shared = indexed.sparkSession.sparkContext.broadcast((probe_ids, probe_vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, leaves = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                q, r, scores = nearest(query_ids, vectors, ids, _vectors(batch.column(1), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[r]), pa.array(scores), pa.array(leaves[r])], names=["query_id", "vec_id", "score", "leaf"])

    truth = _top(indexed.select("id", "vector", "leaf").mapInArrow(scan, FOUND), k).select("query_id", "leaf").collect()
    leaves = {}
    for row in truth:
        leaves.setdefault(row.query_id, []).append(row.leaf)
    visits = 1
    while visits < tree.leaves:
        reached = sum(np.isin(leaves.get(i, []), tree.visit(v, visits)).sum() for i, v in zip(probe_ids.tolist(), probe_vectors, strict=True))
        if reached >= recall * len(truth):
            break
        visits = min(tree.leaves, max(visits + 1, visits * 5 // 4))
    return visits
