"""Exact top-k inner products by dual-tree search over cover trees.

Pivots (a bounded sample) deal all vectors, queries among them, into cells; a
cell's rows go to blocks of bounded size, and each block is a cover tree: every
node covers its rows within a radius. The queries that meet a block form a cover
tree too, and pairs of nodes are searched, one from each tree. With query centre
p, data centre c and radii a, b no inner product of the pair exceeds
``<p, c> + |p| b + |c| a + a b``: below the worst k-th score of the query node's
queries the whole pair is pruned, else the wider node is opened. Only pairs of
leaves compute scores.

Round 1 searches the block of each query. Round 2 prunes (query cell, block)
pairs by the blocks' roots, then searches what is left. Queries meet a block in
bundles of bounded size, so neither side of a task grows with the input. Every
query is sent to each block that survives: copies of queries grow with the
number of blocks that no bound excludes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vintner.session import materialize

from .common import cuts, read

_LEAF = 256  # rows of a leaf, at most (equal rows aside)
_FAN = 16     # children of a node, at most
_WIDE = 2048  # node pairs looked at together
_SEED = 64    # data centres that every query meets first, for a k-th score to start with


class CoverTree:
    """Nodes in breadth-first order: centre row, radius, range of children, and
    of a leaf (a node without children) its rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norm2 = (x * x).sum(axis=1)
        center, radius, lo, hi, parent, self.rows = [0], [0.0], [0], [0], [0], {}
        every = np.arange(len(x))
        todo = [(every, self._far(0, every))]
        for node, (rows, dist) in enumerate(todo):  # grows while it is read
            radius[node] = float(dist.max()) if len(rows) else 0.0
            lo[node] = len(center)
            if len(rows) <= _LEAF or radius[node] == 0.0:
                self.rows[node] = rows
            else:
                for c, members, away in self._net(center[node], rows, dist, radius[node] / 2):
                    todo.append((members, away))
                    center.append(c), radius.append(0.0), lo.append(0), hi.append(0), parent.append(node)
            hi[node] = len(center)
        self.center, self.radius, self.parent = np.array(center), np.array(radius), np.array(parent)
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.leaf = self.lo == self.hi
        self.length = np.sqrt(self.norm2[self.center]) if len(x) else np.zeros(1)
        # nodes of one depth follow each other: the begins of the depths
        depth = [0, 1]
        while depth[-1] < len(center):
            depth.append(int(self.hi[depth[-2]:depth[-1]].max()))
        self.depths = depth

    def _far(self, c: int, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        d2 = self.norm2[rows] + self.norm2[c] - 2 * (self.x[rows] @ self.x[c])
        return np.where(rows == c, 0.0, np.sqrt(np.maximum(d2, 0)))

    def _net(self, c: int, rows: np.ndarray, dist: np.ndarray, cover: float) -> list:
        """Children (centre, rows, distances): the node's own centre first, then
        always the row furthest from the centres so far, until every row lies
        within ``cover`` of one or there are _FAN. A row goes to its nearest
        centre, so many dimensions, where no row is near, do not make every row
        a node."""
        centers, child, least = [c], np.zeros(len(rows), np.int64), dist.copy()
        while len(centers) < _FAN and least.max() > cover:
            centers.append(int(rows[least.argmax()]))
            away = self._far(centers[-1], rows)
            near = away < least
            child[near], least = len(centers) - 1, np.minimum(least, away)
        return [(c, rows[child == k], least[child == k]) for k, c in enumerate(centers)]

    def lowest(self, values: np.ndarray) -> np.ndarray:
        """Of every node, the least value among its rows."""
        out = np.full(len(self.center), np.inf)
        for node, rows in self.rows.items():
            if len(rows):
                out[node] = values[rows].min()
        for a, b in zip(self.depths[-2:0:-1], self.depths[:0:-1]):
            np.minimum.at(out, self.parent[a:b], out[a:b])
        return out


class _Best:
    """The k best (score, id) of each query, an id once; ``pruned`` and ``met``
    count pairs of nodes."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.kth = k, floor.astype(np.float64).copy()
        self.q, self.s, self.i = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.pruned = self.met = 0

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        order = np.lexsort((-s, i, q))
        q, s, i = q[order], s[order], i[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])[:len(q)]
        q, s, i = q[once], s[once], i[once]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        at = cuts(q)
        place = np.arange(len(q)) - np.repeat(at, np.diff(np.append(at, len(q))))
        self.q, self.s, self.i = (v[place < self.k] for v in (q, s, i))
        last = place == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], s[last])


def dual_search(asked: CoverTree, own: np.ndarray, floor: np.ndarray, data: CoverTree, ids: np.ndarray, k: int) -> _Best:
    """The k best rows of ``data`` for the queries of ``asked`` (whose ids are
    ``own``); ``floor``: scores below which a query needs nothing."""
    best = _Best(floor, k)
    if not (len(asked.x) and len(data.x)):
        return best

    def meet(rows, others):
        """Candidates among the scores of some queries with some rows."""
        scores = asked.x[rows] @ data.x[others].T
        q, j = np.nonzero((scores >= best.kth[rows][:, None]) & (ids[others][None, :] != own[rows][:, None]))
        return rows[q], scores[q, j], ids[others[j]]

    best.add(*meet(np.arange(len(asked.x)), np.unique(data.center[:_SEED])))
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        q, d = stack.pop()
        bound = (asked.x[asked.center[q]] * data.x[data.center[d]]).sum(axis=1) + asked.length[q] * data.radius[d] \
            + data.length[d] * asked.radius[q] + asked.radius[q] * data.radius[d]
        reach = bound + 1e-9 * np.abs(bound) + 1e-6
        order = np.flatnonzero(reach >= asked.lowest(best.kth)[q])
        best.pruned, best.met = best.pruned + len(q) - len(order), best.met + len(q)
        order = order[np.argsort(-bound[order], kind="stable")]  # most promising first: they raise the k-th scores
        q, d, reach = q[order], d[order], reach[order]
        both = asked.leaf[q] & data.leaf[d]
        found = [meet(asked.rows[a], data.rows[b]) for a, b, top in zip(q[both].tolist(), d[both].tolist(), reach[both].tolist())
                 if top >= best.kth[asked.rows[a]].min()]
        if found:
            best.add(*(np.concatenate(column) for column in zip(*found)))
        q, d = q[~both], d[~both]
        wide = ~data.leaf[d] & (asked.leaf[q] | (data.radius[d] >= asked.radius[q]))
        pairs = []
        for tree, open_, other, swap in ((data, d[wide], q[wide], False), (asked, q[~wide], d[~wide], True)):
            n = tree.hi[open_] - tree.lo[open_]
            child = np.repeat(tree.lo[open_] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append((child, np.repeat(other, n)) if swap else (np.repeat(other, n), child))
        q, d = (np.concatenate(column) for column in zip(*pairs))
        for a in range((len(q) - 1) // _WIDE * _WIDE if len(q) else -1, -1, -_WIDE):
            stack.append((q[a:a + _WIDE], d[a:a + _WIDE]))
    return best


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(pc.list_value_length(column), np.int64)
    out = np.zeros((len(n), width))
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), at] = np.asarray(column.flatten(), np.float64)
    return out


def usable(vec: Column) -> Column:
    """Vector that is not null and has only finite components."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def exact_top_k(rows: DataFrame, k: int = 5, block_rows: int = 4096, max_pivots: int = 1024,
                bundle_queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` its k rows
    of highest integer inner product, ties to the smaller id. ``rows``: id, vec
    (array of whole numbers), is_query.

    Rows without id or vector are left out; a query's own id is no candidate;
    equal rows count once, an id with several vectors by its best score. Fewer
    than k candidates: all of them. Vectors of different length compare as if
    padded with zeros. Scores are exact while they stay below 2**53. An empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    rows = materialize(rows.where("id IS NOT NULL AND vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"), "is_query").distinct(), "vectors")
    n, width, n_queries = rows.agg(F.count("*"), F.max(F.size("vec")), F.sum(F.col("is_query").cast("long"))).first()
    width, n_queries = width or 0, n_queries or 0
    n_pivots = max(1, min(max_pivots, math.ceil(n / block_rows)))
    bundles = max(1, math.ceil(n_queries / bundle_queries))
    first = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()["vec"]
    pivots = np.zeros((n_pivots, width))
    for i, v in enumerate(first):
        pivots[i, :len(v)] = v
    p_norm2 = (pivots ** 2).sum(axis=1)

    def deal(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            d2 = (x ** 2).sum(axis=1)[:, None] + p_norm2[None, :] - 2 * (x @ pivots.T)
            cell = d2.argmin(axis=1)
            far = np.sqrt(np.maximum(d2[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)],
                                             ["id", "vec", "is_query", "cell", "far"])

    celled = materialize(rows.mapInArrow(deal, "id long, vec array<double>, is_query boolean, cell int, far double"), "cells")
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    blocked = materialize(celled.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
                          .withColumn("block", F.xxhash64("cell", "part")).drop("parts", "part"), "blocks")
    found_type = "query_id long, vec_id long, score double, kth double"

    def found(query_ids, best):
        return pa.table({"query_id": pa.array(query_ids[best.q], pa.int64()), "vec_id": pa.array(best.i, pa.int64()),
                         "score": pa.array(best.s, pa.float64()), "kth": pa.array(best.kth[best.q], pa.float64())})

    def own_block(table):
        x, ids = _matrix(table.column("vec"), width), np.asarray(table.column("id"))
        ask = np.flatnonzero(np.asarray(table.column("is_query")))
        if not len(ask):
            return found(np.empty(0, np.int64), _Best(np.empty(0), k))
        return found(ids[ask], dual_search(CoverTree(x[ask]), ids[ask], np.full(len(ask), -np.inf), CoverTree(x), ids, k))

    def other_blocks(left, right):
        if not (left.num_rows and right.num_rows):
            return found(np.empty(0, np.int64), _Best(np.empty(0), k))
        x, q, floor = _matrix(right.column("vec"), width), np.asarray(right.column("id")), np.asarray(right.column("kth"))
        return found(q, dual_search(CoverTree(x), q, floor, CoverTree(_matrix(left.column("vec"), width)), np.asarray(left.column("id")), k))

    near = materialize(blocked.groupBy("block").applyInArrow(own_block, found_type), "near")
    kth = near.groupBy(F.col("query_id").alias("id")).agg(F.max("kth").alias("kth"))
    ask = materialize(blocked.where("is_query").join(kth, "id", "left")
                      .select("id", "vec", "cell", "far", F.col("block").alias("own"), F.coalesce("kth", F.lit(float("-inf"))).alias("kth"),
                              F.pmod(F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.lit(bundles))), F.lit(bundles)).alias("bundle")), "queries")
    # at most max_pivots query groups: one row each
    asked = ask.groupBy("cell").agg(F.max("far").alias("far"), F.min("kth").alias("kth")).toPandas()
    g_cell, g_far, g_kth = (asked[c].to_numpy() for c in ("cell", "far", "kth"))
    g_norm = np.sqrt(p_norm2[g_cell.astype(int)]) if len(asked) else np.empty(0)

    def survivors(batches):
        for b in batches:
            cell, far = np.asarray(b.column(1)), np.asarray(b.column(2))
            c = pivots[cell]
            bound = c @ pivots[g_cell].T + far[:, None] * g_norm[None, :] + np.sqrt(p_norm2[cell])[:, None] * g_far[None, :] + far[:, None] * g_far[None, :]
            i, j = np.nonzero(bound + 1e-9 * np.abs(bound) + 1e-6 >= g_kth[None, :])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(g_cell[j].astype(np.int32))], ["block", "cell"])

    result = near
    if len(asked):
        roots = blocked.groupBy("block", "cell").agg(F.max("far").alias("far"))
        pairs = roots.mapInArrow(survivors, "block long, cell int")
        sent = ask.join(pairs, "cell").where("own <> block").select("block", "bundle", "id", "vec", "cell", "kth")
        wanted = materialize(sent.select("block", "bundle").distinct(), "meetings")
        data = blocked.select("block", "id", "vec").join(wanted, "block")
        result = near.unionByName(data.groupBy("block", "bundle").cogroup(sent.groupBy("block", "bundle")).applyInArrow(other_blocks, found_type))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return result.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: five best rows for every 50th vector, among all vectors."""
    vec = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    rows = read(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    return exact_top_k(rows.select(F.col("vec_id").alias("id"), vec.alias("vec"), (F.col("vec_id") % 50 == 0).alias("is_query")))


ORACLE = """
WITH e AS (SELECT vec_id, [floor(256.0 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
