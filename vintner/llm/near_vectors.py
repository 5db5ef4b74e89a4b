"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A table rotates the vectors (three rounds of random signs and Hadamard
transform) and hashes each to the nearest vertices of the cross-polytope: the
signed axes of largest magnitude. ``hashes`` rotations form one code; multiprobe
files a vector under the best ``probes`` vertices of its last rotation, so two
vectors meet if their lists share one. The number of rotations per code follows
the table's size, so buckets stay small.

Buckets are verified in blocks by cosine in double precision. A pair is counted
in the first bucket it shares, so links come out exact without a list of pairs;
a large bucket is cut into sub-blocks that meet two at a time. Equal vectors
are one class throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from vintner.session import materialize

from .common import Union, connected_components, read
from .topk import _matrix, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (power-of-two width)."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """Bucket codes of every row: tables * probes of them, distinct by table."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(seed)
    out = []
    for t in range(tables):
        code = np.full(len(x), t, np.int64)
        for h in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / math.sqrt(width)
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :min(probes, width)]
            vertex = 2 * best + (np.take_along_axis(y, best, axis=1) < 0)
            if h == hashes - 1:
                out.append(code[:, None] * (2 * width) + vertex)
            code = code * (2 * width) + vertex[:, 0]
    return np.concatenate(out, axis=1)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tables: int = 6, probes: int = 3,
                 bucket_rows: int = 512, block_rows: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``
    (vec_id, label, embedding).

    Only rows of equal, non-null label and vectors of equal length are compared.
    Rows without id or label, and vectors that are null, zero or hold null or
    non-finite components, link with nothing. n_links counts other rows, equal
    ones included; component_id is the smallest vec_id reachable. An empty table
    gives an empty result. Recall is that of the hash tables (measured in the
    tests); no pair below the cosine is linked.
    """
    vec = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(vec) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")) \
        .withColumn("ok", F.coalesce(ok, F.lit(False))) \
        .withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = materialize(rows.where("ok").groupBy("label", "h1", "h2")
                          .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("vec")), "classes")
    per_label = classes.groupBy("label", F.size("vec").alias("dims")).agg(F.count("*").alias("n")).agg(F.max("n"), F.max("dims")).first()
    most, dims = per_label[0] or 0, per_label[1] or 1
    vertices = 2 << max(0, (dims - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(1, most * probes / bucket_rows)) / math.log(vertices)))
    tables *= hashes  # longer codes miss more: more tables make up for it

    def hashed(batches):
        for b in batches:
            n = np.asarray(pc.list_value_length(b.column(2)), np.int64)
            out = np.zeros((b.num_rows, tables * probes), np.int64)
            for d in np.unique(n):
                part = np.flatnonzero(n == d)
                x = _matrix(b.column(2).take(pa.array(part)), int(d))
                got = codes(x / np.sqrt((x ** 2).sum(axis=1, keepdims=True)), tables, hashes, probes)
                out[part, :got.shape[1]] = got
                out[part, got.shape[1]:] = got[:, :1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), tables * probes).cast(pa.list_(pa.int64()))],
                                             ["rep", "copies", "vec", "label", "codes"])

    coded = materialize(classes.select("rep", "copies", "vec", "label")
                        .mapInArrow(hashed, "rep long, copies long, vec array<double>, label int, codes array<long>"), "codes")
    filed = coded.select("*", F.explode(F.array_distinct("codes")).alias("code")) \
        .withColumn("bucket", F.xxhash64("label", F.size("vec"), "code"))
    full = filed.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).alias("parts"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    mine = F.pmod(F.xxhash64("rep", "bucket"), F.col("parts"))
    met = filed.join(full, "bucket").withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .select("bucket", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "code", "rep", "copies", "vec", "codes")

    def verify(table):
        rep, copies = np.asarray(table.column("rep")), np.asarray(table.column("copies"))
        code, side = int(table.column("code")[0].as_py()), np.asarray(table.column("mine"))
        n = np.asarray(pc.list_value_length(table.column("vec").combine_chunks()))
        x = _matrix(table.column("vec"), int(n.max()))
        every = np.sort(_matrix(table.column("codes"), tables * probes).astype(np.int64), axis=1)
        x /= np.sqrt((x ** 2).sum(axis=1, keepdims=True))
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side == side.max())
        apart = side.min() != side.max()
        if not apart and table.column("a")[0] != table.column("b")[0]:
            left = left[:0]  # one of the two sub-blocks is empty: its pairs are met elsewhere
        links, uf = np.zeros(len(rep), np.int64), Union(len(rep))
        for a in range(0, len(left), 256):
            rows_ = left[a:a + 256]
            i, j = np.nonzero(x[rows_] @ x[right].T >= cosine - 1e-9)
            i, j = rows_[i], right[j]
            if not apart:
                i, j = i[i < j], j[i < j]
            exact = np.concatenate([(x[i[c:c + 65536]] * x[j[c:c + 65536]]).sum(axis=1) >= cosine for c in range(0, len(i), 65536)] or [np.empty(0, bool)])
            i, j = i[exact], j[exact]
            for c in range(0, len(i), 16384):
                p, q = i[c:c + 16384], j[c:c + 16384]
                # counted here if no smaller code is shared
                smaller = np.where(every < code, every, -1)
                shared = np.zeros(len(p), bool)
                for t in range(every.shape[1]):
                    s = smaller[p, t]
                    shared |= (s >= 0) & (smaller[q] == s[:, None]).any(axis=1)
                p, q = p[~shared], q[~shared]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                if len(p):
                    lows = np.minimum.reduceat(uf.roots()[q], at := np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])))
                    roots = uf.roots()
                    for u, v in {(int(roots[u]), int(roots[v])) for u, v in zip(p.tolist(), q.tolist()) if roots[u] != roots[v]}:
                        uf.join(u, v)
        roots = uf.roots()
        hit = (links > 0) | (roots != np.arange(len(rep)))
        return pa.table({"rep": pa.array(rep[hit]), "links": pa.array(links[hit]), "root": pa.array(rep[roots[hit]])})

    pairs = materialize(met.groupBy("bucket", "a", "b").applyInArrow(verify, "rep long, links long, root long"), "vector_links")
    links = pairs.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(pairs.selectExpr("rep u", "root v"), "vector_parts")
    member = classes.drop("vec").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("label", "h1", "h2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    good = rows.where("ok").select("vec_id", "label", "h1", "h2").join(member, ["label", "h1", "h2"]) \
        .select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: near-duplicate embeddings of equal label."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.98),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, y FROM reach JOIN link ON x = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
