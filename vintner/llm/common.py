"""Shared helpers of the corpus operators: word splitting, hashing, byte-plane
packing and connected components."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vintner.session import materialize, table_path

LAST = np.iinfo(np.int64).max


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is written inside the
    block: bounds the buffers that a task holds on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of a text column: sizes blocks and buckets."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def quoted(name: str) -> Column:
    """Column by its literal name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores appended until no column is called so
    (in any case): helper columns that clash with nothing."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: str | None) -> list[bytes]:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text (bytes.split cuts at exactly
    these six characters)."""
    return text.encode().split() if text else []


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of every word of all texts, word count per text, distinct words)."""
    texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
    enc = flat.dictionary_encode()
    codes, vocab = np.asarray(enc.indices), enc.dictionary.to_pylist()
    if "" in vocab:  # pieces before leading and after trailing space
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keep = codes != vocab.index("")
        codes, sizes = codes[keep], np.bincount(owner[keep], minlength=len(sizes))
    return codes, sizes.astype(np.int64), vocab


def hash_words(vocab: list[str], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in vocab), np.uint64, len(vocab))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads close values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(word_hash: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp: polynomial hash modulo 2**64 of every ``width`` consecutive
    words, by differences of prefix sums (the odd base has an inverse)."""
    n = len(word_hash)
    if n < width:
        return np.empty(0, np.uint64)
    def powers(b: int) -> np.ndarray:
        p = np.full(n, b, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(word_hash * powers(base))])
    out = prefix[width:] - prefix[:-width]
    return mix(out * powers(pow(base, -1, 1 << 64))[:len(out)])


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array: planes that are all alike compress to
    nothing in Spark's shuffle files."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.add.accumulate(unpack(data, dtype), dtype=dtype)


def cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one in each 64-bit word, by halving."""
    words, k, at = words.copy(), k.astype(np.int64), np.zeros(len(k), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = words & np.uint64((1 << half) - 1)
        here = np.bitwise_count(low).astype(np.int64)
        up = k >= here
        k, at = np.where(up, k - here, k), at + np.where(up, half, 0)
        words = np.where(up, words >> np.uint64(half), low)
    return at


def text_slices(column: pa.Array, most_bytes: int = 4 << 20):
    """Row ranges of a text column of bounded total size (a single longer text
    stays whole): bounds what a batch holds at a time."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    at = cuts((np.cumsum(sizes) - sizes) // most_bytes)
    return zip(at.tolist(), [*at[1:].tolist(), len(sizes)])


class Union:
    """Union-find over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while (nxt := self.up[self.up]).tolist() != self.up.tolist():
            self.up = nxt
        return self.up


def contracted(batches):
    """Edges (u, v) of one task as stars: every node with the smallest node that
    the task's edges reach from it. A task holds one partition."""
    parts = [np.stack([np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)]) for b in batches if b.num_rows]
    if not parts:
        return
    ends = np.concatenate(parts, axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    u, v = nodes[far], nodes[label[far]]
    for i in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[i:i + (1 << 16)]), pa.array(v[i:i + (1 << 16)])], ["u", "v"])


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (u, v), for every
    node that has an edge to another one.

    Large-star steps by a join, small-star steps by dealing the edges by their
    larger end to tasks that contract them to stars; tasks contract what they
    read before they deal it, so a hub sends one edge a task and a round holds
    about one edge for each node. Each round is written to the
    shared checkpoint folder, so the lineage stays short and a lost executor
    costs one round. A hub's rows are joined, not collected, so adaptive skew
    joins can split them. The number of rounds grows with the logarithm of the
    longest path; more than ``rounds`` raise an error, nothing is dropped.
    """
    def write(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.mapInArrow(contracted, "u long, v long").repartition("u")
                           .mapInArrow(contracted, "u long, v long"), name)

    cur = write(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v"))
    for _ in range(rounds):
        lows = cur.selectExpr("u node", "v").unionByName(cur.selectExpr("v node", "v")) \
            .groupBy("node").agg(F.min("v").alias("root"), F.max("v").alias("most"))
        if not lows.where("root <> most").limit(1).count():  # stars: no node has two roots or a root above its own
            return lows.select("node", "root")
        cur = write(cur.join(lows.select("node", "root"), F.col("v") == F.col("node")).selectExpr("u", "root v"))
    raise RuntimeError(f"connected_components did not settle in {rounds} rounds")
