r"""N-gram Jaccard join over a count-vector R-tree.

0. A third of all shingle hashes are looked up among all texts: a text with more
   shingles that no other text has than a link leaves room for links with
   nothing, exactly, and takes no further part.
1. Every other document's distinct word shingles are hashed into groups; the content
   of one group (its combined hash) is a block key. With more groups than two
   linked sets can differ in, two linked sets agree on the whole content of at
   least one group: no link is lost. Keys of a map task travel as packed arrays
   by key range; tasks that hold a range link documents that share a key.
2. Documents that share keys, directly or through others, form a candidate
   component; components are packed into blocks of bounded size. A block
   indexes its documents' group counts as points of an R-tree, bounds the
   overlap of two nodes by the summed coordinate minima of their boxes, and
   verifies surviving pairs on the shingle sets. Pairs already connected are
   skipped: the result is the components, so copies are never all paired up.
3. A component larger than a block is dealt twice into random blocks. Where
   that leaves more than one part, the documents meet again by rare shingles:
   in one order of all shingles, those with the fewest holders first, two linked
   sets share one of their first shingles (so many that the others are fewer
   than a link has in common): no link is lost. The holders of a shingle meet at
   the smallest of them, a document once however many shingles it shares there,
   and a group is verified like a block: it gives at most a link a document.
   Groups beyond a block are cut into sub-blocks that meet two at a time.

Exact copies are one class from the start; a class is represented by its
smallest doc_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vintner.session import materialize

from .common import (Union, arrow_rows, connected_components, cuts, hash_words, mix, pack, pack_sorted,
                     quoted, read, text_bytes, text_slices, unpack, unpack_sorted, word_codes)

_AXES = 64          # coordinates of a count vector
_LEAF = 32          # points of an R-tree leaf
_SPARE = 3          # groups beyond the number that can differ
_CLASS_RATIO = 1.5  # set sizes from one size class to the next
_PROBE = 3          # one in so many hashes is looked up among all classes


def shingle_sets(texts: pa.Array, width: int):
    """For each text its sorted distinct shingle hashes (None without words).
    Texts have A-Z lowered here; other characters stay as they are."""
    lowered = pa.array([None if t is None else t.translate(_LOWER) for t in texts.to_pylist()], pa.string())
    codes, sizes, vocab = word_codes(lowered)
    word = hash_words(vocab, 5)[codes]
    ends = np.cumsum(sizes)
    place = [mix(word + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(width)]
    full = place[0][:max(0, len(word) - width + 1)].copy()
    for k in range(1, width):
        full = full + place[k][k:k + len(full)]
    full = mix(full)
    for end, n in zip(ends, sizes):
        if n >= width:
            yield np.unique(full[end - n:end - width + 1])
        elif n:
            short = np.array([n], np.uint64)
            for k in range(n):
                short = short + place[k][end - n + k:end - n + k + 1]
            yield mix(short)
        else:
            yield None


_SLICE = 1 << 20  # bytes of text worked on at a time
_LOWER = {c: c + 32 for c in range(65, 91)}


def _spread(size: int, num: int, den: int) -> int:
    """Most elements in which two sets can differ if they link and the larger
    one has ``size`` elements: overlap >= num/den of the union."""
    return max(a + size - 2 * -(-num * (a + size) // (num + den)) for a in (size, size - 1)) if size > 1 else 0


def size_classes(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(lowest size of a class, its number of groups) for each class that a set
    of this size has to be filed under: its own, and the next one if a linked
    partner may be there. Classes start at 1 and grow by a fixed ratio."""
    low, out = 1, []
    while low <= size * den / num:
        top = max(low + 1, int(low * _CLASS_RATIO))
        if size < top:
            out.append((low, max(_spread(s, num, den) for s in (top - 1, max(top - 2, 1))) + 1 + _SPARE))
        low = top
    return out


def block_keys(hashes: np.ndarray, num: int, den: int, memo: dict) -> np.ndarray:
    """Keys of a set: for each class, the combined hash of each group. A set with
    up to _SPARE empty groups leaves these out; one with more files them too."""
    n = len(hashes)
    if n not in memo:
        memo[n] = size_classes(n, num, den)
    out = []
    for low, groups in memo[n]:
        g = (hashes % np.uint64(groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        at = cuts(g[order])
        total = np.add.reduceat(mix(hashes[order]), at)
        tag = g[order][at].astype(np.uint64) + np.uint64(low << 20)
        out.append(mix(total ^ mix(tag)))
        if groups - len(at) > _SPARE:
            empty = np.setdiff1d(np.arange(groups), g).astype(np.uint64)
            out.append(mix(mix(empty + np.uint64(low << 20)) ^ np.uint64(0xA5A5A5A5)))
    return np.concatenate(out)


def by_bucket(keys: np.ndarray, ids: np.ndarray, n_buckets: int) -> dict[str, list]:
    """Keys and the ids that hold them, packed, a row for each bucket of keys."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    at = cuts(bucket[order])
    out = {"bucket": [], "hashes": [], "owners": [], "ids": []}
    for a, b in zip(at, [*at[1:], len(order)]):
        part = order[a:b]
        own, where = np.unique(ids[part], return_inverse=True)
        for k, v in zip(out, (int(bucket[part[0]]), pack_sorted(keys[part]), pack(where.astype(np.uint32)), pack_sorted(own))):
            out[k].append(v)
    return out


def from_buckets(table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the packed rows of a bucket and the ids that hold them, ordered by both."""
    keys, ids = [], []
    for h, o, i in zip(*(table.column(c).to_pylist() for c in ("hashes", "owners", "ids"))):
        keys.append(unpack_sorted(h, np.uint64))
        ids.append(unpack_sorted(i, np.int64)[unpack(o, np.uint32)])
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((ids, keys))
    return keys[order], ids[order]


def lone_counts(table, n_parts: int):
    """(part, classes, lone): for each class how many hashes of this range only
    it holds, packed, a row for each part of the classes. A class has hashes in
    most ranges, so a row for each would make ranges times classes."""
    keys, own = from_buckets(table)
    at = cuts(keys)
    only = own[at][own[at] == np.maximum.reduceat(own, at)]
    fa, n = np.unique(only, return_counts=True)
    part = (fa.view(np.uint64) % np.uint64(n_parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    parts = np.split(order, cuts(part[order])[1:]) if len(order) else []
    return pa.table({"part": pa.array([int(part[x[0]]) for x in parts], pa.int32()), "classes": pa.array([pack_sorted(fa[x]) for x in parts], pa.binary()),
                     "lone": pa.array([pack(n[x].astype(np.uint32)) for x in parts], pa.binary())})


def added_counts(table):
    """(fa, lone): the counts of a part of the classes, added up over all ranges."""
    fa = np.concatenate([unpack_sorted(c, np.int64) for c in table.column("classes").to_pylist()])
    n = np.concatenate([unpack(c, np.uint32) for c in table.column("lone").to_pylist()])
    fa, at = np.unique(fa, return_inverse=True)
    return pa.table({"fa": pa.array(fa, pa.int64()), "lone": pa.array(np.bincount(at, n).astype(np.int64), pa.int64())})


def held_ranges(sets: list[np.ndarray], n_buckets: int) -> dict[str, list]:
    """Hashes of a batch of sets and how many sets hold each, packed, a row for
    each bucket of hashes."""
    hashes, held = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, cuts(bucket[order])[1:]) if len(order) else []
    return {"bucket": [int(bucket[x[0]]) for x in parts], "hashes": [pack_sorted(hashes[x]) for x in parts],
            "held": [pack(held[x].astype(np.uint32)) for x in parts]}


def total_holders(table):
    """(batch, hashes, held): for each batch those of its hashes of this range
    that several sets of all batches hold, and how many do."""
    lists = [unpack_sorted(h, np.uint64) for h in table.column("hashes").to_pylist()]
    every, at = np.unique(np.concatenate(lists), return_inverse=True)
    held = np.bincount(at, np.concatenate([unpack(n, np.uint32) for n in table.column("held").to_pylist()])).astype(np.int64)[at]
    out, end = {"batch": table.column("batch"), "hashes": [], "held": []}, 0
    for hashes in lists:
        n, end = held[end:end + len(hashes)], end + len(hashes)
        out["hashes"].append(pack_sorted(hashes[n > 1]))
        out["held"].append(pack(n[n > 1]))
    return pa.table({"batch": out["batch"], "hashes": pa.array(out["hashes"], pa.binary()), "held": pa.array(out["held"], pa.binary())})


def first_shingles(sets: list[np.ndarray], hashes: np.ndarray, held: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its set) of the first shingles of each set, rarest
    first (then by hash), that other sets hold too: without these the rest is
    smaller than the overlap of a link. ``hashes`` holds, sorted, all that
    several sets hold, ``held`` how many do."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, own = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    times = np.ones(len(flat), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
        times = np.where(hashes[at] == flat, held[at], times)
    order = np.lexsort((flat, times, own))
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = order[(rank < np.repeat(sizes + 1 - -(-num * sizes // den), sizes)) & (times[order] > 1)]
    return flat[first], own[first]


def meetings(table):
    """(low, id) once for the first shingles of this range that documents of
    several parts hold: low is the smallest holder."""
    keys, ids = from_buckets(table)
    every = np.concatenate([unpack_sorted(i, np.int64) for i in table.column("ids").to_pylist()])
    every, at = np.unique(every, return_index=True)
    part = np.concatenate([unpack(p, np.int64) for p in table.column("parts").to_pylist()])[at][np.searchsorted(every, ids)]
    at = cuts(keys)
    n = np.diff(np.append(at, len(ids)))
    apart = np.repeat(np.minimum.reduceat(part, at) != np.maximum.reduceat(part, at), n)
    met = np.unique(np.stack([np.repeat(ids[at], n), ids], axis=1)[apart], axis=0)
    return pa.table({"low": pa.array(met[:, 0], pa.int64()), "id": pa.array(met[:, 1], pa.int64())})


class _RTree:
    """Packed R-tree over count vectors, sorted by size, then tiled by the
    coordinates; level 0 are the leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*(points[:, k] for k in (3, 2, 1, 0)), sizes))
        self.order = order
        tops, least = points[order], sizes[order]
        self.levels = []
        while True:
            at = np.arange(0, len(tops), _LEAF)
            tops, least = np.maximum.reduceat(tops, at), np.minimum.reduceat(least, at)
            self.levels.append((tops, least))
            if len(tops) == 1:
                break


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """Elements of a set per group of hashes."""
    return np.bincount((hashes >> np.uint64(7)).astype(np.int64) % _AXES, minlength=_AXES).astype(np.int32)


def surviving(points: np.ndarray, sizes: np.ndarray, num: int, den: int, wanted):
    """Pairs (i, j) whose overlap bound allows a link, in batches: dual traversal
    of the R-tree with itself. ``wanted(i, j)`` masks the pairs still open."""
    tree = _RTree(points, sizes)
    order = tree.order
    points, sizes = points[order], sizes[order]

    def survive(tops, least, i, j):
        """Node pairs whose bound reaches num/(num+den) of the summed sizes."""
        keep = []
        for a in range(0, len(i), 1 << 14):
            x, y = i[a:a + (1 << 14)], j[a:a + (1 << 14)]
            bound = np.minimum(tops[x], tops[y]).sum(axis=1, dtype=np.int64)
            keep.append(bound * (num + den) >= num * (least[x] + least[y]))
        ok = np.concatenate(keep)
        return i[ok], j[ok]

    def children(i, j, width):
        """Child pairs of node pairs, each once."""
        step = np.arange(_LEAF)
        x = (i[:, None, None] * _LEAF + step[None, :, None] + 0 * step[None, None, :]).ravel()
        y = (j[:, None, None] * _LEAF + step[None, None, :] + 0 * step[None, :, None]).ravel()
        ok = (x < width) & (y < width) & (x <= y)
        return x[ok], y[ok]

    def walk(level, i, j):
        if not len(i):
            return
        if level < 0:
            far = i != j
            far[far] = wanted(order[i[far]], order[j[far]])
            i, j = survive(points, sizes, i[far], j[far]) if far.any() else (i[:0], j[:0])
            if len(i):
                bound = np.minimum(points[i], points[j]).sum(axis=1, dtype=np.int64)
                best = np.argsort(-bound, kind="stable")
                yield order[i[best]], order[j[best]]
            return
        i, j = survive(*tree.levels[level], i, j)
        width = len(tree.levels[level - 1][1]) if level else len(points)
        for a in range(0, len(i), 64):
            yield from walk(level - 1, *children(i[a:a + 64], j[a:a + 64], width))

    yield from walk(len(tree.levels) - 1, np.array([0]), np.array([0]))


def linked(sets: list[np.ndarray], roots: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component root (position) of each set, starting from the given ones:
    exact overlaps of surviving pairs not yet connected."""
    uf, first = Union(len(sets)), {}
    for i, r in enumerate(roots.tolist()):
        uf.join(i, first.setdefault(r, i))

    def apart(i, j):
        up = uf.roots()
        return up[i] != up[j]

    points = np.stack([count_vector(s) for s in sets])
    for i, j in surviving(points, np.fromiter(map(len, sets), np.int64, len(sets)), num, den, apart):
        for a, b in zip(i.tolist(), j.tolist()):
            if uf.find(a) == uf.find(b):
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common * den >= num * (len(sets[a]) + len(sets[b]) - common):
                uf.join(a, b)
    return uf.roots()


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text", block_docs: int = 4000, key_docs: int = 4096, bucket_keys: int = 1 << 20, task_rows: int = 20_000,
                   task_keys: int = 1_000_000) -> DataFrame:
    r"""(id, n_shingles, component): for every row its number of distinct
    ``width``-word shingles and the smallest id reachable over links.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z lowered; a text with fewer than
    ``width`` words is one shingle. Two rows link when their shingle sets'
    intersection is at least ``percent`` % of the union. A row without text,
    words or id links with nothing (component: its own id). Rows that share an
    id count as one document; equal rows all come back. Extra columns are
    ignored; an empty table gives an empty result. Sets are held as 64-bit
    hashes of their shingles.
    """
    spark = docs.sparkSession
    num, den = percent, 100
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    probe = max(1, min(_PROBE, 60 // max(1, 100 - percent)))
    key_fields = [("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary())]
    key_ddl = "bucket int, hashes binary, owners binary, ids binary"

    def prints(s):
        """Class of a set: two sums over its hashes."""
        return (int(mix(s).sum(dtype=np.uint64).view(np.int64)),
                int(mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64).view(np.int64)))

    # 1. sets, classes, and a sample of the hashes to count the classes that hold each
    n_probes = max(1, math.ceil(text_bytes(rows) / 6 / probe / bucket_keys))
    fields = [("id", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), *key_fields]
    schema = pa.schema(fields)

    def features(batches):
        held, owner, n_held, seen = [], [], 0, set()

        def flush():
            keys, own = np.concatenate(held), np.repeat(np.array(owner, np.int64), [len(h) for h in held])
            order = np.lexsort((own, keys))
            keys, own = keys[order], own[order]
            at = cuts(keys)
            two = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys)))) < 2  # two holders say as much as more
            held.clear(), owner.clear(), seen.clear()
            made = by_bucket(keys[two], own[two], n_probes)
            return pa.RecordBatch.from_pydict({k: [None] * len(made["bucket"]) for k, _ in fields[:4]} | made, schema=schema)

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), {k: [] for k, _ in fields}
            sets = (s for a, b in text_slices(batch.column(1), _SLICE) for s in shingle_sets(batch.column(1).slice(a, b - a), width))
            for i, s in zip(ids, sets):
                fa = fb = None
                if s is not None:
                    fa, fb = prints(s)
                    if i is not None and (fa, fb) not in seen:  # a task files a class of copies once
                        seen.add((fa, fb))
                        keys = s[s % np.uint64(probe) == 0] >> np.uint64(24)
                        held.append(keys[cuts(keys)])
                        owner.append(fa)
                        n_held += len(keys)
                for k, v in zip(out, (i, 0 if s is None else len(s), fa, fb, None, None, None, None)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            if n_held > task_keys:
                yield flush()
                n_held = 0
        if n_held:
            yield flush()
        pa.default_memory_pool().release_unused()

    def lone(table):
        return lone_counts(table, n_probes)

    with arrow_rows(spark, 1000):
        made = materialize(rows.mapInArrow(features, "id long, n long, fa long, fb long, " + key_ddl), "shingles")
    member = made.where("bucket IS NULL").select("id", "n", "fa", "fb")
    classes = materialize(member.where("fa IS NOT NULL").groupBy("fa", "fb").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")
    member = materialize(member.join(classes.drop("n"), ["fa", "fb"], "left")
                         .select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")
    # shingles that no linked partner can have: more of them than a link leaves room for, and the class has no link
    lonely = made.where("bucket IS NOT NULL").select("bucket", "hashes", "owners", "ids") \
        .groupBy("bucket").applyInArrow(lone, "part int, classes binary, lone binary") \
        .groupBy("part").applyInArrow(added_counts, "fa long, lone long")
    reps = materialize(classes.where("rep IS NOT NULL").join(lonely, "fa", "left")
                       .where(F.coalesce("lone", F.lit(0)) * den <= (den - num) * F.col("n")).select(F.col("rep").alias("id"), "fa", "n"), "open")

    # 2. block keys of the classes that may have a link
    n_buckets = max(1, math.ceil((reps.agg(F.sum("n")).first()[0] or 0) * (100 - percent) / 50 / bucket_keys))
    open_fields = [("id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), *key_fields]
    open_schema = pa.schema(open_fields)

    def filed(batches):
        held, owner, n_held, seen, memo = [], [], 0, set(), {}

        def flush():
            made = by_bucket(np.concatenate(held), np.repeat(np.array(owner, np.int64), [len(h) for h in held]), n_buckets)
            held.clear(), owner.clear()
            return pa.RecordBatch.from_pydict({k: [None] * len(made["bucket"]) for k, _ in open_fields[:3]} | made, schema=open_schema)

        for batch in batches:
            out = {k: [] for k, _ in open_fields}
            sets = (s for a, b in text_slices(batch.column(1), _SLICE) for s in shingle_sets(batch.column(1).slice(a, b - a), width))
            for i, text, fa, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets):
                if s is None or (i, fa) in seen or prints(s)[0] != fa:  # equal rows, and rows of the id that are of another class
                    continue
                seen.add((i, fa))
                held.append(block_keys(s, num, den, memo))
                owner.append(i)
                n_held += len(held[-1])
                for k, v in zip(out, (i, text, len(s), None, None, None, None)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=open_schema)
            if n_held > task_keys:
                yield flush()
                n_held = 0
        if n_held:
            yield flush()
        pa.default_memory_pool().release_unused()

    def share(table):
        """(key, id, low) for the keys of this range that several documents
        have; low: the smallest of them."""
        keys, ids = from_buckets(table)
        at = cuts(keys)
        n = np.diff(np.append(at, len(ids)))
        low, many = np.repeat(ids[at], n), np.repeat(ids[at] != np.maximum.reduceat(ids, at), n)
        return pa.table({"key": pa.array(keys[many].view(np.int64)), "id": pa.array(ids[many], pa.int64()), "low": pa.array(low[many], pa.int64())})

    with arrow_rows(spark, 1000):
        made = materialize(rows.join(reps.select("id", "fa").hint("merge"), "id").select("id", "text", "fa")
                           .mapInArrow(filed, "id long, text string, n long, " + key_ddl), "keys")
    texts = made.where("bucket IS NULL").select("id", "text", "n")
    shared = materialize(made.where("bucket IS NOT NULL").select("bucket", "hashes", "owners", "ids")
                         .groupBy("bucket").applyInArrow(share, "key long, id long, low long"), "shared")
    near = connected_components(shared.where("id <> low").selectExpr("id u", "low v"), "candidates")
    counts = near.groupBy("root").agg(F.count("*").alias("docs"))
    near = materialize(near.join(counts, "root"), "candidates")
    n_near = max(1, near.count())

    def with_sets(table):
        """(sets, ids, labels) of rows (id, text, label)."""
        texts = table.column("text").combine_chunks()
        sets = [s for a, b in text_slices(texts, _SLICE) for s in shingle_sets(texts.slice(a, b - a), width)]
        ok = np.array([s is not None for s in sets], bool)
        ids, label = (np.asarray(table.column(c).combine_chunks(), np.int64)[ok] for c in ("id", "label"))
        return [s for s in sets if s is not None], ids, label

    def check(table):
        sets, ids, label = with_sets(table)
        if not sets:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        root = linked(sets, label, num, den)
        return pa.table({"u": pa.array(ids, pa.int64()), "v": pa.array(ids[root], pa.int64())})

    def verified(blocks: DataFrame) -> DataFrame:
        """Links found among the documents of each block (id, block, label). The
        candidates grow with the table, so they are never broadcast."""
        return (texts.join(blocks.hint("merge"), "id").select("id", "text", "label", "block")
                .groupBy("block").applyInArrow(check, "u long, v long").where("u <> v"))

    salts = F.ceil(F.col("docs") / F.lit(block_docs)).cast("long")
    packed = math.ceil(n_near / block_docs)
    deal = F.when(F.col("docs") <= block_docs, F.array(F.struct(F.lit(-1).cast("long").alias("r"), F.pmod(F.xxhash64("root"), F.lit(packed)).alias("s")))) \
        .otherwise(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct(F.col("root").alias("r"), (k * salts + F.pmod(F.xxhash64("node", k), salts)).alias("s"))))
    blocks = near.select(F.col("node").alias("id"), F.col("node").alias("label"), F.explode(deal).alias("b")) \
        .select("id", "label", F.xxhash64("b.r", "b.s").alias("block"))
    links = materialize(verified(blocks), "links")
    parts = connected_components(links, "parts")

    # components beyond one block that are still in parts: documents that share a rare shingle
    state = near.where(F.col("docs") > block_docs).join(parts.toDF("node", "part"), "node", "left") \
        .withColumn("part", F.coalesce("part", "node"))
    open_ = state.groupBy("root").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("root")
    left = materialize(texts.join(state.join(open_, "root").selectExpr("node id", "part label").hint("merge"), "id"), "unsettled")
    n_left, n_shingles = left.agg(F.count("*"), F.sum("n")).first()
    if n_left:
        n_batches = max(math.ceil(n_shingles / task_keys), math.ceil(n_left / task_rows))
        n_ranges = max(1, math.ceil(n_shingles / bucket_keys))
        dealt = left.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(n_batches))).select("batch", "id", "text", "label")

        def held(table):
            """(batch, bucket, hashes, held) of a batch."""
            made = held_ranges(with_sets(table)[0], n_ranges)
            batch = pa.array([table.column("batch")[0].as_py()] * len(made["bucket"]), pa.int64())
            return pa.table({"batch": batch, "bucket": pa.array(made["bucket"], pa.int32()),
                             "hashes": pa.array(made["hashes"], pa.binary()), "held": pa.array(made["held"], pa.binary())})

        def first(table, totals):
            """First shingles of the documents of a batch, packed by range, with
            the parts of their holders."""
            sets, ids, label = with_sets(table)
            hashes, held = ([unpack_sorted(x, np.uint64) for x in totals.column("hashes").to_pylist()],
                            [unpack(x, np.int64) for x in totals.column("held").to_pylist()])
            hashes, held = np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate([np.empty(0, np.int64), *held])
            order = np.argsort(hashes)
            keys, own = first_shingles(sets, hashes[order], held[order], num, den)
            made = by_bucket(keys, ids[own], n_ranges)
            every, at = np.unique(ids, return_index=True)
            made["parts"] = [pack(label[at][np.searchsorted(every, unpack_sorted(i, np.int64))]) for i in made["ids"]]
            return pa.table({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in made.items()})

        totals = dealt.groupBy("batch").applyInArrow(held, "batch long, bucket int, hashes binary, held binary") \
            .groupBy("bucket").applyInArrow(total_holders, "batch long, hashes binary, held binary")
        met = dealt.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(first, key_ddl + ", parts binary") \
            .groupBy("bucket").applyInArrow(meetings, "low long, id long").distinct()
        met = materialize(met, "met")
        subs = met.groupBy("low").agg(F.count("*").alias("docs")) \
            .select("low", F.when(F.col("docs") <= key_docs, 1).otherwise(F.ceil(2 * F.col("docs") / key_docs)).alias("subs"))
        met = met.join(subs.hint("merge"), "low").withColumn("mine", F.pmod(F.xxhash64("id", "low"), F.col("subs"))) \
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))) \
            .select("id", F.xxhash64("low", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"))
        more = materialize(verified(met.join(left.select("id", "label").distinct().hint("merge"), "id")), "links")
        parts = connected_components(links.unionByName(more), "parts")
    return (member.join(parts.toDF("rep", "root"), "rep", "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: documents whose 3-word shingle sets have Jaccard >= 0.9."""
    out = jaccard_groups(read(spark, sf_dir, "documents"), width=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (five-word shingles,
    Jaccard >= 0.8) the rows with the smallest doc_id stay. Repeated rows stay:
    all rows of that doc_id, equal or not, and every row without doc_id."""
    groups = jaccard_groups(docs).where("id = component OR id IS NULL").select("id").distinct()
    kept = docs.join(groups.where("id IS NOT NULL").withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return kept.select(*map(quoted, docs.columns)).unionByName(docs.where("doc_id IS NULL"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN link ON x = reach.r)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
