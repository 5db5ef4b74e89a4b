r"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words,
counted in Spark; repeated windows merge into maximal removal intervals.

Documents are dealt into blocks by a hash of the whole row (a hot source or a
group of copies spreads evenly). A block sends each distinct window hash once,
so a passage found in a third of all documents costs one entry per block. The
entries go to buckets by a second, independent hash; a bucket finds the
smallest doc_id of every hash and answers the blocks whose smallest holder
comes later. The blocks then merge removed windows into intervals. Both passes
read the same shuffle of the texts.

Two different windows are taken for equal only if 64 bits of one hash and the
bucket of the other agree: about 1e-5 expected cases in 10**8 windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import (LAST, cuts, hash_words, pack, pack_sorted, quoted, read, rolling, text_bytes,
                     unpack, unpack_sorted, word_codes)

# odd bases of the two polynomials, and the seeds of their word hashes
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_SEEDS = (17, 91)

_ENTRIES = "bucket int, block int, hashes binary, owners binary, ids binary"


class _Windows:
    """Windows of a block: hash, owning row and start, and the local verdict."""

    def __init__(self, table: pa.Table, width: int, second: bool):
        ids = table.column("id").combine_chunks()
        self.ids = np.asarray(ids.fill_null(LAST), np.int64)
        texts = table.column("text").combine_chunks()
        codes, self.sizes, vocab = word_codes(texts)
        self.ends = np.cumsum(self.sizes)
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        hashes = [rolling(hash_words(vocab, s)[codes], width, b)
                  for s, b in list(zip(_SEEDS, _BASES))[:1 + second]]
        self.starts = np.flatnonzero(owner[:len(hashes[0])] == owner[width - 1:]) if len(hashes[0]) else np.empty(0, np.int64)
        self.owner = owner[self.starts]
        self.hash = hashes[0][self.starts]
        # by hash, then doc_id, then position: a run's first entry is its local first
        self.order = np.lexsort((self.starts, self.ids[self.owner], self.hash))
        self.sorted = self.hash[self.order]
        self.runs = cuts(self.sorted)
        self.second = hashes[1][self.starts][self.order[self.runs]] if second else None

    def removed(self, later: np.ndarray) -> np.ndarray:
        """Mask over windows in position order. ``later``: sorted hashes whose
        first holder is a document of another block."""
        ids, row = self.ids[self.owner][self.order], self.owner[self.order]
        n = np.diff(np.append(self.runs, len(ids)))
        first_id = np.repeat(ids[self.runs], n)
        same_row = np.concatenate([[False], (self.sorted[1:] == self.sorted[:-1]) & (row[1:] == row[:-1])])[:len(ids)]
        hit = (ids > first_id) | same_row
        # rows that share a doc_id interleave by position: the same row may recur
        if len(np.unique(self.ids)) < len(self.ids):
            o = np.lexsort((self.starts, self.owner, self.hash))
            again = np.concatenate([[False], (self.hash[o][1:] == self.hash[o][:-1]) & (self.owner[o][1:] == self.owner[o][:-1])])[:len(o)]
            repeat = np.zeros(len(o), bool)
            repeat[o] = again
            hit |= repeat[self.order]
        if len(later):
            at = np.searchsorted(later, self.sorted[self.runs])
            found = later[np.minimum(at, len(later) - 1)] == self.sorted[self.runs]
            hit |= np.repeat(found, n)
        out = np.zeros(len(ids), bool)
        out[self.order] = hit
        return out


def remove_repeated_windows(docs: DataFrame, width: int = 20, id_col: str = "doc_id",
                            text_col: str = "text", block_bytes: int = 8 << 20,
                            bucket_words: int = 1 << 20) -> DataFrame:
    r"""(id, n_words, removed: array<struct<start, end>>, kept): the maximal
    word intervals covered by repeated windows, and the kept words joined by one
    space.

    A window is ``width`` consecutive words ``[^\x20\x09-\x0D]+``; it is repeated
    if its word sequence also starts earlier: in a row with a smaller id, or
    earlier in the same row. Null text has no words; rows without id come after
    all others; rows that share an id do not outrank each other (a repeated row
    keeps its words unless an earlier id holds them). Extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = text_bytes(docs.select(quoted(text_col).alias("text")))
    n_blocks = max(1, math.ceil(size / block_bytes))
    n_buckets = max(1, math.ceil(size / 6 / bucket_words))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))
    kept_type = "id long, n_words long, removed array<struct<start:long,end:long>>, kept string"

    def entries(key, table):
        w = _Windows(table, width, True)
        first = w.order[w.runs]
        hashes, ids = w.sorted[w.runs], w.ids[w.owner[first]]
        bucket = (w.second % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        at = cuts(bucket[by])
        out: dict[str, list] = {k: [] for k in ("bucket", "block", "hashes", "owners", "ids")}
        for a, b in zip(at, [*at[1:], len(by)]):
            part = by[a:b]
            table_ids, owners = np.unique(ids[part], return_inverse=True)
            for k, v in zip(out, (int(bucket[part[0]]), key[0].as_py(), pack_sorted(hashes[part]),
                                  pack(owners.astype(np.uint32)), pack_sorted(table_ids))):
                out[k].append(v)
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()),
                                               ("owners", pa.binary()), ("ids", pa.binary())]))

    def answers(table):
        parts = table.to_pylist()
        hashes = [unpack_sorted(p["hashes"], np.uint64) for p in parts]
        ids = [unpack_sorted(p["ids"], np.int64)[unpack(p["owners"], np.uint32)] for p in parts]
        every, every_id = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(every, kind="stable")
        runs = cuts(every[order])
        low = np.minimum.reduceat(every_id[order], runs)
        later = np.zeros(len(every), bool)
        later[order] = every_id[order] > np.repeat(low, np.diff(np.append(runs, len(order))))
        out, pos = [], 0
        for p, h in zip(parts, hashes):
            hit = later[pos:pos + len(h)]
            pos += len(h)
            if hit.any():
                out.append({"block": p["block"], "hashes": pack_sorted(h[hit])})
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("hashes", pa.binary())]))

    def cut(table, replies):
        w = _Windows(table, width, False)
        later = [unpack_sorted(x, np.uint64) for x in replies.column("hashes").to_pylist()]
        hit = w.removed(np.sort(np.concatenate(later)) if later else np.empty(0, np.uint64))
        cover = np.zeros(int(w.sizes.sum()) + 1, np.int64)
        np.add.at(cover, w.starts[hit], 1)
        np.add.at(cover, w.starts[hit] + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed, kept = [], []
        for text, end, n in zip(table.column("text").to_pylist(), w.ends, w.sizes):
            ws, mask = (text or "").encode().split(), gone[end - n:end]
            if mask.any():
                edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
                removed.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                ws = [x for x, m in zip(ws, mask.tolist()) if not m]
            else:
                removed.append([])
            kept.append(b" ".join(ws).decode())
        return pa.table({"id": table.column("id"), "n_words": pa.array(w.sizes),
                         "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         "kept": pa.array(kept, pa.string())})

    replies = (rows.groupBy("block").applyInArrow(entries, _ENTRIES)
               .groupBy("bucket").applyInArrow(answers, "block int, hashes binary"))
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cut, kept_type)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: repeated 20-word windows removed from all documents."""
    out = remove_repeated_windows(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("id").alias("doc_id"), "n_words", gone.alias("n_removed"),
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY word.p) AS kept, count(*) AS n
              FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p
              WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
