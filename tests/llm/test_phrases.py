"""Phrase mining against a plain count, with hot words, nulls, repeated rows,
very long pieces, clashing columns and no rows."""

import collections
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import spark  # noqa: E402,F401

from vintner.llm import phrases  # noqa: E402


def documents(seed=6):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "CITY", "a", "é", "É", "日本", "x\x85y", "b-c", "x y", "same", "Σ"]
    rows = []
    for i in range(160):
        t = []
        for _ in range(r.choice([0, 1, 5, 60])):
            t.append(r.choice([r.choice(words), "the", "new york city", "one two three four five", "of the"]))
            t.append(r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";\r\n", "! ", "\x0b"]))
        rows.append(("".join(t), r.choice(["en", "en", "en", "fr", None])))
    return rows + [rows[3], rows[3], (None, "en"), ("", "fr"), (" .,\n", None), ("the the " * 400, "en"), ("word " * 50, "a\tb"), ("und one " * 40, "und")]


def plain(rows, longest, least, subsumed, most):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        kept = []
        for p, a in often.items():
            if 100 * inside[p] >= subsumed * a:
                continue
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]]))
        for rank, (s, _, p, a, l, r) in enumerate(sorted(kept)[:most], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"chunk_words": 300, "bucket_words": 40, "sub_entries": 16}])
@pytest.mark.parametrize("longest, most", [(4, 2000), (2, None), (5, 7)])
def test_phrases_match_a_plain_count(spark, sizes, longest, most):  # noqa: F811
    rows = documents()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    df = df.select("*", *(F.lit("clash").alias(c) for c in ("chunk", "bucket", "n", "rank", "phrase", "id", "p", "s", "a.b")))
    got = phrases.mine_phrases(df, longest, least=8, most=most, **sizes).collect()
    assert sorted(map(tuple, got)) == plain(rows, longest, 8, 80, most)
    assert got


def test_phrases_of_tables_without_words(spark):  # noqa: F811
    df = spark.createDataFrame([(None, "en"), (" .\n", "en")], "text string, lang string")
    assert phrases.mine_phrases(df).count() == 0
    assert phrases.mine_phrases(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):  # noqa: F811
    df = spark.createDataFrame([(2**62, 2**63 - 1, 2**63 - 1), (2**62, 2**62, 1), (30, 31, 2**62)], "a long, l long, r long")
    got = [x[0] for x in df.select(phrases._cut(F.col("a"), F.col("l"), F.col("r"), 2_000_000)).collect()]
    assert got == [2_000_000 * a // (b + c) for a, b, c in ((2**62, 2**63 - 1, 2**63 - 1), (2**62, 2**62, 1), (30, 31, 2**62))]


def test_hot_prefixes_are_dealt_over_buckets():
    """Entries of one prefix with many occurrences spread over all buckets."""
    import pyarrow as pa
    n = 4000
    pos = np.arange(2 * n, dtype=np.uint32)
    idx = np.where(pos % 2 == 0, 0, 1 + pos // 2).astype(np.uint32)  # hot, w1, hot, w2, ...
    state = pa.table({"chunk": [7], "pos": [phrases.pack_sorted(pos)], "idx": [phrases.pack(idx)]})
    ids = np.arange(n + 1, dtype=np.int64)
    counts = np.where(ids == 0, 10**6, 30)
    replies = pa.table({"chunk": [7], "bucket": [0], "ids": [phrases.pack(ids)], "counts": [phrases.pack(counts)]})
    out = phrases._grow(state, replies, 16, 1000, True).to_pylist()
    first = [phrases.unpack_sorted(x["first"], np.int64) for x in out]
    assert len(out) == 16 and max((f == 0).sum() for f in first) < 2 * n / 16
    assert sum((f == 0).sum() for f in first) == n
