"""Fill-in-middle and token-id files against plain Python and the tokenizers
library, with nulls, empty and very long texts, repeated rows and clashing
columns."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF001, spark  # noqa: E402,F401

from vintner.llm import common, fill_middle, pieces, token_files  # noqa: E402

ALPHABET = ["a", "B", "é", "日", "😀", "\n", "\n\n", " ", ".", "!", "?", "7", "\t", "\r", "<P", "S>", "it's ", "don't ", "  x", " ", "́"]


def odd_texts(seed=4, n=300):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.choice([0, 1, 3, 40, 400]))) for _ in range(n)]
    return out + [None, "", "\n", "x", "a\nb", "has <S> inside", "<P><S><M>", "\n" * 70, "ab\n" * 30_000, "z" * 70_000 + "\nend", "<|endoftext|> and <|startoftext|>x"]


def frame(spark, texts):  # noqa: F811
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts)] + [(None, "no id\nhere"), (None, None), (5, "same id"), (5, "same id"), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.select("*", *(F.lit(c).alias(c) for c in ("id", "n", "form", "output", "part", "place", "tie", "segment", "a.b")))
    return rows, clash


def test_rank_and_select_match_a_plain_count():
    r = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = r.integers(0, 8, n).astype(np.uint8) if n != 65 else np.full(65, 5, np.uint8)
        m = fill_middle.WaveletMatrix(symbols)
        for s in range(8):
            at = np.arange(n + 1)
            assert (m.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
            where = np.flatnonzero(symbols == s)
            assert (m.select(s, np.arange(len(where))) == where).all()


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("sentence", r"[^\n.!?]*[\n.!?]|[^\n.!?]+")])
def test_fill_middle_matches_plain_cuts(spark, unit, pattern):  # noqa: F811
    rows, df = frame(spark, odd_texts())
    want = []
    for i, t in rows:
        t = t or ""
        w, h = re.findall(pattern, t), hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
        p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
            want.append((i, len(w), "plain", None, None, t, t))
        elif h[3] % 100 < 50:
            want.append((i, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    out = fill_middle.fill_middle(df, unit)
    got = [(*x, fill_middle.restore(x.output, x.form)) for x in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    if unit == "line":
        back = fill_middle.restore_texts(out).collect()
        assert sorted((repr(i), t) for i, t in back) == sorted((repr(i), t or "") for i, t in rows)
        assert fill_middle.fill_middle(df.limit(0)).count() == 0
        assert {x.form for x in out.collect()} == {"plain", "psm", "spm"}


def test_fill_middle_rate_and_unit(spark):  # noqa: F811
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    n = {x.form: x["count"] for x in fill_middle.fill_middle(df, rate=40, spm=25).groupBy("form").count().collect()}
    assert 1100 <= n["plain"] <= 1300 and 150 <= n["spm"] <= 250
    with pytest.raises(ValueError):
        fill_middle.fill_middle(df, "word")


def test_elias_fano_returns_every_value():
    r = np.random.default_rng(5)
    cases = [[], [0], [7], [0, 0, 0], list(range(3000)), [2**62], [0] * 700 + [10**12], [1] * 2000 + [2] * 5 + [2**40]]
    cases += [np.sort(r.integers(0, top, n)).tolist() for top in (2, 1000, 2**50) for n in (1, 64, 513, 5000)]
    for values in cases:
        data = token_files.EliasFano.of(np.array(values, np.uint64)).to_bytes()
        e = token_files.EliasFano.from_bytes(memoryview(data))
        assert e.all().tolist() == values
        some = r.integers(0, len(values), 20) if values else np.empty(0, np.int64)
        assert e.get(some).tolist() == [values[i] for i in some]
    gaps = np.cumsum(r.integers(1, 2000, 200_000))
    assert len(token_files.EliasFano.of(gaps).to_bytes()) < 200_000 * 14 / 8  # 2 + 10 bits and the directory


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(pieces.model_path("word_bpe_49k.json"))


@pytest.mark.parametrize("sizes", [{}, {"file_bytes": 60_000, "segment_ids": 500}])
def test_token_files_hold_what_the_library_encodes(spark, tmp_path, monkeypatch, sizes):  # noqa: F811
    rows, df = frame(spark, odd_texts())
    if sizes:  # several segments per file
        monkeypatch.setattr(token_files, "text_slices", lambda c, most: common.text_slices(c, 2000))
    lib = library()
    path = token_files.write_token_files(df, str(tmp_path / "ids"), **sizes)
    out = token_files.read_token_files(spark, path).orderBy("start").collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    assert [x.doc_id for x in out] == sorted((i for i, _ in rows if i is not None)) + [None, None]
    start = 0
    for x in out:
        assert x.start == start and x.n_tokens == len(x.ids)
        assert x.ids in want[x.doc_id]
        want[x.doc_id].remove(x.ids)
        start += x.n_tokens
    assert not any(want.values())
    found = token_files.find_documents(spark, path, [5, 11, 999_999, -40]).collect()
    assert sorted((x.doc_id, x.ids) for x in found) == sorted((x.doc_id, x.ids) for x in out if x.doc_id in (5, 11, -40))
    raw = b"".join(open(os.path.join(path, f), "rb").read() for f in os.listdir(path) if f.startswith("part-"))
    assert raw.count(token_files.MAGIC) >= (1 if not sizes else 8) and len(raw) < 2 * start + 20_000 + 300 * raw.count(token_files.MAGIC)


def test_token_files_of_an_empty_table(spark, tmp_path):  # noqa: F811
    _, df = frame(spark, [])
    path = token_files.write_token_files(df.limit(0), str(tmp_path / "ids"))
    assert token_files.read_token_files(spark, path).count() == 0


def test_slices_do_not_change_the_ids():
    import pyarrow as pa
    texts, lib = odd_texts(seed=8), library()
    enc = token_files._Encoder(pieces.model_path("word_bpe_49k.json"), most=50)
    for a, b in common.text_slices(pa.array(texts), 300):
        ids, n = enc(pa.array(texts[a:b], pa.string()), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in texts[a:b]]


def test_token_query_digests(spark):  # noqa: F811
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    lib, start = library(), 0
    got = {x.doc_id: x for x in token_files.query(spark, SF001).collect()}
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = [*lib.encode(docs[i] or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
