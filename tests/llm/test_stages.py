"""Pipeline stages on tables with clashing and dotted columns, nulls, repeated
rows, very long texts and no rows at all."""

import collections
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF001, spark  # noqa: E402,F401

from vintner.llm import common, jaccard_join, mixing, pieces, pii, quality  # noqa: E402

CLASH = ["copies", "rows", "k1", "K2", "s_", "l_", "site", "path", "odds_junk", "prior_junk_", "number", "each_", "a.b", "size", "src", "id", "block"]


def documents(spark):  # noqa: F811
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["al", "be", "ga", "de"]) for _ in range(r.choice([0, 1, 30]))), r.choice(["en", None]), r.choice(["a", "b", None])) for i in range(60)]
    rows += [(None, "x y", "en", "a"), (70, None, None, None), (71, "", "en", "b"), (72, "long text " * 60_000, "en", "b"), (73, "z" * 20_000, "en", "b")]
    rows += [rows[3], rows[3], rows[-5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(f"value of {c}").alias(c) for c in CLASH))


@pytest.mark.parametrize("stage", [quality.filter_stage, jaccard_join.keep_first, pii.redact_stage, mixing.mix_stage, pieces.encode_stage])
def test_stage_takes_any_columns(spark, stage):  # noqa: F811
    docs = documents(spark)
    out = stage(spark, docs, SF001)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF001).count() == 0
    if stage is pieces.encode_stage:
        assert len(rows) == docs.count()
        return
    assert out.columns == docs.columns
    assert all(x[c] == f"value of {c}" for x in rows for c in CLASH)
    if stage is quality.filter_stage:  # equal rows share one decision, and the null id is judged too
        n = collections.Counter(map(str, docs.collect()))
        assert all(k == n[x] for x, k in collections.Counter(map(str, rows)).items())


def test_scores_of_slices_equal_those_of_the_whole(spark, monkeypatch):  # noqa: F811
    import pyarrow as pa
    texts = pa.array([r.text for r in documents(spark).collect()])
    evidence = quality.Evidence({"al": (1.5, 0.25), "text": (0.5, 2.0)}, {(3, 1): (0.125, 1.0)}, (-1.0, -1.0))
    whole = evidence._score(texts)
    monkeypatch.setattr(quality, "text_slices", lambda c: common.text_slices(c, 100))
    assert (evidence.score(texts) == whole).all() and (whole != 0).any()
    assert evidence.score(texts[:0]).shape == (0, 2)


def test_strength_follows_the_spread():
    assert quality._strength(0.09, 0.09 * 10, 10, 1000) == 1e4         # only sampling noise: trust the level above
    assert quality._strength(0.09, 80.0, 10, 1000) == 20.0             # rates far apart: trust the site
    assert 20 < quality._strength(0.09, 3.0, 10, 1000) < 1e4


def test_paths_shrink_by_their_own_spread(spark):  # noqa: F811
    """Hosts alike, paths within them far apart: a path keeps its own rate."""
    rows = []
    for host in "abcd":
        for lang, bad in (("en", 0.9), ("fr", 0.1)):
            rows += [(i, host, lang, 6.0 if i < bad * 500 else -6.0, -6.0) for i in range(500)]
    scored = spark.createDataFrame(rows, "doc_id long, source string, lang string, lo_junk double, lo_toxic double")
    priors = {(x.source, x.lang): x.prior_junk for x in quality.site_priors(scored, quality.Evidence({}, {}, (0.0, 0.0))).collect()}
    assert all(priors[h, "en"] > 1.5 and priors[h, "fr"] < -1.5 for h in "abcd")


def test_toxic_recall_on_held_out_labels(spark):  # noqa: F811
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4))
    out = quality.classify(docs, labels.where(part > 0)).join(labels.where(part == 0), "doc_id").collect()
    toxic = [x for x in out if x.toxic == 1]
    assert len(toxic) >= 5 and sum(not x.keep for x in toxic) >= 0.8 * len(toxic)  # fitted on about 40 toxic rows
