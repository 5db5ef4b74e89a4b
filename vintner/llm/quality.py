r"""Quality classifier: hierarchical empirical Bayes.

Evidence of a document: log odds of the terms it contains (words, and buckets of
its shape: case, symbols, repetition) between labelled bad and good documents,
for low quality and for toxicity. Only terms whose odds are high and significant
count.

Sites: a document's host (``source``) and path (``source`` and ``lang``) have
their own rates of bad documents. Soft counts from the evidence of all documents
are summed per path; the host's rate is shrunk toward the global rate, the
path's toward its host's, with a prior strength of each level estimated from the
spread of its rates (method of moments). Sparse sites thus stay near the global prior. The
posterior of a document joins its path's prior odds and its evidence.

The evidence is fitted on a bounded sample of the labelled rows (``fit_rows``);
rates, posteriors and decisions cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vintner.session import materialize

from .common import fresh_names, mix, quoted, read, text_slices, word_codes
from .jaccard_join import shingle_sets

TARGETS = ("junk", "toxic")
_SHAPE = "\t"  # starts the terms of shape: no word holds it


def _word_stats(vocab: list[str]) -> np.ndarray:
    """Per distinct word, without one closing mark: characters, upper case
    letters, characters neither letter nor digit, and whether symbols end it."""
    out = np.zeros((len(vocab), 4), np.int64)
    for i, w in enumerate(vocab):
        if len(w) > 1 and w[-1] in ".,;:!?" and w[-2].isalnum():
            w = w[:-1]
        sym = 0 if w.isalnum() else sum(not c.isalnum() for c in w)
        out[i] = (len(w), 0 if w.islower() else sum(c.isupper() for c in w), sym, sym > 0 and not w[-1].isalnum())
    return out


def _shape_terms(codes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, vocab: list[str]) -> list[np.ndarray]:
    """Bucket of each shape feature for every document: shares of upper case, of
    symbols and of words that end in symbols, distinct words, repeats of the
    word before."""
    n, docs = np.maximum(sizes, 1), len(sizes)
    stats = _word_stats(vocab)[codes] if len(codes) else np.zeros((0, 4), np.int64)
    chars, upper, symbol, noisy = (np.bincount(owner, stats[:, k], docs) for k in range(4))
    chars = np.maximum(chars, 1)
    pair = np.unique(owner * max(len(vocab), 1) + codes) if len(codes) else np.empty(0, np.int64)
    distinct = np.bincount(pair // max(len(vocab), 1), minlength=docs)
    again = np.bincount(owner[1:], (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]), docs) if len(codes) else np.zeros(docs)
    # a text of n running words has about n ** 0.8 distinct ones; repetition has far fewer
    variety = np.where(n >= 16, distinct / n**0.8, 1.9)
    return [np.floor(np.minimum(v, 1.999) * g).astype(np.int64) for v, g in
            ((upper / chars, 6), (symbol / chars, 12), (noisy / n, 6), (variety, 8), (again / n, 12))]


def _distinct_terms(texts: pa.Array):
    """Terms of every text, each once: (owner, term) pairs, the terms (words
    without case and closing punctuation, and word beginnings of four letters),
    and the shape buckets."""
    codes, sizes, raw = word_codes(texts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ids: dict[str, int] = {}
    of = np.full((len(raw), 2), -1, np.int64)
    for i, v in enumerate(raw):
        v = v.lower().strip(".,;:!?")
        of[i, 0] = ids.setdefault(v, len(ids))
        if len(v) > 4:
            of[i, 1] = ids.setdefault(v[:4] + "\n", len(ids))  # no word ends in a line break
    both = of[codes] if len(codes) else np.empty((0, 2), np.int64)
    pair = np.unique((owner[:, None] * max(len(ids), 1) + both)[both >= 0]) if len(codes) else np.empty(0, np.int64)
    return pair // max(len(ids), 1), pair % max(len(ids), 1), list(ids), _shape_terms(codes, owner, sizes, raw)


class Evidence:
    """Log odds per term for each target; rows score the sum over their terms."""

    def __init__(self, weights: dict[str, tuple[float, float]], shape: dict[tuple[int, int], tuple[float, float]], prior: tuple[float, float]):
        self.weights, self.shape, self.prior = weights, shape, prior

    def score(self, texts: pa.Array) -> np.ndarray:
        """(rows, 2): worked out for slices of a few MB of text at a time."""
        parts = [self._score(texts[a:b]) for a, b in text_slices(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, 2))

    def _score(self, texts: pa.Array) -> np.ndarray:
        owner, term, names, shapes = _distinct_terms(texts)
        w = np.array([self.weights.get(v, (0.0, 0.0)) for v in names] or [(0.0, 0.0)])
        hot = (w != 0).any(axis=1)[term] if len(term) else np.empty(0, bool)
        out = np.stack([np.bincount(owner[hot], w[term[hot], t], len(texts)) for t in range(2)], axis=1).astype(float)
        for k, bucket in enumerate(shapes):
            seen, where = np.unique(bucket, return_inverse=True)
            if len(seen):
                out += np.array([self.shape.get((k, int(b)), (0.0, 0.0)) for b in seen])[where]
        return out


def _least_shingles(texts: pa.Array, keys: int = 3) -> np.ndarray:
    """Smallest hashes of each text's five-word shingles under ``keys`` mixings:
    near copies share most of them."""
    out = np.zeros((len(texts), keys), np.int64)
    for i, s in enumerate(shingle_sets(texts, 5)):
        for k in range(keys if s is not None else 0):
            out[i, k] = mix(s ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))).min().view(np.int64)
    return out


def fit_evidence(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, least_g: float = 30.0,
                 least_odds: float = 3.0, least_docs: int = 3) -> Evidence:
    """Fit on about ``fit_rows`` labelled documents (all, if fewer), chosen by
    hash of the id; of near copies among them one counts. A word or beginning
    counts as evidence if its log odds reach ``least_odds`` and the likelihood
    ratio statistic of its counts ``least_g``, and it is in ``least_docs`` bad
    documents; how many terms do is bounded by the words of those rows alone. A
    shape bucket needs ``least_g`` and odds of 1."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL") \
        .groupBy("doc_id").agg((1 - F.min("quality")).alias("junk"), F.max("toxic").alias("toxic"))
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, fit_rows / max(n, 1)))
    known = docs.select("doc_id", "text").where(part).join(labels.where(part), "doc_id")

    def keyed(batches):
        for b in batches:
            for i, j in text_slices(b.column(1)):
                part = b.slice(i, j - i)
                k = _least_shingles(part.column(1))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(k[:, c]) for c in range(3))], ["doc_id", "text", "junk", "toxic", "k0", "k1", "k2"])

    known = materialize(known.mapInArrow(keyed, "doc_id long, text string, junk int, toxic int, k0 long, k1 long, k2 long"), "labelled")
    one = known.groupBy("k0").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("d")).select("d.*") \
        .groupBy("k1").agg(F.min(F.struct("doc_id", "k2")).alias("d")).select("d.*").groupBy("k2").agg(F.min("doc_id").alias("doc_id"))
    known = known.join(one.select("doc_id"), "doc_id", "left_semi").select("text", "junk", "toxic")

    def terms(batches):
        slices = (batch.slice(a, b - a) for batch in batches for a, b in text_slices(batch.column(0)))
        for batch in slices:
            owner, term, names, shapes = _distinct_terms(batch.column(0))
            state = np.asarray(batch.column(1)) + 2 * np.asarray(batch.column(2))
            count = np.zeros((len(names) + 1, 4), np.int64)
            np.add.at(count, (term, state[owner]), 1)
            rows: dict[tuple[str, int], int] = {}
            for i, s in zip(*np.nonzero(count)):
                rows[names[i], int(s)] = int(count[i, s])
            for k, bucket in enumerate(shapes):
                for key in zip(bucket.tolist(), state.tolist()):
                    key = (f"{_SHAPE}{k}:{key[0]}", key[1])
                    rows[key] = rows.get(key, 0) + 1
            for s in state.tolist():
                rows[_SHAPE, s] = rows.get((_SHAPE, s), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.int32()),
                                              pa.array(rows.values(), pa.int64())], ["term", "state", "n"])

    def total(*states):
        return F.sum(F.when(F.col("state").isin(*states), F.col("n")).otherwise(0))

    counts = known.mapInArrow(terms, "term string, state int, n long").groupBy("term") \
        .agg(total(1, 3).alias("junk"), total(2, 3).alias("toxic"), total(0).alias("good"), F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1"), "terms")
    whole = counts.where(F.col("term") == _SHAPE).first()
    if whole is None or not whole["good"] or not (whole["junk"] or whole["toxic"]):
        return Evidence({}, {}, (-4.0, -4.0))
    for t in TARGETS:
        bad, good = whole[t], whole["good"]
        a, b = F.col(t), F.col("good")
        share = (a + b) / float(max(bad + good, 1))

        def part_of(observed, expected):
            return F.when(observed > 0, 2 * observed * F.log(observed / expected)).otherwise(0.0)

        g = part_of(a, share * bad) + part_of(b, share * good) + part_of(bad - a, (1 - share) * bad) + part_of(good - b, (1 - share) * good)
        odds = F.log((a + 0.5) / (bad + 1.0)) - F.log((b + 0.5) / (good + 1.0))
        counts = counts.withColumns({f"lo_{t}": odds, f"g_{t}": g if bad else F.lit(0.0)})
    is_shape = F.col("term").startswith(_SHAPE)
    strong = {t: (F.col(f"g_{t}") >= least_g) & (F.col(f"lo_{t}") >= least_odds) & (F.col(t) >= least_docs) for t in TARGETS}
    words = counts.where(~is_shape & (strong["junk"] | strong["toxic"])).withColumns({f"is_{t}": strong[t] for t in TARGETS}) \
        .collect()  # bounded by the words of fit_rows texts
    shapes = counts.where(is_shape & (F.col("term") != _SHAPE)).collect()  # bounded by the buckets
    weights = {r["term"]: tuple(float(r[f"lo_{t}"]) if r[f"is_{t}"] else 0.0 for t in TARGETS) for r in words}
    shape = {tuple(map(int, r["term"][1:].split(":"))): tuple(float(r[f"lo_{t}"]) if r[f"g_{t}"] >= least_g and abs(r[f"lo_{t}"]) >= 1.0 else 0.0 for t in TARGETS) for r in shapes}
    every = whole["n"]
    prior = tuple(float(np.log((whole[t] + 1) / (every - whole[t] + 1))) for t in TARGETS)
    return Evidence(weights, shape, prior)


_LO = ", ".join(f"lo_{t} double" for t in TARGETS)


def evidence_of(docs: DataFrame, evidence: Evidence) -> DataFrame:
    """(doc_id, source, lang) and the evidence for each target."""
    def run(batches):
        for batch in batches:
            s = evidence.score(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s[:, 0]), pa.array(s[:, 1])],
                                             ["doc_id", "source", "lang", *(f"lo_{t}" for t in TARGETS)])

    return docs.select(quoted("doc_id").cast("long").alias("doc_id"), "source", "lang", "text") \
        .mapInArrow(run, f"doc_id long, source string, lang string, {_LO}")


def _strength(noise: float, between: float, groups: int, rows: int) -> float:
    """Prior strength of a level by the method of moments: ``between`` is the
    sum of squares of its rates around the level above, of which sampling noise
    alone would give ``noise`` for each of the ``groups``."""
    spread = max((between - noise * groups) / max(rows, 1), 1e-6)
    return float(min(max(noise / spread - 1, 20.0), 1e4))


def site_priors(scored: DataFrame, evidence: Evidence) -> DataFrame:
    """(source, lang) and the prior log odds of each target at that path. Hosts
    shrink toward the global rate by the spread of the hosts, paths toward their
    host by the spread of the paths within hosts. All sums are exact decimals,
    so reruns agree to the bit."""
    def p(t):
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(f"lo_{t}") + evidence.prior[TARGETS.index(t)]))))

    exact = "decimal(38,12)"
    sums = [F.sum(p(t).cast("decimal(28,12)")).cast(exact).alias(f"bad_{t}") for t in TARGETS]
    path = materialize(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), *sums), "paths")
    squares = {t: (F.col(f"bad_{t}").cast("double") * F.col(f"bad_{t}").cast("double") / F.col("n")).cast(exact) for t in TARGETS}
    host = path.groupBy("source").agg(F.sum("n").alias("hn"), F.count("*").alias("paths"), *(F.sum(f"bad_{t}").alias(f"host_{t}") for t in TARGETS),
                                      *(F.sum(squares[t]).alias(f"in_{t}") for t in TARGETS))
    host = host.withColumns({f"host_{t}": F.col(f"host_{t}").cast("double") for t in TARGETS})
    own = {t: (F.col(f"host_{t}") * F.col(f"host_{t}") / F.col("hn")).cast(exact) for t in TARGETS}
    one = host.agg(F.sum("hn").alias("n"), F.count("*").alias("hosts"), F.sum("paths").alias("paths"),
                   *(F.sum(F.col(f"host_{t}").cast(exact)).cast("double").alias(t) for t in TARGETS),
                   *(F.sum(own[t]).cast("double").alias(f"sq_{t}") for t in TARGETS),
                   *(F.sum(F.col(f"in_{t}")).cast("double").alias(f"in_{t}") for t in TARGETS)).first()
    total = max(one["n"] or 0, 1)
    out = path.join(host.drop("paths", *(f"in_{t}" for t in TARGETS)).withColumnRenamed("source", "h"), F.col("source").eqNullSafe(F.col("h")))
    for t in TARGETS:
        mean = min(max((one[t] or 0.0) / total, 1e-4), 1 - 1e-4)
        noise = mean * (1 - mean)
        hosts, paths = one["hosts"] or 0, one["paths"] or 0
        of_host = _strength(noise, (one[f"sq_{t}"] or 0.0) - total * mean**2, hosts, total)
        of_path = _strength(noise, (one[f"in_{t}"] or 0.0) - (one[f"sq_{t}"] or 0.0), paths - hosts, total)
        host_rate = (F.col(f"host_{t}") + of_host * mean) / (F.col("hn") + of_host)
        rate = (F.col(f"bad_{t}").cast("double") + of_path * host_rate) / (F.col("n") + of_path)
        out = out.withColumn(f"prior_{t}", F.log(rate / (1 - rate)))
    return materialize(out.select("source", "lang", *(f"prior_{t}" for t in TARGETS)), "priors")


def _decided(scored: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds the posteriors and ``keep``: neither reaches one half."""
    priors = priors.withColumnRenamed("source", "s_").withColumnRenamed("lang", "l_")
    out = scored.join(priors, F.col("source").eqNullSafe(F.col("s_")) & F.col("lang").eqNullSafe(F.col("l_")))
    for t in TARGETS:
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(f"lo_{t}") + F.col(f"prior_{t}"))))))
    return out.withColumn("keep", (F.col("p_junk") < 0.5) & (F.col("p_toxic") < 0.5)).drop("s_", "l_")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, source, lang, p_junk, p_toxic, keep), one row per document.

    Null and empty texts have the evidence of no words, very long texts that of
    all their words; null source and lang are sites of their own; equal rows all
    come back. Labels without id or value are
    ignored; a document labelled twice takes the worse label; without labelled
    good and bad documents everything is kept. Extra columns are ignored; an
    empty table gives an empty result.
    """
    evidence = fit_evidence(docs, labels, fit_rows)
    scored = materialize(evidence_of(docs, evidence), "evidence")
    return _decided(scored, site_priors(scored, evidence)).select("doc_id", "source", "lang", *(f"p_{t}" for t in TARGETS), "keep")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: quality of all documents."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")) \
        .withColumns({f"p_{t}": F.round(f"p_{t}", 6) for t in TARGETS})


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows the classifier keeps, with the columns they came
    with (any others may be there, under any name). The evidence is taken twice,
    for the rates and for the decision, so the texts need no shuffle.

    Null and empty texts are judged by their site and the evidence of no words;
    null source and lang are a site of their own; repeated rows share one
    decision; very long texts are scored whole; an empty table stays empty.
    """
    evidence = fit_evidence(docs, read(spark, sf_dir, "labels"))
    site, path, *odds = fresh_names(docs.columns, "site", "path", *(f"odds_{t}" for t in TARGETS))
    priors = site_priors(materialize(evidence_of(docs, evidence), "evidence"), evidence).toDF(site, path, *odds)
    joined = docs.join(priors, quoted("source").eqNullSafe(F.col(site)) & quoted("lang").eqNullSafe(F.col(path)))

    columns = docs.columns
    text, n = columns.index("text"), len(columns)

    def run(batches):
        for batch in batches:
            prior = np.stack([np.asarray(c) for c in batch.columns[n:]], axis=1)
            keep = (evidence.score(batch.column(text)) + prior < 0).all(axis=1)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], columns).filter(pa.array(keep))

    # by place: mapInArrow takes no names with dots
    joined = joined.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate([*columns, *odds])))
    return joined.mapInArrow(run, docs.schema)
