r"""PII by candidate gradient boosting.

Exact base patterns (e-mail, IP, card, phone) always count. High-recall
generators propose further, overlapping spans: numbers and addresses in looser
formats. Boosted trees score them by format and context features; a threshold
calibrated on held-out candidates selects those that are added. Spans are code
point positions, end exclusive.

Candidates that provably fail a check of their kind (``fails``) are dropped by
that rule. The trees decide about the rest, so they are fitted and calibrated on
candidates that pass it: loosened copies of base matches, where they stand or
behind a word that announces their kind, are positive; the same formats behind
words that announce something else (orders, serial numbers, prices, versions,
places) are negative. The examples come from a bounded sample of the documents
(``sample_docs``, by hash of the id) and the fit runs on the driver. Candidates
that occur in the documents themselves have no label.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import quoted, read, text_slices

KINDS = ("email", "ip", "card", "phone")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]", re.I)
_AT = re.compile(r"[@Aa](?:(?<=@)|(?<=\b[Aa])[Tt]\b)")    # in every match of _EMAIL
_LEAD = re.compile(r"\s?(?:[\[({]\s?)?\Z")
_EMAIL, _SIGNED = (re.compile(r"[A-Za-z0-9._%+-]+\s?(?:[\[({]\s?at\s?[\])}]|" + word + r"@)\s?[A-Za-z0-9-]+"
                              r"(?:\s?(?:[\[({]\s?dot\s?[\])}]|\bdot\b|\.)\s?[A-Za-z0-9-]+)+", re.I) for word in (r"\bat\b|", ""))
_DIGIT = re.compile(r"[0-9]")

_WIDE = (
    ("ip", re.compile(r"[0-9]{1,5}(?:\s?[.:]\s?[0-9]{1,5}){3,4}")),
    ("card", re.compile(r"[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}")),
    ("phone", re.compile(r"\+?\(?[0-9]{1,4}\)?(?:[\x20./()-]{1,2}[0-9]{2,4}){2,5}")),
)
# fixed values: words that announce a kind, looked for shortly before a span
_CONTEXT = ("mail", "contact", "ip", "host", "card", "visa", "phone", "tel", "call", "fax", "version", "date", "id")
# fixed values: words that announce something else than personal data
_OTHER = ("order", "serial", "invoice", "part", "price", "total", "isbn", "version", "build", "seat", "section", "score", "shop", "meet", "sale")
# fixed values: what stands before a span of each kind, when it is announced
_ANNOUNCED = {"email": ("mail me: ", "contact ", "write to "), "ip": ("host ", "ip ", "from address "),
              "card": ("card ", "visa ", "paid with "), "phone": ("phone ", "call ", "tel. ")}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns that pass their checks, by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        # leftmost: the whole run of local characters before the sign
        start = max(last, at)
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def loose_emails(text: str, pattern: re.Pattern = _EMAIL) -> list[tuple[int, int]]:
    """The spans of the pattern, looked for from each sign or word "at": a match starts
    where the run of local characters before it starts."""
    out, last, tried = [], 0, -1
    for m in _AT.finditer(text):
        if m.start() < last:
            continue
        start = end = _LEAD.search(text, max(last, m.start() - 3), m.start()).start()
        while start > last and start != tried and _LOCAL.match(text, start - 1):
            start -= 1
        if start == end:
            continue
        # a run that an earlier sign was in has been tried from its start
        found, tried = None if start == tried else pattern.match(text, start), end - 1
        if found:
            out.append(found.span())
            last = found.end()
    return out


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Wider candidates that overlap no base span of their kind."""
    mails = loose_emails(text)
    if mails:  # "me at jane.doe (at) example.org": the plain word may take the name
        mails = sorted({*mails, *loose_emails(text, _SIGNED)})
    found = [("email", a, b) for a, b in mails]
    if _DIGIT.search(text):
        found += [(kind, *m.span()) for kind, pattern in _WIDE for m in pattern.finditer(text)]
    taken = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    return [(kind, a, b) for kind, a, b in found if all(b <= x or y <= a for x, y in taken[kind])]


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    span, before = text[a:b], text[max(0, a - 24):a].lower()
    d = _digits(span)
    runs = [len(r) for r in re.findall(r"[0-9]+", span)]
    values = [int(r) for r in re.findall(r"[0-9]{1,6}", span)]
    letters = sum(c.isalpha() for c in span)
    prev, after = text[a - 1:a], text[b:b + 1]
    return [KINDS.index(kind), len(d), letters, b - a, len(runs), max(runs, default=0), min(runs, default=0), float(luhn(d)) if d else 0.0,
            max(values, default=0), float(span.startswith("+")), sum(c in "()" for c in span), span.count("."), span.count("-") + span.count("/"),
            span.count(" "), float("@" in span), float(" at " in span.lower() or "at]" in span.lower() or "at)" in span.lower()),
            sum(c in "[({" for c in span), float(". " in span or ".\n" in span),
            float(prev.isalnum()), float(after.isalnum()), float(prev in tuple("=\"'#:")), *(float(w in before) for w in _CONTEXT),
            float(any(w in before for w in _OTHER)), float(any(w in span.lower() for w in _OTHER)), float(" dot " in span.lower()),
            float("(" in span or "[" in span or "{" in span)]


_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}(?![0-9])")
_PROSE = re.compile(r"\s?\bat\b[^@\[({]*?\.\s", re.I)
_TOP = re.compile(r"[A-Za-z]{2,}\Z")


def fails(text: str, kind: str, a: int, b: int, base: list[tuple[str, int, int]]) -> bool:
    """Whether a wide candidate can't be of its kind: a wrong number of digits, a
    wrong check digit, an octet over 255, a date, no top-level name, the end of a
    sentence after the word "at", or part of a base span of another kind."""
    span = text[a:b]
    d = _digits(span)
    if any(k != kind and x < b and a < y for k, x, y in base):
        return True
    if kind == "email":
        return not _TOP.search(span) or "@" not in span and bool(_PROSE.search(span))
    if kind == "ip":
        parts = re.split(r"\s?[.:]\s?", span)
        return span.count(":") > len(parts) - 4 or any(int(v) > 255 for v in parts[:4])
    if kind == "card":
        return not 13 <= len(d) <= 19 or not luhn(d)
    return not 9 <= len(d) <= 15 or bool(_DATE.match(span))


def _loosened(span: str, kind: str) -> list[str]:
    """A base match in looser formats."""
    d = _digits(span)
    if kind == "email":
        user, host = span.rsplit("@", 1)
        return [f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} at {host.replace('.', ' dot ')}",
                f"{user} (at) {host}", f"{user} [at] {host}", f"{user} @ {host}"]
    if kind == "ip":
        return [" . ".join(span.split(".")), " .".join(span.split("."))]
    if kind == "card":
        return ["/".join(d[k:k + 4] for k in range(0, len(d), 4)), ".".join(d[k:k + 4] for k in range(0, len(d), 4))]
    return [span[1:], f"({d[1:4]}) {d[4:7]}-{d[7:]}", f"{d[1:4]}.{d[4:7]}.{d[7:]}"]


def _examples(text: str, kind: str, a: int, b: int, rng: random.Random) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of rule-passing candidates made from a base
    match: its looser formats where it stands, announced, and behind words that
    announce something else; for addresses also a place after "at"."""
    out, span = [], text[a:b]
    if kind == "email" and rng.random() < 0.5:  # names and hosts without digits, too
        span = re.sub(r"[0-9]+(?=[^@]*@)|(?<=[a-z])[0-9]+(?=\.)", "", span, flags=re.I)
        span = span if base_spans(span) else text[a:b]
    for s in _loosened(span, kind):
        other = rng.choice(_OTHER) + rng.choice((" ", " no ", " number ", ": ", " #"))
        for before, label in ((text[max(0, a - 24):a], 1), (rng.choice(_ANNOUNCED[kind]), 1), (other, 0)):
            if label and any(w in before.lower() for w in _OTHER):
                continue  # stands behind such a word already: no telling
            if kind == "email" and not label:
                s = f"{rng.choice(_OTHER)}{rng.choice(('', '', str(rng.randrange(100))))} at {span.rsplit('@', 1)[1]}"
                before = rng.choice(("we ", "see you, ", "the ", ""))
            t = text[:max(0, a - 24)] + before + s + text[b:]
            at = max(0, a - 24) + len(before)
            out.append((t, at, at + len(s), label))
    return [(t, x, y, label) for t, x, y, label in out if not fails(t, kind, x, y, [])]


class Boosted:
    """Gradient-boosted trees for the logistic loss, on quantile cuts."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, cut_points: int = 24, least: int = 8):
        self.n, self.depth, self.rate, self.cut_points, self.least = trees, depth, rate, cut_points, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cut_points + 1)[:-1])) for f in range(x.shape[1])]
        score = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, x, edges, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    def _grow(self, tree, x, edges, g, h, rows, depth) -> int:
        at = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, self.rate * total_g / (total_h + 1.0), 0, 0))
        best = (1e-6, None)
        for f, cuts_ in enumerate(edges if depth else ()):
            v = x[rows, f]
            for c in cuts_[1:]:
                left = v < c
                n = int(left.sum())
                if min(n, len(rows) - n) < self.least:
                    continue
                gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                gain = gl**2 / (hl + 1) + (total_g - gl)**2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, (f, float(c), left))
        if best[1]:
            f, c, left = best[1]
            a = self._grow(tree, x, edges, g, h, rows[left], depth - 1)
            b = self._grow(tree, x, edges, g, h, rows[~left], depth - 1)
            tree[at] = (f, c, 0.0, a, b)
        return at

    def _tree(self, tree, x) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        f, c, v, a, b = (np.array(z) for z in zip(*tree))
        for _ in range(self.depth):
            inner = f[node] >= 0
            go = x[np.arange(len(x)), np.maximum(f[node], 0)] < c[node]
            node = np.where(inner, np.where(go, a[node], b[node]), node)
        return v[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(self._tree(t, x) for t in self.trees))))


class Detector:
    """Base patterns plus the trees' choice among wider candidates. Without both
    positive and negative examples only the base patterns apply."""

    def __init__(self, rows: list[list[float]], labels: list[int], precision: float = 0.995, least_threshold: float = 0.9):
        x, y = np.array(rows, float).reshape(len(rows), -1), np.array(labels, float)
        self.model, self.threshold = None, 1.0
        fold = np.arange(len(y)) % 4 == 3
        if len(y) < 40 or not 0 < y[~fold].sum() < (~fold).sum() or not 0 < y[fold].sum() < fold.sum():
            return
        self.model = Boosted().fit(x[~fold], y[~fold])
        p, held = self.model.score(x[fold]), y[fold]
        order = np.argsort(-p)
        right = np.cumsum(held[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        self.threshold = max(least_threshold, float(p[order][good[-1]])) if len(good) else 1.1

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        bases = [base_spans(t) for t in texts]
        out = [[(k, a, b, True) for k, a, b in base] for base in bases]
        if self.model:
            wide = [(i, *c) for i, t in enumerate(texts) for c in proposals(t, bases[i]) if not fails(t, *c, bases[i])]
            if wide:
                p = self.model.score(np.array([features(texts[i], k, a, b) for i, k, a, b in wide], float))
                for (i, k, a, b), q in zip(wide, p.tolist()):
                    if q >= self.threshold:
                        out[i].append((k, a, b, False))
        for s in out:
            s.sort(key=lambda v: (KINDS.index(v[0]), v[1], v[2]))
        return out


def fit_detector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000,
                 sample_spans: int = 20_000) -> Detector:
    """Fit on candidates of about ``sample_docs`` documents (all, if fewer),
    ``sample_spans`` of them at most."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    n = rows.count()
    keep = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * min(1.0, sample_docs / max(n, 1)))).where("text RLIKE '[0-9@]'")
    width = len(features("1", "ip", 0, 1))

    def examples(batches):
        for batch in batches:
            x, y = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = random.Random(f"{i}")
                for k, a, b in base_spans(t):
                    for made, p, q, label in _examples(t[max(0, a - 200):b + 200], k, a - max(0, a - 200), b - max(0, a - 200), rng):
                        x.append(features(made, k, p, q)), y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    got = keep.mapInArrow(examples, "y long, x array<double>").orderBy(F.xxhash64("x", "y"), "y").limit(sample_spans).collect()
    return Detector([list(r["x"]) for r in got] or [[0.0] * width], [r["y"] for r in got] or [0])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array<struct<kind, start, end, base>>) of every whole text,
    by kind (email, ip, card, phone), then start.

    Null text has no spans; equal rows all come back; extra columns are ignored;
    an empty table gives an empty result.
    """
    detector = detector or fit_detector(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in row] for row in detector.spans(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, _SPANS)], ["id", "spans"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")) \
        .mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Text with each span (overlapping ones together) replaced by its kind."""
    out, at, end = [], 0, -1
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same rows and columns (any others may be there, under
    any name) with found spans replaced by [EMAIL], [IP], [CARD], [PHONE], and
    n_chars of the new text. A null text stays null; repeated rows all stay;
    very long texts are searched whole; an empty table stays empty."""
    detector = fit_detector(docs)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, columns)
            for a, b in text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                hits = [None if t is None else redact(t, s) if s else t for t, s in zip(texts, detector.spans([t or "" for t in texts]))]
                yield part.set_column(at, "text", pa.array(hits, part.column(at).type))

    # by place: mapInArrow takes no names with dots
    out = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, docs.schema)
    if "n_chars" not in columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))) \
        .select(*map(quoted, columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: personal data in all documents."""
    out = find_pii(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(F.col("id").alias("doc_id"),
                      *map(count, KINDS),
                      F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
