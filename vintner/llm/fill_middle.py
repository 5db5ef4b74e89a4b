r"""Fill-in-middle transformation over a wavelet matrix of character classes.

The bytes of a slice of texts are mapped to eight classes (line break, sentence
mark, other space, digit, ASCII letter, other ASCII, first byte and later byte
of a longer code point) and held as a wavelet matrix: three bit vectors with a
rank directory. All counts come from it: the units of a document are a sum of
ranks at its two ends, its code points are its bytes less the rank of the later
bytes. A cut after k units is ``select`` where one class ends a unit, and
bisection on the summed ranks where several do. One matrix serves all documents
of a slice, and all their cuts are located together.

A document's cuts and form follow from the hash of its id, so the work is map
only: no shuffle, and the same result under any partitioning.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import quoted, read, select_in_words, text_slices

# markers before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

LINE, MARK, SPACE, DIGIT, LETTER, OTHER, FIRST, LATER = range(8)
# classes whose characters end a unit
UNITS = {"line": (LINE,), "sentence": (LINE, MARK)}


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0], table[0xC0:] = LATER, FIRST
    for c in range(0x80):
        if chr(c).isalpha():
            table[c] = LETTER
        elif chr(c).isdigit():
            table[c] = DIGIT
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    table[[ord(c) for c in ".!?"]] = MARK
    table[0x0A] = LINE
    return table


_CLASSES = _class_table()


class Bits:
    """A bit vector with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros(-(-self.n // 64) * 64 + 64, bool)
        padded[:self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low).astype(np.int64)

    def select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero: the word by bisection on the
        directory, then the bit within it."""
        before = self.before if ones else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(before, k, "right") - 1
        value = self.words[word] if ones else ~self.words[word]
        return word * 64 + select_in_words(value, k - before[word])


class WaveletMatrix:
    """Rank and select of every symbol of a sequence over 2**levels symbols."""

    def __init__(self, symbols: np.ndarray, levels: int = 3):
        self.n, self.levels, self.bits, self.zeros = len(symbols), levels, [], []
        for level in range(levels - 1, -1, -1):
            one = (symbols >> level) & 1 == 1
            self.bits.append(Bits(one))
            self.zeros.append(int(self.n - np.count_nonzero(one)))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def _path(self, symbol: int):
        for i, bits in enumerate(self.bits):
            yield bits, self.zeros[i], bool(symbol >> (self.levels - 1 - i) & 1)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol among the first ``at`` places."""
        start, end = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for bits, zeros, one in self._path(symbol):
            if one:
                start, end = zeros + bits.rank(start), zeros + bits.rank(end)
            else:
                start, end = start - bits.rank(start), end - bits.rank(end)
        return end - start[0]

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) occurrence; it has to exist."""
        start = np.zeros(1, np.int64)
        path = list(self._path(symbol))
        for bits, zeros, one in path:
            start = zeros + bits.rank(start) if one else start - bits.rank(start)
        at = start[0] + np.asarray(k, np.int64)
        for bits, zeros, one in reversed(path):
            at = bits.select(at - zeros if one else at, one)
        return at


class Units:
    """Unit boundaries and code points of several texts, from one matrix."""

    def __init__(self, data: bytes, ends: np.ndarray, unit: str = "line"):
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1]])
        self.symbols = UNITS[unit]
        classes = _CLASSES[np.frombuffer(data, np.uint8)]
        self.matrix = WaveletMatrix(classes)
        size = self.ends - self.starts
        closed = np.zeros(len(ends), bool)
        closed[size > 0] = np.isin(classes[self.ends[size > 0] - 1], self.symbols)
        self.base = self._rank(self.starts)
        # the rest behind the last closing character is a unit of its own
        self.n = self._rank(self.ends) - self.base + ((size > 0) & ~closed)

    def _rank(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(s, at) for s in self.symbols)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Byte (in the joined texts) behind the first ``k`` units of each text."""
        inner = np.flatnonzero((k > 0) & (k < self.n))
        out = np.where(k > 0, self.ends, self.starts)
        nth = self.base[inner] + k[inner]  # this many closing characters lie before the cut
        if len(self.symbols) == 1:
            out[inner] = self.matrix.select(self.symbols[0], nth - 1) + 1
            return out
        low, high = self.starts[inner], self.ends[inner]
        while (low < high).any():  # least place with that rank
            middle = (low + high) // 2
            enough = self._rank(middle) >= nth
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        out[inner] = low
        return out

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return end - start - (self.matrix.rank(LATER, end) - self.matrix.rank(LATER, start))


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the SHA-256 of ``<seed>:<doc_id>``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def restore(output: str, form: str) -> str:
    """The text that ``fill_middle`` turned into ``output``: markers never occur
    in a text that is not plain and none overlaps itself, so each is found at its
    first place."""
    if form == "plain":
        return output
    head, _, rest = output[len(PREFIX if form == "psm" else SUFFIX):].partition(SUFFIX if form == "psm" else PREFIX)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


def fill_middle(docs: DataFrame, unit: str = "line", seed: str = "7", rate: int = 100, spm: int = 50,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every whole text cut
    into prefix, middle and suffix at unit borders and put out of order.

    ``unit``: ``line`` (ends with a line break) or ``sentence`` (ends with a line
    break or a sentence mark). ``rate`` per cent of the documents are
    transformed, of these ``spm`` per cent with the suffix first. Texts that are
    empty or hold a marker stay plain (null: empty; no counts of characters).
    Cuts follow from the hash of the id, so equal ids are cut alike, repeated
    rows all come back, and rows without id share the draws of the empty id. The
    rows are worked on in slices of a few MB; a longer text is held whole. Extra
    columns are ignored; an empty table gives an empty result.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}, got {unit!r}")

    def work(ids, texts):
        values = [t or "" for t in texts]
        raw = [t.encode() for t in values]
        data = b"".join(raw)
        units = Units(data, np.cumsum([len(r) for r in raw]), unit)
        draw = np.array([draws(seed, i) for i in ids], np.int64)
        a, b = draw[:, 0] % (units.n + 1), draw[:, 1] % (units.n + 1)
        one, two = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
        plain = np.array([not t or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in values], bool) | (draw[:, 2] % 100 >= rate)
        first = np.where(plain, "plain", np.where(draw[:, 3] % 100 < spm, "spm", "psm")).tolist()
        out = []
        for t, form, s, i, j, e in zip(values, first, units.starts.tolist(), one.tolist(), two.tolist(), units.ends.tolist()):
            if form == "plain":
                out.append(t)
                continue
            prefix, middle, suffix = data[s:i].decode(), data[i:j].decode(), data[j:e].decode()
            out.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
        return (pa.array(units.n, pa.int64()), pa.array(first, pa.string()), pa.array(units.chars(units.starts, one), pa.int64(), mask=plain),
                pa.array(units.chars(one, two), pa.int64(), mask=plain), pa.array(out, pa.string()))

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), *work(part.column(0).to_pylist(), part.column(1).to_pylist())],
                                                 ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_texts(transformed: DataFrame) -> DataFrame:
    """(id, text): the texts rebuilt from ``output`` and ``form`` alone, by
    DataFrame functions. Null outputs stay null; repeated rows all come back;
    an empty table gives an empty result; extra columns are ignored."""
    out, form = F.col("output"), F.col("form")

    def between(start: str, end: str | None):
        behind = F.substr(out, F.instr(out, start) + len(start))
        return behind if end is None else F.substr(behind, F.lit(1), F.instr(behind, end) - 1)

    prefix = F.when(form == "psm", between(PREFIX, SUFFIX)).otherwise(between(PREFIX, MIDDLE))
    suffix = F.when(form == "psm", between(SUFFIX, MIDDLE)).otherwise(between(SUFFIX, PREFIX))
    return transformed.select("id", F.when(form == "plain", out).otherwise(F.concat(prefix, between(MIDDLE, None), suffix)).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents, cut at lines; digests of the output and of the text
    rebuilt from it."""
    out = fill_middle(read(spark, sf_dir, "documents"))

    def digests(batches):
        for batch in batches:
            for a, b in text_slices(batch.column(5)):
                part = batch.slice(a, b - a)
                texts, forms = part.column(5).to_pylist(), part.column(2).to_pylist()
                hashed = [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in column])
                          for column in (texts, [restore(t, f) for t, f in zip(texts, forms)])]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *hashed],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return out.mapInArrow(digests, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                   "output_sha256 string, restored_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w FROM d),
v AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT doc_id, t, n, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
             array_to_string(w[greatest(a, b) + 1:], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
