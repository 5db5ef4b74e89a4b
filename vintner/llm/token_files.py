r"""Token-id files: the ids of all documents in a binary format whose document
boundaries are Elias-Fano encoded.

Documents are range-partitioned by id (rows of equal ids by a hash of the text,
equal rows by their place in the input, so no id or copy makes a hot range) and
each range is written as one file of segments. A segment holds the concatenated
ids in the fewest bytes the vocabulary needs, and two monotone sequences in
Elias-Fano form: the document ids and the ends of the documents. Low bits are
packed, high bits are unary, and one 32-bit count of ones per 512 high bits
serves select, so a boundary costs about 2 + log2(ids per document) bits and no
table of 64-bit offsets is kept.

The files are written through Spark's text writer (a segment per row, a line
break behind each) and read through its binary file source: any storage Spark
reaches serves, and a lost executor repeats a task under Spark's commit protocol.

Segment, little-endian: ``MAGIC``; 8 int64: part, place in the part, documents,
of these without id, ids, bytes per id, bytes of the two sequences; the document
ids (less the smallest, which precedes them as int64), the ends, the ids.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vintner.session import materialize, scratch_path

from .common import arrow_rows, quoted, read, select_in_words, text_bytes, text_slices
from .pieces import model_path

MAGIC = b"TOKENEF1"
_BLOCK = 8  # words per count of the select directory


def _words(bits: np.ndarray) -> np.ndarray:
    """A bit array as 64-bit words, with one empty word behind."""
    padded = np.zeros(-(-len(bits) // 64) * 64 + 64, bool)
    padded[:len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


class EliasFano:
    """A non-decreasing sequence of integers >= 0; ``get`` reads any of them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        per = (int(values[-1]) + 1) // n if n else 0
        low_bits = max(0, per.bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(bool).ravel()
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, bool)
        high[at] = True
        words = _words(high)
        words = np.concatenate([words, np.zeros(-len(words) % _BLOCK, np.uint64)])
        ones = np.bitwise_count(words).reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint32)
        return cls(n, low_bits, _words(low), words, (np.cumsum(ones) - ones).astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.counts))

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, low_bits, lows, highs = np.frombuffer(data[:32], np.int64).tolist()
        low = np.frombuffer(data[32:32 + 8 * lows], np.uint64)
        high = np.frombuffer(data[32 + 8 * lows:32 + 8 * (lows + highs)], np.uint64)
        return cls(n, low_bits, low, high, np.frombuffer(data[32 + 8 * (lows + highs):], np.uint32))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.counts, i.astype(np.uint32), "right") - 1
        left = i - self.counts[block]
        words = self.high.reshape(-1, _BLOCK)[block]
        ahead = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (ahead <= left[:, None]).sum(axis=1)
        rows = np.arange(len(i))
        left -= np.where(word > 0, ahead[rows, word - 1], 0)
        place = (block * _BLOCK + word) * 64 + select_in_words(words[rows, word], left)
        top = (place - i).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return top
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        at, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        low = self.low[at] >> off
        over = off > 0  # a shift by 64 is not defined
        low[over] |= self.low[at[over] + 1] << (np.uint64(64) - off[over])
        return top | (low & np.uint64((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))


class Segment:
    """One segment of a file: documents by place, by id, and their ids."""

    def __init__(self, data: memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        self.part, self.place, self.docs, self.nameless, self.n_ids, self.width, ids_size, ends_size = \
            np.frombuffer(data[8:72], np.int64).tolist()
        at = 72
        self.lowest = int(np.frombuffer(data[at:at + 8], np.int64)[0])
        self.names = EliasFano.from_bytes(data[at + 8:at + ids_size])
        at += ids_size
        self.ends = EliasFano.from_bytes(data[at:at + ends_size])
        at += ends_size
        self.ids = np.frombuffer(data[at:at + self.n_ids * self.width], f"<u{self.width}")
        self.size = at + self.n_ids * self.width

    def doc_ids(self) -> np.ma.MaskedArray:
        """Ids of all documents; those without id come last."""
        names = (self.names.all().astype(np.int64) + np.int64(self.lowest)) if self.names.n else np.zeros(0, np.int64)
        return np.ma.array(np.append(names, np.zeros(self.nameless, np.int64)), mask=np.arange(self.docs) >= self.names.n)

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of documents within the segment's ids, by two selects."""
        i = np.asarray(i, np.int64)
        start = np.where(i > 0, self.ends.get(np.maximum(i - 1, 0)), 0)
        return start.astype(np.int64), self.ends.get(i).astype(np.int64)

    def find(self, doc_id: int) -> np.ndarray:
        """Places of the documents with this id, by bisection with select."""
        edges = []
        for wanted in (doc_id, doc_id + 1):
            low, high = 0, self.names.n
            while low < high:
                middle = (low + high) // 2
                if int(self.names.get(np.array([middle]))[0]) + self.lowest < wanted:
                    low = middle + 1
                else:
                    high = middle
            edges.append(low)
        return np.arange(*edges)

    def tokens(self, place: int) -> np.ndarray:
        start, end = self.bounds(np.array([place]))
        return self.ids[int(start[0]):int(end[0])]


def pack_segment(part: int, place: int, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """The bytes of a segment; ``doc_ids`` ascend, None last."""
    names = np.array([i for i in doc_ids if i is not None], np.int64)
    lowest = names[:1] if len(names) else np.zeros(1, np.int64)
    first = lowest.tobytes() + EliasFano.of(names.view(np.uint64) - lowest.view(np.uint64)).to_bytes()
    ends = EliasFano.of(np.cumsum(sizes)).to_bytes()
    head = np.array([part, place, len(sizes), len(sizes) - len(names), len(ids), width, len(first), len(ends)], np.int64)
    return b"".join((MAGIC, head.tobytes(), first, ends, ids.astype(f"<u{width}").tobytes()))


def segments(content: bytes):
    """The segments of a file's content, in order."""
    data, at = memoryview(content), 0
    while at < len(data):
        one = Segment(data[at:])
        yield one
        at += one.size + 1  # the writer's line break


# classes of bytes: white space, letter (also both bytes of U+00C0..U+017F but
# for those below), digit, other ASCII, and bytes that leave a word to the library
_SPACE, _LETTER, _DIGIT, _OTHER, _RARE = range(5)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _RARE, np.uint8)
    for c in range(0x21, 0x7F):
        table[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _OTHER
    table[ord("'")] = _RARE                    # contractions
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[0x80:0xC0] = table[0xC3:0xC6] = _LETTER
    return table


_CLASS = _byte_classes()
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_items(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(code of every item, items per text, distinct items, which of these are
    single pre-tokens): runs of letters, single digits and runs of other
    characters, with A-Z lowered as the tokenizer does; a word with an
    apostrophe, a special token's begin, a control character or a code point
    beyond U+017F is one item that the library splits itself."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]).translate(_SMALL), np.uint8)
    kind = _CLASS[data]
    word = kind != _SPACE
    rare = kind == _RARE
    lead = np.concatenate([[0], data[:-1]])
    # no letters: the signs U+00D7 and U+00F7; U+0130 turns into two code points
    rare |= (lead == 0xC3) & ((data == 0x97) | (data == 0xB7)) | (lead == 0xC4) & (data == 0xB0)
    rare |= (lead == ord("<")) & (data == ord("|"))
    # later bytes of rare code points belong to a word that is rare by its first
    begins = word & ~np.concatenate([[False], word[:-1]])
    plain = word.copy()
    if (found := np.flatnonzero(rare & word)).size:
        begin = np.flatnonzero(begins)
        odd = np.unique(np.searchsorted(begin, found, "right") - 1)
        border = np.zeros(len(data) + 1, np.int8)        # from an odd word's begin to the next word
        border[begin[odd]] += 1
        border[np.append(begin, len(data))[odd + 1]] -= 1
        plain &= np.cumsum(border[:-1], dtype=np.int8) == 0
    new = begins | plain & ((kind != np.concatenate([[_SPACE], kind[:-1]])) | (kind == _DIGIT))
    at = np.flatnonzero(new)
    inside = np.cumsum(word, dtype=np.int32)
    offsets = np.append(inside[at] - 1, inside[-1:]).astype(np.int32)
    items = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes())])
    coded = items.dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    sizes = np.diff(np.searchsorted(at, np.cumsum([0, *(len(r) + 1 for r in raw)])))
    single = np.zeros(len(coded.dictionary), bool)
    single[codes] = plain[at]
    return codes, sizes, coded.dictionary.to_pylist(), single


class _Encoder:
    """Ids of texts by the tokenizers library, each distinct item once. Items
    that are single pre-tokens are encoded as one long text, cut behind the
    tokens that end a pre-token; the others one by one. Items are kept from slice
    to slice as bytes of their ids, up to ``most`` of them."""

    def __init__(self, path: str, most: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are Spark's to deal
        from tokenizers import Tokenizer
        self.lib, self.most, self.known = Tokenizer.from_file(path), most, {}
        vocab = self.lib.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, items: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.lib.encode_batch_fast([i.decode() for i in items], add_special_tokens=False)]

    def _learn(self, items: list[bytes], run: int = 4096) -> None:
        """Ids of new single pre-tokens."""
        runs = [items[k:k + run] for k in range(0, len(items), run)]
        for part, found in zip(runs, self._encode([b" ".join(r) for r in runs])):
            ids = np.frombuffer(found, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):  # a vocabulary without word ends
                self.known.update(zip(part, self._encode(part)))
                continue
            ends = (4 * ends).tolist()
            self.known.update((w, found[a:b]) for w, a, b in zip(part, [0, *ends], ends))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``; ids per text)."""
        codes, sizes, vocab, single = split_items([t or "" for t in texts.to_pylist()])
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        fresh = [(w, one) for w, one in zip(vocab, single.tolist()) if w not in known]
        self._learn([w for w, one in fresh if one])
        if rest := [w for w, one in fresh if not one]:
            known.update(zip(rest, self._encode(rest)))
        rows = [known[w] for w in vocab]
        length = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        flat = np.frombuffer(b"".join(rows), np.int32)
        total = np.concatenate([[0], np.cumsum(length[codes] if len(codes) else codes)])
        ends = np.cumsum(sizes)
        n = total[ends] - total[ends - sizes] + 1
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat))
        out = np.full(int(n.sum()), end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n) - 1] = False
        out[inner] = np.asarray(lists.take(pa.array(codes)).flatten())
        return out, n


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id",
                      text_col: str = "text", file_bytes: int = 32 << 20, segment_ids: int = 1 << 21) -> str:
    """Write the ids of every whole text, each document closed by ``end_id``, in
    ascending order of id under ``path``; returns the path.

    Null and empty texts hold the end id alone; rows without id come last; rows
    of one id are ordered by a hash of their text, and repeated rows all stay.
    ``file_bytes`` of text make about one file; a document stays within one
    segment, however long it is. Extra columns are ignored; an empty table gives
    files without segments.
    """
    tokenizer = tokenizer or model_path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    n_files = max(1, -(-text_bytes(rows) // file_bytes))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("place")]
    ranged = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order).select("id", "text")

    def pack(batches):
        from pyspark import TaskContext
        encoder, part, place = _Encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, ids, sizes, held = [], [], [], 0

        def flush():
            data = pack_segment(part, place, doc_ids, np.concatenate(ids), np.concatenate(sizes), width)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for batch in batches:
            for a, b in text_slices(batch.column(1), 2 << 20):
                tokens, n = encoder(batch.column(1).slice(a, b - a), end_id)
                doc_ids += batch.column(0).slice(a, b - a).to_pylist()
                ids.append(tokens), sizes.append(n)
                held += len(tokens)
                if held >= segment_ids:
                    yield flush()
                    doc_ids, ids, sizes, held, place = [], [], [], 0, place + 1
        if held:
            yield flush()
        pa.default_memory_pool().release_unused()

    with arrow_rows(docs.sparkSession, 1000):
        ranged.mapInArrow(pack, "segment binary").select(F.col("segment").cast("string")).write.mode("overwrite").text(path)
    return path


def map_documents(spark: SparkSession, path: str, fields: str, work) -> DataFrame:
    """(doc_id, part, place, start, n_tokens, *fields) of every document in the
    files; ``start`` counts within its segment. ``work(segment, starts, ends)``
    gives the arrays of ``fields``."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_py()):
                    start, end = s.bounds(np.arange(s.docs))
                    names = s.doc_ids()
                    columns = [pa.array(names.data, pa.int64(), mask=names.mask), pa.array(np.full(s.docs, s.part)),
                               pa.array(np.full(s.docs, s.place)), pa.array(start), pa.array(end - start), *work(s, start, end)]
                    yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return spark.read.format("binaryFile").load(path).select("content") \
        .mapInArrow(run, f"doc_id long, part long, place long, start long, n_tokens long, {fields}")


def with_global_starts(local: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``start`` counted over all files: adds the ids of the segments before. The
    window runs over one row per segment (``segment_ids`` ids or more each). The
    segments are those of ``documents`` (of ``local``, if not given)."""
    ahead = Window.orderBy("p", "q").rowsBetween(Window.unboundedPreceding, -1)
    before = (local if documents is None else documents).groupBy(F.col("part").alias("p"), F.col("place").alias("q")).agg(F.sum("n_tokens").alias("n")) \
        .select("p", "q", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return local.join(before, (F.col("part") == F.col("p")) & (F.col("place") == F.col("q"))) \
        .withColumn("start", F.col("start") + F.col("ahead")).drop("part", "place", "p", "q", "ahead")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document in the files;
    ``start`` counts the ids of all documents before it."""
    def lists(s, start, end):
        return [pa.ListArray.from_arrays(pa.array(np.append(start, s.n_ids), pa.int32()), pa.array(s.ids.astype(np.int32)))]

    out = map_documents(spark, path, "ids array<int>", lists)
    return with_global_starts(out, map_documents(spark, path, "none int", lambda s, a, b: [pa.nulls(s.docs, pa.int32())]))


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids array<int>) of the documents with the given ids (a stated
    list, not a table): bisection in each segment, no segment is decoded whole."""
    wanted = sorted(set(doc_ids))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_py()):
                    hits = [(d, s.tokens(int(i)).tolist()) for d in wanted for i in s.find(d)]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.int64()),
                                                      pa.array([t for _, t in hits], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: ids of all documents written as token-id files and read back:
    start, number of ids and their CRC-32."""
    path = write_token_files(read(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))

    def digest(s, start, end):
        ids = s.ids.astype("<u4")
        return [pa.array([zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), end.tolist())], pa.int64())]

    # written, as it is small and read twice: the files are parsed once
    out = materialize(map_documents(spark, path, "ids_crc32 long", digest), "token-documents")
    return with_global_starts(out).select("doc_id", "start", "n_tokens", "ids_crc32")
