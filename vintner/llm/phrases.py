r"""Phrase collocation mining by stripes.

A stripe belongs to a prefix and is an associative counter of what comes next:
the entry of a next word holds the occurrences of the prefix with that word, and
an id that names the stripe of this longer prefix. The stripe of the empty
prefix counts the words of a language. Stripes of the tasks are merged
elementwise, and everything is read from them: the extensions (entries that
occur often enough), the totals of a prefix (its entry one stripe up) and the
subsumption maxima (greatest entry of its own stripe for a word more behind, and
of the stripes it ends for a word more in front).

Only prefixes and endings that occur often enough can grow, so the words are
counted level by level: a chunk of about half a million words counts the pairs of
neighbouring frequent grams of the level before (first gram = prefix, second =
the prefix without its first word and with the next word, so the two ids say
exactly which longer gram it is), sends each distinct pair once, and receives
ids for the frequent ones. Entries go to buckets by prefix; a prefix with many
occurrences is split into sub-stripes by its next word, so a hot prefix is no
hot bucket: a bucket holds about ``bucket_words`` entries whatever the skew. All
counts are integers, all grams exact: no hash stands for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vintner.session import materialize

from .common import arrow_rows, cuts, hash_words, mix, pack, pack_sorted, quoted, read, text_bytes, text_slices, unpack, unpack_sorted

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)  # of a byte: 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

# what chunks write: the state (bucket -1: places of grams and which message
# entry each is) and one message per bucket
_CHUNK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("pos", pa.binary()), ("idx", pa.binary()),
                    ("names", pa.list_(pa.binary())), ("first", pa.binary()), ("second", pa.binary()), ("n", pa.binary()),
                    ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64()))])
_CHUNK_SQL = ("chunk long, bucket int, pos binary, idx binary, names array<binary>, first binary, second binary, n binary, "
              "langs array<string>, sizes array<long>")
# what buckets write: replies (chunk set) and merged stripes
_MERGED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()),
                     ("prefix", pa.int64()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())),
                     ("suffixes", pa.list_(pa.int64())), ("gram_ids", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])
_MERGED_SQL = ("chunk long, bucket int, ids binary, counts binary, prefix long, langs array<string>, words array<string>, "
               "suffixes array<long>, gram_ids array<long>, f array<long>")


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(code, place and text number of every word, distinct words): places of
    words follow each other within a piece and leave a gap between pieces."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).translate(_LOWER), np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    place = np.arange(len(start)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, "right")
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, np.int64), place, coded.dictionary.to_pylist(), text


class _Chunk:
    """Words of some slices of a task, coded by (language, word)."""

    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.codes, self.places, self.end, self.n, self.sizes = [], [], 0, 0, {}

    def add(self, langs: list[str], texts: list[str]) -> None:
        code, place, vocab, text = split_words(texts)
        if not len(code):
            return
        tongues = sorted(set(langs))
        tongue = np.array([tongues.index(x) for x in langs])[text]
        for i, k in enumerate(np.bincount(tongue, minlength=len(tongues)).tolist()):
            self.sizes[tongues[i]] = self.sizes.get(tongues[i], 0) + k
        pair, back = np.unique(code * len(tongues) + tongue, return_inverse=True)
        heads = [t.encode() + b"\t" for t in tongues]
        rows = [self.names.setdefault(heads[p % len(tongues)] + vocab[p // len(tongues)], len(self.names)) for p in pair.tolist()]
        self.codes.append(np.array(rows, np.uint32)[back])
        self.places.append((place + self.end).astype(np.uint32))
        self.end += int(place[-1]) + 2  # a gap before the next slice
        self.n += len(code)

    def rows(self, chunk: int, n_buckets: int) -> pa.RecordBatch:
        names, codes = list(self.names), np.concatenate(self.codes)
        bucket = (hash_words([n.decode() for n in names], 3) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.uint32)
        back[order] = np.arange(len(order), dtype=np.uint32)
        n = np.bincount(codes, minlength=len(names)).astype(np.uint32)
        out = [{"chunk": chunk, "bucket": -1, "pos": pack_sorted(np.concatenate(self.places)), "idx": pack(back[codes]),
                "langs": list(self.sizes), "sizes": list(self.sizes.values())}]
        for part in np.split(order, cuts(bucket[order])[1:]):
            out.append({"chunk": chunk, "bucket": int(bucket[part[0]]), "names": [names[i] for i in part], "n": pack(n[part])})
        return pa.RecordBatch.from_pylist(out, schema=_CHUNK)


def _grow(state: pa.Table, replies: pa.Table, n_buckets: int, sub_entries: int, last: bool) -> pa.Table:
    """State and messages of the next level: pairs of frequent neighbours."""
    if not state.num_rows:
        return _CHUNK.empty_table()
    replies = replies.sort_by("bucket")
    ids = np.concatenate([unpack(x, np.int64) for x in replies.column("ids").to_pylist()])
    total = np.concatenate([unpack(x, np.int64) for x in replies.column("counts").to_pylist()])
    pos, idx = unpack_sorted(state.column("pos")[0].as_py(), np.uint32), unpack(state.column("idx")[0].as_py(), np.uint32)
    keep = ids[idx] >= 0
    pos, idx = pos[keep], idx[keep].astype(np.uint64)
    next_to = pos[1:] == pos[:-1] + 1
    if not next_to.any():
        return _CHUNK.empty_table()
    pair, back, n = np.unique(idx[:-1][next_to] << np.uint64(32) | idx[1:][next_to], return_inverse=True, return_counts=True)
    one, two = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first, second = ids[one], ids[two]
    parts = np.uint64(1) + (total[one] // sub_entries).view(np.uint64)
    sub = mix(second.view(np.uint64)) % parts
    bucket = (mix(mix(first.view(np.uint64)) + sub) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((second, first, bucket))
    out, chunk = [], state.column("chunk")[0].as_py()
    if not last:
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        out.append({"chunk": chunk, "bucket": -1, "pos": pack_sorted(pos[:-1][next_to]), "idx": pack(place[back])})
    for part in np.split(order, cuts(bucket[order])[1:]):
        out.append({"chunk": chunk, "bucket": int(bucket[part[0]]), "first": pack_sorted(first[part]), "second": pack(second[part]),
                    "n": pack(n[part].astype(np.uint32))})
    return pa.Table.from_pylist(out, schema=_CHUNK)


def _merge(table: pa.Table, bucket: int, n_buckets: int, least: int, last: bool) -> pa.Table:
    """Elementwise sum of the stripes in a bucket; replies to their chunks."""
    n = np.concatenate([unpack(x, np.uint32) for x in table.column("n").to_pylist()]).astype(np.int64)
    names = None
    if table.column("names")[0].is_valid:
        coded = pa.concat_arrays(c.flatten() for c in table.column("names").chunks).dictionary_encode()
        names = coded.dictionary.to_pylist()
        by_name = np.empty(len(names), np.int64)
        by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        names.sort()
        second = by_name[np.asarray(coded.indices)]
        first = np.full(len(second), -1)
    else:
        first = np.concatenate([unpack_sorted(x, np.int64) for x in table.column("first").to_pylist()])
        second = np.concatenate([unpack(x, np.int64) for x in table.column("second").to_pylist()])
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    run = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    f = np.add.reduceat(n[order], run)
    often = f >= least
    ids = np.where(often, (np.cumsum(often) - 1) * n_buckets + bucket, -1)
    out = []
    if not last:
        length = np.diff(np.append(run, len(order)))
        reply, count = np.empty((2, len(order)), np.int64)
        reply[order], count[order] = np.repeat(ids, length), np.repeat(np.where(often, f, 0), length)
        ends = np.cumsum([len(x) // 4 for x in table.column("n").to_pylist()])
        for chunk, p, q in zip(table.column("chunk").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out.append({"chunk": chunk, "bucket": bucket, "ids": pack(reply[p:q]), "counts": pack(count[p:q])})
    a, b, ids, f = a[run][often], b[run][often], ids[often], f[often]
    for p, q in zip(at := cuts(a), [*at[1:], len(a)]):
        row = {"prefix": int(a[p]), "gram_ids": ids[p:q], "f": f[p:q]}
        if names is None:
            row["suffixes"] = b[p:q]
        else:
            pairs = [names[i].decode().rsplit("\t", 1) for i in b[p:q]]
            row["langs"], row["words"] = [x for x, _ in pairs], [y for _, y in pairs]
        out.append(row)
    return pa.Table.from_pylist(out, schema=_MERGED)


def count_stripes(docs: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang",
                  chunk_words: int = 1 << 19, bucket_words: int = 1 << 20, sub_entries: int = 1 << 18) -> tuple[list[DataFrame], DataFrame]:
    """The merged stripes per level (rows of one prefix or part of one), and
    (lang, n): the words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"), quoted(text_col).alias("text"))
    n_buckets = max(1, -(-text_bytes(rows) // (6 * bucket_words)))

    def start(batches):
        from pyspark import TaskContext
        task, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for a, b in text_slices(batch.column(1), 2 << 20):
                chunk.add(batch.column(0).slice(a, b - a).to_pylist(), [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                if chunk.n >= chunk_words or len(chunk.names) >= chunk_words // 2:
                    yield chunk.rows(task, n_buckets)
                    task, chunk = task + 1, _Chunk()
        if chunk.n:
            yield chunk.rows(task, n_buckets)

    with arrow_rows(spark, 1000):
        chunks = materialize(rows.mapInArrow(start, _CHUNK_SQL), "phrase-words")
    sizes = chunks.where("bucket < 0").select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")) \
        .groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    def merging(last):
        return lambda key, table: _merge(table, key[0].as_py(), n_buckets, least, last)

    def growing(last):
        return lambda state, replies: _grow(state, replies, n_buckets, sub_entries, last)

    levels = []
    for level in range(1, longest + 1):
        merged = materialize(chunks.where("bucket >= 0").select("chunk", "bucket", "names", "first", "second", "n")
                             .groupBy("bucket").applyInArrow(merging(level == longest), _MERGED_SQL), f"phrase-stripes-{level}")
        levels.append(merged.where("chunk IS NULL").select("prefix", "langs", "words", "suffixes", "gram_ids", "f"))
        if level < longest:
            state = chunks.where("bucket < 0").select("chunk", "pos", "idx").groupBy("chunk")
            replies = merged.where("chunk IS NOT NULL").select("chunk", "bucket", "ids", "counts").groupBy("chunk")
            chunks = materialize(state.cogroup(replies).applyInArrow(growing(level + 1 == longest), _CHUNK_SQL), f"phrase-grams-{level + 1}")
    return levels, sizes


def _cut(a: Column, l: Column, r: Column, scale: int) -> Column:
    """floor(scale * a / (l + r)), exactly: products of two longs fit a decimal."""
    wide = (F.lit(scale).cast("decimal(18,0)") * a.cast("decimal(19,0)")).cast("decimal(38,0)")
    both = l.cast("decimal(19,0)") + r.cast("decimal(19,0)")
    return F.call_function("div", wide, both.cast("decimal(38,0)"))


def mine_phrases(docs: DataFrame, longest: int = 4, least: int = 30, subsumed: int = 80, most: int | None = 2000,
                 text_col: str = "text", lang_col: str = "lang", **sizes) -> DataFrame:
    r"""(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words
    that occur ``least`` times or more, per language.

    Texts have A-Z lowered, are split at ``[.,;:!?\x0A-\x0D]`` into pieces and
    these into words ``[^\x20\x09]+``. ``a`` counts the phrase, ``l`` and ``r``
    the parts of the cut with the lowest score floor(2000000 * a / (l + r)) (of
    equal ones the first), ``n`` all words of the language. Phrases inside a
    longer one that has ``subsumed`` per cent of their occurrences are dropped.
    Ranked by score and a descending, then by phrase; ``most`` limits the report
    per language (None: all).

    Null and empty texts have no words; a null language is ``und``; repeated
    rows all count; extra columns are ignored; an empty table gives an empty
    result. A very long text stays whole: its words go through one chunk.
    """
    stripes, words = count_stripes(docs, longest, least, text_col, lang_col, **sizes)
    one = stripes[0].select(F.explode(F.arrays_zip("langs", "words", "gram_ids", "f")).alias("x"))
    none = F.array().cast("array<bigint>")
    grams = [materialize(one.select(F.col("x.gram_ids").alias("id"), F.col("x.langs").alias("lang"), F.col("x.words").alias("phrase"),
                                    F.col("x.words").alias("end"), F.col("x.f").alias("f"), none.alias("heads"), none.alias("tails")), "phrase-grams")]
    for stripe in stripes[1:]:
        entry = stripe.select("prefix", F.explode(F.arrays_zip("suffixes", "gram_ids", "f")).alias("x")) \
            .select(F.col("x.gram_ids").alias("id"), F.col("prefix").alias("p"), F.col("x.suffixes").alias("s"), F.col("x.f").alias("f"))
        head = grams[-1].select(F.col("id").alias("p"), "lang", F.col("phrase").alias("begin"), F.col("f").alias("pf"), F.col("heads").alias("ph"))
        tail = grams[-1].select(F.col("id").alias("s"), "end", F.col("f").alias("sf"), F.col("tails").alias("st"))
        grams.append(materialize(entry.join(head, "p").join(tail, "s").select(
            "id", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "end", "f",
            F.concat("ph", F.array("pf")).alias("heads"), F.concat(F.array("sf"), "st").alias("tails")), "phrase-grams"))
    kept = []
    for level, phrases in enumerate(grams[1:], 1):
        phrases = phrases.select("id", "lang", "phrase", F.col("f").alias("a"), "heads", "tails")
        if level + 1 < len(grams):
            # a phrase inside a longer one is inside a phrase one word longer that occurs at least as often
            above = stripes[level + 1]
            behind = above.groupBy(F.col("prefix").alias("id")).agg(F.max(F.array_max("f")).alias("behind"))
            before = above.select(F.explode(F.arrays_zip("suffixes", "f")).alias("x")) \
                .groupBy(F.col("x.suffixes").alias("id")).agg(F.max("x.f").alias("before"))
            part = F.coalesce(F.greatest("behind", "before"), F.lit(0)).cast("decimal(20,0)") * 100
            phrases = phrases.join(behind, "id", "left").join(before, "id", "left") \
                .where(part < F.col("a").cast("decimal(20,0)") * subsumed)
        scored = F.array(*(F.struct(_cut(F.col("a"), F.col("heads")[k], F.col("tails")[k], 2_000_000).alias("score"), F.lit(k).alias("k"),
                                    F.col("heads")[k].alias("l"), F.col("tails")[k].alias("r")) for k in range(level)))
        kept.append(phrases.select("lang", "phrase", "a", F.array_min(scored).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    out = out.withColumn("rank", rank)
    if most is not None:
        out = out.where(F.col("rank") <= most)
    return out.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the first 2000 phrases of every language of all documents."""
    return mine_phrases(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS a
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
inner_part AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, max(a) AS longer
               FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) s(m) WHERE m < k) GROUP BY ALL),
parts AS (SELECT lang, g, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y
          FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT p.*, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * p.a) // (l.a + r.a) AS BIGINT) AS score
        FROM parts p JOIN f l ON l.lang = p.lang AND l.g = x JOIN f r ON r.lang = p.lang AND r.g = y),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_part i ON i.lang = b.lang AND i.g = b.g WHERE coalesce(100 * i.longer < 80 * b.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
