"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut into units that no piece can cross (before a space, around a line
break); the distinct units of a batch are encoded together as one flat symbol
array. A round looks up the rank of every adjacent pair, takes the minimum per
unit, merges that pair from the left wherever it occurs, and compacts; a unit
leaves when none of its pairs is a piece. Where a merge could create a pair that
has to go first, only the leftmost one is done in that round, so the result is
that of one merge at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cuts, quoted, read, text_slices

_SPACE = "▁"
_SIDE = 1 << 21  # symbols: piece ids, then vocabulary size + code point


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceModel:
    """Tables of a byte-fallback BPE model with identity normalisation and a
    dummy prefix; read on the driver, bounded by the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if sp.normalize("A  ﬁ ") != f"{_SPACE}A{_SPACE}{_SPACE}ﬁ{_SPACE}" or any(map(sp.is_unused, range(n))):
            raise ValueError("only models with identity normalisation and no unused pieces")
        self.size, self.end = n, sp.eos_id()
        self.byte_ids = np.zeros(256, np.int32)
        surface, plain = [], {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                surface.append(b"")
            elif sp.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                plain[piece] = i
                surface.append(piece.replace(_SPACE, " ").encode())
        if any(_SPACE in p.lstrip(_SPACE) for p in plain):
            raise ValueError("a piece has a space after other characters")
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.leads = np.array([sp.id_to_piece(i).startswith(_SPACE) for i in range(n)])
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        chars = sorted((ord(p), i) for p, i in plain.items() if len(p) == 1)
        self.char, self.char_id = (np.array(x, np.int64) for x in zip(*chars))

        def symbol(s: str) -> int | None:
            return plain.get(s, n + ord(s) if len(s) == 1 else None)

        pairs = {}
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a * _SIDE + b] = (ranks[sp.get_score(i)], i)
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank, self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int32).T.copy()
        joined = {c for p in plain if len(p) > 1 for c in p if c != _SPACE}
        self.lines_apart = "\n" not in joined
        self.unit = f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n+" if self.lines_apart else f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+"

    none = np.int32(2**31 - 1)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * _SIDE + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], self.none), np.where(hit, self.merged[at], 0)

    def units(self, text: str) -> list[str]:
        """The units of a text, in order; joined they are the normalised text."""
        if not text:
            return []
        text = _SPACE + text.replace(" ", _SPACE)
        if _SPACE * 2 in text or "\0" in text:
            return re.findall(self.unit, text)
        text = text.replace(_SPACE, "\0" + _SPACE)
        if self.lines_apart:
            text = text.replace("\n", "\0\n\0")
        return [u for u in text.split("\0") if u]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, ids per unit)."""
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(units)), [len(u) for u in units])
        at = np.minimum(np.searchsorted(self.char, code), len(self.char) - 1)
        sym = np.where(self.char[at] == code, self.char_id[at], self.size + code)
        done_sym, done_own = [], []
        while len(sym):
            same = own[:-1] == own[1:]
            rank = np.full(len(sym), self.none, np.int32)
            to = np.zeros(len(sym), np.int64)
            r, m = self.look_up(sym[:-1], sym[1:])
            rank[:-1], to[:-1] = np.where(same, r, self.none), m
            first = cuts(own)
            n = np.diff(np.append(first, len(own)))
            least = np.repeat(np.minimum.reduceat(rank, first), n)
            over = least == self.none
            done_sym.append(sym[over]), done_own.append(own[over])
            sym, own, rank, to, least = (x[~over] for x in (sym, own, rank, to, least))
            if not len(sym):
                break
            spot = np.flatnonzero(rank == least)
            run = np.concatenate([[True], np.diff(spot) != 1])
            start = spot[run][np.cumsum(run) - 1]
            spot = spot[(spot - start) % 2 == 0]
            unit = own[spot]
            lead = np.concatenate([[True], unit[1:] != unit[:-1]])
            if not lead.all():  # units with several merges: may a new pair come first?
                new = to[spot]
                right = spot + 2 < len(sym)
                right[right] = own[spot[right] + 2] == unit[right]
                r_next = np.full(len(spot), self.none, np.int32)
                r_next[right] = self.look_up(new[right], sym[spot[right] + 2])[0]
                left = spot > 0
                left[left] = own[spot[left] - 1] == unit[left]
                prev = np.where(left, sym[spot - 1], 0)
                close = np.concatenate([[False], np.diff(spot) == 2]) & ~lead
                prev[close] = new[np.flatnonzero(close) - 1]
                r_prev = np.full(len(spot), self.none, np.int32)
                r_prev[left] = self.look_up(prev[left], new[left])[0]
                early = np.minimum(r_next, r_prev) <= rank[spot]
                unsafe = np.logical_or.reduceat(early, np.flatnonzero(lead))[np.cumsum(lead) - 1]
                spot = spot[lead | ~unsafe]
            sym = sym.copy()
            sym[spot] = to[spot]
            keep = np.ones(len(sym), bool)
            keep[spot + 1] = False
            sym, own = sym[keep], own[keep]
        sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int64)
        own = np.concatenate(done_own) if done_own else np.empty(0, np.int64)
        order = np.argsort(own, kind="stable")
        sym, own = sym[order], own[order]
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):  # characters without a piece: their bytes
            raw = [chr(c).encode() for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(b) for b in raw]
            is_odd = np.zeros(len(sym), bool)
            is_odd[odd] = True
            sym, own, is_odd = np.repeat(sym, times), np.repeat(own, times), np.repeat(is_odd, times)
            sym[is_odd] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype(np.int32), np.bincount(own, minlength=len(units))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of consecutive id sequences: piece surfaces joined; the first
        visible piece loses the dummy prefix; bytes that are no UTF-8 become one
        U+FFFD each."""
        n = self.surface_len[ids]
        ends = np.cumsum(n)
        raw = self.surface[np.repeat(self.surface_at[ids] - (ends - n), n) + np.arange(n.sum())].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        seen = np.flatnonzero(~self.control[ids])
        first = np.searchsorted(seen, np.cumsum(sizes) - sizes)
        out = []
        for k, size_end in enumerate(np.cumsum(sizes).tolist()):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if first[k] < len(seen) and seen[first[k]] < size_end and self.leads[ids[seen[first[k]]]]:
                a += 1
            try:
                out.append(raw[a:b].decode())
            except UnicodeDecodeError:
                out.append(_decode_each(raw[a:b]))
        return out


def _decode_each(raw: bytes) -> str:
    out = ""
    while True:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[:e.start].decode() + "�" * (e.end - e.start)
            raw = raw[e.end:]


class _Encoder:
    """Ids of texts through a cache of encoded units, emptied when it is full."""

    def __init__(self, model: PieceModel, most_units: int = 1 << 19):
        self.model, self.most = model, most_units
        self.reset()

    def reset(self) -> None:
        self.where: dict[str, int] = {}
        self.ids, self.at, self.len, self.n = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def add(self, units: list[str]) -> None:
        ids, n = self.model.encode_units(units)
        for u in units:
            self.where[u] = len(self.where)
        self.ids = [np.concatenate([*self.ids, ids])]
        self.at = [np.concatenate([*self.at, self.n + np.cumsum(n) - n])]
        self.len = [np.concatenate([*self.len, n])]
        self.n += len(ids)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text), each text closed by the end id."""
        if len(self.where) > self.most:
            self.reset()
        lists = [self.model.units(t or "") for t in texts]
        fresh = set()
        for units in lists:
            fresh.update(units)
        fresh = [u for u in fresh if u not in self.where]
        if fresh:
            self.add(fresh)
        sizes = np.array([len(x) for x in lists], np.int64)
        unit = np.fromiter((self.where[u] for x in lists for u in x), np.int64, int(sizes.sum()))
        n = self.len[0][unit]
        ends = np.cumsum(n)
        flat = self.ids[0][np.repeat(self.at[0][unit] - (ends - n), n) + np.arange(int(n.sum()))]
        per = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])
        out = np.full(len(flat) + len(texts), self.model.end, np.int32)
        stop = np.cumsum(per + 1) - 1
        keep = np.ones(len(out), bool)
        keep[stop] = False
        out[keep] = flat
        return out, per + 1


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           decode_too: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded string]): the piece ids of every whole text,
    closed by the end id, and on request the text decoded from them.

    Null text counts as empty (the end id alone). Equal rows all come back;
    extra columns are ignored; an empty table gives an empty result. A batch is
    worked on in slices of 4 MB, a longer text alone.
    """
    model = PieceModel(model or model_path())

    def run(batches):
        enc = _Encoder(model)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                ids, n = enc(batch.column(1).slice(a, b - a).to_pylist())
                cols = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))]
                if decode_too:
                    cols.append(pa.array(model.decode(ids, n), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded"][:len(cols)])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")) \
        .mapInArrow(run, "id long, ids array<int>" + ", decoded string" * decode_too)


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from rows of (id, ids array<int>); null ids give the empty
    text, ids outside the vocabulary raise an IndexError."""
    model = PieceModel(model or model_path())

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
            ids = np.asarray(lists.flatten(), np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= model.size):
                raise IndexError("piece id outside the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode(ids, n), pa.string())], ["id", "text"])

    return encoded.select(quoted(id_col).cast("long").alias("id"), quoted(ids_col).cast("array<int>").alias("ids")) \
        .mapInArrow(run, "id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: ids of all documents, and the texts decoded from them."""
    out = encode(read(spark, sf_dir, "documents"), decode_too=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: (doc_id, n_tokens, ids) of every row."""
    return encode(docs).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")
