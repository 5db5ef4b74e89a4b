"""Token counts under a unigram model by trie-shared dynamic programming.

The distinct pre-tokens of a batch are inserted in a trie; the forward score of
a trie node (best segmentation of its prefix) is computed once, from the scores
of its ancestors, level by level for all nodes together, so pre-tokens with a
common prefix share the work. The terminal nodes hold the counts.

The vocabulary is that of a SentencePiece file. Its merge ranks are no
probabilities, so a piece of rank r scores -log(r + 10) (Zipf's law), in whole
millionths: sums are exact and ties defined. A character without a piece costs
its UTF-8 bytes, each below every piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mix, quoted, read, word_codes
from .pieces import model_path

_BASE = np.uint64(0x5851F42D4C957F2D)
_START = "▁"


class Unigram:
    """Piece scores by hash of the piece's code points, one table per length."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.scores = {sp.id_to_piece(i): -int(1e6 * np.log(rank[sp.get_score(i)] + 10)) for i in plain}
        self.byte_score = min(self.scores.values()) - 1_000_000
        self.tables = []
        for n in range(1, max(map(len, self.scores)) + 1):
            rows = sorted((int(_hash(p)), s) for p, s in self.scores.items() if len(p) == n)
            self.tables.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)))


def _hash(piece: str) -> np.uint64:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + int(mix(np.array([ord(c)], np.uint64))[0])) % (1 << 64)
    return np.uint64(h)


def trie_counts(words: list[str], model: Unigram) -> np.ndarray:
    """Tokens of each distinct word (with the word-start mark in front). Words
    must be sorted: a word's new nodes begin after its common prefix with the
    word before it."""
    lens = np.array([len(w) + 1 for w in words], np.int64)
    code = np.frombuffer("".join(_START + w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.cumsum(lens) - lens
    depth_max = int(lens.max())
    # node of each (word, depth); depth 0 is the root, node 0
    node = np.zeros(len(words), np.int64)
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint64))]  # (parent within the level above, prefix hash) per level
    best, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    out = np.zeros(len(words), np.int64)
    alive = np.arange(len(words))
    powers = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in model.tables:
            powers.append(powers[-1] * _BASE)
        for d in range(1, depth_max + 1):
            c, up = code[at[alive] + d - 1], node[alive]
            new = np.concatenate([[True], (up[1:] != up[:-1]) | (c[1:] != c[:-1])])
            own = np.cumsum(new) - 1
            node[alive] = own
            parent, char = up[new], c[new]
            prefix = levels[-1][1][parent] * _BASE + mix(char)
            levels.append((parent, prefix))
            n_bytes = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            top = best[-1][parent] + n_bytes * model.byte_score
            least = count[-1][parent] + n_bytes
            anc = np.arange(len(parent))
            for k in range(1, min(d, len(model.tables)) + 1):
                anc = levels[d - k + 1][0][anc]
                keys, scores = model.tables[k - 1]
                if not len(keys):
                    continue
                sub = prefix - levels[d - k][1][anc] * powers[k]
                spot = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
                hit = np.flatnonzero(keys[spot] == sub)
                s = best[d - k][anc[hit]] + scores[spot[hit]]
                t = count[d - k][anc[hit]] + 1
                # a character that is a piece never goes to bytes
                win = (s > top[hit]) | ((s == top[hit]) & (t < least[hit]))
                top[hit[win]], least[hit[win]] = s[win], t[win]
            best.append(top), count.append(least)
            ended = lens[alive] == d
            out[alive[ended]] = least[own[ended]]
            alive = alive[~ended]
            if not len(alive):
                break
            if d > len(model.tables):  # levels that no later node can reach
                levels[d - len(model.tables) - 1] = best[d - len(model.tables) - 1] = count[d - len(model.tables) - 1] = None
    return out


def token_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 most_words: int = 1 << 19) -> DataFrame:
    r"""(id, n_words, n_tokens): pre-tokens ``[^\x20\x09-\x0D]+`` of every whole
    text, and the tokens of their best segmentations (highest score, then fewest
    tokens).

    Null and empty texts have none; equal rows all come back; extra columns are
    ignored; an empty table gives an empty result. Counts of ``most_words``
    distinct words are kept from batch to batch, then forgotten.
    """
    model = Unigram(model or model_path())

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            codes, sizes, vocab = word_codes(batch.column(1))
            if len(known) > most_words:
                known.clear()
            fresh = sorted({w for w in vocab if w and w not in known}, key=lambda w: w.encode("utf-32-be"))
            if fresh:
                known.update(zip(fresh, trie_counts(fresh, model).tolist()))
            per_word = np.array([known.get(w, 0) for w in vocab] or [0], np.int64)
            total = np.concatenate([[0], np.cumsum(per_word[codes])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(total[ends] - total[ends - sizes])],
                                             ["id", "n_words", "n_tokens"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")) \
        .mapInArrow(run, "id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: unigram token counts of all documents."""
    return token_counts(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
