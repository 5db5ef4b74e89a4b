"""The methods themselves: node pairs of the dual-tree search, what the trees of
the PII detector reject, and roles against all paths."""

import collections
import itertools
import os
import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import spark  # noqa: E402,F401

from vintner.llm import chat, pii, topk  # noqa: E402


def test_cover_trees_cover_their_rows():
    r = np.random.default_rng(4)
    for x in (r.normal(size=(700, 6)), np.repeat(r.normal(size=(3, 4)), 200, axis=0), np.zeros((90, 3)), r.normal(size=(1, 2))):
        x = np.floor(x * 50)
        tree = topk.CoverTree(x)
        below = {}
        for node in range(len(tree.center) - 1, -1, -1):
            below[node] = tree.rows[node] if tree.leaf[node] else np.concatenate([below[c] for c in range(tree.lo[node], tree.hi[node])])
            far = np.sqrt(((x[below[node]] - x[tree.center[node]]) ** 2).sum(axis=1))
            assert far.max(initial=0) <= tree.radius[node] + 1e-6 and tree.center[node] in below[node]
        assert sorted(below[0].tolist()) == list(range(len(x)))
        values = r.normal(size=len(x))
        assert all(abs(low - values[below[node]].min()) < 1e-12 for node, low in enumerate(tree.lowest(values)))


def test_dual_tree_prunes_pairs_and_finds_the_best():
    r = np.random.default_rng(6)
    middles = r.normal(size=(12, 16)) * 400
    x = np.floor(np.concatenate([m + r.normal(size=(250, 16)) * 8 for m in middles]))
    ids = r.permutation(len(x)) * 3
    ask = r.choice(len(x), 300, replace=False)
    best = topk.dual_search(topk.CoverTree(x[ask]), ids[ask], np.full(len(ask), -np.inf), topk.CoverTree(x), ids, 5)
    scores = x[ask] @ x.T
    scores[np.arange(len(ask)), ask] = -np.inf
    for q in range(len(ask)):
        want = sorted(zip(-scores[q], ids))[:5]
        assert [(-s, i) for s, i in zip(best.s[best.q == q], best.i[best.q == q])] == want
    assert best.pruned > best.met / 4                       # whole pairs of nodes fall to the bound
    floors = np.partition(scores, -5, axis=1)[:, -5]        # known k-th scores prune more
    again = topk.dual_search(topk.CoverTree(x[ask]), ids[ask], floors, topk.CoverTree(x), ids, 5)
    assert again.met <= best.met and len(again.q) == 5 * len(ask)


def test_ids_with_several_vectors_count_once():
    x = np.array([[1.0, 0], [9, 0], [8, 0], [7, 0], [5, 0]])
    ids = np.array([0, 1, 1, 2, 3])
    best = topk.dual_search(topk.CoverTree(x[:1]), ids[:1], np.full(1, -np.inf), topk.CoverTree(x), ids, 3)
    assert list(zip(best.i.tolist(), best.s.tolist())) == [(1, 9.0), (2, 7.0), (3, 5.0)]


def pii_corpus(n=900, seed=5):
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))
    rows = []
    for i in range(n):
        rows.append((i, r.choice([f"reach {r.choice(['jane', 'info', 'j.doe'])}{i}@{r.choice(['mail', 'corp'])}{i % 7}.com today",
                                  f"the machine {'.'.join(str(r.randrange(1, 256)) for _ in range(4))} is up", f"it was charged to {card()} in May",
                                  f"ring +1 {digits(3)} 555 {digits(4)} at noon", "nothing to see here"])))
    return rows


def test_trees_reject_what_the_rules_let_pass(spark):  # noqa: F811
    df = spark.createDataFrame(pii_corpus(), "doc_id long, text string")
    detector = pii.fit_detector(df)
    assert detector.model is not None and 0.9 <= detector.threshold <= 1.0
    not_private = ["the order no 4111/1111/1111/1111 was shipped", "invoice number 4111.1111.1111.1111 is due", "version 10 . 20 . 30 . 40 is out",
                   "see section 12 . 1 . 3 . 4 there", "serial no (743) 555-3824 on the back", "part number 743.555.3824 is sold out",
                   "we meet at shop.example.org today", "the sale at www.example.com ends"]
    private = {"card": ["paid with 4111/1111/1111/1111 today", "visa 4111.1111.1111.1111 was used"], "ip": ["from host 10 . 20 . 30 . 40 again"],
               "phone": ["please call (743) 555-3824 soon", "phone 743.555.3824 at night"],
               "email": ["write to jane.doe (at) example (dot) org please", "contact jane [at] example.org now"]}
    for text in not_private:
        wide = [c for c in pii.proposals(text, pii.base_spans(text)) if not pii.fails(text, *c, [])]
        assert wide, text  # the rules alone would report it
        assert not [s for s in detector.spans([text])[0] if not s[3]], text
    for kind, texts in private.items():
        for text in texts:
            assert any(s[0] == kind for s in detector.spans([text])[0]), text


def test_every_kind_is_trained_on_both_sides(spark):  # noqa: F811
    seen = collections.Counter()
    for i, t in pii_corpus():
        for k, a, b in pii.base_spans(t):
            for made, p, q, label in pii._examples(t, k, a, b, random.Random(i)):
                assert not pii.fails(made, k, p, q, [])
                seen[k, label] += 1
    assert all(seen[k, label] >= 100 for k in pii.KINDS for label in (0, 1)), seen


def test_roles_are_the_best_of_all_paths(spark, monkeypatch):  # noqa: F811
    """Decoded in pieces over partitions, every conversation still has the
    highest score among all sequences of roles."""
    r = random.Random(9)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(r.randint(1, 7)):
            rows.append((conv, turn, r.choice([None, None, "user", "assistant"]), r.choice(["User: hi", "hello?", "x" * 300, "1. a\n2. b", "", "**Assistant:** ok"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    models = []
    real = chat.fit_roles
    monkeypatch.setattr(chat, "fit_roles", lambda turns: models.append(real(turns)) or models[-1])
    for size in (20_000, 5):
        out = chat.format_chats(df, partition_turns=size).collect()
        model, of = models[-1], collections.defaultdict(list)
        for x in out:
            of[x.conv].append(x)
        assert {c: len(v) for c, v in of.items()} == collections.Counter(c for c, *_ in rows)
        for conv, turns in of.items():
            mine = sorted((t for t in rows if t[0] == conv), key=lambda t: t[1])
            seen = [chat._observe(t[2], t[3]) for t in mine]
            emit = model.emit(*(np.array([s[k] for s in seen]) for k in range(4)))

            def score(path):
                total = model.start[path[0]] + emit[0][path[0]]
                return total + sum(model.step[a][b] + emit[i][b] for i, (a, b) in enumerate(zip(path, path[1:]), 1))
            got = [chat.ROLES.index(x.role) for x in sorted(turns, key=lambda x: x.turn)]
            assert score(got) == max(score(p) for p in itertools.product(range(len(chat.ROLES)), repeat=len(mine)))


def test_longer_codes_keep_their_recall():
    """Codes of 1, 2 and 3 rotations (larger labels take longer ones and more
    tables): pairs at the cosine of the query share a bucket."""
    from vintner.llm import near_vectors
    r = np.random.default_rng(12)
    for dims in (32, 64, 384):
        x = r.normal(size=(300, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = r.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * side
        for hashes in (1, 2, 3):
            a, b = (near_vectors.codes(v, 6 * hashes, hashes, 3) for v in (x, y))
            met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)])
            assert met >= 0.97, (dims, hashes, met)


def test_texts_with_shingles_of_their_own_file_no_keys(spark, monkeypatch):  # noqa: F811
    from vintner.llm import jaccard_join
    r, made = random.Random(3), {}
    word = lambda: f"w{r.randrange(10**6)}"
    passage = " ".join(word() for _ in range(40))
    rows = [(i, passage + " " + " ".join(word() for _ in range(120))) for i in range(40)]
    rows += [(100, rows[7][1] + " end"), (101, rows[7][1])]

    def kept(df, name, write=jaccard_join.materialize):
        made[name] = write(df, name)
        return made[name]
    monkeypatch.setattr(jaccard_join, "materialize", kept)
    out = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.id: x.component for x in out} == {i: 7 if i >= 100 else i for i, _ in rows}
    assert {x.id for x in made["shared"].select("id").distinct().collect()} == {7, 100}  # the passage alone makes no candidates


def test_unsettled_components_make_no_pairs(spark, monkeypatch):  # noqa: F811
    from vintner.llm import jaccard_join
    r, made, n = random.Random(5), {}, 150
    base = [" ".join(f"w{r.randrange(10**6)}" for _ in range(7)) for _ in range(250)]
    rows = [(i, " ".join(b + f" v{r.randrange(4)}" for b in base)) for i in range(n)]  # long texts, half of each two alike, none linked
    rows += [(n + k, rows[7 * k][1] + " end") for k in range(1, 6)]

    def kept(df, name, write=jaccard_join.materialize):
        made[name] = write(df, name)
        return made[name]
    monkeypatch.setattr(jaccard_join, "materialize", kept)
    out = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=20).collect()
    assert {x.id: x.component for x in out} == {i: i if i < n else 7 * (i - n) for i, _ in rows}
    assert made["unsettled"].count() >= 100
    assert max(made[x].count() for x in ("pairs", "met") if x in made) < 30 * n  # of n * n / 2 pairs


def test_no_tree_node_has_a_child_per_row():
    x = np.random.default_rng(8).normal(size=(3000, 64)) * 40  # many dimensions: no row is near another
    tree = topk.CoverTree(np.floor(x))
    assert len(tree.center) < 300 and (tree.hi - tree.lo).max() <= 16
