"""Chat formatting: roles of transcript turns by a hidden Markov model.

Hidden states are the roles; a turn shows a speaker marker (its role column or a
prefix such as "User:"; possibly missing or misleading) and line features
(length, lines, question mark, lists). Emission and transition counts come from
turns with markers, by grouped aggregation over the whole table. Viterbi finds
the most probable role sequence of each conversation; turns are then rendered
in one canonical form.

The table is sorted by conversation and turn over range partitions, so a
conversation may span several. Each partition first reduces the conversations
it shares with others to one matrix (best score from each role to each role);
the few matrices of a conversation are chained, which fixes the role at every
partition border; the partitions then decode on their own. Scores are whole
numbers, so the parts agree exactly.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vintner.session import materialize

from .common import cuts, quoted, read

ROLES = ("system", "user", "assistant")
# fixed values: names under which speakers appear
ALIASES = {"system": 0, "sys": 0, "instruction": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1,
           "assistant": 2, "ai": 2, "bot": 2, "model": 2, "gpt": 2, "a": 2, "answer": 2}
_MARK = re.compile(r"\s*(?:[#*<|\[(]{0,3})\s*(" + "|".join(sorted(ALIASES, key=len, reverse=True)) + r")\s*(?:[|\])*>]{0,3})\s*[:>]\s*(?:\*\*)?\s*", re.I)
_TRUST = 0.97      # share of markers taken to be right
_UNIT = 1 << 16    # log probabilities are whole multiples of 1 / _UNIT
_LENGTHS, _LINES = 14, 5
_NEVER = -(1 << 60)


def _observe(role: str | None, text: str | None) -> tuple[int, int, int, int, str]:
    """(marker or -1, length bucket, line bucket, flags, text without its marker)."""
    text = text or ""
    m = _MARK.match(text)
    mark = ALIASES.get((role or "").strip().lower(), -1)
    if m:
        text = text[m.end():]
        if mark < 0:
            mark = ALIASES[m.group(1).lower()]
    lines = text.count("\n")
    flags = ("?" in text) + 2 * ("\n- " in text or "\n1." in text or "```" in text)
    return mark, min(_LENGTHS - 1, len(text).bit_length()), min(_LINES - 1, lines), flags, text


class RoleModel:
    """Whole-number log scores: start, transitions, and a table per feature."""

    def __init__(self, start: np.ndarray, step: np.ndarray, features: list[np.ndarray]):
        def scores(n, axis):
            p = (n + 1.0) / (n + 1.0).sum(axis=axis, keepdims=True)
            return np.round(np.log(p) * _UNIT).astype(np.int64)
        self.start, self.step = scores(start, 0), scores(step, 1)
        self.features = [scores(f, 1) for f in features]
        right, wrong = (round(math.log(x) * _UNIT) for x in (_TRUST, (1 - _TRUST) / (len(ROLES) - 1)))
        self.mark = np.where(np.eye(len(ROLES), dtype=bool), right, wrong)

    def emit(self, mark: np.ndarray, *features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(mark), len(ROLES)), np.int64)
        has = mark >= 0
        out[has] += self.mark[:, mark[has]].T
        for table, f in zip(self.features, features):
            out += table[:, f].T
        return out

    def path(self, emit: np.ndarray, enter: np.ndarray, last: int | None) -> np.ndarray:
        """Best roles given the scores of being in each role at the first turn
        (without its emission), and the role of the last turn if it is known."""
        score, back = enter + emit[0], np.zeros(emit.shape, np.int64)
        for k in range(1, len(emit)):
            ways = score[:, None] + self.step
            back[k] = ways.argmax(axis=0)
            score = ways.max(axis=0) + emit[k]
        out = np.zeros(len(emit), np.int64)
        out[-1] = int(score.argmax()) if last is None else last
        for k in range(len(emit) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out

    def reach(self, emit: np.ndarray) -> np.ndarray:
        """Best score from each first role to each last role of a run of turns."""
        score = np.where(np.eye(len(ROLES), dtype=bool), emit[0][None, :], _NEVER)
        for e in emit[1:]:
            score = (score[:, :, None] + self.step[None]).max(axis=1) + e
        return score


def fit_roles(turns: DataFrame) -> RoleModel:
    """Counts over all turns with a marker; transitions between neighbouring
    turns of a conversation that both have one. ``place`` numbers the turns of a
    partition without gaps. Turns read in one go form a run; between the end of
    each run and the start of the next (two rows a run) is counted on the cluster,
    so only sums reach the driver."""
    n, k = len(ROLES), _LENGTHS + _LINES + 4

    def count(batches):
        total, last, runs = np.zeros((n, 1 + n + k), np.int64), None, []
        for b in batches:
            if not b.num_rows:
                continue
            mark, length, lines, flags, _ = _observed(b)
            ids = b.column(b.schema.get_field_index("conv"))
            conv, null = np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null())
            place = np.asarray(b.column(b.schema.get_field_index("place")), np.int64)

            def turn(r):
                return int(place[r]), None if null[r] else int(conv[r]), int(mark[r])

            has, joined = mark >= 0, np.diff(place) == 1
            same = joined & (conv[1:] == conv[:-1]) & (null[1:] == null[:-1])
            first = 1 + np.flatnonzero(joined & ~same & has[1:])
            np.add.at(total, (mark[first], 0), 1)
            both = 1 + np.flatnonzero(same & has[1:] & has[:-1])
            np.add.at(total, (mark[both - 1], 1 + mark[both]), 1)
            for off, f in ((1 + n, length), (1 + n + _LENGTHS, lines), (1 + n + _LENGTHS + _LINES, flags)):
                np.add.at(total, (mark[has], off + f[has]), 1)
            head = turn(0)
            if last and last[0] + 1 == head[0]:
                between(total, last, head)
            else:
                runs += [*([(-2, *last)] if last else []), (-1, *head)]
            for r in np.flatnonzero(~joined).tolist():
                runs += [(-2, *turn(r)), (-1, *turn(r + 1))]
            last = turn(len(place) - 1)
        if last:
            runs.append((-2, *last))
        i, j = np.nonzero(total)
        none = [None] * len(i)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), *(r[0] for r in runs)], pa.int64()), pa.array([*j.tolist(), *(r[3] for r in runs)], pa.int64()),
                                          pa.array([*none, *(r[1] for r in runs)], pa.int64()), pa.array([*none, *(r[2] for r in runs)], pa.int64()),
                                          pa.array([*total[i, j].tolist(), *(1 for _ in runs)], pa.int64())], ["i", "j", "place", "conv", "n"])

    def between(total, before, after):
        """Counts the later of two neighbouring turns (place, conv, mark)."""
        if after[2] >= 0 and before[1] != after[1]:
            total[after[2], 0] += 1
        elif after[2] >= 0 and before[2] >= 0:
            total[before[2], 1 + after[2]] += 1

    made = materialize(turns.mapInArrow(count, "i long, j long, place long, conv long, n long"), "role-counts")
    counts = made.where("i >= 0").select("i", "j", "n").unionByName(_between_runs(made.where("i < 0")))
    out = np.zeros((n, 1 + n + k))
    for r in counts.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return RoleModel(out[:, 0], out[:, 1:1 + n], np.split(out[:, 1 + n:], [_LENGTHS, _LENGTHS + _LINES], axis=1))


def _between_runs(ends: DataFrame, group: int = 1000) -> DataFrame:
    """(i, j, n): counts of the first turns of runs, given the last turn of the
    run before. ``ends`` holds the first (i = -1) and last (i = -2) turn of every
    run with its mark j. Neighbours meet within groups of partitions; only the
    border turns of the groups pass a window without a key."""
    part = F.shiftright("place", 33)  # the partition of a row id
    ends = ends.select((F.floor(part / group)).alias("g"), "place", "i", "conv", F.col("j").alias("mark"))
    turn = F.struct("place", (-F.col("i")).alias("late"), "conv", "mark")
    inside = Window.partitionBy("g").orderBy("place", F.col("i").desc())
    near = ends.withColumns({"before": F.lag(turn).over(inside), "turn": turn})
    outer = Window.orderBy("g")
    border = ends.groupBy("g").agg(F.max(turn).alias("last")).select(F.col("g").alias("g_"), F.lag("last").over(outer).alias("last"))
    near = near.where("i = -1").join(border, F.col("g") == F.col("g_")).withColumn("before", F.coalesce("before", "last")) \
        .where("mark >= 0")
    same = F.col("before").isNotNull() & F.col("conv").eqNullSafe(F.col("before.conv"))
    starts = near.where(~same).select(F.col("mark").alias("i"), F.lit(0).cast("long").alias("j"))
    steps = near.where(same & (F.col("before.mark") >= 0)).select(F.col("before.mark").alias("i"), (1 + F.col("mark")).alias("j"))
    return starts.unionByName(steps).select("i", "j", F.lit(1).cast("long").alias("n"))


def _observed(b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    names = b.schema.names
    got = [_observe(r, t) for r, t in zip(b.column(names.index("role")).to_pylist(), b.column(names.index("text")).to_pylist())]
    cols = np.array([g[:4] for g in got], np.int64).reshape(-1, 4)
    return cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], [g[4] for g in got]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", partition_turns: int = 20_000) -> DataFrame:
    """(conv, turn, role, rendered): the recovered role of every turn and its
    canonical form ``<|role|>\\ntext<|end|>``, the text without speaker marker.

    Turns are ordered by number, then role and text; null numbers come first;
    rows without conversation form one conversation of their own. Null text is
    empty; unknown or null roles are no marker. Equal rows are turns of their
    own. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = turns.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).cast("long").alias("turn"),
                        quoted(role_col).cast("string").alias("role"), quoted(text_col).alias("text"))
    key = ["conv", "turn", "role", F.xxhash64("text")]
    parts = max(1, math.ceil(rows.count() / partition_turns))
    rows = materialize(rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
                       .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "turns")
    model = fit_roles(rows)
    shared = rows.select("conv", "part").distinct()
    shared = materialize(shared.withColumn("of", F.count("*").over(Window.partitionBy("conv"))).where("of > 1").select("conv", "part"), "shared")
    n = len(ROLES)

    def reduce_run(table):
        table = table.sort_by("place")
        m = model.reach(model.emit(*_observed(table)[:4]))
        return pa.table({"conv": table.column("conv")[:1], "part": table.column("part")[:1], "reach": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})

    def chain(table):
        """Role before the run's first turn (-1: none) and at its last turn."""
        table = table.sort_by("part")
        reach = [np.array(m).reshape(n, n) for m in table.column("reach").to_pylist()]
        score, back = model.start, []
        for k, m in enumerate(reach):
            enter = score if k == 0 else (score[:, None] + model.step).max(axis=0)
            score = (enter[:, None] + m).max(axis=0)
            back.append(enter)
        last = int(score.argmax())
        before, at = [0] * len(reach), [0] * len(reach)
        alphas = [(back[k][:, None] + reach[k]).max(axis=0) for k in range(len(reach))]
        for k in range(len(reach) - 1, -1, -1):
            at[k], before[k] = last, -1
            if k:
                first = int((back[k] + reach[k][:, last]).argmax())
                before[k] = last = int((alphas[k - 1] + model.step[:, first]).argmax())
        return pa.table({"conv": table.column("conv"), "part": table.column("part"), "before": pa.array(before, pa.int32()), "last": pa.array(at, pa.int32())})

    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    runs = rows.join(shared.toDF("c", "p"), same, "left_semi").groupBy("conv", "part").applyInArrow(reduce_run, "conv long, part int, reach array<long>")
    border = materialize(runs.groupBy("conv").applyInArrow(chain, "conv long, part int, before int, last int"), "borders").toDF("c", "p", "before", "last")

    def decode(table):
        table = table.sort_by("place")
        *seen, texts = _observed(table)
        emit = model.emit(*seen)
        conv = table.column("conv").to_numpy(zero_copy_only=False) if table.column("conv").null_count == 0 else np.array([-1 if c is None else 2 * c for c in table.column("conv").to_pylist()], object)
        before, last = (np.asarray(table.column(c).combine_chunks().fill_null(-2)) for c in ("before", "last"))
        role = np.zeros(len(texts), np.int64)
        at = cuts(conv)
        for a, b in zip(at, [*at[1:], len(conv)]):
            enter = model.start if before[a] < 0 else model.step[before[a]]
            role[a:b] = model.path(emit[a:b], enter, None if last[a] < 0 else int(last[a]))
        names = [ROLES[r] for r in role.tolist()]
        return pa.table({"conv": table.column("conv"), "turn": table.column("turn"), "role": pa.array(names, pa.string()),
                         "rendered": pa.array([f"<|{r}|>\n{t}<|end|>" for r, t in zip(names, texts)], pa.string())})

    return rows.join(border, same, "left").drop("c", "p").groupBy("part").applyInArrow(decode, "conv long, turn long, role string, rendered string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all conversations, roles recovered, turns rendered."""
    return format_chats(read(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")
