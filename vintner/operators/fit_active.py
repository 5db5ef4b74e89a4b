"""Elastic net with more features than a Gram matrix can hold (A5).

The features of a row are one array column. Nothing of size p x p is built: an
elastic net with an L1 part leaves most weights at zero, so the exact solution on
the few features that are not (the active set) is the solution, as soon as the
gradient at every other feature is within the L1 bound (the Karush-Kuhn-Tucker
conditions). The search alternates two passes over the rows:

* a gradient pass: one vector of p numbers per task from its Arrow batches,
  added up on the cluster in groups, so that a few vectors reach the driver;
* a Gram pass over the active features only, solved exactly on the driver by
  :func:`vintner.operators.fit.solve_elastic_net`.

Between them the features that break the conditions most join the set, at most
``grow`` at a time. Features that fall to zero stay in it, so it only grows and
the search ends; its result satisfies the conditions to ``tolerance``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintner.functions.names import col_of
from vintner.operators.fit import ALPHA, L1_RATIO, LinearModel, solve_elastic_net

_VECTORS = 16  # partial sums that reach the driver, at most
_SUMS = "part long, n long, bad long, sums binary"


def _rows(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, label) of the complete rows, and how many are not complete."""
    lists, y = batch.column(0), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.float64)
    whole = np.asarray(lists.is_valid()) & ~np.isnan(y)
    kept = lists.filter(pa.array(whole))
    if not len(kept):
        return np.zeros((0, p)), np.zeros(0), len(y)
    sizes = np.asarray(kept.value_lengths())
    if (sizes != p).any():
        raise ValueError(f"a row has {int(sizes[sizes != p][0])} features, expected {p}")
    x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)
    full = ~np.isnan(x).any(axis=1)
    return x[full], y[whole][full], len(y) - int(full.sum())


def _summed(rows: DataFrame, size: int, work, p: int) -> tuple[int, int, np.ndarray]:
    """(rows, incomplete rows, sum) of ``work(x, y)``, a vector of ``size`` numbers
    per batch, over all complete rows."""
    def add(batches):
        n, bad, total = 0, 0, np.zeros(size)
        for batch in batches:
            for start in range(0, len(batch), max(1, (4 << 20) // (8 * p))):  # a few MB at a time
                x, y, left_out = _rows(batch.slice(start, max(1, (4 << 20) // (8 * p))), p)
                n, bad = n + len(y), bad + left_out
                if len(y):
                    total += work(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([bad]),
                                          pa.array([total.tobytes()], pa.binary())], ["part", "n", "bad", "sums"])

    def merge(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])  # one order of adding: reruns agree
        total = np.zeros(size)
        for r in rows:
            total += np.frombuffer(r["sums"])
        return pa.table({"part": [rows[0]["part"]], "n": [sum(r["n"] for r in rows)], "bad": [sum(r["bad"] for r in rows)],
                         "sums": pa.array([total.tobytes()], pa.binary())})

    merged = rows.mapInArrow(add, _SUMS).groupBy(F.pmod("part", F.lit(_VECTORS))).applyInArrow(merge, _SUMS).collect()
    total = np.zeros(size)
    for r in sorted(merged, key=lambda r: r["part"]):
        total += np.frombuffer(r["sums"])
    return sum(r["n"] for r in merged), sum(r["bad"] for r in merged), total


def fit_elastic_net_vector(df: DataFrame, features_col: str, label: str, names: Sequence[str],
                           alpha: float = ALPHA, l1_ratio: float = L1_RATIO, grow: int = 512, most_active: int = 4096,
                           tolerance: float = 1e-9, rounds: int = 100) -> LinearModel:
    """A5 on an array column of ``len(names)`` features; see the module text.
    Minimises what :func:`vintner.operators.fit.fit_elastic_net` minimises.

    Rows with a null or NaN in a feature or the label are left out and counted.
    ``alpha * l1_ratio`` has to be positive. The driver holds vectors of p numbers
    and the Gram matrix of the active features; more than ``most_active`` of them
    raise an error (``fit_spark_ml`` with ``l-bfgs`` fits dense solutions).
    Write ``df`` to files first if it is expensive: every pass reads it.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    if l1 <= 0:
        raise ValueError("needs an L1 part: alpha * l1_ratio > 0")
    p = len(names)
    rows = df.select(col_of(features_col).cast("array<double>").alias("x"), col_of(label).cast("double").alias("y"))
    n, bad, sums = _summed(rows, p + 1, lambda x, y: np.append(x.sum(axis=0), y.sum()), p)
    if not n:
        raise ValueError("no complete rows to fit")
    means, mean_y = sums[:p] / n, sums[p] / n

    def gradient(active: np.ndarray, w: np.ndarray) -> np.ndarray:
        at, center = w[active], means[active]

        def work(x, y):
            residual = (y - mean_y) - (x[:, active] - center) @ at
            return residual @ x - residual.sum() * means
        return _summed(rows, p, work, p)[2] / n

    def gram(active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, center = len(active), means[active]

        def work(x, y):
            z = x[:, active] - center
            return np.concatenate([(z.T @ z).ravel(), z.T @ (y - mean_y)])
        total = _summed(rows, k * k + k, work, p)[2] / n
        return total[:k * k].reshape(k, k), total[k * k:]

    active, w = np.zeros(0, np.int64), np.zeros(p)
    for _ in range(rounds):
        g = gradient(active, w)
        outside = np.setdiff1d(np.arange(p), active)
        over = np.abs(g[outside]) - l1
        breaking = outside[over > tolerance * max(1.0, l1)]
        if not len(breaking):
            return LinearModel(list(names), [float(v) for v in w], float(mean_y - means @ w), label, alpha, l1_ratio, n,
                               {"dropped_rows": bad, "active": len(active)})
        worst = breaking[np.argsort(-np.abs(g[breaking]), kind="stable")[:grow]]
        active = np.sort(np.append(active, worst))
        if len(active) > most_active:
            raise ValueError(f"more than {most_active} active features; raise alpha or fit with l-bfgs")
        w[active] = solve_elastic_net(*gram(active), alpha, l1_ratio)
    raise RuntimeError(f"the active set did not settle in {rounds} rounds")
