"""Logistic regression on wide sparse rows: tasks sum losses and gradients, the driver holds one vector of the features.

Spark ML's own trainer scales every feature to unit variance. Rare terms then get huge penalties, the problem is badly
conditioned and its trainer needs a thousand passes and more, each of which sends several vectors to the driver. Here a
feature is scaled by its curvature, penalty included, which leaves the optimum where it is and needs far fewer passes; the
sums of a pass are finished by the tasks, so the driver receives one vector a pass, whatever the number of partitions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Rows of a block and entries of a slice of the summed vectors.
_ROWS, _SLICE = 1000, 16_384
_TYPES = {"size": np.int32, "at": np.int32, "value": np.float64, "label": np.float64, "weight": np.float64}


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, each column one run of numbers."""
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            rows = batch.slice(low, _ROWS)
            at, value = rows.column("at"), rows.column("value")
            runs = {"size": at.value_lengths(), "at": at.flatten(), "value": value.flatten(),
                    "label": rows.column("label"), "weight": rows.column("weight")}
            yield pa.RecordBatch.from_pydict({
                k: pa.array([v.to_numpy(zero_copy_only=False).astype(_TYPES[k]).tobytes()], pa.binary()) for k, v in runs.items()})


def blocks(features: DataFrame, vector: str, label: str, weight: str) -> RDD:
    """Sparse rows as blocks of numpy arrays (size, at, value, label, weight)."""
    cells = F.unwrap_udt(vector)
    packed = features.select(
        cells["indices"].alias("at"), cells["values"].alias("value"), F.col(label).alias("label"), F.col(weight).alias("weight")
    ).mapInArrow(_packed, ", ".join(f"{k} binary" for k in _TYPES))
    return packed.rdd.map(lambda r: tuple(np.frombuffer(r[k], kind) for k, kind in _TYPES.items()))


def summed(rows: RDD, width: int, measure: Callable[[tuple], np.ndarray]) -> np.ndarray:
    """Sum of ``measure`` over all blocks: a vector of ``width`` entries, added up in slices by the tasks."""
    def partial(own: Iterable[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for block in own:
            found = measure(block)
            total = found if total is None else np.add(total, found, out=total)
        if total is not None:
            for k in range(0, width, _SLICE):
                yield k // _SLICE, total[k:k + _SLICE]

    slices = dict(rows.mapPartitions(partial).reduceByKey(np.add, -(-width // _SLICE)).collect())  # one vector
    return np.concatenate([slices[k] for k in sorted(slices)])


def _curvature(block: tuple, n: int) -> np.ndarray:
    """Weighted squares of every feature, then the weights."""
    size, at, value, _, weight = block
    return np.append(np.bincount(at, weights=value * value * np.repeat(weight, size), minlength=n), weight.sum())


def _gradient(block: tuple, beta: np.ndarray) -> np.ndarray:
    """Gradient by coefficients and intercept, then the loss. ``beta`` holds the coefficients and the intercept."""
    size, at, value, label, weight = block
    margin, full = np.full(len(size), beta[-1]), size > 0
    if full.any():
        margin[full] += np.add.reduceat(value * beta[at], (np.cumsum(size) - size)[full])
    over = weight * (0.5 * (1 + np.tanh(0.5 * margin)) - label)
    loss = weight @ (np.logaddexp(0.0, margin) - label * margin)
    return np.concatenate([np.bincount(at, weights=value * np.repeat(over, size), minlength=len(beta) - 1), [over.sum(), loss]])


def minimize(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tol: float,
             memory: int = 20) -> np.ndarray:
    """L-BFGS on a smooth convex function until the gradient falls to ``tol`` of the first one."""
    x, (f, g) = start, evaluate(start)
    goal, pairs = tol * np.linalg.norm(g), deque(maxlen=memory)
    for _ in range(max_iter):
        if np.linalg.norm(g) <= goal:
            break
        way = -_solved(g, pairs)
        slope, step = g @ way, 1.0
        while True:
            nf, ng = evaluate(x + step * way)
            # Near the optimum rounding hides what the loss gains; the slope still tells.
            if nf <= f + 1e-4 * step * slope or (nf <= f + 1e-10 * abs(f) and abs(ng @ way) <= 0.9 * abs(slope)):
                break
            if step < 1e-8:
                return x
            step *= min(0.5, max(0.1, -0.5 * slope * step / (nf - f - slope * step)))
        moved, bent = step * way, ng - g
        if moved @ bent > 0:
            pairs.append((moved, bent, 1.0 / (moved @ bent)))
        x, f, g = x + moved, nf, ng
    return x


def _solved(g: np.ndarray, pairs: deque) -> np.ndarray:
    """The two loops of L-BFGS: the gradient by the inverse curvature that the last moves showed."""
    way, shares = g.copy(), []
    for moved, bent, rho in reversed(pairs):
        shares.append(rho * (moved @ way))
        way -= shares[-1] * bent
    if pairs:
        moved, bent, rho = pairs[-1]
        way /= rho * (bent @ bent)
    for (moved, bent, rho), share in zip(pairs, reversed(shares)):
        way += (share - rho * (bent @ way)) * moved
    return way


def fit(features: DataFrame, n: int, penalty: float, vector: str, label: str, weight: str,
        max_iter: int = 1000, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Coefficients of ``n`` features and the intercept that minimize the weighted mean loss of labels 0 and 1
    plus half the penalty times the squared coefficients. The intercept is free."""
    rows = blocks(features, vector, label, weight).persist(StorageLevel.MEMORY_AND_DISK)
    context = rows.context
    try:
        *squares, total = summed(rows, n + 1, lambda block: _curvature(block, n))
        penalties = np.append(np.full(n, penalty), 0.0)
        scale = 1 / np.sqrt(0.25 * np.append(squares, total) / total + penalties)

        def evaluate(u: np.ndarray) -> tuple[float, np.ndarray]:
            beta = scale * u
            held = context.broadcast(beta)
            *slopes, loss = summed(rows, n + 2, lambda block: _gradient(block, held.value))
            held.destroy()
            return loss / total + 0.5 * (penalties * beta) @ beta, scale * (np.array(slopes) / total + penalties * beta)

        beta = scale * minimize(evaluate, np.zeros(n + 1), max_iter, tol)
    finally:
        rows.unpersist()
    return beta[:-1], float(beta[-1])
