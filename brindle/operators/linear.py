"""Exact fits of linear classifiers whose rows lie in many tasks.

Each pass over the rows sums losses, slopes and curvatures of all clusters of all nodes; the driver, which holds coefficients and these sums alone,
makes a step for each cluster. So the fit is that of all rows together, however they are dealt.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.blocks import matrix
from brindle.operators.classifiers import Linear

#: Coefficients up to which curvatures are summed in full; wider fits learn them from the slopes of earlier steps.
MOST_CURVED = 512
#: Bytes of sums that the driver holds at a time, numbers of one row of sums, and steps that a wide fit remembers.
DRIVER_BYTES, PER_CHUNK, MEMORY = 256 << 20, 1 << 15, 10
#: Width of the corner that losses with one are rounded by.
CORNER = 0.05
_RIDGE = 1e-8


def _hinge(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.clip(1 - m, 0, CORNER)
    return np.where(1 - m > CORNER, 1 - m - CORNER / 2, gap * gap / (2 * CORNER)), -gap / CORNER, ((m < 1) & (m > 1 - CORNER)) / CORNER


def _log_loss(m):
    p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
    return np.logaddexp(0, -m), -p, np.maximum(p * (1 - p), 1e-9)


def _modified_huber(m):
    gap = np.maximum(0, 1 - m)
    far = m < -1
    return np.where(far, -4 * m, gap * gap), np.where(far, -4.0, -2 * gap), 2.0 * ((m < 1) & ~far)


#: Loss, slope and curvature by margin. A corner is rounded.
LOSSES: dict[str, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]] = {
    "log_loss": _log_loss,
    "squared_hinge": lambda m: (np.maximum(0, 1 - m) ** 2, -2 * np.maximum(0, 1 - m), 2.0 * (m < 1)),
    "modified_huber": _modified_huber,
    "hinge": _hinge,
}
#: Losses that are rounded: their curvature says little beyond the corner.
CORNERED = ("hinge",)


def curves(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, coef: np.ndarray, loss: str, curved: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums over rows of loss, slope and, if curved, curvature of clusters: x has a column of ones last, sign, weight (rows, clusters), coef (clusters, columns)."""
    value, slope, curve = LOSSES[loss](sign * (x @ coef.T))
    second = None
    if curved:
        second = np.stack([(x * (weight[:, j] * curve[:, j])[:, None]).T @ x for j in range(coef.shape[0])])
    return (weight * value).sum(0), (weight * slope * sign).T @ x, second


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.ones((len(x), 1))))


def _summing(models: dict[int, tuple[list[int], np.ndarray, np.ndarray]], loss: str, curved: bool):
    """Rows (node, vec, clusters) to this task's sums: rows (node, cluster, chunk, sums)."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in incoming:
            nodes = batch.column(0).to_numpy()
            for node in np.unique(nodes).tolist():
                if node not in models:
                    continue
                clusters, coef, weights = models[node]
                rows = batch.filter(pa.array(nodes == node))
                own = rows.column(2)
                whose = np.repeat(np.arange(rows.num_rows), np.diff(own.offsets.to_numpy()))
                of = own.flatten().to_numpy()
                at = np.minimum(np.searchsorted(clusters, of), len(clusters) - 1)
                known = np.asarray(clusters)[at] == of
                sign = np.full((rows.num_rows, len(clusters)), -1.0)
                sign[whose[known], at[known]] = 1.0
                value, slope, second = curves(with_ones(matrix(rows.column(1))), sign, np.where(sign > 0, weights[:, 0], weights[:, 1]), coef, loss, curved)
                sums = np.hstack([value[:, None], slope, *([second.reshape(len(clusters), -1)] if second is not None else [])])
                total[node] = total[node] + sums if node in total else sums
        for node, sums in total.items():
            for cluster, row in zip(models[node][0], sums, strict=True):
                for chunk, low in enumerate(range(0, len(row), PER_CHUNK)):
                    part = row[low : low + PER_CHUNK].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((node, pa.int64()), (cluster, pa.int32()), (chunk, pa.int32()), (part, pa.binary()))], ["node", "cluster", "chunk", "sums"])

    return run


def _adding(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, cluster, chunk) to one row of each, its sums added up one after the other."""
    at, total = None, np.zeros(0)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, total.tobytes()), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["node", "cluster", "chunk", "sums"])

    for batch in incoming:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        for k, key in enumerate(keys):
            own = np.frombuffer(batch.column(3)[k].as_buffer())
            if key != at:
                if at is not None:
                    yield out()
                at, total = key, own.copy()
            else:
                total += own
    if at is not None:
        yield out()


def sums(rows: DataFrame, models: dict[int, tuple[list[int], np.ndarray, np.ndarray]], loss: str = "log_loss", curved: bool = True) -> DataFrame:
    """(node, cluster, chunk, sums) over all rows (node, vec, clusters): of each cluster the sum of its losses, its slopes and, if curved, its curvatures, as doubles.

    models: by node its clusters, ascending, their coefficients (the intercept last), and the weights of rows inside and outside of each. Sums of a task are
    added up before they are moved, and chunks of PER_CHUNK numbers one by one after.
    """
    parts = rows.select("node", "vec", "clusters").mapInArrow(_summing(models, loss, curved), "node long, cluster int, chunk int, sums binary")
    return parts.repartition("node", "cluster", "chunk").sortWithinPartitions("node", "cluster", "chunk").mapInArrow(_adding, "node long, cluster int, chunk int, sums binary")


class _Fit:
    """One cluster's coefficients: propose gives those to be tried, tell takes the sums there. Penalties don't touch the intercept, but for a trace."""

    def __init__(self, width: int, square: float, absolute: float, intercept: bool, tol: float, rounds: int):
        self.w = self.tried = np.zeros(width + 1)
        self.square, self.absolute = np.full(width + 1, max(square, _RIDGE)), np.full(width + 1, absolute)
        self.square[-1], self.absolute[-1] = _RIDGE, 0.0
        self.intercept, self.tol, self.left, self.done = intercept, tol, rounds, False
        self.value, self.halved = np.inf, 0

    def propose(self) -> np.ndarray:
        return self.tried

    def tell(self, value: float, slope: np.ndarray, second: np.ndarray | None) -> None:
        value = value + 0.5 * self.square @ self.tried**2 + self.absolute @ np.abs(self.tried)
        slope = slope + self.square * self.tried
        if not self.intercept:
            slope[-1] = 0.0
        if value > self.value + self.least_gain(self.tried - self.w) and self.halved < 25:
            self.halved += 1
            self.tried = self.retried()
            return
        moved = np.abs(self.tried - self.w).max() if np.isfinite(self.value) else np.inf
        before, self.halved = self.value, 0
        self.learn(self.tried - self.w, slope)
        self.w, self.value, self.left = self.tried, value, self.left - 1
        if self.left <= 0 or self.over(moved, before, slope):
            self.done = True
            return
        self.tried = self.step(slope, second)
        if np.abs(self.tried - self.w).max() == 0:
            self.done = True

    def least_gain(self, moved: np.ndarray) -> float:
        """What a step may bring at most to be too long: a little more than nothing, or less than its slope promises."""
        return 1e-10 * abs(self.value) if np.isfinite(self.value) else 0.0

    def retried(self) -> np.ndarray:
        return (self.tried + self.w) / 2

    def learn(self, moved: np.ndarray, slope: np.ndarray) -> None:
        pass

    def over(self, moved: float, before: float, slope: np.ndarray) -> bool:
        return moved <= self.tol

    def step(self, slope: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        raise NotImplementedError

    def pull(self, slope: np.ndarray) -> np.ndarray:
        """The slope where absolute values have a corner: zero where neither side goes down."""
        at = np.sign(self.w) * self.absolute + slope
        zero = self.w == 0
        at[zero] = np.sign(slope[zero]) * np.maximum(np.abs(slope[zero]) - self.absolute[zero], 0)
        return at


class Curved(_Fit):
    """Newton's steps; with absolute values, the least of the curved model by coordinates."""

    def step(self, slope, second):
        h = second + np.diag(self.square)
        if not self.intercept:
            h[-1], h[:, -1] = 0.0, 0.0
            h[-1, -1] = 1.0
        if not self.absolute.any():
            return self.w - np.linalg.solve(h, slope)
        v, own = self.w.copy(), np.maximum(np.diag(h), 1e-12)
        at = slope.copy()  # the model's slope at v
        for _ in range(200):
            most = 0.0
            for k in range(len(v)):
                goal = v[k] - at[k] / own[k]
                new = np.sign(goal) * max(abs(goal) - self.absolute[k] / own[k], 0.0)
                if new != v[k]:
                    at += (new - v[k]) * h[k]
                    most = max(most, abs(new - v[k]))
                    v[k] = new
            if most <= 0.1 * self.tol:
                break
        return v


class Learned(_Fit):
    """Steps by curvatures that follow from the last steps' slopes, within the orthant where absolute values are straight."""

    def __init__(self, *args):
        super().__init__(*args)
        self.pairs: deque = deque(maxlen=MEMORY)
        self.slope: np.ndarray | None = None
        self.still, self.down = 0, 1.0
        self.least = 1e-12  # what a step must bring, as a share; less three times over is the end

    def least_gain(self, moved):
        if self.slope is None:
            return 0.0
        return 1e-4 * min(0.0, float(self.pull(self.slope) @ moved)) + 1e-13 * abs(self.value)

    def retried(self):
        if self.halved % 6:
            return super().retried()
        self.pairs.clear()  # what was learned leads astray: anew, down the slope
        self.down = max(self.down / 8, 1e-12)
        return self.step(self.slope, None)

    def learn(self, moved, slope):
        if self.slope is not None and moved @ (slope - self.slope) > 1e-12 * (moved @ moved):
            self.pairs.append((moved, slope - self.slope))
        self.slope = slope

    def over(self, moved, before, slope):
        # a small step alone says little here
        self.still = self.still + 1 if before - self.value <= self.least * max(1.0, abs(self.value)) and (moved <= self.tol or self.least > 1e-12) else 0
        return self.still >= 3 or np.abs(self.pull(slope)).max() <= 1e-7 * max(1.0, abs(self.value))

    def step(self, slope, second):
        pull = self.pull(slope)
        q, used = pull.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        q *= (self.pairs[-1][0] @ self.pairs[-1][1]) / (self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else self.down / max(1.0, np.linalg.norm(pull))
        for (s, y), a in zip(self.pairs, reversed(used), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        cornered = self.absolute > 0
        q[cornered & (q * pull <= 0)] = 0.0
        side = np.where(self.w != 0, np.sign(self.w), -np.sign(pull))
        new = self.w - q
        new[cornered & (new * side < 0)] = 0.0
        return new


def _settings(learner: Linear, n: int) -> tuple[str, float, float, int]:
    """Loss, strengths of squares and absolute values for a sum of n losses, and most rounds."""
    kind, penalty = type(learner).__name__, learner.get("penalty")
    share = {"l1": 1.0, "elasticnet": learner.get("l1_ratio") or 0.0}.get(penalty, 0.0)
    if kind == "SGD":
        if learner.get("loss") not in LOSSES:
            raise ValueError(f"{learner.get('loss')} has no single best coefficients; choose another loss for a node of so many rows")
        strength = 0.0 if penalty is None else learner.get("alpha") * n
        return learner.get("loss"), strength * (1 - share), strength * share, 200
    if penalty not in ("l2", "l1", "elasticnet", "none", None):
        raise ValueError(f"unknown penalty {penalty!r}")
    strength = 0.0 if penalty in ("none", None) else 1 / learner.get("C")
    return learner.get("loss") or "log_loss", strength * (1 - share), strength * share, learner.get("max_iter") * (1 if share == 0 else 10)


def _class_weights(how, n: int, inside: int) -> tuple[float, float]:
    if how is None:
        return 1.0, 1.0
    if isinstance(how, dict):
        of = {int(k): float(v) for k, v in how.items()}
        return of.get(1, 1.0), of.get(0, 1.0)
    if how != "balanced":
        raise ValueError(f"unknown class weights {how!r}")
    return n / (2 * max(1, inside)), n / (2 * max(1, n - inside))


def fit(rows: DataFrame, kind: type[Linear], kwargs: dict) -> list[tuple[int, int, list[float], float]]:
    """(node, cluster, coef, intercept) of one classifier against the rest for each cluster of each node.

    rows: (node, vec, clusters), read once for each step, so better a written table. The coefficients are those that kind.fit would end at with all
    rows in one place: for a regression its own, up to its tol; for a type that learns in passes, the least of the objective that its passes approach
    (corners of losses rounded by CORNER). Nodes are worked on together as far as their sums fit into DRIVER_BYTES.
    """
    learner = kind(**kwargs)
    sizes = {r["node"]: (r["n"], r["width"]) for r in rows.groupBy("node").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).collect()}
    inside: dict[int, dict[int, int]] = {node: {} for node in sizes}
    for r in rows.select("node", F.explode("clusters").alias("cluster")).groupBy("node", "cluster").agg(F.count("*").alias("n")).collect():
        inside[r["node"]][r["cluster"]] = r["n"]
    out: list[tuple[int, int, list[float], float]] = []
    waiting = sorted(sizes)
    while waiting:
        group, held = [], 0
        while waiting:
            n, width = sizes[waiting[0]]
            need = 8 * len(inside[waiting[0]]) * ((width + 1) ** 2 if width < MOST_CURVED else (width + 1) * 2 * (MEMORY + 2))
            if group and held + need > DRIVER_BYTES:
                break
            held += need
            group.append(waiting.pop(0))
        smooth = learner.get("loss") not in CORNERED
        for curved in (True, False):
            some = [g for g in group if (smooth and sizes[g][1] < MOST_CURVED) == curved]
            if some:
                out += _fit_group(rows.filter(F.col("node").isin(some)), some, sizes, inside, learner, curved)
    return out


def _fit_group(rows, group, sizes, inside, learner, curved):
    fits: dict[tuple[int, int], _Fit] = {}
    weights, loss, out = {}, "log_loss", []
    for node in group:
        n, width = sizes[node]
        loss, square, absolute, rounds = _settings(learner, n)
        for cluster, count in sorted(inside[node].items()):
            if count == n:  # nothing to tell apart
                out.append((node, cluster, [0.0] * width, 30.0))
                continue
            # a regression's tol is a step's; passes have another one
            tol = learner.get("tol") if type(learner).__name__ != "SGD" else 1e-5
            fits[node, cluster] = (Curved if curved else Learned)(width, square, absolute, bool(learner.get("fit_intercept")), tol, rounds)
            if loss in CORNERED and not curved:
                fits[node, cluster].least = 1e-6
            weights[node, cluster] = _class_weights(learner.get("class_weight"), n, count)
    while todo := {at: f for at, f in fits.items() if not f.done}:
        models = {}
        for node in sorted({at[0] for at in todo}):
            own = sorted(c for n, c in todo if n == node)
            models[node] = own, np.stack([todo[node, c].propose() for c in own]), np.array([weights[node, c] for c in own])
        parts: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for r in sums(rows.filter(F.col("node").isin(list(models))), models, loss, curved).toLocalIterator():
            parts.setdefault((r["node"], r["cluster"]), {})[r["chunk"]] = np.frombuffer(bytes(r["sums"]))
        for at, chunks in parts.items():
            row = np.concatenate([chunks[k] for k in sorted(chunks)])
            width = len(todo[at].w)
            todo[at].tell(row[0], row[1 : width + 1].copy(), row[width + 1 :].reshape(width, width) if curved else None)
    return out + [(node, cluster, f.w[:-1].tolist(), float(f.w[-1]) if f.intercept else 0.0) for (node, cluster), f in fits.items()]
