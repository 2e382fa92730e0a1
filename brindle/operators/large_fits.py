"""Forests, boosted trees and kernel machines of nodes whose rows lie in many tasks.

rows are (node, mention_id, vec, clusters), read once for each pass; results are (node, cluster, model), the model being the classifier's text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.blocks import matrix
from brindle.operators import linear
from brindle.operators.classifiers import Boosted, Forest, KernelSVC, _how_many, _sigmoid, walk

#: Rows that one tree of a forest is grown on, rows that bins' bounds and landmarks are drawn from, bins of a feature, and landmarks.
TREE_ROWS, SAMPLE_ROWS, BINS, LANDMARKS = 20_000, 20_000, 64, 512
_MODEL = "node long, cluster int, model string"


def _draws(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for each row, the same whenever it is read."""
    h = ids.astype(np.int64).view(np.uint64) + np.array((salt + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def _inside(rows: pd.DataFrame, cluster: int) -> np.ndarray:
    return np.array([cluster in own for own in rows["clusters"]], float)


def forests(rows: DataFrame, kwargs: dict) -> DataFrame:
    """Each tree is grown by one task on rows of its own, drawn with repeats (without, unless bootstrap) from all rows of the node: as many as max_samples says, TREE_ROWS at most."""
    learner = Forest(**kwargs)
    trees, seed, repeats = learner.get("n_estimators"), learner.get("random_state") or 0, bool(learner.get("bootstrap"))
    sizes = {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect()}
    rates = {node: min(_how_many(learner.get("max_samples") if repeats else None, n), TREE_ROWS) / n for node, n in sizes.items()}

    def deal(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            nodes, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rate = np.array([rates[n] for n in nodes.tolist()])
            for t in range(trees):
                u = _draws(ids, seed * 100_003 + t)
                if repeats:  # how often a row is drawn, by its share of all draws
                    times, part = np.zeros(len(u), int), np.exp(-rate)
                    total = part.copy()
                    for k in range(1, 12):
                        times += u >= total
                        part = part * rate / k
                        total += part
                else:
                    times = (u < rate).astype(int)
                again = pa.array(np.repeat(np.arange(len(u)), times))
                if len(again):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(np.full(len(again), t, np.int32)), batch.column(2).take(again), batch.column(3).take(again)], ["node", "tree", "vec", "clusters"])

    def grown(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        x, out = np.stack(some["vec"].to_numpy()), []
        for c in sorted({c for own in some["clusters"] for c in own}):
            one = Forest(**(kwargs | {"n_estimators": 1, "bootstrap": False, "max_samples": None, "random_state": seed * 1000 + int(key[1])}))
            one.fit(x, _inside(some, c))
            out.append((key[0], c, json.dumps(one.state["trees"][0] if "trees" in one.state else [[one.state["constant"]]])))
        return pd.DataFrame(out, columns=["node", "cluster", "tree"])

    def whole(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        out = Forest(**kwargs)
        # a tree that never met the cluster says no
        out.state = {"trees": [json.loads(t) for t in some["tree"]] + [[[0.0]]] * (trees - len(some))}
        return pd.DataFrame([(key[0], key[1], out.dumps())], columns=["node", "cluster", "model"])

    dealt = rows.select("node", "mention_id", "vec", "clusters").mapInArrow(deal, "node long, tree int, vec array<double>, clusters array<int>")
    each = dealt.groupBy("node", "tree").applyInPandas(grown, "node long, cluster int, tree string")
    return each.groupBy("node", "cluster").applyInPandas(whole, _MODEL)


class _Boosting:
    """The trees of one cluster: cuts are chosen from sums of slopes, curvatures and rows by leaf, feature and bin."""

    def __init__(self, kwargs: dict, bounds: list[np.ndarray], n: int, inside: int):
        self.learner = Boosted(**kwargs)
        self.bounds, self.trees, self.done = bounds, [], False
        self.weights = linear._class_weights(self.learner.get("class_weight"), n, inside)
        share = self.weights[0] * inside / (self.weights[0] * inside + self.weights[1] * (n - inside))
        self.base = float(np.log(share / (1 - share)))
        self._begin()

    def _begin(self) -> None:
        get, k = self.learner.get, len(self.trees)
        rng = np.random.default_rng((get("random_state") or 0) * 1009 + k)
        self.columns = np.sort(rng.choice(len(self.bounds), _how_many(float(get("colsample_bytree")), len(self.bounds)), replace=False))
        self.tree: list[list] = [[0.0]]
        self.open = {0: 0}  # leaves that may be split, with their levels
        self.part = (get("subsample"), k // get("subsample_freq")) if get("subsample_freq") and get("subsample") < 1 else (1.0, 0)

    def told(self) -> dict:
        """What a task needs to know."""
        return {"base": self.base, "rate": self.learner.get("learning_rate"), "trees": self.trees, "tree": self.tree, "open": sorted(self.open), "columns": self.columns, "weights": self.weights, "part": self.part, "seed": self.learner.get("random_state") or 0}

    def tell(self, sums: np.ndarray) -> None:
        """sums: (open leaves, columns, bins, 3)."""
        get = self.learner.get
        l1, l2 = get("reg_alpha"), get("reg_lambda")
        strength = lambda a: np.sign(a) * np.maximum(np.abs(a) - l1, 0)
        score = lambda a, b: strength(a) ** 2 / np.maximum(b + l2, 1e-300)
        found = []
        for leaf, own in zip(sorted(self.open), sums, strict=True):
            g, h, n = own[0].sum(0)
            self.tree[leaf] = [float(strength(g) / max(h + l2, 1e-300))]
            left = np.cumsum(own, 1)[:, :-1]
            a, b, m = left[..., 0], left[..., 1], left[..., 2]
            gain = score(a, b) + score(g - a, h - b) - score(g, h)
            least, least_h = get("min_child_samples"), get("min_child_weight")
            gain[(m < least) | (n - m < least) | (b < least_h) | (h - b < least_h)] = -np.inf
            if gain.size and gain.max() > max(get("min_split_gain"), 1e-12) and (get("max_depth") <= 0 or self.open[leaf] < get("max_depth")):
                j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                if k < len(self.bounds[self.columns[j]]):
                    found.append((float(gain.max()), leaf, int(self.columns[j]), float(self.bounds[self.columns[j]][k])))
        leaves = sum(len(x) == 1 for x in self.tree)
        levels, self.open = self.open, {}
        for _, leaf, feature, cut in sorted(found, key=lambda x: (-x[0], x[1]))[: max(0, get("num_leaves") - leaves)]:
            self.tree[leaf] = [feature, cut, len(self.tree), len(self.tree) + 1]
            for _side in range(2):
                self.open[len(self.tree)] = levels[leaf] + 1
                self.tree.append([0.0])
        if not self.open:
            self.trees.append(self.tree)
            if len(self.trees) >= get("n_estimators") or len(self.tree) == 1:
                self.done = True
            else:
                self._begin()

    def model(self) -> str:
        self.learner.state = {"base": self.base, "trees": self.trees}
        return self.learner.dumps()


def _leaves(tree: list[list], x: np.ndarray) -> np.ndarray:
    """The place of each row's leaf."""
    return walk([n if len(n) > 1 else [k] for k, n in enumerate(tree)], x).astype(int)


def _counting(told: dict[int, dict[int, dict]], bounds: dict[int, list[np.ndarray]]):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in incoming:
            nodes = batch.column(0).to_numpy()
            for node in np.unique(nodes).tolist():
                if node not in told:
                    continue
                rows = batch.filter(pa.array(nodes == node))
                ids, x, own = rows.column(1).to_numpy(), matrix(rows.column(2)), rows.column(3)
                codes = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds[node])])
                whose, of = np.repeat(np.arange(len(x)), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy()
                for cluster, t in told[node].items():
                    y = np.zeros(len(x))
                    y[whose[of == cluster]] = 1.0
                    weight = np.where(y > 0, *t["weights"])
                    p = _sigmoid(t["base"] + t["rate"] * sum((walk(tree, x) for tree in t["trees"]), np.zeros(len(x))))
                    leaf = np.searchsorted(t["open"], at := _leaves(t["tree"], x))
                    leaf[leaf == len(t["open"])] = 0
                    good = np.asarray(t["open"])[leaf] == at
                    if t["part"][0] < 1:
                        good &= _draws(ids, t["seed"] * 7919 + t["part"][1]) < t["part"][0]
                    values = np.stack((weight * (y - p), weight * p * (1 - p), np.ones(len(x))))[:, good]
                    sums = np.zeros((len(t["open"]), len(t["columns"]), BINS, 3))
                    for j, f in enumerate(t["columns"].tolist()):
                        place = leaf[good] * BINS + codes[f][good]
                        for v in range(3):
                            sums[:, j, :, v] = np.bincount(place, values[v], len(t["open"]) * BINS).reshape(-1, BINS)
                    total[node, cluster] = total[node, cluster] + sums if (node, cluster) in total else sums
        for (node, cluster), sums in total.items():
            flat = sums.ravel()
            for chunk, low in enumerate(range(0, len(flat), linear.PER_CHUNK)):
                part = flat[low : low + linear.PER_CHUNK].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((node, pa.int64()), (cluster, pa.int32()), (chunk, pa.int32()), (part, pa.binary()))], ["node", "cluster", "chunk", "sums"])

    return run


def _drawn(rows: DataFrame, node: int, most: int) -> np.ndarray:
    got = rows.filter(F.col("node") == node).orderBy(F.xxhash64("mention_id"), "mention_id").limit(most).select("vec").toArrow()
    return matrix(got["vec"])


def boosted(rows: DataFrame, kwargs: dict) -> list[tuple[int, int, str]]:
    """Trees are grown level by level over all rows: each pass sums slopes and curvatures by leaf, feature and bin, and the driver chooses the cuts. Bins are bounded by quantiles of
    SAMPLE_ROWS rows; of a level's leaves those of the greatest gain are split until num_leaves are there."""
    sizes = {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect()}
    bounds: dict[int, list[np.ndarray]] = {}
    for node in sizes:
        sample = _drawn(rows, node, SAMPLE_ROWS)
        bounds[node] = []
        for column in sample.T:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf"))
            sorted_ = np.unique(column)
            after = sorted_[np.minimum(np.searchsorted(sorted_, values, "right"), len(sorted_) - 1)]
            bounds[node].append(np.unique((values + after) / 2)[: BINS - 1])
    fits, out = {}, []
    for r in rows.select("node", F.explode("clusters").alias("cluster")).groupBy("node", "cluster").agg(F.count("*").alias("n")).collect():
        n = sizes[r["node"]]
        if r["n"] == n:
            constant = Boosted(**kwargs)
            constant.state = {"constant": 1.0}
            out.append((r["node"], r["cluster"], constant.dumps()))
        else:
            fits[r["node"], r["cluster"]] = _Boosting(kwargs, bounds[r["node"]], n, r["n"])
    while todo := {at: f for at, f in fits.items() if not f.done}:
        told: dict[int, dict[int, dict]] = {}
        for (node, cluster), f in todo.items():
            told.setdefault(node, {})[cluster] = f.told()
        parts = rows.filter(F.col("node").isin(list(told))).select("node", "mention_id", "vec", "clusters").mapInArrow(_counting(told, bounds), "node long, cluster int, chunk int, sums binary")
        summed: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        together = parts.repartition("node", "cluster", "chunk").sortWithinPartitions("node", "cluster", "chunk").mapInArrow(linear._adding, "node long, cluster int, chunk int, sums binary")
        for r in together.toLocalIterator():
            summed.setdefault((r["node"], r["cluster"]), {})[r["chunk"]] = np.frombuffer(bytes(r["sums"]))
        for at, chunks in summed.items():
            f = todo[at]
            f.tell(np.concatenate([chunks[k] for k in sorted(chunks)]).reshape(len(f.open), len(f.columns), BINS, 3))
    return out + [(node, cluster, f.model()) for (node, cluster), f in fits.items()]


def kernels(rows: DataFrame, kwargs: dict) -> list[tuple[int, int, str]]:
    """Kernel machines by landmarks: LANDMARKS rows of a node stand for its kernel, in whose terms each row is a vector; the machine is then linear and is fitted by sums over all rows, and so is
    the curve that makes probabilities of its decisions."""
    from brindle.sources.files import checkpointed

    out = []
    for node, n in [(r["node"], r["n"]) for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect()]:
        own = rows.filter(F.col("node") == node)
        sample = _drawn(rows, node, SAMPLE_ROWS)
        machine = KernelSVC(**kwargs)
        gamma = machine.get("gamma")
        machine.state["gamma"] = 1 / max(1e-12, sample.shape[1] * sample.var()) if gamma == "scale" else 1 / sample.shape[1] if gamma == "auto" else float(gamma)
        marks = np.unique(sample[:LANDMARKS], axis=0)
        values, vectors = np.linalg.eigh(machine._kernel(marks, marks) + 1)
        kept = values > 1e-10 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])  # rows' kernels with the landmarks, times this, have the kernel as inner product

        def map_rows(batches, machine=machine, marks=marks, root=root):
            for batch in batches:
                vec = (machine._kernel(matrix(batch.column(2)), marks) + 1) @ root
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * vec.shape[1]), pa.array(vec.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, batch.column(3)], ["node", "mention_id", "vec", "clusters"])

        mapped = checkpointed(own.select("node", "mention_id", "vec", "clusters").mapInArrow(map_rows, "node long, mention_id long, vec array<double>, clusters array<int>"))
        for _, cluster, coef, intercept in linear.fit(mapped, _Machine, {"C": machine.get("C"), "class_weight": machine.get("class_weight")}):
            found = KernelSVC(**kwargs)
            if not any(coef):
                found.state = {"constant": 1.0} if intercept > 0 else {"constant": 0.0}
            else:
                w = np.array(coef)
                decided = mapped.mapInArrow(_decided(w, cluster), "node long, vec array<double>, clusters array<int>")
                curve = linear.fit(checkpointed(decided), _Curve, {"C": 1e3})
                slope, start = next((c[0], i) for _, k, c, i in curve if k == cluster)
                found.state = {"gamma": machine.state["gamma"], "support": marks.tolist(), "dual": (root @ w).tolist(), "curve": [slope, start]}
            out.append((node, cluster, found.dumps()))
    return out


def _decided(w: np.ndarray, cluster: int):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            decision = matrix(batch.column(2)) @ w
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(decision) + 1, dtype=np.int32)), pa.array(decision))
            of = pa.array([[cluster] if cluster in own else [] for own in batch.column(3).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, of], ["node", "vec", "clusters"])

    return run


class _Machine(linear.Linear):
    """Half the squares of the coefficients, and C times the sum of what margins lack; the bias is one of the kernel's terms."""

    known = {"C": 1.0, "class_weight": None, "penalty": "l2", "loss": "hinge", "fit_intercept": False, "tol": 1e-5, "max_iter": 200}


class _Curve(linear.Linear):
    known = {"C": 1.0, "class_weight": None, "penalty": "l2", "fit_intercept": True, "tol": 1e-6, "max_iter": 100}
