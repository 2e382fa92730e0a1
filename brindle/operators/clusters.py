"""Clustering of vectors by cosine."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.blocks import width_of
from brindle.functions.vectors import dot, norm
from brindle.operators import large_clusters as large
from brindle.operators.large_clusters import directions, nearness
from brindle.sources.files import checkpointed


def assign(rows: DataFrame, centroids: list[list[float]], vector: str = "e", digits: int = 9) -> DataFrame:
    """Add cluster: the centroid of greatest cosine, compared at so many digits, ties to the lower one."""
    score = [F.round(dot(F.col(vector), F.array(*map(F.lit, c))) / F.greatest(F.lit(1e-12), norm(F.array(*map(F.lit, c)))), digits) for c in centroids]
    ordered = [F.struct(s.alias("s"), F.lit(-k).alias("k")) for k, s in enumerate(score)]
    best = F.greatest(*ordered) if len(ordered) > 1 else ordered[0]
    return rows.withColumn("cluster", -best["k"])


def lloyd(rows: DataFrame, start: list[list[float]], steps: int, vector: str = "e") -> DataFrame:
    """Cosine Lloyd iterations from given centroids: rows with their cluster after the last assignment.

    Each step is one pass with partial sums of a few centroids; these are all that goes to the driver. A
    cluster without members keeps its centroid.
    """
    centroids = start
    for _ in range(steps - 1):
        found = assign(rows, centroids, vector).select("cluster", F.posexplode(vector).alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("v")).collect()
        fresh = [list(c) for c in centroids]
        for r in found:
            fresh[r["cluster"]][r["k"]] = r["v"]
        centroids = fresh
    return assign(rows, centroids, vector)


def histogram(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.count("*").alias("size"))


def valid_clusters(assigned: DataFrame, least: int, label: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, new_id, size) of clusters of at least so many members, numbered anew by first appearance; none, if only one is left."""
    kept = assigned.groupBy(cluster).agg(F.count("*").alias("size"), F.min(label).alias("first")).filter(F.col("size") >= least)
    every = Window.partitionBy(F.lit(0))
    return kept.withColumn("n", F.count("*").over(every)).filter("n > 1").withColumn("new_id", F.row_number().over(Window.orderBy("first")) - 1).select(cluster, "new_id", "size")


def members(assigned: DataFrame, label: str, cluster: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.array_sort(F.collect_list(label)).alias("labels"))


def balanced_assignment(similarity: np.ndarray) -> np.ndarray:
    """Clusters of near equal size: pairs by falling similarity, until a cluster is full."""
    n, k = similarity.shape
    room = np.full(k, n // k)
    extra = n - room.sum()
    out, left = np.full(n, -1), n
    for at in np.argsort(-np.round(similarity, 9), axis=None, kind="stable"):
        i, c = divmod(int(at), k)
        if out[i] < 0 and (room[c] > 0 or room[c] == 0 and extra > 0):
            if room[c] == 0:
                extra -= 1
                room[c] = -1  # one above its share
            else:
                room[c] -= 1
            out[i] = c
            left -= 1
            if not left:
                break
    return out


def _starts(u: np.ndarray, k: int, init, rng: np.random.Generator) -> np.ndarray:
    """First centres: given, drawn, or far apart from each other (k-means++)."""
    if not isinstance(init, str):
        return np.array(init, float)
    if init == "random":
        return u[rng.choice(len(u), k, replace=False)]
    if init not in ("k-means++", "scalable-k-means++", "k-means||"):
        raise ValueError(f"unknown init {init!r}")
    centres = [u[0]]
    for _ in range(1, k):
        far = np.min([((u - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(u[rng.choice(len(u), p=far / far.sum())] if far.sum() > 0 else u[rng.integers(len(u))])
    return np.array(centres)


def kmeans(z: np.ndarray, k: int, rounds: int = 300, balanced: bool = False, seed: int = 0, cosine: bool = True, tol: float = 0.0, init="k-means++") -> np.ndarray:
    """Clusters of rows; zero rows go to the nearest like others. Ends when nothing changes, or when the centres' moves, squared, are
    together at most tol times the rows' mean variance."""
    rng, u = np.random.default_rng(seed), directions(z, cosine)
    k = min(k, len(z))
    c, label, least = _starts(u, k, init, rng), None, tol * u.var(0).mean()
    for _ in range(rounds):
        near = nearness(u, c, cosine)
        new = balanced_assignment(near) if balanced else np.round(near, 9).argmax(1)
        if label is not None and (new == label).all():
            break
        label, moved = new, 0.0
        for j in range(k):
            if (label == j).any():
                m = u[label == j].mean(0)
                m = m / (np.linalg.norm(m) or 1) if cosine else m
                moved += ((m - c[j]) ** 2).sum()
                c[j] = m
        if tol and moved <= least:
            break
    return label


def mini_batches(z: np.ndarray, k: int, rounds: int, seed: int, batch: int, tol: float, idle: int | None, init, init_size: int | None, ratio: float) -> np.ndarray:
    """k-means of which each step moves the centres by the mean of a batch, less and less. Centres with a small share of the rows seen
    (ratio of the greatest) start anew at rows of the batch."""
    rng, n = np.random.default_rng(seed), len(z)
    k, batch = min(k, n), min(n, batch)
    first = z[rng.choice(n, min(n, init_size or 3 * batch if (init_size or 3 * batch) >= k else k), replace=False)]
    c, seen, mean, best, still = _starts(first, k, init, rng), np.zeros(k), None, np.inf, 0
    for step in range(max(1, rounds * n // batch)):
        rows = z[rng.choice(n, batch, replace=False)]
        distance = (rows * rows).sum(1)[:, None] - nearness(rows, c, False)
        label, old = distance.argmin(1), c.copy()
        for j in range(k):
            own = rows[label == j]
            if len(own):
                seen[j] += len(own)
                c[j] += (own.sum(0) - len(own) * c[j]) / seen[j]
        if ratio and step % 10 == 9 and (seen < ratio * seen.max()).any():
            low = np.flatnonzero(seen < ratio * seen.max())[: batch // 2]
            c[low] = rows[rng.choice(batch, len(low), replace=False)]
            seen[low] = max(1.0, seen[seen >= ratio * seen.max()].min())
        inertia = max(0.0, float(distance.min(1).mean()))
        share = min(1.0, 2 * batch / (n + 1))
        mean = inertia if mean is None else mean * (1 - share) + inertia * share
        still = 0 if mean < best else still + 1
        best = min(best, mean)
        if idle is not None and still >= idle or tol and ((c - old) ** 2).sum() <= tol * z.var(0).mean():
            break
    return np.round(nearness(z, c, False), 9).argmax(1)


#: Bytes that a matrix of all distances may have.
MATRIX_BYTES = 1 << 31


def needs_matrix(linkage: str, metric: str) -> bool:
    """Whether distances of clusters don't follow from their sums: then all distances of rows are held."""
    return not (linkage in ("ward", "single") or linkage == "average" and metric == "cosine")


def _distances(z: np.ndarray, row: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("euclidean", "l2"):
        return np.sqrt(((z - row) ** 2).sum(1))
    if metric == "cosine":
        return 1 - z @ row  # of directions
    if metric in ("manhattan", "l1", "cityblock"):
        return np.abs(z - row).sum(1)
    raise ValueError(f"unknown metric {metric!r}")


class _BySums:
    """Distances of clusters from their sums: no more is held than the rows themselves."""

    def __init__(self, z: np.ndarray, linkage: str):
        self.ward, self.sums, self.size, self.at = linkage == "ward", z.astype(float).copy(), np.ones(len(z)), np.arange(len(z))

    def near(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Open clusters, ascending, and how far each is from a."""
        size, centres = self.size[self.at], self.sums[self.at] / self.size[self.at, None]
        own = self.sums[a] / self.size[a]
        far = np.sqrt(2 * self.size[a] * size / (self.size[a] + size) * ((centres - own) ** 2).sum(1)) if self.ward else 1 - centres @ own
        far[np.searchsorted(self.at, a)] = np.inf
        return self.at, far

    def join(self, a: int, b: int) -> None:
        self.sums[a] += self.sums[b]
        self.size[a] += self.size[b]
        self.at = self.at[self.at != b]


class _ByMatrix:
    """All distances are held, and follow each join."""

    def __init__(self, z: np.ndarray, linkage: str, metric: str):
        self.d = np.array([_distances(z, row, metric) for row in z])
        np.fill_diagonal(self.d, np.inf)
        self.linkage, self.size, self.at = linkage, np.ones(len(z)), np.arange(len(z))

    def near(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at, self.d[a, self.at]

    def join(self, a: int, b: int) -> None:
        d, size = self.d, self.size
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b]) if self.linkage == "average" else np.maximum(d[a], d[b])
        new[[a, b]] = np.inf
        d[a], d[:, a] = new, new
        size[a] += size[b]
        self.at = self.at[self.at != b]


def _chained(clusters: _BySums | _ByMatrix, n: int) -> list[tuple[float, int, int]]:
    """Joins by chains of nearest neighbours: each step follows them until two are each other's nearest, which joins them in any order."""
    joins, chain = [], []
    while len(joins) < n - 1:
        if not chain:
            chain.append(int(clusters.at[0]))
        while True:
            at, far = clusters.near(chain[-1])
            k = int(far.argmin())
            to, apart = int(at[k]), far[k]
            if len(chain) > 1 and far[np.searchsorted(at, chain[-2])] <= apart:
                to, apart = chain[-2], far[np.searchsorted(at, chain[-2])]
                break
            chain.append(to)
        a, b = chain.pop(), chain.pop()
        a, b = min(a, b), max(a, b)
        joins.append((float(apart), a, b))
        clusters.join(a, b)
    return joins


def _spanned(z: np.ndarray, metric: str) -> list[tuple[float, int, int]]:
    """Joins of single linkage: the edges of a least spanning tree, which takes in the nearest row at a time."""
    open_, far, to = np.ones(len(z), bool), np.full(len(z), np.inf), np.zeros(len(z), int)
    joins, last = [], 0
    open_[0] = False
    for _ in range(len(z) - 1):
        d = _distances(z, z[last], metric)
        closer = d < far
        far[closer], to[closer] = d[closer], last
        last = int(np.where(open_, far, np.inf).argmin())
        joins.append((float(far[last]), min(last, int(to[last])), max(last, int(to[last]))))
        open_[last] = False
    return joins


def agglomerate(z: np.ndarray, k: int | None, linkage: str = "ward", metric: str = "euclidean", threshold: float | None = None) -> np.ndarray:
    """Agglomerative clusters: the closest two are joined until k are left, or none is closer than threshold.

    Takes time of the square of the rows, and memory of the rows; complete and most average linkages hold all distances (MATRIX_BYTES at most).
    """
    n = len(z)
    if linkage not in ("ward", "complete", "average", "single"):
        raise ValueError(f"unknown linkage {linkage!r}")
    metric = "euclidean" if linkage == "ward" else metric
    z = directions(z, metric == "cosine")
    _distances(z[:1], z[0], metric)
    if linkage == "single":
        joins = _spanned(z, metric)
    elif needs_matrix(linkage, metric):
        if n * n * 8 > MATRIX_BYTES:
            raise ValueError(f"{n} rows are too many for {linkage} linkage")
        joins = _chained(_ByMatrix(z, linkage, metric), n)
    else:
        joins = _chained(_BySums(z, linkage), n)
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # the lowest joins, in order; a chain finds them out of order
    joins.sort(key=lambda j: j[0])
    kept = joins[: n - k] if threshold is None else [j for j in joins if j[0] < threshold]
    for _, a, b in kept:
        root[max(find(a), find(b))] = min(find(a), find(b))
    _, label = np.unique([find(i) for i in range(n)], return_inverse=True)
    return label


#: Options that say how fast, how loudly or where to work, or that only touch what else the method could return.
_INERT = frozenset("verbose n_jobs tqdm_flag device gpu handle output_type copy_x convert_dtype compute_labels memory compute_full_tree compute_distances max_samples_per_batch oversampling_factor algorithm".split())


def _make(method, known: dict, only: dict | None = None):
    """A clusterer of rows and options; each option is honoured, can't change the result, or is refused."""

    def run(z: np.ndarray, kwargs: dict) -> np.ndarray:
        if wrong := set(kwargs) - set(known) - set(only or {}) - _INERT:
            raise ValueError(f"unknown clustering parameters: {sorted(wrong)}")
        for name, allowed in (only or {}).items():
            if name in kwargs and kwargs[name] not in allowed:
                raise ValueError(f"{name} is known only as {list(allowed)}, not {kwargs[name]!r}")
        return method(z, **(known | kwargs_of(kwargs, known)))

    return run


def kwargs_of(kwargs: dict, known: dict) -> dict:
    return {k: v for k, v in kwargs.items() if k in known}


def _inertia(z: np.ndarray, label: np.ndarray) -> float:
    return sum(float(((z[label == j] - z[label == j].mean(0)) ** 2).sum()) for j in set(label.tolist()))


def _plain(z, n_clusters, init, n_init, max_iter, tol, random_state):
    """The best of n_init starts."""
    starts = (1 if init != "random" else 10) if n_init == "auto" else n_init
    found = [kmeans(z, n_clusters, max_iter, seed=(random_state or 0) + r, cosine=False, tol=tol, init=init) for r in range(starts)]
    return min(found, key=lambda label: _inertia(z, label)) if starts > 1 else found[0]


def _in_batches(z, n_clusters, init, max_iter, batch_size, random_state, tol, max_no_improvement, init_size, n_init, reassignment_ratio):
    batch = batch_size if batch_size > 0 else max(1, len(z) // (os.cpu_count() or 1))
    starts = (1 if init != "random" else 3) if n_init == "auto" else n_init
    found = [mini_batches(z, n_clusters, max_iter, (random_state or 0) + r, batch, tol, max_no_improvement, init, init_size, reassignment_ratio) for r in range(starts)]
    return min(found, key=lambda label: _inertia(z, label)) if starts > 1 else found[0]


def _redone(z, n_clusters, max_iter, tol, random_state, nredo, spherical):
    found = [kmeans(z, n_clusters, max_iter, seed=(random_state or 0) + r, cosine=spherical, tol=tol) for r in range(max(1, nredo))]
    return min(found, key=lambda label: _inertia(z, label))


def _balanced(z, n_clusters, distance, tol, iter_limit, random_state):
    if distance not in ("cosine", "euclidean"):
        raise ValueError(f"unknown distance {distance!r}")
    return kmeans(z, n_clusters, iter_limit, balanced=True, seed=random_state or 0, cosine=distance == "cosine", tol=tol)


def _joined(z, n_clusters, metric, linkage, distance_threshold):
    return agglomerate(z, n_clusters, linkage, metric, distance_threshold)


_KMEANS = {"n_clusters": 8, "init": "k-means++", "n_init": "auto", "max_iter": 300, "tol": 1e-4, "random_state": None}
#: Clusterers by type name. Types for other hardware are the same method here.
CLUSTERERS = {
    "sklearnagglomerativeclustering": _make(_joined, {"n_clusters": 2, "metric": "euclidean", "linkage": "ward", "distance_threshold": None}, {"connectivity": (None,)}),
    "sklearnkmeans": _make(_plain, _KMEANS),
    "sklearnminibatchkmeans": _make(_in_batches, _KMEANS | {"tol": 0.0, "batch_size": 0, "max_no_improvement": 10, "init_size": None, "reassignment_ratio": 0.01}),
    "cumlkmeans": _make(_plain, _KMEANS | {"init": "scalable-k-means++", "n_init": 1, "random_state": 1}),
    "faisskmeans": _make(_redone, {"n_clusters": 8, "max_iter": 300, "tol": 1e-4, "random_state": 42, "nredo": 3, "spherical": False}),
    "balancedkmeans": _make(_balanced, {"n_clusters": 8, "distance": "cosine", "tol": 1e-4, "iter_limit": 400, "random_state": None}, {"iter_k": (None,), "gamma_for_soft_dtw": (0.001,)}),
}


def register_clusterer(name: str, method) -> None:
    """Make a type known by name: a function of the rows and a dictionary of options that gives a cluster for each row."""
    CLUSTERERS[name.lower()] = method


def resolved(config: dict | None, kinds: dict, default: str) -> tuple[str, dict]:
    """Type and parameters of a component's configuration, which is left as it is."""
    config = dict(config or {"type": default})
    kind = str(config.get("type", default)).lower()
    if kind not in kinds:
        raise ValueError(f"unknown type {kind!r}; known: {sorted(kinds)}")
    return kind, dict(config.get("kwargs") or {})


#: Labels of a node that one task clusters, and bytes of their vectors; a sample of so many of a larger node is joined step by step.
NODE_LABELS, NODE_BYTES, SAMPLE_LABELS = 200_000, 256 << 20, 10_000


def node_labels(width: int) -> int:
    return max(2, min(NODE_LABELS, NODE_BYTES // (8 * max(1, width))))


def _large_settings(kind: str, kwargs: dict) -> dict:
    """What the type's options mean for rounds over all labels."""
    given = {k: v for k, v in kwargs.items() if v is not None}
    seed = given.get("random_state", 42 if kind == "faisskmeans" else 1 if kind == "cumlkmeans" else 0)
    if kind == "balancedkmeans":
        return {"init": "k-means++", "cosine": given.get("distance", "cosine") == "cosine", "rounds": given.get("iter_limit", 400), "tol": given.get("tol", 1e-4), "seed": seed, "n": 1, "balanced": True}
    if kind == "faisskmeans":
        return {"init": "k-means++", "cosine": given.get("spherical", False), "rounds": given.get("max_iter", 300), "tol": given.get("tol", 1e-4), "seed": seed, "n": max(1, given.get("nredo", 3)), "balanced": False}
    init, n = given.get("init", "k-means++"), given.get("n_init", "auto")
    tries = (1 if not isinstance(init, str) or init != "random" else 3 if kind == "sklearnminibatchkmeans" else 10) if n == "auto" else n
    return {"init": init, "cosine": False, "rounds": given.get("max_iter", 300), "tol": given.get("tol", 0.0 if kind == "sklearnminibatchkmeans" else 1e-4), "seed": seed, "n": tries, "balanced": False}


def _joined_sample(rows: DataFrame, kind: str, kwargs: dict) -> np.ndarray:
    """Centres of the clusters of a sample, which one task finds."""
    sample = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_LABELS).select(F.lit(0).alias("one"), "label_id", "z")

    def split(some: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(some.sort_values("label_id")["z"].to_numpy())
        label = CLUSTERERS[kind](z, kwargs)
        return pd.DataFrame({"centre": [z[label == c].mean(0) for c in sorted(set(label.tolist()))]})

    return np.array([r["centre"] for r in sample.groupBy("one").applyInPandas(split, "centre array<double>").collect()])


def _large_node(rows: DataFrame, kind: str, kwargs: dict, least: int) -> DataFrame:
    """Clusters of one node of many labels, in rounds over all of them with the type's own distance, starts, limits and equal sizes.

    Mini-batches are whole passes here. Types that join the closest, and registered ones, cluster a sample; its centres take the other labels.
    """
    k = kwargs["n_clusters"]
    if kind in ("balancedkmeans", "faisskmeans", "sklearnkmeans", "sklearnminibatchkmeans", "cumlkmeans"):
        how = _large_settings(kind, kwargs)
        cosine, balanced = how["cosine"], how["balanced"]
        tries = [large.centres_of(rows, k, how["init"], cosine, how["rounds"], how["tol"], how["seed"] + t, balanced) for t in range(how["n"])]
        centres, prices, _ = min(tries, key=lambda t: t[2])
    else:
        centres, cosine, balanced = _joined_sample(rows, kind, kwargs), False, False
        prices = np.zeros(len(centres))
    found = large.assigned(rows, centres, prices, cosine)
    found = large.evened(found, len(centres)) if balanced else checkpointed(found)
    sizes = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    valid = sorted(c for c, n in sizes.items() if n >= least)
    if len(valid) < 2:
        return found.limit(0).select("node", "label_id", "cluster")
    # labels of clusters that are too small go to the nearest valid one
    own = F.when(F.col("cluster").isin(valid), F.col("cluster"))
    offers = F.array_max(F.array(*(F.struct(F.col("near")[c].alias("near"), F.lit(-c).alias("c")) for c in valid)))
    number = F.array_position(F.array(*map(F.lit, valid)), F.coalesce(own, -offers["c"])) - 1
    return found.select("node", "label_id", number.cast("int").alias("cluster"))


def cluster_nodes(z: DataFrame, config: dict | None, least: int) -> DataFrame:
    """Clusters of each node's labels: (node, label_id, z) gives (node, label_id, cluster).

    A node of at most `least` labels, or with fewer than two clusters of that size, is not split and
    gives no rows. Labels of clusters that are too small go to the valid one nearest to them. One task holds the labels of a node, but
    those of a node with more than node_labels are worked on by all.
    """
    kind, kwargs = resolved(config, CLUSTERERS, "balancedkmeans")
    kwargs.setdefault("n_clusters", 2)

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label_id")
        none = pd.DataFrame({"node": [], "label_id": [], "cluster": []}).astype({"node": "int64", "label_id": "int64", "cluster": "int32"})
        if len(rows) <= least:
            return none
        vectors = np.stack(rows["z"].to_numpy())
        label = CLUSTERERS[kind](vectors, kwargs)
        first = {c: k for k, c in reversed(list(enumerate(label)))}
        valid = sorted((c for c in first if (label == c).sum() >= least), key=first.get)
        if len(valid) < 2:
            return none
        centres = np.stack([vectors[label == c].mean(0) for c in valid])
        centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
        own = np.array([valid.index(c) if c in valid else -1 for c in label])
        lost = own < 0
        own[lost] = (vectors[lost] @ centres.T).argmax(1)
        return pd.DataFrame({"node": key[0], "label_id": rows["label_id"].to_numpy(), "cluster": own.astype("int32")})

    most = node_labels(width_of(z, "z"))
    if kind == "sklearnagglomerativeclustering" and needs_matrix(kwargs.get("linkage", "ward"), kwargs.get("metric", "euclidean")):
        most = min(most, int((MATRIX_BYTES / 8) ** 0.5))
    many = [r["node"] for r in z.groupBy("node").count().filter(F.col("count") > most).collect()]
    small = z.filter(~F.col("node").isin(many)) if many else z
    out = small.groupBy("node").applyInPandas(split, "node long, label_id long, cluster int")
    for node in many:
        out = out.unionByName(_large_node(z.filter(F.col("node") == node), kind, kwargs, least))
    return out
