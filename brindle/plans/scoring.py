"""Scores of a node's clusters and labels: models are held, vectors pass by once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.blocks import held_rows, matrix, meet, table
from brindle.operators.classifiers import Classifier

#: Bytes of a row's text or vectors that a held ranker takes, where it isn't linear.
MODEL_BYTES = 1 << 16
#: A node's matchers are held together.
ALL_HELD = 2**31 - 1


def _sigmoid(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -700, 700)))


class _Clusters:
    """Probabilities of all clusters of a node, of which the keep best stay: ties to the lower cluster, compared at nine digits."""

    keep = 0

    def __init__(self, key: tuple, held: pa.Table):
        order = np.argsort(held["cluster"].to_numpy(), kind="stable")
        held = held.take(pa.array(order))
        self.node, self.clusters, self.child = key[0], held["cluster"].to_numpy(), held["child"].combine_chunks()
        if held["model"].null_count == len(held):
            self.coef, self.intercept, self.models = matrix(held["coef"]), held["intercept"].to_numpy(), None
        else:
            self.models = [Classifier.loads(t) for t in held["model"].to_pylist()]

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(rows.column("vec"))
        m = _sigmoid(x @ self.coef.T + self.intercept) if self.models is None else np.stack([c.predict_proba(x)[:, 1] for c in self.models], 1)
        n = min(self.keep or m.shape[1], m.shape[1])
        best = np.argsort(-np.round(m, 9), axis=1, kind="stable")[:, :n]
        flat = pa.array(best.ravel())
        fields = {"cluster": pa.array(self.clusters).cast(pa.int32()).take(flat), "m": pa.array(np.take_along_axis(m, best, 1).ravel()), "child": self.child.take(flat)}
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        own = {name: rows.column(name) for name in rows.schema.names}
        out = table({"node": np.full(len(x), self.node), **own, "best": lists, "sum": m.sum(1), "max": m.max(1)})
        yield out.filter(pa.array(m.max(1) > 0))

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def cluster_scores(rows: DataFrame, matchers: DataFrame, edges: DataFrame | None, id_col: str, keep: int = 0) -> DataFrame:
    """rows (node, id_col, vec, and more) with best, an array of the keep best clusters (cluster, m, child; all, if 0), sum and max of all scores.

    Rows whose greatest score isn't above 0 go. Each row's vector is moved once, to a task that holds its node's matchers.
    """
    children = edges if edges is not None else matchers.select("node", "cluster", F.lit(None).cast("long").alias("child")).limit(0)
    held = matchers.join(children, ["node", "cluster"], "left").select("node", F.col("cluster").cast("int").alias("cluster"), "coef", "intercept", "model", "child")
    names = {name: kind for name, kind in rows.dtypes if name != "node"}
    schema = ", ".join(["node long", *(f"`{name}` {kind}" for name, kind in names.items()), "best array<struct<cluster:int,m:double,child:bigint>>", "sum double", "max double"])
    return meet(held, rows, ["node"], "cluster", id_col, type("Clusters", (_Clusters,), {"keep": keep}), schema, ALL_HELD)


class _Labels:
    """Rankers of labels of a node: each row asks for those of its clusters. A label without a ranker has the score 1."""

    def __init__(self, key: tuple, held: pa.Table):
        order = np.lexsort((held["label_id"].to_numpy(), held["cluster"].to_numpy()))
        held = held.take(pa.array(order))
        self.node, self.labels = key[0], held["label_id"].to_numpy()
        clusters = held["cluster"].to_numpy()
        edges = [0, *(np.flatnonzero(clusters[1:] != clusters[:-1]) + 1).tolist(), len(clusters)]
        self.places = {int(clusters[low]): (low, high) for low, high in zip(edges[:-1], edges[1:], strict=True)}
        self.known = np.asarray(held["known"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        self.models = None
        if held["model"].null_count == len(held):
            width = max((len(v) for v in held["w"].to_pylist() if v is not None), default=0)
            self.w, self.bias = np.zeros((len(held), width)), np.nan_to_num(held["bias"].to_numpy())
            if self.known.any():
                self.w[self.known] = matrix(held["w"].combine_chunks().filter(pa.array(self.known)))
        else:
            self.models = [(Classifier.loads(t), np.array(z)) if t is not None else None for t, z in zip(held["model"].to_pylist(), held["z"].to_pylist(), strict=True)]

    def ranked(self, x: np.ndarray, low: int, high: int) -> np.ndarray:
        """Scores of some rows for the labels of a cluster."""
        known = self.known[low:high]
        out = np.ones((len(x), high - low))
        if self.models is None:
            if known.any():
                out[:, known] = _sigmoid(x @ self.w[low:high][known].T + self.bias[low:high][known])
        else:
            for j in np.flatnonzero(known).tolist():
                model, z = self.models[low + j]
                out[:, j] = model.predict_proba(np.hstack((x, np.broadcast_to(z, (len(x), len(z))))))[:, 1]
        return out

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, stop = matrix(rows.column("vec")), rows.column("stop")
        asks = np.repeat(np.arange(len(x)), np.diff(stop.offsets.to_numpy()))
        flat = stop.flatten()
        cluster, m = flat.field("cluster").to_numpy(), flat.field("m").to_numpy()
        more = [name for name in rows.schema.names if name not in ("vec", "stop")]
        for c in np.unique(cluster).tolist():
            if c not in self.places:
                continue
            low, high = self.places[c]
            at = np.flatnonzero(cluster == c)
            who = asks[at]
            r = self.ranked(x[who], low, high)
            again = pa.array(np.repeat(who, high - low))
            own = {name: rows.column(name).take(again) for name in more}
            yield table({**own, "leaf": np.full(r.size, self.node), "label_id": np.tile(self.labels[low:high], len(who)), "m": np.repeat(m[at], high - low), "r": r.ravel()})

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def label_scores(rows: DataFrame, labels: DataFrame, id_col: str, width: int) -> DataFrame:
    """Labels of the clusters where rows stop: rows (node, id_col, vec, stop, and more) give (id_col, and more, leaf, label_id, m, r).

    stop: array of (cluster, m). labels: (node, label_id, cluster, w, bias, model, z, known): of a linear ranker what it says of a vector is w and bias, of another its model and
    the label's vector; without one known is false. A vector is moved once for each row and chunk of its node's labels, not for each label.
    """
    names = {name: kind for name, kind in rows.dtypes if name not in ("node", "vec", "stop")}
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in names.items()), "leaf long", "label_id long", "m double", "r double"])
    return meet(labels, rows, ["node"], "label_id", id_col, _Labels, schema, min(held_rows(width), 1 << 16))
