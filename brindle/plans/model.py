"""The label tree: training layer by layer, beam search, and saving.

All tables carry the global label id and the id of a node, so nodes of a layer are worked on together.
Vectors are arrays: x (node, mention_id, vec), z (node, label_id, z).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import fusion
from brindle.functions import vectors as V
from brindle.functions.blocks import affinity, matrix, table, width_of
from brindle.operators import labels as L
from brindle.operators import large_fits, linear, negatives, routing
from brindle.operators.classifiers import CLASSIFIERS, SGD, Boosted, Classifier, Forest, KernelSVC, class_weights
from brindle.operators.clusters import cluster_nodes, resolved
from brindle.operators.encoders import TextEncoder
from brindle.plans.scoring import cluster_scores, label_scores
from brindle.sources.files import checkpointed as _kept

#: Clusters of a node that are scored at a leaf, and matched clusters whose mentions a last layer's ranker sees.
LEAF_BEAM, TOP_MATCHED = 100, 5
#: Mentions of a node that one task learns from, and bytes of their vectors; those of a larger node stay where they are.
NODE_ROWS, NODE_BYTES = 200_000, 256 << 20
#: How a classifier is kept: linear ones as columns, others as text.
_MODEL = "coef array<double>, intercept double, model string"


def _columns(learner: Classifier, width: int) -> tuple:
    """(coef, intercept, model) of a fitted classifier; a constant one has no slope."""
    if learner.is_linear_model:
        return learner.coef or [0.0] * width, float(learner.intercept), None
    return None, None, learner.dumps()


def is_linear(config: dict | None, default: str) -> bool:
    return CLASSIFIERS[resolved(config, CLASSIFIERS, default)[0]].is_linear_model


def probability(vec: Column, linear: bool) -> Column:
    """What a matcher or ranker (coef, intercept, model) says of a vector."""
    return V.sigmoid(V.dot(vec, F.col("coef")) + F.col("intercept")) if linear else model_score("model", vec)


#: How types that aren't linear are fitted to a larger node.
_LARGE = {Forest: large_fits.forests, Boosted: large_fits.boosted, KernelSVC: large_fits.kernels}


def node_rows(width: int) -> int:
    """Vectors of a node that one task learns from, so that they have NODE_BYTES at most."""
    return max(2, min(NODE_ROWS, NODE_BYTES // (8 * max(1, width))))


def fit_matchers(x: DataFrame, targets: DataFrame, config: dict | None) -> DataFrame:
    """One classifier against the rest for each cluster of a node: (node, cluster, coef, intercept, model).

    targets: (node, mention_id, clusters), the clusters of a mention's labels. A node of at most node_rows mentions is fitted in one task. Linear types of
    larger ones are fitted by sums over all tasks (linear.fit), to the same coefficients; forests, boosted trees and kernel machines as large_fits says.
    """
    kind, kwargs = resolved(config, CLASSIFIERS, "sklearnlogisticregression")
    linear_type = CLASSIFIERS[kind].is_linear_model

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mention_id")
        vectors = np.stack(rows["vec"].to_numpy())
        out = []
        for c in sorted({c for own in rows["clusters"] for c in own}):
            y = np.array([c in own for own in rows["clusters"]], float)
            out.append((key[0], c, *_columns(CLASSIFIERS[kind](**kwargs).fit(vectors, y), vectors.shape[1])))
        return pd.DataFrame(out, columns=["node", "cluster", "coef", "intercept", "model"])

    schema = f"node long, cluster int, {_MODEL}"
    most = node_rows(width_of(x, "vec"))
    if CLASSIFIERS[kind] is KernelSVC:
        most = min(most, KernelSVC.MOST_ROWS)
    large = [r["node"] for r in x.groupBy("node").count().filter(F.col("count") > most).collect()]
    rows = x.join(targets, ["node", "mention_id"]).select("node", "mention_id", "vec", "clusters")
    if not large:
        return rows.groupBy("node").applyInPandas(fit, schema)
    of = F.col("node").isin(large)
    dealt = _kept(rows.filter(of).withColumn("clusters", F.col("clusters").cast("array<int>")))
    if linear_type:
        found = x.sparkSession.createDataFrame([(*r, None) for r in linear.fit(dealt, CLASSIFIERS[kind], kwargs)], schema)
    elif CLASSIFIERS[kind] in _LARGE:
        fitted = _LARGE[CLASSIFIERS[kind]](dealt, kwargs)
        fitted = fitted if isinstance(fitted, DataFrame) else x.sparkSession.createDataFrame(fitted, "node long, cluster int, model string")
        found = fitted.select("node", "cluster", F.lit(None).cast("array<double>").alias("coef"), F.lit(None).cast("double").alias("intercept"), "model")
    else:
        raise ValueError(f"a node has more than {most} mentions; {kind} is fitted in one task")
    return rows.filter(~of).groupBy("node").applyInPandas(fit, schema).unionByName(found)


@F.pandas_udf(T.DoubleType())
def model_score(model: pd.Series, vec: pd.Series) -> pd.Series:
    """Decisions of models kept as text, as probabilities; rows of the same model are scored together."""
    out = np.empty(len(model))
    for text, at in model.groupby(model).groups.items():
        k = model.index.get_indexer(at)
        out[k] = Classifier.loads(text).predict_proba(np.stack(vec.iloc[k].to_numpy()))[:, 1]
    return pd.Series(out)


def fit_rankers(pool: DataFrame, x: DataFrame, z: DataFrame, config: dict | None, epochs: int) -> DataFrame:
    """A classifier of each label over pairs [x, z]: (node, label_id, coef, intercept, model).

    pool: (node, label_id, mention_id, target, epoch); each epoch is one pass over its rows, by the same learner. Stochastic gradient takes rows as they come, so a task
    holds ids of one epoch of a label (_placed), then a batch of its vectors (_descending), which Spark has sorted as the passes go. Of other types that learn in passes one task holds
    the sample of a label.
    """
    kind, kwargs = resolved(config, CLASSIFIERS, "sklearnsgdclassifier")
    if not CLASSIFIERS[kind].supports_partial_fit:
        raise ValueError(f"a ranker needs a classifier that learns in passes; {kind} doesn't")
    if getattr(CLASSIFIERS[kind], "partial_fit", None) is not SGD.partial_fit:
        return _fit_held(pool, x, z, kind, kwargs, epochs)
    lengths = x.select(F.col("node").cast("long").alias("node"), F.col("mention_id").cast("long").alias("mention_id"), V.dot(F.col("vec"), F.col("vec")).alias("length"))
    named = pool.select(*(F.col(c).cast("long").alias(c) for c in ("node", "label_id", "mention_id")), F.col("target").cast("int").alias("target"), F.col("epoch").cast("int").alias("epoch"))
    dealt = named.filter(F.col("epoch").between(1, epochs)).join(lengths, ["node", "mention_id"]).select("node", "label_id", "epoch", "mention_id", "target", "length")
    sorted_ = dealt.repartition("node", "label_id").sortWithinPartitions("node", "label_id", "epoch", "mention_id", "target")
    placed = sorted_.mapInArrow(_placed(kind, kwargs), "node long, label_id long, mention_id long, target int, epoch int, place long, weight double, length double")
    # a vector is moved once for each label, whatever its epochs
    once = placed.repartition("node", "mention_id").groupBy("node", "mention_id", "label_id", "target").agg(F.collect_list(F.struct("epoch", "place", "weight", "length")).alias("passes"))
    rows = once.join(x.select(F.col("node").cast("long").alias("node"), F.col("mention_id").cast("long").alias("mention_id"), "vec"), ["node", "mention_id"]).select("node", "label_id", "vec", "target", "passes")
    first = F.array(F.struct(F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("length")))
    own = z.select(F.col("node").cast("long").alias("node"), F.col("label_id").cast("long").alias("label_id"), F.col("z").alias("vec"), F.lit(None).cast("int").alias("target"), first.alias("passes"))
    taken = own.unionByName(rows).repartition("node", "label_id").select("node", "label_id", "vec", "target", F.explode("passes").alias("p")).select("node", "label_id", "p.epoch", "p.place", "vec", "target", "p.weight", "p.length")
    return taken.sortWithinPartitions("node", "label_id", "epoch", "place").mapInArrow(_descending(kind, kwargs), f"node long, label_id long, {_MODEL}")


def _runs(incoming: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of the same keys that follow each other, batch by batch."""
    for batch in incoming:
        at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        edges = np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, [batch.num_rows])) if batch.num_rows else [0]
        for low, high in itertools.pairwise(list(map(int, edges))):
            yield tuple(at[:, low].tolist()), batch.slice(low, high - low)


def _placed(kind: str, kwargs: dict):
    """Rows sorted by label, epoch and mention, each once, to their places in the epoch's pass, with their weights; the first of all has the first pass's mean squared length."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = CLASSIFIERS[kind](**kwargs)
        label, t = None, 0
        for (node, label_id, epoch), runs in itertools.groupby(_runs(incoming, ("node", "label_id", "epoch")), lambda run: run[0]):
            if (node, label_id) != label:
                label, t = (node, label_id), 0
            parts = [[rows.column(c).to_numpy() for c in ("mention_id", "target", "length")] for _, rows in runs]
            ids, target, length = (np.concatenate(p) for p in zip(*parts, strict=True))
            del parts
            new = np.append(True, (ids[1:] != ids[:-1]) | (target[1:] != target[:-1]))
            ids, target, length = ids[new], target[new], length[new]
            zero, one = class_weights(learner.get("class_weight"), len(ids), float(target.sum()))
            order, told = learner.order(len(ids), t), float(length.mean()) if not t else None
            for low in range(0, len(ids), negatives.OUT_ROWS):
                at = order[low : low + negatives.OUT_ROWS]
                first = pa.array([told if k + low == 0 else None for k in range(len(at))], pa.float64())
                same = lambda value, kind, n=len(at): np.full(n, value, kind)
                yield table({
                    "node": same(node, np.int64), "label_id": same(label_id, np.int64), "mention_id": ids[at], "target": target[at], "epoch": same(epoch, np.int32), "place": np.arange(low, low + len(at)),
                    "weight": np.where(target[at] > 0, one, zero), "length": first,
                })
            t += len(ids)

    return run


def _descending(kind: str, kwargs: dict):
    """Rows sorted by label, epoch and place, the label's own vector first, to its ranker."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, label_id), runs in itertools.groupby(_runs(incoming, ("node", "label_id")), lambda run: run[0]):
            learner, z = CLASSIFIERS[kind](**kwargs), None
            for _, rows in runs:
                vectors = matrix(rows.column("vec"))
                if z is None and rows.column("epoch")[0].as_py() == 0:
                    z, vectors, rows = vectors[0], vectors[1:], rows.slice(1)
                if z is None or not len(vectors):
                    continue
                if "rate" not in learner.state:
                    learner.begin(rows.column("length")[0].as_py() + float(z @ z))
                pairs = np.hstack((vectors, np.broadcast_to(z, (len(vectors), len(z)))))
                learner.steps(pairs, rows.column("target").to_numpy(), rows.column("weight").to_numpy(), np.arange(len(pairs)))
            if "raw" in learner.state:
                coef, intercept, model = _columns(learner, 2 * len(z))
                yield table({"node": np.array([node]), "label_id": np.array([label_id]), "coef": pa.array([coef], pa.list_(pa.float64())), "intercept": np.array([intercept]), "model": pa.array([model], pa.string())})

    return run


def _fit_held(pool: DataFrame, x: DataFrame, z: DataFrame, kind: str, kwargs: dict, epochs: int) -> DataFrame:
    """fit_rankers of a type that takes all rows of a pass at once: a task holds each mention's vector once, whatever its epochs."""
    once = pool.groupBy("node", "label_id", "mention_id", "target").agg(F.collect_set("epoch").alias("epochs"))
    rows = once.join(x, ["node", "mention_id"]).select("node", "label_id", "mention_id", "target", "epochs", "vec")

    def fit(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        columns = ["node", "label_id", "coef", "intercept", "model"]
        if not len(rows) or not len(own):
            return pd.DataFrame([], columns=columns)
        z = np.asarray(own["z"].iloc[0], float)
        learner = CLASSIFIERS[kind](**kwargs)
        rows = rows.sort_values("mention_id")
        vectors, target = np.stack(rows["vec"].to_numpy()), rows["target"].to_numpy()
        inside = np.zeros((len(rows), epochs + 1), bool)
        for k, own in enumerate(rows["epochs"]):
            inside[k, own] = True
        for part in inside.T[1:]:
            if part.any():
                learner.partial_fit(np.hstack((vectors[part], np.broadcast_to(z, (part.sum(), len(z))))), target[part])
        return pd.DataFrame([(key[0], key[1], *_columns(learner, len(z) * 2))], columns=columns)

    # keys have the same type on both sides, as whole numbers of other lengths are dealt elsewhere
    of = z.select(F.col("node").cast("long").alias("of_node"), F.col("label_id").cast("long").alias("of_label"), "z").groupBy("of_node", "of_label")
    return rows.withColumn("node", F.col("node").cast("long")).withColumn("label_id", F.col("label_id").cast("long")).groupBy("node", "label_id").cogroup(of).applyInPandas(fit, f"node long, label_id long, {_MODEL}")


def ranked_labels(rankers: DataFrame, node_labels: DataFrame) -> DataFrame:
    """(node, label_id, w, bias) of linear rankers: what a label adds to the decision on a pair [x, z] is known beforehand."""
    both = rankers.join(node_labels, ["node", "label_id"])
    at = F.size("coef") - F.size("z")
    return both.select("node", "label_id", F.slice("coef", F.lit(1), at).alias("w"), (V.dot(F.slice("coef", at + 1, F.size("z")), F.col("z")) + F.col("intercept")).alias("bias"))


def epoch_phases(curriculum: dict, epochs: int) -> list[list[negatives.Phase]]:
    """What each epoch's negatives go by: random ones and near ones while it is warm, then hard ones."""
    warm_rand, warm_cos = curriculum.get("warm", (0.70, 0.30))
    hard_ip, hard_cos, _ = curriculum.get("hard", (0.60, 0.30, 0.10))
    warm, hard = [(warm_rand, "draw"), (warm_cos, "cos")], [(hard_ip, "ip"), (hard_cos, "cos"), (None, "draw")]
    return [warm if epoch <= curriculum.get("E_warm", 3) else hard for epoch in range(1, epochs + 1)]


def ranker_pool(
    x: DataFrame, y: DataFrame, z: DataFrame, clusters: DataFrame, matched: DataFrame | None, curriculum: dict, epochs: int, seed: int = 0, draw: negatives.Draw | None = None
) -> DataFrame:
    """The sample of each label, (node, label_id, mention_id, target, epoch): positives and chosen negatives of its cluster's mentions, epoch by epoch.

    Only labels that can be trained are in it. How many negatives there are follows from counts; which ones, from negatives.choose: no table of
    labels with all mentions of their clusters is made.
    """
    places = _kept(L.node_pairs(y, clusters.select("node", "label_id", "cluster")))
    own = places.select("node", "mention_id", "cluster").distinct()
    candidates = _kept(routing.mask_union(own, matched) if matched is not None else own)
    around = candidates.groupBy("node", "cluster").agg(F.count("*").alias("n"))
    counts = places.groupBy("node", "cluster", "label_id").agg(F.count("*").alias("pos")).join(around, ["node", "cluster"]).withColumn("neg", F.col("n") - F.col("pos"))
    counts = _kept(routing.trainable(counts, "pos", "neg", curriculum.get("neg_mult", 15)).select("node", "cluster", "label_id", "n_neg"))
    labels = counts.join(z, ["node", "label_id"])
    lists = y.groupBy("mention_id").agg(F.collect_set("label_id").alias("own"))
    mentions = candidates.join(x, ["node", "mention_id"]).join(lists, "mention_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
    chosen = negatives.choose(labels, mentions, epoch_phases(curriculum, epochs), draw or negatives.mixed(seed))
    positives = places.join(counts.select("node", "label_id"), ["node", "label_id"]).select("node", "label_id", "mention_id", F.lit(1).alias("target"), F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    return positives.unionByName(chosen.select("node", "label_id", "mention_id", F.lit(0).alias("target"), "epoch"))


class XModel:
    """Extreme multi-label ranking of short texts.

    train takes mentions (mention_id, text, label), predict queries (query_id, text). min_leaf_size is the least size
    of a cluster; cut_half_cluster halves n_clusters with each layer; ranker_every_layer False trains rankers
    only where the search ends.
    """

    tables = ("dictionary", "embeddings", "clusters", "matchers", "rankers", "edges", "node_labels")

    def __init__(
        self, vectorizer_config: dict | None = None, transformer_config: dict | None = None, dimension_config: dict | None = None, clustering_config: dict | None = None,
        matcher_config: dict | None = None, ranker_config: dict | None = None, min_leaf_size: int = 20, max_leaf_size: int | None = None, cut_half_cluster: bool = False,
        ranker_every_layer: bool = True, n_workers: int = 8, depth: int = 1, emb_flag: int = 1,
    ):
        self.config = {
            "vectorizer": vectorizer_config, "transformer": transformer_config, "dimension": dimension_config, "clustering": clustering_config, "matcher": matcher_config, "ranker": ranker_config,
            "min_leaf_size": min_leaf_size, "max_leaf_size": max_leaf_size, "cut_half_cluster": cut_half_cluster, "ranker_every_layer": ranker_every_layer, "n_workers": n_workers, "depth": depth, "emb_flag": emb_flag,
        }
        self.encoder: TextEncoder | None = None

    @property
    def linear_matchers(self) -> bool:
        return is_linear(self.config["matcher"], "sklearnlogisticregression")

    @property
    def linear_rankers(self) -> bool:
        return is_linear(self.config["ranker"], "sklearnsgdclassifier")

    @classmethod
    def from_tables(cls, depth: int, **tables: DataFrame) -> XModel:
        """A model of tables that are there already: all of cls.tables, with linear matchers and rankers."""
        out = cls(depth=depth)
        for name in cls.tables:
            setattr(out, name, tables[name])
        return out

    def train(self, mentions: DataFrame) -> XModel:
        c = self.config
        self.encoder = TextEncoder(c["vectorizer"], c["transformer"], c["dimension"], c["emb_flag"]).fit(mentions, "mention_id", "text")
        return self.train_vectors(self.encoder.transform(mentions, "mention_id", "text"), mentions)

    def train_vectors(self, vectors: DataFrame, mentions: DataFrame) -> XModel:
        """As train, with vectors (mention_id, vec) that are there already."""
        c = self.config
        self.dictionary = _kept(L.label_dictionary(mentions, "label"))
        y = _kept(L.label_matrix(mentions, "mention_id", "label", self.dictionary))
        x = _kept(vectors.select(F.lit(0).cast("long").alias("node"), "mention_id", "vec"))
        z = _kept(L.pifa_dense(y.join(x.select("mention_id", "vec"), "mention_id"), "vec", "label_id").select(F.lit(0).cast("long").alias("node"), "label_id", "z"))
        self.embeddings = z.select("label_id", "z")
        self.node_labels = z
        parts: dict[str, list[DataFrame]] = {t: [] for t in ("clusters", "matchers", "rankers", "edges")}
        clustering = c["clustering"]
        for layer in range(c["depth"]):
            found = _kept(cluster_nodes(z, clustering, c["min_leaf_size"]))
            if found.isEmpty():
                break
            last = layer == c["depth"] - 1
            here = found.select("node", "label_id", "cluster")
            of = L.node_pairs(y, here).select("node", "mention_id", "cluster").distinct()
            targets = of.groupBy("node", "mention_id").agg(F.collect_set("cluster").alias("clusters"))
            matchers = _kept(fit_matchers(x, targets, c["matcher"]))
            scores = _kept(cluster_scores(x, matchers, None, "mention_id"))
            sizes = here.groupBy("node", "cluster").count()
            grows = sizes.filter(F.col("count") > c["min_leaf_size"]) if not last else sizes.limit(0)
            edges = _kept(grows.select("node", "cluster", F.abs(F.xxhash64("node", "cluster")).alias("child")))
            if c["ranker_every_layer"] or last:
                matched = None
                if last:
                    matched = scores.select("node", "mention_id", F.explode(F.slice("best", 1, TOP_MATCHED)).alias("b")).select("node", "mention_id", "b.cluster")
                config = dict(c["ranker"] or {})
                epochs = config.get("n_epochs", 3)
                pool = _kept(ranker_pool(x, y, z, here, matched, config.get("cur_config", {}), epochs, int((config.get("kwargs") or {}).get("random_state") or 0)))
                parts["rankers"].append(_kept(fit_rankers(pool, x, z, c["ranker"], epochs)))
            parts["clusters"].append(here)
            parts["matchers"].append(matchers)
            parts["edges"].append(edges)
            if last or edges.isEmpty():
                break
            x, z = self._children(y, z, here, scores, edges)
            self.node_labels = self.node_labels.unionByName(z)
            if c["cut_half_cluster"]:
                kwargs = dict((clustering or {}).get("kwargs") or {})
                kwargs["n_clusters"] = max(2, kwargs.get("n_clusters", 2) // 2)
                clustering = {**(clustering or {"type": "balancedkmeans"}), "kwargs": kwargs}
        spark = mentions.sparkSession
        empty = {"clusters": "node long, label_id long, cluster int", "matchers": f"node long, cluster int, {_MODEL}", "rankers": f"node long, label_id long, {_MODEL}", "edges": "node long, cluster int, child long"}
        for name, tables in parts.items():
            out = spark.createDataFrame([], empty[name])
            for t in tables:
                out = out.unionByName(t)
            setattr(self, name, out)
        if parts["edges"]:  # children that weren't split aren't nodes: the search ends above them
            self.edges = _kept(self.edges.join(self.clusters.select(F.col("node").alias("child")).distinct(), "child", "left_semi").select("node", "cluster", "child"))
        return self

    @staticmethod
    def _children(y, z, here, scores, edges):
        """Inputs of the next layer: x gets its own cluster's score, the sum and the greatest; z the mean, sum and
        greatest affinity to the child's mentions, zeros among them.

        scores: as cluster_scores gives them for all clusters. No pairs of mentions and labels are made.
        """
        of = L.node_pairs(y, here).select("node", "mention_id", "cluster").distinct().join(edges, ["node", "cluster"])
        own = F.get(F.filter("best", lambda b: b["cluster"] == F.col("cluster")), 0)["m"]
        inside = _kept(of.join(scores, ["node", "mention_id"]).select("child", "mention_id", "vec", own.alias("score"), "sum", "max"))
        labels = here.join(edges, ["node", "cluster"]).join(z, ["node", "label_id"]).select("child", "label_id", "z")
        new_x = inside.select(F.col("child").alias("node"), "mention_id", V.unit(F.concat("vec", F.array("score", "sum", "max"))).alias("vec"))
        wider = labels.join(affinity(inside, labels, ["child"]), ["child", "label_id"])
        new_z = wider.select(F.col("child").alias("node"), "label_id", V.unit(F.concat("z", F.array("mean", "total", "most"))).alias("z"))
        return _kept(new_x), _kept(new_z)

    def predict(self, queries: DataFrame, topk: int = 5, beam_size: int | None = None, fusion_mode: str = "geometric", topk_mode: str = "per_leaf", topk_inside_global: int | None = None, **kwargs) -> DataFrame:
        return self.predict_vectors(self.encoder.transform(queries, "query_id", "text"), topk, beam_size, fusion_mode, topk_mode, topk_inside_global, **kwargs)

    def search(self, vectors: DataFrame, beam_size: int | None = None, fusion_mode: str = "geometric", alpha: float = 0.5, p: float = 3.0, eps: float = 1e-6) -> DataFrame:
        """All labels that the beam reaches: (query_id, label_id, leaf, score, trail)."""
        beam = beam_size or 5
        step = "array<struct<layer:int,node:bigint,cluster:int,probability:double,logscore:double>>"
        now = vectors.select("query_id", F.lit(0).cast("long").alias("node"), "vec", F.lit(0.0).alias("logscore"), F.array().cast(step).alias("trail"))
        ended: DataFrame | None = None
        for layer in range(self.config["depth"]):
            scored = _kept(cluster_scores(now, self.matchers, self.edges, "query_id", LEAF_BEAM))
            # where no child follows, labels are scored here
            stop = scored.select("query_id", "node", "vec", "trail", F.transform(F.filter("best", lambda b: b["child"].isNull()), lambda b: F.struct(b["cluster"].alias("cluster"), b["m"].alias("m"))).alias("stop")).filter(F.size("stop") > 0)
            ended = stop if ended is None else ended.unionByName(stop)
            open_ = scored.select("query_id", "node", "logscore", F.explode(F.filter(F.slice("best", 1, beam), lambda b: b["child"].isNotNull())).alias("b"))
            open_ = open_.select("query_id", "node", "b.cluster", "b.m", "b.child", fusion.path_score(F.col("logscore"), F.col("b.m")).alias("now"))
            on = V.top_k(open_, "query_id", "now", beam, "child", 9).drop("rank").join(scored.select("query_id", "node", "vec", "trail", "sum", "max"), ["query_id", "node"])
            trail = F.concat("trail", F.array(F.struct(F.lit(layer).alias("layer"), "node", "cluster", F.col("m").alias("probability"), F.col("now").alias("logscore"))))
            now = _kept(on.select("query_id", F.col("child").alias("node"), V.unit(F.concat("vec", F.array("m", "sum", "max"))).alias("vec"), F.col("now").alias("logscore"), trail.cast(step).alias("trail")))
            if now.isEmpty():
                break
        found = label_scores(ended, self._ranked_clusters(), "query_id", width_of(vectors, "vec"))
        return found.select("query_id", "label_id", "leaf", fusion.fuse(fusion_mode, F.col("m"), F.col("r"), alpha, p, eps).alias("score"), "trail")

    def _ranked_clusters(self) -> DataFrame:
        """Labels of all clusters with what their rankers say, as label_scores takes them."""
        # a ranker was fitted on its own node's label vectors, which have three numbers more for each layer
        if self.linear_rankers:
            known = ranked_labels(self.rankers, self.node_labels).select("node", "label_id", "w", "bias", F.lit(None).cast("string").alias("model"), F.lit(None).cast("array<double>").alias("z"), F.lit(True).alias("known"))
        else:
            none = F.lit(None).cast("array<double>").alias("w"), F.lit(None).cast("double").alias("bias")
            known = self.rankers.join(self.node_labels, ["node", "label_id"]).select("node", "label_id", *none, "model", "z", F.col("model").isNotNull().alias("known"))
        held = self.clusters.join(known, ["node", "label_id"], "left")
        return held.select("node", "label_id", F.col("cluster").cast("int").alias("cluster"), "w", "bias", "model", "z", F.coalesce("known", F.lit(False)).alias("known"))

    def predict_vectors(
        self, vectors: DataFrame, topk: int = 5, beam_size: int | None = None, fusion_mode: str = "geometric", topk_mode: str = "per_leaf", topk_inside_global: int | None = None, alpha: float = 0.5, p: float = 3.0, eps: float = 1e-6
    ) -> DataFrame:
        """(query_id, rank, label_id, label, score).

        per_leaf: the best topk of each leaf, merged by their greatest score. Any other mode: all labels reached are ranked
        by their cosine to the query, those of cosine 0 too.
        """
        reached = self.search(vectors, beam_size, fusion_mode, alpha, p, eps)
        if topk_mode == "per_leaf":
            kept = V.top_k(reached, ["query_id", "leaf"], "score", topk, "label_id", 9)
            best = routing.max_merge(kept)
        else:
            if topk_inside_global:
                reached = V.top_k(reached, ["query_id", "leaf"], "score", topk_inside_global, "label_id", 9)
            union = reached.select("query_id", "label_id").distinct()
            best = union.join(vectors, "query_id").join(self.embeddings, "label_id").select("query_id", "label_id", V.cosine(F.col("vec"), F.col("z")).alias("score"))
        top = V.top_k(best, "query_id", "score", topk, "label_id", 9)
        return top.join(self.dictionary, "label_id").select("query_id", "rank", "label_id", "label", "score")

    def predict_node(self, node: int, vectors: DataFrame, beam_size: int | None = None, topk: int | None = None, as_matrix: bool = False, fusion_mode: str = "lp_fusion", alpha: float = 0.5, p: float = 3.0, eps: float = 1e-6) -> DataFrame:
        """What one node says of vectors (query_id, vec) of its width: its best clusters, their labels, and fused scores.

        (query_id, rank, label_id, score); as_matrix: a row for each query with its labels, ascending, and their scores:
        (query_id, labels, scores). topk keeps the best of a query in either form.
        """
        at = vectors.select("query_id", F.lit(node).cast("long").alias("node"), "vec")
        of = F.col("node") == node
        top = cluster_scores(at, self.matchers.filter(of), None, "query_id", beam_size or LEAF_BEAM)
        stop = F.transform("best", lambda b: F.struct(b["cluster"].alias("cluster"), b["m"].alias("m")))
        reached = label_scores(top.select("query_id", "node", "vec", stop.alias("stop")), self._ranked_clusters().filter(of), "query_id", width_of(vectors, "vec"))
        fused = reached.select("query_id", "label_id", fusion.fuse(fusion_mode, F.col("m"), F.col("r"), alpha, p, eps).alias("score"))
        best = V.top_k(fused, "query_id", "score", topk or 2**31 - 1, "label_id", 9)
        if not as_matrix:
            return best.select("query_id", "rank", "label_id", "score")
        rows = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("label_id", "score"))).alias("i"))
        return rows.select("query_id", F.col("i.label_id").alias("labels"), F.col("i.score").alias("scores"))

    def fused_clusters(self, node: int, vectors: DataFrame, fusion_mode: str = "lp_hinge", alpha: float = 0.5, p: float = 3.0) -> DataFrame:
        """(query_id, cluster, score): fused scores of a node's labels, added up by cluster, as a check while layers are trained.

        A label has its cluster's matcher score, and the ranker of the node's least label that has one speaks for all labels. In a node without
        rankers the matcher's score stands alone. vectors: (query_id, vec) of the node's width.
        """
        here = self.node_labels.filter(F.col("node") == node).join(self.clusters, ["node", "label_id"]).select("node", "label_id", "cluster", "z")
        one = F.min_by(F.struct("coef", "intercept", "model"), "label_id")
        first = self.rankers.filter(F.col("node") == node).groupBy("node").agg(one.alias("r")).select("node", "r.*")  # a single row
        scored = vectors.withColumn("node", F.lit(node).cast("long")).join(self.matchers, "node")
        scored = scored.select("query_id", "vec", "node", "cluster", probability(F.col("vec"), self.linear_matchers).alias("m"))
        if self.linear_rankers:
            spoken = here.select("node", "label_id").join(F.broadcast(first), "node")
            of = here.join(ranked_labels(spoken, here.select("node", "label_id", "z")), ["node", "label_id"], "left")
            pairs = scored.join(of, ["node", "cluster"]).withColumn("r", V.sigmoid(V.dot(F.col("vec"), F.col("w")) + F.col("bias")))
        else:
            pairs = scored.join(here, ["node", "cluster"]).join(F.broadcast(first.select("node", "model")), "node", "left")
            learned = pairs.filter("model is not null").withColumn("r", model_score("model", F.concat("vec", "z")))
            pairs = learned.unionByName(pairs.filter("model is null").withColumn("r", F.lit(None).cast("double")))
        score = F.when(F.col("r").isNull(), F.col("m")).otherwise(fusion.training_fusion(fusion_mode, F.col("m"), F.col("r"), alpha, p))
        return pairs.groupBy("query_id", "cluster").agg(F.sum(score).alias("score"))

    def final_paths(self, vectors: DataFrame, topk: int = 5, **kwargs) -> DataFrame:
        """Records: (query_id, paths, final_path), a path being a leaf's trail, labels and scores by falling score."""
        reached = _kept(self.search(vectors, **kwargs))
        item = F.struct((-F.col("score")).alias("s"), "label_id")
        lists = lambda c: (F.transform(c, lambda x: x["label_id"]).alias("labels"), F.transform(c, lambda x: -x["s"]).alias("scores"))
        per_leaf = V.top_k(reached, ["query_id", "leaf"], "score", topk, "label_id", 9).groupBy("query_id", "leaf").agg(F.first("trail").alias("trail"), F.array_sort(F.collect_list(item)).alias("i"))
        paths = per_leaf.select("query_id", F.struct("leaf", "trail", *lists(F.col("i"))).alias("path")).groupBy("query_id").agg(F.array_sort(F.collect_list("path"), lambda a, b: F.when(a["leaf"] < b["leaf"], -1).when(a["leaf"] > b["leaf"], 1).otherwise(0)).alias("paths"))
        best = V.top_k(routing.max_merge(reached), "query_id", "score", topk, "label_id", 9).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("i"))
        return paths.join(best.select("query_id", F.struct(*lists(F.col("i"))).alias("final_path")), "query_id", "left")

    def save(self, folder: str) -> None:
        """Parquet tables and a configuration; it is an error if the folder has a model."""
        spark = self.dictionary.sparkSession
        for name in self.tables:
            getattr(self, name).write.parquet(f"{folder}/{name}")
        if self.encoder is not None:
            self.encoder.save(f"{folder}/encoder", spark)
        held = json.dumps({"config": self.config, "encoder": self.encoder is not None})
        spark.createDataFrame([(held,)], "value string").coalesce(1).write.text(f"{folder}/config")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> XModel:
        held = json.loads(spark.read.text(f"{folder}/config", wholetext=True).first()[0])
        out = cls()
        out.config = held["config"]
        out.encoder = TextEncoder.load(spark, f"{folder}/encoder") if held["encoder"] else None
        for name in cls.tables:
            setattr(out, name, spark.read.parquet(f"{folder}/{name}"))
        return out
