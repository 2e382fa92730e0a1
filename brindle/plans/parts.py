"""Parts of the label tree on their own: each is a table and a configuration, and is saved and loaded alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators.clusters import cluster_nodes
from brindle.plans import model


class Part:
    """table and config; which columns the table has is said by each kind."""

    def __init__(self, table: DataFrame, config: dict | None = None):
        self.table, self.config = table, config or {}

    def save(self, folder: str) -> None:
        """It is an error if the folder has a part."""
        self.table.write.parquet(f"{folder}/table")
        held = json.dumps({"kind": type(self).__name__, "config": self.config})
        self.table.sparkSession.createDataFrame([(held,)], "value string").coalesce(1).write.text(f"{folder}/config")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Part:
        held = json.loads(spark.read.text(f"{folder}/config", wholetext=True).first()[0])
        if held["kind"] != cls.__name__:
            raise ValueError(f"{folder} holds a {held['kind']}, not a {cls.__name__}")
        return cls(spark.read.parquet(f"{folder}/table"), held["config"])


class Clustering(Part):
    """(node, label_id, cluster)."""

    @classmethod
    def train(cls, z: DataFrame, config: dict | None, least: int) -> Clustering:
        return cls(cluster_nodes(z, config, least), config)

    def centroids(self, z: DataFrame) -> DataFrame:
        """(node, cluster, centroid): means of the labels' vectors."""
        rows = self.table.join(z, ["node", "label_id"]).select("node", "cluster", F.posexplode("z").alias("k", "v"))
        means = rows.groupBy("node", "cluster", "k").agg(F.avg("v").alias("v"))
        return means.groupBy("node", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("centroid"))


class Matcher(Part):
    """(node, cluster, coef, intercept, model)."""

    @classmethod
    def train(cls, x: DataFrame, targets: DataFrame, config: dict | None) -> Matcher:
        return cls(model.fit_matchers(x, targets, config), config)

    def predict_proba(self, x: DataFrame) -> DataFrame:
        """Rows of x (node, ..., vec) for each cluster of their node, with its probability as score."""
        linear = model.is_linear(self.config, "sklearnlogisticregression")
        return x.join(self.table, "node").withColumn("score", model.probability(F.col("vec"), linear)).drop("coef", "intercept", "model")


class Ranker(Part):
    """(node, label_id, coef, intercept, model)."""

    @classmethod
    def train(cls, pool: DataFrame, x: DataFrame, z: DataFrame, config: dict | None, epochs: int) -> Ranker:
        return cls(model.fit_rankers(pool, x, z, config, epochs), config)

    def predict_proba(self, pairs: DataFrame, z: DataFrame, default: float = 1.0) -> DataFrame:
        """Rows of pairs (node, label_id, ..., vec) with their label's probability as score; the default where a label has no model."""
        if model.is_linear(self.config, "sklearnsgdclassifier"):
            joined = pairs.join(model.ranked_labels(self.table, z), ["node", "label_id"], "left")
            return joined.withColumn("score", F.coalesce(V.sigmoid(V.dot(F.col("vec"), F.col("w")) + F.col("bias")), F.lit(default))).drop("w", "bias")
        joined = pairs.join(self.table, ["node", "label_id"], "left").join(z, ["node", "label_id"])
        learned = joined.filter("model is not null").withColumn("score", model.model_score("model", F.concat("vec", "z")))
        return learned.unionByName(joined.filter("model is null").withColumn("score", F.lit(default))).drop("coef", "intercept", "model", "z")
