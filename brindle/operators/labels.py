"""Label ids, label matrices and label embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.vectors import long_unit
from brindle.sources.files import ranked


def label_dictionary(rows: DataFrame, label: str) -> DataFrame:
    """(label, label_id): rank of each different label, from 0. It is kept, so ids can always be read back.

    Labels are sorted over all tasks, as there may be very many.
    """
    distinct = rows.select(F.col(label).alias("label")).filter("label is not null").distinct()
    return ranked(distinct, "label", "label_id")


def label_matrix(rows: DataFrame, mention: str, label: str, dictionary: DataFrame) -> DataFrame:
    """The bridge table (mention, label_id), each pair once."""
    return rows.select(F.col(mention), F.col(label).alias("label")).join(dictionary, "label").select(mention, "label_id").distinct()


def pifa(x: DataFrame, y: DataFrame, mention: str = "mention_id", label: str = "label_id") -> DataFrame:
    """Label embeddings (label, feature, value): sums of the label's mentions, divided by their norm and 1e-10, at length 1.

    The label matrix is as long as the mentions, though its file may be small: it is sorted and merged, never sent through the driver.
    """
    sums = y.hint("merge").join(x, mention).groupBy(label, "feature").agg(F.sum("value").alias("value"))
    n = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(label)))
    return long_unit(sums.withColumn("value", F.col("value") / (n + 1e-10)), label)


def pifa_dense(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """The same for arrays: (label, z)."""
    sums = rows.select(label, F.posexplode(vector).alias("k", "v")).groupBy(label, "k").agg(F.sum("v").alias("v"))
    z = sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("z"))
    n = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    z = z.withColumn("_n", n).withColumn("z", F.transform("z", lambda x: x / (F.col("_n") + 1e-10)))
    return z.withColumn("_n", n).select(label, F.when(F.col("_n") == 0, F.col("z")).otherwise(F.transform("z", lambda x: x / F.col("_n"))).alias("z"))


def mention_clusters(y: DataFrame, clusters: DataFrame, mention: str = "mention_id", label: str = "label_id") -> DataFrame:
    """(mention, cluster): a mention is in each cluster that has one of its labels."""
    return y.join(clusters, label).select(mention, "cluster").distinct()


def node_pairs(y: DataFrame, own: DataFrame, mention: str = "mention_id", label: str = "label_id") -> DataFrame:
    """The label matrix's part in some nodes: pairs (mention, label), each once, of the labels in own (label, and what says their node), with all that own says of them.

    So columns of other labels go, and mentions that have none of these.
    """
    return y.join(own, label).select(mention, *own.columns).distinct()
