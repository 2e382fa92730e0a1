"""Scores of clusters and labels: routing features, candidates, merging of leaves, negatives, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def routing_features(scores: DataFrame, mention: str = "mention_id") -> DataFrame:
    """Of (mention, cluster, score, own boolean): the own cluster's score, and the sum and greatest of all."""
    return scores.groupBy(mention).agg(F.sum(F.when(F.col("own"), F.col("score")).otherwise(0.0)).alias("own_score"), F.sum("score").alias("sum_score"), F.max("score").alias("max_score"))


def label_affinity(scores: DataFrame, mentions: int, label: str = "label_id") -> DataFrame:
    """Of (label, score) over a node's mentions: mean over all of them, sum and greatest; pairs left out count as 0."""
    got = scores.groupBy(label).agg(F.sum("score").alias("sum_score"), F.max("score").alias("m"), F.count("*").alias("n"))
    return got.select(label, (F.col("sum_score") / mentions).alias("mean_score"), "sum_score", F.when(F.col("n") < mentions, F.greatest("m", F.lit(0.0))).otherwise(F.col("m")).alias("max_score"))


def candidate_labels(top: DataFrame, clusters: DataFrame, query: str = "query_id") -> DataFrame:
    """Labels of a query's clusters, each once: (query, label_id)."""
    return top.join(clusters, "cluster").select(query, "label_id").distinct()


def with_default(scores: DataFrame, models: DataFrame, value: Column, default: float = 1.0, label: str = "label_id") -> DataFrame:
    """Scores of labels by their models; a label without a model gets the default."""
    return scores.join(models, label, "left").withColumn("ranker", F.coalesce(value, F.lit(default)))


def max_merge(leaves: DataFrame, query: str = "query_id") -> DataFrame:
    """The best score of each (query, label); what isn't above 0 goes."""
    return leaves.groupBy(query, "label_id").agg(F.max("score").alias("score")).filter("score > 0")


def mask_union(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()


def trainable(counts: DataFrame, positives: str, available: str, neg_mult: int = 15) -> DataFrame:
    """Labels with two positives, and with two negatives at least of which to choose."""
    chosen = F.least(F.col(positives) * neg_mult, F.col(available))
    return counts.withColumn("n_neg", chosen).filter((F.col(positives) >= 2) & (F.col(available) >= 1) & (chosen >= 2))


def pick_negatives(pool: DataFrame, phases: list[tuple[float, list[tuple[str, bool]]]], label: str = "label_id", mention: str = "mention_id") -> DataFrame:
    """Negatives of each label: (label, mention).

    pool has label, mention, n_neg, and the columns the phases order by. A phase is its share of
    n_neg (rounded half to even; None for what is left of n_neg, chosen among the rows not yet taken) and its order: columns, and whether
    they descend. What phases pick is united, sorted by mention and cut at n_neg, so overlap
    means fewer.
    """
    by = Window.partitionBy(label)
    quota, taken, given = [], F.lit(False), F.lit(0).cast("long")
    for share, _ in phases:
        n = (F.col("n_neg") - given) if share is None else F.bround(F.lit(share) * F.col("n_neg")).cast("long")
        quota.append(n)
        given = given + n
    out = pool
    for k, ((share, order), n) in enumerate(zip(phases, quota, strict=True)):
        keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
        if share is None:  # among the rest only
            rank = F.row_number().over(by.orderBy(taken.cast("int"), *keys))
            out = out.withColumn(f"_pick{k}", ~taken & (rank <= n))
        else:
            out = out.withColumn(f"_pick{k}", F.row_number().over(by.orderBy(*keys)) <= n)
        taken = taken | F.col(f"_pick{k}")
    picked = out.filter(taken)
    return picked.withColumn("_at", F.row_number().over(by.orderBy(mention))).filter(F.col("_at") <= F.col("n_neg")).select(label, mention)


def known_gold(gold: DataFrame, known: DataFrame) -> DataFrame:
    """Queries whose first gold code is a known label: gold (query_id, codes), known (label)."""
    first = gold.withColumn("label", F.get("codes", 0))
    return first.join(known, "label", "left_semi").drop("label")


def hit_counts(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """How many predicted labels of a query are gold: predicted (query_id, label), gold (query_id, codes)."""
    lists = predicted.groupBy("query_id").agg(F.collect_set("label").alias("labels"))
    return gold.join(lists, "query_id", "left").select("query_id", F.coalesce(F.size(F.array_intersect(F.coalesce("labels", F.array().cast("array<string>")), "codes")), F.lit(0)).alias("hits"))


def hit_histogram(hits: DataFrame) -> DataFrame:
    return hits.groupBy("hits").agg(F.count("*").alias("queries"))
