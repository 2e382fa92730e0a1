"""Vectors as arrays, and as long tables (key, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which one side of a product is broadcast whole.
MOST_BROADCAST = 64 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays of doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, size: Column | None = None) -> Column:
    """a at length 1; a zero vector stays. The vector and its length are bound once, as a lambda would make them anew for each component."""
    bound = F.array(F.struct(a.alias("a"), (norm(a) if size is None else size).alias("n")))
    return F.get(F.transform(bound, lambda s: F.when(s["n"] == 0, s["a"]).otherwise(F.transform(s["a"], lambda x: x / s["n"]))), 0)


def cosine(a: Column, b: Column, pad: float = 1e-12) -> Column:
    return dot(a, b) / ((norm(a) + pad) * (norm(b) + pad))


def sigmoid(d: Column) -> Column:
    return 1 / (1 + F.exp(-d))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def to_long(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, feature, value), one row for each component that isn't zero."""
    return rows.select(*keys, F.posexplode(vector).alias("feature", "value")).filter("value != 0")


def to_dense(long: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, vector) of a long table; features from width on are cut, missing ones are zero."""
    held = long.filter(F.col("feature") < width).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.col("_m")[k], F.lit(0.0))).alias("vector"))


def long_norms(long: DataFrame, key: str) -> DataFrame:
    return long.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def long_unit(long: DataFrame, key: str) -> DataFrame:
    """Rows of length 1. The norm is a window over the key, so the table is dealt out once."""
    n = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return long.withColumn("_n", n).withColumn("value", F.when(F.col("_n") == 0, F.col("value")).otherwise(F.col("value") / F.col("_n"))).drop("_n")


def long_dots(x: DataFrame, z: DataFrame, x_key: str, z_key: str) -> DataFrame:
    """Inner products of all rows that share a feature: (x_key, z_key, score)."""
    right = z.select(z_key, "feature", F.col("value").alias("_z"))
    return x.join(right, "feature").groupBy(x_key, z_key).agg(F.sum(F.col("value") * F.col("_z")).alias("score"))


def stack(*tables: DataFrame, widths: list[int]) -> DataFrame:
    """Features of the tables side by side: each table's are moved by the widths before it."""
    out, offset = None, 0
    for table, width in zip(tables, widths, strict=True):
        moved = table.withColumn("feature", F.col("feature") + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += width
    return out


def pairs_with_all(x: DataFrame, z: DataFrame, width: int) -> DataFrame:
    """Each row of x with each row of z, as products of a node need: x is read once and not moved.

    z is broadcast if its vectors have at most MOST_BROADCAST bytes; a larger one is dealt to blocks,
    and x is given to each block.
    """
    count = z.count()
    if count * width * 8 <= MOST_BROADCAST:
        return x.crossJoin(F.broadcast(z))
    blocks = -(-count * width * 8 // MOST_BROADCAST)
    left = x.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))
    right = z.withColumn("_block", F.pmod(F.xxhash64(*z.columns[:1]), F.lit(int(blocks))).cast("int"))
    return left.join(right, "_block").drop("_block")


def top_k(rows: DataFrame, by: list[str] | str, score: str, k: int, tie: str, digits: int | None = None) -> DataFrame:
    """The k rows of highest score of each group, with rank from 1; ties by the tie column, ascending.

    digits: scores are compared rounded, so that noise doesn't break ties.
    """
    compared = F.col(score) if digits is None else F.round(score, digits)
    order = Window.partitionBy(by).orderBy(compared.desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_of_candidates(dots: DataFrame, queries: DataFrame, labels: DataFrame, query: str, label: str, k: int, digits: int = 6) -> DataFrame:
    """(query, label, score, rank): as top_k over every label, where pairs that dots leaves out score 0 and none is below.

    Pairs of score 0 are made only for queries with fewer than k candidates, and only with the first labels, one of which is
    among the k - 1 candidates at most: so no table of all pairs is made.
    """
    scored = dots.filter(F.round("score", digits) > 0)
    best = top_k(scored, query, "score", k, label, digits)
    held = best.groupBy(query).agg(F.collect_list(label).alias("_held"))
    short = queries.select(query).join(held, query, "left").withColumn("_held", F.coalesce("_held", F.array().cast(f"array<{dict(labels.dtypes)[label]}>")))
    short = short.filter(F.size("_held") < k)
    first = labels.select(label).distinct().orderBy(label).limit(2 * k - 1)  # at most so many rows
    listed = first.agg(F.array_sort(F.collect_list(label)).alias("_first"))
    free = F.slice(F.filter("_first", lambda x: ~F.array_contains("_held", x)), F.lit(1), F.lit(k) - F.size("_held"))
    more = short.crossJoin(F.broadcast(listed)).select(query, F.posexplode(free).alias("_n", label), F.size("_held").alias("_before"))
    rows = more.select(query, label, F.lit(0.0).alias("score"), (F.col("_before") + F.col("_n") + 1).alias("rank"))
    return best.select(query, label, "score", "rank").unionByName(rows)
