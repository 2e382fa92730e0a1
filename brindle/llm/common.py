"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources.files import checkpointed, discard, scope, scratch, shared_folder, spread

__all__ = ["checkpointed", "discard", "scope", "scratch", "shared_folder", "spread"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: also says where it is.

    Unlike a checkpoint, this also forgets how the rows were partitioned and sorted. In a loop of joins Spark
    would list ever more equal ways to say that, and planning would take longer with each round.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def give_back() -> None:
    """Return memory that a Python worker has freed to the system, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case, close to name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_count(rows: int, per_bucket: int = 50_000) -> int:
    """How many buckets keep each near per_bucket rows."""
    return max(1, -(-rows // per_bucket))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of value over the rows of the same keys that come earlier in (bucket, order).

    The prefix sum is made in two levels, so that one key may hold most rows: totals of the
    (keys, bucket) cells are added up in a small table, and only rows of one cell are sorted
    in one place. df is read twice; give a checkpointed or cheap one. A rank is the running
    total of 1. Other columns stay, whatever they are called; one called name is replaced.
    """
    cell = [*keys, bucket]
    own, start = fresh(df, "_value"), fresh(df, "_start")
    at = {c: fresh(df, f"_at_{k}") for k, c in enumerate(cell)}
    held = df.withColumn(own, value)
    totals = held.groupBy(*cell).agg(F.sum(own).alias(own))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(at[c]) for c in cell), F.coalesce(F.sum(own).over(before), F.lit(0)).alias(start))
    joined = held.join(starts, reduce(lambda a, b: a & b, (held[c].eqNullSafe(starts[at[c]]) for c in cell)))
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn(name, F.col(start) + F.coalesce(F.sum(own).over(inside), F.lit(0)))
    return out.drop(own, start, *at.values())
