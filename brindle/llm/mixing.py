"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bucket_count, checkpointed, fresh, running_total

#: Weights that sources get in turn, by code point.
WEIGHTS = (5, 2, 1)
#: Sources of which a table is small enough to be broadcast.
MOST_BROADCAST = 10_000
#: What counts as one word.
WORD = r"[^\x20\x09-\x0D]+"


def budgets(sizes: DataFrame, total: float | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Targets of sources: (source, source_size) gets rank, weight and target columns.

    Weights repeat over the sources in code point order, null last. Targets share total (all
    sizes, if not given) by weight; one that would be above most times its source's size stops
    there, and the excess is shared anew until none is above.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    # One row a source, as they are summed up before; ranks are of two levels, as there may be many.
    named = checkpointed(sizes.withColumn("_first", F.when(F.col("source").isNull(), F.lit(None)).otherwise(F.substring("source", 1, 2))))
    firsts = named.groupBy("_first").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(F.col("_first").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(F.col("_first").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_first").orderBy(F.col("source").asc_nulls_last())) - 1
    placed = named.join(firsts, named["_first"].eqNullSafe(firsts["_of"])).withColumn("rank", F.col("_before") + within)
    ranked = checkpointed(placed.withColumn("weight", weight).drop("_first", "_of", "_before"))
    if total is None:
        total = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit, share, held = F.lit(most) * F.col("source_size"), 0.0, None
    while True:
        # share only grows, so a source at its limit stays there; a few rounds do, unless limits are staggered
        full = F.lit(share) * F.col("weight") >= limit
        taken, open_weight, n = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))
        ).first()
        if n == held or not open_weight:
            break
        share, held = max(share, (total - taken) / open_weight), n
    return ranked.withColumn("target", F.least(F.lit(share) * F.col("weight"), limit))


def _key(id_: Column, seed: int) -> Column:
    """Hash-random and the same in each run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")).cast("binary"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """How many words a mix takes of each document, so that each source meets its target.

    Documents get hash-random keys, the same in each run, and are sorted by them within their
    source. A prefix sum over that order says where the source's budget ends: whole epochs are
    taken of every document, and the rest of the budget is filled from the front; the document
    in which it ends gives only the words up to it, so a source's taken words are its target,
    rounded. No document gives more than most times its size.

    Returns id, size, source, source_size, target, epochs (whole ones), part (words of the last,
    broken epoch), taken and key. Null texts have size 0; sources may be null, and null is a source.
    Rows that share an id and a size are told apart by nothing and may swap places. An empty table
    gives no rows. Other columns are left out. Key buckets split a source that holds most rows.
    """
    items = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"), _key(F.col(id_col), seed).alias("_key")))
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = checkpointed(budgets(sizes, weights=weights, most=most))
    buckets = bucket_count(items.count(), 8000)
    # the key's first 8 hexadecimal digits, scaled: a range of keys for each bucket
    spread = items.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32)).cast("int"))
    placed = running_total(spread, ["source"], "_bucket", ["_key", "id", "size"], F.col("size"), "_before")
    few = sources.select(F.col("source").alias("_source"), "source_size", "target")
    joined = placed.join(few, placed["source"].eqNullSafe(few["_source"])).drop("_source")
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    out = joined.withColumn("epochs", epochs).withColumn("part", part)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "epochs", "part", taken.alias("taken"), F.col("_key").alias("key"))


def take_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: rows of docs, whole and as often as the mix takes them; the others are left out.

    As mix_documents, but the document in which a source's budget ends is taken whole if half of it or more
    is, else not. So only the last key of each source has to be known: texts are not moved. Repeated rows
    in which a budget ends go or stay together. The table of sources is broadcast if it has at most
    MOST_BROADCAST rows, else joined.
    """
    mixed = mix_documents(docs, weights, most, seed, id_col, text_col, source_col)
    place = F.struct(F.col("key"), F.col(id_col).alias("id"), F.col("size"))
    enough = (F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))
    source, epochs, end, own, times = (fresh(docs, n) for n in ("_source", "_epochs", "_end", "_place", "_times"))
    ends = mixed.groupBy(F.col(source_col).alias(source)).agg(F.max("epochs").alias(epochs), F.max(F.when(enough, place)).alias(end))
    ends = checkpointed(ends)
    few = F.broadcast(ends) if ends.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ends
    here = F.struct(_key(F.col(id_col), seed).alias("key"), F.col(id_col).alias("id"), _size(F.col(text_col)).alias("size"))
    joined = docs.join(few, docs[source_col].eqNullSafe(few[source])).withColumn(own, here)
    more = F.when(F.col(end).isNotNull() & (F.col(own) <= F.col(end)), 1).otherwise(0)
    repeated = joined.withColumn(times, (F.col(epochs) + more).cast("int")).filter(F.col(times) > 0)
    return repeated.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
