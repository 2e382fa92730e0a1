"""Trie of conversation prefixes, with what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, partitions, running_total

#: Turns that a conversation may take over from another, at most.
MOST_SHARED = 8
#: Ids of a range of so many are put into one text before they are hashed.
ID_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()
_STEP = "conv long, part int, depth long, n_turns long, mark1 long, mark2 long, tokens long"


def _windowed(table: DataFrame, keys: list[str], other: str, parts: int) -> tuple[DataFrame, Window]:
    """Rows with a hash part of another column, so that a window over a hot key has the rows of one part only."""
    return table.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(parts))), Window.partitionBy(*keys, "salt").orderBy(other)


def placed_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, at, pos, content, tokens): turns by their place in their conversation, from 1, without their texts.

    Turns are sorted by ranges over all tasks, so one conversation may hold most of them; content is their SHA-256, tokens the bytes of their text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ranged = rows.repartitionByRange(partitions(turns), *order).sortWithinPartitions(*order)
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    held = checkpointed(ranged.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), content.alias("content"), F.octet_length("text").cast("long").alias("tokens")))
    return checkpointed(running_total(held, ["conv"], "part", ["at"], F.lit(1).cast("long"), "before").withColumn("pos", F.col("before") + 1).drop("before"))


def shared_starts(placed: DataFrame, source: Column, taken: Column) -> DataFrame:
    """Rebuild conversations: the first turns of another one, then their own. Steps (conv, part, depth, n_turns, mark1, mark2, tokens).

    placed: as placed_turns gives them. source and taken are expressions over conv: whose turns, and how many, MOST_SHARED at most. A conversation that isn't there
    has no turns to give. Each conversation also has a step of depth 0, its own length being n_turns.
    """
    sizes = placed.groupBy("conv").agg(F.count("*").alias("size"))
    first = F.array_sort(F.collect_list(F.struct("pos", "content", "tokens")))
    heads = placed.filter(F.col("pos") <= MOST_SHARED).groupBy(F.col("conv").alias("whose")).agg(first.alias("head"))
    asked = sizes.withColumn("h", taken).withColumn("from", source)
    joined = asked.join(heads, asked["from"] == heads["whose"], "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    given = F.size("head").cast("long")
    known = checkpointed(joined.select("conv", "h", "head", given.alias("given"), (given + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n_turns")))
    content = lambda c, d: (F.xxhash64(d, c, F.lit(1)).alias("mark1"), F.xxhash64(c, F.lit(2), d).alias("mark2"))
    root = known.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("depth"), "n_turns", F.lit(0).cast("long").alias("mark1"), F.lit(0).cast("long").alias("mark2"), F.lit(0).cast("long").alias("tokens"))
    ahead = known.select("conv", "n_turns", F.explode("head").alias("t")).select("conv", F.lit(-1).alias("part"), F.col("t.pos").alias("depth"), "n_turns", *content(F.col("t.content"), F.col("t.pos")), "t.tokens")
    own = placed.withColumn("h", taken).filter("pos > h").join(known.select("conv", "given", "n_turns"), "conv").withColumn("depth", F.col("given") + F.col("pos") - F.col("h"))
    own = own.select("conv", "part", "depth", "n_turns", *content(F.col("content"), F.col("depth")), "tokens")
    return root.unionByName(ahead).unionByName(own)


def prefix_keys(steps: DataFrame) -> DataFrame:
    """Steps with the key of the prefix that ends there (key1, key2), that of the one before (up1, up2), and the tokens before.

    A key is the sum without carry (exclusive or) of two 64-bit marks of each turn and its depth. Steps of a conversation are added up within parts, and
    the parts' sums in a small table, so a conversation may hold most of them.
    """
    cell = ["conv", "part"]
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"mark1": F.bit_xor, "mark2": F.bit_xor, "tokens": F.sum}
    cells = steps.groupBy(*cell).agg(*(f(c).alias(c) for c, f in sums.items()))
    starts = cells.select(F.col("conv").alias("c"), F.col("part").alias("p"), *(F.coalesce(f(c).over(before), F.lit(0).cast("long")).alias(f"{c}_at") for c, f in sums.items()))
    joined = steps.join(starts, reduce(lambda a, b: a & b, [steps["conv"] == starts["c"], steps["part"] == starts["p"]]))
    inside = Window.partitionBy(*cell).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = joined.select("conv", "depth", "n_turns", "mark1", "mark2", "tokens", *(f(c).over(inside).alias(f"{c}_in") for c, f in sums.items()), *(f"{c}_at" for c in sums))
    key = {k: F.col(f"mark{k}_in").bitwiseXOR(F.col(f"mark{k}_at")) for k in (1, 2)}
    up = {k: key[k].bitwiseXOR(F.col(f"mark{k}")) for k in (1, 2)}
    return keyed.select("conv", "depth", "n_turns", "tokens", key[1].alias("key1"), key[2].alias("key2"), up[1].alias("up1"), up[2].alias("up2"), (F.col("tokens_at") + F.col("tokens_in") - F.col("tokens")).alias("before"))


def _fold(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key1, key2, range): the SHA-256 of each key's texts, joined by commas, one text at a time."""
    at, digest = None, hashlib.sha256()
    names, done = ["node1", "node2", "ends_sha256"], []
    for batch in incoming:
        for one, two, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if (one, two) != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (one, two), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
            done = []
    if at is not None:
        done.append((*at, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)


def id_digests(members: DataFrame) -> DataFrame:
    """(node1, node2, ends_sha256) of (key1, key2, conv): a digest of each key's ids, ascending, joined by commas.

    Ids of a range of 2^ID_BITS become one text first; the texts of a key then pass through one task, one after the other.
    """
    ranges = members.groupBy("key1", "key2", F.shiftright("conv", ID_BITS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    return ranges.repartition("key1", "key2").sortWithinPartitions("key1", "key2", "range").mapInArrow(_fold, "node1 long, node2 long, ends_sha256 string")


def prefix_nodes(steps: DataFrame) -> DataFrame:
    """The trie of steps (as shared_starts gives them), a row for each different prefix.

    Returns conv_id (the smallest member), depth, parent_conv_id (the parent's smallest; null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (id_digests of the members that end there).

    A prefix belongs to its smallest member, and with it all longer ones of that member where it is the smallest too: a conversation owns a suffix of its
    path. Windows over prefixes, dealt to parts by conversation and then over the parts' first members, mark owned nodes and those that nobody
    continues. One group-by over prefixes then adds up, over members, the tokens from there on less the owned ones, and leaves: each node below is
    owned by exactly one member.
    """
    n = partitions(steps)
    key = ["key1", "key2"]
    path = checkpointed(prefix_keys(steps))
    marked, inside = _windowed(path, key, "conv", n)
    goes_on = F.max((F.col("n_turns") > F.col("depth")).cast("int")).over(Window.partitionBy(*key, "salt"))
    local = marked.withColumn("goes_on", goes_on).withColumn("nth", F.row_number().over(inside)).filter("nth = 1")
    over = Window.partitionBy(*key)
    owned = local.withColumn("goes_on", F.max("goes_on").over(over)).withColumn("nth", F.row_number().over(over.orderBy("conv"))).filter("nth = 1")
    owned = checkpointed(owned.select("conv", "depth", *key, "up1", "up2", "before", "goes_on"))
    suffix = owned.groupBy("conv").agg(F.min("depth").alias("from"), F.min("before").alias("shared"), F.max(1 - F.col("goes_on")).alias("leaf"), F.min_by(F.struct("up1", "up2"), "depth").alias("up"))
    above = owned.select(F.col("conv").alias("above"), F.col("key1").alias("k1"), F.col("key2").alias("k2"))
    # whose a conversation's first owned node's parent is: the root has none
    owners = suffix.select("conv", "from", "shared", "leaf", "up.up1", "up.up2")
    owners = owners.join(above, (owners["up1"] == above["k1"]) & (owners["up2"] == above["k2"]) & (owners["from"] > 0), "left").select("conv", "from", "shared", "leaf", "above")
    whole = path.groupBy("conv").agg(F.sum("tokens").alias("all"))
    known = whole.join(owners, "conv", "left").select("conv", F.coalesce("from", F.lit(2**62)).alias("from"), F.coalesce("shared", "all").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "above")
    each = path.join(known, "conv")
    saved = F.when(F.col("depth") < F.col("from"), F.col("shared") - F.col("before")).otherwise(F.lit(0))
    child = (F.col("depth") + 1 >= F.col("from")) & (F.col("depth") < F.col("n_turns"))
    parent = F.when(F.col("depth") > F.col("from"), F.col("conv")).otherwise(F.col("above"))
    nodes = each.groupBy(*key, "depth").agg(
        F.min("conv").alias("conv_id"), F.min_by(parent, "conv").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").cast("long").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    digests = id_digests(path.filter("depth = n_turns").select(*key, "conv"))
    out = nodes.join(digests, (nodes["key1"] == digests["node1"]) & (nodes["key2"] == digests["node2"]), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, source: Column | None = None, taken: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns (prefix_nodes); source and taken (over conv) rebuild conversations first, as in shared_starts.

    Turns go by turn_col, nulls first, then role and text; null roles and texts are empty, and repeated rows are turns of their own. Turns are the same if role and text are.
    Rows without an id take no part. Texts of any length count whole. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    placed = placed_turns(turns, id_col, turn_col, role_col, text_col)
    return prefix_nodes(shared_starts(placed, F.col("conv") if source is None else source, F.lit(0) if taken is None else taken))
