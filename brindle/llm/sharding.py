"""Sharding by best-fit-decreasing bin packing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bucket_count, checkpointed, partitions, running_total

#: At most so many cells and cartons, whatever the input, so that what the driver packs is bounded.
MOST_CELLS, MOST_CARTONS = 4096, 65_536
#: Cartons are at most this part of a shard, unless one group is larger; with more shards, a larger part.
CARTONS_PER_SHARD = 512
#: Up to so many shards, cartons are packed on the driver; beyond, each cell packs shards of its own: at most so many, and no fewer than the last unless there are few groups.
DRIVER_SHARDS, CELL_SHARDS, LEAST_SHARDS = 512, 256, 16


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


class CapacityTree:
    """AVL tree of (remaining capacity, bin), to find the tightest bin that still has room."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _high(node: _Node | None) -> int:
        return node.height if node else 0

    @classmethod
    def _sized(cls, node: _Node) -> _Node:
        node.height = 1 + max(cls._high(node.left), cls._high(node.right))
        return node

    @classmethod
    def _turn(cls, node: _Node, to_left: bool) -> _Node:
        if to_left:
            top = node.right
            node.right, top.left = top.left, node
        else:
            top = node.left
            node.left, top.right = top.right, node
        cls._sized(node)
        return cls._sized(top)

    @classmethod
    def _balanced(cls, node: _Node) -> _Node:
        cls._sized(node)
        lean = cls._high(node.left) - cls._high(node.right)
        if lean > 1:
            if cls._high(node.left.left) < cls._high(node.left.right):
                node.left = cls._turn(node.left, True)
            return cls._turn(node, False)
        if lean < -1:
            if cls._high(node.right.right) < cls._high(node.right.left):
                node.right = cls._turn(node.right, False)
            return cls._turn(node, True)
        return node

    @classmethod
    def _insert(cls, node: _Node | None, key: tuple[int, int]) -> _Node:
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = cls._insert(node.left, key)
        else:
            node.right = cls._insert(node.right, key)
        return cls._balanced(node)

    @classmethod
    def _remove(cls, node: _Node, key: tuple[int, int]) -> _Node | None:
        if key < node.key:
            node.left = cls._remove(node.left, key)
        elif key > node.key:
            node.right = cls._remove(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left:
                least = least.left
            node.key = least.key
            node.right = cls._remove(node.right, least.key)
        return cls._balanced(node)

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least capacity of at least size; ties: the lower bin."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        if best is not None:
            self.root = self._remove(self.root, best)
        return best


class BestFit:
    """Bins of one capacity, filled with items that come by decreasing size."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.tree = capacity, 0, CapacityTree()

    def place(self, size: int) -> int:
        """The bin that the item enters. One larger than the capacity gets a bin alone."""
        room = self.tree.take(size)
        if room is None:
            room, self.bins = (self.capacity, self.bins), self.bins + 1
        if room[0] > size:
            self.tree.add((room[0] - size, room[1]))
        return room[1]


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> tuple[list[int], int]:
    """For sizes that decrease: the bin of each, and how many bins there are."""
    fit = BestFit(capacity)
    return [fit.place(size) for size in sizes], fit.bins


def least_capacity(sizes: list[int], bins: int) -> int:
    """The least capacity found by bisection with which best fit needs no more than so many bins."""
    low = max([-(-sum(sizes) // bins), *sizes[:1], 1])
    if best_fit_decreasing(sizes, low)[1] <= bins:
        return low
    high = low * 2 + 1
    while best_fit_decreasing(sizes, high)[1] > bins:
        high *= 2
    while high - low > max(1, low // 10_000_000):
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(sizes, middle)[1] <= bins else (middle, high)
    return high


def spread_evenly(sizes: list[int], bins: int) -> list[int]:
    """For sizes that decrease: the bin of each, of so many bins of near equal sums.

    Sizes above the fair share of what is left are alone in a bin each; the others share the bins that remain.
    """
    alone, rest = 0, sum(sizes)
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    others = sizes[alone:]
    placed, _ = best_fit_decreasing(others, least_capacity(others, bins - alone))
    return [*range(alone), *(alone + b for b in placed)]


def _cartons(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, fit = None, None
        for batch in batches:
            into = []
            for at, size in zip(batch["cell"].tolist(), batch["weight"].tolist(), strict=True):
                if at != cell:
                    cell, fit = at, BestFit(capacity)
                into.append(fit.place(size))
            yield batch.assign(carton=into)

    return pack


def _own_shards(capacity: int | None):
    """Rows sorted by (cell, weight downwards): each cell's groups go to bins of its own, of one capacity or as many as the cell has.

    Of a cell only the weights are held, and only where its bins are to be even.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if capacity is not None:
            yield from _cartons(capacity)(batches)
            return
        held: list[pd.DataFrame] = []

        def packed() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            return rows.assign(carton=spread_evenly(rows["weight"].tolist(), int(rows["bins"].iloc[0]))).drop(columns="bins")

        for batch in batches:
            for _, part in batch.groupby("cell", sort=False):
                if held and held[0]["cell"].iloc[0] != part["cell"].iloc[0]:
                    yield packed()
                    held = []
                held.append(part)
        if held:
            yield packed()

    return pack


def _many_shards(groups: DataFrame, total: int, wanted: int, n_shards: int | None, capacity: int | None) -> tuple[DataFrame, int]:
    """As assign_shards, where there are too many shards for one place: each cell of hashed groups has its own."""
    many = bucket_count(groups.count())
    cells = max(1, wanted // CELL_SHARDS, min(many, wanted // LEAST_SHARDS))
    cell = F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int").alias("cell")
    kind = "group binary, weight long, cell int, carton long"
    if capacity:
        celled, alone = groups.select("group", "weight", cell), None
    else:
        # groups above the fair share are alone; the cells divide the other shards by their weight, at least one each
        alone = checkpointed(groups.filter(F.col("weight") * n_shards > total))
        n_alone, taken = alone.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
        cells = max(1, (n_shards - n_alone) // CELL_SHARDS, min(many, (n_shards - n_alone) // LEAST_SHARDS))
        cell = F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int").alias("cell")
        celled = groups.filter(F.col("weight") * n_shards <= total).select("group", "weight", cell)
        left = n_shards - n_alone
        sums = checkpointed(celled.groupBy("cell").agg(F.sum("weight").alias("sum")))
        # cut points of the running share are rounded, so the bins of all cells are as many as are left
        before = F.coalesce(F.sum("sum").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spare, rest = left - cells, max(1, total - taken)
        cut = lambda upto: F.floor(upto * spare / F.lit(float(rest)) + 1e-9)
        bins = sums.select("cell", (1 + cut(before + F.col("sum")) - cut(before)).cast("int").alias("bins"))
        celled = celled.join(bins, "cell")
    names = ["group", "weight", "cell", *(["bins"] if not capacity else [])]
    sorted_ = celled.select(*names).repartition(min(cells, 4 * partitions(groups)), "cell").sortWithinPartitions("cell", F.desc("weight"), "group")
    packed = checkpointed(sorted_.mapInPandas(_own_shards(capacity), kind))
    used = packed.groupBy("cell").agg((F.max("carton") + 1).alias("used"))
    first = F.coalesce(F.sum("used").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpointed(used.select("cell", first.alias("first"), "used"))  # a row for each CELL_SHARDS shards
    n_bins = starts.agg(F.coalesce(F.sum("used"), F.lit(0))).first()[0]
    placed = packed.join(starts, "cell").select("group", (F.col("first") + F.col("carton")).cast("int").alias("shard"))
    if alone is None:
        return placed, n_bins
    buckets = alone.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(64)))
    ranked = running_total(buckets.withColumn("all", F.lit(0)), ["all"], "cell", ["group"], F.lit(1).cast("long"), "rank")
    return placed.unionByName(ranked.select("group", (F.col("rank") + n_bins).cast("int").alias("shard"))), n_shards


def assign_shards(groups: DataFrame, n_shards: int | None = None, capacity: int | None = None) -> tuple[DataFrame, int]:
    """Put indivisible groups (group binary, weight long) into shards; (group, shard) and the number of shards.

    With n_shards, cartons above the fair share of what is left get a shard each, and the capacity of the other
    shards is the least with which they do. With capacity, the number of shards follows; a group beyond the capacity gets a shard alone.

    Best fit runs in two levels, since one task can't see all groups: groups are hashed to at
    most MOST_CELLS cells, and each cell's groups, streamed by decreasing weight, go to cartons
    of a small part of a shard. As best fit leaves at most one carton of a cell half empty, there
    are no more than 2 * MOST_CARTONS cartons and one for each cell. These
    are then packed whole on the driver. No shard is cut, and no group is.

    With more than DRIVER_SHARDS shards, the groups of a cell go straight to shards of its own, in parallel: LEAST_SHARDS to CELL_SHARDS of them, as the number of
    groups asks. At most one shard of each cell is left half empty, 3 % of all at worst, and nothing goes to the driver.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give either n_shards or capacity")
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wanted = n_shards or max(1, -(-total // capacity))
    if wanted > DRIVER_SHARDS and count:
        return _many_shards(groups, total, wanted, n_shards, capacity)
    carton = max(1, total // (wanted * max(1, min(CARTONS_PER_SHARD, MOST_CARTONS // wanted))))
    cells = min(MOST_CELLS, bucket_count(count))
    celled = groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int"))
    sorted_ = celled.repartition(min(cells, 4 * partitions(groups)), "cell").sortWithinPartitions("cell", F.desc("weight"), "group")
    packed = checkpointed(sorted_.mapInPandas(_cartons(carton), "group binary, weight long, cell int, carton long"))
    rows = packed.groupBy("cell", "carton").agg(F.sum("weight").alias("weight")).collect()
    rows.sort(key=lambda r: (-r["weight"], r["cell"], r["carton"]))
    sizes = [r["weight"] for r in rows]
    bins, n_bins = best_fit_decreasing(sizes, capacity) if capacity else (spread_evenly(sizes, n_shards), n_shards)
    to = groups.sparkSession.createDataFrame([(r["cell"], r["carton"], b) for r, b in zip(rows, bins, strict=True)], "cell int, carton long, shard int")
    return packed.join(F.broadcast(to), ["cell", "carton"]).select("group", "shard"), n_bins


def shard_documents(docs: DataFrame, n_shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of near equal bytes in which equal texts stay together.

    Returns id, size (UTF-8 bytes of the text and 1), text_crc32, shard (from 0) and slot (gapless
    from 0 in each shard, in no special order but the same again for the same rows).

    A null text has size 1 and forms a group apart from the empty text. Repeated rows are rows
    of their own with slots of their own. Null ids are kept. An empty table gives no rows. Other
    columns are left out. A group larger than a shard's fair share makes its shard larger, as groups
    are never cut; the others are spread evenly over the other shards.
    """
    text = F.col(text_col)
    items = checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.octet_length(text).cast("long") + 1, F.lit(1).cast("long")).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null")).alias("group"),
        )
    )
    groups = items.groupBy("group").agg(F.sum("size").alias("weight"))
    to, _ = assign_shards(groups, n_shards, capacity)
    placed = items.join(to, "group").select("id", "size", "text_crc32", "shard")
    buckets = bucket_count(items.count())
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)))
    ranked = running_total(placed, ["shard"], "_bucket", ["id", "text_crc32", "size"], F.lit(1).cast("long"), "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
