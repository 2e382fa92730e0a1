"""Negatives of labels: bounded heaps, filled while mentions pass by in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.blocks import held_rows, matrix, meet, table, width_of

#: Mentions that are scored together, and entries of the heaps that a task holds of one kind.
PER_STEP, HEAP_ENTRIES = 2048, 1 << 18
#: Entries of a heap in one row, so that a batch of rows is small.
PIECE = 256
#: Rows of a batch that is given on.
OUT_ROWS = 16_384
#: Scores are compared at nine digits.
DIGITS = 1e9
_TAKEN = np.iinfo(np.int64).max

#: A phase: its share of n_neg (None: what is left of it, among those not yet taken), and what it goes by: draw, cos or ip.
Phase = tuple[float | None, str]
#: Random keys of (epoch, labels, mentions): a row for each mention, a column for each label; the least are drawn.
Draw = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def mixed(seed: int) -> Draw:
    """Keys by hash of seed, epoch, label and mention: the same wherever they are made."""

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def draw(epoch: int, labels: np.ndarray, mentions: np.ndarray) -> np.ndarray:
        start = np.array((seed * 1_000_003 + epoch) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        own = mix(labels.astype(np.int64).view(np.uint64) + start)
        return (mix(own[None] ^ mix(mentions.astype(np.int64).view(np.uint64))[:, None]) >> np.uint64(1)).astype(np.int64)

    return draw


def quotas(phases: list[Phase], n: int) -> list[int]:
    """How many each phase takes: shares of n, rounded half to even, and what they leave."""
    out: list[int] = []
    for share, _ in phases:
        out.append(n - sum(out) if share is None else int(np.rint(share * n)))
    return out


def _sizes(epochs: list[list[Phase]], n: int) -> dict[tuple[str, int], int]:
    """Entries that a label's heaps must have: of draws for each epoch, else for all of them."""
    out: dict[tuple[str, int], int] = {}
    for e, phases in enumerate(epochs, 1):
        for (share, by), q in zip(phases, quotas(phases, n), strict=True):
            at = by, e if by == "draw" else 0
            out[at] = max(out.get(at, 0), n if share is None else q)
    return out


class _Heap:
    """The entries of least (key, mention), so many."""

    def __init__(self, size: int):
        self.size, self.keys, self.ids, self.most = size, [], [], _TAKEN
        self.held = 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        good = keys < self.most if self.held < self.size or self.most == _TAKEN else keys <= self.most
        if not self.size or not good.any():
            return
        self.keys.append(keys[good])
        self.ids.append(ids[good])
        self.held += len(self.keys[-1])
        if self.held > 2 * self.size + 256:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        order = np.lexsort((ids, keys))[: self.size]
        self.keys, self.ids, self.held = [keys[order]], [ids[order]], len(order)
        if len(order) == self.size:
            self.most = keys[order[-1]]
        return self.keys[0], self.ids[0]


def _filling(epochs: list[list[Phase]], draw: Draw):
    class Filling:
        """Heaps of a chunk of labels: every mention that passes by is offered to each label that it doesn't have."""

        def __init__(self, key: tuple, held: pa.Table):
            order = np.argsort(held["label_id"].to_numpy(), kind="stable")
            self.node, self.labels, self.z = key[0], held["label_id"].to_numpy()[order], matrix(held["z"])[order]
            self.heaps = [{at: _Heap(size) for at, size in _sizes(epochs, int(n)).items()} for n in held["n_neg"].to_numpy()[order]]

        def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for low in range(0, rows.num_rows, PER_STEP):
                some = rows.slice(low, PER_STEP)
                ids, x = some.column("mention_id").to_numpy(), matrix(some.column("vec"))
                own = some.column("own")
                whose = np.repeat(np.arange(len(ids)), np.diff(own.offsets.to_numpy()))
                theirs = own.flatten().to_numpy()
                at = np.minimum(np.searchsorted(self.labels, theirs), len(self.labels) - 1)
                has = self.labels[at] == theirs
                ip = x @ self.z.T
                keys = {("ip", 0): -np.rint(ip * DIGITS).astype(np.int64), ("cos", 0): -np.rint(ip / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None] * DIGITS).astype(np.int64)}
                keys |= {("draw", e): draw(e, self.labels, ids) for e, phases in enumerate(epochs, 1) if any(by == "draw" for _, by in phases)}
                for way, key in keys.items():
                    key[whose[has], at[has]] = _TAKEN
                    for j, heaps in enumerate(self.heaps):
                        if way in heaps:
                            heaps[way].add(key[:, j], ids)
            return iter(())

        def end(self) -> Iterator[pa.RecordBatch]:
            for label, heaps in zip(self.labels.tolist(), self.heaps, strict=True):
                got = {at: heap.settle() for at, heap in heaps.items()}
                for (way, epoch), entries in got.items():
                    edges = np.append(np.arange(0, len(entries[0]), PIECE), len(entries[0])).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(side)) for side in entries]
                    n = len(edges) - 1
                    yield table({"node": np.full(n, self.node), "label_id": np.full(n, label), "way": pa.array([way] * n, pa.string()), "epoch": np.full(n, epoch, np.int32), "keys": lists[0], "ids": lists[1]})

    return Filling


def settled(heaps: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], phases: list[Phase], epoch: int, n: int) -> np.ndarray:
    """The negatives of one epoch, of heaps sorted by (key, mention): what the phases take, united, ascending, at most n."""
    taken = np.zeros(0, np.int64)
    for (share, by), q in zip(phases, quotas(phases, n), strict=True):
        ids = heaps[by, epoch if by == "draw" else 0][1]
        if share is None:
            ids = ids[~np.isin(ids, taken)]
        taken = np.union1d(taken, ids[: max(0, q)])
    return taken[:n]


def choose(labels: DataFrame, mentions: DataFrame, epochs: list[list[Phase]], draw: Draw) -> DataFrame:
    """Negatives of labels, epoch by epoch (from 1): (node, label_id, mention_id, epoch).

    labels: (node, cluster, label_id, z, n_neg); mentions: (node, cluster, mention_id, vec, own), own being an array of the mention's labels, which it is no negative
    of. Each mention is scored with each label of its clusters, by inner product, cosine and random key at once, but no such pair is written: a block of labels
    keeps heaps of n_neg entries at most, and those of a label are merged. Phases as routing.pick_negatives takes them, ties to the lower mention. A
    mention is in a cluster once.
    """
    parts = labels.agg(F.avg("n_neg")).first()[0] or 1.0
    chunk = max(1, min(held_rows(width_of(labels, "z")), int(HEAP_ENTRIES / max(1.0, parts))))
    held = labels.select("node", F.col("cluster").cast("long").alias("cluster"), F.col("label_id").cast("long").alias("label_id"), "z", F.col("n_neg").cast("long").alias("n_neg"))
    passing = mentions.select("node", F.col("cluster").cast("long").alias("cluster"), F.col("mention_id").cast("long").alias("mention_id"), "vec", F.col("own").cast("array<long>").alias("own"))
    found = meet(held, passing, ["node", "cluster"], "label_id", "mention_id", _filling(epochs, draw), "node long, label_id long, way string, epoch int, keys array<long>, ids array<long>", chunk)
    known = found.select("node", "label_id", F.lit(None).cast("long").alias("n_neg"), "way", "epoch", "keys", "ids")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    wanted = labels.select(F.col("node").cast("long").alias("node"), F.col("label_id").cast("long").alias("label_id"), F.col("n_neg").cast("long").alias("n_neg"), none("string", "way"), none("int", "epoch"), none("array<long>", "keys"), none("array<long>", "ids"))
    # a label's number of negatives comes first
    dealt = wanted.unionByName(known).repartition("node", "label_id").sortWithinPartitions("node", "label_id", F.col("n_neg").desc_nulls_last())
    return dealt.mapInArrow(_merging(epochs), "node long, label_id long, mention_id long, epoch int")


def _merging(epochs: list[list[Phase]]):
    """Batches of rows sorted by label to its negatives: heaps of a label's blocks are merged as they come, in heaps of the same sizes."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, heaps = None, 0, {}

        def end() -> Iterator[pa.RecordBatch]:
            if any(heap.held for heap in heaps.values()):
                got = {way: heap.settle() for way, heap in heaps.items()}
                for e, phases in enumerate(epochs, 1):
                    ids = settled(got, phases, e, n)
                    for low in range(0, len(ids), OUT_ROWS):
                        some = ids[low : low + OUT_ROWS]
                        yield table({"node": np.full(len(some), at[0]), "label_id": np.full(len(some), at[1]), "mention_id": some, "epoch": np.full(len(some), e, np.int32)})

        for batch in incoming:
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label_id")])
            edges = np.concatenate(([0], np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1, [batch.num_rows]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if low == high:
                    continue
                rows = batch.slice(low, high - low)
                if (where := tuple(places[:, low].tolist())) != at:
                    yield from end()
                    at, n, heaps = where, 0, {}
                    if rows.column("n_neg")[0].is_valid:
                        n = rows.column("n_neg")[0].as_py()
                        heaps = {way: _Heap(size) for way, size in _sizes(epochs, n).items()}
                if heaps:
                    for way, epoch, keys, ids in zip(rows.column("way").to_pylist(), rows.column("epoch").to_pylist(), rows.column("keys"), rows.column("ids"), strict=True):
                        if way is not None:
                            heaps[way, epoch].add(keys.values.to_numpy(), ids.values.to_numpy())
        yield from end()

    return run
