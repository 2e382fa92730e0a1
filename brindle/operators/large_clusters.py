"""Clusters of nodes whose labels lie in many tasks: k-means of any distance, and with equal sizes.

Each round is one pass that sums the rows near each centre; only centres, as one array, and these sums are the driver's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.blocks import matrix
from brindle.functions.vectors import unit
from brindle.sources.files import checkpointed, ranked

#: Rounds of starts that are far apart, and rows that prices of equal sizes are found on.
START_ROUNDS, PRICE_ROWS = 5, 20_000


def directions(z: np.ndarray, cosine: bool) -> np.ndarray:
    size = np.linalg.norm(z, axis=1)
    return z / np.where(size == 0, 1, size)[:, None] if cosine else z.astype(float)


def nearness(u: np.ndarray, centres: np.ndarray, cosine: bool) -> np.ndarray:
    """Greater is nearer: cosines, or squared distances less the rows' own squares, turned round."""
    return u @ centres.T if cosine else 2 * u @ centres.T - (centres * centres).sum(1)


def _summing(centres: np.ndarray, prices: np.ndarray, cosine: bool):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, inertia, squares = np.zeros((len(centres), centres.shape[1] + 1)), 0.0, 0.0
        for batch in incoming:
            u = directions(matrix(batch.column(0)), cosine)
            near = nearness(u, centres, cosine)
            own = np.round(near - prices, 9).argmax(1)
            np.add.at(sums, own, np.hstack((u, np.ones((len(u), 1)))))
            squares += (u * u).sum()
            inertia += (u * u).sum() - (near[np.arange(len(u)), own].sum() * (2 if cosine else 1)) + (len(u) if cosine else 0)
        for c in np.flatnonzero(sums[:, -1]).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([sums[c].tolist()], pa.list_(pa.float64())), pa.array([0.0]), pa.array([0.0])], ["cluster", "sums", "inertia", "squares"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([[]], pa.list_(pa.float64())), pa.array([inertia]), pa.array([squares])], ["cluster", "sums", "inertia", "squares"])

    return run


def _adding(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cluster to one of each."""
    at, total, inertia, squares = None, np.zeros(0), 0.0, 0.0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([inertia]), pa.array([squares])], ["cluster", "sums", "inertia", "squares"])
    for batch in incoming:
        for c, own, i, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            values = own.values.to_numpy()
            if c != at:
                if at is not None:
                    yield row()
                at, total, inertia, squares = c, values.copy(), i, s
            else:
                total, inertia, squares = total + values, inertia + i, squares + s
    if at is not None:
        yield row()


_SUMS = "cluster int, sums array<double>, inertia double, squares double"


def sums_of(rows: DataFrame, centres: np.ndarray, cosine: bool, prices: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Of rows (z): the sums of those nearest to each centre, prices off, how many these are, their inertia, and the sum of all squares."""
    parts = rows.select("z").mapInArrow(_summing(centres, np.zeros(len(centres)) if prices is None else prices, cosine), _SUMS)
    out, counts, inertia, squares = np.zeros_like(centres), np.zeros(len(centres)), 0.0, 0.0
    for r in parts.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_adding, _SUMS).collect():  # one for each centre
        if r["cluster"] < 0:
            inertia, squares = r["inertia"], r["squares"]
        else:
            out[r["cluster"]], counts[r["cluster"]] = r["sums"][:-1], r["sums"][-1]
    return out, counts, inertia, squares


def _drawn(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """So many rows by a hash of their label."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(n).select("z").toArrow()
    return matrix(got["z"]) if len(got) else np.zeros((0, 1))


def _farther(centres: np.ndarray, share: float, seed: int):
    """Rows, each kept with a probability by its squared distance from the nearest centre; hashes of labels decide."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            u = matrix(batch.column(1))
            gap = np.maximum((u * u).sum(1) - nearness(u, centres, False).max(1), 0)
            draw = (batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)
            yield batch.filter(pa.array(draw / 2.0**53 < share * gap)).select([1])

    return run


def starts(rows: DataFrame, k: int, init, cosine: bool, seed: int) -> np.ndarray:
    """First centres: given, drawn, or far apart: a few rounds take rows by their distance from those taken before, and of these, by how many rows are near each, k
    are chosen far apart on the driver. Each round takes about 2k rows."""
    if not isinstance(init, str):
        return np.array(init, float)
    if init == "random":
        return directions(_drawn(rows, k, seed), cosine)
    if init not in ("k-means++", "scalable-k-means++", "k-means||"):
        raise ValueError(f"unknown init {init!r}")
    taken = directions(_drawn(rows, 1, seed), cosine)
    held = rows.withColumn("z", unit(F.col("z"))) if cosine else rows
    hashed = held.select(F.xxhash64(F.lit(seed), "label_id").alias("hash"), "z")
    for r in range(START_ROUNDS):
        _, _, inertia, squares = sums_of(held, taken, False)
        if inertia <= 1e-12 * max(1.0, squares):
            break
        more = hashed.mapInArrow(_farther(taken, 2 * k / inertia, seed + r), "z array<double>").toArrow()
        if len(more):
            taken = np.concatenate((taken, matrix(more["z"])))
    _, counts, _, _ = sums_of(held, taken, False)
    rng, centres = np.random.default_rng(seed), [taken[counts.argmax()]]
    for _ in range(1, min(k, len(taken))):
        far = np.min([((taken - c) ** 2).sum(1) for c in centres], axis=0) * counts
        centres.append(taken[rng.choice(len(taken), p=far / far.sum())] if far.sum() > 0 else taken[rng.integers(len(taken))])
    return np.array(centres)


def centres_of(rows: DataFrame, k: int, init, cosine: bool, rounds: int, tol: float, seed: int, balanced: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, their prices (zero, if sizes needn't be equal) and the inertia after at most so many rounds: they end when centres' moves, squared, are together
    at most tol times the mean variance, or none moves."""
    centres = starts(rows, k, init, cosine, seed)
    sample = directions(_drawn(rows, PRICE_ROWS, seed + 1), cosine) if balanced else None
    prices, inertia, n = np.zeros(len(centres)), np.inf, None
    for _ in range(rounds):
        if sample is not None:
            prices = even_prices(nearness(sample, centres, cosine))
        sums, counts, inertia, squares = sums_of(rows, centres, cosine, prices)
        new = centres.copy()
        some = counts > 0
        new[some] = sums[some] / counts[some, None]
        if cosine:
            new[some] = directions(new[some], True)
        if n is None:
            n = counts.sum()
            middle = sums.sum(0) / n
            spread = max(squares / n - middle @ middle, 0.0) / centres.shape[1]
        moved = ((new - centres) ** 2).sum()
        centres = new
        if moved <= max(tol * spread, 1e-18):
            break
    if sample is not None:
        prices = even_prices(nearness(sample, centres, cosine))
    return centres, prices, inertia


def even_prices(near: np.ndarray) -> np.ndarray:
    """Prices of clusters at which about equally many rows choose each: raised where too many do, lowered where too few, by ever smaller steps."""
    n, k = near.shape
    prices, step = np.zeros(k), max(float(near.std()), 1e-9)
    best, least = prices.copy(), np.inf
    for t in range(400):
        share = np.bincount((near - prices).argmax(1), minlength=k) / n * k - 1
        if np.abs(share).max() < least:
            least, best = np.abs(share).max(), prices.copy()
        if least <= k / n:
            break
        prices = prices + step * share
        if t % 20 == 19:
            step *= 0.8
    return best


def _choosing(centres: np.ndarray, prices: np.ndarray, cosine: bool):
    """(node, label_id, z) to (node, label_id, cluster, near), near being what each cluster offers, prices off."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            offer = np.round(nearness(directions(matrix(batch.column(2)), cosine), centres, cosine) - prices, 9)
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(offer) + 1, dtype=np.int32) * offer.shape[1]), pa.array(offer.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offer.argmax(1).astype(np.int32)), near], ["node", "label_id", "cluster", "near"])

    return run


def assigned(rows: DataFrame, centres: np.ndarray, prices: np.ndarray, cosine: bool) -> DataFrame:
    return rows.select("node", "label_id", "z").mapInArrow(_choosing(centres, prices, cosine), "node long, label_id long, cluster int, near array<double>")


def evened(found: DataFrame, k: int) -> DataFrame:
    """Rows (node, label_id, cluster, near) with sizes that differ by one at most: what is too much in one cluster goes where least is lost by it.

    The rows of the fullest are ranked by what they lose in the emptiest, over all tasks, and the first so many go; each step evens one of the two, so there are
    at most 2k of them. Equal rows are told apart by label.
    """
    found = checkpointed(found)
    sizes = np.zeros(k, int)
    for r in found.groupBy("cluster").agg(F.count("*").alias("n")).collect():
        sizes[r["cluster"]] = r["n"]
    goal = np.full(k, sizes.sum() // k)
    goal[np.argsort(-sizes, kind="stable")[: sizes.sum() % k]] += 1
    while (sizes > goal).any():
        full, short = int((sizes - goal).argmax()), int((goal - sizes).argmax())
        n = int(min(sizes[full] - goal[full], goal[short] - sizes[short]))
        loss = (F.col("near")[full] - F.col("near")[short]).alias("loss")
        leaving = found.filter(F.col("cluster") == full).select("node", "label_id", F.struct(loss, "label_id").alias("key"))
        gone = ranked(leaving, "key", "place").filter(F.col("place") < n).select("node", "label_id", F.lit(short).alias("to"))
        found = checkpointed(found.join(gone, ["node", "label_id"], "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to"))
        sizes[full] -= n
        sizes[short] += n
    return found
