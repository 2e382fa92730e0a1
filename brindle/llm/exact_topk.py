"""Exact top-k search by inner products, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bucket_count, checkpointed, partitions

#: Rows of a block, and of a group of blocks that one task searches.
PER_BLOCK, PER_GROUP = 128, 32_768
#: The order of rows is fitted on so many, by so many directions.
SAMPLE_ROWS, ORDER_BITS = 8192, 16
#: Queries that are scored together, and the most bytes of group maxima that are sent to all tasks.
PER_ASK, MOST_SUMMARY = 512, 64 << 20
#: Null ids, which come last of equals.
_NULL = 2**63 - 1
_BLOCKS = "part int, kind int, dim int, ids binary, terms binary, high binary, low binary"
_ASKS = "part int, kind int, dim int, ids binary, terms binary, high binary, low binary"
_FOUND = "query_id long, vec_id long, score long"


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by doubles where every sum fits them, else by longs, else by Python's numbers (cut to longs)."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float((np.abs(queries).astype(float) @ np.abs(rows).max(0).astype(float)).max())
    if most < 2**53:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return queries @ rows.T
    return np.clip(queries.astype(object) @ rows.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, the sum over terms of the most that a row of the block can add: never less than a row's score.

    In doubles, with what rounding may take added on top.
    """
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    sums = up @ high.T.astype(float) + down @ low.T.astype(float)
    size = np.abs(queries).astype(float) @ np.maximum(np.abs(high.astype(float)), np.abs(low.astype(float))).T
    return sums + size * (queries.shape[1] + 2) * 2.0**-52


class Blocks:
    """Blocks of rows of one width: a forward index of the rows, and each block's greatest and least value of every term."""

    def __init__(self, ids: list[np.ndarray], terms: list[np.ndarray], high: np.ndarray, low: np.ndarray):
        self.ids, self.terms, self.high, self.low = ids, terms, high, low

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows without those of the query's own id, or fewer where they are below least: (ids, scores), best first.

        Blocks are taken by falling bound. Once k rows are found, or least is known, a block whose bound is below is passed over, and so are all after it.
        """
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable").tolist():
            if least is not None and bound[b] < least:
                break
            score = products(query[None], self.terms[b])[0]
            good = self.ids[b] != own
            if least is not None:
                good &= score >= least
            if not good.any():
                continue
            ids, scores = np.concatenate((ids, self.ids[b][good])), np.concatenate((scores, score[good]))
            if len(ids) >= k:
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                least = int(scores[-1]) if least is None else max(least, int(scores[-1]))
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _longs(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def order_code(mean: np.ndarray, axes: np.ndarray):
    """(dim, vec) to a number of ORDER_BITS bits: on which side of the sample's mean a row lies, by direction."""
    width = axes.shape[0]

    def code(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            out = np.zeros(len(dims), np.int64)
            at = np.flatnonzero(dims == width)
            if len(at) and width:
                rows = _matrix(batch.column(batch.schema.get_field_index("vec")).take(pa.array(at)), width)
                out[at] = ((rows - mean) @ axes > 0) @ (1 << np.arange(axes.shape[1] - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "code"])

    return code


def _cut(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, dim, vec_id, vec), sorted, to blocks of PER_BLOCK rows of one part and width."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    held, at, n = [], None, 0

    def block() -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        terms = np.concatenate([h[1] for h in held])
        data = (at[0], 0, at[1], ids.tobytes(), terms.tobytes(), terms.max(0).tobytes(), terms.min(0).tobytes())
        types = [pa.int32()] * 3 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(data, types, strict=True)], names)

    for batch in incoming:
        part, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids = batch.column(2).fill_null(_NULL).to_numpy()
        edges = np.flatnonzero((part[1:] != part[:-1]) | (dim[1:] != dim[:-1])) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True):
            while low < high:
                if at != (part[low], dim[low]) or n == PER_BLOCK:
                    if n:
                        yield block()
                    held, at, n = [], (part[low], dim[low]), 0
                upto = min(high, low + PER_BLOCK - n)
                held.append((ids[low:upto], _matrix(batch.column(3).slice(low, upto - low), int(dim[low]))))
                n += upto - low
                low = upto
    if n:
        yield block()


def _search(k: int):
    """Rows sorted by (part, kind): a group's blocks, then queries with the score that they must reach (least, or null), in packs."""

    def search(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, ready = None, {}, {}
        for batch in incoming:
            parts, kinds, dims = (batch.column(c).to_numpy() for c in range(3))
            for r in range(batch.num_rows):
                if parts[r] != at:
                    at, rows, ready = parts[r], {}, {}
                width = int(dims[r])
                ids, terms = _longs(batch.column(3), r), _longs(batch.column(4), r).reshape(-1, width)
                high, low = _longs(batch.column(5), r), _longs(batch.column(6), r)
                if kinds[r] == 0:
                    rows.setdefault(width, []).append((ids, terms, high, low))
                    continue
                if width not in rows:
                    continue
                if width not in ready:
                    ids_, terms_, high_, low_ = zip(*rows[width], strict=True)
                    ready[width] = Blocks(list(ids_), list(terms_), np.stack(high_), np.stack(low_))
                blocks, found = ready[width], []
                bound = bounds(terms, blocks.high, blocks.low)
                # a pack's thresholds are where a block has its maxima; low tells which of them are known
                for q in range(len(ids)):
                    v, s = blocks.search(terms[q], int(ids[q]), bound[q], k, int(high[q]) if low[q] else None)
                    found.append((np.full(len(v), ids[q], np.int64), v, s))
                q_ids, v_ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(v_ids, mask=v_ids == _NULL), pa.array(scores)], ["query_id", "vec_id", "score"])

    return search


def _route(summary: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], groups: dict[int, list[int]], first: bool):
    """Queries (dim, query_id, vec, least, home) in packs to groups: first, each to the one with the greatest bound; else to the others that may hold a row of least.

    summary: by width, the groups and their greatest and least terms; groups: by width, all groups, where there is no summary.
    """

    def route(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ASKS.split(", ")]
        for batch in incoming:
            dims = batch.column(0).to_numpy()
            for width in np.unique(dims).tolist():
                at = np.flatnonzero(dims == width)
                if width not in groups:
                    continue
                ids = batch.column(1).take(pa.array(at)).to_numpy()
                terms = _matrix(batch.column(2).take(pa.array(at)), width)
                least = batch.column(3).take(pa.array(at))
                known = np.asarray(least.is_valid())
                least = least.fill_null(0).to_numpy()
                if width in summary:
                    parts, high, low = summary[width]
                    bound = bounds(terms, high, low)
                    home = parts[bound.argmax(1)]
                    asks = parts[None] == home[:, None] if first else ((bound >= least[:, None]) | ~known[:, None]) & (parts[None] != home[:, None])
                else:
                    parts = np.array(groups[width])
                    home = parts[ids.astype(np.uint64) % np.uint64(len(parts))]
                    asks = (parts[None] == home[:, None]) == first
                for p, part in enumerate(parts.tolist()):
                    who = np.flatnonzero(asks[:, p])
                    for begin in range(0, len(who), PER_ASK):
                        some = who[begin : begin + PER_ASK]
                        data = (part, 1, width, ids[some].astype(np.int64).tobytes(), terms[some].tobytes(), least[some].astype(np.int64).tobytes(), known[some].astype(np.int64).tobytes())
                        types = [pa.int32()] * 3 + [pa.binary()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(data, types, strict=True)], names)

    return route


def _fit_order(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading directions of a bounded sample, of the width that most of it has."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", "vec").toArrow()
    dims = drawn["dim"].to_numpy()
    if not len(dims):
        return np.zeros(0), np.zeros((0, 0))
    values, counts = np.unique(dims, return_counts=True)
    width = int(values[counts.argmax()])
    sample = _matrix(drawn["vec"].combine_chunks().take(pa.array(np.flatnonzero(dims == width))), width).astype(float)
    sample = sample / max(1.0, np.abs(sample).max())
    mean = sample.mean(0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    scale = max(1.0, float(np.abs(_matrix(drawn["vec"].combine_chunks().take(pa.array(np.flatnonzero(dims == width))), width)).max()))
    return mean * scale, axes[:ORDER_BITS].T


def top_products(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of the greatest inner product for each query (rows for which is_query holds), exactly: query_id, rank, vec_id, score.

    Components become whole numbers, floor(scale * x). Rows are sorted by ranges of a code of ORDER_BITS signs, fitted on at most SAMPLE_ROWS rows (it only
    decides how much is passed over), and cut into blocks of PER_BLOCK rows with a forward index and the greatest and least value of each term; blocks
    form groups of about PER_GROUP rows. A query first asks the group with the greatest sum of term maxima, block after block by falling sums until they fall below its k-th
    score, and then, with that score, each group whose sum reaches it. Maxima of groups of more than MOST_SUMMARY bytes aren't sent
    to tasks; then all groups are asked, and their blocks decide.

    Ties go to the smaller id. A query has one row of each id that asks (of rows of one id with different vectors, the least vector asks); rows of its own id
    aren't candidates, other repeated rows each count. Vectors meet those of their own length only. Vectors that are null, empty, or hold null or non-finite components, or
    ones beyond 2^31 when scaled, take no part. Null ids can be found (last of equals, rank by rank) but don't ask. An empty table gives no rows. Other columns are left out.
    """
    vec, top = F.col(vector_col), float(2**31)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    sound = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < top))
    id_ = F.col(id_col).cast("long")
    rows = vectors.filter(F.coalesce(sound, F.lit(False))).select(id_.alias("vec_id"), whole.alias("vec"), F.size(vec).alias("dim"), (F.coalesce(is_query, F.lit(False)) & id_.isNotNull()).alias("asks"))
    n = rows.count()
    mean, axes = _fit_order(rows)
    kinds = "vec_id long, vec array<long>, dim int, asks boolean"
    coded = rows.mapInArrow(order_code(mean, axes), f"{kinds}, code long").withColumn("row", F.monotonically_increasing_id())
    order = ["dim", "code", "vec_id", "row"]
    ranged = coded.repartitionByRange(max(partitions(vectors), bucket_count(n, PER_GROUP)), *order).sortWithinPartitions(*order)
    blocks = checkpointed(ranged.select(F.spark_partition_id().alias("part"), "dim", "vec_id", "vec").mapInArrow(_cut, _BLOCKS))
    asking = rows.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "vec")).alias("q"))
    asking = checkpointed(asking.select("q.dim", "query_id", "q.vec", F.lit(None).cast("long").alias("least")))
    summary, groups = _summary(blocks)
    where = min(max(1, sum(map(len, groups.values()))), 4 * partitions(vectors))

    def ask(queries: DataFrame, first: bool) -> DataFrame:
        asks = queries.repartition(partitions(vectors)).mapInArrow(_route(summary, groups, first), _ASKS)
        together = blocks.unionByName(asks).repartition(where, "part").sortWithinPartitions("part", "kind")
        return together.mapInArrow(_search(k), _FOUND)

    near = checkpointed(ask(asking, True))
    full = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
    more = asking.drop("least").join(full.select("query_id", "least"), "query_id", "left").select("dim", "query_id", "vec", "least")
    found = near.unionByName(ask(more, False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reduce(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task to one row for each (part, dim): their greatest and least terms."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in incoming:
        for r in range(batch.num_rows):
            at = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
            high, low = _longs(batch.column(5), r), _longs(batch.column(6), r)
            if at in held:
                high, low = np.maximum(high, held[at][0]), np.minimum(low, held[at][1])
            held[at] = high, low
    for (part, dim), (high, low) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([high.tobytes()]), pa.array([low.tobytes()])], ["part", "dim", "high", "low"])


def _summary(blocks: DataFrame) -> tuple[dict, dict]:
    """By width: groups with their greatest and least terms (none if these are more than MOST_SUMMARY bytes), and all groups."""
    reduced = checkpointed(blocks.mapInArrow(_reduce, "part int, dim int, high binary, low binary"))
    small = (reduced.agg(F.sum(F.octet_length("high") * 2)).first()[0] or 0) <= MOST_SUMMARY
    groups: dict[int, list[int]] = {}
    terms: dict[int, list] = {}
    for r in (reduced if small else reduced.select("part", "dim")).orderBy("dim", "part").collect():
        groups.setdefault(r["dim"], []).append(r["part"])
        if small:
            terms.setdefault(r["dim"], []).append((r["part"], np.frombuffer(r["high"], np.int64), np.frombuffer(r["low"], np.int64)))
    summary = {d: (np.array([x[0] for x in own]), np.stack([x[1] for x in own]), np.stack([x[2] for x in own])) for d, own in terms.items()}
    return summary, groups
