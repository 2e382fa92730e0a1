"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bucket_count, partitions

#: Trees of a cell's forest, and rows of one cell or of a part of it.
TREES, PER_CELL = 32, 8192
#: Bits of the strings that lead to a cell, and most cells.
ROUTE_BITS, MOST_CELLS = 24, 4096
#: What is fitted is fitted on at most so many rows and queries.
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 256
_U = np.uint64
_WEIGHTS = _U(1) << np.arange(63, -1, -1, dtype=_U)


def strings(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """A 64-bit hash string for each vector and tree: signs of projections on random directions."""
    out = np.empty((trees, len(vectors)), _U)
    rng = np.random.default_rng(seed)
    for t in range(trees):
        signs = vectors @ rng.standard_normal((vectors.shape[1], 64)) > 0
        out[t] = signs.astype(_U) @ _WEIGHTS
    return out


def _bounds(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest string that shares level bits with each."""
    if level == 0:
        return np.zeros_like(hashes), np.full_like(hashes, ~_U(0))
    shift = _U(64 - level)
    low = hashes >> shift << shift
    return low, low | ((_U(1) << shift) - _U(1))


class Forest:
    """Sorted arrays of the hash strings of some vectors, one for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 29):
        self.vectors, self.trees, self.seed = vectors, trees, seed
        hashes = strings(vectors, trees, seed)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, 1)

    def ranges(self, hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query: the places of the strings that share level bits with the query's."""
        low, high = _bounds(hashes, level)
        begin = np.stack([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, low, strict=True)])
        return begin, np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, high, strict=True)])

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query: rows that share a prefix with it in some tree, at least wanted different ones or all.

        Each tree is descended to the longest prefix that any of its strings shares with the query's; then all trees are ascended together, a
        bit at a time, until there are enough different rows. As what shares a longer prefix shares the shorter one too, the
        rows at a level are all that were met before, and levels where even all trees' places together are too few are passed over.
        """
        n = len(self.vectors)
        wanted = min(wanted, n)
        hashes = strings(queries, self.trees, self.seed)
        places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def at(level: int) -> tuple[np.ndarray, np.ndarray]:
            if level not in places:
                places[level] = self.ranges(hashes, level)
            return places[level]

        # the deepest level at which the places are enough, by halving
        low, high = np.zeros(len(queries), int), np.full(len(queries), 64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            enough = np.zeros(len(queries), bool)
            for level in np.unique(middle[low < high]).tolist():
                begin, end = at(level)
                enough[middle == level] = ((end - begin).sum(0) >= wanted)[middle == level]
            open_ = low < high
            low, high = np.where(open_ & enough, middle, low), np.where(open_ & ~enough, middle - 1, high)
        met = np.zeros(n, bool)
        for q, level in enumerate(low.tolist()):
            while True:
                if level == 0:
                    yield np.arange(n)
                    break
                begin, end = at(level)
                met[:] = False
                for order, a, b in zip(self.order, begin[:, q].tolist(), end[:, q].tolist(), strict=True):
                    met[order[a:b]] = True
                found = np.flatnonzero(met)
                if len(found) >= wanted:
                    yield found
                    break
                level -= 1


class Routes:
    """Cells of vectors: variable-length prefixes of one string, whose bits are the signs of projections on the sample's main axes.

    Cells are divided at the next bit as long as they hold more than their part of the sample. A query asks its own cell and then others in
    the order of how far it would have to move to share their prefix, until these hold the share of the other rows that is asked for.
    """

    def __init__(self, sample: np.ndarray, cells: int):
        units = sample / np.linalg.norm(sample, axis=1)[:, None]
        self.mean = units.mean(0)
        bits = min(ROUTE_BITS, sample.shape[1]) if cells > 1 else 0
        self.axes = np.linalg.eigh(np.cov((units - self.mean).T).reshape(sample.shape[1], -1))[1][:, ::-1][:, :bits]
        self.middle = np.median((units - self.mean) @ self.axes, 0)
        codes = self.codes(units)
        least = max(2.0, len(sample) / cells)
        found, stack = [], [(0, 0)]
        while stack:  # (prefix, its length); a cell has all codes that begin with it
            prefix, size = stack.pop()
            inside = int(np.count_nonzero(codes >> (bits - size) == prefix))
            if size < bits and inside > least and len(found) + len(stack) + 2 <= MOST_CELLS:
                stack += [(prefix * 2 + 1, size + 1), (prefix * 2, size + 1)]
            else:
                found.append((prefix << (bits - size), prefix, size, inside))
        found.sort()
        self.starts = np.array([f[0] for f in found], np.int64)
        self.size = np.array([f[2] for f in found])
        # of a cell's prefix: which bits are set, and which count
        self.signs = np.array([[(p >> (s - 1 - b)) & 1 if b < s else 0 for b in range(bits)] for _, p, s, _ in found], float).reshape(len(found), bits)
        self.counts = np.array([[b < s for b in range(bits)] for _, _, s, _ in found], float).reshape(len(found), bits)
        self.weight = np.array([f[3] + 0.5 for f in found]) / (len(sample) + 0.5 * len(found))

    def project(self, vectors: np.ndarray) -> np.ndarray:
        units = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
        return (units - self.mean) @ self.axes - self.middle

    def codes(self, units: np.ndarray) -> np.ndarray:
        bits = self.axes.shape[1]
        return (self.project(units) > 0).astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.codes(vectors), "right") - 1

    def asked(self, queries: np.ndarray, share: float) -> list[np.ndarray]:
        """For each query: cells by the squares of what its projections lack of their prefixes, its own first."""
        z = self.project(queries)
        square = z * z
        # a bit costs its square where its sign isn't the query's
        wrong_if_set, wrong_if_not = square * (z <= 0), square * (z > 0)
        cost = wrong_if_set @ (self.signs * self.counts).T + wrong_if_not @ ((1 - self.signs) * self.counts).T
        out = []
        for row in cost:
            order = np.argsort(row, kind="stable")
            held = np.cumsum(self.weight[order]) - self.weight[order[0]]
            out.append(order[: int(np.searchsorted(held, share * held[-1] - 1e-9)) + 1])
        return out


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, each row by the same order of sums, so equal rows have equal values."""
    v, q = vectors.astype(float), query.astype(float)
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))


def nearest(forest: Forest, ids: np.ndarray, units: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query: the k nearest of its candidates, without those of its own id: (rows, scores)."""
    whole = units @ queries.T if wanted * 8 > len(units) else None  # many candidates: one product for all
    for q, found in enumerate(forest.candidates(queries, wanted)):
        found = found[ids[found] != query_ids[q]]
        if len(found) > k:
            near = whole[found, q] if whole is not None else units[found] @ queries[q]
            bound = np.partition(near, -k)[-k]
            found = found[near >= bound - 1e-6 * max(1.0, abs(bound))]  # a little more, as the last is exact below
        score = cosines(forest.vectors[found], queries[q])
        order = np.lexsort((ids[found], -score))[:k]
        yield found[order], score[order]


def _truth(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Some rows, and the k nearest of each among all."""
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    some = np.linspace(0, len(vectors) - 1, min(SAMPLE_QUERIES, len(vectors))).astype(int)
    near = units[some] @ units.T
    near[np.arange(len(some)), some] = -np.inf
    return some, np.argpartition(-near, k - 1, 1)[:, :k]


_SHARES = np.geomspace(1 / 1024, 1, 31).tolist()


def _least_share(recall_at, recall: float) -> float:
    """The least of some shares at which the recall is enough; the last is everything."""
    low, high = 0, len(_SHARES) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if recall_at(_SHARES[middle]) >= recall else (middle + 1, high)
    return _SHARES[low]


def fit_share(vectors: np.ndarray, k: int, recall: float = 0.98, trees: int = TREES) -> float:
    """The least share of a forest's rows that candidates must be for the recall wanted, on a sample of rows."""
    if len(vectors) <= 4 * k:
        return 1.0
    forest = Forest(vectors, trees)
    some, best = _truth(vectors, k)
    return _least_share(lambda share: np.mean([np.isin(b, f).mean() for b, f in zip(best, forest.candidates(vectors[some], int(share * len(vectors)) + k + 1), strict=True)]), recall)


def fit_routes(vectors: np.ndarray, k: int, cells: int, recall: float = 0.98) -> tuple[Routes, float]:
    """Cells, and the least share of all rows that the cells which a query asks must hold for the recall wanted."""
    routes = Routes(vectors, cells)
    if len(vectors) <= 4 * k or len(routes.starts) == 1:
        return routes, 1.0
    some, best = _truth(vectors, k)
    own = routes.cell(vectors)
    return routes, _least_share(lambda share: np.mean([np.isin(own[b], c).mean() for b, c in zip(best, routes.asked(vectors[some], share), strict=True)]), recall)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _route(routes: Routes | None, width: int, parts: list[int], others: int, share: float):
    """(vec_id, vec, dim, asks) to (dim, cell, part, kind, vec_id, vec): a row of its cell, and, if it asks, a query of each part of the cells it asks."""

    def route(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "cell", "part", "kind", "vec_id", "vec"]
        for batch in incoming:
            dims = batch.column(2).to_numpy()
            ids = batch.column(0)
            draw = (ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(33)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            for main in (True, False):
                at = np.flatnonzero((dims == width) == main)
                if not len(at):
                    continue
                if main and routes is not None:
                    vectors = _matrix(batch.column(1).take(pa.array(at)), width)
                    cell, counts = routes.cell(vectors), np.array(parts)
                else:
                    vectors, cell, counts = None, np.zeros(len(at), np.int64), np.array([others])
                rows, cells, part, kind = [at], [cell], [(draw[at] % counts[cell].astype(_U)).astype(np.int64)], [np.zeros(len(at), np.int64)]
                some = np.flatnonzero(asks[at])
                asked = routes.asked(vectors[some], share) if vectors is not None and len(some) else [np.zeros(1, np.int64)] * len(some)
                for k, own in zip(some.tolist(), asked, strict=True):
                    each = counts[own]
                    rows.append(np.full(each.sum(), at[k]))
                    cells.append(np.repeat(own, each))
                    part.append(np.concatenate([np.arange(n) for n in each]))
                    kind.append(np.ones(each.sum(), np.int64))
                row = np.concatenate(rows)
                for low in range(0, len(row), 8192):
                    cut = slice(low, low + 8192)
                    taken = pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays([batch.column(2).take(taken), *(pa.array(np.concatenate(x)[cut].astype(np.int32)) for x in (cells, part, kind)), ids.take(taken), batch.column(1).take(taken)], names)

    return route


def _search(k: int, share: float):
    """Rows sorted by (dim, cell, part, kind): vectors of a part of a cell, then the queries that ask it."""

    def search(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, ready = None, [], [], None
        for batch in incoming:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]))
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if begin == end:
                    continue
                *where, kind = keys[:, begin].tolist()
                if where != at:
                    at, ids, parts, ready = where, [], [], None
                some = batch.slice(begin, end - begin)
                vectors = _matrix(some.column(5), at[0])
                if kind == 0:
                    ids.append(some.column(4).fill_null(-(2**63)).to_numpy(zero_copy_only=False))
                    parts.append(vectors)
                elif ids:
                    if ready is None:
                        held, own = np.concatenate(parts), np.concatenate(ids)
                        ready = Forest(held), own, held / np.sqrt((held * held).sum(1))[:, None]
                        parts = []
                    forest, own, units = ready
                    wanted = int(share * len(own)) + k + 1
                    all_asked = some.column(4).to_numpy()
                    for low in range(0, len(all_asked), 256):
                        asked, block = all_asked[low : low + 256], vectors[low : low + 256]
                        q_ids, v_ids, scores = [], [], []
                        for q, (found, score) in zip(asked.tolist(), nearest(forest, own, units, block, asked, k, wanted), strict=True):
                            q_ids.append(np.full(len(found), q, np.int64))
                            v_ids.append(own[found])
                            scores.append(score)
                        v = np.concatenate(v_ids)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_ids)), pa.array(v, mask=v == -(2**63)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return search


def _parts(rows: DataFrame, routes: Routes, parts: list[int], width: int) -> list[np.ndarray]:
    """Vectors of a few whole parts, of cells of the greatest and of middling weight: about PER_CELL rows each."""
    by_weight = np.argsort(routes.weight, kind="stable")
    some = sorted({int(by_weight[-1]), int(by_weight[len(by_weight) // 2])})
    schema = rows.select("dim", F.lit(0).alias("cell"), F.lit(0).alias("part"), F.lit(0).alias("kind"), "vec_id", "vec").schema
    dealt = rows.filter(F.col("dim") == width).select("vec_id", "vec", "dim", F.lit(False).alias("asks")).mapInArrow(_route(routes, width, parts, 1, 1.0), schema)
    picked = dealt.filter(F.col("cell").isin(some) & (F.col("part") == 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(len(some) * 2 * PER_CELL).select("cell", "vec").toArrow()
    cell = picked["cell"].to_numpy()
    return [_matrix(picked["vec"].combine_chunks().take(pa.array(np.flatnonzero(cell == c))), width) for c in some if (cell == c).any()]


def _sample(rows: DataFrame) -> np.ndarray:
    """Vectors of a bounded sample, of the length that most of it has."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", F.transform("vec", lambda x: x.cast("double")).alias("vec")).toArrow()
    dims = drawn["dim"].to_numpy()
    if not len(dims):
        return np.empty((0, 1))
    values, counts = np.unique(dims, return_counts=True)
    width = int(values[counts.argmax()])
    return _matrix(drawn["vec"].combine_chunks().take(pa.array(np.flatnonzero(dims == width))), width)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96) -> DataFrame:
    """The k nearest rows found for each query (rows for which is_query holds), by cosine: query_id, rank, vec_id, score.

    Every row belongs to one cell, a variable-length prefix of its string of signs (Routes), which is fitted on at most SAMPLE_ROWS rows.
    A query goes to the cells with the longest prefix in common and, ascending, to others by how near it is to them,
    until they hold a share of the rows. A cell of more than PER_CELL rows, as of many equal vectors, is dealt to parts. Each part has a forest of
    TREES trees, which the query descends and ascends; the best of all parts are the result. Both shares, of cells and of a forest's
    rows, are fitted on the sample for the recall wanted, unless share gives the forest's (then all cells are asked): so
    a query meets few cells where vectors have neighbours, and most where they are scattered evenly.

    Scores are the cosines of the vectors as given, in double precision. Ties go to the smaller id. Ids are integers. Rows of a query's
    own id aren't its neighbours; of other repeated rows each counts. Vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors meet only those of their own length. Null ids can be found (last of equals) but don't ask. An empty
    table gives no rows. Other columns are left out.
    """
    vec = F.col(vector_col)
    sound = F.size(vec) > 0
    sound = sound & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    checked = vectors.filter(F.coalesce(sound, F.lit(False)))
    id_ = F.col(id_col).cast("long")
    rows = checked.select(id_.alias("vec_id"), vec.alias("vec"), F.size(vec).alias("dim"), (F.coalesce(is_query, F.lit(False)) & id_.isNotNull()).alias("asks"))
    sample = _sample(rows)
    width = sample.shape[1]
    count, main = rows.agg(F.count("*"), F.count(F.when(F.col("dim") == width, 1))).first()
    routes, reach = fit_routes(sample, k, bucket_count(main, PER_CELL), recall**0.5) if len(sample) and share is None else (None, 1.0)
    if reach == 1.0:  # all cells would be asked, so there is no use in them
        routes = None
    parts = [max(1, round(w * main / PER_CELL)) for w in routes.weight.tolist()] if routes is not None else []
    others = bucket_count(count if routes is None else max(1, count - main), PER_CELL)
    if share is None:
        # a cell's rows are closer to each other than the sample's: whole parts of some cells show how many candidates they need
        share = fit_share(sample, k, recall) if routes is None else max(fit_share(p, k, recall**0.5) for p in _parts(rows, routes, parts, width))
    kind = vectors.schema[vector_col].dataType.simpleString()
    dealt = rows.select("vec_id", "vec", "dim", "asks").mapInArrow(_route(routes, width, parts, others, reach), f"dim int, cell int, part int, kind int, vec_id long, vec {kind}")
    places = sum(parts) + others
    together = dealt.repartition(min(places, 4 * partitions(vectors)), "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "kind")
    found = together.mapInArrow(_search(k, share), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
