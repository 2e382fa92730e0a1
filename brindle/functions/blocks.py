"""Rows of two tables that meet by key, in blocks: one side is held, the other passes by."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the vectors that a task holds, and rows that pass by it.
HELD_BYTES, PASSING_ROWS = 32 << 20, 16_384
#: Cells of the scores, and products, that are made together where rows are sparse.
SPARSE_STEP = 1 << 20


class Meeting(Protocol):
    """What is done in one block."""

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def end(self) -> Iterator[pa.RecordBatch]: ...


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def table(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _passes(n_keys: int, work: Callable[[tuple, pa.Table], Meeting]):
    """Batches of rows sorted by place, held rows first, to what the meetings of their places give."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, meeting = None, [], None
        for batch in incoming:
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(n_keys + 3)])
            edges = np.concatenate(([0], np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1, [batch.num_rows]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if low == high:
                    continue
                *where, kind = places[:, low].tolist()
                if where != at:
                    if meeting is not None:
                        yield from meeting.end()
                    at, held, meeting = where, [], None
                rows = pa.RecordBatch.from_struct_array(batch.column(n_keys + 3 + kind).slice(low, high - low))
                if kind == 0:
                    held.append(rows)
                elif held:
                    if meeting is None:
                        meeting = work(tuple(where[:n_keys]), pa.Table.from_batches(held))
                    yield from meeting.take(rows)
        if meeting is not None:
            yield from meeting.end()

    return run


def meet(held: DataFrame, passing: DataFrame, keys: list[str], held_by: str, passing_by: str, work: Callable[[tuple, pa.Table], Meeting], schema: str, most_held: int, most_passing: int = 0) -> DataFrame:
    """Let the rows of passing with a key go by the rows of held with the same one: what work gives for each block.

    keys are columns of whole numbers. A key's held rows are dealt to chunks of about most_held by hash of held_by, its passing rows to shares of about most_passing by
    hash of passing_by, so a key may have most rows of either table; each chunk meets each share once, in one task that holds the chunk. Rows that are alike in
    held_by or passing_by stay together. Keys that only one table has give nothing. Only rows of the two tables are moved, never their pairs.
    """
    most_passing = most_passing or PASSING_ROWS
    sizes = lambda rows, of, most, name: rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / most).cast("int").alias(name))
    places = sizes(held, held_by, most_held, "chunks").join(sizes(passing, passing_by, most_passing, "shares"), keys)
    both = {"h": (held, held_by), "p": (passing, passing_by)}
    sides = []
    for kind, (side, (rows, by)) in enumerate(both.items()):
        structs = [F.struct(*(F.col(c) for c in own.columns if c not in keys)).alias(name) if name == side else F.lit(None).cast(_struct(own, keys)).alias(name) for name, (own, _) in both.items()]
        known = rows.select(*keys, *structs, F.xxhash64(by).alias("_hash")).join(places, keys)
        own_at = lambda n: F.pmod("_hash", F.col(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        known = known.withColumn("_chunk", own_at("chunks") if kind == 0 else every("chunks")).withColumn("_share", own_at("shares") if kind == 1 else every("shares"))
        sides.append(known.select(*keys, "_chunk", "_share", F.lit(kind).alias("_kind"), "h", "p"))
    order = [*keys, "_chunk", "_share"]
    dealt = sides[0].unionByName(sides[1]).repartition(*order).sortWithinPartitions(*order, "_kind")
    return dealt.mapInArrow(_passes(len(keys), work), schema)


def _struct(rows: DataFrame, keys: list[str]) -> str:
    return "struct<" + ",".join(f"`{name}`:{kind}" for name, kind in rows.dtypes if name not in keys) + ">"


def held_rows(width: int, most_bytes: int = 0) -> int:
    """How many vectors of a width a task holds."""
    return max(1, (most_bytes or HELD_BYTES) // (8 * max(1, width)))


def width_of(rows: DataFrame, vector: str) -> int:
    first = rows.select(F.size(vector)).first()
    return first[0] if first else 1


class _Greatest:
    """Sum and greatest of each held row's products with the passing ones."""

    def __init__(self, key: tuple, held: pa.Table):
        self.key, self.ids, self.z = key, held["id"].combine_chunks(), matrix(held["z"])
        self.total, self.most, self.n = np.zeros(len(self.z)), np.full(len(self.z), -np.inf), 0

    def take(self, rows):
        x = matrix(rows.column("vec"))
        self.total += self.z @ x.sum(0)
        self.most = np.maximum(self.most, (x @ self.z.T).max(0))
        self.n += len(x)
        return iter(())

    def end(self):
        yield table({**{f"k{i}": np.full(len(self.z), k) for i, k in enumerate(self.key)}, "id": self.ids, "total": self.total, "most": self.most, "n": np.full(len(self.z), self.n)})


def affinity(x: DataFrame, z: DataFrame, keys: list[str], label: str = "label_id", vector: str = "vec", mention: str = "mention_id") -> DataFrame:
    """(keys, label, mean, total, most) of the inner products of each row of z with all rows of x that have its key, of which no pair is written.

    x: keys, mention, vector; z: keys, label (whole numbers), z. Sums are products with sums of vectors.
    """
    named = [F.col(k).cast("long").alias(k) for k in keys]
    held = z.select(*named, F.col(label).cast("long").alias("id"), "z")
    passing = x.select(*named, F.xxhash64(mention).alias("by"), F.col(vector).alias("vec"))
    schema = ", ".join(f"k{i} long" for i in range(len(keys))) + ", id long, total double, most double, n long"
    parts = meet(held, passing, keys, "id", "by", _Greatest, schema, held_rows(width_of(z, "z")))
    names = [f"k{i}" for i in range(len(keys))]
    got = parts.groupBy(*names, "id").agg(F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("n").alias("n"))
    return got.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.col("id").alias(label), (F.col("total") / F.col("n")).alias("mean"), "total", "most")


def _best(k: int, digits: int, cosine: bool):
    class Best:
        """The k held rows of greatest product or cosine with each passing one."""

        def __init__(self, key: tuple, held: pa.Table):
            order = np.argsort(held["id"].to_numpy(), kind="stable")
            self.ids, self.z = held["id"].to_numpy()[order], matrix(held["z"])[order]
            self.sizes = np.sqrt((self.z * self.z).sum(1)) + 1e-12

        def take(self, rows):
            x = matrix(rows.column("vec"))
            score = x @ self.z.T
            if cosine:
                score = score / ((np.sqrt((x * x).sum(1)) + 1e-12)[:, None] * self.sizes)
            best = np.argsort(-np.round(score, digits), axis=1, kind="stable")[:, :k]
            n = best.shape[1]
            yield table({"query": rows.column("query").take(pa.array(np.repeat(np.arange(len(x)), n))), "id": self.ids[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()})

        def end(self):
            return iter(())

    return Best


def top_products(x: DataFrame, z: DataFrame, query: str, label: str, k: int, digits: int = 9, cosine: bool = False, vector: str = "vec") -> DataFrame:
    """(query, label, score, rank): the k rows of z (label, z) with the greatest inner product or cosine for each row of x (query, vector).

    Scores are compared at so many digits, ties go to the lower label. Each chunk of z gives k rows for a query; of these the best stay.
    """
    kind = dict(x.dtypes)[query]
    held = z.select(F.lit(0).cast("long").alias("key"), F.col(label).cast("long").alias("id"), "z")
    passing = x.select(F.lit(0).cast("long").alias("key"), F.col(query).alias("query"), F.col(vector).alias("vec"))
    found = meet(held, passing, ["key"], "id", "query", _best(k, digits, cosine), f"query {kind}, id long, score double", held_rows(width_of(z, "z")))
    order = Window.partitionBy("query").orderBy(F.round("score", digits).desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query), F.col("id").cast(dict(z.dtypes)[label]).alias(label), "score", "rank")



def _best_sparse(k: int, digits: int):
    class BestSparse:
        """The k held rows of greatest product above 0 with each passing one, both being lists of features and values."""

        def __init__(self, key: tuple, held: pa.Table):
            self.ids = held["id"].combine_chunks()
            order = np.array(pc.sort_indices(self.ids))
            self.ids, held = self.ids.take(pa.array(order)), held.take(pa.array(order))
            lists = held["features"].combine_chunks()
            self.n = len(self.ids)
            label = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
            coded = lists.flatten().dictionary_encode()
            self.known, term = coded.dictionary, coded.indices.to_numpy()
            by = np.argsort(term, kind="stable")
            self.label, self.value = label[by], held["values"].combine_chunks().flatten().to_numpy()[by]
            self.first = np.searchsorted(term[by], np.arange(len(self.known) + 1))

        def take(self, rows):
            step = max(1, SPARSE_STEP // max(1, self.n))
            for low in range(0, rows.num_rows, step):
                some = rows.slice(low, step)
                lists = some.column("features")
                n = some.num_rows
                term = pc.index_in(lists.flatten(), value_set=self.known)
                found = np.flatnonzero(np.asarray(term.is_valid()))
                row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))[found]
                term, value = term.take(pa.array(found)).to_numpy(), some.column("values").flatten().to_numpy()[found]
                score = np.zeros(n * self.n)
                sizes = self.first[term + 1] - self.first[term]
                ends = np.cumsum(sizes)
                # as many entries as give about so many products are worked on together
                part = (ends - sizes) // SPARSE_STEP
                for a, b in itertools.pairwise([*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]):
                    own = sizes[a:b]
                    at = np.arange(own.sum()) + np.repeat(self.first[term[a:b]] - np.cumsum(own) + own, own)
                    np.add.at(score, np.repeat(row[a:b], own) * self.n + self.label[at], np.repeat(value[a:b], own) * self.value[at])
                score = score.reshape(n, self.n)
                compared = np.round(score, digits)
                best = np.argsort(-compared, axis=1, kind="stable")[:, :k]
                good = np.take_along_axis(compared, best, 1) > 0
                who = np.repeat(np.arange(n), good.sum(1))
                yield table({"query": some.column("query").take(pa.array(who)), "id": self.ids.take(pa.array(best[good])), "score": np.take_along_axis(score, best, 1)[good]})

        def end(self):
            return iter(())

    return BestSparse


def top_sparse_products(x: DataFrame, z: DataFrame, query: str, label: str, k: int, digits: int = 6) -> DataFrame:
    """(query, label, score): the k rows of z (label, feature, value) with the greatest inner product above 0 for each row of x (query, feature, value), from each chunk of z.

    Scores are compared at so many digits, ties go to the lower label. Rows pass by as lists of their features, once for each chunk, so neither a frequent feature
    nor the table of all pairs that share one is held or moved.
    """
    lists = lambda rows, key, name: rows.groupBy(key).agg(F.collect_list(F.struct("feature", "value")).alias("_l")).select(F.lit(0).cast("long").alias("key"), F.col(key).alias(name), F.col("_l.feature").alias("features"), F.col("_l.value").alias("values"))
    held, passing = lists(z, label, "id"), lists(x, query, "query")
    width = z.groupBy(label).count().agg(F.avg("count")).first()[0] or 1.0
    schema = f"query {dict(x.dtypes)[query]}, id {dict(z.dtypes)[label]}, score double"
    found = meet(held, passing, ["key"], "id", "query", _best_sparse(k, digits), schema, held_rows(4 * int(width)))
    return found.select(F.col("query").alias(query), F.col("id").alias(label), "score")
