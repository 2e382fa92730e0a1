"""Similarity join of documents by word shingles, with Bayesian pruning of candidates."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, discard, give_back, written
from brindle.llm.words import Words, batches, minhashes, mix, shingles, sliced

#: MinHash values: each band of ROWS is a key under which documents meet. At similarity 0.8, a pair meets
#: under none of the bands with probability (1 - 0.8 ** ROWS) ** BANDS, 7 in a million.
BANDS, ROWS = 30, 5
#: Values compared between two looks at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 15, 1e-6
#: Texts of a tile, and words of all of them; a group of more is compared tile by tile.
TILE, TILE_WORDS = 512, 4_000_000
#: Signatures of a tile. Nodes of a bucket of more meet by longer keys instead, drawn from all MinHash values: at similarity 0.8, a pair then meets under none
#: of these with probability (1 - 0.8 ** LONG_ROWS) ** LONG_KEYS, one in a million, or some ten times that for a signature that says less. What is still larger is pruned tile by tile.
BUCKET_TILE, LONG_KEYS, LONG_ROWS = 4096, 128, 10


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): (node, component), for the nodes that have an edge.

    Each round draws lots: every node goes to the one with the least hash of the round among itself and its neighbours, and
    the edges are drawn anew between these. A fair share of the nodes goes in each round, whatever the
    component's shape, so rounds grow as the logarithm of its nodes.

    Edges and labels of a round are removed after the next.
    """
    spark, turn, found, place = edges.sparkSession, 0, None, None
    current, at = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        turn += 1
        both = current.select("a", "b").union(current.select("b", "a"))
        lot = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("lot"), F.col(c).alias("node"))  # noqa: B023, E731
        label = both.groupBy("a").agg(F.min(lot("b")).alias("least"))
        label, label_at = written(label.select(F.col("a").alias("at"), F.least("least", lot("a"))["node"].alias("label")))
        if found is None:
            found, place = written(label.select(F.col("at").alias("node"), F.col("label").alias("component")))
        else:
            newer = written(found.join(label, found["component"] == label["at"], "left").select("node", F.coalesce("label", "component").alias("component")))
            discard(spark, place)
            found, place = newer
        moved = current.join(label.select(F.col("at").alias("a"), F.col("label").alias("la")), "a")
        moved = moved.join(label.select(F.col("at").alias("b"), F.col("label").alias("lb")), "b").filter("la != lb")
        following, following_at = written(moved.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())
        discard(spark, at)
        discard(spark, label_at)
        current, at = following, following_at
        if current.isEmpty():
            discard(spark, at)
            return found


@functools.cache
def least_matches(threshold: float, n: int, tolerance: float = TOLERANCE) -> int:
    """Fewest of n matching MinHash values with which the similarity may still reach threshold.

    With a uniform prior, the similarity after m matches of n is Beta(m + 1, n - m + 1); its upper tail is
    a binomial sum.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def pruned_pairs(values: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of values whose posterior chance to reach threshold never falls below the tolerance.

    right None: all pairs of left; else pairs of one of each.
    """
    others = left if right is None else right
    found_i, found_j = [], []
    for begin in range(0, len(left), 128):
        rows = left[begin : begin + 128]
        counts = np.zeros((len(rows), len(others)), np.int16)
        for k in range(STEP):
            counts += values[rows, k][:, None] == values[others, k][None, :]
        i, j = np.nonzero(counts >= least_matches(threshold, STEP))
        if right is None:
            keep = i + begin < j
            i, j = i[keep], j[keep]
        matches, i, j = counts[i, j].astype(np.int32), rows[i], others[j]
        for at in range(STEP, values.shape[1], STEP):
            if not len(i):
                break
            matches = matches + (values[i, at : at + STEP] == values[j, at : at + STEP]).sum(1)
            keep = matches >= least_matches(threshold, min(at + STEP, values.shape[1]))
            matches, i, j = matches[keep], i[keep], j[keep]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate([*found_i, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*found_j, np.empty(0, np.int64)]).astype(np.int64)


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements sets[i] and sets[j] (sorted, without repeats) share, exactly, for each pair."""
    if not len(i):
        return np.empty(0, np.int64)
    used = np.unique(np.concatenate((i, j)))
    sizes = np.array([len(sets[k]) for k in used])
    everything = np.concatenate([sets[k] for k in used])
    vocabulary, ids, seen = np.unique(everything, return_inverse=True, return_counts=True)
    pair_cost = len(i) * (20e-6 + 2e-8 * sizes.mean())
    shared = np.flatnonzero(seen > 1)
    if pair_cost <= 1e-10 * len(used) ** 2 * len(shared):
        out = np.empty(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            spot = np.searchsorted(y, x)
            spot[spot == len(y)] = 0
            out[k] = np.count_nonzero(y[spot] == x)
        return out
    # many pairs of few texts: products of 0/1 rows over slices of the vocabulary; sums below 2**24 are exact
    number = np.full(len(vocabulary), -1, np.int64)
    number[shared] = np.arange(len(shared))
    column, row = number[ids], np.repeat(np.arange(len(used)), sizes)
    keep = column >= 0
    column, row = column[keep], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    counts = np.zeros((len(used), len(used)), np.float32)
    for begin in range(0, len(shared), 4096):
        low, high = np.searchsorted(column, (begin, begin + 4096))
        part = np.zeros((len(used), 4096), np.float32)
        part[row[low:high], column[low:high] - begin] = 1
        counts += part @ part.T
    place = np.searchsorted(used, np.stack((i, j)))
    return counts[place[0], place[1]].astype(np.int64)


def linked(values: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose Jaccard similarity is at least threshold: pruned by MinHash values, then counted exactly."""
    i, j = pruned_pairs(values, left, right, threshold)
    common = common_counts(sets, i, j)
    size = np.array([len(s) for s in sets], np.int64)
    keep = common / np.maximum(1, size[i] + size[j] - common) >= threshold
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n can reach over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sign(width: int, seed: int):
    """(id, text_hash, text) to (id, text_hash, node, proof, size, bands, signature); the last two only once for each node and task.

    A signature holds 16 bits of each MinHash value.
    """

    def sign(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        salts = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in sliced(incoming):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for low, high in batches(texts):
                words = Words(texts[low:high])
                nodes, proofs, fresh = [], [], []
                for k in range(high - low):
                    own = xxhash.xxh3_128_intdigest(words.hashes[words.first[k] : words.first[k + 1]].tobytes(), seed)
                    node, proof = own & (2**64 - 1), own >> 64
                    nodes.append(node - 2**64 if node >> 63 else node)
                    proofs.append(proof - 2**64 if proof >> 63 else proof)
                    fresh.append(node not in seen)
                    seen.add(node)
                hashes, begins = shingles(words, width)
                some = np.flatnonzero(np.array(fresh) & (np.diff(begins) > 0))
                bands: list = [None] * (high - low)
                signatures: list = [None] * (high - low)
                if len(some):
                    lengths = np.diff(begins)[some]
                    starts = np.concatenate(([0], np.cumsum(lengths)))
                    picked = np.repeat(begins[some] - starts[:-1], lengths) + np.arange(starts[-1])
                    flat = minhashes(hashes[picked], starts, BANDS * ROWS)
                    short, values = flat.astype(np.uint16), flat.reshape(len(some), BANDS, ROWS).astype(np.uint64)
                    key = np.broadcast_to(salts, (len(some), BANDS)).copy()
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + values[:, :, r])
                    for k, own_key, own_values in zip(some.tolist(), key.astype(np.int64), short, strict=True):
                        bands[k], signatures[k] = own_key, own_values.tobytes()
                part = batch.slice(low, high - low)
                columns = [pa.array(nodes, pa.int64()), pa.array(proofs, pa.int64()), pa.array(np.diff(begins)), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "text_hash", "node", "proof", "size", "bands", "signature"])
        give_back()

    return sign


def _texts_of_nodes(seed: int):
    """text to (node, text), once for each node and task."""

    def texts_of(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(incoming):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for low, high in batches(texts):
                words = Words(texts[low:high])
                nodes, own = [], []
                for k in range(high - low):
                    node = xxhash.xxh3_128_intdigest(words.hashes[words.first[k] : words.first[k + 1]].tobytes(), seed) & (2**64 - 1)
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node - 2**64 if node >> 63 else node)
                        own.append(texts[low + k])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(own, pa.string())], ["node", "text"])
        give_back()

    return texts_of


def _long_keys(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) to (node, keys): hashes of LONG_KEYS draws of LONG_ROWS values each, the same draws for all."""
    rng = np.random.default_rng(41)
    drawn = np.array([rng.choice(BANDS * ROWS, LONG_ROWS, replace=False) for _ in range(LONG_KEYS)])
    salts = (np.arange(LONG_KEYS, dtype=np.uint64) + np.uint64(BANDS + 1)) * np.uint64(0x9E3779B97F4A7C15)
    for batch in incoming:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1).astype(np.uint64)
            key = np.broadcast_to(salts, (part.num_rows, LONG_KEYS)).copy()
            for r in range(LONG_ROWS):
                key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + values[:, drawn[:, r]])
            flat = pa.array(key.astype(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * LONG_KEYS), flat)], ["node", "keys"])


def _met(keyed: DataFrame) -> DataFrame:
    """(node, key, tiles) of rows (node, key): nodes in buckets with others; of buckets with the same nodes one is kept."""
    # a bucket's nodes are told by their least, greatest, number and sums of halves; a node of several tasks comes as often in each of its buckets
    halves = (F.col("node").bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned("node", 31).bitwiseAND(0x7FFFFFFF))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"), *(F.sum(h).alias(f"sum{k}") for k, h in enumerate(halves))).filter("least != most")
    buckets = checkpointed(buckets.groupBy("least", "most", "n", "sum0", "sum1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BUCKET_TILE).cast("int").alias("tiles")))
    return checkpointed(keyed.join(buckets, "key").select("node", "key", "tiles"))


def _likely_pairs(values: np.ndarray, begins: np.ndarray, sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within groups that pruning leaves. sides: pairs are of a false and a true one only, in groups that have both.

    Groups of two, which most are, are taken all at once.
    """
    sizes = np.diff(begins)
    two = begins[:-1][sizes == 2]
    i, j = two, two + 1
    if sides is not None and len(two):
        mixed = begins[:-1][sizes == 2]
        ok = np.array([not sides[mixed[k] : mixed[k] + 2].any() or sides[mixed[k]] != sides[mixed[k] + 1] for k in range(len(mixed))], bool)
        i, j = i[ok], j[ok]
    matches = np.zeros(len(i), np.int32)
    for at in range(0, values.shape[1], STEP):
        if not len(i):
            break
        matches = matches + (values[i, at : at + STEP] == values[j, at : at + STEP]).sum(1)
        keep = matches >= least_matches(threshold, min(at + STEP, values.shape[1]))
        matches, i, j = matches[keep], i[keep], j[keep]
    found_i, found_j = [i], [j]
    for begin, end in zip(begins[:-1][sizes > 2].tolist(), begins[1:][sizes > 2].tolist(), strict=True):
        rows = np.arange(begin, end)
        side = sides[begin:end] if sides is not None else np.zeros(0, bool)
        left, right = (rows[~side], rows[side]) if side.any() else (rows, None)
        a, b = pruned_pairs(values, left, right, threshold)
        found_i.append(a)
        found_j.append(b)
    return np.concatenate(found_i), np.concatenate(found_j)


def _prune(threshold: float):
    """Rows sorted by (key, a, b): tile, node, signature. Gives each node that may be linked in its bucket another that it can reach there."""

    def prune(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: pa.Table) -> pa.RecordBatch:
            key, a, b, tile, node = (rows[c].to_numpy() for c in range(5))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            once = new.copy()  # a node's signature may come from several tasks
            once[1:] |= node[1:] != node[:-1]
            kept = np.flatnonzero(once)
            begins = np.append(np.flatnonzero(new[kept]), len(kept))
            values = np.frombuffer(b"".join(rows["signature"].take(pa.array(kept)).to_pylist()), np.uint16).reshape(len(kept), -1)
            sides = (tile != a)[kept]
            i, j = _likely_pairs(values, begins, sides if sides.any() else None, threshold)
            roots = _roots(len(kept), i, j)
            some = np.flatnonzero(roots != np.arange(len(kept)))
            own = node[kept]
            return pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(own[roots[some]])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in incoming:
            held.append(batch)
            key, a, b = (batch.column(c).to_numpy() for c in range(3))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            first = [held[0].column(c)[0].as_py() for c in range(3)]
            if not len(edges) and [key[0], a[0], b[0]] == first:
                continue  # one bucket so far
            cut = int(edges[-1]) if len(edges) else 0
            done = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            if done.num_rows:
                yield answer(done)
            held = [batch.slice(cut)]
        if held and sum(x.num_rows for x in held):
            yield answer(pa.Table.from_batches(held))
        give_back()

    return prune


_LINKS = "node long, root long, documents long, texts long"


def _verify(width: int, threshold: float):
    """Rows sorted by (component, a, b): tile, node, copies, text. Gives each linked node a root it can reach in
    its tiles, and how many documents and different texts it is linked to there."""

    def groups(incoming: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Rows of whole (component, a, b), several small ones together."""
        held: list[tuple] = []
        chars = 0
        for batch in incoming:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (len(held) >= 256 or chars >= 1 << 21) and row[:3] != held[-1][:3]:
                    yield held
                    held, chars = [], 0
                held.append(row)
                chars += len(row[6])
        if held:
            yield held

    def verify(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(incoming):
            unique = list({(*r[:3], r[4]): r for r in held}.values())  # a node's text may come from several tasks
            texts = [r[6] for r in unique]
            values, sets = [], []
            for low, high in batches(texts):
                hashes, begins = shingles(Words(texts[low:high]), width)
                values.append(minhashes(hashes, begins, BANDS * ROWS))
                sets += [np.unique(hashes[begins[k] : begins[k + 1]]) for k in range(high - low)]
            matrix = np.concatenate(values)
            copies = np.array([r[5] for r in unique], np.int64)
            node = np.array([r[4] for r in unique], np.int64)
            out: list[list[np.ndarray]] = [[], [], [], []]
            begin = 0
            while begin < len(unique):
                end = begin
                while end < len(unique) and unique[end][:3] == unique[begin][:3]:
                    end += 1
                _, a, b = unique[begin][:3]
                rows = np.arange(begin, end)
                if a == b:
                    i, j = linked(matrix, sets, rows, None, threshold)
                else:
                    side = np.array([unique[k][3] for k in range(begin, end)])
                    i, j = linked(matrix, sets, rows[side == a], rows[side == b], threshold)
                if len(i):
                    i, j = i - begin, j - begin
                    n = end - begin
                    roots = _roots(n, i, j)
                    documents = np.bincount(i, copies[j + begin], n) + np.bincount(j, copies[i + begin], n)
                    others = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
                    some = np.flatnonzero(others)
                    for column, x in zip(out, (node[some + begin], node[roots[some] + begin], documents[some].astype(np.int64), others[some]), strict=True):
                        column.append(x)
                begin = end
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["node", "root", "documents", "texts"])
        give_back()

    return verify


def similar_documents(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that links of Jaccard similarity >= threshold over shingles of width words connect.

    Returns id, text_hash (xxhash64 of the text), class_node (a number of its class), class_id (the least id of its class), n_links (other documents
    linked to it, copies among them), n_texts (different texts linked to it) and copies (documents with the
    same words in the same order, itself among them).

    1. Documents with the same words are one node; the rest works on nodes, so copies are never paired.
    2. Nodes meet in the buckets of BANDS bands of MinHash values; of buckets with the same nodes one is looked at. Nodes of a bucket of more than BUCKET_TILE
       signatures, as pages of one template fill, meet by longer keys instead, which only nodes share that are alike elsewhere too. There signatures, not
       texts, are compared STEP values at a time, a pair being dropped when the posterior probability of reaching the threshold is
       under TOLERANCE. Each node that may be linked is tied to one other, so there are fewer ties than nodes, and texts that
       only resemble each other, as pages of a template do, aren't tied at all.
    3. Components of these ties hold all pairs that may be linked. Their texts are compared in one place or, beyond TILE texts or
       TILE_WORDS words, tile by tile: pruned as before, then counted exactly over the shingles' 64-bit hashes. Only counts and a root for each node leave the task.
    4. Components of these roots are the classes.

    A pair is lost only if it meets under no band, or only in crowded buckets and by no longer key, or is pruned; at the threshold the first has probability
    (1 - threshold ** ROWS) ** BANDS, and all fall fast above it. Texts of fewer than width words have one shingle of all. Texts
    without words, null ones among them, are copies of each other. Null ids: the class has the least id that isn't null.
    Repeated rows are copies. Ids are numbers or strings. A text may be of any length below 2 GB; one is held whole by its task, with
    about ten times its size for numbers. An empty table gives no rows. Other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        signed = checkpointed(plain.mapInArrow(_sign(width, seed), f"id {kind}, text_hash long, node long, proof long, size long, bands array<long>, signature binary"))
        held = (F.count("*").alias("copies"), F.min("id").alias("id"), F.min("proof").alias("p"), F.max("proof").alias("q"), F.max("size").alias("size"))
        nodes = checkpointed(signed.groupBy("node").agg(*held))
        if nodes.filter("p != q").isEmpty():
            break
        seed += 1  # two word sequences share 64 bits of their 128-bit digest: draw anew
    keyed = signed.filter("bands is not null").select("node", F.explode("bands").alias("key"))
    met = _met(keyed)
    all_signatures = signed.filter("signature is not null").select("node", "signature")
    crowded = met.filter("tiles > 1").select("node")
    if not crowded.isEmpty():
        once = all_signatures.join(crowded.distinct(), "node", "left_semi").groupBy("node").agg(F.first("signature").alias("signature"))
        longer = once.mapInArrow(_long_keys, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
        met = met.filter("tiles = 1").unionByName(_met(longer))
    signatures = all_signatures.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("signature").alias("signature"))
    dealt = met.distinct().join(signatures, "node").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "node", "signature")
    in_buckets = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node")
    member = components(in_buckets.mapInArrow(_prune(threshold), "a long, b long"))
    sizes = member.join(nodes.select("node", "size"), "node").groupBy("component").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_WORDS)).cast("int").alias("tiles"))
    tiled = member.join(sizes, "component").join(nodes.select("node", "copies"), "node")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    texts = docs.select(text_col).mapInArrow(_texts_of_nodes(seed), "node long, text string")
    # a tile meets itself and each other tile of its component once
    spread = texts.join(tiled, "node").select("component", "tile", "node", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    spread = spread.select("component", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "node", "copies", "text")
    together = spread.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "node")
    links = checkpointed(together.mapInArrow(_verify(width, threshold), _LINKS))
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    known = nodes.select("node", "copies", "id").join(classes, "node", "left").join(counts, "node", "left")
    known = checkpointed(known.withColumn("class", F.coalesce("component", "node")))
    least = known.groupBy("class").agg(F.min("id").alias("class_id"))
    answers = known.join(least, "class").select(
        "node", F.col("class").alias("class_node"), "class_id", (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"), "copies"
    )
    return signed.select("id", "text_hash", "node").join(answers, "node").select(F.col("id").alias(id_col), "text_hash", "class_node", "class_id", "n_links", "n_texts", "copies")
