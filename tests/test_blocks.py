"""Rows that meet in blocks, negatives by heaps, fits by sums, readers of folders, and scratch folders, against plain versions."""

import os
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions import blocks
from brindle.operators import classifiers, clusters, labels, large_clusters, linear, negatives, routing
from brindle.plans import model
from brindle.sources import files


def vectors(rng, n, width=5):
    return rng.normal(size=(n, width)).round(3)


class Pairs:
    """All pairs of a block."""

    def __init__(self, key, held):
        self.key, self.ids = key[0], held["id"].to_pylist()

    def take(self, rows):
        own = [(self.key, h, p) for p in rows.column("by").to_pylist() for h in self.ids]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*own, strict=True)], ["k", "h", "p"])

    def end(self):
        return iter(())


def test_everyone_meets_once(spark):
    rng = np.random.default_rng(1)
    held = [(int(k), h) for h, k in enumerate([0] * 40 + rng.integers(1, 6, 30).tolist() + [9])]
    passing = [(int(k), f"p{p}") for p, k in enumerate([0] * 70 + rng.integers(1, 7, 30).tolist())]
    got = blocks.meet(spark.createDataFrame(held, "k long, id long"), spark.createDataFrame(passing, "k long, by string"), ["k"], "id", "by", Pairs, "k long, h long, p string", 7, 9)
    want = [(k, h, p) for k, h in held for j, p in passing if k == j]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert blocks.meet(spark.createDataFrame([], "k long, id long"), spark.createDataFrame(passing, "k long, by string"), ["k"], "id", "by", Pairs, "k long, h long, p string", 7).collect() == []


def test_affinity_and_top_products(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD_BYTES", 8 * 5 * 6)  # six vectors a task
    monkeypatch.setattr(blocks, "PASSING_ROWS", 11)
    rng = np.random.default_rng(2)
    x, z = vectors(rng, 60), vectors(rng, 25)
    xs = spark.createDataFrame([(k % 3, k, v.tolist()) for k, v in enumerate(x)], "node long, mention_id long, vec array<double>")
    zs = spark.createDataFrame([(k % 4, k, v.tolist()) for k, v in enumerate(z)], "node long, label_id long, z array<double>")
    got = {r["label_id"]: (r["node"], r["mean"], r["total"], r["most"]) for r in blocks.affinity(xs, zs, ["node"]).collect()}
    assert sorted(got) == [k for k in range(25) if k % 4 < 3]
    for k, (node, *told) in got.items():
        dots = x[np.arange(60) % 3 == node] @ z[k]
        assert node == k % 4 and np.allclose(told, [dots.mean(), dots.sum(), dots.max()])
    for cosine in (False, True):
        top = blocks.top_products(xs.select("mention_id", "vec"), zs.select("label_id", "z"), "mention_id", "label_id", 4, cosine=cosine).collect()
        score = x @ z.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(z, axis=1) if cosine else 1)
        want = {(m, int(k), r + 1) for m in range(60) for r, k in enumerate(np.argsort(-score[m].round(9), kind="stable")[:4])}
        assert {(r["mention_id"], r["label_id"], r["rank"]) for r in top} == want


@pytest.mark.parametrize("small", [False, True])
def test_negatives_by_heaps(spark, monkeypatch, small):
    """The same as by sorting all pairs, in blocks of any size, with many equal scores."""
    if small:
        monkeypatch.setattr(negatives, "PER_STEP", 5)
        monkeypatch.setattr(negatives, "HEAP_ENTRIES", 40)
        monkeypatch.setattr(blocks, "PASSING_ROWS", 9)
    rng = np.random.default_rng(3)
    x, z = rng.integers(-1, 2, (80, 4)).astype(float), vectors(rng, 9, 4)
    of = [k % 2 for k in range(9)]
    own = [sorted({int(v) for v in rng.integers(0, 9, 2)}) for _ in range(80)]
    labels = [(0, of[k], k, z[k].tolist(), int(rng.integers(2, 30))) for k in range(9)]
    mentions = [(0, c, m, x[m].tolist(), own[m]) for m in range(80) for c in {of[k] for k in own[m]}]
    drawn = negatives.mixed(5)
    epochs = [[(0.7, "draw"), (0.3, "cos")], [(0.6, "ip"), (0.3, "cos"), (None, "draw")], [(0.5, "draw")]]
    kinds = "node long, cluster int, label_id long, z array<double>, n_neg long", "node long, cluster int, mention_id long, vec array<double>, own array<long>"
    got = negatives.choose(spark.createDataFrame(labels, kinds[0]), spark.createDataFrame(mentions, kinds[1]), epochs, drawn).collect()
    rows = []
    for _, c, m, vec, mine in mentions:
        for _, cluster, label, zv, n in labels:
            if c == cluster and label not in mine:
                ip = float(np.dot(vec, zv))
                keys = [int(drawn(e, np.array([label]), np.array([m]))[0, 0]) for e in (1, 2, 3)]
                rows.append((label, m, n, round(ip, 9), round(ip / (float(np.linalg.norm(vec)) + 1e-12), 9), *keys))
    pool = spark.createDataFrame(rows, "label_id long, mention_id long, n_neg long, ip double, cos double, d1 long, d2 long, d3 long")
    for e, phases in enumerate(epochs, 1):
        order = {"draw": [(f"d{e}", False)], "cos": [("cos", True)], "ip": [("ip", True)]}
        want = routing.pick_negatives(pool, [(share, [*order[by], ("mention_id", False)]) for share, by in phases], "label_id", "mention_id")
        assert Counter((r["label_id"], r["mention_id"]) for r in got if r["epoch"] == e) == Counter(map(tuple, want.collect()))


def test_negatives_of_ids_of_any_whole_type(spark):
    """Ids that are ints meet their heaps in as many partitions as there are."""
    ids = np.arange(40)
    z = vectors(np.random.default_rng(4), 12, 3)
    labels = [(0, 0, k, z[k].tolist(), 3) for k in range(12)]
    mentions = [(0, 0, int(m), [float(m % 5), 1.0, -1.0], [int(m % 12)]) for m in ids]
    kinds = "node int, cluster int, label_id int, z array<double>, n_neg int", "node int, cluster int, mention_id int, vec array<double>, own array<int>"
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = negatives.choose(spark.createDataFrame(labels, kinds[0]), spark.createDataFrame(mentions, kinds[1]), [[(1.0, "draw")]], negatives.mixed(1)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = Counter()
    for k in range(12):
        others = ids[ids % 12 != k]
        drawn = negatives.mixed(1)(1, np.array([k]), others)[:, 0]
        want.update((k, int(m)) for m in others[np.lexsort((others, drawn))[:3]])
    assert Counter((r["label_id"], r["mention_id"]) for r in got) == want


def matcher_rows(spark, width=4, n=260):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, width)) * 1.5
    of = rng.integers(0, 3, n)
    x = centres[of] + rng.normal(size=(n, width))
    rows = [(int(k % 7 == 0), k, x[k].tolist(), sorted({int(of[k]), int(rng.integers(0, 3))})) for k in range(n)]
    table = spark.createDataFrame(rows, "node long, mention_id long, vec array<double>, clusters array<int>").repartition(4)
    return table.select("node", "mention_id", "vec"), table.select("node", "mention_id", "clusters")


@pytest.mark.parametrize("kwargs", [{}, {"C": 0.05, "class_weight": "balanced"}, {"penalty": "l1", "C": 0.3, "tol": 1e-6, "max_iter": 500}, {"penalty": "elasticnet", "l1_ratio": 0.4, "tol": 1e-6, "max_iter": 500}, {"fit_intercept": False}])
@pytest.mark.parametrize("curved", [512, 0])
def test_matchers_of_large_nodes(spark, monkeypatch, kwargs, curved):
    """A node has the same coefficients whether one task or many fit it."""
    x, targets = matcher_rows(spark)
    config = {"type": "sklearnlogisticregression", "kwargs": kwargs}
    whole = {(r["node"], r["cluster"]): (*r["coef"], r["intercept"]) for r in model.fit_matchers(x, targets, config).collect()}
    monkeypatch.setattr(model, "NODE_ROWS", 100)  # one of the two nodes is larger
    monkeypatch.setattr(linear, "MOST_CURVED", curved)
    monkeypatch.setattr(linear, "PER_CHUNK", 7)
    spread = {(r["node"], r["cluster"]): (*r["coef"], r["intercept"]) for r in model.fit_matchers(x, targets, config).collect()}
    assert sorted(whole) == sorted(spread) and len(whole) == 6
    assert all(np.allclose(whole[k], spread[k], atol=1e-3) for k in whole)


@pytest.mark.parametrize("kwargs", [{"loss": "log_loss", "penalty": "l1"}, {"loss": "hinge"}, {"loss": "modified_huber", "penalty": "elasticnet"}, {"loss": "squared_hinge", "penalty": None}])
def test_passes_of_large_nodes_reach_the_least(spark, kwargs):
    """Where passes over examples only approach the least of the objective, sums over all tasks get there."""
    x, targets = matcher_rows(spark)
    rows = x.join(targets, ["node", "mention_id"]).filter("node = 0").orderBy("mention_id").collect()
    vec, fits = np.array([r["vec"] for r in rows]), linear.fit(x.join(targets, ["node", "mention_id"]).select("node", "vec", "clusters"), classifiers.SGD, kwargs)
    assert len(fits) == 6
    for node, cluster, coef, intercept in fits:
        if node == 0:
            y = np.array([float(cluster in r["clusters"]) for r in rows])
            passes, best = classifiers.SGD(**kwargs).fit(vec, y), classifiers.SGD(**kwargs)
            best.state = {"coef": coef, "intercept": intercept}
            assert best.objective(vec, y) <= passes.objective(vec, y) + 1e-3
    with pytest.raises(ValueError, match="single best"):
        linear.fit(x.join(targets, ["node", "mention_id"]).select("node", "vec", "clusters"), classifiers.SGD, {"loss": "perceptron"})


def test_readers_of_folders(spark, tmp_path):
    """Files by name, whatever their sizes; ids that are texts, quoted fields, and white space of any kind."""
    parts = ["b\tone\n" * 3 + "a\tfirst\n", "a\tsecond\n" + 'c\t"x\ty ""z"""\n' * 400, 'a\t"third"\n\tno id\n07\tseven\n7\tother\na\n']
    folder = tmp_path / "many"
    folder.mkdir()
    for k, text in enumerate(parts):
        (folder / f"part-{k}.txt").write_text(text, encoding="utf-8")
    got = {r["group_id"]: r["text"] for r in files.read_grouped(spark, str(folder), missing="nan").collect()}
    assert got == {"a": "first second third nan", "b": "one one one", "c": " ".join(['x\ty "z"'] * 400), "07": "seven", "7": "other"}
    lines = files.read_lines(spark, str(folder)).orderBy("pos").collect()
    assert [r["value"] for r in lines] == "".join(parts).split("\n")[:-1] and [r["pos"] for r in lines] == list(range(len(lines)))
    names = tmp_path / "labels.txt"
    names.write_text("\tC1\t\n\n C2 \n\t\n\x1fC3 \n", encoding="utf-8")
    assert [r["label"] for r in files.read_labels(spark, str(names)).orderBy("label_pos").collect()] == ["C1", "C2", "C3"]
    gold = tmp_path / "gold.txt"
    gold.write_text("\tC1|C2\t\nC3 \n", encoding="utf-8")
    assert [r["codes"] for r in files.read_gold(spark, str(gold)).orderBy("query_id").collect()] == [["C1", "C2"], ["C3"]]


def test_scopes_remove_what_they_made(spark):
    place = files.shared_folder(spark).removeprefix("file:")
    files.checkpointed(spark.range(3)).count()
    size = lambda: sum(len(f) for _, _, f in os.walk(place))
    before = size()
    with files.scope():
        kept = files.checkpointed(spark.range(5))
        kept.write.parquet(files.scratch(spark, "table"))
        assert size() > before and kept.count() == 5
    assert size() == before


def label_rows(spark, z, node=0):
    return spark.createDataFrame([(node, k, v.tolist()) for k, v in enumerate(z)], "node long, label_id long, z array<double>").repartition(3)


def blobs(rng, n, k, width=4, apart=6.0):
    centres = rng.normal(size=(k, width)) * apart
    return centres[rng.integers(0, k, n)] + rng.normal(size=(n, width))


def inertia(z, own):
    return sum(((z[own == c] - z[own == c].mean(0)) ** 2).sum() for c in set(own.tolist()))


def clusters_found(spark, z, kind, kwargs, least=2):
    got = clusters.cluster_nodes(label_rows(spark, z), {"type": kind, "kwargs": kwargs}, least).collect()
    own = np.full(len(z), -1)
    for r in got:
        own[r["label_id"]] = r["cluster"]
    return own


@pytest.mark.parametrize(("k", "distance", "hot"), [(2, "cosine", False), (8, "cosine", False), (8, "euclidean", True), (2, "cosine", True)])
def test_equal_sizes_at_any_size(spark, monkeypatch, k, distance, hot):
    """Sizes differ by one at most, whether one task or many cluster the node, and where a third of the labels is alike."""
    rng = np.random.default_rng(31)
    z = blobs(rng, 403, 5)
    if hot:
        z[:135] = z[0]
    for most in (10**9, 100):
        monkeypatch.setattr(clusters, "NODE_LABELS", most)
        sizes = np.bincount(clusters_found(spark, z, "balancedkmeans", {"n_clusters": k, "distance": distance, "random_state": 3, "iter_limit": 12}), minlength=k)
        assert len(sizes) == k and sizes.max() - sizes.min() <= 1


@pytest.mark.parametrize(("kind", "kwargs"), [("sklearnkmeans", {"n_clusters": 5, "n_init": 3}), ("faisskmeans", {"n_clusters": 5}), ("cumlkmeans", {"n_clusters": 5, "n_init": 2}), ("sklearnminibatchkmeans", {"n_clusters": 5, "n_init": 2})])
def test_clusters_of_large_nodes(spark, monkeypatch, kind, kwargs):
    z = blobs(np.random.default_rng(32), 300, 5)
    whole = inertia(z, clusters_found(spark, z, kind, kwargs | {"random_state": 1}))
    monkeypatch.setattr(clusters, "NODE_LABELS", 100)
    assert inertia(z, clusters_found(spark, z, kind, kwargs | {"random_state": 1})) < 1.05 * whole + 1e-9


def test_rounds_over_all_labels(spark):
    """Starts, limits and distances of the rounds are the caller's; many centres are one array, not a plan."""
    rng = np.random.default_rng(33)
    z = blobs(rng, 240, 3)
    rows = label_rows(spark, z)
    given = z[[0, 1, 2]].copy()
    once, _, first = large_clusters.centres_of(rows, 3, given, False, 1, 0.0, 0)
    own = ((z[:, None] - given[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(once, [z[own == c].mean(0) for c in range(3)]) and np.isclose(first, ((z - given[own]) ** 2).sum())
    for _ in range(50):
        own = ((z[:, None] - given[None]) ** 2).sum(2).argmin(1)
        given = np.array([z[own == c].mean(0) for c in range(3)])
    assert np.allclose(large_clusters.centres_of(rows, 3, z[[0, 1, 2]], False, 50, 0.0, 0)[0], given)
    angles = large_clusters.centres_of(rows, 3, z[[0, 1, 2]], True, 30, 0.0, 0)[0]
    u = z / np.linalg.norm(z, axis=1)[:, None]
    own = (u @ angles.T).argmax(1)
    assert np.allclose(angles, [m / np.linalg.norm(m) for m in (u[own == c].mean(0) for c in range(3))])
    assert len(large_clusters.centres_of(rows, 150, "random", False, 1, 0.0, 0)[0]) == 150
    assert len(set(map(tuple, large_clusters.starts(rows, 20, "k-means++", False, 4).round(9).tolist()))) == 20


def plain_agglomeration(z, k, linkage, metric):
    """Clusters joined one by one, by distances of all their rows."""
    groups = [[i] for i in range(len(z))]
    u = z / np.linalg.norm(z, axis=1)[:, None]
    d = {"euclidean": np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), "cosine": 1 - u @ u.T, "manhattan": np.abs(z[:, None] - z[None]).sum(2)}[metric]

    def far(a, b):
        if linkage == "ward":
            return 2 * len(a) * len(b) / (len(a) + len(b)) * ((z[a].mean(0) - z[b].mean(0)) ** 2).sum()
        return {"complete": np.max, "single": np.min, "average": np.mean}[linkage](d[np.ix_(a, b)])

    while len(groups) > k:
        _, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
    return {tuple(g) for g in groups}


@pytest.mark.parametrize(("linkage", "metric"), [("ward", "euclidean"), ("single", "euclidean"), ("single", "manhattan"), ("complete", "cosine"), ("average", "cosine"), ("average", "euclidean")])
def test_agglomeration(linkage, metric, monkeypatch):
    rng = np.random.default_rng(34)
    z = rng.normal(size=(40, 3))
    for k in (2, 5, 11):
        own = clusters.agglomerate(z, k, linkage, metric)
        assert {tuple(np.flatnonzero(own == c).tolist()) for c in set(own.tolist())} == plain_agglomeration(z, k, linkage, metric)
    monkeypatch.setattr(clusters, "MATRIX_BYTES", 8 * 30 * 30)
    if clusters.needs_matrix(linkage, metric):
        with pytest.raises(ValueError, match="too many"):
            clusters.agglomerate(z, 3, linkage, metric)
    else:  # needs no more than the rows
        assert len(set(clusters.agglomerate(z, 3, linkage, metric).tolist())) == 3


def learnable(spark, n, seed=41):
    """Mentions of which the cluster is a curved function of the vector, and as many to judge by."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] ** 2 + x[:, 1] > 0.7) ^ (x[:, 2] > 1)).astype(int)
    rows = [(0, k, v.tolist(), [int(c)]) for k, (v, c) in enumerate(zip(x, y, strict=True))]
    table = spark.createDataFrame(rows, "node long, mention_id long, vec array<double>, clusters array<int>").repartition(4)
    return table.select("node", "mention_id", "vec"), table.select("node", "mention_id", "clusters"), x, y


@pytest.mark.parametrize(("kind", "kwargs"), [
    ("sklearnrandomforestclassifier", {"n_estimators": 20, "min_samples_leaf": 3, "max_features": None, "random_state": 1}), ("lightgbmclassifier", {"n_estimators": 8, "learning_rate": 0.4, "num_leaves": 12}), ("sklearnsupportvectorclassification", {"C": 2.0}),
])
def test_other_types_of_large_nodes(spark, monkeypatch, kind, kwargs):
    """They train on a node of more rows than one task takes, about as well as in one task."""
    x, targets, _, _ = learnable(spark, 1200)
    _, _, asked, truth = learnable(spark, 2000, 42)
    config = {"type": kind, "kwargs": kwargs}

    def decisions():
        found = {r["cluster"]: classifiers.Classifier.loads(r["model"]) for r in model.fit_matchers(x, targets, config).collect()}
        assert sorted(found) == [0, 1]
        return found[1].decision_function(asked)

    whole = decisions()
    monkeypatch.setattr(model, "NODE_ROWS", 300)
    spread = decisions()
    accuracy = [((d > 0) == truth).mean() for d in (whole, spread)]
    assert accuracy[1] > accuracy[0] - 0.02 and accuracy[1] > 0.85
    if kind == "sklearnsupportvectorclassification":
        assert np.corrcoef(whole, spread)[0, 1] > 0.98


def test_label_matrix_is_not_sent_through_the_driver(spark):
    """However small its file is."""
    x = spark.createDataFrame([(m, "f", 1.0) for m in range(4)], "mention_id long, feature string, value double")
    y = spark.range(4).select(F.col("id").alias("mention_id"), (F.col("id") % 2).alias("label_id"))
    found = labels.pifa(x, y)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert Counter((r["label_id"], r["feature"], round(r["value"], 9)) for r in found.collect()) == Counter([(0, "f", 1.0), (1, "f", 1.0)])


def test_top_sparse_products(spark, monkeypatch):
    """The same as by all pairs that share a feature, in blocks of any size, with equal scores; a feature that all rows have is not a place where they meet."""
    monkeypatch.setattr(blocks, "PASSING_ROWS", 11)
    monkeypatch.setattr(blocks, "SPARSE_STEP", 20)
    rng = np.random.default_rng(6)
    rows = lambda n, name: [(name(k), f"f{f}", float(rng.integers(-1, 4)) / 2) for k in range(n) for f in {0, *rng.integers(0, 12, 3).tolist()}]
    x, z = rows(60, int), rows(9, "l{}".format)
    got = blocks.top_sparse_products(spark.createDataFrame(x, "q long, feature string, value double"), spark.createDataFrame(z, "l string, feature string, value double"), "q", "l", 3)
    score = Counter()
    for q, f, v in x:
        for label, g, w in z:
            if f == g:
                score[q, label] += v * w
    want = [(q, label, s) for q in range(60) for s, label in sorted((-s, label) for (p, label), s in score.items() if p == q and s > 0)[:3] for s in [-s]]
    assert Counter((r["q"], r["l"], r["score"]) for r in got.collect()) == Counter(want)


def test_ranker_holds_a_batch_not_a_sample():
    """Passes over a label's sample stream through the task that fits it, in the order and to the coefficients of whole passes."""
    rng = np.random.default_rng(5)
    n, width = 30_000, 32
    ids = np.sort(rng.choice(10 * n, n, replace=False))
    target = (rng.random(n) < 0.3).astype(np.int32)
    vectors, z = rng.normal(size=(n, width)), rng.normal(size=width)
    kwargs = {"loss": "log_loss", "class_weight": "balanced", "average": True, "random_state": 3}
    whole = classifiers.CLASSIFIERS["sgdclassifier"](**kwargs)
    parts = [np.arange(n), np.arange(0, n, 2)]
    for part in parts:
        whole.partial_fit(np.hstack((vectors[part], np.broadcast_to(z, (len(part), width)))), target[part])

    def sorted_rows():
        for epoch, part in enumerate(parts, 1):
            for low in range(0, len(part), 5000):
                at = part[low : low + 5000]
                same = lambda value, kind, n=len(at): np.full(n, value, kind)
                yield blocks.table({"node": same(7, np.int64), "label_id": same(2, np.int64), "epoch": same(epoch, np.int32), "mention_id": ids[at], "target": target[at], "length": (vectors[at] ** 2).sum(1)})

    placed = pa.Table.from_batches(list(model._placed("sgdclassifier", kwargs)(sorted_rows()))).to_pandas()

    def taken():
        yield blocks.table({"node": np.array([7]), "label_id": np.array([2]), "epoch": np.array([0], np.int32), "place": np.array([0]), "vec": pa.array([z.tolist()]), "target": pa.array([None], pa.int32()), "weight": pa.array([None], pa.float64()), "length": pa.array([None], pa.float64())})
        for low in range(0, len(placed), 1000):
            some = placed.iloc[low : low + 1000]
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(vectors[np.searchsorted(ids, some["mention_id"])].ravel()))
            own = {c: some[c].to_numpy() for c in ("epoch", "place", "target", "weight")}
            yield blocks.table({"node": np.full(len(some), 7), "label_id": np.full(len(some), 2), **own, "vec": vec, "length": pa.array(some["length"], from_pandas=True)})

    tracemalloc.start()
    (found,) = list(model._descending("sgdclassifier", kwargs)(taken()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found.column("coef")[0].as_py(), whole.coef, rtol=1e-9, atol=1e-12) and abs(found.column("intercept")[0].as_py() - whole.intercept) < 1e-9
    assert peak < vectors.nbytes / 4


def test_rankers_are_those_of_whole_passes(spark):
    """Rows named twice count once, mentions without a vector not at all, and a label may start at a later epoch."""
    rng = np.random.default_rng(6)
    vectors, zs = rng.normal(size=(40, 4)), {1: rng.normal(size=4), 2: rng.normal(size=4), 3: rng.normal(size=4)}
    pool = [(0, label, m, int(rng.random() < 0.4), e) for label in (1, 2) for m in range(44) for e in (1, 2, 3) if e >= label and rng.random() < 0.7]
    pool = list({(*p[:3], p[4]): p for p in pool}.values())
    targets = {(label, m): t for _, label, m, t, _ in pool}
    pool = [(node, label, m, targets[label, m], e) for node, label, m, _, e in pool]
    x = spark.createDataFrame([(0, m, vectors[m].tolist()) for m in range(40)], "node long, mention_id long, vec array<double>")
    z = spark.createDataFrame([(0, label, v.tolist()) for label, v in zs.items()], "node long, label_id int, z array<double>")
    config = {"type": "sgdclassifier", "kwargs": {"loss": "log_loss", "random_state": 2}}
    got = model.fit_rankers(spark.createDataFrame(pool + pool[:9], "node long, label_id int, mention_id long, target int, epoch int"), x, z, config, 3).collect()
    assert sorted(r["label_id"] for r in got) == [1, 2]
    for r in got:
        learner = classifiers.CLASSIFIERS["sgdclassifier"](**config["kwargs"])
        for e in (1, 2, 3):
            rows = sorted((m, t) for _, label, m, t, at in pool if label == r["label_id"] and at == e and m < 40)
            if rows:
                own = np.array([vectors[m] for m, _ in rows])
                learner.partial_fit(np.hstack((own, np.broadcast_to(zs[r["label_id"]], own.shape))), np.array([t for _, t in rows]))
        assert np.allclose(r["coef"], learner.coef, rtol=1e-9, atol=1e-12) and abs(r["intercept"] - learner.intercept) < 1e-9


def test_heaps_of_a_label_are_merged_as_they_come():
    """A label's blocks have far more entries than its heaps: only those of the heaps are held."""
    rng = np.random.default_rng(8)
    n, many, size = 400, 400, 4096
    all_keys = rng.integers(0, 1 << 60, many * size)

    def rows():
        none = lambda kind: pa.array([None], kind)
        lists = pa.list_(pa.int64())
        yield blocks.table({"node": np.array([0]), "label_id": np.array([4]), "n_neg": np.array([n]), "way": none(pa.string()), "epoch": none(pa.int32()), "keys": none(lists), "ids": none(lists)})
        for k in range(many):
            own = all_keys[k * size : (k + 1) * size]
            column = lambda values: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(values))
            yield blocks.table({"node": np.array([0]), "label_id": np.array([4]), "n_neg": none(pa.int64()), "way": pa.array(["draw"]), "epoch": np.array([1], np.int32), "keys": column(own), "ids": column(np.arange(k * size, (k + 1) * size))})

    tracemalloc.start()
    out = pa.Table.from_batches(list(negatives._merging([[(1.0, "draw")]])(rows())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["mention_id"].to_pylist() == sorted(np.argsort(all_keys)[:n].tolist())
    assert peak < all_keys.nbytes / 8
