"""Queries against DuckDB, readers, and the label tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import queries
from brindle.functions import fusion, vectors
from brindle.operators import classifiers, clusters, encoders, labels, routing
from brindle.plans.model import XModel
from brindle.sources import files
from tests import oracle
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert oracle.spark_rows(queries.queries()[name](spark, SF)) == oracle.duck_rows(duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["negatives_warm", "negatives_epochs", "ranker_fit_predict"])
def test_negatives_in_many_partitions(spark, duck, name):
    """Partitions that are left apart, as they are on larger tables."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    want = oracle.spark_rows(queries.queries()[name](spark, SF)) if name not in queries.oracle_sql() else oracle.duck_rows(duck, queries.oracle_sql()[name])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert oracle.spark_rows(queries.queries()[name](spark, SF)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_matchers_are_fitted_once(spark):
    """What is scored by them reads them, and doesn't fit them in each of its tasks."""
    plan = queries.queries()["matcher_fit_predict"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    train = write(tmp_path / "train.txt", "7\tb one\n2\ta one\n7\tb two\n2\t\n30\tc\n")
    names = write(tmp_path / "labels.txt", "L1\n\n  L2 \nL3\nL4\n")
    with pytest.warns(UserWarning):
        rows = files.read_labelled(spark, train, names).orderBy("label_pos").collect()
    assert [(r["label"], list(r["corpus"])) for r in rows] == [("L1", ["a one", ""]), ("L2", ["b one", "b two"]), ("L3", ["c"])]
    assert {r["group_id"]: r["text"] for r in files.read_grouped(spark, train).collect()} == {"2": "a one ", "7": "b one b two", "30": "c"}
    with pytest.warns(UserWarning):
        assert files.read_labelled(spark, train, names, truncate=1).count() == 1
    few = write(tmp_path / "few.txt", "L1\n")
    with pytest.raises(ValueError):
        files.read_labelled(spark, train, few)
    gold = files.read_gold(spark, write(tmp_path / "gold.txt", "A|B\nC\n")).orderBy("query_id").collect()
    assert [list(r["codes"]) for r in gold] == [["A", "B"], ["C"]]
    files.extract_codes(spark, write(tmp_path / "p.tsv", "x\tcode\n1\tA\n2\t\n3\tC\n"), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["A", "C"]
    flat = files.flatten(files.from_lists(spark, [["a", "b"], ["c"], ["never"]], ["X", "Y"])).orderBy("mention_id").collect()
    assert [tuple(r) for r in flat] == [(0, "X", "a"), (1, "X", "b"), (2, "Y", "c")]
    files.write_debug_tables({"t": spark.range(2)}, str(tmp_path / "debug"))
    assert spark.read.csv(str(tmp_path / "debug/t"), header=True).count() == 2


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 0.0])], "m long, e array<double>")
    got = [r[0] for r in rows.orderBy("m").select(vectors.unit(F.col("e"))).collect()]
    assert got == [[0.6, 0.8, 0.0], [0.0, 0.0, 0.0]]
    long = vectors.to_long(rows, "e", "m")
    assert {r["norm"] for r in vectors.long_norms(long, "m").collect()} == {5.0}
    assert vectors.to_dense(vectors.long_unit(long, "m"), 2, "m").first()["vector"] == [0.6, 0.8]
    both = vectors.stack(long, long, widths=[3, 3])
    assert {r["feature"] for r in both.collect()} == {0, 1, 3, 4}


def test_pairs_in_blocks(spark, monkeypatch):
    x, z = spark.range(5).withColumnRenamed("id", "m"), spark.range(7).withColumnRenamed("id", "l")
    monkeypatch.setattr(vectors, "MOST_BROADCAST", 16)
    assert vectors.pairs_with_all(x, z, 1).distinct().count() == 35


def test_fusion_ends(spark):
    row = spark.range(1).select(fusion.lp_fusion(F.lit(0.3), F.lit(0.9), 0.0).alias("a"), fusion.geometric_fusion(F.lit(0.3), F.lit(0.9), 1.0).alias("b"), fusion.geometric_fusion(F.lit(2.0), F.lit(-1.0)).alias("c")).first()
    assert row["a"] == pytest.approx(0.3) and row["b"] == pytest.approx(0.9) and row["c"] == pytest.approx(1e-3)


def test_pifa_agrees_with_its_long_form(spark):
    x = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("mention_id"), F.col("label").alias("label_id"), F.col("embedding").cast("array<double>").alias("e"))
    dense = {r["label_id"]: r["z"] for r in labels.pifa_dense(x, "e", "label_id").collect()}
    for r in labels.pifa(vectors.to_long(x, "e", "mention_id"), x.select("mention_id", "label_id")).collect():
        assert dense[r["label_id"]][r["feature"]] == pytest.approx(r["value"])
    assert all(np.linalg.norm(z) == pytest.approx(1) for z in dense.values())


@pytest.mark.parametrize("kind", sorted(clusters.CLUSTERERS))
def test_clusterers_find_groups(kind):
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(c, 0.05, (20, 4)) for c in ([1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1])])
    label = clusters.CLUSTERERS[kind](z, {"n_clusters": 3})
    assert sorted(np.bincount(label)) == [20, 20, 20] and all(len(set(label[k : k + 20])) == 1 for k in (0, 20, 40))


def test_balance_and_limits(spark):
    rng = np.random.default_rng(1)
    assert sorted(np.bincount(clusters.balanced_assignment(rng.random((11, 3))))) == [3, 4, 4]
    nodes = spark.createDataFrame([(n, k, rng.random(3).tolist()) for n, size in ((0, 4), (1, 12)) for k in range(size)], "node long, label_id long, z array<double>")
    got = clusters.cluster_nodes(nodes, {"type": "BalancedKMeans"}, 4).collect()
    assert {r["node"] for r in got} == {1} and len(got) == 12
    with pytest.raises(ValueError):
        clusters.cluster_nodes(nodes, {"type": "other"}, 4)


@pytest.mark.parametrize("kind", sorted(classifiers.CLASSIFIERS))
def test_classifiers_learn_and_keep(kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    model = classifiers.CLASSIFIERS[kind](**({"n_estimators": 20} if kind in ("sklearnrandomforestclassifier", "lightgbmclassifier") else {})).fit(x, y)
    assert model.classes == [0, 1]
    assert (model.predict(x) == y).mean() > 0.9
    again = classifiers.Classifier.loads(model.dumps())
    assert np.allclose(again.predict_proba(x), model.predict_proba(x)) and np.allclose(model.predict_proba(x).sum(1), 1)
    assert classifiers.CLASSIFIERS[kind]().fit(x, np.ones(300)).predict(x).all()
    with pytest.raises(ValueError):
        classifiers.CLASSIFIERS[kind](nonsense=1)


def test_singular_values(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((40, 6))
    rows = spark.createDataFrame([(list(range(6)), r.tolist()) for r in a], "features array<int>, values array<double>")
    v, s = encoders.singular_vectors(rows, 6, 3)
    assert np.allclose(s, np.linalg.svd(a)[1][:3]) and np.allclose(v.T @ v, np.eye(3))


def test_registered_encoders(spark):
    rows = spark.createDataFrame([(0, "some text"), (1, None)], "query_id long, text string")
    got = encoders.TextEncoder(transformer={"type": "hashedngrams"}, flag=3).transform(rows, "query_id", "text").orderBy("query_id").collect()
    assert np.linalg.norm(got[0]["vec"]) == pytest.approx(1)
    with pytest.raises(ValueError):
        encoders.TextEncoder(transformer={"type": "nobodys"}, flag=3).transform(rows, "query_id", "text")
    with pytest.raises(Exception, match="torch and transformers"):
        encoders.TextEncoder(transformer={"type": "biobert"}, flag=3).transform(rows, "query_id", "text").collect()


def test_vocabulary_has_no_limit_of_its_own(spark):
    rows = spark.createDataFrame([(k, " ".join(f"{c}{k}" for c in "abcdefgh")) for k in range(1400)], "query_id long, text string")
    dimension = {"kwargs": {"n_components": 2, "n_iter": 0}}
    whole = encoders.TextEncoder(dimension=dimension, flag=1).fit(rows, "query_id", "text")
    assert whole.terms == whole.vocabulary.count() == whole.basis.count() == 1400 * 15
    some = encoders.TextEncoder(vectorizer={"kwargs": {"max_features": 50}}, dimension=dimension, flag=1)
    assert some.fit(rows, "query_id", "text").terms == 50


def test_negatives_are_cut_where_they_overlap(spark):
    pool = spark.createDataFrame([(0, m, 4, float(m), float(-m)) for m in range(10)], "label_id long, mention_id long, n_neg long, a double, b double")
    same = routing.pick_negatives(pool, [(0.5, [("a", True)]), (0.5, [("a", True)])])
    assert sorted(r["mention_id"] for r in same.collect()) == [8, 9]
    rest = routing.pick_negatives(pool, [(0.5, [("a", True)]), (None, [("a", True)])])
    assert sorted(r["mention_id"] for r in rest.collect()) == [6, 7, 8, 9]


@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3)] for _ in range(24)]
    rows = [(k * 6 + n, f"{' '.join(rng.permutation(words[k])[:2])} common", f"L{k:02d}") for k in range(24) for n in range(6)]
    mentions = spark.createDataFrame(rows, "mention_id long, text string, label string")
    ranker = {"type": "sgdclassifier", "kwargs": {"loss": "log_loss", "random_state": 1}, "n_epochs": 4, "cur_config": {"E_warm": 2}}
    fitted = XModel(dimension_config={"kwargs": {"n_components": 40}}, clustering_config={"type": "balancedkmeans", "kwargs": {"n_clusters": 2}}, ranker_config=ranker, min_leaf_size=3, depth=3).train(mentions)
    return fitted, mentions


def hits(model, mentions, **kwargs):
    asked = mentions.filter("mention_id % 3 = 0").select(F.col("mention_id").alias("query_id"), "text")
    got = model.predict(asked, topk=3, **kwargs)
    right = got.join(mentions, (F.col("query_id") == F.col("mention_id")) & (got["label"] == mentions["label"]))
    return right.count() / asked.count()


def test_tree_finds_labels(tree):
    model, mentions = tree
    assert hits(model, mentions) > 0.7 and hits(model, mentions, topk_mode="global") > 0.8
    assert model.edges.count() > 1 and model.clusters.groupBy("node", "label_id").count().filter("count > 1").isEmpty()


def test_tree_is_kept(spark, tree, tmp_path):
    model, mentions = tree
    model.save(str(tmp_path / "model"))
    again = XModel.load(spark, str(tmp_path / "model"))
    asked = mentions.limit(9).select(F.col("mention_id").alias("query_id"), "text")
    rows = lambda m: sorted((r["query_id"], r["rank"], r["label"], round(r["score"], 9)) for r in m.predict(asked).collect())
    assert rows(model) == rows(again)
    with pytest.raises(Exception, match="(?i)exists"):
        model.save(str(tmp_path / "model"))


def test_final_paths(tree):
    model, mentions = tree
    vec = model.encoder.transform(mentions.filter("mention_id < 5").select(F.col("mention_id").alias("query_id"), "text"), "query_id", "text")
    for r in model.final_paths(vec, topk=3).collect():
        assert r["final_path"]["scores"] == sorted(r["final_path"]["scores"], reverse=True) and r["paths"]
        assert all(s["layer"] == k for p in r["paths"] for k, s in enumerate(p["trail"]))


def test_positions_of_wide_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", True)
    mixed = (F.col("id") * 7919) % 500_000
    rows = spark.range(500_000).select(mixed.alias("id"), F.repeat(F.lit("x"), 200).alias("a"), F.repeat(mixed.cast("string"), 20).alias("b"), F.lit("mine").alias("_at"))
    got = files.ranked(rows, "id", "pos")
    assert got.filter("pos is null or pos != id or _at != 'mine'").isEmpty() and got.count() == 500_000
    assert files.ranked(rows.limit(0), "id", "pos").collect() == []


def test_label_ids_are_ranks(spark):
    rows = spark.createDataFrame([(w,) for w in ["b", "a", "é", "Z", None, "a", ""]], "l string")
    assert [tuple(r) for r in labels.label_dictionary(rows, "l").orderBy("label_id").collect()] == [("", 0), ("Z", 1), ("a", 2), ("b", 3), ("é", 4)]


@pytest.mark.parametrize("kind, wrong", [
    ("sklearnlogisticregression", {"dual": True}), ("sklearnlogisticregression", {"solver": "guess"}), ("sgdclassifier", {"loss": "huber"}), ("sgdclassifier", {"learning_rate": "constant", "eta0": 0.0}),
    ("sklearnrandomforestclassifier", {"oob_score": True}), ("sklearnrandomforestclassifier", {"ccp_alpha": 0.1}), ("lightgbmclassifier", {"boosting_type": "dart"}), ("sklearnsupportvectorclassification", {"break_ties": True}),
])
def test_options_of_classifiers_are_refused(kind, wrong):
    with pytest.raises(ValueError):
        classifiers.CLASSIFIERS[kind](**wrong)


def learning_rows(n=400, d=5, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    return x, (x[:, 0] + 0.3 * x[:, 1] + 0.5 * rng.standard_normal(n) > 0).astype(float)


def test_logistic_regression_meets_its_conditions():
    x, y = learning_rows()
    for kwargs, square, absolute in (({"C": 0.5}, 2.0, 0.0), ({"penalty": "l1", "C": 0.1}, 0.0, 10.0), ({"penalty": "elasticnet", "l1_ratio": 0.4, "C": 0.2}, 3.0, 2.0), ({"penalty": None}, 0.0, 0.0)):
        model = classifiers.LogisticRegression(tol=1e-8, max_iter=2000, **kwargs).fit(x, y)
        w = np.array(model.coef)
        error = model.predict_proba(x)[:, 1] - y
        pull = x.T @ error + square * w
        assert abs(error.sum()) < 1e-3 and (np.abs(pull[w == 0]) <= absolute + 1e-3).all() and np.allclose(pull[w != 0], -absolute * np.sign(w[w != 0]), atol=1e-3)
    few = x[:4]  # more features than rows
    model = classifiers.LogisticRegression(tol=1e-8).fit(few, np.array([0.0, 1, 0, 1]))
    assert np.allclose(few.T @ (model.predict_proba(few)[:, 1] - [0, 1, 0, 1]) + np.array(model.coef), 0, atol=1e-6)
    assert classifiers.LogisticRegression(fit_intercept=False).fit(x, y).intercept == 0
    heavy = classifiers.LogisticRegression(class_weight={0: 1, 1: 9}).fit(x, y)
    assert heavy.predict(x).mean() > classifiers.LogisticRegression().fit(x, y).predict(x).mean() + 0.1
    assert classifiers.LogisticRegression(max_iter=1).fit(x, y).coef != classifiers.LogisticRegression().fit(x, y).coef


@pytest.mark.parametrize("kwargs", [
    {"loss": "log_loss", "learning_rate": "adaptive", "eta0": 0.01, "penalty": "l1"}, {"early_stopping": True, "random_state": 42}, {"average": True}, {"learning_rate": "invscaling", "eta0": 0.1}, {"learning_rate": "constant", "eta0": 0.01},
    {"loss": "modified_huber", "penalty": "elasticnet"}, {"loss": "squared_hinge", "penalty": None, "learning_rate": "constant", "eta0": 0.001}, {"loss": "perceptron", "penalty": None, "average": True}, {"class_weight": "balanced"}, {"shuffle": False},
])
def test_options_of_sgd(kwargs):
    x, y = learning_rows()
    best = (classifiers.LogisticRegression().fit(x, y).predict(x) == y).mean()
    for seed in range(5):
        model = classifiers.SGD(**(kwargs | {"random_state": seed})).fit(x, y)
        assert (model.predict(x) == y).mean() > best - 0.08
    assert model.coef == classifiers.SGD(**(kwargs | {"random_state": seed})).fit(x, y).coef
    # rows that differ by rounding alone end near the same objective
    moved = classifiers.SGD(**kwargs).fit(x * (1 + 1e-15), y)
    assert abs(moved.objective(x, y) - classifiers.SGD(**kwargs).fit(x, y).objective(x, y)) < 0.1


def test_passes_of_sgd():
    x, y = learning_rows()
    one = lambda **kw: classifiers.SGD(loss="log_loss", learning_rate="constant", eta0=0.01, **kw).fit(x, y).state["t"] // len(x)
    assert one(max_iter=3) == 3 and one(max_iter=300, tol=None) == 300 and 3 < one(max_iter=300, tol=1e-2, n_iter_no_change=2) < 40
    slow = classifiers.SGD(learning_rate="adaptive", eta0=0.5, tol=1e-2, n_iter_no_change=1, loss="log_loss").fit(x, y)
    assert slow.state["rate"] < 1e-5
    strong = classifiers.SGD(penalty="l1", alpha=0.05, learning_rate="constant", eta0=0.01, loss="log_loss").fit(x, y)
    free = classifiers.SGD(penalty=None, learning_rate="constant", eta0=0.01, loss="log_loss").fit(x, y)
    assert np.abs(strong.coef[2:]).max() < 0.3 * np.abs(free.coef[2:]).max() and min(strong.coef[:2]) > 0.3


def test_options_of_trees():
    x, y = learning_rows()
    forest = lambda **kw: classifiers.Forest(n_estimators=5, random_state=1, **kw).fit(x, y).state["trees"]
    depth = lambda t, k=0: 0 if len(t[k]) == 1 else 1 + max(depth(t, t[k][2]), depth(t, t[k][3]))
    count = lambda t: sum(len(n) == 1 for n in t)
    assert max(map(depth, forest())) > 8 and max(depth(t) for t in forest(max_depth=3)) == 3
    assert all(count(t) <= 6 for t in forest(max_leaf_nodes=6)) and max(map(count, forest())) > 40
    assert max(map(count, forest(min_samples_leaf=40))) <= 10 and max(map(count, forest(min_samples_split=200))) < 20
    assert max(map(count, forest(min_impurity_decrease=0.02))) < 10 and forest(criterion="entropy") != forest() != forest(max_features=None)
    assert max(map(count, forest(max_samples=0.1))) < 30 and len({str(t) for t in forest(bootstrap=False, max_features=None)}) == 1
    boosted = lambda **kw: classifiers.Boosted(n_estimators=5, **kw).fit(x, y).state["trees"]
    assert max(map(count, boosted(num_leaves=4))) == 4 and max(depth(t) for t in boosted(max_depth=2)) == 2 and max(map(count, boosted())) <= 31
    assert max(map(count, boosted(min_child_samples=150))) <= 2 and max(map(count, boosted(min_split_gain=1e6))) == 1
    for kw in ({"reg_alpha": 5.0}, {"reg_lambda": 50.0}, {"colsample_bytree": 0.4, "random_state": 3}, {"subsample": 0.5, "subsample_freq": 1}, {"min_child_weight": 20.0}, {"learning_rate": 0.5}):
        assert boosted(**kw) != boosted()


def test_kernels():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 2))
    y = ((x**2).sum(1) > 1.2).astype(float)
    right = lambda **kw: (classifiers.KernelSVC(**kw).fit(x, y).predict(x) == y).mean()
    assert right() > 0.95 and right(kernel="poly", degree=2, coef0=1.0) > 0.95 and right(kernel="linear") < 0.9 and right(gamma="auto", C=10.0) > 0.95
    model = classifiers.KernelSVC(tol=1e-6).fit(x, y)
    margin = np.where(y > 0, 1, -1) * model.raw_decision(x)
    held = {tuple(r) for r in model.state["support"]}
    assert all(margin[k] > 1 - 1e-3 for k in range(300) if tuple(x[k].tolist()) not in held)  # the conditions for the least


@pytest.mark.parametrize("kind, wrong", [
    ("sklearnkmeans", {"init": "guess"}), ("balancedkmeans", {"distance": "other"}), ("balancedkmeans", {"iter_k": 3}), ("sklearnagglomerativeclustering", {"linkage": "other"}), ("sklearnagglomerativeclustering", {"connectivity": 1}),
    ("faisskmeans", {"nonsense": 1}),
])
def test_options_of_clusterers_are_refused(kind, wrong):
    with pytest.raises(ValueError):
        clusters.CLUSTERERS[kind](np.random.default_rng(0).random((20, 3)), {"n_clusters": 3} | wrong)


def brute_linkage(z, k, linkage):
    groups = [[i] for i in range(len(z))]
    far = lambda a, b: np.linalg.norm(z[a][:, None] - z[b][None], axis=2)
    cost = {
        "ward": lambda a, b: ((z[a].mean(0) - z[b].mean(0)) ** 2).sum() * len(a) * len(b) / (len(a) + len(b)),
        "complete": lambda a, b: far(a, b).max(), "single": lambda a, b: far(a, b).min(), "average": lambda a, b: far(a, b).mean(),
    }[linkage]
    while len(groups) > k:
        _, a, b = min((cost(groups[a], groups[b]), a, b) for b in range(len(groups)) for a in range(b))
        groups[a] += groups.pop(b)
    out = np.zeros(len(z), int)
    for n, rows in enumerate(groups):
        out[rows] = n
    return out


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_linkages(linkage):
    rng = np.random.default_rng(6)
    for _ in range(3):
        z = rng.random((25, 3))
        got, want = clusters.agglomerate(z, 5, linkage), brute_linkage(z, 5, linkage)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == 5
    assert len(set(clusters.agglomerate(z, None, linkage, threshold=1e9))) == 1 and len(set(clusters.agglomerate(z, None, linkage, threshold=0.0))) == 25


def test_options_of_clusterers():
    rng = np.random.default_rng(7)
    z = rng.random((200, 3))
    run = lambda kind, **kw: clusters.CLUSTERERS[kind](z, {"n_clusters": 6} | kw).tolist()
    assert run("sklearnkmeans", max_iter=1) != run("sklearnkmeans") != run("sklearnkmeans", init="random", random_state=4)
    spread = lambda label: sum(((z[np.array(label) == j] - z[np.array(label) == j].mean(0)) ** 2).sum() for j in set(label))
    assert spread(run("sklearnkmeans", n_init=8)) <= spread(run("sklearnkmeans")) and spread(run("faisskmeans", nredo=8)) <= spread(run("faisskmeans", nredo=1))
    assert run("faisskmeans", spherical=True) != run("faisskmeans") and run("balancedkmeans", distance="euclidean") != run("balancedkmeans")
    assert run("sklearnminibatchkmeans", batch_size=20, max_iter=1) != run("sklearnminibatchkmeans", batch_size=200)
    given = z[:6].tolist()
    assert len(set(run("sklearnkmeans", init=given, max_iter=1))) == 6


def test_large_nodes(spark, monkeypatch):
    from brindle.plans import model

    rng = np.random.default_rng(8)
    centres = np.eye(4)
    z = centres[rng.integers(4, size=400)] + 0.05 * rng.standard_normal((400, 4))
    nodes = spark.createDataFrame([(k % 2, k, v.tolist()) for k, v in enumerate(z)] + [(7, 1000, [1.0, 0.0, 0.0, 0.0])], "node long, label_id long, z array<double>")
    monkeypatch.setattr(clusters, "NODE_LABELS", 100)
    monkeypatch.setattr(clusters, "SAMPLE_LABELS", 60)
    for kind, n in (("balancedkmeans", 2), ("sklearnkmeans", 4)):
        got = clusters.cluster_nodes(nodes, {"type": kind, "kwargs": {"n_clusters": n}}, 5).collect()
        sizes = {}
        for r in got:
            sizes.setdefault((r["node"], r["cluster"]), []).append(r["label_id"])
        assert len(got) == 400 and len(sizes) == 2 * n
        if kind == "balancedkmeans":
            assert all(abs(len(x) - 100) <= 1 for x in sizes.values())
        else:
            assert all(len({int(z[k].argmax()) for k in x}) == 1 for x in sizes.values())
    x = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(z)], "node long, mention_id long, vec array<double>")
    targets = spark.createDataFrame([(0, k, [int(v.argmax() < 2)]) for k, v in enumerate(z)], "node long, mention_id long, clusters array<int>")
    whole = {r["cluster"]: r for r in model.fit_matchers(x, targets, None).collect()}
    monkeypatch.setattr(model, "NODE_ROWS", 100)
    parts = {r["cluster"]: r for r in model.fit_matchers(x, targets, None).collect()}
    assert set(parts) == set(whole) == {0, 1}
    for c in (0, 1):
        a, b = ((z @ np.array(m[c]["coef"]) + m[c]["intercept"] > 0) for m in (whole, parts))
        assert (a == b).all() and (a == (z.argmax(1) < 2) ^ (c == 0)).all()
    forest = model.fit_matchers(x, targets, {"type": "sklearnrandomforestclassifier", "kwargs": {"n_estimators": 3}}).collect()
    assert {r["cluster"] for r in forest} == {0, 1}

    class Other(classifiers.Classifier):
        """A type of which nothing is known."""

    monkeypatch.setitem(classifiers.CLASSIFIERS, "other", Other)
    with pytest.raises(ValueError):
        model.fit_matchers(x, targets, {"type": "other"})


def test_options_of_encoders(spark):
    for wrong in ({"vectorizer": {"type": "other"}}, {"vectorizer": {"kwargs": {"analyzer": "char"}}}, {"vectorizer": {"kwargs": {"nonsense": 1}}}, {"dimension": {"kwargs": {"tol": 0.1}}}, {"flag": 4}):
        with pytest.raises(ValueError):
            encoders.TextEncoder(**({"flag": 1} | wrong))
    rows = spark.createDataFrame([(0, "red red blue"), (1, "red green"), (2, "blue blue blue")], "query_id long, text string")
    values = lambda **kw: {(r["query_id"], r["feature"]): r["value"] for r in encoders.TextEncoder(vectorizer={"kwargs": {"ngram_range": (1, 1), "max_df": 1.0} | kw}, flag=1).fit(rows, "query_id", "text")._weights(rows, "query_id", "text").collect()}
    base = values(use_idf=False, norm=None)
    assert base == {(0, 0): 1, (0, 2): 2, (1, 1): 1, (1, 2): 1, (2, 0): 3}
    assert values(use_idf=False, norm=None, binary=True) == dict.fromkeys(base, 1)
    assert values(use_idf=False, norm=None, sublinear_tf=True)[2, 0] == pytest.approx(1 + np.log(3))
    assert set(values(use_idf=False, norm=None, min_df=2)) == {(0, 0), (0, 1), (1, 1), (2, 0)} and len(values(max_df=1)) == 1
    assert values(use_idf=False, norm="l1")[0, 2] == pytest.approx(2 / 3) and values(smooth_idf=False, norm=None)[1, 1] == pytest.approx(np.log(3) + 1)
    assert len(values(stop_words=["red"])) == 3


def test_wide_svd_and_saved_encoder(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((60, 12)) * np.arange(12, 0, -1)
    long = spark.createDataFrame([(k, f, float(v)) for k, row in enumerate(a) for f, v in enumerate(row)], "id long, feature int, value double")
    basis, values = encoders.random_svd(long, "id", 4, more=6)
    want = np.linalg.svd(a, full_matrices=False)
    got = np.array([r["vec"] for r in basis.orderBy("feature").collect()])
    assert np.allclose(values, want[1][:4], rtol=1e-4) and np.allclose(np.abs((got * want[2][:4].T).sum(0)), 1, atol=1e-3)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]
    rows = spark.createDataFrame([(k, " ".join(rng.choice(words, 1 + k % 7))) for k in range(120)] + [(500, "")], "query_id long, text string")
    table = lambda e: {r["query_id"]: r["vec"] for r in e.transform(rows, "query_id", "text").collect()}
    whole = encoders.TextEncoder(dimension={"kwargs": {"n_components": 300}}, flag=1).fit(rows, "query_id", "text")
    near = lambda t: np.array([t[k] for k in range(120)]) @ np.array([t[k] for k in range(120)]).T
    small = near(table(whole))
    whole.save(str(tmp_path / "encoder"), spark)
    assert np.allclose(near(table(encoders.TextEncoder.load(spark, str(tmp_path / "encoder")))), small) and not any(table(whole)[500])
    monkeypatch.setattr(encoders, "MOST_BASIS", 1)
    assert np.allclose(near(table(whole)), small)


def test_batches_shrink_where_memory_runs_out(spark):
    asked = []

    def encode(texts):
        asked.append(len(texts))
        if len(texts) > 3:
            raise MemoryError
        return np.array([[len(t), 1.0] for t in texts])

    got = encoders.encode_in_batches(encode, ["x" * k for k in range(7)], 8, retries=9)
    assert got[:, 0].tolist() == list(range(7)) and max(asked) == 7
    with pytest.raises(RuntimeError):
        encoders.encode_in_batches(lambda texts: (_ for _ in ()).throw(MemoryError()), ["x"], 8)
    with pytest.raises(ZeroDivisionError):
        encoders.encode_in_batches(lambda texts: 1 / 0, ["x"], 8)
    encoders.register_loader("loaded", lambda: lambda texts: np.array([[1.0, len(t)] for t in texts]))
    rows = spark.createDataFrame([(0, "some text"), (1, None)], "query_id long, text string")
    got = encoders.TextEncoder(transformer={"type": "loaded", "kwargs": {"batch_size": 1}}, flag=3).transform(rows, "query_id", "text").orderBy("query_id").collect()
    assert got[1]["vec"] == [1.0, 0.0]


def test_parts_are_kept_by_kind(spark, tmp_path):
    from brindle.plans import parts

    table = spark.createDataFrame([(0, 1, [1.0], 0.0, None)], "node long, cluster int, coef array<double>, intercept double, model string")
    parts.Matcher(table, {"type": "linear_l2"}).save(str(tmp_path / "m"))
    assert parts.Matcher.load(spark, str(tmp_path / "m")).config == {"type": "linear_l2"}
    with pytest.raises(ValueError):
        parts.Ranker.load(spark, str(tmp_path / "m"))
    trees = spark.createDataFrame([(0, 1, k, [float(k % 2)], int(k % 2)) for k in range(60)], "node long, label_id long, mention_id long, vec array<double>, cluster int")
    targets = trees.select("node", "mention_id", F.array("cluster").alias("clusters"))
    forest = parts.Matcher.train(trees.select("node", "mention_id", "vec"), targets, {"type": "sklearnrandomforestclassifier", "kwargs": {"n_estimators": 3}})
    found = forest.predict_proba(trees.select("node", "mention_id", "vec", F.col("cluster").alias("own")))
    assert all((r["score"] > 0.5) == (r["own"] == r["cluster"]) for r in found.collect())


def test_few_candidates_are_filled_up(spark):
    dots = spark.createDataFrame([(1, "b", 0.5), (1, "f", 0.7), (2, "a", 1e-9)], "q long, l string, score double")
    names = spark.createDataFrame([(c,) for c in "gfedcbaa"], "l string")
    asked = spark.range(1, 4).withColumnRenamed("id", "q")
    got = vectors.top_k_of_candidates(dots, asked, names, "q", "l", 4)
    assert sorted((r["q"], r["rank"], r["l"], r["score"]) for r in got.collect()) == [
        (1, 1, "f", 0.7), (1, 2, "b", 0.5), (1, 3, "a", 0.0), (1, 4, "c", 0.0), *((q, k + 1, c, 0.0) for q in (2, 3) for k, c in enumerate("abcd"))
    ]


def test_variables_are_kept_by_kind(spark):
    from brindle.sources import variables

    store = variables.KeptVariables(spark)
    for value in ([1, "a", None], {"k": [1.5]}, [], {}):
        assert store.load(store.save(value)) == value
    for array in (np.arange(12, dtype=np.int16).reshape(3, 4), np.empty((0, 2))):
        again = store.load(store.save(array))
        assert again.dtype == array.dtype and again.shape == array.shape and (again == array).all()
    kept = store.save(spark.range(3))
    assert store.load(kept).count() == 3
    store.delete(kept)
    store.delete(kept)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        store.load(kept)
    with pytest.raises(TypeError):
        store.save("text")
    store.delete_all()


def test_large_variables_go_in_pieces(spark, monkeypatch):
    from brindle.sources import variables

    monkeypatch.setattr(variables, "PIECE", 64)
    store = variables.KeptVariables(spark)
    long = [f"entry {k}" for k in range(100)]
    assert store.load(store.save(long)) == long


def test_fused_clusters_of_other_rankers(spark):
    """Rankers that aren't linear are asked as linear ones are."""
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, vec array<double>")
    z = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (0, 2, [0.6, 0.8])], "node long, label_id long, z array<double>")
    own = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 1)], "node long, label_id long, cluster int")
    matchers = spark.createDataFrame([(0, 0, [1.0, 0.0], 0.0, None), (0, 1, [0.0, 1.0], 0.0, None)], "node long, cluster int, coef array<double>, intercept double, model string")
    edges = spark.createDataFrame([], "node long, cluster int, child long")
    names = z.select("label_id", F.col("label_id").cast("string").alias("label"))
    asked = dict(dictionary=names, embeddings=z.select("label_id", "z"), clusters=own, matchers=matchers, edges=edges, node_labels=z)
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(80, 4))
    learner = classifiers.CLASSIFIERS["sklearnrandomforestclassifier"](n_estimators=3, random_state=1).fit(rows, (rows[:, 0] > 0).astype(float))
    rankers = spark.createDataFrame([(0, 2, None, None, "never"), (0, 1, None, None, learner.dumps())], "node long, label_id long, coef array<double>, intercept double, model string")
    model = XModel.from_tables(1, rankers=rankers, **asked)
    model.config["ranker"] = {"type": "sklearnrandomforestclassifier"}
    got = {(r["query_id"], r["cluster"]): r["score"] for r in model.fused_clusters(0, x, "geometric").collect()}
    vectors_, labels_ = {0: [1.0, 0.0], 1: [0.0, 1.0]}, {0: (0, [1.0, 0.0]), 1: (1, [0.0, 1.0]), 2: (1, [0.6, 0.8])}
    want = dict.fromkeys(got, 0.0)
    for q, v in vectors_.items():
        for c, own_z in labels_.values():
            m, r = 1 / (1 + np.exp(-v[c])), learner.predict_proba(np.array([v + own_z]))[0, 1]
            want[q, c] += m**0.5 * min(max(r, 1e-6), 1) ** 0.5
    assert len(got) == 4 and got == pytest.approx(want)
