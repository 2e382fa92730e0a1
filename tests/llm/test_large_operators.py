"""Near duplicates, repeats, quality, neighbours and the pipeline, against brute force or planted cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import chat, fingerprints, html_text, mixing, near_dups, neighbours, packing, quality, queries, repeats, sharding, words
from brindle.llm.words import Words, minhashes, shingles
from tests.conftest import SF

WORDS = re.compile(r"[a-z0-9_\u0080-\U0010ffff]+")


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def shingle_set(text):
    w = WORDS.findall((text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows, threshold=0.8):
    """class_id, n_links, n_texts, copies of rows (id, text), comparing all pairs."""
    words = [tuple(WORDS.findall((t or "").lower())) for _, t in rows]
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links, others = Counter(), defaultdict(set)
    for i in range(n):
        for j in range(i):
            same = words[i] == words[j]
            union = len(sets[i] | sets[j])
            if same or union and len(sets[i] & sets[j]) / union >= threshold:
                for a, b in ((i, j), (j, i)):
                    links[a] += 1
                    if not same:
                        others[a].add(words[b])
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for k in range(n):
        ids[root(k)].append(rows[k][0])
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    copies = Counter(words)
    return Counter((rows[k][0], least[root(k)], links[k], len(others[k]), copies[words[k]]) for k in range(n))


def near_rows():
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = sentence(rng, rng.choice([3, 6, 20, 60, 300])).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            rows.append(rng.choice([" ", "\n", "  "]).join(copy))
    rows += ["", None, " \n", "!!!", "one", "One", "one two three four", "ONE, two three four.", "Ünï cödé wörds hërë ärë fïvë", "ünï cödé wörds hërë ärë fïvë", "a " * 30000, "a " * 29000]
    rng.shuffle(rows)
    out = [(k, t) for k, t in enumerate(rows)]
    return [*out, out[3], out[3], (None, out[5][1]), (None, "nobody else's text at all here")]


@pytest.fixture(scope="module")
def similar(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in near_rows()], "doc_id long, text string, node string, copies int, bands int")


@pytest.mark.parametrize("tile, bucket", [(512, 4096), (2, 2)])
def test_similar_documents(spark, similar, tile, bucket, monkeypatch):
    monkeypatch.setattr(near_dups, "TILE", tile)
    monkeypatch.setattr(near_dups, "BUCKET_TILE", bucket)
    got = near_dups.similar_documents(similar).drop("text_hash", "class_node")
    assert Counter(map(tuple, got.collect())) == brute_classes(near_rows())


def test_similar_documents_of_nothing(similar):
    assert near_dups.similar_documents(similar.limit(0)).collect() == []


def test_similar_documents_at_small_scale(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op7_near_dups(spark, SF).collect())) == brute_classes(rows)


def test_crowded_buckets_meet_by_longer_keys(spark):
    """Signatures that share one band and nothing else don't meet again; those of alike texts do."""
    rng = np.random.default_rng(12)
    n = near_dups.BANDS * near_dups.ROWS
    values = rng.integers(0, 2**16, (3000, n)).astype(np.uint16)
    values[:, :5] = 7  # the band
    for k in range(0, 200, 2):
        same = rng.random(n) < 0.85
        values[k + 1, same] = values[k, same]
    table = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(values)], "node long, signature binary")
    keyed = table.mapInArrow(near_dups._long_keys, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    met = near_dups._met(keyed).collect()
    together = defaultdict(set)
    for r in met:
        together[r["key"]].add(r["node"])
    pairs = {tuple(sorted(x)) for x in together.values()}
    assert {(k, k + 1) for k in range(0, 200, 2)} <= pairs and len(pairs) <= 110 and max(r["tiles"] for r in met) == 1


def test_texts_that_only_resemble_each_other_are_not_compared(spark, monkeypatch):
    # a chain in which neighbours share three fifths of their shingles: under the bands, not near the threshold
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(12_000)]
    rows = [(k, " ".join(words[25 * k : 25 * k + 100])) for k in range(400)]
    seen = []
    real = near_dups.components
    monkeypatch.setattr(near_dups, "components", lambda edges: seen.append(edges.count()) or real(edges))
    got = near_dups.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in got) and seen[0] < 100


def brute_buckets(rows, width=5):
    """Pairs of different word sequences whose similarity is 0.8 or more, found from shared shingles."""
    sets = {}
    for _, t in rows:
        w = tuple(WORDS.findall((t or "").lower()))
        if w:
            sets.setdefault(w, {hash(x) for x in shingle_set(t)})
    where = defaultdict(list)
    listed = list(sets)
    for k, w in enumerate(listed):
        for x in sets[w]:
            where[x].append(k)
    common = Counter()
    for own in where.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[a, b] += 1
    return {frozenset((listed[a], listed[b])) for (a, b), n in common.items() if n / (len(sets[listed[a]]) + len(sets[listed[b]]) - n) >= 0.8}


def test_similar_documents_at_middle_scale(spark):
    sf = SF.replace("0.001", "0.01")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    links = brute_buckets(rows)
    words = {i: tuple(WORDS.findall((t or "").lower())) for i, t in rows}
    others = Counter(w for pair in links for w in pair)
    copies = Counter(words.values())
    docs = Counter()
    for pair in links:
        a, b = pair
        docs[a] += copies[b]
        docs[b] += copies[a]
    got = {r["doc_id"]: r for r in queries.op7_near_dups(spark, sf).collect()}
    assert len(got) == len(rows) and links
    for i, w in words.items():
        assert (got[i]["n_texts"], got[i]["copies"], got[i]["n_links"]) == (others[w], copies[w], docs[w] + copies[w] - 1)
    for a, b in map(tuple, links):
        assert len({got[i]["class_id"] for i, w in words.items() if w in (a, b)}) == 1


def test_exact_counts_both_ways():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert near_dups.common_counts(sets, i, j).tolist() == want  # many pairs: products
    assert near_dups.common_counts(sets, i[:3], j[:3]).tolist() == want[:3]


def test_pruning_keeps_what_it_should():
    # the posterior after all values, by summing the density
    grid = (np.arange(100_000) + 0.5) / 100_000
    for n in (15, 60, 150):
        m = near_dups.least_matches(0.8, n)
        for matches, enough in ((m, True), (m - 1, False)):
            density = np.exp(matches * np.log(grid) + (n - matches) * np.log1p(-grid))
            assert (density[grid >= 0.8].sum() / density.sum() >= near_dups.TOLERANCE) == enough


def test_minhashes_estimate_similarity():
    rng = random.Random(1)
    base = sentence(rng, 400, 10**6).split()
    texts = [" ".join(base), " ".join(base[40:] + sentence(rng, 40, 10**6).split()), ""]
    hashes, begins = shingles(Words(texts))
    assert [len(set(hashes[begins[k] : begins[k + 1]].tolist())) for k in range(3)] == [len(shingle_set(t)) for t in texts]
    values = minhashes(hashes, begins, 2000)
    true = len(shingle_set(texts[0]) & shingle_set(texts[1])) / len(shingle_set(texts[0]) | shingle_set(texts[1]))
    assert abs((values[0] == values[1]).mean() - true) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, 500)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r["node"]: r["component"] for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = [k for k in parent if k != 500 and sum(k in e and e[0] != e[1] for e in edges)]
    assert set(got) == set(nodes)
    assert len({(root(k), got[k]) for k in nodes}) == len({root(k) for k in nodes}) == len(set(got.values()))


def norm(s):
    return tuple(WORDS.findall(s.lower()))


def sentences(line):
    """Ranges of a line's sentences; those without words go with the one before."""
    cuts = sorted({0, len(line), *(m.end() for m in re.finditer(r"[.!?][ \t\r]+", line))})
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if out and not (norm(line[a:b]) and norm(line[out[-1][0] : out[-1][1]])):
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def brute_repeats(texts, least):
    """The text left and the ranges that go, for each of texts in order, in plain Python."""
    seen, out = set(), []
    for text in texts:
        text, at, units = text or "", 0, []  # line, its range, its words, the sentence's range and words
        for k, line in enumerate(text.split("\n")):
            stop = min(at + len(line) + 1, len(text))
            if norm(line):
                units += [(k, (at, stop), norm(line), (at + a, at + b), norm(line[a:b])) for a, b in sentences(line)]
            at += len(line) + 1
        gone, flags = set(), []
        for k, line in {u[0]: u[2] for u in units}.items():
            if ("line", line) in seen:
                gone.add(k)
            seen.add(("line", line))
        for u in units:
            flags.append(u[4] in seen)
            seen.add(u[4])
        begin = 0
        while begin < len(units):
            end = begin
            while end < len(units) and flags[end]:
                end += 1
            if least is None or sum(len(u[4]) for u in units[begin:end] if len(u[4]) >= 4) < least:
                flags[begin:end] = [False] * (end - begin)
            begin = max(end, begin + 1)
        flags = [f or u[0] in gone for f, u in zip(flags, units, strict=True)]
        whole = {k for k in {u[0] for u in units} if all(f for f, u in zip(flags, units, strict=True) if u[0] == k)}
        cut = []
        for f, u in zip(flags, units, strict=True):
            a, b = u[1] if u[0] in whole else u[3]
            if f and cut and (cut[-1][1] == a or cut[-1] == [a, b] or cut[-1][1] == b):
                cut[-1][1] = b
            elif f:
                cut.append([a, b])
        left, at = "", 0
        for a, b in cut:
            left, at = left + text[at:a], b
        out.append((left + text[at:], [tuple(x) for x in cut]))
    return out


def removed(rows):
    return [(r["text"], [tuple(x) for x in r["removed"]]) for r in rows]


@pytest.mark.parametrize("least", [None, 1, repeats.PASSAGE_WORDS])
def test_repeats_at_small_scale(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    want = brute_repeats(texts, least)
    assert removed(repeats.remove_repeats(docs, least).orderBy("doc_id").collect()) == want
    assert sum(len(x) for _, x in want) > 50


def test_repeats_of_planted_passages(spark):
    rng = random.Random(7)
    passage = [sentence(rng, 55, 10**6) + ".", sentence(rng, 70, 10**6).replace(" ", ". ", 3) + "!"]
    own = lambda n: sentence(rng, n, 10**6) + "."
    line = "All rights reserved by us."
    rows = [
        (1, f"{own(30)} {passage[0]} {own(20)}\n{line}\n{own(9)}"), (2, f"{own(10)} {passage[0].upper()} {own(12)}\n- {line}"), (3, f"{own(12)}\n{passage[0]}\n\n{own(8)}\n{line}\n{line}"),
        (4, own(40) + " İİ ẞ K " + own(3)), (5, f"İstanbul Ⱥ {own(5)} {passage[1]}"), (6, f"{passage[1]}\n{own(5)} é🙂 x. {passage[1]} ß {own(7)}"), (7, ""), (8, None), (9, passage[0]),
        (10, "\n . \n?!\n"), (11, "one. two. three. one. two. three."), (12, "one. two.\n\n\nthree."), (13, "x. \n y.  z. ... \n"), (14, (own(300) + " ") * 40),
    ]
    table = spark.createDataFrame([(i, t, 0, 0, "r") for i, t in rows], "doc_id long, text string, unit int, digest int, Removed string").repartition(4)
    for least in (None, 1, 40):
        got = repeats.remove_repeats(table, least).orderBy("doc_id").collect()
        want = brute_repeats([t for _, t in rows], least)
        assert [(r["text"] or "", [tuple(x) for x in r["removed"]]) for r in got] == want
        for (_, given), r in zip(rows, got, strict=True):
            kept, at = [], 0
            for x in r["removed"]:
                kept.append(given[at : x["start"]])
                at = x["end"]
            assert r["text"] == (None if given is None else "".join([*kept, given[at:]]))
    by = {r["doc_id"]: r["text"] for r in got}
    assert by[1] == rows[0][1] and by[8] is None and by[9] == "" and passage[0] not in by[3] and passage[0].upper() not in by[2] and passage[1] not in by[6] and "é🙂" in by[6]
    assert repeats.remove_repeats(table.limit(0)).collect() == []


def test_passages_between_words_and_lines_by_chance(spark):
    """A passage of 55 words goes from between the words of a line, but for its broken sentences; a short line of two documents stays if lines have a least length."""
    rng = random.Random(8)
    own = lambda n: sentence(rng, n, 10**6)
    passage = [own(14) + ".", own(13) + ".", own(13) + ".", own(15)]
    long = own(25)
    rows = [(1, f"{own(8)} {' '.join(passage)} {own(9)}.\nThe end.\n{long}"), (2, f"{own(9)} {' '.join(passage)} {own(7)}.\nThe end.\n{own(6)}\n{long}"), (3, f"{own(9)}.\nThe end.")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(table, repeats.PASSAGE_WORDS, line_words=repeats.LINE_WORDS).collect()}
    assert [got[k]["text"] for k in (1, 3)] == [rows[0][1], rows[2][1]] and got[1]["removed"] == got[3]["removed"] == []
    assert passage[1] not in got[2]["text"] and passage[2] not in got[2]["text"] and "The end." in got[2]["text"] and long not in got[2]["text"]
    cut = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(table, repeats.PASSAGE_WORDS).collect()}
    assert all("The end." not in cut[k] for k in (2, 3))


def test_repeats_of_repeated_ids(spark):
    rows = [(9, "a line"), (9, "a line"), (9, "other text"), (None, "a line\nx"), (None, "other text"), ("s", "z")]
    for kind, cast in (("long", lambda i: None if i == "s" else i), ("string", lambda i: None if i is None else str(i))):
        table = spark.createDataFrame([(cast(i), t) for i, t in rows], f"doc_id {kind}, text string")
        got = Counter((r["doc_id"], r["text"]) for r in repeats.remove_repeats(table).collect())
        nine = cast(9)
        assert got == Counter({(nine, "a line"): 2, (nine, "other text"): 1, (None, "x"): 1, (None, ""): 1, (cast("s"), "z"): 1})


def test_workers_hold_few_texts():
    texts = ["x" * n for n in (5, 0, 90, 3, 300, 1, 1, 60)] + [None, "é" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["id", "text"])
    parts = list(words.sliced([batch, batch.slice(0, 0), batch.slice(3, 2)], 3, 100))
    assert [p.num_rows for p in parts] == [3, 1, 1, 3, 2, 1, 1]
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(10), 3, 4]
    assert [t for p in parts for t in p.column(1).to_pylist()] == [*texts, *texts[3:5]]


def test_units_don_t_depend_on_their_batch():
    rng = random.Random(3)
    texts = [sentence(rng, n).replace(" ", ". ", n // 7) for n in (0, 1, 2, 50, 500)] + ["\n\n a b. \n c", "x"]
    together = repeats.Units(texts)
    for k, t in enumerate(texts):
        alone = repeats.Units([t])
        low, high = together.first[k], together.first[k + 1]
        for name, base in (("digest", 0), ("words", 0), ("start", together.at[k]), ("end", together.at[k])):
            assert getattr(alone, name).tolist() == (getattr(together, name)[low:high] - base).tolist(), name


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {r["doc_id"]: r for r in queries.op6_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if rows[r["doc_id"]]["held_out"]]
    assert len(held) > 40 and np.mean([rows[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_rules_as_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.98 and 0 < len(model.rules) < 40
    table = spark.createDataFrame(x.tolist(), "a double, b double, c double").coalesce(1)
    got = [r[0] for r in table.select(model.score({n: F.col(n) for n in "abc"})).collect()]
    assert np.allclose(got, model.predict(x))


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(8)
    r = (rng.random((300, 12)) > 0.5).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1)))).astype(float)
    b, w = quality.lasso_logistic(r, y, 0.02)
    pull = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert (np.abs(pull[w == 0]) <= 0.0201).all() and np.allclose(pull[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)
    assert 0 < (w != 0).sum() < 12


def test_quality_of_odd_rows(spark):
    table = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b. " * 40000, "x"), (1, None, "x")], "doc_id long, text string, SCORE string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train_quality(table, none)
    got = quality.score_documents(table, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    some = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, quality int")
    assert quality.score_documents(table.limit(0), quality.train_quality(table, some)).collect() == []


def brute_nearest(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    out = {}
    for q, v in good:
        if q is None or q % every:
            continue
        near = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), i is None, i or 0) for i, w in good if i != q and len(w) == len(v))
        out[q] = [(s, None if gone else i) for s, gone, i in near[:k]]
    return out


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(120)]
    rows += [(200, None), (250, []), (300, [0.0] * 8), (350, [1.0] * 7 + [None]), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, [1.0, 2.0]), (501, [2.0, 4.0]), (None, rows[7][1]), (130, rows[50][1]), (131, rows[50][1]), (600, rows[50][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, shard int")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 12), r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == brute_nearest(rows)
    assert neighbours.nearest_neighbours(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_neighbours_in_cells(spark, hot):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 32))
    x = centres[rng.integers(200, size=30_000)] + 0.25 * rng.standard_normal((30_000, 32))
    if hot:
        x[:10_000] = x[0] + 0.001 * rng.standard_normal((10_000, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    units = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 30_000, 100):
        near = units @ units[q]
        near[q] = -9
        hits += len(got[q] & set(np.argsort(-near, kind="stable")[:5].tolist()))
    assert hits >= 0.93 * 5 * 300
    # few cells are asked, and few rows of a cell are candidates
    sample = x[rng.permutation(30_000)[:8192]]
    routes, reach = neighbours.fit_routes(sample, 5, 4, 0.98)
    asked = np.mean([routes.weight[c].sum() for c in routes.asked(sample[:200], reach)])
    part = x[routes.cell(x) == int(np.argsort(routes.weight)[len(routes.weight) // 2])][:8192]
    assert asked * neighbours.fit_share(part, 5, 0.98) < 0.1


def test_cells_are_prefixes():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 12)) * np.arange(12, 0, -1)
    routes = neighbours.Routes(x, 40)
    cell = routes.cell(x)
    bits = routes.project(x) > 0
    assert len(set(cell.tolist())) == len(routes.starts) > 30
    for c in range(len(routes.starts)):
        n = routes.size[c]
        same = (bits[:, :n] == (routes.signs[c, :n] > 0)).all(1)
        assert (same == (cell == c)).all()
    for q, asked in zip(range(20), routes.asked(x[:20], 0.5), strict=True):
        assert asked[0] == cell[q] and sorted(set(asked.tolist())) == sorted(asked.tolist())
        assert len(routes.asked(x[q : q + 1], 1.0)[0]) == len(routes.starts)


def test_recall_of_neighbours(spark):
    sf = SF.replace("0.001", "0.1")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows)
    got = defaultdict(dict)
    for r in queries.op2_neighbours(spark, sf).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = sum(i in got[q] for q, near in want.items() for _, i in near)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in want.items():
        for s, i in near:
            assert i not in got[q] or abs(got[q][i] + s) < 1e-11


def test_forest_follows_prefixes():
    rng = np.random.default_rng(10)
    vectors = rng.standard_normal((300, 16))
    forest = neighbours.Forest(vectors, trees=1)
    hashes = neighbours.strings(vectors, 1, 29)[0]
    for q, found in zip(range(20), forest.candidates(vectors[:20], 10), strict=True):
        prefix = lambda a, b: 64 - (int(a) ^ int(b)).bit_length()
        shared = np.array([prefix(hashes[q], h) for h in hashes])
        level = max(x for x in range(65) if (shared >= x).sum() >= 10)
        assert found.tolist() == np.flatnonzero(shared >= level).tolist()


@pytest.fixture(scope="module")
def pipeline_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("tables")
    passage = sentence(rng, 60, 10**6)
    docs, labels = [], []
    for k in range(240):
        text = sentence(rng, rng.choice([5, 40, 120]), 10**6) + "."
        if k % 6 == 5:
            text = " ".join(f"{w}%%%" for w in text.split())
        if k % 20 == 3:
            text = docs[-1][1] if k % 40 == 3 else docs[-1][1] + " more words"
        if k % 50 in (7, 8):
            text = f"{text} {passage}. {sentence(rng, 5, 10**6)}"
        docs.append((k, text, "en", f"s{k % 4 if k % 3 else 0}", len(text)))
        if k % 2:
            labels.append((k, int("%%%" not in text), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, passage


def removed_texts(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def brute_stage(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [(r["doc_id"], t) for r, (t, _) in zip(rows, brute_repeats([r["text"] for r in rows], repeats.PASSAGE_WORDS), strict=True)]


def test_pipeline_stages(spark, pipeline_dir):
    folder, docs, passage = pipeline_dir
    text = {r[0]: r[1] for r in docs}
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    names = kept.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, kept, folder)
    assert good.columns == names and sorted(r[0] for r in good.collect()) == [k for k, t in text.items() if "%%%" not in t]
    one = stages[1](spark, good, folder)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert one.columns == names and sorted(r[0] for r in one.collect()) == sorted({c for _, c, *_ in classes})
    cut = stages[2](spark, one, folder)
    rows = cut.collect()
    assert cut.columns == names and len(rows) == one.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    first = min(r["doc_id"] for r in rows if passage in text[r["doc_id"]])
    assert all((passage in r["text"]) == (r["doc_id"] == first) for r in rows if passage in text[r["doc_id"]])
    assert Counter(map(str, removed_texts(rows))) == Counter(map(str, brute_stage(one.collect())))
    mixed = stages[3](spark, cut, folder)
    plan = {r["doc_id"]: r for r in mixing.mix_documents(cut).collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    for k, r in plan.items():
        assert times[k] == r["epochs"] + (r["part"] > 0 and 2 * r["part"] >= r["size"])
    assert mixed.columns == names
    packed = stages[4](spark, mixed, folder).collect()
    starts = Counter(r["doc_id"] for r in packed if r["start"] == 0)
    assert starts == times
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(packed)


def test_pipeline_keeps_one_of_repeated_rows(spark, pipeline_dir):
    folder, _, _ = pipeline_dir
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (3, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r[0]) for r in corpus_pipeline.keep_one_of_similar(spark, table, folder).collect()) == ["1", "3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), folder).collect() == []
        stage(spark, table, folder).collect()


NAMES = "_id _label _start _value _score _predicted _source _end _epochs _place _times _tie _of_tie _units _key _hash _kept _n _counts _statistics _draw _bin _bucket _rank _at_0 _removed node bands size class_id"


@pytest.fixture(scope="module")
def clashing(spark, pipeline_dir):
    """Documents with columns that are called as operators might call theirs, each with its own name as value."""
    docs = spark.read.parquet(f"{pipeline_dir[0]}/documents.parquet")
    return docs.select("*", *(F.lit(n).alias(n) for n in NAMES.split()))


def kept_whole(rows, names):
    rows = rows.collect()
    assert rows and all(r[n] == n for r in rows for n in names)
    return rows


def test_names_that_clash(spark, clashing, pipeline_dir):
    folder, names = pipeline_dir[0], NAMES.split()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train_quality(clashing, labels)
    kept_whole(quality.score_documents(clashing, model), names)
    kept_whole(repeats.remove_repeats(clashing, 40), names)
    kept_whole(mixing.take_documents(clashing), names)
    pieces = packing.tokenize_documents(clashing, queries.tokenizer_path()).select("*", *(F.lit(n).alias(n) for n in names))
    kept_whole(packing.pack_pieces(pieces), names)
    n = clashing.count()
    assert sharding.shard_documents(clashing, n_shards=3).count() == fingerprints.fingerprint_edits(clashing).count() == near_dups.similar_documents(clashing).count() == n
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == clashing.columns, name
    kept_whole(docs, names)
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, folder).count() >= n


def test_string_ids_and_long_texts(spark):
    rng = random.Random(14)
    long = sentence(rng, 200_000, 10**6)
    rows = [(f"d{k}", t, "en", "s", 0) for k, t in enumerate([long, long + " more", "short text", None, "", long[:1_000_000] + ". end"])]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long")
    assert fingerprints.fingerprint_edits(docs).count() == sharding.shard_documents(docs, n_shards=2).count() == 6
    assert {r["class_id"] for r in near_dups.similar_documents(docs).collect() if r["doc_id"] in ("d0", "d1")} == {"d0"}
    assert removed(repeats.remove_repeats(docs, 40).orderBy("doc_id").collect())[2:3] == [("short text", [])]
    model = quality.train_quality(docs, spark.createDataFrame([], "doc_id string, quality int"))
    assert quality.score_documents(docs, model).count() == 6
    assert mixing.mix_documents(docs).agg(F.sum("size")).first()[0] > 400_000
    assert packing.pack_pieces(packing.tokenize_documents(docs, queries.tokenizer_path())).count() > 200
    page = spark.createDataFrame([("p", f"<article><p>{long}</article>")], "page_id string, html string")
    assert html_text.extract_pages(page).first()["text"] == long
    talk = spark.createDataFrame([("c", 0, "user", long), ("c", 1, "assistant", long)], "conv_id string, turn long, role string, text string")
    assert [r["targets"] for r in chat.read_windows(chat.format_conversations(talk)).orderBy("window").collect()] == [[], [long]]
