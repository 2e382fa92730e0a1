"""Sharding, packing, mixing, fingerprints, page text and chat, against brute force and by their invariants."""

import gc
import hashlib
import time
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, fingerprints, html_text, mixing, packing, queries, sharding
from tests import oracle
from tests.conftest import SF

ODD = [
    (0, "a b c", "en", "s1"), (1, None, None, None), (2, "", "en", "s1"), (3, "a b c", "en", "s2"), (3, "a b c", "en", "s2"), (4, "\n \t", "", ""), (5, "ﬁne  Straße\n", "de", "s1"),
    (6, "fine strasse", "de", "s1"), (7, "word " * 9000, "en", "s3"), (None, "no id", None, "s1"), (8, "<|endoftext|> it's 12 ½ 漢字 🙂", "zz", "s2"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, 2, 3, 4, 5) for r in ODD]
    # extra columns whose names operators might want to use
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, shard int, `group` int, slot int, `_bucket` int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_best_fit_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 60, 80).tolist(), reverse=True)
        got, n = sharding.best_fit_decreasing(sizes, 70)
        rooms, want = [], []
        for s in sizes:
            fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
            if fits:
                i = min(fits)[1]
            else:
                rooms.append(70)
                i = len(rooms) - 1
            rooms[i] -= s
            want.append(i)
        assert got == want and n == len(rooms)


def check_shards(rows, n_shards):
    by_text, slots, bytes_ = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        if r["size"] > 1:  # null and empty texts are different groups that look alike
            by_text[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(n_shards))
    return bytes_


def test_shards(spark, docs):
    rows = queries.op1_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    sizes = check_shards(rows, 8)
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.shard_documents(odd, n_shards=3).collect()
    assert len(rows) == len(ODD)
    check_shards(rows, 3)
    assert next(r for r in rows if r["doc_id"] == 1)["size"] == 1
    assert sharding.shard_documents(odd.limit(0), n_shards=3).collect() == []
    fixed = sharding.shard_documents(odd, capacity=100).collect()
    per = check_shards(fixed, 99)
    alone = next(r["shard"] for r in fixed if r["doc_id"] == 7)
    assert all(n <= 100 for s, n in per.items() if s != alone) and per[alone] == 45001


def test_shards_beside_a_hot_group(spark):
    rng = np.random.default_rng(13)
    texts = ["hot " * 25] * 500 + ["warm " * 20] * 250 + ["".join(map(chr, rng.integers(97, 123, 100))) for _ in range(750)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = sorted(check_shards(sharding.shard_documents(table, n_shards=8).collect(), 8).values())
    assert len(sizes) == 8 and sizes[6:] == [250 * 101, 500 * 101] and sizes[5] < 1.02 * sizes[0]


@pytest.mark.parametrize("asked", [{"n_shards": 60}, {"n_shards": 21}, {"capacity": 9000}])
def test_many_shards(spark, asked, monkeypatch):
    monkeypatch.setattr(sharding, "DRIVER_SHARDS", 20)
    monkeypatch.setattr(sharding, "CELL_SHARDS", 8)
    rng = np.random.default_rng(1)
    weight = {bytes([k % 256, k // 256]): int(rng.integers(50, 150)) for k in range(6000)} | {b"hot": 100_000, b"warm": 30_000}
    groups = spark.createDataFrame(list(weight.items()), "`group` binary, weight long")
    found, n = sharding.assign_shards(groups, **asked)
    rows = found.collect()
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += weight[bytes(r["group"])]
    assert len(rows) == len(weight) and sorted(sums) == list(range(n)) and n == asked.get("n_shards", n)
    least, *_, warm, hot = sorted(sums.values())
    if "capacity" in asked:
        assert sum(w <= 9000 for w in sums.values()) == n - 2 and (warm, hot) == (30_000, 100_000) and n < 1.15 * (sum(weight.values()) - 130_000) / 9000 + 2
    else:
        assert hot == 100_000 and sorted(sums.values())[-3] < 1.3 * least


def test_even_spread():
    assert sharding.spread_evenly([], 3) == [] and sharding.spread_evenly([5, 4], 1) == [0, 0]
    assert sharding.spread_evenly([90, 40, 3, 3, 2, 2], 4) == [0, 1, 2, 3, 2, 3]


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(2)
    for bins, depth in ((16, 3), (128, 4), (7, 2)):
        histogram = rng.integers(0, 50, bins + 1)
        histogram[0] = 0
        left = histogram.copy()
        for shape, times in packing.packing_plan(histogram, bins, depth):
            assert sum(shape) <= bins and times > 0
            for s in shape:
                left[s] -= times
        assert not left.any()


def test_least_squares_agrees_with_a_grid_of_starts():
    rng = np.random.default_rng(3)
    for _ in range(10):
        a, b = rng.random((12, 8)), rng.random(12)
        x = packing.nonnegative_least_squares(a, b)
        pull = a.T @ (b - a @ x)  # the conditions for the least
        assert (x >= 0).all() and (pull <= 1e-7).all() and np.abs(pull[x > 0]).max() < 1e-7


def check_pieces(rows, texts, tokenizer, window=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(by_sequence) * window


def test_words_are_kept_while_they_come_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    own = packing.WordTokenizer(queries.tokenizer_path())
    learned = Counter()
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda new: (learned.update(new), learn(new)))
    texts = [["a common word", "it's common 42"], ["common rare"], [], ["common", "it's other words, five of them", "漢字 common"], ["the common end"], ["more common words now"], ["common rare"]]
    for group in texts:
        assert own.ids(group) == [own.whole(t) for t in group]
    assert learned["common"] == 1 and learned["rare"] == 2 and len(own.older) + len(own.words) < 20


def test_words_are_split_as_the_tokenizer_does():
    own = packing.WordTokenizer(queries.tokenizer_path())
    plain = [chr(k) for k in [9, 10, 13, *range(32, 127), *range(0xA1, 0x180)] if k != 0x130]
    rng = np.random.default_rng(4)
    for signs in (plain, list("'’ \tsStTdDmMrReEvVlLx!.1²½éßſÀ\n"), [*plain, "漢", "\x00", "\xa0", "\x85", "İ", "e\u0301", "<|", "\x7f", "\x0b", "\x1c"]):
        texts = ["", "it'", "s", " 's's't", *("".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(300))]
        assert own.ids(texts) == [own.whole(t) for t in texts]
    assert own.ids([]) == [] and own.ids(["", ""]) == [b"", b""]


def test_known_words_take_little_memory():
    own = packing.WordTokenizer(queries.tokenizer_path())
    own.ids(["some words"])
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    text = " ".join("".join(letters[[k // 26**3 % 26, k // 676 % 26, k // 26 % 26, k % 26, k % 7]]) + "." for k in range(30_000))
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    own.ids([text])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 100 * 30_000


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    rows = queries.op3_packing(spark, SF).collect()
    space = check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, Tokenizer.from_file(queries.tokenizer_path()))
    assert sum(r["length"] for r in rows) > 0.93 * space


def test_packing_of_odd_rows(spark, odd):
    from tokenizers import Tokenizer

    one = odd.dropDuplicates(["doc_id"])
    pieces = packing.tokenize_documents(one, queries.tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))
    rows = packing.pack_pieces(pieces).collect()
    check_pieces(rows, {r["doc_id"]: r["text"] for r in one.collect()}, Tokenizer.from_file(queries.tokenizer_path()))
    assert packing.pack_pieces(pieces.limit(0)).collect() == []


def brute_mix(rows, weights=(5, 2, 1), most=3.0):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return sizes, target
        capped |= over


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(spark, docs, odd, which):
    table = {"docs": docs, "odd": odd}[which]
    rows = mixing.mix_documents(table).collect()
    given = table.collect()
    sizes, target = brute_mix(given)
    assert len(rows) == len(given)
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_documents(table.repartition(3)).collect()), key=str)


def test_mix_of_nothing(odd):
    assert mixing.mix_documents(odd.limit(0)).collect() == []


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints(spark, docs, odd, which, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_RANGE", 30)
    table = {"docs": docs, "odd": odd}[which]
    given = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows = fingerprints.fingerprint_edits(table).collect()
    assert len(rows) == len(given)
    want = Counter()
    for k, (id_, text) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        changed = fingerprints.edited(text, after)
        same = lambda a, b: float(fingerprints.canonical(a) == fingerprints.canonical(b))
        want[id_, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.digest(fingerprints.canonical(text)).hex(), fingerprints.digest(fingerprints.canonical(changed)).hex(), same(text, changed), same(text, after)] += 1
    assert Counter(map(tuple, rows)) == want
    grouped = fingerprints.fingerprint_documents(table).collect()
    forms = Counter(fingerprints.canonical(t) for _, t in given)
    assert Counter((r["doc_id"], r["group_size"]) for r in grouped) == Counter((i, forms[fingerprints.canonical(t)]) for i, t in given)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_of_wide_ids(spark, kind, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_RANGE", 20)
    rng = np.random.default_rng(3)
    ids = [*rng.integers(-(2**63), 2**63 - 1, 2000).tolist(), *range(2**62, 2**62 + 200), *[None] * 300, *[5] * 200]
    rows = [(i if i is None or kind == "long" else f"d{i}", f"text {k} " * (k % 5)) for k, i in enumerate(ids)]
    table = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    hashes = {(r[0], r[1]): r[2] for r in table.select("doc_id", "text", F.xxhash64("text")).collect()}
    least = 0 if kind == "long" else ""
    rows.sort(key=lambda r: (r[0] is not None, least if r[0] is None else r[0], hashes[r]))
    want = Counter((i, hashlib.sha256(fingerprints.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprint_edits(table).collect()) == want


def test_canonical_form():
    assert fingerprints.canonical("  ﬁNE  Straße \n") == "fine strasse"
    composed = unicodedata.normalize("NFC", "é")
    assert fingerprints.canonical(composed) == fingerprints.canonical(unicodedata.normalize("NFD", "É"))
    assert fingerprints.canonical(None) == fingerprints.canonical(" \n") == ""


def test_fingerprints_of_clashing_digests(spark, monkeypatch):
    # as if digests clashed: only lengths tell forms apart. Patched in the module and by the workers' copy.
    table = spark.createDataFrame([(0, "aa"), (1, "bb"), (2, "aa"), (3, "ccc")], "doc_id long, text string")
    forms = spark.createDataFrame([(bytearray(b"x"), bytearray(b"aa")), (bytearray(b"x"), bytearray(b"bb")), (bytearray(b"y"), None)], "digest binary, form binary")
    assert [bytes(r[0]) for r in fingerprints._clashing(forms).collect()] == [b"x"]
    real = table.mapInArrow(fingerprints._forms, "id long, digest binary, form binary").select("id", "digest")
    clashes = real.select("digest").distinct()
    named = fingerprints._told_apart(real, table.select("doc_id", "text"), clashes, "fingerprint").collect()
    assert len({r["fingerprint"] for r in named}) == 3


def test_fingerprints_of_nothing(odd):
    assert fingerprints.fingerprint_edits(odd.limit(0)).collect() == []
    assert fingerprints.fingerprint_documents(odd.limit(0)).collect() == []
    assert len(fingerprints.fingerprint_edits(odd.filter("doc_id = 8")).collect()) == 1


PAGES = [
    ("<article><p>One  <b>two</b>\nthree<p>four &amp; five</article><div class=comments><p>no</div>", "One two three\nfour & five"),
    ("<body><header>x</header><div id=main><h1>T</h1><p>A long text that is the page's own, with many words in it.</p><p>More of it.</p></div><aside>no</aside><form>no</form><footer>f</footer>", "T\nA long text that is the page's own, with many words in it.\nMore of it."),
    ("<script>var a = '<p>no</p>'</script><style>p{}</style><p>yes &lt;p&gt; &#233;</p><!-- no -->", "yes <p> é"),
    ("", ""), (None, ""), ("plain", "plain"), ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("<p>broken <b>tags <i>here<p>and there</x></b>", "broken tags here\nand there"),
    ("<nav><ul><li><a href=1>menu</a></ul></nav>", ""),
    ("<main><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></main>", "a\nb\nc\nd\ne"),
    ("<article><p>cut off in a tag <a href='x", "cut off in a tag"),
]


@pytest.mark.parametrize("source, want", PAGES)
def test_page_text(source, want):
    assert html_text.main_text(source) == want


def test_article_in_sibling_containers():
    paragraph = lambda k: f"{k} " + "some words of text " * 13
    section = lambda k, n: "<section>" + "".join(f"<p>{paragraph(k * 100 + i)}" for i in range(n)) + "</section>"
    menu = "<ul>" + "".join(f"<li><a href=/{k}>A page that is elsewhere {k}</a>" for k in range(8)) + "</ul>"
    want = "\n".join(["Title", *(paragraph(k * 100 + i).strip() for k, n in ((1, 10), (2, 10), (3, 4)) for i in range(n))])
    parts = f"<h1>Title</h1>{section(1, 10)}{section(2, 10)}{section(3, 4)}"
    assert html_text.main_text(f"<body>{menu}<div>{parts}{menu}</div>{menu}</body>") == want
    assert html_text.main_text(f"<body>{menu}{parts}{menu}</body>") == want


@pytest.mark.parametrize("around", ["<div class='content has-sidebar'>%s</div>", "<div class='layout with-header'>%s</div>", "<form id=aspnetForm>%s</form>", "<div id=page class='site search'>%s</div>"])
def test_names_that_hold_the_page(around):
    page = "<h2>Part</h2><p>Words of the page, many enough to be all of it.<p>And more of them.<div class=sidebar>not this</div>"
    want = "Part\nWords of the page, many enough to be all of it.\nAnd more of them."
    assert html_text.main_text(f"<body>{around % page}</body>") == want
    assert html_text.main_text(f"<body>{around % f'<article>{page}</article>'}<p>no</p></body>") == want


def test_parts_of_an_article_by_name():
    parts = "<p>Opening words, which are many.</p><section id=discussion><h2>Discussion</h2><p>It holds.</section><section id=related-work><p>Others did too.</section>"
    beside = "<div class=related><ul><li><a href=1>Another page</a></ul></div><section class=comments><p>First!</p></section><form><p>mail</form>"
    assert html_text.main_text("<div class=ad>Much more text than the article has.</div><article><p>Short.</article>") == "Short."
    assert html_text.main_text(f"<article>{parts}{beside}</article>") == "Opening words, which are many.\nDiscussion\nIt holds.\nOthers did too."


def test_readers_are_left_out_without_article_elements():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>A page that is elsewhere {k}</a>" for k in range(8)) + "</ul>"
    story, words = [f"Part {k} of it: " + "words " * 20 for k in range(3)], "".join(f"<p>Comment {k}: " + "other words " * 20 for k in range(9))
    want = "\n".join(x.strip() for x in story)
    body = "".join(f"<p>{x}" for x in story)
    for name in ("class=comments", "id=respond", "class='post replies'"):
        assert html_text.main_text(f"<body>{menu}<div class=story>{body}</div><section {name}>{words}</section></body>") == want, name
    for name in ("article side-by-side", "post reply", "content has-sidebar"):
        assert html_text.main_text(f"<body>{menu}<div class='{name}'>{body}</div></body>") == want, name
    assert html_text.main_text(f"<article><header><h1>Title</h1></header>{body}</article>") == "Title\n" + want
    assert html_text.main_text(f"<header><p>{story[0]}</p></header><div>{body}</div>") == want


def plain_densities(node):
    """(density, sum) of each node under one, from the formulas, by recursion."""
    import math

    def numbers(n):
        chars, tags, link_chars, link_tags = 0, 0, 0, 0
        for c in n.children:
            if isinstance(c, str):
                chars += sum(x != " " for x in c)
            elif not c.skip:
                a, b, d, e = numbers(c)
                chars, tags, link_chars, link_tags = chars + a, tags + b + 1, link_chars + d, link_tags + e
        return (chars, tags, chars, link_tags + 1) if n.name == "a" else (chars, tags, link_chars, link_tags)

    whole = numbers(node)
    out = {}

    def density(n):
        chars, tags, link_chars, link_tags = numbers(n)
        tags, link_tags = max(1, tags), max(1, link_tags)
        if not chars:
            return 0.0
        inside = chars / max(1, link_chars) * tags / link_tags
        base = math.log(chars / max(1, chars - link_chars) * link_chars + whole[2] / max(1, whole[0]) * chars + math.e)
        return chars / tags * math.log(inside) / base if inside > 1 else 0.0

    def walk(n):
        own = [c for c in n.children if not isinstance(c, str) and not c.skip]
        out[n] = density(n), sum(map(density, own))
        for c in own:
            walk(c)

    walk(node)
    return out


def test_densities_and_the_densest_subtree(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in pages:
        plain = page.replace("<article", "<div").replace("</article", "</div")
        root = html_text.parse(plain)
        html_text.settle(root)
        nodes = html_text.measure(root)
        want = plain_densities(root)
        assert all(n.density == pytest.approx(want[n][0]) and n.sum == pytest.approx(want[n][1]) for n in nodes) and len(want) == len(nodes)
    same = [html_text.main_text(p) == html_text.main_text(p.replace("<article", "<div").replace("</article", "</div")) for p in pages]
    assert np.mean(same) > 0.95  # the density finds what the element says


def test_pages(spark):
    rows = queries.op9_html(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    table = spark.createDataFrame([(1, None, "old"), (2, "<p>x", "old")], "page_id long, html string, Text string")
    assert [r["text"] for r in html_text.extract_pages(table).orderBy("page_id").collect()] == ["", "x"]
    assert html_text.extract_pages(table.limit(0)).collect() == []


TURNS = [
    (1, 0, "system", "be \\n good <|im_end|>\n", 0), (1, 1, "user", "hi \\<|", 0), (1, 2, "assistant", "x" * 300, 0), (1, 3, "user", None, 0), (1, 4, "assistant", "", 0), (1, 5, None, "no role", 0), (1, 6, "assistant", "é🙂" * 50, 0),
    (2, 0, "assistant", "alone \\", 0), (2, 0, "assistant", "alone \\", 0), (None, 3, "a\nb\\n", "t\n\n", 0), (3, None, "user", "no turn", 0), (3, 1, "assistant", "<\\|\\\\", 0), (4, 7, "assistant", "y" * 9000, 0), (4, 8, "user", "z", 0),
]


def want_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        lost = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out


@pytest.mark.parametrize("long", [100, 3])
@pytest.mark.parametrize("budget", [30, 200, 100_000])
def test_chat_reads_back(spark, budget, long, monkeypatch):
    monkeypatch.setattr(chat, "LONG", long)
    monkeypatch.setattr(chat, "PER_BLOCK", 2)
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_conversations(turns, budget=budget)
    read = chat.read_windows(windows).orderBy("conv_id", "part", "window").collect()
    lines, lost = defaultdict(list), defaultdict(list)
    for r in read:
        lines[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
        lost[r["conv_id"]] += r["targets"]
    for conv, (n, turns_sha, chars, loss_sha) in want_chat([t[:4] for t in TURNS]).items():
        assert len(lines[conv]) == n
        assert hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in lines[conv]).encode()).hexdigest() == turns_sha
        assert hashlib.sha256("".join(lost[conv]).encode()).hexdigest() == loss_sha and len("".join(lost[conv])) == chars
    assert (max(r["part"] for r in read) > 0) == (long == 3)
    if budget == 30:
        assert all(r["formatted"].startswith("<|im_start|>system\n") for r in windows.filter("conv_id = 1").collect())
        assert windows.filter("n_repeated > 0").count() > 2
    assert chat.format_conversations(turns.limit(0)).collect() == []


def test_chat_query_of_long_conversations(spark, monkeypatch):
    want = {r["conv_id"]: r[:5] for r in queries.op10_chat(spark, SF).collect()}
    monkeypatch.setattr(chat, "LONG", 3)
    monkeypatch.setattr(chat, "PER_BLOCK", 2)
    assert {r["conv_id"]: r[:5] for r in queries.op10_chat(spark, SF).collect()} == want


def test_chat_moves_texts_once(spark):
    plan = chat.format_conversations(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_chat_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    want = want_chat([*given, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op10_chat(spark, SF).collect()}
    assert got == want


def story(rng, n):
    """Sentences of words that no site would use for itself."""
    return " ".join(" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(rng.integers(6, 14))).capitalize() + "." for _ in range(n))


def link_list(rng, n):
    return "<ul>" + "".join(f"<li><a href='/{k}'>{story(rng, 1)[:18]}</a></li>" for k in range(n)) + "</ul>"


def made_page(rng, tag):
    """A page and the blocks of its article, which are known as the page is made of them."""
    known = [story(rng, 1)]
    parts = [f"<h1>{known[0]}</h1>"]
    for k in range(int(rng.integers(4, 9))):
        kind = rng.choice(["p", "p", "p", "list", "table", "menu", "quote", "sources"]) if k else "p"
        text = story(rng, int(rng.integers(3, 7)))
        if kind == "list":
            items = [story(rng, 2) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            known += items
        elif kind == "table":
            cells = [str(rng.integers(10, 99)), story(rng, 1)[:20].strip()]
            parts.append(f"<table><tr><td>{cells[0]}</td><td><a href='/x'>{cells[1]}</a></td></tr></table><p>{text}</p>")
            known += [*cells, text]
        elif kind == "menu":  # a name that sites use for ways through them
            parts.append(f"<div class='menu'><p>{text}</p></div>")
            known.append(text)
        elif kind == "sources":
            links = [story(rng, 1)[:30].strip() for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li><a href='/s'>{x}</a></li>" for x in links) + f"</ul><p>{text}</p>")
            known += [*links, text]
        else:
            parts.append(f"<blockquote>{text}</blockquote>" if kind == "quote" else f"<p>{text}</p>")
            known.append(text)
        if rng.random() < 0.4:
            name = rng.choice(["notice", "alert", "ad", "newsletter", "share", "related", "sidebar", "cookie-consent"])
            parts.append(f"<div class='{name}'><p>{story(rng, 2)}</p></div>")
    last = story(rng, 4)
    body = "".join(parts) + f"<p>{last}</p>"
    known.append(last)
    around = f"<header><a href='/'>{story(rng, 1)[:10]}</a></header><nav>{link_list(rng, 6)}</nav>", f"<div class='comments'><p>{story(rng, 3)}</p></div><aside>{link_list(rng, 4)}</aside><footer>{story(rng, 1)}</footer>"
    return f"<html><head><title>{known[0]}</title></head><body>{around[0]}<{tag} class='{rng.choice(['', 'text', 'page'])}'>{body}</{tag}>{around[1]}</body></html>", known


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_made_pages(tag):
    """Articles that are known, with and without an element of that name, notices among their paragraphs."""
    rng = np.random.default_rng(21)
    for _ in range(40):
        page, known = made_page(rng, tag)
        assert html_text.main_text(page).split("\n") == known


def test_several_articles_and_deep_pages():
    rng = np.random.default_rng(22)
    texts = [story(rng, 6) for _ in range(4)]
    two = f"<body><nav>{link_list(rng, 3)}</nav><div><article><p>{texts[0]}</p></article><article><p>{texts[1]}</p><p>{texts[2]}</p></article></div><p class='notice'>{story(rng, 1)}</p></body>"
    assert html_text.main_text(two).split("\n") == texts[:3]
    section = f"<body><article><p>{texts[0]}</p><section id='discussion'><h2>{texts[1]}</h2><p>{texts[2]}</p></section><section id='related-work'><p>{texts[3]}</p></section></article></body>"
    assert html_text.main_text(section).split("\n") == texts
    began = time.process_time()
    for n in (1000, 16_000):
        assert html_text.main_text("<div>" * n + texts[0] + "</foo>" * n) == texts[0]
        html_text.main_text("<ul><li><div>" + "<b>" * n + "<li></li>" * n)
        html_text.main_text("<div><table><tr><td>" + "<span>" * n + "</div>" * n)
    assert time.process_time() - began < 30


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    sf = SF.replace("0.001", "0.01")
    assert oracle.spark_rows(queries.queries()[name](spark, sf)) == oracle.duck_rows(oracle.connect(sf), queries.oracle_sql()[name])
