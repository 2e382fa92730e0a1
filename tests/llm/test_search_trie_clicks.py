"""Exact top-k search, the trie of prefixes and expiring deduplication, against brute force."""

import datetime
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import clicks, exact_topk, prefixes


def brute_top(rows, k, every):
    """(query_id, rank, vec_id, score) of rows (id, vector), one query an id, that of the least vector."""
    sound = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v in sound:
        if i is not None and i % every == 0:
            asks[i] = min(asks.get(i, (len(v), v)), (len(v), v))
    out = []
    for q, (n, v) in asks.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for i, w in sound if i != q and len(w) == n)
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(found[:k])]
    return Counter(out)


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for k in range(90)]
    rows += [(k, rows[k % 7][1]) for k in range(90, 150)]  # many of the same scores
    rows += [rows[5], rows[10], rows[10], (10, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (150, [0.0] * 6), (151, None), (160, []), (152, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(153, [float("nan")] + [0.0] * 5), (170, [float("inf")] + [0.0] * 5), (180, [1.0, -2.0]), (181, [0.5, 0.5]), (-10, [-1.0] * 6), (190, [1.5] * 3)]
    return rows


@pytest.mark.parametrize("summary", [64 << 20, 0])
def test_top_products(spark, monkeypatch, summary):
    for name, value in (("PER_BLOCK", 4), ("PER_GROUP", 16), ("MOST_SUMMARY", summary), ("PER_ASK", 3)):
        monkeypatch.setattr(exact_topk, name, value)
    rows = odd_vectors()
    table = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], "vec_id long, embedding array<float>, part int, kind string, code int, least int")
    for k in (1, 4, 200):
        got = Counter(map(tuple, exact_topk.top_products(table, F.col("vec_id") % 10 == 0, k).collect()))
        assert got == brute_top(rows, k, 10)
    assert exact_topk.top_products(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert exact_topk.top_products(table, F.lit(False)).collect() == []


def test_bounds_and_products():
    rng = np.random.default_rng(7)
    for top in (50, 2**29, 2**31):
        queries, rows = (rng.integers(-top, top, (n, 9)) for n in (5, 20))
        exact = [[sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in rows] for q in queries]
        want = np.clip(np.array(exact, object), -(2**63), 2**63 - 1)
        assert (exact_topk.products(queries, rows) == want.astype(np.int64)).all()
        assert (exact_topk.bounds(queries, rows.max(0)[None], rows.min(0)[None])[:, 0] >= np.array(exact, float).max(1)).all()


def test_blocks_pass_over_what_cannot_reach():
    rng = np.random.default_rng(8)
    parts = [rng.normal(0, 5, (16, 4)).astype(int) + np.array([200 * (k == d) for d in range(4)]) for k in range(4)]
    asked = []

    class Seen(list):
        def __getitem__(self, k):
            asked.append(k)
            return super().__getitem__(k)

    high, low = np.stack([p.max(0) for p in parts]), np.stack([p.min(0) for p in parts])
    blocks = exact_topk.Blocks([np.arange(16) + 16 * k for k in range(4)], Seen(parts), high, low)
    query = np.array([0, 0, 100, 0])
    ids, scores = blocks.search(query, -1, exact_topk.bounds(query[None], high, low)[0], 5, None)
    assert asked == [2] and set(ids) <= set(range(32, 48)) and (np.diff(scores) <= 0).all()


def brute_trie(rows, shared):
    """Nodes of rows (conv, turn, role, text); shared(c): whose turns come first, and how many."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    paths = {c: convs.get(shared(c)[0], [])[: shared(c)[1]] + v[shared(c)[1] :] for c, v in convs.items()}
    nodes, below = defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    for node in nodes:
        for d in range(len(node) + 1):
            below[node[:d]].add(node)
    out = []
    for node, members in nodes.items():
        d, inside = len(node), below[node]
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == d)))
        leaves = sum(below[x] == {x} for x in inside)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in inside if x)
        out.append((min(members), d, min(nodes[node[:-1]]) if d else None, len(members), sum(len(x) == d + 1 for x in inside), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def odd_turns():
    rng = random.Random(6)
    rows = []
    for c in [*range(-12, 60), 2**40, 2**40 + 1]:
        for turn in range(rng.choice([1, 1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü", None, ""])))
    rows += [(500 + k, t, "user", "hot") for k in range(60) for t in range(3)]  # many equal ones
    rows += [(700, t, "user", f"long {t}") for t in range(400)] + [(701, t, "user", f"long {t}") for t in range(399)]
    rows += rows[:5] + [(None, 1, "user", "nobody"), (800, 1, "user", "x" * 100_000), (801, 1, "us", "erhot"), (802, 1, "user", "hot")]
    rng.shuffle(rows)
    return rows


def test_prefix_trie(spark):
    rows = odd_turns()
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, conv int, key1 int").repartition(3)
    assert Counter(map(tuple, prefixes.prefix_trie(table).collect())) == brute_trie(rows, lambda c: (c, 0))
    whole = lambda c: c - c % 5 if c >= 0 else c + (-c) % 5  # noqa: E731  the remainder has the sign of c
    conv = F.col("conv")
    shared = prefixes.prefix_trie(table, conv - conv % 5, F.crc32(conv.cast("string")) % 9)
    assert Counter(map(tuple, shared.collect())) == brute_trie(rows, lambda c: (whole(c), zlib.crc32(str(c).encode()) % 9))
    assert prefixes.prefix_trie(table.limit(0)).collect() == []


def test_nobody_to_share_with(spark):
    rows = [(6, 0, "user", "gone"), (7, 0, "user", "kept"), (7, 1, "user", "more")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conv = F.col("conv")
    got = Counter(map(tuple, prefixes.prefix_trie(table, conv - conv % 5, F.lit(1)).collect()))
    assert got == brute_trie(rows, lambda c: (c - c % 5, 1)) and sum(got.values()) == 2


def brute_windows(batches, span=48, late=24):
    """Windows of batches of events (click_id, hour, hash)."""
    most, open_, out = None, {}, []
    close = lambda i, b: out.append((i, open_[i][0], b, *open_.pop(i)[1:]))
    for b, events in enumerate(batches):
        for i, hour, hash_ in sorted(events, key=lambda e: (e[0], e[1], e[2])):
            if most is not None and hour < most - late:
                continue
            if i in open_ and hour <= open_[i][0] + span:
                own = open_[i]
                unlike = hash_ != own[4]
                open_[i] = (own[0], own[1] + 1, own[2] + unlike, own[3] + unlike * zlib.crc32(hash_.encode()), own[4])
            else:
                if i in open_:
                    close(i, b)
                open_[i] = (hour, 0, 0, 0, hash_)
        most = max([e[1] for e in events] + ([most] if most is not None else []), default=None)
        for i in sorted(open_):
            if b == len(batches) - 1 or most is not None and open_[i][0] + span < most - late:
                close(i, b)
    return Counter(out)


#: Hashes of 32 bytes, some of which end with zeros.
HASHES = {name: bytes.fromhex(hashlib.sha256(name.encode()).hexdigest())[: 32 - k] + b"\0" * k for k, name in enumerate("abc")}


def test_fold():
    rng = random.Random(3)
    for _ in range(30):
        events = sorted((rng.randrange(8), rng.randrange(1000, 1300), HASHES[rng.choice("abc")].hex()) for _ in range(rng.choice([1, 5, 60])))
        cut = sorted(rng.sample(range(1000, 1300), 2))
        parts = [[e for e in events if low <= e[1] < high] for low, high in zip([0, *cut], [*cut, 9999], strict=True)]
        held, out = np.zeros(0, clicks._OPEN), []
        for part in parts:
            counted = sorted(Counter(part).items())
            ids, hours = (np.array([e[0][c] for e in counted], np.int64) for c in (0, 1))
            hashes, n = np.array([bytes.fromhex(e[0][2]) for e in counted], "S32"), np.array([e[1] for e in counted], np.int64)
            closed, held = clicks.fold(held, ids, hours, hashes, n, 48)
            out.append(closed)
        out = np.concatenate([*out, held])
        got = Counter((*(int(w[c]) for c in ("id", "start", "repeats", "conflicts", "crc")), h.hex()) for w, h in zip(out, clicks.whole_bytes(out["hash"]), strict=True))
        assert got == Counter((w[0], w[1], *w[3:]) for w in brute_windows([events]).elements())


def click_rows():
    rng, day = random.Random(9), datetime.datetime(2024, 1, 1)
    rows = []
    for i in [*range(-3, 40), *[7] * 60]:  # one click has many rows
        at = day + datetime.timedelta(minutes=rng.randrange(0, 60 * 24 * 40))
        rows.append((i, rng.choice([at, None]), at, rng.choice([1, 2, None]), rng.choice(["view", "a|b", None]), rng.choice([1.005, -2.5, None, float("nan"), float("inf")]), rng.choice(["{}", None, "", "x" * 5000])))
    return [*rows, *rows[:4], *rows[-4:], (None, day, day, 1, "view", 1.0, "{}"), (50, day, None, 1, "view", 1.0, "{}")]


def brute_copies(rows):
    """(late_hour, click_id, hour, hash) of click rows."""
    out, zero = [], datetime.datetime(1970, 1, 1)
    micros = lambda t: (t - zero) // datetime.timedelta(microseconds=1)
    for i, ts, arrived, client, kind, value, props in rows:
        if i is None or arrived is None:
            continue
        cents = "" if value is None or not np.isfinite(value) else str(int(np.floor(100 * value + 0.5)))
        told = "|".join(["" if client is None else str(client), kind or "", cents, "" if ts is None else str(micros(ts)), props or ""])
        for j in range(i % 3 + 1):
            c = zlib.crc32(f"{i}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            out.append((hour + c // 10 % 200, i, hour, hashlib.sha256(f"{told}|{c % 3}".encode()).hexdigest()))
    return out


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_click_copies(spark, zone):
    rows = click_rows()
    kinds = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert Counter((*r[:3], r[3].hex()) for r in clicks.click_copies(spark.createDataFrame(rows, kinds)).collect()) == Counter(brute_copies(rows))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_deduplicated_clicks(spark):
    """In three batches; then batches of which one is empty, with a group for each click."""
    rows = click_rows()
    kinds = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch int, cell int, n int, hour int"
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], kinds)
    copies = brute_copies(rows)
    low, high = min(c[0] for c in copies), max(c[0] for c in copies)
    batches = [[c[1:] for c in copies if (c[0] - low) * 3 // (high - low + 1) == b] for b in range(3)]
    assert Counter(map(tuple, clicks.deduplicate_clicks(table, n_batches=3).collect())) == brute_windows(batches)
    assert clicks.deduplicate_clicks(table.limit(0)).collect() == []


def test_batches_of_which_one_is_empty(spark):
    rng = random.Random(11)
    batches = [[(rng.randrange(6), rng.randrange(1000 + 60 * b, 1090 + 60 * b), HASHES[rng.choice("ab")].hex()) for _ in range(12)] for b in range(4)]
    batches[1] = []
    rows = [(b, i, hour, bytearray.fromhex(h), n) for b, events in enumerate(batches) for (i, hour, h), n in Counter(events).items()]
    events = spark.createDataFrame(rows, "batch int, click_id long, hour long, hash binary, n long").repartition(2)
    assert Counter((*r[:6], r[6].hex()) for r in clicks.run_batches(events, 4, cells=0).collect()) == brute_windows(batches)


def test_stores_open_once_a_batch_and_once_at_the_end(spark, monkeypatch):
    """A partition opens its store for each micro-batch, of which every one leaves half a megabyte in the executor."""
    commits, discard = [], clicks.discard

    def seen(session, folder):
        if folder.endswith("/state"):
            commits.extend(x for x in os.listdir(f"{folder.removeprefix('file:')}/commits") if x.isdigit())
        discard(session, folder)

    monkeypatch.setattr(clicks, "discard", seen)
    rows = [(b, click, hour, bytearray(HASHES["a"]), 1) for b, click, hour in [(0, 7, 1000), (0, 8, 1090), (1, 7, 1090)]]
    got = clicks.run_batches(spark.createDataFrame(rows, "batch int, click_id long, hour long, hash binary, n long"), 2, cells=2)
    assert sorted((r.start_hour, r.closed_batch) for r in got.collect()) == [(1000, 0), (1090, 1), (1090, 1)]
    assert len(commits) == 3


def test_executors_collect_garbage(spark):
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = beans()
    clicks.collect_garbage(spark)
    assert beans() > before
