"""Near duplicates, repeated substrings and near vectors against brute force, with nulls, ties, copies and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillspark.llm import minhash, suffix
from quillspark.llm.embeddings import near_vectors
from quillspark.llm.graph import components
from quillspark.llm.minhash import near_duplicates
from quillspark.llm.suffix import Shards, substring_duplicates

SCHEMA = "doc_id long, text string, component_id string, kept string, places string"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    """Texts with extra columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def roots(n, links):
    up = {i: i for i in n}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE  two"), (5, "one two three")]
    for g in range(6):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(8, 120))]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 6))) for k in range(12)]
        rows.append((len(rows), " ".join(base)))
    hub = [rng.choice(WORDS) for _ in range(100)]
    rows += [(len(rows) + k, edited(rng, hub, rng.randrange(0, 9))) for k in range(80)]
    rows += [(len(rows) + k, " ".join(hub)) for k in range(20)]
    return rows


def test_near_duplicates(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = near_duplicates(frame(spark, corpus).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """Unlinked texts with a long common passage stand between the ends of links, and one order alone is asked."""
    rng = random.Random(9)
    passage = [rng.choice(WORDS) for _ in range(156)]
    new = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows = [new(44) for _ in range(160)]
    rows += [[*own[:20], *new(24)] for own in rows[:40]]
    rng.shuffle(rows)
    corpus = [(i, " ".join(passage + own)) for i, own in enumerate(rows)]
    sets = {i: shingles(t) for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) == 40
    one = minhash.scanned
    monkeypatch.setattr(minhash, "scanned", lambda orders, *a, **k: one(orders.where("tree = 0"), *a, **k))
    monkeypatch.setattr(minhash, "WHOLE", 8)
    monkeypatch.setattr(minhash, "LAGS", ((1, 1), (2, 5)))
    monkeypatch.setattr(minhash, "MEET", 50)
    got = near_duplicates(frame(spark, corpus)).collect()
    assert {r.doc_id: r.component_id for r in got} == roots(sets, links)


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert near_duplicates(none).count() == 0
    assert substring_duplicates(none).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for a, b in edges for x in (a, b) if a != b}
    assert got == roots(ends, [e for e in edges if e[0] != e[1]])


def brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_duplicates(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(["alpha", "béta", "gamma", "x", "日本"]) for _ in range(300))
    rows = [(0, None), (1, ""), (2, "q" * 99), (3, "q" * 100), (4, "q" * 230), (5, "ab" * 5000), (6, base), (7, base), (8, base + base), (9, "é" * 300), (10, ("0123456789" * 7)[:67] * 9)]
    rows += [(11 + k, base[a : a + rng.randrange(20, 600)] + " ".join(rng.choice(WORDS) for _ in range(30))) for k, a in enumerate(rng.randrange(500) for _ in range(30))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_duplicates(frame(spark, rows).repartition(4)).collect()}
    assert got == brute_spans(rows)


def test_shards_merge_across_borders(monkeypatch):
    """A value that fills many shards gives what one shard gives."""
    rng = random.Random(7)
    base = " ".join(rng.choice(WORDS) for _ in range(200)).encode()
    rows = []
    for i in range(200):
        a, n = rng.randrange(400), rng.randrange(1, 60)
        source = base if i < 120 else base[::-1]
        rows.append((i // 120, i, 0, source[a : a + n + 99], n))
    want, seen = set(), set()
    for _, doc, s, piece, n in rows:
        for j in range(n):
            if piece[j : j + 100] in seen:
                want.add((doc, s + j))
            seen.add(piece[j : j + 100])
    for size in (300, 5000, 1 << 20):
        monkeypatch.setattr(suffix, "SHARD_BYTES", size)
        shards, got = Shards(), []
        for row in rows:
            if shards.full():
                got += shards.flush(more=shards.rows[-1][0] == row[0])
            shards.add(*row)
        got += shards.flush(more=False)
        assert {(d, s + j) for d, s, n in got for j in range(n)} == want


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 6000).astype(np.uint8)
    text[2000:2600] = text[100:700]
    text[3000:3900] = ord("a")
    lanes, lengths = np.array([0, 1500, 3000]), np.array([1401, 1401, 1401])
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(lanes, lengths, strict=True)])
    order, _ = suffix.refine(text, starts)
    windows = [text[p : p + 100].tobytes() for p in order]
    assert windows == sorted(windows)
    common = [0] + [next((k for k in range(100) if a[k] != b[k]), 100) for a, b in zip(windows, windows[1:], strict=False)]
    assert suffix.kasai(text, order, lanes, lengths).tolist() == common


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(0, None), (1, [0.0] * 8), (2, [float("nan")] + [1.0] * 7), (3, [None] + [1.0] * 7), (4, []), (5, [float("inf")] * 8)]
    base = rng.standard_normal((20, 8))
    for k in range(150):
        rows.append((10 + k, (base[k % 20] + rng.standard_normal(8) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist()))
    rows.append((500, [1.0, 2.0]))
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i >= 10}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9]
    want = roots([i for i, _ in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, component string")).collect()}
    found, all_ = sum(g[0] for g in got.values()), 2 * len(links)
    assert 0.99 * all_ <= found <= all_
    assert all(got[i][0] <= sum(i in e for e in links) for i, _ in rows)
    assert {i: got[i] for i in range(6)} == {i: (0, i, True) for i in range(6)}
    if found == all_:
        assert {i: g[1] for i, g in got.items()} == want


def test_windows_of_a_crowded_value(spark, monkeypatch):
    """A common line in many contexts: its values are dealt on by window, with what one shard would find."""
    monkeypatch.setattr(suffix, "CROWD", 3)
    rng = random.Random(8)
    line = " ".join(rng.choice(WORDS) for _ in range(40))
    new = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90)))
    rows = [(i, new() + line[rng.randrange(20) :] + new() + (line if i % 7 == 0 else "")) for i in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_duplicates(frame(spark, rows).repartition(5)).collect()}
    assert got == brute_spans(rows)


def test_rows_that_ids_do_not_tell_apart(spark):
    """Null and repeated ids: a null id comes first, rows of one id go in order of their texts."""
    one, two = "a" * 60 + "b" * 80, "x y " * 60
    rows = [(7, two), (None, one), (7, one), (7, one), (9, two + one), (None, None)]
    made = [(k, t) for k, (_, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")))]
    want = sorted(x[1:] for x in brute_spans(made).values())
    got = substring_duplicates(frame(spark, rows)).collect()
    assert sorted((r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    near = near_duplicates(frame(spark, [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near) == [(0, 0, True), (0, 0, True), (3, 3, True), (4, 3, False), (4, 3, False)]


def test_repeated_vectors(spark):
    """Each row gives one row, whatever its id: rows repeated as they are, one id for two vectors, and unusable ones."""
    e = lambda *x: [float(v) for v in x]
    rows = [(7, e(1, 0, 0)), (7, e(1, 0, 0)), (9, e(2, 0.1, 0)), (3, e(0, 1, 0)), (3, e(0, 0, 1)), (8, e(0, 0.1, 3)), (5, None), (5, None), (None, e(1, 0, 0)), (None, None), (6, e(0, 0, 0))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (3, 1, 3, True), (3, 1, 3, True), (8, 1, 3, False), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, None), (None, 0, None, None), (6, 0, 6, True)], key=str
    )


def test_own_columns_stay(spark):
    names = ["kept", "kept_text", "removed", "n_bytes", "carry_0", "id", "places", "n_chars"]
    docs = spark.createDataFrame([(1, "q" * 250, *names), (2, None, *names)], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in names)]))
    got = suffix.without_repeats(docs, size_col="none").sort("doc_id")
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(1, "q", *names), (2, None, *names)]


def test_looser_links(spark):
    """At a similarity of 50, sketches and sizes leave in what 75 rules out."""
    rng = random.Random(12)
    rows = []
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(60)]
        kept = rng.randrange(36, 60)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:kept] + [rng.choice(WORDS) for _ in range(min(8, 60 - kept))]))]
    sets = {i: shingles(t) for i, t in rows}
    for similarity in (50, 75):
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
        got = near_duplicates(frame(spark, rows), similarity=similarity).collect()
        assert {r.doc_id: r.component_id for r in got} == roots(sets, links) and len(links) > 5


def test_borders_of_partitions(spark):
    """Regions that lie across the borders of many small partitions are searched whole."""
    rng = random.Random(13)
    base = [rng.choice(WORDS) for _ in range(90)]
    rows = [(i, " ".join(base[:66] + [f"y{rng.randrange(10**9)}" for _ in range(24)])) for i in range(50)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 50, 3)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = near_duplicates(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.doc_id: r.component_id for r in got} == roots(sets, links)
