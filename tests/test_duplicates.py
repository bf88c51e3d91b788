"""The similarity join, greedy choices and pictures against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_question, stems
from quillspark.operators import documents, duplicates
from quillspark.operators.duplicates import PairIndex, Question, _pairs_of, compare, compare_stored, equal_pairs, first_kept, greedy_unique, least_jaccard, least_pairs, option_similarity, similar_pairs

WORDS = "force mass energy motion velocity current voltage cell membrane photosynthesis triangle angle fraction decimal acid base metal river climate treaty empire parliament budget market price grammar verb noun planet orbit gravity friction pressure volume density".split()
FRAMES = ["What is {}?", "Define the {}.", "Explain how {} works in practice", "Calculate the {} of a body", "{}", "Which of the following is true for {}?"]


def variants(rng, text):
    i = rng.randrange(len(text) + 1)
    yield text[:i] + rng.choice("abcxyz ") + text[i:]
    yield text[: max(i - 3, 0)] + text[i:]
    w = text.split()
    rng.shuffle(w)
    yield " ".join(w)
    yield text.upper() + " !!"
    yield "".join(rng.choice("xyz") if rng.random() < 0.18 and c != " " else c for c in text)


def questions(n, seed):
    rng, out = random.Random(seed), []
    while len(out) < n:
        text = rng.choice(FRAMES).format(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))))
        out += [text, *rng.sample(list(variants(rng, text)), rng.randrange(3))]
    return out[: n - 4] + ["", None, "what is the of", "?!"]


def options(rng):
    if rng.random() < 0.4:
        return None
    sets = [["True", "False"], ["all of these", "none of these", "only the first", "only the second"], ["9", "12", "?", "15"]]
    values = rng.choice(sets) if rng.random() < 0.5 else [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 5))]
    if rng.random() < 0.3:
        values = values[:-1] + [values[-1] + "s"]
    return {k: v for k, v in zip("ABCD", rng.sample(values, len(values)), strict=False)}


def read(spark, rows):
    """The rows (i, text, options) as the plain rules take them, by the library's own expressions for words."""
    df = spark.createDataFrame(rows, "i long, t string, options map<string,string>")
    values = F.filter(F.map_values("options"), lambda x: F.length(x) > 0)
    made = F.transform(values, lambda x: F.struct(normalize_question(x).alias("n"), stems(x).alias("s")))
    return {r.i: Question(r.i, r.t, r.n, list(r.s), [(x.n, list(x.s)) for x in r.o or []]) for r in df.select("i", "t", normalize_question("t").alias("n"), stems("t").alias("s"), made.alias("o")).collect()}


@pytest.fixture(scope="module")
def bank(spark):
    rng = random.Random(3)
    rows = [(i, t, options(rng)) for i, t in enumerate(questions(400, 4))]
    frame = spark.createDataFrame([(*r, "MCQ") for r in rows], "i long, t string, options map<string,string>, question_type string")
    return frame, read(spark, rows)


@pytest.mark.parametrize("threshold,stored", [(0.8, True), (0.8, False), (0.65, True), (0.5, False), (1.0, True)])
def test_similar_pairs_like_plain_loops(spark, bank, threshold, stored):
    frame, plain = bank
    rule = compare_stored if stored else compare
    asked = frame.where("i % 3 = 0")
    want = {(a, b): hit for a in plain if a % 3 == 0 and plain[a].normal for b in plain if (hit := rule(plain[a], plain[b], threshold))}
    got = similar_pairs(asked.withColumnRenamed("i", "x"), frame.withColumnRenamed("i", "y"), "t", "x", "y", threshold, "options", stored).collect()
    assert len(got) == len(want) and {(r.x, r.y): (r.score, r.reason) for r in got} == want
    assert threshold == 1.0 or sum(h[1] == "HIGH_SIMILARITY" for h in want.values()) > 30


def test_two_thousand_questions(spark):
    rows = [(i, t) for i, t in enumerate(questions(2000, 9))]
    frame = spark.createDataFrame(rows, "i long, t string")
    asked = frame.where("i % 10 = 0")
    plain = read(spark, [(*r, None) for r in rows])
    want = {(a, b): hit for a in plain if a % 10 == 0 and plain[a].normal for b in plain if (hit := compare_stored(plain[a], plain[b], 0.8))}
    got = similar_pairs(asked.withColumnRenamed("i", "x"), frame.withColumnRenamed("i", "y"), "t", "x", "y").collect()
    assert {(r.x, r.y): (r.score, r.reason) for r in got} == want and len(got) == len(want) > 400


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_limits_lose_no_pair(threshold):
    """Whatever is aligned at the threshold shares enough pairs, and whatever the mix lifts over it enough stems."""
    import difflib

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 24))) for _ in range(150)]
    index = PairIndex(texts, threshold)
    for x in texts:
        near = set(index.near(_pairs_of([x])[0], len(x)).tolist())
        assert {k for k, y in enumerate(texts) if difflib.SequenceMatcher(None, x, y).ratio() >= threshold} <= near
    assert least_pairs(100, 0.8) == 19 and 0.56 < least_jaccard(0.8) < 0.57


def plain_greedy(plain, order, threshold):
    kept, out = [], {}
    for k in order:
        hit = next(((j, found[1]) for j in kept if (found := compare(plain[k], plain[j], threshold))), (None, None))
        out[k] = hit
        if hit[0] is None:
            kept.append(k)
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_greedy_like_the_plain_walk(spark, bank, threshold):
    frame, plain = bank
    want = {}
    for g in range(2):
        want |= plain_greedy(plain, [k for k in sorted(plain) if k % 2 == g], threshold)
    got = greedy_unique(frame.withColumn("g", F.col("i") % 2), "g", "i", "t", threshold, "options")
    assert got.columns == ["i", "t", "question_type", "g", "duplicate_of", "reason"]
    assert {r.i: (r.duplicate_of, r.reason) for r in got.collect()} == want
    assert {x[1] for x in want.values()} >= {"EXACT_NORMALIZED", "MCQ_OPTION_MATCH", "HIGH_SIMILARITY"}


def test_hot_options_need_no_pairs(spark):
    """Four thousand true-or-false questions repeat the first of them."""
    rows = spark.range(4_000).select(F.col("id").alias("i"), F.lit(1).alias("g"), F.concat(F.lit("statement "), F.sha2(F.col("id").cast("string"), 256)).alias("t"), F.expr("map('A', 'True', 'B', 'False')").alias("options"), F.lit("MCQ").alias("question_type"))
    got = greedy_unique(rows, "g", "i", "t", options="options")
    assert got.where("duplicate_of is null").count() == 1 and got.where("duplicate_of = 0").count() == 3999


def test_runs_lose_no_pair_of_long_texts():
    """By the pairs alone most texts of one language stayed; by the runs nearly all that are left are alike."""
    rng, letters = random.Random(5), "eeeeeettttaaaooiinnsshrdlcumwfgypbvkjxqz      "
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(180, 620))) for _ in range(30)]

    def edited(t):
        a = list(t)
        for _ in range(rng.randint(0, len(a) // 7)):
            i = rng.randrange(len(a))
            a[i : i + rng.randint(0, 2)] = rng.choice(letters) * rng.randint(0, 2)
        return "".join(a)

    texts = base + [edited(t) for t in base for _ in range(4)] + [t[: len(t) * 4 // 5] for t in base] + [t[:60] + t[90:] for t in base]
    index, alike, left, before = PairIndex(texts, 0.8), 0, 0, 0
    for t in texts:
        pairs, grams = _pairs_of([t])[0], _pairs_of([t], 5)[0]
        near, wide = set(index.near(pairs, len(t), grams).tolist()), index.near(pairs, len(t))
        want = {k for k in wide.tolist() if SequenceMatcher(None, t, texts[k]).ratio() >= 0.8}
        assert want <= near
        alike, left, before = alike + len(want), left + len(near), before + len(wide)
    assert alike > 300 and left < before / 2


def test_equal_pairs_are_the_equal_ones(spark):
    rows = spark.createDataFrame([(1, "What is  Light?"), (2, "what is light"), (3, "what is a light"), (4, " "), (5, None), (6, "WHAT, is light!")], "x long, t string")
    found = equal_pairs(rows, rows.withColumnRenamed("x", "y"), "t", "x", "y")
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = similar_pairs(rows, rows.withColumnRenamed("x", "y"), "t", "x", "y").where("reason = 'EXACT_NORMALIZED'")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 10


def test_first_kept_like_a_walk(spark):
    rng = random.Random(2)
    n = 120
    edges = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(150)) if a != b} | {(i + 1, i) for i in range(20, 60)}
    cliques = [(f"c{k}", i) for k in range(6) for i in rng.sample(range(n), 8)]
    near = {i: {j for j, k in edges if k == i} | {k for j, k in edges if j == i} for i in range(n)}
    for name in {c for c, _ in cliques}:
        of = [i for c, i in cliques if c == name]
        for i in of:
            near[i] |= set(of) - {i}
    kept = set()
    for i in range(n):
        if not near[i] & kept:
            kept.add(i)
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = first_kept(nodes, spark.createDataFrame(sorted(edges), "later long, earlier long"), spark.createDataFrame(cliques, "clique string, node long"))
    assert sorted(r.node for r in got.collect()) == sorted(kept)
    assert first_kept(nodes, spark.createDataFrame([], "later long, earlier long")).count() == n
    assert first_kept(nodes.limit(0), spark.createDataFrame([], "later long, earlier long")).count() == 0


def test_option_similarity():
    words = lambda *xs: [(x, x.split()) for x in xs]
    assert option_similarity(words("a b", "c"), words("c", "a b", "d", "e")) == 0.5
    assert option_similarity([], words("a")) == 0.0


@pytest.mark.parametrize("near", [0, 4, 7])
def test_pictures_like_the_plain_walk(spark, near):
    rng, rows = random.Random(near), []
    for doc in (1, 2, None):
        bases = [rng.getrandbits(64) for _ in range(12)]
        for k in range(90):
            h = rng.choice(bases)
            for _ in range(rng.randrange(9)):
                h ^= 1 << rng.randrange(64)
            rows.append((doc, k, f"{h:016x}" if rng.random() < 0.97 else None, "x"))
    want = set()
    for doc in (1, 2, None):
        kept = []
        for d, k, h, _ in rows:
            if d == doc and (h is None or all((int(h, 16) ^ x).bit_count() > near for x in kept)):
                kept += [int(h, 16)] if h else []
                want.add((doc, k))
    frame = spark.createDataFrame(rows, "doc_id long, position int, dhash string, kept_by string")
    got = documents.first_pictures(frame, near=near)
    assert got.columns == ["doc_id", "position", "dhash", "kept_by", "kept"] and got.count() == len(rows)
    assert {(r.doc_id, r.position) for r in got.where("kept").collect()} == want


def test_few_questions_go_to_the_rows(spark, monkeypatch):
    """The same pairs as through cells, and no row is written but those that are found."""
    rng, words = random.Random(3), "river stone mountain light water forest animal window garden letter market paper".split()
    said = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    said += [t.replace("stone", "stones").replace("water", "waters") for t in said[:40]] + [" ".join(reversed(t.split())) for t in said[:40]] + said[:10] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(said)), "row_id long, text string")
    asked = spark.createDataFrame([(k, said[k]) for k in range(0, 60)] + [(90, ""), (91, None)], "item_id long, text string")
    written = []

    def counted(df, label, kept=duplicates.materialize):
        out = kept(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(duplicates, "materialize", counted)
    few = sorted(similar_pairs(asked, rows, "text", "item_id", "row_id").collect())
    assert all(n < 100 or label in ("found", "pairs") for label, n in written)
    monkeypatch.setattr(duplicates, "SENT_CHARS", 0)
    assert few == sorted(similar_pairs(asked, rows, "text", "item_id", "row_id").collect()) and len(few) > 70


def test_large_groups_are_not_copied_for_each_cell(spark, monkeypatch):
    """Smaller cells give the same firsts, and what is shuffled does not grow with their number."""
    rng = random.Random(11)
    syllables = "the ing er an re on at en nd ti es or te of ed is it al ar st to nt".split()
    said = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 70))) for _ in range(240)]
    said += [t[:-3] + "xyz" for t in said[:60:2]] + [" ".join(t.split()[1:]) for t in said[60:100:2]] + [" ".join(sorted(t.split())) for t in said[100:120]]
    rng.shuffle(said)
    rows = spark.createDataFrame([(k % 9 == 0, k, t) for k, t in enumerate(said)], "g boolean, k long, t string")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    shuffled, got = [], []
    for chars in (1 << 19, 1 << 11):
        monkeypatch.setattr(duplicates, "CELL_CHARS", chars)
        before = moved()
        got.append(sorted(map(tuple, greedy_unique(rows, "g", "k", "t").collect())))
        shuffled.append(moved() - before)
    assert got[0] == got[1] and sum(r[3] is not None for r in got[0]) > 40
    assert shuffled[1] < 4 * shuffled[0]
    for g in (True, False):
        ours = {k: Question(k, t, n, list(s)) for k, t, n, s in rows.where(F.col("g") == g).select("k", "t", normalize_question(F.col("t")), stems(F.col("t"))).collect()}
        want = plain_greedy(ours, sorted(ours), 0.8)
        assert {r[1]: (r[3], r[4]) for r in got[0] if r[0] == g} == want
