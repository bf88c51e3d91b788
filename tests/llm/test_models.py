"""Language, toxicity and language-model operators: held-out accuracy, determinism and odd inputs."""

import os

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillspark.llm import langid, lm, toxicity
from quillspark.llm.common import discard, held_out, materialize_bucketed

ODD = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "a" * 200_000, "de"), (5, "the same", "fr"), (5, "the same", "fr")]


def odd(spark):
    return spark.createDataFrame([(i, t, g, "x") for i, t, g in ODD], "doc_id long, text string, lang string, score string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")


def test_language(spark, docs):
    model = langid.fit(docs.where(~held_out()))
    rows = langid.predict(docs.where(held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    got = langid.predict(odd(spark), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(got, key=lambda r: r.doc_id)][:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = langid.fit(odd(spark).limit(0))
    assert none[0] == [] and {r.lang_pred for r in langid.predict(odd(spark), none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_grams_match_a_plain_count():
    texts = ["abca", "", "ß日"]
    ids, rows = langid.grams(texts)
    assert [int((rows == i).sum()) for i in range(3)] == [sum(max(len(t) - k, 0) for k in range(3)) for t in texts]
    again, r = langid.grams(["abca"])
    assert sorted(ids[rows == 0]) == sorted(again)


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out()))
    rows = toxicity.score(docs, model).join(labels.where(held_out()), "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([a > b or (a == b) / 2 for a in bad for b in good]) > 0.85
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.05
    got = toxicity.score(odd(spark), model).collect()
    assert len(got) == 6 and all(0 <= r.score < 0.7 for r in got if r.doc_id < 4)
    assert toxicity.reject(docs, model).columns == docs.columns
    empty = toxicity.fit(docs.limit(0), labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd(spark), empty).collect())


def test_segments_are_maximal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(-3, 4, 12).astype(float)

        def split(a, b):  # the definition: the best segment, then the same on either side of it
            best = max(((s[i:j].sum(), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            if best[0] <= 0:
                return []
            _, _, i, j = best
            return [*split(a, i), (i, j, best[0]), *split(j, b)]

        got = toxicity.segments(s.tolist())
        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in split(0, 12)))
        assert max((x[2] for x in got), default=0) == pytest.approx(toxicity.best_sums(s, np.array([0, 12]))[0])


def test_rate_solves_its_equation():
    s, w = np.array([1.0, -1.0, -2.0]), np.array([1.0, 3.0, 2.0])
    lam = toxicity.rate(s, w)
    assert (w / w.sum() * np.exp(lam * s)).sum() == pytest.approx(1)


def brute_likelihood(texts, model):
    """The docstring of the module by plain loops: windows of other places, and the network as their prior."""
    import pyarrow as pa

    p = {k: x.astype(float) for k, x in lm.unpack(model["flat"]).items()}
    rows = []
    for t in texts:
        words = lm.tokens(pa.array([t]))[0].tolist()
        padded = [-1, -1, *words, -1, -1]
        rows.append([((padded[i], padded[i + 1], padded[i + 3], padded[i + 4]), w) for i, w in enumerate(words)])
    seen: dict = {}
    for row in rows:
        for window, w in row:
            seen.setdefault(window, []).append(w)
    out = []
    for row in rows:
        total = 0.0
        for window, w in row:
            h = np.tanh(np.concatenate([p["embed"][lm.PAD if c < 0 else model["word"][c]] for c in window]) @ p["inner"] + p["inner_bias"])
            o = int(model["word"][w])
            z = np.exp(h @ p["class"] + p["class_bias"])
            chance = z[o // lm.GROUP if o < lm.WORDS else o - lm.WORDS + lm.GROUPS] / z.sum()
            if o < lm.WORDS:
                y = np.exp(h @ p["word"][o // lm.GROUP] + p["word_bias"][o // lm.GROUP])
                chance *= y[o % lm.GROUP] / y.sum()
            chance *= np.exp(float(model["share"][w]))
            total += np.log((seen[window].count(w) - 1 + chance) / len(seen[window]))
        out.append((len(row), total))
    return out


def test_likelihoods_are_those_of_the_definition(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(60)] + [None, "", "w1", "w1", "w1 w2 w3 w1 w2 w3 w1 w2 w3"]
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD_BYTES", 600)
    model = lm.fit(docs)
    want = brute_likelihood([t or "" for t in texts], model)
    for parts in (1 << 20, 50):
        monkeypatch.setattr(lm, "PART_WINDOWS", parts)
        got = {r.doc_id: r for r in lm.score(docs, model).collect()}
        assert [got[i].n_tokens for i in range(len(texts))] == [n for n, _ in want]
        assert [got[i].log_likelihood for i in range(len(texts))] == pytest.approx([x for _, x in want], rel=1e-4, abs=1e-4)


def test_language_model(spark, docs):
    model = lm.fit(docs)
    some = docs.where("lang = 'en' and length(text) between 400 and 4000").limit(60)
    plain = {r.doc_id: r for r in lm.score(some, model).collect()}
    assert all(np.isfinite(r.log_likelihood) and r.log_likelihood < 0 for r in plain.values()) and len(plain) == some.count()
    twice = {r.doc_id: r for r in lm.score(some.unionByName(some.where("doc_id % 2 = 0").withColumn("doc_id", F.col("doc_id") + 10**6)), model).collect()}
    gain = lambda odd_: np.mean([twice[i].per_token - plain[i].per_token for i in plain if i % 2 == odd_])
    assert gain(0) > 1 > 4 * gain(1)  # texts that occur twice stand out
    got = lm.score(odd(spark), model).collect()
    assert [(r.n_tokens, r.log_likelihood) for r in got if r.doc_id in (1, 2)] == [(0, 0.0)] * 2
    assert len(got) == 6
    assert lm.score(odd(spark), lm.fit(docs.limit(0))).count() == 6
    assert lm.score(docs.limit(0), model).count() == 0


def test_dealing_does_not_depend_on_files(spark, docs):
    some = docs.limit(200)
    one, many = lm.fit(some.repartition(1)), lm.fit(some.repartition(7))
    assert np.allclose(one["flat"], many["flat"], atol=1e-6)


def test_shards_stay_where_they_are_scored(spark, docs, monkeypatch):
    """Only the totals of windows move by shard, and what is dealt has as few bytes as its values need."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 100_000)
    model = lm.fit(docs.limit(0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lm.score(docs, model)._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [shard" in plan and plan.count("Exchange hashpartitioning(shard") == 1
    rng = np.random.default_rng(4)
    for most, width in ((1, 1), (255, 1), (256, 2), (2**19 - 1, 3), (2**62, 8)):
        x = np.append(rng.integers(0, most, 50, endpoint=True), most)
        assert len(lm.planes(x)) == 1 + 51 * width
        assert (lm.from_planes(pa.array([b"", lm.planes(x)]), 1) == x).all()
    assert len(lm.from_planes(pa.array([lm.planes(np.zeros(0, np.int64))]), 0)) == 0


def test_tables_in_buckets_leave_nothing(spark):
    table = materialize_bucketed(spark.range(20), "numbers", "id", 3)
    assert table.count() == 20
    name, path = table.quill_table, table.quill_path.removeprefix("file://")
    assert spark.catalog.tableExists(name) and os.path.isdir(path)
    discard(table)
    assert not spark.catalog.tableExists(name) and not os.path.exists(path)


def test_probabilities_of_large_outputs():
    """Outputs beyond what exp can hold, and below it."""
    rng = np.random.default_rng(3)
    for scale in (1, 40, 400):
        flat = (lm.start(np.ones(lm.PAD)) * scale).astype(np.float32)
        context, target = rng.integers(0, lm.PAD + 1, (200, 4)), rng.integers(0, lm.PAD, 200)
        exact = lm.log_probabilities(lm.unpack(flat.astype(np.float64)), context, target)
        p = lm.unpack(flat.astype(np.float64))
        h = np.tanh(p["embed"][context].reshape(200, -1) @ p["inner"] + p["inner_bias"])
        z = h @ p["class"] + p["class_bias"]
        for i, t in enumerate(target):
            own = t // lm.GROUP if t < lm.WORDS else t - lm.WORDS + lm.GROUPS
            want = z[i, own] - np.logaddexp.reduce(z[i])
            if t < lm.WORDS:
                y = h[i] @ p["word"][own] + p["word_bias"][own]
                want += y[t % lm.GROUP] - np.logaddexp.reduce(y)
            assert exact[i] == pytest.approx(want, rel=1e-9)
        assert np.isfinite(lm.log_probabilities(lm.unpack(flat), context, target)).all()


def test_every_token_is_trained_on(spark):
    """One-word texts, equal first words and texts of any length: each token is a training target once."""
    rows = [(i, " ".join(["same", *(f"w{k}" for k in range(i % 40))])) for i in range(120)] + [(200 + i, f"lone{i}") for i in range(30)]
    rows.append((300, None))
    n = sum(len(t.split()) for _, t in rows if t)
    assert lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))["trained"] == n


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    target = rng.integers(0, 200, 4096)
    context = np.stack([(target + k) % 200 for k in range(4)], axis=1)
    adam = lm.Adam(lm.start(np.ones(lm.PAD)))
    loss = lambda: -lm.log_probabilities(lm.unpack(adam.flat), context, target).mean()
    before = loss()
    for k in range(160):
        adam.step(context[k % 8 :: 8], target[k % 8 :: 8])
    assert loss() < 0.5 * before


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    flat = lm.start(rng.integers(1, 50, lm.PAD).astype(float)).astype(np.float64)
    context, target = rng.integers(0, lm.PAD + 1, (40, 4)), rng.integers(0, lm.PAD, 40)
    adam = lm.Adam(flat)
    adam.step(context, target)
    g = adam.m / 0.1
    loss = lambda x: -lm.log_probabilities(lm.unpack(x), context, target).mean()
    for k in np.argsort(-np.abs(g))[:: max(1, (g != 0).sum() // 60)][:60]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-7)


def test_languages_are_those_of_the_definition(spark):
    """Naive Bayes by plain counting of the same buckets."""
    texts = [("aa bb", "x"), ("ab ab abc", "x"), ("ccd", "y"), ("dd cd", "y"), ("zz", "x")]
    langs, matrix, prior = langid.fit(spark.createDataFrame(texts, "text string, lang string"))
    assert langs == ["x", "y"] and np.exp(prior) == pytest.approx([0.6, 0.4])
    counts = {g: np.bincount(langid.grams([t for t, h in texts if h == g])[0], minlength=langid.BUCKETS) + langid.SMOOTHING for g in langs}
    asked = ["ab", "cd dd", "abcd", "q"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), (langs, matrix, prior)).collect()}
    for i, t in enumerate(asked):
        ids = langid.grams([t])[0]
        like = [np.log(0.6 if g == "x" else 0.4) + np.log(counts[g][ids] / counts[g].sum()).mean() * min(len(ids), langid.EVIDENCE) for g in langs]
        chance = np.exp(like) / np.exp(like).sum()
        assert got[i][0] == langs[int(np.argmax(like))] and got[i][1] == pytest.approx(chance.max(), rel=1e-4)


def test_segments_themselves():
    """Every maximal segment, not only their sums."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.normal(-0.3, 1, 14)

        def split(a, b):
            best = max(((s[i:j].sum(), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            return [*split(a, best[1]), best[1:], *split(best[2], b)] if best[0] > 0 else []

        assert [x[:2] for x in toxicity.segments(s.tolist())] == split(0, 14)


def test_settings_come_from_the_rows_given(spark):
    """Model and settings don't change with rows that may not be learned from."""
    rows = [(i, ("zzbad zzworse " if i % 5 == 0 else "") + " ".join(f"w{(i * k) % 37}" for k in range(1, 30)), int(i % 5 == 0)) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x.where(~held_out())) for x in (labels, flipped))
    assert one["setting"] == two["setting"] in toxicity.SETTINGS and (one["scores"] == two["scores"]).all() and one["scale"] == two["scale"]
    rows = {r.doc_id: r for r in toxicity.score(docs, one).collect()}
    assert all(rows[i].predicted == int(i % 5 == 0) for i in rows)
