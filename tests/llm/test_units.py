"""License spans, spelling variants and fill-in-middle: brute force, round trips and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from quillspark.llm import fim, licenses, variants
from quillspark.llm.fim import CLASSES, LOOKBACK, Scan, fill_in_middle, lookback, restore
from quillspark.llm.licenses import TEMPLATES, scan
from quillspark.llm.variants import Index, near_pairs, one_edit, word_counts

ODD = [None, "", "\n", "\n\n\n", "no line end", "a\r\nb\n", "é\nü😀\n日本\n", "<P", "<<P>", "x <S> y\n", "<M\n>", "<X>\n<p>", "a<é>\n\x00\n", "x" * 5000, "line\n" * 3000, "é" * 700 + "\n" + "😀" * 900]


def frame(spark, texts, extra=()):
    rows = [(i, t, *extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} string" for c in extra)]))


# --- fill in the middle ----------------------------------------------------------------------------------------------


def plain_fim(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_of(rng, n):
    return ["".join(rng.choice(["a", "<", "P", "S", ">", "\n", "é", "日", "😀", "<P>", "word "]) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_state_depends_on_the_last_bytes():
    assert lookback() == LOOKBACK


@pytest.mark.parametrize("block", [4, 5, 16, 512])
def test_scan_counts_and_cuts(block):
    rng = random.Random(block)
    texts = [t or "" for t in ODD] + texts_of(rng, 300)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    found = Scan(np.frombuffer(b"".join(raw), np.uint8), offsets, block)
    units = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
    assert found.total.tolist() == [[len(t), len(u), len(re.findall("<[PSM]>", t))] for t, u in zip(texts, units, strict=True)]
    want = [rng.randrange(len(u) + 1) for u in units]
    byte, points = found.cuts(np.array(want))
    heads = ["".join(u[:k]) for u, k in zip(units, want, strict=True)]
    assert (byte - offsets[:-1]).tolist() == [len(h.encode()) for h in heads] and points.tolist() == [len(h) for h in heads]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (60, 100)])
def test_fill_in_middle(spark, rate, spm):
    texts = ODD + texts_of(random.Random(rate + spm), 200)
    made = fill_in_middle(frame(spark, texts), rate=rate, spm=spm)
    got = {r.doc_id: r for r in made.withColumn("back", restore(made.output, made.form)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(i, t, rate=rate, spm=spm)
        assert r.back == (t or "") and r.text == t
    assert {r.form for r in got.values()} >= {"plain", "spm" if spm else "psm"}


def test_fill_in_middle_odd_rows(spark):
    names = ["n", "form", "output", "row", "draws"]
    docs = spark.createDataFrame([(None, "a\nb\n", *names), (1, "a\nb\n", *names), (1, "a\nb\n", *names), (2, None, *names)], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in names)]))
    got = fill_in_middle(docs).sort("doc_id").collect()
    assert [r.output for r in got] == [plain_fim(i, t)[4] for i, t in ((None, "a\nb\n"), (1, "a\nb\n"), (1, "a\nb\n"), (2, None))]
    assert {r.row for r in got} == {"row"} and {r.draws for r in got} == {"draws"}
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_invalid_bytes_end_the_scan_too():
    data = np.frombuffer(bytes([0x80, 0xFF, 10, 0xE3, 10, 60, 80, 62]), np.uint8)
    found = Scan(data, np.array([0, 2, 8]), 4)
    assert found.total[:, fim.UNITS].tolist() == [1, 3] and fim.AFTER.max() < len(fim.AFTER) // CLASSES


# --- licenses --------------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text):
    w, k = plain_words(text), licenses.GRAM
    base = [(i, label) for i in range(len(w)) for p, label in licenses.PHRASES if w[i : i + len(p.split())] == p.split()]
    found = []
    for label, template in TEMPLATES:
        t = plain_words(template)
        hits = [(i - j, i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]]
        spans = []
        for d in sorted({h[0] for h in hits}):
            if not spans or d - spans[-1][-1] > licenses.APART:
                spans.append([])
            spans[-1].append(d)
        for span in spans:
            here = [h for h in hits if h[0] in span]
            first, stop = min(h[1] for h in here), max(h[1] for h in here) + k
            covered = len({h[2] + x for h in here for x in range(k)})
            if (covered / len(t) >= licenses.SHARE or covered >= licenses.MANY) and covered >= licenses.DENSE * (stop - first):
                found.append((first, stop - 1, label, covered / len(t)))
    names = sorted({label for _, label in base})
    labels = sorted({*names, *(f[2] for f in found)})
    score = max([0.0, *(f[3] for f in found), *([licenses.NAMED] if base else [])])
    return len(w), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None), ",".join(names), ",".join(labels), score, sorted(found)


def license_texts():
    rng = random.Random(5)
    texts = [None, "", " \n", "MIT license", "mit, LICENSE mit license", "the mit licenses", "general public\nlicense apache License", "ümit license", "K license"]
    for label, template in TEMPLATES:
        w = template.split()
        texts += [f"intro words {template} more words", " ".join(w[: len(w) // 3]), " ".join(x for x in w if rng.random() > 0.06), " ".join(itertools.chain(*((x, "extra") if rng.random() < 0.05 else (x,) for x in w))), f"{template} {label} {template}"]
    return texts + [TEMPLATES[0][1] + " " + "word " * 20_000 + TEMPLATES[4][1], "free of charge to any person " * 400]


def test_licenses_like_plain_loops(spark):
    texts = license_texts()
    got = {r.doc_id: r for r in scan(frame(spark, texts, ("w", "named", "row", "label"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, (n, m, first, last, names, labels, score, found) = got[i], plain_scan(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n, m, first, last, names, labels)
        assert r.score == pytest.approx(score) and [tuple(s)[:3] for s in r.spans] == [s[:3] for s in found]
    whole = [got[9 + 5 * k] for k in range(len(TEMPLATES))]
    assert all(label in r.labels.split(",") and r.score == 1 for r, (label, _) in zip(whole, TEMPLATES, strict=True))


def test_repeated_and_null_rows_of_licenses(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (4, None), (4, "MIT license"), (4, "MIT license")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_base, r.labels, r.score) for r in scan(docs).collect()), key=str)
    assert got == sorted([(None, 1, "mit", 1.0), (4, 0, "", 0.0), (4, 1, "mit", 0.5), (4, 1, "mit", 0.5)], key=str)
    assert scan(docs.limit(0)).collect() == []


def test_licenses_stay_in_the_jvm(spark):
    plan = scan(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- spelling variants -----------------------------------------------------------------------------------------------


def plain_variants(counted):
    near = {a: [b for b in counted if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in counted}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-counted[b], b.encode()), default=None)
        form[a] = best if best and counted[best] >= 10 * counted[a] else None

    def root(a):
        return root(form[a]) if form[a] else a

    return {a: (form[a], root(a), counted[a], len(near[a]), counted.get(form[a])) for a in counted}


def edits(w, letters="abé"):
    yield from (w[:i] + w[i + 1 :] for i in range(len(w)))
    yield from (w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters)
    yield from (w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters)


def test_one_edit():
    for w in ("aab", "abab", "éab", "aaaa"):
        close = {x for x in edits(w) if x != w}
        for n in range(2, 6):
            for x in map("".join, itertools.product("abé", repeat=n)):
                if abs(len(x) - len(w)) < 2:
                    assert one_edit(w, x) == one_edit(x, w) == (x in close)


def vocabulary():
    rng = random.Random(8)
    bases = ["aaaaaaa", "abababab", "aaabaaab", "spelling", "éééaééé", "internationalization"] + ["".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(60)] + ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(60)]
    words = {x for b in bases for x in rng.sample(sorted({y for y in edits(b) if len(y) > 6}), 8)} | set(bases)
    return {w: rng.choice([2, 3, 20, 35, 400, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("crowd", [3, 2000])
def test_variants_like_plain_loops(spark, crowd):
    counted = vocabulary()
    got = variants.variants(spark.createDataFrame(list(counted.items()), "word string, n long"), crowd=crowd).collect()
    assert len(got) == len(counted) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(counted)
    assert sum(r.root != (r.form or r.word) for r in got) > 2


def test_count_filter_keeps_all_near_words():
    words = sorted(vocabulary())
    for size in {len(w) for w in words}:
        index = Index([w for w in words if len(w) == size])
        for w in words:
            if size - len(w) in (0, 1):
                assert sorted(index.near(w)) == [x for x in index.words if one_edit(w, x)]


def test_words_meet_under_two_grams():
    """A word and any word one edit from it, no shorter, share one of the two grams under which it asks."""
    q = variants.gram_length
    for w in ("abcde", "aabbaab", "abcabcabc", "éaéaéaéaéa"):
        first, second = variants._rarest({}).func(pd.Series([w]))[0]
        assert second - first >= q(len(w))
        for x in edits(w):
            if x != w and len(x) >= len(w):
                assert any(x[place : place + q(len(w))] == w[at : at + q(len(w))] for at in (first, second) for place in range(at, at + len(x) - len(w) + 1))


def test_word_counts(spark):
    texts = [None, "", "Spelling spelling SPELLING misspelt", "ÀÉÎÕÜßàé ÀÉÎÕÜßàé", "short words only", "naïveté×÷× x" + "y" * 3000, "a1bcdefgh spelling_misspelt", "y" * 3000] + ["common wording again"] * 40
    runs = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), x)) for i, t in enumerate(texts) for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    want, slips = {}, 0
    for i, run in runs:
        h = zlib.crc32(f"{i}:{run}".encode())
        if h % 31 == 0:
            run, slips = run[: h % len(run)] + run[h % len(run) + 1 :], slips + 1
        want[run] = want.get(run, 0) + 1
    got = {r.word: r.n for r in word_counts(frame(spark, texts, ("word", "n", "run", "h"))).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and slips


def test_odd_vocabularies(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.variants(empty).collect() == [] and near_pairs(empty.select("word")).collect() == []
    with pytest.raises(ValueError):
        near_pairs(spark.createDataFrame([("word",)], "word string"))
    null_ids = spark.createDataFrame([(None, "wording wording"), (3, None), (3, "wording"), (3, "wording")], "doc_id long, text string")
    assert sum(r.n for r in word_counts(null_ids).collect()) == 4
