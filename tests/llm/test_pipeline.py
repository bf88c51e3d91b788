"""The pipeline on planted cases: each stage does what a plain version of it does, and leaves clean documents alone."""

import random

import pytest

import corpus_pipeline
from quillspark.llm.pieces import MODEL, Segmenter, read_pieces


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "vo", "sa"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(60)
    rows: dict[int, str | None] = {i: text(80) for i in range(120)}
    rows[200], rows[201], rows[202] = None, "", "short"
    rows[210] = rows[0]  # an exact copy
    rows[211] = rows[1] + " extra words"  # a near copy
    rows[220] = text(40) + " " + item + " " + text(40)  # a leak
    rows[230] = text(50) + " " + passage + " " + text(20)
    rows[231] = text(10) + " " + passage + " " + text(70)  # repeats the passage of 230
    toxic = {300 + i: text(40) + " zzbad zzworse " + text(30) for i in range(60)}
    rows |= toxic
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*range(120), *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic, passage


def test_stages(spark, corpus):
    folder, rows, toxic, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, set(rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        got = {r.doc_id: r for r in docs.collect()}
        kept -= {"toxicity": set(toxic), "minhash": {201, 210, 211} - {201}, "decontaminate": {220}}.get(name, set())
        assert set(got) == kept, name
        if name != "sentencepiece":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        if name == "suffix_array":
            assert passage in got[230].text and passage not in got[231].text
            assert got[231].n_chars == len(got[231].text)
            assert all(got[i].text == rows[i] for i in kept - {231})
    model = Segmenter(read_pieces(MODEL))
    assert all(model.decode(r.ids) == (rows[i] or "") for i, r in got.items() if i != 231)


def test_run_is_the_stages(spark, corpus):
    assert {r.doc_id for r in corpus_pipeline.run(spark, corpus[0]).select("doc_id").collect()} == set(corpus[1]) - set(corpus[2]) - {210, 211, 220}


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0


def test_odd_columns_and_rows(spark, corpus):
    """Columns whose names the operators use themselves, null and repeated ids, null texts: every stage passes them on."""
    names = ["id", "component", "tree", "words", "kept", "kept_text", "removed", "n_bytes", "score", "toxic", "places", "carry_0", "ids", "item_id"]
    rows = [(None, "some words here", 15), (None, None, 0), (5, None, 0), (5, "", 0), (6, "a text of six words here", 24), (6, "a text of six words here", 24)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, *names) for i, t, n in rows], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"{c} string" for c in names)]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus[0])
        if name == "sentencepiece":
            assert out.count() == len(rows)
        else:
            assert out.columns == docs.columns, name
            key = lambda r: (r.doc_id or 0, r.text or "", r.n_chars, r.kept_text)
            assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect())), name
