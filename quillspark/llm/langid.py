"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts texts and n-grams of one to three characters for each language in every task and adds the counts up in
blocks. The class priors and the log-probability matrix (languages x BUCKETS) have a size that the corpus does not
change, and are broadcast. Scoring gathers matrix rows for the n-grams of a slice and sums them by text, all in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import U64, held_out, mix, shuffle_partitions, table, text_slices

BUCKETS, ORDERS, BLOCK = 1 << 16, 3, 1 << 12
SMOOTHING = 0.5
#: More languages than this can't be learned (the matrix is 256 KB for each).
MOST_LANGUAGES = 256
#: N-grams that count in full towards the certainty of a prediction; further ones only sharpen the mean.
EVIDENCE = 60
_ODD = np.random.Generator(np.random.PCG64(3)).integers(1, 2**63, ORDERS, dtype=np.uint64) | U64(1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-cased texts (in one array, n-gram order by order), and their number by text."""
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    starts = ends - size
    row = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(ends, size) - np.arange(len(code))
    ids, rows, value = [], [], np.zeros(len(code), np.uint64)
    for k in range(ORDERS):
        value[: len(code) - k] = mix(value[: len(code) - k] * _ODD[k] + code[k:] + U64(k))
        fits = left > k
        ids.append((value[fits] >> U64(48)).astype(np.int64) % BUCKETS)
        rows.append(row[fits])
    del starts
    return np.concatenate(ids), np.concatenate(rows)


def _lower(column: pa.Array) -> list[str]:
    return pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "").to_pylist()


def count(batches):
    """(lang, block, counts, texts) of a partition; the number of texts stands in each block."""
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for part in text_slices(batches, "text"):
        langs = part.column("lang").to_pylist()
        ids, rows = grams(_lower(part.column("text")))
        names = sorted(set(langs))
        which = np.array([names.index(x) for x in langs])[rows]
        for i, name in enumerate(names):
            total[name] = total.get(name, 0) + np.bincount(ids[which == i], minlength=BUCKETS)
            texts[name] = texts.get(name, 0) + langs.count(name)
    for name, n in total.items():
        blocks = n.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(list(blocks), pa.list_(pa.int64())), pa.array([texts[name]] * len(blocks))], _COUNTED)


_COUNTED = ["lang", "block", "counts", "texts"]


def add_up(batches):
    """Sums of the counts of equal (lang, block), all of which are in one partition."""
    total: dict[tuple, np.ndarray] = {}
    texts: dict[tuple, int] = {}
    for b in batches:
        for name, block, n, m in zip(b.column("lang").to_pylist(), b.column("block").to_pylist(), b.column("counts"), b.column("texts").to_pylist(), strict=True):
            total[name, block] = total.get((name, block), 0) + n.values.to_numpy()
            texts[name, block] = texts.get((name, block), 0) + m
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.list_(pa.int64())), pa.array(list(texts.values()), pa.int64())], _COUNTED)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the float32 matrix of log-probabilities and the log priors, from all rows with text and language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    schema = "lang string, block int, counts array<long>, texts long"
    found = rows.mapInArrow(count, schema).repartition(shuffle_partitions(spark), "lang", "block").mapInArrow(add_up, schema).limit(MOST_LANGUAGES * BUCKETS // BLOCK + 1).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    n, texts = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for name, block, counts, m in zip(found.column("lang").to_pylist(), found.column("block").to_pylist(), found.column("counts"), found.column("texts").to_pylist(), strict=True):
        n[langs.index(name), block * BLOCK : (block + 1) * BLOCK] = counts.values.to_numpy()
        texts[langs.index(name)] = m
    n += SMOOTHING
    return langs, (np.log(n) - np.log(n.sum(axis=1, keepdims=True))).astype(np.float32), np.log(texts / max(texts.sum(), 1))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest learned language, and its probability under tempered evidence.

    The posterior is the prior times the mean likelihood of an n-gram to the power of the number of n-grams, EVIDENCE of
    them at most: n-grams overlap, so more of them say less than as many independent ones.

    A text that is null or has no letter gives `und` and 0, and so does every text if no language was learned.
    Languages that tie go to the first by name. Repeated rows give repeated rows; other columns are ignored.
    """
    spark = docs.sparkSession
    langs, prior, sent = model[0], model[2], spark.sparkContext.broadcast(model[1])

    def score(batches):
        matrix = sent.value
        for part in text_slices(batches, "text"):
            letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            ids, rows = grams(_lower(part.column("text")))
            like = np.stack([np.bincount(rows, m[ids], minlength=part.num_rows) for m in matrix]) if len(langs) else np.zeros((1, part.num_rows))
            n = np.maximum(np.bincount(rows, minlength=part.num_rows), 1)
            like = like / n * np.minimum(n, EVIDENCE) + (prior[:, None] if len(langs) else 0)
            best = like.argmax(axis=0)
            sure = 1 / np.exp(like - like.max(axis=0)).sum(axis=0)
            known = letters & bool(langs)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, sure, 0.0))], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
