"""Toxicity by maximum-scoring segments.

Token scores are log-odds of the classes under a Dirichlet prior, minus a constant drift, so that ordinary text
drifts down and toxic passages stand out as segments with a positive sum. All maximal segments of a text come from
one linear scan. How far a segment of that sum is beyond chance follows the extreme-value law of segment scores
(rate `lam` solves sum p exp(lam s) = 1 over benign tokens; `k` is fitted on benign texts), several segments are
combined by the sum statistics of that law, and the result is turned into a probability on the training texts.

Words are hashed into BUCKETS counts, so the model has the same size for any corpus. Calibration scores training
texts without their own counts (leave one out). Prior and drift are chosen among SETTINGS by these scores too: the pair
that parts the classes of the training texts best, so rows that are held out have no say.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import U64, RangeHash, bytes_of, held_out, table, text_slices

BUCKETS = 1 << 19
THRESHOLD = 0.7
#: Pairs of prior weight and drift to choose from; of equally good ones the first.
SETTINGS = ((4.0, 1.5), (4.0, 1.0), (4.0, 2.0), (2.0, 1.5), (2.0, 1.0), (2.0, 2.0), (8.0, 1.5), (8.0, 1.0), (8.0, 2.0))
#: Labels broadcast at most (two numbers each); beyond it labels and texts are joined by a shuffle.
BROADCAST_LABELS = 200_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word (letters and digits, lower case), row bounds, and byte range of each word in the lower-cased rows."""
    data, offsets = bytes_of(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    inside = np.concatenate(([False], _WORD[data], [False]))
    edge = np.zeros(len(data) + 2, bool)
    edge[offsets + 1] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
    bucket = (RangeHash(data)(starts, ends) >> U64(40)).astype(np.int64) % BUCKETS
    bounds = np.searchsorted(starts, offsets)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    return bucket, bounds, starts - base, ends - base


def count(batches):
    """(bucket, toxic, benign): in how many texts of each class the bucket occurs."""
    total = np.zeros((2, BUCKETS), np.int64)
    seen = False
    for part in text_slices(batches, "text"):
        bucket, bounds, _, _ = tokens(part.column("text"))
        row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
        pairs = np.unique(row * BUCKETS + bucket)
        toxic = part.column("toxic").to_numpy(zero_copy_only=False)[pairs // BUCKETS] > 0
        total[0] += np.bincount(pairs[toxic] % BUCKETS, minlength=BUCKETS)
        total[1] += np.bincount(pairs[~toxic] % BUCKETS, minlength=BUCKETS)
        seen = True
    if seen:
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "toxic", "benign"])


def token_scores(toxic: np.ndarray, benign: np.ndarray, share: float, prior: float, drift: float) -> np.ndarray:
    p = (np.maximum(toxic, 0) + prior * share) / (np.maximum(toxic, 0) + np.maximum(benign, 0) + prior)
    return (np.log(p / (1 - p)) - math.log(share / (1 - share)) - drift).astype(np.float32)


def rate(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive solution of sum p exp(lam s) = 1; 1 if there is none (no positive score)."""
    scores, weight = scores[weight > 0], weight[weight > 0]
    p = weight / max(weight.sum(), 1)
    if not (p[scores > 0] > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def best_sums(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest sum of a segment of each row (0 for none), from running sums and their running minima."""
    n = np.diff(bounds)
    drop = float(np.abs(scores).sum() * 2 + 1)
    total = np.cumsum(scores.astype(np.float64))
    before = total - scores
    row = np.repeat(np.arange(len(n)), n)
    low = np.minimum.accumulate(before - drop * row) + drop * row
    out = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.maximum.reduceat(total - low, bounds[:-1][full])
    return np.maximum(out, 0)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) in order: the linear scan over candidates with left and right totals."""
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, left, total))
    return [(a, b, r - left) for a, b, left, r in found]


def log_chance(sums: list[float], n: int, lam: float, k: float) -> float:
    """Log of the chance that benign text of n tokens has segments like the best r of these, for the best r."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(sums, reverse=True), 1):
        total += lam * s - math.log(max(k * n, 1e-9))
        if total > 0:
            best = min(best, r * math.log(2) - total + (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r))
    return best


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    few = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(labels) if few else labels, "id").where("text is not null").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model, from all labelled texts given; a text with several labels counts once for each."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    rows = with_labels(docs, known, id_col, text_col)
    counts = rows.mapInArrow(count, "bucket long, toxic long, benign long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("benign").alias("benign")).toPandas()
    both = np.zeros((2, BUCKETS), np.int64)
    both[0, counts.bucket], both[1, counts.bucket] = counts.toxic, counts.benign
    share = (both[0].sum() + 1) / (both.sum() + 2)
    models = [{"scores": token_scores(both[0], both[1], share, *setting), "setting": setting, "k": 0.1} for setting in SETTINGS]
    for m in models:
        m["lam"] = rate(m["scores"], both[1].astype(float))
    sent = docs.sparkSession.sparkContext.broadcast(both)
    lams = [m["lam"] for m in models]

    def measure(batches):
        """For each slice and setting: labels, bounds, leave-one-out token scores and best sums."""
        n = sent.value
        apart = [np.stack([token_scores(n[0], n[1] - 1, share, *setting), token_scores(n[0] - 1, n[1], share, *setting)]) for setting in SETTINGS]
        for part in text_slices(batches, "text"):
            bucket, bounds, _, _ = tokens(part.column("text"))
            toxic = (part.column("toxic").to_numpy(zero_copy_only=False) > 0).astype(int)
            label = np.repeat(toxic, np.diff(bounds))
            for k, scores in enumerate(apart):
                own = scores[label, bucket]
                yield k, toxic, bounds, own, best_sums(own, bounds)

    def excesses(batches):
        for k, toxic, bounds, _, top in measure(batches):
            # texts without a positive token say nothing about k, and have nothing to explain
            at = (toxic == 0) & (top > 0)
            excess = (lams[k] * top - np.log(np.maximum(np.diff(bounds), 1)))[at]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(excess.sum())]), pa.array([len(excess)])], ["setting", "total", "n"])

    for r in rows.mapInArrow(excesses, "setting int, total double, n long").groupBy("setting").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        if r.n:  # the mean of lam * best - log n is log k + Euler's constant
            models[r.setting]["k"] = math.exp(r.total / r.n - float(np.euler_gamma))
    ks = [m["k"] for m in models]

    def chances(batches):
        for k, toxic, bounds, own, top in measure(batches):
            level = np.zeros(len(toxic), np.int64)
            for i in np.flatnonzero(top > 0):
                level[i] = max(-2000, round(10 * log_chance([x[2] for x in segments(own[bounds[i] : bounds[i + 1]].tolist())], bounds[i + 1] - bounds[i], lams[k], ks[k])))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(toxic), pa.int32()), pa.array(toxic), pa.array(level)], ["setting", "toxic", "level"])

    grid = rows.mapInArrow(chances, "setting int, toxic long, level long").groupBy("setting", "toxic", "level").count().toPandas()
    parted = [part_classes(grid[grid.setting == k]) for k in range(len(SETTINGS))]
    best = max(range(len(SETTINGS)), key=lambda k: (parted[k][0], -k))
    # scale: the level that parts the classes best gets a probability of THRESHOLD
    return models[best] | {"scale": math.log((1 - THRESHOLD) / THRESHOLD) - min(parted[best][1], -0.01)}


def part_classes(grid) -> tuple[float, float]:
    """(F1, cut): how well a cut of the levels parts the classes at best, and the middle of such cuts."""
    levels = np.unique(grid.level)
    count = lambda label: np.array([grid[(grid.toxic == label) & (grid.level <= x)]["count"].sum() for x in levels])
    hit, wrong = count(1), count(0)
    if not len(levels) or not hit.max():
        return 0.0, math.log(0.001)
    f1 = 2 * hit / (hit + wrong + hit.max())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    upper = levels[best[-1] + 1] if best[-1] + 1 < len(levels) else levels[best[-1]] + 10
    return float(f1.max()), (levels[best[0]] + upper) / 20


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, passages): probability of toxicity, 1 from 0.7 on, and the toxic passages of the
    lower-cased UTF-8 text as (start, end, sum) in bytes.

    Null, empty and wordless texts have no segment and get the lowest score. Repeated rows give repeated rows, and
    equal texts equal scores; columns other than id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_slices(batches, "text"):
            out, passages = judge(part.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32)), pa.array(passages, _PASSAGES)], ["doc_id", "score", "predicted", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start: long, end: long, sum: double>>")


def judge(column: pa.Array, m: dict) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text, and its passages whose sums are beyond what benign text of its length has."""
    bucket, bounds, begin, end = tokens(column)
    own = m["scores"][bucket]
    top = best_sums(own, bounds)
    out, passages = np.full(len(column), 1 / (1 + math.exp(min(m["scale"], 700)))), [[] for _ in range(len(column))]
    for i in np.flatnonzero(top > 0):
        a, b = bounds[i], bounds[i + 1]
        found = segments(own[a:b].tolist())
        log_p = log_chance([x[2] for x in found], b - a, m["lam"], m["k"])
        out[i] = 1 / (1 + math.exp(min(log_p + m["scale"], 700)))
        cut = max(math.log(max(m["k"] * (b - a), 1e-9)), 0) / m["lam"] + 2.0 / m["lam"]
        passages[i] = [{"start": int(begin[a + x]), "end": int(end[a + y - 1]), "sum": s} for x, y, s in found if s > cut]
    return out, passages


def reject(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is not called toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_slices(batches, text_col):
            yield part.filter(pa.array(judge(part.column(text_col), sent.value)[0] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
