"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words are hashed into buckets. The WORDS most frequent ones are outputs of their own, the others share REST classes by
their corpus counts. A small network predicts each token from the SIDE tokens on either side, in two softmaxes: over
groups of words, and over the words of the group. The same windows elsewhere in the corpus count too: with c
occurrences of a window in other places, p of them around this token, the token has the probability

    (p + network) / (c + 1),

the mean of a Dirichlet prior that weighs one occurrence and has the network's distribution. These window counts cover
every token and grow with the corpus, while the network has a size that the corpus does not change. The sum of the
log-probabilities of all tokens, each with the token itself masked, is the pseudo-likelihood of a document.

Texts are tokenized once and dealt into shards of about SHARD_BYTES by a hash of id and text, so nothing depends on how
files are split. Training masks every token once: each of ROUNDS rounds every ROUNDS-th token, from a first one that
differs by text. In a round each shard trains from the same start (Adam in numpy), and the parameters are averaged by
number of tokens. Windows are counted inside each shard first; each distinct one is sent, with its count, to the part
that its hash names, and the totals of those that occur more than once come back to the shard. Shards are a table in
buckets, so that only these totals move where they join, and what moves is written in as few bytes as its values need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import U64, bytes_of, discard, materialize_bucketed, mix, release, shuffle_partitions, table, text_slices
from quillspark.llm.toxicity import BUCKETS, tokens

WORDS, GROUP, REST = 4096, 128, 32
GROUPS = WORDS // GROUP
CLASSES = GROUPS + REST
SIDE, SIZE, HIDDEN = 2, 12, 24
ROUNDS, STEP, BATCH = 2, 0.04, 4096
BLOCK = 4096
#: Rows that are scored at once.
CHUNK = 4096
PAD = WORDS + REST
#: Text of a shard in bytes, and distinct windows of a part of the window counts (8 bytes each), on average.
SHARD_BYTES, PART_WINDOWS = 3 << 20, 2 << 20
#: Bits of a window's hash that are compared inside its part, beside those of the token.
WINDOW_BITS = 63 - (BUCKETS - 1).bit_length()
#: Bytes of a token where texts are dealt.
WORD_BYTES = ((BUCKETS - 1).bit_length() + 7) // 8

#: Outputs have their biases as a last row, for a hidden value that is always 1.
SHAPES = {"embed": (PAD + 1, SIZE), "inner": (2 * SIDE * SIZE, HIDDEN), "inner_bias": (HIDDEN,), "classes": (HIDDEN + 1, CLASSES), "words": (GROUPS, HIDDEN + 1, GROUP)}
_SIZES = [int(np.prod(s)) for s in SHAPES.values()]
#: Outputs up to this size need no shift before exp: e^60 and its sums are far inside the range of a float.
SAFE = 60


def planes(x: np.ndarray) -> bytes:
    """Integers from 0 on, in as many bytes each as the largest needs: that number, all lowest bytes, all second ones, and
    so on. Bytes of one place are alike, so they pack well."""
    width = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    out = np.empty((width, len(x)), np.uint8)
    for k in range(width):
        out[k] = (x >> 8 * k) & 255
    return bytes([width]) + out.tobytes()


def from_planes(column: pa.Array, k: int) -> np.ndarray:
    raw = np.frombuffer(column[k].as_buffer(), np.uint8)
    parts = raw[1:].reshape(raw[0], -1)
    out = parts[0].astype(np.int64)
    for place, x in enumerate(parts[1:], 1):
        out |= x.astype(np.int64) << 8 * place
    return out


# --- shards ---------------------------------------------------------------------------------------------------------


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, ids, sizes, words): all texts, a row for each shard. A null text has no words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = int(size // SHARD_BYTES) + 1
    buckets = min(number, shuffle_partitions(spark))

    def tokenize(batches):
        for part in text_slices(batches, "text"):
            bucket, bounds, _, _ = tokens(part.column("text"))
            data = bucket.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64) * WORD_BYTES), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("h"), part.column("id"), words.cast(pa.binary())], ["shard", "h", "id", "words"])

    def pack(batches):
        held, shard = [], None
        for b in batches:
            here = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(here[1:] != here[:-1]) + 1).tolist(), len(here)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a:
                    if held and here[a] != shard:
                        yield _packed(shard, held)
                        held = []
                    shard = here[a]
                    held.append(b.slice(a, z - a))
        if held:
            yield _packed(shard, held)

    rows = rows.withColumn("h", F.xxhash64("id", "text")).withColumn("shard", F.pmod("h", F.lit(number)))
    dealt = rows.mapInArrow(tokenize, "shard long, h long, id long, words binary").repartition(buckets, "shard").sortWithinPartitions("shard", "h", "id")
    return materialize_bucketed(dealt.mapInArrow(pack, "shard long, ids array<long>, sizes array<int>, words binary"), "shards", "shard", buckets)


def _packed(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    found = [bytes_of(b.column("words")) for b in held]
    data = np.concatenate([d for d, _ in found]).reshape(-1, WORD_BYTES).astype(np.int64)
    words = (data << 8 * np.arange(WORD_BYTES)).sum(axis=1)
    ids = pa.concat_arrays([b.column("id") for b in held])
    sizes = pa.array(np.concatenate([np.diff(o) // WORD_BYTES for _, o in found]).astype(np.int32))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), one(ids), one(sizes), pa.array([planes(words)], pa.binary())], ["shard", "ids", "sizes", "words"])


def unpacked(batches):
    """(batch row, words, bounds) of each shard."""
    for b in batches:
        for k in range(b.num_rows):
            words = from_planes(b.column("words"), k)
            sizes = b.column("sizes")[k].values.to_numpy()
            yield b.slice(k, 1), words, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    release()


def count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for _, words, _ in unpacked(batches):
        total += np.bincount(words, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def vocabulary(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output of each bucket, and the log of the bucket's share of its output (0 for a word of its own; else add-one
    smoothed counts)."""
    order = np.argsort(-counts, kind="stable")
    word = (np.arange(BUCKETS) * 2654435761 % 2**32 >> 8) % REST + WORDS
    word[order[:WORDS]] = np.arange(WORDS)
    smooth = counts + 1.0
    share = np.log(smooth) - np.log(np.bincount(word, smooth, PAD))[word]
    share[order[:WORDS]] = 0
    return word.astype(np.int32), share.astype(np.float32)


def around(words: np.ndarray, bounds: np.ndarray, pad: int, of: np.ndarray | None = None) -> np.ndarray:
    """The 2 * SIDE neighbours of each token, or of those given; `pad` beyond the ends of its document."""
    rows = len(bounds) - 1
    # SIDE places before each document and after the last one
    at = np.arange(len(words)) + SIDE * (np.repeat(np.arange(rows), np.diff(bounds)) + 1)
    spaced = np.full(len(words) + SIDE * (rows + 1), pad, np.int32)
    spaced[at] = words
    if of is not None:
        at = at[of]
    out = np.empty((len(at), 2 * SIDE), np.int32)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        out[:, k] = spaced[at + step]
    return out


# --- the network ----------------------------------------------------------------------------------------------------


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    p = {k: x.reshape(s) for x, (k, s) in zip(np.split(flat, np.cumsum(_SIZES)[:-1]), SHAPES.items(), strict=True)}
    return p | {"class": p["classes"][:-1], "class_bias": p["classes"][-1], "word": p["words"][:, :-1], "word_bias": p["words"][:, -1]}


def start(word_counts: np.ndarray) -> np.ndarray:
    """Parameters before training: outputs as frequent as in the corpus, whatever the context."""
    rng = np.random.Generator(np.random.PCG64(5))
    flat = np.empty(sum(_SIZES))
    p = unpack(flat)
    for k in ("embed", "inner", "inner_bias", "class", "class_bias", "word", "word_bias"):
        p[k][:] = rng.standard_normal(p[k].shape) * (0.3 if k in ("embed", "inner") else 0.03)
    p["inner_bias"][:] = 0
    own = word_counts[:WORDS].reshape(GROUPS, GROUP) + 0.1
    classes = np.concatenate((own.sum(axis=1), word_counts[WORDS:PAD] + 0.1))
    p["class_bias"][:] = np.log(classes / classes.sum())
    p["word_bias"][:] = np.log(own / own.sum(axis=1, keepdims=True))
    return flat.astype(np.float32)


def class_of(word: np.ndarray) -> np.ndarray:
    return np.where(word < WORDS, word // GROUP, word - WORDS + GROUPS)


def hidden(p: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and hidden values of each context; the last hidden value is 1."""
    x = p["embed"].take(context, axis=0).reshape(len(context), -1)
    z = x @ p["inner"]
    z += p["inner_bias"]
    h = np.ones((len(context), HIDDEN + 1), z.dtype)
    h[:, :-1] = np.tanh(z, out=z)
    return x, h


def largest(p: dict) -> float:
    """A bound of all outputs, as hidden values are 1 at most."""
    return max(float(np.abs(p[k]).sum(axis=-2).max()) for k in ("classes", "words"))


def outputs(h: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    z = h @ weights
    if not most <= SAFE:
        z -= z.max(axis=1, keepdims=True)
    return z


def gradient(z: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """What the rows of z, outputs that become errors, are to be multiplied by to be the gradient of the mean loss of n
    examples."""
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + target] -= total
    return (1 / (n * total))[:, None]


def log_shares(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each row's target by its outputs, which are overwritten."""
    own = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + target]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def by_class(target: np.ndarray) -> np.ndarray:
    return np.argsort(class_of(target).astype(np.uint16), kind="stable")


def groups(classes: np.ndarray):
    """(group, first row, last row + 1) of the rows, sorted by class, whose output is a word of its own."""
    cuts = np.searchsorted(classes, np.arange(GROUPS + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        yield g, cuts[g], cuts[g + 1]


def log_probabilities(p: dict, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target output given its context."""
    out, order, most = np.empty(len(target), p["embed"].dtype), by_class(target), largest(p)
    for first in range(0, len(order), CHUNK):
        rows = order[first : first + CHUNK]
        h, words = hidden(p, context[rows])[1], target[rows]
        classes = class_of(words)
        logs = log_shares(outputs(h, p["classes"], most), classes)
        for g, a, z in groups(classes):
            logs[a:z] += log_shares(outputs(h[a:z], p["words"][g], most), words[a:z] % GROUP)
        out[rows] = logs
    return out


class Adam:
    """Stochastic training of the flat parameters on (context, output) examples."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.m, self.v, self.t = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
        self.g, self.spare = np.zeros_like(flat), np.empty_like(flat)
        self.p, self.grad = unpack(self.flat), unpack(self.g)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        p, grad, n, most = self.p, self.grad, len(target), largest(self.p)
        order = by_class(target)
        context, target = context[order], target[order]
        classes, place = class_of(target), target % GROUP
        x, h = hidden(p, context)
        d = outputs(h, p["classes"], most)
        weight = gradient(d, classes, n)
        dh = d @ p["class"].T
        dh *= weight
        np.matmul((h * weight).T, d, out=grad["classes"])
        grad["words"][:] = 0
        for k, a, z in groups(classes):
            e = outputs(h[a:z], p["words"][k], most)
            weight = gradient(e, place[a:z], n)
            np.matmul((h[a:z] * weight).T, e, out=grad["words"][k])
            dh[a:z] += weight * (e @ p["word"][k].T)
        slope = h[:, :-1] ** 2
        dh *= np.subtract(1, slope, out=slope)
        np.matmul(x.T, dh, out=grad["inner"])
        np.matmul(np.ones(n, dh.dtype), dh, out=grad["inner_bias"])
        dx, cell = p["inner"] @ dh.T, context.T.astype(np.int64).ravel()
        for k in range(SIZE):
            grad["embed"][:, k] = np.bincount(cell, dx[k::SIZE].ravel(), PAD + 1)
        self.t += 1
        g, spare = self.g, self.spare
        self.v *= 0.999
        self.v += np.multiply(np.multiply(g, g, out=spare), 0.001, out=spare)
        self.m *= 0.9
        self.m += np.multiply(g, 0.1, out=spare)
        np.sqrt(np.divide(self.v, 1 - 0.999**self.t, out=spare), out=spare)
        spare += 1e-8
        np.divide(self.m, spare, out=spare)
        spare *= STEP / (1 - 0.9**self.t)
        self.flat -= spare


def fit_shards(packed: DataFrame) -> dict:
    """The network, from every token of the shards."""
    spark = packed.sparkSession
    found = packed.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.bucket] = found.n
    word, share = vocabulary(counts)
    flat = start(np.bincount(word, counts, PAD))
    sent = spark.sparkContext.broadcast(word)

    def train_from(begin, turn):
        def train(batches):
            total, seen = 0.0, 0
            for _, words, bounds in unpacked(batches):
                if not len(words):
                    continue
                own, adam = sent.value[words], Adam(begin.value)
                # the first masked token differs from text to text; over all rounds each token is masked once
                first = words[np.minimum(bounds[:-1], len(words) - 1)] - bounds[:-1]
                masked = np.flatnonzero((np.arange(len(own)) + np.repeat(first, np.diff(bounds))) % ROUNDS == turn)
                context, target = around(own, bounds, PAD, masked), own[masked]
                for a in range(0, len(target), BATCH):
                    adam.step(context[a : a + BATCH], target[a : a + BATCH])
                if len(masked):
                    total, seen = total + adam.flat.astype(np.float64) * len(masked), seen + len(masked)
            if seen:
                blocks = np.array_split(total, -(-len(total) // BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.list_(pa.float64()))], ["block", "seen", "sums"])

        return train

    def add_up(batches):
        total: dict[int, list] = {}
        for b in batches:
            for block, seen, sums in zip(b.column("block").to_pylist(), b.column("seen").to_pylist(), b.column("sums"), strict=True):
                old = total.get(block, [0, 0.0])
                total[block] = [old[0] + seen, old[1] + sums.values.to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1] for x in total.values()], pa.list_(pa.float64()))], ["block", "seen", "sums"])

    schema = "block int, seen long, sums array<double>"
    trained = 0
    for turn in range(ROUNDS):
        begin = spark.sparkContext.broadcast(flat)
        means = packed.mapInArrow(train_from(begin, turn), schema).repartition(shuffle_partitions(spark), "block").mapInArrow(add_up, schema).toArrow().to_pylist()
        if not means:
            continue
        trained += means[0]["seen"]
        flat = np.concatenate([np.array(m["sums"]) / m["seen"] for m in sorted(means, key=lambda m: m["block"])]).astype(np.float32)
    return {"word": word, "share": share, "flat": flat, "trained": trained}


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> dict:
    """The network, from every text of docs."""
    packed = shards(docs, id_col, text_col)
    model = fit_shards(packed)
    discard(packed)
    return model


# --- windows --------------------------------------------------------------------------------------------------------


def windows(words: np.ndarray, bounds: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and key of each token's window and the token: keys that agree but for the token's bits are one window."""
    c = np.full(len(words), 0x51ED270B, np.uint64)
    for column in around(words, bounds, -1).T:
        c = mix(c * U64(0xD6E8FEB86659FD93) + (column.astype(np.int64) + 2).astype(np.uint64))
    bits = (BUCKETS - 1).bit_length()
    part = ((c >> U64(WINDOW_BITS)).astype(np.int64)) % parts
    return part, ((c & U64(2**WINDOW_BITS - 1)) << U64(bits) | words.astype(np.uint64)).astype(np.int64)


def distinct(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens by (part, key), and the number of each token's distinct (part, key) in it."""
    order = np.argsort(key)
    if len(part) and part.max() > 0:
        order = order[np.argsort(part[order].astype(np.uint16 if part.max() < 1 << 16 else np.int64), kind="stable")]
    part, key = part[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def window_counts(packed: DataFrame, parts: int) -> DataFrame:
    """(shard, part, met, same, all): for the shard's distinct windows with their tokens that lie in the part, a bit each
    that is set if the window occurs more than once in the corpus; for those, the occurrences of window and token, and
    of the window."""
    bits = (BUCKETS - 1).bit_length()

    def emit(batches):
        for row, words, bounds in unpacked(batches):
            if len(words):
                part, key = windows(words, bounds, parts)
                first, number = distinct(part, key)
                n, part, key = np.bincount(number), part[first], key[first]
                there = np.unique(part)
                cuts = np.append(np.searchsorted(part, there), len(part)).tolist()
                steps = np.diff(key, prepend=0)
                steps[cuts[:-1]] = key[cuts[:-1]]
                lists = [pa.array([planes(x[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (steps, n)]
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([row.column("shard")[0].as_py()] * len(there), pa.int64()), *lists], ["part", "shard", "keys", "n"])

    def total(batches):
        held, name = [], None

        def finish():
            if not held:
                return
            sizes = [len(k) for _, k, _ in held]
            key, n = np.concatenate([k for _, k, _ in held]), np.concatenate([x for _, _, x in held])
            order = np.argsort(key)
            key, n = key[order], n[order]
            sums = []
            for shift in (0, bits):
                code = key >> shift
                new = np.append(True, code[1:] != code[:-1])
                sums.append(np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1])
            same, every = np.empty_like(sums[0]), np.empty_like(sums[0])
            same[order], every[order] = sums
            start = 0
            for (shard, _, _), m in zip(held, sizes, strict=True):
                met = every[start : start + m] > 1
                if met.any():
                    at = start + np.flatnonzero(met)
                    values = (np.packbits(met).tobytes(), planes(same[at]), planes(every[at]))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in values)], ["shard", "part", "met", "same", "all"])
                start += m

        for b in batches:
            for k in range(b.num_rows):
                part = b.column("part")[k].as_py()
                if part != name:
                    yield from finish()
                    held, name = [], part
                held.append((b.column("shard")[k].as_py(), np.cumsum(from_planes(b.column("keys"), k)), from_planes(b.column("n"), k)))
        yield from finish()
        release()

    found = packed.mapInArrow(emit, "part long, shard long, keys binary, n binary")
    met = found.repartition(min(parts, shuffle_partitions(packed.sparkSession)), "part").sortWithinPartitions("part", "shard")
    return met.mapInArrow(total, "shard long, part long, met binary, same binary, all binary")


def score_shards(packed: DataFrame, model: dict) -> DataFrame:
    tokens_ = packed.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = min(int(tokens_ // PART_WINDOWS) + 1, 1 << 20)
    known = window_counts(packed, parts).groupBy("shard").agg(F.collect_list(F.struct("part", "met", "same", "all")).alias("known"))
    sent = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        p = unpack(m["flat"])
        for row, words, bounds in unpacked(batches):
            n, logs = np.diff(bounds), np.zeros(0)
            if len(words):
                part, key = windows(words, bounds, parts)
                # a window with its token has the same probability wherever it is
                first, number = distinct(part, key)
                own = m["word"][words]
                logs = log_probabilities(p, around(own, bounds, PAD, first), own[first]).astype(np.float64) + m["share"][words[first]]
                base = np.searchsorted(part[first], np.arange(parts))
                found = row.column("known")[0].values
                if found is not None:
                    for k, name in enumerate(found.field("part").to_pylist()):
                        same, every = from_planes(found.field("same"), k), from_planes(found.field("all"), k)
                        bit = np.unpackbits(np.frombuffer(found.field("met")[k].as_buffer(), np.uint8))
                        at = base[name] + np.flatnonzero(bit)
                        # the token's own occurrence is masked
                        logs[at] = np.log(same - 1 + np.exp(logs[at])) - np.log(every)
                logs = logs[number]
            total = np.diff(np.concatenate(([0.0], np.cumsum(logs)))[bounds])
            yield pa.RecordBatch.from_arrays([row.column("ids")[0].values, pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_tokens", "log_likelihood", "per_token"])

    return packed.join(known, "shard", "left").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, per_token double")


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token): the pseudo-likelihood of each text and its mean by token, with the
    windows of docs counted.

    Null, empty and wordless texts have no tokens and 0 for both. Equal texts score alike (up to rounding); repeated rows
    give repeated rows, a null id is an id like others, and an empty table gives an empty one; other columns are ignored.
    """
    return score_shards(shards(docs, id_col, text_col), model)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = shards(table(spark, sf_dir, "documents"))
    return score_shards(packed, fit_shards(packed))
