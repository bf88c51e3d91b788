"""MinHash near-duplicate detection with an LSH forest of sorted signature orders.

Every text becomes its set of five-word shingles. Equal sets fold into one class first, inside a slice of the input and
then by a grouping. Each class has TREES * DEPTH min-wise hashes; order t sorts all classes by the DEPTH hashes of tree
t, and neighbours in an order with a long common prefix are candidates. The depth adapts to the region of a first hash:
in a thin one (WHOLE others at most) all its texts are candidates of each other, in a crowded one the prefix that
neighbours must share grows with their distance (LAGS). A pair is looked at further if a 96-byte sketch does not rule
it out, and every link is confirmed on the full sets.

Links matter here only for what they connect, so candidates are taken between texts that are not joined yet:
1. Direct neighbours in a few orders, confirmed by a join. That joins most groups of near copies.
2. In all orders, texts that have a candidate in another component are marked; only marked texts go on, with their sets.
3. Marked neighbours are compared where they meet, and joined there: a task keeps the components of its rows, so it
   compares no two texts that it has joined and writes fewer links than it reads rows.
4. A crowded region is not searched whole by its order. All texts of crowded regions meet a second time, exactly: with
   shingles in one order of all texts, rare ones first, the first common shingle of a link lies in a prefix of either
   set (`crowded_pairs`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import U64, bytes_of, discard, hash_sets, join_least, materialize, mix, shuffle_partitions, table, text_slices
from quillspark.llm.graph import components, contract

TREES, DEPTH, WIDTH, SKETCH = 16, 6, 5, 96
#: Texts of one first hash up to which all of them are candidates of each other.
WHOLE = 128
#: In a more crowded region: (largest distance in the order, common prefix required up to it).
LAGS = ((8, 1), (16, 2), (32, 3), (64, 4))
#: Chance with which the sketch may rule out a pair that is just similar enough.
SKETCH_MISS = 1e-7
#: Counters by which shingles are ordered in the exact join; any order is right, a good one puts rare shingles first.
COUNTERS = 1 << 18
#: Rows of one shingle that meet at once; a more frequent one is split into blocks, each pair of which is a group.
MEET = 4096
#: Pairs that a task of the exact join holds at once.
AT_ONCE = 1 << 20
FIRST_ROUND_TREES = 3
#: Ids broadcast at most (8 bytes each) when texts are fetched by id; beyond it both sides are shuffled.
BROADCAST_IDS = 200_000

_MASKS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, (TREES * DEPTH, 2), dtype=np.uint64)


def sketch_least(similarity: int) -> int:
    """Hashes of two sketches that must agree: fewer have a chance of SKETCH_MISS at most at this similarity."""
    p = similarity / 100 + (1 - similarity / 100) / 256
    total = 0.0
    for k in range(SKETCH + 1):
        total += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if total > SKETCH_MISS:
            return k
    return SKETCH


def signatures(batches):
    """(ids, id, n, h1, h2, keys, sketch) of each distinct set of a slice: the ids that have it, the least of them, its
    size, two hashes of the set, a key for each tree, and the sketch. Rows without an id are rows of their own."""
    for part in text_slices(batches, "text"):
        sets = hash_sets(part, "text", WIDTH)
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        full = np.flatnonzero(n)
        starts = np.concatenate(([0], np.cumsum(n)))[:-1][full]
        both = np.zeros((2, len(n)), np.uint64)
        if len(full):
            both[0, full] = np.add.reduceat(mix(flat), starts)
            both[1, full] = np.add.reduceat(mix(flat ^ _MASKS[0, 0]), starts)
        same: dict[tuple, list[int]] = {}
        given = part.column("id").to_pylist()
        for i, (own, *key) in enumerate(zip(given, n.tolist(), both[0].tolist(), both[1].tolist(), strict=True)):
            same.setdefault((own is None and i, *key), []).append(i)
        first = np.array([rows[0] for rows in same.values()], np.int64)
        low = np.zeros((TREES * DEPTH, len(first)), np.uint64)
        full = np.flatnonzero(n[first])
        if len(full):
            flat = np.concatenate([sets[i] for i in first[full]])
            starts = np.concatenate(([0], np.cumsum(n[first[full]])))[:-1]
            for k, (a, b) in enumerate(_MASKS):
                low[k, full] = np.minimum.reduceat((flat ^ a) * (b | U64(1)), starts)
        low = mix(low)
        keys = (low >> U64(32)).astype(">u4").T.copy().view(f"S{4 * DEPTH}")
        keys = [[row[4 * DEPTH * t : 4 * DEPTH * (t + 1)] for t in range(TREES)] for row in (k.tobytes() for k in keys)]
        sketch = [r.tobytes() for r in (low[-SKETCH:] & U64(255)).astype(np.uint8).T]
        ids = [[given[i] for i in rows] for rows in same.values()]
        least = [None if x[0] is None else min(x) for x in ids]
        columns = (ids, least, n[first], both[0, first].view(np.int64), both[1, first].view(np.int64), keys, sketch)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)


_SIGNED = pa.schema([("ids", pa.list_(pa.int64())), ("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.binary())), ("sketch", pa.binary())])


def full_sets(batches):
    """(id, n, words): each text's set as sorted hashes."""
    for part in text_slices(batches, "text"):
        sets = hash_sets(part, "text", WIDTH)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "words"])


def linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets reach the similarity (in hundredths)."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= similarity * (len(both) - common)


# --- sorted orders --------------------------------------------------------------------------------------------------

ROW = "tree int, key binary, id long, n long, component long, sketch binary, words binary"
COLUMNS = [f.split()[0] for f in ROW.split(", ")]
FOUND = f"a long, b long, edge boolean, {ROW}"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.bool_()), ("tree", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("sketch", pa.binary()), ("words", pa.binary())])


class _Rows:
    """Rows of an order as arrays; `sent` marks those that have been passed on."""

    def __init__(self, columns: list[np.ndarray]):
        self.tree, self.key, self.id, self.n, self.component, self.sketch, self.words, self.sent = columns

    @classmethod
    def of(cls, b: pa.RecordBatch) -> _Rows:
        c = {k: b.column(k) for k in b.schema.names}
        m = b.num_rows
        long = lambda k: c[k].to_numpy(zero_copy_only=False).copy()
        words = np.empty(m, object)
        for i, x in enumerate(c["words"].to_pylist()):  # one by one: sets of one size must not become a matrix
            words[i] = x if x is None else np.frombuffer(x, np.uint64)
        return cls([long("tree"), bytes_of(c["key"])[0].reshape(m, 4 * DEPTH).copy().view(">u4").astype(np.uint32), long("id"), long("n"), long("component"), bytes_of(c["sketch"])[0].reshape(m, -1), words, np.zeros(m, bool)])

    def columns(self) -> list[np.ndarray]:
        return [self.tree, self.key, self.id, self.n, self.component, self.sketch, self.words, self.sent]

    def take(self, where) -> _Rows:
        return _Rows([x[where] for x in self.columns()])

    def __add__(self, other: _Rows) -> _Rows:
        return _Rows([np.concatenate(x) for x in zip(self.columns(), other.columns(), strict=True)])

    def batch(self, edge: bool) -> pa.RecordBatch:
        m = len(self.id)
        columns = (pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), [edge] * m, self.tree, [x.tobytes() for x in self.key.astype(">u4")], self.id, self.n, self.component, [x.tobytes() for x in self.sketch], [x if x is None else x.tobytes() for x in self.words])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _ids(pairs: np.ndarray) -> pa.RecordBatch:
    m = pairs.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), *(pa.nulls(m, f.type) for f in list(_FOUND)[2:])], schema=_FOUND)


def neighbours(rows: _Rows, new: int, reach: int, similarity: int):
    """(x, y) for each distance: places of rows from `new` on and of earlier rows of their region that the region's depth
    admits, and whose sizes and sketches allow a link."""
    m, least = len(rows.id), sketch_least(similarity)
    begins = np.r_[True, (rows.tree[1:] != rows.tree[:-1]) | (rows.key[1:, 0] != rows.key[:-1, 0])]
    heads = np.flatnonzero(begins)
    size = np.diff(np.append(heads, m))
    head, thin = np.repeat(heads, size), np.repeat(size <= WHOLE + 1, size)
    alive = np.arange(max(new, 1), m)
    for lag in range(1, reach + 1):
        alive = alive[alive - lag >= head[alive]]
        depth = next((d for most, d in LAGS if lag <= most), None)
        near = thin[alive]
        if depth:
            near = near | (rows.key[alive, :depth] == rows.key[alive - lag, :depth]).all(axis=1)
        alive = alive[near]
        if not len(alive):
            return
        x, y = alive, alive - lag
        fits = 100 * np.minimum(rows.n[x], rows.n[y]) >= similarity * np.maximum(rows.n[x], rows.n[y])
        x, y = x[fits], y[fits]
        alike = (rows.sketch[x] == rows.sketch[y]).sum(axis=1) >= least
        if alike.any():
            yield x[alike], y[alike]


def scan(batches, step: str, similarity: int, edges: bool):
    """One sorted partition. step `pairs`: neighbours next to each other; `mark`: rows with a candidate in another
    component; `link`: links between components. edges: also the rows of the partition's first and last region, which
    may go on in the next partition."""
    reach, held, seen, one = (1 if step == "pairs" else WHOLE), None, 0, True
    names_it = lambda rows, at: (rows.tree[at], rows.key[at, 0])
    inside = lambda rows, name: (rows.tree == name[0]) & (rows.key[:, 0] == name[1])
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _Rows.of(batch)
        if edges and one:
            begin = begin if seen else names_it(rows, 0)
            first = inside(rows, begin)
            yield rows.take(np.flatnonzero(first)[: max(reach - seen, 0)]).batch(True)
            one = bool(first.all())
        seen += batch.num_rows
        new = len(held.id) if held else 0
        held = held + rows if held else rows
        if step == "pairs":
            for x, y in neighbours(held, new, 1, similarity):
                yield _ids(np.stack((held.id[x], held.id[y])))
        elif step == "mark":
            found = np.zeros(len(held.id), bool)
            for x, y in neighbours(held, new, reach, similarity):
                apart = held.component[x] != held.component[y]
                found[x[apart]] = found[y[apart]] = True
            found &= ~held.sent
            held.sent |= found
            yield held.take(np.flatnonzero(found)).batch(False)
        else:
            names, at = np.unique(held.component, return_inverse=True)
            low = np.arange(len(names))
            for x, y in neighbours(held, new, reach, similarity):
                apart = low[at[x]] != low[at[y]]
                x, y = x[apart], y[apart]
                ok = np.array([linked(held.words[i], held.words[j], similarity) for i, j in zip(x, y, strict=True)], bool)
                if ok.any():
                    join_least(low, at[x[ok]], at[y[ok]])
                    yield _ids(np.stack((held.id[x[ok]], held.id[y[ok]])))
            held.component = names[low[at]]
        held = held.take(slice(max(0, len(held.id) - reach), None))
    if edges and seen:
        last = np.flatnonzero(inside(held, names_it(held, -1)))
        if one:  # the first rows of this only region are out already
            last = last[len(last) - min(reach, max(seen - reach, 0)) :]
        yield held.take(last).batch(True)


def scanned(orders: DataFrame, step: str, similarity: int, spent: list[DataFrame]) -> DataFrame:
    """Rows of `scan` over the sorted orders. Regions that cross a border of the range partitioning are put together
    from the rows at the borders, by tree and first hash, and scanned once more. spent: gets the table to discard."""
    n, by = shuffle_partitions(orders.sparkSession), ("tree", "key", "id")
    run = lambda edges: lambda it: scan(it, step, similarity, edges)
    found = orders.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run(step != "pairs"), FOUND)
    if step == "pairs":
        return found
    found = materialize(found, step)
    spent.append(found)
    crossing = found.where("edge").select(*COLUMNS).distinct().repartition(n, "tree", F.substring("key", 1, 4)).sortWithinPartitions(*by)
    return found.where("edge is null or not edge").unionByName(crossing.mapInArrow(run(False), FOUND))


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is in ids: a broadcast while the ids are few enough, else a shuffled semi join."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return with_ids(docs, ids).mapInArrow(full_sets, "id long, n long, words binary")


def confirmed(pairs: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """Those pairs whose full shingle sets reach the similarity (in hundredths)."""

    def check(batches):
        for b in batches:
            sides = [[np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in ("wa", "wb")]
            yield b.select(["a", "b"]).filter(pa.array([linked(x, y, similarity) for x, y in zip(*sides, strict=True)], pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = materialize(sets_of(docs, ids), "sets")
    joined = pairs.join(full.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(full.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    out = materialize(joined.mapInArrow(check, "a long, b long"), "links")
    discard(full)
    return out


# --- crowded regions ------------------------------------------------------------------------------------------------


def crowded(orders: DataFrame) -> DataFrame:
    """Ids of the texts that share a first hash with more than WHOLE others in any tree."""
    first = orders.select("tree", F.substring("key", 1, 4).alias("k"), "id")
    many = materialize(first.groupBy("tree", "k").count().where(F.col("count") > WHOLE + 1).select("tree", "k"), "regions")
    few = many.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return first.join(F.broadcast(many) if few else many, ["tree", "k"]).select("id").distinct()


def shingle_counts(batches):
    """(counter, n): shingles by the first bits of their hash."""
    total = np.zeros(COUNTERS, np.int64)
    for part in text_slices(batches, "words"):
        flat = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint64)
        total += np.bincount((flat // U64(2**64 // COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])


def prefixes(batches, counts: np.ndarray, similarity: int):
    """(h, id, n, at): of each set in order of (count, hash) the shingles among which the first one it has in common
    with any set of the similarity must be."""
    for part in text_slices(batches, "words"):
        raw = part.column("words").to_pylist()
        n = np.array([len(x) // 8 for x in raw], np.int64)
        flat, row = np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(n)), n)
        order = np.lexsort((flat, counts[(flat // U64(2**64 // COUNTERS)).astype(np.int64)], row))
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        kept = at <= (n + -similarity * n // 100)[row]
        flat, row, at = flat[order][kept], row[kept], at[kept]
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), part.column("id").take(pa.array(row)), pa.array(n[row]), pa.array(at)], ["h", "id", "n", "at"])


def _ranges(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of `rows` with 0, 1, ... below its count."""
    i = np.repeat(rows, counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def meet(batches, similarity: int):
    """Pairs of different components in each group of sorted rows that may reach the similarity if the shingle of the
    group is their first one in common. Of a link the shorter set has it in an even shorter prefix (`index`)."""
    names = ("h", "x", "y", "component", "own", "id", "n", "at")

    def admitted(rows, i, j):
        n, m = rows[6, i], rows[6, j]
        least = -(-similarity * (n + m) // (100 + similarity))
        ok = (np.minimum(n - rows[7, i], m - rows[7, j]) >= least) & (100 * np.minimum(n, m) >= similarity * np.maximum(n, m))
        ok &= (rows[1, i] == rows[2, i]) | (rows[4, i] != rows[4, j])
        return np.sort(np.stack((rows[5, i[ok]], rows[5, j[ok]])), axis=0)

    def pairs(rows: np.ndarray):
        """All groups of rows, which are sorted by group and component."""
        new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
        run = new | np.r_[True, rows[3, 1:] != rows[3, :-1]]
        place = np.arange(rows.shape[1])
        group, before = np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(run, place, 0))
        index = rows[6] - rows[7] >= -(-2 * similarity * rows[6] // (100 + similarity))
        for side, asking in ((index, place), (~index, place[index])):  # an index row is one end of every pair
            till = np.concatenate(([0], np.cumsum(side)))
            other, asks = np.flatnonzero(side), till[before[asking]] - till[group[asking]]
            ends = np.cumsum(asks)
            start = 0
            while start < len(asking):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
                i, k = _ranges(asking[start:stop], asks[start:stop])
                found = admitted(rows, i, other[till[group[i]] + k]) if len(i) else np.zeros((2, 0), np.int64)
                if found.shape[1]:
                    found = np.unique(found, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
                start = stop

    held = np.zeros((len(names), 0), np.int64)
    for b in batches:
        held = np.concatenate((held, np.stack([b.column(k).to_numpy() for k in names])), axis=1)
        cut = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0))
        if len(cut):
            yield from pairs(held[:, : cut[-1] + 1])
            held = held[:, cut[-1] + 1 :]
    if held.shape[1]:
        yield from pairs(held)


def crowded_pairs(orders: DataFrame, docs: DataFrame, ends: DataFrame, similarity: int) -> DataFrame:
    """Every pair of crowded texts in different components that may be a link, by a join on prefixes of their sets."""
    spark = docs.sparkSession
    ids = materialize(crowded(orders), "crowded")
    sets = materialize(sets_of(docs, ids).select("id", "words"), "sets")
    discard(ids)
    found = sets.mapInArrow(shingle_counts, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found.counter] = found.n
    sent = spark.sparkContext.broadcast(counts)
    rows = sets.mapInArrow(lambda it: prefixes(it, sent.value, similarity), "h long, id long, n long, at long")
    rows = rows.join(ends.select(F.col("rep").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = materialize(rows, "prefixes")
    index = F.col("n") - F.col("at") >= F.ceil(2 * similarity * F.col("n") / (100 + similarity))
    shared = rows.groupBy("h").agg(F.ceil(F.count("*") / MEET).alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or(index).alias("index")).where("low < high and index")
    dealt = rows.join(shared.select("h", "blocks"), "h").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "component", "own", "id", "n", "at")
    by = ("h", "x", "y")
    met = dealt.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by, "component").mapInArrow(lambda it: meet(it, similarity), "a long, b long").distinct()
    sketch = orders.where("tree = 0").select("id", "sketch")
    pairs = met.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    least = sketch_least(similarity)

    def alike(batches):
        for b in batches:
            x, y = (bytes_of(b.column(k))[0].reshape(b.num_rows, -1) for k in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    out = materialize(pairs.mapInArrow(alike, "a long, b long"), "pairs")
    discard(rows)
    discard(sets)
    return out


# --- the whole ------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): texts linked at a shingle similarity of `similarity` hundredths.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. A null, empty or blank text has
    no shingles and stands alone. A row without an id links with nothing: its component is null, and it is kept. Ids
    name documents; repeated rows give repeated rows. Extra columns are ignored, and an empty table gives an empty one.
    Each link is exact; one is missed by all trees with a chance of (1 - similarity / 100) ** TREES, and by the sketch
    with SKETCH_MISS.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(signatures, "ids array<long>, id long, n long, h1 long, h2 long, keys array<binary>, sketch binary"), "signatures")
    sets = signed.where("n > 0 and id is not null")
    same = sets.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    own = lambda c: F.when(F.col("id") == F.col("rep"), F.col(c)).alias(c)
    classes = materialize(sets.join(same, ["n", "h1", "h2"]).select("ids", "id", "n", "rep", own("keys"), own("sketch")), "classes")
    alone = materialize(signed.where("n = 0 or id is null").select("ids", "n"), "alone")
    discard(signed)
    orders = classes.where("id = rep").select(F.posexplode("keys").alias("tree", "key"), "id", "n", "sketch")
    bare = orders.withColumn("component", F.col("id")).withColumn("words", F.lit(None).cast("binary"))
    spent: list[DataFrame] = []
    first = materialize(scanned(bare.where(F.col("tree") < FIRST_ROUND_TREES), "pairs", similarity, spent).select("a", "b").distinct(), "pairs")
    links = confirmed(first, docs, similarity)
    stars = contract(links)
    joined = stars.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
    labelled = bare.join(joined, "id", "left").withColumn("component", F.coalesce("least", "id")).select(*COLUMNS)
    marked = materialize(scanned(labelled, "mark", similarity, spent).select(*COLUMNS).dropDuplicates(["tree", "key", "id"]), "marked")
    asked = materialize(sets_of(docs, marked.select("id").distinct()), "sets")
    rows = materialize(marked.drop("words").join(asked, ["id", "n"]).select(*COLUMNS), "asked")
    found = scanned(rows, "link", similarity, spent).where("a is not null").select("a", "b")
    known = materialize(stars.unionByName(found), "known")
    for x in (first, links, stars, marked, asked, rows, *spent):
        discard(x)
    ends = components(known).select(F.col("node").alias("rep"), F.col("component"))
    pairs = crowded_pairs(orders, docs, ends, similarity)
    far = confirmed(pairs, docs, similarity)
    if not far.isEmpty():
        stars = ends.select(F.col("rep").alias("a"), F.col("component").alias("b"))
        ends = components(stars.unionByName(far)).select(F.col("node").alias("rep"), F.col("component"))
    for x in (known, pairs, far):
        discard(x)
    rows = classes.select("ids", "n", "rep").join(ends, "rep", "left").select(F.explode("ids").alias("id"), "n", F.coalesce("component", "rep").alias("component"))
    rest = alone.select(F.explode("ids").alias("id"), "n").withColumn("component", F.col("id"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return rows.unionByName(rest).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, l.b FROM reach JOIN l ON reach.y = l.a)
  SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM s JOIN r ON r.x = s.doc_id
"""
