"""Embedding near-duplicates by collision counting over one-dimensional projections.

A pair collides in a projection if each lies in the window of +-WINDOW around the other's value; similar vectors
collide in nearly all projections. To keep the compared pairs few, every order first deals the vectors into cells by
the signs of some other projections, sorts each cell by the order's own projection and looks only inside windows
centred on each query there. For the pairs met, collisions are counted over COUNTED projections; only pairs that
pass the count calibrated for RECALL at the threshold get their cosine computed, in double precision.

Identical vectors fold into one class first, in each Arrow batch and then by a grouping. A crowded cell is split into
blocks of BLOCK rows, and each pair of blocks is a group of its own. A pair counts in the first order in which it meets,
so none counts twice. Pairs stay inside their group: what leaves it is, for each vector with a link, the number of its
links there and the smallest vector that it is joined with there, so the output grows with the vectors and not the pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, join_least, materialize, shuffle_partitions, table
from quillspark.llm.graph import components

THRESHOLD, RECALL = 0.9, 0.999
WINDOW, COUNTED, BLOCK, CELL = 0.9, 32, 1024, 200
#: Crowded cells broadcast at most (12 bytes each); with more of them the join is shuffled.
BROADCAST_CELLS = 100_000


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """Signs for a cell, orders, and collisions required, for n vectors."""
    signs = max(1, math.ceil(math.log2(max(n, 2) / CELL)))
    spread = math.sqrt(2 * (1 - threshold))
    meets = 2 * NormalDist().cdf(WINDOW / spread) - 1
    same = (1 - math.acos(threshold) / math.pi) ** signs * meets
    orders = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - same)))
    least, total = COUNTED, 0.0
    while least > 0:
        total += math.comb(COUNTED, least) * meets**least * (1 - meets) ** (COUNTED - least)
        if total >= RECALL:
            break
        least -= 1
    return signs, orders, least


@lru_cache(maxsize=4)
def directions(size: int, signs: int, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random projections for the signs (size x orders * signs), the orders and the counting."""
    rng = np.random.Generator(np.random.PCG64(size))
    return rng.standard_normal((size, orders * signs)), rng.standard_normal((size, orders)), rng.standard_normal((size, COUNTED))


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    odd = ~((norm > 0) & np.isfinite(norm))[:, 0]
    if odd.any():  # squares under or over the range of a double
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.linalg.norm(x[odd], axis=1, keepdims=True)
    return x / norm


def sign_codes(x: np.ndarray, signs: int, orders: int) -> np.ndarray:
    bits = (x @ directions(x.shape[1], signs, orders)[0] > 0).reshape(len(x), orders, signs)
    return bits @ (1 << np.arange(signs))


def compare(left: np.ndarray, right: np.ndarray | None, order: int, shape: tuple[int, int, int], threshold: float):
    """Linked pairs inside one block, or between two blocks, that this order is the first to bring together: the places
    of either end in its block."""
    signs, orders, least = shape
    x, y = left, left if right is None else right
    _, along, counted = directions(x.shape[1], signs, orders)
    px, py = x @ along, y @ along
    cx, cy = (x @ counted).astype(np.float32), (y @ counted).astype(np.float32)
    sx, sy = sign_codes(x, signs, orders), sign_codes(y, signs, orders)
    by = np.argsort(py[:, order], kind="stable")
    line = py[by, order]
    for start in range(0, len(x), 64):
        q = np.arange(start, min(start + 64, len(x)))
        low = np.searchsorted(line, px[q, order] - WINDOW, side="left")
        high = np.searchsorted(line, px[q, order] + WINDOW, side="right")
        n = high - low
        a = np.repeat(q, n)
        b = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        if right is None:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        hits = np.zeros(len(a), np.int16)
        for k in range(COUNTED):
            hits += np.abs(cx[a, k] - cy[b, k]) <= WINDOW
        a, b = a[hits >= least], b[hits >= least]
        linked = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
        a, b = a[linked], b[linked]
        met = (sx[a, :order] == sy[b, :order]) & (np.abs(px[a, :order] - py[b, :order]) <= WINDOW)
        first = ~met.any(axis=1)
        yield a[first], b[first]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked at a cosine of `threshold` or more.

    A vector that is null, empty, zero, or has a null or non-finite component links with nothing, and neither does one with
    a null id; vectors of different lengths never link. Identical vectors link with each other. Other columns are ignored.
    Each row gives one row: repeated rows are vectors of their own, linked with each other, and if one id stands for
    different vectors, these are in one component and their links are added up.
    At the threshold itself a pair is found with a probability of about RECALL squared, and above it more often.
    """
    spark = vectors.sparkSession
    floats = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, element = ("f4", "float") if floats else ("f8", "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)

    def fold(batches):
        """(size, x, ids, rep, copies): the distinct vectors of a batch with all ids that have them."""
        for b in batches:
            v = b.column("v")
            flat = v.flatten().to_numpy() + 0.0  # -0.0 is 0.0
            bounds = np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy())))
            same: dict[bytes, list[int]] = {}
            for i, s, e in zip(b.column("id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                same.setdefault(flat[s:e].tobytes(), []).append(i)
            ids = list(same.values())
            size = [len(x) // flat.itemsize for x in same]
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(list(same), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([min(i) for i in ids], pa.int64()), pa.array([len(i) for i in ids], pa.int64())], ["size", "x", "ids", "rep", "copies"])

    folded = materialize(good.mapInArrow(fold, "size int, x binary, ids array<long>, rep long, copies long"), "folded")
    same = folded.groupBy("size", "x").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"))
    reps = materialize(same, "vectors")
    shape = plan(reps.count(), threshold)
    signs, orders, _ = shape

    def deal(batches):
        for b in batches:
            sizes = b.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                codes = sign_codes(unit(part.column("x").to_pylist(), kind), signs, orders)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("size"), part.column("x"), pa.array(list(codes), pa.list_(pa.int64()))], ["id", "copies", "size", "x", "codes"])

    dealt = reps.mapInArrow(deal, "id long, copies long, size int, x binary, codes array<long>")
    cells = dealt.select("id", "copies", "size", F.posexplode("codes").alias("ord", "cell"), "x")
    key = ["size", "ord", "cell"]
    crowded = materialize(cells.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "crowded")
    few = crowded.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    placed = cells.join(F.broadcast(crowded) if few else crowded, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "copies", "x")
    group = [*key, "i", "j"]

    def links(batches):
        """(id, outside, low): the vectors that have links in a group, how many, and the smallest one they reach there."""
        held: tuple | None = None
        sides: dict[int, tuple[list, list, list]] = {}

        def finish():
            if held is None or held[3] != held[4] and len(sides) < 2:
                return
            blocks = [sides[s] for s in sorted({held[3], held[4]})]
            ids = np.concatenate([np.array(b[0]) for b in blocks])
            copies = np.concatenate([np.array(b[1]) for b in blocks])
            vectors_ = [unit(b[2], kind) for b in blocks]
            at = len(blocks[0][0]) if len(blocks) == 2 else 0
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)  # numbers in order of ids, so that the least number is the least id
            place[order] = np.arange(len(ids))
            outside, least = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for a, b in compare(vectors_[0], vectors_[1] if at else None, held[1], shape, threshold):
                b = b + at
                np.add.at(outside, a, copies[b])
                np.add.at(outside, b, copies[a])
                join_least(least, place[a], place[b])
            found = np.flatnonzero(outside)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found], pa.int64()), pa.array(outside[found]), pa.array(ids[order[least[place[found]]]], pa.int64())], ["id", "outside", "low"])

        for batch in batches:
            for *k, own, i, n, x in zip(*(batch.column(c).to_pylist() for c in (*group, "own", "id", "copies", "x")), strict=True):
                if tuple(k) != held:
                    yield from finish()
                    held, sides = tuple(k), {}
                side = sides.setdefault(own, ([], [], []))
                side[0].append(i)
                side[1].append(n)
                side[2].append(x)
        yield from finish()

    met = materialize(placed.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group).mapInArrow(links, "id long, outside long, low long"), "links")
    discard(crowded)
    joined = components(met.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    degree = met.groupBy(F.col("id").alias("rep")).agg(F.sum("outside").alias("outside"))
    classes = reps.join(degree, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("size", "x", (F.coalesce("outside", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    inside = folded.join(classes, ["size", "x"]).select(F.explode("ids").alias("id"), "links", "component")
    # the ids of the folded vectors are those of all usable rows, one by one; the others link with nothing
    out = inside.select("id", F.col("links").cast("long").alias("links"), "component").unionByName(rows.where(~usable).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, l.b FROM reach JOIN l ON reach.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id LEFT JOIN d ON d.a = e.vec_id
"""
