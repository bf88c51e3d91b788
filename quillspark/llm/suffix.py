"""Suffix-array deduplication: remove every byte covered by a string of LENGTH bytes that also starts earlier.

1. Dealing. A window of LENGTH bytes belongs to the smallest hash of its GRAM-byte substrings (winnowing), so equal
   windows always belong to the same value. Runs of windows with one value form a piece of text. Pieces are shuffled
   as (value, hash, place); the text itself only follows for values that have two different pieces. Pieces that
   repeat byte for byte are folded before: inside a slice of the input, then inside a value; all but the first are
   covered as a whole. A piece that may repeat itself is kept even if it is the only one of its value.
2. Shards. The remaining pieces, sorted by value, fill shards of SHARD_BYTES. Each shard gets its own suffix array
   of window starts by Larsson-Sadakane refinement (rank pairs at doubling offsets, only unresolved groups sorted
   again), common prefixes by Kasai's walk in text order, and so its groups of equal windows.
   A value with more than CROWD different pieces would fill many shards one after the other; its windows are dealt on
   by two 64-bit hashes of their bytes instead, so that any number of tasks share them.
3. Merging. A value that fills more than one shard is merged shard by shard: the sorted distinct windows met so far
   are searched by bisection for each window of the next shard.

Equal windows group by content alone, so the first start among all documents is found whatever the sharding.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import U64, RangeHash, bytes_of, materialize, numbered, shuffle_partitions, table, text_slices

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
SHARD_BYTES = 1 << 20
#: Different pieces of a value up to which they are sorted together.
CROWD = 4096
#: Crowded values broadcast at most (8 bytes each); with more of them the join is shuffled.
BROADCAST_VALUES = 200_000
#: Longest piece in windows; longer runs (periodic text) are cut, which keeps all windows and their value.
LONGEST = 1 << 12
#: The winnowing hash uses other byte values than the hashes of whole pieces.
_GRAM_VALUES = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)

PLACE = "v long, g long, doc long, s long, len int, kind int"
#: Kinds of places: a piece, a piece whose smallest hash occurs twice (it may repeat itself), a covered piece.
PIECE, TWICE, COVERED = 0, 1, 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: block-wise running minima from both sides."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    cells = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    back = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _runs(v: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal v, cut at `breaks` and into LONGEST."""
    change = np.ones(len(v), bool)
    change[1:] = v[1:] != v[:-1]
    change[breaks] = True
    starts = np.flatnonzero(change)
    lengths = np.diff(np.append(starts, len(v)))
    if len(lengths) and lengths.max() > LONGEST:
        parts = -(-lengths // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, lengths = np.repeat(starts, parts) + step * LONGEST, np.minimum(LONGEST, np.repeat(lengths, parts) - step * LONGEST)
    return starts, lengths


def _adjacent_twins(gram: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Values that follow themselves among the selected grams (those that are the minimum of some window).

    Inside a run of windows with one value, two of its grams are never parted by another selected gram, so every
    run that may repeat itself has a value in this list.
    """
    reach = np.concatenate((np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)))
    highest = ~_sliding_min(~reach, SPAN)
    chosen = gram[gram == highest[: len(gram)]]
    return np.unique(chosen[1:][chosen[1:] == chosen[:-1]])


def pieces(batches):
    """(v, g, doc, s, len, kind) of all pieces; exact repeats inside a slice come as covered places."""
    for part in text_slices(batches, "text"):
        data, offsets = bytes_of(part.column("text"))
        size = np.diff(offsets)
        rows = np.flatnonzero(size >= LENGTH)
        if not len(rows):
            continue
        ids = part.column("id").to_numpy(zero_copy_only=False)
        at = np.arange(len(data) - GRAM + 1)
        gram = RangeHash(data, _GRAM_VALUES)(at, at + GRAM)
        low = _sliding_min(gram, SPAN)
        windows = size[rows] - LENGTH + 1
        bounds = np.cumsum(windows) - windows
        place = np.arange(windows.sum()) + np.repeat(offsets[rows] - bounds, windows)
        starts, lengths = _runs(low[place], bounds)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        begin = place[starts]
        v = low[begin].view(np.int64)
        twice = np.isin(low[begin], _adjacent_twins(gram, low))
        g = RangeHash(data)(begin, begin + lengths + LENGTH - 1).view(np.int64)
        s, doc = begin - offsets[rows][doc], ids[rows][doc]
        order = np.lexsort((s, doc, g))
        again = np.zeros(len(g), bool)
        again[order[1:]] = g[order[1:]] == g[order[:-1]]
        # a covered place needs no partner: deal it by its own place
        yield pa.RecordBatch.from_arrays([pa.array(np.where(again, doc * 31 + s, v)), pa.array(g), pa.array(doc), pa.array(s), pa.array(lengths.astype(np.int32)), pa.array(np.where(again, COVERED, twice * TWICE).astype(np.int32))], ["v", "g", "doc", "s", "len", "kind"])


def shared(batches):
    """Of the pieces sorted by (v, g, doc, s) those of values that occur more than once.

    Repeats of a whole piece come back as covered; the first one only if its value has another piece too, or if it may
    repeat itself. Rows stream through: only the first piece of a value waits for a second one.
    """
    waiting, last = None, (None, None)
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        if (kind == COVERED).any():
            yield batch.filter(pa.array(kind == COVERED))
            batch = batch.filter(pa.array(kind != COVERED))
        if not batch.num_rows:
            continue
        kind, v, g = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("kind", "v", "g"))
        old_v, old_g = (np.append(0 if x is None else x, c[:-1]) for x, c in zip(last, (v, g), strict=True))
        new_v = v != old_v
        new_v[0] |= last[0] is None
        again = ~new_v & (g == old_g)
        if waiting is not None:
            if not new_v[0] and (~again[: np.argmax(new_v) if new_v.any() else len(v)]).any():
                yield waiting
                waiting = None
            elif new_v.any():
                waiting = None
        # the first piece of a value stays if another follows it before the next value
        first = np.flatnonzero(new_v)
        others = np.concatenate(([0], np.cumsum(~again & ~new_v)))
        followed = others[np.append(first[1:], len(v))] > others[first]
        keep = ~new_v
        keep[first] = followed | (kind[first] == TWICE)
        if len(first) and not keep[first[-1]]:
            waiting = batch.slice(first[-1], 1)
        yield batch.set_column(batch.schema.get_field_index("kind"), "kind", pa.array(np.where(again, COVERED, kind).astype(np.int32))).filter(pa.array(keep))
        last = v[-1], g[-1]


def cut(batches):
    """Rows of (id, text, places) become pieces (v, doc, s, bytes, len) of their texts.

    Windows of crowded values come as (hash, doc, s, both hashes, WINDOW), those that repeat one of the slice as
    (anything, doc, s, nothing, -len) with their run's length.
    """
    for part in text_slices(batches, "text"):
        rows, found = [], []
        for doc, text, places in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("places").to_pylist(), strict=True):
            rows += [(p["v"], doc, p["s"], text[p["s"] : p["s"] + p["len"] + LENGTH - 1], p["len"]) for p in places if not p["crowded"]]
            spread = [np.arange(p["s"], p["s"] + p["len"]) for p in places if p["crowded"]]
            if spread:
                at, data = np.concatenate(spread), np.frombuffer(text, np.uint8)
                found.append((RangeHash(data)(at, at + LENGTH), RangeHash(data, _GRAM_VALUES)(at, at + LENGTH), np.full(len(at), doc), at))
        if found:
            h1, h2, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, doc, h2, h1))
            h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
            again = np.append(False, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]))
            both = np.stack((h1, h2), axis=1)[~again].tobytes()
            rows += [(v, d, s, both[16 * i : 16 * i + 16], WINDOW) for i, (v, d, s) in enumerate(zip(h1[~again].view(np.int64).tolist(), doc[~again].tolist(), at[~again].tolist(), strict=True))]
            doc, at = doc[again], at[again]
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))[: len(doc)]
            rows += [(d * 31 + s, d, s, b"", -n) for d, s, n in zip(doc[starts].tolist(), at[starts].tolist(), np.diff(np.append(starts, len(doc))).tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)


_PIECE = pa.schema([("v", pa.int64()), ("doc", pa.int64()), ("s", pa.int64()), ("piece", pa.binary()), ("len", pa.int32())])
#: Stands for the length of a row that is one window of a crowded value.
WINDOW = 0


def refine(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of `starts` by the LENGTH bytes from each (ties by place), and the rank of each start's group.

    Larsson-Sadakane: suffixes ordered by h bytes are ordered by 2h bytes through the ranks h further on, and only
    groups that are still tied are sorted again. The last step overlaps its halves to end at LENGTH exactly.
    """
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = wide[:n]
    for step in (1, 2, 4):  # eight bytes as one big-endian number
        key = (key << U64(8 * step)) | np.concatenate((key[step:], np.zeros(min(step, n), np.uint64)))[:n]
    order = np.argsort(key)
    sorted_key = key[order]
    rank = np.empty(n, np.int64)
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first
    h = 8
    while 2 * h < LENGTH:
        tied = ~head
        tied[:-1] |= ~head[1:]
        spots = np.flatnonzero(tied)  # places in the order; ranks are the places of the groups' heads
        members = order[spots]
        onward = np.where(members + h < n, rank[np.minimum(members + h, n - 1)] + 1, 0)
        pair = (rank[members] << 32) | onward
        by = np.argsort(pair)
        members, pair = members[by], pair[by]
        order[spots] = members
        head[spots[1:]] = pair[1:] != pair[:-1]
        if len(spots):
            head[spots[0]] = True
            new = np.maximum.accumulate(np.where(head[spots], spots, 0))
            rank[members] = new
        h *= 2
    pair = (rank[starts] << 32) | rank[starts + LENGTH - h]
    by = np.argsort(pair, kind="stable")
    return starts[by], pair[by]


def kasai(text: np.ndarray, order: np.ndarray, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each start in `order`: bytes in common with the start before it in the order, LENGTH at most.

    Kasai's walk: going from p to p + 1 in the text, a common prefix shrinks by one at most. All lanes (runs of
    adjacent starts) walk in step. The bound does not hold after a full match (the order ends at LENGTH bytes) or
    where the predecessor has no following start in its run; there the count starts again from nothing.
    """
    n = len(text)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    is_start = np.zeros(n + 2, bool)
    is_start[order] = True
    common = np.zeros(n, np.int64)
    longest_first = np.argsort(-lengths, kind="stable")
    lanes, lengths = lanes[longest_first], lengths[longest_first]
    h = np.zeros(len(lanes), np.int64)
    padded = np.concatenate((text, np.zeros(LENGTH + 8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + LENGTH, 8), (1, 1))
    live = len(lanes)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths[:live], -step, side="left"))
        p = lanes[:live] + step
        q = before[p]
        got = h[:live]
        walking = np.flatnonzero(q >= 0)
        got[q < 0] = 0
        while len(walking):  # eight bytes at a time
            a, b = p[walking] + got[walking], q[walking] + got[walking]
            differ = words[a] != words[b]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            got[walking] += same
            walking = walking[(same == 8) & (got[walking] < LENGTH)]
        np.minimum(got, LENGTH, out=got)
        common[p] = got
        keeps = (got < LENGTH) & (q >= 0) & is_start[q + 1]
        h[:live] = np.where(keeps, np.maximum(got - 1, 0), 0)
    return common[order]


def shard_groups(text: np.ndarray, lanes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts in suffix order, and the number of the group of equal windows of each."""
    starts = np.repeat(lanes - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    order, _ = refine(text, starts)
    return order, np.cumsum(kasai(text, order, lanes, lengths) < LENGTH) - 1


class Shards:
    """Joins rows sorted by (v, doc, s) into shards and marks windows that start earlier elsewhere."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0
        self.value, self.known = None, np.zeros(0, f"S{LENGTH}")

    def add(self, v, doc, s, piece, n):
        self.rows.append((v, doc, s, piece, n))
        self.bytes += len(piece)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES

    def flush(self, more: bool) -> list[tuple]:
        """Covered places (doc, s, len) of the shard; more: its last value may go on in the next shard."""
        rows, self.rows, self.bytes = self.rows, [], 0
        if not rows:
            return []
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        lanes = np.cumsum([0, *(len(r[3]) for r in rows[:-1])])
        lengths = np.array([r[4] for r in rows])
        order, group = shard_groups(text, lanes, lengths)
        # rows are sorted by (doc, s) inside a value, and equal windows have equal values: the first place is the smallest
        lead = np.minimum.reduceat(order, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
        repeat = np.zeros(len(text), bool)
        repeat[order] = order != lead[group]
        last = rows[-1][0]
        begin = next(i for i, r in enumerate(rows) if r[0] == last)
        goes_on = self.value == rows[0][0]
        if goes_on:  # merge: search this shard's windows of the value among the sorted windows of the shards before
            end = next((i for i, r in enumerate(rows) if r[0] != self.value), len(rows))
            lead_here = np.sort(lead[lead < (lanes[end] if end < len(rows) else len(text))])
            windows = _windows(text, lead_here)
            at = np.searchsorted(self.known, windows)
            met = np.zeros(len(windows), bool)
            inside = at < len(self.known)
            met[inside] = self.known[at[inside]] == windows[inside]
            repeat[lead_here[met]] = True
        if more:
            fresh = _windows(text, np.sort(lead[(lead >= lanes[begin])]))
            old = self.known if goes_on and last == self.value else np.zeros(0, f"S{LENGTH}")
            self.value, self.known = last, np.union1d(old, fresh)
        else:
            self.value, self.known = None, np.zeros(0, f"S{LENGTH}")
        out = []
        edges = np.diff(np.concatenate(([False], repeat, [False])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            i = int(np.searchsorted(lanes, a, side="right")) - 1
            while a < b:
                stop = min(b, int(lanes[i] + lengths[i]))
                out.append((rows[i][1], rows[i][2] + int(a - lanes[i]), int(stop - a)))
                i += 1
                a = int(lanes[i]) if i < len(lanes) else b
        return out


def _windows(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts]).view(f"S{LENGTH}").ravel()


_COVERED = pa.schema([("doc", pa.int64()), ("s", pa.int64()), ("len", pa.int32())])


def covered(batches):
    """Places covered by an earlier window, from the rows of `cut` sorted by (v, doc, s)."""
    shards, hashed, seen = Shards(), None, set()
    done = lambda places: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*places, strict=True) if places else ([], [], []), _COVERED.types, strict=True)], schema=_COVERED)
    for batch in batches:
        met = []
        for row in zip(*(batch.column(k).to_pylist() for k in ("v", "doc", "s", "piece", "len")), strict=True):
            if row[4] < 0:
                met.append((row[1], row[2], -row[4]))
                continue
            if row[4] == WINDOW:  # the first of equal windows comes first
                if row[0] != hashed:
                    hashed, seen = row[0], set()
                if row[3] in seen:
                    met.append((row[1], row[2], 1))
                seen.add(row[3])
                continue
            if shards.full():
                yield done(shards.flush(more=shards.rows[-1][0] == row[0]))
            shards.add(*row)
        yield done(met)
    yield done(shards.flush(more=False))


def spans(places: list, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows that start at [s, s + len) for any of the places."""
    out: list[list[int]] = []
    for p in sorted(places, key=lambda p: p["s"]):
        a, b = p["s"], min(size, p["s"] + p["len"] + LENGTH - 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _kept(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc_id, the columns of _OUT, carry_0, carry_1, ...): what is left of each text, with the columns of `carry`."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    extra = [f"carry_{k}" for k in range(len(carry))]
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(carry, extra, strict=True)))
    rows, ids = whole.agg(F.count("*"), F.count_distinct("id")).first()
    if rows > ids:  # null or repeated ids: rows are told apart by their places in an order of ids and texts
        extra.append("carry_id")
        whole = numbered(whole.withColumn("carry_id", F.col("id")), ["id", "text"], "row").drop("id").withColumnRenamed("row", "id")
    docs = whole.select("id", "text")
    order = ("v", "g", "doc", "s")
    places = docs.mapInArrow(pieces, PLACE).repartition(n, "v").sortWithinPartitions(*order).mapInArrow(shared, PLACE)
    places = materialize(places, "places")
    open_ = places.where(F.col("kind") != COVERED)
    crowd = materialize(open_.groupBy("v").count().where(F.col("count") > CROWD).select("v", F.lit(True).alias("crowded")), "crowded")
    few = crowd.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    open_ = open_.join(F.broadcast(crowd) if few else crowd, "v", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    asked = open_.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("v", "s", "len", "crowded")).alias("places"))
    cuts = docs.join(asked, "id").mapInArrow(cut, "v long, doc long, s long, piece binary, len int")
    merged = cuts.repartition(n, "v").sortWithinPartitions("v", "doc", "s").mapInArrow(covered, "doc long, s long, len int")
    gone = places.where(F.col("kind") == COVERED).select("doc", "s", "len").unionByName(merged)
    gone = gone.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("s", "len")).alias("places"))

    def remove(batches):
        for part in text_slices(batches, "text"):
            rows = []
            for given, where in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("places").to_pylist(), strict=True):
                text = given or b""
                ranges = spans(where or [], len(text))
                ends = [0, *(x for r in ranges for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept, None if given is None else kept.decode("utf-8", "ignore"), [{"start": a, "end": b} for a, b in ranges]))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns, *map(part.column, extra)], ["doc_id", *_OUT.names, *extra])

    joined = whole.join(gone, "id", "left").select("id", "text", "places", *extra)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, removed array<struct<start: long, end: long>>"
    out = joined.mapInArrow(remove, ", ".join([schema, *(f"{k} {joined.schema[k].dataType.simpleString()}" for k in extra)]))
    return out.withColumn("doc_id", F.col("carry_id")) if "carry_id" in extra else out


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, kept_text, removed): each text without the bytes
    covered by a string of 100 bytes that starts earlier (smaller id, or same text and earlier start), judged on the
    input.

    `kept` are the remaining bytes, `kept_text` the whole characters among them and `removed` the removed ranges as
    (start, end). Null text counts as empty (its `kept_text` is null); texts under 100 bytes are kept whole. A null id
    comes before all others. Rows with equal ids are texts of their own, in order of the text (null first), so repeated
    rows repeat each other. Other columns are ignored, and an empty table gives an empty one.
    """
    return _kept(docs, id_col, text_col, []).select("doc_id", *_OUT.names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with its own columns and rows, each text without what `substring_duplicates` removes; `size_col`, if there
    is one, is the new number of characters. A character that is cut in two goes as a whole; null texts stay null."""
    carry = [c for c in docs.columns if c not in (text_col, size_col)]
    out = _kept(docs, id_col, text_col, carry)
    made = {c: F.col(f"carry_{k}") for k, c in enumerate(carry)} | {text_col: F.col("kept_text").cast(docs.schema[text_col].dataType)}
    if size_col in docs.columns:
        made[size_col] = F.length(F.coalesce("kept_text", F.lit(""))).cast(docs.schema[size_col].dataType)
    return out.select(*(made[c].alias(c) for c in docs.columns))


_OUT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
