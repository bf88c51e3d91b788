"""SentencePiece encoding with the N best segmentations, and decoding.

A text is split where a piece can't reach across: before each space and around each line break. In such a unit, a
forward Viterbi pass over the lattice of pieces gives each place the best score of reaching it; a backward A* search
from the end takes those scores as its exact estimate of what is left, so the segmentations come out best first.
The N best of a whole text are the N best sums over its units. Units repeat, so their results are kept in a
bounded table; those of a slice that are new go through the lattice together, place by place in numpy. Characters
that no piece covers become byte pieces, which makes decoding exact for every text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import U64, RangeHash, mix, table, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
#: Units kept, characters of those that are looked up together, units looked up at once, units whose N best are kept.
CACHED, CACHED_CHARS, LEARNED, RANKED = 160_000, 32, 16_384, 8192
#: Units up to this length have their lattice listed.
LISTED = 1024
#: First bits of a hash by which pieces are looked up.
SLOT_BITS = 16
SPACE = "▁"
#: Texts handled at once, in bytes: with it and LEARNED (units at once) the arrays of a task stay under 50 MB.
SLICE = 1 << 20
#: Added to the lowest piece score for each byte piece; unusable pieces (scores like -1e9) are left out.
BYTE_PENALTY, USABLE = -10.0, -1e8
_UNITS = re.compile(r"\n| ?[^ \n]+| ")


def read_pieces(model_file: str) -> dict:
    """The vocabulary as plain tables: text pieces with id and score, ids of the byte pieces, all pieces by id."""
    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    plain = {n: (i, p.get_score(i)) for i, n in enumerate(names) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and p.get_score(i) > USABLE}
    # runs of spaces have no usable score; a single one gets the lowest of all, so it stands alone only where it must
    plain[SPACE] = (names.index(SPACE), min(s for _, s in plain.values()))
    bytes_ = [next(i for i, n in enumerate(names) if n == f"<0x{b:02X}>") for b in range(256)]
    return {"plain": plain, "bytes": bytes_, "names": names, "byte_score": min(s for _, s in plain.values()) + BYTE_PENALTY, "longest": max(map(len, plain))}


class _Units:
    """Table of units: the pieces of the best segmentation (in `ids`, from `start`, `count` of them), its score, and
    the loss of the second best, as arrays in which `where` has the index of each unit."""

    def __init__(self, search):
        self.search = search
        self.forget()

    def forget(self) -> None:
        self.where: dict[str, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.score, self.loss = np.zeros(0), np.zeros(0)

    def add(self, units: list[str], count, ids, score, loss) -> None:
        count = np.asarray(count, np.int64)
        self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
        self.count, self.ids = np.append(self.count, count), np.append(self.ids, np.asarray(ids, np.int32))
        self.score, self.loss = np.append(self.score, score), np.append(self.loss, loss)
        self.where.update(zip(units, range(len(self.where), len(self.start)), strict=True))

    def search_all(self, units: list[str]) -> None:
        if units:
            found = list(map(self.search, units))
            self.add(units, [len(x[0]) for x in found], list(chain.from_iterable(x[0] for x in found)), [x[1] for x in found], [x[2] for x in found])

    def __len__(self) -> int:
        return len(self.where)

    def __getitem__(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        if unit not in self.where:
            self.search_all([unit])
        k = self.where[unit]
        return tuple(self.ids[self.start[k] :][: self.count[k]].tolist()), float(self.score[k]), float(self.loss[k])


class _Lattice:
    """The lattice of a long unit, without holding it."""

    def __init__(self, model, unit: str):
        self.model, self.unit, self.text = model, unit, unit.replace(" ", SPACE)

    def __getitem__(self, end: int):
        return self.model.ending(self.unit, self.text, end)


class Segmenter:
    """Encoder and decoder over a vocabulary of read_pieces."""

    def __init__(self, pieces: dict, best: int = BEST):
        self.plain, self.bytes, self.byte_score, self.longest, self.best = pieces["plain"], pieces["bytes"], pieces["byte_score"], pieces["longest"], best
        self.parts = [n.replace(SPACE, " ").encode() for n in pieces["names"]]
        for b, i in enumerate(self.bytes):
            self.parts[i] = bytes([b])
        self.cache, self.ranked = _Units(self.viterbi), lru_cache(RANKED)(self.search)
        # hashes, scores and ids of the pieces of each length, sorted by hash; the first of those
        # that begin with some bits, and the most that begin alike
        self.code_values = mix(np.arange(0x110000, dtype=np.uint64) + U64(1)) | U64(1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = {}
        for size in range(1, min(self.longest, CACHED_CHARS) + 1):
            names = [n for n in self.plain if len(n) == size]
            if names:
                code = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
                at = np.arange(len(names)) * size
                key = RangeHash(code, self.code_values)(at, at + size)
                order = np.argsort(key)
                slot = key[order] >> U64(64 - SLOT_BITS)
                slots = np.full(1 << SLOT_BITS, -1, np.int32)
                slots[slot[::-1]] = np.arange(len(names))[::-1]
                deep = int(np.unique(slot, return_counts=True)[1].max())
                self.by_length[size] = key[order], np.array([self.plain[n][1] for n in names])[order], np.array([self.plain[n][0] for n in names])[order], slots, deep

    def nbest(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of a unit as (score, ids), best first."""
        ids, score, _ = self.cache[unit]
        ranked = (self.ranked if len(unit) <= CACHED_CHARS else self.search)(unit)
        return [(score, ids), *(x for x in ranked if x[1] != ids)][: self.best]

    def viterbi(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best segmentation, and how much the second best loses (infinite: there is none).

        The second best takes a piece that the best one does not: the best sum through such a piece is that of the
        best way to its start, itself, and the best way from its end.
        """
        edges, n = self.lattice(unit), len(unit)
        reach, back = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best = None
            for start, _, w in edges[end]:
                total = reach[start] + w
                if best is None or total > best:
                    best, back[end] = total, start
            reach[end] = best
        taken = [n]
        while taken[-1]:
            taken.append(back[taken[-1]])
        ends = set(taken)
        ids = tuple(i for end in reversed(taken[:-1]) for i in next(piece for start, piece, _ in edges[end] if start == back[end]))
        rest = [float("-inf")] * n + [0.0]
        other = float("-inf")
        for end in range(n, 0, -1):
            behind, own = rest[end], back[end] if end in ends else -1
            for start, _, w in edges[end]:
                if w + behind > rest[start]:
                    rest[start] = w + behind
                if start != own and reach[start] + w + behind > other:
                    other = reach[start] + w + behind
        return ids, reach[n], reach[n] - other

    def learn(self, units: set[str]) -> None:
        """Puts new units into the cache: what `viterbi` gives, for all of them at once.

        Units that are long, or hold characters that need byte pieces, are left to `viterbi`.
        """
        cache = self.cache
        if len(cache) > CACHED or len(cache.ids) > 8 * CACHED:
            cache.forget()
        new = list(units - cache.where.keys())
        short = [u for u in new if len(u) <= CACHED_CHARS and SPACE not in u]
        for start in range(0, len(short), LEARNED):
            self._learn(short[start : start + LEARNED])
        cache.search_all([u for u in new if u not in cache.where])

    def _learn(self, new: list[str]) -> None:
        """`learn` for so many units. Places are numbered through all units, a unit of n characters has n + 1 of them;
        the lattice is the list of its edges, taken by the distance of their end from the start of the unit."""
        m, size = len(new), np.fromiter(map(len, new), np.int64, len(new))
        code = np.frombuffer("".join(new).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends, at, unit = np.cumsum(size), np.arange(len(code)), np.repeat(np.arange(m), size)
        hashed, left, covered, found = RangeHash(code, self.code_values), ends[unit] - at, np.zeros(len(code), bool), []
        for n in sorted(self.by_length, reverse=True):  # as in `viterbi`, the longer of equally good pieces stays
            keys, scores, ids, slots, deep = self.by_length[n]
            fits = at[left >= n]
            key = hashed(fits, fits + n)
            hit = slots[key >> U64(64 - SLOT_BITS)]
            maybe = np.flatnonzero(hit >= 0)
            fits, key, hit = fits[maybe], key[maybe], hit[maybe]
            for _ in range(deep - 1):
                hit = np.minimum(hit + (keys[hit] < key), len(keys) - 1)
            ok = np.flatnonzero(keys[hit] == key)
            fits, hit = fits[ok], hit[ok]
            found.append((fits, np.full(len(fits), n), scores[hit], ids[hit]))
            if n == 1:
                covered[fits] = True
        start, length, score, piece = map(np.concatenate, zip(*found, strict=True))
        whole = np.logical_and.reduceat(covered, ends - size)
        till = start + length - (ends - size)[unit[start]]
        order = np.flatnonzero(whole[unit[start]])
        order = order[np.argsort(till[order].astype(np.uint8), kind="stable")]
        start, length, score, piece, till = start[order], length[order], score[order], piece[order], till[order]
        of = unit[start]
        src, most = start + of, int(size.max())
        dst, bounds = src + length, np.searchsorted(till, np.arange(1, most + 2)).tolist()
        first = ends - size + np.arange(m)
        last, steps = first + size, [slice(i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        reach, rest, back = np.full(len(code) + m, -np.inf), np.full(len(code) + m, -np.inf), np.zeros(len(code) + m, np.int64)
        reach[first], rest[last] = 0, 0
        for e in steps:
            total, to = reach[src[e]] + score[e], dst[e]
            np.maximum.at(reach, to, total)
            best = np.flatnonzero(total == reach[to])[::-1]  # of equal ones the first is written last
            back[to[best]] = best + e.start
        on, begins, live = np.zeros(len(code) + m, bool), np.zeros(len(code) + m, bool), last[whole]
        begins[first] = True
        while len(live):
            on[live] = True
            live = src[back[live]]
            live = live[~begins[live]]
        path = np.flatnonzero(on)
        used = back[path]
        for e in reversed(steps):
            np.maximum.at(rest, src[e], score[e] + rest[dst[e]])
        total, other = score + rest[dst] + reach[src], np.full(m, -np.inf)
        total[used] = -np.inf
        np.maximum.at(other, of, total)
        count = np.diff(np.searchsorted(path, np.append(first, len(code) + m)))
        best = reach[last][whole]
        self.cache.add([u for u, w in zip(new, whole.tolist(), strict=True) if w], count[whole], piece[used], best, best - other[whole])

    def lattice(self, unit: str):
        """The pieces that end at each place, as (start, ids, score): a list, or worked out when asked for if it would be
        long, so that a unit of a million characters takes memory for a few numbers by place only."""
        return self.edges(unit) if len(unit) <= LISTED else _Lattice(self, unit)

    def edges(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        text = unit.replace(" ", SPACE)
        return [self.ending(unit, text, end) for end in range(len(unit) + 1)]

    def ending(self, unit: str, text: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """The pieces that end at a place, longest first. text: the unit with its space as pieces write it."""
        get, here, foreign = self.plain.get, [], SPACE in unit
        for start in range(max(end - self.longest, 0), end):
            hit = get(text[start:end])
            if hit and not (foreign and SPACE in unit[start:end]):
                here.append((start, (hit[0],), hit[1]))
        if end and (not here or here[-1][0] != end - 1):  # no piece for the single character
            raw = unit[end - 1].encode("utf-8", "surrogatepass")
            here.append((end - 1, tuple(self.bytes[b] for b in raw), self.byte_score * len(raw)))
        return here

    def search(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """Up to N segmentations of a unit as (score, ids), best first, by backward A*."""
        edges, n = self.lattice(unit), len(unit)
        reach = [0.0]
        for end in range(1, n + 1):  # forward: the best score of reaching each place
            reach.append(max([reach[s] + w for s, _, w in edges[end]]))
        # Backward: open paths with the score they will end with, which is exact, as each can be completed by the best
        # rest. So the N best ends are among the N best open paths at any time, and the others can be left out.
        # A path is its first piece and the path after it; a running number keeps equals in the order they were found.
        paths: list[tuple] = [(-reach[n], 0, None, n, 0.0)]
        made, out = 0, []
        while paths and len(out) < self.best:
            total, _, path, place, behind = paths.pop(0)
            if not place:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-total, tuple(ids)))
                continue
            keep = self.best - len(out)
            worst = paths[keep - 1][0] if len(paths) >= keep else float("inf")
            for start, piece, w in edges[place]:
                end = -(reach[start] + w + behind)
                if end < worst:
                    made += 1
                    paths.append((end, made, (piece, path), start, w + behind))
            paths.sort()
            del paths[keep:]
        return out

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(" " + text) if text else []

    def encode(self, text: str) -> tuple[list[int], float, list[float], list[list[tuple[int, int]]]]:
        """Ids and score of the best segmentation; the scores of the N best; and for each of the N best the units
        that differ from the best one, as (unit, rank of its segmentation)."""
        ids, _, score, ((scores, changes),) = self.encode_all([text])
        return ids.tolist(), float(score[0]), scores, changes

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[list, list]]]:
        """`encode` for many texts: ids of all, bounds of each text's ids, scores, and (scores, changes) of its N best."""
        units, cache, few = list(map(self.units, texts)), self.cache, self.best - 1
        flat = list(chain.from_iterable(units))
        self.learn(set(flat))
        at = np.fromiter(map(cache.where.__getitem__, flat), np.int64, len(flat))
        cut = np.cumsum([0, *map(len, units)])
        score = np.bincount(np.repeat(np.arange(len(texts)), np.diff(cut)), cache.score[at], len(texts))
        count, loss = cache.count[at], cache.loss[at]
        till = np.append(0, np.cumsum(count))
        ids = cache.ids[np.repeat(cache.start[at] - till[:-1], count) + np.arange(till[-1])]
        best = []
        for own, total, a, b in zip(units, score.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            # only the units with the smallest losses can be part of the N best
            x = loss[a:b]
            low = np.flatnonzero(x <= np.partition(x, few - 1)[few - 1]) if 0 < few < b - a else np.arange(b - a)
            losses = heapq.nsmallest(few, ((y, i) for y, i in zip(x[low].tolist(), low.tolist(), strict=True) if y < float("inf")))
            totals: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])]
            for _, i in losses:
                known = self.nbest(own[i])
                options = [(0.0, 0), *((known[0][0] - s, r) for r, (s, _) in enumerate(known) if r)]
                totals = heapq.nsmallest(self.best, ((t + loss_, [*used, (i, r)] if r else used) for t, used in totals for loss_, r in options))
            best.append(([total - t for t, _ in totals], [used for _, used in totals]))
        return ids, till[cut], score, best

    def segmentation(self, text: str, changes: list[tuple[int, int]]) -> list[int]:
        """The ids of one of the N best, from its changes."""
        ranks = dict(changes)
        return list(chain.from_iterable(self.nbest(u)[ranks.get(i, 0)][1] for i, u in enumerate(self.units(text))))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return raw[1:] if ids else raw


def encode(docs: DataFrame, model_file: str = MODEL, id_col: str = "doc_id", text_col: str = "text", best: int = BEST) -> DataFrame:
    """(doc_id, ids, n_pieces, score, nbest_scores, nbest_changes, decoded_sha256): the best segmentation, the scores of
    the `best` best, and what each of them changes as (unit, rank); the hash is that of the text decoded from ids.

    Null counts as empty, and an empty text has no pieces and score 0. Every text decodes to itself, whatever its
    characters. Fewer scores come back where a text has fewer segmentations. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_pieces(model_file))

    def run(batches):
        model = Segmenter(sent.value, best)
        for part in text_slices(batches, "text", SLICE):
            ids, cut, score, best_ = model.encode_all([t or "" for t in part.column("text").to_pylist()])
            shas = [hashlib.sha256(model.decode(ids[a:b].tolist()).encode("utf-8", "surrogatepass")).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            changes = [[[{"unit": u, "rank": r} for u, r in c] for c in changes] for _, changes in best_]
            pieces = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids))
            columns = [part.column("id"), pieces, pa.array(np.diff(cut)), pa.array(score), *map(pa.array, ([x for x, _ in best_], changes, shas), _ENCODED.types[4:])]
            yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)
        # the worker goes on with other tasks, and cycles would keep the tables until its next collection
        model.cache.forget()
        model.ranked.cache_clear()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, score double, nbest_scores array<double>, nbest_changes array<array<struct<unit: int, rank: int>>>, decoded_sha256 string")


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("score", pa.float64()), ("nbest_scores", pa.list_(pa.float64())), ("nbest_changes", pa.list_(pa.list_(pa.struct([("unit", pa.int32()), ("rank", pa.int32())])))), ("decoded_sha256", pa.string())])


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
