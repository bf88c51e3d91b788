"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters (lower case, white space collapsed) may be met with up to n * RATE edits. Cut into that many
pieces plus one, at least one piece of any such occurrence is unchanged. All pieces of a batch of items form one
Aho-Corasick automaton that scans each text once; every place a piece points to is verified over the surrounding
window with Myers' bit-parallel edit distance. A count of shared letter pairs, which an edit can only change by two,
skips windows that can't be within the budget.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, text_slices

RATE = 0.1
#: Characters of items broadcast at once; a larger benchmark is matched in several batches of about this size.
BATCH_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """The pieces of an item with their offsets: one more than the edits allowed, of nearly equal length."""
    n = int(len(item) * rate) + 1
    ends = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def myers(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and the first end of such a substring.

    pattern: a bit mask of its places for each character. Vertical differences of a column of the distance matrix
    are two bit vectors; each character of the text updates the whole column with a few word operations.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    get = pattern.get
    for i, ch in enumerate(text, 1):
        eq = get(ch, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & high:
            distance += 1
        elif down & high:
            distance -= 1
        up = up << 1
        down = down << 1
        plus = full & (down | ~(d0 | up))
        minus = full & up & d0
        if distance < best:
            best, end = distance, i
    return best, end


class Matcher:
    """Items of one batch, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, places = [], defaultdict(list)
        for number, (key, raw) in enumerate(items):
            text = normal(raw)
            masks: dict[str, int] = defaultdict(int)
            for i, ch in enumerate(text):
                masks[ch] |= 1 << i
            self.items.append((key, text, int(len(text) * rate), dict(masks), Counter(zip(text, text[1:], strict=False))))
            for offset, piece in cut(text, rate) if text else []:
                places[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, end, places) for each item within its budget: its best occurrence and the number of them."""
        text = normal(raw)
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                starts[number].add(last - size + 1 - offset)
        found = []
        for number, begins in starts.items():
            key, item, budget, masks, pairs = self.items[number]
            runs: list[list[int]] = []
            for b in sorted(begins):  # places that one window covers are verified together
                if runs and b - runs[-1][1] <= budget:
                    runs[-1][1] = b
                else:
                    runs.append([b, b])
            hits = []
            for a, b in runs:
                low, high = max(0, a - budget), min(len(text), b + len(item) + budget)
                window = text[low:high]
                if budget:
                    near = Counter(zip(window, window[1:], strict=False))
                    if sum(min(c, near[p]) for p, c in pairs.items()) < len(item) - 1 - 2 * budget:
                        continue
                distance, end = myers(masks, len(item), window)
                if distance <= budget:
                    hits.append((distance, low + end))
            if hits:
                found.append((key, *min(hits), len(hits)))
        return found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, end_char, n_places): each text with each benchmark item that it holds within the
    edit budget; the end of the best occurrence (the first of equals) is in characters of the normalised text.

    Null, empty and blank texts and items match nothing; items under 1 / rate characters must occur unchanged.
    Items with one text match alike; repeated rows give repeated rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("item_text")).where("item_text is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    batches = int(chars // BATCH_CHARS) + 1

    def matched(part: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r.item, r.item_text) for r in part.collect()])

        def run(it):
            matcher = Matcher(sent.value, rate)
            for b in text_slices(it, "text"):
                out = [(i, *hit) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) for hit in matcher.search(t)]
                yield pa.RecordBatch.from_pylist([dict(zip(_HITS.names, x, strict=True)) for x in out], schema=_HITS)

        return rows.mapInArrow(run, "doc_id long, item_id long, distance int, end_char int, n_places int")

    out = matched(items.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == 0))
    for k in range(1, batches):
        out = out.unionByName(matched(items.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == k)))
    return out


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end_char", pa.int32()), ("n_places", pa.int32())])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
