"""Duplicate questions: a similarity join through inverted indexes, and the greedy choice of first ones as a fixed point.

Two texts are alike if their aligned share of characters reaches the threshold, or a mix of it with the overlap of their
stems does. Each way has limits that follow from the threshold:

- aligned: texts share character pairs, or longer grams where they are aligned in few runs;
- mixed: the overlap (Jaccard) of stems has a lower bound, so texts share stems;
- options: sets of options meet under the rarer of their alike options.

Equal texts are folded first. Groups are cut into cells of a bounded number of characters on both sides; large ones are
written once, in blocks of like length that tasks read for each other.
No pair is lost: every limit is one that a pair at the threshold can't miss.
"""

from __future__ import annotations

import difflib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions.text import normalize_question, stems
from quillspark.shared import discard, materialize

# fixed values: the shares of word overlaps and aligned characters in a mix; options that count as the same, and when
# options make two questions the same; what stored questions ask of text and options for their mean to count
JACCARD, OVERLAP, ALIGNED = 0.3, 0.35, 0.35
SAME_OPTION, OPTIONS, OPTIONS_ALONE, MIX, MIXED = 0.8, 0.75, 0.9, (0.65, 0.35), 0.6
BOOST_TEXT = 0.65

#: Characters on each side of a cell, and in a task at about the most.
CELL_CHARS, TASK_CHARS = 1 << 19, 1 << 23
#: Questions with fewer characters than this in all are sent to every task.
SENT_CHARS = 1 << 19
#: Bins of characters and of stems in which texts are counted, so that bounds come from whole arrays.
CHAR_BINS, STEM_BINS = 64, 128
#: Bins of stems, and pairs of characters (the commonest), whose counts are multiplied for all texts of two cells at once.
WORD_BINS, COMMON_PAIRS = 1024, 1024
#: For each 64 characters of a text, how many others it must be compared with for this to go side by side.
FEW = 25
#: Characters of a class of characters, about, and how many classes there are at most; how many pairs it takes to look at
#: classes, and how many go side by side.
CLASS_CHARS, MOST_CLASSES, FEWEST, LANES = 48, 8, 8, 1 << 13
_EPS, _SLACK = 1e-9, 1e-5


def _alike(a: str, b: str, x: list[str], y: list[str]) -> float:
    """Similarity of two normalised texts with their stems: the aligned share, or a mix with word overlaps if higher."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    aligned = difflib.SequenceMatcher(None, a, b).ratio()
    p, q = set(x), set(y)
    if not p or not q:
        return aligned
    both = len(p & q)
    return min(1.0, max(aligned, JACCARD * both / len(p | q) + OVERLAP * both / min(len(p), len(q)) + ALIGNED * aligned))


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([_alike(*row) for row in zip(a, b, x, y, strict=True)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    return _similarity(normalize_question(a), normalize_question(b), stems(a), stems(b))


class Question:
    """A question as it is compared: its text, normalised text, stems, and options as (normalised text, stems)."""

    def __init__(self, key, text: str | None, normal: str, stems_: list[str], options: list[tuple[str, list[str]]] | None = None):
        self.key, self.text, self.normal, self.stems, self.options = key, text, normal, stems_, options or []


def option_similarity(a: list[tuple[str, list[str]]], b: list[tuple[str, list[str]]]) -> float:
    """Share of the distinct options of a that b has too, whatever their letters. Options: (normalised text, stems)."""
    left, right = dict((x[0], x) for x in a), dict((x[0], x) for x in b)
    if not left or not right:
        return 0.0
    same = sum(any(_alike(x, y, list(p[1]), list(q[1])) > SAME_OPTION for y, q in right.items()) for x, p in left.items())
    return same / max(len(left), len(right))


def compare(a: Question, b: Question, threshold: float) -> tuple[float, str] | None:
    """(score, reason) if two questions of a batch are the same."""
    if a.normal == b.normal:
        return 1.0, "EXACT_NORMALIZED"
    options = option_similarity(a.options, b.options) if a.options and b.options else 0.0
    score = _alike(a.normal, b.normal, a.stems, b.stems)
    mixed = MIX[0] * options + MIX[1] * score
    if options >= OPTIONS and (mixed >= MIXED or options >= OPTIONS_ALONE):
        return mixed, "MCQ_OPTION_MATCH"
    return (score, "HIGH_SIMILARITY") if score >= threshold else None


def compare_stored(a: Question, b: Question, threshold: float) -> tuple[float, str] | None:
    """(score, reason) if a question is the same as a stored one: like options lift a likely score."""
    if a.normal == b.normal:
        return 1.0, "EXACT_NORMALIZED"
    options = option_similarity(a.options, b.options) if a.options and b.options else 0.0
    score = _alike(a.normal, b.normal, a.stems, b.stems)
    if options >= OPTIONS and score >= BOOST_TEXT:
        score = max(score, (score + options) / 2)
    return (score, "HIGH_SIMILARITY") if score >= threshold else None


# --- limits that follow from a threshold ----------------------------------------------------------------------------


def least_share(threshold: float) -> float:
    """How short a text may be beside another for their aligned share to reach the threshold."""
    return threshold / (2 - threshold)


def least_reach(threshold: float) -> float:
    """How short a text may be beside another for any way to reach the threshold, however far their stems overlap."""
    least = min(threshold, (threshold - JACCARD - OVERLAP) / ALIGNED)
    return least_share(least) if least > 0 else 0.0


def least_pairs(chars: np.ndarray | int, threshold: float) -> np.ndarray:
    """Character pairs that two texts with so many characters in all must share.

    m aligned characters of n leave n - 2m others, so they stand in n - 2m + 1 runs at most, and a run of k characters
    holds k - 1 pairs.
    """
    return np.ceil((1.5 * threshold - 1) * np.asarray(chars) - 1 - _EPS)


def least_jaccard(threshold: float) -> float:
    """What the stems of two texts overlap by at least, if only the mix with them reaches the threshold."""
    return (threshold * (1 - ALIGNED) - OVERLAP) / JACCARD - _EPS


def _lcs(a: str, b: str, least: float = 0) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number; or, as soon as it
    can't reach `least`, a number under that which it is not over."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for done, c in enumerate(b):
        if done % 64 == 63 and (most := len(a) - row.bit_count() + len(b) - done) < least:
            return most
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


class Cell:
    """Questions that others are held against, with what bounds their similarity from above."""

    def __init__(self, questions: list[Question], order: np.ndarray | None = None):
        self.questions, self.order, self._made = questions, np.zeros(len(questions), np.int64) if order is None else order, {}
        self.size = np.array([len(q.normal) for q in questions], np.int64)
        self.start = np.cumsum(self.size) - self.size
        points = np.frombuffer("".join(q.normal for q in questions).encode("utf-32-le"), np.uint32)
        there = np.zeros(int(points.max(initial=0)) + 1, bool)
        there[points] = True
        self.alphabet = np.flatnonzero(there).astype(np.uint32)
        self.flat = (np.cumsum(there, dtype=np.int32) - 1)[points]

    @property
    def chars(self) -> np.ndarray:
        bins = lambda q: np.bincount(np.frombuffer(q.normal.encode("utf-32-le"), np.uint32) % CHAR_BINS, minlength=CHAR_BINS)
        return self.made("chars", lambda: np.stack([bins(q) for q in self.questions] or [np.zeros(CHAR_BINS)]).astype(np.int32))

    @property
    def stems(self) -> np.ndarray:
        bins = lambda q: np.bincount([zlib.crc32(w.encode()) % STEM_BINS for w in set(q.stems)] or [0], minlength=STEM_BINS) * bool(q.stems)
        return self.made("stems", lambda: np.stack([bins(q) for q in self.questions] or [np.zeros(STEM_BINS)]).astype(np.int32))

    def made(self, what, make: Callable):
        """What `make` gives, made once."""
        if what not in self._made:
            self._made[what] = make()
        return self._made[what]

    @property
    def runs(self) -> np.ndarray:
        return self.made("runs", lambda: np.array([most_runs(q.normal) for q in self.questions], np.float32))

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams of all texts and the text of each, sorted by gram."""

        def make():
            code, row = _grams([q.normal for q in self.questions], width)
            order = np.argsort(code, kind="stable")
            code, row = code[order], row[order]
            code |= _again(code, row).astype(np.uint64)
            order = np.argsort(code, kind="stable")
            return code[order], row[order].astype(np.int32)

        return self.made(width, make)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the distinct stems by bins, and of all."""

        def make():
            sets = [set(q.stems) for q in self.questions]
            bins = np.array([k * WORD_BINS + zlib.crc32(w.encode()) % WORD_BINS for k, x in enumerate(sets) for w in x], np.int64)
            counts = np.bincount(bins, minlength=len(sets) * WORD_BINS).reshape(len(sets), WORD_BINS)
            return counts.astype(np.uint16), np.array([len(x) for x in sets], np.float32)

        return self.made("words", make)

    def _aligned_at_least(self, other: Cell, k: int, at: np.ndarray, least: float) -> np.ndarray:
        """How much must be aligned for the similarity to reach `least`, given how far the stems overlap at most."""
        mine, theirs = self.stems[at], other.stems[k]
        both, a, b = np.minimum(mine, theirs).sum(axis=1), mine.sum(axis=1), theirs.sum()
        few, every = np.minimum(a, b), np.maximum(a + b - both, 1)
        words = JACCARD * np.minimum(both / every, 1) + OVERLAP * np.minimum(both / np.maximum(few, 1), 1)
        return np.where(few > 0, np.minimum(least, (least - words) / ALIGNED), least) - _EPS

    def likely(self, other: Cell, k: int, at: np.ndarray, least: float) -> np.ndarray:
        """Those of `at` whose similarity with question k of the other cell may reach `least`: by the characters and stems
        that they share, and then by the longest subsequence, which what is aligned can't exceed."""
        if least <= 0 or not len(at):
            return at
        text = other.questions[k].normal
        sizes, need = np.maximum(self.size[at] + len(text), 1), self._aligned_at_least(other, k, at, least)
        may = 2 * np.minimum(self.chars[at], other.chars[k]).sum(axis=1) >= need * sizes
        at, least = at[may], need[may] / 2 * sizes[may]
        return at[self.reaching(other, np.full(len(at), k), at, least)]

    def reaching(self, other: Cell, asked: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of the pairs of a question `asked` of the other cell and a text `at` of this one have a longest common
        subsequence of `least` or more; asked is sorted."""
        left = self._by_classes(other, asked, at, least)
        out = np.zeros(len(at), bool)
        for pairs in np.split(left, np.flatnonzero(np.diff(asked[left])) + 1) if len(left) else []:
            out[pairs] = self._common(other.questions[asked[pairs[0]]].normal, at[pairs], least[pairs]) >= least[pairs]
        return out

    def _classes(self, many: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The class and the number in it (from 1) of each character, and for each class the numbers of its characters in
        the order of each text, which is a column, with how many there are."""

        def make():
            often = np.bincount(self.flat, minlength=len(self.alphabet))
            of, number, load, used = np.zeros(len(often), np.int64), np.zeros(len(often), np.int64), [0] * many, [0] * many
            for c in np.argsort(-often, kind="stable").tolist():
                k = load.index(min(load))
                used[k] += 1
                of[c], number[c], load[k] = k, used[k], load[k] + int(often[c])
            row, out = np.repeat(np.arange(len(self.size)), self.size), []
            for k in range(many):
                ours = of[self.flat] == k
                have = np.bincount(row[ours], minlength=len(self.size))
                held = np.zeros((int(have.max(initial=0)), len(self.size)), np.uint8 if used[k] < 256 else np.int32)
                held[np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have), row[ours]] = number[self.flat[ours]]
                out.append((held, have))
            return of, number, out

        return self.made(("classes", many), make)

    def _by_classes(self, other: Cell, asked: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of these pairs may have a common subsequence of `least`: what is common has no more characters of a class
        of characters than the longest one of these alone, which are few enough for the bits of one word."""
        by, out = np.ceil(other.size / CLASS_CHARS).astype(np.int64)[asked], []
        for many in np.unique(by).tolist():
            pairs = np.flatnonzero(by == many)
            if len(pairs) < FEWEST or not 0 < many <= MOST_CLASSES:
                out.append(pairs)
                continue
            of, number, classes = self._classes(many)
            size = int(number.max()) + 1
            first, last = int(asked[pairs[0]]), int(asked[pairs[-1]]) + 1
            point = other.alphabet[other.flat[other.start[first] : other.start[last - 1] + other.size[last - 1]]]
            row = np.repeat(np.arange(last - first), other.size[first:last])
            place = np.minimum(np.searchsorted(self.alphabet, point), len(self.alphabet) - 1)
            known = self.alphabet[place] == point
            place, row = place[known], row[known]
            tables, mine = [], []
            for k in range(many):
                ours = of[place] == k
                count = np.bincount(row[ours], minlength=last - first)
                bit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                table = np.zeros((last - first) * size, np.uint64)
                fits = bit < 64
                np.bitwise_or.at(table, (row[ours] * size + number[place[ours]])[fits], np.uint64(1) << bit[fits].astype(np.uint64))
                tables.append(table)
                mine.append(count)
            for some in np.split(pairs, range(LANES, len(pairs), LANES)):
                x, y, need = asked[some] - first, at[some], least[some]
                most = [np.minimum(have[y], count[x]) for count, (_, have) in zip(mine, classes, strict=True)]
                total = sum(most)
                left = np.flatnonzero(total >= need)
                for table, count, (held, have), bound in zip(tables, mine, classes, most, strict=True):
                    if not len(left):
                        break
                    base, row_of = x[left] * size, np.full(len(left), np.uint64(2**64 - 1))
                    index, both = np.empty(len(left), np.int64), np.empty(len(left), np.uint64)
                    for step in held[: int(have[y[left]].max()), y[left]]:
                        np.add(base, step, out=index)
                        met = table[index]
                        met &= row_of
                        np.add(row_of, met, out=both)
                        row_of -= met
                        row_of |= both
                    # a character without a bit leaves all bits set, so behind the 64th they are counted as met
                    met = 64 - np.bitwise_count(row_of).astype(np.int64) + np.maximum(count[x[left]] - 64, 0)
                    total[left] += np.minimum(met, bound[left]) - bound[left]
                    left = left[total[left] >= need[left]]
                out.append(some[left])
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def _common(self, text: str, at: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
        """The longest common subsequences of a text with those at `at`, each as `_lcs` finds it: many at a time side by
        side, where a row of the table is some words of bits for each. Those that can't reach `least` are left behind."""
        least = np.zeros(len(at)) if least is None else least
        words = -(-len(text) // 64)
        if len(at) < FEW * words:
            return np.array([_lcs(text, self.questions[i].normal, n) for i, n in zip(at.tolist(), least.tolist(), strict=True)], np.int64)
        places = np.zeros((words, len(self.alphabet)), np.uint64)
        known = np.searchsorted(self.alphabet, np.frombuffer(text.encode("utf-32-le"), np.uint32))
        for i, (c, p) in enumerate(zip(text, known.tolist(), strict=True)):
            if p < len(self.alphabet) and self.alphabet[p] == ord(c):
                places[i // 64, p] |= np.uint64(1 << i % 64)
        unused = np.uint64(2**64 - 1) << np.uint64((len(text) - 1) % 64) << np.uint64(1)  # bits behind the last character

        def found(rows: np.ndarray) -> np.ndarray:
            rows = rows.copy()
            rows[-1] &= ~unused
            return len(text) - np.bitwise_count(rows).astype(np.int64).sum(axis=0)

        out = np.zeros(len(at), np.int64)
        order = np.argsort(-self.size[at], kind="stable")
        size, start = self.size[at][order], self.start[at][order]
        rows = np.full((words, len(at)), np.uint64(2**64 - 1))
        step = 0
        while len(order):
            n = int(np.searchsorted(-size, -step, side="left"))
            if n < len(order) or step % 64 == 63:  # some are done, or may be past hope
                most = found(rows) + np.maximum(size - step, 0)
                left = (size > step) & (most >= least[order])
                out[order[~left]] = most[~left]
                order, size, start, rows = order[left], size[left], start[left], np.ascontiguousarray(rows[:, left])
                if not len(order):
                    break
            char, carry = self.flat[start + step], None
            for k in range(words):
                row = rows[k]
                met = row & places[k, char]
                total = row + met
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                rows[k] = total | (row - met)
                carry = over.astype(np.uint64)
            step += 1
        return out


#: From this length on the aligner starts no run at a character that makes up over a hundredth of the second text.
LONG = 200
#: Characters of the grams that long texts are counted by.
GRAM = 5


def most_runs(text: str) -> float:
    """In how many runs a text can be aligned to at most, as the second one.

    A run of a long text holds one of its rare characters (n // 100 + 1 times or fewer), or else begins both texts.
    """
    if len(text) < LONG:
        return math.inf
    often = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1]
    return 1 + int(often[often <= len(text) // 100 + 1].sum())


def _grams(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of texts as numbers with 22 free bits, and the text of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    many = max(0, len(points) - width + 1)
    inside = row[:many] == row[width - 1 :] if many else np.zeros(0, bool)
    if width == 2:
        code = (points[:many] << np.uint64(43)) | (points[1:] << np.uint64(22)) if many else np.zeros(0, np.uint64)
    else:
        code = sum((points[i : i + many] * np.uint64(0x9E3779B97F4A7C15 ** (i + 1) % 2**64) for i in range(width)), np.zeros(many, np.uint64)) >> np.uint64(22) << np.uint64(22)
    return code[inside], row[:many][inside]


def _again(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each gram was in its text before; equal ones of a text stand together."""
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(fresh)
    return np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))


def _pairs_of(texts: list[str], width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The character pairs of texts, numbered where they repeat in one, and the text of each; sorted by text. Grams of
    another width are hashed, so some may count as equal that are not, but never the other way round."""
    code, row = _grams(texts, width)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    return code | _again(code, row).astype(np.uint64), row


class PairIndex:
    """Texts indexed by their character pairs; `near` finds those that may be aligned well enough."""

    def __init__(self, texts: list[str], threshold: float):
        self.threshold, self.size = threshold, np.array([len(t) for t in texts], np.int64)
        code, row = _pairs_of(texts)
        order = np.argsort(code, kind="stable")
        self.rows = row[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.runs = np.array([most_runs(t) for t in texts])
        code, row = _pairs_of([t if len(t) >= LONG else "" for t in texts], GRAM)
        order = np.argsort(code, kind="stable")
        self.gram_rows = row[order]
        self.grams, first = np.unique(code[order], return_index=True)
        self.gram_first = np.append(first, len(code))

    def _grams_in(self, grams: np.ndarray) -> np.ndarray:
        """How many of these grams each long text has."""
        place = np.searchsorted(self.grams, grams)
        known = place < len(self.grams)
        place = place[known][self.grams[place[known]] == grams[known]]
        lists = [self.gram_rows[x:y] for x, y in zip(self.gram_first[place].tolist(), self.gram_first[place + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate(lists), minlength=len(self.size)) if lists else np.zeros(len(self.size), np.int64)

    def near(self, codes: np.ndarray, size: int, grams: np.ndarray | None = None) -> np.ndarray:
        """Places of the texts that share enough pairs with a text of this size that has these pairs; where its grams are
        given, and a long text is aligned in few runs, enough grams: a run of k characters holds k - GRAM + 1 of them."""
        share = least_share(self.threshold) - _EPS
        fits = (self.size >= share * size) & (self.size * share <= size) & (self.size > 0) & (size > 0)
        if not fits.any():
            return np.zeros(0, np.int64)
        if grams is not None:
            least = self.threshold / 2 * (self.size + size) - (GRAM - 1) * self.runs - _EPS
            known = least > 0
            if (fits & known).any():
                fits &= ~known | (self._grams_in(grams) >= least)
            if not (fits & ~known).any():
                return np.flatnonzero(fits)
        need = least_pairs(self.size + size, self.threshold)
        place = np.searchsorted(self.codes, codes)
        known = place < len(self.codes)
        place = place[known][self.codes[place[known]] == codes[known]]
        a, b = self.first[place], self.first[place + 1]
        order = np.argsort(b - a, kind="stable")
        a, b = a[order], b[order]
        later = int(max(0, min(len(a), need[fits].min() // 2)))  # the commonest pairs wait
        here = np.zeros(len(self.size), np.int64)
        for some, left in ((slice(0, len(a) - later), later), (slice(len(a) - later, len(a)), 0)):
            lists = [self.rows[x:y] for x, y in zip(a[some], b[some], strict=True)]
            if lists:
                here += np.bincount(np.concatenate(lists), minlength=len(here))
            fits &= here >= need - left
            if not fits.any():
                break
        return np.flatnonzero(fits)


# --- which texts of two cells may be alike ----------------------------------------------------------------------------

#: Questions of a cell that are held against another at a time, and meetings of grams that are counted at once.
SLICE, COUNTED = 128, 1 << 20
#: Widths of the grams that texts aligned in few runs are counted by, and how many must be shared for one to be taken.
GRAMS = ((10, 16), (GRAM, 0))


def _grams_shared(mine: Cell, others: Cell, width: int, asks: np.ndarray, held: np.ndarray, first: int) -> np.ndarray:
    """How many grams the asking ones of the texts from `first` on share with each of the others that are held."""
    code, row = mine.grams(width)
    ours = (row >= first) & (row < first + len(asks))
    code, row = code[ours], row[ours] - first
    ours = asks[row]
    code, row = code[ours], row[ours].astype(np.int64)
    there, rows = others.grams(width)
    if not held.all():
        kept = held[rows]
        there, rows = there[kept], rows[kept]
    begin, end = np.searchsorted(there, code), np.searchsorted(there, code, side="right")
    met = end > begin
    row, begin, many = row[met], begin[met], (end - begin)[met]
    out = np.zeros(len(asks) * len(held), np.int32)
    ends = np.cumsum(many)
    done = 0
    while done < len(many):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + max(COUNTED, len(out)), side="right")))
        n = many[done:upto]
        at = np.arange(n.sum()) + np.repeat(begin[done:upto] - (np.cumsum(n) - n), n)
        out += np.bincount(np.repeat(row[done:upto] * len(held), n) + rows[at], minlength=len(out)).astype(np.int32)
        done = upto
    return out.reshape(len(asks), len(held))


def _common_pairs(cell: Cell, known: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the known numbered pairs each text has, and how many others."""
    last = len(cell.questions) if last is None else last
    code, row = cell.grams(2)
    ours = (row >= first) & (row < last)
    code, row = code[ours], row[ours] - first
    place = np.minimum(np.searchsorted(known, code), len(known) - 1)
    hit = known[place] == code
    out = np.zeros((last - first, len(known)), np.uint8)
    out[row[hit], place[hit]] = 1
    return out, np.bincount(row[~hit], minlength=last - first).astype(np.float32)


def _pairs_shared(mine: Cell, others: Cell, first: int, last: int) -> np.ndarray:
    """How many numbered character pairs texts share at most: the commonest as they are, and the rest by how many there are."""

    def make():
        code = others.grams(2)[0]
        if not len(code):
            return None
        every, many = np.unique(code, return_counts=True)
        known = np.sort(every[np.argsort(-many, kind="stable")[:COMMON_PAIRS]])
        return known, *_common_pairs(others, known)

    made = others.made("pairs", make)
    if made is None:
        return np.zeros((last - first, len(others.questions)), np.float32)
    known, held, rest = made
    have, more = _common_pairs(mine, known, first, last)
    return have.astype(np.float32) @ held.T.astype(np.float32) + np.minimum(more[:, None], rest)


def may_be_alike(mine: Cell, others: Cell, threshold: float, ordered: bool = False, both: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Each question of a cell with the places of those others whose similarity with it may reach the threshold: what is
    aligned shares grams, more of them where it is in few runs, and only texts whose stems overlap are alike by a mix.
    Of these, the longest subsequence decides, which what is aligned can't exceed.

    ordered: only with others before it, which are the second texts; both: with those after it too, where it is second.
    """
    share, wide, words = np.float32(least_share(threshold) - _SLACK), np.float32(least_reach(threshold) - _SLACK), least_jaccard(threshold)
    b = others.size.astype(np.float32)
    (x, every), (y, most) = mine.words(), others.words()
    y = y.T.astype(np.float32)
    for first in range(0, len(mine.questions), SLICE):
        last = min(first + SLICE, len(mine.questions))
        a = mine.size[first:last].astype(np.float32)[:, None]
        open_ = (a > 0) & (b > 0)
        runs = np.broadcast_to(others.runs, open_.shape)
        if ordered:
            now, then = mine.order[first:last, None], others.order
            open_ &= now != then if both else now > then
            if both:
                runs = np.where(now > then, runs, mine.runs[first:last, None])
        left = open_ & (b >= share * a) & (b * share <= a)
        found = np.zeros(open_.shape, bool)
        for width, enough in GRAMS:
            if not left.any():
                break
            need = np.float32(threshold / 2 - _SLACK) * (a + b) - np.float32(width - 1) * runs
            may = left & (need > enough)
            if may.any():
                met = _grams_shared(mine, others, width, may.any(axis=1), may.any(axis=0), first)
                found |= may & (met >= need)
                left &= ~may
        if left.any():
            need = np.float32(1.5 * threshold - 1 - _SLACK) * (a + b) - np.float32(1.01)
            found |= left & (_pairs_shared(mine, others, first, last) >= need)
        many = every[first:last, None]
        shared = x[first:last].astype(np.float32) @ y
        few = np.minimum(many, most)
        stemmed = open_ & (few > 0) & (b >= wide * a) & (b * wide <= a)
        found |= stemmed & (shared >= np.float32(words / (1 + words)) * (many + most) - np.float32(0.01))
        k, at = np.nonzero(found)
        in_both, least_words = np.minimum(shared[k, at], few[k, at]), few[k, at]
        mix = JACCARD * in_both / np.maximum(many[k, 0] + most[at] - in_both, 1) + OVERLAP * in_both / np.maximum(least_words, 1)
        need = np.where(least_words > 0, np.minimum(threshold, (threshold - mix) / ALIGNED), threshold) - _SLACK
        reach = others.reaching(mine, first + k, at, need / 2 * (a[k, 0] + b[at]))
        k, at = k[reach], at[reach]
        for pairs in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1) if len(k) else []:
            yield first + int(k[pairs[0]]), at[pairs]


# --- meeting of texts under keys, in cells of bounded size -----------------------------------------------------------

_SIDE = ["g", "c", "k", "n", "s", "o"]


def _cell(pdf: pd.DataFrame) -> Cell:
    options = [[(x["n"], list(x["s"])) for x in o] if o is not None else None for o in pdf["o"]]
    order = pdf["k"].to_numpy(np.int64) if "k" in pdf else None
    return Cell([Question(c, None, n, list(s), o) for c, n, s, o in zip(pdf["c"], pdf["n"], pdf["s"], options, strict=True)], order)


def _meet(a: DataFrame, b: DataFrame, find: Callable[[Cell, Cell], list[tuple]]) -> DataFrame:
    """(a, b, score, reason) of what `find` gives for the rows (g, c, n, s, o) of both sides with equal g, cell by cell."""
    chars = F.sum(F.length("n") + 32)
    cells = a.groupBy("g").agg(chars.alias("in_a")).join(b.groupBy("g").agg(chars.alias("in_b")), "g")
    cells = materialize(cells.select("g", F.ceil(F.col("in_a") / CELL_CHARS).cast("int").alias("by_a"), F.ceil(F.col("in_b") / CELL_CHARS).cast("int").alias("by_b"), "in_a", "in_b"), "cells")
    total = cells.agg(F.sum(F.col("in_a") * F.col("by_b") + F.col("in_b") * F.col("by_a"))).first()[0] or 0
    tasks = max(2 * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_CHARS))

    def dealt(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        mine, others = F.pmod(F.xxhash64("c"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("others")
        cut = side.join(cells.select("g", "by_a", "by_b"), "g").select(*_SIDE, mine.alias("mine"), others)
        cell = F.xxhash64("g", *(("mine", "others") if asks else ("others", "mine")))
        return cut.select(F.pmod(cell, F.lit(tasks)).alias("task"), cell.alias("cell"), F.lit(asks).alias("asks"), *_SIDE)

    def match(both: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, rows in both.groupby(["cell", "g"], sort=False):
            found += find(_cell(rows[rows["asks"]]), _cell(rows[~rows["asks"]]))
        return pd.DataFrame(found, columns=["a", "b", "score", "reason"])

    met = dealt(a, "by_a", "by_b", True).unionByName(dealt(b, "by_b", "by_a", False))
    # dealt by number, since the work of a cell is that of its pairs, not of its bytes
    return met.repartition(tasks, "task").groupBy("task").applyInPandas(match, "a string, b string, score double, reason string")


#: Cells of a group beyond which its texts are written once, as blocks of like length that are read for each other.
MOST_CELLS = 4
#: Lengths of a block, as a power of e, and how many blocks of each side a task has, and bytes sent at once.
BAND, HELD, BATCH_BYTES = 0.2, 6, 1 << 22


def _meet_texts(a: DataFrame, b: DataFrame, find: Callable[..., list[tuple]], reach: float, ordered: bool = False) -> DataFrame:
    """(a, b, score, reason) of what `find` gives for the rows (w, c, k, n, s, o) of both sides with equal w.

    Small groups meet in cells. What these copy grows with the square of a group, so large ones are written once, in blocks,
    and each task reads some of both sides. reach: how short a text may be beside another; ordered: both sides are the
    same, and `find` is asked for pairs of a row with those before it, or with those after it too (`both`).
    """
    chars, both_sides = F.sum(F.length("n") + 32), ((a, "in_a"), (b, "in_b"))
    sizes = [side.groupBy("w").agg(chars.alias(name)) for side, name in both_sides]
    large = materialize(sizes[0].join(sizes[1], "w").where(F.greatest("in_a", "in_b") > MOST_CELLS * CELL_CHARS).select("w"), "large")
    if large.isEmpty():
        discard(large)
        return _meet(*(side.withColumnRenamed("w", "g") for side, _ in both_sides), find)
    small = [side.join(large, "w", "left_anti").withColumnRenamed("w", "g") for side, _ in both_sides]
    asking = _blocks(a.join(large, "w", "left_semi"))
    held = asking if ordered else _blocks(b.join(large, "w", "left_semi"))
    count, other = asking.count(), held.count()
    least = math.isqrt(2 * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    # by ranges, so that a task has blocks of like length, all or none of which meet those of another
    x = asking.repartitionByRange(max(-(-count // HELD), min(count, least), 1), "w", "block").select(*(F.col(c).alias(f"{c}_a") for c in asking.columns))
    y = held.repartitionByRange(max(-(-other // HELD), min(other, least), 1), "w", "block").select(*(F.col(c).alias(f"{c}_b") for c in held.columns))
    meet = (F.col("w_a") == F.col("w_b")) & (F.col("longest_a") >= F.col("shortest_b") * (reach - _SLACK)) & (F.col("longest_b") >= F.col("shortest_a") * (reach - _SLACK))
    if ordered:
        meet &= F.col("block_a") >= F.col("block_b")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {}

        def cell(side: str, batch: pa.RecordBatch, i: int) -> Cell:
            name = side, batch["w_a"][i].as_py(), batch[f"block_{side}"][i].as_py()
            if name in cells:
                cells[name] = cells.pop(name)
            else:
                same = [k for k in cells if k[0] == side]
                if len(same) >= (HELD + 1 if side == "b" else 1):
                    del cells[same[0]]
                rows = batch[f"rows_{side}"][i].values
                cells[name] = _cell(pd.DataFrame({c: rows.field(c).to_pylist() for c in "cknso"}))
            return cells[name]

        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                mine, others = cell("a", batch, i), cell("b", batch, i)
                found += find(mine, others, both=True) if ordered and batch["block_a"][i] != batch["block_b"][i] else find(mine, others)
            yield pa.RecordBatch.from_pylist([dict(zip(_HIT.names, hit, strict=True)) for hit in found], _HIT)

    # each task pairs some blocks of one side with some of the other, so nothing is copied but what it holds
    met = x.hint("shuffle_replicate_nl").join(y, meet).select("w_a", "block_a", "block_b", "rows_a", "rows_b")
    # a row of two blocks is large, so a batch of the usual bytes, which both sides hold, would have many of them
    conf, limit = a.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = conf.get(limit, None)
    conf.set(limit, str(BATCH_BYTES))
    try:
        found = materialize(met.mapInArrow(match, "a string, b string, score double, reason string"), "met")
    finally:
        conf.unset(limit) if usual is None else conf.set(limit, usual)
    for df in {id(x): x for x in (asking, held)}.values():
        discard(df)
    return _meet(*small, find).unionByName(found)


_HIT = pa.schema([("a", pa.string()), ("b", pa.string()), ("score", pa.float64()), ("reason", pa.string())])


def _blocks(side: DataFrame) -> DataFrame:
    """(w, block, shortest, longest, rows): the texts of like length, in blocks of a cell's characters."""
    size = F.length("n")
    rows = side.where(size > 0).withColumn("band", F.floor(F.ln(size.cast("double")) / BAND))
    parts = rows.groupBy("w", "band").agg(F.ceil(F.sum(size + 32) / CELL_CHARS).alias("parts"))
    block = F.col("band") * F.lit(1 << 32) + F.pmod(F.xxhash64("c"), "parts")
    cut = rows.join(parts, ["w", "band"]).withColumn("block", block).groupBy("w", "block")
    return materialize(cut.agg(F.min(size).alias("shortest"), F.max(size).alias("longest"), F.collect_list(F.struct("c", "k", "n", "s", "o")).alias("rows")), "blocks")


def _by_options(left: DataFrame, right: DataFrame, apart: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides under each pair of option sets that may be alike enough: one of the rarer options of the first must have
    an alike one in the second. apart: not those whose sets are equal, with a word in each option."""
    opened = []
    for side in (left, right):
        x = side.where("o is not null").withColumn("set", F.sha2(F.concat_ws("\x1f", "w", F.to_json(F.transform("o", lambda x: x["n"]))), 256))
        each = x.select("w", "set", F.size("o").alias("many"), F.forall("o", lambda x: x["n"] != "").alias("whole"), F.explode("o").alias("x")).select("w", "set", "many", "whole", "x.n", "x.s").distinct()
        opened.append((x, each.withColumn("c", F.sha2(F.concat_ws("\x1f", "w", "n"), 256))))
    (a, in_a), (b, in_b) = opened
    # options that are alike, by the same joins: an option is a text of its own
    one = lambda each: each.select("w", "c", "n", "s", F.lit(None).cast(_OPTIONS).alias("o")).dropDuplicates(["c"])
    alike = materialize(_near(one(in_a), one(in_b), SAME_OPTION, compare).select("a", "b"), "alike")
    often = in_b.groupBy(F.col("c").alias("b")).agg(F.count("*").alias("often"))
    ways = alike.join(often, "b").groupBy(F.col("a").alias("c")).agg(F.sum("often").alias("often"))
    ranked = in_a.join(ways, "c", "left").groupBy("set", "many", "whole").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "c"))).alias("r"))
    first = F.slice("r", F.lit(1), (F.col("many") - F.ceil(F.col("many") * OPTIONS - _EPS) + 1).cast("int"))["c"]
    met = ranked.select(F.col("set").alias("set_a"), "many", "whole", F.explode(first).alias("a")).join(alike, "a").join(in_b.select(F.col("c").alias("b"), F.col("set").alias("set_b"), F.col("many").alias("other")), "b")
    met = met.where(F.col("many") >= OPTIONS * F.greatest("many", "other") - _EPS)
    if apart:
        met = met.where("set_a <> set_b or not whole")
    met = met.select("set_a", "set_b").distinct()
    met = materialize(met.select("set_a", "set_b", F.concat("set_a", F.lit("/"), "set_b").alias("g")), "sets")
    keyed = lambda side, name: side.withColumnRenamed("set", name).join(met, name).select("g", "c", F.lit(0).cast("long").alias("k"), "n", "s", "o")
    return keyed(a, "set_a"), keyed(b, "set_b")


_OPTIONS = "array<struct<n: string, s: array<string>>>"


def _near(left: DataFrame, right: DataFrame, threshold: float, rule, by_options: bool = False, apart: bool = False, ordered: bool = False) -> DataFrame:
    """(a, b, score, reason) of the contents (w, c, n, s, o) that the rule calls the same; those of other w don't meet.

    by_options: the rule looks at options; apart: pairs with equal sets of options may be left out; ordered: both sides
    are the same, and only the pairs of a content with those of a smaller k are asked for (others may be found too, and
    those of empty texts are not).
    """
    if not ordered:
        left, right = (side.withColumn("k", F.lit(0).cast("long")) for side in (left, right))

    def alike(mine: Cell, others: Cell, both: bool = False) -> list[tuple]:
        out = []
        for k, at in may_be_alike(mine, others, threshold, ordered, both):
            for i in at.tolist():
                x, y = mine.questions[k], others.questions[i]
                if both and others.order[i] > mine.order[k]:
                    x, y = y, x
                if hit := rule(x, y, threshold):
                    out.append((x.key, y.key, *hit))
        return out

    def mixed(mine: Cell, others: Cell, least: float = threshold) -> list[tuple]:
        every, out = np.arange(len(others.questions)), []
        for k, x in enumerate(mine.questions):
            out += [(x.key, others.questions[i].key, *hit) for i in others.likely(mine, k, every, least).tolist() if (hit := rule(x, others.questions[i], threshold))]
        return out

    def chosen(mine: Cell, others: Cell) -> list[tuple]:
        # options alone can make two questions of a batch the same; for stored ones the texts must be likely too
        return mixed(mine, others, max(BOOST_TEXT, 2 * threshold - 1) if rule is compare_stored else 0.0)

    if least_jaccard(threshold) > 0:
        found = _meet_texts(left, right, alike, least_reach(threshold), ordered)
    else:  # nothing follows for the stems from so low a threshold
        found = _meet_texts(left, right, mixed, 0.0)
    if not ordered:
        equal = left.select("w", "n", F.col("c").alias("a")).join(right.select("w", "n", F.col("c").alias("b")), ["w", "n"])
        found = found.unionByName(equal.select("a", "b", F.lit(1.0).alias("score"), F.lit("EXACT_NORMALIZED").alias("reason")))
    if by_options:
        found = found.unionByName(_meet(*_by_options(left, right, apart), chosen))
    return found.distinct()


def _near_few(asked: list[Question], right: DataFrame, threshold: float, rule) -> DataFrame:
    """(a, b, score, reason) as `_near` finds them without options, for questions that every task can hold: no row of `right`
    is moved. The threshold must say something of stems."""
    sent = right.sparkSession.sparkContext.broadcast([(q.key, q.normal, q.stems) for q in asked])

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Cell([Question(k, None, n, s) for k, n, s in sent.value])
        for pdf in parts:
            found = []
            # texts of like length together, so that most questions pass most of them by
            bands = np.floor(2 * np.log(np.maximum(pdf["n"].str.len(), 1)) / max(0.1, -math.log(least_share(threshold))))
            for _, rows in pdf.groupby(bands, sort=False):
                others = _cell(rows)
                for k, at in may_be_alike(mine, others, threshold):
                    x = mine.questions[k]
                    found += [(x.key, others.questions[i].key, *hit) for i in at.tolist() if (hit := rule(x, others.questions[i], threshold))]
            yield pd.DataFrame(found, columns=["a", "b", "score", "reason"])

    return right.where("n <> ''").select("c", "n", "s", "o").mapInPandas(match, "a string, b string, score double, reason string")


def _contents(df: DataFrame, key: str, text: str, options: str | None, within: Column) -> DataFrame:
    """(w, k, c, n, s, o): each row with its key and its content; equal contents have one c."""
    made = F.lit(None).cast(_OPTIONS)
    if options:
        values = F.filter(F.map_values(options), lambda x: F.length(x) > 0)
        sets = F.array_sort(F.array_distinct(F.transform(values, lambda x: F.struct(normalize_question(x).alias("n"), stems(x).alias("s")))))
        made = F.when((F.col("question_type") == "MCQ") & (F.size(sets) > 0), sets)
    rows = df.select(within.alias("w"), F.col(key).alias("k"), normalize_question(F.col(text)).alias("n"), stems(F.col(text)).alias("s"), made.alias("o"))
    name = F.sha2(F.concat_ws("\x1f", "w", "n", F.coalesce(F.to_json(F.transform("o", lambda x: x["n"])), F.lit(""))), 256)
    return rows.withColumn("c", name)


def similar_pairs(asked: DataFrame, rows: DataFrame, text: str, key_asked: str, key_rows: str, threshold: float = 0.8, options: str | None = None, stored: bool = True) -> DataFrame:
    """(key_asked, key_rows, score, reason) of every question of `asked` with every row that it duplicates.

    options: a map column, for rows with question_type MCQ. stored: the rules for stored questions, else those inside a
    batch. Questions without options and with less than SENT_CHARS characters in all are sent to every task, and only texts
    that equal ones are folded by move; otherwise neither side is collected or broadcast. A null text counts as empty, and a
    question without text asks nothing.
    """
    everywhere = F.lit("")
    rule = compare_stored if stored else compare
    contents = [_contents(df, key, text, options, everywhere) for df, key in ((asked, key_asked), (rows, key_rows))]
    members = [materialize(contents[0], "contents")]
    left = materialize(members[0].where("n <> ''").select("w", "c", "n", "s", "o").dropDuplicates(["c"]), "texts")
    few = options is None and least_jaccard(threshold) > 0 and (left.agg(F.sum(F.length("n") + 32)).first()[0] or 0) < SENT_CHARS
    if few:
        members.append(contents[1])
        right, made = contents[1].select("c", "n", "s", "o").dropDuplicates(["c"]), [left]
        found = _near_few([Question(r.c, None, r.n, list(r.s)) for r in left.select("c", "n", "s").collect()], right, threshold, rule)
    else:
        members.append(materialize(contents[1], "contents"))
        right = materialize(members[1].select("w", "c", "n", "s", "o").dropDuplicates(["c"]), "texts")
        found, made = _near(left, right, threshold, rule, options is not None), [left, right, members[1]]
    found = materialize(found, "found")
    a, b = members[0].select(F.col("c").alias("a"), F.col("k").alias(key_asked)), members[1].select(F.col("c").alias("b"), F.col("k").alias(key_rows))
    out = materialize(found.join(b, "b").join(a, "a").select(key_asked, key_rows, "score", "reason"), "pairs")
    for df in (members[0], *made, found):
        discard(df)
    return out


def equal_pairs(asked: DataFrame, rows: DataFrame, text: str, key_asked: str, key_rows: str) -> DataFrame:
    """(key_asked, key_rows, score, reason): what `similar_pairs` finds by equal normalised texts, and no more, by one join."""
    a, b = (df.select(F.col(key).alias(key), normalize_question(F.col(text)).alias("n")) for df, key in ((asked, key_asked), (rows, key_rows)))
    return a.where("n <> ''").join(b, "n").select(key_asked, key_rows, F.lit(1.0).alias("score"), F.lit("EXACT_NORMALIZED").alias("reason"))


def best_match(pairs: DataFrame, key_asked: str, key_rows: str) -> DataFrame:
    """The best match of each question: an exact one, or else the highest score; the smallest key of equals."""
    order = F.struct((F.col("reason") == "EXACT_NORMALIZED").alias("e"), "score", (-F.col(key_rows)).alias("k"))
    return pairs.groupBy(key_asked).agg(F.max_by(F.struct(key_rows, "score", "reason"), order).alias("b")).select(key_asked, "b.*")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first): each text with the smallest key of its normalised form."""
    rows = df.select(key, F.md5(normalize_question(F.col(text))).alias("_n"))
    firsts = rows.groupBy("_n").agg(F.min(key).alias("first"))
    return rows.join(firsts, "_n").select(key, "first")


# --- the first ones ---------------------------------------------------------------------------------------------------


def first_kept(nodes: DataFrame, edges: DataFrame, cliques: DataFrame | None = None) -> DataFrame:
    """(node): what a walk keeps that takes nodes in order and leaves out each one with a kept neighbour before it.

    nodes: (node), in the order of their values; edges: (later, earlier), later > earlier; cliques: (clique, node), whose
    nodes are all neighbours, so their pairs need not be listed. A node is kept once all its earlier neighbours are left
    out, and left out once one of them is kept; each round settles all nodes that this decides, so the rounds are as many
    as the longest chain of decisions that wait for each other.
    """
    if cliques is None:
        cliques = nodes.select(F.lit("").alias("clique"), "node").where("false")
    linked = edges.select(F.col("later").alias("node")).unionByName(edges.select(F.col("earlier").alias("node"))).unionByName(cliques.select("node")).distinct()
    kept = [materialize(nodes.select("node").join(linked, "node", "left_anti"), "kept")]
    open_, edges, cliques = materialize(nodes.select("node").join(linked, "node", "left_semi"), "open"), materialize(edges.select("later", "earlier"), "edges"), materialize(cliques.select("clique", "node"), "cliques")
    while not open_.isEmpty():
        leads = cliques.groupBy("clique").agg(F.min("node").alias("lead"))
        waits = edges.select(F.col("later").alias("node")).unionByName(cliques.join(leads, "clique").where("node > lead").select("node"))
        now = materialize(open_.join(waits, "node", "left_anti"), "kept")
        taken = cliques.join(now, "node").select("clique")
        out = edges.join(now.select(F.col("node").alias("earlier")), "earlier").select(F.col("later").alias("node")).unionByName(cliques.join(taken, "clique").select("node")).join(now, "node", "left_anti").distinct()
        settled = materialize(now.unionByName(out), "settled")
        old = open_, edges, cliques, settled
        open_ = materialize(open_.join(settled, "node", "left_anti"), "open")
        left = edges.join(settled.select(F.col("node").alias("later")), "later", "left_anti").join(settled.select(F.col("node").alias("earlier")), "earlier", "left_anti")
        edges, cliques = materialize(left, "edges"), materialize(cliques.join(settled, "node", "left_anti").select("clique", "node"), "cliques")
        kept.append(now)
        for df in old:
            discard(df)
    whole = kept[0]
    for df in kept[1:]:
        whole = whole.unionByName(df)
    out = materialize(whole, "firsts")
    for df in (*kept, open_, edges, cliques):
        discard(df)
    return out


def greedy_unique(df: DataFrame, group: str, position: str, text: str, threshold: float = 0.8, options: str | None = None) -> DataFrame:
    """`duplicate_of` and `reason` for each draft of a batch: the first kept draft that it repeats, in order of position.

    Positions are whole numbers, distinct in their batch. Drafts with equal texts and options decide alike, so the first
    of them stands for all; texts that are the same, and sets of options that are, hold drafts that repeat each other
    without listing their pairs. No task holds a batch.
    """
    rows = materialize(_contents(df, position, text, options, F.coalesce(F.col(group).cast("string"), F.lit("\x00"))).withColumn("k", F.col("k").cast("long")), "contents")
    texts = materialize(rows.groupBy("w", "c").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("o").alias("o")), "texts")
    node = F.struct("w", "k").alias("node")
    contents = texts.select("w", "c", "k", "n", "s", "o")
    found = _near(contents, contents, threshold, compare, options is not None, apart=True, ordered=True).where("a <> b")
    place = texts.select("c", node)
    edges = found.join(place.select(F.col("c").alias("a"), F.col("node").alias("later")), "a").join(place.select(F.col("c").alias("b"), F.col("node").alias("earlier")), "b")
    edges = materialize(edges.where("later > earlier").select("later", "earlier", "reason"), "edges")
    # texts that are equal, and sets of options that are (with a word in each): their drafts repeat each other
    same = texts.select(F.concat(F.lit("n"), F.sha2(F.concat_ws("\x1f", "w", "n"), 256)).alias("clique"), node, F.lit("EXACT_NORMALIZED").alias("reason"))
    whole = texts.where("o is not null and forall(o, x -> x.n <> '')")
    same = same.unionByName(whole.select(F.concat(F.lit("o"), F.sha2(F.concat_ws("\x1f", "w", F.to_json(F.transform("o", lambda x: x["n"]))), 256)).alias("clique"), node, F.lit("MCQ_OPTION_MATCH").alias("reason")))
    kept = first_kept(texts.select(node), edges, _shared(same.select("clique", "node")))
    # what each content repeats: a kept one before it
    firsts = same.join(kept, "node").select("clique", F.col("node").alias("earlier"))
    by_clique = same.join(firsts, "clique").where("node > earlier").select("node", "earlier", "reason")
    by_edge = edges.withColumnRenamed("later", "node").join(kept.withColumnRenamed("node", "earlier"), "earlier").select("node", "earlier", "reason")
    repeats = by_clique.unionByName(by_edge).groupBy("node").agg(F.min(F.struct("earlier", "reason")).alias("m")).select("node", F.col("m.earlier.k").alias("of"), "m.reason")
    decided = texts.select("c", F.col("k").alias("first"), node).join(repeats, "node", "left")
    out = rows.select("w", "k", "c").join(decided.select("c", "first", "of", "reason"), "c")
    again = F.col("of").isNull() & (F.col("k") > F.col("first"))
    out = out.select(F.col("w").alias("_w"), F.col("k").alias("_k"), F.when(again, F.col("first")).otherwise(F.col("of")).alias("duplicate_of"), F.when(again, "EXACT_NORMALIZED").otherwise(F.col("reason")).alias("reason"))
    out = materialize(out, "decided")
    for x in (rows, texts, edges, kept):
        discard(x)
    keys = df.withColumn("_w", F.coalesce(F.col(group).cast("string"), F.lit("\x00"))).withColumn("_k", F.col(position).cast("long"))
    return keys.join(out, ["_w", "_k"]).select(*(c for c in df.columns if c != options), "duplicate_of", "reason")


def _shared(cliques: DataFrame) -> DataFrame:
    """Cliques of two nodes or more."""
    many = cliques.groupBy("clique").agg(F.count("*").alias("n")).where("n > 1")
    return cliques.join(many, "clique", "left_semi")
