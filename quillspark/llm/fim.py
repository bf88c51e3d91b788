"""Fill-in-middle transformation: a table-driven automaton over UTF-8 bytes counts units, code points and sentinels.

One scan runs the automaton over blocks of all texts of a slice side by side and counts, for each block, how often each
transition was taken; sums of weighted counts are the code points, units and sentinels of a block. Cuts are named by unit
numbers, so the running sums tell the block of a cut, and a second pass over those blocks alone finds its byte.

The state depends on the last LOOKBACK bytes only (`lookback` derives that from the table), so a block can start anywhere.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bytes_of, table, text_slices

#: The sentinels: an angle bracket, a letter for prefix, suffix or middle, and the closing bracket.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a text that one lane of the scan runs over.
BLOCK = 512

# classes of bytes
PLAIN, NEWLINE, ANGLE, LETTER, CLOSING, CONTINUED, LEAD2, LEAD3, LEAD4 = range(9)
# states: at the start of a unit, inside one, after "<", after "<" and a letter, one to three bytes short of a code point
FRESH, INSIDE, OPENED, NAMED, SHORT1, SHORT2, SHORT3 = range(7)
# what transitions are counted for
CODE_POINTS, UNITS, SENTINELS = range(3)


def _classes() -> np.ndarray:
    of = np.full(256, PLAIN, np.uint8)
    of[0x80:0xC0], of[0xC0:0xE0], of[0xE0:0xF0], of[0xF0:0x100] = CONTINUED, LEAD2, LEAD3, LEAD4
    for mark in (PREFIX, SUFFIX, MIDDLE):
        of[[ord(c) for c in mark]] = ANGLE, LETTER, CLOSING
    of[ord("\n")] = NEWLINE
    return of


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the counts of each transition, numbered state * 9 + class."""
    after, counts = np.full((7, 9), INSIDE, np.uint8), np.zeros((7, 9, 3), np.int64)
    after[:, NEWLINE], after[:, ANGLE], after[OPENED, LETTER] = FRESH, OPENED, NAMED
    after[:, LEAD2], after[:, LEAD3], after[:, LEAD4] = SHORT1, SHORT2, SHORT3
    after[SHORT2, CONTINUED], after[SHORT3, CONTINUED] = SHORT1, SHORT2
    counts[:, :, CODE_POINTS] = 1
    counts[:, CONTINUED, CODE_POINTS] = 0
    counts[FRESH, :, UNITS] = 1
    counts[NAMED, CLOSING, SENTINELS] = 1
    return after.ravel(), counts.reshape(-1, 3)


CLASS = _classes()
AFTER, COUNTS = _transitions()
CLASSES = 9


def lookback() -> int:
    """The least number of bytes after which the state is the same whatever it was before them."""
    for k in itertools.count():
        for word in itertools.product(range(CLASSES), repeat=k):
            states = np.arange(len(AFTER) // CLASSES)
            for c in word:
                states = AFTER[states * CLASSES + c]
            if len(set(states.tolist())) > 1 and _possible(word):
                break
        else:
            return k


def _possible(word: tuple[int, ...]) -> bool:
    """Whether the classes can stand in UTF-8: continuation bytes only behind a lead byte that wants them, and all of them."""
    want = None  # bytes of a code point that are missing; unknown at first
    for c in word:
        if c == CONTINUED:
            if want == 0:
                return False
            want = None if want is None else want - 1
        else:
            if want:
                return False
            want = {LEAD2: 1, LEAD3: 2, LEAD4: 3}.get(c, 0)
    return True


#: What `lookback` gives; a test holds it against the table.
LOOKBACK = 3


class Scan:
    """One scan over the texts data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.data, self.offsets = CLASS[data], offsets
        pieces = -(-np.diff(offsets) // block)
        self.first = np.concatenate(([0], np.cumsum(pieces)))
        row = np.repeat(np.arange(len(pieces)), pieces)
        place = np.arange(self.first[-1]) - self.first[row]
        self.start = offsets[row] + place * block
        self.stop = np.minimum(self.start + block, offsets[row + 1])
        # the state in which each block begins, from the bytes just before it
        self.state = np.full(len(row), FRESH, np.int64)
        later = np.flatnonzero(place)
        state = np.full(len(later), INSIDE, np.int64)
        for back in range(LOOKBACK, 0, -1):
            state = AFTER[state * CLASSES + self.data[self.start[later] - back]].astype(np.int64)
        self.state[later] = state
        taken = np.zeros(len(row) * len(AFTER), np.int32)
        for lanes, code, _ in self._walk(np.arange(len(row))):
            taken[lanes * len(AFTER) + code] += 1
        of_block = taken.reshape(-1, len(AFTER)) @ COUNTS
        self.before = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(of_block, axis=0)))
        #: Code points, units and sentinels of each text.
        self.total = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def _walk(self, blocks: np.ndarray):
        """Yields (lanes, transition of each, bytes done) for each step of all blocks side by side; lanes index `blocks`."""
        size = (self.stop - self.start)[blocks]
        lanes = np.argsort(-size, kind="stable")
        size, at, state = size[lanes], self.start[blocks][lanes], self.state[blocks][lanes]
        for done in range(size[0] if len(size) else 0):
            m = int(np.searchsorted(-size, -done, side="left"))
            code = state[:m] * CLASSES + self.data[at[:m] + done]
            yield lanes[:m], code, done
            state[:m] = AFTER[code]

    def cuts(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte in data, and the code points before it in its text, where the first units[i] units of text i end."""
        byte, points = self.offsets[1:].copy(), self.total[:, CODE_POINTS].copy()
        inside = np.flatnonzero(units < self.total[:, UNITS])
        wanted = self.before[self.first[inside], UNITS] + units[inside]
        block = np.searchsorted(self.before[1:, UNITS], wanted, side="right")
        rest, seen, passed, open_ = wanted - self.before[block, UNITS], np.zeros(len(block), np.int64), np.zeros(len(block), np.int64), np.ones(len(block), bool)
        for lanes, code, done in self._walk(block):
            counts = COUNTS[code]
            here = lanes[open_[lanes] & (counts[:, UNITS] > 0) & (seen[lanes] == rest[lanes])]
            if len(here):
                byte[inside[here]] = self.start[block[here]] + done
                points[inside[here]] = self.before[block[here], CODE_POINTS] + passed[here] - self.before[self.first[inside[here]], CODE_POINTS]
                open_[here] = False
            seen[lanes] += counts[:, UNITS]
            passed[lanes] += counts[:, CODE_POINTS]
        return byte, points


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; a column of docs that has one of these names is replaced.

    A text is n lines. Hashes of seed and id choose two cuts between lines and the form: psm (prefix, suffix, middle), spm
    (suffix, prefix, middle), or plain for empty texts, those that hold a sentinel, and 100 - rate in a hundred others.
    spm of a hundred formed texts are spm. The output of a plain text is the text, and its prefix_chars and middle_chars
    are null. Null texts count as empty, a null id as an empty one. Repeated rows give equal results; an empty table
    gives an empty one.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    ready = docs.select(F.struct(*own).alias("row"), F.col(text_col).cast("string").alias("text"), draws.alias("draws"))
    schema = ready.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def form(batches):
        for part in text_slices(batches, "text"):
            data, offsets = bytes_of(part.column("text"))
            scan = Scan(data, offsets)
            n = scan.total[:, UNITS]
            draw = np.array(part.column("draws").to_pylist(), np.int64).reshape(-1, 4)
            one, two = draw[:, 0] % (n + 1), draw[:, 1] % (n + 1)
            (low, before), (high, until) = scan.cuts(np.minimum(one, two)), scan.cuts(np.maximum(one, two))
            formed = (n > 0) & (scan.total[:, SENTINELS] == 0) & (draw[:, 2] % 100 < rate)
            forms = np.where(formed, np.where(draw[:, 3] % 100 < spm, "spm", "psm"), "plain")
            raw, out = data.tobytes(), []
            marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
            for kind, a, b, c, d in zip(forms.tolist(), offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), strict=True):
                if kind == "plain":
                    out.append(raw[a:d])
                else:
                    order = [(marks[0], raw[a:b]), (marks[1], raw[c:d])]
                    out.append(b"".join(itertools.chain(*(order if kind == "psm" else order[::-1]), (marks[2], raw[b:c]))))
            whole = lambda x: pa.array(x, pa.int64(), mask=~formed)
            columns = [part.column("row"), pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()), whole(before), whole(until - before), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", *made])

    return ready.mapInArrow(form, schema).select("row.*", *made)


def restore(output: Column, form: Column) -> Column:
    """The text that fill_in_middle was given, from its output and form."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:n], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM p
"""
