"""Shared helpers of the corpus operators: intermediate tables, Arrow slices, hashing of bytes and words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import discard, materialize, materialize_bucketed, numbered, shared_dir  # noqa: F401

#: Bytes of text handled at once inside a task; bounds the numpy arrays, whatever the length of an Arrow batch.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: str = "doc_id"):
    """True for the third of the rows that no classifier may learn from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that a slice holds about `limit` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Gives memory that this worker has freed back to the system; it stays alive for further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as one array, and the n + 1 row offsets in it (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(wide), b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply), so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class RangeHash:
    """Hash of any byte range in constant time, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = _powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def join_least(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b; least[i] is the smallest member of i's set on entry and on return."""
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        onward = least[least]
        while (onward != least).any():
            least[:] = onward
            onward = least[least]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run of bytes other than ASCII white space), and the index of each row's first word."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles_of(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row and the row bounds: `width` words, or all words of a shorter row as one."""
    starts, ends, first = words_of(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = RangeHash(LOWER[data])(starts, ends)
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(shingles)))
    row = np.repeat(np.arange(len(counts)), shingles)
    at = np.arange(bounds[-1]) - bounds[row] + first[row]
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        there = at + j < first[row + 1]
        total = total * U64(0xD6E8FEB86659FD93) + np.where(there, word[np.minimum(at + j, n - 1)], U64(0x5851F42D4C957F2D))
        total = mix(total)
    return total, bounds


def hash_sets(batch: pa.RecordBatch, text: str, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = bytes_of(batch.column(text))
    hashes, bounds = shingles_of(data, offsets, width)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
