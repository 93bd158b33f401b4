"""Helpers shared by the operators: table access, word expressions, byte-level array work."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from inspect import getfullargspec, isgeneratorfunction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of words; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building an array: starts of words, counted by what a replace leaves."""
    return F.size(words_of(text)).cast("long")


def spread(spark: SparkSession, at_least: int = 1) -> int:
    """Number of groups that work keyed by a hash is dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def shard_count(df: DataFrame, text: str, bytes_per_shard: int = 3_000_000) -> int:
    """Groups of about ``bytes_per_shard`` bytes of text, so a group's memory does not grow with the input."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(spread(df.sparkSession), -(-total // bytes_per_shard))


def gives_back(work: Callable) -> Callable:
    """``work`` on batches or a group that afterwards returns freed memory to the system.

    A worker outlives its task, and else keeps its largest group's memory while other stages run.
    """

    def free() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    def batches_done(batches):
        try:
            yield from work(batches)
        finally:
            free()

    def done(*given):
        try:
            return work(*given)
        finally:
            free()

    if isgeneratorfunction(work):
        return batches_done
    # Spark tells the kinds of group functions by their number of arguments
    return {1: lambda table: done(table), 2: lambda key, table: done(key, table), 3: lambda key, left, right: done(key, left, right)}[len(getfullargspec(work).args)]


# ---- arrays -------------------------------------------------------------------------------------

rng = np.random.default_rng(20240607)
BYTE_VALUE = rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i in 0..n, kept between calls."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Rolling:
    """Hash of any slice of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def raw(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.raw(start, end) ^ ((end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` values, by start."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 400_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes together; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (one more entry than texts)."""
    gap = np.ones(len(raw) + 1, dtype=bool)
    gap[:-1] = IS_SPACE[raw]
    inside = ~gap[:-1]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    before = np.ones(len(raw), dtype=bool)
    before[1:] = gap[: len(raw) - 1] if len(raw) else True
    starts = np.flatnonzero(inside & (before | first[:-1]))
    after = gap[1:] | first[1:]
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUE[raw]).slices(starts, ends)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    have, m = 1, keys
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have : width - have + n]) if have < width else m[:n]


POSITION_BITS = U64(30)


class Segments:
    """Windows of a batch of sequences, cut into runs that share one anchor.

    The anchor of a window is its leftmost gram of least hash, so equal windows have anchors of
    equal content at equal places. A segment is a run of windows with one anchor: ``start`` and
    ``count`` of its windows, hash of the anchor's gram and of everything its windows cover.
    Windows never cross ``offsets``.
    """

    def __init__(self, values: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.window = window
        self.rolling = Rolling(values)
        n = len(values) - window + 1
        if n <= 0:
            self.start = self.count = self.text = np.zeros(0, dtype=np.int64)
            self.gram = self.whole = np.zeros(0, dtype=np.uint64)
            return
        grams = self.rolling.grams(gram)
        keys = ((grams >> POSITION_BITS) << POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(keys, window - gram + 1) & ((U64(1) << POSITION_BITS) - U64(1))).astype(np.int64)
        valid = np.ones(n, dtype=bool)
        steps = np.zeros(n + 1, dtype=np.int32)
        ends = offsets[1:]
        np.add.at(steps, np.clip(np.maximum(ends - window + 1, offsets[:-1]), 0, n), 1)
        np.add.at(steps, np.clip(ends, 0, n), -1)
        valid = np.cumsum(steps[:n]) == 0
        edge = np.ones(n, dtype=bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        inner = offsets[1:-1]
        edge[inner[inner < n]] = True
        at = np.flatnonzero(edge)
        to = np.append(at[1:], n)
        ok = valid[at]
        self.start, self.count = at[ok], (to - at)[ok]
        self.gram = grams[anchor[self.start]]
        self.whole = self.rolling.slices(self.start, self.start + self.count + window - 1)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every window of the chosen segments, and the segment it is from."""
        count = self.count[which]
        source = np.repeat(which, count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.start[source] + inside, source

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        return self.rolling.slices(starts, starts + self.window)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a run of ``width`` from one of the starts."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, size), -1)
    return np.cumsum(steps[:size]) > 0
