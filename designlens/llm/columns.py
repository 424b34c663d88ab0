"""Arrow helpers that the operators of this package share inside tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of a batch on its way to a task's worker; a longer row stands alone.
BATCH_BYTES = 8 << 20
#: Text that is worked on at once in a task; a longer single text stands alone.
SLICE_BYTES = 2 << 20


def give_back() -> None:
    """Hand memory that this process no longer uses back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run: Callable) -> Callable:
    """``run`` (a function of record batches) that gives memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of a bounded number of bytes (long texts count), with memory given back after each task.

    The bound is a setting of the session, which this sets.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(releasing(run), schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: distinct ones, and codes by row."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("")
        if lower:
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, "[\\t-\\r]", " ")
        self._group(pc.split_pattern(texts, " "), True)

    @classmethod
    def pieces(cls, parts: pa.ListArray) -> "Words":
        """As for words, of lists of strings, which may be empty strings."""
        self = cls.__new__(cls)
        self._group(parts, False)
        return self

    def _group(self, parts: pa.ListArray, drop_empty: bool) -> None:
        flat, rows = parts.flatten(), pc.list_parent_indices(parts)
        if drop_empty:
            keep = pc.greater(pc.binary_length(flat), 0)
            flat, rows = flat.filter(keep), rows.filter(keep)
        coded = flat.dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.codes: np.ndarray = coded.indices.to_numpy(zero_copy_only=False)
        self.rows: np.ndarray = rows.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds: np.ndarray = np.searchsorted(self.rows, np.arange(len(parts) + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def times(self) -> np.ndarray:
        """How often each distinct word occurs."""
        return np.bincount(self.codes, minlength=len(self.distinct))


class Memo:
    """Results of words that a worker has solved before.

    Only words that occur twice in a slice are kept, since most others never come
    again, and as many as ``room`` bytes hold: frequent words come early.
    """

    #: Bytes of an entry besides its word and result.
    ENTRY = 200

    def __init__(self, room: int):
        self.room, self.known = room, {}

    def solve(self, words: Words, solver) -> list:
        """The result of each distinct word; ``solver`` takes and returns a list."""
        strings = words.distinct.to_pylist()
        out = list(map(self.known.get, strings))
        missing = [i for i, x in enumerate(out) if x is None]
        often = words.times() > 1
        for i, x in zip(missing, solver([strings[i] for i in missing])):
            out[i] = x
            size = self.ENTRY + 4 * len(strings[i]) + (len(x) if isinstance(x, bytes) else 0)
            if often[i] and size <= self.room:
                self.known[strings[i]] = x
                self.room -= size
        return out


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(s) for s in strings.to_pylist()), np.uint64, len(strings))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gather(values: list | np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Concatenate the runs ``values[starts[i]:starts[i]+lengths[i]]`` for i in ``order``."""
    n = lengths[order]
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.asarray(values).dtype)
    ends = np.cumsum(n)
    at = np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[order], n)
    return np.asarray(values)[at]


def run_sums(lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` between consecutive ``bounds``."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    return total[bounds[1:]] - total[bounds[:-1]]
