"""Shared pieces of the training-data operators: scratch tables, Arrow text slices, vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..sources.scratch import scratch_dir

#: Text bytes that one vectorised step works on; a longer document is a step of its own.
SLICE_BYTES = 2 << 20

#: Words that are digested before their digests are put into an array.
_DIGESTS = 4096

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared scratch folder, so a lost executor loses nothing already written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker gives freed memory back to the system when its partition ends: reused workers outlive a stage."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return all_of


def free_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it (column names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_array(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as large strings, null as the empty text."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    return values.fill_null("") if values.null_count else values


def offsets_of(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that each piece holds about ``limit`` text bytes, and ``rows`` rows at most; a text is never cut."""
    off = offsets_of(text_array(batch, column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = min(start + rows, max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1))
        yield batch.slice(start, min(stop, n) - start)
        start = min(stop, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, found by vectorised byte operations.

    data: the bytes of all texts; off: where each text starts (one more at the end); start, end: byte range of each
    word; first: index of each text's first word (one more at the end)."""

    def __init__(self, values: pa.Array):
        off = offsets_of(values)
        data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]] if len(values) else np.zeros(0, np.uint8)
        self.data, self.off = data, off - off[0]
        self.inside = inside = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.off] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of a 128-bit BLAKE2b digest of each word: words of equal digests can't be written down, nor met by chance. Each distinct word is digested once."""
        place = np.concatenate(([0], np.cumsum(self.end - self.start)))
        flat = self.data[self.inside]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(place), pa.py_buffer(flat)]).dictionary_encode()
        text, at = words.dictionary.buffers()[2], offsets_of(words.dictionary).tolist()
        text = memoryview(text) if text else b""
        distinct = np.empty((len(at) - 1, 2), np.uint64)
        for k in range(0, len(distinct), _DIGESTS):
            ends = at[k : k + _DIGESTS + 1]
            distinct[k : k + _DIGESTS] = np.frombuffer(b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]), np.uint64).reshape(-1, 2)
        index = words.indices.to_numpy()
        return distinct[index, 0], distinct[index, 1]

    def hashes(self) -> np.ndarray:
        """The first half of each word's digest."""
        return self.digests()[0]


#: Ranges above so many bytes are hashed one by one.
_LONG = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, for buckets only: eight bytes at a time go through a bijective mixer, so equal hashes can be written down."""
    size = end - start
    out = mix(size.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    row = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = start[row], size[row]
    while len(row):
        out[row] = mix(out[row] * np.uint64(0x9FB21C651E98DF25) ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        row, at, left = row[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), int(size[k]))
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_cache: list[np.ndarray] = []
#: Powers that a worker keeps; a longer slice works out its own.
_KEPT = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if _cache and len(_cache[0]) >= n:
        return _cache[0][:n], _cache[1][:n]
    size = 1 << max(16, (n - 1).bit_length())
    rows = [_power_row(_BASE, size), _power_row(pow(_BASE, -1, 1 << 64), size)]
    if size <= _KEPT:
        _cache[:] = rows
    return rows[0][:n], rows[1][:n]


def _power_row(base: int, size: int) -> np.ndarray:
    row = np.ones(size, np.uint64)
    done = 1
    while done < size:
        step = np.uint64(pow(base, done, 1 << 64))
        row[done : 2 * done] = row[:done] * step
        done *= 2
    return row


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values: entry i is of values[i : i + size]; shorter input gives none."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[: n - size + 1])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())
