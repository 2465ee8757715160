"""Helpers shared by the operators here: shared-folder tables, text buffers and hashes.

Texts reach Python as Arrow record batches. `pieces` cuts them into slices of a
few megabytes, so that the numpy temporaries of one slice stay small; `buffer`
gives a slice's UTF-8 bytes and document offsets without copying.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII white space of the word contracts: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set by setCheckpointDir; a temporary one only where neither is (tests)."""
    global _own
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = _own = _own or "file://" + tempfile.mkdtemp(prefix="ragloom-")
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds: 8 MB, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def parts_for(spark: SparkSession, n_bytes: int, each: int = 16 << 20) -> int:
    """Groups of about `each` bytes, at least one for each shuffle partition of the session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def give_back() -> None:
    """Return freed memory to the system, so that a reused worker holds only what its present group needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keep_memory(size: int = 16 << 20) -> None:
    """Until the next give_back, arrays of up to `size` bytes reuse freed memory, without a page fault for each page."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, size)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 * size)  # M_TRIM_THRESHOLD


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_pow = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, dtype=U64)
            step[0] = 1
            _pow[k] = np.cumprod(step, dtype=U64)
    return _pow


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], from one prefix sum of a polynomial."""
    n = len(codes)
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * _MULT)


def gram_hash(codes: np.ndarray, g: int) -> np.ndarray:
    """span_hash of every g codes on end."""
    n = len(codes)
    if n < g:
        return np.zeros(0, U64)
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[:n], out=prefix[1:])
    return mix((prefix[g:] - prefix[: n - g + 1]) * down[: n - g + 1] + U64(g * int(_MULT) & (2**64 - 1)))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not taken, in whatever case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def _slices(batches: Iterator[pa.RecordBatch], at: int, cap: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(at).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + cap, "right")) - 1)
            yield batch.slice(lo, hi - lo), text.slice(lo, hi - lo)
            lo = hi
    give_back()


def slices(batches: Iterator[pa.RecordBatch], at: int, cap: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches' rows in order and as they are, cut so that a slice holds about cap bytes of the text in column number `at`, or one text; with the texts (null: empty)."""
    for batch, text in _slices(batches, at, cap):
        yield batch, text.to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", cap: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices by the column of that name, in which null texts are empty ones."""
    batches = iter(batches)
    for first in batches:
        at = first.schema.get_field_index(column)
        for batch, text in _slices(itertools.chain([first], batches), at, cap):
            yield batch.set_column(at, column, text)


def buffer(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """A slice's UTF-8 bytes and its documents' offsets in them."""
    text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if text.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal true runs, which never cross documents."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:n]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers of the lower-cased words [^\\x20\\x09-\\x0D]+, in order."""
    start, end, doc = runs(~WHITE[buf], off)
    return span_hash(LOWER[buf], start, end), doc
