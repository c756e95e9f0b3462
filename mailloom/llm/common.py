"""Shared pieces: tables, shared-folder materialisation, and byte-level text arithmetic.

Texts are handled as the raw UTF-8 buffers of Arrow string columns, so that words,
lines, windows and their 64-bit fingerprints are computed by whole-array operations.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.sources.scratch import fresh_path

#: bytes of text handled at once by one Python worker; a longer text is handled alone
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: the paths made inside of each open sweeping()
_SWEPT: list[list[str]] = []


def scratch(spark: SparkSession) -> str:
    """A fresh path below the cluster's shared checkpoint folder; without one, a cluster is refused."""
    path = fresh_path(spark)
    for made in _SWEPT:
        made.append(path)
    return path


@contextlib.contextmanager
def sweeping(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch tables made inside; what is to stay has its path from before."""
    made: list[str] = []
    _SWEPT.append(made)
    try:
        yield
    finally:
        _SWEPT[:] = [m for m in _SWEPT if m is not made]
        for path in made:
            _delete(spark, path)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives the loss of executors."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table written by materialize() that no later plan reads."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: bytes from which an Arrow batch takes no more rows
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 2000, size: int = BATCH_BYTES) -> None:
    """Bound the rows and the bytes of an Arrow batch, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, row after the last, bytes, offsets) of runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


# --- fingerprints -----------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Fingerprints of any substrings of a buffer, from one running sum."""

    def __init__(self, buf: np.ndarray):
        self.p, self.q = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        term = _BYTE[buf]
        term *= self.p[:-1]
        np.cumsum(term, out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(np.uint64))

    def fixed(self, length: int) -> np.ndarray:
        """Of the substring of this length at every position that has one."""
        n = len(self.sums) - 1 - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        x = self.sums[length:] - self.sums[:n]
        x *= self.q[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x


#: spans of more bytes are hashed one by one
_LONG = 128
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans, not linear in their bytes: eight of them are mixed at a time, long spans by BLAKE2."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + _BASE)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    live, k = np.flatnonzero(size <= _LONG), 0
    while len(live):
        left = size[live] - k
        out[live] = mix((out[live] ^ (eight[start[live] + k] & _HEAD[np.minimum(left, 8)])) * _BASE + np.uint64(k + 1))
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def same_spans(buf: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, room: int = 1 << 20) -> np.ndarray:
    """Whether the spans a[k]:a_end[k] and b[k]:b_end[k] hold the same bytes, some of them at a time."""
    size = a_end - a
    same = size == b_end - b
    for k in np.flatnonzero(same & (size > room)):
        same[k] = np.array_equal(buf[a[k] : a_end[k]], buf[b[k] : b_end[k]])
    todo = np.flatnonzero(same & (size <= room) & (size > 0))
    total = np.cumsum(size[todo])
    at = 0
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + room, "right")))
        part = todo[at:to]
        n = size[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = buf[np.repeat(a[part], n) + step] != buf[np.repeat(b[part], n) + step]
        same[part[np.unique(np.repeat(np.arange(len(part)), n)[differ])]] = False
        at = to
    return same


def classes_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray | None = None, room: int = 1 << 20) -> np.ndarray:
    """A number for each span, the same for equal bytes only. Hashes propose, every proposal is compared."""
    key = span_hashes(buf, start, end) if key is None else key
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    here, before = order[~new], order[np.flatnonzero(~new) - 1]
    same = same_spans(buf, start[here], end[here], start[before], end[before], room)
    if not same.all():  # different bytes of one hash: told apart by the bytes
        odd = np.isin(key, key[here[~same]])
        known: dict[bytes, int] = {}
        key = key.copy()
        for i in np.flatnonzero(odd):
            key[i] = known.setdefault(buf[start[i] : end[i]].tobytes(), len(known))
        number = np.empty(len(key), np.int64)
        number[~odd] = np.unique(key[~odd], return_inverse=True)[1]
        number[odd] = key[odd].astype(np.int64) + (int(number[~odd].max()) + 1 if (~odd).any() else 0)
        return number
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return number


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts in a slice; owner[d]:owner[d+1] are those of text d."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(buf)
        self.space = space = _SPACE[buf]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:], after[:-1] = space[:-1], space[1:]
            full = off[1:] > off[:-1]
            before[off[:-1][full]] = True
            after[off[1:][full] - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.owner = np.searchsorted(self.start, off)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.owner) - 1), np.diff(self.owner))


def shingles(word: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all k-word windows and the index of the first word of each."""
    n = len(word)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = word[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _BASE + word[j : n - k + 1 + j]
    last = np.repeat(owner[1:], np.diff(owner))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return mix(out[at]), at


def sums_at(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags per text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
