"""Exact top-k inner products on a bit-sliced index.

Every dimension of the quantised vectors is stored as bit slices over the rows of a block. For a
query the slices, shifted by the bits of its weights, are summed by carry-save bitmap arithmetic
into the slices of the score. The k best rows are selected from the most significant score slice
downward; the rows left tied at the boundary are resolved exactly, smaller id first.

Blocks of the index meet blocks of queries by an equi-join on (length, slot): each block of the
index lies in one slot, and the blocks of queries are sent to every slot.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part; vectors
are compared with those of the same length; equal vectors tie and the smaller id wins; a query
without candidates has no rows; extra columns are ignored. Components beyond 2**26 after scaling
are refused, as their scores could overflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

LIMIT = 1 << 26


def build_slices(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(rows, dims) integers to (dims, bits, words) bitmaps of x - lo, and lo."""
    lo = int(x.min())
    u = (x - lo).astype(np.uint64)
    bits = max(1, int(u.max()).bit_length())
    rows, dims = u.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for j in range(bits):
        packed = np.packbits(((u >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        out[:, j, : packed.shape[0]] = packed.T
    return out.view(np.uint64), lo


def sum_slices(index: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Score slices, least significant first, of the weighted sum over dimensions, less a constant that is returned too."""
    dims, bits, words = index.shape
    parts: dict[int, list[np.ndarray]] = {}
    size = np.abs(weights)
    negative = weights < 0
    # a negative weight counts down from the largest value: its slices are complemented
    index = np.where(negative[:, None, None], ~index, index)
    offset = -int(size[negative].sum()) * ((1 << bits) - 1)
    for i in range(int(size.max()).bit_length() if dims else 0):
        d = np.flatnonzero((size >> i) & 1)
        if len(d):
            got = index[d]
            for j in range(bits):
                parts.setdefault(i + j, []).append(got[:, j])
    planes: list[np.ndarray] = []
    w = 0
    while parts:
        rows = parts.pop(w, None)
        if rows is None:
            planes.append(np.zeros(words, np.uint64))
            w += 1
            continue
        a = np.concatenate(rows) if len(rows) > 1 else rows[0]
        carry = []
        while len(a) >= 3:
            t = len(a) // 3
            p, q, r = a[:t], a[t : 2 * t], a[2 * t : 3 * t]
            x = p ^ q
            carry.append((p & q) | (x & r))
            x ^= r
            a = np.concatenate([x, a[3 * t :]]) if len(a) > 3 * t else x
        if len(a) == 2:
            carry.append((a[:1] & a[1:]))
            a = a[:1] ^ a[1:]
        planes.append(a[0])
        if carry:
            parts.setdefault(w + 1, []).extend(carry)
        w += 1
    return planes, offset


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(planes: list[np.ndarray], exist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k largest sums among `exist`, ties to smaller ids, and their sums."""
    sure, edge = np.zeros_like(exist), exist
    for s in reversed(planes):
        hit = edge & s
        both = sure | hit
        n = int(np.bitwise_count(both).sum())
        if n > k:
            edge = hit
        else:
            sure, edge = both, edge & ~s
            if n == k:
                edge = np.zeros_like(exist)
                break
    rows = _rows(sure)
    tied = _rows(edge)
    if len(tied) and len(rows) < k:
        rows = np.concatenate([rows, tied[np.argsort(ids[tied], kind="stable")][: k - len(rows)]])
    total = np.zeros(len(rows), np.int64)
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    for b, s in enumerate(planes):
        total += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << b
    return rows, total


def _quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    x = F.col(vec_col)
    good = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _packed(df: DataFrame, rows_each: int, kind: str) -> DataFrame:
    """Rows of id, v packed into blocks of one vector length: kind, dim, n, ids, values."""
    n = df.count()
    parts = max(1, -(-n // rows_each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            got = held.pop(dim)
            ids, v = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vals": pa.array([v.tobytes()], pa.binary())})

        for batch in batches:
            ids, col = batch.column(0).to_numpy(), batch.column(1)
            off = col.offsets.to_numpy().astype(np.int64)
            values = col.values.to_numpy(zero_copy_only=False)
            if len(values) and np.abs(values).max() > LIMIT:
                raise ValueError(f"a scaled component exceeds {LIMIT}")
            dims = np.diff(off)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = values[(off[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim).astype(np.int32)
                held.setdefault(int(dim), []).append((ids[at], v))
                if sum(len(g[0]) for g in held[int(dim)]) >= 2 * rows_each:
                    yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return df.repartition(parts).mapInArrow(run, "dim int, ids binary, vals binary")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 16384, query_rows: int = 64, slots: int | None = None) -> DataFrame:
    """query_id, rank, <id_col>, score: for each query its k rows of largest floor(scale * x) inner product."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, asked = _quantised(vectors, id_col, vec_col, scale), _quantised(queries, id_col, vec_col, scale)
    # a slot for each block or so of the index, and a copy of the queries for each slot
    slots = slots or 2 * max(1, -(-rows.count() // block_rows))
    index = _packed(rows, block_rows, "index").withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    sent = _packed(asked, query_rows, "query").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    pairs = index.join(sent.select(F.col("dim"), F.col("slot"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals")), ["dim", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray, np.ndarray, int] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, raw, vals, q_raw, q_vals = (batch.column(c)[i].as_py() for c in range(5))
                if last is None or last[0] != raw:
                    ids = np.frombuffer(raw, np.int64)
                    slices, lo = build_slices(np.frombuffer(vals, np.int32).reshape(-1, dim).astype(np.int64))
                    last = (raw, ids, slices, lo)
                _, ids, slices, lo = last
                full = np.zeros(slices.shape[2] * 64, np.uint8)
                full[: len(ids)] = 1
                exist = np.packbits(full, bitorder="little").view(np.uint64)
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for q, w in zip(np.frombuffer(q_raw, np.int64), np.frombuffer(q_vals, np.int32).reshape(-1, dim).astype(np.int64), strict=True):
                    planes, offset = sum_slices(slices, w)
                    own = exist
                    for r in np.flatnonzero(ids == q):
                        own = own.copy()
                        own[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
                    at, total = select_top(planes, own, ids, k)
                    out.append((int(q), ids[at], total + offset + lo * int(w.sum())))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.concatenate([np.full(len(o[1]), o[0]) for o in out])), "vec_id": pa.array(np.concatenate([o[1] for o in out])), "score": pa.array(np.concatenate([o[2] for o in out]))})

    best = pairs.select("dim", "ids", "vals", "q_ids", "q_vals").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
