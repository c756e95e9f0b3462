"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a `span`-byte string that covers it also starts in a text with a smaller id. Only
the first `span` bytes of a suffix matter, so suffixes can be sorted apart by what they start with:

1. Chunks. Texts are written once, a few megabytes to a row, in the shared folder.
2. Screen. Every string of `span` bytes is assigned the least fingerprint of its `gram`-byte parts;
   equal strings have equal ones. Runs of positions with one fingerprint are a region. Chunks send
   each fingerprint once, packed by bucket; buckets answer with a bit for each: seen elsewhere too?
   A fingerprint with more than `hot_regions` different regions (a phrase in countless contexts) is
   hot: its windows are sent one by one, spread over as many parts as it takes by their own hashes.
3. Sort. Regions whose fingerprint is shared go to its bucket, a chunk's equal regions once. There
   regions of equal bytes collapse; of fingerprints with several different regions, the suffixes are sorted
   by the difference cover modulo three: sort the triples at the sampled positions, name them,
   recurse on the names until they span enough bytes, merge the remaining suffixes. Neighbours are
   compared byte by byte, and each class of equal strings gets its smallest id. Buckets answer with
   the positions, region by region, that some smaller id holds.
4. Cut. Chunks mark what the answers cover.

A fingerprint only ever proposes: what is taken for equal was compared byte by byte.

Every message between chunks and buckets is a packed array; a string that very many texts share
is one entry per chunk at most.

Cases: null and empty texts and texts shorter than `span` lose nothing; repeats inside one text
do not count; of equal texts with equal ids neither is smaller, so neither loses; an empty table
gives an empty result; a null id counts as larger than all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, classes_of, materialize, mix, scratch, small_batches, span_hashes, text_slices

#: stands for a null id, which counts as larger than all others but this one; results carry the ids as they were given
NO_ID = np.iinfo(np.int64).max
#: parts of a hot fingerprint are numbered above the buckets
PART = 40
#: different regions of a fingerprint in one chunk that are worth telling
MANY = 8
#: chunks in a row group
GROUP = 4
#: bytes gathered or compared at once, as the position of one takes eight
ROOM = 1 << 18


@dataclass(frozen=True)
class SpanSettings:
    span: int = 50
    gram: int = 26
    chunk_bytes: int = 4 << 20
    cache_bytes: int = 1 << 18
    #: text per bucket; a bucket sees about a twelfth as many fingerprints
    bucket_bytes: int = 8 << 20
    #: bytes of regions sorted at once
    sort_bytes: int = 1 << 19
    #: windows of a bucket judged at once, and bytes of regions sent at once
    part_windows: int = 1 << 18
    send_bytes: int = 2 << 20
    #: different regions of one fingerprint from which its windows are spread, and parts for each so many
    #: (a region has about 25 windows, and 67 bytes of each are sent)
    hot_regions: int = 20_000
    hot_parts: int = 8
    #: bytes from which an Arrow batch of chunks or messages takes no more rows
    batch_bytes: int = 2 << 20
    #: answers of this many bytes at most are sent to all executors; larger ones meet the chunks by a shuffle
    broadcast_bytes: int = 32 << 20


# --- chunk side -------------------------------------------------------------------


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunks(docs: DataFrame, s: SpanSettings, keep: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1), s.chunk_bytes):
                ids = batch.column(0).slice(a, b - a).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([(TaskContext.get().partitionId() << 32) + n]), "ids": pa.array([ids.tobytes()], pa.binary()), "offs": pa.array([off.tobytes()], pa.binary()), "data": pa.array([buf.tobytes()], pa.binary()), "kept": pa.array([_ipc(batch.select([0, *range(2, batch.num_columns)]).slice(a, b - a))], pa.binary())})
                n += 1

    spark = docs.sparkSession
    path = scratch(spark)
    made = docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, "chunk long, ids binary, offs binary, data binary, kept binary")
    # small row groups, as readers decode a whole one; their bytes are first looked at after a hundred rows, so the rows are counted
    made.write.option("compression", "zstd").option("parquet.block.row.count.limit", GROUP).option("parquet.block.size", GROUP * s.chunk_bytes).parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _slide(x: np.ndarray, width: int, low: np.ufunc) -> np.ndarray:
    """Least (or greatest) of each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = low(x[:-have], x[have:])
        have *= 2
    return low(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _runs(buf: np.ndarray, off: np.ndarray, s: SpanSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf) - s.span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    pre = Prefix(buf)
    least = _slide(pre.fixed(s.gram), s.span - s.gram + 1, np.minimum)
    # starts whose window would leave the text
    begin = np.maximum(off[:-1], off[1:] - s.span + 1)
    leaves = _gather(begin, off[1:] - begin)
    valid = np.ones(n, bool)
    valid[leaves[leaves < n]] = False
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    new[off[:-1][off[:-1] < n]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    first, last = first[valid[first]], last[valid[first]]
    # at most 64 starts to a region
    pieces = (last - first) // 64 + 1
    if (pieces > 1).any():
        at = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = first[at] + 64 * step, np.minimum(first[at] + 64 * step + 63, last[at])
    return first, last, mix(least[first] ^ np.uint64(0x5851F42D4C957F2D)), pre.of(first, last + s.span)


class Regions:
    """Runs of window starts [first, last] of one text that share their least fingerprint.

    key: of that fingerprint; full: of the bytes that the run's windows cover."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, s: SpanSettings):
        parts = []
        a = 0
        while a < len(off) - 1:  # texts that fit a processor's cache together
            b = max(a + 1, int(np.searchsorted(off, off[a] + s.cache_bytes, "right")) - 1)
            first, last, key, full = _runs(buf[off[a] : off[b]], off[a : b + 1] - off[a], s)
            parts.append((first + off[a], last + off[a], key, full))
            a = b
        empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
        self.first, self.last, self.key, self.full = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        self.doc = np.searchsorted(off, self.first, "right") - 1

    def different(self, at: np.ndarray, codes: int) -> np.ndarray:
        """Different regions of each code, as their fingerprints have it."""
        order = np.lexsort((self.full, at))
        f, c = self.full[order], at[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
        return np.bincount(c[new], minlength=codes)

    def codes(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (bucket << 32 | 32 bits of the key); each region's place; which are in two texts here."""
        code = ((self.key % np.uint64(buckets)) << np.uint64(32)) | (self.key >> np.uint64(32))
        codes, at = np.unique(code, return_inverse=True)
        low, high = np.full(len(codes), len(self.doc) + 1, np.int64), np.full(len(codes), -1, np.int64)
        np.minimum.at(low, at, self.doc)
        np.maximum.at(high, at, self.doc)
        return codes, at, high > low


def _split(sorted_buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(sorted_buckets):
        return sorted_buckets, np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
    return sorted_buckets[cut], cut, np.append(cut[1:], len(sorted_buckets))


class Shared:
    """The regions of a chunk whose fingerprint other texts have too, equal ones once, by bucket or part."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, buf: np.ndarray, flags: dict[int, tuple[bytes, bytes]], buckets: int, s: SpanSettings):
        r = Regions(buf, off, s)
        codes, at, local = r.codes(buckets)
        seen, parts = local, np.zeros(len(codes), np.int64)
        for b, lo, hi in zip(*_split(codes >> np.uint64(32)), strict=True):
            if int(b) in flags:
                bits, hot = flags[int(b)]
                seen[lo:hi] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
                places, n = np.frombuffer(hot, np.uint32).reshape(-1, 2).T
                parts[lo + places] = n
        pick = np.flatnonzero(seen[at])
        self.first, self.last, self.doc, key = r.first[pick], r.last[pick], r.doc[pick], r.key[pick]
        full, bucket, into = r.full[pick], (key % np.uint64(buckets)).astype(np.int64), parts[at[pick]]
        if into.any():
            key, full, bucket = self._spread(buf, key, full, bucket, into, s)
        owner = ids[self.doc] if len(key) else np.empty(0, np.int64)
        same = classes_of(buf, self.first, self.last + s.span, full, ROOM)
        order = np.lexsort((owner, same, key, bucket))
        k, f = key[order], same[order]
        head = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])]) if len(order) else np.empty(0, bool)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(head) - 1
        lead = order[head]
        self.lead, self.key, self.owner, self.bucket, self.occurs = lead, key[lead], owner[lead], bucket[lead], owner

    def _spread(self, buf: np.ndarray, key: np.ndarray, full: np.ndarray, bucket: np.ndarray, into: np.ndarray, s: SpanSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Regions of hot fingerprints become their windows, each in the part that its own hash names."""
        count = np.where(into > 0, self.last - self.first + 1, 1)
        region = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
        hot = into[region] > 0
        first, key, full, bucket = self.first[region] + step, key[region], full[region], bucket[region]
        self.last, self.doc, self.first = np.where(hot, first, self.last[region]), self.doc[region], first
        at = np.flatnonzero(hot)
        full[at] = span_hashes(buf, first[at], first[at] + s.span)
        bucket[at] |= (1 + (full[at] % into[region][at].astype(np.uint64)).astype(np.int64)) << PART
        return key, full, bucket


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    ids, off, data = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((1, np.int64), (2, np.int64), (3, np.uint8)))
    return batch.column(0)[i].as_py(), ids, off, data


def _gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the ranges first[k] .. first[k] + size[k], one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _bytes_of(buf: np.ndarray, first: np.ndarray, size: np.ndarray, room: int = ROOM) -> np.ndarray:
    """buf[_gather(first, size)], some positions at a time, as one takes eight times the room of its byte."""
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(total[-1]), buf.dtype)
    for a, b in _pieces(total, room):
        out[total[a] : total[b]] = buf[_gather(first[a:b], size[a:b])]
    return out


def _pieces(total: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes, with the running sums `total` from 0 on, fit `room` together; a larger one is alone."""
    a = 0
    while a < len(total) - 1:
        b = max(a + 1, int(np.searchsorted(total, total[a] + room, "right")) - 1)
        yield a, b
        a = b


# --- bucket side ------------------------------------------------------------------


def _named(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each value among the different ones, and how many there are."""
    order = np.argsort(x)
    ranks = np.zeros(len(x), np.int32)
    np.cumsum(x[order[1:]] != x[order[:-1]], out=ranks[1:], dtype=np.int32)
    names = np.empty(len(x), np.int32)
    names[order] = ranks
    return names, int(ranks[-1]) + 1 if len(x) else 0


def cover_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix of s (non-negative), right as far as the first `depth` symbols decide.

    Difference cover {1, 2} modulo 3. The last `depth` + 3 symbols should be zeros. What a level does
    not need while the next one is sorted is made again after it, and numbers are no wider than they must be.
    """
    n = len(s)
    s = np.concatenate([s, np.zeros(3, s.dtype)])
    wide = int(s.max()) + 1
    kind = np.int32 if wide**3 < 1 << 31 else np.int64

    def pairs() -> np.ndarray:
        pair = s[:-1].astype(kind) * kind(wide) + s[1:]
        return _named(pair)[0].astype(np.int64) if wide**3 >= 1 << 62 else pair

    pair = pairs()
    name, names = _named(np.concatenate([pair[k:n:3] * kind(wide) + s[k + 2 : n + 2 : 3] for k in (1, 2)]))
    del pair
    ones, sampled = len(range(1, n, 3)), len(name)
    if depth > 3 and names < sampled:
        name = cover_order(np.concatenate([name + 1, np.zeros(-(-depth // 3) + 3, name.dtype)]), -(-depth // 3))[:sampled]
    rank = np.zeros(n + 3, np.int32)
    rank[1:n:3], rank[2:n:3] = name[:ones] + 1, name[ones:] + 1
    by_name = np.argsort(name, kind="stable").astype(np.int32)
    del name
    by_name = np.where(by_name < ones, 3 * by_name + 1, 3 * (by_name - ones) + 2)
    most, pair = int(rank.max()) + 1, pairs()
    assert (int(pair.max()) + 1) * most < 1 << 63
    near = s[:n:3].astype(np.int64) * most + rank[1 : n + 1 : 3]
    rest = np.argsort(near, kind="stable").astype(np.int32)
    at = by_name[by_name % 3 == 1]
    before = np.searchsorted(s[at].astype(np.int64) * most + rank[at + 1], near[rest])
    at = by_name[by_name % 3 == 2]
    near = pair[:n:3].astype(np.int64) * most + rank[2 : n + 2 : 3]
    before += np.searchsorted(pair[at].astype(np.int64) * most + rank[at + 2], near[rest])
    del pair, near, at, rank
    place = np.arange(len(rest)) + np.maximum.accumulate(before) if len(rest) else rest
    free = np.ones(n, bool)
    free[place] = False
    out = np.empty(n, np.int32)
    out[3 * rest] = place
    out[by_name] = np.flatnonzero(free)
    return out


def window_classes(data: np.ndarray, first: np.ndarray, count: np.ndarray, span: int) -> np.ndarray:
    """Class of every window of regions of data: region k has count[k] windows from first[k] on."""
    size = count + span - 1
    # regions one after the other, with a zero after each
    end = np.cumsum(size + 1)
    start, filled = end - (size + 1), np.ones(int(end[-1]), bool)
    filled[end - 1] = False
    text = np.zeros(len(filled) + span + 3, np.int16)
    text[: len(filled)][filled] = _bytes_of(data, first, size).astype(np.int16) + 1
    del filled
    window = _gather(start, count)
    window = window[np.argsort(cover_order(text, span)[window], kind="stable")]
    raw = np.lib.stride_tricks.sliding_window_view((text - 1).astype(np.uint8), span)
    new = np.ones(len(window), bool)
    for a in range(1, len(window), 20_000):
        b = min(a + 20_000, len(window))
        new[a:b] = (raw[window[a:b]] != raw[window[a - 1 : b - 1]]).any(1)
    back = np.zeros(len(text), np.int32)
    back[window] = np.cumsum(new, dtype=np.int32) - 1
    return back[_gather(start, count)]


def least_owners(data: np.ndarray, first: np.ndarray, count: np.ndarray, key: np.ndarray, owner: np.ndarray, s: SpanSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries (regions with the smallest id that holds each): a distinct region's number for
    each entry, by its bytes, and per distinct region's windows the smallest id, with the windows' bounds."""
    _, lead, number = np.unique(classes_of(data, first, first + count + s.span - 1, room=ROOM), return_index=True, return_inverse=True)
    low = np.full(len(lead), NO_ID, np.int64)
    np.minimum.at(low, number, owner)
    bound = np.concatenate([[0], np.cumsum(count[lead])])
    out = np.repeat(low, count[lead])
    # only regions that share their fingerprint with a different one can share a window with it, and not if both are one window
    keys, group, many = np.unique(key[lead], return_inverse=True, return_counts=True)
    wide = np.bincount(group, weights=count[lead] > 1, minlength=len(keys))
    mixed = np.flatnonzero((many[group] > 1) & (wide[group] > 0))
    mixed = mixed[np.argsort(group[mixed], kind="stable")]
    weight = np.cumsum(count[lead[mixed]] + s.span) if len(mixed) else np.empty(0, int)
    a = 0
    while a < len(mixed):
        b = int(np.searchsorted(weight, (weight[a - 1] if a else 0) + s.sort_bytes, "right"))
        b = max(b, a + 1)
        while b < len(mixed) and group[mixed[b]] == group[mixed[b - 1]]:
            b += 1
        part = mixed[a:b]
        c = count[lead[part]]
        classes = window_classes(data, first[lead[part]], c, s.span)
        least = np.full(int(classes.max()) + 1, NO_ID, np.int64)
        np.minimum.at(least, classes, np.repeat(low[part], c))
        out[_gather(bound[part], c)] = least[classes]
        a = b
    return number, bound, out


def judged(data: np.ndarray, count: np.ndarray, key: np.ndarray, owner: np.ndarray, s: SpanSettings) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of each entry a smaller id holds, 0: none, 1: all, 2: those in the mask; data: its regions, one after the other.

    Only entries of one fingerprint have to do with each other, so some fingerprints are judged at a time."""
    size = count + s.span - 1
    first = np.cumsum(size) - size
    state, mask = np.zeros(len(count), np.uint8), np.zeros(len(count), np.uint64)
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(order) else order
    total = np.concatenate([[0], np.cumsum(count[order])])
    edges = np.append(heads, len(order))
    for u, v in _pieces(total[edges], s.part_windows):
        part = np.sort(order[edges[u] : edges[v]])
        c = count[part]
        n = c + s.span - 1
        number, bound, least = least_owners(_bytes_of(data, first[part], n), np.cumsum(n) - n, c, key[part], owner[part], s)
        entry = np.repeat(np.arange(len(c)), c)
        smaller = least[_gather(bound[number], c)] < owner[part][entry]
        hits = np.bincount(entry[smaller], minlength=len(c))
        state[part] = np.where(hits == 0, 0, np.where(hits == c, 1, 2))
        step = (np.arange(len(entry)) - (np.cumsum(c) - c)[entry])[smaller]
        bits = np.zeros(len(c), np.uint64)
        np.bitwise_or.at(bits, entry[smaller], np.uint64(1) << step.astype(np.uint64))
        mask[part] = bits
    return state, mask


# --- plan -------------------------------------------------------------------------


def _by_bucket(rows: DataFrame, answer, schema: str) -> DataFrame:
    """answer(bucket, batches of its rows as Python lists) for each bucket."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(len(names))), strict=True):
                if held and held[0][0] != row[0]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _meet(chunks: DataFrame, notes: DataFrame, limit: int, *more: str) -> DataFrame:
    """notes: chunk, bucket, and binary columns; joined to the chunks as one array of structs."""
    packed = [c for c in notes.columns if c not in ("chunk", "bucket")]
    size = notes.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in packed), F.lit(24)))).first()[0] or 0
    each = notes.groupBy("chunk").agg(F.collect_list(F.struct("bucket", *packed)).alias("notes"))
    if size <= limit:
        each = F.broadcast(each)
    return chunks.join(each, "chunk", "left").select("chunk", "ids", "offs", "data", "notes", *more)


def repeated_spans(docs: DataFrame, s: SpanSettings = SpanSettings(), with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per text; with_text adds what is left.
    keep: further columns to pass through.

    In the remaining text, parts of characters that a cut has split are dropped.
    """
    small_batches(docs.sparkSession)
    chunks = _chunks(docs, s, keep)
    total = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(8, -(-int(total) // s.bucket_bytes))
    small_batches(docs.sparkSession, size=s.batch_bytes)  # from here on a row is a chunk or a message

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, _, off, buf = _unpack(batch, i)
                r = Regions(buf, off, s)
                codes, at, _ = r.codes(buckets)
                b, lo, hi = _split(codes >> np.uint64(32))
                short = (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                many = r.different(at, len(codes))
                told = [(x + np.flatnonzero(many[x:y] >= MANY), x) for x, y in zip(lo, hi, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(b.astype(np.int64)),
                        "chunk": pa.array(np.full(len(b), chunk)),
                        "codes": pa.array([short[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary()),
                        "many": pa.array([np.stack([k - x, many[k]], 1).astype(np.uint32).tobytes() for k, x in told], pa.binary()),
                    }
                )

    def seen_elsewhere(rows: list[tuple]) -> pa.RecordBatch:
        codes = [np.frombuffer(r[2], np.uint32) for r in rows]
        every, chunks_of = np.unique(np.concatenate(codes), return_counts=True)
        different = chunks_of.copy()
        for c, r in zip(codes, rows, strict=True):
            places, n = np.frombuffer(r[3], np.uint32).reshape(-1, 2).T
            np.add.at(different, np.searchsorted(every, c[places]), n.astype(np.int64) - 1)
        parts = np.where(different > s.hot_regions, -(-different * s.hot_parts // s.hot_regions), 0)
        twice, hot = every[chunks_of > 1], every[parts > 0]
        hit = [np.isin(c, twice, assume_unique=True) for c in codes]
        warm = [np.flatnonzero(np.isin(c, hot, assume_unique=True)) if len(hot) else np.empty(0, np.int64) for c in codes]
        some = [k for k, h in enumerate(hit) if h.any() or len(warm[k])]
        spread = [np.stack([warm[k], parts[np.searchsorted(every, codes[k][warm[k]])]], 1).astype(np.uint32).tobytes() for k in some]
        return pa.RecordBatch.from_pydict({"chunk": pa.array([rows[k][1] for k in some], pa.int64()), "bucket": pa.array([rows[k][0] for k in some], pa.int64()), "flags": pa.array([np.packbits(hit[k]).tobytes() for k in some], pa.binary()), "hot": pa.array(spread, pa.binary())})

    sent = chunks.select("chunk", "ids", "offs", "data").mapInArrow(screen, "bucket long, chunk long, codes binary, many binary")
    flags = materialize(_by_bucket(sent, seen_elsewhere, "chunk long, bucket long, flags binary, hot binary"))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, ids, off, buf = _unpack(batch, i)
                got = Shared(ids, off, buf, {x["bucket"]: (x["flags"], x["hot"]) for x in batch.column(4)[i].as_py() or []}, buckets, s)
                if not len(got.lead):
                    continue
                b, lo, hi = _split(got.bucket)
                count = (got.last - got.first + 1)[got.lead]
                size = count + s.span - 1
                end = np.concatenate([[0], np.cumsum(size)])
                for u, v in _pieces(np.append(end[lo], end[-1]), s.send_bytes):
                    x0, cuts = lo[u], list(zip(lo[u:v], hi[u:v], strict=True))
                    data = _bytes_of(buf, got.first[got.lead[x0 : hi[v - 1]]], size[x0 : hi[v - 1]]).tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array(b[u:v].astype(np.int64)),
                            "chunk": pa.array(np.full(v - u, chunk)),
                            "keys": pa.array([got.key[x:y].tobytes() for x, y in cuts], pa.binary()),
                            "owners": pa.array([got.owner[x:y].tobytes() for x, y in cuts], pa.binary()),
                            "counts": pa.array([count[x:y].astype(np.uint8).tobytes() for x, y in cuts], pa.binary()),
                            "data": pa.array([data[end[x] - end[x0] : end[y] - end[x0]] for x, y in cuts], pa.binary()),
                        }
                    )

    def held_by_smaller(rows: list[tuple]) -> pa.RecordBatch:
        key, owner, count = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in ((2, np.uint64), (3, np.int64), (4, np.uint8)))
        data, a = np.empty(sum(len(r[5]) for r in rows), np.uint8), 0
        for k, r in enumerate(rows):  # the bytes are not held twice
            data[a : a + len(r[5])] = np.frombuffer(r[5], np.uint8)
            a += len(r[5])
            rows[k] = r[:5]
        state, mask = judged(data, count.astype(np.int64), key, owner, s)
        out = {"chunk": [], "bucket": [], "states": [], "masks": []}
        a = 0
        for r in rows:
            b = a + len(r[4])
            if state[a:b].any():
                part = mask[a:b][state[a:b] == 2]
                for name, value in zip(out, (r[1], r[0], state[a:b].tobytes(), part.tobytes()), strict=True):
                    out[name].append(value)
            a = b
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("chunk", "bucket") else pa.binary()) for k, v in out.items()})

    met = _meet(chunks, flags, s.broadcast_bytes)
    sent = met.mapInArrow(regions, "bucket long, chunk long, keys binary, owners binary, counts binary, data binary")
    masks = materialize(_by_bucket(sent, held_by_smaller, "chunk long, bucket long, states binary, masks binary"))
    both = flags.join(masks, ["chunk", "bucket"], "full")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, off, buf = _unpack(batch, i)
                notes = batch.column(4)[i].as_py() or []
                got = Shared(ids, off, buf, {x["bucket"]: (x["flags"], x["hot"]) for x in notes if x["flags"] is not None}, buckets, s)
                mask = np.zeros(len(got.lead), np.uint64)
                answers = {x["bucket"]: x for x in notes if x["states"] is not None}
                for b, lo, hi in zip(*_split(got.bucket), strict=True):
                    if int(b) in answers:
                        state = np.frombuffer(answers[int(b)]["states"], np.uint8)
                        mask[lo:hi][state == 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
                        mask[lo:hi][state == 2] = np.frombuffer(answers[int(b)]["masks"], np.uint64)
                out = _result(ids, off, buf, got, mask, s, with_text)
                given = pa.ipc.open_stream(batch.column(5)[i].as_buffer()).read_all().combine_chunks().to_batches()
                for name, column in zip(("doc_id", *keep), given[0].columns if given else (), strict=False):
                    out = out.set_column(0, name, column) if name == "doc_id" else out.append_column(name, column)
                yield out

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text + kept
    return _meet(chunks, both, s.broadcast_bytes, "kept").mapInArrow(cut, schema)


def _result(ids: np.ndarray, off: np.ndarray, buf: np.ndarray, got: Shared, mask: np.ndarray, s: SpanSettings, with_text: bool) -> pa.RecordBatch:
    count = got.last - got.first + 1
    # a text here that has a region of a smaller id here loses all of it
    own = np.where(got.occurs > got.owner[got.entry], np.uint64(0xFFFFFFFFFFFFFFFF), mask[got.entry]) if len(count) else np.empty(0, np.uint64)
    some = np.flatnonzero(own)
    count, own = count[some], own[some]
    first = got.first[some]
    cover = np.zeros(len(buf) + s.span + 1, np.int8)
    for x, y in _pieces(np.concatenate([[0], np.cumsum(count)]), s.part_windows):
        c = count[x:y]
        at = _gather(first[x:y], c)
        step = _gather(np.zeros(y - x, np.int64), c)
        at = at[(np.repeat(own[x:y], c) >> step.astype(np.uint64)) & np.uint64(1) == 1]
        cover[at] += 1  # window starts are distinct
        cover[at + s.span] -= 1
    gone = np.cumsum(cover, dtype=np.int16)[: len(buf)] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = off[:-1][off[:-1] < len(buf)]
    begins[heads] = gone[heads]
    doc_of = lambda x: np.bincount(np.searchsorted(off, np.flatnonzero(x), "right") - 1, minlength=len(ids))
    spans = doc_of(begins)
    removed, full = np.zeros(len(ids), np.int64), off[1:] > off[:-1]
    if full.any():
        removed[full] = np.add.reduceat(gone, off[:-1][full], dtype=np.int64)
    raw, left = buf.tobytes(), []
    for d in range(len(ids)):
        a, b = off[d], off[d + 1]
        left.append(raw[a:b] if not removed[d] else buf[a:b][~gone[a:b]].tobytes())
    out = {"doc_id": pa.array(ids), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(removed), "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())}
    if with_text:
        out["text"] = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())
    return pa.RecordBatch.from_pydict(out)
