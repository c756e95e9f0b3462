"""N-gram Jaccard self-join with Bayesian candidate pruning.

Equal texts form one class at once; the join runs between the classes' smallest ids. A text is
the set of its five-word shingles (of one shingle, if it has fewer words). Steps:

1. MinHash values; candidates share a band of them. Within a bucket of equal bands every member is
   tied to the smallest and the largest member; ties whose values plainly disagree are dropped. The
   components of what is left, small groups of similar texts, hold all candidate pairs.
2. A component of more than `block` texts most of which are unlike its smallest, such as the pages
   of one site, is parted again by its rarest shingles: two sets that reach the threshold share one of the first |x| - ceil(t |x|) + 1
   of each, in any one order. In the order of their number of texts those are the texts' own words,
   not the boilerplate, so what is left together are links and few others; only where more than
   four fifths of a text are boilerplate does that part nothing. No link is lost by it.
3. A group is cut into blocks of `block` texts, and each pair of blocks is one unit of work, so
   a large group is spread over many tasks. Pairs exist only inside a unit, never as rows.
4. Within a unit pairs of too different sizes are dropped, then the MinHash values are compared
   `step` at a time. Under a uniform prior, the agreement so far gives the posterior probability
   that the similarity reaches the threshold; below `tolerance` the pair is dropped. Survivors are
   verified exactly on their shingles.
5. Units return each text's number of links and a spanning forest; the components of the forests
   are the classes.

Cases: null and empty texts, and texts of white space alone, have no shingles and link to nothing
but equal texts; repeated rows share a class; an empty table gives an empty result; equal ids are
one row each with the same result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, mix, release, shingles, small_batches, span_hashes, text_slices
from .components import connected_components

#: so many ids are sent to every executor at most (16 MB); more are joined by a shuffle
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class JoinSettings:
    threshold: float = 0.8
    words: int = 5
    #: MinHash values are bands * rows; two texts at the threshold share no band with probability 1e-7
    bands: int = 40
    rows: int = 5
    #: values compared before a tie within a bucket is kept, and the share that must agree
    tie_values: int = 64
    tie_share: float = 0.5
    step: int = 20
    tolerance: float = 1e-6
    block: int = 128

    @property
    def values(self) -> int:
        return self.bands * self.rows


def _beta_tail(a: int, b: int, x: float) -> float:
    """P(X >= x) of Beta(a, b), integers: a binomial sum."""
    n = a + b - 1
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log1p(-x)) for j in range(a))


def least_agreement(s: JoinSettings) -> list[tuple[int, int]]:
    """(values compared, least agreement that keeps a pair) for each step.

    With a uniform prior the posterior of the similarity after m of n values agree is
    Beta(m + 1, n - m + 1); chance agreement of the 16 bits kept only errs towards keeping.
    """
    out = []
    for n in range(s.step, s.values + 1, s.step):
        m = 0
        while m < n and _beta_tail(m + 1, n - m + 1, s.threshold) < s.tolerance:
            m += 1
        out.append((n, m))
    return out


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle fingerprints of the texts of a slice, and the bounds of each text's."""
    w = Words(buf, off)
    word = span_hashes(buf, w.start, w.end)
    win, at = shingles(word, w.owner, k)
    n = np.diff(w.owner)
    doc = w.doc()[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j, d in enumerate(short):
            for x in word[w.owner[d] : w.owner[d + 1]]:
                whole[j] = whole[j : j + 1] * np.uint64(0x9E3779B97F4A7C15) + x
        win, doc = np.concatenate([win, mix(whole)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        win, doc = win[order], doc[order]
    return win, np.searchsorted(doc, np.arange(len(n) + 1))


class MinHash:
    def __init__(self, s: JoinSettings):
        r = np.random.default_rng(97)
        self.s = s
        self.flip = r.integers(0, 1 << 32, s.values, dtype=np.uint32)
        self.times = r.integers(0, 1 << 31, s.values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.salt = mix(np.arange(s.bands, dtype=np.uint64) + np.uint64(1))

    def values(self, win: np.ndarray) -> np.ndarray:
        h = (win >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.s.values, 0xFFFFFFFF, np.uint32)
        for a in range(0, len(h), 512):
            m = (h[a : a + 512, None] ^ self.flip) * self.times
            np.minimum(out, (m ^ (m >> np.uint32(16))).min(0), out=out)
        return out

    def band_keys(self, v: np.ndarray) -> np.ndarray:
        v = v.reshape(-1, self.s.bands, self.s.rows).astype(np.uint64)
        key = np.broadcast_to(self.salt, v.shape[:2]).copy()
        for j in range(self.s.rows):
            key = mix(key ^ v[:, :, j])
        return key.view(np.int64)

    def short(self, v: np.ndarray) -> np.ndarray:
        return (v & np.uint32(0xFFFF)).astype(np.uint16)


def _sketch(docs: DataFrame, s: JoinSettings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mh = MinHash(s)
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                win, bound = shingle_sets(buf, off, s.words)
                raw, full = buf.tobytes(), np.flatnonzero(np.diff(bound))
                v = np.array([mh.values(win[bound[d] : bound[d + 1]]) for d in full], np.uint32).reshape(len(full), s.values)
                bands, ties = [None] * (b - a), [None] * (b - a)
                for d, k, t in zip(full, mh.band_keys(v), mh.short(v[:, :: max(1, s.values // s.tie_values)][:, : s.tie_values]), strict=True):
                    bands[d], ties[d] = k, t.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "text_key": pa.array([hashlib.md5(raw[off[d] : off[d + 1]]).digest() for d in range(b - a)], pa.binary()),
                        "bands": pa.array(bands, pa.list_(pa.int64())),
                        "tie": pa.array(ties, pa.binary()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text_key binary, bands array<long>, tie binary")


def _ties(reps: DataFrame, s: JoinSettings) -> DataFrame:
    """u, v: ties within buckets whose values agree well enough."""
    band = reps.select(F.col("doc_id").alias("u"), F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo < hi")
    ends = band.join(shared, "band").select("u", F.explode(F.array("lo", "hi")).alias("v")).where("u <> v")
    ends = materialize(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    tie = reps.select("doc_id", "tie")
    pairs = ends.join(tie.withColumnsRenamed({"doc_id": "u", "tie": "tu"}), "u").join(tie.withColumnsRenamed({"doc_id": "v", "tie": "tv"}), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) for c in (2, 3))
            keep = (a == b).sum(1) >= s.tie_share * a.shape[1] if n else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _verify(ids: np.ndarray, side: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], s: JoinSettings, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a unit, as two index arrays. side: 0 or 1; pairs are across sides, or all if there is one."""
    m = len(ids)
    size = np.array([len(x) for x in sets])
    if side.any():
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    else:
        i, j = np.triu_indices(m, 1)
    near = np.minimum(size[i], size[j]) >= s.threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[near], j[near]
    agree, done = np.zeros(len(i), np.int64), 0
    for n, needed in least:
        agree += (sigs[i, done:n] == sigs[j, done:n]).sum(1)
        keep = agree >= needed
        i, j, agree, done = i[keep], j[keep], agree[keep], n
        if not len(i):
            return i, j
    both = _intersections(i, j, sets)
    hit = both >= s.threshold * (size[i] + size[j] - both) - 1e-9
    return i[hit], j[hit]


def _intersections(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the sets' intersections, by products of bounded incidence matrices."""
    if len(i) < 16:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, col, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    row, col = row[count[col] > 1], col[count[col] > 1]
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    # a fixed number of cells at a time, whatever the sets' sizes
    width = max(1, 4_000_000 // len(used))
    starts = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])) if len(col) else np.zeros(0, int)
    rank = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1])])) if len(col) else col
    for a in range(0, len(starts), width):
        lo, hi = starts[a], starts[a + width] if a + width < len(starts) else len(col)
        x = np.zeros((len(used), min(width, len(starts) - a)), np.float32)
        x[row[lo:hi], rank[lo:hi] - a] = 1
        total += x @ x.T
    return total[back[: len(i)], back[len(i) :]].astype(np.int64)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index linked to each, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: shingles that leave a worker at once
_FLAT = 1 << 18


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, doc_id, n, h: a row for each shingle of the rows' root, doc_id, shingles; n is their number."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        n = [len(x) for *_, x in held]
        root, doc, size = (np.repeat(np.array(v, np.int64), n) for v in ([h[0] for h in held], [h[1] for h in held], [h[2] for h in held]))
        return pa.RecordBatch.from_pydict({"root": root, "doc_id": doc, "n": size, "h": np.concatenate([h[3] for h in held])})

    for batch in batches:
        held, room = [], _FLAT
        for root, doc, raw in zip(*(batch.column(c) for c in range(3)), strict=True):
            x = np.frombuffer(raw.as_buffer(), np.int64)
            for a in range(0, len(x), _FLAT):
                held.append((root.as_py(), doc.as_py(), len(x), x[a : a + _FLAT]))
                room -= len(held[-1][3])
                if room <= 0:
                    yield out(held)
                    held, room = [], _FLAT
        if held:
            yield out(held)


def finer_groups(rows: DataFrame, s: JoinSettings) -> DataFrame:
    """rows: root, doc_id, shingles. node, root: groups within the old ones that hold all links.

    A text whose rarest shingles no other text of its group has is in no group.
    """
    flat = rows.select("root", "doc_id", "shingles").mapInArrow(_shingle_rows, "root long, doc_id long, n long, h long")
    # written out, so that the join shuffles anew and a shingle that a whole group has can be split
    often = materialize(flat.groupBy("root", "h").agg(F.count("*").alias("f")).where("f > 1"))
    # those of one text alone come first in the order; only their number matters
    shared = flat.join(often, ["root", "h"]).groupBy("root", "doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("of"))
    first = F.col("n") - F.ceil(F.lit(s.threshold) * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - F.size("of"))
    first = shared.where(first > 0).select("root", "doc_id", F.explode(F.slice("of", F.lit(1), first.cast("int"))).alias("x"))
    first = materialize(first.select("root", "doc_id", F.col("x.h").alias("h")))
    least = materialize(first.groupBy("root", "h").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("w")).where("v < w").select("root", "h", "v"))
    edges = materialize(first.join(least, ["root", "h"]).select(F.col("doc_id").alias("u"), "v").where("u <> v").distinct())
    groups = connected_components(edges)
    for done in (often, first, least, edges):
        release(done)
    return groups


def _loose_groups(wide: DataFrame, s: JoinSettings) -> DataFrame:
    """wide: root, doc_id, sig. root: groups of which most texts fall short of the threshold with the smallest one.

    The others are near copies of one text: their pairs are links, which no order of shingles could spare.
    """
    heads = wide.where("doc_id = root").groupBy("root").agg(F.max("sig").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, s.values) for c in (1, 2))
            near = ((a == b).mean(1) >= s.threshold).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"root": batch.column(0), "near": near})

    near = wide.join(heads, "root").select("root", "sig", "head").mapInArrow(run, "root long, near double")
    return near.groupBy("root").agg(F.avg("near").alias("near")).where("near < 0.5").select("root")


def _units(members: DataFrame, texts: DataFrame, s: JoinSettings) -> DataFrame:
    """members: node, root. u, v, links: per unit, each linked text's smallest partner and its number of links."""

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    known = materialize(members.join(sizes, "root").select(F.col("node").alias("doc_id"), "root", "m"))
    with_text = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(known), "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mh = MinHash(s)
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(3)):
                win, bound = shingle_sets(buf, off, s.words)
                sets = [np.unique(win[bound[d] : bound[d + 1]]) for d in range(b - a)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "root": batch.column(1).slice(a, b - a),
                        "m": batch.column(2).slice(a, b - a),
                        "sig": pa.array([mh.short(mh.values(x)).tobytes() for x in sets], pa.binary()),
                        "shingles": pa.array([x.tobytes() for x in sets], pa.binary()),
                    }
                )

    rows = with_text.select("doc_id", "root", "m", "text").mapInArrow(prepare, "doc_id long, root long, m long, sig binary, shingles binary")
    rows = held_rows = materialize(rows)
    loose = materialize(_loose_groups(rows.where(F.col("m") > s.block), s))
    if loose.limit(1).count():
        loose = few(loose)
        finer = finer_groups(rows.join(loose, "root", "left_semi"), s)
        sizes = finer.groupBy("root").agg(F.count("*").alias("m"))
        finer = materialize(finer.join(sizes, "root").select(F.col("node").alias("doc_id"), "root", "m"))
        parted = rows.join(loose, "root", "left_semi").drop("root", "m").join(few(finer), "doc_id")
        rows = rows.join(loose, "root", "left_anti").unionByName(parted.select(*rows.columns))
    rows = rows.withColumn("nb", F.ceil(F.col("m") / s.block).cast("int"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "doc_id", (F.col("own") > F.col("other")).cast("int").alias("late"), "sig", "shingles")
    least = least_agreement(s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def unit() -> pa.RecordBatch | None:
            rows, two = sorted({r[3]: r for r in held}.values(), key=lambda r: r[3]), held[0][1] != held[0][2]
            if len(rows) < 2:
                return None
            ids = np.array([r[3] for r in rows])
            side = np.array([r[4] if two else 0 for r in rows])
            if two and (side.all() or not side.any()):
                return None
            i, j = _verify(ids, side, np.array([np.frombuffer(r[5], np.uint16) for r in rows]), [np.frombuffer(r[6], np.uint64) for r in rows], s, least)
            if not len(i):
                return None
            links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            at = np.flatnonzero(links)
            return pa.RecordBatch.from_pydict({"u": pa.array(ids[at]), "v": pa.array(ids[_forest(len(ids), i, j)[at]]), "links": pa.array(links[at])})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if held and held[0][:3] != row[:3]:
                    if (out := unit()) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := unit()) is not None:
            yield out

    spread = spread.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    found = materialize(spread.mapInArrow(work, "u long, v long, links long"))
    release(held_rows)
    release(known)
    return found


def jaccard_classes(docs: DataFrame, s: JoinSettings = JoinSettings()) -> DataFrame:
    """doc_id, text_id (smallest id of an equal text), class_id (smallest id reached by links), n_links.

    n_links counts the other texts of similarity `threshold` or more; copies count as one text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sketch = materialize(_sketch(docs, s))
    # written out, so that the joins with it shuffle anew and a text with very many copies can be split
    same = materialize(sketch.groupBy("text_key").agg(F.min("doc_id").alias("text_id")))
    member = sketch.select("doc_id", "text_key").join(same, "text_key").select("doc_id", "text_id")
    reps = sketch.join(same.select(F.col("text_id").alias("doc_id"), "text_key"), ["doc_id", "text_key"], "left_semi").where("bands is not null")
    tied = connected_components(_ties(reps, s))
    found = _units(tied, docs, s)
    roots = connected_components(found)
    links = found.groupBy(F.col("u").alias("text_id")).agg(F.sum("links").alias("n_links"))
    known = materialize(roots.select(F.col("node").alias("text_id"), F.col("root").alias("class_id")).join(links, "text_id", "left"))
    out = member.join(known, "text_id", "left")
    return out.select("doc_id", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
