"""Variable-capacity best-fit packing of texts into training sequences.

Texts longer than the largest permitted length are cut into pieces of it. Pieces are dealt in turn,
whatever their ids, to shards of about `shard_rows`, one to a task, so that no id, null or repeated,
gathers in one of them. A shard has the lengths of the whole table; what packing shards apart costs
is measured in the README. In a shard, pieces go longest first into the open bin
that they leave least room in; if none fits, a bin of the size with the least expected cost per
token is opened; at the end every bin shrinks to the smallest permitted length that holds it.

Cases: null and empty texts have one row of length 0 and no bin; equal lengths are taken in order
of id; repeated rows are packed each; an empty table gives an empty result; a null id is packed
like any other; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackSettings:
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    #: cost of a bin besides its length, in tokens
    bin_cost: int = 8
    #: rows of a shard, about
    shard_rows: int = 32_768


def pack(lengths: np.ndarray, s: PackSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, position in it, and size of the bin of each piece; lengths from 1 to the largest capacity."""
    sizes = sorted(s.capacities)
    order = np.argsort(-lengths, kind="stable")
    ascending = np.sort(lengths)
    upto = np.concatenate([[0], np.cumsum(ascending)])
    left = int(lengths.sum())
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set when a bin has r tokens left
    used: list[int] = []
    bin_of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        n = int(lengths[i])
        above = free >> n
        if above:
            r = n + ((above & -above).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            best = None
            for c in sizes:
                if c >= n:
                    # later pieces are no longer than this one; those that fit the rest may fill it
                    fit = min(left - n, int(upto[bisect.bisect_right(ascending, min(n, c - n))]))
                    cost = (c + s.bin_cost) / (n + min(c - n, fit))
                    if best is None or cost < best[0]:
                        best = (cost, c)
            b, r = len(used), best[1]
            used.append(0)
        bin_of[i], place[i] = b, used[b]
        used[b] += n
        left -= n
        r -= n
        if r:
            room.setdefault(r, []).append(b)
            free |= 1 << r
    fitted = np.array([sizes[bisect.bisect_left(sizes, u)] for u in used], np.int64)
    return bin_of, place, fitted[bin_of] if len(lengths) else bin_of


SCHEMA = "doc_id long, piece long, start long, length long, bin_id string, position long, capacity long"


def pack_documents(lengths: DataFrame, s: PackSettings = PackSettings()) -> DataFrame:
    """lengths: doc_id, n_tokens. One row per piece: where it starts in the text and in its bin."""
    most = max(s.capacities)
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    pieces = lengths.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(n / most) - 1).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("length"))
    rows = lengths.agg(F.sum(F.greatest(F.lit(1), F.ceil(n / most)))).first()[0] or 0
    shards = max(1, -(-int(rows) // s.shard_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        pdf = pd.concat(held).sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        got = np.flatnonzero(pdf["length"].to_numpy() > 0)
        bins, place, capacity = pack(pdf["length"].to_numpy()[got], s)
        name = np.full(len(pdf), None, object)
        name[got] = [f"{TaskContext.get().partitionId()}-{b}" for b in bins]
        position, size = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        position[got], size[got] = place, capacity
        yield pdf.assign(bin_id=name, position=position, capacity=size)[["doc_id", "piece", "start", "length", "bin_id", "position", "capacity"]]

    # dealt in turn after a sort by the rows' hashes, which a lost task repeats
    return pieces.repartition(shards).mapInPandas(run, SCHEMA)
