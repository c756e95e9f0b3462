"""Greedy batches of ranked documents, exact and without a single sequential pass.

A batch holds at most `most` documents, so from any start the next one is decided by the rows just
ahead. Ranked rows are cut into blocks; each block tells, for every row a batch may enter it at, where
the last of its batches leaves it and how many it holds. Folding these few numbers over the blocks
gives every block's entry, and the blocks are then numbered apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 100_000


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the dense rank from 0 in a total order, by a range sort and the sizes of its partitions."""
    placed = df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = placed.withColumn("__p", F.shiftright("__m", 33)).persist()
    sizes = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}
    start, starts = 0, {}
    for p in sorted(sizes):
        starts[p], start = start, start + sizes[p]
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__m", "__p")
    base = F.create_map(*(F.lit(x).cast("long") for p in starts.items() for x in p))[F.col("__p").cast("long")]
    return placed.withColumn(name, base + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p")


def _next(size: np.ndarray, most: int, room: int) -> np.ndarray:
    """From each row, the row that the next batch starts at."""
    total = np.concatenate([[0], np.cumsum(size)])
    fit = np.searchsorted(total, total[:-1] + room, "right") - 1
    return np.minimum(np.maximum(fit, np.arange(len(size)) + 1), np.arange(len(size)) + most)


def greedy_batches(documents: DataFrame, key: str, size: str, order: list[Column], most: int = 8, room: int = 80_000, block: int = BLOCK, rank: str | None = None) -> DataFrame:
    """key, size, batch (from 0) in the given total order; batch is null for documents over `room`.

    rank: a name for the column of the document's place in the order, if it is wanted.
    """
    fits = F.col(size) <= room
    rows = ranked(documents.where(fits), order, "__i").select(key, size, "__i", F.floor(F.col("__i") / block).alias("__b"))
    # a block sees the rows just past its end, which may close its last batch
    spill = rows.where(F.col("__i") % block < most).withColumn("__b", F.col("__b") - 1).where("__b >= 0")
    wide = rows.unionByName(spill)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        first = int(pdf["__b"].iat[0]) * block
        own = int(((pdf["__i"] - first) < block).sum())
        nxt = _next(pdf[size].to_numpy(np.int64), most, room)
        end, count = np.arange(own + most) - own, np.zeros(own + most, np.int64)
        for i in range(own - 1, -1, -1):
            end[i], count[i] = end[nxt[i]], count[nxt[i]] + 1
        n = min(most, own)
        return pd.DataFrame({"b": int(pdf["__b"].iat[0]), "entry": np.arange(n), "leave": end[:n], "count": count[:n]})

    # `most` rows a block; a single block is entered at its first row, so that nothing has to be told
    alone = rows.select("__b").where("__b > 0").limit(1).count() == 0
    told = [] if alone else wide.groupBy("__b").applyInPandas(exits, "b long, entry long, leave long, count long").collect()
    table = {(r["b"], r["entry"]): (r["leave"], r["count"]) for r in told}
    entry, number, begun = 0, 0, {0: (0, 0)}
    for b in range(max((r["b"] for r in told), default=-1) + 1):
        begun[b] = (entry, number)
        entry, count = table.get((b, entry), (entry, 0))
        number += count

    place = {rank: "long"} if rank else {}

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        b = int(pdf["__b"].iat[0])
        at, n = begun[b]
        nxt = _next(pdf[size].to_numpy(np.int64), most, room)
        starts = np.zeros(len(pdf), np.int64)
        own = ((pdf["__i"] - b * block) < block).to_numpy()
        while at < int(own.sum()):
            starts[at] = 1
            at = int(nxt[at])
        out = pdf.assign(batch=n - 1 + np.cumsum(starts))
        return out[own].rename(columns={"__i": rank or "__i"})[[key, size, "batch", *place]]

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    # rows before a block's entry belong to the block before: its last batch's number is n - 1
    schema = {key: kinds[key], size: kinds[size], "batch": "long"} | place
    numbered = wide.groupBy("__b").applyInPandas(assign, ", ".join(f"{n} {t}" for n, t in schema.items()))
    over = documents.where(~fits | F.col(size).isNull()).select(key, size, *(F.lit(None).cast("long").alias(n) for n in ("batch", *place)))
    return numbered.unionByName(over)


def batch_identity(members: DataFrame, batch: str, order: str, payload: Column, version: str = "message-extraction-v1") -> DataFrame:
    """batch_id (number and start of the input's hash) and input_sha256 of each batch."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), payload.alias("p")))), lambda x: x["p"]), ",")
    out = members.groupBy(batch).agg(F.sha2(F.concat(F.lit(f'{{"prompt_version":"{version}","threads":['), joined, F.lit("]}")).cast("binary"), 256).alias("input_sha256"))
    return out.withColumn("batch_id", F.concat(F.lpad((F.col(batch) + 1).cast("string"), 5, "0"), F.lit("-"), F.substring("input_sha256", 1, 12)))
