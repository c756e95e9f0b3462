"""Which of a bounded set of quotes lie in each text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None


def search(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """texts: doc_id, body. quotes: item_id, quote; the caller has checked that they are few.

    One pass over each text finds all quotes; without the library, each quote is looked for apart.
    """
    if ahocorasick is None:
        return texts.join(F.broadcast(quotes), F.col("body").contains(F.col("quote"))).select("doc_id", "item_id")
    by_text: dict[str, list[int]] = defaultdict(list)
    for r in quotes.collect():
        by_text[r["quote"]].append(r["item_id"])
    shared = texts.sparkSession.sparkContext.broadcast(dict(by_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for quote, ids in shared.value.items():
            automaton.add_word(quote, ids)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            docs, items = [], []
            if shared.value:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = {i for _, ids in automaton.iter(body) for i in ids}
                    docs += [doc] * len(found)
                    items += found
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "item_id": pa.array(items, pa.int64())})

    return texts.select("doc_id", "body").mapInArrow(run, "doc_id long, item_id long")
