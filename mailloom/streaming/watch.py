"""A file stream that ingests what arrives: every batch goes through the store's merge.

The file source knows a file by path and time; the store skips it if its content is unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mailloom.plans.ingest import ingest
from mailloom.sources.store import Store


def watch(store: Store, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    stream = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,csv,JSON,CSV}").load(folder)

    def batch(files: DataFrame, _: int) -> None:
        paths = [r["path"] for r in files.select("path").collect()]
        if paths:
            ingest(store, paths)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
