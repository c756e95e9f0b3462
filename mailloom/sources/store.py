"""The store: immutable tables, numbered commits that name the tables in force, and append-only logs.

A commit is one small file that appears by one rename; the highest number is in force, so there is
never a moment without one. A table that a commit does not change is named again, not written again.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators.merge import latest_by_key

from .records import MESSAGE_SCHEMA

SCHEMAS = {
    "messages": MESSAGE_SCHEMA,
    "links": "email_id string, source_file_id long, source_index long",
    "sources": "source_file_id long, path string, sha256 string, kind string, size_bytes long, modified_at timestamp, status string, message_count long, error string, imported_at string",
}
LOGS = {
    "runs": "batch_id string, phase string, status string, thread_ids_json string, input_sha256 string, agent_id string, run_id string, model string, output_json string, error string, duration_ms long, created_at string",
    "analyses": "thread_id string, source_fingerprint string, status string, importance_score int, factual_confidence double, extraction_json string, verification_json string, verified_json string, updated_at string",
}

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def now() -> str:
    return datetime.now(UTC).isoformat()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def init(self) -> Store:
        """Create the store if there is none."""
        if not self.version():
            self.commit(**{n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
        return self

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".commit")) for n in self._names("commits") if n.endswith(".commit"))

    def version(self) -> int:
        """The number of the commit in force; 0 if there is none."""
        return max(self._commits(), default=0)

    def _tables(self, version: int) -> dict[str, str]:
        stream = self._fs.open(self._path(f"{self.root}/commits/{version:010d}.commit"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        if name in LOGS:
            path = f"{self.root}/{name}"
            if not self._fs.exists(self._path(path)):
                return self.spark.createDataFrame([], LOGS[name])
            return self.spark.read.schema(LOGS[name]).parquet(path)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{self._tables(self.version())[name]}")

    def commit(self, **tables: DataFrame) -> None:
        """Write the tables given, keep the others as they are, and put both in force at once."""
        v = self.version()
        named = self._tables(v) if v else {}
        for name, rows in tables.items():
            named[name] = f"data/{name}-{uuid.uuid4().hex}"
            rows.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.parquet(f"{self.root}/{named[name]}")
        fresh, target = self._path(f"{self.root}/commits/{uuid.uuid4().hex}.tmp"), self._path(f"{self.root}/commits/{v + 1:010d}.commit")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(named).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"another writer made commit {v + 1}")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the tables that only commits before the last `keep` name; returns their number."""
        if keep < 1:
            raise ValueError("keep must be at least 1")
        commits = self._commits()
        used = {t for v in commits[-keep:] for t in self._tables(v).values()}
        gone = {t for v in commits[:-keep] for t in self._tables(v).values()} - used
        for v in commits[:-keep]:
            self._fs.delete(self._path(f"{self.root}/commits/{v:010d}.commit"), False)
        for t in gone:
            self.remove(t)
        return len(gone)

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.spark.createDataFrame([], LOGS[name]).columns).write.mode("append").parquet(f"{self.root}/{name}")

    def log(self, name: str, row: tuple) -> None:
        """Append one row without a Spark job: a small file that appears whole, by one rename."""
        columns = [c.split(" ") for c in LOGS[name].split(", ")]
        table = pa.table([pa.array([v], _ARROW[kind]) for v, (_, kind) in zip(row, columns, strict=True)], [n for n, _ in columns])
        sink = pa.BufferOutputStream()
        pq.write_table(table, sink)
        path, part = f"{self.root}/{name}", f"part-{uuid.uuid4().hex}.parquet"
        # names that begin with a dot are passed over by readers
        fresh, target = self._path(f"{path}/.{part}"), self._path(f"{path}/{part}")
        out = self._fs.create(fresh, False)
        try:
            out.write(bytearray(sink.getvalue().to_pybytes()))
        finally:
            out.close()
        if not self._fs.rename(fresh, target):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"the row could not be logged: {target}")

    def analyses(self) -> DataFrame:
        """The latest row of each thread."""
        return latest_by_key(self.table("analyses"), ["thread_id"], [F.col("updated_at")])

    def thread(self, thread_id: str) -> DataFrame:
        t = F.coalesce("sent_at_utc", "received_at_utc", F.lit(""))
        return self.table("messages").where(F.col("conversation_id") == thread_id).orderBy(t, "email_id")
