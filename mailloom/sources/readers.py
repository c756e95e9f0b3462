"""Discovery and reading of export files; hashing and parsing run on the executors."""

from __future__ import annotations

import csv
import hashlib
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import KINDS, MESSAGE_SCHEMA, kind_of, normalize, parse_file


def discover(spark: SparkSession, paths: list[str]) -> list[str]:
    """JSON and CSV files named or below the folders named, each once, in order of path.

    Lists by the file system's own interface, so any store that Spark reads will do.
    """
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), set()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(p)
        if fs.getFileStatus(path).isFile():
            if not p.lower().endswith(tuple(KINDS)):
                raise FileNotFoundError(f"not a JSON or CSV file: {p}")
            found.add(fs.getFileStatus(path).getPath().toString())
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if name.lower().endswith(tuple(KINDS)):
                found.add(name)
    return sorted(found)


def _set_aside(spark: SparkSession, paths: list[str], aside: str) -> list[tuple[str, str, datetime]]:
    """Copies under plain names of files whose names Spark's readers would pass over."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for k, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs, to = path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{aside}/{k}{path.getName()}")
        time = fs.getFileStatus(path).getModificationTime()
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, to.getFileSystem(conf), to, False, True, conf)
        out.append((to.getFileSystem(conf).makeQualified(to).toString(), p, datetime.fromtimestamp(time / 1000, UTC)))
    return out


def read_files(spark: SparkSession, paths: list[str], aside: str | None = None) -> DataFrame:
    """path, size_bytes, modified_at, content and its sha256 of the files named, wildcards taken literally.

    Names that start with `_` or `.` are hidden from Spark's readers: such files, few as a rule, are
    copied to the folder `aside` first; without one they are refused.
    """
    empty = spark.createDataFrame([], "path string, size_bytes long, modified_at timestamp, content binary, sha256 string")
    hidden = [p for p in paths if p.rsplit("/", 1)[-1].startswith(("_", "."))]
    if hidden and not aside:
        raise ValueError(f"hidden files need a folder to copy them to: {hidden[0]}")
    columns = ["path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content", F.sha2("content", 256).alias("sha256")]
    read = lambda names: spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", n) for n in names]).select(*columns)
    plain = [p for p in paths if p not in set(hidden)]
    out = read(plain) if plain else empty
    if hidden:
        moved = _set_aside(spark, hidden, aside)
        names = spark.createDataFrame(moved, "path string, own string, time timestamp")
        copies = read([m[0] for m in moved]).drop("modified_at").join(names, "path")
        out = out.unionByName(copies.select(F.col("own").alias("path"), "size_bytes", F.col("time").alias("modified_at"), "content", "sha256"))
    return out


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.strip().split(" ") for c in ddl.split(","))])


def normalize_records(records: DataFrame) -> DataFrame:
    """Normalised messages of records given as JSON text in the column `record`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(MESSAGE_SCHEMA)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([normalize(json.loads(r)) for r in batch.column(0).to_pylist()], schema)

    return records.select("record").mapInArrow(run, MESSAGE_SCHEMA)


PARSED = f"path string, source_index long, error string, {MESSAGE_SCHEMA}"


def parse_files(files: DataFrame, strict_csv: bool = False) -> DataFrame:
    """Records of every file; a file that fails has one row with the error and no message.

    A file whose sha256 differs from the one in the column `expected`, if there is one, fails too.
    strict_csv keeps the standard limit of 128 KiB to a CSV field, at which a file fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(131_072 if strict_csv else 1 << 30)
        schema = _schema(PARSED)
        for batch in batches:
            for path, content, expected in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    if expected and hashlib.sha256(content).hexdigest() != expected:
                        raise ValueError("the file changed while it was read")
                    rows = [{"path": path, "source_index": k, "error": None} | normalize(r) for k, r in enumerate(parse_file(kind_of(path), content))]
                    found = pa.RecordBatch.from_pylist(rows, schema)
                except Exception as e:  # one file's failure is a row, whatever its cause
                    found = pa.RecordBatch.from_pylist([{"path": path, "source_index": -1, "error": str(e) or type(e).__name__}], schema)
                yield found

    expected = F.col("expected") if "expected" in files.columns else F.lit(None).cast("string")
    return files.select("path", "content", expected).mapInArrow(run, PARSED)
