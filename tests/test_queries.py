"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from mailloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect()), key=repr)
    place = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_entry_and_names():
    assert set(ORACLES) == set(QUERIES)


def test_exports_do_not_depend_on_how_a_table_is_cut(spark, tmp_path):
    from mailloom.plans.queries import _exports

    spark.read.parquet(f"{SF}/documents.parquet").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/conversations.parquet").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    path = _exports(spark, str(tmp_path))
    for folder, kind in (("mail", "json"), ("table", "csv")):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(f"{path}/{folder}")
        assert files.count() == 1  # all ids are below 200
