"""Versions of a table: changes, readers of older versions, writers that die or come too late."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources.versions import VersionConflict, VersionedTable


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def table(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.create(spark.createDataFrame([(i, f"v{i}", i) for i in range(50)] + [(7, "v0", 0)], "id long, v string, bucket_no int"), buckets=16)
    return t


def test_changes_and_older_versions(spark, table):
    base = {(i, f"v{i}", i) for i in range(50)}
    assert rows_of(table.read()) == sorted(base)
    assert table.upsert(spark.createDataFrame([(3, "new", 1), (99, "add", 2), (99, "zzz", 0)], "id long, v string, bucket_no int")) == 1
    one = (base - {(3, "v3", 3)}) | {(3, "new", 1), (99, "zzz", 0)}
    assert rows_of(table.read()) == sorted(one) and rows_of(table.read(0)) == sorted(base)
    assert table.delete(spark.createDataFrame([(0,), (12345,), (None,)], "id long")) == 2
    assert rows_of(table.read()) == sorted(one - {(0, "v0", 0)}) and rows_of(table.read(1)) == sorted(one)
    assert table.manifests()[1]["touched"] <= 2 and table.manifests()[2]["touched"] <= 2
    assert table.upsert(table.read().limit(0)) == 3 and table.manifests()[3]["touched"] == 0


def test_a_writer_that_dies(spark, table, monkeypatch):
    """Before its manifest is written, or with half of it: the version before is read, and the next change goes on from it."""
    before = rows_of(table.read())
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.delete(spark.range(10))
    assert rows_of(table.read()) == before and table.latest() == 0
    fs, p = table._fs("00000009.json")
    out = fs.create(p, False)
    out.write(b'{"version": 9, "fold')
    out.close()
    assert table.latest() == 0 and table.delete(spark.range(10)) == 1 and table.read().count() == 40


def test_two_writers(spark, table):
    table.delete(spark.range(1), onto=0)
    with pytest.raises(VersionConflict):
        table.delete(spark.range(1, 2), onto=0)
    assert table.read().count() == 49


def test_errors(spark, table, tmp_path):
    with pytest.raises(Exception, match="without id"):
        table.upsert(table.read().withColumn("id", F.lit(None).cast("long")))
    with pytest.raises(ValueError):
        table.read(5)
    with pytest.raises(ValueError):
        VersionedTable(spark, f"{tmp_path}/none").read()
