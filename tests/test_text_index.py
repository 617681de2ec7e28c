"""A search by the index gives the rows of a scan, from fewer files."""

import pytest
from pyspark.sql import functions as F

from citegrid.operators import tables
from citegrid.sources import text_index

COLUMNS = ["title", "source"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("indexed")
    rows = [(i, f"Work {i} {'Needle' if i == 77 else 'straw'}", f"Source {i % 7}", None) for i in range(200)] + [(900, None, "ÉLAN Vital", None), (901, "100% of a_b", None, None), (902, "x", "", None)]
    spark.createDataFrame(rows, "id long, title string, source string, other string").repartitionByRange(10, "id").write.parquet(str(root / "t"))
    return str(root / "t"), str(root / "index")


@pytest.mark.parametrize("text", ["needle", "NEEDLE", "Work 1", "élan v", "Source 3", "nothing like it", "wo", "x", "100%", "a_b", "k_7", "w%k 5", " work 150 "])
def test_rows_of_a_scan(spark, table, text):
    path, index = table
    text_index.update(spark, path, index, COLUMNS)
    whole = spark.read.parquet(path)
    want = whole.filter(tables.search(text, COLUMNS, least=1))
    assert sorted(map(str, text_index.search(spark, path, index, text, COLUMNS).collect())) == sorted(map(str, want.collect()))


def test_fewer_files_and_updates(spark, table):
    path, index = table
    text_index.update(spark, path, index, COLUMNS)
    files = len(spark.read.parquet(path).inputFiles())
    read = text_index.search(spark, path, index, "needle", COLUMNS)
    assert len(read.inputFiles()) == 1 < files
    assert text_index.search(spark, path, index, "no such text", COLUMNS).count() == 0
    assert text_index.update(spark, path, index, COLUMNS) == 0
    more = spark.createDataFrame([(1000, "a second needle", "s", None)], spark.read.parquet(path).schema)
    more.coalesce(1).write.mode("append").parquet(path)
    assert text_index.search(spark, path, index, "needle", COLUMNS).count() == 2  # a file that isn't indexed yet is read
    assert text_index.update(spark, path, index, COLUMNS) >= 1
    found = text_index.search(spark, path, index, "needle", COLUMNS)
    assert sorted(r.id for r in found.collect()) == [77, 1000] and len(found.inputFiles()) == 2
    assert found.filter(F.col("id") > 0).columns == ["id", "title", "source", "other"]
