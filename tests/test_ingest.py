"""Incremental scans: what changed is taken again, what didn't isn't opened, and a run may break off anywhere."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citegrid.streaming import ingest, partitions

SCHEMA = StructType().add("id", "string").add("kind", "string").add("n", "long")


class Dump:
    """A folder of JSON lines, its chunks and its log."""

    def __init__(self, spark, root):
        self.spark, self.source, self.target, self.state = spark, root / "in put", root / "chunks", root / "log"
        self.source.mkdir()

    def put(self, name, *rows, stamp=None):
        path = self.source / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join((r if isinstance(r, str) else json.dumps(dict(zip(("id", "kind", "n"), r, strict=True)))) + "\n" for r in rows))
        if stamp:
            os.utime(path, ns=stamp)
        return path

    def sync(self, **options):
        return partitions.sync(self.spark, str(self.source), SCHEMA, str(self.target), str(self.state), keep=lambda df: df.filter("kind != 'no'"), **options)

    def rows(self):
        return sorted((r.id, r.n) for r in partitions.records(self.spark, str(self.target), str(self.state), SCHEMA).collect())

    def log(self):
        return {r.source.rsplit("/", 1)[1]: r for r in partitions.log(self.spark, str(self.state)).collect()}


@pytest.fixture
def dump(spark, tmp_path):
    d = Dump(spark, tmp_path)
    d.put("d=1/a.json", ("1", "x", 1), ("2", "no", 2), ("3", "x", 3))
    d.put("d=1/b c.json", ("3", "x", 30), ("4", "x", 4), "")
    d.put("d=2/none.json", ("9", "no", 9))
    return d


def test_changed_gone_and_new_files(dump):
    assert dump.sync() == {"keep": 0, "scan": 3, "gone": 0}
    assert dump.rows() == [("1", 1), ("3", 3), ("3", 30), ("4", 4)]
    logged = dump.log()
    assert {k: (r.records, r.scanned, r.errors, r.status) for k, r in logged.items()} == {"a.json": (2, 3, 0, "ok"), "b%20c.json": (2, 2, 0, "ok"), "none.json": (0, 1, 0, "ok")}
    assert dump.sync() == {"keep": 3, "scan": 0, "gone": 0}
    dump.put("d=1/a.json", ("1", "x", 100))
    (dump.source / "d=1/b c.json").unlink()
    dump.put("d=3/e.json", ("5", "x", 5), ("4", "x", 40))
    assert dump.sync() == {"keep": 1, "scan": 2, "gone": 1}
    assert dump.rows() == [("1", 100), ("4", 40), ("5", 5)]
    assert dump.sync() == {"keep": 2 + 1, "scan": 0, "gone": 0}
    dump.put("d=1/b c.json", ("3", "x", 31))  # comes back
    assert dump.sync() == {"keep": 3, "scan": 1, "gone": 0}
    assert dump.rows() == [("1", 100), ("3", 31), ("4", 40), ("5", 5)]
    assert len([p for p in dump.target.iterdir() if p.name.startswith("chunk=")]) == 3  # old chunks are deleted


def test_unchanged_files_are_not_opened(dump):
    dump.sync()
    before = (dump.source / "d=1/a.json").stat()
    dump.put("d=1/a.json", ("7", "x", 1), ("2", "no", 2), ("3", "x", 3), stamp=(before.st_atime_ns, before.st_mtime_ns))  # size and time as before
    assert dump.sync(verify=True) == {"keep": 3, "scan": 0, "gone": 0}
    assert ("1", 1) in dump.rows()
    os.utime(dump.source / "d=1/a.json", ns=(before.st_atime_ns, before.st_mtime_ns + 10**9))
    assert dump.sync() == {"keep": 2, "scan": 1, "gone": 0}
    assert ("7", 1) in dump.rows() and ("1", 1) not in dump.rows()


def test_break_between_chunk_and_log(dump, monkeypatch):
    append, steps = partitions._append, []

    def breaks(rows, state):
        steps.append(1)
        if len(steps) == 2:
            raise RuntimeError("broken off")
        append(rows, state)

    monkeypatch.setattr(partitions, "_append", breaks)
    with pytest.raises(RuntimeError):
        dump.sync(files_per_commit=1)
    assert dump.rows() == [("1", 1), ("3", 3)]  # the second chunk is there, but not in the log
    monkeypatch.undo()
    assert dump.sync(files_per_commit=1) == {"keep": 1, "scan": 2, "gone": 0}
    assert dump.rows() == [("1", 1), ("3", 3), ("3", 30), ("4", 4)]


@pytest.mark.parametrize("how", ["bytes", "cut", "rows", "folder"])
def test_damaged_chunks(dump, spark, how):
    dump.sync()
    chunk = dump.log()["a.json"].chunk
    folder = dump.target / f"chunk={chunk}"
    file = next(folder.glob("part-*.parquet"))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    if how == "bytes":
        file.write_bytes(b"\0" * file.stat().st_size)
    elif how == "cut":
        file.write_bytes(file.read_bytes()[:-30])
    elif how == "rows":
        spark.createDataFrame([("1", "x", 1), ("3", "x", 4)], SCHEMA).write.mode("overwrite").parquet(str(folder))
    else:
        for f in folder.iterdir():
            f.unlink()
        folder.rmdir()
    if how != "folder":
        assert dump.sync()["scan"] == 0  # a quick run looks for the chunk only
    assert dump.sync(verify=how != "folder") == {"keep": 2, "scan": 1, "gone": 0}
    assert dump.rows() == [("1", 1), ("3", 3), ("3", 30), ("4", 4)]
    assert dump.sync(verify=True)["scan"] == 0


def test_damaged_lines(dump):
    dump.put("d=2/bad.json", ("6", "x", 6), '{"id": "7", ', "[1]", ("8", "x", 8))
    assert dump.sync() == {"keep": 0, "scan": 4, "gone": 0}
    r = dump.log()["bad.json"]
    assert (r.status, r.records, r.scanned, r.errors) == ("failed", 2, 4, 2)
    assert ("8", 8) in dump.rows()
    assert dump.sync() == {"keep": 3, "scan": 1, "gone": 0}
    dump.put("d=2/bad.json", ("6", "x", 6))
    dump.sync()
    assert dump.log()["bad.json"].status == "ok" and ("8", 8) not in dump.rows()


def test_nothing_there(spark, tmp_path):
    d = Dump(spark, tmp_path)
    assert d.sync() == {"keep": 0, "scan": 0, "gone": 0}
    assert d.rows() == [] and d.log() == {}
    d.put("a.json", ("1", "no", 1))
    assert d.sync(verify=True) == {"keep": 0, "scan": 1, "gone": 0}
    assert d.sync() == {"keep": 1, "scan": 0, "gone": 0} and d.rows() == []


def test_first_of_each(spark):
    rows = spark.createDataFrame([("1", 5, "b"), ("1", 4, "a"), ("2", 7, "b"), (None, 1, "a"), (None, 1, "a")], "id string, n long, source string")
    for df in (rows, rows.orderBy(F.desc("n"))):
        assert sorted(((r.id or "", r.n) for r in partitions.first_of_each(df, "id").collect())) == [("", 1), ("", 1), ("1", 4), ("2", 7)]


def test_keys_over_batches(spark, tmp_path):
    """A second delivery looks up its own keys only; one that breaks off after its rows are written is done again."""
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make = lambda low, high: spark.range(low, high).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("kind"), F.col("id").alias("n"))
    make(0, 1000).unionByName(make(0, 10)).unionByName(spark.createDataFrame([(None, "x", 1), (None, "x", 1)], SCHEMA)).write.json(source)
    ingest.ingest(spark, source, SCHEMA, target, state)
    read = lambda: spark.read.schema(StructType([*SCHEMA.fields]).add("batch", "long")).parquet(target)
    assert (read().count(), read().filter("id is null").count()) == (1002, 2)
    make(990, 1020).coalesce(1).write.mode("append").json(source)

    def broken(df):
        return df.withColumn("n", F.when(F.col("n") == 1015, F.raise_error(F.lit("broken off"))).otherwise(F.col("n")))

    with pytest.raises(Exception, match="broken off"):
        ingest.ingest(spark, source, SCHEMA, target, state, keep=broken)
    query = ingest.ingest(spark, source, SCHEMA, target, state)
    rows = [r for r in read().collect() if r.id is not None]
    assert sorted(int(r.id) for r in rows) == list(range(1020))
    last = [p for p in query.recentProgress if p["numInputRows"]][-1]
    assert last["numInputRows"] == 30  # the target's 1,000 rows are not read
    assert last["stateOperators"][0]["numRowsTotal"] == 1022 and last["stateOperators"][0]["numRowsUpdated"] == 20
    assert ingest.manifest(spark, target, SCHEMA).agg(F.sum("records")).first()[0] == 1022
