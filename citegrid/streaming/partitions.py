"""Incremental scan of a dump's files (ST1) with a commit log, so that a run can break off anywhere (ST2).

Every source file has a chunk in the target: the records of the file that belong to the slice. A file is known by its
path, size and time of change; a chunk is named by these. The log has a row for each chunk, written after the
chunk: a chunk that isn't logged doesn't count and is made again. A file whose row has the same size and time, and whose chunk is
there, is not opened. A changed file gets a chunk of its own, and the log's newest row of a file decides; so readers
switch from the old rows to the new with the log, and rows of files that are gone go with their row. Files are taken
``files_per_commit`` at a time: a failure costs one such step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citegrid.sources import io
from citegrid.sources.scratch import settled

LOG = "source string, fingerprint string, chunk string, status string, records long, scanned long, errors long, rows_hash string, run long"
FILES_PER_COMMIT = 10_000
BROADCAST_ROWS = 1_000_000


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def source_files(spark: SparkSession, source: str) -> DataFrame:
    """(path, source, fingerprint, chunk) of each file below a folder; the files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    stamp = F.concat_ws(":", F.col("_metadata.file_size"), F.unix_micros("_metadata.file_modification_time"))
    named = files.select("path", F.col("_metadata.file_path").alias("source"), stamp.alias("fingerprint"))
    return named.withColumn("chunk", F.md5(F.concat_ws("\n", "source", "fingerprint")))


def log(spark: SparkSession, state: str) -> DataFrame:
    """The newest row of each source file."""
    if not _there(spark, state):
        return spark.createDataFrame([], LOG)
    rows = spark.read.schema(LOG).json(state)
    return rows.groupBy("source").agg(F.max_by(F.struct(*rows.columns), F.struct("run", "chunk")).alias("s")).select("s.*")


def _row_hash(names: list[str]) -> F.Column:
    return F.xxhash64(*(F.to_json(F.struct(F.col(c))) for c in sorted(names))).cast("decimal(38,0)")


def _summary(chunks: DataFrame, names: list[str]) -> DataFrame:
    """Rows and an order-free checksum of each chunk."""
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("records"), F.sum(_row_hash(names)).cast("string").alias("rows_hash"))


def _chunks(spark: SparkSession, target: str, schema: StructType, **options: bool) -> DataFrame:
    whole = StructType([*schema.fields]).add("chunk", "string")
    return spark.read.options(**options).schema(whole).parquet(target) if _there(spark, target) else spark.createDataFrame([], whole)


def damaged(spark: SparkSession, target: str, state: str, schema: StructType, verify: bool = True) -> DataFrame:
    """(chunk) of logged chunks that are not there or, if asked to ``verify``, don't have the rows that were logged; unreadable
    files have none."""
    logged = log(spark, state).filter("status = 'ok'").select("chunk", "records", "rows_hash")
    if verify:
        there = _summary(_chunks(spark, target, schema, ignoreCorruptFiles=True, ignoreMissingFiles=True), schema.names)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target) if _there(spark, target) else spark.createDataFrame([], "path string")
        there = files.select(F.regexp_extract("path", "chunk=([0-9a-f]{32})", 1).alias("chunk")).distinct().withColumns({"records": F.lit(None).cast("long"), "rows_hash": F.lit(None).cast("string")})
    there = there.withColumnsRenamed({"records": "_records", "rows_hash": "_hash"}).withColumn("_there", F.lit(True))
    found = logged.join(there.hint("shuffle_merge"), "chunk", "left")
    right = F.coalesce("_there", F.lit(False))
    if verify:
        right = right & (F.col("records") == F.col("_records")) & (F.col("rows_hash") == F.col("_hash"))
    return found.filter((F.col("records") > 0) & ~F.coalesce(right, F.lit(False))).select("chunk")


def plan(spark: SparkSession, source: str, target: str, state: str, schema: StructType, verify: bool = False) -> DataFrame:
    """(path, source, fingerprint, chunk, action): keep, scan (new, changed, failed, or chunk damaged) or gone."""
    known = log(spark, state).filter("status != 'gone'").select("source", F.col("chunk").alias("_chunk"), F.col("status").alias("_status"))
    bad = damaged(spark, target, state, schema, verify).select(F.col("chunk").alias("_chunk"), F.lit(True).alias("_bad"))
    known = known.join(bad.hint("shuffle_merge"), "_chunk", "left")
    both = source_files(spark, source).join(known.hint("shuffle_merge"), "source", "full_outer")
    same = (F.col("chunk") == F.col("_chunk")) & (F.col("_status") == "ok") & F.col("_bad").isNull()
    action = F.when(F.col("chunk").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "keep").otherwise("scan")
    return both.select("path", "source", "fingerprint", F.coalesce("chunk", "_chunk").alias("chunk"), action.alias("action"))


def _append(rows: DataFrame, state: str) -> None:
    rows.write.mode("append").json(state)


def sync(
    spark: SparkSession, source: str, schema: StructType, target: str, state: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df, verify: bool = False, files_per_commit: int = FILES_PER_COMMIT,
) -> dict[str, int]:
    """Brings the target up to date with the JSON lines below ``source``; how many files were kept, scanned and gone.

    Damaged lines are counted and make a file's status failed; its other records are there, and it is scanned again
    next time. ``keep`` gets the records and gives those that belong to the slice, with the same columns."""
    todo = settled(plan(spark, source, target, state, schema, verify), "sync-plan")
    counts = {"keep": 0, "scan": 0, "gone": 0} | {r["action"]: r["count"] for r in todo.groupBy("action").count().collect()}
    run = (log(spark, state).agg(F.max("run")).first()[0] or 0) + 1
    files = todo.filter("action = 'scan'").orderBy("source").select("path", "source", "fingerprint", "chunk")
    batch: list = []
    for row in files.toLocalIterator():
        batch.append(row)
        if len(batch) == files_per_commit:
            _scan(spark, batch, schema, target, state, keep, run)
            batch, run = [], run + 1
    if batch:
        _scan(spark, batch, schema, target, state, keep, run)
        run += 1
    if counts["gone"]:
        none = F.lit(0).cast("long")
        gone = todo.filter("action = 'gone'").select("source", F.lit("").alias("fingerprint"), "chunk", F.lit("gone").alias("status"), none.alias("records"), none.alias("scanned"), none.alias("errors"), F.lit("").alias("rows_hash"), F.lit(run).cast("long").alias("run"))
        _append(gone, state)
    if counts["scan"] or counts["gone"]:
        _drop_orphans(spark, target, state)
    return counts


def _scan(spark: SparkSession, batch: list, schema: StructType, target: str, state: str, keep: Callable[[DataFrame], DataFrame], run: int) -> None:
    """Chunks of some files, then their rows of the log."""
    of = F.broadcast(spark.createDataFrame([(r["source"], r["fingerprint"], r["chunk"]) for r in batch], "source string, fingerprint string, chunk string"))  # files_per_commit rows
    lines = io.read_tolerant(spark, [r["path"] for r in batch], schema).withColumnRenamed("file", "source").join(of, "source")
    whole = StructType([*schema.fields]).add("chunk", "string")
    rows = keep(lines.filter(~F.col("error")).select("record.*", "chunk")).select(*whole.names)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(target)
    scanned = lines.groupBy("source").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("error").alias("errors"))
    made = _summary(_chunks(spark, target, schema).filter(F.col("chunk").isin([r["chunk"] for r in batch])) if len(batch) <= 1000 else _chunks(spark, target, schema).join(of.select("chunk"), "chunk", "left_semi"), schema.names)
    told = of.join(scanned.hint("shuffle_merge"), "source", "left").join(made.hint("shuffle_merge"), "chunk", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(F.coalesce("errors", F.lit(0)) > 0, "failed").otherwise("ok")
    _append(told.select("source", "fingerprint", "chunk", status.alias("status"), zero("records"), zero("scanned"), zero("errors"), F.coalesce("rows_hash", F.lit("0")).alias("rows_hash"), F.lit(run).cast("long").alias("run")), state)


def _drop_orphans(spark: SparkSession, target: str, state: str) -> None:
    """Deletes chunks that no row of the log names any more; a reader of before may still hold them until then."""
    if not _there(spark, target):
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = spark.createDataFrame([(f.getPath().getName()[6:],) for f in system.listStatus(at) if f.getPath().getName().startswith("chunk=")], "chunk string")
    named = log(spark, state).filter("status != 'gone'").select("chunk")
    for row in folders.join(named.hint("shuffle_merge"), "chunk", "left_anti").toLocalIterator():
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/chunk={row['chunk']}"), True)


def records(spark: SparkSession, target: str, state: str, schema: StructType) -> DataFrame:
    """The records of all logged chunks, with their ``source``."""
    named = log(spark, state).filter("status != 'gone' and records > 0").select("chunk", "source")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named.hint("shuffle_merge")
    return _chunks(spark, target, schema).join(named, "chunk").drop("chunk")


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """A row for each key, that of the first source (ties: any order of the rows gives the same); rows without a key all stay.
    So a key that a changed file gave up is still there if another file has it."""
    told = rows.columns
    order = F.struct("source", _row_hash(told))
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*told), order).alias("s")).select("s.*")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))
