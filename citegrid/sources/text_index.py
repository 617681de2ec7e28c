"""An index of trigrams that tells which files of a table can hold a text (SL8, SL13, P4, P5, P17).

A posting is a trigram and a file. A search looks up the trigrams of the text, reads the files that have all of them, and
applies the exact test there, so it gives the rows of a scan. Postings lie in buckets of their trigram's hash and are sorted, so
a lookup reads a few row groups. Files don't change once written: an update adds the files that came since, and files that
are gone are passed over. A batch of an incremental load is one update.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators import tables

BUCKETS = 64
FILES = "file string"
POSTINGS = "gram string, file string, bucket int"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _listed(spark: SparkSession, table: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(table)
    return files.filter(F.col("path").endswith(".parquet")).select("path", F.col("_metadata.file_path").alias("file"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def update(spark: SparkSession, table: str, index: str, columns: Sequence[str]) -> int:
    """Indexes the Parquet files of ``table`` that are new; tells how many. Postings come before the list of files: what a
    failed update left is indexed again, and repeated postings do no harm."""
    files = _listed(spark, table)
    if _there(spark, f"{index}/files"):
        files = files.join(spark.read.schema(FILES).parquet(f"{index}/files").hint("shuffle_merge"), "file", "left_anti")
    paths = [r["path"] for r in files.select("path").orderBy("path").toLocalIterator()]
    if not paths:
        return 0
    text = F.lower(F.concat_ws("\n", *(F.col(c).cast("string") for c in columns)))
    starts = F.when(F.char_length("text") >= 3, F.sequence(F.lit(1), F.char_length("text") - 2)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(3))))
    rows = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("file"), text.alias("text"))
    found = rows.select("file", F.explode(grams).alias("gram")).distinct().withColumn("bucket", _bucket(F.col("gram")))
    found.repartition("bucket", F.pmod(F.xxhash64("file"), F.lit(8))).sortWithinPartitions("bucket", "gram").select("gram", "file", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{index}/postings")
    spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("file")).distinct().unionByName(files.select("file")).distinct().write.mode("append").parquet(f"{index}/files")
    return len(paths)


def trigrams(spark: SparkSession, text: str) -> list[str]:
    """Trigrams that a match must have; those around a wildcard of the pattern need not be."""
    lowered = spark.range(1).select(F.lower(F.lit(text)).alias("t")).first()["t"]
    return sorted({part[i : i + 3] for part in re.split(r"[%_\\]", lowered) for i in range(len(part) - 2)})


def candidates(spark: SparkSession, table: str, index: str, text: str) -> DataFrame:
    """(path) of the files of ``table`` that can have rows with the text: all, if it has no trigram, and all that aren't indexed."""
    files, grams = _listed(spark, table), trigrams(spark, text)
    if not grams or not _there(spark, f"{index}/files"):
        return files.select("path")
    buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g")).alias("b")).distinct().collect()]  # trigrams of one text
    postings = spark.read.schema(POSTINGS).parquet(f"{index}/postings") if _there(spark, f"{index}/postings") else spark.createDataFrame([], POSTINGS)
    hit = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).groupBy("file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("file")
    known = spark.read.schema(FILES).parquet(f"{index}/files").distinct().withColumn("_known", F.lit(True))
    told = files.join(known.hint("shuffle_merge"), "file", "left").join(hit.withColumn("_hit", F.lit(True)).hint("shuffle_merge"), "file", "left")
    return told.filter(F.col("_known").isNull() | F.col("_hit")).select("path")


def search(spark: SparkSession, table: str, index: str, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows of ``table`` with the text in one of the columns, as :func:`citegrid.operators.tables.search` finds them."""
    text = text.strip()
    paths = [r["path"] for r in candidates(spark, table, index, text).toLocalIterator()]
    whole = spark.read.parquet(table)
    rows = spark.read.schema(whole.schema).parquet(*paths) if paths else whole.limit(0)
    return rows.filter(tables.search(text, columns, least=1))
