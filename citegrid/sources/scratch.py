"""Folders for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); a local session whose
    setting is unset gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python need not have it; once for an application."""
    context, package = spark.sparkContext, Path(__file__).parent.parent
    if getattr(context, "_shipped_package", None) is None:
        archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._shipped_package = str(archive)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back. Sums of fractions differ in their last bits when they
    are made twice in another order, so what is joined by value, or read several times, is made once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, tuple[str, StructType]] = {}


def _files(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """Path, size and time of change of each file that a pattern meets, or that lies below a folder that it meets."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system, told = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for found in system.globStatus(path) or []:
        below = system.listFiles(found.getPath(), True)
        while below.hasNext():
            f = below.next()
            told.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return sorted(told)


def kept(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries of an application read, written to the shared folder once. It is made anew if the
    source's tables have changed or the files are gone."""
    key = (spark.sparkContext.applicationId, source, name, *_files(spark, f"{source}/*.parquet"))
    if key not in _KEPT or not _files(spark, f"{_KEPT[key][0]}/_SUCCESS"):
        df, path = make(), folder(spark, name)
        df.write.parquet(path)
        _KEPT[key] = path, df.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)
