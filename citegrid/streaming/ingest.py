"""Streaming ingest (ST1, ST3): new files of a dump are sliced, deduplicated and appended, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "id", files_per_batch: int = 1000) -> StreamingQuery:
    """Works through what the source folder has that was not taken before, then stops; gives the query with its progress.

    The checkpoint remembers the files, so a run after a failure takes up where the last one stopped. A batch has
    a folder of its own, so one that is done twice replaces itself. Files are known by name; where they change, see
    ``partitions``. Keys that earlier batches had are kept in the state store (ST3): it lies on disk, is parted by the
    key's hash, and a batch looks up its own keys only; the target is not read. Of records with one key in a batch any one
    is taken. Records without a key are all kept."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = keep(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)).select(*schema.names)
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\n"), F.uuid()))
    new = rows.withColumn("_key", own).dropDuplicates(["_key"]).drop("_key")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        query = new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    return query


def manifest(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Records of each batch."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(target)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("records"))
