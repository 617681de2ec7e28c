"""Scans, sinks, manifests (IO1-IO14)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType
from pyspark.sql.window import Window

from citegrid.sources.scratch import ship

#: Files up to this size are hashed as one cell, larger ones as a stream, in slices.
CELL_BYTES = 1 << 26
SLICE_BYTES = 1 << 23


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """JSON lines, plain or gzipped; blank lines are no rows (IO1). Gzip files can't be split: deal their rows out."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(partitions) if partitions else rows


def read_tolerant(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines with ``error`` true for lines that are no JSON object (IO2), and their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_none"})
    whole = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    return lines.select("file", F.col("value").alias("line"), F.when(whole, parsed).alias("record"), (~whole).alias("error"))


def parse_errors(tolerant: DataFrame, most: int = 20) -> DataFrame:
    """For each file: records, errors, and the first ``most`` damaged lines by text (IO2)."""
    counts = tolerant.groupBy("file").agg(F.count_if(~F.col("error")).alias("records"), F.count_if("error").alias("errors"))
    first = tolerant.filter("error").withColumn("_rn", F.row_number().over(Window.partitionBy("file").orderBy("line"))).filter(F.col("_rn") <= most)
    shown = first.groupBy("file").agg(F.array_sort(F.collect_list("line")).alias("examples"))
    return counts.join(shown, "file", "left")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, and line breaks in quotes (IO4)."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table by its path without an ending: Parquet if it is there, else CSV (IO5)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.parquet")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(f"{path}.parquet")
    return read_csv(spark, f"{path}.csv", schema)


def number_text(c: Column, digits: int = 10) -> Column:
    """A number with so many significant digits, without trailing zeros, and with an exponent where it is below
    1e-4 or has more digits before the point (IO7)."""
    size = F.abs(c)
    e = F.floor(F.log10(size))
    scaled = F.round(size * F.pow(F.lit(10.0), digits - 1 - e))
    over = scaled >= 10.0**digits
    e, scaled = e + F.when(over, 1).otherwise(0), F.when(over, scaled / 10).otherwise(scaled)
    ds = F.lpad(scaled.cast("decimal(20,0)").cast("string"), digits, "0")
    point = F.when(e >= 0, F.concat(F.substring(ds, F.lit(1), (e + 1).cast("int")), F.lit("."), F.substring(ds, (e + 2).cast("int"), F.lit(digits)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), (-e - 1).cast("int")), ds))
    short = lambda t: F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))
    power = F.concat(short(F.concat(F.substring(ds, F.lit(1), F.lit(1)), F.lit("."), F.substring(ds, F.lit(2), F.lit(digits)))), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    text = F.when((e >= -4) & (e < digits), short(point)).otherwise(power)
    odd = F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(c == 0, "0")
    return F.when(c.isNotNull(), F.coalesce(odd, F.concat(F.when(c < 0, "-").otherwise(""), text)))


def sorted_keys(c: Column, kind: DataType) -> Column:
    """A nested value with the fields of its structs and the keys of its maps in order."""
    if isinstance(kind, StructType):
        inner = F.struct(*(sorted_keys(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(c, lambda _, v: sorted_keys(v, kind.valueType)))))
    return c


def csv_columns(df: DataFrame) -> list[Column]:
    """Columns as CSV holds them (IO7): truth values in lower case, floats with ten digits, nested values as JSON
    with sorted keys."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        nested = isinstance(f.dataType, (StructType, ArrayType, MapType))
        out.append((F.to_json(sorted_keys(c, f.dataType)) if nested else number_text(c) if isinstance(f.dataType, (FloatType, DoubleType)) else c.cast("string")).alias(f.name))
    return out


def write_both(df: DataFrame, path: str) -> DataFrame:
    """Parquet, and from it CSV (IO6): the query runs once. Gives the table as read back."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    back = df.sparkSession.read.schema(df.schema).parquet(f"{path}.parquet")
    write_csv(back, f"{path}.csv")
    return back


#: Quotes are doubled, null and empty texts are empty fields, blanks stay.
CSV = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """An export, sorted if asked (IO8); null is an empty field."""
    rows = df.select(*csv_columns(df)) if not order else df.orderBy(*order).select(*csv_columns(df))
    rows.write.mode("overwrite").options(header=True, **CSV).csv(path)


def export_sorted(df: DataFrame, path: str, order: Sequence[Column | str], rows_per_part: int = 1_000_000) -> DataFrame:
    """A sorted export in parts that are one CSV file if put together in their order (IO8): part -1 has the header. Gives the
    manifest: part, file, rows, bytes, and the ``offset`` of its first byte in the whole.

    ``order`` should leave no ties. Parts are ranges, so no task sorts more than one; a record with line breaks is in
    one part."""
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows_per_part))
    sorted_ = df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
    lines = sorted_.select(F.to_csv(F.struct(*csv_columns(df)), CSV).alias("value"), "part")
    lines.write.partitionBy("part").text(path)
    header = spark.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(c) for c in df.columns)), CSV).alias("value"), F.lit(-1).alias("part"))
    header.write.mode("append").partitionBy("part").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.regexp_extract("path", "part=(-?[0-9]+)/", 1).cast("int").alias("part"), F.col("path").alias("file"), F.col("length").alias("bytes"))
    text = ", ".join(f"c{i} string" for i in range(max(1, len(df.columns))))
    counted = spark.read.schema(f"{text}, part int").options(multiLine=True, **CSV).csv(path).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    told = files.join(counted.hint("shuffle_merge"), "part", "left")
    return told.select("part", "file", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))


def register(tables: dict[str, DataFrame]) -> None:
    """Named views (IO9)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table (IO10)."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def _opened(path: str) -> pa.NativeFile:
    """A file as a stream, from what Spark calls it (``file:/a/b``, ``hdfs://host/a/b``, ``s3a://bucket/a/b``)."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    host, _, inside = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme.removesuffix('a') if scheme == 's3a' else scheme}://{host}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{inside}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while data := stream.read(SLICE_BYTES):
                    digest.update(data)
            told.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], names=["path", "length", "sha256"])


def file_checksums(spark: SparkSession, path: str, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """SHA-256 and size of each file (IO11). Files of at most ``cell_bytes`` come through Spark's reader; a larger one is
    a task of its own, which reads it in slices of ``SLICE_BYTES``, so its size doesn't matter."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= cell_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > cell_bytes).select("path", "length").mapInArrow(_digests, "path string, length long, sha256 string")
    return small.unionByName(large).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256")


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a sum of row hashes: the same for any order and partitioning (IO11)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)))), 1, 15), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"))


def manifest_partitions(manifest: DataFrame) -> DataFrame:
    """Entries, records and bytes of each ``updated_date=`` partition (IO12); manifest: url, records, bytes."""
    part = F.regexp_extract("url", r"updated_date=([^/]+)", 1)
    return manifest.groupBy(part.alias("partition")).agg(F.count(F.lit(1)).alias("entries"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """What is wrong with each entry (IO13): missing, failed, another checksum, or a repeated key; manifest: file,
    key, status, sha256; files: file, sha256."""
    there = files.select(F.col("file").alias("_file"), F.col("sha256").alias("_sha"))
    again = manifest.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("_again"))
    rows = manifest.join(there, F.col("file") == F.col("_file"), "left").join(again, "key", "left")
    codes = F.array_compact(
        F.array(F.when(F.col("_file").isNull(), "missing"), F.when(F.col("status") == "failed", "failed"), F.when(F.col("_sha") != F.col("sha256"), "checksum"), F.when(F.coalesce("_again", F.lit(False)), "repeated_key"))
    )
    return rows.select("file", "key", F.array_join(codes, ",").alias("problems"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Records, errors (told, or one for a failed entry) and bytes (IO14)."""
    errors = F.coalesce(F.nullif("error_count", F.lit(0)), F.when(F.col("status") == "failed", 1), F.lit(0))
    return manifest.agg(F.sum("records").alias("records"), F.sum(errors).alias("errors"), F.sum("bytes").alias("bytes"))
