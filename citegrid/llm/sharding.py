"""Hilbert-curve sharding: rows sorted along a space-filling curve over several metadata dimensions
and cut into runs of near equal bytes, so that each shard covers a small box in every dimension and
readers can skip files by their minima and maxima.

The law is ``bytes``: shards are runs along the curve, cut where the running size passes a multiple of an equal
share. Equal texts stand together on the curve, at the place of the first of them, and share a shard, so a
shard may miss its share by half of such a group at each end. A group of more than ``split_share`` of a shard
would break the law by itself: it is cut row by row. Source and language are binned by rank, each bin with
a like number of rows.

Only DataFrame functions run here. Nulls: a null dimension is the lowest value; a null text has no
bytes and counts 1 (every row does). Repeated rows are rows of their own. An empty table gives no rows. Only
the named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.operators import order

from .common import drop_written, table, written

BITS = 4


def hilbert_index(point: list[int], bits: int) -> int:
    """Place on the Hilbert curve of a cell of a cube with ``2 ** bits`` cells a side."""
    axes, n = list(point), len(point)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            if axes[i] & bit:
                axes[0] ^= low
            else:
                swap = (axes[0] ^ axes[i]) & low
                axes[0] ^= swap
                axes[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flip, bit = 0, 1 << (bits - 1)
    while bit > 1:
        if axes[n - 1] & bit:
            flip ^= bit - 1
        bit >>= 1
    axes = [a ^ flip for a in axes]
    index = 0
    for b in reversed(range(bits)):
        for a in axes:
            index = index * 2 + (a >> b & 1)
    return index


def curve_of(bins: list[Column], bits: int = BITS) -> Column:
    """The curve index of a row's cell: a lookup in a table of ``2 ** (bits * dimensions)`` entries."""
    n, side = len(bins), 1 << bits
    cells = [hilbert_index([cell >> bits * (n - 1 - d) & side - 1 for d in range(n)], bits) for cell in range(side**n)]
    cell = F.lit(0)
    for b in bins:
        cell = cell * side + b.cast("int")
    places = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<int>")  # folded to one constant
    return F.element_at(places, cell + 1)


def ranked(rows: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """(value, bin) for each value of a column: its place in order among ``2 ** bits`` bins of like many rows."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"{name}_value")).agg(F.count(F.lit(1)).alias("times"))
    upto = order.running(counts, [F.asc(f"{name}_value")], [], {"upto": F.col("times")})
    total = counts.agg(F.sum("times").alias("total"))
    place = (2 * F.col("upto") - F.col("times")) * (1 << bits)
    # Written and read back: Spark knows its size and broadcasts it only if it is small.
    return written(upto.crossJoin(F.broadcast(total)).select(f"{name}_value", F.floor(place / (2 * F.col("total"))).cast("int").alias(f"{name}_bin")), f"shard-{name}")  # one row


def scaled(name: str, low: int | None, high: int | None, bits: int = BITS) -> Column:
    """A number's bin among ``2 ** bits`` of equal width between the least and the greatest."""
    if low is None or high == low:
        return F.lit(0)
    step = (high - low) / (1 << bits)
    return F.least(F.lit((1 << bits) - 1), F.floor((F.coalesce(F.col(name), F.lit(low)) - F.lit(low)) / F.lit(step)).cast("int"))


def hilbert_shards(docs: DataFrame, n_shards: int = 8, split_share: float = 0.2, partitions: int | None = None) -> DataFrame:
    """One row for each document: its shard and its place there.

    Dimensions: source, language, log2 of the size, id; each in ``2 ** BITS`` bins.

    Running totals over the whole order need no task that sees all rows: the rows are range
    partitioned along the curve, each partition sums its own, and only one row for each partition
    meets in one place.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.encode(F.col("text"), "UTF-8")
    base = written(
        docs.select(
            "doc_id",
            "source",
            "lang",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
            F.coalesce(F.md5(raw), F.lit("null")).alias("text_key"),
        ),
        "shard-base",
    )
    b = base.agg(
        *(f(c).alias(f"{c}_{n}") for c in ("doc_id",) for n, f in (("low", F.min), ("high", F.max))),
        F.sum("size").alias("total"),
    ).first()
    total, spread = b["total"] or 1, 1 << BITS
    named = base
    for c in ("source", "lang"):
        values = ranked(base, c)
        named = named.join(values, named[c] == values[f"{c}_value"], "left").drop(c, f"{c}_value")
    bins = [F.coalesce(f"{c}_bin", F.lit(0)) for c in ("source", "lang")]
    bins += [F.least(F.lit(spread - 1), F.greatest(F.lit(0), F.floor(F.log2(F.col("size")) - 5).cast("int")))]
    bins += [scaled("doc_id", b["doc_id_low"], b["doc_id_high"])]
    placed = written(named.withColumn("own_curve", curve_of(bins)).drop("source_bin", "lang_bin"), "shard-placed")
    drop_written(base)
    groups = placed.groupBy("text_key").agg(F.min("own_curve").alias("group_curve"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = written(groups, "shard-groups")  # apart from the join, so that Spark can split a text with many rows there
    whole = F.col("group_size") <= F.lit(split_share * total / n_shards)
    ordered = (
        placed.join(groups.hint("shuffle_merge"), "text_key", "left")
        .withColumn("curve", F.coalesce("group_curve", "own_curve"))
        .withColumn("whole", F.coalesce(whole, F.lit(False)))
        .withColumn("cut_id", F.when(~F.col("whole"), F.col("doc_id")))
        .repartitionByRange(partitions, "curve", "text_key", "cut_id")
        .select("doc_id", "size", "text_crc32", "text_key", "curve", "whole", "group_size", F.spark_partition_id().alias("part"))
    )
    ordered = written(ordered, "shard-ordered")
    parts = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")))
    run = Window.partitionBy("part").orderBy("curve", "text_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("part", "curve", "text_key")
    start = F.col("bytes_before") + F.col("done") - F.col("size")
    counted = (
        ordered.repartitionByRange(partitions, "part")
        .withColumn("done", F.sum("size").over(run))
        .withColumn("place", F.row_number().over(run))
        .join(F.broadcast(parts), "part")  # one row for each partition
        .withColumn("start", F.when(F.col("whole"), F.min(start).over(group)).otherwise(start))
        .withColumn("length", F.when(F.col("whole"), F.col("group_size")).otherwise(F.col("size")))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * start + length) * {n_shards}) div (2 * {total})").cast("int")))
        .select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rows_before") + F.col("place") - 1).alias("position"))
    )
    counted = written(counted, "shard-counted")
    for t in (placed, groups, ordered):
        drop_written(t)
    firsts = counted.groupBy("shard").agg(F.min("position").alias("first"))
    return counted.join(F.broadcast(firsts), "shard").select(  # n_shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
