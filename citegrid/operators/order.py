"""Running sums, ranks and quantiles over whole tables, without a task that sorts a whole table or group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.functions.columns import all_of
from citegrid.sources.scratch import settled

#: Sums of ranges are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def running(rows: DataFrame, order: Sequence[Column], group: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with running sums along ``order``, which must leave no ties, in each group.

    Rows are dealt into ranges of group and order; each range is summed for itself, and one row for each range
    and group brings the sums of the ranges before; with very many groups these rows are joined by shuffle."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumns({f"_w_{n}": w.cast("long") for n, w in sums.items()}).repartitionByRange(parts, *map(F.col, group), *order)
    placed = settled(placed.withColumn("_range", F.spark_partition_id()), "ranges")
    whole = placed.groupBy("_range", *group).agg(*(F.sum(f"_w_{n}").alias(f"_s_{n}") for n in sums))
    if group:
        whole = settled(whole, "range-sums")
    # At most a row for each range and each group: without many groups that is small.
    few = not group or whole.count() <= BROADCAST_ROWS
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"_g_{g}") for g in group]
    whole = whole.select(F.col("_range").alias("_r"), *keys, *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    within = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = all_of([F.col("_range") == F.col("_r"), *(F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group)])
    summed = placed.withColumns({f"_s_{n}": F.sum(f"_w_{n}").over(within) for n in sums}).join(F.broadcast(whole) if few else whole.hint("shuffle_merge"), here)
    return summed.select(*rows.columns, *((F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def ranks(rows: DataFrame, value: str, ties: Sequence[Column], group: Sequence[str]) -> DataFrame:
    """``rows`` with ``position``, ``rank_competition`` and ``rank_dense`` by ``value``, descending, in each group; ``ties`` must
    leave none.

    Ranks are taken within ranges of group, value and ties. A row for each range and group tells how many rows and values
    come before, and where the run of equal values began that reaches into the range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *map(F.col, group), F.desc(value), *ties).withColumn("_range", F.spark_partition_id())
    here = Window.partitionBy("_range", *group)
    by_value = here.orderBy(F.desc(value))
    placed = settled(placed.withColumns({"_row": F.row_number().over(here.orderBy(F.desc(value), *ties)), "_rank": F.rank().over(by_value), "_dense": F.dense_rank().over(by_value)}), "ranges")
    v = F.col(value)
    whole = placed.groupBy("_range", *group).agg(F.max("_row").cast("long").alias("_n"), F.max("_dense").alias("_kinds"), F.max("_rank").alias("_tail"), F.max(v).alias("_first"), F.min(v).alias("_last"))
    whole = settled(whole, "range-sums")
    along = Window.partitionBy(*group).orderBy("_range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_on": F.coalesce(F.lag("_last").over(along) == F.col("_first"), F.lit(False))})
    start = F.when(~F.col("_on") | (F.col("_kinds") > 1), F.col("_before") + F.col("_tail"))
    told = whole.select(
        F.col("_range").alias("_r"), *(F.col(g).alias(f"_g_{g}") for g in group), "_before", "_on", "_first", F.last(start, True).over(earlier).alias("_start"),
        (F.coalesce(F.sum("_kinds").over(earlier), F.lit(0)) - F.sum(F.col("_on").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("_values"),
    )
    same = all_of([F.col("_range") == F.col("_r"), *(F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group)])
    few = whole.count() <= BROADCAST_ROWS
    both = placed.join(F.broadcast(told) if few else told.hint("shuffle_merge"), same)
    competition = F.when(F.col("_on") & (v == F.col("_first")), F.col("_start")).otherwise(F.col("_before") + F.col("_rank"))
    return both.select(*rows.columns, (F.col("_before") + F.col("_row")).alias("position"), competition.alias("rank_competition"), (F.col("_values") + F.col("_dense")).alias("rank_dense"))


def value_counts(long: DataFrame, group: Sequence[str] = ("metric",), value: str = "value", descending: bool = False) -> DataFrame:
    """Each group's different values with ``times``, and ``upto``: the rows up to and with the value."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("times"))
    return running(counts, [F.desc(value) if descending else F.asc(value)], group, {"upto": F.col("times")})


def quantiles(long: DataFrame, probs: Mapping[str, float], group: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """For each group ``unique_count`` and the named quantiles, linear between order statistics."""
    counts = value_counts(long, group, value)
    sizes = long.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    told = counts.join(F.broadcast(sizes), list(group))  # a row for each group
    place = {n: F.lit(p) * (F.col("_size") - 1) for n, p in probs.items()}
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    ends = [x.alias(f"_{side}_{n}") for n, at_place in place.items() for side, x in (("low", at(F.floor(at_place))), ("high", at(F.ceil(at_place))))]
    found = told.groupBy(*group, "_size").agg(F.count(F.lit(1)).alias("unique_count"), *ends)
    between = [(F.col(f"_low_{n}") + (at_place - F.floor(at_place)) * (F.col(f"_high_{n}") - F.col(f"_low_{n}"))).alias(n) for n, at_place in place.items()]
    return found.select(*group, "unique_count", *between)
