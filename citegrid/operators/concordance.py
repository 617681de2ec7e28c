"""Kendall's tau-b of pairs of metrics, exact for any number of authors (DS14).

Discordant pairs of points are counted without comparing all points. Points are dealt into strips, ranges of (x, y),
and into bands, ranges of (y, x); in these orders no two points are tied, and points with equal x or y are never
discordant, so a value that many authors share is split like any other. A discordant pair lies in one strip, or
in one band, or in neither:

    discordant = within strips + within bands - within cells (both) + among cells of which neither is shared

The last is the same count over the cells' weights. A task holds one strip or band, a ``RANGES``-th of the points.

With ``by``, groups of up to ``GROUP_ROWS`` rows are dealt whole into buckets of about so many rows, and all groups of a bucket are
counted at once; only larger groups take the way above.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.sources.scratch import settled, ship

RANGES = 256
BROADCAST_ROWS = 100_000
GROUP_ROWS = 100_000


def discordant(x: np.ndarray, y: np.ndarray, weight: np.ndarray, block: np.ndarray | None = None) -> int:
    """Products of weights, summed over the pairs of points of one block of which one has the less x and the greater y.

    The points, in the order of x, are parted by the bits of their places in the order of y, highest first: of two
    points that are parted at a bit, the one with the greater y has it set."""
    n = len(x)
    block = np.zeros(n, np.int64) if block is None else block
    by_y = np.lexsort((x, y, block))
    place = np.empty(n, np.int64)
    place[by_y] = np.arange(n)
    order = np.lexsort((y, x, block))
    place, weight, total = place[order], weight[order].astype(np.int64), 0
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        parent, high = place >> (bit + 1), (place >> bit) & 1 == 1
        before = np.cumsum(np.where(high, weight, 0))
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        start = np.where(first > 0, before[first - 1], 0)
        before = before - np.repeat(start, np.diff(np.append(first, n)))
        total += int((weight[~high] * before[~high]).sum())
        order = np.argsort(place >> bit, kind="stable")
        place, weight = place[order], weight[order]
    return total


def _changes(key: np.ndarray) -> np.ndarray:
    """Whether a sorted key differs from the one before it."""
    return np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)


def _sum_of_runs(changes: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """For each block twice the number of pairs within its runs; ``changes`` are where runs start."""
    first = np.flatnonzero(changes)
    times = np.diff(np.append(first, len(changes)))
    return _by_block(block[first], times * (times - 1), blocks)


def _by_block(block: np.ndarray, value: np.ndarray, blocks: int) -> np.ndarray:
    """Whole numbers summed for each block; blocks are in order."""
    out = np.zeros(blocks, np.int64)
    if len(block):
        first = np.flatnonzero(_changes(block))
        out[block[first]] = np.add.reduceat(value, first)
    return out


def in_blocks(x: np.ndarray, y: np.ndarray, block: np.ndarray, blocks: int) -> dict[str, np.ndarray]:
    """For each block of points: ``n``, twice the pairs tied in x, in y and in both, and the discordant pairs, as
    :func:`discordant` counts them. ``x`` and ``y`` are ranks; the values that a bit parts move past one another, block by block."""
    by_y = np.lexsort((x, y, block))
    xs, ys, bs = x[by_y], y[by_y], block[by_y]
    block_starts = _changes(bs)
    y_starts = block_starts | _changes(ys)
    both_starts = y_starts | _changes(xs)
    told = {"n": np.bincount(block, minlength=blocks), "tied_both": _sum_of_runs(both_starts, bs, blocks), "tied_y": _sum_of_runs(y_starts, bs, blocks)}
    place = np.empty(len(x), np.int64)
    place[by_y] = np.cumsum(both_starts)  # equal points have one place
    order = np.lexsort((y, x, block))
    told["tied_x"] = _sum_of_runs(block_starts | _changes(x[order]), bs, blocks)
    place, total, index = place[order], np.zeros(len(x), np.int64), np.arange(len(x))
    starts = np.flatnonzero(block_starts)
    sizes = np.diff(np.append(starts, len(x)))
    place -= np.repeat(np.minimum.reduceat(place, starts), sizes) if len(x) else 0
    for bit in reversed(range(int(place.max(initial=0)).bit_length())):
        high = (place >> bit) & 1
        first = np.flatnonzero(block_starts | _changes(place >> (bit + 1)))
        size = np.diff(np.append(first, len(x)))
        before = np.cumsum(high)
        highs = np.diff(np.append(before[first] - high[first], before[-1]))
        before -= high + np.repeat(before[first] - high[first], size)
        total += np.where(high, 0, before)
        start = np.repeat(first, size)
        moved = np.empty_like(place)
        moved[start + np.where(high, np.repeat(size - highs, size) + before, index - start - before)] = place
        place = moved
    return told | {"discordant": _by_block(bs, total, blocks)}


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _counted(rows: DataFrame, keys: Sequence[str], part: Sequence[str], x: str, y: str, also: str | None = None) -> DataFrame:
    """For each key ``pairs``: discordant pairs within each ``part``, less those that ``also`` share the other."""
    schema = rows.select(*keys, F.lit(0).cast("long").alias("pairs")).schema

    def count(table: pa.Table) -> pa.Table:
        xs, ys, weight = (_column(table, c) for c in (x, y, "weight"))
        found = discordant(xs, ys, weight)
        if also:
            found -= discordant(xs, ys, weight, _column(table, also))
        return table.select(list(keys)).slice(0, 1).append_column("pairs", pa.array([found], pa.int64()))

    columns = dict.fromkeys([*keys, *part, x, y, "weight", *([also] if also else [])])
    return rows.select(*columns).groupBy(*keys, *part).applyInArrow(count, schema)


def _pairs_of(n: Column) -> Column:
    n = n.cast("decimal(19,0)")
    return n * (n - 1)  # twice their number


def kendall(rows: DataFrame, metrics: Sequence[str], limit: int | None, by: Sequence[str] = (), diagonal: bool = False, ranges: int = RANGES) -> DataFrame:
    """(``by``, metric_a, metric_b, n, value, skipped) for each pair of metrics, over the rows that have both values.

    Pairs with more than ``limit`` such rows are told as skipped, with null; without a limit all are counted. ``diagonal``
    adds each metric with itself: 1 from two rows on. Null where a metric doesn't vary. Counts are exact
    below three thousand million authors."""
    ship(rows.sparkSession)
    ends = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + (not diagonal) :]]
    # Zeros have one sign, so that equal values sort alike.
    rows = rows.select(*by, *((F.col(m).cast("double") + 0.0).alias(m) for m in metrics))
    if not by:
        return _tau(_ranged(rows, ends, limit, by, ranges), by, limit)
    rows = settled(rows, "kendall-rows")
    groups = settled(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "kendall-groups")
    large = F.col("_n") > GROUP_ROWS
    told = groups.agg(F.count_if(large).alias("many"), F.sum(F.when(~large, F.col("_n"))).alias("rest")).first()
    few, many = rows, groups.filter(large).select(*by)
    if told["many"]:
        many = F.broadcast(many) if told["many"] <= BROADCAST_ROWS else many.hint("shuffle_merge")
        few = _with(rows, many, by, "left_anti")
    counts = _together(few, ends, by, -(-(told["rest"] or 1) // GROUP_ROWS))
    if told["many"]:
        counts = counts.unionByName(_ranged(_with(rows, many, by, "left_semi"), ends, limit, by, ranges))
    return _tau(counts, by, limit)


TIES = ["tied_both", "tied_x", "tied_y"]


def _together(rows: DataFrame, ends: Sequence[tuple[str, str]], by: Sequence[str], buckets: int) -> DataFrame:
    """Counts of whole groups, bucket by bucket. A bucket's rows are held by one task."""
    counts = ["n", *TIES, "discordant"]
    names = list(dict.fromkeys(m for pair in ends for m in pair))
    schema = rows.select(*by, *(F.lit("").alias(m) for m in ("metric_a", "metric_b")), *(F.lit(0).cast("long").alias(c) for c in counts)).schema

    def count(table: pa.Table) -> pa.Table:
        block = np.zeros(table.num_rows, np.int64)
        for k in by:
            codes = table[k].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            block = np.unique(block * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        blocks = int(block.max()) + 1
        first = np.empty(blocks, np.int64)
        first[block[::-1]] = np.arange(table.num_rows)[::-1]
        keys = table.select(list(by)).take(pa.array(first))
        known = {m: table[m].is_valid().to_numpy() for m in names}
        rank = {m: np.unique(table[m].fill_null(0.0).to_numpy(), return_inverse=True)[1] for m in names}
        out = []
        for a, b in ends:
            both = known[a] & known[b]
            found = in_blocks(rank[a][both], rank[b][both], block[both], blocks)
            made = keys.append_column("metric_a", pa.array([a] * blocks)).append_column("metric_b", pa.array([b] * blocks))
            for c in counts:
                made = made.append_column(c, pa.array(found[c], pa.int64()))
            out.append(made)
        return pa.concat_tables(out)

    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("_bucket")
    return rows.select(bucket, *by, *names).groupBy("_bucket").applyInArrow(count, schema)


def _ranged(rows: DataFrame, ends: Sequence[tuple[str, str]], limit: int | None, by: Sequence[str], ranges: int) -> DataFrame:
    """Counts by strips, bands and cells: of the whole table, or of each group. Discordant pairs are null where they aren't needed."""
    spark = rows.sparkSession
    keys = [*by, "metric_a", "metric_b"]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in ends)))
    points = rows.select(*by, each.alias("s")).select(*by, "s.*")
    points = settled(points.filter("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("weight")), "kendall-points")
    sizes = points.groupBy(*keys).agg(F.sum("weight").alias("n"), F.sum(_pairs_of(F.col("weight"))).alias("tied_both"))
    for side in ("x", "y"):
        tied = points.groupBy(*keys, side).agg(F.sum("weight").alias("t")).groupBy(*keys).agg(F.sum(_pairs_of(F.col("t"))).alias(f"tied_{side}"))
        sizes = _with(sizes, tied, keys, "inner")
    sizes = settled(sizes, "kendall-sizes")

    off = F.col("metric_a") != F.col("metric_b")
    open_ = sizes.filter(off if limit is None else off & (F.col("n") <= limit)).select(*keys)
    few = sizes.count() <= BROADCAST_ROWS
    chosen = _with(points, F.broadcast(open_) if few else open_.hint("shuffle_merge"), keys, "left_semi")
    parts = max(1, min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    strips = settled(chosen.repartitionByRange(parts, *keys, "x", "y").withColumn("_strip", F.spark_partition_id().cast("long")), "kendall-strips")
    placed = settled(strips.repartitionByRange(parts, *keys, "y", "x").withColumn("_band", F.spark_partition_id().cast("long")), "kendall-bands")
    cells = placed.groupBy(*keys, "_strip", "_band").agg(F.sum("weight").alias("weight"))
    counts = (
        _counted(placed, keys, ["_strip"], "x", "y")
        .unionByName(_counted(placed, keys, ["_band"], "x", "y", also="_strip"))
        .unionByName(_counted(cells, keys, [], "_strip", "_band"))  # ranges ** 2 cells of a pair at most
    )
    counts = settled(counts.groupBy(*keys).agg(F.sum(F.col("pairs").cast("decimal(38,0)")).alias("discordant")), "kendall-counts")

    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")) if by else spark.range(1)
    wanted = whole.select(*by, F.explode(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b")) for a, b in ends))).alias("s")).select(*by, "s.*")
    told = _with(_with(wanted, sizes.hint("shuffle_merge"), keys, "left"), counts.hint("shuffle_merge"), keys, "left")
    return told.select(*keys, "n", *TIES, "discordant")


def _tau(counts: DataFrame, by: Sequence[str], limit: int | None) -> DataFrame:
    off = F.col("metric_a") != F.col("metric_b")
    n, number = F.coalesce("n", F.lit(0)), lambda c: c.cast("double")
    untied_x, untied_y = _pairs_of(F.col("n")) - F.col("tied_x"), _pairs_of(F.col("n")) - F.col("tied_y")
    surplus = _pairs_of(F.col("n")) - F.col("tied_x") - F.col("tied_y") + F.col("tied_both") - 4 * F.coalesce("discordant", F.lit(0))
    tau = F.when((untied_x > 0) & (untied_y > 0), number(surplus) / F.sqrt(number(untied_x) * number(untied_y)))
    skipped = off & F.lit(False) if limit is None else off & (n > limit)
    value = F.when(~off, F.when(n >= 2, 1.0)).when(~skipped, tau)
    return counts.select(*by, "metric_a", "metric_b", n.alias("n"), value.alias("value"), skipped.alias("skipped"))


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join by keys of which some may be null."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_k_{k}"]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return left.join(named, condition, how).drop(*(f"_k_{k}" for k in keys))
