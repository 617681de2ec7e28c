"""Resampling protocols (RS1-RS6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.operators import order, stats
from citegrid.sources.scratch import settled, ship


def ordinal_ranks(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A row for each author and metric with its unique rank: by value, c, p (all descending), author id."""
    keep = [F.col("c").cast("double").alias("tie_c"), F.col("p").cast("double").alias("tie_p")]
    long = rows.select("author_id", *keep, *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics)).unpivot(["author_id", "tie_c", "tie_p"], list(metrics), "metric", "value")
    placed = order.running(long, [F.desc("value"), F.desc("tie_c"), F.desc("tie_p"), F.asc("author_id")], ["metric"], {"rank": F.lit(1)})
    return placed.select("author_id", "metric", "value", F.col("rank").cast("double").alias("rank"))


def ordinal_spearman(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman of unique ranks (RS6): metric_a, metric_b, n, value; null below 3 authors."""
    names = sorted({m for p in pairs for m in p})
    wide = ordinal_ranks(rows, names).groupBy("author_id").pivot("metric", names).agg(F.first("rank"))
    found = stats._moments(wide, pairs).withColumn("value", stats._correlation())
    return found.select(F.col("a").alias("metric_a"), F.col("b").alias("metric_b"), "n", F.when(F.col("n") >= 3, F.col("value")).alias("value"))


def _number(*parts: Column | str, at: Column | None = None) -> Column:
    """A number below 2 ** 60 from the MD5 of the parts; ``at`` 0 or 1 takes one of two."""
    digest = F.md5(F.concat_ws(":", *parts))
    digits = F.substring(digest, 1, 15) if at is None else F.substring(digest, at * 15 + 1, F.lit(15))
    return F.conv(digits, 16, 10).cast("long")


def _ranks_in_order(wide: DataFrame, metrics: Sequence[str], rows_per_range: int) -> tuple[DataFrame, int, int]:
    """``wide`` (author_id and whole ranks) with ``slot``, its number by id from 0; and the rows, and how many ranges of ranks
    of ``rows_per_range`` they make."""
    numbered = order.running(wide, [F.asc("author_id")], [], {"place": F.lit(1)}).withColumn("slot", F.col("place") - 1).drop("place")
    numbered = settled(numbered, "numbered")
    n = numbered.count()
    return numbered, n, -(-n // rows_per_range) or 1


def bootstrap(rows: DataFrame, pairs: Sequence[tuple[str, str]], iterations: int = 200, seed: int = 42, sample_size: int = 0, rows_per_range: int = 100_000) -> DataFrame:
    """The ordinal Spearman and its 2.5 % and 97.5 % bounds over resamples of ``sample_size`` (or all) authors (RS1).

    Authors are numbered by id. Each iteration draws as many numbers as there are authors, by MD5; an author's rank in a
    resample is the running count of draws in the metric's order, the place of its last copy. Draws are rows of a range
    and are shuffled once, by author: an author then has one row with the list of iterations that drew it, and the running
    counts of all iterations are taken together, within ranges of ``rows_per_range`` ranks of each metric, from the sums of
    the ranges before. So no task holds an iteration, and no row is shuffled for each draw again."""
    iterations = max(10, min(iterations, 10_000))
    spark, names = rows.sparkSession, sorted({m for p in pairs for m in p})
    wide = ordinal_ranks(rows, names).groupBy("author_id").pivot("metric", names).agg(F.first("rank"))
    numbered, n, ranges = _ranks_in_order(wide, names, rows_per_range)
    drawn_size = max(2, min(n, sample_size or n))
    if n < 3 or drawn_size < 3:
        return spark.createDataFrame([], "metric_a string, metric_b string, iterations long, sample_size long, estimate double, ci_low double, ci_high double, status string")
    twos = -(-drawn_size // 2)
    parts = max(spark.sparkContext.defaultParallelism, -(-iterations * twos // 1_000_000))
    draws = spark.range(0, iterations * twos, 1, parts).select((F.col("id") / twos).cast("long").alias("iteration"), (F.col("id") % twos).alias("two"))
    both = F.array(*(F.struct((F.col("two") * 2 + i).alias("k"), (_number(F.lit(str(seed)), "iteration", "two", at=F.lit(i)) % n).alias("slot")) for i in (0, 1)))
    draws = draws.select("iteration", F.inline(both)).filter(F.col("k") < drawn_size).select(F.col("iteration").cast("int").alias("iteration"), "slot")
    ship(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = draws.repartition(width, "slot").groupBy("slot").agg(F.sort_array(F.collect_list("iteration")).alias("drawn"))
    sample = settled(drawn.join(numbered.drop("author_id").hint("shuffle_hash"), "slot"), "resample")
    placed = None
    for m in names:
        one = _resampled_ranks(sample, m, n, ranges, iterations)
        one = one if placed is None else one.drop("kinds")
        placed = one if placed is None else placed.join(one.hint("shuffle_merge"), "slot")
    each = placed.mapInArrow(_sums_of_iterations(pairs, iterations), "iteration int, pair int, n long, x double, y double, xx double, yy double, xy double")
    named = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    each = each.groupBy("iteration", "pair").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).withColumn("s", F.get(named, F.col("pair"))).select("iteration", "s.*", "n", "x", "y", "xx", "yy", "xy")
    rho = each.withColumn("rho", stats._correlation())
    constant = methodology(rows, names).filter("constant").agg(F.collect_set("metric").alias("flat"))
    out = rho.groupBy("a", "b").agg(F.count("rho").alias("n"), F.percentile("rho", 0.025).alias("low"), F.percentile("rho", 0.975).alias("high")).crossJoin(F.broadcast(constant))  # one row; iterations values a pair
    flat = F.array_contains("flat", F.col("a")) | F.array_contains("flat", F.col("b"))
    whole = _moments_of_ranks(numbered, pairs).select("a", "b", F.col("value").alias("whole"))
    return out.join(F.broadcast(whole), ["a", "b"]).select(  # a row for each pair
        F.col("a").alias("metric_a"), F.col("b").alias("metric_b"), F.when(flat, 0).otherwise(F.col("n")).cast("long").alias("iterations"), F.lit(drawn_size).cast("long").alias("sample_size"),
        F.when(~flat, F.col("whole")).alias("estimate"), F.when(~flat, F.col("low")).alias("ci_low"), F.when(~flat, F.col("high")).alias("ci_high"), F.when(flat, "constant_metric").otherwise("ok").alias("status"),
    )


#: Counts of authors by iterations that a task holds at once.
CELLS = 1 << 21


def _counts(lists: pa.Array, iterations: int) -> np.ndarray:
    """How often each list holds each iteration: a row for each list."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(size), dtype=np.int64) * iterations, size) + lists.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(at, minlength=len(size) * iterations).reshape(len(size), iterations)


def _resampled_ranks(sample: DataFrame, metric: str, n: int, ranges: int, iterations: int) -> DataFrame:
    """slot, ``kinds``, the different iterations that drew it, and ``_metric``, for each of them the copies up to and with the
    author's, in the order of its rank in all."""
    rows = sample.select("slot", "drawn", F.col(metric).cast("long").alias("rank"), F.floor((F.col(metric) - 1) * ranges / n).cast("int").alias("range"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, part = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            at = np.repeat(part.astype(np.int64) * iterations, batch.column(1).value_lengths().to_numpy(zero_copy_only=False)) + batch.column(1).flatten().to_numpy()
            sums = np.bincount(at, minlength=len(kinds) * iterations)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[some // iterations], pa.int32()), pa.array((some % iterations).astype(np.int32)), pa.array(sums[some], pa.int64())], names=["range", "iteration", "sum"])

    few = max(1, CELLS // iterations)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(iterations, np.int64), -1
        for batch in (b.slice(i, few) for b in batches for i in range(0, b.num_rows, few)):
            slots, part, before = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(4)
            times = _counts(batch.column(1), iterations)
            begins = np.flatnonzero(np.concatenate(([part[0] != last], part[1:] != part[:-1]))) if len(part) else []
            starts = [0, *(b for b in begins if b)] if len(part) else []
            upto = np.empty(times.shape, np.int64)
            for begin, stop in zip(starts, [*starts[1:], len(part)], strict=True):
                if begin in begins:  # a range begins with the row of the sums before
                    total = np.asarray(before[begin].values).astype(np.int64)
                upto[begin:stop] = np.cumsum(times[begin:stop], axis=0) + total
                total = upto[stop - 1]
            last = part[-1] if len(part) else last
            row, iteration = np.nonzero(times)
            ends = np.searchsorted(row, np.arange(len(slots) + 1)).astype(np.int32)
            kinds = pa.ListArray.from_arrays(pa.array(ends), pa.array(iteration.astype(np.int32)))
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(upto[row, iteration]))
            yield pa.RecordBatch.from_arrays([pa.array(slots), kinds, found], names=["slot", "kinds", f"_{metric}"]).filter(pa.array(slots >= 0))

    sums = rows.select("range", "drawn").mapInArrow(totals, "range int, iteration int, sum long").groupBy("range", "iteration").agg(F.sum("sum").alias("sum"))
    every = rows.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range")).crossJoin(rows.sparkSession.range(iterations).select(F.col("id").cast("int").alias("iteration")))
    sums = every.join(sums.hint("shuffle_merge"), ["range", "iteration"], "left")
    earlier = Window.partitionBy("iteration").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", "iteration", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    sums = sums.groupBy("range").agg(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "before"))), lambda s: s["before"]).alias("before"))
    first = sums.select(F.lit(-1).cast("long").alias("slot"), F.array().cast("array<int>").alias("drawn"), "range", F.lit(0).cast("long").alias("rank"), "before")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.select("slot", "drawn", "range", "rank", F.lit(None).cast("array<long>").alias("before")).unionByName(first)
    return both.repartition(parts, "range").sortWithinPartitions("range", "rank").mapInArrow(running, f"slot long, kinds array<int>, _{metric} array<long>")


def _sums_of_iterations(pairs: Sequence[tuple[str, str]], iterations: int) -> Callable:
    """For each task, iteration and pair the moments of the ranks in the resample."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pairs), 6, iterations))
        for batch in batches:
            iteration = batch.column("kinds").flatten().to_numpy()
            for i, (a, b) in enumerate(pairs):
                x, y = (batch.column(f"_{m}").flatten().to_numpy().astype(np.float64) for m in (a, b))
                for j, weight in enumerate((None, x, y, x * x, y * y, x * y)):
                    sums[i, j] += np.bincount(iteration, weight, iterations)
        for i in range(len(pairs)):
            n = sums[i, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations, dtype=np.int32)), pa.array(np.full(iterations, i, np.int32)), pa.array(n), *(pa.array(sums[i, j]) for j in range(1, 6))], names=["iteration", "pair", "n", "x", "y", "xx", "yy", "xy"])

    return moments


def _moments_of_ranks(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return stats._moments(wide, pairs).withColumn("value", stats._correlation())


def permutation(rows: DataFrame, pairs: Sequence[tuple[str, str]], top_n: int = 20, iterations: int = 200, seed: int = 42) -> DataFrame:
    """Is the overlap of two top lists more than that of the first with random authors (RS2)? p = (extreme + 1) / (iterations + 1),
    and Holm's adjustment over the pairs; pairs with a constant metric have a status instead.

    An iteration's list is the ``top_n`` authors of least number by MD5. Numbers are even, so all but about ``top_n`` authors
    lie above a threshold and are dropped where they are made; an iteration that keeps fewer than ``top_n`` is given a higher
    one, until none does. So some ``top_n`` rows of each iteration are shuffled, whatever the number of authors."""
    spark, names = rows.sparkSession, sorted({m for p in pairs for m in p})
    wide = ordinal_ranks(rows, names).groupBy("author_id").pivot("metric", names).agg(F.first("rank"))
    n = rows.count()
    size = max(1, min(top_n, n))
    if n < 2:
        return spark.createDataFrame([], "metric_a string, metric_b string, top_n long, overlap long, overlap_rate double, p_value double, iterations long, status string, p_holm double")
    top = settled(wide.select("author_id", *((F.col(m) <= size).alias(m) for m in names)), "top")
    each = top.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("chance", _number(F.lit(str(seed)), "iteration", "author_id"))
    share = (size + 12 * size**0.5 + 40) / n
    while True:
        few = each if share >= 1 else each.filter(F.col("chance") < int(share * 2**60))
        few = settled(few, "lists")
        full = few.groupBy("iteration").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= size).count()
        if full == iterations:
            break
        share *= 4
    by = Window.partitionBy("iteration").orderBy("chance", "author_id")
    lists = few.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= size)
    hits = lists.groupBy("iteration").agg(*(F.count_if(m).alias(m) for m in names))
    seen = top.agg(*(F.count_if(F.col(a) & F.col(b)).alias(f"o{i}") for i, (a, b) in enumerate(pairs)))
    both = hits.crossJoin(F.broadcast(seen))  # one row
    sums = [F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.max(f"o{i}").alias("overlap"), ((F.count_if(F.col(a) >= F.col(f"o{i}")) + 1) / (iterations + 1)).alias("p")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]
    constant = methodology(rows, names).filter("constant").agg(F.collect_set("metric").alias("flat"))
    one = both.agg(*sums).select(F.explode(F.array(*(f"s{i}" for i in range(len(pairs))))).alias("s")).select("s.*").crossJoin(F.broadcast(constant))  # one row
    flat = F.array_contains("flat", F.col("metric_a")) | F.array_contains("flat", F.col("metric_b"))
    told = one.select(
        "metric_a", "metric_b", F.lit(size).cast("long").alias("top_n"), F.when(~flat, F.col("overlap")).alias("overlap"), F.when(~flat, F.col("overlap") / size).alias("overlap_rate"), F.when(~flat, F.col("p")).alias("p_value"),
        F.when(flat, 0).otherwise(iterations).cast("long").alias("iterations"), F.when(flat, "constant_metric").otherwise("ok").alias("status"),
    )
    told = settled(told, "permutation")
    return holm(told.filter("p_value is not null")).unionByName(told.filter("p_value is null").withColumn("p_holm", F.lit(None).cast("double")))


def holm(tests: DataFrame) -> DataFrame:
    """``tests`` (metric_a, metric_b, p_value) with Holm's adjusted p (RS3): a row for each pair of metrics."""
    by = Window.orderBy("p_value", "metric_a", "metric_b")
    ranked = tests.withColumn("i", F.row_number().over(by) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    step = F.least(F.lit(1.0), F.col("p_value") * (F.col("m") - F.col("i")))
    return ranked.withColumn("p_holm", F.max(step).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("i", "m")


def convergence(rows: DataFrame, baseline: str = "h", sizes: Sequence[int] = (500, 1000, 2000, 5000), top_n: int = 20) -> DataFrame:
    """How the order of the first authors by id nears that of all, for growing numbers of them (RS4): the correlation
    of their places among themselves with their places in the whole order, and the shared authors of the two
    lists' first ``top_n``."""
    n = rows.count()
    full = ordinal_ranks(rows, [baseline]).select("author_id", F.col("rank").alias("full_rank"))
    ties = rows.select("author_id", F.coalesce(F.col(baseline).cast("double"), F.lit(0.0)).alias("value"), F.col("c").cast("double").alias("tie_c"), F.col("p").cast("double").alias("tie_p"))
    placed = settled(order.running(ties, [F.asc("author_id")], [], {"place": F.lit(1)}).join(full.hint("shuffle_merge"), "author_id"), "placed")
    best = [F.desc("value"), F.desc("tie_c"), F.desc("tie_p"), F.asc("author_id")]
    out = None
    for size in sorted({s for s in sizes if 0 < s <= n} | ({n} if n else set())):
        part = order.running(placed.filter(F.col("place") <= size), best, [], {"rank": F.lit(1)})
        one = part.agg(F.count(F.lit(1)).alias("k"), F.corr("rank", "full_rank").alias("r"), F.count_if((F.col("rank") <= top_n) & (F.col("full_rank") <= top_n)).alias("top_overlap"))
        one = one.select(
            F.lit(size).cast("long").alias("prefix_size"), F.lit(n).cast("long").alias("full_size"), F.lit(size / n).alias("coverage_ratio"), F.when(F.col("k") >= 3, F.col("r")).alias("spearman_vs_full"),
            "top_overlap", (F.col("top_overlap") / min(max(1, min(n, top_n)), size)).alias("top_overlap_rate"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.sparkSession.createDataFrame([], "prefix_size long, full_size long, coverage_ratio double, spearman_vs_full double, top_overlap long, top_overlap_rate double")
    return out


def methodology(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Constant and all-zero metrics (RS5), to twelve decimals."""
    v = F.round("value", 12)
    s = stats.to_long(rows, metrics).groupBy("metric").agg(F.count_distinct(v).alias("kinds"), F.max(F.abs(v)).alias("most"))
    return s.select("metric", (F.col("kinds") <= 1).alias("constant"), F.coalesce(F.col("most") == 0, F.lit(True)).alias("all_zero"), F.when(F.col("kinds") <= 1, "constant_metric").otherwise("ok").alias("status"))
