"""Ratings and rankings (RK1-RK11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import order
from .indices import METRICS

GROUP = ["run_id", "fraction_mode", "metric_name"]


def long_metrics(indices: DataFrame, metrics: Sequence[str] = METRICS, keep: Sequence[str] = ("run_id", "fraction_mode", "author_id", "author_display_name")) -> DataFrame:
    """A row for each author and metric (RK1); a missing score is 0."""
    wide = indices.select(*keep, F.col("c").alias("tie_break_c"), F.col("p").alias("tie_break_p"), *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics))
    return wide.unpivot([*keep, "tie_break_c", "tie_break_p"], list(metrics), "metric_name", "score")


def ratings(indices: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Competition, dense and unique ranks of every metric (RK2, RK3).

    All three come from one pass over ranges of metric and score (:func:`citegrid.operators.order.ranks`)."""
    placed = order.ranks(long_metrics(indices, metrics), "score", [F.desc("tie_break_c"), F.desc("tie_break_p"), F.asc("author_id")], GROUP)
    return placed.select(
        *GROUP, "author_id", "author_display_name", "score", "position", F.col("position").alias("rank_ordinal"), "rank_competition", "rank_dense", "tie_break_c", "tie_break_p", F.col("author_id").alias("tie_break_author_id")
    )


def stable_order(columns: Sequence[str], sort: str, direction: str = "desc") -> list[Column]:
    """The chosen column, then citations, publications, name, author and work (P7)."""
    if sort not in columns:
        raise ValueError(f"unknown sort column: {sort}")
    first = F.col(sort).desc_nulls_last() if direction == "desc" else F.col(sort).asc_nulls_last()
    rest = [("c", False), ("p", False), ("author_display_name", True), ("author_id", True), ("work_id", True)]
    return [first, *(F.col(c).asc() if up else F.col(c).desc() for c, up in rest if c in columns and c != sort)]


def metric_ranking(indices: DataFrame, metric: str, limit: int = 20, direction: str = "desc", data_limit: int = 0) -> DataFrame:
    """Ranks of one metric on a selection, the selection's size, and the first ``limit`` authors (RK4). The
    selection may first be cut to its ``data_limit`` best."""
    if metric not in indices.columns:
        raise ValueError(f"unknown metric: {metric}")
    along = stable_order(indices.columns, metric, direction)
    rows = indices.orderBy(*along).limit(data_limit) if data_limit else indices
    values = rows.groupBy(metric).agg(F.count(F.lit(1)).alias("_n"))
    up = F.col(metric).asc_nulls_last() if direction == "asc" else F.col(metric).desc_nulls_last()
    values = order.running(values, [up], [], {"_upto": F.col("_n"), "rank_dense": F.lit(1)})
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    values = values.select(F.col(metric).alias("_value"), (F.col("_upto") - F.col("_n") + 1).alias("rank_competition"), "rank_dense").crossJoin(F.broadcast(total))  # one row
    best = rows.orderBy(*along).limit(limit)
    numbered = best.withColumn("rank_ordinal", F.row_number().over(Window.orderBy(*along)))  # limit rows
    return numbered.join(values, F.col(metric).eqNullSafe(F.col("_value"))).select(
        "author_id", "author_display_name", F.col(metric).cast("double").alias("score"), F.col("rank_ordinal").cast("long"), F.col("rank_competition").cast("long"), F.col("rank_dense").cast("long"), F.col("total").cast("long")
    )


def ranking_rows(indices: DataFrame, metric: str, visible: Sequence[str] = (), limit: int = 20, most: int = 500, direction: str = "desc") -> DataFrame:
    """The rows of a ranking table (RK5): by score, citations, publications (descending) and author id; ascending is
    that order backwards, ties too. ``rank_competition`` counts from the end that is shown first."""
    score = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    up = direction == "asc"
    rows = indices.withColumn("_score", score(metric))
    along = [score(c).asc() if up else score(c).desc() for c in (metric, "c", "p")] + [F.desc("author_id") if up else F.asc("author_id")]
    shown = max(0, min(limit, max(1, most)))
    ranks = order.value_counts(rows, [], "_score", descending=not up).select("_score", (F.col("upto") - F.col("times") + 1).alias("rank_competition"))
    best = rows.orderBy(*along).limit(shown) if shown else rows
    return best.join(ranks.hint("shuffle_merge"), "_score").select("author_id", "author_display_name", F.col("_score").alias("score"), *visible, "rank_competition")


def line_series(indices: DataFrame, rank_metric: str = "h", metrics: Sequence[str] = ("p", "c", "h", "g"), limit: int = 30) -> DataFrame:
    """The best authors with each metric scaled to 0-100 over the whole selection (RK6)."""
    limit = min(limit, 100)
    bounds = indices.agg(*(f(F.col(m).cast("double")).alias(f"{m}_{n}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))))
    best = indices.orderBy(*stable_order(indices.columns, rank_metric)).limit(limit)
    scaled = [F.coalesce(100 * F.try_divide(F.col(m) - F.col(f"{m}_lo"), F.col(f"{m}_hi") - F.col(f"{m}_lo")), F.lit(0.0)).alias(f"{m}_scaled") for m in metrics]
    return best.crossJoin(F.broadcast(bounds)).select("author_id", *(F.col(m).cast("double").alias(m) for m in metrics), *scaled)  # one row of bounds


def competition_ranks(long: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """``long`` with ``rank``: 1 + the number of greater values of the metric. Only distinct values are sorted."""
    ranks = order.value_counts(long, [by], value, descending=True).select(by, value, (F.col("upto") - F.col("times") + 1).alias("rank"))
    return long.join(ranks.hint("shuffle_merge"), [by, value])


def rank_deltas(ranked: DataFrame, baseline: str = "h") -> DataFrame:
    """Each author's shift from the baseline's rank, for every other metric."""
    base = ranked.filter(F.col("metric") == baseline).select("author_id", F.col("rank").alias("baseline_rank"))
    others = ranked.filter(F.col("metric") != baseline).select("author_id", "metric", F.col("rank").alias("metric_rank"))
    return others.join(base.hint("shuffle_merge"), "author_id").withColumn("rank_delta", F.col("metric_rank") - F.col("baseline_rank")).withColumn("abs_rank_delta", F.abs("rank_delta"))


def rank_delta_summary(ranked: DataFrame, baseline: str = "h") -> DataFrame:
    """Median, 90th percentile, maximum and share up to 5 of the absolute shifts (RK8)."""
    d = F.col("abs_rank_delta")
    deltas = rank_deltas(ranked, baseline).withColumn("abs_rank_delta", d.cast("double"))
    cuts = order.quantiles(deltas, {"median_abs_delta": 0.5, "p90_abs_delta": 0.9}, value="abs_rank_delta").drop("unique_count")
    rest = deltas.groupBy("metric").agg(F.count(F.lit(1)).alias("n_common_authors"), F.max(d).alias("max_abs_delta"), F.avg(F.when(d <= 5, 1.0).otherwise(0.0)).alias("share_abs_delta_le_5"))
    return rest.join(F.broadcast(cuts), "metric").select("metric", "n_common_authors", "median_abs_delta", "p90_abs_delta", "max_abs_delta", "share_abs_delta_le_5")  # a row for each metric


def largest_shifts(ranked: DataFrame, baseline: str = "h", n: int = 20) -> DataFrame:
    """The ``n`` largest shifts of each metric; of ties at the edge, larger author ids (RK9)."""
    best = Window.partitionBy("metric").orderBy(F.desc("abs_rank_delta"), F.desc("author_id"))
    return rank_deltas(ranked, baseline).withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= n).drop("_rn")


def top_positions(ranked: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` authors of each metric by (rank, author id), with their position."""
    best = Window.partitionBy("metric").orderBy("rank", "author_id")
    return ranked.select("metric", "author_id", "rank").withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= limit)


def top_overlap(ranked: DataFrame, top_n: int = 100) -> DataFrame:
    """For each pair of metrics and cut: shared authors, their rate and the Jaccard similarity (RK10)."""
    cuts = sorted({10, 20, 50, top_n})
    top = top_positions(ranked, max(cuts))
    at = top.select("metric", "author_id", "pos", F.explode(F.array(*map(F.lit, cuts))).alias("cut")).filter("pos <= cut")
    sizes = at.groupBy("metric", "cut").agg(F.count(F.lit(1)).alias("n"))
    a, b = at.select(F.col("metric").alias("metric_a"), "author_id", "cut"), at.select(F.col("metric").alias("metric_b"), "author_id", "cut")
    both = a.join(b.hint("shuffle_merge"), ["author_id", "cut"]).groupBy("metric_a", "metric_b", "cut").agg(F.count(F.lit(1)).alias("overlap"))
    na, nb = sizes.select(F.col("metric").alias("metric_a"), "cut", F.col("n").alias("size_a")), sizes.select(F.col("metric").alias("metric_b"), "cut", F.col("n").alias("size_b"))
    pairs = na.join(nb.hint("shuffle_merge"), "cut").join(both.hint("shuffle_merge"), ["metric_a", "metric_b", "cut"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    available = F.least("cut", F.greatest("size_a", "size_b"))
    return pairs.select(
        "metric_a", "metric_b", F.col("cut").cast("long"), "size_a", "size_b", "overlap", F.try_divide("overlap", available).alias("overlap_rate"), F.try_divide("overlap", F.col("size_a") + F.col("size_b") - F.col("overlap")).alias("jaccard")
    )


def concentration(long: DataFrame) -> DataFrame:
    """Share of a metric's total that its first 10 and 20 authors hold (RK11)."""
    v = F.greatest(F.col("value"), F.lit(0.0))
    best = Window.partitionBy("metric").orderBy(F.desc("_v"), "author_id")
    top = long.filter("value is not null").withColumn("_v", v).withColumn("_rn", F.row_number().over(best)).filter("_rn <= 20")
    best = top.groupBy("metric").agg(F.sum(F.when(F.col("_rn") <= 10, F.col("_v"))).alias("t10"), F.sum("_v").alias("t20"))
    total = long.groupBy("metric").agg(F.sum(v).alias("total"))
    return total.join(F.broadcast(best), "metric", "left").select("metric", F.try_divide("t10", "total").alias("top10_share"), F.try_divide("t20", "total").alias("top20_share"))
