"""Distributions, correlations and findings (DS1-DS24).

The operators work on a long table (metric, author_id, value): a metric's statistics are one grouped
aggregation, so any number of metrics is one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.functions.columns import significant
from citegrid.operators import concordance, order, ranking
from citegrid.sources.scratch import settled, ship

#: Finding thresholds.
THRESHOLDS = {"skewness": (1.0, 2.0), "kurtosis": (3.0, 10.0), "normality_p": (0.05, 0.01), "zero_rate": (0.30, 0.60), "tie_rate": (0.30, 0.60)}
DEPENDENCE = {"publication_volume_dependence": (0.70, 0.85), "citation_volume_dependence": (0.80, 0.90), "top1_dominance_dependence": (0.50, 0.70)}
FACTORS = {
    "publication_volume_dependence": "p",
    "citation_volume_dependence": "c",
    "fractional_citation_dependence": "c_frac",
    "top1_dominance_dependence": "top1_share",
    "collaboration_size_dependence": "mean_authors_per_work",
}
INSTABILITY = {"share": 0.20, "high_share": 0.40, "jaccard": 0.50, "high_jaccard": 0.30}
AGREEMENT = {"spearman": 0.90, "jaccard": 0.70}
KENDALL_LIMIT = 1000
CORE, DIAGNOSTIC, EXPERIMENTAL = ("p", "c", "c_frac", "cpp", "h", "i10", "g"), ("m_local", "top1_share", "rfi_log_frac", "n_cited5", "frac_cited5"), ("pci", "iupv_s", "iupv_sb", "islv", "lrdi")


def to_long(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    wide = rows.select("author_id", *(F.col(m).cast("double").alias(m) for m in metrics))
    return wide.unpivot(["author_id"], list(metrics), "metric", "value")


def metric_group(metric: Column) -> Column:
    return F.when(metric.isin(*CORE), "core").when(metric.isin(*DIAGNOSTIC), "diagnostic").when(metric.isin(*EXPERIMENTAL), "experimental").otherwise("custom")


def distribution(long: DataFrame) -> DataFrame:
    """Summary with the sample standard deviation (DS1)."""
    v = F.col("value")
    cuts = order.quantiles(long, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9})
    rest = long.filter(v.isNotNull()).groupBy("metric").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_samp(v).alias("stddev"), F.count_if(v == 0).alias("zero_count"), (F.count_if(v == 0) / F.count(v)).alias("zero_rate")
    )
    return rest.join(F.broadcast(cuts), "metric").select("metric", "n", "min", "q1", "median", "mean", "q3", "p90", "max", "stddev", "unique_count", "zero_count", "zero_rate")  # a row for each metric


def readiness(long: DataFrame) -> DataFrame:
    """Whether a histogram and a box plot can be drawn (DS3)."""
    v = F.col("value")
    s = long.groupBy("metric").agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    s = s.join(F.broadcast(order.quantiles(long, {"q1": 0.25, "q3": 0.75})), "metric", "left")  # a row for each metric

    def state(least: int, box: bool) -> Column:
        c = F.when(F.col("n") == 0, "no_data").when(F.col("n") < least, "not_enough_rows").when((F.col("lo") == 0) & (F.col("hi") == 0), "all_zero").when(F.col("lo") == F.col("hi"), "constant_values")
        return (c.when(F.col("q1") == F.col("q3"), "zero_iqr") if box else c).otherwise("ok")

    return s.select("metric", state(3, False).alias("histogram"), state(5, True).alias("boxplot"))


def describe(long: DataFrame) -> DataFrame:
    """Descriptive block with the population standard deviation (DS4)."""
    v = F.col("value")
    some = long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_total"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"),
        F.skewness(v).alias("s"), F.kurtosis(v).alias("k"), F.count_if(v == 0).alias("zeros"),
    )
    cuts = order.quantiles(long, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    some = some.join(F.broadcast(cuts), "metric", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))  # a row for each metric
    varies = F.coalesce(F.col("stddev") > 0, F.lit(False))
    some = some.select(
        "metric", "n", (F.col("n_total") - F.col("n")).alias("missing"), "min", "max", "mean", "stddev", "q1", "median", "q3", "p90", "p95", "p99",
        F.try_divide("stddev", "mean").alias("coefficient_of_variation"), (F.col("q3") - F.col("q1")).alias("iqr"), F.when(varies, F.col("s")).alias("skewness"), F.when(varies, F.col("k")).alias("excess_kurtosis"),
        "unique_count", F.try_divide("zeros", "n").alias("zero_rate"), F.try_divide(F.col("n") - F.col("unique_count"), F.col("n")).alias("tie_rate"),
    )
    fence = some.select("metric", (F.col("q1") - 1.5 * F.col("iqr")).alias("lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("hi"), (F.col("iqr") > 0).alias("on"))
    out = long.join(F.broadcast(fence), "metric").groupBy("metric").agg(F.count_if(F.col("on") & ((v < F.col("lo")) | (v > F.col("hi")))).alias("outlier_count_iqr"))  # a row for each metric
    return some.join(F.broadcast(out), "metric").withColumn("outlier_share_iqr", F.try_divide("outlier_count_iqr", "n"))


def fences(long: DataFrame) -> DataFrame:
    v = F.col("value")
    f = long.filter(v.isNotNull()).groupBy("metric").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    f = f.join(F.broadcast(order.quantiles(long, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("unique_count")), "metric")  # a row for each metric
    iqr = F.col("q3") - F.col("q1")
    return f.withColumns({"iqr": iqr, "lower_fence": F.when(iqr > 0, F.col("q1") - 1.5 * iqr), "upper_fence": F.when(iqr > 0, F.col("q3") + 1.5 * iqr)})


def boxplot(long: DataFrame, view: str = "all") -> DataFrame:
    """Quartiles, whiskers and outlier counts (DS5); ``view`` may be all, nonzero or central95 (DS6)."""
    v = F.col("value")
    rows = long.filter(v.isNotNull())
    if view == "nonzero":
        rows = rows.filter(v != 0)
    elif view == "central95":
        cut = order.quantiles(rows, {"a": 0.025, "b": 0.975}).drop("unique_count")
        rows = rows.join(F.broadcast(cut), "metric").filter(v.between(F.col("a"), F.col("b"))).drop("a", "b")  # a row for each metric
    f = fences(rows)
    inside = v.between(F.coalesce("lower_fence", v), F.coalesce("upper_fence", v))
    flat = F.col("iqr") == 0
    return rows.join(F.broadcast(f), "metric").groupBy("metric").agg(
        F.count(v).alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"), F.max("iqr").alias("iqr"), F.max("lower_fence").alias("lower_fence"), F.max("upper_fence").alias("upper_fence"),
        F.when(F.max(flat), F.max("q1")).otherwise(F.min(F.when(inside, v))).alias("whisker_low"), F.when(F.max(flat), F.max("q3")).otherwise(F.max(F.when(inside, v))).alias("whisker_high"),
        F.count_if(~flat & ~inside).alias("n_outliers"), F.count_if(flat & (v != F.col("median"))).alias("n_display_outliers"),
        F.max(F.when(flat, "iqr_zero_no_outlier_fence").otherwise("iqr_1_5")).alias("outlier_rule"),
    )


def boxplot_points(long: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` outliers of each metric from the greatest value on, or values off the median where the quartiles meet
    (DS5), with the fences and the rule."""
    v = F.col("value")
    rows = long.filter(v.isNotNull()).join(F.broadcast(fences(long)), "metric")
    flat = F.col("iqr") == 0
    rows = rows.filter((flat & (v != F.col("median"))) | (~flat & ((v < F.col("lower_fence")) | (v > F.col("upper_fence")))))
    greatest = Window.partitionBy("metric").orderBy(F.desc(v), "author_id")  # with a limit, which Spark takes into each task
    rule = F.when(flat, "iqr_zero_no_outlier_fence").otherwise("iqr_1_5")
    return rows.withColumn("rn", F.row_number().over(greatest)).filter(F.col("rn") <= n).select("metric", "author_id", "value", "rn", "lower_fence", "upper_fence", rule.alias("rule"))


def outliers(long: DataFrame) -> DataFrame:
    """Every value outside the fences; none where the quartiles meet (DS8)."""
    v = F.col("value")
    rows = long.join(F.broadcast(fences(long).filter("iqr > 0")), "metric").filter((v < F.col("lower_fence")) | (v > F.col("upper_fence")))
    return rows.select("metric", "author_id", "value", "lower_fence", "upper_fence", F.when(v < F.col("lower_fence"), "low").otherwise("high").alias("side"), F.lit("iqr_1_5").alias("rule"))


def _log1p(spark: SparkSession) -> Callable[[Column], Column]:
    """The C library's ``log(1 + x)``, 0 for negative values: Spark's own logarithm differs from it in the last bit of some values."""
    ship(spark)

    @F.arrow_udf("double")
    def logs(values: pa.Array) -> pa.Array:
        return pa.array([math.log(1.0 + max(x, 0.0)) for x in values.to_pylist()], pa.float64())

    return logs


def histogram(long: DataFrame, bins: int = 12, log: bool = False, snap: bool = True) -> DataFrame:
    """Equal bins between the least and the greatest value, empty ones too (DS7); one bin if all are equal.

    A value on an edge belongs to the bin above. Logarithms are not exact, so with ``log`` a value is on an edge if it is to
    nine decimals of a bin's width: of 0 to 80 in twelve bins, 26 is the edge below the last three. Without ``snap`` it is where
    its logarithm as computed puts it, as in CH7; that is taken once for each different value."""
    bins = max(1, min(bins, 50))
    exact = log and not snap
    rows = long.filter("value is not null")
    if exact:
        rows = rows.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("times"))
        rows = settled(rows.select("metric", "times", _log1p(long.sparkSession)(F.col("value")).alias("v")), "logs")
    else:
        v = F.log1p(F.greatest(F.lit(0.0), F.col("value"))) if log else F.col("value")
        rows = rows.select("metric", v.alias("v"), F.lit(1).alias("times"))
    bounds = rows.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bounds = bounds.withColumn("n_bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins)).withColumn("width", width)
    place = F.try_divide(F.col("v") - F.col("lo"), F.col("width"))
    at = F.when(F.col("width") == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.round(place, 9) if log and snap else place))).cast("int")
    counts = rows.join(F.broadcast(bounds), "metric").groupBy("metric", at.alias("bin")).agg(F.sum("times").alias("count"))
    every = bounds.select("metric", "lo", "hi", "width", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    edge = F.when(F.col("bin") == F.col("n_bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width"))
    return every.join(counts.hint("shuffle_hash"), ["metric", "bin"], "left").select("metric", F.col("bin").cast("long"), (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), edge.alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def sparse_histogram(long: DataFrame, bins: int = 8) -> DataFrame:
    """The bins that have values (DS2), each with a label of its bounds to three digits, or of its value if all are equal."""
    low, high = F.col("low"), F.col("high")
    label = F.when(low == high, significant(low)).otherwise(F.concat_ws("-", significant(low), significant(high)))
    return histogram(long, bins).filter("count > 0").withColumn("label", label)


def normality(long: DataFrame, log: bool = False) -> DataFrame:
    """Skewness, excess kurtosis, Jarque-Bera and its p; null below 3 values or without variance (DS9)."""
    v = F.log1p(F.greatest(F.lit(0.0), F.col("value"))) if log else F.col("value")
    s = long.groupBy("metric").agg(F.count("value").alias("n"), F.stddev_pop(v).alias("sd"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k"))
    ok = (F.col("n") >= 3) & (F.col("sd") > 0)
    jb = F.when(ok, F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4))
    return s.select("metric", "n", F.when(ok, F.col("s")).alias("skewness"), F.when(ok, F.col("k")).alias("excess_kurtosis"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p_approx"))


def qq_points(long: DataFrame, most: int = 101) -> DataFrame:
    """Up to ``most`` evenly spaced order statistics and the normal quantiles they stand against (DS10).

    Order statistics come from running counts of distinct values."""
    counts = order.value_counts(long)
    totals = counts.groupBy("metric").agg(F.max("upto").alias("total"))
    points = F.least(F.lit(most), F.col("total")).cast("int")
    place = F.when(points == 1, 0).otherwise(F.bround(F.col("i") * (F.col("total") - 1) / (points - 1))).cast("long")
    wanted = totals.select("metric", "total", F.explode(F.sequence(F.lit(0), points - 1)).alias("i")).select("metric", "total", place.alias("index")).distinct()
    met = (F.col("index") >= F.col("upto") - F.col("times")) & (F.col("index") < F.col("upto"))
    at = counts.join(F.broadcast(wanted), "metric").filter(met)  # most rows for each metric
    return at.select("metric", F.col("index").cast("long"), normal_quantile((F.col("index") + 0.5) / F.col("total")).alias("theoretical"), F.col("value").alias("sample"))


#: Coefficients of the published approximation of the normal quantile.
QUANTILE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00),
)


def normal_quantile(p: Column) -> Column:
    """Where the standard normal distribution reaches ``p`` in (0, 1): a published rational
    approximation with a relative error below 1.2e-9."""
    a, b, c, d = QUANTILE

    def poly(x: Column, terms: Sequence[float], last: float | None = None) -> Column:
        out = F.lit(terms[0])
        for t in [*terms[1:], *([] if last is None else [last])]:
            out = out * x + t
        return out

    tail = lambda q: poly(q, c) / poly(q, d, 1.0)
    q = p - 0.5
    middle = q * poly(q * q, a) / poly(q * q, b, 1.0)
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def average_ranks(long: DataFrame) -> DataFrame:
    """Average rank of each value, ascending (DS11), from counts of distinct values."""
    ranks = order.value_counts(long).select("metric", "value", (F.col("upto") - (F.col("times") - 1) / 2).alias("avg_rank"))
    return long.join(ranks.hint("shuffle_merge"), ["metric", "value"]).select("metric", "author_id", "value", "avg_rank")


def _moments(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One pass over the authors for all pairs: n, sums, squares and products where both have a value."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a), F.col(b)
        both = x.isNotNull() & y.isNotNull()
        pick = lambda c, both=both: F.sum(F.when(both, c))
        aggs += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), pick(x).alias("x"), pick(y).alias("y"), pick(x * x).alias("xx"), pick(y * y).alias("yy"), pick(x * y).alias("xy")).alias(f"s{i}")]
    one = wide.agg(*aggs)
    return one.select(F.explode(F.array(*(f"s{i}" for i in range(len(pairs))))).alias("s")).select("s.*")


def _correlation() -> Column:
    """Pearson's r of a row of moments; null below 2 values or without variance."""
    n = F.col("n").cast("double")
    vx, vy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    r = F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    return F.when((F.col("n") >= 2) & (vx > 1e-9) & (vy > 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _pairs(metrics: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]


def spearman(long: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation of average ranks (DS12): metric_a, metric_b, value."""
    names = sorted({m for p in pairs for m in p})
    wide = average_ranks(long).groupBy("author_id").agg(*(F.max(F.when(F.col("metric") == m, F.col("avg_rank"))).alias(m) for m in names))
    return _moments(wide, pairs).select(F.col("a").alias("metric_a"), F.col("b").alias("metric_b"), "n", _correlation().alias("value"))


def pearson_log1p(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Correlation of log1p of the values (DS13)."""
    wide = rows.select(*(F.log1p(F.greatest(F.lit(0.0), F.col(m).cast("double"))).alias(m) for m in metrics))
    return _moments(wide, _pairs(metrics)).select(F.col("a").alias("metric_a"), F.col("b").alias("metric_b"), "n", _correlation().alias("value"))


def kendall(rows: DataFrame, metrics: Sequence[str], limit: int | None = KENDALL_LIMIT, by: Sequence[str] = (), diagonal: bool = False) -> DataFrame:
    """Exact tau-b, null and marked skipped above ``limit`` authors; ``limit=None`` counts for any number (DS14)."""
    return concordance.kendall(rows, metrics, limit, by, diagonal)


def pairwise(rows: DataFrame, metrics: Sequence[str], baseline: str = "h", top_n: int = 100, kendall_limit: int | None = KENDALL_LIMIT) -> DataFrame:
    """All pairs of metrics with three correlations, overlaps and shifts against the baseline (DS15)."""
    long = to_long(rows, metrics)
    ranked = ranking.competition_ranks(long)
    keys = ["metric_a", "metric_b"]
    s = spearman(long, _pairs(metrics)).select(*keys, F.col("value").alias("spearman"))
    p = pearson_log1p(rows, metrics).select(*keys, F.col("value").alias("pearson_log1p"))
    k = kendall(rows, metrics, kendall_limit).select(*keys, F.col("value").alias("kendall_tau_b"))
    o = ranking.top_overlap(ranked, top_n).groupBy(*keys).agg(*(F.max(F.when(F.col("cut") == c, F.col("overlap_rate"))).alias(f"top{c}_overlap_rate") for c in (10, 20, 50)))
    d = ranking.rank_delta_summary(ranked, baseline).drop("n_common_authors")
    out = s.join(p.hint("shuffle_hash"), keys).join(k.hint("shuffle_hash"), keys).join(o.hint("shuffle_hash"), keys, "left")
    other = F.when(F.col("metric_a") == baseline, F.col("metric_b")).when(F.col("metric_b") == baseline, F.col("metric_a"))
    return out.withColumn("metric", other).join(d.hint("shuffle_hash"), "metric", "left").drop("metric").withColumns({"group_a": metric_group(F.col("metric_a")), "group_b": metric_group(F.col("metric_b"))})


def rank_summary(long: DataFrame) -> DataFrame:
    """A row for each metric: group, statistics and shares of the first authors (DS16)."""
    d = describe(long).select("metric", F.col("n").alias("n_authors"), "mean", "median", "stddev", "min", F.col("q1").alias("p25"), F.col("q3").alias("p75"), "p90", "p95", "p99", "max", "zero_rate", "tie_rate", "unique_count", "outlier_share_iqr")
    return d.join(ranking.concentration(long).hint("shuffle_hash"), "metric").withColumn("metric_group", metric_group(F.col("metric")))


def scorecard(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Dependence of each metric on five factors (DS17): metric, factor label, rho, direction; and the metric's shares of ties, zeros
    and outliers and its variation."""
    pairs = [(m, f) for m in metrics for f in FACTORS.values() if m != f]
    names = sorted({*metrics, *FACTORS.values()})
    label = F.create_map(*(x for k, v in FACTORS.items() for x in (F.lit(v), F.lit(k))))
    rho = F.col("value")
    direction = F.when(rho.isNull(), None).when(rho > 0, "positive").when(rho < 0, "negative").otherwise("none")
    found = spearman(to_long(rows, names), pairs).select(F.col("metric_a").alias("metric"), label[F.col("metric_b")].alias("factor"), rho.alias("spearman_rho"), F.abs(rho).alias("abs_spearman_rho"), direction.alias("direction"))
    shares = describe(to_long(rows, metrics)).select("metric", "tie_rate", "zero_rate", "outlier_share_iqr", "coefficient_of_variation")
    return found.join(shares.hint("shuffle_hash"), "metric", "left")


def findings(rows: DataFrame, metrics: Sequence[str], baseline: str = "h", top_n: int = 100) -> DataFrame:
    """Threshold rules (DS18): id, type, metric, baseline_metric, severity, evidence (JSON)."""
    long = to_long(rows, metrics)
    none = F.lit(None).cast("string")

    def told(df: DataFrame, kind: str, severity: Column, evidence: Column, prefix: str = "", base: Column = none) -> DataFrame:
        name = F.concat_ws(":", F.lit(prefix or kind), base, F.col("metric"))
        return df.select(name.alias("id"), F.lit(kind).alias("type"), "metric", base.alias("baseline_metric"), severity.alias("severity"), F.to_json(evidence).alias("evidence"))

    level = lambda high: F.when(high, "high").otherwise("medium")
    d = describe(long).join(normality(long).select("metric", "jarque_bera_p_approx").hint("shuffle_hash"), "metric")
    d = settled(d, "finding-shapes")  # several rules read these tables
    s, k, jp = F.abs("skewness"), F.col("excess_kurtosis"), F.col("jarque_bera_p_approx")
    t = THRESHOLDS
    heavy = [F.coalesce((s >= t["skewness"][i]) | (k >= t["kurtosis"][i]) | (jp < t["normality_p"][i]), F.coalesce(s >= t["skewness"][i], F.lit(False)) | F.coalesce(k >= t["kurtosis"][i], F.lit(False)) | F.coalesce(jp < t["normality_p"][i], F.lit(False))) for i in (0, 1)]
    out = told(d.filter(heavy[0]), "heavy_tail_distribution", level(heavy[1]), F.struct("skewness", "excess_kurtosis", "jarque_bera_p_approx"), "heavy_tail")
    for kind, column, prefix in (("zero_inflation", "zero_rate", ""), ("high_tie_rate", "tie_rate", "tie_rate")):
        out = out.unionByName(told(d.filter(F.col(column) >= t[column][0]), kind, level(F.col(column) >= t[column][1]), F.struct(column), prefix))
    card = settled(scorecard(rows, metrics), "finding-scorecard")
    for kind, (least, high) in DEPENDENCE.items():
        rho = F.col("abs_spearman_rho")
        out = out.unionByName(told(card.filter((F.col("factor") == kind) & (rho >= least)), kind, level(rho >= high), F.struct("abs_spearman_rho", "spearman_rho", "direction")))
    spark = rows.sparkSession
    info = F.lit("informational")
    one = spark.range(1)
    for m, kind in (("p", "productivity_metric"), ("c", "citation_volume_metric")):
        if m in metrics:
            out = out.unionByName(told(one.select(F.lit(m).alias("metric")), kind, info, F.struct(F.lit(kind).alias("metric_role")), "metric_identity"))
    for m in ("islv", "iupv_s"):
        if m in metrics:
            out = out.unionByName(told(one.select(F.lit(m).alias("metric")), "balanced_candidate_metric", info, F.struct(F.lit(True).alias("uses_percentile_components")), "balanced_candidate"))
    ranked = settled(ranking.competition_ranks(long), "finding-ranks")
    pair = ranking.top_overlap(ranked, top_n).filter((F.col("cut") == top_n) & (F.col("metric_a") == baseline)).select(F.col("metric_b").alias("metric"), "jaccard")
    others = [m for m in metrics if m != baseline]
    rho = spearman(long, [(baseline, m) for m in others]).select(F.col("metric_b").alias("metric"), F.col("value").alias("spearman"))
    n = rows.agg(F.count(F.lit(1)).alias("n_authors"))
    shift = ranking.rank_delta_summary(ranked, baseline).join(pair.hint("shuffle_hash"), "metric").join(rho.hint("shuffle_hash"), "metric").crossJoin(F.broadcast(n))  # one row
    shift = settled(shift, "finding-shifts")
    p90, j, size = F.col("p90_abs_delta"), F.col("jaccard"), F.col("n_authors")
    unstable = (p90 >= F.greatest(F.lit(5.0), INSTABILITY["share"] * size)) | (j < INSTABILITY["jaccard"])
    high = (p90 >= F.greatest(F.lit(10.0), INSTABILITY["high_share"] * size)) | (j < INSTABILITY["high_jaccard"])
    out = out.unionByName(told(shift.filter(unstable), "rank_instability", level(high), F.struct("median_abs_delta", "p90_abs_delta", "jaccard", "n_authors"), base=F.lit(baseline)))
    agree = (F.col("spearman") >= AGREEMENT["spearman"]) & (j >= AGREEMENT["jaccard"])
    out = out.unionByName(told(shift.filter(agree), "rank_agreement", info, F.struct("spearman", "jaccard"), base=F.lit(baseline)))
    return out.join(F.broadcast(n.filter("n_authors > 0").select()))  # nothing is found without authors


def severity_order(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def finding_summary(found: DataFrame) -> DataFrame:
    """Counts by severity, candidates and the first eight limitations (DS19)."""
    first = F.struct(severity_order(F.col("severity")).alias("o"), "type", "metric", "id")
    limits = F.collect_list(F.when(F.col("severity").isin("high", "medium") & (F.col("type") != "balanced_candidate_metric"), first))
    return found.agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("severity") == "high").alias("high_count"), F.count_if(F.col("severity") == "medium").alias("medium_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == "balanced_candidate_metric", F.col("metric")))), ",").alias("candidate_metrics"),
        F.array_join(F.transform(F.slice(F.array_sort(limits), 1, 8), lambda x: x["id"]), ",").alias("limitations"),
    )


def conclusion_evidence(found: DataFrame) -> DataFrame:
    """For each role of a conclusion the findings and metrics that support it (DS20)."""
    kind = F.col("type")
    correction = (kind == "top1_dominance_dependence") & (F.get_json_object("evidence", "$.direction") == "negative")
    role = (
        F.when(kind == "heavy_tail_distribution", "distribution_limits").when(kind.isin("high_tie_rate", "zero_inflation"), "index_limitations").when(correction, "correction_effects")
        .when(kind.isin(*DEPENDENCE), "dependence_limits").when(kind.isin("rank_instability", "rank_agreement"), "rank_comparison").when(kind == "balanced_candidate_metric", "candidate_metric")
    )
    roles = found.withColumn("role", role).filter("role is not null").groupBy("role").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("evidence_finding_ids"), F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("evidence_metrics"))
    n = found.agg(F.count(F.lit(1)).alias("n"))
    fixed = n.select(F.explode(F.when(F.col("n") == 0, F.array(F.lit("scope"), F.lit("no_data"), F.lit("final_caution"))).otherwise(F.array(F.lit("scope"), F.lit("final_caution")))).alias("role"), F.lit("").alias("evidence_finding_ids"), F.lit("").alias("evidence_metrics"))
    return roles.unionByName(fixed)


def warnings(rows: DataFrame, metrics: Sequence[str], top_n: int = 100) -> DataFrame:
    """What makes an analysis weak (DS21): code, detail."""
    long = to_long(rows, metrics)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    size = F.col("n")
    codes = F.array_compact(F.array(F.when(size == 0, "no_authors").when(size < 5, "under_5_authors").when(size < 20, "under_20_authors"), F.when(size > top_n, "rank_cut"), F.when(size > KENDALL_LIMIT, "kendall_skipped")))
    by_size = n.select(F.explode(codes).alias("code"), F.lit("").alias("detail"))
    box = fences(long).filter("iqr = 0").select(F.lit("zero_iqr").alias("code"), F.col("metric").alias("detail"))
    empty = long.groupBy("metric").agg(F.count("value").alias("n")).filter("n = 0").select(F.lit("no_values").alias("code"), F.col("metric").alias("detail"))
    return by_size.unionByName(box).unionByName(empty)


def analysis(rows: DataFrame, metrics: Sequence[str], baseline: str = "h", top_n: int = 100) -> dict[str, DataFrame]:
    """Every block of the analysis on one selection (DS22), which the caller may persist first."""
    long = settled(to_long(rows, metrics), "analysis-long")
    ranked = settled(ranking.competition_ranks(long), "analysis-ranked")
    found = settled(findings(rows, metrics, baseline, top_n), "analysis-findings")  # several blocks read each
    return {
        "descriptive": describe(long), "boxplots": boxplot(long), "boxplots_nonzero": boxplot(long, "nonzero"), "boxplots_central": boxplot(long, "central95"),
        "histograms": histogram(long), "histograms_log1p": histogram(long, log=True), "chart_readiness": readiness(long), "normality": normality(long), "normality_log1p": normality(long, log=True),
        "spearman": spearman(long, _pairs(metrics)), "pearson_log1p": pearson_log1p(rows, metrics), "kendall_tau_b": kendall(rows, metrics), "rank_deltas": ranking.rank_delta_summary(ranked, baseline),
        "largest_shifts": ranking.largest_shifts(ranked, baseline), "top_overlap": ranking.top_overlap(ranked, top_n), "pairwise": pairwise(rows, metrics, baseline, top_n), "rank_summary": rank_summary(long),
        "scorecard": scorecard(rows, metrics), "findings": found, "finding_summary": finding_summary(found), "conclusion": conclusion_evidence(found), "warnings": warnings(rows, metrics, top_n),
    }


def tidy_tables(rows: DataFrame, metrics: Sequence[str], folder: str, baseline: str = "h", top_n: int = 100, kendall_limit: int | None = KENDALL_LIMIT) -> list[str]:
    """The long result tables of a selection written as Parquet (DS23); gives their paths. Ranks are made once."""
    long = settled(to_long(rows, metrics), "tidy-long")
    ranked = settled(ranking.competition_ranks(long), "tidy-ranked")
    made = {
        "chart_readiness": readiness(long),
        "spearman": spearman(long, _pairs(metrics)),
        "pearson_log1p": pearson_log1p(rows, metrics),
        "kendall_tau_b": kendall(rows, metrics, kendall_limit),
        "top_overlap": ranking.top_overlap(ranked, top_n),
        "rank_deltas": ranking.rank_delta_summary(ranked, baseline),
        "rank_summary": rank_summary(long),
    }
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in made]


def outlier_rows(rows: DataFrame, metrics: Sequence[str], n: int = 10) -> DataFrame:
    """The first outliers of each metric as export rows, with names (DS24); none where the quartiles meet."""
    points = boxplot_points(to_long(rows, metrics), n).filter("rule = 'iqr_1_5'").drop("rn")
    names = rows.select("author_id", "author_display_name")
    return names.join(F.broadcast(points), "author_id").select("metric", "author_id", "author_display_name", "value", "rule", "lower_fence", "upper_fence")  # n rows for each metric


def finding_rows(found: DataFrame) -> DataFrame:
    """Findings as export rows, the evidence as text (DS24)."""
    return found.select("id", "type", "metric", "baseline_metric", "severity", F.col("evidence").alias("evidence_json"))


def descriptive_rows(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A row of figures for each metric (DS24)."""
    return describe(to_long(rows, metrics))


def correlation_rows(rows: DataFrame, metrics: Sequence[str], kendall_limit: int | None = KENDALL_LIMIT) -> DataFrame:
    """Correlations as export rows: method, left, right, value (DS24)."""
    long = to_long(rows, metrics)
    each = {"spearman": spearman(long, _pairs(metrics)), "pearson_log1p": pearson_log1p(rows, metrics), "kendall_tau_b": kendall(rows, metrics, kendall_limit)}
    out = None
    for method, df in each.items():
        part = df.select(F.lit(method).alias("method"), F.col("metric_a").alias("left"), F.col("metric_b").alias("right"), "value")
        out = part if out is None else out.unionByName(part)
    return out
