"""Author indices (IX1-IX19)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.operators import order
from citegrid.sources.scratch import settled

KEYS = ["run_id", "fraction_mode", "author_id"]
SCOPE = ["run_id", "fraction_mode"]
METRICS = ("p", "c", "c_frac", "cpp", "h", "i10", "g", "m_local", "top1_share", "rfi_log_frac", "n_cited5", "frac_cited5", "pci", "iupv_s", "iupv_sb", "islv", "lrdi")
#: Weights of the balanced index.
ISLV_WEIGHTS = {"h": 0.35, "c_frac": 0.30, "g": 0.20, "i10": 0.10, "p": 0.05}


def percentile_rank(df: DataFrame, fields: dict[str, str], scope: list[str] = SCOPE, floor: float = 1e-6) -> DataFrame:
    """Adds for each field its positive-only percentile: 0 up to 0, else the average rank among the positive
    values over their number (IX15).

    Ranks come from running counts of distinct values of all fields at once. Values that agree to nine decimals
    are tied. ``df`` must give the same values each time it is read (see :func:`citegrid.sources.scratch.settled`);
    ``scope`` and the author name its rows."""
    if not fields:
        return df
    keys = [*scope, "author_id"]
    values = [F.round(F.col(f).cast("double"), 9).alias(out) for f, out in fields.items()]
    long = df.select(*keys, *values).unpivot(keys, list(fields.values()), "_field", "_value").filter("_value > 0")
    counts = order.value_counts(long, [*scope, "_field"], "_value")
    sizes = long.groupBy(*scope, "_field").agg(F.count(F.lit(1)).alias("_size"))
    rank = F.greatest(F.lit(floor), (F.col("upto") - (F.col("times") - 1) / 2) / F.col("_size"))
    ranks = counts.join(F.broadcast(sizes), [*scope, "_field"]).select(*scope, "_field", "_value", rank.alias("_rank"))  # a row for each scope and field
    told = long.join(ranks.hint("shuffle_merge"), [*scope, "_field", "_value"]).groupBy(*keys).agg(*(F.max(F.when(F.col("_field") == out, F.col("_rank"))).alias(out) for out in fields.values()))
    return df.join(told.hint("shuffle_merge"), keys, "left").fillna(0.0, list(fields.values()))


def base_indices(author_work: DataFrame, p0: float = 5.0, decay: float = 0.15, year: int = 2026, once: bool = False, fixed: Mapping[str, str] | None = None) -> DataFrame:
    """All indices that need an author's own works only (IX1-IX14): one shuffle by author, a sort by work, of which only
    the first row counts for p, and one by citations. So no aggregation holds a group for each work.

    ``once`` says that a mode has one row for each author and work, as :func:`citegrid.operators.credit.author_work`
    makes them; then all rows count for p without the sort by work. ``fixed`` names keys that have one value in all rows:
    grouped by a constant, Spark would sort the rows once more."""
    fixed = fixed or {}
    keys = [k for k in KEYS[::-1] if k not in fixed]  # sorted by author first, as most rows differ there
    best = Window.partitionBy(*keys).orderBy(F.greatest("cited_by_count", F.lit(0)).desc(), "work_id")
    rank = F.row_number().over(best)
    cited = F.greatest(F.col("cited_by_count"), F.lit(0))
    same = Window.partitionBy(*keys, "work_id").orderBy("cited_by_count")
    first = F.lit(True) if once else F.row_number().over(same) == 1
    rows = author_work.withColumn("_first", first & F.col("work_id").isNotNull())
    rows = rows.withColumns({"_rank": rank, "_sum": F.sum(cited).over(best.rowsBetween(Window.unboundedPreceding, 0))})
    years = F.when(F.col("publication_year") > 0, F.col("publication_year"))
    age = F.greatest(F.lit(0), year - years)
    weight = F.log1p(cited.cast("double")) / F.greatest(F.lit(1.0), F.col("authors_count_used")) * F.exp(-decay * F.coalesce(age, F.lit(0)))
    actual = F.greatest(F.lit(1.0), F.coalesce("actual_authors_count", "authors_count_reported", "authors_count_used", F.lit(1.0)))
    p, c = F.count_if("_first"), F.sum("cited_by_count")
    span = F.greatest(F.lit(1), F.coalesce(F.max(years) - F.min(years) + 1, F.lit(1)))
    h = F.coalesce(F.max(F.when(cited >= F.col("_rank"), F.col("_rank"))), F.lit(0)).cast("long")
    name = F.when(F.col("author_display_name") != "", F.col("author_display_name"))
    done = rows.groupBy(*keys).agg(
        F.min_by(name, F.when(name.isNotNull(), F.col("work_id"))).alias("author_display_name"),
        p.alias("p"),
        c.cast("double").alias("c"),
        F.sum("cited_credit").alias("c_frac"),
        F.coalesce(F.try_divide(c.cast("double"), p.cast("double")), F.lit(0.0)).alias("cpp"),
        h.alias("h"),
        F.count_if(F.col("cited_by_count") >= 10).alias("i10"),
        F.coalesce(F.max(F.when(F.col("_sum") >= F.col("_rank") * F.col("_rank"), F.col("_rank"))), F.lit(0)).cast("long").alias("g"),
        (h / span).alias("m_local"),
        F.coalesce(F.try_divide(F.max("cited_by_count").cast("double"), c.cast("double")), F.lit(0.0)).alias("top1_share"),
        F.sum(F.log1p(F.greatest(F.lit(0.0), F.col("cited_credit")))).alias("rfi_log_frac"),
        F.count_if(F.col("cited_by_count") >= 5).cast("double").alias("n_cited5"),
        F.coalesce(F.sum(F.when(F.col("cited_by_count") >= 5, F.col("credit_weight"))), F.lit(0.0)).alias("frac_cited5"),
        (p / (p + p0) * F.sum(weight)).alias("lrdi"),
        F.avg(actual).alias("mean_authors_per_work"),
        F.avg(F.when(F.col("single_authored_flag"), 1.0).otherwise(0.0)).alias("share_single_authored"),
        F.count_if("qf_any").alias("n_flagged_works"),
        F.count_if("qf_authorship_truncated").alias("n_truncated_works"),
    )
    return done.select(*(F.lit(fixed[k]).alias(k) if k in fixed else k for k in KEYS[::-1]), *done.columns[len(keys) :])


def islv(ranks: dict[str, Column], top1: Column, epsilon: float = 0.01, tau: float = 0.5, penalty: float = 0.3) -> Column:
    """Weighted geometric mean of percentiles, less where one work holds most citations (IX18)."""
    logs = sum((w * F.log(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ranks[m]) + epsilon)) for m, w in ISLV_WEIGHTS.items()), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top1))
    damped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - penalty * F.greatest(F.lit(0.0), share - tau)))
    return 100 * F.exp(logs) * damped


def composites(base: DataFrame) -> DataFrame:
    """Adds the percentile composites (IX16-IX18)."""
    pr = {m: f"_pr_{m}" for m in ("p", "h", "c_frac", "g", "i10", "rfi_log_frac")}
    df = percentile_rank(base, pr)
    r = {m: F.col(n) for m, n in pr.items()}
    positive = (F.col("p") > 0) & (F.col("h") > 0) & (F.col("c_frac") > 0)
    some = F.col("rfi_log_frac") > 0
    return df.withColumns(
        {
            "pci": F.when(positive, 100 * F.pow(r["p"] * r["h"] * r["c_frac"], F.lit(1 / 3))).otherwise(0.0),
            "iupv_s": F.when(some, 100 * r["rfi_log_frac"]).otherwise(0.0),
            "iupv_sb": F.when(some, 100 * F.sqrt(r["p"] * r["rfi_log_frac"])).otherwise(0.0),
            "islv": islv(r, F.col("top1_share")),
        }
    ).drop(*pr.values())


def indices(author_work: DataFrame, p0: float = 5.0, decay: float = 0.15, year: int = 2026, once: bool = False, fixed: Mapping[str, str] | None = None) -> DataFrame:
    """The whole table of author indices (IX19); ``once`` and ``fixed`` as in :func:`base_indices`."""
    done = composites(settled(base_indices(author_work, p0, decay, year, once, fixed), "indices-base"))
    tail = ["mean_authors_per_work", "share_single_authored", "n_flagged_works", "n_truncated_works"]
    return done.select(*KEYS, "author_display_name", *METRICS, *tail)


# Closed forms on arrays, for one author at a time inside an expression.
def h_index(citations: Column) -> Column:
    """h of an array of citations."""
    ranked = F.reverse(F.array_sort(F.transform(citations, lambda c: F.greatest(c, F.lit(0)))))
    return F.size(F.filter(ranked, lambda c, i: c >= i + 1))


def g_index(citations: Column) -> Column:
    """g of an array of citations, at most the number of works."""
    ranked = F.reverse(F.array_sort(F.transform(citations, lambda c: F.greatest(c, F.lit(0)).cast("long"))))
    enough = F.transform(ranked, lambda _, i: F.aggregate(F.slice(ranked, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b) >= (i + 1) * (i + 1))
    return F.coalesce(F.array_max(F.transform(enough, lambda ok, i: F.when(ok, i + 1))), F.lit(0))


