"""Author-work credit table (AW1-AW6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.functions.columns import DELETED_AUTHOR, NULL_AUTHOR, any_of

MODES = ("strict_authors_count", "renorm_valid_authors", "integer")
RUN = "base"


def guard(works: DataFrame, retracted: bool = True, paratext: bool = True, keep_xpac: bool = False, types: Sequence[str] = (), since: str = "", until: str = "") -> Column:
    """The works that count (SL3): those not excluded; a null date fails a date bound. A column that the
    table lacks excludes nothing."""
    ok = F.lit(True)
    for name, on in (("is_retracted", retracted), ("is_paratext", paratext), ("is_xpac", not keep_xpac)):
        if on and name in works.columns:
            ok = ok & ~F.coalesce(F.col(name), F.lit(False))
    if types and "type" in works.columns:
        ok = ok & F.coalesce(F.col("type").isin(*types), F.lit(False))
    if "publication_date" in works.columns:
        date = F.col("publication_date")
        if since:
            ok = ok & F.coalesce(date >= since, F.lit(False))
        if until:
            ok = ok & F.coalesce(date <= until, F.lit(False))
    return ok


def first_authorships(joined: DataFrame) -> DataFrame:
    """One authorship for each work and author, the first by sequence (AW2)."""
    order = Window.partitionBy("author_id", "work_id").orderBy(F.col("author_seq").asc_nulls_last(), "author_display_name")
    return joined.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def author_work(works: DataFrame, authorships: DataFrame, modes: Sequence[str] = MODES, run_id: str = RUN, by_author: bool = False, **guards) -> DataFrame:
    """A row for each work, valid author and fraction mode, with the credit that the mode gives.

    Works are filtered before the join; the modes fan out after the only shuffles (works by id, then
    authorships by work and author). ``by_author`` deals the rows by author first, for what groups by author next:
    one sort there finds an author's first place on each work."""
    for m in modes:
        if m not in MODES:
            raise ValueError(f"unknown fraction mode: {m}")
    chosen = works.filter(guard(works, **guards)).select("work_id", "publication_year", "cited_by_count")
    flags = ["qf_null_author_id", "qf_deleted_author_id", "qf_duplicate_authorship", "qf_authorship_truncated", "qf_author_count_mismatch", "qf_missing_primary_topic"]
    people = authorships.filter(F.nullif("author_id", F.lit("")).isNotNull() & ~F.col("author_id").isin(NULL_AUTHOR, DELETED_AUTHOR)).select(
        "work_id", "author_id", "author_display_name", "author_seq", "authorships_count_raw", "authors_count_reported", "valid_author_ids_count", *flags
    )
    base = people.join(chosen.hint("shuffle_hash"), "work_id")
    base = first_authorships(base.repartition("author_id") if by_author else base)
    raw, valid = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("authorships_count_raw", "valid_author_ids_count"))
    reported = F.coalesce(F.when(F.col("authors_count_reported") > 0, F.col("authors_count_reported").cast("double")), raw)
    base = base.withColumns({"raw": raw, "valid": valid, "reported": reported, "mode": F.explode(F.array(*map(F.lit, modes))) if len(modes) > 1 else F.lit(*modes)})
    mode = F.col("mode")
    used = F.when(mode == "strict_authors_count", F.col("reported")).when(mode == "renorm_valid_authors", F.col("valid")).otherwise(1.0)
    strict = mode == "strict_authors_count"
    omitted = F.when(strict, F.greatest(F.lit(0.0), 1.0 - F.try_divide("valid", "reported")))
    cited = F.coalesce(F.col("cited_by_count").cast("double"), F.lit(0.0))
    return base.withColumn("used", used).filter("used > 0").select(
        F.lit(run_id).alias("run_id"),
        mode.alias("fraction_mode"),
        "work_id",
        "author_id",
        "author_display_name",
        "publication_year",
        F.coalesce(F.col("cited_by_count"), F.lit(0)).cast("long").alias("cited_by_count"),
        F.col("used").alias("authors_count_used"),
        F.col("reported").alias("actual_authors_count"),
        F.col("reported").alias("authors_count_reported"),
        (1.0 / F.col("used")).alias("credit_weight"),
        (cited * (1.0 / F.col("used"))).alias("cited_credit"),
        (F.col("reported") == 1).alias("single_authored_flag"),
        any_of([F.coalesce(f, F.lit(False)) for f in flags]).alias("qf_any"),
        (F.coalesce("qf_authorship_truncated", F.lit(False)) | (F.col("reported") > F.col("raw"))).alias("qf_authorship_truncated"),
        (strict & ((F.coalesce(omitted, F.lit(0.0)) > 0) | F.coalesce("qf_author_count_mismatch", F.lit(False)))).alias("qf_author_omission"),
        omitted.alias("omitted_author_fraction"),
    )
