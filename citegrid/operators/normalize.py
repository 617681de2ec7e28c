"""Nested work documents to flat tables, and their quality (NZ1-NZ17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.functions.columns import DELETED_AUTHOR, NULL_AUTHOR, short_id


def distinct_works(raw: DataFrame, order: Column | None = None) -> DataFrame:
    """One document for each id, the first in ``order``; documents without an id go (NZ1)."""
    first = Window.partitionBy("id").orderBy(order if order is not None else F.xxhash64(F.to_json(F.struct(*raw.columns))))
    return raw.filter(F.nullif("id", F.lit("")).isNotNull()).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def _valid(i: Column) -> Column:
    return i.isNotNull() & (i != "") & ~i.isin(NULL_AUTHOR, DELETED_AUTHOR)


def reported_count(raw: DataFrame) -> Column:
    """The first positive of the reported author counts, else the number seen (NZ4)."""
    told = [F.when(F.col(c).try_cast("long") > 0, F.col(c).try_cast("long")) for c in ("authors_count", "authorships_count", "author_count") if c in raw.columns]
    return F.coalesce(*told, seen_count())


def seen_count() -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.size("authorships"), F.lit(0))).cast("long")


def valid_count() -> Column:
    """Distinct ids that stand for an author (NZ6)."""
    ids = F.transform("authorships", lambda a: a["author"]["id"])
    return F.greatest(F.lit(0), F.coalesce(F.size(F.array_distinct(F.filter(ids, _valid))), F.lit(0))).cast("long")


def works(raw: DataFrame) -> DataFrame:
    """works (NZ2): one row for each document."""
    abstract = F.col("has_abstract") if "has_abstract" in raw.columns else F.lit(None).cast("boolean")
    if "abstract_inverted_index" in raw.columns:
        abstract = F.coalesce(abstract, F.col("abstract_inverted_index").isNotNull())
    topic, source = F.col("primary_topic"), F.col("primary_location.source")
    no = F.lit(False)
    return raw.select(
        F.col("id").alias("work_id"),
        F.coalesce(F.nullif("doi", F.lit("")), F.col("ids.doi")).alias("doi"),
        "display_name", "publication_year", "publication_date", "type", "language",
        F.coalesce(F.col("cited_by_count").cast("long"), F.lit(0)).alias("cited_by_count"),
        F.coalesce(F.col("open_access.is_oa"), no).alias("open_access_is_oa"),
        F.coalesce(abstract, no).alias("has_abstract"),
        *(F.coalesce(F.col(c), no).alias(c) for c in ("is_retracted", "is_paratext", "is_xpac", "is_authors_truncated")),
        reported_count(raw).alias("authors_count_reported"), seen_count().alias("authorships_count_raw"), valid_count().alias("valid_author_ids_count"),
        topic["id"].alias("primary_topic_id"), topic["display_name"].alias("primary_topic_display_name"), topic["subfield"]["id"].alias("primary_subfield_id"),
        short_id(topic["subfield"]["id"]).alias("primary_subfield_short_id"), topic["field"]["id"].alias("primary_field_id"), topic["domain"]["id"].alias("primary_domain_id"),
        source["id"].alias("source_id"), source["display_name"].alias("source_display_name"), source["type"].alias("source_type"),
    )


def _people(raw: DataFrame) -> DataFrame:
    """A row for each authorship with its 1-based place (NZ5)."""
    base = raw.select(F.col("id").alias("work_id"), F.col("authorships").alias("_all"), seen_count().alias("raw"), reported_count(raw).alias("reported"), valid_count().alias("valid"), F.coalesce("is_authors_truncated", F.lit(False)).alias("cut"), F.col("primary_topic").isNull().alias("no_topic"))
    return base.select("*", F.posexplode("_all").alias("_pos", "a")).withColumn("author_seq", (F.col("_pos") + 1).cast("long")).withColumn("author_id", F.col("a.author.id"))


def _countries() -> Column:
    """Distinct sorted countries of an authorship, else those of its institutions (NZ11)."""
    own = F.when(F.size("a.countries") > 0, F.col("a.countries"))
    codes = F.coalesce(own, F.transform("a.institutions", lambda i: i["country_code"]))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != ""))))


def authorships(raw: DataFrame) -> DataFrame:
    """authorships with weights (NZ7) and quality flags (NZ8)."""
    i = F.col("author_id")
    null, gone = i.isNull() | (i == "") | (i == NULL_AUTHOR), F.coalesce(i == DELETED_AUTHOR, F.lit(False))
    null = F.coalesce(null, F.lit(True))
    times = F.size(F.filter("_all", lambda a: a["author"]["id"] == i))
    ids = F.filter(F.transform("a.institutions", lambda x: x["id"]), lambda x: x.isNotNull() & (x != ""))
    denominator = F.when(F.col("reported") > 0, F.col("reported")).otherwise(F.col("raw"))
    return _people(raw).select(
        "work_id", "author_seq", F.col("a.author_position").alias("author_position"), "author_id", F.col("a.author.display_name").alias("author_display_name"), F.col("a.author.orcid").alias("author_orcid"),
        F.col("a.raw_author_name").alias("raw_author_name"), F.col("a.is_corresponding").alias("is_corresponding"),
        F.array_join(ids, "|").alias("institution_ids_csv"), F.array_join(_countries(), "|").alias("country_codes_csv"),
        F.col("raw").alias("authorships_count_raw"), F.col("reported").alias("authors_count_reported"), F.col("valid").alias("valid_author_ids_count"),
        F.try_divide(F.lit(1.0), denominator).alias("frac_weight_strict"), F.when(~null & ~gone, F.try_divide(F.lit(1.0), "valid")).alias("frac_weight_renorm"),
        null.alias("qf_null_author_id"), gone.alias("qf_deleted_author_id"), (F.coalesce(i != "", F.lit(False)) & (times > 1)).alias("qf_duplicate_authorship"),
        F.col("cut").alias("qf_authorship_truncated"), (F.col("reported") != F.col("raw")).alias("qf_author_count_mismatch"), F.col("no_topic").alias("qf_missing_primary_topic"),
    )


def work_topics(raw: DataFrame) -> DataFrame:
    """work_topics: a row for each topic, and the primary one if the list lacks it (NZ9)."""
    primary = F.col("primary_topic")
    topics = F.coalesce("topics", F.array().cast(raw.schema["topics"].dataType))
    missing = primary.isNotNull() & ~F.exists(topics, lambda t: t["id"] == primary["id"])
    every = F.when(missing, F.concat(topics, F.array(primary))).otherwise(topics)
    t = F.col("t")
    return raw.select(F.col("id").alias("work_id"), primary["id"].alias("_primary"), F.explode(every).alias("t")).select(
        "work_id", t["id"].alias("topic_id"), t["display_name"].alias("topic_display_name"), t["score"].alias("score"), t["subfield"]["id"].alias("subfield_id"), t["field"]["id"].alias("field_id"), t["domain"]["id"].alias("domain_id"),
        F.coalesce(t["id"] == F.col("_primary"), F.lit(False)).alias("is_primary"),
    )


def author_institutions(raw: DataFrame) -> DataFrame:
    """A row for each institution with an id of an authorship (NZ10)."""
    rows = _people(raw).select("work_id", "author_id", "author_seq", F.explode("a.institutions").alias("i"))
    return rows.filter(F.nullif(F.col("i.id"), F.lit("")).isNotNull()).select("work_id", "author_id", "author_seq", F.col("i.id").alias("institution_id"), F.col("i.display_name").alias("institution_display_name"), F.col("i.ror").alias("ror"), F.col("i.country_code").alias("country_code"), F.col("i.type").alias("institution_type"))


def author_countries(raw: DataFrame) -> DataFrame:
    return _people(raw).select("work_id", "author_id", "author_seq", F.explode(_countries()).alias("country_code"))


def quality_report(raw: DataFrame) -> DataFrame:
    """Counts of rows and quality issues (NZ12): issue, count."""
    docs = distinct_works(raw)
    people = authorships(docs)
    a = raw.agg(F.count(F.lit(1)).alias("raw_works"), F.count_if(F.nullif("id", F.lit("")).isNull()).alias("works_without_id"), (F.count("id") - F.count_distinct("id")).alias("duplicate_works"))
    w = works(docs).agg(F.count(F.lit(1)).alias("works"), F.count_if("is_authors_truncated").alias("works_truncated"), F.count_if(F.col("primary_topic_id").isNull()).alias("works_without_primary_topic"), F.count_if("is_retracted").alias("works_retracted"))
    p = people.agg(F.count(F.lit(1)).alias("authorships"), F.count_if("qf_null_author_id").alias("authorships_null_author_id"), F.count_if("qf_deleted_author_id").alias("authorships_deleted_author_id"), F.count_if("qf_duplicate_authorship").alias("authorships_duplicate_author_id"))
    out = None
    for one in (a, w, p):
        part = one.unpivot([], one.columns, "issue", "count")
        out = part if out is None else out.unionByName(part)
    return out


def quality_funnel(raw: DataFrame, indices: DataFrame) -> DataFrame:
    """From raw works to authors with indices (NZ13): stage, count."""
    docs = distinct_works(raw)
    people = authorships(docs)
    steps = [("raw_works", raw.agg(F.count(F.lit(1)).alias("count"))), ("works", docs.agg(F.count(F.lit(1)).alias("count"))), ("authorships", people.agg(F.count(F.lit(1)).alias("count")))]
    steps += [("valid_authorships", people.agg(F.count_if(_valid(F.col("author_id"))).alias("count"))), ("authors_with_indices", indices.agg(F.count_distinct("author_id").alias("count")))]
    out = None
    for i, (name, df) in enumerate(steps):
        part = df.select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "count")
        out = part if out is None else out.unionByName(part)
    return out


def truncated(raw: DataFrame) -> DataFrame:
    """Documents whose author list is cut (NZ14)."""
    return raw.filter(F.coalesce("is_authors_truncated", F.lit(False)) | (reported_count(raw) > seen_count()))


def backfilled(raw: DataFrame, candidates: DataFrame) -> DataFrame:
    """``raw`` with truncated author lists replaced by fuller ones of a candidate table (NZ15), and what
    became of each document: kept, replaced or unresolved."""
    fuller = candidates.select(F.col("id").alias("_id"), F.col("authorships").alias("_list"))
    rows = raw.withColumn("_need", F.coalesce("is_authors_truncated", F.lit(False)) | (reported_count(raw) > seen_count())).withColumn("_want", reported_count(raw))
    rows = rows.join(fuller, F.col("id") == F.col("_id"), "left")
    size = F.coalesce(F.size("_list"), F.lit(-1))
    better = F.col("_need") & (size >= seen_count()) & (size > 0) & ((size >= F.col("_want")) | (size > seen_count()))
    status = F.when(~F.col("_need"), "kept").when(better, "replaced").otherwise("unresolved")
    lists = F.when(better, F.col("_list")).otherwise(F.col("authorships"))
    cut = F.when(better & (size >= F.col("_want")), False).otherwise(F.col("is_authors_truncated"))
    return rows.select(*(lists.alias(c) if c == "authorships" else cut.alias(c) if c == "is_authors_truncated" else F.col(c) for c in raw.columns), status.alias("backfill_status"))


def backfill_summary(done: DataFrame) -> DataFrame:
    s = F.col("backfill_status")
    return done.agg(F.count_if(s != "kept").alias("attempted"), F.count_if(s == "replaced").alias("replaced"), F.count_if(s == "unresolved").alias("unresolved"))


def integrity(counts: DataFrame) -> DataFrame:
    """Error codes of a dump (NZ16) from one row: actual, expected, parse_errors, checksum, expected_checksum."""
    differs = F.col("expected_checksum").isNotNull() & ~F.col("checksum").eqNullSafe(F.col("expected_checksum"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("actual") == 0, "empty_dump"), F.when(F.col("expected").isNull(), "expected_count_missing"), F.when(F.col("actual") != F.col("expected"), "record_count_mismatch"),
            F.when(F.col("parse_errors") > 0, "parse_errors"), F.when(differs, "checksum_mismatch"),
        )
    )
    return counts.select("*", codes.alias("errors"), (F.size(codes) == 0).alias("ok"))


def eligibility(quality: DataFrame) -> DataFrame:
    """Whether an analysis may be final (NZ17), from one row: allowed, ok, truncated, backfilled, n_authors."""
    open_cut = (F.col("truncated") > 0) & ~F.col("backfilled")
    final = F.col("allowed") & F.col("ok") & ~open_cut
    reason = F.when(~F.col("ok"), "integrity_failed").when(open_cut, "truncated_authorships").when(~F.col("allowed"), "not_allowed")
    status = F.when(F.col("n_authors") == 0, "blocked").when(final, "final_reproducible").when(F.col("ok"), "pilot_ready").otherwise("exploratory")
    return quality.select("*", final.alias("final_allowed"), reason.alias("reason"), status.alias("status"))
