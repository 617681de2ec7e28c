"""Table queries: selection, search, sort, paging, details, catalogs (P1-P19) and affiliation roll-ups (IX20-IX23)."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrid.functions.columns import any_of, short_id, to_double
from citegrid.operators import credit, filters, formulas, indices, ranking

#: The columns that a text is looked for in.
SEARCHABLE = {
    "indices": ("author_display_name", "author_id", "orcid"),
    "ratings": ("author_display_name", "author_id", "metric_name"),
    "works": ("display_name", "doi", "work_id", "source_display_name", "primary_topic_display_name"),
    "authorships": ("author_display_name", "author_id", "work_id", "institution_display_name"),
    "author_work": ("author_display_name", "author_id", "work_id", "work_display_name"),
    "work_topics": ("work_id", "topic_display_name", "subfield_display_name", "field_display_name"),
    "author_institutions": ("work_id", "author_id", "institution_id", "institution_display_name", "country_code"),
    "author_countries": ("work_id", "author_id", "country_code"),
}


def type_class(kind: str) -> str:
    if kind == "boolean":
        return "boolean"
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return "number"
    return "date" if kind in ("date", "timestamp", "timestamp_ntz") else "text"


def column_info(df: DataFrame) -> DataFrame:
    """Each column's class and whether it can be sorted and filtered (P12)."""
    rows = [(n, type_class(k), not k.startswith(("array", "struct", "map")), not k.startswith(("array", "struct", "map", "binary"))) for n, k in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "name string, type_class string, sortable boolean, filterable boolean")


def validate(df: DataFrame, sort: str = "", data_filters: Mapping[str, Mapping] | None = None) -> None:
    """Unknown, unsortable or unfilterable columns are errors (P13)."""
    kinds = dict(df.dtypes)
    for name in [*([sort] if sort else []), *(data_filters or {})]:
        if name not in kinds:
            raise ValueError(f"unknown column: {name}")
        if kinds[name].startswith(("array", "struct", "map")):
            raise ValueError(f"column cannot be sorted or filtered: {name}")


def column_filter(data_filters: Mapping[str, Mapping], columns: Sequence[str], alias: str = "", ignore_unknown: bool = False) -> Column:
    """``{column: {contains, min, max}}`` as a condition (P2); on a joined table with its alias (P3)."""
    ok = F.lit(True)
    for name, rule in data_filters.items():
        if name not in columns:
            if ignore_unknown:
                continue
            raise ValueError(f"unknown column: {name}")
        c = F.col(f"{alias}.{name}" if alias else name)
        if rule.get("contains"):
            ok = ok & filters.like(c.cast("string"), str(rule["contains"]))
        for key, test in (("min", lambda a, b: a >= b), ("max", lambda a, b: a <= b)):
            if rule.get(key) not in (None, ""):
                ok = ok & F.coalesce(test(to_double(c), to_double(F.lit(str(rule[key])))), F.lit(False))
    return ok


def search(q: str, columns: Sequence[str], alias: str = "", least: int = 2) -> Column:
    """A text in any of the columns (P4, P5); shorter texts than ``least`` match everything."""
    q = q.strip()
    if len(q) < least:
        return F.lit(True)
    return any_of([filters.like(F.col(f"{alias}.{c}" if alias else c).cast("string"), q) for c in columns])


def related_authors(rows: DataFrame, relation: DataFrame, column: str, text: str) -> DataFrame:
    """Rows of authors that have a country or institution in another table (P6)."""
    hit = relation.filter(filters.like(F.col(column), text)).select("author_id").distinct()
    return rows.join(hit, "author_id", "left_semi")


def after(columns: Sequence[str], sort: str, direction: str, last: Mapping[str, object]) -> Column:
    """Rows that come after the one with the values ``last`` in the stable order (P8). Nulls stand where the order
    puts them: last in the chosen column, else first where ascending and last where descending."""
    order = [(sort, direction == "desc", True)] + [(c, d, d) for c, d in (("c", True), ("p", True), ("author_display_name", False), ("author_id", False), ("work_id", False)) if c in columns and c != sort]
    out, equal = F.lit(False), F.lit(True)
    for name, down, nulls_last in order:
        c, v = F.col(name), F.lit(last[name])
        if last[name] is None:
            past = F.lit(False) if nulls_last else c.isNotNull()
        else:
            past = F.coalesce(c < v if down else c > v, F.lit(nulls_last))
        out = out | (equal & past)
        equal = equal & c.eqNullSafe(v)
    return out


def cursor_text(row: Mapping[str, object], columns: Sequence[str], sort: str, direction: str = "desc") -> str:
    """A page's last row as an opaque text, from which :func:`cursor_values` gives ``last`` for the next page."""
    names = [sort, *(c for c in ("c", "p", "author_display_name", "author_id", "work_id") if c in columns and c != sort)]
    plain = lambda v: v if v is None or isinstance(v, (str, int, float, bool)) else str(v)
    told = {"v": 1, "sort": sort, "direction": direction, "values": {n: plain(row[n]) for n in names}}
    return base64.urlsafe_b64encode(json.dumps(told, ensure_ascii=False).encode()).decode().rstrip("=")


def cursor_values(text: str) -> dict[str, object]:
    """The values of a cursor; none if it can't be read."""
    try:
        return dict(json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))["values"])
    except (ValueError, KeyError, TypeError):
        return {}


def matching(df: DataFrame, table: str = "", q: str = "", data_filters: Mapping[str, Mapping] | None = None, **equals: str) -> DataFrame:
    """The rows of a table under exact filters, column filters and search, in no order."""
    for name, value in equals.items():
        if value and name in df.columns:
            df = df.filter(F.col(name) == value)
    return df.filter(column_filter(data_filters or {}, df.columns)).filter(search(q, [c for c in SEARCHABLE.get(table, df.columns) if c in df.columns]))


def page_info(df: DataFrame, table: str = "", q: str = "", data_filters: Mapping[str, Mapping] | None = None, limit: int = 100, offset: int = 0, **equals: str) -> DataFrame:
    """What goes with a page of :func:`query` (P1): the number of all matching rows, of those on the page, and whether others follow.
    One count, without a sort."""
    validate(df, "", data_filters)
    left = F.greatest(F.col("total") - offset, F.lit(0))
    told = matching(df, table, q, data_filters, **equals).agg(F.count(F.lit(1)).alias("total"))
    return told.select("total", F.least(left, F.lit(limit)).cast("long").alias("page_rows"), (left > limit).alias("has_next"))


def query(df: DataFrame, table: str = "", q: str = "", data_filters: Mapping[str, Mapping] | None = None, sort: str = "", direction: str = "desc", limit: int = 100, offset: int = 0, last: Mapping[str, object] | None = None, select: Sequence[str] = (), **equals: str) -> DataFrame:
    """One page of a table (P1): exact filters, column filters, search, stable order, columns in table order (P9)."""
    validate(df, sort, data_filters)
    df = matching(df, table, q, data_filters, **equals)
    if sort:
        if last:
            df = df.filter(after(df.columns, sort, direction, last))
        df = df.orderBy(*ranking.stable_order(df.columns, sort, direction))
    page = (df.offset(offset) if offset else df).limit(limit)
    return page.select(*(c for c in df.columns if c in select)) if select else page


def select_rows(rows: DataFrame, data_filters: Mapping[str, Mapping] | None = None, text: str = "", sort: str = "", direction: str = "desc", limit: int = 0) -> DataFrame:
    """Selection on author rows (P10): unknown filters are ignored, numbers sort before text, missing last."""
    rows = rows.filter(column_filter(data_filters or {}, rows.columns, ignore_unknown=True)).filter(search(text, rows.columns, least=1))
    if sort and sort in rows.columns:
        c = F.col(sort)
        keys = [to_double(c), F.lower(c.cast("string"))]
        rows = rows.orderBy(F.isnull(c), *(k.desc_nulls_last() if direction == "desc" else k.asc_nulls_last() for k in keys), "author_id")
    return rows.limit(limit) if limit else rows


def only_authors(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of a set of authors (P11): no set is everyone, an empty set is no one."""
    return rows if ids is None else rows.join(ids.select("author_id").distinct(), "author_id", "left_semi")


def author_detail(author: str, indices_table: DataFrame, ratings: DataFrame, author_work: DataFrame, works: DataFrame, limit: int = 100, offset: int = 0) -> dict[str, DataFrame]:
    """An author's indices, ratings and works (P14)."""
    mine = author_work.filter(F.col("author_id") == author).select("work_id").distinct()
    return {
        "indices": indices_table.filter(F.col("author_id") == author).orderBy("fraction_mode"),
        "ratings": ratings.filter(F.col("author_id") == author).orderBy("fraction_mode", "metric_name"),
        "works": works.join(mine.hint("shuffle_merge"), "work_id", "left_semi").select("work_id", "display_name", "publication_year", "cited_by_count").orderBy(F.desc("cited_by_count"), "work_id").offset(offset).limit(limit),
    }


def work_detail(work: str, works: DataFrame, authorships: DataFrame, author_work: DataFrame, limit: int = 500, offset: int = 0) -> dict[str, DataFrame]:
    """A work, its authorships by sequence and its credit rows by mode (P15)."""
    this = F.col("work_id") == work
    return {"work": works.filter(this), "authorships": authorships.filter(this).orderBy("author_seq").offset(offset).limit(limit), "author_work": author_work.filter(this).orderBy("fraction_mode", "author_id")}


def upsert(catalog: DataFrame, new: DataFrame, keys: Sequence[str] = ("entity_type", "entity_id"), by: str = "updated_at") -> DataFrame:
    """A catalog with new entries; of one key the last written stays (P16)."""
    both = catalog.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_new")


def search_catalog(catalog: DataFrame, kind: str, q: str = "", limit: int = 8) -> DataFrame:
    """Entries with a text in name, ids or description, by number of works (P17)."""
    text = q.strip().lower()
    hit = any_of([F.coalesce(F.lower(c).contains(text), F.lit(False)) for c in (F.col("name"), short_id(F.col("entity_id")), F.col("entity_id"), F.col("external_id"), F.col("description"))]) if text else F.lit(True)
    return catalog.filter((F.col("entity_type") == kind) & hit).orderBy(F.desc("works_count"), "name", "entity_id").limit(limit)


def search_aliases(presets: DataFrame, q: str, limit: int = 8) -> DataFrame:
    """Presets with a text in value, label, description or aliases, in their order (P18); needs two characters."""
    text = q.strip().lower()
    if len(text) < 2:
        return presets.limit(0)
    return presets.filter(F.lower(F.concat_ws(" ", "value", "label", "description", "aliases")).contains(text)).orderBy("position").limit(limit)


def catalog_status(catalog: DataFrame) -> DataFrame:
    """Entries of each type (P19)."""
    return catalog.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy("entity_type")


def affiliations(authorships: DataFrame) -> DataFrame:
    """Countries and institutions of each author on a work, distinct and sorted (IX22)."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, r"[|]"))))), "|")
    return authorships.groupBy("work_id", "author_id").agg(joined("country_codes_csv").alias("country_codes"), joined("institution_ids_csv").alias("institution_ids"))


def filtered_indices(author_work: DataFrame, works: DataFrame, authorships: DataFrame, topics: DataFrame, slice_filters: Mapping[str, object], mode: str = "") -> DataFrame:
    """Indices computed anew on a filtered slice, with percentiles over it (IX20), and the countries seen there."""
    rows = author_work.filter(F.col("fraction_mode") == mode) if mode else author_work
    rows = filters.filtered_author_work(rows, works, authorships, topics, slice_filters)
    done = indices.indices(rows)
    # The first place and subject that an author's works name, in the order of their ids; none leave null.
    people = rows.select("work_id", "author_id").distinct()
    places = affiliations(authorships.join(people, ["work_id", "author_id"], "left_semi")).select("work_id", "author_id", "country_codes")
    told = people.join(places.hint("shuffle_merge"), ["work_id", "author_id"], "left").join(works.select("work_id", "primary_topic_display_name").hint("shuffle_merge"), "work_id", "left")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("work_id")))
    told = told.groupBy("author_id").agg(first("country_codes").alias("country_code"), first("primary_topic_display_name").alias("subject_name"))
    scope = [F.lit("filtered_recomputed").alias("metric_scope"), F.lit("current filtered author set").alias("percentile_scope")]
    return done.join(told.hint("shuffle_merge"), "author_id", "left").select(*done.columns, "country_code", "subject_name", *scope)


def chosen(table: DataFrame, data_filters: Mapping[str, Mapping], text: str = "") -> DataFrame:
    """The rows of a table that meet column filters and hold a text."""
    return table.filter(column_filter(data_filters, table.columns)).filter(search(text, table.columns, least=1))


def indices_of_works(works: DataFrame, authorships: DataFrame, data_filters: Mapping[str, Mapping], text: str = "") -> DataFrame:
    """Indices computed anew from a selection of works (IX21). A work's credit depends on that work only, so it is dealt for
    the chosen works, without a credit table of all."""
    return indices.indices(credit.author_work(chosen(works, data_filters, text), authorships, by_author=True), once=True, fixed={"run_id": credit.RUN})


def indices_of_selection(kind: str, table: DataFrame, author_work: DataFrame, data_filters: Mapping[str, Mapping], text: str = "") -> DataFrame:
    """Indices computed anew from a selection of works, credit rows, authorships or topics (IX21), where the credit table is
    at hand."""
    hit = chosen(table, data_filters, text)
    on = ["work_id", "author_id"] if kind in ("author_work", "authorships") else ["work_id"]
    return indices.indices(author_work.join(hit.select(*on).distinct().hint("shuffle_merge"), on, "left_semi"))


def selected_indices(precomputed: DataFrame, author_work: DataFrame, works: DataFrame, authorships: DataFrame, topics: DataFrame, mode: str, slice_filters: Mapping[str, object] | None = None, ids: DataFrame | None = None, custom: Sequence[formulas.Metric] = ()) -> DataFrame:
    """The author rows of a request (IX23): the stored indices where no work filter is set, else computed anew."""
    f = filters.clean(slice_filters)
    rows = filtered_indices(author_work, works, authorships, topics, f, mode).drop("country_code", "subject_name", "metric_scope", "percentile_scope") if f else precomputed.filter(F.col("fraction_mode") == mode)
    return only_authors(formulas.with_metrics(rows, custom), ids)


def bundle(rows: DataFrame, metric: str, limit: int = 20) -> dict[str, DataFrame]:
    """Distribution, ranking and line series of one selection (RK7)."""
    from citegrid.operators import stats

    return {"distribution": stats.distribution(stats.to_long(rows, [metric])), "ranking": ranking.metric_ranking(rows, metric, limit), "series": ranking.line_series(rows, metric)}
