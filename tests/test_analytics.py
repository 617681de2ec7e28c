"""Closed forms and small known answers of the analytics operators."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citegrid.functions.columns import significant
from citegrid.operators import cohorts, credit, filters, formulas, indices, normalize, order, ranking, resampling, stats, tables
from citegrid.sources import io
from citegrid.streaming import ingest

WORKS = "work_id string, publication_year int, publication_date string, type string, cited_by_count long, is_retracted boolean"
PEOPLE = (
    "work_id string, author_id string, author_display_name string, author_seq long, authorships_count_raw long, authors_count_reported long, valid_author_ids_count long, "
    "qf_null_author_id boolean, qf_deleted_author_id boolean, qf_duplicate_authorship boolean, qf_authorship_truncated boolean, qf_author_count_mismatch boolean, qf_missing_primary_topic boolean"
)


def person(work, author, seq, raw=1, reported=None, valid=None):
    reported = raw if reported is None else reported
    return (work, author, f"Name {author}", seq, raw, reported, raw if valid is None else valid, False, False, False, reported > raw, reported != raw, False)


def test_h_and_g(spark):
    rows = [([10, 8, 5, 4, 3],), ([],), ([9, 10, 11, 0],), ([0, 0],), ([100],)]
    df = spark.createDataFrame(rows, "c array<long>").select(indices.h_index(F.col("c")).alias("h"), indices.g_index(F.col("c")).alias("g"))
    assert [tuple(r) for r in df.collect()] == [(4, 5), (0, 0), (3, 4), (0, 0), (1, 1)]


def test_credit_modes(spark):
    works = spark.createDataFrame([("W1", 2020, "2020-01-01", "article", 10, False), ("W2", 2021, None, "article", 3, False), ("W3", 2021, "2021-01-01", "article", 9, True)], WORKS)
    people = spark.createDataFrame([person("W1", "A1", 1, 2, 10), person("W1", "A2", 2, 2, 10), person("W1", "A1", 3, 2, 10), person("W2", "A1", 1, 2, 2, 1), person("W2", None, 2, 2, 2, 1), person("W3", "A1", 1)], PEOPLE)
    rows = {(r.fraction_mode, r.work_id, r.author_id): r for r in credit.author_work(works, people).collect()}
    assert len(rows) == 9
    r = rows["strict_authors_count", "W1", "A1"]
    assert (r.credit_weight, r.cited_credit, r.qf_authorship_truncated, r.qf_author_omission, r.qf_any) == (0.1, 1.0, True, True, True)
    assert rows["renorm_valid_authors", "W1", "A1"].credit_weight == 0.5
    r = rows["strict_authors_count", "W2", "A1"]
    assert (r.credit_weight, r.omitted_author_fraction) == (0.5, 0.5) and rows["renorm_valid_authors", "W2", "A1"].credit_weight == 1.0
    assert credit.author_work(works, people, modes=["integer"], since="2020-01-01").count() == 2  # a null date fails a bound
    with pytest.raises(ValueError):
        credit.author_work(works, people, modes=["other"])


def author_rows(spark, *authors):
    rows = [(f"W{a}{i}", a, "n", 2020, c, 1.0, 1.0, 1.0, 1.0, float(c), True, False, False, False, None) for a, cs in authors for i, c in enumerate(cs)]
    schema = "work_id string, author_id string, author_display_name string, publication_year int, cited_by_count long, authors_count_used double, actual_authors_count double, authors_count_reported double, credit_weight double, cited_credit double, single_authored_flag boolean, qf_any boolean, qf_authorship_truncated boolean, qf_author_omission boolean, omitted_author_fraction double"
    return spark.createDataFrame(rows, schema).withColumns({"run_id": F.lit("r"), "fraction_mode": F.lit("integer")})


def test_indices(spark):
    df = indices.indices(author_rows(spark, ("A1", [12, 5]), ("A2", [0]), ("A3", [9]), ("A4", [9]))).collect()
    got = {r.author_id: r for r in df}
    a = got["A1"]
    assert (a.p, a.cpp, a.i10, a.h, a.g, a.top1_share, a.n_cited5) == (2, 8.5, 1, 2, 2, 12 / 17, 2.0)
    assert got["A2"].iupv_s == 0 and got["A3"].iupv_s == got["A4"].iupv_s == 50.0 and a.iupv_s == 100.0
    assert got["A2"].islv > 0 and all(r.g >= r.h for r in df)
    assert indices.indices(author_rows(spark, ("A", [1])).limit(0)).count() == 0


def test_ratings_break_ties(spark):
    rows = [("r", "m", "A1", "x", 5.0, 20.0, 9), ("r", "m", "A2", "x", 5.0, 40.0, 2), ("r", "m", "A3", "x", 5.0, 40.0, 7), ("r", "m", "A4", "x", 4.0, 99.0, 99)]
    df = spark.createDataFrame(rows, "run_id string, fraction_mode string, author_id string, author_display_name string, h double, c double, p long")
    got = ranking.ratings(df, ["h"]).orderBy("position").collect()
    assert [r.author_id for r in got] == ["A3", "A2", "A1", "A4"]
    assert [r.rank_competition for r in got] == [1, 1, 1, 4] and [r.rank_dense for r in got] == [1, 1, 1, 2]


def long(spark, values, metric="m"):
    return spark.createDataFrame([(metric, f"A{i}", v) for i, v in enumerate(values)], "metric string, author_id string, value double")


def test_describe_and_boxes(spark):
    d = stats.describe(long(spark, [0.0, 0.0, 1.0, 2.0, 100.0])).first()
    assert (d.zero_rate, d["median"], d.outlier_count_iqr) == (0.4, 1.0, 1)
    flat = long(spark, [1.0, 1.0, 1.0, 1.0, 2.0])
    b = stats.boxplot(flat).first()
    assert (b.n_outliers, b.whisker_low, b.whisker_high, b.n_display_outliers) == (0, 1.0, 1.0, 1)
    assert stats.outliers(flat).count() == 0 and stats.boxplot(flat, "central95").first().n == 4
    many = long(spark, [0.0] * 30 + [1.0] * 15 + [float(v) for v in range(100, 112)])
    assert stats.outliers(many).count() == 12 and stats.boxplot_points(many).count() == 10
    assert stats.readiness(long(spark, [0.0] * 6)).first().histogram == "all_zero"
    assert sum(r["count"] for r in stats.histogram(many).collect()) == 57
    assert stats.normality(long(spark, [1.0, 1.0, 1.0])).first().jarque_bera is None


def test_labels_to_three_digits(spark):
    values = [0.0, 1.0, -2.5, 12.25, 12.75, 15.25, 99.95, 99.96, 999.4, 999.6, 1000.0, 123456.0, 1e9, 0.1, 0.25, 0.0625, 0.0001234, 0.00001234, 100.0, 2.0, -31.5, 1.005e-7]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", significant(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.3g}" for r in got]
    assert spark.range(1).select(significant(F.lit(None).cast("double")).alias("t")).first().t is None
    labels = {r.bin: r.label for r in stats.sparse_histogram(long(spark, [0.0, 3.0, 39.0, 4000.0])).collect()}
    assert labels == {0: "0-500", 7: "3.5e+03-4e+03"}
    assert [r.label for r in stats.sparse_histogram(long(spark, [7.0, 7.0])).collect()] == ["7"]


def test_outlier_points_and_rows(spark):
    values = [10.0] * 4 + [11.0, 12.0, 13.0, 14.0, -500.0, 90.0, 80.0, 80.0]
    rows = spark.createDataFrame([(f"A{i}", f"n{i}", v, 1.0 if i else 5.0) for i, v in enumerate(values)], "author_id string, author_display_name string, x double, flat double")
    points = [(r.metric, r.author_id, r.rn, r.rule) for r in stats.boxplot_points(stats.to_long(rows, ["x", "flat"]), 3).orderBy("metric", "rn").collect()]
    assert points == [("flat", "A0", 1, "iqr_zero_no_outlier_fence"), ("x", "A9", 1, "iqr_1_5"), ("x", "A10", 2, "iqr_1_5"), ("x", "A11", 3, "iqr_1_5")]
    told = {(r.metric, r.author_display_name, r.value) for r in stats.outlier_rows(rows, ["x", "flat"]).collect()}
    assert told == {("x", "n9", 90.0), ("x", "n10", 80.0), ("x", "n11", 80.0), ("x", "n8", -500.0)}
    assert stats.outlier_rows(rows.limit(0), ["x"]).count() == 0
    assert stats.descriptive_rows(rows, ["x", "flat"]).count() == 2


def test_finding_rows(spark):
    found = spark.createDataFrame([("zero_inflation:h", "zero_inflation", "h", None, "high", '{"zero_rate":0.7}')], "id string, type string, metric string, baseline_metric string, severity string, evidence string")
    row = stats.finding_rows(found).first().asDict()
    assert row == {"id": "zero_inflation:h", "type": "zero_inflation", "metric": "h", "baseline_metric": None, "severity": "high", "evidence_json": '{"zero_rate":0.7}'}


def test_tidy_tables(spark, tmp_path):
    rows = spark.createDataFrame([(f"A{i}", float(i % 7), float(i)) for i in range(30)], "author_id string, h double, x double")
    made = {p.rsplit("/", 1)[-1]: spark.read.parquet(p) for p in stats.tidy_tables(rows, ["h", "x"], f"file://{tmp_path}/tidy")}
    assert made["kendall_tau_b"].count() == made["spearman"].count() == 1 and made["rank_summary"].count() == 2
    assert made["top_overlap"].columns == ["metric_a", "metric_b", "cut", "size_a", "size_b", "overlap", "overlap_rate", "jaccard"]
    again = stats.tidy_tables(rows.limit(0), ["h", "x"], f"file://{tmp_path}/tidy")
    assert spark.read.parquet(again[5]).count() == 0


def test_correlations(spark):
    rows = spark.createDataFrame([(f"A{i}", float(i), float(2 * i), 3.0) for i in range(1, 40)], "author_id string, x double, y double, z double")
    s = {(r.metric_a, r.metric_b): r.value for r in stats.spearman(stats.to_long(rows, ["x", "y", "z"]), [("x", "y"), ("x", "z")]).collect()}
    assert s[("x", "y")] == pytest.approx(1.0) and s[("x", "z")] is None
    assert stats.kendall(rows, ["x", "y"]).first().value == pytest.approx(1.0)
    cut = stats.kendall(rows, ["x", "y"], limit=10).first()
    assert cut.value is None and cut.skipped


def test_formulas(spark):
    df = author_rows(spark, ("A1", [12, 5]), ("A2", [0]))
    ix = indices.indices(df)
    m = formulas.parse_metrics([{"id": "Mix!", "expression": "c / p + 1"}, {"id": "z", "expression": "p / (h - h) + sqrt(0 - 4)"}])
    assert [x.id for x in m] == ["custom_mix", "custom_z"]
    got = {r.author_id: (r.custom_mix, r.custom_z) for r in formulas.with_metrics(ix, m).collect()}
    assert got == {"A1": (9.5, 0.0), "A2": (1.0, 0.0)}
    for bad in ("__import__('os')", "p.q", "p if p else 1", "unknown + 1", "True", "p " * 300, "[p]"):
        with pytest.raises(ValueError):
            formulas.parse_metrics([{"id": "b", "expression": bad}])
    assert formulas.resolve_template("{a} * h", {"a": 2}) == "2.0 * h"


def test_holm_and_cohorts(spark):
    t = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03)], "metric_a string, metric_b string, p_value double")
    assert [round(r.p_holm, 6) for r in resampling.holm(t).orderBy("p_value").collect()] == [0.03, 0.06, 0.06]
    members = cohorts.manual(spark, ["A2", " A1 ", "", "A2"])
    import hashlib

    assert tuple(cohorts.checksum(members).first()) == (2, hashlib.sha256(b"A1\nA2").hexdigest())
    with pytest.raises(ValueError):
        cohorts.top_n(members, "h", 0)


def test_filters():
    f = filters.clean({"type": " article ", "country": "rus", "nothing": 1, "filter_mode": "all", "cited_by_min": "-5.5", "q": ""})
    assert f == {"work_type": "article", "country_code": "RU", "min_cited_by_count": 0}
    assert filters.clean({"min_cited_by_count": "many", "affiliation_mode": "historical", "open_access_is_oa": True}) == {"open_access_is_oa": "True"}
    assert filters.clean({"affiliation_mode": "historical", "institution_id": "I1"}) == {"affiliation_mode": "historical", "institution_id": "I1"}
    assert filters.clean({"keyword_name": "a", "author_name": "b", "source_name": "c", "source_display_name": "d"}) == {"keyword_display_name": "a", "author_display_name": "b", "source_display_name": "d"}
    with pytest.raises(ValueError):
        filters.check({"affiliation_mode": "current", "country_code": "RU"})
    assert filters.check({"author_id": "A1", "filter_mode": "topics_any"}, has_topics=False) == ["authorship_filter_local_final_policy", "topics_any_requires_work_topics"]
    assert filters.check({"affiliation_mode": "current", "filter_mode": "keyword"}) == ["current_affiliation_requires_enrichment", "keyword_local_best_effort"]


def test_cohort_context():
    assert cohorts.context({"type": "article"}, {"language": "l1"}) == ({"work_type": "article"}, "membership_filters")
    assert cohorts.context({"type": "article"}, {"language": "l1"}, "current") == ({"language": "l1"}, "analysis_override")
    assert cohorts.context({"type": "article"}, {"type": "article"}, "current")[1] == "membership_filters"
    assert cohorts.context({"type": "article"}, {}, "none") == ({}, "no_analysis_filters")
    for bad in ({"policy": "other"}, {"scope": ("r1", ""), "asked": ("r2", "")}):
        with pytest.raises(ValueError):
            cohorts.context({}, {}, **bad)


def test_keyset_and_selection(spark):
    df = spark.createDataFrame([("A1", "x", 3, 1.0, 1), ("A2", "x", 3, 1.0, 1), ("A3", "y", 1, 5.0, 1)], "author_id string, author_display_name string, h int, c double, p int")
    first = tables.query(df, "indices", sort="h", limit=2).collect()
    assert [r.author_id for r in first] == ["A1", "A2"]
    assert [r.author_id for r in tables.query(df, "indices", sort="h", limit=2, last=first[-1].asDict()).collect()] == ["A3"]
    assert tables.only_authors(df, df.limit(0)).count() == 0 and tables.only_authors(df, None).count() == 3
    assert tables.select_rows(df, {"c": {"min": "1,5"}}).first().author_id == "A3"
    with pytest.raises(ValueError):
        tables.query(df, sort="nope")
    info = {r.name: (r.type_class, r.sortable) for r in tables.column_info(df.withColumn("a", F.array("h"))).collect()}
    assert info["h"] == ("number", True) and info["author_id"] == ("text", True) and not info["a"][1]


@pytest.mark.parametrize(("limit", "offset", "told"), [(2, 0, (5, 2, True)), (2, 3, (5, 2, False)), (2, 4, (5, 1, False)), (3, 9, (5, 0, False)), (5, 0, (5, 5, False))])
def test_page_info(spark, limit, offset, told):
    df = spark.createDataFrame([(f"A{i}", None if i == 6 else "Smith", i) for i in range(7)], "author_id string, author_display_name string, h int")
    chosen = {"q": "smith", "data_filters": {"h": {"min": "1"}}}
    assert tuple(tables.page_info(df, "indices", limit=limit, offset=offset, **chosen).first()) == told
    assert tables.query(df, "indices", sort="h", limit=limit, offset=offset, **chosen).count() == told[1]
    with pytest.raises(ValueError):
        tables.page_info(df, data_filters={"nope": {}})


@pytest.mark.parametrize("direction", ["desc", "asc"])
def test_pages_by_cursor_hold_every_row(spark, direction):
    values = [None, 3, 1, None, 3, 2, 3]
    rows = [(f"A{i}", None if i % 3 == 0 else "n", h, None if i % 2 else 1.0, i % 2) for i, h in enumerate(values)]
    df = spark.createDataFrame(rows, "author_id string, author_display_name string, h int, c double, p int")
    whole = [r.author_id for r in df.orderBy(*ranking.stable_order(df.columns, "h", direction)).collect()]
    seen, last = [], None
    while page := tables.query(df, "indices", sort="h", direction=direction, limit=2, last=last).collect():
        seen += [r.author_id for r in page]
        last = tables.cursor_values(tables.cursor_text(page[-1].asDict(), df.columns, "h", direction))
    assert seen == whole and len(seen) == len(rows)
    assert tables.cursor_values("no cursor") == {}


@pytest.mark.parametrize("rows", [0, 100_000])
def test_running_sums_of_many_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(order, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame([(f"g{i % 17}" if i % 17 else None, i) for i in range(300)], "g string, v long").repartition(5)
    got = {(r.g, r.v): r.total for r in order.running(df, [F.asc("v")], ["g"], {"total": F.col("v")}).collect()}
    assert got == {(f"g{i % 17}" if i % 17 else None, i): sum(range(i % 17, i + 1, 17)) for i in range(300)}


def test_running_and_quantiles(spark):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(1).integers(0, 40, 500)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None)], "metric string, value double")
    got = {r.metric: r for r in order.quantiles(df, {"x": 0.31, "top": 1.0}).collect()}
    assert got["a"].x == pytest.approx(np.quantile(values, 0.31)) and got["a"].top == max(values) and got["a"].unique_count == len(set(values)) and got["b"].x == 1.0
    counts = {(r.metric, r.value): r.upto for r in order.value_counts(df, descending=True).collect()}
    assert all(counts["a", v] == sum(w >= v for w in values) for v in set(values))
    assert order.quantiles(df.limit(0), {"x": 0.5}).count() == 0
    p = spark.createDataFrame([(i / 1000,) for i in range(1, 1000)], "p double").select("p", stats.normal_quantile(F.col("p")).alias("q")).collect()
    assert all(abs(r.q - NormalDist().inv_cdf(r.p)) < 1e-7 for r in p)


def test_csv_text(spark):
    xs = [0.1, 1 / 3, -2.5e-7, 1e10, 9999999999.5, 1234567890.12345, 1e-4, 0.00001, 5e300, -1e22, 0.0, 100.0, float("nan"), float("inf"), None, 12345.6789]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.x for r in df.select(*io.csv_columns(df)).collect()]
    assert got == [None if x is None else f"{x:.10g}" for x in xs]
    nested = spark.sql("SELECT named_struct('b', 1, 'a', map('z', 1, 'c', 2)) AS s")
    assert nested.select(*io.csv_columns(nested)).first().s == '{"a":{"c":2,"z":1},"b":1}'


def test_names_of_a_formula():
    for _ in range(200):
        assert formulas.names_in("sqrt(c) + h * log1p(p) - pr_g") == {"c", "h", "p", "pr_g"}


def test_normalize(spark):
    work = "id string, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>>>, authors_count string, is_authors_truncated boolean"
    rows = [("W1", [(("A1", "a", None),), (("A1", "a", None),), ((None, "b", None),)], "5", False), ("W2", None, "x", None), (None, [], None, False), ("W2", None, "x", None)]
    df = normalize.distinct_works(spark.createDataFrame(rows, work))
    got = {r.id: tuple(r)[1:] for r in df.select("id", normalize.reported_count(df), normalize.seen_count(), normalize.valid_count()).collect()}
    assert got == {"W1": (5, 3, 1), "W2": (0, 0, 0)}


def test_csv_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", \n b', True, 0.1), (2, None, False, None)], "i long, t string, f boolean, d double")
    io.write_both(df, f"file://{tmp_path}/t")
    assert sorted(map(tuple, io.read_table(spark, f"file://{tmp_path}/t", df.schema).collect())) == sorted(map(tuple, df.collect()))
    back = io.read_csv(spark, f"file://{tmp_path}/t.csv", df.schema).collect()
    assert {r.i: (r.t, r.f, r.d) for r in back} == {1: ('a "q", \n b', True, 0.1), 2: (None, False, None)}
    assert io.fingerprint(df).collect() == io.fingerprint(df.repartition(3)).collect()


def test_incremental_ingest(spark, tmp_path):
    schema = StructType().add("id", "string").add("n", "long")
    base = f"file://{tmp_path}"
    for rows in ([("a", 1), ("b", 2), (None, 7), (None, 8)], [("b", 3), ("c", 4)], []):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").json(f"{base}/in")
        ingest.ingest(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state")
    got = spark.read.schema(schema).parquet(f"{base}/out").collect()
    assert sorted((r.id or "", r.n) for r in got) == [("", 7), ("", 8), ("a", 1), ("b", 2), ("c", 4)]
    assert sum(r.records for r in ingest.manifest(spark, f"{base}/out", schema).collect()) == 5
