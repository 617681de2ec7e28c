"""Plans that keep the work in proportion to the input."""

import duckdb
from citegrid.operators import cohorts, credit, indices, order, ranking, stats, tables
from citegrid.operators.indices import KEYS
from citegrid.plans import catalog, sql
from citegrid.plans.catalog import STRICT, Tables
from citegrid.sources import adapter
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from test_analytics import author_rows, long

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_by_work_once(spark):
    a = adapter.authorships(spark, SMALL)
    told = credit.author_work(adapter.works(spark, SMALL), a, by_author=True)
    on_lines = [x for x in plan(told).split("\n") if "Exchange hashpartitioning(author_id" in x or "Exchange hashpartitioning(work_id" in x]
    assert len(on_lines) == 3  # lines by work, works by work, rows by author before the modes fan out
    assert plan(told).count("lineitem.parquet") == 1


def test_affiliations_are_those_of_authorships_with_one_shuffle(spark):
    told = adapter.affiliations(spark, SMALL)
    assert plan(told).count("Exchange hashpartitioning") == plan(told).count("Exchange hashpartitioning(author_id") == 1
    want = adapter.authorships(spark, SMALL).filter("author_id is not null").select(*told.columns).distinct()
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect()))


def test_publications_are_counted_without_a_group_for_each_work(spark):
    df = author_rows(spark, ("A", [9, 9, 3]))
    twice = indices.base_indices(df.unionByName(df.limit(1)))
    assert "distinct" not in plan(twice)
    assert [r.p for r in twice.collect()] == [3]


def test_selection_is_made_for_its_mode_only(spark, monkeypatch):
    made = []
    whole = credit.author_work
    monkeypatch.setattr(credit, "author_work", lambda w, a, modes=credit.MODES, **k: made.append(list(modes)) or whole(w, a, modes, **k))
    rows = Tables(spark, SMALL).strict
    assert made in ([[STRICT]], []) and {r.fraction_mode for r in rows.select("fraction_mode").distinct().collect()} == {STRICT}
    every = {r.author_id: (r.h, r.islv) for r in indices.indices(whole(adapter.works(spark, SMALL), adapter.authorships(spark, SMALL))).filter(f"fraction_mode = '{STRICT}'").collect()}
    assert {r.author_id: (r.h, round(r.islv, 9)) for r in rows.collect()} == {a: (h, round(i, 9)) for a, (h, i) in every.items()}


def test_values_on_the_edge_of_a_log_bin(spark):
    for top in (80, 728, 15624):  # edges at powers of 3 and 5
        got = [r["count"] for r in stats.histogram(long(spark, [float(i) for i in range(top + 1)]), log=True).orderBy("bin").collect()]
        low = [next(v for v in range(top + 2) if (v + 1) ** 12 >= (top + 1) ** k) for k in range(12)]
        assert got[:-1] == [b - a for a, b in zip(low[:11], low[1:], strict=True)] and sum(got) == top + 1


def test_cohort_values_on_the_edge_of_a_log_bin_as_in_sql(spark):
    for low, high in ((9, 39), (25, 103), (0, 80), (1, 127), (7, 7)):
        values = [float(i) for i in range(low, high + 1)] * 2
        rows = long(spark, values).selectExpr("author_id", "value AS m")
        got = {(r.scale, r.bin): r["count"] for r in cohorts.histograms(rows, rows, ["m"]).collect()}
        lg = "WITH lg AS (SELECT 'm' AS metric, unnest(?) AS value)"
        for scale, v in (("raw", "value"), ("log1p", "ln(1 + greatest(0, value))")):
            want = duckdb.execute(sql._histogram(v, rows=lg), [values]).fetchall()
            assert {i: n for (s, i), n in got.items() if s == scale} == {r[1]: r[4] for r in want}


def test_ranks_of_scores_that_fill_several_ranges(spark):
    values = [1.0] * 300 + [2.0] * 40 + [float(i % 5) for i in range(60)]
    rows = spark.createDataFrame([(g, f"A{i:04}", v) for g in ("x", "y", None) for i, v in enumerate(values)], "g string, author_id string, score double")
    got = order.ranks(rows, "score", [F.asc("author_id")], ["g"])
    by = Window.partitionBy("g").orderBy(F.desc("score"))
    want = rows.select("*", F.row_number().over(by.orderBy(F.desc("score"), "author_id")).cast("long"), F.rank().over(by).cast("long"), F.dense_rank().over(by).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in want.toDF(*got.columns).collect())


def test_ratings_sort_the_scores_once(spark):
    rows = spark.createDataFrame([("r", "m", "A1", "a", 2.0, 1.0, 1), ("r", "m", "A2", "b", 2.0, 3.0, 1)], "run_id string, fraction_mode string, author_id string, author_display_name string, h double, c double, p long")
    told = ranking.ratings(rows, ["h"])
    assert "SortMergeJoin" not in plan(told) and "Exchange rangepartitioning" not in plan(told)
    assert [(r.author_id, r.position, r.rank_competition, r.rank_dense) for r in told.orderBy("position").collect()] == [("A2", 1, 1, 1), ("A1", 2, 1, 1)]


def test_ranks_meet_by_author_in_one_shuffle(spark):
    rows = long(spark, [1.0, 2.0, 3.0, 5.0]).unionByName(long(spark, [2.0, 1.0, 4.0, 4.0]).withColumn("metric", F.lit("other")))
    names = [r["metric"] for r in rows.select("metric").distinct().orderBy("metric").collect()]
    told = stats.spearman(rows, [tuple(names)])
    assert plan(told).count("Exchange hashpartitioning(author_id") == 1
    assert round(told.collect()[0]["value"], 9) == round(3.5 / 22.5**0.5, 9)


def test_selection_sorts_an_authors_rows_twice(spark):
    rows = credit.author_work(adapter.works(spark, SMALL), adapter.authorships(spark, SMALL), [STRICT], by_author=True)
    fixed = {"run_id": credit.RUN, "fraction_mode": STRICT}
    told = plan(indices.base_indices(rows, once=True, fixed=fixed))
    by_author = [x for x in told.split("\n") if "Sort [author_id" in x]
    assert len(by_author) == 2, by_author  # by work, by citations
    assert "Generate" not in told and "l_extendedprice" not in told
    every = {r.author_id: r for r in indices.base_indices(rows).select(*KEYS, "p", "c", "h", "g", "i10").collect()}
    assert {r.author_id: r for r in indices.base_indices(rows, once=True, fixed=fixed).select(*KEYS, "p", "c", "h", "g", "i10").collect()} == every


def test_indices_of_chosen_works_need_no_credit_table_of_all(spark, monkeypatch):
    asked, kept = [], catalog.kept
    monkeypatch.setattr(catalog, "kept", lambda spark, source, name, make: asked.append(name) or kept(spark, source, name, make))
    t = Tables(spark, SMALL)
    got = catalog.ix21(t)
    assert "author-work" not in asked
    rule = {"cited_by_count": {"min": "20"}, "source_display_name": {"contains": "NATION_1"}}
    want = catalog._filled_index(tables.indices_of_selection("works", t.works, t.author_work, rule), "fraction_mode", "author_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
