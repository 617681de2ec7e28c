"""Kendall's tau-b against all pairs: ties, nulls, values that a third of the rows share, groups, limits."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrid.operators import concordance, stats
from citegrid.plans import catalog


def brute_discordant(x, y, w):
    return sum(w[i] * w[j] for i in range(len(x)) for j in range(len(x)) if x[i] < x[j] and y[i] > y[j])


def brute_tau(pairs):
    sign = lambda v: (v > 0) - (v < 0)
    s = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(pairs) for b in pairs[i + 1 :]]
    under = math.sqrt(sum(x * x for x, _ in s) * sum(y * y for _, y in s))
    return sum(x * y for x, y in s) / under if under else None


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 9)), max_size=40))
def test_discordant(points):
    x, y, w = (np.array([p[i] for p in points], np.int64) for i in range(3))
    assert concordance.discordant(x, y, w) == brute_discordant(x.tolist(), y.tolist(), w.tolist())
    block = x % 2
    parts = [[p for p in points if p[0] % 2 == b] for b in (0, 1)]
    assert concordance.discordant(x, y, w, block) == sum(brute_discordant(*([p[i] for p in part] for i in range(3))) for part in parts)


def test_discordant_of_many():
    n = 20_000
    assert concordance.discordant(np.arange(n), -np.arange(n), np.full(n, 3)) == 9 * n * (n - 1) // 2
    assert concordance.discordant(np.arange(n), np.arange(n) // 7, np.ones(n, np.int64)) == 0


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(8)
    value = lambda: None if pick.random() < 0.05 else 0.0 if pick.random() < 0.4 else -0.0 if pick.random() < 0.1 else round(pick.gauss(0, 3), 1)
    made = [(f"A{i}", value(), value(), float(i), 7.0, pick.choice(["x", "y", "z", None])) for i in range(400)] + [("B", 1.0, None, None, 7.0, "alone")]
    return made, spark.createDataFrame(made, "author_id string, a double, b double, c double, flat double, kind string").repartition(3)


def want(made, i, j):
    return brute_tau([(r[i], r[j]) for r in made if r[i] is not None and r[j] is not None])


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_tau_for_any_number_of_ranges(spark, rows, ranges):
    made, df = rows
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", max(4, ranges))
    try:
        got = {(r.metric_a, r.metric_b): r for r in concordance.kendall(df, ["a", "b", "c", "flat"], None, diagonal=True, ranges=ranges).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    names = ["a", "b", "c", "flat"]
    assert len(got) == 10
    for i, a in enumerate(names):
        assert got[a, a].value == 1.0 and got[a, a].n == sum(r[i + 1] is not None for r in made)
        for j in range(i + 1, 4):
            r, value = got[a, names[j]], want(made, i + 1, j + 1)
            assert not r.skipped and r.n == sum(m[i + 1] is not None and m[j + 1] is not None for m in made)
            assert r.value == (None if value is None else pytest.approx(value, abs=1e-12))


def test_limit_and_groups(rows):
    made, df = rows
    sizes = {k: [m for m in made if m[5] == k] for k in {m[5] for m in made}}
    limit = sorted(len([m for m in s if m[1] is not None and m[2] is not None]) for s in sizes.values())[2]
    got = {(r.kind, r.metric_a, r.metric_b): r for r in stats.kendall(df, ["a", "b"], limit, by=["kind"], diagonal=True).collect()}
    assert len(got) == 15
    for k, s in sizes.items():
        both = [m for m in s if m[1] is not None and m[2] is not None]
        r, value = got[k, "a", "b"], want(s, 1, 2)
        assert (r.n, r.skipped) == (len(both), len(both) > limit)
        assert r.value == (None if len(both) > limit or value is None else pytest.approx(value, abs=1e-12))
        assert got[k, "a", "a"].value == (1.0 if sum(m[1] is not None for m in s) >= 2 else None)
    assert {r.skipped for r in got.values()} == {True, False}
    over = stats.kendall(df, ["a", "b"], 10).collect()
    assert [(r.n, r.value, r.skipped) for r in over] == [(len([m for m in made if m[1] is not None and m[2] is not None]), None, True)]


def test_no_rows(rows):
    none = stats.kendall(rows[1].limit(0), ["a", "b"], diagonal=True).collect()
    assert {(r.metric_a, r.metric_b, r.n, r.value, r.skipped) for r in none} == {("a", "a", 0, None, False), ("a", "b", 0, None, False), ("b", "b", 0, None, False)}


def test_institution_of_more_authors_than_the_limit(spark):
    n = stats.KENDALL_LIMIT + 200
    people = [(f"A{i}", i % 40, i % 7, float(i * 37 % 1009)) for i in range(n)]
    at = [(a, "large") for a, *_ in people] + [(a, "small") for a, *_ in people[:30]]
    authorships = spark.createDataFrame(at, "author_id string, institution_ids_csv string")
    tables = SimpleNamespace(affiliations=authorships, strict=spark.createDataFrame(people, "author_id string, p int, h int, c_frac double"))
    got = {(r.institution, r.metric_a, r.metric_b): r for r in catalog.kendall_by_institution(tables).collect()}
    for name, rows in (("large", people), ("small", people[:30])):
        for a, b, i, j in (("p", "h", 1, 2), ("p", "c_frac", 1, 3), ("h", "c_frac", 2, 3)):
            r = got[name, a, b]
            assert (r.n, r.skipped) == (len(rows), False) and r.value == pytest.approx(brute_tau([(x[i], x[j]) for x in rows]), abs=1e-6)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 3)), max_size=60))
def test_in_blocks(points):
    x, y, b = (np.array([p[i] for p in points], np.int64) for i in range(3))
    got = concordance.in_blocks(x, y, b, 5)
    for k in range(5):
        at = [p[:2] for p in points if p[2] == k]
        pairs = [(p, q) for i, p in enumerate(at) for q in at[:i]]
        assert got["n"][k] == len(at) and got["discordant"][k] == brute_discordant([p[0] for p in at], [p[1] for p in at], [1] * len(at))
        for name, same in (("tied_x", lambda p, q: p[0] == q[0]), ("tied_y", lambda p, q: p[1] == q[1]), ("tied_both", lambda p, q: p == q)):
            assert got[name][k] == 2 * sum(same(p, q) for p, q in pairs)


def test_small_groups_are_counted_together_and_large_ones_in_ranges(spark, rows, monkeypatch):
    made, df = rows
    calls = []
    ranged = concordance._ranged
    monkeypatch.setattr(concordance, "_ranged", lambda *a: calls.append(a) or ranged(*a))
    every = {}
    for most in (1, 100, 100_000):  # all groups but one, some, none in ranges
        monkeypatch.setattr(concordance, "GROUP_ROWS", most)
        every[most] = sorted(map(str, stats.kendall(df.withColumn("other", F.lit(1.5)), ["a", "b", "c", "flat"], None, by=["kind", "other"], diagonal=True).collect()))
    assert every[1] == every[100] == every[100_000] and len(every[1]) == 50 and len(calls) == 2
