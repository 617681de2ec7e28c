"""Bootstrap and permutation against plain Python with the same draws; ranges, samples, constants and small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrid.operators import resampling

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(6)
    made = [(f"A{i:03}", float(pick.randint(0, 9)), pick.gauss(0, 1) + i / 40, 3.0, pick.randint(1, 5), pick.randint(1, 5)) for i in range(151)]
    return made, spark.createDataFrame(made, "author_id string, a double, b double, flat double, c long, p long").repartition(4)


def ranks(made, i):
    return {r[0]: k + 1 for k, r in enumerate(sorted(made, key=lambda r: (-r[i], -r[4], -r[5], r[0])))}


def number(*parts, at=0):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[15 * at : 15 * at + 15], 16)


def brute_bootstrap(made, iterations, size, seed):
    ids, found = sorted(r[0] for r in made), []
    order = {m: sorted(ids, key=ranks(made, i + 1).get) for i, m in enumerate(NAMES)}
    for it in range(iterations):
        times = dict.fromkeys(ids, 0)
        for k in range(size):
            times[ids[number(seed, it, k // 2, at=k % 2) % len(ids)]] += 1
        drawn = [i for i in ids if times[i]]
        upto = {}
        for m in NAMES:
            total = 0
            for i in order[m]:
                total += times[i]
                upto[m, i] = total
        found.append(np.corrcoef([upto["a", i] for i in drawn], [upto["b", i] for i in drawn])[0, 1])
    return np.quantile(found, [0.025, 0.975])


@pytest.mark.parametrize(("size", "per_range"), [(0, 10**6), (0, 20), (40, 7)])
def test_bootstrap(rows, size, per_range):
    made, df = rows
    r = resampling.bootstrap(df, [("a", "b")], iterations=30, seed=5, sample_size=size, rows_per_range=per_range).first()
    low, high = brute_bootstrap(made, 30, size or len(made), 5)
    assert (r.iterations, r.sample_size, r.status) == (30, size or len(made), "ok")
    assert (r.ci_low, r.ci_high) == (pytest.approx(low, abs=1e-9), pytest.approx(high, abs=1e-9))
    x, y = ranks(made, 1), ranks(made, 2)
    assert r.estimate == pytest.approx(np.corrcoef([x[i] for i in x], [y[i] for i in x])[0, 1], abs=1e-9)


@pytest.mark.parametrize("cells", [1, 100, 1 << 21])
def test_bootstrap_keeps_a_row_for_each_author(rows, monkeypatch, cells):
    made, df = rows
    told, write = {}, resampling.settled
    monkeypatch.setattr(resampling, "settled", lambda d, name: told.setdefault(name, write(d, name)))
    monkeypatch.setattr(resampling, "CELLS", cells, raising=False)
    r = resampling.bootstrap(df, [("a", "b")], iterations=30, seed=5, rows_per_range=20).first()
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(brute_bootstrap(made, 30, len(made), 5)), abs=1e-9)
    assert told["resample"].count() <= len(made)


def test_bootstrap_of_constants_and_few(rows):
    df = rows[1]
    r = {x.metric_b: x for x in resampling.bootstrap(df, [("a", "flat"), ("a", "b")], iterations=10).collect()}
    assert (r["flat"].status, r["flat"].iterations, r["flat"].estimate, r["flat"].ci_low) == ("constant_metric", 0, None, None)
    assert r["b"].status == "ok"
    assert resampling.bootstrap(df.limit(2), [("a", "b")]).collect() == []


@pytest.mark.parametrize("top_n", [1, 20, 500])
def test_permutation(rows, top_n):
    made, df = rows
    size = min(top_n, len(made))
    first = [{i for i, k in ranks(made, j).items() if k <= size} for j in (1, 2)]
    seen, lists = len(first[0] & first[1]), []
    for it in range(1, 51):
        lists.append(sorted((number(9, it, r[0]), r[0]) for r in made)[:size])
    extreme = sum(len(first[0] & {i for _, i in chosen}) >= seen for chosen in lists)
    got = {x.metric_b: x for x in resampling.permutation(df, [("a", "b"), ("flat", "a")], top_n=top_n, iterations=50, seed=9).collect()}
    r = got["b"]
    assert (r.top_n, r.overlap, r.overlap_rate, r.p_value, r.iterations, r.status) == (size, seen, pytest.approx(seen / size), pytest.approx((extreme + 1) / 51), 50, "ok")
    assert r.p_holm == pytest.approx(r.p_value) and (got["a"].status, got["a"].p_value, got["a"].p_holm) == ("constant_metric", None, None)


def test_a_threshold_too_low_is_raised(rows, monkeypatch):
    """Numbers that lie high: the first threshold keeps none, and the result is that of all rows."""
    made, df = rows
    number_of = resampling._number
    want = {tuple(r) for r in resampling.permutation(df, [("a", "b")], top_n=5, iterations=20).collect()}
    monkeypatch.setattr(resampling, "_number", lambda *parts, at=None: (number_of(*parts, at=at) / 2**6).cast("long") + F.lit(2**60 - 2**54))
    tight = resampling.permutation(df, [("a", "b")], top_n=5, iterations=20)
    assert {tuple(r) for r in tight.collect()} == want


def test_one_author(rows):
    assert resampling.permutation(rows[1].limit(1), [("a", "b")]).collect() == []
