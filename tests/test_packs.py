"""Records of packs against a whole-file parser, with documents cut into many ranges."""

import gzip
import json
import random

import pytest
from pyspark.sql.types import StructType

from citegrid.sources import packs

RECORD = StructType().add("id", "string").add("n", "long").add("title", "string")


def payloads(text, lines):
    if lines:
        rows = [json.loads(x) for x in text.split("\n") if x.strip()]
        if not all(isinstance(r, dict) for r in rows):
            raise ValueError
        return rows
    data = json.loads(text)
    if isinstance(data, dict) and isinstance(data.get("results"), list):
        data = data["results"]
    return [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]


def want(folder):
    rows, manifest = [], {}
    for f in folder.rglob("*"):
        if f.is_file() and f.suffix in (".json", ".jsonl", ".gz"):
            text = gzip.decompress(f.read_bytes()).decode() if f.suffix == ".gz" else f.read_text()
            try:
                mine = [(f.name, p["id"], p.get("n"), p.get("title")) for p in payloads(text, f.suffix != ".json") if str(p.get("id") or "").startswith("W")]
                status = "ok"
            except ValueError:
                mine, status = [], "failed"
            rows += mine
            manifest[f.name] = (f.stat().st_size, len(mine), status)
    return sorted(rows, key=repr), manifest


def some(n, seed=1):
    pick = random.Random(seed)
    odd = ['a "quoted" } bracket', "back\\slash\\\\", '\\"', "[{]}", "", "é\U0001f600", '"results": [', "line\nbreak", "}" * 9]
    return [
        {"id": pick.choice(["W", "A"]) + str(i), "n": i, "title": " ".join(pick.choice(odd) for _ in range(pick.randint(0, 5))), "more": {"results": [{"id": "Wno"}], "deep": [[{"id": "Winner"}], {"x": {}}]}}
        for i in range(n)
    ]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def compare(spark, folder):
    rows, manifest = packs.read_packs(spark, str(folder), RECORD, "W")
    got = sorted(((r.file.rsplit("/", 1)[1], r.id, r.n, r.title) for r in rows.collect()), key=repr)
    told = {r.file.rsplit("/", 1)[1]: (r.bytes, r.records, r.status) for r in manifest.collect()}
    assert (got, told) == want(folder)
    return rows


def test_documents_over_many_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "deep").mkdir()
    put = lambda name, data, **how: (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data, **how))
    put("array.json", some(120))
    put("deep/spaced.json", [[{"id": "Winner"}], 5, "W", None, *some(60, 2), [some(3)], {}], indent=3)
    put("results.json", {"meta": {"count": 3, "x": {"id": "Wmeta"}, "results": [{"id": "Wmeta"}]}, "results": some(90, 3), "group_by": [{"id": "Wgroup"}, {"id": "W" + "g" * 3000}]}, ensure_ascii=False)
    put("late.json", {"group_by": some(30, 4), "results": some(40, 5)}, indent=1)
    put("early.json", {"results": [], "group_by": some(30, 6)})
    put("one.json", {"id": "Wone", "n": 1, "title": "x" * 5000, "list": some(20, 7)}, indent=2)
    put("no_list.json", {"id": "Wmap", "results": {"a": some(20, 8)}})
    put("long.json", [{"id": "Wlong", "n": 1, "title": "no bracket " * 900}, {"id": "Wx", "title": "}" * 4000}, *some(5)])
    put("lines.jsonl", "\n\n".join(json.dumps(r) for r in some(50, 9)) + "\n")
    (tmp_path / "zipped.jsonl.gz").write_bytes(gzip.compress("\n".join(json.dumps(r) for r in some(50, 10)).encode()))
    put("notes.txt", "W")
    rows = compare(spark, tmp_path)
    assert rows.count() > 200
    states = packs._pieces(spark, [str(tmp_path / "array.json")]).mapInArrow(packs._summaries, "file string, block long, odd long, outside long, within long, first string")
    assert states.count() > 20 and states.rdd.getNumPartitions() > 20  # one document, many tasks


DOCUMENTS = ["  \n", "[]", "{}", "[1, 2]", '"W"', "7", "null", '[{"id": "W1"}', '{"id": "W1"', '[{"id": "W1}]', '[{"id": "W1", }]', '[{"id": "W1"}, {"id": W2}]', '{"results": [{"id": "W1"}]', '{"results": [{"id": "W1"}]}\n', ' [ {"id": "W1"} ] \n', '[{"id": "W9", "n": 3}]']
LINES = ['{"id": "W1"}\n{"id": \n', '{"id": "W1"}\n[1]\n', '\n {"id": "W1", "n": 4}\n\n', "\n"]


def test_small_and_damaged(spark, tmp_path):
    for i, data in enumerate(DOCUMENTS):
        (tmp_path / f"d{i}.json").write_text(data)
    for i, data in enumerate(LINES):
        (tmp_path / f"l{i}.jsonl").write_text(data)
    compare(spark, tmp_path)


def test_nothing(spark, tmp_path):
    rows, manifest = packs.read_packs(spark, str(tmp_path), RECORD, "W")
    assert rows.collect() == manifest.collect() == []
