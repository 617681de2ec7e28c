"""A sorted export in parts is one CSV file if put together."""

import csv
import io as text_io

import pytest
from pyspark.sql import functions as F

from citegrid.sources import io


@pytest.mark.parametrize("rows_per_part", [7, 1000])
def test_parts_are_one_file(spark, tmp_path, rows_per_part):
    odd = ['plain', 'a "quote"', "comma, here", "line\nbreak", "", None, "é\U0001f600", " blanks "]
    made = [(i % 13, f"k{i:03}", odd[i % 8], i / 7, i % 2 == 0) for i in range(100)]
    df = spark.createDataFrame(made, "n long, k string, t string, x double, b boolean").repartition(5)
    manifest = sorted(io.export_sorted(df, str(tmp_path / "out"), [F.desc("n"), "k"], rows_per_part).collect(), key=lambda r: r.part)
    data = b""
    for r in manifest:
        part = open(r.file.removeprefix("file:"), "rb").read()
        assert (len(data), len(part)) == (r.offset, r.bytes)
        assert r.rows == sum(1 for _ in csv.reader(text_io.StringIO(part.decode(), newline="")))
        data += part
    got = list(csv.reader(text_io.StringIO(data.decode(), newline="")))
    want = sorted(made, key=lambda r: (-r[0], r[1]))
    assert got[0] == ["n", "k", "t", "x", "b"]
    assert [(int(r[0]), r[1], r[2], r[4]) for r in got[1:]] == [(n, k, t or "", str(b).lower()) for n, k, t, _, b in want]
    assert [float(r[3]) for r in got[1:]] == pytest.approx([r[3] for r in want], rel=1e-9)
    assert len(manifest) == (2 if rows_per_part == 1000 else len(manifest)) and sum(r.rows for r in manifest) == 101
    assert len(manifest) > 8 or rows_per_part == 1000


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "n long, k string")
    manifest = io.export_sorted(df, str(tmp_path / "out"), ["n"]).collect()
    assert [(r.part, r.rows, r.offset) for r in manifest if r.bytes] == [(-1, 1, 0)]
