"""Checksums of files, small and large."""

import hashlib
import os

import pytest

from citegrid.sources import io


@pytest.mark.parametrize("cell_bytes", [0, 5, 1 << 26])
def test_checksums_by_cell_and_by_stream(spark, tmp_path, cell_bytes):
    made = {"a.bin": b"12345", "b c.bin": b"x" * 9, "d%20é.bin": os.urandom(3000), "deep=1.bin": b"1"}
    (tmp_path / "in").mkdir()
    for name, data in made.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.file: (r.bytes, r.sha256) for r in io.file_checksums(spark, str(tmp_path / "in"), cell_bytes).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in made.items()}


def test_checksum_of_a_file_larger_than_a_cell_can_be(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "big.bin", "wb") as f:
        f.write(b"begin")
        f.truncate(size)
    whole, zeros = hashlib.sha256(b"begin"), bytes(1 << 24)
    for left in range(size - 5, 0, -len(zeros)):
        whole.update(zeros[:left])
    r = io.file_checksums(spark, str(tmp_path)).first()
    assert (r.file, r.bytes, r.sha256) == ("big.bin", size, whole.hexdigest())
