"""SimHash near-dedup: 64-bit fingerprints of word shingles, all links of at most RADIUS differing bits, and the
components that they make.

1. A fingerprint bit is set if it is set in over half of the text's shingle hashes (repeats count).
2. Equal fingerprints are one class: only different ones are dealt out.
3. Covering hashing: bits are dealt to the ``2 ** (radius + 1) - 1`` vectors of radius + 1 bits that are not zero.
   Table v keeps the bits whose vector has an odd product with v. The vectors of any ``radius`` bits leave a v that is
   orthogonal to all of them, so two fingerprints within the radius agree in all that some table keeps: no pair is
   lost, whatever the data (radius 2: seven tables, the points and lines of the Fano plane, 36 or 37 bits kept).
4. A bucket of more than BUCKET fingerprints is dealt again, by the same construction over the bits that its table
   doesn't keep. Twice dealt, a bucket has at most 2 ** 12 fingerprints, as so many bits are free: no group is
   without a bound, and nothing is capped.
5. A task compares the fingerprints of its buckets and gives a forest of the links of each bucket, not the pairs.

Nulls: a null or wordless text has the fingerprint zero, which links like any other. A component's name is its least
id that is not null, or null if it has no other. Repeated rows get a row each. Only doc_id and text are read; very
long texts are hashed in pieces. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, ship, table, written
from .components import connected_components
from .words import LOWER, SPACES, slices, spans

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
BUCKET = 512
SALTS = 16
PIECE = 1 << 16


def covering_masks(bits: Sequence[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` such that for any ``radius`` of them some mask has none of these."""
    vectors = range(1, 1 << (radius + 1))
    return [sum(1 << b for i, b in enumerate(bits) if (vectors[i % len(vectors)] & v).bit_count() % 2) for v in vectors]


def text_prints(raw: np.ndarray, at: np.ndarray, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text of a slice."""
    begins, ends, first = spans(raw, at, SPACES)
    n, sizes = np.diff(first), ends - begins
    # The words in lower case, each with one space behind it.
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined = np.full(starts[-1], 32, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = LOWER[raw[~SPACES[raw]]]
    text = joined.tobytes()
    heads = np.minimum(np.maximum(n - k + 1, 1), n)  # shingles of each row
    rows = np.repeat(np.arange(len(n)), heads)
    word = np.arange(len(rows)) - np.repeat(np.cumsum(heads) - heads, heads) + first[rows]
    a, b = starts[word], starts[np.minimum(word + k, first[rows + 1])] - 1
    counts = np.zeros((len(n), BITS), np.int64)
    for p in range(0, len(rows), PIECE):
        ends_at = zip(a[p : p + PIECE].tolist(), b[p : p + PIECE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(text[i:j], seed) for i, j in ends_at], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        there = rows[p : p + PIECE]
        new = np.flatnonzero(np.concatenate(([True], there[1:] != there[:-1])))
        counts[there[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > heads[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` (any columns; text last) without the text and with ``fp``, the bits of the fingerprint as a long."""
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*names, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(text_prints(raw, at, k, seed).view(np.int64))], names=[*names, "fp"])

    return docs.select(*names, "text").mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, masks: Sequence[int]) -> DataFrame:
    """Each fingerprint under its key in each table."""
    keys = F.array(*(F.struct(F.lit(i).alias("bucket_table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket_key")) for i, m in enumerate(masks)))
    return rows.select(F.inline(keys), "fp")


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Makes the trees of u[i] and v[i] one; every node points to its root, the least of its tree."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def bucket_forest(key: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that join all that links, directly or through others of one bucket. ``key`` tells the
    bucket of each, bucket after bucket."""
    n = len(prints)
    end = np.searchsorted(key, key, "right")
    parent, at = np.arange(n), np.arange(n)
    for step in range(1, n):
        at = at[end[at] - at > step]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= radius]
        if len(near):
            _joined(parent, near, near + step)
    child = np.flatnonzero(parent != np.arange(n))
    return prints[child], prints[parent[child]]


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of rows (bucket_table, bucket_key, fp) whose buckets all have a bounded size."""
    sorted_rows = rows.repartition("bucket_table", "bucket_key").sortWithinPartitions("bucket_table", "bucket_key")

    def forest(columns: list[np.ndarray]) -> pa.RecordBatch:
        new = np.concatenate(([False], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])))
        u, v = bucket_forest(np.cumsum(new), columns[2].view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            columns = [np.concatenate((x, c.to_numpy(zero_copy_only=False).astype(np.int64))) for x, c in zip(left, batch.columns, strict=True)]
            cuts = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
            cut = int(cuts[-1]) if len(cuts) else 0  # the last bucket may go on in the next batch
            if cut:
                yield forest([c[:cut] for c in columns])
            left = [c[cut:] for c in columns]
        yield forest(left)

    return sorted_rows.mapInArrow(run, "u long, v long")


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``prints`` (fp, each once) within the radius."""
    ship(prints.sparkSession)
    masks = covering_masks(range(BITS), radius)
    rows, key = _dealt(prints, masks), ["bucket_table", "bucket_key"]
    full = written(rows.groupBy(*key).count().filter(F.col("count") > bucket).select(*key), "simhash-full")
    if full.isEmpty():
        found = written(_linked(rows, radius), "simhash-links")
        drop_written(full)
        return found
    # A full bucket is spread over SALTS tasks until it is dealt again.
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    salts = full.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = rows.withColumn("salt", salt)
    few = salted.join(salts.hint("shuffle_merge"), [*key, "salt"], "left_anti").drop("salt")
    many = salted.join(salts.hint("shuffle_merge"), [*key, "salt"], "left_semi").drop("salt")
    again = None
    for i, mask in enumerate(masks):
        inner = [mask | m for m in covering_masks([b for b in range(BITS) if not mask >> b & 1], radius)]
        part = _dealt(many.filter(F.col("bucket_table") == i), inner).withColumn("bucket_table", F.col("bucket_table") + (i + 1) * len(masks))
        again = part if again is None else again.unionByName(part)
    found = written(_linked(few, radius).unionByName(_linked(again, radius)), "simhash-links")
    drop_written(full)
    return found


def _components(prints: DataFrame, radius: int, name: str) -> DataFrame:
    """(fp, ``component_id``): the least ``name`` of the fingerprints that are reachable; ``prints`` has fp and ``name``."""
    classes = written(prints.groupBy("fp").agg(F.min(name).alias("least")), "simhash-classes")
    found = links(classes.select("fp"), radius)
    parts = connected_components(found)
    placed = classes.join(parts.withColumnRenamed("node", "fp").hint("shuffle_merge"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    placed = written(placed.select("fp", "least", "part"), "simhash-parts")
    names = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = written(placed.join(names.hint("shuffle_merge"), "part").select("fp", "component_id"), "simhash-named")
    for t in (classes, found, placed):
        drop_written(t)
    return named


def near_copies(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for each document."""
    members = written(fingerprints(docs.select("doc_id", "text"), k, seed), "simhash-members")
    return members.join(_components(members, radius, "doc_id").hint("shuffle_merge"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs``, all columns, with the row of least doc_id of each component (null ids last; of rows with one id any one)."""
    row = "row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    first = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", F.col(row).alias("row"))
    members = written(fingerprints(rows.select(first.alias("at"), "text"), k, seed), "simhash-members")
    best = _components(members, radius, "at").select(F.col("component_id.row").alias(row)).distinct()
    return rows.join(best.hint("shuffle_merge"), row, "left_semi").select(*docs.columns)


def op13_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
