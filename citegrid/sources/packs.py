"""Packs of records (IO3): JSON documents of any size, that hold an object, an array or ``{"results": [...]}``, and JSON lines.

A large document is read by many tasks. The text reader splits it at each ``}``, by byte ranges of Spark's own, and three steps find
the records:

1. Each range is summed up: whether its quotes are odd, and how much deeper it ends if it begins outside of a string, and
   if within one.
2. Running sums over the ranges of a file give each one's state: within a string or not, and the depth.
3. With these each range gives its whole records, and the pieces of those that go on in its neighbours, which are put
   together by the range where they begin.

Steps read the file twice and shuffle pieces at range ends only. No split lies in an escape, as ``\\}`` is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from citegrid.sources import io
from citegrid.sources.scratch import settled, ship

#: Documents are read in groups of so many bytes and files, which bounds the table of ranges that each task gets.
GROUP_BYTES = 1 << 42
GROUP_FILES = 50_000

_DEEPER = np.zeros(256, np.int64)
_DEEPER[[ord("{"), ord("[")]] = 1
_DEEPER[[ord("}"), ord("]")]] = -1
_RESULTS = re.compile(rb'"results"\s*:\s*\[')


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Text of neighbouring pieces of one range."""
    for batch in batches:
        files, blocks, values = (batch.column(i) for i in range(3))
        ends = np.flatnonzero(np.diff(blocks.to_numpy()) != 0) + 1
        names = files.to_pylist()
        cuts = sorted({0, batch.num_rows, *ends.tolist(), *(i for i in range(1, len(names)) if names[i] != names[i - 1])})
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield (names[a], blocks[a].as_py()), "}".join([*values.slice(a, b - a).to_pylist(), ""]).encode()


def structure(data: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of each byte: is it in a string, and how much deeper is the text after it, as if no byte were; and the state at the end."""
    a = np.frombuffer(data, np.uint8)
    quote = a == 34
    if 92 in data:
        at = np.arange(len(a))
        other = np.maximum.accumulate(np.where(a != 92, at, -1))
        backslashes = at - 1 - np.concatenate(([-1], other[:-1]))
        quote = quote & (backslashes % 2 == 0)
    inside = (np.cumsum(quote) + in_string) % 2 == 1
    return inside, _DEEPER[a], bool(inside[-1]) if len(a) else in_string


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told: dict[tuple, list] = {}
    for key, data in _runs(batches):
        s = told.setdefault(key, [False, 0, 0, ""])
        inside, deeper, s[0] = structure(data, s[0])
        out = int(deeper[~inside].sum())
        s[1] += out
        s[2] += int(deeper.sum()) - out
        s[3] = s[3] or data.lstrip()[:1].decode("latin-1")
    rows = [(*key, int(s[0]), *s[1:]) for key, s in told.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(_SUMMARY.names, r, strict=True)) for r in rows], _SUMMARY)


_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("outside", pa.int64()), ("within", pa.int64()), ("first", pa.string())])
_FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("wanted", pa.bool_()), ("text", pa.string())])
#: Parts of a range, in their order: the end of a record from before, a piece of one that goes through, whole records, the beginning of one.
END, THROUGH, WHOLE, BEGIN, LIST = 0, 1, 2, 3, 4


class _Range:
    """The records of one range. Every value right below the list is one, also numbers' neighbours such as inner lists."""

    def __init__(self, key: tuple[str, int], odd: int, depth: int, kind: str):
        self.key, self.in_string, self.depth, self.kind = key, bool(odd), depth, kind
        self.base = 1 if kind == "[" else 2
        self.open: list[bytes] | None = [] if depth > self.base else None
        self.from_before = self.open is not None
        self.wanted: bool | None = True if kind == "[" else False if key[1] == 0 else None
        self.told: bool | None = None

    def row(self, part: int, text: bytes, wanted: bool | None) -> dict:
        return {"file": self.key[0], "block": self.key[1], "part": part, "wanted": wanted, "text": text.decode("utf-8", "replace")}

    def records(self, data: bytes) -> Iterator[dict]:
        inside, deeper, ended = structure(data, self.in_string)
        step = np.where(inside, 0, deeper)
        after = self.depth + np.cumsum(step)
        opens, closes = np.flatnonzero((step == 1) & (after == self.base + 1)), np.flatnonzero((step == -1) & (after == self.base))
        events = [(int(i), "open") for i in opens] + [(int(i), "close") for i in closes]
        if self.kind == "{":
            lists = [m for m in _RESULTS.finditer(data) if not inside[m.start() - 1 if m.start() else 0] and after[m.start()] == 1]
            events += [(m.end() - 1, "list") for m in lists] + [(int(i), "no list") for i in np.flatnonzero((step == -1) & (after == 1))]
        begin = 0
        for at, what in sorted(events):
            if what == "open":
                self.open, begin = [], at
            elif what == "close" and self.open is not None:
                text = b"".join([*self.open, data[begin : at + 1]])
                if self.from_before:
                    yield self.row(END, text, None)
                elif text[:1] == b"{":
                    yield self.row(WHOLE, text, self.wanted)
                self.open, self.from_before = None, False
            elif what in ("list", "no list"):
                self.wanted = self.told = what == "list"
        if self.open is not None:
            self.open.append(data[begin:])
        self.in_string, self.depth = ended, int(after[-1]) if len(after) else self.depth

    def rest(self) -> Iterator[dict]:
        if self.open is not None:
            yield self.row(THROUGH if self.from_before else BEGIN, b"".join(self.open), None if self.from_before else self.wanted)
        if self.told is not None:
            yield self.row(LIST, b"", self.told)


def _found(states) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        for key, data in _runs(batches):
            rows: list[dict] = []
            if now is None or now.key != key:
                if now is not None:
                    rows += now.rest()
                now = _Range(key, *states.value[key])
            rows += now.records(data)
            yield pa.RecordBatch.from_pylist(rows, _FOUND)
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(now.rest()), _FOUND)

    return run


def _documents(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(file, text) of each record, and (file, sound, listed) of each file: are strings and brackets closed, and does it
    have a list of records."""
    ship(spark)
    pieces = _pieces(spark, paths)
    sums = settled(pieces.mapInArrow(_summaries, "file string, block long, odd long, outside long, within long, first string"), "pack-ranges")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    odd = sums.withColumn("odd_before", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    deeper = odd.withColumn("deeper", F.when(F.col("odd_before") == 0, F.col("outside")).otherwise(F.col("within")))
    kind = F.first(F.when(F.col("block") == 0, F.col("first")), ignorenulls=True).over(whole)
    states = deeper.select("file", "block", "odd", "deeper", "odd_before", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"), kind.alias("kind"))
    states = settled(states, "pack-states")
    held = {(r["file"], r["block"]): (r["odd_before"], r["depth"], r["kind"] or "") for r in states.select("file", "block", "odd_before", "depth", "kind").toLocalIterator()}  # a row for each range of a group
    found = pieces.mapInArrow(_found(spark.sparkContext.broadcast(held)), "file string, block long, part long, wanted boolean, text string")
    found = settled(found.filter(F.col("part").isin(END, THROUGH, BEGIN, LIST) | (F.col("part") == WHOLE)), "pack-found")

    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lists = found.filter(F.col("part") == LIST).select("file", "block", F.col("wanted").alias("_list"))
    carried = states.select("file", "block").join(lists.hint("shuffle_merge"), ["file", "block"], "left").select("file", "block", F.last("_list", ignorenulls=True).over(upto).alias("_before"))
    # A record that begins before its range's first sight of a list belongs to what the ranges before saw last.
    told = found.join(F.broadcast(carried), ["file", "block"]).withColumn("wanted", F.coalesce("wanted", "_before", F.lit(False)))  # a row for each range of a group

    ends = told.filter(F.col("part").isin(END, THROUGH, BEGIN))
    along = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("start", F.last(F.when(F.col("part") == BEGIN, F.col("block")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.when(F.col("part") == BEGIN, F.col("block")).otherwise(F.col("start"))
    joined = ends.withColumn("start", start).groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda s: s["text"]), "").alias("text"), F.bool_or(F.when(F.col("part") == BEGIN, F.col("wanted"))).alias("wanted"), F.max((F.col("part") == END).cast("int")).alias("ended")
    )
    records = told.filter((F.col("part") == WHOLE) & F.col("wanted")).select("file", "text").unionByName(joined.filter((F.col("ended") == 1) & F.col("wanted") & F.col("text").startswith("{")).select("file", "text"))
    end_depth, quotes = F.sum("deeper"), F.sum("odd") % 2
    # The reader adds a bracket to what follows the last one, so a sound file ends at 0 or one below.
    files = states.groupBy("file").agg(((quotes == 0) & end_depth.isin(0, -1)).alias("sound"), F.first("kind").alias("kind"))
    seen = lists.filter("_list").select("file").distinct().withColumn("_seen", F.lit(True))
    files = files.join(seen.hint("shuffle_merge"), "file", "left")
    return records, files.select("file", "sound", (F.col("kind") == "[").alias("array"), F.coalesce("_seen", F.lit(False)).alias("listed"))


def _groups(files: DataFrame) -> Iterator[list[str]]:
    group, size = [], 0
    for r in files.orderBy("path").toLocalIterator():
        if group and (size + r["length"] > GROUP_BYTES or len(group) == GROUP_FILES):
            yield group
            group, size = [], 0
        group.append(r["path"])
        size += r["length"]
    if group:
        yield group


def read_packs(spark: SparkSession, folder: str, record: StructType, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Records below a folder whose id has the prefix, as (file, fields of ``record``), and the manifest
    (file, bytes, records, status). ``.json`` files are documents, ``.jsonl`` and ``.jsonl.gz`` lines; others are left
    out, and so are files of no bytes, which Spark doesn't list. A file with damaged JSON is failed and gives no records."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("_metadata.file_path").alias("file"))
    listed = settled(listed, "pack-files")
    name, parts = F.lower("path"), []
    one = F.from_json("text", record)
    good, object_ = F.try_parse_json("text").isNotNull(), F.regexp_replace("text", r"^\s+", "").startswith("{")
    bad = listed.limit(0).select("file")
    for group in _groups(listed.filter(name.endswith(".json"))):
        texts, files = _documents(spark, group)
        files = settled(files, "pack-documents")
        single = [r["path"] for r in listed.join(files.filter("sound and not array and not listed").hint("shuffle_merge"), "file").select("path").toLocalIterator()]
        if single:  # an object without a list is one record
            whole = spark.read.text(single, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
            texts = texts.unionByName(whole)
        parts.append(texts.select("file", F.when(good & object_, one).alias("r"), (~good).alias("error")))
        bad = bad.unionByName(files.filter("not sound").select("file"))
    lines = [r["path"] for r in listed.filter(name.endswith(".jsonl") | name.endswith(".jsonl.gz")).select("path").toLocalIterator()]
    if lines:
        parts.append(io.read_tolerant(spark, lines, record).select("file", F.col("record").alias("r"), "error"))
    none = listed.limit(0).select("file", F.from_json(F.lit("{}"), record).alias("r"), F.lit(False).alias("error"))
    made = none
    for part in parts:
        made = made.unionByName(part)
    made = settled(made.filter(F.col("error") | F.col("r.id").startswith(prefix)), "pack-records")
    failed = settled(made.filter("error").select("file").unionByName(bad).distinct(), "pack-failed")
    rows = made.filter(~F.col("error")).join(failed.hint("shuffle_merge"), "file", "left_anti").select("file", "r.*")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("records"))
    known = listed.filter(name.endswith(".json") | name.endswith(".jsonl") | name.endswith(".jsonl.gz"))
    manifest = known.join(counts.hint("shuffle_merge"), "file", "left").join(failed.withColumn("_failed", F.lit(True)).hint("shuffle_merge"), "file", "left")
    status = F.when(F.col("_failed"), "failed").otherwise("ok")
    return rows, manifest.select("file", F.col("length").alias("bytes"), F.coalesce("records", F.lit(0)).alias("records"), status.alias("status"))
