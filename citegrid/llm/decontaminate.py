"""Benchmark decontamination with a generalised suffix automaton.

The items' words form one automaton that knows every run of words of every item. A document's words
are streamed through it; the length of the longest run that ends at each word shows where a window
(``window`` consecutive item words, or a whole shorter item) occurs. Words that no item has cannot
lie in a window, so only stretches of item words are streamed.

Items are read in blocks of at most ``BLOCK_WORDS`` words, each with an automaton of its own whose
size is thereby bounded; documents are scanned against one block after another. Documents are never
shuffled, unless there are several blocks: then they are written with a number for each row, by which
the findings of all blocks are put together before anything is judged or cut.

Nulls: a null text has no words; an item without id or words is no item; a null document id is kept.
An empty benchmark hits nothing. Repeated documents are judged each for itself; items with one id
count as one item with all their windows. Only the named columns are read; further columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, written
from .words import LOWER, NOT_ALNUM, per_row, slices, span_hashes, spans, text_bytes

WINDOW = 10
BLOCK_WORDS = 200_000


class Automaton:
    """Suffix automaton of several word sequences; words are numbers below ``len(self.vocabulary)``."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        every = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.vocabulary, self.window = np.unique(every), window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        told = [(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items if len(h)]
        for _, words in told:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(words) for _, words in told)])
        # Items of each state: of the runs of ``window`` words, and of whole shorter items.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, words in told:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.full.setdefault(self.window_state(state), set()).add(name)
            if len(words) < window:
                self.short.setdefault(state, (len(words), set()))[1].add(name)

    def _extend(self, last: int, w: int) -> int:
        """Adds a word after the run that ends in state ``last``; gives the longer run's state."""
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _split(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a run that ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) for each window that occurs."""
        state = matched = 0
        for i, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            if matched >= self.window:
                yield i - self.window, i, self.full[self.window_state(state)]
            if self.short:
                s, m = state, matched
                while s > 0:
                    if s in self.short and m >= self.short[s][0]:
                        yield i - self.short[s][0], i, self.short[s][1]
                    s = self.link[s]
                    m = self.length[s]


def _findings(auto: Automaton, raw: np.ndarray, at: np.ndarray):
    """Words of a slice: starts, ends, first word of each row, hit words, and the items found by row."""
    begins, ends, first = spans(raw, at, NOT_ALNUM)
    hit, found = np.zeros(len(begins), bool), {}
    if len(auto.vocabulary) == 0 or len(begins) == 0:
        return begins, ends, first, hit, found
    hashes = span_hashes(LOWER[raw], begins, ends)
    ids = np.minimum(np.searchsorted(auto.vocabulary, hashes), len(auto.vocabulary) - 1)
    known = np.zeros(len(hashes) + 2, bool)
    known[1:-1] = auto.vocabulary[ids] == hashes
    new = np.zeros(len(hashes) + 1, bool)
    new[first] = True
    starts = np.flatnonzero(known[1:-1] & (~known[:-2] | new[:-1]))
    stops = np.flatnonzero(known[1:-1] & (~known[2:] | new[1:])) + 1
    long = stops - starts >= auto.shortest
    rows = np.searchsorted(first, starts, "right") - 1
    for a, b, row in zip(starts[long].tolist(), stops[long].tolist(), rows[long].tolist(), strict=True):
        for i, j, items in auto.stream(ids[a:b].tolist()):
            hit[a + i : a + j] = True
            found.setdefault(row, set()).update(items)
    return begins, ends, first, hit, found


def _item_blocks(benchmark: DataFrame, window: int) -> Iterator[Automaton]:
    """Automata of the items, one for each block of about BLOCK_WORDS words; the driver and a task
    hold one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (BLOCK_WORDS * 4)) or 1
    for k in range(n):
        block = (items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items).toPandas()
        told = []
        for name, text in zip(block["item"], block["text"], strict=True):
            raw, at = text_bytes(pa.array([text], pa.string()))
            begins, ends, _ = spans(raw, at, NOT_ALNUM)
            told.append((name, span_hashes(LOWER[raw], begins, ends)))
        yield Automaton(told, window)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


SCAN = "n_words long, items array<string>, spans array<struct<begin:long,stop:long>>"


def _scan_block(docs: DataFrame, key: str, auto: Automaton) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(auto)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch, raw, at in slices(batches, "text"):
            _, _, first, hit, found = _findings(auto, raw, at)
            runs = [[{"begin": a, "stop": b} for a, b in _runs(hit[first[r] : first[r + 1]])] if r in found else [] for r in range(batch.num_rows)]
            items = [sorted(found.get(r, ())) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(items, pa.list_(pa.string())), pa.array(runs, kind)], names=[key, "n_words", "items", "spans"])

    return docs.select(key, "text").mapInArrow(scan, f"{key} {docs.schema[key].dataType.simpleString()}, {SCAN}")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and that column's name."""
    row = "row"
    while row in docs.columns:
        row += "_"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "leak-rows"), row


def _merged(spans: Column) -> Column:
    """Spans in order, with those that overlap or touch made one, as if all blocks were one."""
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["stop"], s["stop"]).alias("stop"))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["begin"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, s)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<begin:bigint,stop:bigint>>"), step)


def _scan_blocks(docs: DataFrame, row: str, autos: Iterator[Automaton]) -> DataFrame:
    """What all blocks find, for each row number."""
    found = None
    for auto in autos:
        part = _scan_block(docs, row, auto)
        found = part if found is None else found.unionByName(part.filter(F.size("items") > 0))
    return found.groupBy(row).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.flatten(F.collect_list("spans"))).alias("spans")
    )


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """For each document: ``n_words``, the ``items`` whose windows it has (sorted), and the ``spans`` of
    words (from, before) that lie in windows."""
    blocks = _item_blocks(benchmark, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan_block(docs, key, first)
    rows, row = _numbered(docs.select(key, "text"))
    found = _scan_blocks(rows, row, chain((first, second), blocks))
    return rows.select(row, key).join(found.hint("shuffle_merge"), row).select(key, "n_words", "items", "spans")


def hit_count(spans_column: str = "spans"):
    """Words in any of the spans, which may overlap when they come from several blocks."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["stop"], s["begin"]))).alias("n"), F.greatest(acc["stop"], s["stop"]).alias("stop")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop"))
    return F.aggregate(spans_column, zero, step, lambda acc: acc["n"])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without what they share with the benchmark: spans of at least ``min_span`` hit words go
    from the text (shorter ones only where a whole shorter item makes them up), documents with more than
    ``max_coverage`` of their words hit go wholly. A column n_chars follows
    the text. Other texts and all further columns stay as they are."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    blocks = _item_blocks(benchmark, window)
    first_block, second = next(blocks), next(blocks, None)
    shortest = min(min_span, first_block.shortest)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first_block)
    else:
        shared = None

        def told(autos: Iterator[Automaton]) -> Iterator[Automaton]:
            nonlocal shortest
            for auto in autos:
                shortest = min(shortest, auto.shortest)
                yield auto

        rows, row = _numbered(docs)
        found = _scan_blocks(rows, row, told(chain((first_block, second), blocks))).filter(F.size("items") > 0)
        docs = rows.join(found.select(row, F.col("spans").alias(f"{row}_spans")).hint("shuffle_merge"), row, "left").select(*names, f"{row}_spans")
    least = shortest

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in slices(batches, "text"):
            if shared is not None:
                begins, ends, first, hit, found = _findings(shared.value, raw, at)
            else:
                begins, ends, first = spans(raw, at, NOT_ALNUM)
                hit, found = np.zeros(len(begins), bool), {}
                for r, some in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for s in some or ():
                        hit[first[r] + s["begin"] : first[r] + s["stop"]] = True
                        found[r] = some
                batch = batch.select(names)
            if not found:
                yield batch
                continue
            n, n_hit = np.diff(first), per_row(hit, first)
            keep = n_hit <= max_coverage * n
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            for r in found:
                left, cut = [], int(at[r])
                for a, b in _runs(hit[first[r] : first[r + 1]]):
                    if b - a >= least:
                        left.append(raw[cut : begins[first[r] + a]].tobytes())
                        cut = int(ends[first[r] + b - 1])
                texts[r] = b"".join([*left, raw[cut : at[r + 1]].tobytes()]).decode()
            columns = [pa.array(texts, batch.schema.field(k).type) if i == k else c for i, c in enumerate(batch.columns)]
            c = batch.schema.get_field_index("n_chars")
            if c >= 0:
                n_chars = batch.column(c).to_pylist()
                for r in found:
                    n_chars[r] = len(texts[r])
                columns[c] = pa.array(n_chars, batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(clean, schema).select(*names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_count()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), found AS (
  SELECT d.doc_id, d.i, d.k, x.item
  FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)) d
  JOIN windows x ON x.win = d.win AND x.k = d.k
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
