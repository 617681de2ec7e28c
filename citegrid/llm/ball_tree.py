"""Ranked lexical search: for each item the documents of highest score, exact, by ball trees over sparse vectors.

A score is the inner product of an item (its terms, once each) and a document (term weight times saturated
frequency, integers). Items come in blocks of bounded size, each a query set against all documents:

1. One pass counts documents, their terms, and how many documents hold each term of the block. Weights follow.
2. A second pass turns documents into sparse vectors over the block's terms; those without any score nothing. Each task
   puts every CHUNK documents into a ball tree: a node is split in halves between two far documents, and knows its
   centroid, its radius and the terms that its documents have.
3. For each item the tree is walked best-first. No document of a node can score above
   ``q . centroid + |q| * radius``, where only the item's terms that the node has count in ``|q|``, as all its vectors are
   zero elsewhere. The bound is computed in doubles and widened by far more than what rounding can lose. The walk ends when
   the best open bound is below the item's k-th score so far, over all chunks of the task. Leaves are scored in 64-bit
   integers.
4. Each task gives at most k documents for each item; the best k of these are the answer. Documents are never shuffled.

Both vectors are scaled by the square root of the term's weight, which leaves the inner product and tightens the bound.

Terms are known by 64 bits of a hash. Nulls: a null text has no terms; such items have no rows, such documents no
score. A null doc_id comes last among equal scores. Every row of the items is an item of its own, and every
row of the documents a document, so repeated rows count and are ranked one by one; items without an id are left out. Only
the id and text columns are read. Empty tables give no rows. Very long texts are sliced like others; a text adds
its different terms only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import ship, table
from .words import LOWER, NOT_ALNUM, rows_of, slices, span_hashes, spans, text_bytes

TOP = 10
CHUNK = 2048
LEAF = 16
BLOCK_BYTES = 8 << 20
#: Above this relative error of sums of some million doubles, and above what an integer of the size of a score loses as a double.
SAFE = 1e-9


class Block:
    """Some items: ids, the term numbers of each, and the sorted hashes of all their terms."""

    def __init__(self, ids: list, texts: list):
        found = []
        for text in texts:
            raw, at = text_bytes(pa.array([text], pa.large_string()))
            begins, ends, _ = spans(raw, at, NOT_ALNUM)
            found.append(np.unique(span_hashes(LOWER[raw], begins, ends)))
        self.ids = [i for i, f in zip(ids, found, strict=True) if len(f)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        self.terms = [np.searchsorted(self.vocabulary, f) for f in found if len(f)]

    def weigh(self, documents: int, length: int, holding: np.ndarray) -> None:
        self.documents, self.length = documents, length
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)


def blocks(items: DataFrame, key: str, block_bytes: int) -> Iterator[Block]:
    """The items, about ``block_bytes`` of text at a time; the driver and a task hold one block."""
    some = items.select(F.col(key).alias("id"), "text").filter("id is not null and text is not null")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for i in range(n):
        rows = (some.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else some).collect()
        yield Block([r["id"] for r in rows], [r["text"] for r in rows])


def _matches(block: Block, raw: np.ndarray, at: np.ndarray):
    """Terms of each text, and its (row, term, times) for terms of the block, by row and term."""
    begins, ends, first = spans(raw, at, NOT_ALNUM)
    hashes, size = span_hashes(LOWER[raw], begins, ends), len(block.vocabulary)
    if not size:
        none = np.zeros(0, np.int64)
        return np.diff(first), none, none, none
    term = np.minimum(np.searchsorted(block.vocabulary, hashes), size - 1)
    known = block.vocabulary[term] == hashes
    cells, times = np.unique(rows_of(first)[known] * size + term[known], return_counts=True)
    return np.diff(first), cells // size, cells % size, times


def count_terms(docs: DataFrame, block: Block) -> None:
    """Gives the block its weights, from all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        sums = np.zeros(len(block.vocabulary) + 2, np.int64)
        for _, raw, at in slices(batches, "text"):
            n, _, term, _ = _matches(block, raw, at)
            sums += np.concatenate((np.bincount(term, minlength=len(block.vocabulary)), [np.count_nonzero(n), n.sum()]))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["place", "total"])

    rows = docs.select("text").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()  # a row for each term of the block
    sums = np.zeros(len(block.vocabulary) + 2, np.int64)
    for r in rows:
        sums[r["place"]] = r["total"]
    block.weigh(int(sums[-2]), int(sums[-1]), sums[:-2])
    shared.unpersist()


class Tree:
    """A ball tree over documents (``first``: where each one's entries begin; ``term`` below ``size``; integer ``value``)."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, scale: np.ndarray, leaf: int = LEAF):
        self.scale, self.n_terms = scale, len(scale)
        self.first, self.term, self.value = first, term, value
        self.x = value / scale[term]
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.square = np.bincount(self.row, self.x * self.x, len(first) - 1)
        self.children: list[tuple[int, int] | None] = []
        self.leaves: list[tuple | None] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.has: list[np.ndarray] = []
        self._grow(np.arange(len(first) - 1), leaf)
        self.centre, self.has = np.array(self.centre).T.copy(), np.array(self.has).T.copy()
        self.radius = np.array(self.radius)
        self.n_leaves = sum(x is not None for x in self.leaves)

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries, and the document's number within ``docs`` of each."""
        size = self.first[docs + 1] - self.first[docs]
        local = np.repeat(np.arange(len(docs)), size)
        return np.arange(len(local)) - np.repeat(np.cumsum(size) - size, size) + self.first[docs][local], local

    def _grow(self, docs: np.ndarray, leaf: int) -> int:
        node = len(self.children)
        place, local = self._entries(docs)
        term, x = self.term[place], self.x[place]
        centre = np.bincount(term, x, self.n_terms) / len(docs)
        away = self.square[docs] - 2 * np.bincount(local, x * centre[term], len(docs)) + centre @ centre
        self.radius.append(math.sqrt(max(0.0, float(away.max())) + SAFE * (float(self.square[docs].max()) + float(centre @ centre))))
        self.centre.append(centre)
        self.has.append(centre > 0)
        self.children.append(None)
        self.leaves.append(None)
        if len(docs) <= leaf:
            self.leaves[node] = docs, term, local, self.value[place]
            return node

        def product(i: int) -> np.ndarray:
            """Inner products of all with one of them."""
            dense = np.zeros(self.n_terms)
            mine = slice(self.first[docs[i]], self.first[docs[i] + 1])
            dense[self.term[mine]] = self.x[mine]
            return np.bincount(local, x * dense[term], len(docs))

        a = int(away.argmax())
        to_a = product(a)
        b = int((self.square[docs] - 2 * to_a).argmax())
        side = product(b) - to_a  # grows towards b
        order = np.argsort(side, kind="stable")
        half = len(docs) // 2
        self.children[node] = self._grow(docs[order[:half]], leaf), self._grow(docs[order[half:]], leaf)
        return node

    def search(self, terms: np.ndarray, best: list, k: int, name) -> int:
        """Puts the documents that belong to the ``k`` best into the heap ``best`` of (score, ``name(document)``), and
        tells how many leaves were scored."""
        q = self.scale[terms]
        norm = np.sqrt((q * q) @ self.has[terms])
        bound = ((q @ self.centre[terms] + norm * self.radius) * (1 + SAFE) + 1).tolist()
        wanted = np.zeros(self.n_terms, bool)
        wanted[terms] = True
        heap, scored = [(-bound[0], 0)], 0
        while heap:
            most, node = heapq.heappop(heap)
            if len(best) == k and -most < best[0][0]:
                break
            if self.leaves[node] is None:
                for child in self.children[node]:
                    heapq.heappush(heap, (max(most, -bound[child]), child))
                continue
            scored += 1
            docs, term, local, value = self.leaves[node]
            hit = wanted[term]
            scores = np.zeros(len(docs), np.int64)
            np.add.at(scores, local[hit], value[hit])
            for i in np.flatnonzero(scores > (0 if len(best) < k else best[0][0] - 1)).tolist():
                entry = int(scores[i]), name(int(docs[i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


class Searcher:
    """The best documents of a task for each item of a block."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.best: list[list] = [[] for _ in block.ids]
        self.held: list[tuple] = []
        self.waiting = self.scored = self.leaves = 0  # documents; leaves scored, and all of them

    def add(self, ids: list, raw: np.ndarray, at: np.ndarray) -> None:
        b = self.block
        n, row, term, times = _matches(b, raw, at)
        some, row = np.unique(row, return_inverse=True)
        m = np.array([10 + 90 * int(x) * b.documents // b.length for x in n[some].tolist()], np.int64)
        value = b.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
        if not len(some):
            return
        self.held.append(([ids[i] for i in some.tolist()], np.bincount(row, minlength=len(some)), term, value))
        self.waiting += len(some)
        if self.waiting >= CHUNK:
            self.search()

    def search(self) -> None:
        if not self.held:
            return
        ids = [i for h in self.held for i in h[0]]
        sizes, term, value = (np.concatenate([h[j] for h in self.held]) for j in (1, 2, 3))
        self.held, self.waiting = [], 0
        # Equal scores: the least id first, none last; a heap's least entry is its worst.
        worth = [(i is not None, -i if i is not None else 0) for i in ids]
        used, term = np.unique(term, return_inverse=True)
        scale = np.sqrt(np.maximum(self.block.weights[used], 1))
        first = np.concatenate(([0], np.cumsum(sizes)))
        local = np.full(len(self.block.vocabulary), -1)
        local[used] = np.arange(len(used))
        for low in range(0, len(ids), CHUNK):
            high = min(low + CHUNK, len(ids))
            part = slice(first[low], first[high])
            tree = Tree(first[low : high + 1] - first[low], term[part], value[part], scale)
            for item, terms in enumerate(self.block.terms):
                mine = local[terms]
                mine = mine[mine >= 0]
                if len(mine):
                    self.scored += tree.search(mine, self.best[item], self.k, lambda d, low=low: worth[low + d])
                    self.leaves += tree.n_leaves


def _search(docs: DataFrame, block: Block, kind: str, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = docs.select(F.lit(0).cast("long").alias("item"), F.lit(None).cast(kind).alias("item_id"), "doc_id", F.lit(0).cast("long").alias("score")).schema
    id_type = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, k)
        for batch, raw, at in slices(batches, "text"):
            searcher.add(batch.column(0).to_pylist(), raw, at)
        searcher.search()
        rows = [(i, -worth[1] if worth[0] else None, score) for i, best in enumerate(searcher.best) for score, worth in best]
        item = [r[0] for r in rows]
        columns = pa.array(item, pa.int64()), pa.array([shared.value.ids[i] for i in item], id_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns), names=["item", "item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) its ``k`` best rows of ``docs``."""
    ship(docs.sparkSession)
    kind, out = items.schema["item_id"].dataType.simpleString(), None
    for block in blocks(items, "item_id", block_bytes):
        count_terms(docs, block)
        # Tasks give k rows for each item at most, so the window has a small part of the documents.
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        part = _search(docs, block, kind, k).withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op12_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"

OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL
), totals AS (
  SELECT count(*) AS docs, sum(len(t)) AS length FROM d WHERE len(t) > 0
), tf AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs
), found AS (
  SELECT item, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.t) * docs) // length)))) AS BIGINT) AS score
  FROM (SELECT item, item_id, unnest(t) AS term FROM i) JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (row), totals
  GROUP BY item, item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM found WHERE score > 0) WHERE rank <= {TOP}
"""
