"""Token ids in compressed files: tokenise, write in ascending id order, read back.

A file holds blocks of at most ``LANES * STEPS`` ids, each coded from nothing and checked by a CRC, so a
damaged block costs itself only. In a block the ids lie in lanes of STEPS consecutive ids; all lanes
advance together, each with a range coder of its own, and share one adaptive model:

* order 0: counts of the block's ids so far, taken over at steps 1, 2, 4, ...;
* order 1 and order 2: the id that last followed the id, or the two ids, before, with a confidence.

The three are mixed into one distribution: order 0 by its counts, and a point mass for each predicted id.
The masses follow how often predictions of such confidences came true so far. Decoding replays the model.

Strings of special tokens in a text are these tokens, as the library has it by default.

Nulls: a null text is empty and has the end id alone; a null document id comes first. Rows with one id
follow each other by text. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, ship, table, written
from .words import SPACES, slices, span_hashes, spans

LANES, STEPS = 256, 256
BLOCK = LANES * STEPS
GROUP = 16
VOCABULARY = 1 << 16
MAGIC = b"IDMIX1\n"
BASE_BITS, MIX_BITS = 20, 8
PAIRS = 1 << 15
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
LEVELS = 4
#: Ids after which a file ends, at the next slice of texts.
FILE_IDS = 1 << 25
#: White space of the tokeniser's pattern beyond ASCII.
WIDE_BLANK = b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


def _pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word with the space before it, and of each stretch of other blanks, of which the
    last before a word stands alone. The tokeniser never merges across these."""
    begins, ends, first = spans(raw, at, SPACES)
    n = np.diff(first)
    gap = np.empty(len(begins), np.int64)
    gap[1:] = ends[:-1]
    some = np.flatnonzero(n)
    gap[first[some]] = at[some]
    lead = (begins > gap) & (raw[begins - 1] == 32)
    word = begins - lead
    alone = ~lead & (begins > gap)
    stretch = begins - 1 > gap
    last = at[:-1].copy()
    last[some] = ends[first[some + 1] - 1]
    tail = last < at[1:]
    start = np.concatenate((word, begins[alone] - 1, gap[stretch], last[tail]))
    stop = np.concatenate((ends, begins[alone], begins[stretch] - 1, at[1:][tail]))
    order = np.argsort(start, kind="stable")
    return start[order], stop[order]


class Words:
    """Ids of texts by ids of their pieces, each of which is tokenised once for as long as it is kept. Texts with
    wide blanks or special tokens are tokenised whole."""

    KEPT = 500_000
    SLOTS = 21

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([WIDE_BLANK, *special]))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.SLOTS, np.uint64)
        self.place = np.full(1 << self.SLOTS, -1, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, -1 for those that aren't known."""
        slot = (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        found = np.where(self.keys[slot] == hashes, self.place[slot], -1)
        for step in range(1, 8):
            left = np.flatnonzero(found < 0)
            if len(left) == 0:
                break
            at = (slot[left] + step) & ((1 << self.SLOTS) - 1)
            found[left] = np.where(self.keys[at] == hashes[left], self.place[at], -1)
        return found

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> np.ndarray:
        """Tokenises new pieces; gives their numbers."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        numbers = np.arange(len(texts)) + len(self.starts) - 1
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(some) for some in ids])])
        left, slot = np.arange(len(texts)), (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        for step in range(8):
            at = (slot[left] + step) & ((1 << self.SLOTS) - 1)
            free = np.flatnonzero(self.place[at] < 0)
            _, own = np.unique(at[free], return_index=True)
            put = free[own]
            self.keys[at[put]], self.place[at[put]] = hashes[left[put]], numbers[left[put]]
            left = np.delete(left, put)
        return numbers

    def _plain(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.starts) > self.KEPT:
            self.clear()
        start, stop = _pieces(raw, at)
        hashes = span_hashes(raw, start, stop)
        which = self._find(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            kinds, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            texts = [raw[a:b].tobytes().decode() for a, b in zip(start[new[first]].tolist(), stop[new[first]].tolist(), strict=True)]
            which[new] = self._learn(kinds, texts)[back]
        begin = self.starts[which]
        size = self.starts[which + 1] - begin
        total = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.pool[place], np.diff(total[np.searchsorted(start, at)])

    def encode(self, raw: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each with the end id, and how many each has."""
        text = raw.tobytes()
        odd = np.unique(np.searchsorted(at, [m.start() for m in self.odd.finditer(text)], "right") - 1)
        if len(odd) == 0:
            ids, n = self._plain(raw, at)
        else:
            size = np.diff(at)
            usual = np.ones(len(size), bool)
            usual[odd] = False
            part, m = self._plain(raw[np.repeat(usual, size)], np.concatenate(([0], np.cumsum(np.where(usual, size, 0)))))
            lists = np.split(part, np.cumsum(m)[:-1])
            whole = self.tokenizer.encode_batch_fast([text[at[r] : at[r + 1]].decode() for r in odd], add_special_tokens=False)
            for r, e in zip(odd.tolist(), whole, strict=True):
                lists[r] = np.asarray(e.ids, np.uint32)
            ids, n = np.concatenate(lists), np.array([len(some) for some in lists])
        return np.insert(ids, np.cumsum(n), end_id), n + 1


@functools.lru_cache(maxsize=1)
def _words(vocabulary: str) -> Words:
    """One tokeniser, with the pieces it knows, for all tasks of a Python process."""
    return Words(vocabulary)


class Model:
    """What coder and decoder know of several blocks' ids so far."""

    def __init__(self, n_blocks: int):
        self.counts = np.ones((n_blocks, VOCABULARY), np.int64)
        self.one = np.zeros(n_blocks * VOCABULARY, np.int32)
        self.one_sure = np.zeros(n_blocks * VOCABULARY, np.int8)
        self.two = np.zeros(n_blocks * PAIRS, np.int32)
        self.two_sure = np.zeros(n_blocks * PAIRS, np.int8)
        # For each block and pair of confidences: times seen, and hits of order 1 and of order 2.
        self.seen = np.full((3, n_blocks * LEVELS * LEVELS), 8.0)
        self.seen[1] = self.seen[2] = np.tile(np.add.outer(np.arange(LEVELS), np.arange(LEVELS)).ravel() * 0.5, n_blocks)
        self.learn()

    def learn(self) -> None:
        """Takes over the counts: cumulative order 0 of total 2 ** BASE_BITS, and the masses of 2 ** MIX_BITS."""
        total = np.cumsum(self.counts, axis=1)
        spare = (1 << BASE_BITS) - VOCABULARY
        own = total - np.arange(1, VOCABULARY + 1)  # counts without the one that each id has
        scaled = own * spare // np.maximum(own[:, -1:], 1) + np.arange(1, VOCABULARY + 1)
        scaled[:, -1] = 1 << BASE_BITS
        self.below = np.concatenate((np.zeros((len(total), 1), np.int64), scaled), axis=1)
        # Cumulative counts of all blocks, each raised above the one before, are one sorted array.
        self.raised = (self.below + (np.arange(len(total)) << BASE_BITS + 1)[:, None]).ravel().astype(np.int32)
        share = np.minimum(self.seen[1:] / self.seen[0], 0.95)
        mass = np.floor(share * (1 << MIX_BITS)).astype(np.int64)
        over = mass.sum(0) > 240
        mass[:, over] = mass[:, over] * 240 // mass[:, over].sum(0)
        self.mass = mass


class Step:
    """Predictions of the lanes in one step."""

    def __init__(self, model: Model, block: np.ndarray, last: np.ndarray, before: np.ndarray):
        self.model, self.block = model, block
        self.at_one = block * VOCABULARY + last
        self.at_two = block * PAIRS + ((before * 40503 + last * 2654435761 >> 7) & (PAIRS - 1))
        self.one, self.two = model.one[self.at_one].astype(np.int64), model.two[self.at_two].astype(np.int64)
        self.one_sure, self.two_sure = model.one_sure[self.at_one], model.two_sure[self.at_two]
        self.kind = block * (LEVELS * LEVELS) + self.two_sure * LEVELS + self.one_sure
        self.mass_one, self.mass_two = model.mass[0][self.kind], model.mass[1][self.kind]
        self.mass = (1 << MIX_BITS) - self.mass_one - self.mass_two

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' share of the mixed distribution begins, and its size."""
        at = self.block * (VOCABULARY + 1) + ids
        below = self.model.below.ravel()
        low, high = below[at], below[at + 1]
        begin = self.mass * low + ((self.one < ids) * self.mass_one + (self.two < ids) * self.mass_two << BASE_BITS)
        size = self.mass * (high - low) + ((self.one == ids) * self.mass_one + (self.two == ids) * self.mass_two << BASE_BITS)
        return begin.astype(np.uint64), size.astype(np.uint64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids at places of the mixed distribution."""
        first, second = np.minimum(self.one, self.two), np.maximum(self.one, self.two)
        swap = self.one > self.two
        m1 = np.where(swap, self.mass_two, self.mass_one) << BASE_BITS
        m2 = np.where(swap, self.mass_one, self.mass_two) << BASE_BITS
        below, base = self.model.below.ravel(), self.block * (VOCABULARY + 1)
        after_first = self.mass * below[base + first + 1] + m1
        left = value.copy()
        past = value >= after_first
        left[past] -= m1[past]
        same = first == second
        at_first = ~past & (value >= self.mass * below[base + first])
        # With both predictions alike, the second mass lies at the first's place too.
        over = past & same & (left < self.mass * below[base + first + 1] + m2)
        later = past & ~over
        past_second = later & (left >= self.mass * below[base + second + 1] + m2)
        at_second = later & ~past_second & ~same & (left >= self.mass * below[base + second])
        left[past_second] -= m2[past_second]
        plain = np.minimum(left // self.mass, (1 << BASE_BITS) - 1)
        ids = np.searchsorted(self.model.raised, (plain + self.block * (1 << BASE_BITS + 1)).astype(np.int32), "right") - 1 - base
        ids = np.where(at_first | over, first, ids)
        return np.where(at_second, second, ids)

    def update(self, ids: np.ndarray) -> None:
        model = self.model
        hit_one, hit_two = self.one == ids, self.two == ids
        for hit, at, guess, sure, of in ((hit_one, self.at_one, model.one, model.one_sure, self.one_sure), (hit_two, self.at_two, model.two, model.two_sure, self.two_sure)):
            swap = ~hit & (of == 0)
            guess[at[swap]] = ids[swap]
            sure[at] = np.where(hit, np.minimum(of + 1, LEVELS - 1), np.maximum(of - 1, 0))
        n = model.seen.shape[1]
        model.seen[0] += np.bincount(self.kind, minlength=n)
        model.seen[1] += np.bincount(self.kind[hit_one & ~hit_two], minlength=n)
        model.seen[2] += np.bincount(self.kind[hit_two], minlength=n)


def _lanes(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each lane its block and its number of ids."""
    block = np.concatenate([np.full(-(-n // STEPS), b) for b, n in enumerate(sizes)])
    size = np.concatenate([np.minimum(STEPS, n - np.arange(0, n, STEPS)) for n in sizes])
    return block.astype(np.int64), size.astype(np.int64)


def _learns(step: int) -> bool:
    return step & (step - 1) == 0


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's ids as bytes: their number, CRC, the lanes' sizes and the lanes."""
    block, size = _lanes([len(b) for b in blocks])
    ids = np.zeros((len(block), STEPS), np.int64)
    ids[np.arange(STEPS) < size[:, None]] = np.concatenate(blocks)
    model = Model(len(blocks))
    low, span = np.zeros(len(block), np.uint64), np.full(len(block), 0xFFFFFFFFFFFFFFFF, np.uint64)
    out, at = np.zeros((len(block), 2 * STEPS + 16), np.uint16), np.zeros(len(block), np.int64)
    last = before = np.zeros(len(block), np.int64)
    learnt = 0
    full = size.min() == STEPS
    for t in range(STEPS):
        if t and _learns(t):
            part = ids[:, learnt:t]
            inside = np.arange(learnt, t) < size[:, None]
            model.counts += np.bincount((block[:, None] * VOCABULARY + part)[inside], minlength=model.counts.size).reshape(model.counts.shape) * 32
            model.learn()
            learnt = t
        on = slice(None) if full else np.flatnonzero(size > t)
        if not full and len(on) == 0:
            break
        now = ids[on, t]
        step = Step(model, block[on], last[on], before[on])
        begin, width = step.interval(now)
        unit = span[on] >> np.uint64(BASE_BITS + MIX_BITS)
        lo, sp = low[on] + unit * begin, unit * width
        lanes = np.arange(len(block)) if full else on
        while True:
            settled = (lo ^ (lo + sp)) < TOP
            narrow = ~settled & (sp < BOTTOM)
            sp[narrow] = (~lo[narrow] + np.uint64(1)) & (BOTTOM - np.uint64(1))
            ready = np.flatnonzero(settled | narrow)
            if len(ready) == 0:
                break
            out[lanes[ready], at[lanes[ready]]] = (lo[ready] >> np.uint64(48)).astype(np.uint16)
            at[lanes[ready]] += 1
            lo[ready] <<= np.uint64(16)
            sp[ready] <<= np.uint64(16)
        low[on], span[on] = lo, sp
        step.update(now)
        if full:
            last, before = now, last
        else:
            last, before = last.copy(), before.copy()
            before[on] = last[on]
            last[on] = now
    for _ in range(4):
        out[np.arange(len(block)), at] = (low >> np.uint64(48)).astype(np.uint16)
        low <<= np.uint64(16)
        at += 1
    done = []
    for b, part in enumerate(blocks):
        lanes = np.flatnonzero(block == b)
        body = b"".join(out[i, : at[i]].astype("<u2").tobytes() for i in lanes)
        sizes = at[lanes].astype("<u2").tobytes()
        done.append(struct.pack("<III", len(part), zlib.crc32(part.astype("<u4").tobytes()), len(sizes) + len(body)) + sizes + body)
    return done


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that doesn't match its CRC is an error."""
    heads = [struct.unpack_from("<III", b) for b in blocks]
    block, size = _lanes([n for n, _, _ in heads])
    words = []
    for (n, _, _), raw in zip(heads, blocks, strict=True):
        n_lanes = -(-n // STEPS)
        sizes = np.frombuffer(raw, "<u2", n_lanes, 12).astype(np.int64)
        body = np.frombuffer(raw, "<u2", -1, 12 + 2 * n_lanes)
        words.append(np.split(body, np.cumsum(sizes)[:-1]))
    lanes = [w for some in words for w in some]
    source = np.zeros((len(lanes), max(map(len, lanes)) + 8), np.uint16)
    for i, w in enumerate(lanes):
        source[i, : len(w)] = w
    model = Model(len(blocks))
    every = np.arange(len(block))
    low, span = np.zeros(len(block), np.uint64), np.full(len(block), 0xFFFFFFFFFFFFFFFF, np.uint64)
    code, at = np.zeros(len(block), np.uint64), np.zeros(len(block), np.int64)
    for _ in range(4):
        code = code << np.uint64(16) | source[every, at]
        at += 1
    ids = np.zeros((len(block), STEPS), np.int64)
    last = before = np.zeros(len(block), np.int64)
    learnt = 0
    for t in range(STEPS):
        if t and _learns(t):
            inside = np.arange(learnt, t) < size[:, None]
            model.counts += np.bincount((block[:, None] * VOCABULARY + ids[:, learnt:t])[inside], minlength=model.counts.size).reshape(model.counts.shape) * 32
            model.learn()
            learnt = t
        on = np.flatnonzero(size > t)
        if len(on) == 0:
            break
        step = Step(model, block[on], last[on], before[on])
        unit = span[on] >> np.uint64(BASE_BITS + MIX_BITS)
        value = np.minimum((code[on] - low[on]) // unit, np.uint64((1 << BASE_BITS + MIX_BITS) - 1)).astype(np.int64)
        now = step.find(value)
        begin, width = step.interval(now)
        lo, sp, co = low[on] + unit * begin, unit * width, code[on]
        while True:
            settled = (lo ^ (lo + sp)) < TOP
            narrow = ~settled & (sp < BOTTOM)
            sp[narrow] = (~lo[narrow] + np.uint64(1)) & (BOTTOM - np.uint64(1))
            ready = np.flatnonzero(settled | narrow)
            if len(ready) == 0:
                break
            lane = on[ready]
            co[ready] = co[ready] << np.uint64(16) | source[lane, np.minimum(at[lane], source.shape[1] - 1)]
            at[lane] += 1
            lo[ready] <<= np.uint64(16)
            sp[ready] <<= np.uint64(16)
        low[on], span[on], code[on] = lo, sp, co
        step.update(now)
        ids[on, t] = now
        last, before = last.copy(), before.copy()
        before[on] = last[on]
        last[on] = now
    out = []
    for b, (n, crc, _) in enumerate(heads):
        mine = ids[block == b][np.arange(STEPS) < size[block == b][:, None]].astype(np.uint32)
        if len(mine) != n or zlib.crc32(mine.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of ids is damaged")
        out.append(mine)
    return out


FILES = "part int, seq int, name string, n_docs long, n_ids long"
DOCS = "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long"


class _Writer:
    """One file: the magic, blocks of ids, a zlib table of document ids and id counts, and a footer with the
    table's size. Holds at most GROUP blocks, and some bytes for each document."""

    def __init__(self, folder: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.ids"
        self.out = fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.out.write(MAGIC)
        self.waiting, self.docs, self.known, self.counts, self.n_ids = np.zeros(0, np.uint32), [], [], [], 0

    def add(self, docs: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        self.known.append(np.asarray(docs.is_valid(), np.uint8))
        self.docs.append(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.counts.append(n.astype("<u4"))
        self.n_ids += len(ids)
        self.waiting = np.concatenate((self.waiting, ids))
        if len(self.waiting) >= GROUP * BLOCK:
            self._flush(len(self.waiting) // BLOCK * BLOCK)

    def _flush(self, end: int) -> None:
        cuts = [self.waiting[i : min(i + BLOCK, end)] for i in range(0, end, BLOCK)]
        for i in range(0, len(cuts), GROUP):
            for raw in encode_blocks(cuts[i : i + GROUP]):
                self.out.write(raw)
        self.waiting = self.waiting[end:]

    def close(self, part: int, seq: int) -> pa.RecordBatch:
        self._flush(len(self.waiting))
        n_docs = sum(map(len, self.counts))
        tail = zlib.compress(b"".join(x.tobytes() for x in (*self.known, *self.docs, *self.counts)), 6)
        self.out.write(tail + struct.pack("<QQ", n_docs, len(tail)))
        self.out.close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, seq, self.name, n_docs, self.n_ids), kinds, strict=True)], names=["part", "seq", "name", "n_docs", "n_ids"])


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Files of ids in ascending document order; gives a row for each file (part, seq in that order)."""
    spark = docs.sparkSession
    ship(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out, part, seq = _words(vocabulary), None, 0, 0
        for batch, raw, at in slices(batches, "text"):
            if out is None:
                out, part = _Writer(folder), batch.column(2)[0].as_py()
            out.add(batch.column(0), *words.encode(raw, at, end_id))
            if out.n_ids >= file_ids:
                yield out.close(part, seq)
                out, seq = None, seq + 1
        if out is not None:
            yield out.close(part, seq)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(write, FILES), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """For each document of the files: its file (part, seq), id, place of its first id in the file, number of
    ids, and the CRC of the ids."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, seq, name in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    n_docs, n_tail = struct.unpack("<QQ", f.read_at(16, f.size() - 16))
                    end = f.size() - 16 - n_tail
                    tail = zlib.decompress(f.read_at(n_tail, end))
                    known = np.frombuffer(tail, np.uint8, n_docs).astype(bool)
                    docs = np.frombuffer(tail, "<i8", n_docs, n_docs)
                    counts = np.frombuffer(tail, "<u4", n_docs, 9 * n_docs).astype(np.int64)
                    if f.read_at(len(MAGIC), 0) != MAGIC:
                        raise ValueError(f"{name} is no file of ids")
                    at, doc, left, first, crcs, done = len(MAGIC), 0, int(counts[0]), 0, 0, []
                    while at < end:
                        group = []
                        while at < end and len(group) < GROUP:
                            size = 12 + struct.unpack("<III", f.read_at(12, at))[2]
                            group.append(f.read_at(size, at))
                            at += size
                        raw, cut = np.concatenate(decode_blocks(group)).astype("<u4").tobytes(), 0
                        while cut < len(raw):
                            take = min(4 * left, len(raw) - cut)
                            crcs = zlib.crc32(memoryview(raw)[cut : cut + take], crcs)
                            cut, left = cut + take, left - take // 4
                            if left == 0:
                                done.append((part, seq, int(docs[doc]) if known[doc] else None, first, int(counts[doc]), crcs))
                                first, doc, crcs = first + int(counts[doc]), doc + 1, 0
                                left = int(counts[doc]) if doc < n_docs else 0
                        if done:
                            yield _rows(done)
                            done = []

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["part", "seq", "doc_id", "first", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("part", "seq", "name").repartitionByRange(n, "part", "seq").mapInArrow(read, DOCS)


def op10_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "ids")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    start = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    found = read_token_files(files, folder).join(written(start, "token-starts").hint("shuffle_merge"), ["part", "seq"])
    return found.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
