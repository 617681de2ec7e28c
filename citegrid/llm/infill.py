"""Fill-in-middle transformation: a text becomes prefix, suffix and middle, cut between tokens.

A token is a word with the blanks before it, or the blanks at the text's end. Where tokens end is found without
reading a shared passage twice:

1. A rolling hash over the last WINDOW bytes cuts texts into chunks where its high bits are zero, so equal passages
   are cut alike, wherever they stand. A chunk has MIN_CHUNK to MAX_CHUNK bytes, the last of a text any size.
2. A task keeps a summary for each chunk content that it met, looked up by the content itself: words, characters, and
   whether the first and the last byte lie in a word. The cache is emptied when it holds CACHE_BYTES.
3. Summaries of neighbours combine to running counts of tokens: a word that goes on from one chunk to the next counts
   once. A cut after so many tokens is found by bisection over the chunks, and one chunk is searched for the word.

The draws are hashes of seed and id, so any run gives the same output. Python finds the two cuts only; form, output
and the way back are columns.

Nulls: a null text is empty; a null id counts as an empty one in the draws. An empty text, and one that has a marker,
stays plain. A text of blanks is one token. Ties do not occur; repeated rows get the same output each. Very long
texts are cut like others, in slices of whole texts. An empty table gives no rows. Further columns pass
through; one named like a new column is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .words import SPACES, slices, window_hashes

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

WINDOW = 32
CUT_BITS = 9
MIN_CHUNK = 64
MAX_CHUNK = 8192
CACHE_BYTES = 32 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_INNER_BYTES = bytes(range(0x80, 0xC0))  # bytes of a character after its first


def characters(data: bytes) -> int:
    return len(data.translate(None, _INNER_BYTES))


class Chunks:
    """Cuts texts into chunks and remembers what it counted in each content."""

    def __init__(self, cache_bytes: int = CACHE_BYTES):
        self.known: dict[bytes, tuple[int, bool, bool, int]] = {}
        self.limit, self.held, self.hits, self.misses = cache_bytes, 0, 0, 0

    def summary(self, chunk: bytes) -> tuple[int, bool, bool, int]:
        """Words, whether the first and the last byte lie in a word, and characters."""
        told = self.known.get(chunk)
        if told is not None:
            self.hits += 1
            return told
        self.misses += 1
        told = len(chunk.split()), not SPACES[chunk[0]], not SPACES[chunk[-1]], characters(chunk)
        if self.held > self.limit:
            self.known.clear()
            self.held = 0
        self.known[chunk] = told
        self.held += len(chunk) + 200
        return told

    @staticmethod
    def ends(marks: list[int], size: int) -> list[int]:
        """Where the chunks of a text of ``size`` bytes end; ``marks`` are ends that the rolling hash allows."""
        out, at = [], 0
        while at < size:
            i = bisect_left(marks, at + MIN_CHUNK)
            at = min(marks[i] if i < len(marks) else size, at + MAX_CHUNK, size)
            out.append(at)
        return out

    def counted(self, text: bytes, marks: list[int]) -> Counted:
        ends = self.ends(marks, len(text))
        told = [self.summary(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        goes_on = [False, *(x[2] and y[1] for x, y in zip(told, told[1:], strict=False))]
        begun = list(accumulate(t[0] - g for t, g in zip(told, goes_on, strict=False)))
        return Counted(text, ends, goes_on, begun, list(accumulate(t[3] for t in told)), bool(told) and not told[-1][2])


class Counted:
    """A text's chunks with running counts: words begun and characters up to each chunk's end."""

    def __init__(self, text: bytes, ends: list[int], goes_on: list[bool], begun: list[int], chars: list[int], blanks_last: bool):
        self.text, self.ends, self.goes_on, self.begun, self.chars = text, ends, goes_on, begun, chars
        self.words = begun[-1] if begun else 0
        self.n = self.words + blanks_last

    def chars_before(self, tokens: int) -> int:
        """Characters of the first ``tokens`` tokens."""
        if tokens == 0:
            return 0
        if tokens == self.n:
            return self.chars[-1]
        j = bisect_left(self.begun, tokens)
        begin = self.ends[j - 1] if j else 0
        number = tokens - (self.begun[j - 1] if j else 0) + self.goes_on[j]  # of the word within the chunk
        word = next(islice(_WORD.finditer(self.text, begin, self.ends[j]), number - 1, None))
        stop = _BLANK.search(self.text, word.end()) if word.end() == self.ends[j] else None
        end = word.end() if word.end() < self.ends[j] else stop.start() if stop else len(self.text)
        return (self.chars[j - 1] if j else 0) + characters(self.text[begin:end])


def marks_of(raw: np.ndarray) -> np.ndarray:
    """Places (after a byte) where the rolling hash of the WINDOW bytes before allows a chunk to end."""
    hashes = window_hashes(raw, WINDOW)
    return np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + WINDOW


_CUTS = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    chunks = Chunks()

    def rows() -> Iterator[pa.RecordBatch]:
        for arrays in batches:
            yield pa.RecordBatch.from_arrays(list(arrays), names=["text", "h1", "h2", "wanted"])

    for whole in rows():
        parts = []
        for batch, raw, at in slices(iter([whole]), "text"):
            marks, data = marks_of(raw), raw.tobytes()
            low, high = np.searchsorted(marks, at[:-1] + WINDOW), np.searchsorted(marks, at[1:], "right")
            h1, h2, wanted = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = []
            for r in range(batch.num_rows):
                a, b = int(at[r]), int(at[r + 1])
                c = chunks.counted(data[a:b], (marks[low[r] : high[r]] - a).tolist())
                if not wanted[r]:
                    out.append({"n": c.n, "prefix_chars": None, "middle_chars": None})
                    continue
                x, y = sorted((h1[r] % (c.n + 1), h2[r] % (c.n + 1)))
                prefix = c.chars_before(x)
                out.append({"n": c.n, "prefix_chars": prefix, "middle_chars": c.chars_before(y) - prefix})
            parts.append(pa.array(out, _CUTS))
        yield pa.concat_arrays(parts) if parts else pa.array([], _CUTS)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 from seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    ship(docs.sparkSession)
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    found = F.arrow_udf(_cuts, "n long, prefix_chars long, middle_chars long")
    names = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    rows = docs.select(*names, form.alias("form"), found(F.col("text"), h1, h2, ~plain).alias("_cuts"))
    rows = rows.select(*names, F.col("_cuts.n").alias("n"), "form", F.col("_cuts.prefix_chars").alias("prefix_chars"), F.col("_cuts.middle_chars").alias("middle_chars"))
    end = (F.col("prefix_chars") + F.col("middle_chars")).cast("int")
    prefix = F.substring(text, F.lit(1), F.col("prefix_chars").cast("int"))
    middle = F.substring(text, F.col("prefix_chars").cast("int") + 1, F.col("middle_chars").cast("int"))
    suffix = F.substring(text, end + 1, F.char_length(text))
    psm, spm = ((PREFIX, prefix), (SUFFIX, suffix)), ((SUFFIX, suffix), (PREFIX, prefix))
    told = {name: F.concat(*(x for mark, part in (*order, (MIDDLE, middle)) for x in (F.lit(mark), part))) for name, order in (("psm", psm), ("spm", spm))}
    return rows.withColumn("output", F.when(F.col("form") == "psm", told["psm"]).when(F.col("form") == "spm", told["spm"]).otherwise(text))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No text with a marker is cut, so the first marker of a kind is the one
    that was put in."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        i, j = F.instr(body, second), F.instr(body, MIDDLE)
        rest = lambda at: F.substring(body, at, F.char_length(body))
        return F.substring(body, F.lit(1), i - 1), F.substring(body, i + len(second), j - i - len(second)), rest(j + len(MIDDLE))

    a, b, middle = parts(PREFIX, SUFFIX)
    c, d, spm_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(a, middle, b)).when(form == "spm", F.concat(d, spm_middle, c)).otherwise(output)


def op11_infill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
