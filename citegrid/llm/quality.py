"""Quality rules: plain word rules first, then how well public tokenisers know a text.

Three measures come from public vocabularies: characters per token and the entropy of the tokens (of a
byte-level BPE), and the share of the text's bytes that a piece vocabulary spells byte by byte. The last is
asked of the piece tokeniser once for each different character: a character is spelt as bytes exactly if no
piece is made of it alone, whatever stands beside it (tests compare with the tokeniser on whole texts).

Each measure has a rejection band for each language: its median plus or minus ``WIDTH`` spreads, where the
spread is half the distance of the quartiles, over all documents of the language that pass the word rules.
Quartiles are exact order statistics of the measures, which are rounded to ``DECIMALS``; they come from counts
of values, so they don't depend on how rows are dealt. A language with few documents leans on the band of all:
its band is the mean of both, weighted by its documents and ``LEAN``, and wider by as much of the distance of
the two medians as it leans, so that its own median lies within. Null is a language too. Means over few words
vary more, so below ``STEADY_WORDS`` words the band widens with the square root.

Words and lines are compared by 64-bit hashes.

Nulls and empty texts have no words and fail the word rules. Repeated documents get a row each. Only the
named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, ship, table, written
from .words import SPACES, mix, per_row, rows_of, shingles, slices, span_hashes, spans

WIDTH = 6.0
STEADY_WORDS = 200
LEAN = 20
DECIMALS = {"chars_per_token": 3, "token_entropy": 4, "byte_fallback": 5}
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _text_key() -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64("text")


def default_vocabularies() -> dict[str, str]:
    import public_tokenizers

    return {"bpe": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "pieces": public_tokenizers.path("piece_bpe_32k.model")}


@functools.lru_cache(maxsize=1)
def _load(files: tuple[tuple[str, str], ...]):
    """Byte-level tokeniser, and the piece tokeniser's way with characters; once for all tasks of a Python process."""
    import sentencepiece
    import tiktoken

    vocabularies = dict(files)
    with open(vocabularies["bpe"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("bpe", pat_str=vocabularies["pattern"], mergeable_ranks=ranks, special_tokens={})
    return bpe, Characters(sentencepiece.SentencePieceProcessor(model_file=vocabularies["pieces"]))


class Characters:
    """How many byte pieces the piece tokeniser makes of a character between two letters."""

    def __init__(self, pieces):
        self.pieces = pieces
        self.bytes = np.full(0x110000, -1, np.int8)

    def byte_pieces(self, points: np.ndarray) -> np.ndarray:
        some = np.unique(points)
        for c in some[self.bytes[some] < 0].tolist():
            self.bytes[c] = sum(map(self.pieces.is_byte, self.pieces.encode(f"a{chr(c)}a")))
        return self.bytes[points]


def _repeats(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    _, where, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[where] > 1


def word_rules(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The word counts of each text of a slice."""
    begins, ends, first = spans(raw, at, SPACES)
    rows = rows_of(first)
    lead = (raw & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    salt = mix(np.arange(len(at), dtype=np.uint64) + np.uint64(1))
    in_three, valid = shingles(span_hashes(raw, begins, ends), first, 3)
    again = np.zeros(len(begins), bool)
    again[valid] = _repeats(mix(in_three[valid]) ^ salt[rows[valid]])
    repeated = again.copy()
    repeated[1:] |= again[:-1]
    repeated[2:] |= again[:-2]
    # Lines: cut at \n and at the ends of texts; those with a word count.
    breaks = np.flatnonzero(raw == 10)
    texts = np.arange(len(at) - 1)
    line_begins = np.concatenate((at[:-1], breaks + 1))
    line_rows = np.concatenate((texts, np.searchsorted(at, breaks, "right") - 1))
    order = np.lexsort((line_begins, line_rows))
    line_begins, line_rows = line_begins[order], line_rows[order]
    line_ends = np.concatenate((line_begins[1:] - 1, [len(raw)])) if len(line_begins) else line_begins
    last = np.concatenate((line_rows[1:] != line_rows[:-1], [True])) if len(line_rows) else np.zeros(0, bool)
    line_ends = np.where(last, at[line_rows + 1], line_ends)
    wordy = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
    line_begins, line_ends, line_rows = line_begins[wordy], line_ends[wordy], line_rows[wordy]
    _, told_first = np.unique(mix(span_hashes(raw, line_begins, line_ends)) ^ salt[line_rows], return_index=True)
    n_rows = len(at) - 1
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": per_row(chars[ends] - chars[begins], first),
        "n_symbols": np.diff(np.concatenate(([0], np.cumsum(SYMBOLS[raw])))[at]),
        "n_dup_lines": np.bincount(line_rows, minlength=n_rows) - np.bincount(line_rows[told_first], minlength=n_rows),
        "n_repeat_words": per_row(repeated, first),
    }


MEASURES = ("chars_per_token", "token_entropy", "byte_fallback")


def measures(docs: DataFrame, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """For each document: the word counts, characters per token, token entropy (bits for each token,
    by the bits that as many different tokens would have), and the share of bytes spelt as bytes; all rounded."""
    ship(docs.sparkSession)
    vocabularies = vocabularies or default_vocabularies()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, characters = _load(tuple(sorted(vocabularies.items())))
        for batch, raw, at in slices(batches, "text"):
            out = word_rules(raw, at)
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            spelt_bytes = np.concatenate(([0], np.cumsum(characters.byte_pieces(points), dtype=np.int64)))
            char_at = np.searchsorted(lead, at)
            n_bytes, n_chars = np.diff(at), np.diff(char_at)
            n_tokens, entropy = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                if text:
                    ids = np.sort(np.asarray(bpe.encode_ordinary(text), np.int32))
                    n = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
                    n_tokens[i] = len(ids)
                    entropy[i] = 1.0 if len(ids) < 2 else 1.0 - (n @ np.log2(n)) / len(ids) / np.log2(len(ids))
            out["chars_per_token"] = n_chars / np.maximum(n_tokens, 1)
            out["token_entropy"] = entropy
            out["byte_fallback"] = np.diff(spelt_bytes[char_at]) / np.maximum(n_bytes, 1)
            arrays = [*batch.columns[:3], *(pa.array(np.round(v, DECIMALS[k]) if k in DECIMALS else v) for k, v in out.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "text_key", *out])

    kinds = docs.schema
    schema = f"doc_id {kinds['doc_id'].dataType.simpleString()}, lang {kinds['lang'].dataType.simpleString()}, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{m} double" for m in MEASURES)
    return docs.select("doc_id", "lang", _text_key().alias("text_key"), "text").mapInArrow(measure, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    good = written(judged(docs).filter("kept").select(F.col("doc_id").alias("good_id"), F.col("text_key").alias("good_key")), "quality-good")
    return docs.join(good.hint("shuffle_merge"), docs["doc_id"].eqNullSafe(good["good_id"]) & (_text_key() == good["good_key"]), "left_semi")


def quartiles(m: DataFrame) -> DataFrame:
    """For each language (null too) and each measure: n, low, mid and high, the values at a quarter, half and
    three quarters of the rows in order; for all languages together with ``every`` true.

    Values are counted before anything is ordered: a language has at most some 100,000 different ones, as
    the measures are bounded and rounded."""
    value = F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in MEASURES)), F.array(*MEASURES))).alias("measure", "value")
    counts = m.select("lang", value).groupBy("lang", "measure", "value").agg(F.count(F.lit(1)).alias("times"))
    counts = written(counts, "quality-counts")
    both = counts.select(F.lit(False).alias("every"), "lang", "measure", "value", "times").unionByName(
        counts.groupBy("measure", "value").agg(F.sum("times").alias("times")).select(F.lit(True).alias("every"), F.lit(None).cast(m.schema["lang"].dataType).alias("lang"), "measure", "value", "times")
    )
    group = ["every", "lang", "measure"]
    told = both.withColumn("upto", F.sum("times").over(Window.partitionBy(*group).orderBy("value"))).withColumn("n", F.sum("times").over(Window.partitionBy(*group)))
    cut = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("n") * q, F.col("value")))
    found = written(told.groupBy(*group).agg(F.first("n").alias("n"), *(cut(q).alias(c) for q, c in ((1, "low"), (2, "mid"), (3, "high")))), "quality-quartiles")
    drop_written(counts)
    return found


def bands(m: DataFrame) -> DataFrame:
    """For each language the centre and spread of each measure, c_... and w_..."""
    cuts = quartiles(m)
    spread = F.greatest((F.col("high") - F.col("low")) / 2, 0.01 * F.abs("mid"), F.lit(1e-3))
    own = cuts.filter("not every").select("lang", "measure", "n", "mid", spread.alias("spread"))
    every = cuts.filter("every").select("measure", F.col("mid").alias("mid_all"), spread.alias("spread_all"))  # a row for each measure
    lean = F.lit(LEAN) / (F.col("n") + LEAN)
    centre = F.col("mid") + lean * (F.col("mid_all") - F.col("mid"))
    wide = F.col("spread") + lean * (F.col("spread_all") - F.col("spread")) + lean * F.abs(F.col("mid_all") - F.col("mid"))
    joined = own.join(F.broadcast(every), "measure").select("lang", "measure", centre.alias("c"), wide.alias("w"))
    return joined.groupBy("lang").agg(*(F.max(F.when(F.col("measure") == k, F.col(x))).alias(f"{x}_{k}") for k in MEASURES for x in "cw"))


def judged(docs: DataFrame, vocabularies: dict[str, str] | None = None, width: float = WIDTH) -> DataFrame:
    """The measures with ``base_failed`` (the word rules) and ``kept``."""
    m = written(measures(docs, vocabularies), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    # Written and read back, so that Spark knows its size and broadcasts it only if it is small.
    band = written(bands(m.filter("not base_failed")).withColumnRenamed("lang", "band"), "quality-bands")
    wider = F.sqrt(F.greatest(F.lit(1.0), STEADY_WORDS / F.greatest(F.col("n_words"), F.lit(1))))
    fine = F.lit(True)
    for k in MEASURES:
        fine = fine & (F.abs(F.col(k) - F.col(f"c_{k}")) <= width * F.col(f"w_{k}") * wider)
    joined = m.join(band, m["lang"].eqNullSafe(band["band"]), "left")
    return joined.select(*m.columns, (~F.col("base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"))


def op9_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("lang", "text_key")
