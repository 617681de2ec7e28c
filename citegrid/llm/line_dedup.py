"""Line dedup: an exact set-similarity join of lines; a line goes if an earlier one is as it or near it.

A line's tokens are its distinct parts between spaces; two lines match if ``100 * both >= 80 * either``.
Lines are ordered by (doc_id, line number), and a line is removed if it matches any earlier line, kept or
not; lines without tokens always stay.

1. Tokens are ordered by rarity (counts of all tokens in ``BUCKETS`` buckets, by half powers of two; ties by
   hash). Equal token sets are one class, of which only the first line goes on.
2. Lines that match share a token of their prefixes (the ``n - ceil(0.8 n) + 1`` rarest). What is left of two
   lines from their first common token on, their lengths and parity maps of the sets bound the overlap of
   lines that meet at a token; none loses a match. A map tells little of sets that have more tokens than it has
   bits, so lines of more than ``LONG`` tokens carry more maps: unlike ones that meet would make pairs of all.
3. Each line is first tried against a few lines at ``STAR`` of its prefix tokens (those of least hash, which
   near copies mostly have in common, while the rarest are often what sets them apart): those there are dealt
   into ``HEADS`` parts by a hash, and the earliest of each part is tried. Only lines that found no match then
   meet all earlier lines at all prefix tokens: one match is enough, so a group of near copies makes no pairs
   of all.
   Both joins go through the tokens in ``PARTS`` parts, one after the other, so that only one part's rows
   are in shuffle files at a time.
4. Candidates' tokens are read again and compared exactly, in ``PARTS`` parts by the earlier line.

Only DataFrame functions run here. Nulls: a null text has no lines; a null id is the least id. Rows with
one id count as one document with the lines of all of them. An empty table gives no rows. Only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, table, written

PERCENT = 80
BUCKETS = 1 << 16
STAR = 3
HEADS = 8
PARTS = 4
NEEDED_BITS = 1 << 21
NO_ID = -(1 << 63)
#: Parity maps of longer lines: together 256 bits, which tell unlike lines of some 450 tokens apart.
LONG = 64
WIDE = [f"parity{i}" for i in range(4)]
LINE = ["doc", "line"]


def _constant(numbers: list[int], kind: str) -> Column:
    """An array that Spark folds to one constant."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def _lines(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    return docs.select(doc, F.posexplode(F.split("text", "\n")).alias("line", "words"))


def _ranks(docs: DataFrame) -> Column:
    """For each bucket of tokens a rank that grows with its count, in the bits above a key's hash. The last token
    of a line is counted with what it touches: an order needn't be exact, and cutting lines too costs as much again."""
    token = docs.select(F.explode(F.split("text", " ")).alias("t")).filter("t != ''")
    counts = token.groupBy(F.xxhash64("t").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).count().collect()  # BUCKETS rows at most
    ranks = [0] * BUCKETS
    for r in counts:
        ranks[r["b"]] = 2 * r["count"].bit_length() + (r["count"] >> max(r["count"].bit_length() - 2, 0) & 1) << 56
    return _constant(ranks, "long")


def _keys(words: Column, ranks: Column) -> Column:
    """The distinct tokens of a line as numbers, rarest first: the rank in the high bits, then the hash."""

    def key(t: Column) -> Column:
        h = F.xxhash64(t)
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0))
        return rank.bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(words, " "), ""), key)))


def _parity(keys: Column) -> Column:
    """For each of 64 bits, whether an odd number of keys has its number."""
    one = F.lit(1).cast("long")
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(63).cast("int"))))


def _may_match(x: str, y: str, n: Column, m: Column, percent: int) -> Column:
    """Whether lines of ``n`` and ``m`` tokens that meet at their first common token may match: by their lengths,
    by what each has from that token on, and by their parity maps."""
    both = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    apart = lambda m: F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}")))
    near = lambda d: (100 + percent) * d <= (100 - percent) * (n + m)
    sizes = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * both >= percent * (n + m))
    return sizes & near(apart("parity")) & ((F.least(n, m) <= LONG) | near(reduce(Column.__add__, map(apart, WIDE))))


def _earlier(x: str, y: str) -> Column:
    return (F.col(f"{x}.doc") < F.col(f"{y}.doc")) | ((F.col(f"{x}.doc") == F.col(f"{y}.doc")) & (F.col(f"{x}.line") < F.col(f"{y}.line")))


def _matches(docs: DataFrame, pairs: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """Distinct later lines of the candidate pairs (xd, xl, doc, line) that match."""
    needed = written(pairs.select(F.col("xd").alias("doc"), F.col("xl").alias("line")).unionByName(pairs.select(*LINE)).distinct(), "lines-needed")
    bit = F.pmod(F.xxhash64(*LINE), F.lit(NEEDED_BITS))
    words = needed.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("b")).collect()  # NEEDED_BITS / 64 rows at most
    flags = [0] * (NEEDED_BITS // 64)
    for r in words:
        flags[r["w"]] = r["b"]
    # Most other lines are passed over before their tokens are looked at.
    may = F.expr("shiftright(flag, int(bit % 64)) & 1") == 1
    lines = _lines(docs).withColumn("bit", bit).withColumn("flag", F.get(_constant(flags, "long"), F.shiftright("bit", 6).cast("int"))).filter(may)
    sets = lines.select(*LINE, _keys(F.col("words"), ranks).alias("keys")).join(needed.hint("shuffle_merge"), LINE, "left_semi").dropDuplicates(LINE)
    sets = written(sets, "lines-sets")
    x = sets.select(F.col("doc").alias("xd"), F.col("line").alias("xl"), F.col("keys").alias("x"))
    both = F.size(F.array_intersect("x", "keys"))
    # A pair takes the earlier line's keys through a shuffle: part by part, so that not all are on disk at once.
    some = []
    for i in range(PARTS):
        mine = F.pmod(F.xxhash64("xd", "xl"), F.lit(PARTS)) == i
        part = pairs.filter(mine).join(x.filter(mine).hint("shuffle_merge"), ["xd", "xl"]).join(sets.hint("shuffle_merge"), LINE)
        some.append(written(part.filter((100 + percent) * both >= percent * (F.size("x") + F.size("keys"))).select(*LINE).distinct(), "lines-matched-part"))
    found = written(reduce(DataFrame.unionByName, some).distinct(), "lines-matched")
    for t in some:
        drop_written(t)
    drop_written(needed)
    drop_written(sets)
    return found


def _in_parts(rows: DataFrame, pairs: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Distinct ``pairs`` of the ``rows`` of all tokens, made part by part."""
    some = [written(pairs(rows.filter(F.pmod("token", F.lit(PARTS)) == i)).distinct(), f"{name}-part") for i in range(PARTS)]
    every = written(reduce(DataFrame.unionByName, some).distinct(), name)
    for t in some:
        drop_written(t)
    return every


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The lines to remove (doc, line, why: exact or near), and the number of each document's lines with
    tokens (doc, n_lines)."""
    docs = docs.select("doc_id", "text")
    ranks = _ranks(docs)
    keys = _lines(docs).filter(F.trim("words") != "").select(*LINE, _keys(F.col("words"), ranks).alias("keys"))
    n = F.size("keys")
    least = -F.floor(-percent * n / 100)
    maps = ["parity", *WIDE]
    token = lambda k: k.bitwiseAND((1 << 31) - 1).cast("int")
    part = lambda i: F.filter("keys", lambda k: F.shiftright(k, 6).bitwiseAND(len(WIDE) - 1) == i)
    lines = written(
        keys.select(
            *LINE,
            F.xxhash64("keys").alias("h1"),
            F.xxhash64("keys", F.lit(1)).alias("h2"),
            n.alias("n"),
            _parity(F.col("keys")).alias("parity"),
            *(F.when(n > LONG, _parity(part(i))).otherwise(0).alias(m) for i, m in enumerate(WIDE)),
            F.transform(F.slice("keys", F.lit(1), (n - least + 1).cast("int")), token).alias("prefix"),
        ),
        "lines",
    )
    classes = lines.groupBy("h1", "h2").agg(F.min(F.struct(*LINE, "n", *maps, "prefix")).alias("f"), F.count(F.lit(1)).alias("times"))
    classes = written(classes.select("h1", "h2", "times", "f.*"), "lines-classes")
    several = classes.filter("times > 1").select("h1", "h2", F.col("doc").alias("fd"), F.col("line").alias("fl"))
    exact = lines.select(*LINE, "h1", "h2").join(several.hint("shuffle_merge"), ["h1", "h2"]).filter("doc != fd or line != fl").select(*LINE, F.lit("exact").alias("why")).distinct()
    exact = written(exact, "lines-exact")
    counts = written(lines.select(*LINE).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines")), "lines-counts")
    drop_written(lines)

    classes_only = classes.drop("h1", "h2", "times")

    ends = (F.col("x.doc").alias("xd"), F.col("x.line").alias("xl"), "y.doc", "y.line")

    # A few early lines at each of those tokens, with every later line there.
    def with_heads(stars: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(*LINE), F.lit(HEADS))
        heads = stars.groupBy("token", part.alias("part")).agg(F.min(F.struct(*LINE, "n", "pos", *maps)).alias("x")).select("token", "x")
        near = stars.select("token", F.struct(*LINE, "n", "pos", *maps).alias("y")).join(heads.hint("shuffle_merge"), "token")
        return near.filter(_earlier("x", "y") & _may_match("x", "y", F.col("x.n"), F.col("y.n"), percent)).select(*ends)

    stars = classes_only.select(*LINE, "n", *maps, F.lit(0).alias("pos"), F.explode(F.slice(F.sort_array("prefix"), 1, STAR)).alias("token"))
    near = _in_parts(stars, with_heads, "lines-near")
    matched = _matches(docs, near, ranks, percent)

    # Lines still without a match, with all earlier ones. ``open_n`` is 0 for those that have one: they are too short to be the later line.
    openness = classes_only.join(matched.withColumn("found", F.lit(True)).hint("shuffle_merge"), LINE, "left").withColumn("open_n", F.when(F.col("found"), 0).otherwise(F.col("n")))
    openness = written(openness.drop("found"), "lines-open")
    for t in (classes, near):
        drop_written(t)

    def with_earlier(meeting: DataFrame) -> DataFrame:
        x, y = meeting.alias("x"), meeting.alias("y")
        # Both sides read the same columns, so Spark shuffles the tokens once.
        bounds = _may_match("x", "y", F.greatest("x.n", "x.open_n"), F.col("y.n"), percent) & (100 * F.col("y.open_n") >= percent * F.col("x.n"))
        return x.join(y.hint("shuffle_merge"), (F.col("x.token") == F.col("y.token")) & _earlier("x", "y") & bounds).select(*ends)

    far = _in_parts(openness.select(*LINE, "n", "open_n", *maps, F.posexplode("prefix").alias("pos", "token")), with_earlier, "lines-far")
    drop_written(openness)
    more = _matches(docs, far, ranks, percent)
    removed = written(exact.unionByName(matched.unionByName(more).distinct().withColumn("why", F.lit("near"))), "lines-removed")
    for t in (exact, far, matched, more):
        drop_written(t)
    return removed, counts


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut from their texts; all columns stay."""
    gone = removed.groupBy("doc").agg(F.collect_set("line").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(gone.hint("shuffle_merge"), "doc", "left")
    return joined.select(*(text.alias("text") if c == "text" else c for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed, counts = removed_lines(docs)
    by_doc = removed.groupBy("doc").agg(
        F.count_if(F.col("why") == "exact").alias("n_exact"), F.count_if(F.col("why") == "near").alias("n_near"), F.array_sort(F.collect_set("line")).alias("removed_lines")
    )
    found = counts.join(by_doc.hint("shuffle_merge"), "doc", "left")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    zero = F.lit(0).cast("long")
    return rows.join(found.hint("shuffle_merge"), "doc", "left").select(
        "doc_id",
        F.coalesce("n_lines", zero).alias("n_lines"),
        F.coalesce("n_exact", zero).alias("n_exact"),
        F.coalesce("n_near", zero).alias("n_near"),
        F.coalesce(F.array_join("removed_lines", ","), F.lit("")).alias("removed_lines"),
    )


OP2_SQL = f"""
WITH parts AS (
  SELECT coalesce(CAST(doc_id AS BIGINT), {NO_ID + 1} - 1) AS doc, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL
), cut AS (
  SELECT doc, i - 1 AS line, list_sort(list_distinct(list_filter(string_split(p[i], ' '), lambda t: t <> ''))) AS s
  FROM (SELECT doc, p, unnest(range(1, len(p) + 1)) AS i FROM parts)
), lines AS (
  SELECT doc, line, s, len(s) AS n, row_number() OVER (ORDER BY doc, line) AS ord FROM cut WHERE len(s) > 0
), classes AS (
  SELECT s, any_value(n) AS n, min(ord) AS ord FROM lines GROUP BY s
), tokens AS (
  SELECT ord, n, unnest(s) AS t FROM classes
), ranked AS (
  SELECT ord, n, t, row_number() OVER (PARTITION BY ord ORDER BY df, t) AS place FROM tokens JOIN (SELECT t, count(*) AS df FROM tokens GROUP BY t) USING (t)
), prefixes AS (
  SELECT ord, n, t FROM ranked WHERE place <= n - CAST(ceil({PERCENT} * n / 100.0) AS BIGINT) + 1
), pairs AS (
  SELECT DISTINCT x.ord AS x, y.ord AS y FROM prefixes x JOIN prefixes y ON x.t = y.t AND x.ord < y.ord AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)
), matched AS (
  SELECT DISTINCT y AS ord FROM pairs JOIN classes a ON a.ord = x JOIN classes b ON b.ord = y
  WHERE {100 + PERCENT} * len(list_intersect(a.s, b.s)) >= {PERCENT} * (a.n + b.n)
), gone AS (
  SELECT doc, line, l.ord <> c.ord AS exact FROM lines l JOIN classes c USING (s) WHERE l.ord <> c.ord OR l.ord IN (SELECT ord FROM matched)
), by_doc AS (
  SELECT doc, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_near, string_agg(line, ',' ORDER BY line) AS ids FROM gone GROUP BY doc
), counts AS (
  SELECT doc, count(*) AS n_lines FROM lines GROUP BY doc
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(ids, '') AS removed_lines
FROM documents d LEFT JOIN counts c ON c.doc = coalesce(d.doc_id, {NO_ID + 1} - 1) LEFT JOIN by_doc b ON b.doc = c.doc
"""
