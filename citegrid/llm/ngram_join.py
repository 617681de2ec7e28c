"""N-gram Jaccard join: sets of word shingles, all pairs with ``100 * both >= 90 * either``, and the
components that these links make.

1. A global order of shingles: by how common their words are (counts of all words, in 2 ** 16 buckets),
   shingles found common among prefixes last of all. Any order gives the same links; a good one few
   candidates.
2. Equal sets are one class, named by a 128-bit fingerprint, with the least document as its member.
3. Two sets that link share a shingle of their prefixes (the first ``n - ceil(0.9 n) + 1`` shingles). Sets
   that meet at a shingle are candidates if their lengths, what each has from that shingle on (none before it
   need be common: one meeting is at the first common shingle) and bitmaps of the sets allow the overlap; none
   of these bounds loses a link.
4. Candidates of one set are put into a trie along the global order and walked with that set: stretches
   that several share are compared once, and a subtree ends where its overlap so far and what remains
   can't reach the least overlap.
5. First each set is tried against ``HEADS`` sets at each of ``STAR`` prefix shingles (those of least hash;
   sets that meet many others are tried first), and the components of these links are found. Where more than
   ``CROWD`` sets of several components meet, each is tried against ``MORE_HEADS`` others there that are least apart from
   the rest, in up to ``ROUNDS`` rounds; then every pair at a prefix shingle whose components differ. So a large group of near copies does not
   make all its pairs, and no link between components is lost.

Texts are shingled again wherever needed, for candidates only those that a map of the needed texts' hashes lets through;
whole sets are shuffled only for candidates. Shingles are known by
56 bits of a hash, sets by 128.

Nulls: a null or wordless text has an empty set, and its component is its own id. A component's name is its
least id that is not null, or null if it has no other; rows with one id and different texts are sets of their
own. Repeated rows get a row each. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, ship, table, written
from .components import connected_components
from .words import LOWER, SPACES, mix, rows_of, shingles, slices, span_hashes, spans

SHINGLE = 3
PERCENT = 90
BUCKETS = 1 << 16
COMMON = 100_000
NEEDED_BITS = 1 << 22
STAR = 4
HEADS = 4
CROWD = 64
ROUNDS = 3
MORE_HEADS = 16
MAPS = ("m0", "m1", "m2", "m3")
#: A second map of 512 bits, only for sets that still meet others after the first round.
MORE_MAPS = tuple(f"w{j}" for j in range(8))
ID = ["f1", "f2"]


class Sets:
    """The shingle sets of a slice: keys in global order, row after row."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, k: int, ranks: np.ndarray, common: np.ndarray, common_keys: np.ndarray):
        begins, ends, first = spans(raw, at, SPACES)
        words = span_hashes(LOWER[raw], begins, ends)
        weight = ranks[(words >> np.uint64(48)).astype(np.int64)]
        hashes, valid = shingles(words, first, k)
        total = np.concatenate(([0], np.cumsum(weight)))
        keep = np.flatnonzero(valid)
        rows, n = rows_of(first)[keep], np.diff(first)
        keys, weights = hashes[keep], total[keep + k] - total[keep]
        short = np.flatnonzero((n > 0) & (n < k))
        for j in range(1, k):  # texts of j words: the whole sequence
            some = short[n[short] == j]
            of_j, _ = shingles(words, first, j)
            keys = np.concatenate((keys, mix(of_j[first[some]] + np.uint64(j))))
            weights = np.concatenate((weights, total[first[some] + j] - total[first[some]]))
            rows = np.concatenate((rows, some))
        keys = self.packed(keys, np.minimum(weights, 199))
        if len(common):
            i = np.minimum(np.searchsorted(common, keys), len(common) - 1)
            keys = np.where(common[i] == keys, common_keys[i], keys)
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        self.keys, self.rows = keys[new], rows[new]
        self.first = np.searchsorted(self.rows, np.arange(len(at)))
        self.n = np.diff(self.first)
        spread = mix(self.keys)
        sums = np.zeros((2, len(spread) + 1), np.uint64)
        np.cumsum(spread, out=sums[0, 1:])
        np.cumsum(mix(self.keys + np.uint64(0x632BE59BD9B4E019)), out=sums[1, 1:])
        self.f1, self.f2 = ((s[self.first[1:]] - s[self.first[:-1]]).view(np.int64) for s in sums)
        self.spread = spread

    @staticmethod
    def packed(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weight in the high bits, so that keys sort in the global order."""
        return (hashes & np.uint64((1 << 56) - 1)) | (weights.astype(np.uint64) << np.uint64(56))

    def bitmaps(self, size: int = 256, shift: int = 56) -> list[np.ndarray]:
        """A parity map of each set: two maps differ in at most as many bits as the sets in shingles."""
        bits = (self.spread >> np.uint64(shift)).astype(np.int64) & (size - 1)
        flags = np.bincount(self.rows * size + bits, minlength=size * len(self.n)).reshape(-1, size) & 1
        packed = np.packbits(flags.astype(np.uint8), axis=1).view(np.int64)
        return [packed[:, j] for j in range(size // 64)]


def _scan(docs: DataFrame, schema: str, rows, orders, k: int, columns: list[str], flags=None) -> DataFrame:
    """``rows(batch, sets, seen)`` for each slice; ``seen`` has fingerprints of earlier slices of the task. With ``flags``,
    only texts whose key has its bit there are shingled (``text_key`` is the first of ``columns`` then)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, common, common_keys = orders.value
        seen: set = set()
        for batch, raw, at in slices(batches if flags is None else _flagged(batches, flags.value), "text"):
            sets = Sets(raw, at, k, ranks, common, common_keys)
            if len(seen) > 200_000:
                seen.clear()
            yield rows(batch, sets, seen)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def _flagged(batches: Iterator[pa.RecordBatch], flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose text key has its bit in ``flags``."""
    for batch in batches:
        low = batch.column(0).to_numpy(zero_copy_only=False) & (NEEDED_BITS - 1)
        batch = batch.filter(pa.array((flags[low >> 6] >> (low & 63)) & 1 == 1))
        if batch.num_rows:
            yield batch


def _new_rows(sets: Sets, seen: set) -> np.ndarray:
    """Rows with a set that is not empty and that the task hasn't had yet."""
    fresh = np.zeros(len(sets.n), bool)
    for r, (n, fp) in enumerate(zip(sets.n.tolist(), zip(sets.f1.tolist(), sets.f2.tolist(), strict=True), strict=True)):
        if n and fp not in seen:
            seen.add(fp)
            fresh[r] = True
    return fresh


def _word_ranks(docs: DataFrame) -> np.ndarray:
    """For each bucket of words a weight that grows with the logarithm of its count over all texts."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, raw, at in slices(batches, "text"):
            begins, ends, _ = spans(raw, at, SPACES)
            total += np.bincount((span_hashes(LOWER[raw], begins, ends) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    ranks = np.zeros(BUCKETS, np.int64)
    ranks[counts["bucket"].to_numpy(np.int64)] = np.round(1.5 * np.log2(counts["n"].to_numpy(np.float64) + 1)).astype(np.int64)
    return ranks


def _prefix(sets: Sets, fresh: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the prefixes' keys, and the position of each in its set."""
    least = -(-percent * sets.n // 100)
    size = np.where(fresh, sets.n - least + 1, 0)
    start = np.repeat(sets.first[:-1], size)
    position = np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)
    return start + position, position


def _postings(docs: DataFrame, orders, k: int, percent: int) -> DataFrame:
    def rows(batch: pa.RecordBatch, sets: Sets, seen: set) -> pa.RecordBatch:
        place, position = _prefix(sets, _new_rows(sets, seen), percent)
        r = sets.rows[place]
        columns = [sets.keys[place].view(np.int64), sets.f1[r], sets.f2[r], sets.n[r], position, *(m[r] for m in sets.bitmaps())]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", *ID, "n", "pos", *MAPS])

    return _scan(docs, "key long, f1 long, f2 long, n long, pos long, m0 long, m1 long, m2 long, m3 long", rows, orders, k, [])


def _common_keys(docs: DataFrame, orders, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON keys that most prefixes have, and their keys at the end of the order."""

    def rows(batch: pa.RecordBatch, sets: Sets, seen: set) -> pa.RecordBatch:
        place, _ = _prefix(sets, _new_rows(sets, seen), percent)
        return pa.RecordBatch.from_arrays([pa.array(sets.keys[place].view(np.int64))], names=["key"])

    counts = _scan(docs, "key long", rows, orders, k, []).groupBy("key").count().filter("count >= 4")
    top = counts.orderBy(F.desc("count"), "key").limit(COMMON).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    weights = 200 + np.minimum(np.round(2 * np.log2(top["count"].to_numpy(np.float64) + 1)), 55).astype(np.int64)
    return keys[order], Sets.packed(keys, weights)[order]


def _distance(x: Column, y: Column, maps: tuple[str, ...]) -> Column:
    """Bits in which two sets' maps differ."""
    return sum((F.bit_count(x[m].bitwiseXOR(y[m])) for m in maps), F.lit(0))


def _possible(x: Column, y: Column, percent: int, *maps: tuple[str, ...]) -> Column:
    """Whether lengths, positions of the first common shingle and bitmaps leave room for the overlap that a link needs."""
    both, total = F.least(x["n"] - x["pos"], y["n"] - y["pos"]), x["n"] + y["n"]
    # both / (total - both) >= p / 100 is both * (100 + p) >= p * total; total - 2 both differ.
    may = (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & ((100 + percent) * both >= percent * total)
    for of in maps or (MAPS,):
        may &= (100 + percent) * _distance(x, y, of) <= (100 - percent) * total
    return may


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a1, a2, b1, b2), a before b."""
    swap = (F.col("x.f1") > F.col("y.f1")) | ((F.col("x.f1") == F.col("y.f1")) & (F.col("x.f2") > F.col("y.f2")))
    return found.select(*(F.when(swap, F.col(f"{q}.{f}")).otherwise(F.col(f"{p}.{f}")).alias(f"{t}{f[1]}") for t, p, q in (("a", "x", "y"), ("b", "y", "x")) for f in ID)).distinct()


def _walk(probe: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """Numbers of the sets that link with ``probe``. ``members`` are in lexicographic order, so that those
    from ``low`` to ``high`` with a common beginning are a subtree of their trie."""
    linked: list[int] = []
    stack = [(0, len(members), 0, 0)]
    while stack:
        low, high, depth, both = stack.pop()
        one, last = members[low], members[high - 1]
        size = min(len(one), len(last))
        differ = np.flatnonzero(one[depth:size] != last[depth:size])
        end = depth + int(differ[0]) if len(differ) else size
        stretch = one[depth:end]
        if len(stretch):
            at = np.minimum(np.searchsorted(probe, stretch), len(probe) - 1)
            both += int(np.count_nonzero(probe[at] == stretch))
        left = len(probe) - (int(np.searchsorted(probe, one[end - 1], "right")) if end else 0)
        while low < high and len(members[low]) == end:  # sets that end here
            if both * 100 >= percent * (len(probe) + end - both):
                linked.append(low)
            low += 1
        begin = low
        for i in range(low, high):
            if i + 1 == high or members[i + 1][end] != members[begin][end]:
                # The best that a set of this branch can reach: all that remains of the shorter one.
                longest = max(len(m) for m in members[begin : i + 1])
                most = both + min(left, longest - end)
                shortest = min(len(m) for m in members[begin : i + 1])
                if most * 100 >= percent * (len(probe) + shortest - most):
                    stack.append((begin, i + 1, end, both))
                begin = i + 1
    return linked


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, orders, k: int, percent: int) -> DataFrame:
    """The candidate pairs that link. ``classes`` has a text of each set."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a1").alias("f1"), F.col("a2").alias("f2")).unionByName(pairs.select(F.col("b1").alias("f1"), F.col("b2").alias("f2"))).distinct()
    needed = written(ends.join(classes.select(*ID, "text_key").hint("shuffle_merge"), ID), "join-needed")
    # A bit for the low bits of each needed text's key: most other texts need not be shingled again.
    low = needed.groupBy(F.shiftright(F.col("text_key").bitwiseAND(NEEDED_BITS - 1), 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((text_key & {NEEDED_BITS - 1}) % 64))")).alias("b")).toPandas()  # NEEDED_BITS / 64 rows at most
    filled = np.zeros(NEEDED_BITS // 64, np.int64)
    filled[low["w"].to_numpy(np.int64)] = low["b"].to_numpy(np.int64)
    flags = spark.sparkContext.broadcast(filled)

    def rows(batch: pa.RecordBatch, sets: Sets, seen: set) -> pa.RecordBatch:
        r = np.flatnonzero(_new_rows(sets, seen))
        keys = sets.keys.view(np.int64)
        lists = pa.array([keys[sets.first[i] : sets.first[i + 1]] for i in r], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(sets.f1[r]), pa.array(sets.f2[r]), lists], names=[*ID, "keys"])

    sets = _scan(docs, "f1 long, f2 long, keys array<long>", rows, orders, k, ["text_key"], flags)
    sets = written(sets.join(needed.hint("shuffle_merge"), ID, "left_semi").dropDuplicates(ID), "join-sets")
    a = sets.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("keys").alias("a"))
    b = sets.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("keys").alias("b"))
    both = pairs.join(b.hint("shuffle_merge"), ["b1", "b2"]).join(a.hint("shuffle_merge"), ["a1", "a2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a1, a2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            b1, b2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 4))
            of_b, of_a = ([np.asarray(v.values).view(np.uint64) for v in batch.column(i)] for i in (4, 5))
            order = sorted(range(batch.num_rows), key=lambda i: (a1[i], a2[i], of_b[i].astype(">u8").tobytes()))
            good, begin = [], 0
            for j in range(1, len(order) + 1):
                if j == len(order) or a1[order[j]] != a1[order[begin]] or a2[order[j]] != a2[order[begin]]:
                    run = order[begin:j]
                    good += [run[i] for i in _walk(of_a[run[0]], [of_b[i] for i in run], percent)]
                    begin = j
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in (a1, a2, b1, b2)], names=["a1", "a2", "b1", "b2"])

    found = written(both.select("a1", "a2", "b1", "b2", "b", "a").mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long"), "join-links")
    drop_written(needed)
    drop_written(sets)
    return found


def _orders(docs: DataFrame, k: int, percent: int):
    """The global order, for all tasks."""
    context, none = docs.sparkSession.sparkContext, np.zeros(0, np.uint64)
    ranks = _word_ranks(docs)
    common, common_keys = _common_keys(docs, context.broadcast((ranks, none, none)), k, percent)
    return context.broadcast((ranks, common, common_keys))


def _parts(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, f1, f2, n) for each document, and for each set that is not empty (f1, f2, part, name): the
    number of its component, and the least id in it."""
    docs = docs.select("doc_id", _text_key().alias("text_key"), "text")
    orders = _orders(docs, k, percent)

    def summary(batch: pa.RecordBatch, sets: Sets, seen: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in (sets.f1, sets.f2, sets.n, *sets.bitmaps(512, 40)))], names=["doc_id", "text_key", *ID, "n", *MORE_MAPS])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "text_key", *ID, "n", *MORE_MAPS))
    members = written(_scan(docs, schema, summary, orders, k, ["doc_id", "text_key"]), "join-members")
    classes = members.filter("n > 0").groupBy(*ID).agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), *(F.min(m).alias(m) for m in MORE_MAPS))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")

    by_key = Window.partitionBy("key")
    found = _postings(docs, orders, k, percent).repartition("key").dropDuplicates(["key", *ID])
    found = written(found.withColumn("sets", F.count(F.lit(1)).over(by_key)).filter("sets > 1"), "join-found")
    # A text that others were made from meets more sets than they do: it is tried first.
    known = found.groupBy(*ID).agg(F.sum("sets").alias("known"))
    place = F.row_number().over(Window.partitionBy(*ID).orderBy(F.xxhash64("key"), "key"))
    stars = found.join(known.hint("shuffle_merge"), ID).withColumn("place", place).filter(F.col("place") <= STAR)
    whole = F.struct("n", "pos", *ID, *MAPS)
    stars = written(stars.select("key", "known", whole.alias("x"), F.pmod(F.xxhash64(*ID), F.lit(HEADS)).alias("deal")), "join-stars")
    heads = stars.groupBy("key", "deal").agg(F.max(F.struct("known", "x")).alias("y")).select("key", F.col("y.x").alias("y"))
    near = stars.select("key", "x").join(heads.hint("shuffle_merge"), "key").filter("x.f1 != y.f1 or x.f2 != y.f2").filter(_possible(F.col("x"), F.col("y"), percent))
    near = written(_pairs(near), "join-near")
    edges = _as_nodes(_links(docs, near, classes, orders, k, percent), classes)
    parts = written(connected_components(edges), "join-parts")

    rest = _apart(found, classes, parts)
    for turn in range(ROUNDS):
        more = written(_pairs(_hubs(rest, turn, percent)).join(near.hint("shuffle_merge"), ["a1", "a2", "b1", "b2"], "left_anti"), "join-more")
        if more.isEmpty():
            break
        near, links = written(near.unionByName(more), "join-near"), _links(docs, more, classes, orders, k, percent)
        if links.isEmpty():
            break
        edges = edges.unionByName(_as_nodes(links, classes))
        parts = written(connected_components(edges), "join-parts")
        rest = _apart(found, classes, parts)
    x, y = rest.alias("x"), rest.alias("y").hint("shuffle_merge")
    far = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.s.part") < F.col("y.s.part")) & _possible(F.col("x.s"), F.col("y.s"), percent, MAPS, MORE_MAPS))
    far = far.select(F.col("x.s").alias("x"), F.col("y.s").alias("y"))
    far = written(_pairs(far).join(near.hint("shuffle_merge"), ["a1", "a2", "b1", "b2"], "left_anti"), "join-far")
    if not far.isEmpty():
        more = _as_nodes(_links(docs, far, classes, orders, k, percent), classes)
        parts = written(connected_components(edges.unionByName(more)), "join-parts")
    named = _placed(classes, parts)
    names = named.groupBy("part").agg(F.min("least").alias("name"))
    named = written(named.join(names.hint("shuffle_merge"), "part").select(*ID, "part", "name"), "join-named")
    for t in (found, stars, near, rest, far):
        drop_written(t)
    return members, named


def _apart(found: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, s) at keys where sets of several components meet; s has the set's component, place and maps."""
    placed = _placed(classes, parts).select(*ID, "part", *MORE_MAPS)
    rest = found.select("key", *ID, "n", "pos", *MAPS).join(placed.hint("shuffle_merge"), ID)
    several = rest.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("key")
    rest = rest.join(several.hint("shuffle_merge"), "key", "left_semi").select("key", F.struct("part", "n", "pos", *ID, *MAPS, *MORE_MAPS).alias("s"))
    return written(rest, "join-rest")


def _hubs(rest: DataFrame, turn: int, percent: int) -> DataFrame:
    """(x, y): possible links at crowded keys, with sets y of other components that are least apart from some
    others there, so that most sets that link with any link with them."""
    crowded = rest.groupBy("key").count().filter(F.col("count") > CROWD).select("key")
    rows = rest.join(crowded.hint("shuffle_merge"), "key", "left_semi")
    deal = F.pmod(F.xxhash64("s.f1", "s.f2", F.lit(turn)), F.lit(MORE_HEADS)).alias("deal")

    def few(rows: DataFrame, order: Column, name: str) -> DataFrame:
        one = rows.groupBy("key", deal).agg(F.min(F.struct(order, "s")).alias("one"))
        return one.groupBy("key").agg(F.collect_list("one.s").alias(name))  # MORE_HEADS at most

    some = few(rows, F.xxhash64("s.f2", F.lit(turn)), "some")
    away = F.aggregate("some", F.lit(0), lambda total, y: total + _distance(F.col("s"), y, MORE_MAPS).cast("int"))
    rows = rows.join(some.hint("shuffle_merge"), "key").select("key", "s", away.alias("away"))
    tried = rows.join(few(rows, F.col("away"), "hubs").hint("shuffle_merge"), "key")
    x = F.col("s")
    return tried.select(x.alias("x"), F.explode(F.filter("hubs", lambda y: (x["part"] != y["part"]) & _possible(x, y, percent, MAPS, MORE_MAPS))).alias("y"))


def _text_key() -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64("text")


def _as_nodes(links: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("node").alias("u"))
    b = classes.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("node").alias("v"))
    return links.join(a.hint("shuffle_merge"), ["a1", "a2"]).join(b.hint("shuffle_merge"), ["b1", "b2"]).select("u", "v")


def _placed(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """``classes`` with the number of each one's component so far."""
    return classes.join(parts.hint("shuffle_merge"), "node", "left").select(*ID, "least", *MORE_MAPS, F.coalesce("component", "node").alias("part"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    members, named = _parts(docs, k, percent)
    own = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return members.join(named.hint("shuffle_merge"), ID, "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that with the least id (null ids last; ties: the least hash of the
    text). Rows with an empty set all stay."""
    members, named = _parts(docs, SHINGLE, PERCENT)
    key = ["doc_id", "text_key"]
    first = members.join(named.hint("shuffle_merge"), ID).groupBy("part").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), *key)).alias("s"))
    stay = first.select("s.doc_id", "s.text_key").unionByName(members.filter("n = 0").select(*key)).distinct()
    stay = written(stay.toDF("stay_id", "stay_key"), "join-stay")
    again = members.filter("n > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*key)
    again = written(again.toDF("again_id", "again_key"), "join-again")
    same = lambda t, x: docs["doc_id"].eqNullSafe(t[f"{x}_id"]) & _text_key().eqNullSafe(t[f"{x}_key"])
    left = docs.join(stay.hint("shuffle_merge"), same(stay, "stay"), "left_semi")
    if again.isEmpty():
        return left
    single = left.join(again.hint("shuffle_merge"), same(again, "again"), "left_anti")
    return single.unionByName(left.join(again.hint("shuffle_merge"), same(again, "again"), "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_OP6_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP6_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_OP6_WORDS} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
  ) WHERE 100 * shared >= {PERCENT} * (total - shared)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), parts AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN parts ON x = doc_id
"""
