"""Ball-tree search, fill-in-middle and SimHash against brute force, on nulls, odd and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from citegrid.llm import ball_tree, infill, simhash
from citegrid.llm.words import text_bytes

DOCS = "doc_id long, text string, lang string, n long, form string, output string, row long, item long, score long"
LOWERED = {c: c + 32 for c in range(65, 91)}


def corpus(seed=3, n=80):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(300)]
    say = lambda k: " ".join(pick.choice(vocabulary) for _ in range(k))
    passage = say(400)
    texts = [say(pick.randint(30, 120)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2].replace(" ", "\t", 4), f"{say(30)} {passage} {say(9)}", f"{say(7)} {passage}", passage + "  \n"]
    for i in range(30):  # near copies of one long text
        w = passage.split()
        w[(7 * i) % len(w)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += ["", None, " \n\t ", "one", "one two", "a b c", "d'élève ça \U0001f600 x", "x <P> y", "a <S>", "<M>", " lead and trail ", "  nbsp wide", "w" * 20000, "tail " * 5000 + "w" * 9000, "<" * 500 + " S> " * 90, say(260_000)]
    rows = [(i, t, "en", -1, "f", "o", 5, 6, 7) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], None, None, None, None, None, None, None), (rows[5][0], "another text under one id", "x", 0, "f", "o", 1, 2, 3)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWERED))
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_parts(prints, radius=2):
    parts = {}
    for p in prints:
        near = {r for r in parts if any((p ^ q).bit_count() <= radius for q in parts[r])}
        parts[p] = {p}.union(*(parts.pop(r) for r in near))
    return {q: r for r, members in parts.items() for q in members}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_set_of_bits(radius):
    masks = simhash.covering_masks(range(64), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    pick = random.Random(1)
    for bits in [pick.sample(range(64), radius) for _ in range(3000)]:
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        for inner in simhash.covering_masks(free, radius):
            assert not inner & m
            assert len(free) - inner.bit_count() <= {1: 8, 2: 12, 3: 16}[radius]


def test_fingerprints_of_odd_and_long_texts(rows, docs, monkeypatch):
    got = Counter(tuple(r) for r in simhash.fingerprints(docs.select("doc_id", "text")).collect())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == Counter((r[0], signed(brute_print(r[1]))) for r in rows)
    raw, at = text_bytes(pa.array([r[1] for r in rows[:60]]))
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.text_prints(raw, at).tolist() == [brute_print(r[1]) for r in rows[:60]]


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_join_all_that_lie_within_the_radius(spark, bucket):
    """A dense cloud, chains of two bits a step, and noise; with full buckets dealt again, and without."""
    pick = random.Random(5)
    prints = {pick.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for _ in range(3):
        x = pick.getrandbits(64)
        for _ in range(60):
            x ^= (1 << pick.randrange(64)) | (1 << pick.randrange(64))
            prints.add(x)
    centre = pick.getrandbits(64)
    prints |= {centre ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for _ in range(400)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(5)
    found = simhash.links(table, bucket=bucket).collect()
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in found:
        parent[root(r["u"] % (1 << 64))] = root(r["v"] % (1 << 64))
    want = brute_parts(prints)
    sets = lambda name: {frozenset(p for p in prints if name(p) == g) for g in {name(p) for p in prints}}
    assert sets(root) == sets(want.get)
    assert len(found) < 49 * len(prints)  # a forest for each bucket, not its pairs


def test_buckets_over_batches():
    prints = np.array([0, 1, 3, 7, 255, 2, 4], np.uint64)
    u, v = simhash.bucket_forest(np.array([0, 0, 0, 0, 0, 1, 1]), prints)
    assert {(int(a), int(b)) for a, b in zip(u, v, strict=True)} == {(1, 0), (3, 0), (7, 0), (4, 2)}
    assert len(simhash.bucket_forest(np.zeros(0, np.int64), np.zeros(0, np.uint64))[0]) == 0


def test_components_and_one_of_each(rows, docs, none):
    parts = brute_parts({brute_print(r[1]) for r in rows})
    least = {}
    for r in rows:
        if r[0] is not None:
            least[parts[brute_print(r[1])]] = min(r[0], least.get(parts[brute_print(r[1])], r[0]))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_copies(docs).collect())
    assert got == Counter((r[0], brute_print(r[1]), least[parts[brute_print(r[1])]]) for r in rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(parts.values()))
    assert {r["doc_id"] for r in kept} == set(least.values())
    assert simhash.near_copies(none).collect() == simhash.one_of_each(none).collect() == []


def brute_infill(doc_id, text):
    text = text or ""
    t = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_cuts_and_comes_back(rows, docs, none):
    many = docs.select("doc_id", "text")
    for j in range(1, 8):  # other ids draw other cuts
        many = many.unionByName(docs.select((F.col("doc_id") + 1000 * j).alias("doc_id"), "text"))
    made = infill.fill_in_middle(many).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = Counter()
    for j in range(8):
        for r in rows:
            i = None if r[0] is None else r[0] + 1000 * j
            want[(i, r[1] or "", *brute_infill(i, r[1]))] += 1
    assert Counter((r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made) == want
    assert {k[3] for k in want} == {"plain", "psm", "spm"}
    wide = infill.fill_in_middle(docs)
    assert wide.columns == ["doc_id", "text", "lang", "row", "item", "score", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert wide.count() == len(rows)
    assert infill.fill_in_middle(none).collect() == []


def test_chunks_are_shared_and_summed():
    """Every cut of texts in which words and characters lie across chunk ends; a passage is counted once."""
    pick = random.Random(2)
    say = lambda k: "".join(pick.choice(["w", "é", " ", "\n", "word ", "\U0001f600"]) for _ in range(k))
    shared = say(6000)
    texts = [say(900) + shared + say(50), shared, say(31) + shared, "x" * 30000, " " * 700, "y", "z" * 9000 + " end", "end " + "z" * 9000]
    chunks = infill.Chunks()
    for text in texts:
        data = text.encode()
        marks = [m for m in infill.marks_of(np.frombuffer(data, np.uint8)).tolist() if m >= infill.WINDOW]
        counted = chunks.counted(data, marks)
        t = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
        assert counted.n == len(t)
        assert [counted.chars_before(i) for i in range(len(t) + 1)] == np.cumsum([0, *map(len, t)]).tolist()
    assert chunks.hits > 10
    small = infill.Chunks(cache_bytes=1000)
    for text in texts:
        data = text.encode()
        small.counted(data, infill.marks_of(np.frombuffer(data, np.uint8)).tolist())
    assert small.held < 1000 + infill.MAX_CHUNK + 200


def terms(text):
    return [t.translate(LOWERED) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute_search(rows, items, k=10):
    held = [(r[0], Counter(terms(r[1]))) for r in rows]
    lengths = [sum(c.values()) for _, c in held]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, c), size in zip(held, lengths, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((score, doc_id))
        best = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item_id, i + 1, d, s) for i, (s, d) in enumerate(best)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    pick = random.Random(9)
    long = [r[1] for r in rows if r[1] and 200 < len(r[1]) < 5000]
    some = [(i, " ".join(pick.choice(long).split()[: pick.randint(1, 40)])) for i in range(40)]
    return [*some, (50, None), (51, ""), (52, "nosuchterm atall"), (53, "ONE Two"), some[0], (54, long[0] + " " + long[7]), (55, rows[0][1]), (56, "w élève ça")]


@pytest.mark.parametrize(("chunk", "block_bytes"), [(2048, 1 << 20), (20, 3000)])
def test_search_equals_brute_force(spark, rows, docs, items, monkeypatch, chunk, block_bytes):
    monkeypatch.setattr(ball_tree, "CHUNK", chunk)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = ball_tree.ranked_search(docs, asked, block_bytes=block_bytes)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute_search(rows, items)


def test_search_of_empty_tables(spark, docs, none, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert ball_tree.ranked_search(none, asked).collect() == []
    assert ball_tree.ranked_search(docs, nothing).collect() == []
    assert ball_tree.ranked_search(docs, nothing).schema["item_id"].dataType.simpleString() == "string"


def test_bounds_hold_and_prune():
    """No document of a node is above its bound; clustered documents leave most leaves unread."""
    pick = np.random.default_rng(4)
    n, size = 2000, 400
    group = pick.integers(0, 40, n)
    sets = [np.unique(np.concatenate((pick.choice(np.arange(g * 10, g * 10 + 10), 8, replace=False), pick.integers(0, size, 3)))) for g in group]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    term = np.concatenate(sets)
    value = pick.integers(1, 10**10, len(term))
    scale = np.sqrt(pick.integers(1, 20000, size))
    tree = ball_tree.Tree(first, term, value, scale)
    dense = np.zeros((n, size), np.int64)
    dense[np.repeat(np.arange(n), np.diff(first)), term] = value
    scored = 0
    for g in range(40):
        asked = np.arange(g * 10, g * 10 + 10)
        want = dense[:, asked].sum(axis=1)
        best = []
        scored += tree.search(asked, best, 10, lambda d: (True, -d))
        assert sorted(((s, -w[1]) for s, w in best), key=lambda x: (-x[0], x[1])) == heapq.nsmallest(10, ((int(s), d) for d, s in enumerate(want)), key=lambda x: (-x[0], x[1]))
        q = scale[asked]
        norm = np.sqrt((q * q) @ tree.has[asked])
        bound = (q @ tree.centre[asked] + norm * tree.radius) * (1 + ball_tree.SAFE) + 1
        for node, leaf in enumerate(tree.leaves):
            if leaf is not None:
                assert want[leaf[0]].max() <= bound[node]
    assert scored < 0.5 * 40 * tree.n_leaves


def test_unlike_long_lines_make_no_pairs(spark, monkeypatch):
    from citegrid.llm import line_dedup

    pick = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    lines = [" ".join(pick.sample(words[: 2 * n], n)) for n in [150] * 60 + [400] * 20]
    copies = [" ".join([*line.split(" ")[: -len(line.split(" ")) // 12], "other", "words"]) for line in lines[:70:10]]
    docs = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    tried = []
    matches = line_dedup._matches
    monkeypatch.setattr(line_dedup, "_matches", lambda d, pairs, *rest: tried.append(pairs.count()) or matches(d, pairs, *rest))
    removed, _ = line_dedup.removed_lines(docs)
    assert sorted(r["doc"] for r in removed.collect()) == list(range(len(lines), len(lines) + len(copies)))
    assert sum(tried) <= 2 * len(copies)
