"""Every corpus operator against a brute-force version, on fixtures with nulls, empty and long texts, ties,
repeated rows, empty tables and further columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citegrid.llm import common, components, decontaminate, line_dedup, mixing, ngram_join, quality, sharding, substring_dedup, token_files, urls, warc
from citegrid.llm.words import LOWER, NOT_ALNUM, SPACES, span_hashes, spans, text_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, kept string"
LOWERED = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWERED))


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls and odd ones."""
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 8))) for _ in range(400)]
    say = lambda k: " ".join(pick.choice(vocabulary) for _ in range(k))
    passage = say(60)
    texts = [say(pick.randint(60, 160)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " one more", texts[3].replace(" ", "\n", 3)]
    for i in range(4, 24):  # near copies of one text
        w = texts[5].split()
        w[i % len(w)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [f"{say(20)} {passage} {say(20)}" for _ in range(6)]
    texts += ["", " \n\t ", None, "\u00e9l\u00e8ve na\u00efve", "one two", "one two", "a b c", say(5000), "line\n" * 30, "same words here\n" + texts[7] + "\nsame words here"]
    return [(i, t, "en" if i % 3 else None, f"src{i % 4}", len(t or ""), -1, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3, "source")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes():
    texts = ["Ab c", None, "", "x\ty  Z1 \u00e9\u00e9", "!!!", "ab"]
    raw, at = text_bytes(pa.array(["skip", *texts]).slice(1))
    for separator, find in ((SPACES, plain_words), (NOT_ALNUM, lambda t: words_of(t))):
        begins, ends, first = spans(raw, at, separator)
        got = [[raw[begins[j] : ends[j]].tobytes().decode().translate(LOWERED) for j in range(first[i], first[i + 1])] for i in range(len(texts))]
        assert got == [[w.translate(LOWERED) for w in find(t)] for t in texts]
    begins, ends, _ = spans(raw, at, SPACES)
    hashes = dict(zip([raw[a:b].tobytes().lower() for a, b in zip(begins, ends, strict=True)], span_hashes(LOWER[raw], begins, ends).tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes)


def brute_decontaminate(text, items, window=10):
    w, hit, found = words_of(text), set(), set()
    for item, body in items:
        i = words_of(body)
        k = min(len(i), window)
        wins = {tuple(i[a : a + k]) for a in range(len(i) - k + 1)} if k else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in wins:
                hit |= set(range(a, a + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontaminate(spark, rows, docs, no_docs):
    w = rows[8][1].split()
    items = [(1, " ".join(w[10:40])), (1, " ".join(w[45:60])), (2, "one two"), (3, None), (4, ""), (5, "a"), (10, " ".join(w[12:30]).upper()), (None, rows[9][1]), (7, "never " * 12), (8, " ".join(w[:9]))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    want = {r[0]: brute_decontaminate(r[1], [(i, t) for i, t in items if i is not None]) for r in rows}
    found = decontaminate.scan(docs, bench).withColumn("n_hit", decontaminate.hit_count()).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == want
    old, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, 5  # several blocks
    try:
        found = decontaminate.scan(docs, bench).withColumn("n_hit", decontaminate.hit_count()).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == want
    finally:
        decontaminate.BLOCK_WORDS = old
    assert decontaminate.scan(no_docs, bench).count() == 0
    assert all(not r["items"] for r in decontaminate.scan(docs, bench.limit(0)).collect())
    left = {r.doc_id: r for r in decontaminate.remove_leaks(docs, bench, max_coverage=0.9).collect()}
    for i, r in left.items():
        assert brute_decontaminate(r.text, [(a, t) for a, t in items if a is not None])[1] == 0 or want[i][1] > 0
        if want[i][1] == 0:
            assert r.text == rows[i][1]
        elif r.text:
            assert r.n_chars == len(r.text)
    assert set(left) >= {r[0] for r in rows if want[r[0]][1] == 0}


def test_decontaminate_in_blocks(spark):
    """Several blocks give what one block gives: repeated and null ids, joint coverage, overlapping windows."""
    w = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(w[a : a + 12])) for i, a in enumerate((0, 6, 12, 30, 42))]
    more = " ".join(f"x{i}" for i in range(8))
    texts = [(1, " ".join(w[:24]) + " " + more), (2, " ".join(w[:18] + ["y"] * 60)), (3, " ".join(w[30:42] + ["z"] * 40 + w[42:54])), (3, " ".join(["q"] * 64)), (None, " ".join(["q"] * 64)), (None, " ".join(w[30:42] + ["z"] * 52)), (3, " ".join(["q"] * 64)), (4, None)]
    texts.append((5, " ".join(w[:12] + ["v"] * 8 + w[42:54] + ["v"] * 12)))
    docs = spark.createDataFrame([(d, t, len(t or ""), "r") for d, t in texts], "doc_id long, text string, n_chars long, row string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    look = lambda: (sorted(map(str, decontaminate.scan(docs, bench).collect())), sorted(map(str, decontaminate.remove_leaks(docs, bench).collect())))
    one, old = look(), decontaminate.BLOCK_WORDS
    try:
        for size in (5, 10, 20, 40):
            decontaminate.BLOCK_WORDS = size
            assert look() == one
    finally:
        decontaminate.BLOCK_WORDS = old


def test_line_dedup(spark, rows, docs, no_docs):
    lines = [(r[0], i, frozenset(x for x in line.split(" ") if x)) for r in rows if r[1] is not None for i, line in enumerate(r[1].split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = set()
    for j, (d, i, s) in enumerate(lines):
        if any(100 * len(s & t) >= 80 * len(s | t) for _, _, t in lines[:j]):
            gone.add((d, i))
    removed, _ = line_dedup.removed_lines(docs)
    assert {(r.doc, r.line) for r in removed.collect()} == gone
    cleaned = {r.doc_id: r.text for r in line_dedup.without_lines(docs, removed).collect()}
    for d, text, *_ in rows:
        assert cleaned[d] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone))
    assert line_dedup.removed_lines(no_docs)[0].count() == 0


def test_url_rules(spark):
    seen = ["https://WWW.Example.ORG/es/1?q", "http://example.org/en/15", "nothing", None, "a://b.com/fr/x#y", "http://x.com/de/", "http://org", "http://x.net/", "q://h?://other/p"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(seen)], "page_id long, url string")
    host, path = urls.host_and_path(df["url"])
    rule, verdict = urls.rule_of(host, path)
    got = [tuple(r)[1:] for r in df.select("page_id", host, path, rule, verdict).orderBy("page_id").collect()]
    assert got == [
        ("www.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/15", "example.org/en/1", "block"), ("", "", None, None), ("", "", None, None), ("b.com", "/fr/x", "com/fr/", "allow"),
        ("x.com", "/de/", "com/de/", "block"), ("org", "", None, None), ("x.net", "/", None, None), ("h", "", None, None),
    ]


def test_url_templates(spark):
    pages = [(i, "farm.net", f"/offers/{i}") for i in range(40)] + [(100 + i, "farm.net", f"/news/{i}") for i in range(40)] + [(200, "", ""), (201, "lone.net", "/a/b/c/d/e")]
    df = spark.createDataFrame([(i, h, p, i) for i, h, p in pages], "page_id long, host string, path string, label_key long")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(5, 1)], "label_key long, bad int")
    got = {r.page_id: r.verdict for r in urls.template_verdicts(df, labels).collect()}
    assert got == {i: "block" if i < 100 else "allow" for i, _, _ in pages}
    assert urls.template_verdicts(df.limit(0), labels).count() == 0
    assert {r.verdict for r in urls.template_verdicts(df, labels.limit(0)).collect()} == {"allow"}


def brute_templates(pages, bad):
    """Verdicts by a tree of as many levels as the longest path has."""
    parts = lambda p: tuple(re.sub("[0-9]+", "#", x) for x in p.split("/") if x)
    shapes = defaultdict(lambda: [0, 0, 0])
    for _, host, path, key in pages:
        s = shapes[host, parts(path)]
        s[0] += 1
        if key in bad:
            s[1] += 1
            s[2] += bad[key]
    depth = max((len(p) for _, p in shapes), default=0)
    seg = lambda p, k: p[k] if k < len(p) else ""
    t = {x: () for x in shapes}
    for k in range(depth):
        kinds, total = defaultdict(set), Counter()
        for (h, p), (n, _, _) in shapes.items():
            kinds[h, t[h, p]].add(seg(p, k))
            total[h, t[h, p]] += n
        wild = {x for x in kinds if len(kinds[x]) >= urls.MIN_DISTINCT and len(kinds[x]) >= urls.DISTINCT_SHARE * total[x]}
        t = {(h, p): (*x, "*" if (h, x) in wild else seg(p, k)) for (h, p), x in t.items()}
    m = {x: () for x in shapes}
    for k in reversed(range(depth)):
        branch, whole = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for (h, p), (_, n, b) in shapes.items():
            for d, x in ((branch, t[h, p][: k + 1]), (whole, t[h, p][:k])):
                d[h, x][0] += n
                d[h, x][1] += b
        for (h, p), x in t.items():
            (bn, bb), (wn, wb) = branch[h, x[: k + 1]], whole[h, x[:k]]
            on, ob = wn - bn, wb - bb
            apart = bn * on > 0 and (bb * on - ob * bn) ** 2 * wn > urls.Z**2 * bn * on * wb * (wn - wb)
            m[h, p] = (x[k] if apart else "*", *m[h, p])
    leaf, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, p), (_, n, b) in shapes.items():
        for d, x in ((leaf, (h, m[h, p])), (hosts, h)):
            d[x][0] += n
            d[x][1] += b
    n, b = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    prior = b / n if n else 0.0
    smooth = lambda v, toward: (v[1] + urls.WEIGHT * toward) / (v[0] + urls.WEIGHT)
    return Counter((i, h, p, "block" if smooth(leaf[h, m[h, parts(p)]], smooth(hosts[h], prior)) > urls.MAX_BAD else "allow") for i, h, p, _ in pages)


@pytest.mark.parametrize("before", ["", "/1/2/3/4/5/6/7/8/9"])
def test_url_templates_of_any_depth(spark, before):
    """Bad and good branches lie below any number of segments; among the pages are odd, equal and null ones."""
    pick = random.Random(4)
    pages = [(i, "site.net", f"{before}/{'spam' if i % 3 == 0 else 'news'}/x{pick.random()}", i) for i in range(400)]
    pages += [(1000 + i, "other.net", "/" + "/".join(pick.choice(["a", "b", "7", "*", "#"]) for _ in range(pick.randint(0, 4))), 1000 + i) for i in range(200)]
    pages += [(2000 + i, "deep.net", "/d" * (40 + i), 2000 + i) for i in range(3)] + [(1, "site.net", "", None), (None, "", "", None), (7, "site.net", "//", 7)]
    df = spark.createDataFrame(pages, "page_id long, host string, path string, label_key long").withColumn("t", F.lit("t")).withColumn("own", F.lit(1))
    bad = {i: int(i % 3 == 0) for i in range(0, 400, 2)} | {1000 + i: int(pick.random() < 0.4) for i in range(150)}
    labels = spark.createDataFrame(list(bad.items()), "label_key long, bad int").withColumn("host", F.lit("x"))
    got = Counter((r.page_id, r.host, r.path, r.verdict) for r in urls.template_verdicts(df, labels).collect())
    assert got == brute_templates(pages, bad)
    assert sum(n for (i, h, _, v), n in got.items() if h == "site.net" and v == "block" and i is not None) >= 134


def brute_passages(rows, run=50):
    seen = defaultdict(set)
    texts = {r[0]: words_of(r[1]) for r in rows}
    for d, w in texts.items():
        for i in range(len(w) - run + 1):
            seen[tuple(w[i : i + run])].add(d)
    hit = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - run + 1):
            if len(seen[tuple(w[i : i + run])]) > 1:
                hit[d] |= set(range(i, i + run))
    return hit


def test_substring_dedup(spark, rows, docs, no_docs):
    hit = brute_passages(rows)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert len(got) == len(rows)
    for d, _, *_ in rows:
        covered = {i for s in got[d].passages for i in range(s.begin, s.stop)}
        assert hit[d] <= covered and len(covered) == got[d].n_repeated
        assert got[d].n_removable <= got[d].n_repeated
    near = {r[0] for r in rows if r[1] and "edit" in r[1]}
    assert {d for d in got if got[d].n_repeated and not hit[d]} <= near | {5}
    assert got[0].n_removable == 0 and got[60].copy_of == 0 and got[60].n_removable == got[60].n_words
    assert substring_dedup.repeated_passages(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_short_passages_in_many_documents(spark, seed):
    """Equal passages of 50 to 55 words in hundreds of documents with differing neighbours, all found."""
    pick = random.Random(seed)
    say = lambda k: " ".join(f"w{pick.randrange(100_000)}" for _ in range(k))
    passages = [say(k) for k in (50, 50, 52, 55)]
    rows = [(i, f"{say(pick.randint(20, 60))} {passages[i % 4]} {say(pick.randint(20, 60))}") for i in range(400)]
    hit = brute_passages(rows)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {d: r.n_repeated for d, r in got.items()} == {d: len(hit[d]) for d in got}
    first, gone = {}, defaultdict(set)
    for d, text in rows:
        w = text.split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[d] |= set(range(i, i + 50))
    assert {d: r.n_removable for d, r in got.items()} == {d: len(gone[d]) for d in got}


def test_equal_runs_in_any_order_of_copies(spark, monkeypatch):
    """Copies of higher id that stand first don't keep their class out of the pass over equal runs."""
    pick = random.Random(12)
    say = lambda k: " ".join(str(pick.randrange(10**6)) for _ in range(k))
    passages = [say(60) for _ in range(40)]
    texts = [f"{say(30)} {passages[i % 40]} {say(30)}" for i in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    seen, runs_of = [], substring_dedup._shared_runs

    def told(*args):
        seen.append(runs_of(*args))
        return seen[-1]

    monkeypatch.setattr(substring_dedup, "_shared_runs", told)
    monkeypatch.setattr(substring_dedup, "drop_written", lambda df: None)
    found = []
    words, first, _, _ = substring_dedup._shingled(*text_bytes(pa.array(texts)))
    each = set(substring_dedup._fingerprints(words, first)[0].tolist())
    for order, tasks in ((rows, 1), (rows[::-1], 1), (rows, 7)):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(tasks)
        found.append(sorted(map(str, substring_dedup.repeated_passages(df).collect())))
        assert Counter(r.doc for r in seen[-1].select("doc").collect()) == Counter(each)
    assert found[0] == found[1] == found[2]


def test_passages_of_texts_with_one_id(spark):
    """Different texts with one id, null too, are compared; none of them is earlier than the other."""
    pick = random.Random(5)
    say = lambda k: " ".join(str(pick.randrange(10**6)) for _ in range(k))
    passage = say(60)
    rows = [(d, f"{say(30)} {passage} {say(30)}") for d in (None, None, 4, 4, 9)]
    for tasks in (1, 5):
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)).collect()
        want = Counter({(None, 60, 0): 2, (4, 60, 60): 2, (9, 60, 60): 1})
        assert Counter((r.doc_id, r.n_repeated, r.n_removable) for r in got) == want
    for d in (None, 4):
        rows = [(d, f"{say(30)} {passage} {say(30)}") for _ in range(2)]
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [(r.n_repeated, r.n_removable) for r in got] == [(60, 0)] * 2


def test_recall_of_near_passages(spark):
    """Passages of 80 words with one, two or three edits each in 60 documents, against all pairs of documents."""
    pick = random.Random(11)
    say = lambda k: " ".join(f"w{pick.randrange(100_000)}" for _ in range(k))
    rows, groups = [], {}
    for edits in (1, 2, 3):
        passage = say(80).split()
        for _ in range(60):
            w = list(passage)
            for i in pick.sample(range(80), edits):
                w[i] = f"e{pick.randrange(10_000)}"
            groups[len(rows)] = edits
            rows.append((len(rows), f"{say(pick.randint(20, 60))} {' '.join(w)} {say(pick.randint(20, 60))}"))
    each = {d: substring_dedup._shingled(*text_bytes(pa.array([t])))[2][: len(t.split()) - 4] for d, t in rows}
    want = defaultdict(set)
    for a in each:
        for b in each:
            if a != b and groups[a] == groups[b]:
                want[a] |= {i for x, y in substring_dedup.repeated(each[a], each[b]) for i in range(x, y + 4)}
    got = {r.doc_id: {i for s in r.passages for i in range(s.begin, s.stop)} for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for edits in (1, 2, 3):
        some = [d for d in groups if groups[d] == edits and want[d]]
        found, words = sum(bool(got[d] & want[d]) for d in some), sum(len(got[d] & want[d]) for d in some)
        print("recall", edits, found, len(some), words / max(sum(len(want[d]) for d in some), 1))
        assert found >= 0.9 * len(some)
    assert all(got[d] <= want[d] for d in groups)


def test_compact_windows():
    values = np.random.default_rng(3).integers(0, 1 << 40, 300).astype(np.uint64)
    left, c, right = substring_dedup.compact_windows(values, np.array([0, 100]), np.array([100, 300]), 20)
    for begin, stop in ((0, 100), (100, 300)):
        for i in range(begin, stop - 19):
            for j in range(i + 19, stop):
                at = i + int(np.argmin(values[i : j + 1]))
                assert ((left <= i) & (c == at) & (right >= j)).sum() == 1


def test_hilbert_curve():
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = {sharding.hilbert_index([cell >> bits * d & side - 1 for d in range(n)], bits): [cell >> bits * d & side - 1 for d in range(n)] for cell in range(side**n)}
        assert sorted(cells) == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1], strict=True)) == 1 for i in range(side**n - 1))


def test_sharding(spark, rows, docs, no_docs):
    got = sharding.hilbert_shards(docs, n_shards=4).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(text.keys())
    for r in got:
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.grown_shard is None
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for some in by.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)
    share = sum(r["size"] for r in got) / 4
    longest = max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in some) - share) <= 0.2 * share + longest for some in by.values())
    where = defaultdict(set)
    given = {r[0]: r[1] for r in rows}
    for r in got:
        where[given[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if sum(r["size"] for r in got if given[r.doc_id] == t) <= 0.2 * share)
    assert sharding.hilbert_shards(no_docs).count() == 0


def test_sharding_of_like_names(spark):
    """Sources with a common beginning still part, a huge group of one text is cut, null ids and dimensions stay."""
    rows = [(i if i % 50 else None, f"text {i} " * (i % 7 + 1), None if i % 11 == 0 else "en", f"https://source_{i % 32:02d}", 0, 0, "", "") for i in range(3200)]
    rows += [(5000 + i, "the same text again " * 3, "de", "https://source_99", 0, 0, "", "") for i in range(3000)]
    got = sharding.hilbert_shards(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    share = sum(size.values()) / 8
    assert len(got) == len(rows) and len(size) == 8 and all(abs(s - share) < 0.01 * share for s in size.values())
    seen = defaultdict(set)
    source = {r[0]: r[3] for r in rows if r[0] is not None and r[0] < 5000}
    for r in got:
        if r.doc_id in source:
            seen[r.shard].add(source[r.doc_id])
    # A shard of scattered rows would hold all 32 sources.
    assert sum(map(len, seen.values())) / len(seen) < 20


def brute_components(rows, k=3):
    """For each row: the size of its set, and the numbers of the rows of its component."""
    sets = []
    for _, t, *_ in rows:
        w = plain_words((t or "").translate(LOWERED))
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                part = [part[a] if p == part[b] else p for p in part]
    return [(len(s), [j for j, q in enumerate(part) if q == p]) for s, p in zip(sets, part, strict=True)]


def least_id(rows, some):
    return min((rows[j][0] for j in some if rows[j][0] is not None), default=None)


def with_odd_ids(rows):
    """Near copies and equal texts with null ids and ids of other texts, repeated rows."""
    w = rows[5][1].split()
    odd = [(None, " ".join([*w[:-1], "end"])), (None, rows[9][1]), (None, " ".join(f"q{i}" for i in range(70))), (None, " ".join(f"q{i}" for i in range(69))), (None, None)]
    odd += [(11, " ".join(f"z{i}" for i in range(80))), (11, " ".join(f"z{i}" for i in range(79))), (3, rows[3][1]), (3, rows[3][1]), (12, "")]
    return [*rows, *((d, t, "en", "s", 0, 0, "", "") for d, t in odd)]


def test_ngram_join(spark, rows, no_docs):
    rows = with_odd_ids(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    parts = brute_components(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == Counter((r[0], n, least_id(rows, some) if n else r[0]) for r, (n, some) in zip(rows, parts, strict=True))
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect())
    for i, (n, some) in enumerate(parts):
        if n == 0:
            assert kept[rows[i][0], rows[i][1]] == sum(rows[j][:2] == rows[i][:2] for j in range(len(rows)))
        elif i == some[0]:
            assert [kept[k] for k in {rows[j][:2] for j in some} if kept[k]] == [1]
            assert any(kept[rows[j][:2]] for j in some if rows[j][0] == least_id(rows, some))
    assert ngram_join.jaccard_components(no_docs).count() == 0 and ngram_join.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_of_many_near_copies(spark, seed):
    """Chains and groups near the threshold, in which no single text is like all others."""
    pick = random.Random(seed)
    rows = []
    for group in range(12):
        w = [f"g{group}w{pick.randrange(400)}" for _ in range(pick.randint(20, 200))]
        for _ in range(pick.randint(2, 40)):
            rows.append((len(rows), " ".join(w)))
            source = rows[pick.randrange(max(0, len(rows) - 6), len(rows))][1].split()
            for _ in range(pick.randint(0, max(1, len(source) // 25))):
                source[pick.randrange(len(source))] = f"e{pick.randrange(1000)}"
            w = source
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {r[0]: (n, least_id(rows, some)) for r, (n, some) in zip(rows, brute_components(rows), strict=True)}


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (7, 7), (300, 400), (400, 500)]
    got = dict(components.connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 200: 100, 300: 300, 400: 300, 500: 300}


def test_warc(spark):
    long = "<p>" + "x" * 2000
    html = [long, long, long, "short", "short", None, "", "caf\u00e9" * 500, long + "!"]
    pages = [(i, None if i == 3 else f"http://h/\u00e9 {i}", h, i) for i, h in enumerate(html)] + [(None, "u", long, 0), (2, "again", long, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest long")
    folder = spark.conf.get("spark.checkpoint.dir") + "/warc-test"
    index = warc.write_archives(df, folder)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        same = [p for p in pages if p[0] == r.page_id]
        body = (same[0][2] or "").encode()
        revisit = len(body) >= 1000 and sum(p[2] == same[0][2] for p in pages) > 1 and r.page_id != max(p[0] for p in pages if p[2] == same[0][2] and p[0] is not None)
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response")
        assert r.payload == (None if revisit else body) and (r.refers_to is not None) == revisit
    some = warc.read_records(index, folder, where=index["page_id"] == 7).collect()
    assert [r.page_id for r in some] == [7]
    assert warc.read_records(warc.write_archives(df.limit(0), folder), folder).count() == 0


def dense_rates(n, p, want):
    """Coordinate descent over the documents' rates, each step exact."""
    natural = (n @ p).clip(1)
    budget, r = natural[0] / want[0], np.ones(len(n))
    for _ in range(4000):
        total, before = (r * n) @ p, r.copy()
        for i in np.flatnonzero(n):
            slope = p[i] @ ((total - want * budget) / natural) + mixing.PULL * (r[i] - 1)
            new = max(0.0, r[i] - slope / (p[i] ** 2 @ (n[i] / natural) + mixing.PULL))
            total += (new - r[i]) * n[i] * p[i]
            r[i] = new
        if abs(r - before).max() < 1e-7:
            break
    return r


def test_mixing(spark, no_docs):
    pick = random.Random(5)
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(800):
        w = [f"w{pick.randint(0, 300)}" for _ in range(60)]
        kind = i % 4
        if kind == 3:
            w[::9] = [pick.choice(bad) for _ in w[::9]]
        if kind == 2:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0, 0, "", ""))
        if i // 4 % 2:
            labels.append((i, 0 if kind == 2 else 1, 1 if kind == 3 else 0))
    labels += [(4, None, None), (None, 1, 1), (5, 1, 0)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, None, None, "", ""), (901, "", "", "", 0, 0, "", "")], DOCS)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mixed(docs, table).collect()}
    sure = ("p_good", "p_good", "p_low", "p_toxic")
    right = [got[i][sure[i % 4]] > 0.5 for i in range(800) if not i // 4 % 2]
    assert sum(right) >= 0.9 * len(right)
    total = sum(r.rate * r.n_tokens for r in got.values())
    reached = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got.values()) / total for d in mixing.DOMAINS}
    assert all(abs(reached[d] - share) < 0.1 * share for d, share in mixing.TARGETS.items())
    # Against a dense solver that has a rate for each document.
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got.values()])
    n = np.array([r.n_tokens for r in got.values()], float)
    dense = dense_rates(n, p, np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]))
    assert abs((dense * n) @ p / ((dense * n) @ p).sum() - np.array([reached[d] for d in mixing.DOMAINS])).max() < 0.002
    assert abs(dense - [r.rate for r in got.values()]).mean() < 0.05  # a cell has one rate
    assert all(r.rate >= 0 for r in got.values())
    taken = Counter(r.doc_id for r in mixing.resampled(docs, table).collect())
    assert sum(taken[i] > 0 for i in range(800) if i % 4 in (0, 1)) > 350
    assert sum(taken[i] for i in range(800) if i % 4 == 3) < 40
    assert mixing.mixed(no_docs, table).count() == 0
    assert mixing.mixed(docs, table.limit(0)).count() == 802


def brute_rules(text):
    w = plain_words(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(three)
    again = {i + j for i, x in enumerate(three) if times[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if plain_words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(again)


def brute_measures(text, bpe, pieces):
    ids = bpe.encode_ordinary(text)
    n = Counter(ids)
    bits = -sum(k / len(ids) * np.log2(k / len(ids)) for k in n.values()) if ids else 0
    entropy = bits / np.log2(len(ids)) if len(ids) > 1 else float(len(ids))
    spelt = sum(map(pieces.is_byte, pieces.encode(text)))
    return len(text) / max(len(ids), 1), entropy, spelt / max(len(text.encode()), 1)


def brute_bands(judged):
    """kept by plain quartiles of each language and of all."""
    use = [r for r in judged if not r.base_failed]

    def cuts(rows, k):
        v = sorted(r[k] for r in rows)
        at = [v[-(-len(v) * q // 4) - 1] for q in (1, 2, 3)]
        return at[1], max((at[2] - at[0]) / 2, 0.01 * abs(at[1]), 1e-3)

    kept = {}
    for r in judged:
        ok = not r.base_failed
        for k in quality.MEASURES if ok else ():
            own = [x for x in use if x.lang == r.lang]
            lean = quality.LEAN / (len(own) + quality.LEAN)
            (m, s), (ma, sa) = cuts(own, k), cuts(use, k)
            centre, wide = m + lean * (ma - m), s + lean * (sa - s) + lean * abs(ma - m)
            ok = ok and abs(r[k] - centre) <= quality.WIDTH * wide * max(1, quality.STEADY_WORDS / r.n_words) ** 0.5
        kept[r.doc_id] = ok
    return kept


def test_quality(spark, rows, no_docs):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    say = lambda i: "\u4e2d\u6587 " * 30 + " ".join(f"\u0ca0{chr(0x4E00 + i * 40 + j)}x" for j in range(40))
    rows = [*rows, *((i, say(i), "zz", "s", 0, 0, "", "") for i in range(200, 203)), (210, "\u0001\u0002 " * 100 + rows[3][1], "en", "s", 0, 0, "", ""), (None, rows[4][1], "en", "s", 0, 0, "", ""), (4, rows[4][1], "en", "s", 0, 0, "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    every = quality.judged(docs).collect()
    assert Counter(r.doc_id for r in every) == Counter(r[0] for r in rows)
    got = {r.doc_id: r for r in every}
    for d, text, *_ in rows:
        r = got[d]
        want = brute_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert [r[k] for k in quality.MEASURES] == pytest.approx(brute_measures(text or "", bpe, pieces), abs=6e-4)
    assert {d: r.kept for d, r in got.items()} == brute_bands(every)
    assert got[200].kept and got[201].kept and not got[210].kept  # a rare language is not rejected for being unlike the others
    assert quality.judged(no_docs).count() == 0
    assert Counter(r.doc_id for r in quality.keep_good(docs).collect()) == Counter(r.doc_id for r in every if r.kept)


def test_token_files(spark, rows, docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = spark.conf.get("spark.checkpoint.dir") + "/ids-test"
    for how in ({}, {"partitions": 1, "file_ids": 1}):  # one file a partition; a file for each slice
        files = token_files.write_token_files(docs, folder, path, **how)
        before = 0
        starts = {}
        for f in sorted(files.collect()):
            starts[f.part, f.seq] = before
            before += f.n_ids
        got = {r.doc_id: (starts[r.part, r.seq] + r.first, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files, folder).collect()}
        at = 0
        for d, text, *_ in rows:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(no_docs, folder, path), folder).count() == 0


def test_token_words_equal_whole_texts():
    """Against the library's call on whole texts, at its defaults."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    words = token_files.Words(path)
    odd = ["a  b \n c\t\td 's don't  \n\n x\u3000y\x85z q\x1cr   ", "x<|endoftext|> y  <|endoftext|>", "", None, " ", "  ", "\n", "\n\nw", " \nw", "a\u200bb  \u2003c", "it's  'll\u00a0", "\u65e5\u672c\u8a9e \u30c6\u30b9\u30c8", "\U0001f600 \U0001f600  x", "w"]
    pick = random.Random(3)
    odd += ["".join(pick.choice(["a", "bc", " ", "  ", "\n", "\t", "'s", "1", ".", "\u00e9", *(["\u00a0", "<|endoftext|>"] if i % 9 == 0 else [])]) for _ in range(pick.randint(0, 60))) for i in range(300)]
    for _ in range(2):  # the second time with all pieces known
        ids, n = words.encode(*text_bytes(pa.array(odd)), 0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in odd]


def test_range_coder():
    pick = np.random.default_rng(7)
    blocks = [pick.zipf(1.3, n).clip(0, 50_000).astype(np.uint32) for n in (1, 255, 256, 257, 3000, token_files.BLOCK)]
    blocks += [np.zeros(5000, np.uint32), np.full(10, token_files.VOCABULARY - 1, np.uint32), pick.integers(0, 1 << 16, 9000).astype(np.uint32), np.tile(np.arange(70, dtype=np.uint32), 100)]
    raw = token_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(token_files.decode_blocks(raw), blocks, strict=True))
    assert all((token_files.decode_blocks([r])[0] == b).all() for r, b in zip(token_files.encode_blocks([blocks[4]]), [blocks[4]], strict=True))
    assert len(raw[6]) < 700  # a block of one id costs little
    damaged = bytearray(raw[4])
    damaged[len(damaged) // 2] ^= 0xFF
    with pytest.raises((ValueError, IndexError)):
        token_files.decode_blocks([bytes(damaged)])


CLASHING = ("row", "rate", "part", "bit", "text_key", "stay_id", "doc", "id", "band", "curve")


def odd_docs(spark):
    """Null ids and columns, repeated rows, ids with several texts, and further columns named like those that operators make."""
    rows = [(r[0], r[1], None if i % 5 == 0 else r[2], r[3], r[4]) for i, r in enumerate(with_odd_ids(corpus(seed=4, n=30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "source")
    return rows, docs.withColumns({c: F.lit(7) for c in CLASHING})


def test_odd_rows_in_every_operator(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, docs = odd_docs(spark)
    names, texts = docs.columns, Counter((r[0], r[1]) for r in rows)
    bench = spark.createDataFrame([(1, " ".join(rows[2][1].split()[5:40])), (None, "x"), (2, None)], "item_id long, text string")
    assert decontaminate.scan(docs, bench).count() == len(rows)
    left = decontaminate.remove_leaks(docs, bench, max_coverage=1.0)
    assert left.columns == names and Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in rows)
    removed, counts = line_dedup.removed_lines(docs)
    assert line_dedup.without_lines(docs, removed).columns == names and line_dedup.without_lines(docs, removed).count() == len(rows)
    assert {r.doc for r in counts.collect()} == {line_dedup.NO_ID if d is None else d for d, t, *_ in rows if t is not None and t.strip(" \n") != ""}
    passages = substring_dedup.repeated_passages(docs).collect()
    assert Counter((r.doc_id, r.n_words) for r in passages) == Counter((d, len(words_of(t))) for d, t, *_ in rows)
    shards = sharding.hilbert_shards(docs, n_shards=3).collect()
    assert Counter((r.doc_id, r["size"]) for r in shards) == Counter((d, len((t or "").encode()) + 1) for d, t, *_ in rows)
    one = ngram_join.one_of_each(docs)
    assert one.columns == names and all(n <= texts[k] for k, n in Counter((r.doc_id, r.text) for r in one.collect()).items())
    labels = spark.createDataFrame([(d, i % 2, int(i % 7 == 0)) for i, (d, *_) in enumerate(rows)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    assert mixing.mixed(docs, labels).count() == len(rows) and mixing.resampled(docs, labels).columns == names
    kept = quality.keep_good(docs)
    assert kept.columns == names and Counter(r.kept for r in quality.judged(docs).collect())[True] == kept.count()
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    files = token_files.write_token_files(docs, spark.conf.get("spark.checkpoint.dir") + "/odd-ids", path, partitions=2)
    got = sorted(((r.part, r.seq, r.first), r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files, spark.conf.get("spark.checkpoint.dir") + "/odd-ids").collect())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, *_ in ordered]
    assert [x[1:] for x in got] == [(r[0], len(i), zlib.crc32(i.tobytes())) for r, i in zip(ordered, ids, strict=True)]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_and_empty_tables(spark, tmp_path, empty):
    rows, docs = odd_docs(spark)
    pq = f"file://{tmp_path}"
    cut = (lambda df: df.limit(0)) if empty else (lambda df: df)
    cut(docs).write.parquet(f"{pq}/documents.parquet")
    cut(spark.createDataFrame([(1, " ".join(rows[2][1].split()[5:40])), (None, None)], "item_id long, text string")).write.parquet(f"{pq}/benchmark.parquet")
    cut(spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")).write.parquet(f"{pq}/labels.parquet")
    stage_docs = spark.read.parquet(f"{pq}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, stage_docs, pq), "odd")
        assert after.columns == docs.columns and (empty or 0 < after.count() <= len(rows))
        stage_docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, stage_docs, pq).count() == stage_docs.count()


def test_pipeline(spark, tmp_path):
    rows = corpus(seed=2)
    pq = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{pq}/documents.parquet")
    leak = " ".join(rows[8][1].split()[10:40])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{pq}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{pq}/labels.parquet")
    docs = spark.read.parquet(f"{pq}/documents.parquet")
    schema, seen = docs.schema, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, pq), "t")
        assert docs.schema == schema
        seen.append({r.doc_id: r.text for r in docs.collect()})
    kept, single, clean, mixed = seen
    assert not {r[0] for r in rows if brute_rules(r[1])[0] < 50} & set(kept)
    left = [r for r in rows if r[0] in kept]
    assert set(single) == {least_id(left, some) for _, some in brute_components(left)}
    assert brute_decontaminate(clean[8], [(1, leak)])[1] == 0 and all(clean[d] == single[d] for d in clean if d != 8)
    assert set(mixed) <= set(clean) and len(mixed) >= 0.9 * len(clean)
    out = corpus_pipeline.run(spark, pq)
    assert {r.doc_id for r in out.collect()} == set(mixed)


def test_crowd_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Most copies differ by one shingle more than a link allows: lengths, places and one map leave many of their pairs."""
    rng = np.random.default_rng(7)
    base, texts = [f"w{i}" for i in range(150)], []
    for d in range(400):
        words = list(base)
        words[1], words[int(rng.integers(5, 145))] = f"e{d}", f"f{d}"
        texts.append(words)
    sets = [{tuple(w[i : i + 3]) for i in range(148)} for w in texts]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(400):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    far, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (far.append(df.count()) if name == "join-far" else None, write(df, name))[1])
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {d: root(d) for d in range(400)}
    assert far[0] <= 12_000  # of some 78,000 pairs


def test_shuffle_files_go_with_the_job(spark, monkeypatch):
    from pathlib import Path

    from citegrid.llm import common

    before = spark.conf.get(common.CLEANUP)
    dirs = [Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    had = files()
    df = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    assert common.written(df, "few").count() == 7
    assert not {f for f in files() - had if f.stat().st_size > 200}
    assert spark.conf.get(common.CLEANUP) == before


def test_passages_of_pairs_in_a_crowd(spark):
    """400 texts have 40 words in common, too few for a passage; two and two have 20 more, and one word of the 40 changed in one of them."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"r{x}" for x in rng.integers(0, 1 << 40, n)]
    core, rows = words(40), []
    for i in range(200):
        own = words(20)
        for twin in range(2):
            passage = core + own
            if twin:
                passage[30] = f"e{i}"
            rows.append((2 * i + twin, " ".join(words(60) + passage + words(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(docs).collect()}
    found = sum(50 <= got[d]["n_repeated"] <= 64 for d in got)
    assert found >= 0.97 * 400, found
    assert sum(50 <= got[d]["n_removable"] <= 64 for d in got if d % 2) >= 0.97 * 200
    assert not any(got[d]["n_removable"] for d in got if d % 2 == 0)


def test_only_flagged_texts_are_shingled_again():
    keys = np.array([5, -1, 5 + ngram_join.NEEDED_BITS, 6, 63], np.int64)
    flags = np.zeros(ngram_join.NEEDED_BITS // 64, np.int64)
    for k in (5, 63):
        flags[k >> 6] |= np.array(1 << k, np.uint64).view(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys), pa.array([*"abcde"])], names=["text_key", "text"])] * 2
    assert [b.column(1).to_pylist() for b in ngram_join._flagged(iter(batches), flags)] == [["a", "c", "e"]] * 2
    assert not list(ngram_join._flagged(iter(batches), np.zeros_like(flags)))


def test_lines_meet_in_parts_of_tokens(spark):
    """Each part's pairs are written for themselves; none is lost, and one found in several parts stays once."""
    rows = spark.createDataFrame([(1, 0, t) for t in range(40)] + [(2, 0, t) for t in range(20, 60)], "doc long, line int, token int")
    seen = []

    def pairs(part):
        seen.append({r["token"] for r in part.collect()})
        return part.alias("x").join(part.alias("y"), "token").filter("x.doc < y.doc").select("x.doc", F.col("y.doc").alias("other"))

    found = line_dedup._in_parts(rows, pairs, "pairs")
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    assert set().union(*seen) == set(range(60)) and sum(map(len, seen)) == 60
    assert len(seen) == line_dedup.PARTS and max(map(len, seen)) < 30


def test_written_hands_python_few_rows_at_once(spark):
    """What a task holds for Python is bounded by rows; the session's own setting is back afterwards."""
    before = spark.conf.get(common.BATCH)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    found = [r["n"] for r in common.written(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "batches").collect()]
    assert sum(found) == 5000 and max(found) <= common.BATCH_ROWS
    assert spark.conf.get(common.BATCH) == before
