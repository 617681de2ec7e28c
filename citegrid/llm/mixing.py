"""Mixing sources to target weights with soft membership.

A classifier learns domains from a labelled table and gives every document a posterior for each domain.
Rates r >= 0, one for each document, are then fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, come to its target share of the budget: least squares by accelerated
projected gradient, with a small pull towards 1, until no rate moves. Documents whose posteriors lie in one
cell of a grid (``GRID`` steps for each domain) have one rate. Spark sums the tokens and posteriors of each
cell over all documents, exactly; there are at most (GRID + 1) ** (domains - 1) cells, so the steps run on
that small table, however many documents there are.

The classifier is fitted on at most ``SAMPLE`` labelled documents (those with the least hash of their
id); posteriors, totals and rates cover all documents. Domains come from ``labels``: toxic, else low
quality, else good. The budget keeps what the documents have of the good domain, so unwanted
domains shrink and good documents stay.

Nulls: a null text has no tokens and the posterior of no features; a null label is no label; without
labels every posterior is the prior and every rate 1 or near it. A repeated document gets the same rate
in each row. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, ship, table, written
from .words import LOWER, NOT_ALNUM, mix, rows_of, slices, span_hashes, spans

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.97, "low": 0.02, "toxic": 0.01}
SAMPLE = 8_000
FEATURES = 1 << 16
SURE = 6.0
GRID = 100
PULL = 1e-4
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each row (row, feature) and its number of words. The first 64 features are
    shares of symbols, capitals and different words, in eight steps each; the others hashed words."""
    begins, ends, first = spans(raw, at, NOT_ALNUM)
    hashes = span_hashes(LOWER[raw], begins, ends)
    rows, n = rows_of(first), np.diff(first)
    feature = 64 + (hashes % np.uint64(FEATURES - 64)).astype(np.int64)
    pair = np.unique(rows * FEATURES + feature)
    kinds = np.bincount(pair // FEATURES, minlength=len(n))
    chars = np.maximum(np.diff(at), 1)
    extra = []
    for k, share in enumerate(((np.diff(np.concatenate(([0], np.cumsum(flag[raw])))[at]) / chars) for flag in (SYMBOLS, UPPER))):
        extra.append(8 * k + np.minimum((np.sqrt(share) * 16).astype(np.int64), 7))
    extra.append(16 + np.minimum((kinds / np.maximum(n, 1) * 8).astype(np.int64), 7))
    every = np.arange(len(n))
    pair = np.sort(np.concatenate([pair, *(every * FEATURES + e for e in extra)]))
    return pair // FEATURES, pair % FEATURES, n


def _values(row: np.ndarray, feature: np.ndarray, n_rows: int) -> np.ndarray:
    """Shares count 1 each; the hashed words of a row make a vector of length 1."""
    words = feature >= 64
    kinds = np.bincount(row[words], minlength=n_rows)
    return np.where(words, 1 / np.sqrt(np.maximum(kinds, 1))[row], 1.0)


def telling(rows: np.ndarray, index: np.ndarray, domain: np.ndarray, n_domains: int, sure: float = SURE) -> np.ndarray:
    """For each feature and domain the logarithm of how much commoner the feature is in the domain's documents
    than in the others, where that is surer than ``sure`` standard deviations; else 0. A word that tells a
    domain counts fully then, however long the text around it is."""
    size = np.bincount(domain, minlength=n_domains).astype(float)
    found = np.stack([np.bincount(index[domain[rows] == c], minlength=FEATURES) for c in range(n_domains)], 1).astype(float)
    other, rest = found.sum(1, keepdims=True) - found, size.sum() - size
    inside, outside = (found + 0.5) / (size + 1), (other + 0.5) / (rest + 1)
    pooled = (found + other + 1) / (size.sum() + 2)
    apart = (inside - outside) / np.sqrt(pooled * (1 - pooled) * (1 / size.clip(1) + 1 / rest.clip(1)))
    known = (apart > sure) & (size > 0) & (rest > 0)
    known[:64] = False
    return np.where(known, np.log(inside / outside), 0.0)


def fit(rows: list[np.ndarray], domain: np.ndarray, n_domains: int, steps: int = 300, rate: float = 1.2, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient descent with momentum, on top of the words that tell a domain; gives the weights,
    of which the last row is the bias, and the telling words' own."""
    weights, fixed = np.zeros((FEATURES + 1, n_domains)), np.zeros((FEATURES, n_domains))
    if len(rows) == 0:
        return weights, fixed
    sizes = np.array([len(r) for r in rows])
    at, index = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows)
    fixed = telling(at, index, domain, n_domains)
    offset = np.stack([np.bincount(at, fixed[index, c], len(rows)) for c in range(n_domains)], 1)
    value, wanted = _values(at, index, len(rows)), np.eye(n_domains)[domain]
    weights[-1] = np.log(wanted.mean(0) + 1e-3)
    speed = np.zeros_like(weights)
    for _ in range(steps):
        score = np.stack([np.bincount(at, weights[index, c] * value, len(rows)) for c in range(n_domains)], 1) + weights[-1] + offset
        score = np.exp(score - score.max(1, keepdims=True))
        error = (score / score.sum(1, keepdims=True) - wanted) / wanted.sum(0).clip(1)[domain][:, None]  # domains weigh alike
        slope = decay * weights
        for c in range(n_domains):
            slope[:-1, c] += np.bincount(index, error[at, c] * value, FEATURES) / n_domains
        slope[-1] = error.sum(0) / n_domains
        speed = 0.9 * speed - rate * slope
        weights += speed
    return weights, fixed


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most ``sample`` labelled documents; ``labelled`` has doc_id and domain (0, 1, ...)."""
    ship(docs.sparkSession)
    chosen = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    chosen = written(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "mix-sample")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in slices(batches, "text"):
            row, feature, _ = features(raw, at)
            lists = np.split(feature, np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "domain", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", "text")  # sample rows at most
    found = rows.mapInArrow(told, "doc_id long, domain int, features array<long>").orderBy("doc_id").limit(sample).toPandas()
    return fit([np.asarray(f) for f in found["features"]], found["domain"].to_numpy(), len(DOMAINS))


def _posterior(raw: np.ndarray, at: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    weights, fixed = model
    row, feature, n = features(raw, at)
    value = _values(row, feature, len(n))
    score = np.stack([np.bincount(row, w[feature] * value + f[feature], len(n)) + w[-1] for w, f in zip(weights.T, fixed.T, strict=True)], 1)
    score = np.exp(score - score.max(1, keepdims=True))
    return np.round(score / score.sum(1, keepdims=True), 6), n


def posteriors(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens and a posterior for each domain."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch, raw, at in slices(batches, "text"):
            score, n = _posterior(raw, at, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *(pa.array(s) for s in score.T)], names=["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def cell_of(p: np.ndarray) -> np.ndarray:
    """The number of each posterior's cell of the grid."""
    steps = np.floor(p[:, :-1] * GRID + 1e-9).astype(np.int64)
    return steps @ ((GRID + 1) ** np.arange(steps.shape[1]))


def solve(tokens: np.ndarray, totals: np.ndarray, want: np.ndarray, pull: float = PULL, close: float = 1e-7, most: int = 500_000) -> np.ndarray:
    """Rates r >= 0 of cells with so many tokens and such domain totals (a row for each cell): the least
    sum over domains of (r @ totals - want) ** 2 / natural total, plus pull * tokens @ (r - 1) ** 2."""
    natural = np.maximum(totals.sum(0), 1.0)
    share = totals / np.maximum(tokens, 1.0)[:, None]
    now = point = np.ones(len(tokens))
    step, momentum = 1.0 / (1.0 + pull), 1.0
    for _ in range(most):
        slope = share @ ((point @ totals - want) / natural) + pull * (point - 1)
        new = np.maximum(0.0, point - step * slope)
        if np.abs(new - point).max(initial=0.0) < close * pull:
            return new
        if (point - new) @ (new - now) > 0:  # momentum leads uphill: start it anew
            momentum = 1.0
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        point, now, momentum = new + (momentum - 1) / after * (new - now), new, after
    return now


def fit_rates(found: DataFrame, targets: dict[str, float] | None = None) -> tuple[np.ndarray, dict]:
    """The rate of each cell (by its number; 1 where no document is), and a report: the domains' targets, and
    the shares that the documents have by nature and at these rates."""
    ship(found.sparkSession)
    want = np.array([(targets or TARGETS)[d] for d in DOMAINS])
    want = want / want.sum()
    names = [f"p_{d}" for d in DOMAINS]
    cell = sum((F.floor(F.col(n) * GRID + 1e-9) * (GRID + 1) ** i for i, n in enumerate(names[:-1])), F.lit(0)).alias("cell")
    millionths = [F.sum(F.round(F.col(n) * 1_000_000).cast("long") * F.col("n_tokens")).alias(n) for n in names]
    cells = found.groupBy(cell).agg(F.sum("n_tokens").alias("n_tokens"), *millionths).orderBy("cell").toPandas()  # (GRID + 1) ** (domains - 1) rows at most
    rate = np.ones((GRID + 1) ** (len(DOMAINS) - 1))
    tokens, totals = cells["n_tokens"].to_numpy(np.float64), cells[names].to_numpy(np.float64) / 1e6
    natural = totals.sum(0)
    if natural.sum() == 0:
        return rate, {}
    good = int(np.argmax(want))
    budget = natural[good] / want[good] if natural[good] else natural.sum()
    fitted = solve(tokens, totals, want * budget)
    rate[cells["cell"].to_numpy(np.int64)] = fitted
    reached = fitted @ totals
    report = {d: {"target": float(w), "natural": float(n), "reached": float(r)} for d, w, n, r in zip(DOMAINS, want, natural / natural.sum(), reached / max(reached.sum(), 1e-9), strict=True)}
    return rate, report


def with_rates(found: DataFrame, rate: np.ndarray) -> DataFrame:
    names = [f"p_{d}" for d in DOMAINS]
    shared = found.sparkSession.sparkContext.broadcast(rate)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 2 + len(names))], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(shared.value[cell_of(p)], 4))], names=[*batch.schema.names, "rate"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "n_tokens", *names).mapInArrow(final, f"doc_id {kind}, n_tokens long, " + ", ".join(f"{n} double" for n in names) + ", rate double")


def label_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", domain.alias("domain"))


def copies(ids: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """How often documents are taken: the rate, rounded up or down by the hash of the id."""
    chance = (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x6D6978)) >> np.uint64(11)) / float(1 << 53)
    return np.floor(rate + chance).astype(np.int64)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, posteriors and rate of each document."""
    found = written(posteriors(docs, train(docs, label_domains(labels))), "mix-posteriors")
    return with_rates(found, fit_rates(found, targets)[0])


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row taken as often as its rate says, and all its columns. A row's rate follows
    from its text and the cells' rates, so nothing is joined."""
    weights = train(docs, label_domains(labels))
    found = written(posteriors(docs, weights), "mix-posteriors")
    shared = docs.sparkSession.sparkContext.broadcast((weights, fit_rates(found, targets)[0]))
    drop_written(found)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rate = shared.value
        for batch, raw, at in slices(batches, "text"):
            p, _ = _posterior(raw, at, weights)
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), copies(ids, np.round(rate[cell_of(p)], 4)))))

    return docs.mapInArrow(take, docs.schema)


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
