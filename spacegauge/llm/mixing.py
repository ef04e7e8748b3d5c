"""Mixing towards target weights with soft domain membership.

A classifier taught by the labelled table gives every document its probabilities of the domains: a softmax regression
on hashed words and document statistics, fitted on at most ``TRAIN_ROWS`` labelled rows (those with the least hash).
A document then counts towards each domain with its tokens times the probability, and nonnegative rates r are sought:

    minimise  1/2 sum_k (sum_d r_d t_d p_dk / T - target_k)^2 / base_k + ridge/2 sum_d t_d / T (r_d - 1)^2,   r >= 0

where base_k is the less of what domain k has at present and is to have (what it has, if it is to have none), which
preconditions rare domains, so that the ridge takes as little of a rare target as of a common one. It is solved by projected gradient steps with lazy projection: every step's gradient,
which for a document is its probabilities times the domains' residuals, is added up before the projection, so the rates
are r_d = max(1 - sum_k p_dk g_k / ridge, 0) with one accumulated number g_k per domain. A step adds up the tokens that
the rates give each domain, over all documents in Spark; no state is kept per document, and any task can be run again.
Steps are accelerated by Anderson mixing, that is by the combination of the last few steps whose gradients cancel best,
and go back halfway where one grows the gradient. They end when the gradient is zero but for ``OPTIMAL`` of a domain's
tokens; if it isn't after ``STEPS``, that is an error. The totals reached come with the result, and with them the
domains whose target is missed by more than ``TOLERANCE`` of itself, as nonnegative rates can't meet all targets: every
document has a little of every domain, so a target of zero is only approached.

``copies`` rounds a rate up or down by a hash of key and text, so that its expectation is the rate.

Defined results: a null or empty text has no tokens but a rate, as its probabilities say; labels without a document,
or that are null, teach nothing; a domain without labelled rows has the prior of one row; equal rows get equal rates
and copies; an empty table gives an empty one; other columns are not read and may have any names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.qda import statistics
from spacegauge.llm.tables import spare_name, staged
from spacegauge.llm.words import Texts, mix, sliced

TRAIN_ROWS = 6_000
BUCKETS = 1 << 16
EPOCHS = 16
RIDGE = 1e-3
STEPS = 200
TOLERANCE = 1e-2
OPTIMAL = 1e-8

_log = logging.getLogger(__name__)


def _features(t: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words of each text, and their bounds."""
    of = t.text_of_word
    bucket = (t.word_hash >> np.uint64(40)).astype(np.int64) % buckets
    keys = np.unique(of * buckets + bucket)
    return (keys % buckets).astype(np.int32), np.searchsorted(keys, np.arange(len(t) + 1) * buckets)


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Softmax:
    """Softmax regression on hashed words (each with the weight one over the root of their number) and statistics."""

    def __init__(self, domains: int, buckets: int = BUCKETS):
        self.domains, self.buckets = domains, buckets

    def _logits(self, words: np.ndarray, bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _row_sums(self.of_words[words], bounds) / self._length(bounds) + x @ self.of_x + self.prior

    @staticmethod
    def _length(bounds: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.diff(bounds), 1))[:, None]

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.5, batch: int = 64) -> Softmax:
        """Learn from (domain, words, statistics) by adaptive gradient steps in a fixed random order."""
        k = self.domains
        share = np.array([sum(r[0] == c for r in rows) + 1 for c in range(k)], float)
        self.prior = np.log(share / share.sum())
        x = np.array([r[2] for r in rows]) if rows else np.zeros((0, 1))
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if rows else (np.zeros(1), np.ones(1))
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        self.of_words, self.of_x = np.zeros((self.buckets, k)), np.zeros((x.shape[1], k))
        seen_words, seen_x = np.full((self.buckets, k), 1e-3), np.full(self.of_x.shape, 1e-3)
        label = np.array([r[0] for r in rows], int)
        order = np.random.Generator(np.random.PCG64(5))
        for _ in range(epochs if rows else 0):
            shuffled = order.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                own = shuffled[lo : lo + batch]
                words = np.concatenate([rows[i][1] for i in own])
                bounds = np.concatenate(([0], np.cumsum([len(rows[i][1]) for i in own])))
                error = _softmax(self._logits(words, bounds, x[own]))
                error[np.arange(len(own)), label[own]] -= 1
                spread = np.repeat(error / self._length(bounds), np.diff(bounds), 0)
                at, inverse = np.unique(words, return_inverse=True)
                g = np.stack([np.bincount(inverse, spread[:, c], len(at)) for c in range(k)], 1) / len(own)
                seen_words[at] += g * g
                self.of_words[at] -= rate * g / np.sqrt(seen_words[at])
                g = x[own].T @ error / len(own) + 1e-3 * self.of_x
                seen_x += g * g
                self.of_x -= 0.2 * rate * g / np.sqrt(seen_x)
        self.of_words = self.of_words.astype(np.float32)
        return self

    def __call__(self, words: np.ndarray, bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != len(self.mean):
            x = np.zeros((len(x), len(self.mean)))
        return _softmax(self._logits(words, bounds, np.clip((x - self.mean) / self.scale, -5, 5)))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def fitted(df: DataFrame, labels: DataFrame, domain: Column, domains: int, key: str = "doc_id", text: str = "text") -> Softmax:
    """The classifier of the documents in ``df``; ``domain`` gives the number of a row of ``labels``, or null."""
    known = labels.select(F.col(f"`{key}`").alias("label_key"), domain.cast("int").alias("domain")).filter(
        F.col("label_key").isNotNull() & F.col("domain").between(0, domains - 1)
    )
    chosen = known.orderBy(F.xxhash64("label_key"), "label_key", "domain").limit(TRAIN_ROWS)
    taught = _rows(df, key, text).join(F.broadcast(chosen), F.col("key") == F.col("label_key"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words, bounds = _features(Texts(batch.column(0)), BUCKETS)
            x = statistics(batch.column(0))
            parts = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(parts, pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["domain", "words", "x"]
            )

    rows = taught.select("text", "domain").mapInArrow(describe, "domain int, words binary, x binary")
    # A key may repeat in the documents; the bound holds for rows too.
    rows = rows.orderBy(F.xxhash64("words"), "x", "domain").limit(TRAIN_ROWS).collect()
    return Softmax(domains).fit([(r["domain"], np.frombuffer(r["words"], np.int32), np.frombuffer(r["x"])) for r in rows])


def memberships(df: DataFrame, model: Softmax, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``text_no`` (a number of its text), ``n_tokens`` and the domains' probabilities ``p``."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            t = Texts(batch.column(1))
            p = model(*_features(t, model.buckets), statistics(batch.column(1)))
            bounds = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(t.n_words, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(p.ravel()))],
                ["key", "text_no", "n_tokens", "p"],
            )

    rows = _rows(df, key, text).withColumn("text_no", F.xxhash64("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(predict, f"key {kind}, text_no long, n_tokens long, p array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rates(p: np.ndarray, g: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates by the domains' numbers ``g``, and what they are before those below zero become zero."""
    point = 1 - p @ g / ridge
    return np.maximum(point, 0), point


def _copies(rate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The rate rounded up or down by a row's hash, in the proportion of its fraction."""
    return np.floor(rate + (mix(draw.view(np.uint64)) >> np.uint64(11)) / 2.0**53).astype(np.int64)


def _tokens(members: DataFrame, g: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The tokens that the rates by ``g`` give each domain, and all tokens at present; added up in generated code."""
    p = [F.col("p")[i] for i in range(len(g))]
    point = F.lit(1.0)
    for share, number in zip(p, g, strict=True):
        point = point - share * F.lit(float(number) / ridge)
    weight = F.col("n_tokens") * F.greatest(point, F.lit(0.0))
    row = members.agg(*[F.sum(weight * share) for share in p], F.sum("n_tokens")).first()
    return np.array([x or 0.0 for x in row[:-1]], float), float(row[-1] or 0)


def fit_rates(members: DataFrame, targets: Sequence[float], ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE):
    """The domains' numbers ``g`` of the best rates, and the expected shares that these rates give.

    ``targets`` are the domains' tokens as shares of the present number of tokens. ``steps`` bounds the passes.
    """
    targets = np.asarray(targets, float)
    k = len(targets)
    present, total = _tokens(members, np.zeros(k), ridge)
    if not total:
        return np.zeros(k), targets
    shares = present / total
    own = shares > 0  # no rate changes a domain without tokens
    base = weights_of(shares, targets)
    scale = np.maximum(shares, targets)

    def step(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step that the gradient asks for at the rates by ``g``, and the shares reached."""
        reached = _tokens(members, g, ridge)[0] / total
        return np.where(own, (reached - targets) / base - g, 0), reached

    def size(ahead: np.ndarray) -> float:
        return float(np.abs(ahead * base / np.where(own, scale, 1)).max())

    # Of a plain step; what the rates add to a domain grows no faster than its share.
    length = ridge / ((shares / base).max() + ridge)
    g = np.zeros(k)
    ahead, reached = step(g)
    points, steps_seen = [g], [ahead]
    for _ in range(steps):
        if size(ahead) <= OPTIMAL:
            break
        move = length * ahead
        if len(points) > 1:
            moved, turned = np.diff(points, axis=0).T, np.diff(steps_seen, axis=0).T
            weights = np.linalg.lstsq(turned * base[:, None], ahead * base, rcond=1e-10)[0]
            move = move - (moved + length * turned) @ weights
        for _ in range(8):
            tried = g + move
            found, given = step(tried)
            if size(found) < size(ahead):
                break
            move = move / 2
        points, steps_seen = [*points, tried][-k - 1 :], [*steps_seen, found][-k - 1 :]
        if size(found) >= size(ahead) and size(ahead) <= 1e-3 * tolerance:  # as exact as the sums are
            break
        g, ahead, reached = tried, found, given
    if size(ahead) > 1e-3 * tolerance:
        raise ArithmeticError(f"the rates are not settled after {steps} steps: gradient {ahead * base}")
    if off := missed(targets, reached, tolerance):
        _log.warning("domains %s miss their targets: %s of %s reached", off, reached.tolist(), targets.tolist())
    return g, reached


def weights_of(shares: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """What a domain's miss is divided by; one for domains without tokens."""
    base = np.where(targets > 0, np.minimum(shares, targets), shares)
    return np.where(base > 0, base, 1)


def missed(targets: Sequence[float], reached: np.ndarray, tolerance: float = TOLERANCE) -> list[int]:
    """The domains that are off their target by more than the tolerance; of a target of zero, all that have tokens."""
    targets = np.asarray(targets, float)
    return np.flatnonzero(np.abs(reached - targets) > tolerance * targets).tolist()


def mixed(df: DataFrame, labels: DataFrame, domain: Column, targets: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``text_no``, ``n_tokens``, the domains' probabilities ``p``, ``rate`` and ``copies``.

    The metadata of ``rate`` hold the ``targets``, the shares ``reached`` and the domains that ``missed``.
    """
    model = fitted(df, labels, domain, len(targets), key, text)
    members = staged(memberships(df, model, key, text), "memberships")
    g, reached = fit_rates(members, targets)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rate, _ = _rates(_matrix(batch.column(3)), g, RIDGE)
                copies = pa.array(_copies(rate, batch.column(4).to_numpy()).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(4)), pa.array(rate), copies],
                    ["key", "text_no", "n_tokens", "p", "rate", "copies"],
                )

    kind = members.schema["key"].dataType.simpleString()
    out = members.withColumn("draw", F.xxhash64("key", "text_no")).mapInArrow(
        rated, f"key {kind}, text_no long, n_tokens long, p array<double>, rate double, copies int"
    )
    shares = {"targets": [float(x) for x in targets], "reached": reached.tolist(), "missed": missed(targets, reached)}
    return out.withColumn("rate", F.col("rate").alias("rate", metadata=shares)).withColumnRenamed("key", key)


def resampled(df: DataFrame, labels: DataFrame, domain: Column, targets: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as its copies say, with all their columns.

    The probabilities are computed again where the texts are, which spares a shuffle of the texts.
    """
    model = fitted(df, labels, domain, len(targets), key, text)
    g, _ = fit_rates(staged(memberships(df, model, key, text), "memberships"), targets)
    draw = spare_name(df, "draw")

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            p = model(*_features(Texts(column), model.buckets), statistics(column))
            copies = _copies(_rates(p, g, RIDGE)[0], batch.column(batch.num_columns - 1).to_numpy())
            rows = batch.take(pa.array(np.repeat(np.arange(len(copies)), copies)))
            yield rows.select(rows.schema.names[:-1])

    rows = df.withColumn(draw, F.xxhash64(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`").cast("string"))))
    return rows.mapInArrow(repeat, df.schema)
