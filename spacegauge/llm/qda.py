"""A quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Each class has a Gaussian density of the statistics. Its covariance is shrunk towards the diagonal of the pooled one,
so that it can be inverted however few rows a class has; its Cholesky factor is computed once and sent with the
model. A text's score is the logistic of the difference of the log densities and the log prior odds.

Statistics are counts of the whole text, turned into logarithms and shares, so a text of any length, also an empty
one, has finite values. Sums and products of the statistics are added up in Spark over all labelled training rows.

Defined results: a null text counts as empty; a row without a label, or whose ``train`` is null or false, does not
teach; a key with several labels teaches with each; with fewer than two rows of either class every score is the
smoothed share of label 1; equal rows get equal scores; other columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.cascade import Measures
from spacegauge.llm.tables import staged
from spacegauge.llm.words import Texts, mix, per_text, sliced

SHRINKAGE = 0.1
THRESHOLD = 0.7

_BYTE = np.arange(256)
_DIGIT, _UPPER = (_BYTE >= 48) & (_BYTE <= 57), (_BYTE >= 65) & (_BYTE <= 90)
_STOP = np.isin(_BYTE, list(b".!?"))
_MARK = np.isin(_BYTE, list(b"!|"))
_PUNCTUATION = ((_BYTE > 32) & (_BYTE < 48)) | ((_BYTE > 57) & (_BYTE < 65)) | ((_BYTE > 90) & (_BYTE < 97)) | ((_BYTE > 122) & (_BYTE < 127))


def _distinct_words(t: Texts) -> np.ndarray:
    of = t.text_of_word
    keys = mix(t.word_hash ^ mix(of.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(of[first], minlength=len(t))


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of each text, one row a text."""
    m = Measures(column)
    t = m.texts
    words, size = np.maximum(m.n_words, 1), np.maximum(np.diff(t.offsets), 1)
    share = lambda count, of: np.log((count + 0.5) / (of + 1.0))
    bytes_of = lambda kind: per_text(kind[t.data], t.offsets)
    lines = np.maximum(m.n_lines, 1)
    longest = np.zeros(len(t))
    has = np.flatnonzero(m.n_words)
    if len(has):
        longest[has] = np.maximum.reduceat(t.ends - t.starts, t.first_word[:-1][has])
    return np.stack(
        [
            np.log1p(m.n_words),
            m.word_chars / words,
            np.log1p(longest),
            np.log1p(m.n_words / lines),
            share(m.n_symbols, words),
            m.n_dup_lines / lines,
            share(m.n_repeat_words, words),
            m.n_letter_words / words,
            share(m.n_shouted_words, words),
            share(bytes_of(_DIGIT), size),
            share(bytes_of(_UPPER), size),
            share(bytes_of(_STOP), words),
            share(bytes_of(_MARK), words),
            share(bytes_of(_PUNCTUATION), words),
            _distinct_words(t) / words,
        ],
        1,
    ).astype(np.float64)


def described(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and statistics of each row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = statistics(batch.column(1))
            bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], ["key", "x"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(describe, f"key {rows.schema['key'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per label (columns ``label``, ``x``): number of rows, sums, and sums of products."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for c in np.unique(label):
                own = np.column_stack((np.ones((label == c).sum()), x[label == c]))
                sums = (own.T @ own).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sums), c, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)],
                    ["label", "i", "v"],
                )

    sums = rows.mapInArrow(add, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for label in {r["label"] for r in sums}:
        own = sorted((r["i"], r["v"]) for r in sums if r["label"] == label)
        table = np.array([v for _, v in own]).reshape(int(len(own) ** 0.5), -1)
        out[label] = int(round(table[0, 0])), table[0, 1:], table[1:, 1:]
    return out


class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log priors of two classes."""

    def __init__(self, found: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        n = {c: found[c][0] if c in found else 0 for c in (0, 1)}
        self.constant = (n[1] + 1) / (n[0] + n[1] + 2) if min(n.values()) < 2 else None
        if self.constant is not None:
            return
        mean = {c: found[c][1] / n[c] for c in n}
        scatter = {c: found[c][2] - n[c] * np.outer(mean[c], mean[c]) for c in n}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        target = np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.classes = []
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - shrinkage) * scatter[c] / n[c] + shrinkage * target)
            offset = np.log(n[c] / (n[0] + n[1])) - np.log(np.diag(factor)).sum()
            self.classes.append((mean[c], np.linalg.inv(factor), offset))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        low, high = (offset - 0.5 * np.square((x - mean) @ inverse.T).sum(1) for mean, inverse, offset in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def scored(
    df: DataFrame, labels: DataFrame, label: str, train: str = "train", key: str = "doc_id", text: str = "text",
    shrinkage: float = SHRINKAGE, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of ``df``: key, ``score`` and ``predicted``. ``train`` is a column of ``labels``."""
    rows = staged(described(df, key, text), "statistics")
    known = labels.filter(F.col(f"`{train}`") & F.col(f"`{label}`").isin(0, 1)).select(
        F.col(f"`{key}`").alias("label_key"), F.col(f"`{label}`").cast("int").alias("label")
    )
    taught = rows.join(known, F.col("key") == F.col("label_key")).select("label", "x")
    model = Discriminant(moments(taught), shrinkage)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model(_matrix(batch.column(1)))
                predicted = pa.array((p >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), predicted], ["key", "score", "predicted"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(score, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
