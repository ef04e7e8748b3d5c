"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost is tried first.

A rule marks the texts it rejects. Cost and selectivity of every rule are measured on a bounded sample; rules are
then ordered by share rejected per second. A text leaves the cascade with its first rejection, and later rules
are computed for survivors only. A text is kept if no rule rejects it, so the verdict is the same in any order
and only the time depends on the sample.

Defined results: a null text counts as empty and is rejected (too few words); an empty table gives an empty one;
equal rows get equal verdicts; other columns are never read and may have any names; texts are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.words import RunHash, Texts, mix, per_text, sliced

SAMPLE_ROWS = 500
"""Rows on which the order of the rules is decided. It has no bearing on the verdicts."""

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_NEWLINE = np.arange(256) == 10
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]) | (np.arange(256) >= 128)
_LOWERCASE = np.isin(np.arange(256), [*range(97, 123)])


class Measures:
    """Counts of each text of a slice, each computed when first asked for."""

    def __init__(self, column: pa.Array):
        self.texts = Texts(column)
        self._made: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = _MEASURES[name](self.texts)
        return self._made[name]


def _word_chars(t: Texts) -> np.ndarray:
    """Code points in words: the bytes that don't continue a character."""
    points = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
    return per_text(points[t.ends] - points[t.starts], t.first_word)


def _marked_words(t: Texts, marks: np.ndarray) -> np.ndarray:
    """Whether each word holds a byte that is marked."""
    sums = np.concatenate(([0], np.cumsum(marks[t.data])))
    return sums[t.ends] > sums[t.starts]


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The text and the content hash of each line that has a word."""
    starts, ends, first = t.spans(_NEWLINE)
    of = np.repeat(np.arange(len(t)), np.diff(first))
    worded = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    return of[worded], t.run_hash(starts[worded], ends[worded])


def _in_text(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(of.astype(np.uint64) + np.uint64(1)))


def _n_lines(t: Texts) -> np.ndarray:
    return np.bincount(_lines(t)[0], minlength=len(t))


def _n_dup_lines(t: Texts) -> np.ndarray:
    of, hashes = _lines(t)
    _, first = np.unique(_in_text(of, hashes), return_index=True)
    return np.bincount(of, minlength=len(t)) - np.bincount(of[first], minlength=len(t))


def _n_repeat_words(t: Texts) -> np.ndarray:
    """Words in windows of three that occur twice or more in their text."""
    at = t.runs(3)
    keys = _in_text(t.text_of_word[at], RunHash(t.word_hash)(at, at + 3))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(t.starts), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return per_text(covered, t.first_word)


_MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: t.n_words,
    "word_chars": _word_chars,
    "n_symbols": lambda t: per_text(_SYMBOL[t.data], t.offsets),
    "n_lines": _n_lines,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_letter_words": lambda t: per_text(_marked_words(t, _LETTER), t.first_word),
    "n_shouted_words": lambda t: per_text(_marked_words(t, _UPPER) & ~_marked_words(t, _LOWERCASE), t.first_word),
}


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Measures], np.ndarray]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
#: The usual limits for web text: word length, symbols, lines and words without letters; and shouting.
RULES = (
    *BASE_RULES,
    Rule("short_words", lambda m: m.word_chars < 3 * m.n_words),
    Rule("long_words", lambda m: m.word_chars > 12 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule("few_letters", lambda m: 10 * m.n_letter_words < 8 * m.n_words),
    Rule("shouting", lambda m: 2 * m.n_shouted_words > m.n_words),
)


def measured(df: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each rule its seconds, texts and rejections on the first ``rows`` rows that Spark finds.

    Every rule starts from the bare texts, so that its cost includes all it needs.
    """
    rules = list(rules)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = []
            for k, rule in enumerate(rules):
                began = time.process_time()
                rejected = int(rule.rejects(Measures(batch.column(0))).sum())
                found.append((k, time.process_time() - began, batch.num_rows, rejected))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["rule", "s", "n", "rejected"])

    sample = df.select(F.col(f"`{text}`").cast("string").alias("text")).limit(rows)
    parts = sample.mapInArrow(timed, "rule long, s double, n long, rejected long")
    return parts.groupBy("rule").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rejected").alias("rejected"))


def ordered(df: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> list[Rule]:
    """The rules by share rejected per second, the most first; ties and unmeasured ones in the order given."""
    rules = list(rules)
    gain = {r["rule"]: (r["rejected"] / r["n"]) / max(r["s"] / r["n"], 1e-9) for r in measured(df, rules, text).collect()}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k))]


def survivors(column: pa.Array, rules: Iterable[Rule]) -> np.ndarray:
    """Which texts no rule rejects; each rule sees only what is left when it is its turn."""
    alive = np.arange(len(column))
    inside, measures = alive, Measures(column)
    for rule in rules:
        if not len(alive):
            break
        if 2 * len(alive) < len(inside):  # else the counts made so far are worth more than fewer texts
            inside, measures = alive, Measures(column.take(pa.array(alive)))
        rejected = np.zeros(len(column), bool)
        rejected[inside] = rule.rejects(measures)
        alive = alive[~rejected[alive]]
    out = np.zeros(len(column), bool)
    out[alive] = True
    return out


def keep(df: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text no rule rejects, with all their columns."""
    rules = ordered(df, rules, text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            yield batch.filter(pa.array(survivors(batch.column(batch.schema.get_field_index(text)), rules)))

    return df.mapInArrow(kept, df.schema)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(df: DataFrame, rules: Iterable[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, the base counts, whether a base rule failed, and whether the cascade keeps the text."""
    rules = ordered(df, rules, text)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            m = Measures(batch.column(1))
            failed = np.logical_or.reduce([r.rejects(m) for r in BASE_RULES])
            kept = np.zeros(batch.num_rows, bool)
            kept[~failed] = survivors(batch.column(1).filter(pa.array(~failed)), rules)
            counts = [pa.array(getattr(m, c), pa.int64()) for c in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(failed), pa.array(kept)], ["key", *BASE, "base_failed", "kept"]
            )

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean"
    return rows.mapInArrow(judged, schema).withColumnRenamed("key", key)
