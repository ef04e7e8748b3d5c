"""Removal of repeated spans of words with a sparse de Bruijn graph.

The edges of the graph are token k-mers. Of the k-mers of each window of ``span`` words the one with the least hash
is sampled, so equal windows sample the same edge, wherever they are, and one edge in about fourteen words is
enough. With each sampled edge goes the path around it: the words of all consecutive windows that sample it there.

* Edges that occur once cannot lie in a repeated window and end here.
* An edge whose occurrences all have the same path does not branch. Joined back to its occurrences, the path is
  compacted: all its windows are repeated, and no window of it is looked at on its own.
* At edges that branch, the paths are verified at their source coordinates: the windows that sampled the edge are
  read from their documents, counted by their words' 128-bit hash, and those found twice are repeated.

All occurrences of a window sample the same edge, hence fall under the same case, so the result is exact (up to
128-bit collisions, of windows or of whole texts). Edges are counted with partial aggregates and joined with adaptive skew handling, so an edge
that a third of the documents share is never brought together in one task.

Defined results: null and empty texts have no words; texts shorter than ``span`` words stay as they are, but for
blanks; equal rows are occurrences of each other; columns other than the key and the text are not read and may
have any names; a null key is a key like any other; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.tables import fingerprint, staged
from spacegauge.llm.words import RunHash, Texts, mix, sliced

SPAN = 35
K = 8

_INDEX = np.uint64((1 << 31) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in a logarithmic number of passes."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def sampled(t: Texts, span: int, k: int) -> tuple[np.ndarray, ...]:
    """The sampled edges of a slice: k-mer hash, path hash, first window and number of windows of each."""
    windows = t.runs(span)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(windows):
        return none
    first, second = RunHash(t.word_hash), RunHash(t.word_hash, 1)
    at = np.arange(len(t.starts) - k + 1)
    edges = first(at, at + k)
    # The place below the upper bits of the hash: the leftmost of equal k-mers wins, in every copy of a window.
    places = _least((edges & ~_INDEX) | at.astype(np.uint64), span - k + 1)[windows] & _INDEX
    begin = np.flatnonzero(np.concatenate(([True], (places[1:] != places[:-1]) | (np.diff(windows) != 1))))
    count = np.diff(np.concatenate((begin, [len(windows)])))
    start, place = windows[begin], places[begin].astype(np.int64)
    path = mix(second(start, start + count + span - 1) ^ mix((place - start).astype(np.uint64) + np.uint64(1)))
    return edges[place], path, start, count


def _rows(df: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """Key, text, the text's fingerprint, and other columns; rows of one text have the same result."""
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))) if carry else F.lit(None).cast("int")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), rest.alias("rest"))
    return rows.withColumn("text_no", F.coalesce(fingerprint("text"), F.lit(b"")))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns that ``right`` has for the same text, or nulls."""
    right = right.withColumnRenamed("text_no", "their_no")
    return left.join(right, F.col("text_no") == F.col("their_no"), "left").drop("their_no")


def edges(rows: DataFrame, span: int, k: int) -> DataFrame:
    """Per sampled edge: its hash, its path's hash, fingerprint of the text it is from, first word and windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            t = Texts(batch.column(0))
            edge, path, start, count = sampled(t, span, k)
            of = t.text_of_word[start] if len(start) else start
            source = pa.array(of)
            columns = [edge.view(np.int64), path.view(np.int64), start - t.first_word[of], count]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(source)]
                + [pa.array(c).cast(t_) for c, t_ in zip(columns, kinds, strict=True)],
                ["text_no", "edge", "path", "start", "windows"],
            )

    rows = rows.select("text", "text_no")
    return rows.mapInArrow(found, "text_no binary, edge long, path long, start int, windows int")


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def _without(text: str | None, t: Texts, row: int, gone: np.ndarray) -> bytes:
    """The kept words of a text, joined by single blanks."""
    raw, base = (text or "").encode(), t.offsets[row]
    lo, hi = t.first_word[row], t.first_word[row + 1]
    starts, ends = (t.starts[lo:hi] - base)[~gone].tolist(), (t.ends[lo:hi] - base)[~gone].tolist()
    return b" ".join([raw[a:b] for a, b in zip(starts, ends, strict=True)])


def judged(
    df: DataFrame, span: int = SPAN, k: int = K, key: str = "doc_id", text: str = "text", texts: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by blanks).

    With ``texts`` also ``kept``: those words, or the text as it was if none is removed. ``rest`` is a struct of the
    columns named by ``carry`` (fields c0, c1, ...).
    """
    rows = _rows(df, key, text, list(carry))
    found = edges(rows, span, k)
    # Written, so that the joins read two plain shuffles, of which adaptive execution can split the hot partitions.
    shared = staged(
        found.groupBy("edge")
        .agg(F.count("*").alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi"))
        .filter("n > 1")
        .select("edge", F.expr("lo != hi").alias("branches")),
        "edges",
    )
    # Sets, which end at a text's own edges however often the text occurs; tasks fold copies before the shuffle.
    places = (
        found.join(shared, "edge")
        .groupBy("text_no")
        .agg(
            F.collect_set(F.expr("if(branches, null, struct(start, windows))")).alias("paths"),
            F.collect_set(F.expr("if(branches, struct(start, windows), null)")).alias("branching"),
        )
    )
    kind = rows.schema["key"].dataType.simpleString()
    pair = "array<struct<start:int,windows:int>>"
    rest = rows.schema["rest"].dataType.simpleString()
    result = "n_words long, n_removed long, kept_sha256 string, kept string"

    def counts(t: Texts, batch: pa.RecordBatch, covered) -> list:
        out = []
        for row, value in enumerate(batch.column(1)):
            n = int(t.n_words[row])
            gone = covered(row, n)
            whole = value.as_py()
            kept = _without(whole, t, row, gone)
            result = (kept.decode() if gone.any() else whole) if texts else None
            out.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), result))
        return out

    def spans(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
        value = column[row]
        if not value.is_valid:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = value.values
        return flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish the texts without branching edges; list the windows at the edges of the others."""
        for batch in sliced(batches, "text"):
            t = Texts(batch.column(1))
            open_rows = np.array([v.is_valid and len(v) > 0 for v in batch.column(4)], bool)

            def paths(row: int, n: int, batch=batch) -> np.ndarray:
                start, windows = spans(batch.column(3), row)
                return _covered(n, start, windows + span - 1)

            done = counts(t, batch, paths)
            at, h1, h2, size = [], [], [], np.zeros(len(t), np.int64)
            if open_rows.any():
                one, two = RunHash(t.word_hash), RunHash(t.word_hash, 1)
                for row in np.flatnonzero(open_rows):
                    start, windows = spans(batch.column(4), row)
                    own = np.repeat(start - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
                    whole = own + t.first_word[row]
                    at.append(own)
                    h1.append(one(whole, whole + span))
                    h2.append(two(whole, whole + span))
                    size[row] = len(own)
            joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            windows = pa.StructArray.from_arrays(
                [
                    pa.array(joined(h1, np.uint64).view(np.int64)),
                    pa.array(joined(h2, np.uint64).view(np.int64)),
                    pa.array(joined(at, np.int64)).cast(pa.int32()),
                ],
                ["h1", "h2", "start"],
            )
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), windows)
            pending = pa.array(open_rows)
            blank = pa.array([None] * len(t), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pending,
                    pa.compute.if_else(pending, batch.column(1).cast(pa.string()), blank),
                    batch.column(3),
                    listed,
                    batch.column(5),
                    *(pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))),
                ],
                ["key", "text_no", "pending", "text", "paths", "listed", "rest", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    joined = _with(rows, places).select("key", "text", "text_no", "paths", "branching", "rest")
    halfway = staged(
        joined.mapInArrow(
            first_pass,
            f"key {kind}, text_no binary, pending boolean, text string, paths {pair}, "
            f"listed array<struct<h1:long,h2:long,start:int>>, rest {rest}, {result}",
        ),
        "spans",
        "pending",
    )
    pending = halfway.filter("pending")
    windows = pending.select("text_no", F.inline("listed"))
    twice = staged(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "windows")
    repeated = windows.join(twice, ["h1", "h2"]).groupBy("text_no").agg(F.collect_set("start").alias("starts"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            t = Texts(batch.column(1))

            def both(row: int, n: int, batch=batch) -> np.ndarray:
                start, windows = spans(batch.column(2), row)
                value = batch.column(3)[row]
                own = value.values.to_numpy().astype(np.int64) if value.is_valid else np.zeros(0, np.int64)
                return _covered(n, np.concatenate((start, own)), np.concatenate((windows + span - 1, np.full(len(own), span))))

            done = counts(t, batch, both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4)]
                + [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["key", "rest", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    finished = (
        _with(pending, repeated)
        .select("key", "text", "paths", "starts", "rest")
        .mapInArrow(second_pass, f"key {kind}, rest {rest}, {result}")
    )
    out = halfway.filter("not pending").select("key", "rest", "n_words", "n_removed", "kept_sha256", "kept")
    dropped = ([] if carry else ["rest"]) + ([] if texts else ["kept"])
    return out.unionByName(finished).drop(*dropped).withColumnRenamed("key", key)


def removed(df: DataFrame, span: int = SPAN, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with all their columns, and ``text`` without its repeated spans.

    A text that loses words becomes its kept words joined by blanks; one that loses all is left out with its row.
    """
    carry = [c for c in df.columns if c not in (key, text)]
    out = judged(df, span, k, key, text, texts=True, carry=carry).filter("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carry)}
    columns |= {key: F.col(f"`{key}`"), text: F.col("kept").cast(df.schema[text].dataType).alias(text)}
    return out.select(*(columns[c] for c in df.columns))
