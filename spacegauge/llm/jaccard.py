"""Similarity join of texts by the Jaccard similarity of their word n-gram sets, found by MinHash banding.

1. Texts with the same set of n-grams are one class; only one of them, the representative, is compared further.
2. A band hash covers ``rows`` MinHash values. Bands and rows are chosen so that a pair at the threshold shares a
   band with the target recall. Classes are shuffled on band hashes; a bucket links its classes to its least one.
3. Classes that buckets connect are candidates of each other. They are compared on their full sets, exactly and in
   whole numbers, in cells of two blocks of about ``BLOCK`` classes each, so that no group meets in one task, and a
   cell returns a count of links per class and a spanning forest, so pairs are never rows.
4. The forests of all cells make the near-duplicate classes.

A link is a pair of rows whose similarity reaches the threshold. A verified link is never wrong; a pair at the
threshold is missed with a chance of one minus the recall at most, and a pair above it more rarely.

Defined results: a text of one to ``n`` - 1 words has one n-gram, all its words. A text without words, or null, has
no links and is its own class. Equal rows are links of each other. A null key is a key like any other, but is never
a class id if the class has another. Columns other than key and text are not read and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.components import components
from spacegauge.llm.tables import fingerprint, spare_name, staged
from spacegauge.llm.words import RunHash, Texts, mix, sliced

N = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
HASHES = 128
BLOCK = 96


def bands_and_rows(threshold: float, recall: float, most: int = HASHES) -> tuple[int, int]:
    """The most selective banding of at most ``most`` hashes that finds a pair at the threshold with this recall."""
    fits = []
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        if 0 < miss < 1:
            fits.append((math.ceil(math.log(1 - recall) / math.log(miss)), rows))
    fits = [(bands, rows) for bands, rows in fits if bands * rows <= most]
    if not fits:
        raise ValueError(f"no banding of {most} hashes reaches a recall of {recall} at {threshold}")
    return max(fits, key=lambda x: x[1])


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64 - 1, (2, n), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text as hashes, with their texts, in the order of the texts."""
    hashes = RunHash(t.word_hash)
    at = t.runs(n)
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < n))
    of = np.concatenate((t.text_of_word[at], short))
    values = np.concatenate((hashes(at, at + n), hashes(t.first_word[short], t.first_word[short + 1])))
    _, first = np.unique(mix(values ^ mix(of.astype(np.uint64) + np.uint64(1))), return_index=True)
    first = first[np.argsort(of[first], kind="stable")]
    return values[first], of[first]


def signatures(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """Per row with words: key, fingerprint of the text, fingerprint of the set, its size, and the band hashes."""
    factor, offset = _hash_family(bands * per_band)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            t = Texts(batch.column(1))
            values, of = shingles(t, n)
            size = np.bincount(of, minlength=len(t))
            has = np.flatnonzero(size)
            begin = np.concatenate(([0], np.cumsum(size[has])))[:-1].astype(np.int64)
            if not len(has):
                continue
            prints = np.stack(
                [np.add.reduceat(mix(values ^ np.uint64(c)), begin) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)], 1
            )
            out = np.empty((len(has), bands), np.uint64)
            for b in range(bands):
                band = np.full(len(has), b + 1, np.uint64)
                for k in range(b * per_band, (b + 1) * per_band):
                    x = values * factor[k] + offset[k]
                    x ^= x >> np.uint64(32)
                    band = mix(band ^ np.minimum.reduceat(x, begin))
                out[:, b] = band
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(out.ravel().view(np.int64))
            )
            row = pa.array(has)
            node = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(has), [None, pa.py_buffer(prints.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(2).take(row), node.cast(pa.binary()), listed],
                ["key", "text_no", "node", "bands"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(signed, f"key {kind}, text_no binary, node binary, bands array<long>")


def _linked(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a symmetric matrix without its diagonal."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    shared = count[column] > 1
    column, row = (np.cumsum(count > 1) - 1)[column[shared]], row[shared]
    both, step = np.zeros((m, m), np.float32), 8192
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        part = np.zeros((m, step), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    num, den = threshold.numerator, threshold.denominator
    out = both * (num + den) >= num * (size[:, None] + size[None, :])
    np.fill_diagonal(out, False)
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least index that each index is connected with."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] < 0:
            reached, edge = np.zeros(len(linked), bool), np.zeros(len(linked), bool)
            edge[start] = True
            while edge.any():
                reached |= edge
                edge = linked[edge].any(0) & ~reached
            root[reached] = start
    return root


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows of one cell; batches are sorted by cell."""
    held, key = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        begin = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                if i > begin:
                    if keys[begin] != key and held:
                        yield held
                        held = []
                    key = keys[begin]
                    held.append(batch.slice(begin, i - begin))
                begin = i
    if held:
        yield held


def _verify(n: int, threshold: Fraction):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            cell = pa.Table.from_batches(cell).combine_chunks()
            nodes = cell["node"].to_pylist()
            at = sorted({x: i for i, x in enumerate(nodes)}.items())  # by node, each once
            if len(at) < 2:
                continue
            cell = cell.take(pa.array([i for _, i in at]))
            values, of = shingles(Texts(cell["text"].combine_chunks()), n)
            sets = np.split(values, np.searchsorted(of, np.arange(1, len(at))))
            linked = _linked(sets, threshold)
            root = _roots(linked)
            block = cell["block"].to_numpy()
            if cell["i"][0].as_py() != cell["j"][0].as_py():  # pairs of one block are counted in its own cell
                linked &= block[:, None] != block[None, :]
            classes, rows = linked.sum(1), linked.astype(np.int64) @ cell["copies"].to_numpy()
            some = np.flatnonzero((root != np.arange(len(at))) | (classes > 0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at[k][0] for k in some], pa.binary()),
                    pa.array([at[root[k]][0] for k in some], pa.binary()),
                    pa.array(classes[some], pa.int64()),
                    pa.array(rows[some], pa.int64()),
                ],
                ["node", "root", "classes", "rows"],
            )

    return verified


def _classes(
    df: DataFrame, n: int, threshold: Fraction, recall: float, key: str, text: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows; those with words and their ``node`` (one per set of n-grams); and per node its ``copy_id``, ``copies``,
    ``linked_rows``, the ``root`` of its near-duplicate class and its ``source``.

    A source is the least row with that set, as (no_key, key, text_no), so a row with a key goes before one without.
    """
    bands, per_band = bands_and_rows(float(threshold), recall)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("text_no", fingerprint("text"))
    signed = staged(signatures(rows, n, bands, per_band), "signatures")
    classes = staged(
        signed.groupBy("node").agg(
            F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_no")).alias("source"),
            F.min("key").alias("copy_id"),
            F.count("*").alias("copies"),
            F.min("bands").alias("bands"),
        ),
        "classes",
    )
    buckets = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    hubs = buckets.groupBy("band", "bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    near = components(
        buckets.join(hubs.drop("n"), ["band", "bucket"]).select(F.col("node").alias("a"), F.col("hub").alias("b")), "candidates"
    )
    groups = near.select(F.col("a").alias("node"), F.col("b").alias("family")).unionByName(
        near.select(F.col("b").alias("node"), F.col("b").alias("family")).distinct()
    )
    sizes = groups.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = (
        groups.join(sizes, "family")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(classes.drop("bands", "copy_id"), "node")
        .select("node", "family", "blocks", "block", "copies", "source")
    )
    texts = rows.withColumnsRenamed({"key": "their_key", "text_no": "their_no"})
    cells = (
        placed.join(
            texts,
            F.col("source.key").eqNullSafe(F.col("their_key")) & (F.col("source.text_no") == F.col("their_no")),
        )
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "text")
        .repartition("family", "i", "j")
        .sortWithinPartitions("family", "i", "j")
    )
    verified = staged(
        cells.mapInArrow(_verify(n, threshold), "node binary, root binary, classes long, rows long"), "verified"
    )
    links = verified.groupBy("node").agg(F.sum("rows").alias("linked_rows"))
    forest = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
    of_class = (
        classes.join(links, "node", "left")
        .join(forest.select(F.col("a").alias("node"), "b"), "node", "left")
        .select("node", "copy_id", "copies", "linked_rows", F.coalesce("b", "node").alias("root"), "source")
    )
    return rows, signed, of_class


def _bare(text: str) -> Column:
    """Whether a text has no words."""
    return ~F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def joined(
    df: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``df``: key, ``class_id`` (least key of its near-duplicate class), ``copy_id`` (least key with the
    same n-grams) and ``n_links`` (other rows it is linked with, copies included)."""
    rows, signed, of_class = _classes(df, n, threshold, recall, key, text)
    least = of_class.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    of_class = of_class.join(least, "root").select(
        "node", "class_id", "copy_id", (F.col("copies") - 1 + F.coalesce("linked_rows", F.lit(0))).alias("n_links")
    )
    worded = signed.select("key", "node").join(of_class, "node").select("key", "class_id", "copy_id", "n_links")
    bare = rows.filter(_bare("text"))
    return worded.unionByName(
        bare.select("key", F.col("key").alias("class_id"), F.col("key").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    ).withColumnRenamed("key", key)


def keep_one(
    df: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each near-duplicate class, and the rows whose texts have no words.

    A class keeps the row with its least key, or a row without a key if none has one; of the texts with that key, the
    one with the least fingerprint. Texts without words are no duplicates; of those, equal ones with one key stay once,
    and all without a key stay.
    """
    _, _, of_class = _classes(df, n, threshold, recall, key, text)
    source = of_class.groupBy("root").agg(F.min("source").alias("source"))
    chosen = source.select(F.col("source.key").alias("kept_key"), F.col("source.text_no").alias("kept_no"))
    number = spare_name(df, "text_no")
    numbered = df.withColumn(number, fingerprint(text))
    same = F.col(f"`{key}`").eqNullSafe(F.col("kept_key")) & (F.col(number) == F.col("kept_no"))
    worded = numbered.join(chosen, same, "left_semi")
    bare = numbered.filter(_bare(text))
    once = worded.unionByName(bare.filter(F.col(f"`{key}`").isNotNull())).dropDuplicates([key, number])
    return once.unionByName(bare.filter(F.col(f"`{key}`").isNull())).drop(number)
