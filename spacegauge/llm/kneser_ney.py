"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, scored by memory map.

Counting. Tasks count the bigrams of their texts and send, for each range of context hashes, sorted arrays of
(context, word, count), so a frequent bigram costs one entry per task. One task per range merges them, writes the
bigrams' hashes, sorted, beside their counts, and passes on what each word needs: its count, the number of its
contexts, and as a context its total and how many words follow it once, twice and more often. These are merged by
ranges of word hashes. Ranges (``shards``) grow with the data by the session's shuffle partitions; a range holds each
context's distinct followers once, whatever its frequency.

Scoring. Workers map the arrays into memory and look up the distinct words and bigrams of a slice of texts in sorted
order, so they touch few pages and hold none. The model lies in the shared folder, which must be mounted on all
executors (a ``file:`` path). Files are written under another name and then renamed: a task that runs again after an
executor is lost, or twice at once, writes the same file.

    p(w | u) = (c(uw) - D(c(uw)) + (D1 N1(u) + D2 N2(u) + D3 N3+(u)) p(w)) / c(u.)
    p(w)     = (N(.w) - d(N(.w)) + (d1 n1 + d2 n2 + d3 n3+) / (V + 1)) / N(..)

A text starts after a start mark and ends with an end token; after an unseen context p(w) holds; an unseen word has
p(w) with N(.w) = 0, and the V words and "unseen" sum to one.

Defined results: null and empty texts are the end token alone; equal rows count again; rows whose ``train`` is null
are held out; without training rows both scores are those of an empty model (every word unseen); other columns are not
read. Lower case is that of A to Z.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.tables import new_folder
from spacegauge.llm.words import Texts, mix, per_text, sliced

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FLUSH_TOKENS = 4_000_000
SLICE = 4 << 20
_MANY = 255


def _local(folder: str) -> str:
    """The path of a folder that all machines have mounted."""
    scheme, _, path = folder.partition(":") if folder.startswith(("file:", "/")) or "://" in folder else ("", "", folder)
    if folder.startswith("/"):
        return folder
    if scheme != "file":
        raise ValueError(f"the model is mapped into memory, so {folder} must be a mounted (file:) folder")
    return "/" + path.lstrip("/")


def _save(folder: str, name: str, values: np.ndarray) -> None:
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, values)
    os.replace(part, f"{folder}/{name}.npy")


def _range(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _bigram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token of every place, and each text's place among them."""
    first = t.first_word
    return np.insert(t.word_hash, first[:-1], START), np.insert(t.word_hash, first[1:], END), first + np.arange(len(first))


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` (the first leads) and where equal ones begin."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin) if len(begin) else values[:0]


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _cut(shard: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(shard, np.arange(shards + 1))


_COUNTS = "shard int, contexts binary, followers binary, words binary, counts binary"
_WORDS = "shard int, words binary, counts binary, conts binary, contexts binary, totals binary, follows binary"


def _counted(rows: DataFrame, shards: int) -> DataFrame:
    def flush(context: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, begin = _grouped([context, word])
        count = np.diff(np.append(begin, len(order))).astype(np.uint32)
        context, word = context[order[begin]], word[order[begin]]
        cut = _cut(_range(context, shards), shards)
        for shard in np.flatnonzero(np.diff(cut)):
            a, b = cut[shard], cut[shard + 1]
            own, at = np.unique(context[a:b], return_index=True)
            follow = np.diff(np.append(at, b - a)).astype(np.uint32)
            blobs = _bytes(own, follow, word[a:b], count[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)],
                ["shard", "contexts", "followers", "words", "counts"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in sliced(batches, "text", SLICE):
            context, word, _ = tokens(Texts(batch.column(0), lower=True))
            held.append((context, word))
            n += len(word)
            if n >= FLUSH_TOKENS:
                yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.filter("train").select("text").mapInArrow(count, _COUNTS)


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table[column].to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _merge_bigrams(folder: str, shards: int):
    def merge(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        follow = _joined(table, "followers", np.uint32)
        context = np.repeat(_joined(table, "contexts", np.uint64), follow)
        word, count = _joined(table, "words", np.uint64), _joined(table, "counts", np.uint32)
        order, begin = _grouped([context, word])
        count = _sums(count[order].astype(np.int64), begin)
        context, word = context[order[begin]], word[order[begin]]
        keys = _bigram(context, word)
        by_key = np.argsort(keys)
        sorted_count = count[by_key]
        many = np.flatnonzero(sorted_count >= _MANY)
        _save(folder, f"bigrams-{shard}", keys[by_key])
        _save(folder, f"counts-{shard}", np.minimum(sorted_count, _MANY).astype(np.uint8))
        _save(folder, f"many-{shard}", np.stack([many, sorted_count[many]]))
        _save(folder, f"of-counts-{shard}", np.array([np.sum(count == k) for k in (1, 2, 3, 4)]))
        at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        follows = np.stack([_sums(x.astype(np.int64), at) for x in (count == 1, count == 2, count > 2)], 1).astype(np.uint32)
        own, totals = context[at], _sums(count, at)
        order, begin = _grouped([word])
        word, total, conts = word[order[begin]], _sums(count[order], begin), np.diff(np.append(begin, len(order)))
        word_cut, own_cut = _cut(_range(word, shards), shards), _cut(_range(own, shards), shards)
        out = []
        for k in range(shards):
            a, b = slice(word_cut[k], word_cut[k + 1]), slice(own_cut[k], own_cut[k + 1])
            out.append([k, *_bytes(word[a], total[a], conts[a].astype(np.uint32), own[b], totals[b], follows[b])])
        names = [f.split()[0] for f in _WORDS.split(", ")]
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names
        )

    return merge


def _merge_words(folder: str):
    def merge(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        word, context = _joined(table, "words", np.uint64), _joined(table, "contexts", np.uint64)
        order, begin = _grouped([np.concatenate((word, context))])
        column = lambda own, other: _sums(np.concatenate((own, other))[order], begin)
        no_word, no_context = np.zeros(len(word), np.int64), np.zeros(len(context), np.int64)
        counts = column(_joined(table, "counts", np.int64), no_context)
        conts = column(_joined(table, "conts", np.uint32).astype(np.int64), no_context)
        totals = column(no_word, _joined(table, "totals", np.int64))
        follows = _joined(table, "follows", np.uint32).reshape(-1, 3).astype(np.int64)
        _save(folder, f"words-{shard}", np.concatenate((word, context))[order[begin]])
        _save(folder, f"word-counts-{shard}", counts)
        _save(folder, f"conts-{shard}", conts.astype(np.uint32))
        _save(folder, f"totals-{shard}", totals)
        _save(folder, f"follows-{shard}", np.stack([column(no_word, follows[:, k]) for k in range(3)], 1).astype(np.uint32))
        found = [int(np.sum(conts == k)) for k in (1, 2, 3, 4)] + [int(np.sum(conts > 2))]
        found += [int(counts.sum()), int(np.sum(counts > 0)), int(conts.sum())]
        return pa.table({"found": pa.array([found], pa.list_(pa.int64()))})

    return merge


def discounts(of_counts: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of entries counted once to four times; where those are missing, 0.75."""
    n1, n2, n3, n4 = of_counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = [k - (k + 1) * y * b / a if a and b else 0.75 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [0.0] + [min(max(d, 0.0), k) for k, d in enumerate(out, 1)]


def train(rows: DataFrame, shards: int) -> dict:
    """Count the rows marked ``train``, write the arrays, and return the model: its folder and a few numbers."""
    folder = _local(new_folder(rows.sparkSession, "kneser-ney"))
    os.makedirs(folder)
    words = _counted(rows, shards).groupBy("shard").applyInArrow(_merge_bigrams(folder, shards), _WORDS)
    merged = words.groupBy("shard").applyInArrow(_merge_words(folder), "found array<long>").collect()
    found = np.sum([r["found"] for r in merged], 0).tolist() if merged else [0] * 8
    files = [f"{folder}/of-counts-{k}.npy" for k in range(shards)]
    of_counts = np.sum([np.load(f) for f in files if os.path.exists(f)] or [[0] * 4], 0).tolist()
    return {
        "folder": folder,
        "shards": shards,
        "discounts": discounts(of_counts),
        "lower": discounts(found[:4]),
        "n1": found[0],
        "n2": found[1],
        "n3": found[4],
        "tokens": found[5],
        "types": found[6],
        "bigrams": found[7],
    }


@lru_cache(8)
def _mapped(folder: str, shards: int) -> dict[str, list[np.ndarray | None]]:
    """The arrays of a model, mapped, by name and shard."""
    names = ("bigrams", "counts", "many", "words", "word-counts", "conts", "totals", "follows")
    path = lambda name, k: f"{folder}/{name}-{k}.npy"
    return {
        name: [np.load(path(name, k), mmap_mode="r") if os.path.exists(path(name, k)) else None for k in range(shards)]
        for name in names
    }


def _look_up(keys: np.ndarray, arrays: list[np.ndarray | None], shard: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard the places of the keys found there, and their places in its array; keys ascend in a shard."""
    order = np.argsort(shard, kind="stable")
    cut = _cut(shard[order], len(arrays))
    for k in np.flatnonzero(np.diff(cut)):
        if arrays[k] is None or not len(arrays[k]):
            continue
        own = order[cut[k] : cut[k + 1]]
        at = np.minimum(np.searchsorted(arrays[k], keys[own]), len(arrays[k]) - 1)
        hit = arrays[k][at] == keys[own]
        yield k, own[hit], at[hit]


class Model:
    """A trained model on a worker."""

    def __init__(self, model: dict):
        self.m, self.arrays = model, _mapped(model["folder"], model["shards"])

    def _words(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count, continuation count, context total and back-off mass of distinct hashes."""
        n, shards, d = len(hashes), self.m["shards"], self.m["discounts"]
        count, cont, total, mass = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for k, own, at in _look_up(hashes, self.arrays["words"], _range(hashes, shards)):
            count[own] = self.arrays["word-counts"][k][at]
            cont[own] = self.arrays["conts"][k][at]
            total[own] = self.arrays["totals"][k][at]
            mass[own] = self.arrays["follows"][k][at] @ np.array(d[1:])
        return count, cont, total, mass

    def __call__(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training count of each token, and its log10 probability by the base and by the model."""
        m = self.m
        distinct, at = np.unique(np.concatenate((context, word)), return_inverse=True)
        count, cont, total, mass = self._words(distinct)
        lower = np.array(m["lower"])
        spread = m["lower"][1] * m["n1"] + m["lower"][2] * m["n2"] + m["lower"][3] * m["n3"]
        if m["bigrams"]:
            low = (np.maximum(cont - lower[np.minimum(cont, 3)], 0) + spread / (m["types"] + 1)) / m["bigrams"]
        else:
            low = np.ones(len(distinct))
        base = np.log10((count + 0.1) / (m["tokens"] + 0.1 * (m["types"] + 1)))
        of_context, of_word = at[: len(context)], at[len(context) :]
        pairs, first, back = np.unique(_bigram(context, word), return_index=True, return_inverse=True)
        seen = np.zeros(len(pairs), np.int64)
        for k, own, place in _look_up(pairs, self.arrays["bigrams"], _range(context[first], m["shards"])):
            c = self.arrays["counts"][k][place].astype(np.int64)
            many = c == _MANY
            if many.any():
                places, counts = self.arrays["many"][k]
                c[many] = counts[np.searchsorted(places, place[many])]
            seen[own] = c
        u, w = of_context[first], of_word[first]
        high = np.maximum(seen - np.array(m["discounts"])[np.minimum(seen, 3)], 0) + mass[u] * low[w]
        p = np.where(total[u] > 0, high / np.maximum(total[u], 1), low[w])
        return count[of_word], base[of_word], np.log10(np.maximum(p, 1e-300))[back]


def scored(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text", train: str = "train") -> DataFrame:
    """Per row: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    rows = df.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").cast("string").alias("text"),
        (~F.coalesce(F.col(f"`{train}`"), F.lit(False))).alias("held_out"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(model)
        for batch in sliced(batches, "text", SLICE):
            context, word, bounds = tokens(Texts(batch.column(1), lower=True))
            count, base, high = of(context, word)
            n = pa.array(np.diff(bounds), pa.int64())
            known = pa.array(per_text(count > 0, bounds), pa.int64())
            sums = [pa.array(np.add.reduceat(x, bounds[:-1])) for x in (base, high)]
            total = pa.array(np.full(len(n), model["tokens"]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), n, known, total, *sums],
                ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        score,
        f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).withColumnRenamed("key", key)


def perplexities(df: DataFrame, key: str = "doc_id", text: str = "text", held_out: str = "held_out") -> DataFrame:
    """Learn from the rows not marked ``held_out`` (null: marked) and score all."""
    marked = df.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").cast("string").alias("text"),
        (~F.coalesce(F.col(f"`{held_out}`"), F.lit(True))).alias("train"),
    )
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scored(marked, train(marked, shards), key="key").withColumnRenamed("key", key)
