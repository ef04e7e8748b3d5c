"""Alignment of two tokenizers on the same bytes, by pointer jumping.

Tokens of both lie on one line of bytes. Every token points to the token that overlaps it and reaches farthest right,
itself if none reaches farther (of two that end together, to that of the first tokenizer). Replacing each pointer by its
pointer's pointer, for all tokens of many texts at once, halves what is left of every way in each round, until all tokens
of a group point to its last token of the first tokenizer, where both tokenizers end. The rounds are the logarithm of
the longest group.

Where tokens of both end together they are linked. A slice of texts, as many as hold ``LINKS`` links, knows its own pairs
of ids; a text's links are places among them. Pairs are counted slice by slice and summed by Spark; the sums come
back to each slice that has the pair, so what is shuffled for counts has a row per slice and pair, not per link, and no
key has more rows than there are slices.

The byte-level tokenizer's ids are given by the rank-based library from the same vocabulary file, which must have its
merges in the order of their ids; the tests hold them against the file's own library.

Defined results: texts that are null or empty, or whose tokens of either side don't spell a blank and the text, have no
tokens, and the empty text in place of the digest; rows with equal ids or texts are each counted and returned; null ids
are ids; an empty table gives no rows; other columns are not read. Texts are whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.tables import staged
from spacegauge.llm.token_files import gather
from spacegauge.llm.words import Texts, sliced

BLANK = "▁"
LINKS = 1 << 20
SLICE = 1 << 20
"""Bytes of texts tokenized at once."""


def _table(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of bytes as values and bounds."""
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else one from U+0100 on."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Ids by a byte-level vocabulary; strings of its special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, split = made["model"], made["pre_tokenizer"]
        vocabulary, special = model["vocab"], {t["content"] for t in made["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [vocabulary[a + b] for a, b in merges]
        if made["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or order != sorted(order):
            raise ValueError("the vocabulary must be byte-level, with merges in the order of their ids")
        letters = byte_letters()
        raw = {i: bytes(letters[c] for c in piece) for piece, i in vocabulary.items() if piece not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={})
        self.raw = _table([raw.get(i, b"") for i in range(max(raw) + 1)])

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) if t else [] for t in texts]


class Pieces:
    """Ids by a SentencePiece vocabulary that puts a blank before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.raw = _table([self._bytes(i) for i in range(self.model.vocab_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(2)
def encoders(byte_path: str, piece_path: str, pattern: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(byte_path, pattern), Pieces(piece_path)


class Side:
    """One tokenizer's tokens of many texts in a row."""

    def __init__(self, lists: list[list[int]], raw: tuple[np.ndarray, np.ndarray]):
        self.raw = raw
        self.count = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.fromiter(chain.from_iterable(lists), np.int64, int(self.count.sum()))

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.raw[1])[self.ids]

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and each text's bounds among them."""
        data, ends = gather(*self.raw, self.ids)
        return data, ends[np.concatenate(([0], np.cumsum(self.count)))]

    def without(self, texts: np.ndarray) -> None:
        """Forget the tokens of these texts (a mask)."""
        self.ids = self.ids[~np.repeat(texts, self.count)]
        self.count = np.where(texts, 0, self.count)


def jumped(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of these sizes on the same bytes, the last A token of the group of each A and of each B token."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    n = len(a_size)
    over_a = np.searchsorted(b_start, a_end) - 1  # the last B token that starts before A's end
    over_b = np.searchsorted(a_start, b_end) - 1
    farther = b_end[over_a] > a_end if n else np.zeros(0, bool)
    to = np.concatenate((np.where(farther, n + over_a, np.arange(n)), over_b)) if n else np.zeros(0, np.int64)
    while True:
        after = to[to]
        if np.array_equal(after, to):
            return to[:n], to[n:]
        to = after


@lru_cache(4)
def _written(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id in digits, followed by each of the marks."""
    return _table([f"{i}{mark}".encode() for i in range(size) for mark in ",|;"])


def _digests(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """Per text the SHA-256 of its groups, as ``a1,a2|b1;a3|b2,b3``; the empty text without tokens."""
    n_a, n_b = len(a.ids), len(b.ids)
    groups = int(group_a[-1]) + 1 if n_a else 0
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    place = np.empty(n_a + n_b, np.int64)
    at_a = np.arange(n_a) + (np.cumsum(in_b) - in_b)[group_a]
    at_b = np.arange(n_b) + np.cumsum(in_a)[group_b]
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
    place[at_a] = a.ids * 3 + last_a
    place[at_b] = b.ids * 3 + 2 * last_b
    data, ends = gather(*_written(max(len(a.raw[1]), len(b.raw[1]))), place)
    data, at = data.tobytes(), ends[np.concatenate(([0], np.cumsum(a.count + b.count)))].tolist()
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]


def align(texts: pa.Array, left: ByteLevel, right: Pieces) -> tuple[Side, Side, np.ndarray, np.ndarray]:
    """The tokens of the texts by both, and the group of each token among all."""
    texts = texts.cast(pa.string()).fill_null("")
    strings = texts.to_pylist()
    a, b = Side(left(strings), left.raw), Side(right(strings), right.raw)
    own = Texts(texts)
    size = np.diff(own.offsets)
    asked = np.insert(own.data, own.offsets[:-1][size > 0], 32)
    bounds = np.concatenate(([0], np.cumsum(size + (size > 0))))
    wrong = np.zeros(len(texts), bool)
    for side in (a, b):
        data, at = side.spelled()
        if not (np.array_equal(at, bounds) and np.array_equal(data, asked)):
            wrong |= [data[at[i] : at[i + 1]].tobytes() != asked[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))]
    if wrong.any():
        a.without(wrong)
        b.without(wrong)
    last_a, last_b = jumped(a.size, b.size)
    ends = np.flatnonzero(last_a == np.arange(len(last_a)))
    return a, b, np.searchsorted(ends, last_a), np.searchsorted(ends, last_b)


def _lasts(group: np.ndarray) -> np.ndarray:
    """The last place of each group, in order."""
    return np.flatnonzero(np.append(group[1:] != group[:-1], True)[: len(group)])


def _linked(rows: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """Rows of kind 1: a text's counts, digest and links, as places among the pairs of its slice. Rows of kind 0: a pair of the
    slice, its place and its number."""
    kind = rows.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("slice", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("times", pa.int64()), ("key", to_arrow_type(kind))]
    fields += [("n_a", pa.int64()), ("n_b", pa.int64()), ("digest", pa.string()), ("links", pa.list_(pa.int32())), ("kind", pa.int32())]
    schema = pa.schema(fields)

    def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(byte_path, piece_path, pattern)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        links = 0

        def done() -> Iterator[pa.RecordBatch]:
            pairs, place, times = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True, return_counts=True)
            n = len(pairs)
            if n:
                yield batch_of(
                    n, slice=pa.array(np.full(n, number)), place=pa.array(np.arange(n, dtype=np.int32)), pair=pa.array(pairs),
                    times=pa.array(times.astype(np.int64)), kind=pa.array(np.zeros(n, np.int32)),
                )
            begin = 0
            for keys, n_a, n_b, digests, own, n_links in held:
                n = len(keys)
                part = place[begin : begin + len(own)].astype(np.int32)
                begin += len(own)
                bounds = np.concatenate(([0], np.cumsum(n_links))).astype(np.int32)
                yield batch_of(
                    n, slice=pa.array(np.full(n, number)), place=pa.array(np.full(n, -1, np.int32)), key=keys, n_a=pa.array(n_a),
                    n_b=pa.array(n_b), digest=pa.array(digests, pa.string()), kind=pa.array(np.ones(n, np.int32)),
                    links=pa.ListArray.from_arrays(pa.array(bounds), pa.array(part)),
                )

        for batch in sliced(batches, "text", SLICE):
            a, b, group_a, group_b = align(batch.column(1), *both)
            ends = _lasts(group_a)
            pairs = (b.ids[_lasts(group_b)] << 32) | a.ids[ends]
            text_of = np.repeat(np.arange(len(batch)), a.count)[ends]
            held.append((batch.column(0), a.count, b.count, _digests(a, b, group_a, group_b), pairs, np.bincount(text_of, minlength=len(batch))))
            links += len(pairs)
            if links >= LINKS:
                yield from done()
                held.clear()
                number, links = number + 1, 0
        if held:
            yield from done()

    name = kind.simpleString()
    return rows.mapInArrow(
        link, f"slice long, place int, pair long, times long, key {name}, n_a long, n_b long, digest string, links array<int>, kind int"
    )


def aligned(df: DataFrame, byte_path: str, piece_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, tokens by both (``n_a, n_b``), ``n_groups``, ``n_links``, ``n_best`` (links whose pair has its B id's highest
    count over all texts), ``count_sum`` (over links, of their pair's count) and ``groups_sha256``."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    made = staged(_linked(rows, byte_path, piece_path, pattern), "alignment")
    texts, pairs = made.where("kind = 1"), made.where("kind = 0").select("slice", "place", "pair", "times")
    totals = pairs.groupBy("pair").agg(F.sum("times").alias("total")).withColumn("b", F.shiftright("pair", 32))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    totals = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = pairs.drop("times").join(totals, "pair").select("slice", "place", "total", "best")
    met = answers.unionByName(texts.select("slice", "place", "key", "n_a", "n_b", "digest", "links"), allowMissingColumns=True)
    met = met.repartition("slice").sortWithinPartitions("slice", F.col("place") < 0, "place")
    # The pairs of a slice come before its texts.

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, []
        for batch in batches:
            slices, is_text = batch.column("slice").to_numpy(), batch.column("place").to_numpy() < 0
            cuts = np.flatnonzero((slices[1:] != slices[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part = batch.slice(begin, end - begin)
                if not len(part):
                    continue
                if slices[begin] != now:
                    now, known = slices[begin], []
                if not is_text[begin]:
                    known.append((part.column("total").to_numpy(), part.column("best").to_numpy(zero_copy_only=False)))
                    continue
                if len(known) > 1:
                    known = [tuple(np.concatenate(x) for x in zip(*known, strict=True))]
                total, best = known[0] if known else (np.zeros(0, np.int64), np.zeros(0, bool))
                lists = part.column("links")
                at = lists.flatten().to_numpy()
                bounds = lists.offsets.to_numpy()
                bounds = bounds - bounds[0]
                sums, bests = (np.concatenate(([0], np.cumsum(x[at], dtype=np.int64)))[bounds] for x in (total, best))
                n = pa.array(np.diff(bounds).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("n_a"), part.column("n_b"), n, n, pa.array(np.diff(bests)), pa.array(np.diff(sums)), part.column("digest")],
                    ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    name = rows.schema["key"].dataType.simpleString()
    counted = met.mapInArrow(
        count, f"key {name}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return counted.withColumnRenamed("key", key)
