"""SentencePiece ids by streaming Viterbi, and back to text.

A text is segmented into the vocabulary's pieces with the greatest sum of scores; of equal sums the one whose last
piece is longer, at every boundary, as in the library's own Viterbi. A character that no piece covers costs more than
any piece and becomes its UTF-8 bytes' pieces. The best way to each of the last ``longest piece`` boundaries is all
that can still be extended; when the ways back from all of them meet in one boundary, everything before it is final,
is committed, and is forgotten, so a text without blanks needs no more memory than its undecided end.

A boundary between two characters that stand together in no piece is such a meeting point for every text: before a
run of blanks, and around characters the vocabulary lacks, such as line ends. Texts are cut there, and each distinct
part of a slice is encoded once; a worker remembers a bounded number of them.

A vocabulary made by merges has its merge order as scores. Its best-scoring segmentation is then not always the one
that merging gives; it has the same pieces and decodes to the same text.

Defined results: a null text counts as empty; an empty text has no ids; equal rows have equal ids; other columns
are not read. Texts are taken as they are, so the vocabulary must have the identity normaliser.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.token_files import gather
from spacegauge.llm.words import Texts, sliced

BLANK = "▁"
KNOWN = 1 << 19
UNKNOWN_PENALTY = 10.0
SLICE = 2 << 20
CHECK_EVERY = 32
"""Characters between two looks for a common boundary."""


class Vocabulary:
    """Pieces, their scores, and the bytes they stand for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize("a  b\nc D ") != f"{BLANK}a{BLANK}{BLANK}b\nc D{BLANK}":
            raise ValueError("the vocabulary must take texts as they are, with a blank before them")
        n = model.vocab_size()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in ordinary}
        self.longest = max(map(len, self.pieces))
        if any(BLANK in piece.lstrip(BLANK) or "\n" in piece[1:] for piece in self.pieces):
            raise ValueError("no piece of the vocabulary may have a blank or line end after other characters")
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        raw = [b""] * n
        for i in ordinary:
            raw[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def stream(text: Iterable[str], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Encode characters as they come, and yield ids as soon as they are final.

    ``held`` are the characters since the last committed boundary, ``best`` and ``back`` the sum and the length of the
    last piece of the best way to each boundary after it.
    """
    pieces, longest, unknown = vocabulary.pieces, vocabulary.longest, vocabulary.unknown
    held, best, back = "", [0.0], [0]

    def committed(upto: int) -> list[int]:
        cuts, at = [], upto
        while at > 0:
            cuts.append(at)
            at -= back[at]
        ids, start = [], 0
        for end in reversed(cuts):
            piece = pieces.get(held[start:end])
            ids += [piece[0]] if piece else [vocabulary.byte_ids[b] for b in held[start:end].encode()]
            start = end
        return ids

    for char in text:
        held += char
        end = len(held)
        top, length = None, 1
        for start in range(max(0, end - longest), end):
            piece = pieces.get(held[start:])
            if piece is not None:
                total = best[start] + piece[1]
                if top is None or total > top:
                    top, length = total, end - start
        if top is None or (length > 1 and char not in pieces and best[-1] + unknown > top):
            top, length = best[-1] + unknown, 1
        best.append(top)
        back.append(length)
        if end % CHECK_EVERY == 0:
            ways = set(range(max(1, end - longest + 1), end + 1)) if end >= longest else {0}
            while len(ways) > 1:
                last = max(ways)
                ways.remove(last)
                ways.add(last - back[last])
            meet = ways.pop()
            if meet > 0:
                yield committed(meet)
                held, best, back = held[meet:], [b - best[meet] for b in best[meet:]], back[meet:]
                back[0] = 0
    if held:
        yield committed(len(held))


class PieceEncoder:
    """Ids of whole texts. Parts that recur are encoded once."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.bounds = array("i"), array("q", [0])

    def _numbers(self, parts: list[str]) -> np.ndarray:
        known = self.known
        numbers = list(map(known.get, parts))
        for i, number in enumerate(numbers):
            if number is None:
                for ids in stream(parts[i].replace(" ", BLANK), self.vocabulary):
                    self.values.extend(ids)
                numbers[i] = known[parts[i]] = len(self.bounds) - 1
                self.bounds.append(len(self.values))
        return np.array(numbers, np.int64)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        if len(self.known) > KNOWN:
            self._forget()
        size = np.diff(texts.offsets)
        data = np.insert(texts.data, texts.offsets[:-1][size > 0], 32)  # a blank before every text
        offsets = np.concatenate(([0], np.cumsum(size + (size > 0))))
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        blank, line = data == 32, data == 10
        begins = blank | line
        begins[1:] &= ~(blank[1:] & blank[:-1])  # a run of blanks begins once
        begins[1:] |= line[:-1]
        begins[offsets[:-1][size > 0]] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data))
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
        parts = parts.dictionary_encode()
        numbers = self._numbers(parts.dictionary.to_pylist())
        # Views, so nothing is copied; they are gone before either grows again.
        ids, ends = gather(np.frombuffer(self.values, np.int32), np.frombuffer(self.bounds, np.int64), numbers[parts.indices.to_numpy()])
        return ids, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in a row, and the bounds of each text's; the blank before a text goes."""
        raw, ends = gather(self.vocabulary.raw, self.vocabulary.raw_bounds, ids)
        at = ends[bounds]
        first = at[:-1][np.diff(at) > 0]
        keep = np.ones(len(raw), bool)
        keep[first[raw[first] == 32]] = False
        return raw[keep], np.concatenate(([0], np.cumsum(keep)))[at]


@lru_cache(4)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_ids``, ``ids``, and whether decoding the ids gives the text again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in sliced(batches, "text", SLICE):
            texts = Texts(batch.column(1))
            ids, bounds = encoder(texts)
            raw, at = encoder.decode(ids, bounds)
            same = np.diff(at) == np.diff(texts.offsets)
            if not (same.all() and np.array_equal(raw, texts.data)):
                same = [raw[at[i] : at[i + 1]].tobytes() == texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array(np.asarray(same, bool)),
                ],
                ["key", "n_ids", "ids", "round_trip"],
            )

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(encode, f"key {kind}, n_ids long, ids array<int>, round_trip boolean").withColumnRenamed("key", key)


def decoded(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and ``text``, the text of its ids; null ids give null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            raw, at = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy() - lists.offsets[0].as_py())
            text = [
                raw[a:b].tobytes().decode() if valid else None
                for a, b, valid in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(1).is_valid().to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["key", "text"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(decode, f"key {kind}, text string").withColumnRenamed("key", key)
