"""Token ids in Parquet: list columns in key order, with chosen encodings, row groups and page indexes.

Texts are range-partitioned and sorted by key, encoded, and written as ``doc_id, n_tokens, in_file, ids``:

* ``ids`` is a list column with dictionary encoding (a vocabulary of up to 64 Ki ids fits its dictionary page);
* the integer columns are delta-encoded, for which the format's second version is chosen;
* row groups and pages are small enough that a reader which knows a key range reads a few pages: files are sorted by
  key, so the page indexes, which the writer always adds, skip the others, and metadata columns can be read alone;
* ``in_file`` counts the ids before a text in its file, so a text's place among all ids needs only file totals.

Encoding goes through the library for each distinct word of a slice and not for each word: no token crosses white
space, so the ids of a text are those of its words. A word of letters with trailing ASCII punctuation is two units, as
the tokenizer splits there anyhow; all other words go to the library whole.

Defined results: null and empty texts have the end id only; rows of equal key are each written, in the order of their
text's MD5 (a null text first), spread over files where they are many; null keys come first; an empty table gives no rows; other columns are not read. Texts are whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.llm.tables import fingerprint
from spacegauge.llm.words import sliced

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
SLICE = 4 << 20
KNOWN = 1 << 19
"""Distinct words a worker remembers at most; then it starts anew."""

_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def gather(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``at`` of a list column, as values and bounds."""
    size = np.diff(bounds)[at]
    ends = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(ends[-1]) + np.repeat(bounds[at] - ends[:-1], size)
    return values[place], ends


def _ends(texts: pa.Array, begin: np.ndarray) -> pa.Array:
    """The texts from a byte on that begins a character."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    parts, bounds = gather(data, np.stack((at[:-1] + begin, at[1:]), 1).ravel(), np.arange(0, 2 * len(texts), 2))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(parts))


class WordEncoder:
    """Ids of whole texts, from a tokenizer that drops white space, marks word ends and lowers letters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.bounds = array("I"), array("q", [0])

    def _library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str], step: int = 1000) -> list[list[int]]:
        """Words of letters only: encoded many at a time, as each ends with a word-end piece."""
        out = []
        parts = [words[i : i + step] for i in range(0, len(words), step)]
        for part, ids in zip(parts, self._library([" ".join(p) for p in parts]), strict=True):
            cuts = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(cuts) != len(part):
                out += self._library(part)
            else:
                out += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _units(self, units: pa.Array) -> np.ndarray:
        """The numbers of distinct units, after encoding those not yet known."""
        words = units.to_pylist()
        known = self.known
        numbers = list(map(known.get, words))
        new = [i for i, n in enumerate(numbers) if n is None]
        if new:
            unknown = units.take(pa.array(new))
            letters = pc.and_not(pc.utf8_is_alpha(unknown), pc.match_substring(unknown, "\u0130")).to_pylist()
            for wanted, encode in ((True, self._letters), (False, self._library)):
                part = [i for i, plain in zip(new, letters, strict=True) if plain == wanted]
                for i, ids in zip(part, encode([words[i] for i in part]) if part else [], strict=True):
                    numbers[i] = known[words[i]] = len(self.bounds) - 1
                    self.values.extend(ids)
                    self.bounds.append(len(self.values))
        return np.array(numbers, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        if len(self.known) > KNOWN:
            self._forget()
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        lower = pc.ascii_lower(words.dictionary)
        stem = pc.ascii_rtrim(lower, characters=_PUNCTUATION)
        # The one letter whose lower case isn't letters only must not be cut from what follows; nor anything else.
        plain = pc.and_not(pc.utf8_is_alpha(stem), pc.match_substring(stem, "\u0130"))
        stem = pc.if_else(plain, stem, lower)
        rest = _ends(lower, pc.binary_length(stem).to_numpy())
        units = [x.dictionary_encode() for x in (stem, rest)]
        numbers = [self._units(u.dictionary)[u.indices.to_numpy()] for u in units]
        values, bounds = np.array(self.values), np.array(self.bounds)  # copies, so that both may grow again
        own, own_bounds = gather(values, bounds, np.stack(numbers, 1).ravel())
        ids, ends = gather(own, own_bounds[::2], at)
        return ids, ends[split.offsets.to_numpy()]


@lru_cache(4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after the ids of each text."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def encoded(df: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, in_file, ids`` in ascending order of key, over partitions that follow each other."""
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # A key that holds many rows is dealt out by text; equal rows go by where they were read.
    by = ("doc_id", "print", "place")
    rows = rows.withColumns({"print": fingerprint("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("print", "place")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = word_encoder(path), 0
        for batch in sliced(batches, "text", SLICE):
            ids, bounds = with_end(*encoder(batch.column(1)), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(before + bounds[:-1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))),
                ],
                ["doc_id", "n_tokens", "in_file", "ids"],
            )
            before += int(bounds[-1])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, in_file long, ids array<int>")


def write(tokens: DataFrame, folder: str, row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES) -> None:
    """Write what :func:`encoded` made; each partition is one file."""
    writer = (
        tokens.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", 0)
    )
    for column in ("doc_id", "n_tokens", "in_file"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(folder)


def read(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None, ids: bool = True) -> DataFrame:
    """Texts with a key from ``low`` to ``high``; without ``ids``, the ids' pages are not read."""
    files = spark.read.parquet(folder)
    if low is not None:
        files = files.filter(F.col("doc_id") >= low)
    if high is not None:
        files = files.filter(F.col("doc_id") <= high)
    return files if ids else files.drop("ids")


def placed(spark: SparkSession, folder: str) -> DataFrame:
    """Per text, read from the files: ``doc_id, start, n_tokens, ids_crc32``.

    The ids before a file come from the totals of the files before it: one row a file.
    """
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file")
    files = read(spark, folder).select("doc_id", "n_tokens", "in_file", "ids", number)
    totals = read(spark, folder, ids=False).select(number, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.selectExpr(
        "file as its_file", "sum(n) over (order by file rows between unbounded preceding and current row) - n as before"
    )

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, bounds = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(sums, pa.int64())],
                ["doc_id", "n_tokens", "in_file", "file", "ids_crc32"],
            )

    kind = files.schema["doc_id"].dataType.simpleString()
    sums = files.mapInArrow(crc, f"doc_id {kind}, n_tokens long, in_file long, file long, ids_crc32 long")
    return sums.join(before, F.col("file") == F.col("its_file")).select(
        "doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
