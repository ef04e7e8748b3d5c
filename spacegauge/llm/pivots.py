"""Near duplicates among vectors, by an index of pivot permutations.

A vector is described by its ``NEAREST`` nearest reference points, in order of nearness. The points are random
directions drawn from a fixed seed, alike in every task, so how many points two vectors share depends on their angle
alone and not on the data: a number of points that grows with the root of the rows is halved until pairs at exactly the
threshold share ``SHARED`` of their points with a chance of ``RECALL`` or more, measured on simulated pairs. With no more
points than ``NEAREST`` all pairs are candidates, so short vectors too have that recall.

Vectors that share ``SHARED`` points share one of their ``NEAREST - SHARED + 1`` lowest-numbered ones, so inverted lists,
by label, length and point, hold only those. A list is cut into blocks, every two of which meet in a cell. In a cell,
shared points are counted for all pairs at once, and a pair belongs to the list of the lowest point it shares. The
first pass has no vectors, only points, and leaves the vectors with candidates; the second brings their components and
verifies. A cell yields a count of links per vector and a forest of those it connects, never pairs.

Equal vectors of a label are one node with a count; so copies need no pairs, however many they are.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label,
link with nothing and are components of their own; vectors of unequal length don't link; rows with one id are each
returned; a component of rows without ids has a null id, and a null id is kept if it is its component's; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.components import components
from spacegauge.llm.tables import staged

THRESHOLD = 0.98
NEAREST = 8
SHARED = 4
RECALL = 0.98
LEAST_POINTS = 256
MOST_VALUES = 1 << 23
"""Components of all reference points of one length at most."""
BLOCK = 4096
"""Vectors of a list in one block."""
STEP = 512


def wanted_points(rows: int) -> int:
    """Reference points for so many vectors: a power of two near twice the root."""
    return max(LEAST_POINTS, 1 << int(2 * max(rows, 1) ** 0.5).bit_length() - 1)


def nearest(units: np.ndarray, points: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """The numbers of the ``k`` nearest points of each vector, nearest first."""
    near = -(units @ points.T)
    some = np.argpartition(near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
    order = np.lexsort((some, np.take_along_axis(near, some, 1)), axis=1)
    return np.take_along_axis(some, order, 1)


def _directions(seed: int, n: int, length: int) -> np.ndarray:
    drawn = np.random.Generator(np.random.PCG64(seed)).standard_normal((n, length))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def simulated_recall(points: np.ndarray, threshold: float, shared: int = SHARED, pairs: int = 1000) -> float:
    """The share of pairs at exactly the threshold whose nearest points have that many in common."""
    length = points.shape[1]
    if length == 1:
        return 1.0
    a, z = _directions(1, pairs, length), _directions(2, pairs, length)
    z -= (z * a).sum(1, keepdims=True) * a
    b = threshold * a + (1 - threshold**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    both = nearest(a, points)[:, :, None] == nearest(b, points)[:, None, :]
    return float((both.sum((1, 2)) >= shared).mean())


@lru_cache(16)
def reference_points(length: int, wanted: int, threshold: float) -> np.ndarray:
    """The points for vectors of a length: as many as wanted, or half, a quarter, ... of that, as recall allows."""
    n = max(NEAREST, min(wanted, MOST_VALUES // length))
    points = _directions(0, n, length)
    while n > NEAREST and simulated_recall(points[:n], threshold) < RECALL:
        n = max(NEAREST, n // 2)
    return points[:n]


def _nodes(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """The rows: ``key``, and for those that can link their ``node``, a hash of label and vector, and both of these."""
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").alias("label")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    fit = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(i), "label", "vector")), 16, "0") for i in (1, 2)]
    return rows.withColumn("node", F.when(fit, F.unhex(F.concat(*halves))))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Of length one, whatever the size of their components."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _described(nodes: DataFrame, wanted: int, threshold: float) -> DataFrame:
    """Per node its label, its length and its nearest ``points``, in order of nearness."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values, begins = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
            for length in np.unique(sizes).tolist():
                points = reference_points(length, wanted, threshold)
                at = np.flatnonzero(sizes == length)
                for some in np.array_split(at, max(1, len(at) * len(points) >> 22)):
                    found = nearest(unit(values[begins[some][:, None] + np.arange(length)]), points)
                    taken = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(taken),
                            batch.column(2).take(taken),
                            pa.array(np.full(len(some), length, np.int32)),
                            pa.ListArray.from_arrays(
                                pa.array(np.arange(len(some) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel().astype(np.int32))
                            ),
                        ],
                        ["node", "label", "length", "points"],
                    )

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "vector", "label").mapInArrow(describe, f"node binary, label {kind}, length int, points array<int>")


def _owned(points: np.ndarray, this: int, rows: slice, shared: int) -> np.ndarray:
    """Which of the vectors at ``rows`` share enough points with which of all, none of them lower than ``this``."""
    found, column, times = np.unique(points, return_inverse=True, return_counts=True)
    column = column.reshape(points.shape)
    both = np.zeros((len(range(*rows.indices(len(points)))), len(points)), np.float32)
    lower = np.zeros(both.shape, bool)
    common = np.flatnonzero(times > 1)
    for some in np.array_split(common, max(1, -(-len(common) // 2048))):
        place = np.full(len(found), -1)
        place[some] = np.arange(len(some))
        at = place[column]
        has = np.zeros((len(points), len(some)), np.float32)
        row, nth = np.nonzero(at >= 0)
        has[row, at[row, nth]] = 1
        both += has[rows] @ has.T
        below = int(np.searchsorted(found[some], this))
        if below:
            lower |= (has[rows, :below] @ has[:, :below].T) > 0
    return (both >= shared) & ~lower


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each cell; batches are sorted by cell."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        cells = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for end in range(1, len(cells) + 1):
            if end == len(cells) or cells[end] != cells[begin]:
                if held and cells[begin] != now:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = cells[begin]
                held.append(batch.slice(begin, end - begin))
                begin = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_CELL = ["label", "length", "point", "i", "j"]


def _of_cell(cell: pa.Table, shared: int) -> Iterator[tuple[slice, np.ndarray]]:
    """For some rows of the cell after others: which rows they share enough points with."""
    points = cell["points"].combine_chunks()
    points = points.flatten().to_numpy().reshape(len(cell), -1)
    block, apart = cell["block"].to_numpy(), cell["i"][0].as_py() != cell["j"][0].as_py()
    for begin in range(0, len(cell), STEP):
        rows = slice(begin, begin + STEP)
        found = _owned(points, cell["point"][0].as_py(), rows, shared)
        place = np.arange(len(cell))
        found &= block[rows, None] != block[None, :] if apart else place[rows, None] != place[None, :]
        yield rows, found


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
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


def _marked(cells: DataFrame, shared: int) -> DataFrame:
    """The rows of cells that have candidates there."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, _CELL):
            if len(cell) > 1:
                some = np.concatenate([found.any(1) for _, found in _of_cell(cell, shared)])
                yield from cell.filter(pa.array(some)).to_batches()

    return cells.mapInArrow(mark, cells.schema)


def _verified(cells: DataFrame, threshold: float, shared: int) -> DataFrame:
    """Per node and cell: the ``root`` that it is connected with there, and the ``links`` it has there, copies included."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, _CELL):
            units = unit(cell["vector"].combine_chunks().flatten().to_numpy().reshape(len(cell), -1))
            copies = cell["copies"].to_numpy().astype(np.float64)
            linked, links = np.zeros((len(cell), len(cell)), bool), np.zeros(len(cell))
            for rows, found in _of_cell(cell, shared):
                linked[rows] = found & (units[rows] @ units.T >= threshold)
                links[rows] = linked[rows] @ copies
            some = np.flatnonzero(links)
            if len(some):
                nodes, root = cell["node"].combine_chunks(), _roots(linked)
                taken = [nodes.take(pa.array(some)), nodes.take(pa.array(root[some])), pa.array(links[some].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(taken, ["node", "root", "links"])

    return cells.mapInArrow(verify, "node binary, root binary, links long")


def linked(
    df: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row of ``df``: key, ``n_links`` (other vectors of its label with that cosine or more), ``component_id`` (the least
    key that links lead to) and ``kept`` (whether that is its own)."""
    rows = _nodes(df, key, vector, label)
    grouped = rows.where("node is not null").groupBy("node", "label")
    nodes = staged(grouped.agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("key").alias("least")), "vectors")
    described = staged(_described(nodes, wanted_points(nodes.count()), threshold), "points")
    lowest = F.slice(F.array_sort("points"), 1, NEAREST - SHARED + 1)
    lists = described.withColumn("point", F.explode(lowest))
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    sizes = lists.groupBy("label", "length", "point").agg(blocks, F.count("*").alias("n")).where("n > 1").drop("n")
    cells = (
        lists.join(sizes, ["label", "length", "point"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("label", "length", "point", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "points")
    )
    marked = staged(_marked(cells.repartition(*_CELL).sortWithinPartitions(*_CELL), SHARED), "candidates")
    brought = marked.join(nodes.select("node", "vector", "copies"), "node").repartition(*_CELL).sortWithinPartitions(*_CELL)
    verified = staged(_verified(brought, threshold, SHARED), "links")
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    forest = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "components")
    placed = nodes.select("node", "copies", "least").join(forest.select(F.col("a").alias("node"), "b"), "node", "left")
    placed = placed.select("node", "copies", "least", F.coalesce("b", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    found = placed.join(least, "root").join(counts, "node", "left")
    found = found.select("node", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.lit(True).alias("met"))
    whole = rows.select("key", "node").join(found, "node", "left")
    component = F.when(F.col("met"), F.col("component")).otherwise(F.col("key"))
    return whole.select(
        F.col("key").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )
