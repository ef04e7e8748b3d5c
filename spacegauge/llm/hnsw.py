"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, and merged shard results.

Distinct vectors are dealt to shards by length and hash, about ``SHARD_ROWS`` to one; a query is searched in the shards of
its own length. A task builds one shard's graph and stores it
as one row of flat arrays: the vectors, the level of each node, and per level a fixed-width array of neighbour numbers
filled up with -1. Queries travel to the shards in blocks; a task searches one block in one shard; the nearest of all
shards are kept per query. Equal vectors are one node, and share its distance; of their ids only the ``k`` + 1 least can
be among the ``k`` nearest, so these stand for all, and a vector that a third of the rows share is one node like any.

The walk orders nodes by their squared distance less the query's norm, on vectors divided by the shard's largest component
and less the shard's mean, so that neither large components nor a cluster far from zero cost it precision. The distances
returned are computed again from the original components, in double precision, and rank the results.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part; vectors of
different lengths are no neighbours; a distance too large for a double is infinite; fewer than ``k`` candidates are all returned; ties go to the smaller id; rows of
equal id are one candidate per distinct vector; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacegauge.llm.tables import staged

SHARD_ROWS = 4096
NEIGHBOURS = 16
BUILD_BREADTH = 64
SEARCH_BREADTH = 128
BLOCK = 256
"""Queries that one task searches a shard for."""


class Graph:
    """The graph of one shard in flat arrays; nodes are numbered in the order of insertion."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.links, self.entry = vectors, levels, links, entry
        self.norms = np.einsum("ij,ij->i", vectors, vectors)

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = NEIGHBOURS, breadth: int = BUILD_BREADTH, seed: int = 1) -> Graph:
        n = len(vectors)
        draw = np.random.Generator(np.random.PCG64(seed)).random(n)
        levels = np.minimum((-np.log(1 - draw) / np.log(m)).astype(np.int8), 8)
        width = lambda level: 2 * m if level == 0 else m
        links = [np.full((n, width(k)), -1, np.int32) for k in range(int(levels.max()) + 1 if n else 1)]
        graph = cls(vectors, levels, links, 0)
        graph.used = [np.zeros(n, np.int32) for _ in links]
        for node in range(1, n):
            graph._insert(node, m, breadth)
            if levels[node] > levels[graph.entry]:
                graph.entry = node
        return graph

    def _distances(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return self.norms[nodes] - 2 * (self.vectors[nodes] @ query)

    def _chosen(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one that is closer to a chosen one than to the node is left for last."""
        nodes = np.array([i for _, i in near])
        if len(nodes) <= most:
            return nodes.tolist()
        own = self.vectors[nodes]
        between = self.norms[nodes][:, None] + self.norms[nodes][None, :] - 2 * own @ own.T
        to_node = np.array([d for d, _ in near]) + self._own_norm
        blocked, chosen = np.zeros(len(nodes), bool), []
        for i in range(len(nodes)):
            if not blocked[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                blocked |= between[i] < to_node
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in range(len(nodes)) if i not in taken][: most - len(chosen)]
        return nodes[chosen].tolist()

    def _insert(self, node: int, m: int, breadth: int) -> None:
        query, level = self.vectors[node], int(self.levels[node])
        top = int(self.levels[self.entry])
        near = [(float(self._distances(query, np.array([self.entry]))[0]), self.entry)]
        for k in range(top, level, -1):
            near = self._search(query, near, 1, k)
        for k in range(min(top, level), -1, -1):
            near = self._search(query, near, breadth, k)
            self._own_norm = float(self.norms[node])
            chosen = self._chosen(near, m)
            links, used = self.links[k], self.used[k]
            links[node, : len(chosen)] = chosen
            used[node] = len(chosen)
            for other in chosen:
                if used[other] < links.shape[1]:
                    links[other, used[other]] = node
                    used[other] += 1
                else:
                    around = np.append(links[other], node)
                    d = self._distances(self.vectors[other], around)
                    order = np.argsort(d, kind="stable")
                    self._own_norm = float(self.norms[other])
                    kept = self._chosen([(float(d[i]), int(around[i])) for i in order], links.shape[1])
                    links[other] = kept

    def _search(self, query: np.ndarray, start: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest nodes that a best-first walk on a level finds, nearest first, less the query's norm."""
        seen = np.zeros(len(self.levels), bool)
        seen[[i for _, i in start]] = True
        queue = list(start)
        heapq.heapify(queue)
        found = [(-d, i) for d, i in start]
        heapq.heapify(found)
        links = self.links[level]
        while queue:
            d, node = heapq.heappop(queue)
            if len(found) >= breadth and d > -found[0][0]:
                break
            around = links[node]
            around = around[around >= 0]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            distances = self._distances(query, around)
            if len(found) >= breadth:
                close = distances < -found[0][0]
                around, distances = around[close], distances[close]
            for d, i in zip(distances.tolist(), around.tolist(), strict=True):
                if len(found) < breadth:
                    heapq.heappush(found, (-d, i))
                elif d < -found[0][0]:
                    heapq.heapreplace(found, (-d, i))
                else:
                    continue
                heapq.heappush(queue, (d, i))
        return sorted((-d, i) for d, i in found)

    def nearest(self, query: np.ndarray, k: int, breadth: int = SEARCH_BREADTH) -> list[int]:
        """Up to ``k`` nodes near the query."""
        near = [(float(self._distances(query, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            near = self._search(query, near, 1, level)
        return [i for _, i in self._search(query, near, max(breadth, k), 0)[:k]]


def _taking_part(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(v.isNotNull() & F.col(f"`{key}`").isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def index(vectors: DataFrame, shards: DataFrame, m: int, breadth: int) -> DataFrame:
    """One row per shard: its length and number, its nodes' ids, vectors and levels, the neighbours by level, and the entry.

    ``vectors`` has distinct vectors ``v`` with an id each; ``shards`` the number of shards for each ``length``.
    """

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        frame = Frame.of(x)
        graph = Graph.build(frame(x), m, breadth)
        return pa.table(
            {
                "length": pa.array([x.shape[1]], pa.int32()),
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "vectors": pa.array([x.tobytes()], pa.binary()),
                "levels": pa.array([graph.levels.tobytes()], pa.binary()),
                "links": pa.array([[a.tobytes() for a in graph.links]], pa.list_(pa.binary())),
                "entry": pa.array([graph.entry], pa.int32()),
            }
        )

    dealt = vectors.join(shards, F.size("v") == F.col("length")).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    total = shards.agg(F.sum("shards")).first()[0] or 1
    return dealt.select("vec_id", "v", "length", "shard").repartition(int(total), "length", "shard").groupBy("length", "shard").applyInArrow(
        build, "length int, shard int, ids binary, vectors binary, levels binary, links array<binary>, entry int"
    )


class Frame:
    """Where a shard's vectors lie: what they are divided by, and their mean after that."""

    def __init__(self, scale: float, mean: np.ndarray):
        self.scale, self.mean = scale, mean

    @classmethod
    def of(cls, vectors: np.ndarray) -> Frame:
        scale = float(np.abs(vectors).max())
        return cls(scale, (vectors / scale).mean(0))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(vectors / self.scale, -1e100, 1e100) - self.mean


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, Frame, Graph]:
    ids, levels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["levels"], np.int8)
    links = [np.frombuffer(a, np.int32).reshape(len(ids), -1) for a in row["links"]]
    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    frame = Frame.of(x)
    return ids, x, frame, Graph(frame(x), levels, links, row["entry"])


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, of the gaps divided by their largest component."""
    with np.errstate(over="ignore", under="ignore"):
        gap = vectors - query
        squares = np.einsum("ij,ij->i", gap, gap)
        far = (squares > 1e300) | (squares < 1e-280)
        out = np.sqrt(squares)
        if far.any():
            most = np.abs(gap[far]).max(1)
            part = gap[far] / np.where((most > 0) & np.isfinite(most), most, 1)[:, None]
            out[far] = np.where(most > 0, most * np.sqrt(np.einsum("ij,ij->i", part, part)), 0)
    return out


def search(graphs: DataFrame, shards: DataFrame, queries: DataFrame, k: int, breadth: int) -> DataFrame:
    """For each query (``query``, ``v``) the ``k`` nearest nodes of all shards of its length: ``query, node, distance``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        for batch in batches:
            for row in range(batch.num_rows):
                if (place := (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())) != opened:
                    opened = place
                    names = ("ids", "vectors", "levels", "links", "entry")
                    ids, vectors, frame, graph = _open({n: batch.column(i)[row].as_py() for i, n in enumerate(names, 2)})
                asked = batch.column(7)[row].as_py()
                x = np.array(batch.column(8)[row].as_py(), np.float64)
                out: list[tuple] = []
                for q, v in zip(asked, x, strict=True):
                    nodes = np.array(graph.nearest(frame(v), k, breadth), np.int64)
                    out += [(q, n, d) for n, d in zip(ids[nodes].tolist(), distances(vectors[nodes], v).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["query", "node", "distance"])

    block = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-queries.count() // BLOCK))))
    blocks = queries.groupBy(F.size("v").alias("to_length"), block.alias("block"))
    blocks = blocks.agg(F.collect_list("query").alias("queries"), F.collect_list("v").alias("vs"))
    visits = blocks.join(shards, F.col("to_length") == F.col("length")).select(
        "to_length", F.explode(F.expr("sequence(0, cast(shards as int) - 1)")).alias("to"), "queries", "vs"
    )
    work = graphs.join(visits, (F.col("length") == F.col("to_length")) & (F.col("shard") == F.col("to"))).drop("to_length", "to")
    found = work.mapInArrow(walk, "query long, node long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "node"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def neighbours(
    df: DataFrame, asks: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, m: int = NEIGHBOURS, build: int = BUILD_BREADTH, breadth: int = SEARCH_BREADTH,
) -> DataFrame:
    """For each row whose id (``vec_id``) satisfies ``asks``: ``query_id``, ``rank``, ``vec_id`` and ``score``, the
    Euclidean distance, of the ``k`` nearest other rows."""
    rows = staged(_taking_part(df, key, vector), "vectors")
    nodes = staged(rows.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "nodes")
    shards = staged(nodes.groupBy(F.size("v").alias("length")).agg(F.ceil(F.count("*") / shard_rows).alias("shards")), "shards")
    # Of equal vectors the k + 1 least ids: k, and one that may be the query. Spark limits groups before the shuffle.
    spread = Window.partitionBy("v", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    least = rows.distinct().withColumn("r", F.row_number().over(spread)).filter(F.col("r") <= k + 1)
    least = least.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    copies = least.join(nodes.filter("copies > 1").select("v", F.col("vec_id").alias("node")), "v").select("node", F.col("vec_id").alias("copy"))
    graphs = staged(index(nodes.select("vec_id", "v"), shards, m, build), "graphs")
    queries = rows.filter(asks).select("v", F.col("vec_id").alias("query_id")).distinct()
    asked = nodes.join(queries.select("v").distinct(), "v", "left_semi").select(F.col("vec_id").alias("query"), "v")
    found = search(graphs, shards, asked, k + 1, breadth)
    found = found.join(copies, "node", "left").withColumn("vec_id", F.coalesce("copy", "node"))
    of_node = queries.join(nodes.select("v", F.col("vec_id").alias("query")), "v").select("query", "query_id")
    found = found.join(of_node, "query").filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", F.col("distance").alias("score"))
    )
