"""Shards from a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``cells`` places. Virtual nodes take places by the hash of shard and number; a key belongs to the next
virtual node clockwise of its own place. No shard takes more than its capacity: of the keys at home in a shard, those
in its first cells stay, and the rest continue clockwise, cell by cell, to the next shard that still has room.

Where keys go depends only on how many there are in each cell, so it is decided on one row per cell, a number that is
fixed by the ring and does not grow with the data; keys then look up their cell. With ``load`` 1 the capacities add
up to the rows exactly, so counts differ by one at most (law ``rows``); a larger load bounds every shard by that
multiple of the mean and moves fewer keys when shards are added.

Defined results: a null text has no bytes; rows of equal key share a cell and are numbered by checksum and size (by parts
of the cell, if it has more than ``part`` rows), and equal rows in any order; null keys share one cell; an empty table gives
no rows; other columns are not read. A ring with so few cells that a shard finds no place on it is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.llm.tables import staged

CELLS = 1 << 16
NODES = 64
"""Virtual nodes of a shard."""
OVERHEAD = 16
"""Bytes that a row takes besides its text."""
PART = 1 << 16
"""Rows of a cell that are numbered together."""


def ring(spark: SparkSession, shards: int, nodes: int = NODES, cells: int = CELLS) -> DataFrame:
    """Per cell: the virtual node it belongs to (numbered clockwise) and that node's shard, in one partition."""
    points = spark.range(0, shards * nodes, 1, 1).selectExpr(
        f"cast(id % {shards} as int) as shard", f"pmod(xxhash64('node', id % {shards}, id div {shards}), {cells}) as cell"
    )
    points = points.groupBy("cell").agg(F.min("shard").alias("shard"))  # a place taken twice belongs to the first
    numbered = points.selectExpr("cell", "shard", "cast(row_number() over (order by cell) - 1 as int) as node")
    return (
        spark.range(0, cells, 1, 1)
        .withColumnRenamed("id", "cell")
        .join(F.broadcast(numbered), "cell", "left")
        .selectExpr(
            "cell",
            "last_value(if(shard is null, null, struct(node, shard)), true) "
            "over (order by cell desc rows between unbounded preceding and current row) as next_node",
            "first_value(if(shard is null, null, struct(node, shard)), true) "
            "over (order by cell rows between unbounded preceding and unbounded following) as least_node",
        )
        .selectExpr("cell", "coalesce(next_node, least_node) as at")
        .selectExpr("cell", "at.node as node", "at.shard as shard")
    )


def _settled(counts: DataFrame, spark: SparkSession, shards: int, load: float, nodes: int, cells: int) -> DataFrame:
    """Per cell: node, home shard, keys before it in its shard, how many stay, and overflow before it in its node.

    Of the data this has one number a cell at most, so all is in one partition, that of the ring.
    """
    exact = load <= 1
    total = "sum(n) over ()"
    capacity = (
        f"{total} div {shards} + if(shard < {total} % {shards}, 1, 0)"
        if exact
        else f"cast(ceil({load} * {total} / {shards}) as bigint)"
    )
    before = "order by cell rows between unbounded preceding and current row"
    return (
        ring(spark, shards, nodes, cells)
        .join(F.broadcast(counts), "cell", "left")
        .selectExpr("cell", "node", "shard", "coalesce(n, 0L) as n")
        .selectExpr("*", f"{capacity} as capacity", f"sum(n) over (partition by shard {before}) - n as first_slot")
        .selectExpr("*", "greatest(0L, least(n, capacity - first_slot)) as stays")
        .selectExpr("*", f"sum(n - stays) over (partition by node {before}) - (n - stays) as over_before")
    )


#: Walks the overflow of each node clockwise. A segment says that a node's overflowing keys from ``lo`` up to ``hi``
#: go to a shard, and how many that shard has taken in before.
_WALK = """
    aggregate(
        overflow,
        struct(room as room, transform(room, r -> 0L) as taken, cast(array() as array<struct<node:int,lo:bigint,hi:bigint,shard:int,taken:bigint>>) as segments),
        (state, node) -> aggregate(
            array_distinct(concat(slice(ring, node.node + 1, size(ring)), slice(ring, 1, node.node))),
            struct(state.room as room, state.taken as taken, state.segments as segments, 0L as done),
            (s, shard) -> if(
                s.done >= node.n or s.room[shard] <= 0,
                s,
                struct(
                    transform(s.room, (r, i) -> if(i = shard, r - least(r, node.n - s.done), r)) as room,
                    transform(s.taken, (t, i) -> if(i = shard, t + least(s.room[shard], node.n - s.done), t)) as taken,
                    concat(s.segments, array(struct(
                        node.node as node, s.done as lo, s.done + least(s.room[shard], node.n - s.done) as hi,
                        shard as shard, s.taken[shard] as taken))) as segments,
                    s.done + least(s.room[shard], node.n - s.done) as done)),
            s -> struct(s.room as room, s.taken as taken, s.segments as segments)),
        state -> state.segments)
"""


def _segments(settled: DataFrame, shards: int) -> DataFrame:
    """How the overflow of each node is dealt to the shards after it, in one partition like ``settled``."""
    settled = settled.coalesce(1)
    per_shard = settled.groupBy("shard").agg((F.first("capacity") - F.sum("stays")).alias("room"), F.sum("stays").alias("own"))
    rooms = per_shard.agg(
        F.expr(
            f"if(count(*) = {shards}, transform(array_sort(collect_list(struct(shard, room))), x -> x.room), "
            "raise_error('a shard has no place on the ring: take more cells or fewer nodes'))"
        ).alias("room")
    )
    per_node = settled.groupBy("node", "shard").agg(F.sum(F.col("n") - F.col("stays")).alias("n"))
    walk = per_node.agg(
        F.expr("transform(array_sort(collect_list(struct(node, shard))), x -> x.shard)").alias("ring"),
        F.expr("array_sort(collect_list(if(n > 0, struct(node, n), null)))").alias("overflow"),
    )
    moved = walk.join(F.broadcast(rooms), F.lit(True)).select(F.expr(f"inline({_WALK})"))
    return moved.join(F.broadcast(per_shard.select("shard", "own")), "shard").selectExpr(
        "node as from_node", "lo", "hi", "shard as next_shard", "own + taken - lo as shift"
    )


def _ranked(rows: DataFrame, home: DataFrame, part: int) -> DataFrame:
    """Rows with their cell's columns of ``home`` and their ``rank`` in the cell, from 0.

    Equal rows are one row with a number before they are shuffled, and then one row for every ``part`` of them. A cell
    of more than ``part`` rows is dealt out by hash into as many parts, each of which starts where those before it end,
    so neither a key that holds most of the rows nor a group of equal rows meets in one task. Where parts start is looked
    up for such cells only, so at most two numbers are broadcast for every ``part`` rows, and the rows are shuffled by part once.
    """
    folded = rows.groupBy("cell", "key", "size", "text_crc32").agg(F.count("*").alias("equal"))
    pieces = folded.withColumn("piece", F.explode(F.expr(f"sequence(0L, (equal - 1) div {part})")))
    pieces = pieces.withColumn("equal", F.expr(f"least({part}, equal - piece * {part})"))
    dealt = pieces.join(home, "cell").withColumn(
        "part", F.expr(f"pmod(xxhash64('part', key, size, text_crc32, piece), (n - 1) div {part} + 1)")
    )
    begins = dealt.filter(f"n > {part}").groupBy("cell", "part").agg(F.sum("equal").alias("rows"))
    begins = begins.selectExpr("cell", "part", "sum(rows) over (partition by cell order by part) - rows as begin")
    order = "order by xxhash64(key), text_crc32, size, piece rows between unbounded preceding and current row"
    within = dealt.withColumn("before", F.expr(f"sum(equal) over (partition by cell, part {order}) - equal"))
    numbered = within.join(F.broadcast(begins), ["cell", "part"], "left").withColumn("first", F.expr("coalesce(begin, 0L) + before"))
    return numbered.withColumn("rank", F.expr("explode(sequence(first, first + equal - 1))"))


def sharded(
    df: DataFrame,
    shards: int,
    load: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    nodes: int = NODES,
    cells: int = CELLS,
    part: int = PART,
) -> DataFrame:
    """Per row: key, ``size``, ``text_crc32``, ``home`` (the shard of an unbounded ring), ``shard`` and its ``slot``."""
    spark = df.sparkSession
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(cells))
    counts = df.select(place.alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    # Both tables have a size that the ring fixes: one row a cell, and at most a row a node and shard. They are written, so
    # that the plan over the rows does not hold the ring once for every place that looks it up.
    settled = staged(_settled(counts, spark, shards, load, nodes, cells), "cells")
    segments = staged(_segments(settled, shards), "segments")
    content = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(f"`{key}`").alias("key"),
        place.alias("cell"),
        (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    home = F.broadcast(settled.select("cell", "node", F.col("shard").alias("home"), "n", "first_slot", "stays", "over_before"))
    placed = _ranked(rows, home, part).withColumn("over", F.expr("if(rank >= stays, over_before + rank - stays, null)"))
    moved = placed.join(F.broadcast(segments), F.expr("node = from_node and over >= lo and over < hi"), "left")
    return moved.select(
        F.col("key").alias(key), "size", "text_crc32", "home",
        F.expr("if(rank < stays, home, next_shard)").alias("shard"), F.expr("if(rank < stays, first_slot + rank, over + shift)").alias("slot"),
    )
