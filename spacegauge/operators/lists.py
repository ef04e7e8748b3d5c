"""Ranked lists, numbering and the other window-shaped operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


NUMBERED = 1 << 16  # rows of one key that are numbered in one part
MOST_PARTS = 1 << 12
SAMPLED = 16  # rows per part from which a key's parts are cut
_STEP = 64


def _same(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"__their_{c}")) for c in columns])


def _theirs(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"__their_{c}") for c in columns]


def in_parts(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int = NUMBERED) -> DataFrame:
    """Distinct rows with their number as ``__n``, their ``__place`` in the order and the ``__part`` of their key they are in.

    Keys of up to ``size`` rows are one part. Of a larger key, a sample is drawn by hash, a row as likely as it is
    frequent, and quantiles of the sample's whole order, texts included, are where parts begin. So parts are about even
    however uneven values are; rows equal in the order are told apart by a hash of the row, and equal rows are one row.
    """
    mine = [f"__their_{c}" for c in partition]
    folded = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    folded = folded.withColumn("__place", F.struct(*order, F.xxhash64(*df.columns).alias("__hash")))
    sizes = folded.groupBy(*_theirs(partition)).agg(F.sum("__n").alias("__total")).where(F.col("__total") > size)
    sizes = sizes.withColumn("__parts", F.least(F.ceil(F.col("__total") / size), F.lit(MOST_PARTS)))
    # A sampled row stands for as many rows as it has, or as one in so many that are drawn.
    worth = F.col("__total") / (F.col("__parts") * SAMPLED)
    chance = F.pmod(F.xxhash64(F.lit("sample"), "__place.__hash"), F.lit(1 << 30)) / (1 << 30)
    drawn = folded.join(sizes, _same(partition)).where(chance < F.col("__n") / worth)
    drawn = drawn.select(*mine, "__place", "__parts", F.greatest(F.col("__n"), worth).alias("__worth"))
    upto = Window.partitionBy(*mine).orderBy("__place")
    share = F.sum("__worth").over(Window.partitionBy(*mine)) / F.col("__parts")
    cut = drawn.withColumn("__share", F.floor((F.sum("__worth").over(upto) - F.col("__worth")) / share))
    begins = cut.groupBy(*mine, "__share").agg(F.min("__place").alias("__place"))
    begins = begins.groupBy(*mine).agg(F.sort_array(F.collect_list("__place")).alias("__begins"))
    begins = begins.withColumn("__steps", F.expr(f"transform(sequence(0, size(__begins) - 1, {_STEP}), i -> __begins[i])"))
    rows = folded.join(begins, _same(partition), "left")
    step = f"greatest(size(filter(__steps, s -> s <= __place)) - 1, 0) * {_STEP}"
    part = f"{step} + size(filter(slice(__begins, {step} + 1, {_STEP}), s -> s <= __place))"
    return rows.select(*df.columns, "__n", "__place", F.expr(f"if(__begins is null, 0, {part})").alias("__part"))


def number_rows(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int = NUMBERED) -> DataFrame:
    """Number the rows of each partition from 1 in the given order, as ``seq``.

    Keys of up to ``size`` rows are numbered as they are. Rows of larger ones are numbered within the parts of
    :func:`in_parts`, and each part starts where those before it end, so a key that holds most of the rows is spread over
    many tasks.
    """
    mine = [f"__their_{c}" for c in partition]
    large = df.groupBy(*_theirs(partition)).agg(F.count("*").alias("__total")).where(F.col("__total") > size).select(*mine)
    whole = Window.partitionBy(*partition).orderBy(*order, F.xxhash64(*df.columns))
    small = df.join(large, _same(partition), "left_anti").withColumn("seq", F.row_number().over(whole).cast("long"))
    return small.unionByName(_number_parts(df.join(large, _same(partition), "left_semi"), partition, order, size))


def _number_parts(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    mine = [f"__their_{c}" for c in partition]
    rows = in_parts(df, partition, order, size)
    sizes = rows.groupBy(*_theirs(partition), F.col("__part").alias("__their_part")).agg(F.sum("__n").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(*mine).orderBy("__their_part")) - F.col("__rows")
    starts = sizes.select(*mine, "__their_part", before.alias("__before"))
    # Dealt out by part too; the window alone would be content with partitions by key.
    upto = F.sum("__n").over(Window.partitionBy(*partition, "__part").orderBy("__place"))
    numbered = rows.repartition(*partition, "__part").withColumn("__upto", upto - F.col("__n"))
    numbered = numbered.join(starts, _same(partition) & (F.col("__part") == F.col("__their_part")))
    first = F.col("__before") + F.col("__upto")
    return numbered.select(*df.columns, F.explode(F.sequence(first + 1, first + F.col("__n"))).alias("seq"))


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows of each partition.

    The filter sits right on ``row_number`` so Spark keeps at most ``k`` rows per key and task
    before the shuffle; a key holding most of the data never lands whole in one task.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def shown_items(items: DataFrame, k: int | None = None, order: Sequence[str] = ("ord", "sub", "item")) -> DataFrame:
    """``items(space_id, rule_id, ord, sub, item)`` -> first ``k`` names, or all, per space and rule as an array."""
    top = items if k is None else ranked(items, ["space_id", "rule_id"], order, k)
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col("item").alias("name"))))
    return top.groupBy("space_id", "rule_id").agg(F.transform(pairs, lambda p: p["name"]).alias("shown"))


def first_k(items: DataFrame, k: int, order: Sequence[str] = ("ord", "sub", "item")) -> DataFrame:
    """First ``k`` names per space and rule, with the number of names left out.

    Names are cut to ``k`` before they are shuffled, and counted apart, so no key is ranked whole.
    """
    keys = ["space_id", "rule_id"]
    sizes = items.groupBy(*keys).agg(F.count("*").alias("n"))
    return shown_items(items, k, order).join(sizes, keys).select(
        *keys, "shown", F.greatest(F.col("n") - k, F.lit(0)).alias("n_more")
    )


def lag_value(df: DataFrame, dims: Sequence[str], period: str, metric: str) -> DataFrame:
    """Value of the previous period within each series."""
    window = Window.partitionBy(*dims).orderBy(period)
    return df.select(
        *dims, period, F.col(metric).alias("value"), F.lag(metric).over(window).alias("previous")
    )


def top_by(df: DataFrame, dim: str, metric: str, n: int) -> DataFrame:
    """Largest ``n`` sums of ``metric`` by ``dim``; ties in order of ``dim``."""
    return (
        df.groupBy(dim)
        .agg(F.sum(metric).alias("total"))
        .orderBy(F.desc("total"), F.asc(dim))
        .limit(n)
    )


def ordered(df: DataFrame, keys: Sequence) -> DataFrame:
    return df.orderBy(*keys)
