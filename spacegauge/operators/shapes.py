"""The analytic query shapes users ask for, on any fact table.

Sums of doubles are taken as decimals so that results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.operators.joins import in_range, join_dim, join_ranged
from spacegauge.operators.lists import lag_value, top_by

Period = tuple[str, str]


def money(metric: str | Column) -> Column:
    col = F.col(metric) if isinstance(metric, str) else metric
    return col.cast("decimal(18,2)")


def total_by_dimension(df: DataFrame, dim: str, metric: str, date: str, start: str, end: str) -> DataFrame:
    """Sum by dimension over a half-open range, largest first."""
    return (
        df.where(in_range(date, start, end))
        .groupBy(dim)
        .agg(F.sum(money(metric)).alias("total_metric"))
        .orderBy(F.desc("total_metric"), dim)
    )


def join_total(
    fact: DataFrame, dim: DataFrame, keys, label: str, metric: str, date: str, start: str, end: str
) -> DataFrame:
    """Sum by a label of a joined dimension, largest first."""
    return (
        join_dim(fact.where(in_range(date, start, end)), dim, keys)
        .groupBy(label)
        .agg(F.sum(money(metric)).alias("total_metric"))
        .orderBy(F.desc("total_metric"), label)
    )


def monthly_trend(df: DataFrame, date: str, metric: str, start: str, end: str) -> DataFrame:
    return (
        df.where(in_range(date, start, end))
        .groupBy(F.date_trunc("month", date).cast("date").alias("month"))
        .agg(F.sum(money(metric)).alias("total_metric"))
        .orderBy("month")
    )


def top_n(df: DataFrame, dim: str, metric: str, n: int, date: str, start: str, end: str) -> DataFrame:
    rows = df.where(in_range(date, start, end)).select(dim, money(metric).alias(metric))
    return top_by(rows, dim, metric, n).withColumnRenamed("total", "total_metric")


def conditional_sums(df: DataFrame, dim: str, ts: str, metric: str, cur: Period, prev: Period) -> DataFrame:
    """Sums of two periods by dimension in one pass, with the relative change."""
    value = money(metric)
    current = F.sum(F.when(in_range(ts, *cur), value).otherwise(0))
    previous = F.sum(F.when(in_range(ts, *prev), value).otherwise(0))
    return (
        df.groupBy(dim)
        .agg(current.alias("current"), previous.alias("previous"))
        .withColumn(
            "pct_change",
            F.try_divide((F.col("current") - F.col("previous")).cast("double"), F.col("previous").cast("double")),
        )
    )


def period_over_period(df: DataFrame, dim: str, metric: str, date: str, cur: Period, prev: Period) -> DataFrame:
    """Current against previous period by dimension, largest current first; dimensions without either stay."""
    return conditional_sums(df, dim, date, metric, cur, prev).orderBy(F.desc("current"), dim)


def parameterised(spark: SparkSession, sql: str, args: Mapping[str, object], **views: DataFrame) -> DataFrame:
    """Run a parameterised query (``:name``) over the DataFrames passed by name (``{name}``)."""
    return spark.sql(sql, args=dict(args), **views)


def daily_count_sum(df: DataFrame, ts: str, condition: Column, metric: str, start: str, end: str) -> DataFrame:
    return (
        df.where(in_range(ts, start, end) & condition)
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("n"), F.sum(money(metric)).alias("total_metric"))
        .orderBy("day")
    )


def period_change(df: DataFrame, ts: str, condition: Column, cur: Period, prev: Period) -> DataFrame:
    """Counts of two periods, the difference, and the percentage (null when the previous count is 0)."""
    spans = condition & (in_range(ts, *cur) | in_range(ts, *prev))
    counted = df.where(spans).agg(
        F.count_if(in_range(ts, *cur)).alias("current"), F.count_if(in_range(ts, *prev)).alias("previous")
    )
    change = F.col("current") - F.col("previous")
    percent = F.when(F.col("previous") != 0, F.round(change * 100.0 / F.col("previous"), 2))
    return counted.select("current", "previous", change.alias("absolute_change"), percent.alias("percent_change"))


def related_events(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    range_a: tuple[str, str, str],
    range_b: tuple[str, str, str],
    where_a: Column | None = None,
    where_b: Column | None = None,
) -> DataFrame:
    """Events of two kinds on the same keys, each kind filtered and limited to its own time range."""
    a = a if where_a is None else a.where(where_a)
    b = b if where_b is None else b.where(where_b)
    return join_ranged(a, b, keys, range_a, range_b)


def group_stats(df: DataFrame, dims: Sequence[str], metric: str) -> DataFrame:
    """Count, average and sum by dimensions; the average is the sum over the count."""
    rows = df.select(*dims, money(metric).alias("v"))
    stats = rows.groupBy(*dims).agg(
        F.count("*").alias("n"), F.count("v").alias("k"), F.sum("v").alias("sum")
    )
    return stats.select(*dims, "n", F.try_divide(F.col("sum").cast("double"), F.col("k")).alias("avg"), "sum")


def profile_stats(
    fact: DataFrame, dim: DataFrame, key, dims: Sequence[str], metric: str, condition: Column | None = None
) -> DataFrame:
    """Statistics of a fact by attributes of its dimension, largest sum first."""
    rows = join_dim(fact, dim, key)
    if condition is not None:
        rows = rows.where(condition)
    return group_stats(rows, dims, metric).orderBy(F.desc("sum"), *dims)


def mart_read(mart: DataFrame, alias: str) -> DataFrame:
    """Volume and ratio of one metric of a metrics mart; the metric must be named."""
    return (
        mart.where(F.col("metric_alias") == alias)
        .agg(F.sum("value_num").alias("num"), F.sum("value_denom").alias("volume"))
        .select("volume", F.try_divide(F.col("num").cast("double"), F.col("volume").cast("double")).alias("ratio"))
    )


def metric_value(mart: DataFrame, alias: str, kind: str) -> DataFrame:
    """One metric of a mart: ``volume`` is the sum of denominators, ``ratio`` the sums divided."""
    if kind not in ("volume", "ratio"):
        raise ValueError(f"kind must be 'volume' or 'ratio', not {kind!r}")
    return mart_read(mart, alias).select(F.col(kind).cast("double").alias("value"))


def condition_rate(df: DataFrame, condition: Column, dims: Sequence[str]) -> DataFrame:
    """Share of rows that meet a condition, by dimensions."""
    return (
        df.select(*dims, condition.alias("hit"))
        .groupBy(*dims)
        .agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
        .withColumn("rate", F.col("hits") / F.col("n"))
    )


def rate(df: DataFrame, condition: Column, group: str) -> DataFrame:
    return condition_rate(df, condition, [group])


def filtered_rolling_count(df: DataFrame, ts: str, condition: Column, days: int, as_of: str) -> DataFrame:
    """Rows of the trailing ``days`` up to ``as_of`` that meet a condition."""
    end = F.lit(as_of).cast("date")
    recent = (F.col(ts) >= F.date_sub(end, days).cast("timestamp_ntz")) & (F.col(ts) < end.cast("timestamp_ntz"))
    return df.where(recent & condition).agg(F.count("*").alias("n"))


def same_day_both(a: DataFrame, b: DataFrame, key: str, ts: str) -> DataFrame:
    """Keys and days on which both kinds of event occurred."""
    days = [key, F.to_date(ts).alias("day")]
    return a.select(*days).distinct().join(b.select(*days).distinct(), [key, "day"], "left_semi")


def period_lag(df: DataFrame, dim: str, date: str, metric: str) -> DataFrame:
    """Monthly sum of each series beside the sum of its previous month on record."""
    monthly = df.groupBy(dim, F.date_trunc("month", date).cast("date").alias("period")).agg(
        F.sum(money(metric)).alias("total")
    )
    return lag_value(monthly, [dim], "period", "total")
