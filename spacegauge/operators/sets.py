"""Set operators: distinct unions, differences and existence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R


def restricted_tables(tables: DataFrame) -> DataFrame:
    """Tables with a row filter or a column mask."""
    guarded = F.coalesce("has_row_filter", F.lit(False)) | F.coalesce("has_col_mask", F.lit(False))
    return tables.where(F.col("error").isNull() & guarded).select("table_id").distinct()


def name_tokens(name) -> F.Column:
    """Words of a column name that may be business abbreviations."""
    words = F.array_distinct(F.split(F.lower(name), "_"))
    return F.filter(
        words, lambda w: w.rlike(R.ABBREVIATION_TOKEN.regex) & ~w.isin(*R.COMMON_SHORT_WORDS)
    )


def distinct_tokens(columns: DataFrame) -> DataFrame:
    """Distinct abbreviation-like words of each table's column names."""
    return columns.select("table_id", F.explode(name_tokens(F.col("name"))).alias("token")).distinct()


def missing_items(required: DataFrame, found: DataFrame) -> DataFrame:
    """Required items that a space lacks."""
    return required.select("space_id", "item").join(
        found.select("space_id", "item").distinct(), ["space_id", "item"], "left_anti"
    )


def exists_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def all_findings(*areas: DataFrame) -> DataFrame:
    """One findings table out of the areas' findings."""
    return reduce(lambda a, b: a.unionByName(b), areas)
