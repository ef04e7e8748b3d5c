"""Area 1, curation: number, spread, layer and width of tables, and the space description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators import joins as J


def budget_expr(base_count: Column) -> Column:
    return F.when(base_count <= 5, 3).when(base_count <= 9, 2).otherwise(1)


def table_budget_score(base_counts: DataFrame) -> DataFrame:
    return base_counts.select("space_id", budget_expr(F.col("base_count")).alias("score"))


def schema_spread(space_tables: DataFrame) -> DataFrame:
    """Number of schemas a space draws on."""
    return space_tables.groupBy("space_id").agg(
        F.count_distinct(X.schema_id(F.col("table_id"))).alias("n_schemas")
    )


def spaces_to_split(space_tables: DataFrame, metric_views: DataFrame) -> DataFrame:
    """Spaces with too many base tables, or tables of several schemas; one shuffle of partial sums by space."""
    members = space_tables.withColumn("full_name", F.lower("table_id")).join(
        metric_views.select("full_name", F.lit(1).alias("mv")), "full_name", "left"
    )
    by_schema = members.groupBy("space_id", X.schema_id(F.col("table_id")).alias("s")).agg(F.count_if(F.col("mv").isNull()).alias("n"))
    spaces = by_schema.groupBy("space_id").agg(F.sum("n").alias("base"), F.count("s").alias("n_schemas"))
    return spaces.where((budget_expr(F.col("base")) < 3) | (F.col("n_schemas") > 1)).select("space_id")


def schema_spread_findings(spread: DataFrame) -> DataFrame:
    return spread.where("n_schemas > 1").select("space_id", "n_schemas")


def too_many_tables(base_counts: DataFrame) -> DataFrame:
    return base_counts.where("base_count > 9").select("space_id", F.col("base_count").alias("n"))


def layer_tags(table_tags: DataFrame) -> DataFrame:
    """The value of the first tag that names a layer, per table."""
    named = table_tags.where(F.lower("tag_name").isin(*R.LAYER_TAG_KEYS))
    return named.groupBy("table_id").agg(F.min_by(F.lower("tag_value"), "ordinal").alias("layer_tag"))


def layer_expr(table_id: Column, table_type: Column, tag: Column) -> Column:
    """``exempt`` (views), ``non_gold``, ``tagged`` (any accepted layer) or ``unclear``."""
    return (
        F.when(F.upper(X.text_of(table_type)).isin("VIEW", "METRIC_VIEW"), "exempt")
        .when(tag.isin(*R.NON_GOLD_TAG_VALUES), "non_gold")
        .when(tag.isNotNull(), "tagged")
        .when(R.NON_GOLD_NAME.hit(F.lower(table_id)), "non_gold")
        .otherwise("unclear")
    )


def layer_evidence(tag: Column) -> Column:
    return F.when(tag.isNotNull(), F.concat(F.lit("tagged: "), tag)).otherwise("name")


def table_layer(space_tables: DataFrame, tables: DataFrame, table_tags: DataFrame) -> DataFrame:
    """Layer of every table that is not a view: a layer tag decides, the name only where there is none."""
    members = J.with_metadata(space_tables, tables).join(layer_tags(table_tags), "table_id", "left")
    tag = F.col("layer_tag")
    return (
        members.withColumn("layer", layer_expr(F.col("table_id"), F.col("table_type"), tag))
        .where("layer <> 'exempt'")
        .select("space_id", "table_id", "layer", layer_evidence(tag).alias("evidence"))
    )


def wide_tables(table_widths: DataFrame, limit: int = R.WIDE_TABLE_COLUMNS) -> DataFrame:
    return table_widths.where(F.col("n_cols") > limit).select("table_id", "n_cols")


def missing_elements() -> Column:
    """Labels of the description elements that the verdict row denies."""
    return X.kept(
        *[
            F.when(~F.coalesce(F.col(key), F.lit(True)), F.lit(label))
            for key, label in R.DESCRIPTION_ELEMENTS.items()
        ]
    )


def description_kind(description: Column, missing: Column) -> Column:
    size = F.length(X.strip(description))
    return (
        F.when(size == 0, "empty")
        .when(size < R.SHORT_DESCRIPTION_CHARS, "short")
        .when(F.size(missing) >= 2, "incomplete")
    )


def description_findings(spaces: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Descriptions that are empty, short, or lack two of four elements; without a verdict nothing is lacking."""
    judged = spaces.select("space_id", "description").join(verdicts, "space_id", "left")
    rows = judged.select("space_id", "description", missing_elements().alias("missing"))
    return (
        rows.withColumn("kind", description_kind(F.col("description"), F.col("missing")))
        .where("kind is not null")
        .select(
            "space_id",
            "kind",
            F.when(F.col("kind") == "incomplete", F.col("missing")).otherwise(F.expr(X.NO_ARRAY)).alias("missing"),
        )
    )
