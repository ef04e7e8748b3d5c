"""Area 0, readiness: joins, keys, ownership, sharing and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import text as X
from spacegauge.operators import joins as J
from spacegauge.operators.findings import finding
from spacegauge.operators.lists import first_k, shown_items
from spacegauge.sources import readers


def structure_expr() -> Column:
    tables, joins, keyed = F.col("table_count"), F.col("join_count"), F.col("keyed")
    return (
        F.when(tables <= 1, F.when(keyed >= 1, 3).otherwise(2))
        .when((joins >= tables - 1) & (keyed >= 1), 3)
        .when((joins >= 1) | (keyed >= 1), 2)
        .otherwise(1)
    )


def readiness_expr(structure: Column) -> Column:
    """Structure score, lowered where people cannot get at the space or its tables."""
    ungranted = F.col("ungranted_count")
    half = F.greatest(F.lit(1), F.floor(F.col("table_count") / 2))
    blocked = F.col("not_shared") | ((ungranted > 0) & (ungranted >= half))
    hindered = F.col("warehouse_locked") | (ungranted > 0)
    return (
        F.when(blocked, F.greatest(structure - 1, F.lit(1)))
        .when(hindered & (structure == 3), 2)
        .otherwise(structure)
    )


def structure_score(counts: DataFrame) -> DataFrame:
    return counts.select("space_id", structure_expr().alias("score"))


def missing_join_findings(counts: DataFrame) -> DataFrame:
    return finding(counts, "no_joins")


def missing_key_findings(space_tables: DataFrame, constraints: DataFrame, k: int = 5) -> DataFrame:
    """Spaces where some tables have keys and others lack them, naming the first that lack them."""
    keyed = readers.tables_with_keys(constraints)
    partly = space_tables.join(keyed, "table_id", "left_semi").select("space_id").distinct()
    missing = space_tables.join(keyed, "table_id", "left_anti").join(partly, "space_id", "left_semi")
    items = missing.select(
        "space_id",
        F.lit("missing_keys").alias("rule_id"),
        F.col("ordinal").alias("ord"),
        F.lit(0).alias("sub"),
        X.short_name(F.col("table_id")).alias("item"),
    )
    return first_k(items, k).select("space_id", F.col("shown").alias("tables"), "n_more")


def unowned(space_tables: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables without an owner, unreadable ones included."""
    return J.with_metadata(space_tables, tables).where(X.text_of(F.col("owner")) == "").select("space_id", "table_id")


def not_serverless(spaces: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Spaces whose warehouse is known not to be serverless."""
    classic = warehouses.where(~F.col("is_serverless")).select("warehouse_id")
    return spaces.join(classic, "warehouse_id", "left_semi").select("space_id")


def can_use_principals(acl: DataFrame) -> DataFrame:
    """Principals other than admins that were given the right to use an object."""
    principal = X.first_present(F.col("user_name"), F.col("group_name"), F.col("service_principal_name"))
    return acl.select("object_type", "object_id", principal.alias("principal"), "levels").where(
        F.col("principal").isNotNull()
        & (F.lower("principal") != "admins")
        & F.array_contains("levels", "CAN_USE")
    ).select("object_type", "object_id", "principal")


def locked_objects(acl: DataFrame) -> DataFrame:
    """Objects that have access entries, none of which lets an ordinary principal use them."""
    principal = X.first_present(F.col("user_name"), F.col("group_name"), F.col("service_principal_name"))
    usable = (
        principal.isNotNull() & (F.lower(principal) != "admins") & F.array_contains("levels", "CAN_USE")
    )
    return (
        acl.groupBy("object_type", "object_id")
        .agg(F.bool_or(F.coalesce(usable, F.lit(False))).alias("usable"))
        .where(~F.col("usable"))
        .select("object_type", "object_id")
    )


def not_shared(spaces: DataFrame, acl: DataFrame) -> DataFrame:
    kind = spaces.schema["space_id"].dataType
    locked = locked_objects(acl.where(F.col("object_type") == "space"))
    return spaces.select("space_id").join(
        locked.select(F.col("object_id").try_cast(kind).alias("space_id")), "space_id", "left_semi"
    )


def warehouse_locked(spaces: DataFrame, acl: DataFrame) -> DataFrame:
    locked = locked_objects(acl.where(F.col("object_type") == "warehouse"))
    return (
        spaces.where(X.text_of(F.col("warehouse_id")) != "")
        .join(locked.select(F.col("object_id").alias("warehouse_id")), "warehouse_id", "left_semi")
        .select("space_id")
    )


def table_access(
    grants: DataFrame, grant_status: DataFrame, tables: DataFrame, strict_compat: bool = False
) -> DataFrame:
    """Per table: whether grants are readable, and if so whether anyone but the owner may read."""
    external = J.external_grants(grants, tables, strict_compat)
    return grant_status.select("table_id", "readable").join(external, "table_id", "left").select(
        "table_id",
        F.coalesce("readable", F.lit(False)).alias("readable"),
        F.coalesce("has_external_grant", F.lit(False)).alias("has_external_grant"),
    )


def no_external_grant(
    space_tables: DataFrame,
    grants: DataFrame,
    grant_status: DataFrame,
    tables: DataFrame,
    strict_compat: bool = False,
) -> DataFrame:
    bare = table_access(grants, grant_status, tables, strict_compat).where(
        F.col("readable") & ~F.col("has_external_grant")
    )
    return space_tables.join(bare, "table_id", "left_semi").select("space_id", "table_id")


def grants_unknown(space_tables: DataFrame, grant_status: DataFrame) -> DataFrame:
    readable = grant_status.where("readable").select("table_id")
    return space_tables.join(readable, "table_id", "left_anti").select("space_id", "table_id")


def readiness_score(
    structure: DataFrame, not_shared: DataFrame, locked: DataFrame, ungranted: DataFrame, counts: DataFrame
) -> DataFrame:
    """Readiness of every space from the parts found above."""

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("space_id", F.lit(True).alias(name)).distinct()

    bare = ungranted.groupBy("space_id").agg(F.count("*").alias("ungranted_count"))
    return (
        structure.join(counts.select("space_id", "table_count"), "space_id")
        .join(flag(not_shared, "not_shared"), "space_id", "left")
        .join(flag(locked, "warehouse_locked"), "space_id", "left")
        .join(bare, "space_id", "left")
        .na.fill({"not_shared": False, "warehouse_locked": False, "ungranted_count": 0})
        .select("space_id", readiness_expr(F.col("score")).alias("score"))
    )


def metric_view_findings(space_tables: DataFrame, metric_views: DataFrame, k: int = 5) -> DataFrame:
    """What a space should know about metric views, its own and those only in its schemas."""

    def named(views: DataFrame, rule: str, order) -> DataFrame:
        short = X.short_name(F.col("full_name")).alias("item")
        return views.select("space_id", F.lit(rule).alias("rule_id"), order.cast("long").alias("ord"), short)

    held = named(J.held_metric_views(metric_views, space_tables), "metric_views_in_space", F.col("ordinal"))
    extra = named(J.further_metric_views(space_tables, metric_views, k), "metric_views_extra", F.lit(0))
    lists = shown_items(held.unionByName(extra), order=["ord", "item"])
    names = F.map_from_entries(F.collect_list(F.struct("rule_id", "shown")))
    facts = lists.groupBy("space_id").agg(names.alias("shown")).selectExpr(
        "space_id",
        "shown",
        f"size(coalesce(try_element_at(shown, 'metric_views_in_space'), {X.NO_ARRAY})) as mv_count",
        "map_contains_key(shown, 'metric_views_extra') as has_extra_views",
    )
    return finding(facts, "metric_views_in_space").unionByName(finding(facts, "metric_views_extra")).unionByName(
        finding(facts, "metric_views_only_in_catalog")
    )


def untagged_spaces(space_tables: DataFrame, tables: DataFrame, table_tags: DataFrame) -> DataFrame:
    """Spaces that hold base tables none of which carries a tag."""
    base = J.base_tables(space_tables, readers.metric_views(tables))
    tagged = base.join(table_tags.select("table_id").distinct(), "table_id", "left_semi")
    return base.select("space_id").distinct().join(tagged.select("space_id").distinct(), "space_id", "left_anti")
