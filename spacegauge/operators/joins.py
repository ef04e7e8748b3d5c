"""Joins between spaces, tables and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators.containment import contained
from spacegauge.operators.lists import number_rows, ranked
from spacegauge.sources import readers


def with_metadata(space_tables: DataFrame, tables: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Space tables with their metadata; a table that cannot be read keeps an error and no attributes.

    ``extra`` names further columns of ``tables`` to carry along unchanged.
    """
    known = tables.select(
        "table_id",
        "comment",
        "owner",
        "table_type",
        "has_row_filter",
        "has_col_mask",
        F.col("error").alias("read_error"),
        F.lit(True).alias("known"),
        *extra,
    )
    joined = space_tables.select("space_id", "table_id", "ordinal").join(known, "table_id", "left")
    error = (
        F.when(~X.has_three_parts(F.col("table_id")), F.concat(F.lit("Cannot parse: "), "table_id"))
        .when(F.col("known").isNull(), "No metadata")
        .otherwise(F.col("read_error"))
    )
    joined = joined.withColumn("error", error)
    fine = F.col("error").isNull()
    return joined.select(
        "space_id",
        "table_id",
        "ordinal",
        F.when(fine, X.text_of(F.col("comment"))).alias("comment"),
        F.when(fine, F.col("owner")).alias("owner"),
        F.when(fine, F.coalesce("table_type", F.lit("BASE TABLE"))).alias("table_type"),
        (fine & F.coalesce("has_row_filter", F.lit(False))).alias("has_row_filter"),
        (fine & F.coalesce("has_col_mask", F.lit(False))).alias("has_col_mask"),
        "error",
        *extra,
    )


def with_tags(space_tables: DataFrame, table_tags: DataFrame) -> DataFrame:
    return space_tables.select("space_id", "table_id").join(
        table_tags.select("table_id", "tag_name", "tag_value"), "table_id", "left"
    ).select("space_id", "table_id", "tag_name", "tag_value")


def tables_without_keys(space_tables: DataFrame, constraints: DataFrame) -> DataFrame:
    return space_tables.select("space_id", "table_id").join(
        readers.tables_with_keys(constraints), "table_id", "left_anti"
    ).select("space_id", "table_id")


def base_tables(space_tables: DataFrame, metric_views: DataFrame) -> DataFrame:
    """Space tables that are not metric views."""
    return (
        space_tables.withColumn("full_name", F.lower("table_id"))
        .join(metric_views.select("full_name"), "full_name", "left_anti")
        .drop("full_name")
    )


PART = 1 << 14  # metric views of a schema, about, that lie in one task
VIEWS = 256  # metric views of a list, a multiple of 8 so that what is written repeats by whole bytes
SPREAD = 64  # copies of each list, over which the spaces of its schema are dealt out
BLOCK = 256  # spaces that meet a list at once, counting the names they hold


def split_metric_views(metric_views: DataFrame, space_tables: DataFrame) -> DataFrame:
    """Metric views of every schema a space touches, told apart by whether the space holds them.

    The result has a row for every space and view of its schemas, so it is made last and never shuffled. ``space_tables`` is
    read once and its rows are shuffled once for each part of about ``PART`` views of their schema, over ``SPREAD`` places,
    to all of which the part's views go. There, blocks of spaces meet lists of views and are unfolded list by list, so that
    the same few names follow each other for space after space and take little room where they are written.
    """
    named = metric_views.where("schema_id is not null")
    sizes = named.groupBy("schema_id").agg(F.ceil(F.count("*") / PART).alias("n_parts"))
    placed = named.join(sizes, "schema_id").select(
        "schema_id", "full_name", F.expr("pmod(xxhash64(full_name), n_parts)").alias("part")
    )
    views = placed.groupBy("schema_id", "part").agg(F.sort_array(F.collect_list(F.struct("full_name"))).alias("views"))
    cut = f"transform(sequence(0, (size(views) - 1) div {VIEWS}), i -> slice(views, i * {VIEWS} + 1, {VIEWS}))"
    lists = views.select("schema_id", "part", F.explode(F.expr(cut)).alias("views")).select(
        "*",
        F.array_min("views.full_name").alias("least"),
        F.array_max("views.full_name").alias("most"),
        F.expr(f"explode(sequence(0L, {SPREAD - 1}L))").alias("copy"),
    )
    members = space_tables.where(X.has_three_parts(F.col("table_id"))).select(
        "space_id",
        F.lower("table_id").alias("full_name"),
        F.lower(X.schema_id(F.col("table_id"))).alias("schema_id"),
    )
    known = named.select("full_name", F.col("schema_id").alias("its_schema")).distinct()
    # A view held counts in the schema it is listed under, which need not be that of its name; a space without an id holds none.
    held = F.when(F.col("space_id").isNotNull() & F.col("its_schema").isNotNull(), F.col("full_name"))
    own, other = F.col("schema_id"), F.col("its_schema")
    facts = members.join(known, "full_name", "left").select(
        "space_id",
        F.inline(
            F.when(other != own, F.array(_fact(own, F.lit(None).cast("string"), True), _fact(other, held, False)))
            .otherwise(F.array(_fact(own, held, True)))
        ),
    )
    facts = facts.join(sizes, "schema_id").select(
        "schema_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"),
        F.expr(f"pmod(xxhash64(space_id), {SPREAD}L)").alias("copy"),
        "space_id",
        "held",
        "touched",
    )
    place = ["schema_id", "part", "copy"]
    # A fixed number of tasks: by their size, the rows dealt out would be put into few, which then make all of the result.
    dealt = facts.repartition(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)
    spaces = dealt.groupBy(*place, "space_id").agg(F.collect_set("held").alias("held"), F.bool_or("touched").alias("touched"))
    spaces = spaces.where("touched").withColumn("size", F.size("held") + 1)
    upto = F.sum("size").over(Window.partitionBy(*place).orderBy("space_id").rowsBetween(Window.unboundedPreceding, 0))
    blocks = spaces.withColumn("block", F.floor((upto - F.col("size")) / BLOCK)).groupBy(*place, "block")
    blocks = blocks.agg(F.collect_list(F.struct("space_id", "held")).alias("spaces"))
    met = blocks.join(lists.hint("merge"), place)
    met = met.select("views", "least", "most", F.inline("spaces"))
    met = met.select("space_id", "views", F.expr("filter(held, h -> h between least and most)").alias("held"))
    return met.select("space_id", "held", F.inline("views")).select(
        "space_id", "full_name", F.expr("coalesce(array_contains(held, full_name), false)").alias("in_space")
    )


def _fact(schema_id: Column, held: Column, touched: bool) -> Column:
    return F.struct(schema_id.alias("schema_id"), held.alias("held"), F.lit(touched).alias("touched"))


def held_metric_views(metric_views: DataFrame, space_tables: DataFrame) -> DataFrame:
    """The metric views among each space's tables: ``space_id, full_name, schema_id, ordinal``."""
    members = space_tables.where(X.has_three_parts(F.col("table_id"))).groupBy(
        "space_id",
        F.lower("table_id").alias("full_name"),
        F.lower(X.schema_id(F.col("table_id"))).alias("schema_id"),
    )
    return members.agg(F.min("ordinal").alias("ordinal")).join(metric_views.select("full_name"), "full_name", "left_semi")


def further_metric_views(space_tables: DataFrame, metric_views: DataFrame, k: int) -> DataFrame:
    """For each space, the first ``k`` metric views of the schemas it touches that it does not hold.

    A space that holds ``m`` metric views of a schema finds its first ``k`` others among the schema's first ``k + m``,
    which are looked up by rank, so its rows grow with what it holds and not with the schema.
    """
    held = held_metric_views(metric_views, space_tables)
    touched = space_tables.where(X.has_three_parts(F.col("table_id"))).select(
        "space_id", F.lower(X.schema_id(F.col("table_id"))).alias("schema_id")
    )
    own = held.groupBy("space_id", "schema_id").agg(F.count("*").alias("m"))
    wanted = touched.distinct().join(own, ["space_id", "schema_id"], "left").select(
        "space_id", "schema_id", F.explode(F.sequence(F.lit(1), F.coalesce("m", F.lit(0)).cast("int") + k)).alias("rank")
    )
    numbered = number_rows(metric_views, ["schema_id"], ["full_name"]).withColumnRenamed("seq", "rank")
    others = wanted.join(numbered, ["schema_id", "rank"]).select("space_id", "full_name")
    others = others.join(held.select("space_id", "full_name"), ["space_id", "full_name"], "left_anti")
    by_name = [X.short_name(F.col("full_name")), F.col("full_name")]
    return ranked(others, ["space_id"], by_name, k).select("space_id", "full_name")


def unknown_refs(sql_refs: DataFrame, cte_names: DataFrame, space_tables: DataFrame) -> DataFrame:
    """First table reference of each SQL that names neither one of its own CTEs nor a table of its space."""
    known = space_tables.select(
        "space_id", F.lower(X.short_name(F.col("table_id"))).alias("ref")
    ).distinct()
    return (
        sql_refs.join(cte_names.select("space_id", "sql_id", F.col("name").alias("ref")), ["space_id", "sql_id", "ref"], "left_anti")
        .join(known, ["space_id", "ref"], "left_anti")
        .groupBy("space_id", "sql_id")
        .agg(F.min_by("ref", "pos").alias("ref"))
    )


def label_table(spark: SparkSession) -> DataFrame:
    """The fixed table of abbreviations and their full terms."""
    return spark.createDataFrame(list(R.ABBREVIATION_LABELS.items()), "abbrev string, label string")


def label_abbrevs(abbrevs: DataFrame, labels: DataFrame) -> DataFrame:
    """Abbreviations with their full term, if there is one."""
    return abbrevs.join(labels, "abbrev", "left")


def mentioned_abbrevs(abbrevs: DataFrame, labels: DataFrame, space_text: DataFrame) -> DataFrame:
    """Rows of ``abbrevs(space_id, abbrev)`` that occur, themselves or by full term, in their space's texts."""
    full_term = F.trim(F.element_at(F.split(F.lower("label"), "/"), 1))
    needles = label_abbrevs(abbrevs, labels).select(
        "space_id", "abbrev", F.explode(X.kept(F.col("abbrev"), full_term)).alias("needle")
    )
    texts = space_text.select("space_id", F.lower("text").alias("text"))
    return contained(needles, texts).select("space_id", "abbrev")


def covered_abbrevs(abbrevs: DataFrame, labels: DataFrame, space_text: DataFrame) -> DataFrame:
    """Whether an abbreviation, or its full term, occurs in the texts of its space."""
    distinct = abbrevs.select("space_id", "abbrev").distinct()
    hits = mentioned_abbrevs(distinct, labels, space_text).distinct()
    return distinct.join(hits.withColumn("hit", F.lit(True)), ["space_id", "abbrev"], "left").select(
        "space_id", "abbrev", F.col("hit").isNotNull().alias("covered")
    )


def name_variants(space_tables: DataFrame, shortest: bool = False) -> DataFrame:
    """Forms in which a question may mention a table; with ``shortest``, those that hold no other form of the table.

    They are made once for each table, not for each space that holds it: a plain ``explode`` would have Spark infer that
    there are some, and make them for every row of ``space_tables`` to see.
    """
    named = space_tables.select("table_id").distinct().select("table_id", X.name_variants(F.col("table_id")).alias("forms"))
    if shortest:
        named = named.withColumn("forms", X.shortest(F.col("forms")))
    forms = named.select("table_id", F.explode_outer("forms").alias("variant")).where("variant is not null")
    return space_tables.select("space_id", "table_id").join(forms, "table_id").select("space_id", "table_id", "variant")


def question_mentions(variants: DataFrame, questions: DataFrame) -> DataFrame:
    """Tables that some question of their space mentions by any form of their name."""
    texts = questions.select("space_id", F.lower("question_text").alias("text"))
    needles = variants.withColumnRenamed("variant", "needle")
    return contained(needles, texts).select("space_id", "table_id").distinct()


def attach_recommendations(area_scores: DataFrame, recommendations: DataFrame) -> DataFrame:
    items = recommendations.select("space_id", "area", "severity", "seq", "item")
    return area_scores.select("space_id", "area", "score").join(items, ["space_id", "area"], "left")


def external_grants(grants: DataFrame, tables: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Whether anyone but the owner may read a table; ``strict_compat`` ignores ``ALL PRIVILEGES`` with a space."""
    action = F.upper("action_type")
    if not strict_compat:
        action = F.replace(action, F.lit(" "), F.lit("_"))
    reader = F.when(action.isin(*R.GRANTING_ACTIONS), F.lower("principal"))
    # The least and the greatest reader equal the owner only if no one else reads.
    readers_of = grants.groupBy("table_id").agg(F.min(reader).alias("least"), F.max(reader).alias("most"))
    owner = F.when(F.col("error").isNull(), F.lower("owner"))
    owners = tables.select("table_id", X.text_of(owner).alias("owner"))
    other = (F.col("least") != X.text_of(F.col("owner"))) | (F.col("most") != X.text_of(F.col("owner")))
    return readers_of.join(owners, "table_id", "left").select(
        "table_id", F.coalesce(other, F.lit(False)).alias("has_external_grant")
    )


def apply_rules(texts: DataFrame, rules: Sequence[R.Rule], text: str = "text") -> DataFrame:
    """Hit counts of every rule, as columns of one projection."""
    return texts.select("*", *[r.count(F.col(text)).alias(r.name) for r in rules])


def join_dim(fact: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Fact rows with their dimension; Spark broadcasts the dimension only where its size allows."""
    return fact.join(dim, on)


def join_ranged(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    range_a: tuple[str, str, str],
    range_b: tuple[str, str, str],
) -> DataFrame:
    """Rows of ``a`` and ``b`` with equal keys, each side limited to its own half-open time range."""
    return a.where(in_range(*range_a)).join(b.where(in_range(*range_b)), list(keys))


def in_range(ts: str, start: str, end: str) -> Column:
    """Half-open range ``start <= ts < end``."""
    kind = "timestamp_ntz"
    return (F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind))


def two_period(df: DataFrame, ts: str, cur: tuple[str, str], prev: tuple[str, str]) -> DataFrame:
    """Row counts of two periods in one row, from a single pass."""
    spans = in_range(ts, *cur) | in_range(ts, *prev)
    return df.where(spans).agg(
        F.count_if(in_range(ts, *cur)).alias("current"), F.count_if(in_range(ts, *prev)).alias("previous")
    )
