"""Readers: exported files in, the audit's tables out.

Each ``read_*`` loads files with a fixed schema; the function of the same noun shapes any DataFrame of
that schema, so tables and views can be audited as well as files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.sources import schemas as S
from spacegauge.operators.usage import sample_audit, since

FORMATS = ("parquet", "orc", "json", "csv")


def load(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read files of a known schema; a JSON record that cannot be read keeps its text in ``error``."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
        if "error STRING" in schema:
            reader = reader.option("columnNameOfCorruptRecord", "error")
    elif fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


# ---- spaces and their settings ----------------------------------------------------------------
def read_spaces(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Space settings, one row per space; an unreadable space is a row with ``error``."""
    return spaces(load(spark, path, S.SPACES, fmt))


def spaces(df: DataFrame) -> DataFrame:
    return df.select(
        "space_id",
        F.coalesce("display_name", "title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("table_identifiers", F.expr(X.NO_ARRAY)).alias("table_identifiers"),
        F.coalesce("warehouse_id", F.lit("")).alias("warehouse_id"),
        "error",
    )


def space_tables(spaces_df: DataFrame) -> DataFrame:
    """One row per table of a space, with its catalog, schema and name; an id without three parts is flagged."""
    member = spaces_df.select(
        "space_id", F.posexplode("table_identifiers").alias("ordinal", "table_id")
    )
    parts = F.split("table_id", r"\.")
    good = X.has_three_parts(F.col("table_id"))
    return member.select(
        "space_id",
        "table_id",
        "ordinal",
        F.when(good, parts[0]).alias("catalog_name"),
        F.when(good, parts[1]).alias("schema_name"),
        F.when(good, parts[2]).alias("table_name"),
        F.when(~good, F.concat(F.lit("Cannot parse: "), "table_id")).alias("error"),
    )


def read_warehouses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return warehouses(load(spark, path, S.WAREHOUSES, fmt))


def warehouses(df: DataFrame) -> DataFrame:
    """Serverless flag, unknown where the warehouse could not be read."""
    return df.select(
        "warehouse_id", F.when(F.col("error").isNull(), F.col("enable_serverless_compute")).alias("is_serverless")
    )


def read_acl(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return acl(load(spark, path, S.ACL, fmt))


def acl(df: DataFrame) -> DataFrame:
    """One row per access entry of a space or warehouse."""
    return df.select("object_type", "object_id", F.inline("access_control_list")).select(
        "object_type",
        "object_id",
        "user_name",
        "group_name",
        "service_principal_name",
        F.coalesce(F.col("all_permissions.permission_level"), F.expr(X.NO_ARRAY)).alias("levels"),
    )


# ---- instructions and questions ---------------------------------------------------------------
def read_instructions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return load(spark, path, S.INSTRUCTIONS, fmt)


def text_instructions(instructions: DataFrame) -> DataFrame:
    return _of_kind(instructions, "TEXT_INSTRUCTION").select(
        "space_id", "ordinal", "title", F.coalesce("content", F.lit("")).alias("text")
    )


def sql_instructions(instructions: DataFrame) -> DataFrame:
    return _of_kind(instructions, "SQL_INSTRUCTION").select(
        "space_id", F.col("ordinal").alias("sql_id"), "title", F.coalesce("content", F.lit("")).alias("sql")
    )


def _of_kind(instructions: DataFrame, kind: str) -> DataFrame:
    return instructions.where(F.col("instruction_type") == kind)


def snippet(content: Column) -> Column:
    """A semantic expression out of its JSON, as a struct; malformed JSON leaves empty fields."""
    parsed = F.from_json(content, S.SNIPPET)
    kind = X.text_of(parsed["type"])
    return F.struct(
        F.when(kind.contains("MEASURE"), "MEASURE")
        .when(kind.contains("DIMENSION"), "DIMENSION")
        .when(kind.contains("FILTER"), "FILTER")
        .otherwise(kind)
        .alias("expression_type"),
        X.text_of(X.first_present(parsed["display_name"], parsed["alias"])).alias("name"),
        X.text_of(parsed["code"]).alias("code"),
        F.coalesce(parsed["synonyms"], F.expr(X.NO_ARRAY)).alias("synonyms"),
    )


def parse_expressions(instructions: DataFrame) -> DataFrame:
    """Semantic expressions: measures, dimensions and filters."""
    parsed = _of_kind(instructions, "SQL_SNIPPET").select("space_id", "ordinal", snippet(F.col("content")).alias("j"))
    return parsed.select("space_id", "ordinal", "j.*")


def explode_synonyms(expressions: DataFrame) -> DataFrame:
    """Every synonym, one per row, in the order of ``ordinal`` (its expression's) and ``place``."""
    return expressions.select("space_id", "ordinal", F.posexplode("synonyms").alias("place", "synonym"))


def parse_joins(instructions: DataFrame) -> DataFrame:
    """Join definitions: snippets whose JSON has a top-level ``join`` key."""
    return _of_kind(instructions, "FROM_SNIPPET").where(X.json_has_key(F.col("content"), "join")).select(
        "space_id", "ordinal", "content"
    )


def read_questions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return questions(load(spark, path, S.QUESTIONS, fmt))


def questions(df: DataFrame) -> DataFrame:
    """Samples and benchmarks, the text taken from the first key present."""
    present = [c for c in ("question", "question_text", "content") if c in df.columns]
    return df.where(F.col("question_type").isin("SAMPLE_QUESTION", "BENCHMARK")).select(
        "space_id",
        "question_id",
        "question_type",
        F.coalesce(*present, F.lit("")).alias("question_text"),
        "answer_text",
    )


# ---- catalog ----------------------------------------------------------------------------------
def table_attributes(describe_rows: DataFrame) -> DataFrame:
    """Comment and owner out of the extended description rows."""
    return describe_rows.groupBy("table_id").agg(
        F.coalesce(F.max(F.when(F.col("col_name") == "Comment", F.col("data_type"))), F.lit("")).alias("comment"),
        F.max(F.when(F.col("col_name") == "Owner", F.col("data_type"))).alias("owner"),
    )


def protection_flags(describe_rows: DataFrame) -> DataFrame:
    """Whether a table has a row filter or a column mask."""
    label = F.lower("col_name")
    return describe_rows.groupBy("table_id").agg(
        F.bool_or(label.contains("row filter")).alias("has_row_filter"),
        F.bool_or(label.contains("column mask") | label.contains("masking policy")).alias("has_col_mask"),
    )


def table_columns(columns: DataFrame) -> DataFrame:
    """Columns of every table, null comments read as empty."""
    return columns.select(
        "table_id", "ordinal", "name", "data_type", F.coalesce("comment", F.lit("")).alias("comment")
    )


def table_types(tables: DataFrame) -> DataFrame:
    return tables.select("table_id", F.coalesce("table_type", F.lit("BASE TABLE")).alias("table_type"))


def metadata_errors(tables: DataFrame) -> DataFrame:
    """Tables whose metadata could not be read, as data."""
    return tables.where(F.col("error").isNotNull()).select("table_id", "error")


def non_error_tables(tables: DataFrame) -> DataFrame:
    return tables.where(F.col("error").isNull())


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return load(spark, path, S.TABLES, fmt)


def read_columns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return table_columns(load(spark, path, S.COLUMNS, fmt))


def read_describe_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return load(spark, path, S.DESCRIBE_ROWS, fmt)


def read_tags(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return tags(load(spark, path, S.TABLE_TAGS, fmt))


def tags(df: DataFrame) -> DataFrame:
    return df.where(F.col("tag_name").isNotNull()).select("table_id", "tag_name", "tag_value", "ordinal")


def read_constraints(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return load(spark, path, S.CONSTRAINTS, fmt)


def tables_with_keys(constraints: DataFrame) -> DataFrame:
    return constraints.where(F.col("constraint_type").isin(*R.KEY_CONSTRAINTS)).select("table_id").distinct()


def read_grants(spark: SparkSession, path: str, status_path: str, fmt: str = "parquet") -> DataFrame:
    return grants(load(spark, path, S.GRANTS, fmt), load(spark, status_path, S.GRANT_STATUS, fmt))


def grants(table_grants: DataFrame, grant_status: DataFrame) -> DataFrame:
    """Grants of every listed table; unreadable tables and tables without grants stay distinct."""
    status = grant_status.select("table_id", F.coalesce("readable", F.lit(False)).alias("readable"))
    joined = status.join(table_grants, "table_id", "left")
    return joined.select(
        "table_id",
        "readable",
        F.when(F.col("readable"), F.col("principal")).alias("principal"),
        F.when(F.col("readable"), F.col("action_type")).alias("action_type"),
    ).distinct()


def metric_views(tables: DataFrame) -> DataFrame:
    """Metric views of the catalogs, by lower-cased name and schema."""
    return tables.where(F.col("table_type") == "METRIC_VIEW").select(
        F.lower(X.schema_id(F.col("table_id"))).alias("schema_id"), F.lower("table_id").alias("full_name")
    ).distinct()


# ---- events -----------------------------------------------------------------------------------
def read_lineage(spark: SparkSession, path: str, as_of: str, days: int = 90, fmt: str = "parquet") -> DataFrame:
    return lineage(since(load(spark, path, S.LINEAGE, fmt), as_of, days))


def lineage(df: DataFrame) -> DataFrame:
    return df.select(
        "event_time",
        F.col("source_table_full_name").alias("source_table"),
        F.col("target_table_full_name").alias("target_table"),
    )


def lineage_of(lineage_df: DataFrame, space_tables_df: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Lineage events of the trailing window that touch a table of any space."""
    known = space_tables_df.select("table_id").distinct()
    recent = since(lineage_df, as_of, days)
    marked = recent.join(known.select(F.col("table_id").alias("source_table"), F.lit(True).alias("s")), "source_table", "left")
    marked = marked.join(known.select(F.col("table_id").alias("target_table"), F.lit(True).alias("t")), "target_table", "left")
    return marked.where(F.col("s").isNotNull() | F.col("t").isNotNull()).select(*lineage_df.columns)


def read_audit(
    spark: SparkSession, path: str, as_of: str, days: int = 90, fmt: str = "parquet", sample_rows: int | None = None
) -> DataFrame:
    """Table reads of the trailing window, nested fields taken out; ``sample_rows`` keeps the first rows only."""
    return sample_audit(audit(since(load(spark, path, S.AUDIT, fmt), as_of, days)), sample_rows)


def audit(df: DataFrame) -> DataFrame:
    return df.where(F.col("action_name") == "getTable").select(
        "event_time",
        F.col("user_identity.email").alias("user_email"),
        "action_name",
        F.col("request_params.full_name_arg").alias("table_name"),
    )


def title_sql_blocks(texts: DataFrame) -> DataFrame:
    """Title / SQL blocks out of texts whose blocks are parted by dashed lines, one row per block."""
    blocks = texts.select(
        "space_id", F.posexplode(F.split(F.trim("text"), r"\n?---+\n?")).alias("seq", "block")
    ).select("space_id", "seq", F.regexp_replace("block", r"(?U)^\s+|\s+$", "").alias("block"))
    title = F.regexp_extract("block", r"(?id)^Title:\s*(.+?)(?:\n|\z)", 1)
    sql = F.regexp_extract("block", r"(?id)\bSQL:\s*\n([\s\S]+)", 1)
    return blocks.select(
        "space_id", "seq", F.trim(title).alias("title"), F.trim(sql).alias("sql")
    ).where((F.col("title") != "") & (F.col("sql") != ""))
