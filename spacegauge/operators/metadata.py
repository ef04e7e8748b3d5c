"""Area 2, metadata: coverage of descriptions, and names, types and comments that mislead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators import joins as J
from spacegauge.operators import sets
from spacegauge.operators.lists import ranked
from spacegauge.operators.texts import joints, space_pieces, space_text

COLUMN_RULES = ("described", "generic", "coded", "date_string", "technical")


def column_rules() -> dict[str, str]:
    """All column rules, as SQL expressions over one column row."""
    described = r"(coalesce(comment, '') rlike r'(?U)\S')"
    types = ", ".join(f"'{t}'" for t in R.STRING_TYPES)
    return {
        "described": described,
        "generic": f"{described} and {R.GENERIC_COMMENT.hit_sql('comment')}",
        "coded": f"{R.CODED_NAME.hit_sql('name')} and not {R.VALUE_DICTIONARY.hit_sql('comment')}",
        "date_string": f"{R.DATE_NAME.hit_sql('name')} and upper(data_type) in ({types})",
        "technical": f"{R.TECHNICAL_NAME.hit_sql('name')} and not {described}",
    }


def lint_columns(columns: DataFrame) -> DataFrame:
    """Every column with the outcome of every column rule, in one projection."""
    return columns.selectExpr("table_id", "ordinal", "name", *[f"{e} as {k}" for k, e in column_rules().items()])


def table_widths(columns: DataFrame) -> DataFrame:
    """Columns and described columns per table, with the hits of the other column rules."""
    return lint_columns(columns).groupBy("table_id").agg(
        F.count("*").alias("n_cols"), *[F.count_if(F.col(r)).alias(f"n_{r}") for r in COLUMN_RULES]
    )


def column_hits(columns: DataFrame, rule: str) -> DataFrame:
    return columns.where(column_rules()[rule]).select("table_id", "name")


def generic_comments(columns: DataFrame) -> DataFrame:
    return column_hits(columns, "generic")


def coded_columns(columns: DataFrame) -> DataFrame:
    return column_hits(columns, "coded")


def date_as_string(columns: DataFrame) -> DataFrame:
    return column_hits(columns, "date_string")


def technical_names(columns: DataFrame) -> DataFrame:
    return column_hits(columns, "technical")


def coverage_pct(described: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(described, total) * 100, F.lit(0.0))


def coverage(space_tables: DataFrame, columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Described share of each space's columns; columns are counted per table before the spaces join.

    With ``tables``, those that could not be read are left out.
    """
    members = space_tables.select("space_id", "table_id")
    if tables is not None:
        members = members.join(tables.where("error is null").select("table_id"), "table_id", "left_semi")
    widths = columns.groupBy("table_id").agg(
        F.count("*").alias("n_cols"), F.count_if(~X.is_blank(F.col("comment"))).alias("n_described")
    )
    return (
        members.join(widths, "table_id", "left")
        .groupBy("space_id")
        .agg(
            F.coalesce(F.sum("n_described"), F.lit(0)).alias("described"),
            F.coalesce(F.sum("n_cols"), F.lit(0)).alias("total"),
        )
        .withColumn("pct", coverage_pct(F.col("described"), F.col("total")))
    )


def coverage_expr(pct: Column) -> Column:
    return F.when(pct >= 80, 3).when(pct >= 50, 2).otherwise(1)


def coverage_score(coverage: DataFrame) -> DataFrame:
    return coverage.select("space_id", coverage_expr(F.col("pct")).alias("score"))


def metadata_expr(pct: Column, coded: Column, date_string: Column, thin: Column) -> Column:
    """Coverage score, lowered twice in turn, so that a good score may end as a poor one."""
    first = coverage_expr(pct)
    second = F.when((first == 3) & ((coded > 3) | (date_string > 0) | (thin > 1)), 2).otherwise(first)
    return F.when((second == 2) & ((coded > 5) | (date_string > 2)), 1).otherwise(second)


def metadata_score(
    coverage: DataFrame, n_coded: DataFrame, n_date_string: DataFrame, n_thin: DataFrame
) -> DataFrame:
    """Score of every space; the last three tables carry ``space_id, n``."""
    parts = {"n_coded": n_coded, "n_date_string": n_date_string, "n_thin": n_thin}
    joined = coverage.select("space_id", "pct")
    for name, df in parts.items():
        joined = joined.join(df.select("space_id", F.col("n").alias(name)), "space_id", "left")
    joined = joined.na.fill(0, list(parts))
    return joined.select("space_id", metadata_expr(F.col("pct"), *[F.col(c) for c in parts]).alias("score"))


def comment_kind(comment: Column, table_type: Column) -> Column:
    size = F.length(X.strip(comment))
    return F.when(size == 0, "none").when(
        (size < R.THIN_COMMENT_CHARS) & (F.upper(X.text_of(table_type)) != "METRIC_VIEW"), "thin"
    )


def comment_findings(tables: DataFrame) -> DataFrame:
    """Readable tables without a comment, or with a short one that is not on a metric view."""
    return (
        tables.where("error is null")
        .select(
            "table_id",
            comment_kind(F.col("comment"), F.col("table_type")).alias("kind"),
            F.length(X.strip(F.col("comment"))).alias("length"),
        )
        .where("kind is not null")
    )


def undocumented_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Readable tables none of whose columns is described."""
    described = columns.where(~X.is_blank(F.col("comment"))).select("table_id").distinct()
    return tables.where("error is null").select("table_id").join(described, "table_id", "left_anti")


def restricted_findings(space_tables: DataFrame, tables: DataFrame) -> DataFrame:
    return space_tables.join(sets.restricted_tables(tables), "table_id", "left_semi").select("space_id", "table_id")


def space_abbrevs(space_tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Short words in the names of each space's columns: distinct ``space_id, abbrev``."""
    tokens = sets.distinct_tokens(columns)
    return (
        space_tables.select("space_id", "table_id")
        .join(tokens, "table_id")
        .select("space_id", F.col("token").alias("abbrev"))
        .distinct()
    )


def explained_abbrevs(abbrevs: DataFrame, space_text: DataFrame, synonyms: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``abbrevs`` that a synonym or an instruction of their space explains.

    ``space_text(space_id, text)`` and ``synonyms(space_id, ordinal, place, synonym)`` hold one text per row. A full
    term of several words may be spread over consecutive synonyms, which the joints between them cover.
    """
    words = max(len(term.split()) for term in R.ABBREVIATION_LABELS.values())
    between = joints(
        synonyms, "space_id", ["ordinal", "place"], "synonym", " ", max(words - 1, 1), skip_blank=False
    ).select("space_id", F.concat("before", F.lit(" "), "after").alias("text"))
    texts = (
        space_text.select("space_id", "text")
        .unionByName(synonyms.select("space_id", F.col("synonym").alias("text")))
        .unionByName(between)
    )
    return J.mentioned_abbrevs(abbrevs, labels, texts).distinct()


def not_explained(abbrevs: DataFrame, explained: DataFrame, labels: DataFrame) -> DataFrame:
    left = abbrevs.join(explained, ["space_id", "abbrev"], "left_anti")
    return J.label_abbrevs(left, labels).select("space_id", "abbrev", "label")


def unmapped_abbrevs(
    space_tables: DataFrame, columns: DataFrame, space_text: DataFrame, synonyms: DataFrame, labels: DataFrame
) -> DataFrame:
    """Abbreviations in column names that neither a synonym nor an instruction of the space explains."""
    abbrevs = space_abbrevs(space_tables, columns)
    return not_explained(abbrevs, explained_abbrevs(abbrevs, space_text, synonyms, labels), labels)


# ---- digests ----------------------------------------------------------------------------------
def column_digest(columns: DataFrame, k: int = 15, width: int = 60) -> DataFrame:
    """One line per table: its first described columns, or its first columns with types if none is."""
    full = columns.where(F.col("comment") != "").select(
        "table_id",
        "ordinal",
        F.lit(1).alias("described"),
        F.concat("name", F.lit(": "), F.substring("comment", 1, width)).alias("entry"),
    )
    plain = columns.select(
        "table_id",
        "ordinal",
        F.lit(0).alias("described"),
        F.concat("name", F.lit(" ("), "data_type", F.lit(")")).alias("entry"),
    )
    first = ranked(full.unionByName(plain), ["table_id", "described"], ["ordinal"], k)

    def entries(kind: int, sep: str) -> Column:
        picked = F.collect_list(F.when(F.col("described") == kind, F.struct("rank", "entry")))
        return F.array_join(F.transform(F.sort_array(picked), lambda p: p["entry"]), sep)

    return first.groupBy("table_id").agg(
        F.coalesce(F.nullif(entries(1, "; "), F.lit("")), entries(0, ", ")).alias("digest")
    )


def _digest_lines(space_tables: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    members = J.with_metadata(space_tables, tables).where("error is null")
    described = members.join(column_digest(columns), "table_id", "left")
    comment = F.trim(F.coalesce(F.nullif("comment", F.lit("")), F.lit("No description")))
    return described.select(
        "space_id",
        "ordinal",
        F.concat(
            F.lit("Table: "),
            X.short_name(F.col("table_id")),
            F.lit("\nDescription: "),
            comment,
            F.lit("\nColumns: "),
            F.coalesce("digest", F.lit("")),
        ).alias("text"),
    )


def digest_pieces(space_tables: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Name, comment and main columns of each readable table, in order, many tables to a piece."""
    return space_pieces(_digest_lines(space_tables, tables, columns), "\n\n", size=256)


def metadata_digest(space_tables: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The same as one text per space."""
    return space_text(_digest_lines(space_tables, tables, columns), "\n\n").withColumnRenamed("text", "digest")
