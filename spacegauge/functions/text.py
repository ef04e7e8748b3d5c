"""Column expressions for names, texts and JSON, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ARRAY = "cast(array() as array<string>)"


def text_of(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Text without white space, of any kind, at either end."""
    return F.regexp_replace(text_of(col), r"(?U)^\s+|\s+\z", "")


def is_blank(col: Column) -> Column:
    return ~text_of(col).rlike(r"(?U)\S")


def short_name(table_id: Column) -> Column:
    """Last dotted part of an id."""
    return F.element_at(F.split(table_id, r"\."), -1)


def schema_id(table_id: Column) -> Column:
    """First two dotted parts of an id."""
    return F.substring_index(table_id, ".", 2)


def has_three_parts(table_id: Column) -> Column:
    return F.size(F.split(table_id, r"\.")) == 3


LINE_END = r"(?:\R|[\x1c-\x1e])"


def line_count(text: Column) -> Column:
    """Lines as a text editor counts them: none in an empty text, one trailing line end ignored."""
    body = F.regexp_replace(text, LINE_END + r"\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, LINE_END)))


def line_count_sql(text: str) -> str:
    """The same as SQL text."""
    return f"if({text} = '', 0, size(split(regexp_replace({text}, r'{LINE_END}\\z', ''), r'{LINE_END}')))"


def first_present(*cols: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def kept(*options: Column) -> Column:
    """The non-null options as an array."""
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def name_variants(table_id: Column) -> Column:
    """Forms in which a question may mention a table: the name, its singular, its first and last word."""
    name = F.lower(short_name(table_id))
    words = F.split(name, "_")
    last = F.element_at(words, -1)
    compound = F.size(words) > 1

    def cut(col: Column, n: int) -> Column:
        return F.substring(col, F.lit(1), F.length(col) - n)

    return F.array_distinct(
        kept(
            name,
            F.when(name.endswith("ies"), F.concat(cut(name, 3), F.lit("y"))).when(
                name.endswith("sses") | name.endswith("xes"), cut(name, 2)
            ),
            F.when(name.endswith("s") & (F.length(name) > 3), cut(name, 1)),
            F.when(compound, words[0]),
            F.when(compound, last),
            F.when(compound & last.endswith("s"), cut(last, 1)),
        )
    )


def shortest(forms: Column) -> Column:
    """The forms that hold no other form; a text that holds any form holds one of these."""
    return F.filter(forms, lambda f: ~F.exists(forms, lambda g: (g != f) & F.contains(f, g)))


def demote_headings(text: Column) -> Column:
    """Turn level 1-3 markdown headings into level 4."""
    return F.regexp_replace(text, r"(?md)^#{1,3} ", "#### ")


def safe_key(text: Column) -> Column:
    """A file-name-safe form of a title."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9_-]", "_")


def whole_percent(pct: Column) -> Column:
    """Percentage rounded half to even, as text without decimals."""
    return F.bround(pct, 0).cast("bigint").cast("string")


def json_has_key(content: Column, key: str) -> Column:
    """True where the JSON object has the top-level key; false on malformed JSON."""
    return F.coalesce(F.array_contains(F.json_object_keys(content), key), F.lit(False))
