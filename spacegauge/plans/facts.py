"""The wide row of each space, from which scores, findings and recommendations are read.

Inputs are reduced on their own key first (columns, tags and grants per table) and tables are joined to their spaces
once. Then every input gives rows of ``space_id`` and its own measures, numbers to add up and flags to be or'ed; all of
them are one union, added up in one aggregation, whose partial sums are taken before its only shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators import config_lint as C
from spacegauge.operators import curation, joins, metadata, questions, readiness
from spacegauge.operators.findings import present
from spacegauge.operators.lists import ranked, shown_items
from spacegauge.sources import readers


@dataclass(frozen=True)
class Estate:
    """All inputs of an audit, for any number of spaces."""

    spaces: DataFrame
    space_tables: DataFrame
    tables: DataFrame
    columns: DataFrame
    table_tags: DataFrame
    table_constraints: DataFrame
    table_grants: DataFrame
    grant_status: DataFrame
    acl: DataFrame
    warehouses: DataFrame
    instructions: DataFrame
    questions: DataFrame
    description_verdicts: DataFrame


# Names per space and rule kept for messages; all others list everything.
SHOWN = {
    "missing_keys": 5, "unowned": 5, "ungranted": 5, "grants_unknown": 3, "metric_views_extra": 5,
    "unclear_layer": 5, "generic": 5, "coded": 5, "date_string": 5, "technical": 5, "restricted": 5,
    "hardcoded_sql": 3, "unknown_tables": 3, "inline_sql": 2, "hardcoded_gold": 2,
}


# ---- tables -----------------------------------------------------------------------------------
def table_facts(estate: Estate, strict_compat: bool = False) -> DataFrame:
    """One row per table with everything the rules need of it."""
    keyed = readers.tables_with_keys(estate.table_constraints).withColumn("is_keyed", F.lit(True))
    tagged = estate.table_tags.where("tag_name is not null").select("table_id").distinct().withColumn("is_tagged", F.lit(True))
    access = readiness.table_access(estate.table_grants, estate.grant_status, estate.tables, strict_compat)
    parts = [
        estate.tables.select(
            "table_id", "comment", "owner", "table_type", "has_row_filter", "has_col_mask", "error",
            (F.col("table_type") == "METRIC_VIEW").alias("is_mv"),
        ),
        metadata.table_widths(estate.columns),
        keyed,
        tagged,
        curation.layer_tags(estate.table_tags),
        access,
    ]
    return reduce(lambda a, b: a.join(b, "table_id", "left"), parts)


_CARRIED = (
    "is_mv", "n_cols", "n_described", "n_generic", "n_coded", "n_date_string", "n_technical",
    "is_keyed", "is_tagged", "layer_tag", "readable", "has_external_grant",
)


def member_facts(estate: Estate, strict_compat: bool = False) -> DataFrame:
    """One row per table of a space, with the outcome of every table rule."""
    members = joins.with_metadata(estate.space_tables, table_facts(estate, strict_compat), _CARRIED)
    counts = [c for c in _CARRIED if c.startswith("n_")]
    flags = ("is_mv", "is_keyed", "is_tagged", "readable", "has_external_grant")
    plain = [c for c in members.columns if c not in counts and c not in flags]
    members = members.selectExpr(
        *plain,
        *[f"if(error is null, coalesce({c}, 0), 0) as {c}" for c in counts],
        *[f"coalesce({c}, false) as {c}" for c in flags],
    ).withColumns(
        {
            "short": X.short_name(F.col("table_id")),
            "kind": metadata.comment_kind(F.col("comment"), F.col("table_type")),
            "layer": curation.layer_expr(F.col("table_id"), F.col("table_type"), F.col("layer_tag")),
        }
    )
    rules = {
        "missing_keys": "not is_keyed",
        "unowned": "coalesce(owner, '') = ''",
        "ungranted": "readable and not has_external_grant",
        "grants_unknown": "not readable",
        "metric_views_in_space": "is_mv",
        "non_gold": "layer = 'non_gold'",
        "unclear_layer": "layer = 'unclear'",
        "wide": f"n_cols > {R.WIDE_TABLE_COLUMNS}",
        "undocumented": "error is null and n_described = 0",
        "no_comment": "error is null and coalesce(kind, '') = 'none'",
        "thin_comment": "error is null and coalesce(kind, '') = 'thin'",
        "restricted": "has_row_filter or has_col_mask",
    }
    return members.selectExpr("*", *[f"{cond} as {rule}" for rule, cond in rules.items()])


MEMBER_COUNTS = {
    "missing_keys": "n_missing_keys",
    "unowned": "unowned_count",
    "ungranted": "ungranted_count",
    "grants_unknown": "unknown_grant_count",
    "metric_views_in_space": "mv_count",
    "non_gold": "n_non_gold",
    "unclear_layer": "n_unclear",
    "wide": "n_wide",
    "undocumented": "n_undocumented",
    "no_comment": "n_no_comment",
    "thin_comment": "n_thin",
    "restricted": "n_restricted",
}


def member_measures(members: DataFrame) -> DataFrame:
    """What each table of a space adds to the space."""
    sums = {
        "total_cols": "n_cols", "described": "n_described", "n_generic": "n_generic", "n_coded": "n_coded",
        "n_date_string": "n_date_string", "n_technical": "n_technical",
    }
    counts = {
        "keyed": "is_keyed",
        "tagged": "is_tagged",
        "base_tagged_count": "is_tagged and not is_mv",
        **{n: rule for rule, n in MEMBER_COUNTS.items()},
    }
    return members.selectExpr(
        "space_id",
        "1L as table_count",
        *[f"if({cond}, 1L, 0L) as {n}" for n, cond in counts.items()],
        *[f"cast({c} as bigint) as {n}" for n, c in sums.items()],
    )


def schema_measures(space_tables: DataFrame) -> DataFrame:
    schemas = space_tables.select("space_id", X.schema_id(F.col("table_id")).alias("s")).distinct()
    return schemas.selectExpr("space_id", "if(s is null, 0L, 1L) as n_schemas")


# ---- names behind the findings ----------------------------------------------------------------
def _items(df: DataFrame, rule: str, item: str, order: str = "0", sub: str = "0") -> DataFrame:
    """Rows as items: the rule they fall under, their place (two whole numbers) and their name."""
    return df.selectExpr(
        "space_id", f"{rule} as rule_id", f"cast({order} as bigint) as ord", f"cast({sub} as bigint) as sub", f"{item} as item"
    )


def member_items(members: DataFrame) -> DataFrame:
    """One row per table and rule it falls under, as items."""
    named = {
        "non_gold": "concat(short, if(layer_tag is null, '', concat(' (tagged: ', layer_tag, ')')))",
        "wide": "concat(short, ' (', n_cols, ' cols)')",
        "thin_comment": "concat('`', short, '` (', length(trim(comment)), ' chars)')",
        "metric_views_in_space": "lower(short)",
    }
    cases = ", ".join(
        f"if({rule}, named_struct('rule_id', '{rule}', 'item', {named.get(rule, 'short')}), null)"
        for rule in MEMBER_COUNTS
    )
    hits = members.selectExpr("space_id", "ordinal", f"inline(array({cases}))").where("rule_id is not null")
    return _items(hits, "rule_id", "item", "ordinal")


COLUMN_RULES = ("generic", "coded", "date_string", "technical")


def column_items(columns: DataFrame) -> DataFrame:
    """One row per column and rule it falls under: ``table_id, rule_id, ordinal, name``."""
    rules = metadata.column_rules()
    hit = F.expr(present([(rules[r], r) for r in COLUMN_RULES]))
    return columns.select("table_id", "ordinal", "name", F.explode(hit).alias("rule_id"))


def space_column_items(estate: Estate, k: int | None = None) -> DataFrame:
    """Column names behind the findings of each space; with ``k``, the first of each table only.

    A name among the first ``k`` of its space is among the first ``k`` of its table.
    """
    items = column_items(estate.columns)
    if k is not None:
        items = ranked(items, ["table_id", "rule_id"], ["ordinal"], k).drop("rank")
    readable = estate.tables.where("error is null").select("table_id")
    members = estate.space_tables.select("space_id", "table_id", F.col("ordinal").alias("t"))
    placed = items.join(readable, "table_id", "left_semi").join(members, "table_id")
    return _items(placed, "rule_id", "concat(element_at(split(table_id, '[.]'), -1), '.', name)", "t", "ordinal")


def sql_items(sqls: DataFrame, unknown: DataFrame) -> DataFrame:
    """Titles of SQL with hardcoded values, and of SQL that reads unknown tables with what it reads."""
    titled = unknown.join(sqls.select("space_id", "sql_id", "title"), ["space_id", "sql_id"])
    reads = "concat('\"', substring(coalesce(title, ''), 1, 40), '\" reads `', ref, '`')"
    return _items(C.hardcoded_sqls(sqls), "'hardcoded_sql'", "coalesce(title, '')", "sql_id").unionByName(
        _items(titled, "'unknown_tables'", reads, "sql_id")
    )


def text_items(texts: DataFrame) -> DataFrame:
    return _items(C.text_blocks(texts), "kind", "title", "ordinal")


def gold_items(question_rows: DataFrame) -> DataFrame:
    rows = questions.benchmarks(question_rows).where(R.HARDCODED_GOLD_SQL.hit(F.col("answer_text")))
    return _items(rows, "'hardcoded_gold'", "substring(question_text, 1, 50)", "question_id")


def extra_metric_views(space_tables: DataFrame, metric_views: DataFrame) -> DataFrame:
    """The names that messages show of metric views a space lacks in the schemas it touches."""
    others = joins.further_metric_views(space_tables, metric_views, SHOWN["metric_views_extra"])
    return _items(others, "'metric_views_extra'", "element_at(split(full_name, '[.]'), -1)")


# ---- instructions and questions ---------------------------------------------------------------
RULE_COUNTS = ("schema_hits", "business_hits")


def instruction_measures(instructions: DataFrame) -> list[DataFrame]:
    """What each instruction adds to its space, one table per kind: texts, example SQL, joins and semantic expressions.

    All rules of all kinds in one projection make a method of more than 8,000 bytes, which the JVM never compiles; rules
    that only count which of many words occur are apart for that reason. A rule is tried where its words occur.
    """
    texts = readers.text_instructions(instructions).selectExpr("space_id", "text", f"{R.lowered('text')} as low")
    sqls = readers.sql_instructions(instructions).selectExpr("space_id", "sql", f"{R.lowered('sql')} as low")
    sql_rules, text_rules = C.sql_rules("sql", "low"), C.text_rules("text", "low")
    counted = {m: f"cast({text_rules[m]} as bigint) as {m}" for m in C.TEXT_MEASURES}
    kind = C.classify_expression(F.col("expression_type"), F.col("code"))
    return [
        texts.selectExpr("space_id", "1L as text_count", *[e for m, e in counted.items() if m not in RULE_COUNTS]),
        texts.selectExpr("space_id", *[counted[m] for m in RULE_COUNTS]),
        sqls.selectExpr(
            "space_id",
            "1L as sql",
            f"if({sql_rules['hardcoded']}, 1L, 0L) as n_hardcoded",
            *[f"{sql_rules[c]} as {c}" for c in C.FLAGS],
        ),
        _each(readers.parse_joins(instructions), "join_count"),
        readers.parse_expressions(instructions).withColumn("kind", kind).selectExpr(
            "space_id",
            "1L as expr_count",
            "if(kind = 'measure', 1L, 0L) as n_measures",
            "cast(size(synonyms) as bigint) as n_synonyms",
        ),
    ]


def question_measures(question_rows: DataFrame) -> DataFrame:
    """What each sample and benchmark adds to its space."""
    sample, bench = "question_type = 'SAMPLE_QUESTION'", "question_type = 'BENCHMARK'"
    counts = {
        "samples": sample,
        "benchmarks": bench,
        "n_missing_gold": f"{bench} and not coalesce(answer_text, '') rlike r'(?U)\\S'",
        "n_hardcoded_gold": f"{bench} and {R.HARDCODED_GOLD_SQL.hit_sql('answer_text')}",
    }
    return question_rows.selectExpr(
        "space_id",
        *[f"if({cond}, 1L, 0L) as {n}" for n, cond in counts.items()],
        *[f"{sample} and {rule.hit_sql('lower(question_text)')} as {n}" for n, rule in R.QUESTION_PATTERNS.items()],
    )


# ---- the whole --------------------------------------------------------------------------------
def summed(pieces: Sequence[DataFrame]) -> DataFrame:
    """Measures of all inputs per space: numbers added up, flags or'ed, whichever input they come from.

    Flags are packed into the bits of one number, as rows of more than a hundred fields fall out of generated code.
    """
    kinds = {f.name: f.dataType.typeName() for piece in pieces for f in piece.schema.fields if f.name != "space_id"}
    numbers = [n for n, kind in kinds.items() if kind != "boolean"]
    flags = {n: 1 << i for i, n in enumerate(n for n, kind in kinds.items() if kind == "boolean")}

    def packed(piece: DataFrame) -> DataFrame:
        own = [f"if({n}, {bit}L, 0L)" for n, bit in flags.items() if n in piece.columns]
        added = [f"coalesce({n}, 0L) as {n}" if n in piece.columns else f"0L as {n}" for n in numbers]
        return piece.selectExpr("space_id", *added, f"{' | '.join(own) or '0L'} as flags")

    rows = reduce(lambda a, b: a.union(b), map(packed, pieces))
    spaces = rows.groupBy("space_id").agg(*[F.sum(n).alias(n) for n in numbers], F.bit_or("flags").alias("flags"))
    return spaces.selectExpr("space_id", *numbers, *[f"(flags & {bit}L) != 0 as {n}" for n, bit in flags.items()])


def _each(df: DataFrame, name: str, n: int = 1) -> DataFrame:
    return df.select("space_id", F.lit(n).cast("long").alias(name))


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.select("space_id", F.lit(True).alias(name))


class _Parts:
    """Intermediate tables that several outputs read."""

    def __init__(self, estate: Estate, strict_compat: bool = False):
        e = estate
        self.estate = e
        self.members = member_facts(e, strict_compat)
        self.sqls = readers.sql_instructions(e.instructions)
        self.texts = readers.text_instructions(e.instructions)
        self.unknown = C.unknown_table_refs(self.sqls, e.space_tables, strict_compat)
        self.extra = extra_metric_views(e.space_tables, readers.metric_views(e.tables))

    def abbreviations(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Those in names of readable columns per space, those explained, and the fixed table of full terms."""
        e = self.estate
        readable = e.columns.join(e.tables.where("error is null").select("table_id"), "table_id", "left_semi")
        synonyms = readers.explode_synonyms(readers.parse_expressions(e.instructions))
        labels = joins.label_table(e.spaces.sparkSession)
        abbrevs = metadata.space_abbrevs(e.space_tables, readable)
        return abbrevs, metadata.explained_abbrevs(abbrevs, self.texts.select("space_id", "text"), synonyms, labels), labels

    @property
    def unmapped(self) -> DataFrame:
        abbrevs, explained, labels = self.abbreviations()
        return metadata.not_explained(abbrevs, explained, labels)

    @property
    def uncovered(self) -> DataFrame:
        return questions.uncovered_tables(self.estate.space_tables, self.estate.questions)


def space_items(estate: Estate, strict_compat: bool = False) -> DataFrame:
    """Every name behind the findings of a space: ``space_id, rule_id, ord, sub, item``.

    Columns are not repeated for each space of their table; they are in :func:`column_items`.
    """
    e, parts = estate, _Parts(estate, strict_compat)
    spelled = "concat(upper(abbrev), if(label is null, '', concat(' (', label, ')')))"
    uncovered = parts.uncovered.join(e.space_tables, ["space_id", "table_id"])
    tables = [
        member_items(parts.members),
        sql_items(parts.sqls, parts.unknown),
        text_items(parts.texts),
        gold_items(e.questions),
        _items(parts.unmapped, "'unmapped'", spelled),
        _items(uncovered, "'uncovered'", "lower(element_at(split(table_id, '[.]'), -1))", "ordinal"),
        parts.extra,
    ]
    return reduce(lambda a, b: a.unionByName(b), tables)


def space_facts(estate: Estate, strict_compat: bool = False, items: DataFrame | None = None) -> DataFrame:
    """One wide row per space; spaces without tables, instructions or questions are there with zeros.

    ``items``, the table made by :func:`space_items` and written beforehand, adds the names that messages
    show. Scores do without.
    """
    e = estate
    spaces = e.spaces.select("space_id", "title", X.text_of(F.col("description")).alias("description"), "warehouse_id")
    locked = readiness.locked_objects(e.acl)
    locked_warehouses = locked.where("object_type = 'warehouse'").select(
        F.col("object_id").alias("warehouse_id"), F.lit(True).alias("warehouse_locked")
    )
    per_warehouse = spaces.join(e.warehouses.select("warehouse_id", "is_serverless"), "warehouse_id", "left").join(
        locked_warehouses, "warehouse_id", "left"
    )
    locked_spaces = locked.where("object_type = 'space'").select(
        F.col("object_id").try_cast(spaces.schema["space_id"].dataType).alias("space_id")
    )
    parts = _Parts(estate, strict_compat)
    lacking = [f"not coalesce({element}, true) as lacks_{element}" for element in R.DESCRIPTION_ELEMENTS]
    pieces = [
        member_measures(parts.members),
        schema_measures(e.space_tables),
        *instruction_measures(e.instructions),
        C.text_joints(parts.texts),  # what spans two texts is added to what is in them
        question_measures(e.questions),
        questions.question_joint_asks(questions.samples(e.questions)),
        _flag(locked_spaces, "not_shared"),
        e.description_verdicts.selectExpr("space_id", *lacking),
    ]
    if items is None:
        # Counts of what is left over are differences, so that no set is subtracted from another before the shuffle.
        abbrevs, explained, _ = parts.abbreviations()
        variants = joins.name_variants(e.space_tables, shortest=True)
        counts = [
            _each(parts.unknown, "n_unknown"),
            _each(joins.question_mentions(variants, questions.samples(e.questions)), "n_mentioned"),
            _each(abbrevs, "n_unmapped"),
            _each(explained, "n_unmapped", -1),
            _flag(parts.extra, "has_extra_views"),
        ]
    else:
        counted = {"unknown_tables": "n_unknown", "uncovered": "n_uncovered", "unmapped": "n_unmapped"}
        counts = [
            items.selectExpr(
                "space_id",
                *[f"if(rule_id = '{rule}', 1L, 0L) as {n}" for rule, n in counted.items()],
                "rule_id = 'metric_views_extra' as has_extra_views",
            )
        ]
    # Rows that only count are many; they are added up in narrow rows before they join the others.
    pieces.append(summed(counts))
    wide = per_warehouse.join(summed(pieces), "space_id", "left")
    if items is None:
        unasked = "if(samples >= 3 and table_count >= 2, table_count - coalesce(n_mentioned, 0), 0L)"
        wide = wide.withColumn("n_uncovered", F.expr(unasked)).drop("n_mentioned")
    else:
        wide = wide.join(shown_names(items, space_column_items(e, 5)), "space_id", "left")
    named = [F.when(F.col(f"lacks_{element}"), label) for element, label in R.DESCRIPTION_ELEMENTS.items()]
    wide = wide.withColumn("desc_missing", X.kept(*named)).drop(*[f"lacks_{element}" for element in R.DESCRIPTION_ELEMENTS])
    return _completed(wide, with_names=items is not None)


def _completed(wide: DataFrame, with_names: bool) -> DataFrame:
    """Defaults for spaces that no input mentions, and the columns derived from others."""
    defaults = {"long": "0L", "boolean": "false"}
    own = ("space_id", "title", "description", "warehouse_id", "is_serverless")
    filled = []
    for field in wide.schema.fields:
        name, default = field.name, defaults.get(field.dataType.typeName())
        filled.append(name if name in own or default is None else f"coalesce({name}, {default}) as {name}")
    if not with_names:
        filled.append("cast(map() as map<string, array<string>>) as shown")
    return wide.selectExpr(*filled).selectExpr(
        "*",
        "table_count - mv_count as base_count",
        "coalesce(try_divide(described, total_cols) * 100, 0.0) as pct",
        f"{C.SECTIONS_FOUND} as sections",
        "directives > 0 as has_directives",
        f"schema_hits >= {R.SCHEMA_DUMP_FROM} as is_dump",
        "inline_sql as n_inline",
        "emphatic as n_emphatic",
        "long as n_long",
    ).drop(*C.SECTION_COLUMNS.values(), "inline_sql", "emphatic", "long")


def shown_names(items: DataFrame, columns: DataFrame) -> DataFrame:
    """Per space, a map from rule to the names its message shows: the first few, or all."""
    both = items.unionByName(columns)
    limit = F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair))[F.col("rule_id")]
    few = ranked(both.where(F.col("rule_id").isin(*SHOWN)), ["space_id", "rule_id"], ["ord", "sub", "item"], max(SHOWN.values()))
    few = few.where(F.col("rank") <= limit).drop("rank")
    shown = shown_items(few.unionByName(both.where(~F.col("rule_id").isin(*SHOWN))))
    return shown.groupBy("space_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rule_id", "shown"))).alias("shown")
    )


def space_counts(
    spaces: DataFrame,
    space_tables: DataFrame,
    table_constraints: DataFrame,
    table_tags: DataFrame,
    instructions: DataFrame,
    question_rows: DataFrame,
) -> DataFrame:
    """Sizes of each space: tables, joins, keyed and tagged tables, example SQL, samples, benchmarks."""
    keyed = readers.tables_with_keys(table_constraints).withColumn("k", F.lit(1))
    tagged = table_tags.select("table_id").distinct().withColumn("t", F.lit(1))
    tables = (
        space_tables.join(keyed, "table_id", "left")
        .join(tagged, "table_id", "left")
        .groupBy("space_id")
        .agg(F.count("*").alias("table_count"), F.count("k").alias("keyed"), F.count("t").alias("tagged"))
    )
    kind = F.col("instruction_type")
    is_join = (kind == "FROM_SNIPPET") & X.json_has_key(F.col("content"), "join")
    configured = instructions.groupBy("space_id").agg(
        F.count_if(is_join).alias("join_count"), F.count_if(kind == "SQL_INSTRUCTION").alias("sql")
    )
    asked = question_rows.groupBy("space_id").agg(
        F.count_if(F.col("question_type") == "SAMPLE_QUESTION").alias("samples"),
        F.count_if(F.col("question_type") == "BENCHMARK").alias("benchmarks"),
    )
    names = ["table_count", "join_count", "keyed", "tagged", "sql", "samples", "benchmarks"]
    return (
        spaces.select("space_id")
        .join(tables, "space_id", "left")
        .join(configured, "space_id", "left")
        .join(asked, "space_id", "left")
        .na.fill(0, names)
        .select("space_id", *names)
    )


def base_counts(spaces: DataFrame, space_tables: DataFrame, metric_views: DataFrame) -> DataFrame:
    """Number of base tables (all but metric views) of every space."""
    base = joins.base_tables(space_tables, metric_views).groupBy("space_id").agg(F.count("*").alias("base_count"))
    return spaces.select("space_id").join(base, "space_id", "left").na.fill(0, ["base_count"])
