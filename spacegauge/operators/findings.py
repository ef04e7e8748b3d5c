"""Findings: for each rule, when it applies to a space and what it says.

Rules read one wide row per space (see ``plans.facts``) and are stated as SQL text: a condition, and a
message put together from wording and columns. ``shown`` maps a rule to the first names it concerns;
the whole list of names is the items table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X

# Patterns of example SQL, with the wording used where one is missing.
MISSING_PATTERNS = {
    "has_join": "multi-table joins",
    "has_date": "date or time filters",
    "has_agg": "aggregations (SUM, COUNT, GROUP BY)",
    "has_topn": "top-N rankings (ORDER BY with LIMIT)",
    "has_compare": "comparisons of periods",
}


class Sql(str):
    """SQL text, told apart from plain wording."""


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def say(*parts: str) -> Sql:
    """A message: wording is quoted, :class:`Sql` is evaluated."""
    if len(parts) == 1:
        return parts[0] if isinstance(parts[0], Sql) else Sql(quote(parts[0]))
    return Sql("concat(" + ", ".join(p if isinstance(p, Sql) else quote(p) for p in parts) + ")")


def col(name: str) -> Sql:
    return Sql(f"cast({name} as string)")


def present(options: Sequence[tuple[str, str]]) -> Sql:
    """Array of the texts whose condition holds."""
    cases = ", ".join(f"case when {cond} then {say(text)} end" for cond, text in options)
    return Sql(f"filter(array({cases}), x -> x is not null)")


def joined(array: str, sep: str) -> Sql:
    return Sql(f"array_join({array}, {quote(sep)})")


def _names(rule_id: str, k: int | None, ticks: bool) -> str:
    names = f"coalesce(try_element_at(shown, {quote(rule_id)}), {X.NO_ARRAY})"
    if k is not None:
        names = f"slice({names}, 1, {k})"
    return f"transform({names}, n -> concat('`', n, '`'))" if ticks else names


def first(rule_id: str, k: int | None = None, sep: str = ", ", ticks: bool = True) -> Sql:
    """The first names, without saying how many follow."""
    return joined(_names(rule_id, k, ticks), sep)


def listed(rule_id: str, total: str, k: int | None = None, sep: str = ", ", ticks: bool = True) -> Sql:
    """The first names as ``a, b, c (+N more)``."""
    more = f"({total} - size({_names(rule_id, k, False)}))"
    return Sql(
        f"concat({first(rule_id, k, sep, ticks)}, case when {more} > 0 then concat(' (+', {more}, ' more)') else '' end)"
    )


PATTERNS_MISSING = present(
    [
        (f"not {c} and table_count > 1" if c == "has_join" else f"not {c}", text)
        for c, text in MISSING_PATTERNS.items()
    ]
)
SECTIONS_MISSING = Sql(f"array_except(array({', '.join(quote(s) for s in R.SECTIONS)}), sections)")
# What sample questions ask for and no example SQL shows, in spaces with three samples at least.
GAPS = present(
    [
        ("samples >= 3 and asks_time and not has_date", "time trends, but no example SQL filters by time"),
        (
            "samples >= 3 and asks_join and not has_join and table_count > 1",
            "several tables at once, but no example SQL joins tables",
        ),
        ("samples >= 3 and asks_topn and not has_topn", "rankings, but no example SQL orders and limits"),
        ("samples >= 3 and asks_compare and not has_compare", "comparisons, but no example SQL compares periods"),
    ]
)
DEFECTS = present(
    [
        ("coalesce(is_dump, false)", "reads like a data dictionary"),
        ("n_inline > 0", "holds inline SQL"),
        ("n_emphatic > 0", "holds emphatic overrides"),
        (f"lines > {R.MAX_TEXT_LINES}", say("too long: ", col("lines"), " lines")),
    ]
)


def alignment_gaps_expr() -> Column:
    return F.expr(GAPS)


def text_defects_expr() -> Column:
    return F.expr(DEFECTS)


class Finding(NamedTuple):
    rule_id: str
    area: int
    applies: str
    message: Sql


OWN_LAYER = "mv_count = 0"
LINES = R.MAX_TEXT_LINES
SHORT = R.SHORT_DESCRIPTION_CHARS
DESCRIPTION = "length(regexp_replace(coalesce(description, ''), r'(?U)^\\s+|\\s+\\z', ''))"

# Area 0, readiness.
_READINESS = [
    ("no_joins", "table_count > 1 and join_count = 0",
     say("No joins configured for ", col("table_count"), " tables; define joins so that questions over several tables work")),
    ("no_keys", "keyed = 0 and table_count > 1",
     say("No table has a primary or foreign key; add keys so that join paths can be inferred")),
    ("missing_keys", "keyed > 0 and keyed < table_count",
     say("No primary or foreign key on: ", listed("missing_keys", "n_missing_keys", 5, ticks=False), "; add keys so that join paths can be resolved")),
    ("unowned", "unowned_count > 0",
     say("Tables without an owner: ", listed("unowned", "unowned_count", 5, ticks=False), "; assign owners")),
    ("not_serverless", "is_serverless = false",
     say("The SQL warehouse is not serverless; a serverless one starts faster and scales by itself")),
    ("not_shared", "not_shared",
     say("No user or group holds CAN_USE on the space; share it before people are asked to use it")),
    ("warehouse_locked", "warehouse_locked",
     say("Only admins may use the SQL warehouse; grant CAN_USE or people's queries will fail")),
    ("ungranted", "ungranted_count > 0",
     say("Tables that only their owner may read (", col("ungranted_count"), "): ", listed("ungranted", "ungranted_count", 5), "; grant SELECT to those who need it")),
    ("grants_unknown", "unknown_grant_count > 0",
     say("Grants could not be read on ", col("unknown_grant_count"), " table(s): ", listed("grants_unknown", "unknown_grant_count", 3, ticks=False), "; check them with an administrator")),
    ("no_tags", "base_tagged_count = 0 and base_count > 0",
     say("No table carries a tag; tag domain, classification and sensitivity")),
    ("metric_views_in_space", "mv_count > 0",
     say("OK: metric views in the space: ", listed("metric_views_in_space", "mv_count"), "; measures and dimensions are defined in the catalog")),
    ("metric_views_extra", "mv_count > 0 and has_extra_views",
     say("Further metric views in the catalog, not in the space: ", first("metric_views_extra", 3), "; add those that cover its metrics")),
    ("metric_views_only_in_catalog", "mv_count = 0 and has_extra_views",
     say("Metric views in the catalog but none in the space: ", first("metric_views_extra", 5), "; add them rather than maintain expressions by hand")),
]

# Area 1, curation.
_CURATION = [
    ("schema_spread", "n_schemas > 1",
     say("Tables come from ", col("n_schemas"), " schemas; consider one space per domain")),
    ("too_many_tables", "base_count > 9",
     say(col("base_count"), " base tables are too many; answers get worse beyond 9", Sql(f"case when mv_count > 0 then {say(' (', col('mv_count'), ' metric view(s) not counted)')} else '' end"))),
    ("non_gold", "n_non_gold > 0",
     say("Tables below the gold layer: ", listed("non_gold", "n_non_gold", ticks=False), "; replace them with gold or semantic ones")),
    ("unclear_layer", "n_unclear > 0",
     say("Layer unclear for: ", listed("unclear_layer", "n_unclear", 5), "; tag the layer, such as layer = gold")),
    ("wide", "n_wide > 0",
     say("Tables with more than 50 columns: ", listed("wide", "n_wide", ticks=False), "; hide columns or offer a narrower view")),
    ("no_description", f"{DESCRIPTION} = 0",
     say("The space has no description; state purpose, key metrics, dimensions, grain and users")),
    ("short_description", f"{DESCRIPTION} between 1 and {SHORT - 1}",
     say("The description is short (", col(DESCRIPTION), " characters); add key metrics, dimensions, grain and users")),
    ("incomplete_description", f"{DESCRIPTION} >= {SHORT} and size(coalesce(desc_missing, {X.NO_ARRAY})) >= 2",
     say("The description lacks: ", joined("desc_missing", ", "))),
]

# Area 2, metadata.
_METADATA = [
    ("undocumented", "n_undocumented > 0",
     say("Tables without any described column: ", listed("undocumented", "n_undocumented"))),
    ("no_comment", "n_no_comment > 0",
     say("Tables without a comment: ", listed("no_comment", "n_no_comment"))),
    ("thin_comment", "n_thin > 0",
     say("Tables with a comment under 50 characters: ", listed("thin_comment", "n_thin", ticks=False), "; describe grain, scope, key metrics and links")),
    ("generic", "n_generic > 0",
     say("Generic or technical column comments: ", listed("generic", "n_generic", 5))),
    ("technical", "n_technical > 0",
     say("Technical column names without a comment (", col("n_technical"), "): ", listed("technical", "n_technical", 4), "; comment them or give them a display name")),
    ("coded", "n_coded > 0",
     say("Coded columns whose values are not explained (", col("n_coded"), "): ", listed("coded", "n_coded", 4), "; list the values in the comment, such as A=Active, I=Inactive")),
    ("date_string", "n_date_string > 0",
     say("Dates or times stored as text (", col("n_date_string"), "): ", first("date_string", 3), "; use DATE or TIMESTAMP")),
    ("restricted", "n_restricted > 0",
     say("Tables with row filters or column masks: ", listed("restricted", "n_restricted", 5), "; results may be incomplete for some users")),
    ("unmapped", "n_unmapped > 0",
     say("Abbreviations in column names that no synonym or instruction explains (", col("n_unmapped"), "): ", listed("unmapped", "n_unmapped", ticks=False), "; add a synonym or a business term for each")),
]

# Area 3, configuration.
_CONFIGURATION = [
    ("no_sql", "sql = 0", say("Example SQL: none; add 10 to 15 that cover all query patterns")),
    ("few_sql", "sql between 1 and 9", say("Example SQL: only ", col("sql"), "; add up to 10 to 15")),
    ("hardcoded_sql", "n_hardcoded > 0",
     say("Example SQL with hardcoded values: ", first("hardcoded_sql", 3, "; ", False), "; use :param_name")),
    ("no_parameterised_sql", "sql > 0 and not has_param",
     say("Example SQL: none has parameters (:param_name), so no answer can be marked as trusted")),
    ("missing_patterns", f"sql > 0 and size({PATTERNS_MISSING}) > 0",
     say("Example SQL: no example of ", joined(PATTERNS_MISSING, ", "))),
    ("unknown_tables", "n_unknown > 0",
     say("Example SQL reads tables that are not in the space (", col("n_unknown"), "): ", listed("unknown_tables", "n_unknown", 3, "; ", False))),
    ("no_text", "text_count = 0",
     say("Text instructions: none; state role, critical rules, business terms and date handling in at most 100 lines")),
    ("inline_sql", "n_inline > 0",
     say("Text instructions: SQL in ", col("n_inline"), " block(s) (", first("inline_sql", 2, "; ", False), "); move it to the example SQL")),
    ("metric_prose", "text_count > 0 and metric_hits > 0",
     say("Text instructions define metrics; move them to expressions or column comments")),
    ("join_prose", "text_count > 0 and join_hits > 0",
     say("Text instructions describe table relationships; move them to the joins")),
    ("missing_sections", f"text_count > 0 and size({SECTIONS_MISSING}) > 0",
     say("Text instructions lack sections: ", joined(SECTIONS_MISSING, ", "))),
    ("long_text", f"lines > {LINES}", say("Text instructions: ", col("lines"), " lines; keep to 100")),
    ("vague_text", f"text_count > 0 and lines <= {LINES} and vague_hits >= 2 and not has_directives",
     say("Text instructions are vague; write directives such as: when asked X, do Y")),
    ("few_joins", "base_count > 1 and join_count > 0 and join_count < base_count - 1",
     say("Joins: only ", col("join_count"), " for ", col("base_count"), " base tables", Sql(f"case when mv_count > 0 then {say(' (and ', col('mv_count'), ' metric view(s) with their own joins)')} else '' end"), "; check that every relationship is configured")),
    ("no_expressions", f"{OWN_LAYER} and expr_count = 0",
     say("Expressions: no measure, dimension, filter or synonym; define key metrics and synonyms")),
    ("no_measures", f"{OWN_LAYER} and expr_count > 0 and n_measures = 0",
     say("Expressions: no measure; define key metrics")),
    ("no_synonyms", f"{OWN_LAYER} and expr_count > 0 and n_synonyms = 0",
     say("Expressions: no synonym; add abbreviations and other names")),
    ("few_expressions", f"{OWN_LAYER} and expr_count between 1 and 2",
     say("Expressions: only ", col("expr_count"), "; add more measures, dimensions, filters and synonyms")),
    ("misaligned_questions", f"size({GAPS}) > 0",
     say("Sample questions ask for ", joined(GAPS, "; "), ". Match the example SQL to the questions")),
]

# Area 4, sample questions.
_SAMPLES = [
    ("no_samples", "samples = 0", say("No sample question: users start from a blank page")),
    ("few_samples", "samples between 1 and 9", say("Only ", col("samples"), " sample questions; offer 10 or more")),
    ("sample_diversity", "samples > 0",
     say("Check by hand that the questions cover different metrics, dimensions, periods and kinds of user")),
    ("uncovered", "n_uncovered > 0",
     say("Tables no sample question mentions (", col("n_uncovered"), "): ", listed("uncovered", "n_uncovered"), "; add a question for each")),
]

# Area 5, benchmarks.
_BENCHMARKS = [
    ("no_benchmarks", "benchmarks = 0", say("No benchmark; add at least 5 pairs of question and SQL")),
    ("few_benchmarks", "benchmarks between 1 and 4",
     say("Only ", col("benchmarks"), Sql("case when benchmarks = 1 then ' benchmark' else ' benchmarks' end"), "; add up to 15 or more, simple to complex")),
    ("some_benchmarks", "benchmarks between 5 and 14",
     say("Only ", col("benchmarks"), " benchmarks; 15 to 30 should cover every key metric and dimension")),
    ("missing_gold", "n_missing_gold > 0", say(col("n_missing_gold"), " benchmark(s) without expected SQL")),
    ("hardcoded_gold", "n_hardcoded_gold > 0",
     say("Benchmark SQL with hardcoded values: ", first("hardcoded_gold", 2, "; ", False))),
]

RULES = [
    Finding(rule_id, area, applies, message)
    for area, rules in enumerate((_READINESS, _CURATION, _METADATA, _CONFIGURATION, _SAMPLES, _BENCHMARKS))
    for rule_id, applies, message in rules
]


def finding(facts: DataFrame, rule_id: str) -> DataFrame:
    """The spaces one rule applies to, with its message."""
    rule = next(f for f in RULES if f.rule_id == rule_id)
    return facts.where(rule.applies).selectExpr("space_id", f"{rule.message} as message")


def _exploded(facts: DataFrame, rules: Sequence[Finding], with_message: bool) -> DataFrame:
    """Findings that apply, numbered within their area.

    Which rules apply is kept as one bit each, so that a message is made only where it is said and its
    number is the count of bits up to its own.
    """
    areas = {f.area: [g for g in rules if g.area == f.area] for f in rules}
    bits = [
        " + ".join(f"if({f.applies}, {1 << i}L, 0L)" for i, f in enumerate(group)) + f" as applies_{area}"
        for area, group in areas.items()
    ]
    rows = []
    for area, group in areas.items():
        for i, f in enumerate(group):
            number = f"bit_count(applies_{area} & {(2 << i) - 1}L)"
            said = f"applies_{area} & {1 << i}L != 0"
            message = f", 'message', if({said}, {f.message}, null)" if with_message else ""
            rows.append(
                f"named_struct('area', {area}, 'seq', {number}, "
                f"'rule_id', if({said}, {quote(f.rule_id)}, null){message})"
            )
    marked = facts.selectExpr("*", *bits)
    return marked.selectExpr("space_id", f"inline(array({', '.join(rows)}))").where("rule_id is not null")


def area_findings(
    facts: DataFrame, area: int, only: Sequence[str] | None = None, with_message: bool = True
) -> DataFrame:
    """Findings of one area, numbered in rule order; ``only`` limits the rules to those named."""
    rules = [f for f in RULES if f.area == area and (only is None or f.rule_id in only)]
    return _exploded(facts, rules, with_message)


def findings(facts: DataFrame, with_message: bool = True) -> DataFrame:
    """Findings of all areas: ``space_id, area, seq, rule_id, message``."""
    return _exploded(facts, RULES, with_message)


def messages(area: int) -> str:
    """SQL of the messages of one area that apply to the row, in rule order."""
    return present([(f.applies, f.message) for f in RULES if f.area == area])
