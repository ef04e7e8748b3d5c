"""Next steps: for each area that is not good, what to do, worded by what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators.findings import (
    GAPS,
    OWN_LAYER,
    PATTERNS_MISSING,
    SECTIONS_MISSING,
    Sql,
    col,
    first,
    joined,
    listed,
    present,
    quote,
    say,
)


def severity_expr(score: Column) -> Column:
    return F.when(score == 1, R.SEVERITIES[1]).when(score == 2, R.SEVERITIES[2])


def severity(area_scores: DataFrame) -> DataFrame:
    """Severity of every area that is not good."""
    return area_scores.where("score < 3").select("space_id", "area", severity_expr(F.col("score")).alias("severity"))


ALWAYS = "true"
NEEDED = "greatest(0, base_count - 1)"
PERCENT = Sql("cast(cast(bround(pct, 0) as bigint) as string)")
NO_LAYER = f"{OWN_LAYER} and expr_count = 0"
PART_LAYER = f"{OWN_LAYER} and expr_count > 0"
DESCRIBE = "Describe the space: purpose, key metrics, dimensions, grain, users"
LAYER = "Expressions: define measures, synonyms, dimensions and filters, or add metric views"
UNMAPPED = (
    "n_unmapped > 0",
    say("Explain abbreviations by a synonym or a business term: ", listed("unmapped", "n_unmapped", ticks=False)),
)
KEYS_MISSING = listed("missing_keys", "n_missing_keys", 4, ticks=False)

# Items of each area by score, each with the condition under which it is given.
ITEMS: dict[int, dict[int, list[tuple[str, str]]]] = {
    0: {
        1: [
            ("join_count = 0 and keyed = 0", say("Blocking: neither joins nor keys for ", col("table_count"), " tables; configure joins or add primary and foreign keys")),
            ("join_count > 0 and keyed = 0", "Add primary and foreign keys so that joins need not all be configured by hand"),
            ("not_shared", "Blocking: share the space with its users (CAN_USE)"),
            ("warehouse_locked", "Blocking: let users run queries on the warehouse (CAN_USE)"),
            ("ungranted_count > 0", say("Grant SELECT to those who need it on: ", first("ungranted", 4))),
        ],
        2: [
            (f"table_count > 1 and join_count < {NEEDED}", say("Only ", col("join_count"), " of about ", col(NEEDED), " joins are configured; add the missing ones")),
            ("keyed = 0 and table_count > 0", "Add primary and foreign keys to help resolve joins"),
            ("keyed > 0 and keyed < table_count", say("Keys are still missing on: ", KEYS_MISSING)),
            ("not_shared", "Share the space with its users (CAN_USE)"),
            ("warehouse_locked", "Let users run queries on the warehouse (CAN_USE)"),
            ("ungranted_count > 0", say("Grant SELECT beyond the owner on: ", listed("ungranted", "ungranted_count", 4))),
            ("unknown_grant_count > 0", say("Check grants on ", col("unknown_grant_count"), " table(s) with an administrator")),
            (ALWAYS, "Look through the findings on ownership, warehouse type and tags"),
        ],
    },
    1: {
        1: [
            (ALWAYS, say("Rebuild the scope: ", col("table_count"), " tables are too many; start again from one business domain")),
            (ALWAYS, "Split the tables into two to four focused spaces"),
            (ALWAYS, "Do not let users in before the space holds ten tables or fewer"),
            (ALWAYS, "Replace raw, bronze and silver tables with gold or semantic ones"),
            ("n_non_gold > 0 or n_unclear > 0", say("Tag the layer of every table before rebuilding", Sql(f"case when n_non_gold > 0 then {say('; below gold: ', first('non_gold', 3, ticks=False))} else '' end"))),
            (ALWAYS, "Hide the columns of wide tables that users do not need, or offer narrower views"),
            (ALWAYS, DESCRIBE),
        ],
        2: [
            (ALWAYS, "Keep only the tables the use case needs"),
            ("not coalesce(description, '') rlike r'(?U)\\S'", DESCRIBE),
            ("n_non_gold > 0", say("Replace tables below gold: ", first("non_gold", 5, ticks=False))),
            ("n_wide > 0", say("Narrow the wide tables: ", first("wide", 3, ticks=False))),
            ("n_unclear > 0", say("Tag the layer of ", col("n_unclear"), " table(s) whose layer is unclear")),
            (ALWAYS, "Hide internal ids, load metadata and outdated columns"),
        ],
    },
    2: {
        1: [
            ("pct < 80", say("Blocking: only ", PERCENT, "% of columns are described; raise it above 80%")),
            ("pct < 80", say("Describe the ", col("total_cols - described"), " remaining columns, those used in filters, aggregates and joins first")),
            ("pct < 80", "Add column comments in bulk with ALTER TABLE ... ALTER COLUMN ... COMMENT"),
            ("pct >= 80", say(PERCENT, "% of columns are described, but coded columns and dates stored as text stand in the way")),
            ("n_no_comment = table_count", "Comment every table: grain, scope, key metrics"),
            (ALWAYS, "Explain the values of coded columns in their comments, such as A=Active, I=Inactive, and enable value matching"),
            ("n_date_string > 0", "Turn dates and times stored as text into DATE or TIMESTAMP"),
            UNMAPPED,
        ],
        2: [
            (ALWAYS, say(PERCENT, "% of columns are described; fill the ", col("total_cols - described"), " gaps, flagged columns first")),
            ("n_thin > 0", say("Expand short table comments: ", first("thin_comment", 3, ticks=False))),
            ("n_no_comment > 0", say("Comment these tables: ", first("no_comment", 3, ticks=False))),
            (ALWAYS, "Replace key shorthand in comments with plain words, such as: links to the customer record"),
            ("n_coded > 0", say("Explain the values of coded columns: ", listed("coded", "n_coded", 4, ticks=False))),
            ("n_date_string > 0", say("Turn into DATE or TIMESTAMP: ", first("date_string", 3, ticks=False))),
            UNMAPPED,
        ],
    },
    3: {
        1: [
            ("sql_sub = 1", say("Example SQL: ", Sql("case when sql = 0 then 'none' else concat('only ', sql) end"), "; add 10 to 15, starting with aggregates, date filters, joins, top-N and comparisons")),
            ("sql_sub = 1", "Make every example a complete, tested query"),
            ("text_sub = 1", say("Text instructions: ", Sql("case when text_count = 0 then 'write them' else 'rewrite them' end"))),
            ("text_sub = 1", "Use four sections: role, critical rules, business terms, date handling"),
            ("text_sub = 1", "Keep the text to 100 lines of rules that neither metadata nor example SQL can tell"),
            (NO_LAYER, LAYER),
        ],
        2: [
            ("sql_sub < 3", Sql(f"case when sql < 10 then {say('Example SQL: add ', col('10 - sql'), ' to reach 10')} else {say('Example SQL: ', col('sql'), ' are enough; mend what is flagged')} end")),
            (f"sql_sub < 3 and size({PATTERNS_MISSING}) > 0", say("Add examples of: ", joined(PATTERNS_MISSING, ", "))),
            ("sql_sub < 3 and n_hardcoded > 0", say("Replace hardcoded values by parameters in: ", first("hardcoded_sql", 3, "; ", False))),
            (f"sql_sub < 3 and size({GAPS}) > 0", say("Add examples that match the sample questions, which ask for ", joined(GAPS, "; "))),
            ("text_sub < 3 and n_inline > 0", say("Move SQL out of the text: ", first("inline_sql", 2, "; ", False))),
            ("text_sub < 3 and metric_hits > 0", "Move metric definitions from the text to expressions"),
            ("text_sub < 3 and join_hits > 0", "Move table relationships from the text to the joins"),
            (f"text_sub < 3 and size({SECTIONS_MISSING}) > 0", say("Add text sections: ", joined(SECTIONS_MISSING, ", "))),
            (f"text_sub < 3 and lines > {R.MAX_TEXT_LINES}", "Cut the text to 100 lines"),
            ("text_sub < 3", "Redraft the text instructions"),
            ("base_count > 1 and join_count > 0 and join_count < base_count - 1", say("Check the joins of all ", col("base_count"), " base tables; only ", col("join_count"), " found")),
            (NO_LAYER, LAYER),
            (f"{PART_LAYER} and n_measures = 0", "Expressions: add measures for key metrics"),
            (f"{PART_LAYER} and n_synonyms = 0", "Expressions: add synonyms for abbreviations and other names"),
        ],
    },
    4: {
        1: [
            (ALWAYS, Sql(f"case when samples = 0 then {say('Urgent: no sample question, so users start from a blank page')} else {say('Urgent: only ', col('samples'), ' sample question(s)')} end")),
            (ALWAYS, "Write ten or more questions now"),
            (ALWAYS, "Even five good questions help first-time users a great deal"),
            (ALWAYS, "Cover every major metric and every kind of user at least once"),
        ],
        2: [
            (ALWAYS, say("Add ", col("greatest(0, 10 - samples)"), " more sample questions to reach 10")),
            (ALWAYS, "Vary the questions across kinds of user"),
            (ALWAYS, "Ask at least once for every major metric"),
            (ALWAYS, "Word questions as users would, not like SQL"),
            ("n_uncovered > 0", say("Ask about the tables no question mentions, or drop them: ", listed("uncovered", "n_uncovered"))),
        ],
    },
    5: {
        1: [
            (ALWAYS, Sql(f"case when benchmarks = 0 then {say('Blocking: no benchmark, so accuracy cannot be measured')} else {say('Blocking: only ', col('benchmarks'), ' benchmark(s), so accuracy can hardly be measured')} end")),
            (ALWAYS, "Do not show the space to users before five benchmarks pass"),
            (ALWAYS, "Take the five most important sample questions as first benchmarks"),
            (ALWAYS, "Give every benchmark a tested SQL as the expected answer"),
            (ALWAYS, "Run the benchmarks after every change"),
        ],
        2: [
            (ALWAYS, say(col("benchmarks"), " benchmarks; add ", col("greatest(0, 15 - benchmarks)"), " more to reach 15")),
            (ALWAYS, "Run the benchmarks now and note the pass rate"),
            (ALWAYS, "Cover every metric and dimension, from simple to complex"),
            (ALWAYS, "Mix fixed dates, relative periods and year-over-year questions"),
            ("n_missing_gold > 0", say("Add the expected SQL to ", col("n_missing_gold"), " benchmark(s)")),
            (ALWAYS, "Reach a pass rate of 80% before letting users in"),
        ],
    },
}


def steps(area: int) -> str:
    """SQL of the next steps of one area for the row, none where the area is good."""
    cases = " ".join(f"when score_{area} = {score} then {present(items)}" for score, items in ITEMS[area].items())
    return f"case {cases} else {X.NO_ARRAY} end"


def _numbered(area: int) -> str:
    levels = " ".join(f"when {score} then {quote(name)}" for score, name in R.SEVERITIES.items())
    return (
        f"transform({steps(area)}, (x, i) -> named_struct('area', {area}, "
        f"'severity', case score_{area} {levels} end, 'seq', i + 1, 'item', x))"
    )


def area_items(scored: DataFrame, areas: Sequence[int] = tuple(R.AREAS)) -> DataFrame:
    """Numbered next steps: ``space_id, area, severity, seq, item``."""
    return scored.selectExpr("space_id", f"inline(concat({', '.join(_numbered(a) for a in areas)}))")
