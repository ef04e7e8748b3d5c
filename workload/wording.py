"""What findings say, put together in DuckDB SQL from the checking query's own facts.

``o_scores s`` gives counts, and ``o_names n`` the names of a space's tables under each rule, in order. Rules whose
names come from columns, SQL texts or abbreviations are checked by rule and place only (``UNWORDED``).
"""

from __future__ import annotations

# Names of tables, by rule: condition on o_member_rules, and how a name is written.
NAMED = {
    "missing_keys": ("not is_keyed", "short"),
    "unowned": ("coalesce(owner, '') = ''", "short"),
    "ungranted": ("readable and not ext", "short"),
    "grants_unknown": ("not readable", "short"),
    "metric_views_in_space": ("is_mv", "lower(short)"),
    "non_gold": ("layer = 'non_gold'", "short || case when layer_tag is null then '' else ' (tagged: ' || layer_tag || ')' end"),
    "unclear_layer": ("layer = 'unclear'", "short"),
    "wide": ("n_cols > 50", "short || ' (' || n_cols || ' cols)'"),
    "undocumented": ("error is null and n_described = 0", "short"),
    "no_comment": ("no_comment", "short"),
    "thin_comment": ("thin", "'`' || short || '` (' || length(trim(comment)) || ' chars)'"),
    "restricted": ("has_row_filter or has_col_mask", "short"),
}

NAMES_SQL = (
    "select m.space_id, "
    + ", ".join(f"list({text} order by ordinal) filter (where {cond}) as l_{rule}" for rule, (cond, text) in NAMED.items())
    + ", list(lower(short) order by ordinal) filter (where u.table_id is not null) as l_uncovered from o_member_rules m "
    "left join (select distinct space_id, table_id from o_uncovered) u on u.space_id = m.space_id and u.table_id = m.table_id "
    "group by m.space_id"
)


def some(rule: str, k: int | None = None, ticks: bool = True) -> str:
    """The first ``k`` names, or all, and how many follow."""
    names = f"coalesce(l_{rule}, [])"
    shown = names if k is None else f"{names}[1:{k}]"
    shown = f"list_transform({shown}, lambda x: '`' || x || '`')" if ticks else shown
    more = "" if k is None else f" || case when len({names}) > {k} then ' (+' || (len({names}) - {k}) || ' more)' else '' end"
    return f"(array_to_string({shown}, ', '){more})"


def those(options: dict[str, str], sep: str) -> str:
    cases = ", ".join(f"case when {cond} then '{text}' end" for text, cond in options.items())
    return f"array_to_string(list_filter([{cases}], lambda x: x is not null), '{sep}')"


PATTERN_WORDS = dict(zip(
    ("multi-table joins", "date or time filters", "aggregations (SUM, COUNT, GROUP BY)", "top-N rankings (ORDER BY with LIMIT)", "comparisons of periods"),
    ("not has_join and table_count > 1", "not has_date", "not has_agg", "not has_topn", "not has_compare"), strict=True))
GAP_WORDS = {
    "time trends, but no example SQL filters by time": "gap_time",
    "several tables at once, but no example SQL joins tables": "gap_join",
    "rankings, but no example SQL orders and limits": "gap_topn",
    "comparisons, but no example SQL compares periods": "gap_compare",
}

UNWORDED = ("metric_views_extra", "metric_views_only_in_catalog", "generic", "technical", "coded", "date_string", "unmapped",
            "hardcoded_sql", "unknown_tables", "inline_sql", "missing_sections", "hardcoded_gold", "incomplete_description")

MESSAGES = {
    "no_joins": "'No joins configured for ' || table_count || ' tables; define joins so that questions over several tables work'",
    "no_keys": "'No table has a primary or foreign key; add keys so that join paths can be inferred'",
    "missing_keys": f"'No primary or foreign key on: ' || {some('missing_keys', 5, False)} || '; add keys so that join paths can be resolved'",
    "unowned": f"'Tables without an owner: ' || {some('unowned', 5, False)} || '; assign owners'",
    "not_serverless": "'The SQL warehouse is not serverless; a serverless one starts faster and scales by itself'",
    "not_shared": "'No user or group holds CAN_USE on the space; share it before people are asked to use it'",
    "warehouse_locked": "'Only admins may use the SQL warehouse; grant CAN_USE or people''s queries will fail'",
    "ungranted": f"'Tables that only their owner may read (' || ungranted_count || '): ' || {some('ungranted', 5)} || '; grant SELECT to those who need it'",
    "grants_unknown": f"'Grants could not be read on ' || unknown_grant_count || ' table(s): ' || {some('grants_unknown', 3, False)} || '; check them with an administrator'",
    "no_tags": "'No table carries a tag; tag domain, classification and sensitivity'",
    "metric_views_in_space": f"'OK: metric views in the space: ' || {some('metric_views_in_space')} || '; measures and dimensions are defined in the catalog'",
    "schema_spread": "'Tables come from ' || n_schemas || ' schemas; consider one space per domain'",
    "too_many_tables": "base_count || ' base tables are too many; answers get worse beyond 9' || case when mv_count > 0 then ' (' || mv_count || ' metric view(s) not counted)' else '' end",
    "non_gold": f"'Tables below the gold layer: ' || {some('non_gold', None, False)} || '; replace them with gold or semantic ones'",
    "unclear_layer": f"'Layer unclear for: ' || {some('unclear_layer', 5)} || '; tag the layer, such as layer = gold'",
    "wide": f"'Tables with more than 50 columns: ' || {some('wide', None, False)} || '; hide columns or offer a narrower view'",
    "no_description": "'The space has no description; state purpose, key metrics, dimensions, grain and users'",
    "short_description": "'The description is short (' || length(description) || ' characters); add key metrics, dimensions, grain and users'",
    "undocumented": f"'Tables without any described column: ' || {some('undocumented')}",
    "no_comment": f"'Tables without a comment: ' || {some('no_comment')}",
    "thin_comment": f"'Tables with a comment under 50 characters: ' || {some('thin_comment', None, False)} || '; describe grain, scope, key metrics and links'",
    "restricted": f"'Tables with row filters or column masks: ' || {some('restricted', 5)} || '; results may be incomplete for some users'",
    "no_sql": "'Example SQL: none; add 10 to 15 that cover all query patterns'",
    "few_sql": "'Example SQL: only ' || sql || '; add up to 10 to 15'",
    "no_parameterised_sql": "'Example SQL: none has parameters (:param_name), so no answer can be marked as trusted'",
    "missing_patterns": f"'Example SQL: no example of ' || {those(PATTERN_WORDS, ', ')}",
    "no_text": "'Text instructions: none; state role, critical rules, business terms and date handling in at most 100 lines'",
    "metric_prose": "'Text instructions define metrics; move them to expressions or column comments'",
    "join_prose": "'Text instructions describe table relationships; move them to the joins'",
    "long_text": "'Text instructions: ' || lines || ' lines; keep to 100'",
    "vague_text": "'Text instructions are vague; write directives such as: when asked X, do Y'",
    "few_joins": "'Joins: only ' || join_count || ' for ' || base_count || ' base tables' || case when mv_count > 0 then ' (and ' || mv_count || ' metric view(s) with their own joins)' else '' end || '; check that every relationship is configured'",
    "no_expressions": "'Expressions: no measure, dimension, filter or synonym; define key metrics and synonyms'",
    "no_measures": "'Expressions: no measure; define key metrics'",
    "no_synonyms": "'Expressions: no synonym; add abbreviations and other names'",
    "few_expressions": "'Expressions: only ' || expr_count || '; add more measures, dimensions, filters and synonyms'",
    "misaligned_questions": f"'Sample questions ask for ' || {those(GAP_WORDS, '; ')} || '. Match the example SQL to the questions'",
    "no_samples": "'No sample question: users start from a blank page'",
    "few_samples": "'Only ' || samples || ' sample questions; offer 10 or more'",
    "sample_diversity": "'Check by hand that the questions cover different metrics, dimensions, periods and kinds of user'",
    "uncovered": f"'Tables no sample question mentions (' || n_uncovered || '): ' || {some('uncovered')} || '; add a question for each'",
    "no_benchmarks": "'No benchmark; add at least 5 pairs of question and SQL'",
    "few_benchmarks": "'Only ' || benchmarks || case when benchmarks = 1 then ' benchmark' else ' benchmarks' end || '; add up to 15 or more, simple to complex'",
    "some_benchmarks": "'Only ' || benchmarks || ' benchmarks; 15 to 30 should cover every key metric and dimension'",
    "missing_gold": "n_missing_gold || ' benchmark(s) without expected SQL'",
}
