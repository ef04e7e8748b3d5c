"""Shared parts of the checking queries: one SQL text per intermediate table, named like the table.

A checking query names the parts it needs; :func:`compose` puts them in front of it as CTEs.
"""

from __future__ import annotations

import re

from spacegauge.functions import rules as R
from workload.bindings import BINDINGS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pat(rule: R.Rule) -> str:
    return lit(f"(?{rule.flags}){rule.pattern}" if rule.flags else rule.pattern)


def has(col: str, rule: R.Rule) -> str:
    return f"regexp_matches(coalesce({col}, ''), {pat(rule)})"


def cnt(col: str, rule: R.Rule) -> str:
    return f"len(regexp_extract_all(coalesce({col}, ''), {pat(rule)}))"


def names(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def lines(col: str) -> str:
    return f"(case when {col} = '' then 0 else len(string_split(regexp_replace({col}, '\\n\\z', ''), chr(10))) end)"


SQL_FLAGS = ", ".join(f"{has('content', r)} as {n}" for n, r in R.SQL_PATTERNS.items())
FLAG_NAMES = [*R.SQL_PATTERNS, "has_param"]
SECTIONS = {name: "sec_" + name.split()[0] for name in R.SECTIONS}
JOINED = {"metric_hits": R.METRIC_PROSE, "join_hits": R.JOIN_PROSE, "vague_hits": R.VAGUE}
STRING_TYPES = names(R.STRING_TYPES)

PARTS: dict[str, str] = {
    **BINDINGS,
    "o_columns": f"""
        select table_id, ordinal, name, data_type, comment, trim(comment) <> '' as described,
            trim(comment) <> '' and {has('comment', R.GENERIC_COMMENT)} as generic,
            {has('name', R.CODED_NAME)} and not {has('comment', R.VALUE_DICTIONARY)} as coded,
            {has('name', R.DATE_NAME)} and upper(data_type) in {STRING_TYPES} as date_string,
            {has('name', R.TECHNICAL_NAME)} and trim(comment) = '' as technical
        from b_columns""",
    "o_widths": """
        select table_id, count(*) as n_cols, count(*) filter (where described) as n_described,
            count(*) filter (where generic) as n_generic, count(*) filter (where coded) as n_coded,
            count(*) filter (where date_string) as n_date_string, count(*) filter (where technical) as n_technical
        from o_columns group by table_id""",
    "o_keyed": f"select distinct table_id from b_table_constraints where constraint_type in {names(R.KEY_CONSTRAINTS)}",
    "o_layer": f"""
        select table_id, min_by(lower(tag_value), ordinal) as layer_tag from b_table_tags
        where lower(tag_name) in {names(R.LAYER_TAG_KEYS)} group by table_id""",
    "o_ext": f"""
        select g.table_id, bool_or(replace(upper(g.action_type), ' ', '_') in {names(R.GRANTING_ACTIONS)}
            and lower(g.principal) <> lower(coalesce(case when t.error is null then t.owner end, ''))) as ext
        from b_table_grants g join b_tables t on t.table_id = g.table_id group by g.table_id""",
    "o_members": f"""
        select s.space_id, s.table_id, s.ordinal, split_part(s.table_id, '.', 3) as short, t.error,
            case when t.error is null then t.comment end as comment,
            case when t.error is null then t.owner end as owner,
            case when t.error is null then t.table_type end as table_type,
            t.error is null and t.has_row_filter as has_row_filter,
            t.error is null and t.has_col_mask as has_col_mask,
            t.table_type = 'METRIC_VIEW' as is_mv,
            case when t.error is null then coalesce(w.n_cols, 0) else 0 end as n_cols,
            case when t.error is null then coalesce(w.n_described, 0) else 0 end as n_described,
            case when t.error is null then coalesce(w.n_generic, 0) else 0 end as n_generic,
            case when t.error is null then coalesce(w.n_coded, 0) else 0 end as n_coded,
            case when t.error is null then coalesce(w.n_date_string, 0) else 0 end as n_date_string,
            case when t.error is null then coalesce(w.n_technical, 0) else 0 end as n_technical,
            k.table_id is not null as is_keyed, g.table_id is not null as is_tagged, lt.layer_tag,
            coalesce(gs.readable, false) as readable, coalesce(e.ext, false) as ext
        from b_space_tables s
        left join b_tables t on t.table_id = s.table_id
        left join o_widths w on w.table_id = s.table_id
        left join o_keyed k on k.table_id = s.table_id
        left join (select distinct table_id from b_table_tags) g on g.table_id = s.table_id
        left join o_layer lt on lt.table_id = s.table_id
        left join b_grant_status gs on gs.table_id = s.table_id
        left join o_ext e on e.table_id = s.table_id""",
    "o_member_rules": f"""
        select *, case when upper(coalesce(table_type, '')) in ('VIEW', 'METRIC_VIEW') then 'exempt'
                when layer_tag in {names(R.NON_GOLD_TAG_VALUES)} then 'non_gold'
                when layer_tag is not null then 'tagged'
                when {has('lower(table_id)', R.NON_GOLD_NAME)} then 'non_gold' else 'unclear' end as layer,
            error is null and trim(coalesce(comment, '')) = '' as no_comment,
            error is null and trim(coalesce(comment, '')) <> '' and length(trim(comment)) < 50
                and table_type <> 'METRIC_VIEW' as thin
        from o_members""",
    "o_member_counts": """
        select space_id, count(*) as table_count, count(*) filter (where is_keyed) as keyed,
            count(*) filter (where is_tagged) as tagged,
            count(*) filter (where is_tagged and not is_mv) as base_tagged_count,
            count(*) filter (where is_mv) as mv_count,
            count(*) filter (where coalesce(owner, '') = '') as unowned_count,
            count(*) filter (where readable and not ext) as ungranted_count,
            count(*) filter (where not readable) as unknown_grant_count,
            count(*) filter (where layer = 'non_gold') as n_non_gold,
            count(*) filter (where layer = 'unclear') as n_unclear,
            count(*) filter (where n_cols > 50) as n_wide,
            count(*) filter (where error is null and n_described = 0) as n_undocumented,
            count(*) filter (where no_comment) as n_no_comment, count(*) filter (where thin) as n_thin,
            count(*) filter (where has_row_filter or has_col_mask) as n_restricted,
            count(distinct split_part(table_id, '.', 1) || '.' || split_part(table_id, '.', 2)) as n_schemas,
            cast(sum(n_cols) as bigint) as total_cols, cast(sum(n_described) as bigint) as described,
            cast(sum(n_generic) as bigint) as n_generic, cast(sum(n_coded) as bigint) as n_coded,
            cast(sum(n_date_string) as bigint) as n_date_string, cast(sum(n_technical) as bigint) as n_technical
        from o_member_rules group by space_id""",
    "o_texts": "select space_id, ordinal, title, content from b_instructions where instruction_type = 'TEXT_INSTRUCTION'",
    "o_sqls": f"""
        select space_id, ordinal as sql_id, title, content, {SQL_FLAGS}, {has('content', R.PARAMETER)} as has_param,
            {has('content', R.HARDCODED_SQL)} and not {has('content', R.PARAMETER)} as hardcoded
        from b_instructions where instruction_type = 'SQL_INSTRUCTION'""",
    "o_flags": "select space_id, count(*) as sql, count(*) filter (where hardcoded) as n_hardcoded, "
    + ", ".join(f"bool_or({n}) as {n}" for n in FLAG_NAMES)
    + " from o_sqls group by space_id",
    "o_blobs": "select space_id, string_agg(content, chr(10) order by ordinal) as blob from o_texts group by space_id",
    "o_text_blocks": f"""
        select space_id, ordinal, title, length(content) as chars, {lines('content')} as n_lines,
            {has('content', R.INLINE_SQL)} as inline_sql, {has('content', R.EMPHATIC)} as emphatic,
            length(content) > 800 as long,
            {' + '.join(f"cast({has('content', r)} as bigint)" for r in R.SCHEMA_DUMP_RULES)} as schema_hits,
            {' + '.join(f"cast({has('content', r)} as bigint)" for r in R.BUSINESS_RULES)} as business_hits
        from o_texts""",
    "o_text_facts": f"""
        select b.space_id, t.text_count, t.lines, t.chars, t.n_inline, t.n_emphatic, t.n_long, t.schema_hits, t.business_hits,
            {', '.join(f"cast({cnt('b.blob', r)} as bigint) as {n}" for n, r in JOINED.items())},
            {has('b.blob', R.DIRECTIVE)} as has_directives,
            {', '.join(f"{has('b.blob', r)} as {SECTIONS[n]}" for n, r in R.SECTIONS.items())}
        from o_blobs b join (
            select space_id, count(*) as text_count, cast(sum(n_lines) as bigint) as lines, cast(sum(chars) as bigint) as chars,
                count(*) filter (where inline_sql) as n_inline, count(*) filter (where emphatic) as n_emphatic,
                count(*) filter (where long) as n_long, cast(sum(schema_hits) as bigint) as schema_hits,
                cast(sum(business_hits) as bigint) as business_hits
            from o_text_blocks group by space_id) t on t.space_id = b.space_id""",
    "o_exprs": f"""
        select space_id, ordinal, case when t like '%MEASURE%' then 'MEASURE' when t like '%DIMENSION%' then 'DIMENSION'
                when t like '%FILTER%' then 'FILTER' else t end as expression_type,
            coalesce(nullif(json_extract_string(j, '$.display_name'), ''), json_extract_string(j, '$.alias'), '') as name,
            coalesce(json_extract_string(j, '$.code'), '') as code,
            coalesce(cast(json_extract(j, '$.synonyms') as varchar[]), []) as synonyms
        from (select space_id, ordinal, j, coalesce(json_extract_string(j, '$.type'), '') as t
            from (select space_id, ordinal, case when json_valid(content) then content else '{{}}' end as j
                from b_instructions where instruction_type = 'SQL_SNIPPET') v) p""",
    "o_expr_kinds": f"""
        select *, case when upper(expression_type) in ('MEASURE', 'AGGREGATION')
                or (expression_type = '' and {has('code', R.AGGREGATE_CALL)}) then 'measure'
            when upper(expression_type) in ('FILTER', 'CONDITIONAL')
                or (expression_type = '' and {has('code', R.CONDITION)} and not {has('code', R.AGGREGATE_CALL)}) then 'filter'
            else 'dimension' end as kind from o_exprs""",
    "o_expr_facts": """
        select space_id, count(*) as expr_count, count(*) filter (where kind = 'measure') as n_measures,
            cast(sum(len(synonyms)) as bigint) as n_synonyms from o_expr_kinds group by space_id""",
    "o_synonyms": """
        select space_id, ordinal, i as place, synonym from (
            select space_id, ordinal, unnest(synonyms) as synonym, generate_subscripts(synonyms, 1) - 1 as i from o_exprs) u""",
    "o_joins": """
        select space_id, ordinal, content from b_instructions where instruction_type = 'FROM_SNIPPET'
            and case when json_valid(content) then list_contains(json_keys(content), 'join') else false end""",
    "o_refs": f"""
        select space_id, sql_id, pos, regexp_replace(lower(string_split(replace(raw, '`', ''), '.')[-1]), '"', '') as ref
        from (select space_id, sql_id, unnest(r) as raw, generate_subscripts(r, 1) - 1 as pos from (
            select space_id, sql_id, regexp_extract_all(regexp_replace(content, {pat(R.FUNCTION_FROM)}, '(', 'g'),
                {pat(R.TABLE_REF_FULL)}, 1) as r from o_sqls where not {has('content', R.PLACEHOLDER)}) x) y""",
    "o_ctes": f"""
        select distinct space_id, sql_id, lower(name) as name from (select space_id, sql_id,
            unnest(regexp_extract_all(content, {pat(R.CTE_FULL)}, 1)) as name from o_sqls) c""",
    "o_unknown": """
        select r.space_id, r.sql_id, min_by(r.ref, r.pos) as ref from o_refs r
        where not exists (select 1 from o_ctes c where c.space_id = r.space_id and c.sql_id = r.sql_id and c.name = r.ref)
            and not exists (select 1 from b_space_tables s where s.space_id = r.space_id
                and lower(split_part(s.table_id, '.', 3)) = r.ref)
        group by r.space_id, r.sql_id""",
    "o_questions": """
        select space_id, question_id, question_type, question_text, answer_text from b_questions
        where question_type in ('SAMPLE_QUESTION', 'BENCHMARK')""",
    "o_asks": f"""
        select space_id, {', '.join(f"{has('blob', r)} as {n}" for n, r in R.QUESTION_PATTERNS.items())}
        from (select space_id, string_agg(lower(question_text), ' ' order by question_id) as blob from o_questions
            where question_type = 'SAMPLE_QUESTION' group by space_id) b""",
    "o_question_facts": f"""
        select space_id, count(*) filter (where question_type = 'SAMPLE_QUESTION') as samples,
            count(*) filter (where question_type = 'BENCHMARK') as benchmarks,
            count(*) filter (where question_type = 'BENCHMARK' and trim(coalesce(answer_text, '')) = '') as n_missing_gold,
            count(*) filter (where question_type = 'BENCHMARK' and {has('answer_text', R.HARDCODED_GOLD_SQL)}) as n_hardcoded_gold
        from o_questions group by space_id""",
    "o_variants": """
        select distinct space_id, table_id, unnest(list_filter([
            n, case when suffix(n, 'ies') then n[:-4] || 'y' when suffix(n, 'sses') or suffix(n, 'xes') then n[:-3] end,
            case when suffix(n, 's') and length(n) > 3 then n[:-2] end,
            case when len(w) > 1 then w[1] end, case when len(w) > 1 then w[-1] end,
            case when len(w) > 1 and suffix(w[-1], 's') then w[-1][:-2] end], lambda x: x is not null)) as variant
        from (select space_id, table_id, n, string_split(n, '_') as w from (
            select space_id, table_id, lower(split_part(table_id, '.', 3)) as n from b_space_tables) a) b""",
    "o_mentions": """
        select distinct v.space_id, v.table_id from o_variants v join o_questions q on q.space_id = v.space_id
        where q.question_type = 'SAMPLE_QUESTION' and contains(lower(q.question_text), v.variant)""",
    "o_uncovered": """
        select s.space_id, s.table_id, s.ordinal from b_space_tables s
        join (select space_id from o_question_facts where samples >= 3) q on q.space_id = s.space_id
        join (select space_id from b_space_tables group by space_id having count(*) >= 2) t on t.space_id = s.space_id
        where not exists (select 1 from o_mentions m where m.space_id = s.space_id and m.table_id = s.table_id)""",
    "o_labels": "select * from (values "
    + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in R.ABBREVIATION_LABELS.items())
    + ") l(abbrev, label)",
    "o_tokens": f"""
        select distinct table_id, token from (select table_id, unnest(string_split(lower(name), '_')) as token from b_columns) t
        where regexp_matches(token, '^\\p{{L}}{{2,5}}$') and token not in {names(R.COMMON_SHORT_WORDS)}""",
    "o_abbrevs": """
        select distinct s.space_id, k.token as abbrev from b_space_tables s join b_tables t on t.table_id = s.table_id
        join o_tokens k on k.table_id = s.table_id where t.error is null""",
    "o_covered": """
        select a.space_id, a.abbrev, l.label,
            contains(coalesce(y.blob, ''), a.abbrev) or contains(coalesce(lower(b.blob), ''), a.abbrev)
            or (l.label is not null and (contains(coalesce(y.blob, ''), trim(split_part(lower(l.label), '/', 1)))
                or contains(coalesce(lower(b.blob), ''), trim(split_part(lower(l.label), '/', 1))))) as covered
        from o_abbrevs a left join o_labels l on l.abbrev = a.abbrev
        left join (select space_id, lower(string_agg(synonym, ' ' order by ordinal, place)) as blob from o_synonyms group by space_id) y
            on y.space_id = a.space_id
        left join o_blobs b on b.space_id = a.space_id""",
    "o_unmapped": "select space_id, abbrev, label from o_covered where not covered",
    "o_locked": """
        select object_type, object_id from b_acl group by object_type, object_id
        having not bool_or(coalesce(nullif(user_name, ''), nullif(group_name, '')) is not null
            and lower(coalesce(nullif(user_name, ''), nullif(group_name, ''))) <> 'admins' and level = 'CAN_USE')""",
    "o_mvs": """
        select distinct lower(table_id) as full_name, lower(split_part(table_id, '.', 1) || '.' || split_part(table_id, '.', 2))
            as schema_id from b_tables where table_type = 'METRIC_VIEW'""",
    "o_split": """
        select distinct m.space_id, v.full_name, exists (select 1 from b_space_tables s where s.space_id = m.space_id
            and lower(s.table_id) = v.full_name) as in_space
        from (select distinct space_id, lower(split_part(table_id, '.', 1) || '.' || split_part(table_id, '.', 2)) as schema_id
            from b_space_tables) m join o_mvs v on v.schema_id = m.schema_id""",
    "o_verdicts": "select space_id, list_filter(["
    + ", ".join(f"case when not coalesce({k}, true) then {lit(v)} end" for k, v in R.DESCRIPTION_ELEMENTS.items())
    + "], lambda x: x is not null) as missing from b_description_verdicts",
    "o_facts": f"""
        select s.space_id, s.title, trim(coalesce(s.description, '')) as description, w.is_serverless,
            {', '.join(f"coalesce(m.{c}, 0) as {c}" for c in (
                "table_count", "keyed", "tagged", "base_tagged_count", "mv_count", "unowned_count", "ungranted_count",
                "unknown_grant_count", "n_non_gold", "n_unclear", "n_wide", "n_undocumented", "n_no_comment", "n_thin",
                "n_restricted", "n_schemas", "total_cols", "described", "n_generic", "n_coded", "n_date_string", "n_technical"))},
            coalesce(m.table_count, 0) - coalesce(m.mv_count, 0) as base_count,
            coalesce(j.n, 0) as join_count, coalesce(f.sql, 0) as sql, coalesce(f.n_hardcoded, 0) as n_hardcoded,
            {', '.join(f"coalesce(f.{c}, false) as {c}" for c in FLAG_NAMES)},
            {', '.join(f"coalesce(x.{c}, 0) as {c}" for c in (
                "text_count", "lines", "chars", "n_inline", "n_emphatic", "n_long", "schema_hits", "business_hits",
                "metric_hits", "join_hits", "vague_hits"))},
            coalesce(x.has_directives, false) as has_directives,
            {', '.join(f"coalesce(x.{c}, false) as {c}" for c in SECTIONS.values())},
            {' + '.join(f"cast(coalesce(x.{c}, false) as bigint)" for c in SECTIONS.values())} as n_sections,
            coalesce(e.expr_count, 0) as expr_count, coalesce(e.n_measures, 0) as n_measures,
            coalesce(e.n_synonyms, 0) as n_synonyms,
            coalesce(u.n, 0) as n_unknown, coalesce(q.samples, 0) as samples, coalesce(q.benchmarks, 0) as benchmarks,
            coalesce(q.n_missing_gold, 0) as n_missing_gold, coalesce(q.n_hardcoded_gold, 0) as n_hardcoded_gold,
            {', '.join(f"coalesce(k.{c}, false) as {c}" for c in R.QUESTION_PATTERNS)},
            coalesce(c.n, 0) as n_uncovered, coalesce(a.n, 0) as n_unmapped, coalesce(p.n, 0) as n_extra,
            ls.object_id is not null as not_shared, coalesce(s.warehouse_id, '') <> '' and lw.object_id is not null as warehouse_locked,
            v.missing as desc_missing
        from b_spaces s
        left join b_warehouses w on w.warehouse_id = s.warehouse_id
        left join o_member_counts m on m.space_id = s.space_id
        left join (select space_id, count(*) as n from o_joins group by space_id) j on j.space_id = s.space_id
        left join o_flags f on f.space_id = s.space_id
        left join o_text_facts x on x.space_id = s.space_id
        left join o_expr_facts e on e.space_id = s.space_id
        left join (select space_id, count(*) as n from o_unknown group by space_id) u on u.space_id = s.space_id
        left join o_question_facts q on q.space_id = s.space_id
        left join o_asks k on k.space_id = s.space_id
        left join (select space_id, count(*) as n from o_uncovered group by space_id) c on c.space_id = s.space_id
        left join (select space_id, count(*) as n from o_unmapped group by space_id) a on a.space_id = s.space_id
        left join (select space_id, count(*) as n from o_split where not in_space group by space_id) p on p.space_id = s.space_id
        left join o_locked ls on ls.object_type = 'space' and ls.object_id = cast(s.space_id as varchar)
        left join o_locked lw on lw.object_type = 'warehouse' and lw.object_id = s.warehouse_id
        left join o_verdicts v on v.space_id = s.space_id""",
    "o_steps": """
        select *, case when total_cols = 0 then 0.0 else described / total_cols * 100 end as pct,
            case when table_count <= 1 then case when keyed >= 1 then 3 else 2 end
                when join_count >= table_count - 1 and keyed >= 1 then 3
                when join_count >= 1 or keyed >= 1 then 2 else 1 end as structure,
            case when sql = 0 then 1 when n_pat >= 4 then case when n_unknown > 0 then 2 else 3 end
                when n_pat >= 2 then 2 else 1 end as sql_sub,
            case when text_count = 0 then 1
                when metric_hits + join_hits = 0 and n_sections >= 2 and has_directives and lines <= 100 then 3
                when metric_hits + join_hits > 2 then 1 else 2 end as text_sub,
            samples >= 3 and asks_time and not has_date as gap_time,
            samples >= 3 and asks_join and not has_join and table_count > 1 as gap_join,
            samples >= 3 and asks_topn and not has_topn as gap_topn,
            samples >= 3 and asks_compare and not has_compare as gap_compare
        from (select *, """
    + " + ".join(f"cast({c} as bigint)" for c in FLAG_NAMES)
    + """ as n_pat from o_facts) f""",
    "o_scores": """
        select *,
            case when blocked then greatest(structure - 1, 1)
                when (warehouse_locked or ungranted_count > 0) and structure = 3 then 2 else structure end as score_0,
            case when base_count <= 5 then 3 when base_count <= 9 then 2 else 1 end as score_1,
            case when meta = 2 and (n_coded > 5 or n_date_string > 2) then 1 else meta end as score_2,
            case when config = 3 and (gap_time or gap_join or gap_topn or gap_compare) then 2 else config end as score_3,
            case when samples >= 10 then case when n_uncovered >= greatest(2, table_count // 2) then 2 else 3 end
                when samples >= 5 then 2 else 1 end as score_4,
            case when benchmarks >= 15 then 3 when benchmarks >= 5 then 2 else 1 end as score_5
        from (select *, not_shared or (ungranted_count > 0 and ungranted_count >= greatest(1, table_count // 2)) as blocked,
                case when cov = 3 and (n_coded > 3 or n_date_string > 0 or n_thin > 1) then 2 else cov end as meta,
                cast(greatest(1, (sql_sub + text_sub) // 2) as int) as config
            from (select *, case when pct >= 80 then 3 when pct >= 50 then 2 else 1 end as cov from o_steps) a) b""",
    "o_areas": " union all ".join(
        f"select space_id, {a} as area, score_{a} as score from o_scores" for a in R.AREAS
    ),
    "o_totals": """
        select space_id, cast(sum(score) as bigint) as total, cast(count(*) * 3 as bigint) as max_total,
            sum(score) / (count(*) * 3) as pct,
            case when sum(score) / (count(*) * 3) >= 0.83 then 'PRODUCTION READY'
                when sum(score) / (count(*) * 3) >= 0.61 then 'NEEDS IMPROVEMENT' else 'RECOMMEND REBUILD' end as verdict,
            """
    + "coalesce(string_agg(case when score = 1 then case area "
    + " ".join(f"when {a} then {lit(R.AREAS[a])}" for a in R.BLOCKER_AREAS)
    + " end end, '|' order by area), '') as blockers from o_areas group by space_id",
    "o_sessions": """
        select distinct user_email as "user", cast(event_time as date) as day, table_name from b_audit
        where action_name = 'getTable'""",
    "o_recent": """
        select distinct user_email as "user", cast(event_time as date) as day, table_name from b_audit
        where action_name = 'getTable' and event_time >= date '2024-01-31' - interval 14 day""",
    "o_edges": """
        select source_table, target_table, count(*) as n from b_lineage
        where event_time >= date '2024-01-31' - interval 14 day group by source_table, target_table""",
}


def compose(sql: str) -> str:
    """Put the parts a query names, and the parts those name, in front of it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[bo]_\w+\b", text):
            if word in PARTS and word not in order:
                visit(PARTS[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as ({PARTS[n].strip()})" for n in order)
    return f"with {ctes}\n{sql.strip()}"
