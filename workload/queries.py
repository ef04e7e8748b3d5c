"""Every operator as a query over the whole test tables, beside the SQL that checks it.

Arrays are joined to texts and decimals cast to doubles here, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators import config_lint as C
from spacegauge.operators import curation as CU
from spacegauge.operators import findings as FD
from spacegauge.operators import joins as J
from spacegauge.operators import lists as L
from spacegauge.operators import metadata as M
from spacegauge.operators import questions as Q
from spacegauge.operators import readiness as RD
from spacegauge.operators import recommend as RC
from spacegauge.operators import scoring as S
from spacegauge.operators import sets as ST
from spacegauge.operators import shapes as AN
from spacegauge.operators import texts as T
from spacegauge.operators import usage as U
from spacegauge.plans import assessment as A
from spacegauge.plans import facts as P
from spacegauge.session import shared_folder
from spacegauge.sources import readers as SRC
from spacegauge.sources import sinks
from spacegauge.streaming import coaccess
from workload.data import Data
from workload.oracle_base import FLAG_NAMES, SECTIONS, cnt, compose, has, lit, names, pat
from workload.wording import MESSAGES, NAMES_SQL, UNWORDED

AS_OF, DAYS = "2024-01-31", 14
YEAR = ("1996-01-01", "1997-01-01")
PREV_YEAR = ("1995-01-01", "1996-01-01")
WEEK, PREV_WEEK = ("2024-01-15", "2024-01-22"), ("2024-01-08", "2024-01-15")

Query = Callable[[Data], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    ENTRIES[name] = (query, sql)


def flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in cols})


def dbl(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def big(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def counts(d: Data) -> DataFrame:
    return P.space_counts(d.spaces, d.space_tables, d.b_table_constraints, d.b_table_tags, d.b_instructions, d.questions)


def base(d: Data) -> DataFrame:
    return P.base_counts(d.spaces, d.space_tables, d.metric_views)


def split(d: Data) -> DataFrame:
    return J.split_metric_views(d.metric_views, d.space_tables)


def sessions(d: Data) -> DataFrame:
    return U.access_sessions(U.since(d.b_audit, AS_OF, DAYS))


def scored(d: Data) -> DataFrame:
    """Scores with the names that messages show, staged as a full audit does."""
    return A.staged_facts(d.estate)[1]


def bare(d: Data) -> DataFrame:
    """Scores without the names that only messages show, staged because many rules read them."""
    return A.staged(A.scored_facts(d.estate), "facts")


def areas(d: Data) -> DataFrame:
    return S.area_scores(A.scored_facts(d.estate))


COUNTS = "table_count, join_count, keyed, tagged, sql, samples, benchmarks"

# ---- scans and sources ------------------------------------------------------------------------
RAW_SPACES = """
    select c_custkey as space_id, c_name as title, cast(null as string) as display_name,
        case when c_custkey % 2 = 0 then c_mktsegment end as description,
        'main.gold.t' || c_custkey % 7 || ',raw.bad_' || c_custkey % 3 || ',a.b.c' || c_nationkey as ids,
        'w' || c_nationkey as warehouse_id, case when c_custkey % 11 = 0 then 'unreadable' end as error
    from customer"""
IDS_SQL = RAW_SPACES.replace("as string", "as varchar")


def raw_spaces(d: Data) -> DataFrame:
    rows = d.spark.sql(RAW_SPACES.replace("from customer", "from {customer}"), customer=d.customer)
    return SRC.spaces(rows.withColumn("table_identifiers", F.split("ids", ",")))


add("src01_spaces", lambda d: flat(raw_spaces(d), "table_identifiers"),
    f"select space_id, title, coalesce(description, '') as description, replace(ids, ',', '|') as table_identifiers, "
    f"warehouse_id, error from ({IDS_SQL}) s")  # fmt: skip
add("src02_instructions", lambda d: SRC.text_instructions(d.b_instructions).withColumn("kind", F.lit("text")).unionByName(
    SRC.sql_instructions(d.b_instructions).select(
        "space_id", F.col("sql_id").alias("ordinal"), "title", F.col("sql").alias("text"), F.lit("sql").alias("kind"))),
    "select space_id, ordinal, title, content as text, case instruction_type when 'TEXT_INSTRUCTION' then 'text' else 'sql' end as kind "
    "from b_instructions where instruction_type in ('TEXT_INSTRUCTION', 'SQL_INSTRUCTION')")  # fmt: skip
add("src03_expressions", lambda d: flat(d.expressions, "synonyms"),
    "select space_id, ordinal, expression_type, name, code, array_to_string(synonyms, '|') as synonyms from o_exprs")
add("src04_synonyms", lambda d: d.synonyms, "select space_id, ordinal, place, synonym from o_synonyms")
add("src05_joins", lambda d: SRC.parse_joins(d.b_instructions), "select * from o_joins")
add("src06_questions", lambda d: d.questions, "select * from o_questions")
add("src07_space_tables", lambda d: big(SRC.space_tables(raw_spaces(d)), "ordinal"),
    f"""select space_id, table_id, ordinal,
        case when len(string_split(table_id, '.')) = 3 then split_part(table_id, '.', 1) end as catalog_name,
        case when len(string_split(table_id, '.')) = 3 then split_part(table_id, '.', 2) end as schema_name,
        case when len(string_split(table_id, '.')) = 3 then split_part(table_id, '.', 3) end as table_name,
        case when len(string_split(table_id, '.')) <> 3 then 'Cannot parse: ' || table_id end as error
        from (select space_id, unnest(string_split(ids, ',')) as table_id,
            generate_subscripts(string_split(ids, ','), 1) - 1 as ordinal from ({IDS_SQL}) s) u""")  # fmt: skip
add("src08_table_attributes", lambda d: SRC.table_attributes(d.b_describe_rows),
    "select table_id, coalesce(max(case when col_name = 'Comment' then data_type end), '') as comment, "
    "max(case when col_name = 'Owner' then data_type end) as owner from b_describe_rows group by table_id")
add("src09_table_columns", lambda d: d.columns, "select table_id, ordinal, name, data_type, comment from b_columns")
add("src10_table_types", lambda d: SRC.table_types(d.tables),
    "select table_id, coalesce(table_type, 'BASE TABLE') as table_type from b_tables")
add("src11_protection_flags", lambda d: SRC.protection_flags(d.b_describe_rows),
    "select table_id, bool_or(contains(lower(col_name), 'row filter')) as has_row_filter, "
    "bool_or(contains(lower(col_name), 'column mask') or contains(lower(col_name), 'masking policy')) as has_col_mask "
    "from b_describe_rows group by table_id")
add("src12_metadata_errors", lambda d: SRC.metadata_errors(d.tables),
    "select table_id, error from b_tables where error is not null")
add("src13_tags", lambda d: SRC.tags(d.b_table_tags), "select * from b_table_tags where tag_name is not null")
add("src14_tables_with_keys", lambda d: SRC.tables_with_keys(d.b_table_constraints), "select * from o_keyed")
add("src15_warehouses", lambda d: SRC.warehouses(d.b_warehouses.select(
    "warehouse_id", F.col("is_serverless").alias("enable_serverless_compute"),
    F.when(F.col("warehouse_id") == "w7", "404").alias("error"))),
    "select warehouse_id, case when warehouse_id <> 'w7' then is_serverless end as is_serverless from b_warehouses")
add("src16_acl", lambda d: flat(SRC.acl(d.b_acl.select("object_type", "object_id", F.array(F.struct(
    "user_name", "group_name", F.lit(None).cast("string").alias("service_principal_name"),
    F.array(F.struct(F.col("level").alias("permission_level"))).alias("all_permissions"))).alias("access_control_list"))), "levels"),
    "select object_type, object_id, user_name, group_name, cast(null as varchar) as service_principal_name, level as levels from b_acl")
add("src17_grants", lambda d: SRC.grants(d.b_table_grants, d.b_grant_status),
    "select distinct s.table_id, s.readable, case when s.readable then g.principal end as principal, "
    "case when s.readable then g.action_type end as action_type from b_grant_status s left join b_table_grants g on g.table_id = s.table_id")
add("src18_metric_views", lambda d: d.metric_views, "select * from o_mvs")
add("src19_lineage", lambda d: SRC.lineage_of(d.b_lineage.drop("event_id"), d.space_tables, AS_OF, DAYS).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")),
    "select strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, source_table, target_table from b_lineage where event_time >= date '2024-01-31' - interval 14 day "
    "and (source_table in (select table_id from b_space_tables) or target_table in (select table_id from b_space_tables))")  # fmt: skip


def nested_audit(d: Data) -> DataFrame:
    return d.b_audit.select(
        F.struct(F.col("table_name").alias("full_name_arg")).alias("request_params"),
        F.struct(F.col("user_email").alias("email")).alias("user_identity"),
        "action_name",
        "event_time",
    )


add("src20_audit", lambda d: U.since(SRC.audit(nested_audit(d)), AS_OF, DAYS).select(
    F.to_date("event_time").alias("day"), "user_email", "action_name", "table_name"),
    "select cast(event_time as date) as day, user_email, action_name, table_name from b_audit "
    "where action_name = 'getTable' and event_time >= date '2024-01-31' - interval 14 day")  # fmt: skip


# ---- sinks ------------------------------------------------------------------------------------
def written(df: DataFrame, write: Callable) -> DataFrame:
    """Write a result where runs of that date and of another were written before, and read what is there of that date."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    stale = spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    for date in ("2024-01-30", AS_OF):
        write(stale, path, date)
    write(df, path, AS_OF)
    return spark.read.parquet(path).where(F.col("run_date") == F.lit(AS_OF).cast("date"))


SCORES_SQL = ", ".join(f"s.score_{a}" for a in R.AREAS)
CARD_SQL = f"""select s.space_id, s.title, {SCORES_SQL}, t.total, t.max_total, t.pct, t.blockers,
    case when t.verdict = 'PRODUCTION READY' and t.blockers <> '' then 'NEEDS IMPROVEMENT' else t.verdict end as verdict"""
CARD_FROM = " from o_scores s join o_totals t on t.space_id = s.space_id"


def card(d: Data) -> DataFrame:
    return big(flat(A.scorecard(d.estate), "blockers"), "total", "max_total")


add("snk01_scorecard", lambda d: written(card(d), sinks.write_scorecard),
    f"{CARD_SQL}, date '2024-01-31' as run_date {CARD_FROM}")

# ---- projections, filters, predicates ---------------------------------------------------------
add("prj01_short_name", lambda d: d.space_tables.select("space_id", "table_id", X.short_name(F.col("table_id")).alias("short_name")),
    "select space_id, table_id, split_part(table_id, '.', 3) as short_name from b_space_tables")
add("prj02_schema_id", lambda d: d.tables.select("table_id", X.schema_id(F.col("table_id")).alias("schema_id")),
    "select table_id, split_part(table_id, '.', 1) || '.' || split_part(table_id, '.', 2) as schema_id from b_tables")
add("prj03_can_use_principals", lambda d: RD.can_use_principals(d.acl),
    "select object_type, object_id, coalesce(nullif(user_name, ''), group_name) as principal from b_acl "
    "where level = 'CAN_USE' and lower(coalesce(nullif(user_name, ''), group_name)) <> 'admins'")
add("prj04_classify_expression", lambda d: d.expressions.select("space_id", "ordinal", C.classify_expression(F.col("expression_type"), F.col("code")).alias("kind")),
    "select space_id, ordinal, kind from o_expr_kinds")
add("prj05_non_error_tables", lambda d: SRC.non_error_tables(d.tables).select("table_id", "comment"),
    "select table_id, comment from b_tables where error is null")
add("prj06_base_tables", lambda d: J.base_tables(d.space_tables, d.metric_views).select("space_id", "table_id"),
    "select space_id, table_id from b_space_tables where lower(table_id) not in (select full_name from o_mvs)")
add("prj07_skip_placeholder_sql", lambda d: C.skip_placeholder_sql(d.sqls).select("space_id", "sql_id", "sql"),
    f"select space_id, sql_id, content as sql from o_sqls where not {has('content', R.PLACEHOLDER)}")
add("prj08_period_filter", lambda d: d.orders.where(J.in_range("o_orderdate", *YEAR)).select("o_orderkey", "o_custkey"),
    "select o_orderkey, o_custkey from orders where o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'")

# ---- joins ------------------------------------------------------------------------------------
add("jn01_with_metadata", lambda d: J.with_metadata(d.space_tables, d.tables).select("space_id", "table_id", "comment", "owner", "table_type", "error"),
    "select space_id, table_id, comment, owner, table_type, error from o_members")
add("jn02_with_tags", lambda d: J.with_tags(d.space_tables, d.b_table_tags),
    "select s.space_id, s.table_id, t.tag_name, t.tag_value from b_space_tables s left join b_table_tags t on t.table_id = s.table_id")
add("jn03_tables_without_keys", lambda d: J.tables_without_keys(d.space_tables, d.b_table_constraints),
    "select space_id, table_id from b_space_tables where table_id not in (select table_id from o_keyed)")
add("jn04_unknown_refs", lambda d: J.unknown_refs(C.sql_refs(d.sqls), C.cte_names(d.sqls), d.space_tables), "select * from o_unknown")
add("jn05_split_metric_views", split, "select * from o_split")
add("jn06_covered_abbrevs", lambda d: J.covered_abbrevs(
    J.with_metadata(d.space_tables, d.tables).where("error is null").join(ST.distinct_tokens(d.columns), "table_id").select("space_id", F.col("token").alias("abbrev")),
    d.labels, d.texts.select("space_id", "text")),
    """select a.space_id, a.abbrev, bool_or(contains(coalesce(lower(b.blob), ''), a.abbrev)
        or (l.label is not null and contains(coalesce(lower(b.blob), ''), lower(l.label)))) as covered
        from o_abbrevs a left join o_labels l on l.abbrev = a.abbrev left join o_blobs b on b.space_id = a.space_id
        group by a.space_id, a.abbrev""")  # fmt: skip
add("jn07_question_mentions", lambda d: J.question_mentions(J.name_variants(d.space_tables), Q.samples(d.questions)), "select * from o_mentions")
PAIRS_SQL = """select a."user", a.day, a.table_name as table_a, b.table_name as table_b from o_recent a
    join o_recent b on b."user" = a."user" and b.day = a.day and a.table_name < b.table_name"""
add("jn08_session_pairs", lambda d: U.session_pairs(sessions(d)), PAIRS_SQL)
add("jn10_label_abbrevs", lambda d: J.label_abbrevs(ST.distinct_tokens(d.columns).select(F.col("token").alias("abbrev")).distinct(), d.labels),
    "select distinct token as abbrev, label from o_tokens left join o_labels on abbrev = token")
add("jn11_external_grants", lambda d: J.external_grants(d.b_table_grants, d.tables), "select table_id, ext as has_external_grant from o_ext")
RULES = [R.METRIC_PROSE, R.JOIN_PROSE, R.VAGUE, R.DIRECTIVE, R.INLINE_SQL, R.EMPHATIC]
add("jn12_apply_rules", lambda d: big(J.apply_rules(d.texts, RULES).drop("title"), *[r.name for r in RULES]),
    "select space_id, ordinal, content as text, " + ", ".join(f"{cnt('content', r)} as {r.name}" for r in RULES) + " from o_texts")
add("jn13_join_dim", lambda d: J.join_dim(d.customer, d.nation, d.customer.c_nationkey == d.nation.n_nationkey).select("c_custkey", "n_name"),
    "select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey")


def typed(d: Data, kind: str, prefix: str) -> DataFrame:
    return d.events.where(F.col("event_type") == kind).select(
        "user_id", F.to_date("ts").alias("day"), F.col("ts").alias(f"{prefix}_ts"), F.col("event_id").alias(f"{prefix}_id")
    )


RANGED_SQL = """select a.user_id, cast(a.ts as date) as day, a.event_id as a_id, b.event_id as b_id from events a
    join events b on b.user_id = a.user_id and cast(b.ts as date) = cast(a.ts as date)
    where a.event_type = 'purchase' and b.event_type = 'error' and a.ts >= date '2024-01-15' and a.ts < date '2024-01-22'
    and b.ts >= date '2024-01-08' and b.ts < date '2024-01-22'"""
add("jn14_join_ranged", lambda d: J.join_ranged(typed(d, "purchase", "a"), typed(d, "error", "b"), ["user_id", "day"], ("a_ts", *WEEK), ("b_ts", PREV_WEEK[0], WEEK[1])).drop("a_ts", "b_ts"), RANGED_SQL)
add("jn15_two_period", lambda d: J.two_period(d.orders, "o_orderdate", YEAR, PREV_YEAR),
    "select count(*) filter (where year(o_orderdate) = 1996) as current, count(*) filter (where year(o_orderdate) = 1995) as previous from orders")

# ---- aggregations -----------------------------------------------------------------------------
add("ag01_space_counts", counts, f"select space_id, {COUNTS} from o_facts")
add("ag02_schema_spread", lambda d: CU.schema_spread(d.space_tables), "select space_id, n_schemas from o_member_counts")
COVERAGE_SQL = """select s.space_id, cast(coalesce(sum(w.n_described), 0) as bigint) as described,
    cast(coalesce(sum(w.n_cols), 0) as bigint) as total,
    case when coalesce(sum(w.n_cols), 0) = 0 then 0.0 else sum(w.n_described) / sum(w.n_cols) * 100 end as pct
    from b_space_tables s join b_tables t on t.table_id = s.table_id left join o_widths w on w.table_id = s.table_id
    where t.error is null group by s.space_id"""
add("ag03_coverage", lambda d: M.coverage(d.space_tables, d.columns, d.tables), COVERAGE_SQL)
add("ag04_table_widths", lambda d: M.table_widths(d.columns).select("table_id", "n_cols", "n_described"), "select table_id, n_cols, n_described from o_widths")
add("ag05_pattern_flags", lambda d: C.pattern_flags(d.sqls), f"select space_id, {', '.join(FLAG_NAMES)} from o_flags")
add("ag06_space_text", lambda d: T.space_text(d.texts, "\n"), "select space_id, blob as text from o_blobs")
add("ag07_hit_totals", lambda d: C.hit_totals(d.texts), "select space_id, metric_hits, join_hits, vague_hits, lines, chars from o_text_facts")
add("ag08_rule_density", lambda d: C.schema_dump_density(d.texts).select("space_id", F.col("schema_hits").cast("bigint"), F.col("business_hits").cast("bigint")),
    "select space_id, schema_hits, business_hits from o_text_facts")
add("ag09_patterns_covered", lambda d: big(C.patterns_covered(C.pattern_flags(d.sqls)), "n"),
    "select space_id, " + " + ".join(f"cast({c} as bigint)" for c in FLAG_NAMES) + " as n from o_flags")
add("ag10_edge_counts", lambda d: U.edge_counts(U.since(d.b_lineage, AS_OF, DAYS)), "select * from o_edges")
PAIR_COUNTS_SQL = f"select table_a, table_b, count(*) as n_sessions from ({PAIRS_SQL}) p group by table_a, table_b"
add("ag11_pair_counts", lambda d: U.pair_counts(sessions(d)), PAIR_COUNTS_SQL)


def money(col: str) -> str:
    return f"cast({col} as decimal(18,2))"


def summed(col: str, cond: str | None = None) -> str:
    value = money(col) if cond is None else f"case when {cond} then {money(col)} else 0 end"
    return f"cast(sum({value}) as double)"


CUR_SQL, PREV_SQL = "year(o_orderdate) = 1996", "year(o_orderdate) = 1995"
SUMS_SQL = f"""select o_orderpriority, current, previous, (current - previous) / nullif(previous, 0) as pct_change from (
    select o_orderpriority, {summed('o_totalprice', CUR_SQL)} as current, {summed('o_totalprice', PREV_SQL)} as previous
    from orders group by o_orderpriority) s"""
add("ag12_conditional_sums", lambda d: dbl(AN.conditional_sums(d.orders, "o_orderpriority", "o_orderdate", "o_totalprice", YEAR, PREV_YEAR), "current", "previous"), SUMS_SQL)
add("ag13_group_stats", lambda d: dbl(AN.group_stats(d.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"), "sum"),
    f"select l_returnflag, l_linestatus, count(*) as n, {summed('l_extendedprice')} / count(*) as avg, {summed('l_extendedprice')} as sum from lineitem group by l_returnflag, l_linestatus")
add("ag14_score_totals", lambda d: big(S.score_totals(areas(d)), "total", "max_total"), "select space_id, total, max_total, pct from o_totals")
MART_SQL = "select cast(sum(value_denom) as double) as volume, cast(sum(value_num) as double) / cast(sum(value_denom) as double) as ratio from b_metrics_mart where metric_alias = 'R'"
add("ag15_mart_read", lambda d: dbl(AN.mart_read(d.b_metrics_mart, "R"), "volume"), MART_SQL)
add("ag16_condition_rate", lambda d: AN.condition_rate(d.events, F.col("event_type") == "error", ["user_id"]),
    "select user_id, count(*) filter (where event_type = 'error') as hits, count(*) as n, count(*) filter (where event_type = 'error') / count(*) as rate from events group by user_id")


# ---- windows, top-k, sets ---------------------------------------------------------------------
def unowned_items(d: Data) -> DataFrame:
    return J.with_metadata(d.space_tables, d.tables).where("coalesce(owner, '') = ''").select(
        "space_id", F.lit("unowned").alias("rule_id"), F.col("ordinal").alias("ord"), F.lit(0).alias("sub"), X.short_name(F.col("table_id")).alias("item")
    )


FIRST_K_SQL = """select space_id, {rule} as rule_id, string_agg(item, '|' order by rn) filter (where rn <= {k}) as shown,
    greatest(count(*) - {k}, 0) as n_more from (select space_id, item, row_number() over (partition by space_id order by ord, item) as rn
    from ({items}) i) r group by space_id"""
add("wn01_first_k", lambda d: big(flat(L.first_k(unowned_items(d), 2), "shown"), "n_more"),
    FIRST_K_SQL.format(rule="'unowned'", k=2, items="select space_id, ordinal as ord, short as item from o_members where coalesce(owner, '') = ''"))
add("wn02_number_rows", lambda d: big(L.number_rows(d.b_questions.select("space_id", "question_id"), ["space_id"], ["question_id"]), "seq"),
    "select space_id, question_id, row_number() over (partition by space_id order by question_id) as seq from b_questions")
MONTHLY_SQL = f"select o_orderpriority, cast(date_trunc('month', o_orderdate) as date) as period, {summed('o_totalprice')} as value from orders group by 1, 2"
add("wn03_lag_value", lambda d: dbl(AN.period_lag(d.orders, "o_orderpriority", "o_orderdate", "o_totalprice"), "value", "previous"),
    f"select o_orderpriority, period, value, lag(value) over (partition by o_orderpriority order by period) as previous from ({MONTHLY_SQL}) m")
EDGE_ORDER = "n desc, coalesce(source_table, ''), coalesce(target_table, '')"
TOP_EDGES_SQL = f"""select space_id, source_table, target_table, n, rank from (select *, row_number() over (partition by space_id order by {EDGE_ORDER}) as rank
    from (select distinct s.space_id, e.source_table, e.target_table, e.n from o_edges e join b_space_tables s
        on s.table_id = e.source_table or s.table_id = e.target_table) j) r where rank <= {{k}}"""
add("tk01_top_edges", lambda d: big(U.top_edges(U.edge_counts(U.since(d.b_lineage, AS_OF, DAYS)), d.space_tables, 5), "rank"), TOP_EDGES_SQL.format(k=5))
TOP_PAIRS_SQL = f"""select space_id, table_a, table_b, n_sessions, rank from (select *, row_number() over (partition by space_id
    order by n_sessions desc, table_a, table_b) as rank from (select a.space_id, p.* from ({PAIR_COUNTS_SQL}) p
    join b_space_tables a on a.table_id = p.table_a join b_space_tables b on b.space_id = a.space_id and b.table_id = p.table_b) j) r where rank <= {{k}}"""
add("tk02_top_pairs", lambda d: big(U.busiest_pairs(sessions(d), d.space_tables, 3), "rank"), TOP_PAIRS_SQL.format(k=3))
add("tk03_sample_audit", lambda d: U.sample_audit(d.b_audit, 500).select("user_email", F.to_date("event_time").alias("day"), "table_name"),
    "select user_email, cast(event_time as date) as day, table_name from b_audit order by user_email, day, table_name, event_time limit 500")
DIGEST_SQL = """select table_id, coalesce(string_agg(case when described then name || ': ' || substr(comment, 1, 60) end, '; ' order by ordinal)
        filter (where described and rd <= 15), string_agg(name || ' (' || data_type || ')', ', ' order by ordinal) filter (where rn <= 15)) as digest
    from (select *, row_number() over (partition by table_id order by ordinal) as rn,
        row_number() over (partition by table_id, described order by ordinal) as rd from o_columns) c group by table_id"""
add("tk04_column_digest", lambda d: M.column_digest(d.columns), DIGEST_SQL)
add("tk05_top_by", lambda d: L.top_by(d.lineitem, "l_partkey", "l_quantity", 20),
    "select l_partkey, sum(l_quantity) as total from lineitem group by l_partkey order by total desc, l_partkey limit 20")
add("tk06_ordered", lambda d: L.ordered(d.columns, ["table_id", "ordinal"]), "select table_id, ordinal, name, data_type, comment from b_columns")
add("tk07_exists_in", lambda d: ST.exists_in(d.space_tables, d.b_table_constraints, ["table_id"]).select("space_id", "table_id"),
    "select space_id, table_id from b_space_tables where table_id in (select table_id from b_table_constraints)")
add("st01_restricted_tables", lambda d: ST.restricted_tables(d.tables), "select distinct table_id from b_tables where error is null and (has_row_filter or has_col_mask)")
add("st02_distinct_tokens", lambda d: ST.distinct_tokens(d.columns), "select table_id, token from o_tokens")


def required_sections(d: Data) -> DataFrame:
    return d.texts.select("space_id").distinct().select("space_id", F.explode(F.array(*[F.lit(s) for s in R.SECTIONS])).alias("item"))


def found_sections(d: Data) -> DataFrame:
    return C.text_lint(d.texts).select("space_id", F.explode("sections").alias("item"))


add("st03_missing_items", lambda d: ST.missing_items(required_sections(d), found_sections(d)),
    " union all ".join(f"select space_id, {lit(n)} as item from o_text_facts where not {c}" for n, c in SECTIONS.items()))

# ---- findings, as (rule, condition) in rule order ----------------------------------------------
PATTERN_MISSING = "(not has_join and table_count > 1) or not has_date or not has_agg or not has_topn or not has_compare"
CONDITIONS = {
    0: [
        ("no_joins", "table_count > 1 and join_count = 0"),
        ("no_keys", "keyed = 0 and table_count > 1"),
        ("missing_keys", "keyed > 0 and keyed < table_count"),
        ("unowned", "unowned_count > 0"),
        ("not_serverless", "not coalesce(is_serverless, true)"),
        ("not_shared", "not_shared"),
        ("warehouse_locked", "warehouse_locked"),
        ("ungranted", "ungranted_count > 0"),
        ("grants_unknown", "unknown_grant_count > 0"),
        ("no_tags", "base_tagged_count = 0 and base_count > 0"),
        ("metric_views_in_space", "mv_count > 0"),
        ("metric_views_extra", "mv_count > 0 and n_extra > 0"),
        ("metric_views_only_in_catalog", "mv_count = 0 and n_extra > 0"),
    ],
    1: [
        ("schema_spread", "n_schemas > 1"),
        ("too_many_tables", "base_count > 9"),
        ("non_gold", "n_non_gold > 0"),
        ("unclear_layer", "n_unclear > 0"),
        ("wide", "n_wide > 0"),
        ("no_description", "description = ''"),
        ("short_description", "description <> '' and length(description) < 80"),
        ("incomplete_description", "length(description) >= 80 and len(coalesce(desc_missing, [])) >= 2"),
    ],
    2: [
        (r, f"n_{n} > 0")
        for r, n in (
            ("undocumented", "undocumented"), ("no_comment", "no_comment"), ("thin_comment", "thin"), ("generic", "generic"),
            ("technical", "technical"), ("coded", "coded"), ("date_string", "date_string"), ("restricted", "restricted"),
            ("unmapped", "unmapped"),
        )
    ],
    3: [
        ("no_sql", "sql = 0"),
        ("few_sql", "sql > 0 and sql < 10"),
        ("hardcoded_sql", "n_hardcoded > 0"),
        ("no_parameterised_sql", "sql > 0 and not has_param"),
        ("missing_patterns", f"sql > 0 and ({PATTERN_MISSING})"),
        ("unknown_tables", "n_unknown > 0"),
        ("no_text", "text_count = 0"),
        ("inline_sql", "n_inline > 0"),
        ("metric_prose", "metric_hits > 0"),
        ("join_prose", "join_hits > 0"),
        ("missing_sections", "text_count > 0 and n_sections < 4"),
        ("long_text", "lines > 100"),
        ("vague_text", "text_count > 0 and lines <= 100 and vague_hits >= 2 and not has_directives"),
        ("few_joins", "base_count > 1 and join_count > 0 and join_count < base_count - 1"),
        ("no_expressions", "mv_count = 0 and expr_count = 0"),
        ("no_measures", "mv_count = 0 and expr_count > 0 and n_measures = 0"),
        ("no_synonyms", "mv_count = 0 and expr_count > 0 and n_synonyms = 0"),
        ("few_expressions", "mv_count = 0 and expr_count > 0 and expr_count < 3"),
        ("misaligned_questions", "gap_time or gap_join or gap_topn or gap_compare"),
    ],
    4: [
        ("no_samples", "samples = 0"),
        ("few_samples", "samples > 0 and samples < 10"),
        ("sample_diversity", "samples > 0"),
        ("uncovered", "n_uncovered > 0"),
    ],
    5: [
        ("no_benchmarks", "benchmarks = 0"),
        ("few_benchmarks", "benchmarks > 0 and benchmarks < 5"),
        ("some_benchmarks", "benchmarks >= 5 and benchmarks < 15"),
        ("missing_gold", "n_missing_gold > 0"),
        ("hardcoded_gold", "n_hardcoded_gold > 0"),
    ],
}


def findings_sql(only: dict[int, list] | None = None, worded: bool = False) -> str:
    if worded:
        rows = " union all ".join(
            f"select s.space_id, {area} as area, {i} as k, {lit(rule)} as rule_id, {MESSAGES.get(rule, 'null')} as message "
            f"from o_scores s left join ({NAMES_SQL}) n on n.space_id = s.space_id where {cond}"
            for area, rules in (only or CONDITIONS).items()
            for i, (rule, cond) in enumerate(rules)
        )
        return f"select space_id, area, row_number() over (partition by space_id, area order by k) as seq, rule_id, message from ({rows}) f"
    rows = " union all ".join(
        f"select space_id, {area} as area, {i} as k, {lit(rule)} as rule_id from o_scores where {cond}"
        for area, rules in (only or CONDITIONS).items()
        for i, (rule, cond) in enumerate(rules)
    )
    return f"select space_id, area, row_number() over (partition by space_id, area order by k) as seq, rule_id from ({rows}) f"


def named(area: int, wanted) -> dict[int, list]:
    return {area: [c for c in CONDITIONS[area] if c[0] in wanted]}


add("st04_all_findings", lambda d: big(FD.findings(bare(d), with_message=False), "seq"), findings_sql())
def worded(df: DataFrame) -> DataFrame:
    """The messages that the checking query words too; of the others, that there is one."""
    return df.withColumn("message", F.when(~F.col("rule_id").isin(*UNWORDED) | (F.length("message") == 0), F.col("message")))


add("snk02_findings", lambda d: written(big(worded(FD.findings(scored(d))), "seq"), sinks.write_findings),
    f"select *, date '2024-01-31' as run_date from ({findings_sql(worded=True)}) w")

# ---- scalar functions -------------------------------------------------------------------------
add("fn01_normalise", lambda d: d.spaces.select("space_id", F.upper("title").alias("up"), F.lower(X.strip(F.col("description"))).alias("low"),
    F.length(X.text_of(F.col("description"))).alias("n"), F.substring("title", 1, 12).alias("cut")),
    "select space_id, upper(title) as up, lower(trim(coalesce(description, ''))) as low, cast(length(coalesce(description, '')) as int) as n, substr(title, 1, 12) as cut from b_spaces")
add("fn02_split_join", lambda d: d.columns.select("table_id", "ordinal", F.array_join(F.split("name", "_"), "/").alias("parts"), F.element_at(F.split("name", "_"), -1).alias("last")),
    "select table_id, ordinal, array_to_string(string_split(name, '_'), '/') as parts, string_split(name, '_')[-1] as last from b_columns")
add("fn03_contains", lambda d: d.tables.select("table_id", F.col("table_id").contains("raw").alias("has_raw"), F.col("table_id").endswith("s").alias("plural"), F.col("table_id").startswith("main.").alias("main")),
    "select table_id, contains(table_id, 'raw') as has_raw, suffix(table_id, 's') as plural, prefix(table_id, 'main.') as main from b_tables")
add("fn04_regex_search", lambda d: d.b_instructions.select("space_id", "ordinal", *[r.hit(F.col("content")).alias(n) for n, r in R.SQL_PATTERNS.items()]),
    "select space_id, ordinal, " + ", ".join(f"{has('content', r)} as {n}" for n, r in R.SQL_PATTERNS.items()) + " from b_instructions")
add("fn05_regex_find_all", lambda d: flat(d.sqls.select("space_id", "sql_id", R.TABLE_REF_NARROW.find_all(F.col("sql"), 1).alias("refs")), "refs"),
    f"select space_id, sql_id, array_to_string(regexp_extract_all(content, {pat(R.TABLE_REF_NARROW)}, 1), '|') as refs from o_sqls")
add("fn06_regex_count", lambda d: d.b_instructions.select("space_id", "ordinal", R.METRIC_PROSE.count(F.col("content")).cast("bigint").alias("n")),
    f"select space_id, ordinal, {cnt('content', R.METRIC_PROSE)} as n from b_instructions")
add("fn07_regex_replace", lambda d: d.texts.select("space_id", "ordinal", X.demote_headings(F.col("text")).alias("text"), X.safe_key(F.col("title")).alias("key")),
    "select space_id, ordinal, regexp_replace(content, '(?m)^#{1,3} ', '#### ', 'g') as text, regexp_replace(title, '[^a-zA-Z0-9_-]', '_', 'g') as key from o_texts")
add("fn08_title_sql_blocks", lambda d: big(SRC.title_sql_blocks(d.b_generated_sql), "seq"),
    r"""select space_id, seq, trim(regexp_extract(block, '(?i)^Title:\s*(.+?)(?:\n|$)', 1)) as title,
        trim(regexp_extract(block, '(?i)\bSQL:\s*\n([\s\S]+)', 1)) as sql
        from (select space_id, generate_subscripts(p, 1) - 1 as seq, trim(unnest(p)) as block
            from (select space_id, regexp_split_to_array(text, '\n?---+\n?') as p from b_generated_sql) s) b
        where regexp_matches(block, '(?i)^Title:\s*.+') and regexp_matches(block, '(?i)\bSQL:\s*\n')""")  # fmt: skip
add("fn09_abbreviation_test", lambda d: d.columns.select("name").distinct().select("name", F.size(ST.name_tokens(F.col("name"))).alias("n")),
    f"select name, cast(len(list_filter(list_distinct(string_split(lower(name), '_')), lambda w: regexp_matches(w, '^\\p{{L}}{{2,5}}$') and w not in {names(R.COMMON_SHORT_WORDS)})) as int) as n from (select distinct name from b_columns) c")
add("fn10_name_variants", lambda d: J.name_variants(d.space_tables), "select * from o_variants")
add("fn11_line_count", lambda d: d.b_instructions.select("space_id", "ordinal", X.line_count(F.col("content")).cast("bigint").alias("n")),
    r"select space_id, ordinal, len(string_split(regexp_replace(content, '\n\z', ''), chr(10))) as n from b_instructions")
add("fn12_json", lambda d: d.b_instructions.select("space_id", "ordinal", X.json_has_key(F.col("content"), "join").alias("has_join_key")),
    "select space_id, ordinal, case when json_valid(content) then coalesce(list_contains(json_keys(content), 'join'), false) else false end as has_join_key from b_instructions")
add("fn13_map_lookup", lambda d: ST.distinct_tokens(d.columns).select("table_id", "token", F.try_element_at(F.create_map(*[F.lit(x) for p in R.ABBREVIATION_LABELS.items() for x in p]), F.col("token")).alias("label")),
    "select table_id, token, label from o_tokens left join o_labels on abbrev = token")
add("fn14_arithmetic", lambda d: d.orders.select("o_orderkey", F.greatest(F.lit(1), F.floor(F.col("o_orderkey") / 2)).alias("half"), F.least(F.col("o_custkey"), F.col("o_orderkey")).alias("least"), F.try_divide(F.col("o_custkey"), F.col("o_orderkey") % 3).alias("safe")),
    "select o_orderkey, greatest(1, o_orderkey // 2) as half, least(o_custkey, o_orderkey) as least, case when o_orderkey % 3 <> 0 then o_custkey / (o_orderkey % 3) end as safe from orders")
add("fn15_dates", lambda d: d.events.select("event_id", F.to_date("ts").alias("day"), F.date_trunc("month", "ts").cast("date").alias("month"), F.date_sub(F.to_date("ts"), 90).alias("earlier")),
    "select event_id, cast(ts as date) as day, cast(date_trunc('month', ts) as date) as month, cast(cast(ts as date) - interval 90 day as date) as earlier from events")
add("fn16_whole_percent", lambda d: M.coverage(d.space_tables, d.columns, d.tables).select("space_id", X.whole_percent(F.col("pct")).alias("percent")),
    f"select space_id, cast(cast(round_even(pct, 0) as bigint) as varchar) as percent from ({COVERAGE_SQL}) c")
add("fn17_output_key", lambda d: d.spaces.select("space_id", F.concat(X.safe_key(F.col("title")), F.lit("_2024-01-31.md")).alias("path"), (F.length(F.current_user()) > 0).alias("has_user")),
    "select space_id, regexp_replace(title, '[^a-zA-Z0-9_-]', '_', 'g') || '_2024-01-31.md' as path, true as has_user from b_spaces")


# ---- streaming --------------------------------------------------------------------------------
def audit_of(d: Data, events: DataFrame) -> DataFrame:
    """A stream of events bound to tables like the batch audit."""
    tables = d.b_tables.select("s_suppkey", F.col("table_id").alias("table_name"))
    return events.select(
        F.col("ts").alias("event_time"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_email"),
        F.when(F.col("event_id") % 7 == 0, "other").otherwise("getTable").alias("action_name"),
        F.expr(f"(event_id * 7 + user_id) % {d.supplier.count()} + {d.supplier.agg(F.min('s_suppkey')).first()[0]}").alias("s_suppkey"),
    ).join(tables, "s_suppkey")


def streamed(d: Data) -> DataFrame:
    """The events file read as a stream and run to its end."""
    events = d.spark.readStream.schema(d.events.schema).option("pathGlobFilter", "events.parquet").parquet(d.sf_dir)
    audit = audit_of(d, events)
    run = f"{shared_folder(d.spark)}/stream-{uuid.uuid4().hex}"
    query = coaccess.write_sessions(coaccess.coaccess_stream(audit), f"{run}/sessions", f"{run}/checkpoint")
    query.awaitTermination()
    return coaccess.session_table(d.spark, f"{run}/sessions")


def kept_current(d: Data) -> DataFrame:
    """The pair counts that a stream of the events keeps, which come in several batches and in no order."""
    run = f"{shared_folder(d.spark)}/stream-{uuid.uuid4().hex}"
    d.events.repartition(8).write.parquet(f"{run}/events")
    days = d.events.agg(F.date_diff(F.max("ts"), F.min("ts"))).first()[0] or 0
    events = d.spark.readStream.schema(d.events.schema).option("maxFilesPerTrigger", 2).parquet(f"{run}/events")
    sessions = coaccess.coaccess_stream(audit_of(d, events), f"{days + 1} days")
    coaccess.write_pairs(sessions, f"{run}/out", f"{run}/checkpoint").awaitTermination()
    return coaccess.kept_pairs(d.spark, f"{run}/out")


add("sx01_coaccess_stream", streamed, "select * from o_sessions")
add("sx01_kept_pairs", kept_current, """
    select a.table_name as table_a, b.table_name as table_b, cast(count(*) as bigint) as n_sessions
    from o_sessions a join o_sessions b on a."user" = b."user" and a.day = b.day and a.table_name < b.table_name
    group by a.table_name, b.table_name""")

# ---- area 0 -----------------------------------------------------------------------------------
add("rd01_structure_score", lambda d: RD.structure_score(counts(d)), "select space_id, structure as score from o_steps")
add("rd02_missing_join_findings", lambda d: RD.missing_join_findings(counts(d)),
    "select space_id, 'No joins configured for ' || table_count || ' tables; define joins so that questions over several tables work' as message from o_facts where table_count > 1 and join_count = 0")
add("rd03_missing_key_findings", lambda d: big(flat(RD.missing_key_findings(d.space_tables, d.b_table_constraints, 3), "tables"), "n_more"),
    "select space_id, shown as tables, n_more from (" + FIRST_K_SQL.format(rule="'x'", k=3, items="select space_id, ordinal as ord, short as item from o_members where not is_keyed and space_id in (select space_id from o_members where is_keyed)") + ") f")
add("rd04_unowned", lambda d: RD.unowned(d.space_tables, d.tables), "select space_id, table_id from o_members where coalesce(owner, '') = ''")
add("rd05_not_serverless", lambda d: RD.not_serverless(d.spaces, d.b_warehouses), "select space_id from o_facts where is_serverless = false")
add("rd06_not_shared", lambda d: RD.not_shared(d.spaces, d.acl), "select space_id from o_facts where not_shared")
add("rd07_warehouse_locked", lambda d: RD.warehouse_locked(d.spaces, d.acl), "select space_id from o_facts where warehouse_locked")
add("rd08_no_external_grant", lambda d: RD.no_external_grant(d.space_tables, d.b_table_grants, d.b_grant_status, d.tables), "select space_id, table_id from o_members where readable and not ext")
add("rd08_no_external_grant_strict", lambda d: RD.no_external_grant(d.space_tables, d.b_table_grants, d.b_grant_status, d.tables, True),
    f"""select space_id, table_id from o_members m where readable and not exists (
        select 1 from b_table_grants g join b_tables t on t.table_id = g.table_id where g.table_id = m.table_id
            and upper(g.action_type) in {names(R.GRANTING_ACTIONS)}
            and lower(g.principal) <> lower(coalesce(case when t.error is null then t.owner end, '')))""")
add("rd09_grants_unknown", lambda d: RD.grants_unknown(d.space_tables, d.b_grant_status), "select space_id, table_id from o_members where not readable")
add("rd10_readiness_score", lambda d: RD.readiness_score(RD.structure_score(counts(d)), RD.not_shared(d.spaces, d.acl), RD.warehouse_locked(d.spaces, d.acl),
    RD.no_external_grant(d.space_tables, d.b_table_grants, d.b_grant_status, d.tables), counts(d)), "select space_id, score_0 as score from o_scores")
add("rd11_metric_view_findings", lambda d: RD.metric_view_findings(d.space_tables, d.metric_views).withColumn("kind", F.expr("if(message like 'OK%', message, split(message, ':')[0])")).drop("message"),
    "select space_id, case rule_id when 'metric_views_in_space' then message when 'metric_views_extra' then 'Further metric views in the catalog, not in the space' "
    f"else 'Metric views in the catalog but none in the space' end as kind from ({findings_sql(named(0, ('metric_views_in_space', 'metric_views_extra', 'metric_views_only_in_catalog')), True)}) f")
add("rd12_untagged_spaces", lambda d: RD.untagged_spaces(d.space_tables, d.tables, d.b_table_tags), "select space_id from o_facts where base_tagged_count = 0 and base_count > 0")

# ---- area 1 -----------------------------------------------------------------------------------
add("cu01_table_budget_score", lambda d: CU.table_budget_score(base(d)), "select space_id, score_1 as score from o_scores")
add("cu02_schema_spread_findings", lambda d: CU.schema_spread_findings(CU.schema_spread(d.space_tables)), "select space_id, n_schemas from o_facts where n_schemas > 1")
add("cu03_too_many_tables", lambda d: CU.too_many_tables(base(d)), "select space_id, base_count as n from o_facts where base_count > 9")
add("cu04_table_layer", lambda d: CU.table_layer(d.space_tables, d.tables, d.b_table_tags),
    "select space_id, table_id, layer, case when layer_tag is not null then 'tagged: ' || layer_tag else 'name' end as evidence from o_member_rules where layer <> 'exempt'")
add("cu05_wide_tables", lambda d: CU.wide_tables(M.table_widths(d.columns)), "select table_id, n_cols from o_widths where n_cols > 50")
add("cu06_description_findings", lambda d: flat(CU.description_findings(d.spaces, d.b_description_verdicts), "missing"),
    """select space_id, kind, case when kind = 'incomplete' then array_to_string(missing, '|') else '' end as missing from (
        select s.space_id, v.missing, case when trim(coalesce(s.description, '')) = '' then 'empty' when length(trim(s.description)) < 80 then 'short'
            when len(coalesce(v.missing, [])) >= 2 then 'incomplete' end as kind from b_spaces s left join o_verdicts v on v.space_id = s.space_id) k where kind is not null""")  # fmt: skip


# ---- area 2 -----------------------------------------------------------------------------------
def per_space(d: Data, tables: DataFrame) -> DataFrame:
    """Sum of ``n`` over the readable tables of each space."""
    fine = d.tables.where("error is null").select("table_id")
    return d.space_tables.join(fine, "table_id", "left_semi").join(tables, "table_id").groupBy("space_id").agg(F.sum("n").alias("n"))


def metadata_score(d: Data) -> DataFrame:
    widths = M.table_widths(d.columns)
    thin = M.comment_findings(d.tables).where("kind = 'thin'").select("table_id", F.lit(1).alias("n"))
    return M.metadata_score(
        M.coverage(d.space_tables, d.columns, d.tables),
        per_space(d, widths.select("table_id", F.col("n_coded").alias("n"))),
        per_space(d, widths.select("table_id", F.col("n_date_string").alias("n"))),
        per_space(d, thin),
    )


add("md01_coverage_score", lambda d: M.coverage_score(M.coverage(d.space_tables, d.columns, d.tables)),
    f"select space_id, case when pct >= 80 then 3 when pct >= 50 then 2 else 1 end as score from ({COVERAGE_SQL}) c")
add("md02_metadata_score", metadata_score,
    f"select s.space_id, s.score_2 as score from o_scores s where s.space_id in (select space_id from ({COVERAGE_SQL}) c)")
add("md03_comment_findings", lambda d: big(M.comment_findings(d.tables), "length"),
    """select table_id, case when trim(comment) = '' then 'none' else 'thin' end as kind, length(trim(comment)) as length from b_tables
        where error is null and (trim(comment) = '' or (length(trim(comment)) < 50 and table_type <> 'METRIC_VIEW'))""")  # fmt: skip
add("md04_undocumented_tables", lambda d: M.undocumented_tables(d.tables, d.columns),
    "select table_id from b_tables where error is null and table_id not in (select table_id from o_columns where described)")
for key, rule, fn in (("md05_generic_comments", "generic", M.generic_comments), ("md06_coded_columns", "coded", M.coded_columns),
                      ("md07_date_as_string", "date_string", M.date_as_string), ("md08_technical_names", "technical", M.technical_names)):
    add(key, lambda d, fn=fn: fn(d.columns), f"select table_id, name from o_columns where {rule}")
add("md09_restricted_findings", lambda d: M.restricted_findings(d.space_tables, d.tables), "select space_id, table_id from o_members where has_row_filter or has_col_mask")
add("md10_unmapped_abbrevs", lambda d: M.unmapped_abbrevs(d.space_tables, d.columns.join(d.tables.where("error is null"), "table_id", "left_semi"),
    d.texts.select("space_id", "text"), d.synonyms, d.labels), "select * from o_unmapped")

# ---- area 3 -----------------------------------------------------------------------------------
add("cf01_sql_pattern_tags", lambda d: C.sql_pattern_tags(d.sqls), f"select space_id, sql_id, {', '.join(R.SQL_PATTERNS)} from o_sqls")
add("cf02_parameterised_sqls", lambda d: C.parameterised_sqls(d.sqls), "select space_id, sql_id from o_sqls where has_param")
add("cf03_hardcoded_sqls", lambda d: C.hardcoded_sqls(d.sqls), "select space_id, sql_id, substr(title, 1, 50) as title from o_sqls where hardcoded")
add("cf04_unknown_table_refs", lambda d: C.unknown_table_refs(d.sqls, d.space_tables), "select * from o_unknown")
add("cf04_unknown_table_refs_strict", lambda d: C.unknown_table_refs(d.sqls, d.space_tables, True),
    f"""select r.space_id, r.sql_id, min_by(r.ref, r.pos) as ref from (
            select space_id, sql_id, pos, lower(string_split(replace(raw, '`', ''), '.')[-1]) as ref
            from (select space_id, sql_id, unnest(r) as raw, generate_subscripts(r, 1) - 1 as pos from (
                select space_id, sql_id, regexp_extract_all(content, {pat(R.TABLE_REF_NARROW)}, 1) as r
                from o_sqls where not {has('content', R.PLACEHOLDER)}) x) y) r
        where r.ref <> '' and not exists (select 1 from (
                select distinct space_id, sql_id, lower(name) as name from (select space_id, sql_id,
                    unnest(regexp_extract_all(content, {pat(R.CTE_NARROW)}, 1)) as name from o_sqls) n) c
                where c.space_id = r.space_id and c.sql_id = r.sql_id and c.name = r.ref)
            and not exists (select 1 from b_space_tables s where s.space_id = r.space_id and lower(split_part(s.table_id, '.', 3)) = r.ref)
        group by r.space_id, r.sql_id""")
add("cf05_sql_subscore", lambda d: C.sql_subscore(counts(d), C.pattern_flags(d.sqls), C.unknown_table_refs(d.sqls, d.space_tables)), "select space_id, sql_sub as score from o_steps")
LINT_SQL = f"""select space_id, text_count, metric_hits, join_hits, vague_hits, lines, chars,
    array_to_string(list_filter([{', '.join(f"case when {c} then {lit(n)} end" for n, c in SECTIONS.items())}], lambda x: x is not null), '|') as sections,
    has_directives, n_inline, n_emphatic, n_long from o_text_facts"""
add("cf06_text_lint", lambda d: flat(C.text_lint(d.texts), "sections"), LINT_SQL)
add("cf07_text_subscore", lambda d: C.text_subscore(C.text_lint(d.texts)), "select space_id, text_sub as score from o_steps where text_count > 0")
add("cf08_config_score", lambda d: C.config_score(C.sql_subscore(counts(d), C.pattern_flags(d.sqls), C.unknown_table_refs(d.sqls, d.space_tables)), C.text_subscore(C.text_lint(d.texts))),
    "select space_id, cast(greatest(1, (sql_sub + text_sub) // 2) as int) as score from o_steps")
add("cf09_sql_findings", lambda d: FD.area_findings(bare(d), 3, C.SQL_FINDINGS, False).select("space_id", F.col("seq").cast("bigint"), "rule_id"),
    f"select space_id, seq, rule_id from ({findings_sql(named(3, C.SQL_FINDINGS))}) f")
add("cf10_text_findings", lambda d: FD.area_findings(bare(d), 3, C.TEXT_FINDINGS, False).select("space_id", F.col("seq").cast("bigint"), "rule_id"),
    f"select space_id, seq, rule_id from ({findings_sql(named(3, C.TEXT_FINDINGS))}) f")
add("cf11_join_completeness", lambda d: C.join_completeness(base(d), counts(d)),
    "select space_id, join_count as joins, base_count - 1 as needed from o_facts where base_count > 1 and join_count > 0 and join_count < base_count - 1")
SEMANTIC = ("no_expressions", "no_measures", "no_synonyms", "few_expressions")
add("cf12_semantic_findings", lambda d: C.semantic_findings(d.spaces, d.expressions, d.synonyms, J.held_metric_views(d.metric_views, d.space_tables)).select("space_id", "message"),
    f"select space_id, message from ({findings_sql(named(3, SEMANTIC), True)}) f")
GAPS = {"gap_time": "time trends, but no example SQL filters by time", "gap_join": "several tables at once, but no example SQL joins tables",
        "gap_topn": "rankings, but no example SQL orders and limits", "gap_compare": "comparisons, but no example SQL compares periods"}
add("cf13_question_alignment", lambda d: Q.question_alignment(d.questions, C.pattern_flags(d.sqls), counts(d)),
    " union all ".join(f"select space_id, {lit(t)} as gap from o_steps where {g}" for g, t in GAPS.items()))
add("cf14_schema_dump_density", lambda d: C.schema_dump_density(d.texts), "select space_id, schema_hits, business_hits, schema_hits > 3 as is_dump from o_text_facts")
add("cf15_text_defects", lambda d: C.text_defects(C.text_lint(d.texts), C.schema_dump_density(d.texts)),
    "select space_id, 'reads like a data dictionary' as defect from o_text_facts where schema_hits > 3 "
    "union all select space_id, 'holds inline SQL' from o_text_facts where n_inline > 0 "
    "union all select space_id, 'holds emphatic overrides' from o_text_facts where n_emphatic > 0 "
    "union all select space_id, 'too long: ' || lines || ' lines' from o_text_facts where lines > 100")

# ---- areas 4 and 5, verdict -------------------------------------------------------------------
add("sq01_sample_score", lambda d: Q.sample_score(counts(d)), "select space_id, case when samples >= 10 then 3 when samples >= 5 then 2 else 1 end as score from o_facts")
add("sq02_sample_findings", lambda d: Q.sample_findings(counts(d)),
    f"select space_id, message from ({findings_sql(named(4, ('no_samples', 'few_samples', 'sample_diversity')), True)}) f")
add("sq03_uncovered_tables", lambda d: Q.uncovered_tables(d.space_tables, d.questions), "select space_id, table_id from o_uncovered")
add("sq03_covered_sample_score", lambda d: Q.covered_sample_score(counts(d), Q.uncovered_tables(d.space_tables, d.questions)), "select space_id, score_4 as score from o_scores")
add("bm01_benchmark_score", lambda d: Q.benchmark_score(counts(d)), "select space_id, score_5 as score from o_scores")
add("bm02_missing_gold_sql", lambda d: Q.missing_gold_sql(d.questions), "select space_id, n_missing_gold as n from o_facts where n_missing_gold > 0")
add("bm03_hardcoded_gold_sql", lambda d: Q.hardcoded_gold_sql(d.questions),
    f"select space_id, substr(question_text, 1, 50) as question_text from o_questions where question_type = 'BENCHMARK' and {has('answer_text', R.HARDCODED_GOLD_SQL)}")
add("bm04_benchmark_findings", lambda d: Q.benchmark_findings(counts(d)),
    f"select space_id, message from ({findings_sql(named(5, ('no_benchmarks', 'few_benchmarks', 'some_benchmarks')), True)}) f")
add("vd01_verdict", lambda d: big(S.verdict(areas(d)), "total", "max_total"), "select space_id, total, max_total, pct, verdict from o_totals")
add("vd02_capped_verdict", lambda d: (lambda a: flat(S.capped_verdict(S.verdict(a), a), "blockers"))(areas(d)),
    "select space_id, blockers, case when verdict = 'PRODUCTION READY' and blockers <> '' then 'NEEDS IMPROVEMENT' else verdict end as verdict from o_totals")
add("vd02_scorecard", card, f"{CARD_SQL} {CARD_FROM}")

# ---- recommendations --------------------------------------------------------------------------
# For each area, the condition of each next step by score, in order.
NEED = "greatest(0, base_count - 1)"
STEP_CONDITIONS = {
    0: {1: ["join_count = 0 and keyed = 0", "join_count > 0 and keyed = 0", "not_shared", "warehouse_locked", "ungranted_count > 0"],
        2: [f"table_count > 1 and join_count < {NEED}", "keyed = 0 and table_count > 0", "keyed > 0 and keyed < table_count",
            "not_shared", "warehouse_locked", "ungranted_count > 0", "unknown_grant_count > 0", "true"]},
    1: {1: ["true"] * 4 + ["n_non_gold > 0 or n_unclear > 0", "true", "true"],
        2: ["true", "description = ''", "n_non_gold > 0", "n_wide > 0", "n_unclear > 0", "true"]},
    2: {1: ["pct < 80", "pct < 80", "pct < 80", "pct >= 80", "n_no_comment = table_count", "true", "n_date_string > 0", "n_unmapped > 0"],
        2: ["true", "n_thin > 0", "n_no_comment > 0", "true", "n_coded > 0", "n_date_string > 0", "n_unmapped > 0"]},
    3: {1: ["sql_sub = 1", "sql_sub = 1", "text_sub = 1", "text_sub = 1", "text_sub = 1", "mv_count = 0 and expr_count = 0"],
        2: ["sql_sub < 3", f"sql_sub < 3 and ({PATTERN_MISSING})", "sql_sub < 3 and n_hardcoded > 0",
            "sql_sub < 3 and (gap_time or gap_join or gap_topn or gap_compare)", "text_sub < 3 and n_inline > 0",
            "text_sub < 3 and metric_hits > 0", "text_sub < 3 and join_hits > 0", "text_sub < 3 and n_sections < 4",
            "text_sub < 3 and lines > 100", "text_sub < 3", "base_count > 1 and join_count > 0 and join_count < base_count - 1",
            "mv_count = 0 and expr_count = 0", "mv_count = 0 and expr_count > 0 and n_measures = 0",
            "mv_count = 0 and expr_count > 0 and n_synonyms = 0"]},
    4: {1: ["true"] * 4, 2: ["true"] * 4 + ["n_uncovered > 0"]},
    5: {1: ["true"] * 5, 2: ["true"] * 4 + ["n_missing_gold > 0", "true"]},
}


def steps_sql(area: int) -> str:
    counted = {s: " + ".join(f"cast(({c}) as bigint)" for c in conds) for s, conds in STEP_CONDITIONS[area].items()}
    n = " ".join(f"when score_{area} = {s} then {c}" for s, c in counted.items())
    return f"""select space_id, {area} as area, severity, n_items from (select space_id, case score_{area} when 1 then 'CRITICAL' else 'IMPROVE' end as severity,
        case {n} end as n_items from o_scores where score_{area} < 3) r where n_items > 0"""


def step_counts(d: Data, area: int) -> DataFrame:
    return RC.area_items(bare(d), [area]).groupBy("space_id", "area", "severity").agg(F.count("item").alias("n_items"))


ALL_STEPS_SQL = " union all ".join(steps_sql(a) for a in R.AREAS)
add(
    "jn09_attach_recommendations",
    lambda d: (lambda s: J.attach_recommendations(S.area_scores(s), RC.area_items(s)).groupBy("space_id", "area", "score").agg(F.count("item").alias("n_items")))(bare(d)),
    f"select a.space_id, a.area, a.score, coalesce(n.n_items, 0) as n_items from o_areas a left join ({ALL_STEPS_SQL}) n on n.space_id = a.space_id and n.area = a.area",
)
add("rc01_severity", lambda d: RC.severity(areas(d)), "select space_id, area, case score when 1 then 'CRITICAL' else 'IMPROVE' end as severity from o_areas where score < 3")
for i, key in enumerate(("rc02_readiness_items", "rc03_curation_items", "rc04_metadata_items", "rc05_configuration_items", "rc06_sample_items", "rc07_benchmark_items")):
    add(key, lambda d, i=i: step_counts(d, i), steps_sql(i))
add("snk03_recommendations", lambda d: written(RC.area_items(bare(d)).groupBy("space_id", "area", "severity").agg(F.count("item").alias("n_items")), sinks.write_recommendations),
    f"select *, date '2024-01-31' as run_date from ({ALL_STEPS_SQL}) w")
N_FOUND_SQL = f"""select a.space_id, greatest(count(r.rule_id), 1) as n from o_areas a
    left join ({findings_sql()}) r on r.space_id = a.space_id and r.area = a.area group by a.space_id, a.area"""
add("snk04_report_rows", lambda d: A.report_rows(scored(d), AS_OF).select("space_id", "path", F.size(F.split("document", "\n")).cast("bigint").alias("n_lines")),
    f"""select s.space_id, regexp_replace(s.title, '[^a-zA-Z0-9_-]', '_', 'g') || '_2024-01-31.md' as path,
        cast(9 + 6 + 4 + 6 * 2 + f.n + coalesce(t.n, 0) as bigint) as n_lines from o_scores s
        join (select space_id, sum(n) as n from ({N_FOUND_SQL}) x group by space_id) f on f.space_id = s.space_id
        left join (select space_id, sum(n_items + 2) as n from ({ALL_STEPS_SQL}) y group by space_id) t on t.space_id = s.space_id""")  # fmt: skip
# Wording of the pattern gaps, each with the condition under which it is missing.
GAP_PATTERNS = [
    ("sql = 0 or not has_agg", "totals and counts by group"),
    ("sql = 0 or not has_date", "a period chosen by a date parameter"),
    ("sql = 0 or not has_topn", "the largest or smallest few of a ranking"),
    ("sql = 0 or not has_compare", "one period against the one before"),
    ("table_count > 1 and (sql = 0 or not has_join)", "columns of several tables, joined"),
    ("sql = 0 and table_count <= 1", "rows that meet a condition"),
    ("sql > 0 and not has_param", "any value given as a :parameter"),
]
add("rc08_pattern_gaps", lambda d: big(C.pattern_gaps(counts(d), C.pattern_flags(d.sqls)), "seq"),
    "select space_id, row_number() over (partition by space_id order by k) as seq, pattern from ("
    + " union all ".join(f"select space_id, {i} as k, {lit(t)} as pattern from o_facts where {c}" for i, (c, t) in enumerate(GAP_PATTERNS)) + ") g")
add("rc09_needs_domain_split", lambda d: CU.spaces_to_split(d.space_tables, d.metric_views), "select space_id from o_scores where score_1 < 3 or n_schemas > 1")
add("rc10_metadata_digest", lambda d: M.metadata_digest(d.space_tables, d.tables, d.columns),
    f"""select m.space_id, string_agg('Table: ' || m.short || chr(10) || 'Description: ' || trim(coalesce(nullif(m.comment, ''), 'No description'))
        || chr(10) || 'Columns: ' || coalesce(g.digest, ''), chr(10) || chr(10) order by m.ordinal) as digest
        from o_members m left join ({DIGEST_SQL}) g on g.table_id = m.table_id where m.error is null group by m.space_id""")  # fmt: skip

# ---- analytic shapes --------------------------------------------------------------------------
IN_YEAR = "o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'"
add("an01_total_by_dimension", lambda d: dbl(AN.total_by_dimension(d.orders, "o_orderpriority", "o_totalprice", "o_orderdate", *YEAR), "total_metric"),
    f"select o_orderpriority, {summed('o_totalprice')} as total_metric from orders where {IN_YEAR} group by o_orderpriority")
add("an02_join_total", lambda d: dbl(AN.join_total(d.orders, d.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "c_mktsegment", "o_totalprice", "o_orderdate", *YEAR), "total_metric"),
    f"select c_mktsegment, {summed('o_totalprice')} as total_metric from orders join customer on c_custkey = o_custkey where {IN_YEAR} group by c_mktsegment")
add("an03_monthly_trend", lambda d: dbl(AN.monthly_trend(d.orders, "o_orderdate", "o_totalprice", *YEAR), "total_metric"),
    f"select cast(date_trunc('month', o_orderdate) as date) as month, {summed('o_totalprice')} as total_metric from orders where {IN_YEAR} group by 1")
add("an04_top_n", lambda d: dbl(AN.top_n(d.orders, "o_custkey", "o_totalprice", 10, "o_orderdate", *YEAR), "total_metric"),
    f"select o_custkey, {summed('o_totalprice')} as total_metric from orders where {IN_YEAR} group by o_custkey order by total_metric desc, o_custkey limit 10")
add("an05_period_over_period", lambda d: dbl(AN.period_over_period(d.orders, "o_orderpriority", "o_totalprice", "o_orderdate", YEAR, PREV_YEAR), "current", "previous"), SUMS_SQL)
add("an06_parameterised", lambda d: dbl(AN.parameterised(d.spark, "select o_orderpriority, sum(cast(o_totalprice as decimal(18,2))) as total_metric from {orders} "
    "where o_orderdate >= :start_date and o_orderdate < :end_date and o_orderstatus = :status group by o_orderpriority",
    {"start_date": YEAR[0], "end_date": YEAR[1], "status": "F"}, orders=d.orders), "total_metric"),
    f"select o_orderpriority, {summed('o_totalprice')} as total_metric from orders where {IN_YEAR} and o_orderstatus = 'F' group by o_orderpriority")
add("an07_daily_count_sum", lambda d: dbl(AN.daily_count_sum(d.events, "ts", F.col("event_type") == "purchase", "value", *WEEK), "total_metric"),
    f"select cast(ts as date) as day, count(*) as n, {summed('value')} as total_metric from events where ts >= date '2024-01-15' and ts < date '2024-01-22' and event_type = 'purchase' group by 1")
add("an08_period_change", lambda d: AN.period_change(d.events, "ts", F.col("event_type") == "error", WEEK, PREV_WEEK).withColumn("percent_change", F.col("percent_change").cast("double")),
    """select current, previous, current - previous as absolute_change, case when previous <> 0 then round((current - previous) * 100.0 / previous, 2) end as percent_change
        from (select count(*) filter (where ts >= date '2024-01-15' and ts < date '2024-01-22') as current,
            count(*) filter (where ts >= date '2024-01-08' and ts < date '2024-01-15') as previous from events where event_type = 'error') c""")  # fmt: skip
add("an09_related_events", lambda d: AN.related_events(
    d.events.select("user_id", F.to_date("ts").alias("day"), F.col("ts").alias("a_ts"), F.col("event_id").alias("a_id"), F.col("event_type").alias("a_type")),
    d.events.select("user_id", F.to_date("ts").alias("day"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b_id"), F.col("event_type").alias("b_type")),
    ["user_id", "day"], ("a_ts", *WEEK), ("b_ts", PREV_WEEK[0], WEEK[1]), F.col("a_type") == "purchase", F.col("b_type") == "error").select("user_id", "day", "a_id", "b_id"), RANGED_SQL)
add("an10_profile_stats", lambda d: dbl(AN.profile_stats(d.orders, d.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", ["c_mktsegment", "o_orderstatus"], "o_totalprice", F.col("c_acctbal") > 0), "sum"),
    f"select c_mktsegment, o_orderstatus, count(*) as n, {summed('o_totalprice')} / count(*) as avg, {summed('o_totalprice')} as sum from orders join customer on c_custkey = o_custkey where c_acctbal > 0 group by c_mktsegment, o_orderstatus")
add("an11_metric_value", lambda d: AN.metric_value(d.b_metrics_mart, "R", "ratio"), f"select ratio as value from ({MART_SQL}) m")
add("an12_rate", lambda d: AN.rate(d.events, F.col("event_type") == "error", "event_type"),
    "select event_type, count(*) filter (where event_type = 'error') as hits, count(*) as n, count(*) filter (where event_type = 'error') / count(*) as rate from events group by event_type")
add("an13_filtered_rolling_count", lambda d: AN.filtered_rolling_count(d.events, "ts", F.col("value") > 10, 7, "2024-01-20"),
    "select count(*) as n from events where ts >= date '2024-01-13' and ts < date '2024-01-20' and value > 10")
add("an14_same_day_both", lambda d: AN.same_day_both(d.events.where("event_type = 'error'"), d.events.where("event_type = 'purchase'"), "user_id", "ts"),
    "select distinct user_id, cast(ts as date) as day from events where event_type = 'error' intersect select distinct user_id, cast(ts as date) as day from events where event_type = 'purchase'")
add("an15_lineage_edges", lambda d: big(U.lineage_edges(d.b_lineage, d.space_tables, AS_OF, DAYS), "rank"), TOP_EDGES_SQL.format(k=30))
add("an16_coaccess_pairs", lambda d: big(U.coaccess_pairs(d.b_audit, d.space_tables, AS_OF, DAYS), "rank"), TOP_PAIRS_SQL.format(k=10))
add("an17_period_lag", lambda d: dbl(AN.period_lag(d.lineitem, "l_returnflag", "l_shipdate", "l_extendedprice"), "value", "previous"),
    f"""select l_returnflag, period, value, lag(value) over (partition by l_returnflag order by period) as previous from (
        select l_returnflag, cast(date_trunc('month', l_shipdate) as date) as period, {summed('l_extendedprice')} as value from lineitem group by 1, 2) m""")  # fmt: skip


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES[name][0](Data(spark, sf_dir))


def oracle(name: str) -> str | None:
    sql = ENTRIES[name][1]
    return None if sql is None else compose(sql)
