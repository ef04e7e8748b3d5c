"""Audit inputs as projections of the whole test tables, in SQL that Spark and DuckDB both run.

The same text feeds the Spark job and, as a CTE, the query that checks it. No binding drops rows to get
smaller: what an operator should ignore (other constraint types, entries of unknown objects, drafts) is
left in for it to ignore.
"""

BINDINGS = {
    "b_spaces": """
        select c_custkey as space_id, c_name as title,
            case c_custkey % 3 when 0 then '' when 1 then 'Short ' || c_mktsegment
                else 'Revenue metrics by segment and region for analysts in ' || c_mktsegment
                    || '; one row per order line, refreshed daily.' end as description,
            'w' || c_nationkey as warehouse_id
        from customer
        union all
        select -1 - s_suppkey as space_id, s_name as title, null as description, '' as warehouse_id from supplier
    """,
    "b_warehouses": """
        select 'w' || n_nationkey as warehouse_id,
            case n_nationkey % 3 when 0 then true when 1 then false end as is_serverless
        from nation
    """,
    "b_tables": """
        select s_suppkey,
            'main.' || case s_nationkey % 4 when 0 then 'gold' when 1 then 'raw_zone' when 2 then 'sales' else 'risk' end
                || '.' || case s_suppkey % 5 when 0 then 'order_' || s_suppkey || '_events'
                    when 1 then 'stg_' || s_suppkey || '_accounts' when 2 then 'x' || s_suppkey || '_categories'
                    when 3 then 'fraud_' || s_suppkey || '_state' else 'metrics_' || s_suppkey || '_logins' end as table_id,
            case s_suppkey % 3 when 0 then '' when 1 then 'Thin note'
                else 'One row per business event with amounts, dates and customer links' end as comment,
            case when s_suppkey % 7 = 0 then null else 'owner' || s_nationkey end as owner,
            case s_suppkey % 5 when 4 then 'METRIC_VIEW' when 3 then 'VIEW' else 'BASE TABLE' end as table_type,
            s_suppkey % 11 = 0 as has_row_filter,
            s_suppkey % 13 = 0 as has_col_mask,
            case when s_suppkey % 50 = 49 then 'unreadable' end as error
        from supplier
    """,
    "b_space_tables": """
        select space_id, t.table_id, t.s_suppkey as ordinal
        from (
            select distinct space_id, s from (
                select o.o_custkey as space_id, min(l.l_suppkey) as s
                from orders o join lineitem l on l.l_orderkey = o.o_orderkey
                group by o.o_custkey, o.o_orderstatus, o.o_orderpriority
            ) picked
        ) member
        join b_tables t on t.s_suppkey = member.s
    """,
    "b_columns": """
        select t.table_id, c.ordinal,
            replace(c.part_name, ' ', '_') || '_' || c.ordinal
                || case (c.ordinal + t.s_suppkey) % 24 when 0 then '_status' when 1 then '_cd' when 2 then '_amt'
                    when 3 then '_created_at' when 4 then '_id' when 5 then '_rm' when 6 then '_kpi' else '_name' end as name,
            case (c.ordinal + t.s_suppkey) % 48 when 3 then 'STRING' when 10 then 'DATE' else 'BIGINT' end as data_type,
            case when c.ordinal % 10 >= case when t.s_suppkey % 13 = 0 then 0 else 4 + t.s_suppkey % 9 end then ''
                when (c.ordinal + t.s_suppkey) % 4 = 0 then 'Status: A=Active, I=Inactive'
                when c.ordinal % 4 = 1 then 'Primary key of the record' else 'Plain business description' end as comment
        from (
            select l.l_suppkey as s, l.l_partkey % (3 + l.l_suppkey % 10 * 6) as ordinal, min(p.p_name) as part_name
            from lineitem l join part p on p.p_partkey = l.l_partkey
            group by l.l_suppkey, l.l_partkey % (3 + l.l_suppkey % 10 * 6)
        ) c
        join b_tables t on t.s_suppkey = c.s
    """,
    "b_table_tags": """
        select case when s_suppkey % 5 = 2 then 'other.' || table_id else table_id end as table_id,
            case s_suppkey % 4 when 0 then 'layer' when 1 then 'Data_Tier' else 'domain' end as tag_name,
            case s_suppkey % 6 when 0 then 'Gold' when 1 then 'Bronze' when 2 then 'finance' else 'silver' end as tag_value,
            0 as ordinal
        from b_tables
    """,
    "b_table_constraints": """
        select table_id,
            case s_suppkey % 6 when 0 then 'PRIMARY KEY' when 3 then 'FOREIGN KEY' else 'CHECK' end as constraint_type
        from b_tables
    """,
    "b_table_grants": """
        select t.table_id, 'owner' || (g.n % 25) as principal,
            case g.n % 7 when 0 then 'SELECT' when 1 then 'ALL PRIVILEGES' when 2 then 'MODIFY' when 3 then 'MODIFY'
                else 'ALL_PRIVILEGES' end as action_type
        from (select l_suppkey as s, l_returnflag, count(*) as n from lineitem group by l_suppkey, l_returnflag) g
        join b_tables t on t.s_suppkey = g.s
    """,
    "b_grant_status": """
        select table_id, s_suppkey % 9 <> 0 as readable from b_tables
    """,
    "b_acl": """
        select 'space' as object_type,
            case when c_custkey % 4 = 0 then 'archived-' || c_custkey else cast(c_custkey as string) end as object_id,
            case c_custkey % 3 when 0 then 'u' || c_custkey end as user_name,
            case c_custkey % 3 when 1 then 'admins' when 2 then 'analysts' end as group_name,
            case c_custkey % 2 when 0 then 'CAN_USE' else 'CAN_MANAGE' end as level
        from customer
        union all
        select 'warehouse' as object_type,
            case when n_nationkey % 5 = 0 then 'old-' || n_nationkey else 'w' || n_nationkey end as object_id,
            cast(null as string) as user_name,
            case n_nationkey % 2 when 0 then 'analysts' else 'admins' end as group_name,
            'CAN_USE' as level
        from nation
    """,
    "b_instructions": """
        select o_custkey as space_id, o_orderkey as ordinal,
            case when o_orderpriority = '1-URGENT' then 'TEXT_INSTRUCTION'
                when o_custkey % 5 = 1 and o_orderpriority <> '2-HIGH' then 'FROM_SNIPPET'
                when o_custkey % 5 = 0 or o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'SQL_INSTRUCTION'
                when o_orderpriority = '4-NOT SPECIFIED' then 'SQL_SNIPPET'
                else 'FROM_SNIPPET' end as instruction_type,
            'Item ' || o_orderkey as title,
            case
                when o_custkey % 5 = 0 and o_orderpriority = '1-URGENT' then case o_orderkey % 2
                    when 0 then '## Critical rules' || chr(10) || '- Always filter closed orders'
                    else '## Business terms' || chr(10) || 'RM means manager' end
                when o_custkey % 5 = 0 then case o_orderkey % 3
                    when 0 then 'SELECT [dim], SUM(v) FROM t JOIN u ON t.k = u.k GROUP BY 1 ORDER BY 2 DESC LIMIT 10'
                    when 1 then 'SELECT v FROM [t] WHERE order_date >= :start_date'
                    else 'SELECT LAG(v) OVER (ORDER BY month) FROM [t]' end
                when o_custkey % 5 = 1 and o_orderpriority not in ('1-URGENT', '2-HIGH') then '{"join":{"left":"a"}}'
                when o_orderpriority = '1-URGENT' then case o_orderkey % 7
                    when 0 then '## Role' || chr(10) || 'You help analysts.'
                    when 1 then '## Critical rules' || chr(10) || 'Always filter closed orders.'
                    when 2 then 'revenue = price times quantity, divided by days, then the sum'
                    when 3 then '**IMPORTANT: careful** consider and try to join the orders table'
                    when 4 then 'of all lines. This table stores all orders; foreign key as in SELECT a, b FROM t'
                    when 5 then 'Use the sum'
                    else '## Business terms' || chr(10) || 'RM means manager' || chr(10) || '## Date handling'
                        || chr(10) || 'When asked use order date' end
                when o_orderpriority = '4-NOT SPECIFIED' then case o_orderkey % 4
                    when 0 then '{"type":"SQL_MEASURE","display_name":"m","code":"SUM(x)","synonyms":["rm","net","key"]}'
                    when 1 then '{"type":"FILTER","alias":"f","code":"a = 1","synonyms":["performance indicator"]}'
                    when 2 then '{"code":"COUNT(*)"}' else '{bad' end
                when o_orderpriority = '5-LOW' then case o_orderkey % 3 when 0 then '{"join":{"left":"a"}}'
                    when 1 then '{"comment":"join"}' else '{bad' end
                else case o_orderkey % 7
                    when 0 then 'SELECT dim, SUM(v) FROM order_0_events GROUP BY dim ORDER BY 2 DESC LIMIT 10'
                    when 1 then 'SELECT * FROM a JOIN b ON a.k = b.k'
                    when 2 then 'SELECT v FROM stg_1_accounts WHERE order_date >= :start_date'
                    when 3 then 'SELECT v FROM fraud_3_state WHERE s = ' || chr(39) || 'OPEN' || chr(39)
                    when 4 then 'SELECT LAG(v) OVER (ORDER BY month) FROM metrics_4_logins'
                    when 5 then 'WITH c AS (SELECT 1 v), d AS (SELECT v FROM c) SELECT v FROM d'
                    else 'SELECT [col] FROM nowhere' end end as content
        from orders
    """,
    "b_questions": """
        select o_custkey as space_id, o_orderkey as question_id,
            case when o_orderstatus = 'P' then 'DRAFT' when o_custkey % 3 = 0 then 'SAMPLE_QUESTION'
                when o_custkey % 3 = 1 then 'BENCHMARK' when o_orderstatus = 'F' then 'SAMPLE_QUESTION'
                else 'BENCHMARK' end as question_type,
            case o_orderkey % 6 when 0 then 'What is the monthly trend of order events?'
                when 1 then 'Top 5 accounts by revenue' when 2 then 'Compare this month vs last'
                when 3 then 'Breakdown by fraud state' when 4 then '7 days of logins'
                else 'How many logins failed?' end as question_text,
            case o_orderkey % 4 when 0 then null when 1 then '  '
                when 2 then 'SELECT 1 FROM t WHERE id = 1234567' else 'SELECT COUNT(*) FROM t' end as answer_text
        from orders
    """,
    "b_audit": """
        select e.event_id, e.ts as event_time, 'u' || e.user_id as user_email,
            case e.event_id % 7 when 0 then 'other' else 'getTable' end as action_name, t.table_id as table_name
        from (select *, (event_id * 7 + user_id) % (select count(*) from supplier) + (select min(s_suppkey) from supplier) as k from events) e
        join b_tables t on t.s_suppkey = e.k
    """,
    "b_lineage": """
        select e.event_id, e.ts as event_time, t.table_id as source_table,
            case when e.user_id % 4 = 0 then null else u.table_id end as target_table
        from (select *, (event_id * 7 + user_id) % (select count(*) from supplier) + (select min(s_suppkey) from supplier) as k, (user_id * 13 + event_id) % (select count(*) from supplier) + (select min(s_suppkey) from supplier) as k2 from events) e
        join b_tables t on t.s_suppkey = e.k
        join b_tables u on u.s_suppkey = e.k2
    """,
    "b_metrics_mart": """
        select l_returnflag as metric_alias, l_shipdate as metric_date,
            cast(l_extendedprice * l_discount as decimal(18,4)) as value_num,
            cast(l_extendedprice as decimal(18,2)) as value_denom
        from lineitem
    """,
    "b_description_verdicts": """
        select case when c_custkey % 9 = 0 then -1000000000 - c_custkey else c_custkey end as space_id,
            c_custkey % 2 = 0 as metrics, c_custkey % 5 <> 0 as dimensions, c_custkey % 7 <> 0 as grain,
            c_nationkey % 2 = 0 as users
        from customer
    """,
    "b_describe_rows": """
        select table_id, 'Comment' as col_name, comment as data_type from b_tables
        union all
        select table_id, 'Owner' as col_name, owner as data_type from b_tables where owner is not null
        union all
        select table_id, 'Row Filter' as col_name, 'f' as data_type from b_tables where has_row_filter
        union all
        select table_id, '# Column Masks' as col_name, '' as data_type from b_tables where has_col_mask
    """,
    "b_generated_sql": """
        select c_custkey as space_id,
            'Title: Sales for ' || c_mktsegment || chr(10) || 'SQL:' || chr(10) || 'SELECT 1' || chr(10) || '---' || chr(10)
                || case c_custkey % 2 when 0 then 'no title here'
                    else 'Title: Second' || chr(10) || 'SQL:' || chr(10) || 'SELECT 2' end as text
        from customer
    """,
}
