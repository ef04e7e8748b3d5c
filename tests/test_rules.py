"""Rules against Python's regular expressions, whose meaning they are defined by."""

import re

from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X

TEXTS = [
    "", " ", "status", "Status", "status_x", "order_state", "A=Active", "A = Active", "Y/N", "true/false", "PK", "PKs", "the pk.",
    "Foreign Key", "foreign\nkey", "foreign key", "stores the", "date", "update", "created_at", "created_at2", "up_on", "x_dt",
    "x_cd", "x_CD", "x_cdx", "amt", "= 'OPEN'", "= 'OPE'", "= 'open'", "WHERE a = 'x'", "where a = 'x'", "= 12345", "= 1234",
    ":p", "a::b", "{{x}}", "{{x\ny}}", "getArgument(", "JOIN", "joins", "SUM(x)", "sum of", "sum\n of", "sum  of", "group by",
    "ORDER BY x LIMIT 5", "ORDER BY\nx\nLIMIT 5", "ORDER BY LIMIT", "ORDER BY " + "x" * 250 + " LIMIT 5", "LAG (", "prior_period",
    "year over year", "year-over-year", "yoy", "yoyx", "previous month", "previous__year", "[x]", "{x}", "[x\n]",
    "FROM a.b.c JOIN `d`", "WITH c AS (SELECT 1), d as (SELECT 2)", "EXTRACT(year FROM ts)", "revenue = x", "margin:", "profit",
    "join the orders table", "related to a table", "joined " + "x" * 60 + " table", "relates to", "consider", "try to", "if possible",
    "handle nulls", "ask follow-up", "you might", "- when asked", "* Always x", "• never y", "if a user", "if user", "do not",
    "x do not", "line\n  - do not", "## Role", "  # About us", "text # role", "## Roles", "\n\n## Date handling", "SELECT a FROM b",
    "SELECT a, b, c FROM t", "SELECT\nabcdef\nFROM", "**IMPORTANT** x", "** always ** y **", "!! stop", "!stop", "dateé",
    "édate", "line ## Role", "a\r\nb", "trend", "trending", "last 5", "last 5x", "top 10", "bottom 3x", "vs", "vs.",
    "This table", "This analytics space contains", "KPI", "default x filter", "NULL values mean", "include only", "excluded",
    "sum\u00a0of", "join\u00a0a table", "x\u2028# Role", "x\u2028- always", "a=b\u00a0", "\u00e9date x", "relates\u3000to",
    "rm", "kpi", "a", "abcdef", "äö", "r2", "raw_x", "main.stg_1", "trailing \n",
]


def all_rules():
    found = [v for v in vars(R).values() if isinstance(v, R.Rule)]
    for group in (R.SQL_PATTERNS, R.SECTIONS, R.QUESTION_PATTERNS):
        found += list(group.values())
    return found + [*R.SCHEMA_DUMP_RULES, *R.BUSINESS_RULES]


def test_rules_agree_with_python(spark):
    rules = all_rules()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    exprs = [f"{r.count_sql('t')} as c{n}" for n, r in enumerate(rules)]
    exprs += [f"{r.hit_sql('t')} as h{n}" for n, r in enumerate(rules)]
    rows = {r["i"]: r for r in df.selectExpr("i", *exprs).collect()}
    wrong = []
    for n, rule in enumerate(rules):
        flags = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in rule.flags)
        pattern = re.compile(rule.pattern.replace(r"\p{L}", r"[^\W\d_]"), flags)
        for i, text in enumerate(TEXTS):
            expected = sum(1 for _ in pattern.finditer(text))
            if rows[i][f"c{n}"] != expected or rows[i][f"h{n}"] != (expected > 0):
                wrong.append((rule.name, text, expected, rows[i][f"c{n}"]))
    assert wrong == []


def test_line_count(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb", "a\rb\n", "a b", "x\x0cy", "a\x1cb", "a\n\nb\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", X.line_count(F.col("t")).alias("n"), F.expr(X.line_count_sql("t")).alias("m")).collect()
    assert [(r["n"], r["m"]) for r in rows] == [(len(t.splitlines()),) * 2 for t in texts]


def test_name_variants(spark):
    cases = {
        "m.g.categories": {"categories", "category", "categorie"},
        "m.g.order_events": {"order_events", "order_event", "order", "events", "event"},
        "m.g.assesses": {"assesses", "assess", "assesse"},
        "m.g.boxes": {"boxes", "box", "boxe"},
        "m.g.bus": {"bus"},
        "m.g.fraud_state": {"fraud_state", "fraud", "state"},
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: set(r["v"]) for r in df.select("t", X.name_variants(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_whole_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (66.6,)], "p double")
    assert [r[0] for r in df.select(X.whole_percent(F.col("p"))).collect()] == ["0", "2", "2", "67"]


def test_fixed_lists():
    assert len(R.ABBREVIATION_LABELS) == 33
    assert len(R.COMMON_SHORT_WORDS) == len(set(R.COMMON_SHORT_WORDS))


def test_rules_that_need_words_find_the_same(spark):
    # Whole texts, texts cut from the rules themselves, and letters that only Unicode takes for the same.
    rules = [r for r in all_rules() if r.needs]
    pieces = {w for r in rules for w in re.split(r"[\\()\[\]{}|?:*+.]+", r.pattern) if w}
    texts = [n for r in rules for n in r.needs] + sorted(pieces) + [
        "SUM OF", "divided\nby", "Revenue = x", "count (", "link a table", "relates to", "Foreign  Key", "try\tto", "if possible",
        "handle nulls", "ask follow-up", "you might", "- When asked", "if a user", "* do  not", "# Role", "## fiscal date", "!! x",
        "SELECT a, b FROM t", "**IMPORTANT: x**", "This sales space contains", "The Following Tables", "year-to-date", "rolling 7",
        "default x filter", "case-insensitive", "NULL can mean", "missing any value", "do not ever join", "prefer a join", "KPIs",
        "ORDER BY x LIMIT 5", "LAG (", "prior_period", "previous year", "GROUP BY", "= 'OPEN'", "WHERE a = 'x'", "= 12345",
        ":p", "{{ p }}", "getArgument(", "ſum of", "try to aſk follow up", "dİvided by", "fiſcal", "KPI", "KPı",
        "ſELECT abcde FROM t", "ſhould", "## Critical rules", "# Business terms", "case-sensitive", "", None, *TEXTS,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = df.selectExpr("*", f"{R.lowered('text')} as low")
    pairs = [(r.count_sql("text"), r.count_sql("text", "low")) for r in rules]
    pairs += [(r.hit_sql("text"), r.hit_sql("text", "low")) for r in rules]
    same = [f"({a}) <=> ({b}) as same_{n}" for n, (a, b) in enumerate(pairs)]
    rows = df.selectExpr(*same, *[f"{a} as found_{n}" for n, (a, _) in enumerate(pairs)]).collect()
    for n in range(len(pairs)):
        assert all(row[f"same_{n}"] for row in rows), pairs[n]
        assert any(row[f"found_{n}"] for row in rows), pairs[n]


def test_shortest_forms_are_found_where_any_form_is(spark):
    names = ["a.b.order_1_events", "a.b.categories", "a.b.classes", "a.b.x_s", "a.b._x", "a.b.", "a.b.stg_2_accounts", "a.b.events"]
    df = spark.createDataFrame([(t,) for t in names], "t string").select("t", X.name_variants(F.col("t")).alias("v"))
    for row in df.select("v", X.shortest(F.col("v")).alias("s")).collect():
        assert set(row.s) <= set(row.v)
        assert all(any(s in v for s in row.s) for v in row.v)
        assert not any(a != b and a in b for a in row.s for b in row.s)
