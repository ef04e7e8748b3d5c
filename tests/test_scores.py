"""Scores at both sides of every threshold, against hand-written rules."""

import itertools

from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.functions import text as X
from spacegauge.operators import config_lint as C
from spacegauge.operators import curation, metadata, questions, readiness, scoring


def scores(spark, rows, schema, expr):
    return [r["s"] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr.alias("s")).collect()]


def test_counts_to_scores(spark):
    n = [(i,) for i in (0, 4, 5, 6, 9, 10, 14, 15, 16)]
    assert scores(spark, n, "n int", questions.sample_expr(F.col("n"))) == [1, 1, 2, 2, 2, 3, 3, 3, 3]
    assert scores(spark, n, "n int", questions.benchmark_expr(F.col("n"))) == [1, 1, 2, 2, 2, 2, 2, 3, 3]
    assert scores(spark, n, "n int", curation.budget_expr(F.col("n"))) == [3, 3, 3, 2, 2, 1, 1, 1, 1]
    p = [(x,) for x in (0.0, 49.9, 50.0, 79.9, 80.0)]
    assert scores(spark, p, "p double", metadata.coverage_expr(F.col("p"))) == [1, 1, 2, 2, 3]


def test_structure(spark):
    rows = list(itertools.product((0, 1, 2, 4), (0, 1, 2, 3), (0, 1, 2)))

    def expected(t, j, k):
        if t <= 1:
            return 3 if k else 2
        if j >= t - 1 and k:
            return 3
        return 2 if j or k else 1

    got = scores(spark, rows, "table_count int, join_count int, keyed int", readiness.structure_expr())
    assert got == [expected(*r) for r in rows]


def test_readiness_downgrade(spark):
    rows = list(itertools.product((1, 2, 3), (0, 1, 2, 5), (0, 1, 2, 3), (False, True), (False, True)))

    def expected(s, tables, bare, unshared, locked):
        if unshared or (bare and bare >= max(1, tables // 2)):
            return {3: 2, 2: 1, 1: 1}[s]
        return 2 if (locked or bare) and s == 3 else s

    schema = "s0 int, table_count int, ungranted_count int, not_shared boolean, warehouse_locked boolean"
    assert scores(spark, rows, schema, readiness.readiness_expr(F.col("s0"))) == [expected(*r) for r in rows]


def test_metadata_cascade(spark):
    rows = list(itertools.product((49.0, 50.0, 80.0), (3, 4, 5, 6), (0, 1, 2, 3), (1, 2)))

    def expected(p, coded, dates, thin):
        s = 3 if p >= 80 else 2 if p >= 50 else 1
        if s == 3 and (coded > 3 or dates or thin > 1):
            s = 2
        if s == 2 and (coded > 5 or dates > 2):
            s = 1
        return s

    expr = metadata.metadata_expr(*[F.col(c) for c in ("p", "c", "d", "t")])
    assert scores(spark, rows, "p double, c int, d int, t int", expr) == [expected(*r) for r in rows]


def test_configuration(spark):
    rows = list(itertools.product((0, 1, 10), (0, 1, 2, 3, 4, 6), (0, 1)))

    def sql(n, covered, unknown):
        if n == 0:
            return 1
        s = 3 if covered >= 4 else 2 if covered >= 2 else 1
        return 2 if s == 3 and unknown else s

    expr = C.sql_sub_expr(F.col("n"), F.col("c"), F.col("u"))
    assert scores(spark, rows, "n int, c int, u int", expr) == [sql(*r) for r in rows]
    halves = list(itertools.product((1, 2, 3), (1, 2, 3)))
    assert scores(spark, halves, "a int, b int", C.config_expr(F.col("a"), F.col("b"))) == [
        max(1, (a + b) // 2) for a, b in halves
    ]
    texts = list(itertools.product((0, 1), (0, 1, 3), (0, 2), (1, 2), (False, True), (100, 101)))

    def text(n, metric, join, sections, directives, lines):
        if not n:
            return 1
        if metric + join == 0 and sections >= 2 and directives and lines <= 100:
            return 3
        return 1 if metric + join > 2 else 2

    df = spark.createDataFrame(
        [(n, m, j, ["x"] * s, d, li) for n, m, j, s, d, li in texts],
        "text_count int, metric_hits int, join_hits int, sections array<string>, has_directives boolean, lines int",
    ).coalesce(1)
    assert [r[0] for r in df.select(C.text_sub_expr()).collect()] == [text(*r) for r in texts]


def test_covered_samples(spark):
    rows = list(itertools.product((9, 10), (0, 1, 2, 3), (2, 4, 6, 7)))
    expr = questions.covered_sample_expr(F.col("n"), F.col("u"), F.col("t"))

    def expected(n, uncovered, tables):
        s = 3 if n >= 10 else 2
        return 2 if s == 3 and uncovered >= max(2, tables // 2) else s

    assert scores(spark, rows, "n int, u int, t int", expr) == [expected(*r) for r in rows]


def test_verdict_and_cap(spark):
    totals = [(t / 18,) for t in range(6, 19)]
    got = scores(spark, totals, "pct double", scoring.verdict_expr(F.col("pct")))
    assert got == [R.READY if t >= 15 else R.IMPROVE if t >= 11 else R.REBUILD for t in range(6, 19)]
    areas = spark.createDataFrame(
        [(s, a, v) for s, values in enumerate(((3, 3, 3, 3, 3, 1), (3, 1, 3, 3, 3, 3), (1, 1, 1, 1, 1, 1))) for a, v in enumerate(values)],
        "space_id int, area int, score int",
    )
    capped = {r["space_id"]: (r["verdict"], r["blockers"]) for r in scoring.capped_verdict(scoring.verdict(areas), areas).collect()}
    assert capped == {
        0: (R.IMPROVE, ["Benchmarks"]),
        1: (R.READY, []),
        2: (R.REBUILD, ["Data Readiness", "Metadata Quality", "Benchmarks"]),
    }
    wide = spark.createDataFrame([(0, "t", 3, 3, 3, 3, 3, 1)], "space_id int, title string, " + ", ".join(f"score_{a} int" for a in R.AREAS))
    row = scoring.scorecard(wide).first()
    assert (row["total"], row["verdict"], row["blockers"]) == (16, R.IMPROVE, ["Benchmarks"])


def test_description_and_comment_lengths(spark):
    texts = [("",), ("  \n",), ("x" * 79,), ("x" * 80,), (" " * 5 + "x" * 79,)]
    none = F.expr(X.NO_ARRAY)
    lacking = F.array(F.lit("a"), F.lit("b"))
    assert scores(spark, texts, "d string", curation.description_kind(F.col("d"), none)) == ["empty", "empty", "short", None, "short"]
    assert scores(spark, texts, "d string", curation.description_kind(F.col("d"), lacking)) == ["empty", "empty", "short", "incomplete", "short"]
    comments = [("", "BASE TABLE"), ("x" * 49, "BASE TABLE"), ("x" * 50, "BASE TABLE"), ("x", "METRIC_VIEW"), (None, "VIEW")]
    assert scores(spark, comments, "c string, t string", metadata.comment_kind(F.col("c"), F.col("t"))) == ["none", "thin", None, None, "none"]


def test_layers(spark):
    rows = [("m.g.t", "BASE TABLE", None), ("m.raw.t", "BASE TABLE", None), ("m.raw.t", "BASE TABLE", "gold"), ("m.g.t", "BASE TABLE", "silver"),
            ("m.raw.t", "VIEW", "raw"), ("m.g.ODS_x", None, None), ("m.g.t", "metric_view", None), ("m.g.t", "BASE TABLE", "odd")]
    expr = curation.layer_expr(F.col("i"), F.col("t"), F.col("g"))
    assert scores(spark, rows, "i string, t string, g string", expr) == [
        "unclear", "non_gold", "tagged", "non_gold", "exempt", "non_gold", "exempt", "tagged",
    ]


def test_expression_kinds(spark):
    rows = [("MEASURE", ""), ("", "sum(x)"), ("", "a = 'x'"), ("", "sum(x) and y"), ("conditional", ""), ("DIMENSION", "sum(x)"), ("", "x")]
    expr = C.classify_expression(F.col("k"), F.col("c"))
    assert scores(spark, rows, "k string, c string", expr) == ["measure", "measure", "filter", "measure", "filter", "dimension", "dimension"]


def test_unknown_refs(spark):
    sqls = spark.createDataFrame(
        [(1, 1, "", "WITH a AS (SELECT 1), b AS (SELECT 2) SELECT * FROM a JOIN b ON 1 = 1"), (1, 2, "", "SELECT EXTRACT(year FROM ts) FROM `m`.`g`.`sales`"),
         (1, 3, "", "SELECT * FROM sales JOIN lost JOIN gone"), (1, 4, "", "SELECT [x] FROM lost"), (1, 5, "", "select * from M.G.SALES")],
        "space_id int, sql_id int, title string, sql string")
    tables = spark.createDataFrame([(1, "m.g.sales")], "space_id int, table_id string")
    assert {(r["sql_id"], r["ref"]) for r in C.unknown_table_refs(sqls, tables).collect()} == {(3, "lost")}
    strict = {(r["sql_id"], r["ref"]) for r in C.unknown_table_refs(sqls, tables, strict_compat=True).collect()}
    assert strict == {(1, "b"), (2, "ts"), (3, "lost")}


def test_external_grants(spark):
    grants = spark.createDataFrame(
        [("a", "Boss", "SELECT"), ("b", "x", "ALL PRIVILEGES"), ("c", "x", "MODIFY"), ("d", "boss", "SELECT"), ("d", "y", "select")],
        "table_id string, principal string, action_type string")
    tables = spark.createDataFrame([(t, "boss", None) for t in "abcd"], "table_id string, owner string, error string")
    from spacegauge.operators.joins import external_grants

    got = {r["table_id"]: r["has_external_grant"] for r in external_grants(grants, tables).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True}
    strict = {r["table_id"]: r["has_external_grant"] for r in external_grants(grants, tables, strict_compat=True).collect()}
    assert strict == {"a": False, "b": False, "c": False, "d": True}


def test_semantic_findings_join_nothing(spark):
    """Repeated and null spaces, spaces that only inputs know, and held metric views; all inputs meet in one aggregation."""
    spaces = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 4, 5, None)], "space_id int")
    code = [(1, "MEASURE", "x"), (2, "FILTER", "a"), (3, "MEASURE", "y"), (9, "FILTER", "b"), (None, "MEASURE", "z")]
    code += [(4, kind, "c") for kind in ("MEASURE", "FILTER", "FILTER")]
    expressions = spark.createDataFrame(code, "space_id int, expression_type string, code string")
    synonyms = spark.createDataFrame([(1, "s"), (1, "t"), (4, "u"), (None, "v")], "space_id int, synonym string")
    held = spark.createDataFrame([(3, "a.b.c"), (3, "a.b.d"), (None, "a.b.e")], "space_id int, full_name string")
    out = C.semantic_findings(spaces, expressions, synonyms, held)
    found = sorted((str(r.space_id), r.message.split(";")[0]) for r in out.collect())
    none = "Expressions: no measure, dimension, filter or synonym"
    lacks = ["Expressions: no measure", "Expressions: no synonym", "Expressions: only 1"]
    assert found == sorted([("1", lacks[2]), *[("2", x) for x in lacks * 2], ("5", none), ("None", none)])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
