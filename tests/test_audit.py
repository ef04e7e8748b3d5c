"""The whole audit: a known space, its properties, its outputs, and reading exported files."""

import json

import pytest
from pyspark.sql import functions as F

from spacegauge.operators import findings as FD
from spacegauge.operators import joins as J
from spacegauge.operators import readiness as RD
from spacegauge.plans import assessment as A
from spacegauge.plans import facts as P
from spacegauge.plans.facts import Estate
from spacegauge.sources import readers as SRC

BASE = ("account_profiles", "fraud_risk_state", "login_events", "transactions")
VIEWS = tuple(f"metrics_{n}" for n in BASE)
QUESTIONS = (
    "How many transactions were high risk?", "Compare account profiles by city", "Which accounts are risky?",
    "How many logins failed?", "What are the top fraud cases?", "Which profiles are new?", "Which cities are risky?",
)


def column_rows():
    """Forty coded columns, nine dates stored as text, all of them described, one with a generic comment."""
    rows = []
    for t, table in enumerate((*BASE, *VIEWS)):
        for i in range(5):
            rows.append((f"main.risk.{table}", i, f"kind{i}_status", "STRING", "What the row is"))
        rows.append((f"main.risk.{table}", 10, "event_date", "STRING", "When it was"))
        if t == 0:
            rows.append((f"main.risk.{table}", 11, "updated_at", "string", "When it changed"))
    rows.append(("main.risk.transactions", 12, "transaction_id", "BIGINT", "Primary key"))
    rows.append(("main.risk.login_events", 12, "mfa_enabled", "BOOLEAN", "Whether a second factor was used"))
    return rows


def estate(spark, spaces=(1,), shuffle=False) -> Estate:
    members = [(s, f"main.risk.{t}", i) for s in spaces for i, t in enumerate((*BASE, *VIEWS))]
    instructions = []
    for s in spaces:
        instructions += [(s, 100 + i, "FROM_SNIPPET", "j", '{"join": {}}') for i in range(3)]
        instructions.append((s, 1, "TEXT_INSTRUCTION", "t", "You are a helpful analyst."))
        for i in range(15):
            sql = "SELECT risk_category, COUNT(*) FROM transactions GROUP BY 1 ORDER BY 2 DESC LIMIT 5"
            if i < 3:
                sql = "SELECT COUNT(*) FROM assessments WHERE risk = 'CRITICAL'"
            instructions.append((s, 10 + i, "SQL_INSTRUCTION", f"Question {i}", sql))
    asked = [(s, i, "SAMPLE_QUESTION", q, None) for s in spaces for i, q in enumerate(QUESTIONS)]
    tables = [
        (f"main.risk.{t}", "One row per event, with amounts, dates and links to accounts", "boss", "METRIC_VIEW" if t in VIEWS else "BASE TABLE", False, False, None)
        for t in (*BASE, *VIEWS)
    ]

    def df(rows, schema):
        made = spark.createDataFrame(rows, schema)
        return made.orderBy(F.rand(3)).repartition(3) if shuffle else made

    return Estate(
        spaces=df([(s, "Card risk", "Key metrics of card risk by city and kind; one row per event; for analysts and managers", "w1") for s in spaces], "space_id long, title string, description string, warehouse_id string"),
        space_tables=df(members, "space_id long, table_id string, ordinal int"),
        tables=df(tables, "table_id string, comment string, owner string, table_type string, has_row_filter boolean, has_col_mask boolean, error string"),
        columns=df(column_rows(), "table_id string, ordinal long, name string, data_type string, comment string"),
        table_tags=df([], "table_id string, tag_name string, tag_value string, ordinal int"),
        table_constraints=df([], "table_id string, constraint_type string"),
        table_grants=df([(t[0], "boss", "SELECT") for t in tables], "table_id string, principal string, action_type string"),
        grant_status=df([(t[0], True) for t in tables], "table_id string, readable boolean"),
        acl=df([("space", str(s), "ann", None, None, ["CAN_USE"]) for s in spaces], "object_type string, object_id string, user_name string, group_name string, service_principal_name string, levels array<string>"),
        warehouses=df([("w1", True)], "warehouse_id string, is_serverless boolean"),
        instructions=df(instructions, "space_id long, ordinal long, instruction_type string, title string, content string"),
        questions=df(asked, "space_id long, question_id long, question_type string, question_text string, answer_text string"),
        description_verdicts=df([], "space_id long, metrics boolean, dimensions boolean, grain boolean, users boolean"),
    )


@pytest.fixture(scope="module")
def golden(spark):
    return A.staged_facts(estate(spark))


def test_golden_scores(spark, golden):
    row = A.scoring.scorecard(golden[1]).first()
    assert [row[f"score_{a}"] for a in range(6)] == [1, 3, 1, 2, 2, 1]
    assert (row["total"], row["max_total"], row["verdict"]) == (10, 18, "RECOMMEND REBUILD")
    assert row["blockers"] == ["Data Readiness", "Metadata Quality", "Benchmarks"]


def test_golden_findings(golden):
    said = {r["rule_id"]: r["message"] for r in FD.findings(golden[1]).collect()}
    assert set(said) == {
        "no_keys", "ungranted", "no_tags", "metric_views_in_space", "unclear_layer", "generic", "coded", "date_string",
        "unmapped", "hardcoded_sql", "no_parameterised_sql", "missing_patterns", "unknown_tables", "missing_sections",
        "misaligned_questions", "few_samples", "sample_diversity", "uncovered", "no_benchmarks",
    }
    assert "(8): `account_profiles`, `fraud_risk_state`, `login_events`, `transactions`, `metrics_account_profiles` (+3 more)" in said["ungranted"]
    assert "(40): `account_profiles.kind0_status`" in said["coded"] and "(+36 more)" in said["coded"]
    assert "(9)" in said["date_string"]
    assert "(1): MFA (Multi-Factor Authentication)" in said["unmapped"]
    assert said["generic"].endswith("`transactions.transaction_id`")
    assert '(3): "Question 0" reads `assessments`' in said["unknown_tables"]
    assert "(2): `metrics_fraud_risk_state`, `metrics_login_events`" in said["uncovered"]


def test_report(golden):
    doc = A.report_rows(golden[1], "2026-03-25").first()
    assert doc["path"] == "Card_risk_2026-03-25.md"
    assert "| **TOTAL** | **10/18** | |" in doc["document"]
    assert "| 1. Table & Space Curation | 3/3 | Good |" in doc["document"]
    lines = [r["line"] for r in A.report_lines(golden[1], "2026-03-25").orderBy("line_no").collect()]
    assert "\n".join(lines) == doc["document"]


def test_spaces_do_not_touch_and_order_does_not_matter(spark):
    def facts(e):
        rows = P.space_facts(e).drop("shown").collect()
        return {r["space_id"]: tuple(r) for r in rows}

    alone = facts(estate(spark))
    together = facts(estate(spark, (1, 2), shuffle=True))
    assert together[1] == alone[1]
    assert together[2][1:] == alone[1][1:]


def test_undocumented_column_never_raises_metadata_score(spark):
    e = estate(spark)
    before = A.scorecard(e).first()["score_2"]
    more = e.columns.unionByName(spark.createDataFrame([("main.risk.transactions", 99, "plain", "BIGINT", "")], e.columns.schema))
    after = A.scorecard(Estate(**{**vars(e), "columns": more})).first()["score_2"]
    assert after <= before


def test_empty_space_is_scored(spark):
    e = estate(spark)
    lonely = e.spaces.unionByName(spark.createDataFrame([(7, "Empty", None, "")], e.spaces.schema))
    row = A.scorecard(Estate(**{**vars(e), "spaces": lonely})).where("space_id = 7").first()
    assert [row[f"score_{a}"] for a in range(6)] == [2, 3, 1, 1, 1, 1]


def test_run_writes_all_outputs_and_keeps_other_runs(spark, tmp_path):
    out = str(tmp_path / "out")
    A.run(estate(spark), out, "2024-01-01")
    A.run(estate(spark), out, "2024-01-02")
    A.run(estate(spark), out, "2024-01-02")
    for name in ("area_scores", "pattern_gaps", "digest_pieces", "scorecard", "findings", "finding_items", "column_items", "recommendations", "reports"):
        df = spark.read.parquet(f"{out}/{name}")
        assert df.select("run_date").distinct().count() == 2, name
    assert spark.read.parquet(f"{out}/scorecard").count() == 2
    assert spark.read.parquet(f"{out}/column_items").where("rule_id = 'coded' and run_date = '2024-01-01'").count() == 40


def test_extra_metric_views_beyond_those_held(spark):
    views = spark.createDataFrame([("m.g", f"m.g.v{i:03d}") for i in range(30)], "schema_id string, full_name string")
    members = [(1, f"m.g.v{i:03d}", i) for i in range(12)] + [(2, "m.g.t", 0)]
    tables = spark.createDataFrame(members, "space_id int, table_id string, ordinal int")
    found = J.further_metric_views(tables, views, 2).groupBy("space_id").agg(F.sort_array(F.collect_list("full_name")).alias("v"))
    assert {r["space_id"]: r["v"] for r in found.collect()} == {1: ["m.g.v012", "m.g.v013"], 2: ["m.g.v000", "m.g.v001"]}


def test_messages_name_everything(spark):
    """150 tables below gold and 120 metric views in one space: each is named."""
    views = spark.createDataFrame([("m.g", f"m.g.v{i:03d}") for i in range(130)], "schema_id string, full_name string")
    tables = spark.createDataFrame([(1, f"m.g.v{i:03d}", i) for i in range(120)], "space_id int, table_id string, ordinal int")
    messages = [r.message for r in RD.metric_view_findings(tables, views).collect()]
    own = next(m for m in messages if m.startswith("OK"))
    assert all(f"`v{i:03d}`" in own for i in range(120)) and "more" not in own
    assert any("`v120`, `v121`, `v122`;" in m for m in messages)
    items = spark.createDataFrame([(1, "non_gold", i, 0, f"t{i}") for i in range(150)], "space_id int, rule_id string, ord int, sub int, item string")
    shown = P.shown_names(items, items.where("false")).first()["shown"]["non_gold"]
    assert shown == [f"t{i}" for i in range(150)]


def test_read_exported_files(spark, tmp_path):
    spaces = tmp_path / "spaces.json"
    spaces.write_text(
        json.dumps({"space_id": "1", "title": "A", "table_identifiers": ["m.g.t", "bad"], "warehouse_id": "w"}) + "\n{broken\n"
    )
    df = SRC.read_spaces(spark, str(spaces))
    rows = {r["space_id"]: r for r in df.collect()}
    assert rows["1"]["description"] == "" and rows["1"]["error"] is None
    assert rows[None]["error"] == "{broken"
    members = [(r["table_id"], r["ordinal"], r["error"]) for r in SRC.space_tables(df).orderBy("ordinal").collect()]
    assert members == [("m.g.t", 0, None), ("bad", 1, "Cannot parse: bad")]
    acl = tmp_path / "acl.json"
    acl.write_text(json.dumps({"object_type": "space", "object_id": "1", "access_control_list": [
        {"group_name": "users", "all_permissions": [{"permission_level": "CAN_USE"}]}, {"user_name": "x"}]}))
    got = {(r["group_name"], r["user_name"]): r["levels"] for r in SRC.read_acl(spark, str(acl)).collect()}
    assert got == {("users", None): ["CAN_USE"], (None, "x"): []}
    asked = tmp_path / "q.json"
    asked.write_text("\n".join(json.dumps(q) for q in (
        {"space_id": "1", "question_type": "SAMPLE_QUESTION", "question": "a", "question_text": "b"},
        {"space_id": "1", "question_type": "BENCHMARK", "content": "c"}, {"space_id": "1", "question_type": "OTHER"})))
    assert sorted(r["question_text"] for r in SRC.read_questions(spark, str(asked)).collect()) == ["a", "c"]


def test_read_events(spark, tmp_path):
    path = str(tmp_path / "audit")
    spark.sql(
        "select named_struct('full_name_arg', 'm.g.t') as request_params, named_struct('email', 'u') as user_identity, "
        "a as action_name, timestamp'2024-01-30 10:00:00' as event_time from values ('getTable'), ('other') v(a)"
    ).write.parquet(path)
    assert [tuple(r)[1:] for r in SRC.read_audit(spark, path, "2024-01-31", 14).collect()] == [("u", "getTable", "m.g.t")]
    assert SRC.read_audit(spark, path, "2024-03-31", 14).count() == 0
    with pytest.raises(ValueError):
        SRC.load(spark, path, "a INT", "avro")


# ---- results that are replaced -------------------------------------------------------------------
def test_a_rerun_replaces_its_run_only(spark, tmp_path):
    """A run that finds nothing any more leaves nothing; other runs stay, and a failing run leaves the former one whole."""
    from spacegauge.sources import sinks

    path = str(tmp_path / "findings")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "space_id int, message string")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).selectExpr("space_id", "message", "cast(run_date as string)").collect())
    sinks.write_findings(rows, path, "2024-01-30")
    sinks.write_findings(rows, path, "2024-01-31")
    sinks.write_findings(rows.where("space_id = 1"), path, "2024-01-31")
    assert read() == [(1, "a", "2024-01-30"), (1, "a", "2024-01-31"), (2, "b", "2024-01-30")]
    with pytest.raises(Exception, match="USER_RAISED|boom"):
        sinks.write_findings(rows.selectExpr("space_id", "if(space_id = 2, raise_error('boom'), message) as message"), path, "2024-01-31")
    assert read() == [(1, "a", "2024-01-30"), (1, "a", "2024-01-31"), (2, "b", "2024-01-30")]
    sinks.write_findings(rows.where("false"), path, "2024-01-31")
    assert read() == [(1, "a", "2024-01-30"), (2, "b", "2024-01-30")]
    assert sorted(p.name for p in (tmp_path / "findings").iterdir() if not p.name.startswith(".")) == ["run_date=2024-01-30", "run_date=2024-01-31"]


def test_staged_tables_go_after_use(spark):
    from pathlib import Path

    from spacegauge.session import shared_folder
    from spacegauge.sources import staging

    folder = Path(shared_folder(spark).removeprefix("file:"))
    with staging.scratch(spark):
        kept = staging.staged(spark.range(5).toDF("x"), "scoped")
        assert kept.count() == 5 and list(folder.glob("scoped-*"))
    assert not list(folder.glob("scoped-*"))


def test_lists_are_cut_before_the_shuffle(spark):
    from spacegauge.operators.lists import first_k

    items = spark.range(100).selectExpr("id % 2 as space_id", "'r' as rule_id", "id as ord", "0 as sub", "cast(id as string) as item")
    few = first_k(items, 3)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.space_id, r.shown, r.n_more) for r in few.collect()) == [(0, ["0", "2", "4"], 47), (1, ["1", "3", "5"], 47)]


def test_metric_views_are_unfolded_last(spark, monkeypatch):
    """The rows of every space and view are made above all joins, so that none of them is shuffled."""
    monkeypatch.setattr(J, "VIEWS", 3)
    views = spark.createDataFrame([(f"m.{s}", f"m.{s}.v{i}") for s in "ab" for i in range(20)], "schema_id string, full_name string")
    members = [(1, "M.a.v3"), (1, "m.A.v3"), (1, "m.a.t"), (2, "m.b.v19"), (2, "m.a.v0"), (3, "m.c.v1"), (4, "v1"), (None, "m.a.v1")]
    out = J.split_metric_views(views, spark.createDataFrame(members, "space_id int, table_id string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan and plan.index("Generate inline") < plan.index("Join")
    expected = [(s, f"m.{c}.v{i}", (s, c, i) in {(1, "a", 3), (2, "b", 19), (2, "a", 0)})
                for s, c in ((1, "a"), (2, "a"), (2, "b"), (None, "a")) for i in range(20)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


def test_metric_views_are_split_whole(spark, monkeypatch):
    """Every row comes once per listed view, however views and spaces are cut up, repeat or lack values."""
    for name, size in {"PART": 7, "VIEWS": 3, "SPREAD": 2, "BLOCK": 4}.items():
        monkeypatch.setattr(J, name, size)
    views = [(f"m.{s}", f"m.{s}.v{i}") for s in "ab" for i in range(25)]
    # Listed twice, under another schema, in two schemas, without a name or a schema.
    views += [("m.a", "m.a.v7"), ("m.b", "m.a.w"), ("m.b", "m.a.v8"), ("m.a", None), (None, "m.a.x"), ("m.c", None)]
    members = [(s, f"m.{c}.v{i}") for s in range(30) for c in "ab" for i in range(s)]
    members += [(40, "M.A.v7"), (41, "m.a.v8"), (42, "m.a.w"), (42, "m.b.t"), (43, "m.a.x"), (44, "m.c.y"), (45, "m.d.y"), (46, "a.v"),
                (None, "m.a.v8"), (None, "m.b.v1"), (47, None), (40, "m.a.v7")]
    out = J.split_metric_views(
        spark.createDataFrame(views, "schema_id string, full_name string"),
        spark.createDataFrame(members, "space_id int, table_id string"),
    )
    full = {(s, t.lower()) for s, t in members if t and t.count(".") == 2}
    touched = {(s, t.rsplit(".", 1)[0]) for s, t in full}
    expected = [(s, v, s is not None and (s, v) in full) for s, schema in touched for at, v in views if at == schema]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


def test_split_metric_views_take_little_room(spark, monkeypatch, tmp_path):
    """``space_tables`` is read once, and the same few names are written after each other: about a bit and a half a row."""
    monkeypatch.setattr(J, "SPREAD", 1)
    path = str(tmp_path / "members")
    spark.range(1000).selectExpr("id as space_id", "'Main.s.v' || id as table_id").write.parquet(path)
    views = spark.range(2048).selectExpr("'main.s' as schema_id", "'main.s.v' || id as full_name")
    out = J.split_metric_views(views, spark.read.parquet(path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    out.coalesce(1).write.parquet(str(tmp_path / "split"))
    back = spark.read.parquet(str(tmp_path / "split"))
    assert back.count() == 1000 * 2048 and back.where("in_space").count() == 1000
    assert sum(f.stat().st_size for f in (tmp_path / "split").glob("*.parquet")) < 0.3 * 1000 * 2048
