"""Co-access and lineage against brute force, in batch and as a stream."""

import itertools
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spacegauge.operators import usage as U
from spacegauge.sources import readers
from spacegauge.streaming import coaccess

AUDIT = "event_time timestamp, user_email string, action_name string, table_name string"


def audit_rows(n=600, days=4):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        at = start + timedelta(minutes=rng.randint(0, days * 1440 - 1))
        rows.append((at, f"u{rng.randint(0, 6)}", rng.choice(["getTable", "getTable", "other"]), f"t{rng.randint(0, 9):02d}"))
    # A job that reads many tables, the same ones each day.
    rows += [(start + timedelta(days=d, hours=3), "job", "getTable", f"t{t:02d}") for d in range(days) for t in range(40)]
    return sorted(rows)


def brute(rows):
    sessions = {}
    for at, user, action, table in rows:
        if action == "getTable":
            sessions.setdefault((user, at.date()), set()).add(table)
    pairs = Counter()
    for tables in sessions.values():
        pairs.update(itertools.combinations(sorted(tables), 2))
    return sessions, pairs


@pytest.mark.parametrize("block_rows", [3, 256])
def test_pairs(spark, block_rows):
    rows = audit_rows()
    sessions, pairs = brute(rows)
    found = U.access_sessions(spark.createDataFrame(rows, AUDIT))
    got = {(r["table_a"], r["table_b"]): r["n_sessions"] for r in U.pair_counts(found, block_rows).collect()}
    assert got == dict(pairs)
    listed = U.session_pairs(found, block_rows)
    assert listed.count() == sum(pairs.values()) == listed.distinct().count()
    assert found.count() == sum(len(s) for s in sessions.values())


def test_top_pairs_per_space(spark):
    rows = audit_rows()
    _, pairs = brute(rows)
    members = [(s, f"t{t:02d}") for s in range(4) for t in range(s, 10 + s, 1 + s % 2)]
    tables = spark.createDataFrame(members, "space_id int, table_id string")
    audit = spark.createDataFrame(rows, AUDIT)
    got = {}
    for r in U.coaccess_pairs(audit, tables, "2024-01-05", 90, 3).collect():
        got.setdefault(r["space_id"], []).append((r["rank"], r["table_a"], r["table_b"], r["n_sessions"]))
    for space in range(4):
        mine = {t for s, t in members if s == space}
        best = sorted(((-n, a, b) for (a, b), n in pairs.items() if a in mine and b in mine))[:3]
        assert sorted(got[space]) == [(i + 1, a, b, -n) for i, (n, a, b) in enumerate(best)]


def test_window_is_trailing(spark):
    rows = [(datetime(2024, 1, d), "u", "getTable", f"t{d}") for d in range(1, 11)]
    audit = spark.createDataFrame(rows, AUDIT)
    assert {r["table_name"] for r in U.since(audit, "2024-01-10", 3).collect()} == {"t7", "t8", "t9", "t10"}


def test_top_edges(spark):
    rng = random.Random(3)
    edges = [(f"t{rng.randint(0, 8)}", rng.choice([None] + [f"t{i}" for i in range(9)])) for _ in range(400)]
    members = [(s, f"t{t}") for s in range(3) for t in (s, s + 3)]
    counted = U.edge_counts(spark.createDataFrame(edges, "source_table string, target_table string"))
    got = {}
    for r in U.top_edges(counted, spark.createDataFrame(members, "space_id int, table_id string"), 4).collect():
        got.setdefault(r["space_id"], []).append((r["rank"], r["source_table"], r["target_table"], r["n"]))
    totals = Counter(edges)
    for space in range(3):
        mine = {t for s, t in members if s == space}
        best = sorted((-n, a, b or "") for (a, b), n in totals.items() if a in mine or b in mine)[:4]
        assert sorted(got[space]) == [(i + 1, a, b or None, -n) for i, (n, a, b) in enumerate(best)]


def test_stream_equals_batch(spark, tmp_path):
    rows = audit_rows()
    source = tmp_path / "audit"
    for part in range(4):  # one file per day, in order, so that nothing is late
        day = [r for r in rows if r[0].date() == (datetime(2024, 1, 1) + timedelta(days=part)).date()]
        spark.createDataFrame(day, AUDIT).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).parquet(str(source))
    out, checkpoint = str(tmp_path / "sessions"), str(tmp_path / "checkpoint")
    coaccess.write_sessions(coaccess.coaccess_stream(stream), out, checkpoint).awaitTermination()
    batch = U.access_sessions(spark.createDataFrame(rows, AUDIT))
    found = coaccess.session_table(spark, out)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
    _, pairs = brute(rows)
    assert {(r[0], r[1]): r[2] for r in coaccess.current_pairs(spark, out).collect()} == dict(pairs)
    # Started again without new files, the stream adds nothing.
    coaccess.write_sessions(coaccess.coaccess_stream(stream), out, checkpoint).awaitTermination()
    assert coaccess.session_table(spark, out).count() == found.count()


def _plan(df):
    return df._jdf.queryExecution().simpleString()


def test_stream_drops_only_rows_past_the_watermark(spark, tmp_path):
    source = tmp_path / "audit"
    files = [
        [(datetime(2024, 1, 5, 12), "u", "getTable", "a")],
        [(datetime(2024, 1, 4, 13), "u", "getTable", "b")],
        [(datetime(2024, 1, 5, 1), "v", "getTable", "d"), (datetime(2024, 1, 1), "u", "getTable", "c")],
    ]
    for rows in files:
        spark.createDataFrame(rows, AUDIT).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "sessions")
    query = coaccess.write_sessions(coaccess.coaccess_stream(stream), out, str(tmp_path / "cp"))
    query.awaitTermination()
    kept = {r["table_name"] for r in coaccess.session_table(spark, out).collect()}
    assert kept == {"a", "b", "d"} and coaccess.rows_too_late(query) == 1
    # A day that several batches wrote is whole, and a window reads its own days only.
    recent = coaccess.session_table(spark, out, "2024-01-06", 1)
    assert sorted(r.table_name for r in recent.collect()) == ["a", "d"]
    assert "PartitionFilters: [isnotnull(day" in _plan(recent)


@pytest.mark.parametrize("by_day", [True, False])
def test_events_are_read_by_day(spark, tmp_path, by_day):
    """Equal results with and without folders by day; with them, only those of the window are read."""
    rows = [(datetime(2024, 1, d, h), f"t{d}", f"u{h}") for d in range(1, 11) for h in (0, 23)] + [(None, "t", "u")]
    events = spark.createDataFrame(rows, "event_time timestamp, a string, b string").withColumn("event_date", F.to_date("event_time"))
    edges = events.withColumnsRenamed({"a": "source_table_full_name", "b": "target_table_full_name"})
    reads = events.select(
        F.struct(F.col("a").alias("full_name_arg")).alias("request_params"),
        F.struct(F.col("b").alias("email")).alias("user_identity"),
        F.lit("getTable").alias("action_name"),
        "event_time",
        "event_date",
    )
    for df, name in ((edges, "lineage"), (reads, "audit")):
        if by_day:
            df.write.partitionBy("event_date").parquet(str(tmp_path / name))
        else:
            df.drop("event_date").write.parquet(str(tmp_path / name))
    found = readers.read_lineage(spark, str(tmp_path / "lineage"), "2024-01-10", 3)
    expected = sorted(r for r in rows if r[0] and r[0] >= datetime(2024, 1, 7))
    assert sorted(map(tuple, found.collect())) == expected
    audit = readers.read_audit(spark, str(tmp_path / "audit"), "2024-01-10", 3)
    assert sorted((r.event_time, r.table_name, r.user_email) for r in audit.collect()) == expected
    for df in (found, audit):
        assert set(df.columns) & {"event_date"} == set()
        if by_day:
            # The window and the day before it, and rows without a day.
            assert re.search(r"PartitionFilters: \[\(isnull\(event_date#\d+\) OR \(event_date#\d+ >= 2024-01-06\)\)\]", _plan(df))


def test_sample_audit_is_off_unless_asked(spark):
    audit = spark.createDataFrame(audit_rows(), AUDIT)
    assert U.sample_audit(audit).count() == audit.count()
    first = U.sample_audit(audit, 5).select(F.col("user_email")).collect()
    assert len(first) == 5 and {r[0] for r in first} == {"job"}


# ---- the busiest pairs ---------------------------------------------------------------------------
def top_by_all_pairs(sessions, members, k):
    """(space, rank, pair, count) by pairing everything."""
    days, counts = {}, Counter()
    for user, day, table in sessions:
        days.setdefault((user, day), set()).add(table)
    for tables in days.values():
        counts.update(itertools.combinations(sorted(tables), 2))
    out = set()
    for space in {s for s, _ in members}:
        own = {t for s, t in members if s == space}
        pairs = sorted((-n, p) for p, n in counts.items() if set(p) <= own)[:k]
        out |= {(space, i, *p, -n) for i, (n, p) in enumerate(pairs, 1)}
    return out


def busiest(spark, sessions, members, k, first=None):
    df = spark.createDataFrame(sorted(sessions), "user string, day int, table_name string")
    tables = spark.createDataFrame(members, "space_id int, table_id string")
    return {(r.space_id, r["rank"], r.table_a, r.table_b, r.n_sessions) for r in U.busiest_pairs(df, tables, k, first).collect()}


@pytest.mark.parametrize("first", [1, 2, 5, None])
def test_busiest_pairs_equal_all_pairs(spark, first):
    """Ties, spaces of one table and of tables never read, a job that reads everything, and several rounds."""
    rng = random.Random(first or 0)
    sessions = {(f"u{rng.randint(0, 8)}", rng.randint(0, 5), f"t{min(rng.randint(0, 30), rng.randint(0, 30)):02d}") for _ in range(300)}
    sessions |= {("job", d, f"t{t:02d}") for d in range(3) for t in range(40)}
    members = sorted({(s, f"t{rng.randint(0, 45):02d}") for s in range(6) for _ in range(4 * s)} | {(7, "t00"), (8, "x"), (8, "y")})
    assert busiest(spark, sessions, members, 3, first) == top_by_all_pairs(sessions, members, 3)


def test_service_account_makes_few_pairs(spark, monkeypatch):
    """An account that reads 20,000 tables of a space makes under 1 % of its pairs, whether busier tables stand out or all tie."""
    made, pairs_of = [], U._pairs

    def counted(rows, group, *args):
        found = pairs_of(rows, group, *args)
        made.append(found.count())
        return found

    monkeypatch.setattr(U, "_pairs", counted)
    everything = spark.range(20_000).selectExpr("'job' as user", "1 as day", "concat('t', lpad(id, 5, '0')) as table_name")
    people = spark.range(400).selectExpr("concat('u', id div 4) as user", "2 as day", "concat('t', lpad(19990 - id % 4, 5, '0')) as table_name")
    members = everything.selectExpr("1 as space_id", "table_name as table_id")
    tied = U.busiest_pairs(everything, members, 10).collect()
    assert sorted((r.table_a, r.table_b, r.n_sessions) for r in tied) == [("t00000", f"t{i:05d}", 1) for i in range(1, 11)]
    top = {(r.table_a, r.table_b): r.n_sessions for r in U.busiest_pairs(everything.union(people), members, 5).collect()}
    names = [f"t{19990 - i:05d}" for i in range(4)]
    assert len(top) == 5 and all(n == 101 and set(p) <= set(names) for p, n in top.items())
    assert sum(made) <= 0.01 * (20_000 * 19_999 / 2)


# ---- pairs kept current --------------------------------------------------------------------------
@pytest.mark.parametrize("block_rows", [3, 256])
def test_kept_pairs_equal_the_batch(spark, tmp_path, block_rows):
    """Batches out of order, with a row within the watermark, one beyond it and one that an earlier batch had."""
    rows = audit_rows()
    random.Random(2).shuffle(rows)
    source, out, checkpoint = (str(tmp_path / name) for name in ("audit", "out", "checkpoint"))
    late = [
        (datetime(2024, 1, 8, 12), "u0", "getTable", "t00"),
        (datetime(2024, 1, 3, 13), "u0", "getTable", "within"),
        (datetime(2024, 1, 1, 3), "job", "getTable", "beyond"),
    ]
    # A watermark holds from the batch after the next on.
    slices = [rows[part::4] + rows[:5] for part in range(4)] + [late[:1], late[:1], late[1:]]
    for part in slices:
        spark.createDataFrame(part, AUDIT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: coaccess.write_pairs(coaccess.coaccess_stream(stream, "5 days"), out, checkpoint, block_rows=block_rows)
    query = run()
    query.awaitTermination()
    assert coaccess.rows_too_late(query) == 1
    _, pairs = brute(rows + late[:2])
    counts = lambda **kw: {(r[0], r[1]): r[2] for r in coaccess.kept_pairs(spark, out, **kw).collect()}
    assert counts() == dict(pairs)
    assert len({r.batch_id for r in spark.read.parquet(f"{out}/pairs").select("batch_id").distinct().collect()}) > 3
    _, recent = brute([r for r in rows + late[:2] if r[0] >= datetime(2024, 1, 3)])
    assert counts(as_of="2024-01-04", days=1) == dict(recent)
    assert "PartitionFilters: [isnotnull(day" in _plan(coaccess.kept_pairs(spark, out, "2024-01-04", 1))
    run().awaitTermination()  # nothing new, nothing added
    assert counts() == dict(pairs)


def test_a_batch_that_is_run_again_replaces_its_part(spark, tmp_path):
    """The last batch's commit is lost, so it is run again on a stream that starts from its checkpoint."""
    rows = audit_rows()
    source, out, checkpoint = (str(tmp_path / name) for name in ("audit", "out", "checkpoint"))
    for part in range(2):
        spark.createDataFrame(rows[part::2], AUDIT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: coaccess.write_pairs(coaccess.coaccess_stream(stream, "9 days"), out, checkpoint).awaitTermination()
    run()
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    _, pairs = brute(rows)
    assert {(r[0], r[1]): r[2] for r in coaccess.kept_pairs(spark, out).collect()} == dict(pairs)


def test_a_batch_writes_few_files_a_day(spark, tmp_path, monkeypatch):
    """Rows are dealt out by day before they are written, so not every task writes a file for every day."""
    monkeypatch.setattr(coaccess, "FILES", 1)
    rows = audit_rows()
    source, out, checkpoint = (str(tmp_path / name) for name in ("audit", "out", "checkpoint"))
    spark.createDataFrame(rows, AUDIT).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(AUDIT).parquet(source)
    coaccess.write_pairs(coaccess.coaccess_stream(stream, "9 days"), out, checkpoint).awaitTermination()
    files = Counter(p.parent for name in ("pairs", "sessions") for p in (tmp_path / "out" / name).rglob("*.parquet"))
    assert len(files) == 8 and max(files.values()) <= 2
    assert {(r[0], r[1]): r[2] for r in coaccess.kept_pairs(spark, out).collect()} == dict(brute(rows)[1])


def test_edges_go_to_spaces_as_lists(spark, monkeypatch):
    """No row is ranked per edge and space, and a space of many tables, repeated members and null ends give the same edges."""
    rng = random.Random(8)
    seen = {(f"t{rng.randint(0, 40)}", rng.choice([None, f"t{rng.randint(0, 40)}"])): rng.randint(1, 3) for _ in range(300)}
    members = [(s, f"t{t}") for s in range(40) for t in ((s % 41, 3) if s else range(41))] + [(5, "t3"), (None, "t3"), (7, None)]
    monkeypatch.setattr(U, "BLOCK_ROWS", 8)
    rows = []
    ranked = U.ranked
    monkeypatch.setattr(U, "ranked", lambda df, *more: rows.append(df.count()) or ranked(df, *more))
    edges = spark.createDataFrame([(*e, n) for e, n in seen.items()], "source_table string, target_table string, n long")
    out = U.top_edges(edges, spark.createDataFrame(members, "space_id int, table_id string"), 6)
    found = sorted(((r.space_id, r["rank"], r.source_table, r.target_table, r.n) for r in out.collect()), key=str)
    expected = []
    for space in {s for s, _ in members}:
        held = {t for s, t in members if s == space and t}
        mine = [e for e in seen if held & set(e)]
        best = sorted(mine, key=lambda e: (-seen[e], e[0], e[1] is not None, e[1] or ""))[:6]
        expected += [(space, i + 1, *e, seen[e]) for i, e in enumerate(best)]
    assert found == sorted(expected, key=str)
    assert max(rows) <= 2 * len(seen)


def test_pairs_of_long_user_days_share_lists(spark, monkeypatch):
    """User-days go to the spaces as lists of numbers, cut where long; weights, ties of lists and small days add up."""
    monkeypatch.setattr(U, "LISTED", 4)
    joined = []
    pairs = U._pairs
    monkeypatch.setattr(U, "_pairs", lambda rows, group, n, *more: joined.append((group, rows)) or pairs(rows, group, n, *more))
    rng = random.Random(9)
    day = datetime(2024, 1, 1).date()
    visits = {f"u{u}": {rng.randint(0, 29) for _ in range(rng.choice([2, 8, 12]))} for u in range(60)}
    visits |= {f"job{i}": {1, 2, 3, 4, 5, 6, 7} for i in range(5)}
    sessions = spark.createDataFrame([(u, day, f"t{t:02d}") for u, ts in visits.items() for t in ts], "user string, day date, table_name string")
    spaces = {s: {rng.randint(0, 29) for _ in range(5)} for s in range(30)} | {99: set(range(30))}
    members = spark.createDataFrame([(s, f"t{t:02d}") for s, ts in spaces.items() for t in ts], "space_id int, table_id string")
    found = {(r.space_id, r.table_a, r.table_b): r.n_sessions for r in U.member_pairs(sessions, members, 4).collect()}
    expected = Counter()
    for s, held in spaces.items():
        for ts in visits.values():
            expected.update((s, f"t{a:02d}", f"t{b:02d}") for a, b in itertools.combinations(sorted(held & ts), 2))
    assert found == expected
    by_space = [rows for group, rows in joined if "space_id" in group]
    places = sum(len(ts & held) for ts in visits.values() for held in spaces.values())
    assert by_space and by_space[0].count() < places and "user" not in by_space[0].columns
