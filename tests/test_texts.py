"""Hits over joined texts, and strings in texts, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spacegauge.functions import rules as R
from spacegauge.operators import config_lint as C
from spacegauge.operators import texts as T
from spacegauge.operators.containment import contained
from spacegauge.operators.lists import in_parts, number_rows

WORDS = ["sum", "of", "divided", "by", "foreign", "key", "try", "to", "if", "a", "user", "do", "not", "x", "relates",
         "revenue", "=", "handle", "null", "- if", "* do", "\n", "join", "table", ""]


def blocks(seed, spaces=6, n=40):
    rng = random.Random(seed)
    rows = []
    for space in range(spaces):
        positions = sorted(rng.sample(range(10_000), n))
        for pos in positions:
            rows.append((space, pos, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3)))))
    return rows


AWKWARD = [
    (100, ["sum", "", " ", "\n\n", "", "of"]),
    (101, ["sum" + " " * 500, "of", "foreign" + "\n" * 500, "\t" * 300 + "key"]),
    (102, ["w" * 10_000 + " sum", "of " + "w" * 10_000]),
    (103, ["", "\n", "if", "", "a", " ", "user", ""]),
    (104, ["say - if", "a user", "word * do", "not"]),
    (105, ["- if\na", "user", "x\n* do", "not"]),
    (106, ["sum", "offer", "myrevenue", ": 5", "sumsum", "(x", "handle", "nullable"]),
    (107, ["try", "to relate", "to", "link a", "table", "ask", "follow-up", "ask", "follow", "up", "ask follow", "up"]),
    (108, ["foreign foreign", "key key", "divided", "by by", "sum of divided", "by"]),
]


@pytest.mark.parametrize("seed", [2, 50, 4096])
def test_hits_of_joined_text(spark, seed):
    rows = blocks(seed)
    far = random.Random(seed)
    for space, parts in AWKWARD:  # far apart, unevenly, up to the largest numbers
        places = sorted(far.sample(range(-(2**40), 2**62), len(parts)))
        rows += [(space, pos, text) for pos, text in zip(places, parts, strict=True)]
    texts = spark.createDataFrame(rows, "space_id int, ordinal bigint, text string").repartition(5)
    sides = T.joints(texts, "space_id", ["ordinal"], "text", "\n")
    extra = sides.groupBy("space_id").agg(
        *[F.sum(T.joint_hits(rule, "\n")).alias(n) for n, rule in C.JOINED_RULES.items()]
    )
    inside = texts.groupBy("space_id").agg(
        *[F.sum(rule.count(F.col("text"))).alias(n) for n, rule in C.JOINED_RULES.items()]
    )
    got = {
        r["space_id"]: r for r in C.add_joint_hits(inside, extra).collect()
    }
    for space in {r[0] for r in rows}:
        blob = "\n".join(t for s, _, t in sorted(rows) if s == space)
        for name, rule in C.JOINED_RULES.items():
            flags = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in rule.flags)
            expected = len(re.findall(rule.pattern, blob, flags))
            if name == "directives":  # only whether there is one counts
                assert (got[space][name] > 0) == (expected > 0)
            else:
                assert got[space][name] == expected, (space, name)


ORDERS = {
    "even": lambda rng, n: list(range(n)),
    "outlier": lambda rng, n: [*range(n - 1), 2**62],
    "powers": lambda rng, n: [int(1.01 ** (i % 2000)) * 1000 + i for i in range(n)],
    "texts": lambda rng, n: ["common prefix of all " + "".join(rng.choice("ab") for _ in range(30)) for _ in range(n)],
    "repeated": lambda rng, n: [7] * n,
}


def numbered(rows):
    """(space, seq, pos) by sorting."""
    out = []
    for space in {r[0] for r in rows}:
        own = sorted((p for s, p in rows if s == space), key=lambda p: (p is not None, p))
        out += [(space, i, p) for i, p in enumerate(own, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_numbering_of_a_large_key(spark, size):
    """Nearly all rows in one space, unevenly spread, some without a number, some spaces without an id, some rows equal."""
    rng = random.Random(size)
    rows = [(1, p) for p in rng.sample(range(2**62), 300)] + [(1, p) for p in range(200)] + [(None, 5), (None, 4), (2, None), (2, -7)]
    rows += [(3, 9)] * 50 + [(3, p) for p in range(20)]
    df = spark.createDataFrame(rows, "space_id int, pos bigint").repartition(7)
    got = sorted(((r.space_id, r.seq, r.pos) for r in number_rows(df, ["space_id"], ["pos"], size).collect()), key=str)
    assert got == numbered(rows)


@pytest.mark.parametrize("order", ORDERS)
def test_parts_of_a_key_are_even(spark, order):
    """No part of a hot key exceeds twice its share, whatever the order is like; equal rows are one row with a number."""
    rng, n, size = random.Random(1), 20_000, 1000
    values = ORDERS[order](rng, n)
    kind = "string" if order == "texts" else "bigint"
    df = spark.createDataFrame([(1, v, i if order == "repeated" else 0) for i, v in enumerate(values)] + [(2, values[0], 0)], f"k int, v {kind}, x int")
    parts = in_parts(df, ["k"], ["v"], size).where("k = 1").groupBy("__part").agg(F.sum("__n").alias("n")).collect()
    assert len(parts) >= n / size / 2 and sum(p.n for p in parts) == n and max(p.n for p in parts) <= 2 * size
    got = number_rows(df, ["k"], ["v"], size).where("k = 1").select("seq", "v").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.seq)] == sorted(values) and sorted(r.seq for r in got) == list(range(1, n + 1))


def test_equal_rows_are_folded(spark):
    df = spark.range(50_000).selectExpr("1 as k", "5 as v")
    folded = in_parts(df, ["k"], ["v"], 1000).collect()
    assert [r["__n"] for r in folded] == [50_000]
    assert number_rows(df, ["k"], ["v"], 1000).agg(F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()[:] == (50_000, 1, 50_000)


def test_no_group_grows_with_a_space(spark):
    """A space of 20,000 texts far apart: what is gathered per joint stays within the rule's words."""
    texts = spark.range(20_000).selectExpr("1 as space_id", "id * 70000 as ordinal", "concat('w', id, ' sum') as text")
    sides = T.joints(texts, "space_id", ["ordinal"], "text", "\n")
    assert sides.count() == 19_999
    assert sides.agg(F.max(F.length("before")), F.max(F.length("after"))).first()[0] <= 24
    pieces = T.space_pieces(texts, "\n", size=1000)
    assert pieces.count() == 20 and pieces.agg(F.max(F.length("text"))).first()[0] < 12_000


def test_space_text_keeps_order(spark):
    rows = blocks(7)
    texts = spark.createDataFrame(rows, "space_id int, ordinal bigint, text string").repartition(7)
    got = {r["space_id"]: r["text"] for r in T.space_text(texts, "\n").collect()}
    for space, text in got.items():
        assert text == "\n".join(t for s, _, t in sorted(rows) if s == space)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_contained(spark, seed):
    rng = random.Random(seed)
    letters = "abcé🎉 "
    texts = [(s, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for s in range(4) for _ in range(s * 4)]
    texts += [(3, "long " * 700 + "needle at the end"), (6, ""), (7, None), (None, "ab")]
    needles = sorted({(s, "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))) for s in range(5) for _ in range(40)})
    needles += [(3, "needle at the end"), (3, "absent one"), (3, "long " * 60), (6, ""), (6, "a"), (7, ""), (None, "ab"), (4, None)]
    n = spark.createDataFrame(needles, "space_id int, needle string")
    t = spark.createDataFrame(texts, "space_id int, text string")
    got = {(r[0], r[1]) for r in contained(n, t).collect()}
    known = [(s, x) for s, x in needles if s is not None and x is not None]
    assert got == {(s, x) for s, x in known if any(s == s2 and body is not None and x in body for s2, body in texts)}


def test_contained_lists_few_places(spark):
    """Many strings and many texts of one space: what is compared grows with the texts and not with their product."""
    n = spark.range(2000).selectExpr("1 as space_id", "concat('name_', lpad(conv(id * 7919, 10, 36), 6, 'q')) as needle")
    t = spark.range(2000).selectExpr("1 as space_id", "concat('text ', id, ' has name_', lpad(conv(id * 7919, 10, 36), 6, 'q'), ' in it') as text")
    assert contained(n, t).count() == 2000


def test_question_wording_across_questions(spark):
    from spacegauge.operators.questions import question_asks

    rows = [(1, 1, "SAMPLE_QUESTION", "what was last", None), (1, 2, "SAMPLE_QUESTION", "7 days", None),
            (2, 1, "SAMPLE_QUESTION", "what was last", None), (2, 2, "BENCHMARK", "7 days", None)]
    df = spark.createDataFrame(rows, "space_id int, question_id int, question_type string, question_text string, answer_text string")
    got = {r["space_id"]: r["asks_time"] for r in question_asks(df).collect()}
    assert got == {1: True, 2: False}
    rows = [(1, i, "SAMPLE_QUESTION", t, None) for i, t in enumerate(["year", "over", "year"])]
    rows += [(2, i, "SAMPLE_QUESTION", t, None) for i, t in enumerate(["the year", "", "over year"])]
    rows += [(3, i, "SAMPLE_QUESTION", t, None) for i, t in enumerate(["a year over", "year b"])]
    df = spark.createDataFrame(rows, "space_id int, question_id int, question_type string, question_text string, answer_text string")
    got = {r["space_id"]: r["asks_compare"] for r in question_asks(df).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert R.QUESTION_PATTERNS["asks_time"].pattern.startswith(r"\btrend")


def test_small_keys_are_numbered_as_they_are(spark):
    """Only rows of large keys go through parts; null keys, ties and equal rows are numbered either way."""
    rows = [(k, i % 7, "ab"[i % 2]) for k, n in ((1, 40), (2, 5), (None, 30), (None, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, pos int, v string")
    out = number_rows(df, ["k"], ["pos"], 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    for size in (10, 1000):
        found = sorted(number_rows(df, ["k"], ["pos"], size).collect(), key=str)
        assert sorted(((r.k, r.pos, r.v) for r in found), key=str) == sorted(rows, key=str)
        for key in (1, 2, 3, None):
            mine = sorted((r.seq, r.pos) for r in found if r.k == key)
            assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
            assert [p for _, p in mine] == sorted(p for _, p in mine)
