"""Search, sharding, language model, mixing, classifier and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from spacegauge.llm import hnsw, kneser_ney, mixing, qda, queries, ring
from spacegauge.llm.tables import staged
from tests.llm.conftest import SF
from tests.llm.test_texts import words


# ---- search --------------------------------------------------------------------------------------
def exact(rows, asks, k):
    out = {}
    for q, v in rows:
        if asks(q):
            near = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:k]
            out[q] = near
    return out


def test_search_finds_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in hnsw.neighbours(df, F.col("vec_id") % 50 == 0, shard_rows=400).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    expected = exact(rows, lambda i: i % 50 == 0, 10)
    hits = 0
    for q, near in expected.items():
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, 11)) and [x[2] for x in found] == sorted(x[2] for x in found)
        hits += len({x[1] for x in found} & {i for _, i in near})
    assert hits >= 0.95 * 10 * len(expected)


def test_search_of_awkward_vectors(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, []), (103, [1.0, None, 2.0])]
    rows += [(104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0, 2.0]), (107, [0.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "query": F.lit(2)})
    got = defaultdict(list)
    for r in hnsw.neighbours(df, F.col("vec_id").isin(0, 7, 107, 100, 106)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 7, 107}  # no other vector has the length of 106
    assert sorted(got[7]) == [(k + 1, i, 0.0) for k, i in enumerate([0, 1, 2, 3, 4, 5, 6, 8, 9, 10])]
    assert [x[1] for x in sorted(got[107])] == list(range(10))
    assert hnsw.neighbours(df.filter("vec_id < 0"), F.lit(True)).count() == 0
    few = hnsw.neighbours(df.filter("vec_id in (1, 107)"), F.lit(True)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(1, 1, 107), (107, 1, 1)]


def test_search_in_hard_places(spark):
    """Vectors of several lengths, far from zero, huge and tiny; each finds all of its nearest of its own length."""
    rng = np.random.default_rng(4)
    far = np.array([1e8, 1e8, 5e7]) + rng.normal(size=(600, 3)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(far)]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))]
    rows += [(2000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)) * 1e200)]
    rows += [(3000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)) * 1e-200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hnsw.neighbours(df, F.col("vec_id") % 20 == 0, shard_rows=256).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = asked = 0
    for size in (3, 5, 4, 6):
        own = [r for r in rows if len(r[1]) == size]
        for q, v in own:
            if q % 20 == 0:
                scale = max(map(abs, v)) if size in (4, 6) else 1.0
                near = sorted((math.dist([x / scale for x in v], [x / scale for x in w]) * scale, i) for i, w in own if i != q)[:10]
                found = sorted(got[q])
                assert [x[0] for x in found] == list(range(1, 11)) and all(0 < x[2] < math.inf for x in found)
                distance = {i: d for d, i in near}
                assert all(math.isclose(x[2], distance[x[1]], rel_tol=1e-9) for x in found if x[1] in distance)
                hits, asked = hits + len({x[1] for x in found} & set(distance)), asked + 10
    assert hits >= 0.98 * asked


def test_search_recall_of_full_shards(spark):
    """Production parameters, several full shards: random vectors, clusters and near copies."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64))
    clustered = centres[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 64))
    copies = rng.normal(size=64) + 0.01 * rng.normal(size=(1500, 64))
    x = np.concatenate((rng.normal(size=(4500, 64)), clustered, copies))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = defaultdict(set)
    for r in hnsw.neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    recall = []
    for q in range(0, len(x), 100):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        recall.append(len(got[q] & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(recall) >= 0.95, np.mean(recall)


# ---- shards --------------------------------------------------------------------------------------
@pytest.mark.parametrize("load", [1.0, 1.1])
def test_ring(documents, load):
    rows = ring.sharded(documents, 40, load, cells=1 << 12).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(40)]
    assert len(rows) == documents.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if load == 1:
        assert max(counts) - min(counts) <= 1
    else:
        assert max(counts) <= math.ceil(load * len(rows) / 40)
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)


def test_ring_overflow_goes_clockwise(spark):
    """Every key that leaves its home lands on the first shard clockwise that is not full, by the counts at the end."""
    df = spark.range(300).selectExpr("id as doc_id", "'t' as text")
    nodes = {r.cell: (r.node, r.shard) for r in ring.ring(spark, 5, 8, 256).collect()}
    order = [s for _, s in sorted({v for v in nodes.values()})]
    rows = ring.sharded(df, 5, nodes=8, cells=256).collect()
    cells = {r.doc_id: r.cell for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 256) as cell").collect()}
    home = Counter(nodes[c][1] for c in cells.values())
    full = {s for s in range(5) if home[s] >= 60}
    assert full and full != set(range(5))
    for r in rows:
        node, shard = nodes[cells[r.doc_id]]
        assert r.home == shard
        if r.shard != r.home:
            assert r.home in full
            walk = list(dict.fromkeys(order[node:] + order[:node]))
            passed = walk[: walk.index(r.shard)]
            assert all(Counter(x.shard for x in rows)[s] == 60 for s in passed)


def test_ring_moves_little(documents):
    at = lambda n: {r.doc_id: r.shard for r in ring.sharded(documents, n, 1.25, cells=1 << 12).collect()}
    one, two = at(20), at(21)
    assert sum(one[i] != two[i] for i in one) < 0.25 * len(one)


def test_ring_splits_a_hot_key(spark):
    """A third of the rows have no key and half of those are equal: every slot is taken once, and no part is large."""
    df = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 6 = 0, 'same', cast(id as string)) as text")
    out = ring.sharded(df, 7, nodes=4, cells=64, part=100)
    rows = out.collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} <= {857, 858}
    expected = Counter((r.doc_id, len(r.text) + 16, zlib.crc32(r.text.encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    cells = ring._ranked(
        df.selectExpr("doc_id as key", "0L as cell", "1L as size", "crc32(text) as text_crc32"), spark.sql("select 0L as cell, 6000L as n"), 100
    )
    assert sorted(r["rank"] for r in cells.collect()) == list(range(6000))
    sizes = [r["count"] for r in cells.groupBy("part").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 300


def test_ring_without_room_for_a_shard(spark):
    with pytest.raises(Exception, match="no place on the ring"):
        ring.sharded(spark.range(300).selectExpr("id as doc_id", "'t' as text"), 7, cells=64).collect()


def test_ring_is_not_run_through_again_for_the_rows(documents):
    """The ring and what moves are tables by the time rows are placed; the plan over the rows numbers these once."""
    plan = ring.sharded(documents, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "Union" not in plan


def test_ring_looks_up_its_tables_without_a_shuffle(spark, documents, monkeypatch):
    """But for the counts by cell nothing of the ring is shuffled, and numbered rows are not shuffled to find where parts start."""
    plans = []

    def plan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        plans.append((text.count("Exchange hashpartitioning"), text.count("SortMergeJoin")))

    monkeypatch.setattr(ring, "staged", lambda df, name: plan(df) or staged(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan(ring.sharded(documents, 40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[:2] == [(1, 0), (0, 0)] and plans[2][1] == 0


def test_ring_of_awkward_rows(messy, none, rows):
    out = ring.sharded(messy, 3, cells=64).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and {r.size for r in out if r.doc_id == 1} == {16}
    assert ring.sharded(none, 3, cells=64).count() == 0


# ---- language model ------------------------------------------------------------------------------
def kneser_ney_scores(rows, trained):
    """The model by dictionaries."""
    tokens = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + [None] for _, t in rows]
    unigrams, bigrams = Counter(), Counter()
    for (i, _), t in zip(rows, tokens, strict=True):
        if trained(i):
            unigrams.update(t)
            bigrams.update(zip([0, *t[:-1]], t, strict=True))
    conts, totals, follows = Counter(w for _, w in bigrams), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), c in bigrams.items():
        totals[u] += c
        follows[u][min(c, 3) - 1] += 1
    of = lambda counts: [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
    high, low = kneser_ney.discounts(of(bigrams)), kneser_ney.discounts(of(conts))
    spread = low[1] * of(conts)[0] + low[2] * of(conts)[1] + low[3] * sum(c > 2 for c in conts.values())
    n, v, a = sum(unigrams.values()), len(unigrams), len(bigrams)

    def p(u, w):
        p1 = (max(conts[w] - low[min(conts[w], 3)], 0) + spread / (v + 1)) / a if a else 1.0
        if not totals[u]:
            return p1
        c = bigrams[u, w]
        return (max(c - high[min(c, 3)], 0) + sum(d * x for d, x in zip(high[1:], follows[u], strict=True)) * p1) / totals[u]

    if a:
        assert abs(sum(p(u, w) for w in [*unigrams, "never seen"] for u in [0]) - 1) < 1e-9
    for (i, _), t in zip(rows, tokens, strict=True):
        base = sum(math.log10((unigrams[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = sum(math.log10(p(u, w)) for u, w in zip([0, *t[:-1]], t, strict=True))
        yield i, not trained(i), len(t), sum(unigrams[w] > 0 for w in t), n, round(base, 6), round(score, 6)


def seen(df):
    return Counter(repr((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6))) for r in df.collect())


def test_model_equals_dictionaries(messy, none, rows):
    marked = messy.withColumn("held_out", F.col("doc_id") % 3 == 0)
    expected = Counter(map(repr, kneser_ney_scores(rows, lambda i: i is not None and i % 3 != 0)))
    assert seen(kneser_ney.perplexities(marked)) == expected
    assert kneser_ney.perplexities(none.withColumn("held_out", F.lit(False))).count() == 0


def test_model_without_training_rows(messy, rows):
    out = seen(kneser_ney.perplexities(messy.withColumn("held_out", F.lit(True))))
    assert out == Counter(map(repr, kneser_ney_scores(rows, lambda i: False)))


def test_model_beats_base(spark):
    out = queries.op4_kneser_ney_scoring(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# ---- classifier and mixing -----------------------------------------------------------------------
def test_discriminant_on_held_out_rows(spark, labels):
    out = queries.op9_quality_discriminant(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 10 and sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_discriminant_of_awkward_rows(messy, none, rows, spark):
    known = spark.createDataFrame([(7, 1, True), (8, 1, True), (9, 0, True), (None, 1, True), (12, None, True), (13, 0, None)],
                                  "doc_id long, quality int, train boolean")
    out = qda.scored(messy, known, "quality").collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and {round(r.score, 6) for r in out} == {round(4 / 6, 6)}
    more = known.unionByName(spark.createDataFrame([(11, 0, True)], known.schema))
    scores = qda.scored(messy, more, "quality").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scores)
    assert qda.scored(none, more, "quality").count() == 0


def test_density_is_gaussian():
    rng = np.random.default_rng(2)
    x = {0: rng.normal(size=(80, 3)), 1: rng.normal(1, 2, size=(60, 3))}
    found = {c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}
    model = qda.Discriminant(found, 0.2)
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x.values()) / 140
    logs = []
    for c, v in x.items():
        cov = 0.8 * np.cov(v.T, bias=True) + 0.2 * np.diag(np.diag(pooled))
        gap = np.array([0.3, -1, 2]) - v.mean(0)
        logs.append(math.log(len(v) / 140) - 0.5 * math.log(np.linalg.det(cov)) - 0.5 * gap @ np.linalg.solve(cov, gap))
    assert abs(model(np.array([[0.3, -1, 2]]))[0] - 1 / (1 + math.exp(logs[0] - logs[1]))) < 1e-9


def test_rates_reach_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.4], 400)
    t = rng.integers(0, 500, 400)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    residuals, reached = mixing.fit_rates(df, (0.5, 0.3, 0.1), steps=200)
    rate, _ = mixing._rates(p, residuals, mixing.RIDGE)
    assert (rate >= 0).all() and np.allclose(reached, (rate * t) @ p / t.sum()) and np.abs(reached - [0.5, 0.3, 0.1]).max() < 5e-3
    assert np.allclose(residuals, newton(t.astype(float), p, np.array([0.5, 0.3, 0.1])), atol=1e-6)


def newton(t, p, targets, ridge=mixing.RIDGE):
    """The same problem by damped Newton steps on its dual, as a reference."""
    w = t / t.sum()
    shares = w @ p
    base = mixing.weights_of(shares, targets)

    def at(g):
        rate = np.maximum(1 - p @ g / ridge, 0)
        return g * g @ base / 2 + ridge / 2 * (w @ rate**2) + targets @ g, g * base - (w * rate) @ p + targets, rate

    g = np.zeros(len(targets))
    for _ in range(200):
        value, slope, rate = at(g)
        move = np.linalg.solve(np.diag(base) + (p * (w * (rate > 0))[:, None]).T @ p / ridge, slope)
        length = 1.0
        while length > 1e-6 and at(g - length * move)[0] > value:
            length /= 2
        g = g - length * move
    return g


@pytest.mark.parametrize("share", [0.005, 0.001, 0.0003])
def test_rates_reach_targets_of_rare_domains(spark, share):
    """With production defaults, a domain of 0.1 % of the tokens gets the 3 % that rates can give it."""
    toxic = round(20_000 * share)
    rows = [(100, [0.0, 0.0, 1.0])] * toxic + [(100, [0.0, 1.0, 0.0])] * 6_000 + [(100, [1.0, 0.0, 0.0])] * (14_000 - toxic)
    df = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    g, reached = mixing.fit_rates(df, queries.TARGETS)
    assert np.allclose(reached, queries.TARGETS, rtol=2e-3) and not mixing.missed(queries.TARGETS, reached)
    p, t = np.array([r[1] for r in rows]), np.array([float(r[0]) for r in rows])
    rate, _ = mixing._rates(p, g, mixing.RIDGE)
    assert np.allclose((t * rate) @ p / t.sum(), reached)
    residual = (reached - queries.TARGETS) / mixing.weights_of(t @ p / t.sum(), np.array(queries.TARGETS))
    assert np.allclose(np.maximum(1 - p @ residual / mixing.RIDGE, 0), rate, atol=1e-3)
    assert np.allclose(g, newton(t, p, np.array(queries.TARGETS)), atol=1e-6)


def test_mixing_query(spark, labels, documents):
    """The classifier tells held-out domains apart, every given target is met, and rates are those of the projection."""
    out = queries.op5_soft_mixing(spark, SF)
    told = out.schema["rate"].metadata
    assert told["missed"] == [] and np.allclose(told["reached"], queries.TARGETS, rtol=1e-2)
    rows = out.collect()
    t, p = np.array([float(r.n_tokens) for r in rows]), np.array([r.p for r in rows])
    rate = np.array([r.rate for r in rows])
    assert len(rows) == documents.count() and np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert np.allclose((t * rate) @ p / t.sum(), told["reached"])
    assert np.allclose(rate, np.maximum(1 - p @ newton(t, p, np.array(queries.TARGETS)) / mixing.RIDGE, 0), atol=1e-2)


def test_classifier_on_held_out_rows(spark):
    """Taught by half of the labels, it tells the domains of the other half better than their shares do."""
    larger = SF.replace("sf0.001", "sf0.01")
    documents, known = (spark.read.parquet(f"{larger}/{name}.parquet") for name in ("documents", "labels"))
    known = known.withColumn("domain", F.expr(queries.DOMAIN)).where("domain is not null")
    model = mixing.fitted(documents, known.where("doc_id % 2 = 0"), F.col("domain"), 3)
    asked = known.where("doc_id % 2 = 1").select(F.col("doc_id").alias("key"), "domain")
    rows = mixing.memberships(documents, model).join(asked, "key").collect()
    truth, p = np.array([r.domain for r in rows]), np.array([r.p for r in rows])
    shares = np.bincount(truth, minlength=3) / len(truth)
    assert len(rows) > 100 and (p.argmax(1) == truth).mean() > shares.max() + 0.05
    assert np.log(p[np.arange(len(truth)), truth]).mean() > shares @ np.log(shares) + 0.2


def test_missed_targets_are_told(spark, messy, labels, caplog):
    df = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.8, 0.2])], "n_tokens long, p array<double>")
    _, reached = mixing.fit_rates(df, (0.0, 0.5))
    assert reached[0] > 0.1 and "miss their targets" in caplog.text
    told = mixing.mixed(messy, labels, F.expr(queries.DOMAIN), queries.TARGETS).schema["rate"].metadata
    assert told["targets"] == list(queries.TARGETS) and len(told["reached"]) == 3


def test_copies_have_the_rate_as_mean():
    draw = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    for rate in (0.0, 0.3, 1.0, 2.6):
        copies = mixing._copies(np.full(20_000, rate), draw)
        assert abs(copies.mean() - rate) < 0.02 and set(copies) <= {math.floor(rate), math.ceil(rate)}


def test_mixing_of_awkward_rows(messy, none, labels, rows):
    domain = F.expr(queries.DOMAIN)
    out = mixing.mixed(messy, labels, domain, queries.TARGETS).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and all(r.rate >= 0 for r in out)
    again = mixing.resampled(messy, labels, domain, queries.TARGETS)
    assert again.schema == messy.schema
    assert Counter(r.doc_id for r in again.collect()) == Counter({i: n for i, n in _copies_of(out).items() if n})
    assert mixing.mixed(none, labels, domain, queries.TARGETS).count() == 0
    assert mixing.resampled(none, labels, domain, queries.TARGETS).count() == 0


def _copies_of(out):
    copies = Counter()
    for r in out:
        copies[r.doc_id] += r.copies
    return copies


# ---- queries and pipeline ------------------------------------------------------------------------
def test_pipeline(spark, documents, labels):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert 0 < docs.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(ids) == docs.count() and all(r.round_trip for r in ids)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in ids)
    clean = labels.join(documents, "doc_id").filter("quality = 1 and toxic = 0 and n_chars > 400").count()
    kept = labels.join(docs.select("doc_id").distinct(), "doc_id").groupBy("quality", "toxic").count().collect()
    assert sum(r["count"] for r in kept if (r.quality, r.toxic) == (1, 0)) >= 0.8 * clean
    assert not [r for r in kept if r.quality == 0]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    theirs = [d[0] for d in result.description]
    expected = Counter(repr(tuple(r[theirs.index(c)] for c in df.columns)) for r in result.fetchall())
    assert Counter(repr(tuple(r)) for r in df.collect()) == expected


def test_all_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
