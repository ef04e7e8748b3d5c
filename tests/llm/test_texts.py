"""Operators on texts against brute force: quality rules, repeated spans, similarity join, token files, pieces."""

import glob
import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spacegauge.llm import cascade, debruijn, jaccard, pieces, token_files
from spacegauge.llm.components import components
from spacegauge.llm.tables import new_folder
from spacegauge.llm.words import RunHash, Texts

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def multiset(df):
    return Counter(map(repr, (tuple(r) for r in df.collect())))


# ---- words ---------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b x", max_size=30)), max_size=8))
def test_words_of_slices(texts):
    t = Texts(pa.array(texts, pa.string()))
    assert t.n_words.tolist() == [len(words(x)) for x in texts]
    found = [t.data[a:b].tobytes().decode() for a, b in zip(t.starts, t.ends, strict=True)]
    assert found == [w for x in texts for w in words(x)]
    by_word = {}
    for w, h in zip(found, t.word_hash.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_runs_hash_alike_wherever_they_are():
    values = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    twice = np.concatenate((values, values[10:30]))
    h = RunHash(twice)
    at = lambda a, b: h(np.array([a]), np.array([b]))[0]
    assert at(10, 30) == at(50, 70) and at(10, 29) != at(50, 70)


# ---- quality rules -------------------------------------------------------------------------------
def base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit)


def verdict(text):
    n, chars, symbols, dup, repeats = base(text)
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    failed = n < 50 or 100 * repeats > 50 * n
    letters = sum(bool(re.search("[A-Za-z]|[^\x00-\x7f]", x)) for x in w)
    shouted = sum(bool(re.search("[A-Z]", x)) and not re.search("[a-z]", x) for x in w)
    bad = chars < 3 * n or chars > 12 * n or 10 * symbols > n or 2 * dup > len(lines) or 10 * letters < 8 * n or 2 * shouted > n
    return failed, not (failed or bad)


def test_cascade_equals_all_rules(messy, rows):
    expected = Counter(repr((i, *base(t), *verdict(t))) for i, t in rows)
    assert multiset(cascade.verdicts(messy)) == expected


def test_cascade_keeps_rows_whole(messy, none, rows):
    kept = cascade.keep(messy)
    assert kept.schema == messy.schema
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in rows if verdict(x[1])[1])
    assert cascade.keep(none).count() == 0 and cascade.verdicts(none).count() == 0


def test_order_of_rules_changes_no_verdict(rows):
    column = pa.array([t for _, t in rows])
    first = cascade.survivors(column, cascade.RULES)
    assert (first == cascade.survivors(column, cascade.RULES[::-1])).all()


def test_rules_are_ordered_by_rejections_per_cost(spark, documents):
    slow = cascade.Rule("slow", lambda m: np.array([sum(range(20_000)) < 0 for _ in range(len(m.texts))]))
    found = cascade.ordered(documents, (slow, *cascade.RULES))
    assert found[-1].name == "slow" or {r.name for r in found[found.index(slow) :]} <= {"slow", "short_words", "long_words"}


# ---- repeated spans ------------------------------------------------------------------------------
def spans(rows, span):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[p : p + span]) for p in range(len(w) - span + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - span + 1) if seen[tuple(w[p : p + span])] > 1 for q in range(p, p + span)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(map(repr, out))


@pytest.mark.parametrize(("span", "k"), [(35, 8), (10, 3)])
def test_spans_equal_brute_force(messy, rows, span, k):
    assert multiset(debruijn.judged(messy, span, k)) == spans(rows, span)


def test_branching_paths(spark):
    """Copies that part at different places, so that equal edges have different paths around them."""
    body = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"l{i}"] * (i % 3) + body[i : i + 40 + 3 * i] + [f"r{i}{j}" for j in range(i)])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(debruijn.judged(df, 12, 3)) == spans(rows, 12)


def test_removed_keeps_columns(messy, none, rows):
    out = debruijn.removed(messy)
    assert out.columns == messy.columns and dict(out.dtypes) == dict(messy.dtypes)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[7] == " ".join(words(rows[7][1])[:50]) and got[1] is None and got[2] == "" and 9 not in got
    assert debruijn.removed(none).count() == 0


def colliding():
    """Two unlike texts with the same 32-bit hash."""
    return "a4005 " + " ".join(f"w{i}" for i in range(40)), "b72470 " + " ".join(f"v{i}" for i in range(300))


def test_texts_of_one_key_are_told_apart(spark):
    a, b = colliding()
    rows = [(5, a), (5, b), (1, "z" + a), (2, "y" + b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.filter("doc_id = 5").select(F.hash("text")).distinct().count() == 1
    assert multiset(debruijn.judged(df)) == spans(rows, 35)
    assert multiset(debruijn.judged(df.limit(3))) == spans(rows[:3], 35)
    assert multiset(jaccard.joined(df)) == similar(rows)
    assert jaccard.keep_one(df.limit(2)).count() == 2


def test_lists_of_copies_end_at_the_text(spark, monkeypatch):
    """The list of a text's edges that meets each of its copies does not grow with their number."""
    longest, joined = [], debruijn._with

    def measured(left, right):
        for c, kind in right.dtypes:
            if kind.startswith("array"):
                longest.append(right.agg(F.max(F.size(c))).first()[0])
        return joined(left, right)

    monkeypatch.setattr(debruijn, "_with", measured)
    body = [f"w{i}" for i in range(120)]
    text = " ".join(body)
    rows = [(None, text)] * 300 + [(i, " ".join(body[: 60 + i])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(debruijn.judged(df)) == spans(rows, 35)
    assert longest and max(longest) <= 120


# ---- similarity join -----------------------------------------------------------------------------
def similar(rows, n=5, threshold=Fraction(4, 5)):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))} if w else set())
    size, root = len(rows), list(range(len(rows)))
    find = lambda a: a if root[a] == a else find(root[a])
    links = [0] * size
    for a in range(size):
        for b in range(a):
            if sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        group = [x for x in range(size) if find(x) == find(a)]
        same = [x for x in group if sets[x] == sets[a] and (sets[a] or x == a)]
        least = lambda xs: min((rows[x][0] for x in xs if rows[x][0] is not None), default=None)
        out.append((i, least(group), least(same), links[a]))
    return Counter(map(repr, out))


def test_join_equals_brute_force(messy, none, rows):
    assert multiset(jaccard.joined(messy)) == similar(rows)
    assert jaccard.joined(none).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    """A family of near copies in several blocks: links are counted once each, and none is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    body = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*body[: i * 9], f"n{i}", *body[i * 9 + 1 :]])) for i in range(40)] + [(99, " ".join(body))]
    assert multiset(jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == similar(rows)


def test_keep_one(messy, rows):
    kept = jaccard.keep_one(messy)
    assert kept.schema == messy.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8, 8, 9, 11, 12, 14, 15, 16, 17]
    assert ids.count(None) == 1


def test_keep_one_without_and_with_repeated_keys(spark):
    """One row of each class stays, whichever of its rows have no key or one that other texts have too."""
    body = {c: [f"{c}{i}" for i in range(100)] for c in "abcd"}
    exact = {c: " ".join(w) for c, w in body.items()}
    near = {c: " ".join([*w[:-1], "end"]) for c, w in body.items()}
    rows = [(None, exact["a"]), (None, exact["a"]), (None, near["a"])]  # a class without keys
    rows += [(None, exact["b"]), (3, near["b"]), (4, exact["b"])]  # one with and without
    rows += [(1, exact["c"]), (2, near["c"]), (2, exact["d"]), (2, near["d"]), (2, exact["d"])]  # repeated keys
    rows += [(None, None), (None, ""), (None, ""), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(df).collect()]
    groups = Counter((r[1] or " ")[0] for r in kept)
    assert groups == {"a": 1, "b": 1, "c": 1, "d": 1, " ": 4}
    assert {(3, near["b"]), (1, exact["c"])} < set(kept) and all(r in rows for r in kept)


def test_banding_reaches_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.999)):
        bands, per_band = jaccard.bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**per_band) ** bands >= recall and bands * per_band <= jaccard.HASHES
    with pytest.raises(ValueError, match="no banding"):
        jaccard.bands_and_rows(0.01, 0.9999)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (60, 60), (71, 70), (70, 72)]
    found = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 31)}, 50: 40, 71: 70, 72: 70}


# ---- token files ---------------------------------------------------------------------------------
def test_token_files_equal_library(spark, messy, none, rows):
    folder = new_folder(spark, "test-tokens")
    token_files.write(token_files.encoded(messy, BPE), folder)
    library, at, expected = Tokenizer.from_file(BPE), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(token_files.placed(spark, folder).collect(), key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(expected)
    assert [r.doc_id for r in got] == [i for i, _, _ in expected]
    empty = new_folder(spark, "test-tokens")
    token_files.write(token_files.encoded(none, BPE), empty)
    assert token_files.placed(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB'sé,.!?1 \n\t ́ßİ中-<|>end", max_size=60))
def test_word_encoder_equals_library(text):
    ids, bounds = token_files.word_encoder(BPE)(pa.array([text, None, text]))
    expected = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    assert ids[: bounds[1]].tolist() == expected == ids[bounds[2] :].tolist() and bounds[1] == bounds[2]


def test_token_file_layout(spark, documents):
    folder = new_folder(spark, "test-tokens")
    token_files.write(token_files.encoded(documents, BPE), folder, row_group=64 << 10, page=8 << 10)
    last, groups = -1, 0
    for path in sorted(glob.glob(f"{folder.removeprefix('file:')}/part-*.parquet")):
        file = pq.ParquetFile(path)
        groups += file.metadata.num_row_groups
        ids = file.read(["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
        columns = {c.path_in_schema: c for c in (file.metadata.row_group(0).column(i) for i in range(4))}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert groups >= 2
    part = token_files.read(spark, folder, 20, 22)
    assert sorted(r.doc_id for r in part.collect()) == [20, 21, 22]
    assert "ids" not in token_files.read(spark, folder, ids=False).columns


# ---- pieces --------------------------------------------------------------------------------------
def viterbi(text, v):
    """The whole lattice at once."""
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    best, back = [0.0] + [None] * len(s), [0] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for begin in range(max(0, end - v.longest), end):
            piece = v.pieces.get(s[begin:end])
            if piece or end - begin == 1:
                total = best[begin] + (piece[1] if piece else v.unknown)
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, begin
    out, end = [], len(s)
    while end:
        piece = v.pieces.get(s[back[end] : end])
        out[:0] = [piece[0]] if piece else [v.byte_ids[b] for b in s[back[end] : end].encode()]
        end = back[end]
    return out


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="the re ing\né中\U0001f600 ationsS", max_size=120))
def test_streaming_viterbi_equals_whole_lattice(text):
    encoder = pieces.piece_encoder(PIECES)
    t = Texts(pa.array([text, None, text]))
    ids, bounds = encoder(t)
    assert ids[: bounds[1]].tolist() == viterbi(text, encoder.vocabulary) == ids[bounds[2] :].tolist()
    raw, at = encoder.decode(ids, bounds)
    assert raw[: at[1]].tobytes().decode() == text
    assert sentencepiece.SentencePieceProcessor(model_file=PIECES).decode(ids[: bounds[1]].tolist()) == text


def test_window_stays_small():
    """A text without blanks is committed as it goes on."""
    v = pieces.piece_encoder(PIECES).vocabulary
    sizes = [len(ids) for ids in pieces.stream("therationsing" * 400, v)]
    assert len(sizes) > 50 and max(sizes) < 3 * pieces.CHECK_EVERY


def test_pieces_of_rows(spark, messy, none, rows):
    out = pieces.encoded(messy, PIECES)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in out.collect())
    back = Counter((r.doc_id, r.text) for r in pieces.decoded(out, PIECES).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    assert pieces.encoded(none, PIECES).count() == 0
