"""Vector links, token alignment and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from spacegauge.llm import align, pivots, queries, repair
from tests.llm.conftest import CLASHING, SF

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PATHS = (BYTES, PIECES, public_tokenizers.PATTERN)


def clash(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate((*CLASHING, "conv", "slice", "place", "point", "links")) if c not in df.columns})


def bag(df):
    return Counter(repr(tuple(r)) for r in df.collect())


# ---- vectors -------------------------------------------------------------------------------------
def linked(rows, threshold=0.98):
    """By all pairs; ``rows`` are (id, vector, label)."""
    fit = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    unit = [np.array(v) / max(map(abs, v)) if ok else None for ok, (_, v, _) in zip(fit, rows)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    root = list(range(len(rows)))

    def find(a):
        return a if root[a] == a else find(root[a])

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    out = []
    for a, (i, _, _) in enumerate(rows):
        least = min((rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None), default=None)
        out.append((i, links[a], least, i == least))
    return Counter(map(repr, out))


def near(rng, base, cosine):
    z = rng.normal(size=len(base))
    z -= (z @ base) * base / (base @ base)
    return cosine * base / np.linalg.norm(base) + (1 - cosine**2) ** 0.5 * z / np.linalg.norm(z)


def frame(spark, rows):
    return clash(spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l) for i, v, l in rows], "vec_id long, embedding array<double>, label int"))


def test_links_equal_all_pairs(spark, monkeypatch):
    """Chains, near copies, exact copies and a hot group over several blocks of its lists."""
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64), i % 3) for i in range(200)]
    base = rng.normal(size=64)
    rows += [(1000 + i, near(rng, base, 0.997), 1) for i in range(90)]
    rows += [(2000 + i, base, 1) for i in range(30)] + [(3000, base, 2)]
    chain = rng.normal(size=64)
    for i in range(12):
        chain = near(rng, chain, 0.985)
        rows.append((4000 - i, chain, 0))
    assert bag(pivots.linked(frame(spark, rows))) == linked(rows)


def test_links_of_awkward_vectors(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(None, same, 1), (5, same, 1), (5, [2.0, 4.0, 4.0], 1), (6, [1e200, 2e200, 2e200], 1), (7, [1e-200, 2e-200, 2e-200], 1)]
    rows += [(8, same, None), (9, None, 1), (10, [], 1), (11, [0.0, 0.0, 0.0], 1), (12, [1.0, None, 2.0], 1), (13, [1.0, 2.0], 1), (14, [2.0, 4.0], 1)]
    rows += [(15, [float("nan"), 1.0, 1.0], 1), (16, [float("inf"), 2.0, 2.0], 1), (17, [3.0], 1), (18, [4.0], 1), (19, [-4.0], 1), (None, None, None), (20, same, 2)]
    df = frame(spark, rows)
    assert bag(pivots.linked(df)) == linked(rows)
    assert pivots.linked(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("length", [2, 3, 8, 16, 64, 256])
def test_index_finds_pairs_at_the_threshold(length):
    """Pairs other than those by which the number of points was chosen."""
    rng = np.random.default_rng(length)
    points = pivots.reference_points(length, 2048, 0.98)
    a = rng.normal(size=(1500, length))
    b = np.array([near(rng, x, 0.9801) for x in a])
    both = pivots.nearest(pivots.unit(a), points)[:, :, None] == pivots.nearest(pivots.unit(b), points)[:, None, :]
    assert (both.sum((1, 2)) >= pivots.SHARED).mean() >= 0.96


def test_links_query(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    assert bag(queries.op11_pivot_permutation_links(spark, SF)) == linked(rows)


# ---- alignment -----------------------------------------------------------------------------------
def aligned(texts):
    """One text and one byte at a time, with the libraries that the files are made for."""
    left, right = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    left.encode_special_tokens = True
    letters = align.byte_letters()
    spelled = []
    for text in texts:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()) for i in right.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a = b = []
        groups, x, y, i, j = [[[], []]], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                groups[-1][0].append(a[i][0])
                x += len(a[i][1])
                i += 1
            else:
                groups[-1][1].append(b[j][0])
                y += len(b[j][1])
                j += 1
            if x == y:
                groups.append([[], []])
        spelled.append((len(a), len(b), groups[:-1]))
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in spelled for g in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for n_a, n_b, groups in spelled:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


AWKWARD = ["<|endoftext|> <s> </s><unk>", "a▁b", "▁", " ", "  two  blanks ", "日本語 text 🎉🎉", "é\u0085 x", "\x00\x01 a", "don't we'll I'D", "x" * 3000, "\t\n\r\x0b", "ﬁ ½ Å"]


def test_alignment_equals_bytewise(spark, messy, none, rows, monkeypatch):
    monkeypatch.setattr(align, "LINKS", 500)
    more = spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD, 50)], "doc_id long, text string")
    every = [*rows, *enumerate(AWKWARD, 50)]
    expected = Counter(repr((i, *x)) for (i, _), x in zip(every, aligned([t for _, t in every]), strict=True))
    df = clash(messy).unionByName(more, allowMissingColumns=True)
    assert bag(align.aligned(df, *PATHS)) == expected
    assert align.aligned(none, *PATHS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB'sé,.!?1 \n\t ́ßİ中▁🎉\u0085​　<|>end", max_size=50))
def test_byte_level_equals_library(text):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    left, _ = align.encoders(*PATHS)
    assert left([text]) == [library.encode(" " + text, add_special_tokens=False).ids if text else []]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.randoms())
def test_jumps_end_at_common_ends(sizes, rng):
    total = sum(sizes)
    cuts = sorted({total, *(rng.randint(1, total) for _ in range(len(sizes)))})
    other = np.diff([0, *cuts])
    last_a, last_b = pivot = align.jumped(np.array(sizes), other)
    ends, common = np.cumsum(sizes).tolist(), sorted(set(np.cumsum(sizes).tolist()) & set(cuts))
    for got, own in zip(pivot, (ends, cuts), strict=True):
        assert [ends[i] for i in got] == [min(c for c in common if c >= e) for e in own]


def test_alignment_query(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = Counter(repr((r.doc_id, *x)) for r, x in zip(df, aligned([r.text for r in df]), strict=True))
    assert bag(queries.op12_pointer_jumping_alignment(spark, SF)) == expected


# ---- conversations -------------------------------------------------------------------------------
def cheapest(rows):
    """Every script of edits for rows of (initial, fault); at most two inserts in a row."""
    best = None
    choices = [[("K", i, 0), ("R", "u", 3), ("R", "a", 3), ("D", "", 4)] if fault in ("", "truncated") else [("D", "", 4)] for i, fault in rows]
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for script in itertools.product(*choices):
        extra = sum(3 for (letter, _, _), (_, fault) in zip(script, rows, strict=True) if letter != "D" and fault == "truncated")
        base = sum(c for _, _, c in script) + extra
        if best and base > best[0]:
            continue
        for before in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, before))
            if best and cost > best[0]:
                continue
            said, audit = "", ""
            for lead, edit in itertools.zip_longest(before, script):
                said += "".join(lead) + (edit[1] if edit else "")
                audit += "I" * len(lead) + (edit[0] if edit else "")
            if re.fullmatch("(s?(ua)+)?", said):
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def code(initial, fault):
    return "sua?".index(initial) * 4 + ("", "truncated", "blank", "duplicate").index(fault)


def test_parser_equals_all_scripts():
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice("sua?"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 4))]
        codes = bytes(code(*r) for r in rows)
        assert repair.ending(repair.ways(codes, 0)) == cheapest(rows), rows


def test_parser_in_pieces():
    """Ways chained over pieces of any size are those of the whole."""
    rng = random.Random(9)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(1, 30)))
        tops, at = {0: (0, "")}, 0
        while at < len(codes):
            piece = codes[at : at + rng.randint(1, 6)]
            at += len(piece)
            after = {}
            for top, (cost, audit) in tops.items():
                for leaving, way in repair.ways(piece, top).items():
                    whole = (cost + way[0], audit + way[1])
                    after[leaving] = min(after.get(leaving, whole), whole)
            tops = after
        assert repair.ending(tops) == repair.ending(repair.ways(codes, 0))


def conversations(rows):
    """Per conversation of damaged rows (conv, turn, role, text), by one row after the other."""
    out, held = {}, {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, role, text))
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        codes = bytes(code(i if i in ("s", "u", "a") else "?", f) for i, f in zip(initials, faults, strict=True))
        cost, audit = repair.ending(repair.ways(codes, 0))
        lines, stack, leads = [], list(turns), (len(audit) - audit.count("D")) % 2
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else stack.pop(0)
            if letter != "D":
                role = role if letter == "K" else ("user", "assistant")[(len(lines) - leads) % 2]
                lines.append(f"{role}:{text}")
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        wrong = sum((a + b) not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def chances(rows):
    """The damage that the query does, a row at a time."""
    out = []
    for conv, turn, role, text in rows:
        chance = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        row = (conv, turn, "user" if chance == 4 else role, "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text)
        out += [] if chance == 0 else [row, row] if chance == 3 else [row]
    return out


def awkward_turns():
    rng = random.Random(2)
    rows = [(None, t % 7 if t % 5 else None, rng.choice(["user", "assistant", None, "tool", ""]), rng.choice(["a.", "b", "", None, " ", "c! \n"])) for t in range(120)]
    rows += [(1, None, None, None), (2, None, "user", "x."), (2, None, "user", "x."), (3, 2, "system", "Long. " * 9000), (3, 9, "user", "y" * 50_000)]
    for conv in range(4, 60):
        roles = ["system"] * rng.randint(0, 2) + ["user", "assistant"] * rng.randint(0, 5)
        rows += [(conv, t, r, rng.choice(["Said. ", "Cut", "Why?", "Ends!\n", "Same."]) * rng.randint(1, 3)) for t, r in enumerate(roles)]
    return rows


@pytest.mark.parametrize("piece", [3, 4096])
def test_repair_equals_row_by_row(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = awkward_turns()
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    expected = conversations(chances(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    whole = Counter(repr((c, *expected.get(c, nothing))) for c in {r[0] for r in rows})
    assert bag(repair.digested(queries.damaged(df), df)) == whole
    assert repair.digested(df.where("turn < 0"), df.where("turn < 0")).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Cut"), (1, 1, "user", "Cut"), (1, 2, "tool", "Ok!"), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted(tuple(r) for r in repair.repaired(df).collect())
    assert got == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi."), (1, 2, "K", "user", "Cut"), (1, 3, "R", "assistant", "Ok!")]
    assert [r.audit for r in repair.judged(df).orderBy("conv_id").collect()] == ["IKKDR", "D"]


def test_large_conversation_is_cut(spark):
    """One conversation that holds most rows: its pieces come from many tasks, and copies don't grow them."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(9000)] + [(7, None, "user", "Same.")] * 6000 + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folded = repair._folded(repair._rows(df, "conv_id", "turn", "role", "text"))
    order = ("conv", "turn", "role", "mark")
    pieces = repair._pieces(folded.repartitionByRange(8, *order).sortWithinPartitions(*order).select("conv", "code", "n")).collect()
    assert len({p.part for p in pieces if p.conv == 7}) >= 6 and max(len(a) for p in pieces for a in p.audits) <= 2 * repair.PIECE
    got = repair.judged(df).where("conv_id = 7").first()
    assert (got.duplicate, got.cost, got.audit) == (5999, *conversations(rows)[7][5:7])
