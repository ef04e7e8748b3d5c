"""Repair of conversations by generalised LR parsing with weighted edits.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. A parser of that grammar reads its rows in
order, and at each row may keep, rerole or delete it, and anywhere insert a row. Its stacks are linked nodes that share
all that lies below their tops; wherever two stacks have equal tops, what may follow is equal too, and only the one with
the least (cost, audit) goes on. No two audits of equal cost are prefixes of one another, since the letters that follow
the shorter could be inserts only and would cost more, so the least of the merged stacks leads to the least of all.

Rows are folded to (conversation, turn, role, fingerprint, fault) with a count, ordered by range over all of these, and
parsed in pieces of at most ``PIECE`` rows, so a conversation that holds most rows is cut over many tasks: a piece whose
beginning is unknown is parsed from each top that can stand there. Per conversation the pieces' ways are chained, one
letter a row. Texts are then met by their conversation's audit and stream by in order; a digest of a whole text reads
that text in one task, with the memory of one row.

Defined results: a null role or text counts as one blank; rows without a conversation are one conversation, with a null
key; a null turn comes first; rows of one turn are ordered by role, then by the MD5 of their text; rows that repeat are
duplicates but the first; an empty table gives no rows; other columns are not read. Texts are whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacegauge.llm.tables import fingerprint, staged

PIECE = 4096
"""Rows of a conversation parsed at once."""
BLANKS = " \t\n\x0b\x0c\r"

#: What edits cost: those of a row, an insert, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# The parser of  C -> (empty) | P | s P,  P -> P T | T,  T -> u a : where each state goes on a role's initial, which
# states end a rule (its length and left side), and where it goes then.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 6}, 3: {"u": 2}, 5: {"u": 2}}
REDUCE = {4: (1, "P"), 6: (2, "T"), 7: (2, "P")}
GOTO = {0: {"P": 3, "T": 4}, 1: {"P": 5, "T": 4}, 3: {"T": 7}, 5: {"T": 7}}
ACCEPT = (0, 3, 5)
#: A stack for each top that stands between two rows, as (state, stack below).
ENTRIES = {0: (0, None), 1: (1, (0, None)), 2: (2, (0, None)), 3: (3, (0, None)), 5: (5, (1, (0, None)))}

# A row's code: four times the place of its initial among these (or three), plus its fault.
INITIALS = "sua"
SOUND, CUT, BLANK, COPY = range(4)


def _shifted(stack: tuple, initial: str) -> tuple | None:
    """The stack after a row with that initial; None where the grammar has none."""
    state = SHIFT[stack[0]].get(initial)
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        length, left = REDUCE[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (GOTO[stack[0]][left], stack)
    return stack


def _offer(tops: dict, stack: tuple, cost: int, audit: str) -> bool:
    """Merge a stack into those with its top; whether it is the least."""
    there = tops.get(stack[0])
    if there is not None and there[:2] <= (cost, audit):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def _inserted(tops: dict) -> dict:
    """The stacks, and those after any inserts."""
    tops, todo = dict(tops), list(tops)
    while todo:
        cost, audit, stack = tops[todo.pop()]
        for initial in "ua":
            after = _shifted(stack, initial)
            if after and _offer(tops, after, cost + INSERT, audit + "I"):
                todo.append(after[0])
    return tops


def _parsed(codes: bytes, entry: int) -> dict[int, tuple[int, str]]:
    tops = {entry: (0, "", ENTRIES[entry])}
    for code in codes:
        own, fault = divmod(code, 4)
        stays = fault in (SOUND, CUT)
        extra = TRUNCATED if fault == CUT else 0
        after: dict = {}
        for cost, audit, stack in _inserted(tops).values():
            _offer(after, stack, cost + DELETE, audit + "D")
            for initial in SHIFT[stack[0]] if stays else ():
                if INITIALS.find(initial) == own:
                    _offer(after, _shifted(stack, initial), cost + extra, audit + "K")
                elif initial != "s":
                    _offer(after, _shifted(stack, initial), cost + extra + REROLE, audit + "R")
        tops = after
    return {top: way[:2] for top, way in tops.items()}


_known = lru_cache(1 << 14)(_parsed)


def ways(codes: bytes, entry: int) -> dict[int, tuple[int, str]]:
    """From the stack top before the rows with these codes to each top after them: the least (cost, audit)."""
    return (_known if len(codes) <= 64 else _parsed)(codes, entry)


def ending(tops: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) by which a conversation can end there."""
    closed = _inserted({top: (*way, ENTRIES[top]) for top, way in tops.items()})
    return min(way[:2] for top, way in closed.items() if top in ACCEPT)


def illegal(codes: bytes) -> int:
    """Neighbours other than system and user, user and assistant, assistant and user."""
    return sum((a // 4, b // 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:], strict=False))


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _rows(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    named = {"conv": F.col(f"`{key}`"), "turn": F.col(f"`{turn}`")}
    named |= {n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for n, c in (("role", role), ("text", text))}
    return df.select(*[c.alias(n) for n, c in named.items()]).withColumn("mark", fingerprint("text"))


def _folded(rows: DataFrame) -> DataFrame:
    """Distinct rows in no order: ``conv, turn, role, mark``, the ``code`` of the first of them and their number ``n``."""
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ends == "", BLANK).when(F.right(ends, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    folded = rows.groupBy("conv", "turn", "role", "mark", fault.alias("fault")).agg(F.count("*").alias("n"))
    first = folded.groupBy("conv", "role", "mark").agg(F.min(F.struct("turn")).alias("first"))
    first = first.withColumnsRenamed({"conv": "their_conv", "role": "their_role", "mark": "their_mark"})
    met = F.col("conv").eqNullSafe(F.col("their_conv")) & (F.col("role") == F.col("their_role"))
    begins = F.left("role", F.lit(1))
    own = F.when(begins == "s", 0).when(begins == "u", 1).when(begins == "a", 2).otherwise(3)
    again = ~F.struct("turn").eqNullSafe(F.col("first"))
    code = own * 4 + F.when((F.col("fault") != BLANK) & again, COPY).otherwise(F.col("fault"))
    return folded.join(first, met & (F.col("mark") == F.col("their_mark"))).select(
        "conv", "turn", "role", "mark", code.cast("int").alias("code"), "n"
    )


class _Out:
    """Rows gathered into batches of a schema; ``size`` is what a row weighs."""

    def __init__(self, schema: pa.Schema, most: int = 1 << 20):
        self.schema, self.most = schema, most
        self.rows, self.weight = [], 0

    def add(self, row: tuple, size: int = 64) -> bool:
        """Whether the rows are enough for a batch."""
        self.rows.append(row)
        self.weight += size
        return self.weight > self.most

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.weight = [], 0
        return made


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _pieces(ordered: DataFrame) -> DataFrame:
    """Per piece of a conversation: its place, the codes that begin and end it, its counts and its ways."""
    counts = ("blank", "duplicate", "truncated", "illegal")
    lists = [("entries", pa.int32()), ("exits", pa.int32()), ("costs", pa.int64()), ("audits", pa.string())]
    fields = [("conv", _arrow(ordered, "conv")), ("part", pa.int32()), ("piece", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
    schema = pa.schema([*fields, *[(c, pa.int64()) for c in counts], *[(n, pa.list_(t)) for n, t in lists]])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), _Out(schema)
        now, begun, opened, number, codes = None, False, True, 0, bytearray()

        def done() -> bool:
            nonlocal number
            held = bytes(codes)
            faults = [c % 4 for c in held]
            found = [
                (entry, leaving, *way)
                for entry in ((0,) if number == 0 and not opened else ENTRIES)
                for leaving, way in ways(held, entry).items()
            ]
            counted = [*(faults.count(f) for f in (BLANK, COPY, CUT)), illegal(held)]
            full = out.add((now, part, number, held[0], held[-1], *counted, *zip(*found, strict=True)), 64 + len(held) * len(found))
            number += 1
            codes.clear()
            return full

        for batch in batches:
            for conv, code, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "code", "n")), strict=True):
                if begun and not _same(conv, now):
                    if codes and done():
                        yield out.batch()
                    opened, number = False, 0
                now, begun = conv, True
                again = code if code % 4 in (BLANK, COPY) else code - code % 4 + COPY
                codes.append(code)
                n -= 1
                while n or len(codes) >= PIECE:
                    more = min(n, PIECE - len(codes))
                    codes.extend([again] * more)
                    n -= more
                    if len(codes) == PIECE and done():
                        yield out.batch()
        if codes:
            done()
        yield out.batch()

    kind = ordered.schema["conv"].dataType.simpleString()
    return ordered.mapInArrow(
        pieces,
        f"conv {kind}, part int, piece long, first int, last int, {', '.join(f'{c} long' for c in counts)}, "
        "entries array<int>, exits array<int>, costs array<long>, audits array<string>",
    )


def _chained(pieces: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit, from its pieces in order."""
    counts = ("blank", "duplicate", "truncated", "illegal")
    schema = pa.schema([("conv", _arrow(pieces, "conv")), *[(c, pa.int64()) for c in (*counts, "cost")], ("audit", pa.string())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        now, begun, total, last, tops, settled = None, False, [0] * 4, None, {}, []

        def done() -> bool:
            cost, audit = ending(tops)
            audit = "".join([*settled, audit])
            return out.add((now, *total, cost, audit), 64 + len(audit))

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or not _same(row["conv"], now):
                    if begun and done():
                        yield out.batch()
                    now, begun, total, last, tops, settled = row["conv"], True, [0] * 4, None, {0: (0, "")}, []
                total = [a + row[c] for a, c in zip(total, counts, strict=True)]
                if last is not None:
                    total[3] += illegal(bytes((last, row["first"])))
                last = row["last"]
                after: dict = {}
                for entry, leaving, cost, audit in zip(*(row[c] for c in ("entries", "exits", "costs", "audits")), strict=True):
                    if entry in tops:
                        way = (tops[entry][0] + cost, tops[entry][1] + audit)
                        after[leaving] = min(after.get(leaving, way), way)
                common = os.path.commonprefix([audit for _, audit in after.values()])  # what all ways share is final
                settled.append(common)
                tops = {top: (cost, audit[len(common) :]) for top, (cost, audit) in after.items()}
        if begun:
            done()
        yield out.batch()

    kind = pieces.schema["conv"].dataType.simpleString()
    sorted_pieces = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return sorted_pieces.mapInArrow(chain, f"conv {kind}, {', '.join(f'{c} long' for c in (*counts, 'cost'))}, audit string")


def judged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: key, ``gaps`` in its turns, its ``blank, duplicate, truncated`` rows, its ``illegal`` neighbours, and
    the ``cost`` and ``audit`` of its repair: the first letters of keep, rerole, delete and insert, in order."""
    return _judged(_rows(df, key, turn, role, text)).withColumnRenamed("conv", key)


def _judged(rows: DataFrame) -> DataFrame:
    folded = staged(_folded(rows), "turns")
    order = ("conv", "turn", "role", "mark")
    solved = _chained(_pieces(folded.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "code", "n")))
    spans = folded.select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    spans = spans.withColumnRenamed("conv", "their_conv")
    both = solved.join(spans, F.col("conv").eqNullSafe(F.col("their_conv")))
    return both.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of repaired conversations: key, ``place`` (from 0), ``edit`` (keep, rerole or insert, by its first letter),
    ``role`` and ``text``."""
    rows = _rows(df, key, turn, role, text)
    return _edited(rows, _judged(rows)).withColumnRenamed("conv", key)


def _edited(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's rows follow one another, in order, in one partition."""
    schema = pa.schema([("conv", _arrow(rows, "conv")), ("place", pa.int64()), *[(c, pa.string()) for c in ("edit", "role", "text")]])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, audit, at, place, leads = _Out(schema), None, "", 0, 0, 0

        def put(letter: str, own: str, said: str) -> bool:
            nonlocal place
            given = own if letter == "K" else ("user", "assistant")[(place - leads) % 2]
            place += 1
            return out.add((conv, place - 1, letter, given, said), 64 + len(said))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "audit")), strict=True):
                if row[1] == 0:
                    while at < len(audit):  # inserts after the last row
                        if put("I", "", ""):
                            yield out.batch()
                        at += 1
                    conv, audit, at, place = row[0], row[4], 0, 0
                    leads = (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with a system row
                    continue
                while audit[at] == "I":
                    if put("I", "", ""):
                        yield out.batch()
                    at += 1
                if audit[at] != "D" and put(audit[at], row[2], row[3]):
                    yield out.batch()
                at += 1
        while at < len(audit):
            put("I", "", "")
            at += 1
        yield out.batch()

    none = F.lit(None)
    said = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "mark", "text", none.cast("string").alias("audit"))
    turn = rows.schema["turn"].dataType
    plans = solved.select(
        "conv", F.lit(0).alias("kind"), none.cast(turn).alias("turn"), F.lit("").alias("role"), none.cast("binary").alias("mark"),
        F.lit("").alias("text"), "audit",
    )
    met = plans.unionByName(said).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "mark")
    kind = rows.schema["conv"].dataType.simpleString()
    return met.select("conv", "kind", "role", "text", "audit").mapInArrow(edit, f"conv {kind}, place long, edit string, role string, text string")


def digested(df: DataFrame, keys: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`judged` for every key in ``keys``, with ``repaired_sha256``: that of the lines ``role:text`` of the repaired
    conversation, joined by line ends. A key without rows has zeros, no edits and the empty text."""
    rows = _rows(df, key, turn, role, text)
    solved = staged(_judged(rows), "repairs")
    schema = pa.schema([("their_conv", _arrow(rows, "conv")), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, held = _Out(schema), None, None
        for batch in batches:
            for now, place, own, said in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")), strict=True):
                if place == 0:
                    if held is not None and out.add((conv, held.hexdigest())):
                        yield out.batch()
                    conv, held = now, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{own}:{said}".encode())
        if held is not None:
            out.add((conv, held.hexdigest()))
        yield out.batch()

    kind = rows.schema["conv"].dataType.simpleString()
    sums = _edited(rows, solved).mapInArrow(digest, f"their_conv {kind}, repaired_sha256 string")
    all_keys = keys.select(F.col(f"`{key}`").alias("id")).distinct()
    whole = all_keys.join(solved, F.col("id").eqNullSafe(F.col("conv")), "left").join(
        sums, F.col("id").eqNullSafe(F.col("their_conv")), "left"
    )
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        F.col("id").alias(key),
        *zeros,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
