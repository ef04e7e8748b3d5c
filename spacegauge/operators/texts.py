"""Ordered texts of a space: joining them, and finding what spans two of them.

Rules are defined on the texts of a space joined in order. Building that joined text just to count in it would put a
whole space into one row, so hits are counted per text, and those that span neighbours are added from what stands
around each joint: the last words before it and the first after it, however long these and the blanks between them are.

A rule of ``n`` words spans a joint with at most ``n`` - 1 words on each side, so that many are kept. Where a text has
fewer, the words before it are added, from as many texts as there can be words. Texts find their neighbours by number
(:func:`spacegauge.operators.lists.number_rows`), for which only their ends are shuffled, so no group holds more than ``n`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacegauge.functions.rules import Rule
from spacegauge.operators.lists import number_rows

WORDS = 2  # words kept on each side: one less than the longest rule that can span a joint has
PIECE_TEXTS = 4096  # texts that are joined into one piece


def _tail(words: int, group: int) -> str:
    """The end of ``text`` as SQL, read backwards: the last words, and their line's start if only marks precede them."""
    pattern = rf"(?U)^\\s*(?:\\S+(?:\\s+\\S+){{0,{words - 1}}})?([\\s*\\-•]*(?:\\n|\\z))?"
    return f"regexp_extract(reverse(text), '{pattern}', {group})"


def _head(words: int) -> str:
    return rf"regexp_extract(text, '(?U)^\\s*(?:\\S+(?:\\s+\\S+){{0,{words - 1}}})?', 0)"


def joints(
    texts: DataFrame, key: str, order: Sequence[str], text: str, sep: str, words: int = WORDS, skip_blank: bool = True
) -> DataFrame:
    """``(key, before, after)``: what stands on either side of each joint between neighbouring texts.

    With ``skip_blank``, texts without words are no neighbours; right for rules that take any white space for one
    blank. Otherwise they are, and blanks are kept as they are; right for rules with literal blanks.
    """
    gap = sep.replace("\n", "\\n")
    blocks = texts.selectExpr(key, *order, f"coalesce({text}, '') as text")
    if skip_blank:
        blocks = blocks.where(r"text rlike '(?U)\\S'")
    ends = blocks.selectExpr(
        key,
        *order,
        f"{_head(words)} as head",
        f"{_tail(words, 0)} as cut",
        f"{_tail(words, 1)} as line",
        "length(text) as size",
    )
    numbered = number_rows(ends, [key], list(order))
    # A cut in the middle of a line is marked, lest it passes for a line's start.
    parts = numbered.selectExpr(
        key,
        "explode(concat("
        "array(named_struct('at', seq, 'd', 0, 'text', head, 'whole', false)), "
        f"transform(sequence(1, {words}), d -> named_struct('at', seq + d, 'd', d, "
        "'text', if(length(cut) = size or line != '', reverse(cut), concat('x ', reverse(cut))), "
        "'whole', length(cut) = size)))) as part",
    ).selectExpr(key, "part.*")
    around = parts.groupBy(key, "at").agg(F.sort_array(F.collect_list(F.struct("d", "text", "whole"))).alias("parts"))
    before = (
        "aggregate(slice(parts, 3, size(parts)), named_struct('text', parts[1].text, 'open', parts[1].whole), "
        f"(s, p) -> if(s.open, named_struct('text', concat(p.text, '{gap}', s.text), 'open', p.whole), s), s -> s.text)"
    )
    return around.where("size(parts) > 1 and parts[0].d = 0 and parts[1].d = 1").selectExpr(
        key, f"{before} as before", "parts[0].text as after"
    )


def joint_hits(rule: Rule, sep: str) -> Column:
    """Hits of a rule that span the joint: those of both sides together, less those of each side.

    No rule begins with a word that it can also end with, so a hit across the joint takes none away.
    """
    gap = sep.replace("\n", "\\n")
    whole = rule.count_sql(f"concat(before, '{gap}', after)")
    return F.expr(f"{whole} - {rule.count_sql('before')} - {rule.count_sql('after')}")


def space_pieces(
    texts: DataFrame, sep: str, text: str = "text", order: str = "ordinal", key: str = "space_id", size: int = PIECE_TEXTS
) -> DataFrame:
    """The texts of a space joined in order, ``size`` at a time: ``key, piece_no, text``, however large a space is."""
    rows = texts.select(key, F.col(order).alias("pos"), F.coalesce(F.col(text), F.lit("")).alias("part"))
    numbered = number_rows(rows, [key], ["pos"]).withColumn("piece_no", F.expr(f"(seq - 1) div {size} + 1"))
    pairs = F.sort_array(F.collect_list(F.struct("seq", "part")))
    joined = F.array_join(F.transform(pairs, lambda p: p["part"]), sep)
    return numbered.groupBy(key, "piece_no").agg(joined.alias("text"))


def space_text(texts: DataFrame, sep: str, text: str = "text", order: str = "ordinal", key: str = "space_id") -> DataFrame:
    """All texts of a space as one text, for those who need it in one row; else see :func:`space_pieces`."""
    pairs = F.sort_array(F.collect_list(F.struct("piece_no", "text")))
    joined = F.array_join(F.transform(pairs, lambda p: p["text"]), sep)
    return space_pieces(texts, sep, text, order, key).groupBy(key).agg(joined.alias("text"))
