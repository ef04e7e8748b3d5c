"""Which strings occur inside which texts of the same space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = 4  # characters by which strings are met, or all of a shorter one
PIECE = 64  # characters of text taken at a time where places are listed
WORDS = 8  # of 64 bits each, in the mask of a space's beginnings


def contained(needles: DataFrame, texts: DataFrame, key: str = "space_id") -> DataFrame:
    """Distinct rows of ``needles`` whose ``needle`` is a substring of any of ``texts(key, text)`` of their space.

    Strings are met by their beginning: every place of a text where one of its space's beginnings may stand, by a mask of
    them, is listed with what follows, joined to the strings that begin so, and compared. The work grows with the length of
    the texts and not with strings times texts, and a space with very many of both is spread by beginning. An empty string
    occurs in every text; null texts hold nothing.
    """
    begin = f"substring(needle, 1, {BEGIN})"
    words = [F.expr(f"bit_or(if(place & {WORDS - 1} = {i}, shiftleft(1L, cast(shiftright(place, 32) & 63 as int)), 0L))").alias(f"m{i}") for i in range(WORDS)]
    named = needles.where("needle is not null")
    masks = named.selectExpr(key, "length(needle) as size", f"xxhash64({begin}) as place").groupBy(key).agg(
        F.max("size").alias("most"), F.expr(f"bit_or(shiftleft(1, least(size, {BEGIN})))").alias("sizes"), *words
    )
    masks = masks.select(key, "most", "sizes", F.array(*[f"m{i}" for i in range(WORDS)]).alias("mask"))
    held = texts.select(key, "text").where(F.col("text").isNotNull()).join(masks, key)
    pieces = held.selectExpr(
        key, "most", "sizes", "mask",
        f"explode(transform(sequence(0, length(text), {PIECE}), at -> substring(text, at + 1, {PIECE} - 1 + greatest(most, 1)))) as piece",
    )
    # An empty text, or the end of one, is a place too: empty strings stand there.
    places = pieces.selectExpr(key, "most", "sizes", "mask", "piece", f"explode(sequence(1, least(length(piece) + 1, {PIECE}))) as at")
    places = places.selectExpr(key, "sizes", "mask", "substring(piece, at, most) as rest")
    begun = []
    for n in range(BEGIN + 1):
        place = f"xxhash64(substring(rest, 1, {n}))"
        marked = f"(shiftright(mask[cast({place} & {WORDS - 1} as int)], cast(shiftright({place}, 32) & 63 as int)) & 1) = 1"
        begun.append(f"if((sizes & {1 << n}) != 0 and length(rest) >= {n} and {marked}, substring(rest, 1, {n}), null)")
    places = places.selectExpr(key, "rest", f"explode(array({', '.join(begun)})) as begin").where("begin is not null")
    met = places.join(named.withColumn("begin", F.expr(begin)), [key, "begin"]).where(F.startswith("rest", F.col("needle")))
    return met.select(*needles.columns).distinct()
