"""Regular-expression matches with their positions, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,stop:int,text:string>"


#: Elements that a running sum takes one after another.
STEP = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once: nothing shares what stands inside functions of arrays."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, in two levels, so that no growing array is copied for each number."""

    def sums(part: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def cut(all_: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_) - 1) / STEP), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * STEP + 1, STEP))

    total = lambda part: F.aggregate(part, F.lit(0), lambda t, x: t + x)
    return let(let(numbers, cut), lambda parts: F.flatten(F.zip_with(parts, sums(F.transform(parts, total), F.lit(0)), sums)))


def pairs(text: Column, pattern: str) -> Column:
    """Matches m, in order, each with the length of the piece of text before it (gap) and its own (n); null where none is.

    There is one more piece than matches: the last pair has no match. The pattern is literal, so it is compiled once a
    task; it must not match the empty string.
    """
    p = F.lit(pattern)
    both = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1), lambda m, x: F.struct(m.alias("m"), F.length(x).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n")))
    return F.when(F.rlike(text, p), both)


def placed(found: Column) -> Column:
    """pairs as spans (start, stop, text): a match begins where the pieces, and the matches, before it end."""
    one = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("stop"), x["m"].alias("text"))
    return let(found, lambda all_: F.slice(F.zip_with(all_, running(F.transform(all_, lambda x: x["gap"] + x["n"])), one), 1, F.size(all_) - 1))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of (start, stop, text), in code points; null for a null text."""
    found = placed(F.coalesce(pairs(text, pattern), F.array(F.struct(F.lit(None).cast("string").alias("m"), F.lit(0).alias("gap"), F.lit(0).alias("n")))))
    return F.when(text.isNotNull(), found)


def window(text: Column, start: Column, stop: Column, before: int, after: int) -> Column:
    """Characters of text around a span, clamped to the text."""
    first = F.greatest(start - before, F.lit(0))
    return F.substring(text, first + 1, stop + after - first)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))
