"""Matches of a pattern with their places, in DataFrame expressions only.

The stretches between matches and the matches themselves are cut by the same
pattern; a match's place is the length of everything before it.  Lengths are
summed in two levels, so a text with many matches costs little more than one
with few.  Places count code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, x: total + x)


def let(value: Column, body) -> Column:
    """body(value), value being evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _most(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0).cast("bigint"))


def in_chunks(values: Column, size: int = CHUNK) -> Column:
    """A non-empty array cut into arrays of `size` elements."""
    count = F.floor((F.size(values) + (size - 1)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.slice(values, j * size + 1, size))


def _before(values: Column, fold, both) -> Column:
    """fold() of the elements before each element of a non-empty array, in two levels."""

    def chunked(chunks: Column) -> Column:
        def based(totals: Column) -> Column:
            return F.flatten(F.transform(chunks, lambda c, j: let(fold(F.slice(totals, F.lit(1), j)), lambda base: F.transform(c, lambda _, i: both(base, fold(F.slice(c, F.lit(1), i)))))))

        return let(F.transform(chunks, fold), based)

    return let(in_chunks(values), chunked)


def prefix_sums(values: Column) -> Column:
    """Sums of the elements before each element of an array of bigint."""
    return _before(values, _sum, lambda a, b: a + b)


def prefix_most(values: Column) -> Column:
    """Greatest of the elements before each element of an array of bigint; 0 before the first."""
    return _before(values, _most, lambda a, b: F.greatest(a, b))


#: Code points of the parts that a text is cut into, so that a place in it is reached without going over all before.
PART = 1024


def parts_of(text: Column) -> Column:
    """The text in parts of PART code points, for `cut`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))


def cut(parts: Column, start: Column, count: Column) -> Column:
    """`count` code points from place `start` (0 is the first) of a text given as `parts_of` it."""
    first = F.floor(start / PART).cast("int")
    last = F.floor((start + count - 1) / PART).cast("int")
    return F.substring(F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), (start - first * PART + 1).cast("int"), count.cast("int"))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the non-overlapping matches of `pattern` (null text: null)."""
    kind = "array<struct<start:bigint,end:bigint,value:string>>"

    def placed(values: Column, gaps: Column) -> Column:
        lengths = F.transform(values, lambda v, i: (F.length(F.get(gaps, i)) + F.length(v)).cast("bigint"))
        return let(
            prefix_sums(lengths),
            lambda before: F.transform(values, lambda v, i: F.struct((F.get(before, i) + F.length(F.get(gaps, i))).alias("start"), (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(v)).alias("end"), v.alias("value"))),
        )

    def whole(values: Column) -> Column:
        return F.when(F.size(values) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(values, gaps)).cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), whole)
