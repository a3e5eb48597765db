"""Nested frames: rigid transforms as structs, conversion along the walk to the common ancestor, grid codes of places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.scalars import conjugate, minus, plus, rotate


def apply(origin: Column, turn: Column, point: Column) -> Column:
    """A point of a child frame in its parent: turn * point + origin."""
    return plus(rotate(turn, point), origin)


def inverse(origin: Column, turn: Column, point: Column) -> Column:
    """A point of the parent in a child frame."""
    return rotate(conjugate(turn), minus(point, origin))


def to_root(points: DataFrame, frames: DataFrame, depth: int) -> DataFrame:
    """Points (frame, point) in the root frame: one join with frames (frame, parent, origin, turn) per level.

    frames is the small table of named frames; deeper points take more rounds,
    root points none.
    """
    known = frames.select(F.col("frame").alias("_f"), F.col("parent").alias("_p"), "origin", "turn")
    out = points
    for _ in range(depth):
        joined = out.join(known, F.col("frame") == F.col("_f"), "left")
        moved = F.when(F.col("_f").isNotNull(), apply(F.col("origin"), F.col("turn"), F.col("point"))).otherwise(F.col("point"))
        out = joined.withColumn("point", moved).withColumn("frame", F.when(F.col("_f").isNotNull(), F.col("_p")).otherwise(F.col("frame"))).select(points.columns)
    return out


def cell_code(point: Column, half: Column, axes: int = 3) -> Column:
    """Which of 2^axes halves of a cube around 0 a point lies in: one bit an axis."""
    assert half is not None
    return reduce(lambda a, b: a + b, [F.when(F.get(point, F.lit(i)) >= 0, 1 << i).otherwise(0) for i in range(axes)])


def anchor_path(point: Column, size: float, epsilon: float, axes: int = 3) -> Column:
    """Codes of the cells that hold a point, from a cube of half `size` down to halves of at most epsilon.

    Each axis is a binary fraction, so the codes are its bits in turn; no loop
    carries the remainder.
    """
    levels = 0
    while size / 2**levels > epsilon and levels < 32:
        levels += 1
    grid = [F.least(F.greatest(F.floor((F.get(point, F.lit(i)) + size) / (2 * size) * 2**levels), F.lit(0)), F.lit(2**levels - 1)) for i in range(axes)]
    return F.array(*[reduce(lambda a, b: a + b, [F.shiftright(grid[i], levels - 1 - level).bitwiseAND(F.lit(1)) * (1 << i) for i in range(axes)]) for level in range(levels)]).cast("array<int>")


def longitude(x: Column) -> Column:
    """Normalised to [-180, 180): 181 becomes -179."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def within(points: DataFrame, centres: DataFrame, radius: str, size: float) -> DataFrame:
    """(centre, id, distance) of points within each centre's radius, by a grid of cells of a size and an exact test."""
    cell = lambda c: F.struct(*[F.floor(F.col(f"{c}{a}") / size).alias(a) for a in "xyz"])
    p = points.select("id", "x", "y", "z").withColumn("cell", cell(""))
    span = lambda a: F.sequence(F.floor((F.col(f"c{a}") - F.col(radius)) / size), F.floor((F.col(f"c{a}") + F.col(radius)) / size))
    c = centres.select(F.col("id").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), radius)
    c = c.withColumn("_x", F.explode(span("x"))).withColumn("_y", F.explode(span("y"))).withColumn("cell", F.explode(F.transform(span("z"), lambda z: F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), z.alias("z")))))
    squared = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2
    return c.join(p, "cell").where(squared <= F.col(radius) ** 2).select("centre", "id", F.sqrt(squared).alias("distance"))
