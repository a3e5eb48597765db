"""Scenes over anchor paths: registry, ownership, dormancy, objects, kinematics and searches.

A scene is a row (scene, name, tags bigint, root array<int>, state, centre array<double>,
radius), an object a row (object, path array<int>, point array<double>).  Registries
are dimension tables; objects may be many, and are joined by the prefixes of their
paths, one key a level, never by comparing all pairs.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import scalars

ACTIVE, DORMANT, UNLOADED = "Active", "Dormant", "Unloaded"


def nominal_radius(model: Column, size: Column) -> Column:
    """Bound on how far a scene's content reaches from its centre: by its model and that model's size."""
    return F.when(model == "euclid", size * (sqrt(3) / 2)).when(model.isin("sphere", "orbit"), size * 2.0).otherwise(size)


def text_of(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), "/")


def prefixes(path: Column) -> Column:
    """All prefixes of a path as text, the whole path last; the empty one is left out."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))), lambda n: text_of(F.slice(path, F.lit(1), n)))


def register(known: DataFrame, asked: DataFrame, nested: bool = False) -> DataFrame:
    """asked with `accepted`: a scene whose root another scene covers is refused, unless nesting is allowed.

    Scenes are asked for in the order of their numbers; one covers what comes
    after it.  Two scenes never share a root.
    """
    rows = known.select(F.lit(0).alias("turn"), "scene", "root").unionByName(asked.select(F.lit(1).alias("turn"), "scene", "root"))
    each = rows.select("turn", "scene", text_of(F.col("root")).alias("own"), F.explode(prefixes(F.col("root"))).alias("at"))
    holders = rows.select(text_of(F.col("root")).alias("at"), F.struct("turn", "scene").alias("by"))
    before = each.join(holders, "at").where(F.col("by") < F.struct("turn", "scene"))
    blocked = before if not nested else before.where("own = at")
    return asked.join(blocked.where("turn = 1").select("scene").distinct().withColumn("_no", F.lit(True)), "scene", "left").withColumn("accepted", F.col("_no").isNull()).drop("_no")


def owners(objects: DataFrame, scenes: DataFrame) -> DataFrame:
    """Adds the scene of each object: that of the longest root that its path begins with, or null."""
    roots = scenes.select(text_of(F.col("root")).alias("at"), F.col("scene").alias("_scene"), F.size("root").alias("_depth"))
    each = objects.select("object", F.explode(prefixes(F.col("path"))).alias("at"))
    own = each.join(roots, "at").groupBy("object").agg(F.max(F.struct("_depth", "_scene")).alias("_o")).select("object", F.col("_o._scene").alias("scene"))
    return objects.join(own, "object", "left")


def named(scenes: DataFrame, name: str) -> DataFrame:
    return scenes.where(F.col("name") == name)


def tagged(scenes: DataFrame, bit: int) -> DataFrame:
    """Scenes whose tag mask has a bit."""
    return scenes.where(F.expr(f"bit_get(tags, {int(bit)})") == 1)


def set_state(scenes: DataFrame, objects: DataFrame, scene: int, state: str) -> tuple[DataFrame, DataFrame]:
    """A scene's new state, and the objects that stay: sleeping drops those below its root, the scene itself is kept."""
    changed = scenes.withColumn("state", F.when(F.col("scene") == scene, state).otherwise(F.col("state")))
    if state == ACTIVE:
        return changed, objects
    root = scenes.where(F.col("scene") == scene).select(text_of(F.col("root")).alias("at"), F.size("root").alias("_depth"))
    below = objects.select("object", F.size("path").alias("_size"), F.explode(prefixes(F.col("path"))).alias("at")).join(root, "at").where("_size > _depth").select("object")
    return changed, objects.join(below, "object", "left_anti")


def save_object(objects: DataFrame, fresh: DataFrame) -> DataFrame:
    """Objects after saving others, which replace those of the same number."""
    return objects.join(fresh.select("object"), "object", "left_anti").unionByName(fresh)


def remove_objects(objects: DataFrame, gone: DataFrame) -> DataFrame:
    return objects.join(gone.select("object"), "object", "left_anti")


def transfer(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves objects to the roots they are sent to: moves (object, root, point); their old places are left."""
    sent = moves.select("object", F.col("root").alias("_root"), F.col("point").alias("_point"))
    return objects.join(sent, "object", "left").withColumn("path", F.coalesce("_root", "path")).withColumn("point", F.coalesce("_point", "point")).drop("_root", "_point")


def near_scenes(scenes: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, scene) whose bounding spheres meet: probes (probe, at array<double>, reach); the registry is the small side."""
    gap = F.aggregate(F.zip_with("at", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    return probes.join(scenes.select("scene", "centre", "radius"), gap <= (F.col("reach") + F.col("radius")) * (F.col("reach") + F.col("radius"))).select("probe", "scene")


def search(objects: DataFrame, scenes: DataFrame, at: list[float], radius: float, most: int = 0) -> DataFrame:
    """Objects of loaded scenes within a distance, nearest first (ties by number): object, scene, distance; `most` 0 is all.

    Sleeping scenes have no objects, so what comes back says for each scene that
    the sphere meets whether it was loaded at all: see `unloaded`.
    """
    place = F.array(*[F.lit(float(x)) for x in at])
    squared = F.aggregate(F.zip_with("point", place, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    loaded = scenes.where(F.col("state") == ACTIVE).select("scene")
    found = objects.where(squared <= radius * radius).join(loaded, "scene", "left_semi").select("object", "scene", F.sqrt(squared).alias("distance")).orderBy("distance", "object")
    return found.limit(most) if most else found


def unloaded(scenes: DataFrame, at: list[float], radius: float) -> DataFrame:
    """Scenes that a search would have to look at but that are not loaded: scene, state."""
    place = F.array(*[F.lit(float(x)) for x in at])
    gap = F.sqrt(F.aggregate(F.zip_with("centre", place, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    return scenes.where((F.col("state") != ACTIVE) & (gap <= F.col("radius") + radius)).select("scene", "state")


def motion(kind: Column, t: Column, radius: Column, period: Column, phase: Column, spin: Column) -> dict[str, Column]:
    """Origin, velocity, turn (quaternion w, x, y, z about z) and turning speed at a time; a frame that rests has zeros.

    kind is static or orbit; a spin period of 0 does not turn.
    """
    moving = (kind == "orbit") & (period > 0)
    angle = 2 * pi * F.pmod(phase + t / F.when(period > 0, period), F.lit(1.0))
    speed = 2 * pi / F.when(period > 0, period)
    still = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    turned = pi * F.pmod(t / F.when(spin > 0, spin), F.lit(1.0))
    rests = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return {
        "origin": F.when(moving, F.array(radius * F.cos(angle), radius * F.sin(angle), F.lit(0.0))).otherwise(still),
        "velocity": F.when(moving, F.array(-radius * speed * F.sin(angle), radius * speed * F.cos(angle), F.lit(0.0))).otherwise(still),
        "turn": F.when(spin > 0, F.array(F.cos(turned), F.lit(0.0), F.lit(0.0), F.sin(turned))).otherwise(rests),
        "turning": F.when(spin > 0, F.array(F.lit(0.0), F.lit(0.0), 2 * pi / F.when(spin > 0, spin))).otherwise(still),
    }


def along(path: list[list[float]], s: Column) -> Column:
    """The point after a way s along a broken line, held at its ends."""
    steps = [(a, b, sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))) for a, b in zip(path[:-1], path[1:], strict=True)]
    out, at = F.array(*[F.lit(float(x)) for x in path[-1]]), sum(n for *_, n in steps)
    for a, b, n in reversed(steps):
        at -= n
        share = F.greatest(F.lit(0.0), (s - at) / n) if n else F.lit(0.0)
        out = F.when(s < at + n, F.array(*[F.lit(float(x)) + share * float(y - x) for x, y in zip(a, b, strict=True)])).otherwise(out)
    return out


def path_key(path: Column) -> Column:
    """A path as one number in decimal text: short paths of small codes are packed, others hashed with the top bit set.

    Packed: the depth in the top byte and three bits a code, for at most 18 codes
    below 8.  Hashed: 64-bit FNV-1a over depth and codes as 8 little-endian bytes.
    """
    packable = (F.size(path) <= 18) & ~F.exists(path, lambda c: c >= 8)
    bits = F.aggregate(F.transform(path, lambda c, i: F.call_function("shiftleft", c.cast("bigint"), 3 * i)), F.lit(0).cast("bigint"), lambda t, x: t.bitwiseOR(x))
    packed = F.call_function("shiftleft", F.size(path).cast("bigint"), F.lit(56)).bitwiseOR(bits)
    numbers = F.concat(F.array(F.size(path).cast("bigint")), F.transform(path, lambda c: c.cast("bigint")))
    little = lambda n: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("shiftright", n, 8 * b).bitwiseAND(F.lit(255)))
    hashed = scalars.fnv1a64_of(F.flatten(F.transform(numbers, little)))
    # the top bit: the first hex digit is 8 or more
    first = F.hex(F.conv(F.substring(hashed, 1, 1), 16, 10).cast("bigint").bitwiseOR(F.lit(8)))
    return F.when(packable, packed.cast("string")).otherwise(F.conv(F.concat(first, F.substring(hashed, 2, 15)), 16, 10))


def ranked_paths(paths: DataFrame, node: str = "node", most: int = 3) -> DataFrame:
    """The strongest paths to each node: paths (node, path, energy); ties by the path."""
    rank = F.row_number().over(W.partitionBy(node).orderBy(F.desc("energy"), "path"))
    return paths.withColumn("rank", rank).where(F.col("rank") <= most)
