"""Memory blocks: region and time queries, grid joins, levels of detail, summaries and version chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.sources.scratch import written

AXES = "xyz"
BOX = [f"{side}_{axis}" for side in ("min", "max") for axis in AXES]
#: Rows of a table that are broadcast at most; beyond, it is joined by a shuffle.
BROADCAST = 100_000


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Boxes (min_x..max_z) that share a point, borders included."""
    out = F.lit(True)
    for axis in AXES:
        out = out & (a[f"min_{axis}"] <= b[f"max_{axis}"]) & (b[f"min_{axis}"] <= a[f"max_{axis}"])
    return out


def box_of(df: DataFrame, prefix: str = "") -> dict[str, Column]:
    return {f"{side}_{axis}": F.col(f"{prefix}{side}_{axis}") for side in ("min", "max") for axis in AXES}


def region_box(region) -> dict[str, Column]:
    """Six numbers: min x, y, z, max x, y, z."""
    low, high = region[:3], region[3:]
    return {f"min_{a}": F.lit(float(v)) for a, v in zip(AXES, low, strict=True)} | {f"max_{a}": F.lit(float(v)) for a, v in zip(AXES, high, strict=True)}


def contains_point(box: dict[str, Column], x: Column, y: Column, z: Column) -> Column:
    return (x.between(box["min_x"], box["max_x"])) & (y.between(box["min_y"], box["max_y"])) & (z.between(box["min_z"], box["max_z"]))


def query(blocks: DataFrame, region=None, first: int | None = None, last: int | None = None, level: int | None = None) -> DataFrame:
    """Blocks whose box meets a region and whose time lies in a closed range; all plain comparisons, so Parquet prunes."""
    out = blocks
    if region is not None:
        out = out.where(intersects(box_of(out), region_box(region)))
    if first is not None:
        out = out.where(F.col("t") >= first)
    if last is not None:
        out = out.where(F.col("t") <= last)
    return out.where(F.col("level") == level) if level is not None else out


def covered(box: dict[str, Column], size: float) -> Column:
    """array<struct<cx,cy,cz>> of the grid cells that a box covers."""
    span = lambda axis: F.sequence(F.floor(box[f"min_{axis}"] / size), F.floor(box[f"max_{axis}"] / size))
    return F.flatten(F.transform(span("x"), lambda x: F.flatten(F.transform(span("y"), lambda y: F.transform(span("z"), lambda z: F.struct(x.alias("cx"), y.alias("cy"), z.alias("cz")))))))


def grid_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float) -> DataFrame:
    """Pairs of ids whose boxes intersect.

    Both sides are spread over the grid cells they cover and joined on the cell;
    a pair is reported only by the cell that holds the least corner of its
    intersection, so no duplicates arise and nothing has to be made distinct.
    """
    a = left.select(F.col(left_id).alias("left_id"), *[F.col(f"{s}_{x}").alias(f"a_{s}_{x}") for s in ("min", "max") for x in AXES])
    b = right.select(F.col(right_id).alias("right_id"), *[F.col(f"{s}_{x}").alias(f"b_{s}_{x}") for s in ("min", "max") for x in AXES])
    a = a.withColumn("cell", F.explode(covered(box_of(a, "a_"), size)))
    b = b.withColumn("cell", F.explode(covered(box_of(b, "b_"), size)))
    own = F.lit(True)
    for axis in AXES:
        own = own & (F.floor(F.greatest(f"a_min_{axis}", f"b_min_{axis}") / size) == F.col(f"cell.c{axis}"))
    return a.join(b, "cell").where(intersects(box_of(a, "a_"), box_of(b, "b_")) & own).select("left_id", "right_id")


def spread(df: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """A row for each grid cell that a box covers: adds cx, cy, cz; null boxes cover none."""
    for axis in AXES:
        df = df.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(F.col(f"{prefix}min_{axis}") / size), F.floor(F.col(f"{prefix}max_{axis}") / size))))
    return df


def counted(df: DataFrame, most: int | None = None) -> DataFrame:
    """A table that is cheap to count, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= (BROADCAST if most is None else most) else df


def shapes(blocks: DataFrame, *flags: str) -> DataFrame:
    """The distinct boxes (and flags) of blocks, written: shape, box, flags, least and greatest id (lo, hi).

    Blocks of one box meet the same boxes, so what is asked of boxes is asked once
    for all their copies and joined back by the box.
    """
    groups = blocks.groupBy(*BOX, *flags).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return written(groups.withColumn("shape", F.monotonically_increasing_id()), "shapes")


def meeting(left: DataFrame, right: DataFrame, size: float, other: bool = False) -> DataFrame:
    """The shapes of the left side whose box meets any box of the right, each once; other: by a block of another id.

    A semi join in each cell, which stops at the first box that meets.  The members
    of a shape are either all on the right side or none, so only a shape of a single
    block can be left with nothing but itself.
    """
    a = left.select("shape", "lo", "hi", *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = right.select(F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    near = spread(b, size, "b_").withColumnsRenamed({f"c{x}": f"b_c{x}" for x in AXES})
    found = intersects(box_of(a, "a_"), box_of(b, "b_"))
    for axis in AXES:
        found = found & (F.col(f"c{axis}") == F.col(f"b_c{axis}"))
    if other:
        found = found & ((F.col("lo") != F.col("hi")) | (F.col("b_lo") != F.col("lo")) | (F.col("b_hi") != F.col("lo")))
    return spread(a, size, "a_").join(near, found, "left_semi").select("shape").distinct()


def occupants(blocks: DataFrame, instances: DataFrame, size: float) -> DataFrame:
    """Instances whose boxes meet each block: id, instances (sorted).

    The instances are gathered once for each distinct box and joined to its blocks,
    so no pairs of blocks and instances are moved.  An id that has several boxes
    gets the instances of all of them.
    """
    boxes = shapes(blocks)
    met = grid_join(boxes, instances, "shape", "id", size).groupBy(F.col("left_id").alias("shape")).agg(F.sort_array(F.collect_set("right_id")).alias("instances"))
    each = blocks.select("id", *BOX).join(counted(boxes.select("shape", *BOX)), BOX).select("id", "shape")
    owners = written(each.groupBy("id").agg(F.min("shape").alias("shape"), F.max("shape").alias("last")), "owners")
    out = owners.where("shape = last").join(met, "shape").select("id", "instances")
    several = owners.where("shape <> last").select(F.col("id").alias("of"))
    if several.isEmpty():
        return out
    parts = each.join(several, F.col("id").eqNullSafe(F.col("of")), "left_semi").distinct().join(met, "shape").select("id", F.explode("instances").alias("instance"))
    return out.unionByName(parts.groupBy("id").agg(F.sort_array(F.collect_set("instance")).alias("instances")))


def centre(box: dict[str, Column]) -> dict[str, Column]:
    return {axis: (box[f"min_{axis}"] + box[f"max_{axis}"]) / 2 for axis in AXES}


def block_key(blocks: DataFrame, size: float, slot: int) -> DataFrame:
    """Adds the cell and time slot of a block: cell_x, cell_y, cell_z, time_slot (floors toward minus infinity)."""
    mid = centre(box_of(blocks))
    return blocks.withColumns({f"cell_{axis}": F.floor(mid[axis] / size) for axis in AXES} | {"time_slot": F.floor(F.col("t") / slot)})


def detect_level(box: dict[str, Column], sizes: list[float]) -> Column:
    """The level whose cell size is nearest to the largest extent; ties go to the finer (higher) level."""
    extent = F.greatest(*[box[f"max_{a}"] - box[f"min_{a}"] for a in AXES])
    best = F.array_min(F.array(*[F.struct(F.abs(extent - F.lit(float(s))).alias("d"), F.lit(-i).alias("n")) for i, s in enumerate(sizes)]))
    return -best["n"]


def summaries(blocks: DataFrame, size: float) -> DataFrame:
    """Per coarse cell: count, majority payload (ties: the least), mean confidence, majority state (ties: Pending, Stable, Changing) and last time."""
    cell = [f"cell_{a}" for a in AXES]
    rows = block_key(blocks, size, 1)
    order = F.when(F.col("state") == "Pending", 0).when(F.col("state") == "Stable", 1).otherwise(2)
    rows = rows.withColumn("_state", order)

    def majority(column: str) -> DataFrame:
        counted = rows.groupBy(*cell, column).agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(*cell).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(f"major{column if column[0] == '_' else '_' + column}"))

    base = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.max("t").alias("t"))
    out = base.join(majority("payload"), cell).join(majority("_state"), cell)
    names = F.when(F.col("major_state") == 0, "Pending").when(F.col("major_state") == 1, "Stable").otherwise("Changing")
    return out.select(*cell, "n", "confidence", "t", F.col("major_payload").alias("payload"), names.alias("state"))


def versions(changes: DataFrame) -> DataFrame:
    """A version chain per block from changes (block_id, t, payload, ord): version, valid_from, valid_to (null: open)."""
    order = W.partitionBy("block_id").orderBy("t", "ord")
    return changes.select("block_id", F.row_number().over(order).alias("version"), "payload", F.col("t").alias("valid_from"), F.lead("t").over(order).alias("valid_to"))


def version_at(chain: DataFrame, t) -> DataFrame:
    """The version in force at t (half open; of versions of one moment none but the last is ever in force)."""
    return chain.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def versions_at(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of join: for each probe (block_id, probe_id, t) the payload of the last change not after t.

    Union and one window per block instead of a range join.
    """
    both = changes.select("block_id", "t", F.lit(0).alias("side"), "ord", F.struct("payload").alias("p"), F.lit(None).cast("bigint").alias("probe_id")).unionByName(
        probes.select("block_id", "t", F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("ord"), F.lit(None).cast("struct<payload:string>").alias("p"), "probe_id")
    )
    upto = W.partitionBy("block_id").orderBy("t", "side", "ord").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("p", F.last("p", ignorenulls=True).over(upto)).where("side = 1").select("block_id", "probe_id", "t", F.col("p.payload").alias("payload"))


def expired(blocks: DataFrame, before: int) -> DataFrame:
    """What stays after blocks strictly older than a time are dropped."""
    return blocks.where(F.col("t") >= before)


def coarse_to_fine(blocks: DataFrame, region, size: float) -> DataFrame:
    """Finer blocks (level >= 1) that meet the part of the region covered by coarse hits (level 0), each once."""
    coarse = query(blocks, region, level=0)
    cut = region_box(region)
    cut_boxes = coarse.select(F.col("id"), *[F.greatest(F.col(f"min_{a}"), cut[f"min_{a}"]).alias(f"min_{a}") for a in AXES], *[F.least(F.col(f"max_{a}"), cut[f"max_{a}"]).alias(f"max_{a}") for a in AXES])
    fine = query(blocks.where("level >= 1"), region)
    hit = grid_join(fine, cut_boxes, "id", "id", size).select(F.col("left_id").alias("id")).distinct()
    return coarse.unionByName(fine.join(hit, "id", "left_semi"))


def refined(blocks: DataFrame, size: float) -> DataFrame:
    """Coarse blocks (level 0) with whether any finer block meets them."""
    coarse = blocks.where("level = 0")
    boxes = shapes(coarse)
    hit = boxes.join(meeting(boxes, shapes(blocks.where("level >= 1")), size), "shape", "left_semi")
    hit = counted(written(hit.select(*BOX, F.lit(True).alias("hit")), "refined"))
    return coarse.select("id", *BOX).join(hit, BOX, "left").select("id", F.coalesce("hit", F.lit(False)).alias("refined"))


def suspects(blocks: DataFrame, ground: list[str], empty: list[str], size: float) -> DataFrame:
    """Marks blocks that cannot be: ground with emptiness right above, or a non-ground block with nothing right below.

    A null payload is neither ground nor empty; a block without an id meets no other.
    """
    kind = lambda payloads: F.coalesce(F.col("payload").isin(payloads), F.lit(False))
    rows = blocks.select("id", *BOX, kind(ground).alias("ground"), kind(empty).alias("empty"))
    boxes = shapes(rows.where("id is not null"), "ground", "empty")
    high = F.col("max_z") - F.col("min_z")
    up = boxes.where("ground").withColumns({"min_z": F.col("max_z"), "max_z": F.col("max_z") + high})
    down = boxes.where("not ground").withColumns({"min_z": F.col("min_z") - high, "max_z": F.col("min_z")})
    found = meeting(up, boxes.where("empty"), size, True).union(meeting(down, boxes, size, True))
    keys = [*BOX, "ground", "empty"]
    hit = counted(written(boxes.join(found, "shape", "left_semi").select(*keys, F.lit(True).alias("hit")), "suspects"))
    met = F.coalesce("hit", F.lit(False)) & F.col("id").isNotNull()
    return rows.join(hit, keys, "left").select("id", (F.col("ground") == met).alias("suspect"))


#: Ranges that a cut is looked for in at once, and rows that the last range may hold.
RANGES, LAST_RANGE = 1_000, 100_000


def evict(blocks: DataFrame, accesses: DataFrame, capacity: int) -> DataFrame:
    """The `capacity` blocks of latest access (ties: greater id), by accesses (id, at).

    Counts per range of access times say which range the cut lies in; the range is
    narrowed until few rows, or one time, are left, and only those are sorted.
    """
    last = blocks.select("id").join(accesses.groupBy("id").agg(F.max("at").alias("at")), "id")
    low, high = last.agg(F.min("at"), F.max("at")).first()
    rest = capacity
    while low is not None and low < high:
        width = max(1, -(-(high - low + 1) // RANGES))
        counts = {r[0]: r[1] for r in last.where(F.col("at").between(low, high)).groupBy(F.floor((F.col("at") - low) / width)).count().collect()}
        place = max(counts)
        for place in sorted(counts, reverse=True):
            if rest <= counts[place]:
                break
            rest -= counts[place]
        low, high = low + place * width, min(high, low + (place + 1) * width - 1)
        if counts[place] <= LAST_RANGE:
            break
    if low is None:
        return blocks.limit(0)
    edge = last.where(F.col("at").between(low, high)).orderBy(F.desc("at"), F.desc("id")).limit(max(rest, 0))
    return blocks.join(last.where(F.col("at") > high).unionByName(edge).select("id"), "id", "left_semi")
