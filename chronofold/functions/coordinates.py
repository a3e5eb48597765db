"""Coordinate models as columns: Euclidean space, sphere surfaces, circular orbits and one-dimensional tracks.

Every model has a metric, a normal form, a chart into its parent's space and
the grid cells near a place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclid_distance(a: Column, b: Column) -> Column:
    """Distance of two arrays of coordinates."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def euclid_cells(x: Column, radius: Column, size: float) -> Column:
    """Cell numbers along one axis within a radius of a place."""
    return F.sequence(F.floor((x - radius) / size), F.floor((x + radius) / size))


def sphere_normal(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Latitude held to [-90, 90], longitude to [-180, 180)."""
    return F.least(F.lit(90.0), F.greatest(F.lit(-90.0), lat)), F.pmod(lng + 180, F.lit(360.0)) - 180


def sphere_chart(lat: Column, lng: Column, height: Column, radius: float) -> Column:
    """Place over a sphere in the parent's coordinates."""
    r = F.lit(radius) + height
    a, b = F.radians(lat), F.radians(lng)
    return F.array(r * F.cos(a) * F.cos(b), r * F.cos(a) * F.sin(b), r * F.sin(a))


def sphere_from_chart(point: Column, radius: float) -> Column:
    """The inverse: array(lat, lng, height)."""
    x, y, z = (F.get(point, F.lit(i)) for i in range(3))
    r = F.sqrt(x * x + y * y + z * z)
    return F.array(F.when(r > 0, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))))).otherwise(0.0), F.degrees(F.atan2(y, x)), r - radius)


def sphere_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float) -> Column:
    """Along the surface, by the angle between the two directions."""
    a, b = sphere_chart(lat1, lng1, F.lit(0.0), 1.0), sphere_chart(lat2, lng2, F.lit(0.0), 1.0)
    half = euclid_distance(a, b) / 2
    return 2 * radius * F.asin(F.least(F.lit(1.0), half))


def sphere_cells(lat: Column, lng: Column, distance: Column, radius: float, step: float) -> Column:
    """array<struct<i,j>> of cells of `step` degrees that a disc on the surface may meet.

    Near a pole the disc takes every longitude, so nothing is missed and no cap
    is needed.
    """
    reach = F.degrees(distance / radius)
    rows = F.sequence(F.floor(F.greatest(F.lit(-90.0), lat - reach) / step), F.floor(F.least(F.lit(90.0), lat + reach) / step))
    edge = F.least(F.lit(90.0), F.abs(lat) + reach)
    wide = F.when(edge >= 90, 180.0).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(reach, F.lit(90.0)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12)))))))
    count = int(360 / step)
    columns = F.array_distinct(F.transform(F.sequence(F.floor((lng - wide + 180) / step), F.floor((lng + wide + 180) / step)), lambda j: F.pmod(j, F.lit(count))))
    return F.flatten(F.transform(rows, lambda i: F.transform(columns, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def orbit_chart(phase: Column, radial: Column, height: Column, radius: float) -> Column:
    """Place beside a circular orbit (phase in turns) in the parent's coordinates."""
    turn = 2 * F.pi() * F.pmod(phase, F.lit(1.0))
    return F.array((radius + radial) * F.cos(turn), (radius + radial) * F.sin(turn), height)


def track_distance(a: Column, b: Column, length: float | None = None) -> Column:
    """Along a track; on a closed one of a length, the shorter way round."""
    d = F.abs(a - b)
    return d if length is None else F.least(F.pmod(d, F.lit(length)), length - F.pmod(d, F.lit(length)))


def track_cells(s: Column, radius: Column, size: float, length: float | None = None) -> Column:
    """Cells of a track within a radius; numbers wrap on a closed one."""
    cells = euclid_cells(s, radius, size)
    return cells if length is None else F.array_distinct(F.transform(cells, lambda c: F.pmod(c, F.lit(max(1, int(length / size))))))


def chart_velocity(chart, place: list[Column], velocity: list[Column], step: float = 1e-6) -> Column:
    """A velocity through a chart (columns -> array), by forward differences along the velocity."""
    here = chart(*place)
    there = chart(*[p + step * v for p, v in zip(place, velocity, strict=True)])
    return F.zip_with(there, here, lambda a, b: (a - b) / step)
