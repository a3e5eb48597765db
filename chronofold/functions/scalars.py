"""Scalar functions as columns: time, geometry, text, hashes and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
#: The geohash alphabet.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def decayed(base: Column, elapsed: Column, half_life: float) -> Column:
    """Half-life decay; none without elapsed time or half-life."""
    return base if half_life <= 0 else F.when(elapsed > 0, base * F.pow(F.lit(0.5), elapsed / half_life)).otherwise(base)


def slot(t: Column, size: int) -> Column:
    """Time slot, rounded toward minus infinity."""
    return F.floor(t / size)


def bucket(t: Column, span: int) -> Column:
    """Entity time bucket, rounded toward zero."""
    return F.floor(F.abs(t) / span) * F.when(t < 0, -1).otherwise(1)


def local_hour(epoch: Column, offset_hours: int = 8) -> Column:
    return F.pmod(F.floor((epoch + offset_hours * 3600) / 3600), F.lit(24)).cast("int")


def day_period(hour: Column) -> Column:
    """dawn 5-9, morning 9-11, noon 11-14 (and 17-20 as evening), afternoon 14-17, night 20-23, late else."""
    return F.when(hour.between(5, 8), "dawn").when(hour.between(9, 10), "morning").when(hour.between(11, 13), "noon").when(hour.between(14, 16), "afternoon").when(hour.between(17, 19), "evening").when(hour.between(20, 22), "night").otherwise("late")


def outside_hours(minute: Column, begin: int, end: int) -> Column:
    """Whether a minute of the day is outside working hours, which may pass midnight."""
    inside = (minute >= begin) & (minute < end) if begin <= end else (minute >= begin) | (minute < end)
    return ~inside


def valid_utc(t: Column, now: int) -> Column:
    """After the epoch and less than ten years ahead."""
    return (t > 0) & (t < now + 10 * 365 * 86400)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def geohash(lat: Column, lng: Column, precision: int = 6) -> Column:
    """Geohash by integers: each coordinate becomes a binary fraction, and their bits alternate, longitude first."""
    bits = 5 * precision
    n_lng, n_lat = (bits + 1) // 2, bits // 2
    code_lng = F.least(F.floor((lng + 180) / 360 * 2**n_lng), F.lit(2**n_lng - 1))
    code_lat = F.least(F.floor((lat + 90) / 180 * 2**n_lat), F.lit(2**n_lat - 1))
    out = []
    for c in range(precision):
        value = F.lit(0)
        for b in range(5):
            at = 5 * c + b
            code, place = (code_lng, n_lng - 1 - at // 2) if at % 2 == 0 else (code_lat, n_lat - 1 - at // 2)
            value = value + F.shiftright(code, place).bitwiseAND(F.lit(1)) * (1 << (4 - b))
        out.append(F.substring(F.lit(GEOHASH), value.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cross(a: Column, b: Column) -> Column:
    at = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[at(a, (i + 1) % 3) * at(b, (i + 2) % 3) - at(a, (i + 2) % 3) * at(b, (i + 1) % 3) for i in range(3)])


def rotate(q: Column, v: Column) -> Column:
    """A vector turned by a unit quaternion (w, x, y, z)."""
    axis = F.slice(q, 2, 3)
    t = F.transform(cross(axis, v), lambda x: 2 * x)
    w = F.get(q, F.lit(0))
    return plus(plus(v, F.transform(t, lambda x: w * x)), cross(axis, t))


def conjugate(q: Column) -> Column:
    return F.transform(q, lambda x, i: F.when(i == 0, x).otherwise(-x))


def orbit(t: Column, radius: float, period: float, phase: float) -> Column:
    """Place on a circular orbit."""
    turn = 2 * F.pi() * F.pmod(phase + t / period, F.lit(1.0))
    return F.array(radius * F.cos(turn), radius * F.sin(turn), F.lit(0.0))


def path_parent(path: Column) -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def is_prefix(prefix: Column, path: Column) -> Column:
    return (F.size(prefix) <= F.size(path)) & (F.slice(path, F.lit(1), F.size(prefix)) == prefix)


def parse_path(text: Column) -> Column:
    """"1/2/3" as codes; null if it is malformed, deeper than 32 or a code passes 2^32 - 1."""
    codes = F.transform(F.split(text, "/"), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("bigint"))
    fine = text.rlike("^[0-9]+(/[0-9]+)*$") & (F.size(F.split(text, "/")) <= 32) & ~F.exists(F.split(text, "/"), lambda x: (F.length(x) > 10) | (x.cast("bigint") > 4294967295))
    return F.when(fine, codes)


def space_kind(text: Column) -> Column:
    """A reference with a space or of more than 32 bytes is raw text, any other an anchor."""
    return F.when(text.contains(" ") | (F.octet_length(text) > 32), "raw_text").otherwise("anchor")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fnv1a64_hex(data: Column, offset: str = "14695981039346656037") -> Column:
    """64-bit FNV-1a of a text's bytes, as 16 hex digits."""
    return fnv1a64_of(F.transform(F.filter(F.split(F.hex(F.encode(data, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint")), offset)


def fnv1a64_of(codes: Column, offset: str = "14695981039346656037") -> Column:
    """64-bit FNV-1a of an array of bytes given as numbers, by decimal arithmetic on the two halves."""
    high, low = int(offset) >> 32, int(offset) & 0xFFFFFFFF
    start = F.struct(F.lit(high).cast("bigint").alias("h"), F.lit(low).cast("bigint").alias("l"))
    # prime = 2^40 + 0x1b3: low * 0x1b3 stays below 2^42, and low << 8 goes to the high half
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def step(s: Column, b: Column) -> Column:
        low_ = s["l"].bitwiseXOR(b)
        product = low_ * 0x1B3
        return F.struct((s["h"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low_, 8)).bitwiseAND(mask).alias("h"), product.bitwiseAND(mask).alias("l"))

    return F.aggregate(codes, start, step, lambda s: F.concat(F.lpad(F.lower(F.hex(s["h"])), 8, "0"), F.lpad(F.lower(F.hex(s["l"])), 8, "0")))


# Phrases of relative time in the order they are looked for, and days from the anchor.
PHRASES = [
    ("前天", -2), ("昨天", -1), ("yesterday", -1), ("今天", 0), ("today", 0), ("上周", -7), ("上星期", -7), ("last week", -7),
    ("上个月", -30), ("last month", -30), ("几个月前", -90), ("a few months ago", -90), ("去年", -365), ("last year", -365),
]


def relative_time(text: Column, anchor: Column) -> Column:
    """The time that a phrase names, in seconds, relative to an anchor; 0 where a text has none.  ASCII case does not count."""
    return first_phrase(ascii_lower(text), [(phrase, days * 86400) for phrase, days in PHRASES], anchor)


def url_parameters(query: Column) -> Column:
    """The parameters of a URL query as a map of decoded text; plus signs are blanks, and the last of a name holds."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    part = lambda p, i: F.try_url_decode(F.get(F.split(p, "=", 2), F.lit(i)))
    named = F.transform(pairs, lambda p: F.struct(part(p, 0).alias("key"), F.coalesce(part(p, 1), F.lit("")).alias("value")))
    kept = F.filter(named, lambda p: p["key"].isNotNull())
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def first_phrase(text: Column, phrases: list[tuple[str, int]], anchor: Column) -> Column:
    """The time of the first listed phrase that a text contains, relative to an anchor; 0 without one."""
    out = reduce(lambda c, p: (c.when if c is not None else F.when)(text.contains(p[0]), anchor + p[1]), phrases, None)
    return F.lit(0) if out is None else out.otherwise(0)


def surface_forms(*names: Column) -> Column:
    """The distinct non-empty names, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull() & (x != ""))))


def substrings(text: Column, least: int = 2, most: int = 8) -> Column:
    """All substrings of `least` to `most` characters."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.filter(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(i + n - 1 <= F.length(text), F.substring(text, i, n))), lambda x: x.isNotNull())))
