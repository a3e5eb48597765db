"""A small query language over memory blocks, planned as DataFrames.

    FIND BLOCKS IN REGION(x0,y0,z0,x1,y1,z1) DURING(t0,t1) [LEVEL n] [STATE s] [PAYLOAD ~ 'text'] [AT t] [SUMMARY] [LIMIT n]
    FIND HISTORY OF id
    FIND DYNAMIC IN REGION(...) DURING(...)
    FIND TRAJECTORY OF id
    STATS
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators import spatial

STATES = ("Pending", "Stable", "Changing")
_TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|'(?P<text>[^']*)'|(?P<word>[A-Za-z_]\w*)|(?P<mark>[(),~]))")


class VqlError(ValueError):
    """A statement that cannot be parsed, with the place of the fault."""


@dataclass
class Statement:
    kind: str
    region: tuple = ()
    during: tuple = ()
    level: int | None = None
    state: str | None = None
    payload: str | None = None
    at: int | None = None
    summary: bool = False
    limit: int = 0
    id: int | None = None
    clauses: list = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m and m.lastgroup:
                self.tokens.append((m.lastgroup, m.group(m.lastgroup), m.start(m.lastgroup)))
                at = m.end()
            else:
                at += 1  # unknown characters are passed over
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.tokens[self.at][0] == "word" else self.tokens[self.at][1]

    def take(self, kind: str, *expected: str) -> str:
        found, value, place = self.tokens[self.at]
        if found != kind or expected and value.upper() not in expected:
            raise VqlError(f"at {place}: expected {' or '.join(expected) or kind}, found {value or 'the end'!r}")
        self.at += 1
        return value

    def numbers(self, count: int) -> tuple:
        self.take("mark", "(")
        out = [float(self.take("number"))]
        while self.peek() == ",":
            self.take("mark", ",")
            out.append(float(self.take("number")))
        self.take("mark", ")")
        if len(out) != count:
            raise VqlError(f"expected {count} numbers, found {len(out)}")
        return tuple(out)

    def statement(self) -> Statement:
        if self.peek() == "STATS":
            self.take("word")
            out = Statement("stats")
        else:
            self.take("word", "FIND")
            what = self.take("word", "BLOCKS", "HISTORY", "DYNAMIC", "TRAJECTORY").upper()
            if what in ("HISTORY", "TRAJECTORY"):
                self.take("word", "OF")
                out = Statement(what.lower(), id=int(float(self.take("number"))))
            else:
                self.take("word", "IN")
                self.take("word", "REGION")
                out = Statement(what.lower(), region=self.numbers(6))
                self.take("word", "DURING")
                out.during = self.numbers(2)
                while what == "BLOCKS" and self.tokens[self.at][0] != "end":
                    self.clause(out)
        self.take("end")
        return out

    def clause(self, out: Statement) -> None:
        word = self.take("word", "LEVEL", "STATE", "PAYLOAD", "AT", "SUMMARY", "LIMIT").upper()
        if word == "LEVEL":
            out.level = int(float(self.take("number")))
        elif word == "STATE":
            out.state = self.take("word", *(s.upper() for s in STATES)).capitalize()
        elif word == "PAYLOAD":
            self.take("mark", "~")
            out.payload = self.take("text")
        elif word == "AT":
            out.at = int(float(self.take("number")))
        elif word == "SUMMARY":
            out.summary = True
        else:
            out.limit = int(float(self.take("number")))


def parse(text: str) -> Statement:
    return _Parser(text).statement()


def execute(text: str, blocks: DataFrame, versions: DataFrame | None = None, tracks: DataFrame | None = None, levels: int = 1) -> DataFrame:
    """Plans a statement.

    blocks has id, the box, t, payload, state, level and confidence; versions
    block_id, version, payload, valid_from, valid_to; tracks id, t and the box.
    STATE and PAYLOAD look at current blocks before AT puts in the version of
    that time (blocks without one go).  SUMMARY returns all levels.  A negative
    LEVEL, or none, is the finest and one too large the finest too.  LIMIT 0 is
    no limit; results are ordered by id.
    """
    s = parse(text)
    if s.kind == "stats":
        return blocks.agg(F.count(F.lit(1)).alias("blocks"), *[F.count_if(F.col("state") == x).alias(x.lower()) for x in STATES])
    if s.kind == "history":
        return versions.where(F.col("block_id") == s.id).orderBy("version")
    if s.kind == "trajectory":
        return tracks.where(F.col("id") == s.id).orderBy(F.desc("t")).limit(64).orderBy("t")
    first, last = (int(x) for x in s.during)
    if s.kind == "dynamic":
        latest = tracks.groupBy("id").agg(F.max_by(F.struct(*[c for c in tracks.columns if c != "id"]), "t").alias("p")).select("id", "p.*")
        return spatial.query(latest, s.region, first, last).orderBy("id")
    level = None if s.summary else levels - 1 if s.level is None or not 0 <= s.level < levels else s.level
    out = spatial.query(blocks, s.region, first, last, level)
    if s.state:
        out = out.where(F.col("state") == s.state)
    if s.payload is not None:
        out = out.where(F.col("payload").contains(F.lit(s.payload)))
    if s.at is not None:
        then = spatial.version_at(versions, s.at).select(F.col("block_id").alias("id"), F.col("payload").alias("_then"), F.col("version"))
        out = out.drop("version").join(then, "id").withColumn("payload", F.col("_then")).drop("_then")
    out = out.orderBy("id")
    return out.limit(s.limit) if s.limit > 0 else out
