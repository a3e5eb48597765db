"""Personal data by weak supervision, in DataFrame expressions only.

Base spans are the matches of four fixed patterns that pass their checks; they
always stay.  Looser patterns propose further spans.  Three labelers vote on every
span, base or proposed: a strict pattern, a gazetteer (a table of words that
stand near a kind and of beginnings and ends of its values), and the context
that touches it.  Each span also has features of its own: its length, its groups,
the classes of its neighbours, digits before it, and its place in the text.

Spans are counted by kind, votes and features, all of few values, so however
large the corpus a bounded table reaches the driver.  There expectation
maximisation estimates for each kind how far each labeler can be trusted and
how likely each vote pattern is personal data, and a logistic span classifier
over votes and features is fitted on these soft labels.  It is one sum of
weights, so it goes back into the plan as a column expression and decides on the
proposed spans.

Places count code points, the end exclusive.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import numbered, save
from chronofold.llm.spans import PART, cut, found, in_chunks, let, parts_of, prefix_most

KINDS = ("email", "ip", "card", "phone")

# A match can only begin where its first run of characters begins, or right
# behind the match before; saying so, and never giving back what cannot help,
# keeps long runs linear and changes no match.
_WORD = "A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_WORD}]))[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal runs of digits with single separators; only those of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals; what touches a base span of any kind is left out.
LOOSE_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,63}+){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+().-])(?<![0-9]\x20)\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\x20.-]?[0-9])",
}
#: What the gazetteer holds by default, in lower case: words near a kind, and beginnings (card, phone) or ends (email) of its values.
NEAR = {
    "email": "mail|email|e-mail|contact|write|address|reply|inbox|correo|courriel|adresse|kontakt|contacto|schreiben|envoyer|subscribe",
    "ip": "ip|host|server|address|client|login|ping|peer|node|gateway|subnet|dns|from|addr|ipv4|ipv6",
    "card": "card|visa|mastercard|amex|credit|debit|payment|pay|karte|kreditkarte|carte|tarjeta|pago|zahlung|paiement|billing",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|dial|contact|telefon|mobil|anrufen|appelez|appeler|telefono|llamar|whatsapp",
}
VALUES = {"email": "com|org|net|edu|gov|io|de|fr|es|uk|eu|info", "card": "4|51|52|53|54|55|34|37|6011|65", "phone": "+1|+33|+34|+44|+49|0|(0"}
#: Entries that a gazetteer may have.
ENTRIES = 20_000
CONTEXT = 32
LABELERS = ("strict", "gazetteer", "context")
#: Features of a span and how many values each has, from 0 on.
SHAPE = {"length": 5, "groups": 5, "prior": 5, "next": 5, "digits": 3, "place": 2}
ROUNDS = 50


def default_gazetteer(spark: SparkSession) -> DataFrame:
    """The default table (kind, part, entry); part is near or value."""
    rows = [{"kind": kind, "part": part, "entry": x} for part, table in (("near", NEAR), ("value", VALUES)) for kind, own in table.items() for x in own.split("|")]
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:string,part:string,entry:string>>")).alias("g")).select("g.*")


def read_gazetteer(table: DataFrame) -> dict[tuple[str, str], str]:
    """Patterns by (kind, part) of a table (kind, part, entry) of at most ENTRIES rows; more are an error."""
    rows = table.where(F.col("kind").isin(*KINDS) & F.col("part").isin("near", "value") & (F.length("entry") > 0)).select("kind", "part", F.lower("entry").alias("entry")).distinct().limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES:
        raise ValueError(f"a gazetteer has at most {ENTRIES} entries")
    by: dict[tuple[str, str], list[str]] = {}
    for kind, part, entry in sorted(rows):
        by.setdefault((kind, part), []).append(re.escape(entry))
    return {key: "|".join(own) for key, own in by.items()}


def _luhn(value: Column) -> Column:
    """Whether the digits of a short string pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(value, r"[^0-9]", ""))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda total, d: total + d) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


#: A text without these has no match, so its pattern is not tried (any of the alternatives).
NEEDED = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",)}
LOOSE_NEEDED = {"email": ("(at)", "[at]", "{at}"), "ip": (":",), "card": (), "phone": ()}
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def _tried(text: Column, digits: Column, kind: str, patterns: dict, needed: dict) -> Column:
    """The matches of a kind's pattern, looked for only where its signs stand."""
    signs = F.lit(not needed[kind])
    for sign in needed[kind]:
        signs = signs | F.contains(text, F.lit(sign))
    return F.when(signs if kind == "email" else digits & signs, found(text, patterns[kind])).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column, digits: Column) -> Column:
    """array<struct<kind,start,end>> by kind as listed, then start; digits: whether the text has one."""
    passing = lambda kind: lambda s: _passes(kind, s["value"])
    return F.concat(*[_named(kind, F.filter(_tried(text, digits, kind, BASE_PATTERNS, NEEDED), passing(kind))) for kind in KINDS])


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _touches(index: Column, s: Column) -> Column:
    """Whether a span overlaps one of a kind's base spans, given in chunks (null: none)."""
    ends = F.transform(index, lambda c: F.get(c, F.size(c) - 1)["end"])
    near = F.get(index, F.size(F.filter(ends, lambda e: e <= s["start"])))
    return F.coalesce(F.get(F.filter(near, lambda b: b["end"] > s["start"]), F.lit(0))["start"] < s["end"], F.lit(False))


def proposed_spans(text: Column, digits: Column, base: Column) -> Column:
    """Spans of the loose patterns that overlap no base span."""
    by_kind = F.array(*[F.filter(base, _of(kind)) for kind in KINDS])
    index = F.transform(F.filter(by_kind, lambda own: F.size(own) > 0), lambda own: in_chunks(own, 64))
    made = F.concat(*[_named(kind, _tried(text, digits, kind, LOOSE_PATTERNS, LOOSE_NEEDED)) for kind in KINDS])
    return let(index, lambda kinds: F.filter(made, lambda s: ~F.exists(kinds, lambda k: _touches(k, s))))


def _class(char: Column) -> Column:
    """0 for none or a line's end, then white space, a letter or digit, an opening or closing sign, another sign."""
    return F.when((char == "") | (char == "\n"), 0).when(F.regexp(char, F.lit(r"^\s")), 1).when(F.regexp(char, F.lit(r"^[\p{L}\p{N}]")), 2).when(F.regexp(char, F.lit(r"^[\x22'`()\[\]{}<>,.;:!?]")), 3).otherwise(4)


def judged(span: Column, value: Column, before: Column, after: Column, gazetteer: dict[tuple[str, str], str]) -> Column:
    """struct<v, f>: the labelers' votes on a span (1 for, 0 against, -1 no opinion) and its features."""
    lowered, small = F.lower(before), F.lower(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    of = lambda per_kind: F.coalesce(*[F.when(span["kind"] == kind, per_kind[kind]) for kind in KINDS])
    strict = of({
        "email": F.when(F.contains(value, F.lit("@")), 1).otherwise(-1),
        "ip": F.when(F.contains(value, F.lit(".")), 1).otherwise(-1),
        "card": F.when(_luhn(value), 1).otherwise(0),
        "phone": F.when(F.startswith(value, F.lit("+")) & digits.between(9, 15), 1).when(digits < 9, 0).otherwise(-1),
    })

    def listed(kind: str) -> Column:
        near, values = gazetteer.get((kind, "near")), gazetteer.get((kind, "value"))
        there = F.regexp(lowered, F.lit(rf"(?<![\p{{L}}])(?:{near})(?![\p{{L}}])[^\n]{{0,16}}$")) if near else F.lit(False)
        known = F.regexp(small, F.lit(rf"[.](?:{values})$" if kind == "email" else rf"^(?:{values})")) if values else F.lit(False)
        return F.when(there, 1).when(~known if values else F.lit(False), 0).otherwise(-1)

    # glued to letters, digits or signs of other data, or a table of numbers
    glued = F.regexp(before, F.lit(r"[\p{L}0-9_/=#]$")) | F.regexp(after, F.lit(r"^[\p{L}0-9_/=]"))
    votes = F.struct(strict.alias("strict"), of({kind: listed(kind) for kind in KINDS}).alias("gazetteer"), F.when(glued, 0).otherwise(1).alias("context"))
    size = F.length(value)
    close = F.length(F.regexp_replace(F.substring(before, -16, 16), "[^0-9]", ""))
    shape = F.struct(
        F.when(size <= 8, 0).when(size <= 12, 1).when(size <= 16, 2).when(size <= 24, 3).otherwise(4).alias("length"),
        F.least(F.lit(4), F.size(F.split(value, r"[^\p{L}\p{N}]+")) - 1).alias("groups"),
        _class(F.substring(before, -1, 1)).alias("prior"),
        _class(F.substring(after, 1, 1)).alias("next"),
        F.when(close == 0, 0).when(close <= 4, 1).otherwise(2).alias("digits"),
        F.when(span["start"] < 200, 0).otherwise(1).alias("place"),
    )
    return F.struct(votes.alias("v"), shape.alias("f"))


def candidates(docs: DataFrame, text: str = "text", gazetteer: DataFrame | None = None) -> DataFrame:
    """row (struct of all columns of docs), base and more: the spans with their votes v and features f.

    Work grows with the text and its spans, not with their product: what stands
    at a span is cut out of the part of the text that holds it.
    """
    table = read_gazetteer(gazetteer if gazetteer is not None else default_gazetteer(docs.sparkSession))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    rows = rows.select("row", "t", F.regexp("t", F.lit("[0-9]")).alias("digits"))
    rows = rows.select("row", "t", "digits", base_spans(F.col("t"), F.col("digits")).alias("base"))
    rows = rows.select("row", "t", "base", proposed_spans(F.col("t"), F.col("digits"), F.col("base")).alias("more"))

    def one(parts: Column, s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.struct(cut(parts, s["start"], s["end"] - s["start"]).alias("value"), cut(parts, begin, s["start"] - begin).alias("before"), cut(parts, s["end"], F.lit(4)).alias("after"))
        seen = let(let(near, lambda x: judged(s, x["value"], x["before"], x["after"], table)), lambda m: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), m["v"].alias("v"), m["f"].alias("f")))
        return seen

    # one expression for both kinds of spans, told apart by a flag, as it is a long one
    flagged = lambda flag: lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(flag).alias("base"))
    marked = F.concat(F.transform("base", flagged(True)), F.transform("more", flagged(False)))
    rows = rows.select("row", "t", marked.alias("spans"))
    seen = let(parts_of(F.col("t")), lambda parts: F.transform("spans", lambda s: F.struct(s["base"].alias("base"), one(parts, s).alias("s"))))
    empty = F.array().cast(f"array<struct<base:boolean,s:{_JUDGED}>>")
    rows = rows.select("row", F.when(F.size("spans") > 0, seen.cast(f"array<struct<base:boolean,s:{_JUDGED}>>")).otherwise(empty).alias("seen"))
    part = lambda flag: F.transform(F.filter("seen", lambda x: x["base"] == flag), lambda x: x["s"])
    return rows.select("row", part(True).alias("base"), part(False).alias("more"))


_JUDGED = f"struct<kind:string,start:bigint,end:bigint,v:struct<{','.join(f'{x}:int' for x in LABELERS)}>,f:struct<{','.join(f'{x}:int' for x in SHAPE)}>>"


def vote_patterns(rows: DataFrame) -> list[tuple]:
    """(kind, base, votes..., features..., count) over saved rows of `candidates`.

    Votes and features have few values, so however many spans there are, at most
    some 400,000 rows reach the driver (texts show a few hundred).
    """
    marked = lambda spans, base: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), F.lit(base).alias("base"), s["v"].alias("v"), s["f"].alias("f")))
    each = numbered(rows.select("base", "more"), "number").select(F.explode(F.when(F.col("number") >= 0, F.concat(marked("base", True), marked("more", False)))).alias("s"))
    counted = each.groupBy("s.kind", "s.base", *[F.col(f"s.v.{x}").alias(x) for x in LABELERS], *[F.col(f"s.f.{x}").alias(x) for x in SHAPE]).agg(F.count(F.lit(1)).alias("n"))
    return sorted(tuple(r) for r in counted.collect())


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def reliabilities(patterns: list[tuple], rounds: int = ROUNDS) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """Expectation maximisation, each kind by itself: accuracy by (kind, labeler), and P(personal | kind, base, votes).

    patterns: (kind, base, votes..., anything..., count).  Abstaining says nothing.
    Base spans are personal data throughout; the share of personal data among
    proposals is estimated.  Accuracies have a weak prior of 0.8 and stay within
    0.55 and 0.98, so no labeler is believed blindly or turned round.
    """
    counts: dict[tuple, int] = {}
    for p in patterns:
        counts[p[:5]] = counts.get(p[:5], 0) + p[-1]
    accuracy, belief = {}, {}
    for kind in sorted({p[0] for p in counts}):
        own = {p: n for p, n in counts.items() if p[0] == kind}
        sure, prior = dict.fromkeys(LABELERS, 0.8), 0.5
        for _ in range(rounds):
            right, voted = dict.fromkeys(LABELERS, 8.0), dict.fromkeys(LABELERS, 10.0)
            personal, proposals = 5.0, 10.0
            for p, n in own.items():
                odds = _logit(prior) + sum((1 if v else -1) * _logit(sure[x]) for x, v in zip(LABELERS, p[2:5], strict=True) if v >= 0)
                chance = belief[p] = 1.0 if p[1] else 1 / (1 + math.exp(-odds))
                for x, v in zip(LABELERS, p[2:5], strict=True):
                    if v >= 0:
                        right[x] += n * (chance if v else 1 - chance)
                        voted[x] += n
                if not p[1]:
                    personal, proposals = personal + n * chance, proposals + n
            sure = {x: min(0.98, max(0.55, right[x] / voted[x])) for x in LABELERS}
            prior = min(0.9, max(0.1, personal / proposals))
        accuracy |= {(kind, x): sure[x] for x in LABELERS}
    return accuracy, belief


def _inputs(votes: tuple, shape: tuple) -> list[str]:
    """Names of the weights that a span adds up: votes that are no abstentions, and one per feature."""
    return [f"{x}={v}" for x, v in zip(LABELERS, votes, strict=True) if v >= 0] + [f"{x}={v}" for x, v in zip(SHAPE, shape, strict=True)] + ["constant"]


def fit(patterns: list[tuple], steps: int = 300) -> dict[tuple[str, str], float]:
    """Weights of the span classifier by (kind, input); see `_inputs`.

    Gradient ascent on the soft labels, patterns weighted by the logarithm of
    their counts.  Votes start at the log odds of their reliabilities, features at
    nothing, and all are drawn back to where they start.
    """
    accuracy, belief = reliabilities(patterns)
    out: dict[tuple[str, str], float] = {}
    for kind in KINDS:
        start = {f"{x}={v}": (1 if v else -1) * _logit(accuracy.get((kind, x), 0.8)) for x in LABELERS for v in (0, 1)}
        start |= {f"{x}={v}": 0.0 for x, n in SHAPE.items() for v in range(n)} | {"constant": 0.0}
        rows = [(_inputs(p[2:5], p[5:-1]), belief[p[:5]], 1 + math.log(p[-1])) for p in patterns if p[0] == kind]
        total, weights = 1 + sum(r[2] for r in rows), dict(start)
        for _ in range(steps if rows else 0):
            slope = {x: 0.02 * total * (start[x] - w) for x, w in weights.items()}
            for names, target, weight in rows:
                odds = max(-30.0, min(30.0, sum(weights[x] for x in names)))
                error = weight * (target - 1 / (1 + math.exp(-odds)))
                for x in names:
                    slope[x] += error
            weights = {x: w + 0.3 * slope[x] / total for x, w in weights.items()}
        out |= {(kind, x): w for x, w in weights.items()}
    return out


def score(span: Column, weights: dict[tuple[str, str], float]) -> Column:
    """Log odds of the span classifier: one weight looked up for each vote and feature."""
    kind = F.coalesce(*[F.when(span["kind"] == k, place) for place, k in enumerate(KINDS)])
    out = F.get(F.lit([weights[(k, "constant")] for k in KINDS]), kind)
    for x in LABELERS:  # an abstention adds nothing
        out = out + F.get(F.lit([w for k in KINDS for w in (0.0, weights[(k, f"{x}=0")], weights[(k, f"{x}=1")])]), kind * 3 + span["v"][x] + 1)
    for x, n in SHAPE.items():
        out = out + F.get(F.lit([weights[(k, f"{x}={v}")] for k in KINDS for v in range(n)]), kind * n + span["f"][x])
    return out


def all_spans(weights: dict[tuple[str, str], float]) -> Column:
    """Of rows of `candidates`: base spans and the proposals that the classifier accepts, by kind as listed and then by start."""
    chosen = F.concat("base", F.filter("more", lambda s: score(s, weights) > 0))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size("more") == 0, bare("base")).otherwise(F.concat(*[F.array_sort(F.filter(bare(chosen), _of(kind))) for kind in KINDS]))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Per row of docs: doc_id, base counts, base_sha256, spans, n_added and n_spans.

    A null or empty text has no spans; repeated rows give repeated rows; an
    empty table gives none; of spans of one kind and start the shorter comes first.
    Work on very long texts grows with their length and spans.  One pass over the
    texts writes the spans with their votes and features, without texts; the rest
    reads that table.
    """
    rows = save(candidates(docs, gazetteer=gazetteer).select(F.col("row.doc_id").alias("doc_id"), "base", "more"), "spans")
    rows = rows.select("doc_id", "base", all_spans(fit(vote_patterns(rows))).alias("spans"))
    counts = [F.size(F.filter("base", _of(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"), F.size("spans").cast("bigint").alias("n_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [KIND]; overlapping spans become one, named by the first.

    A span that starts where none before it reaches opens a new stretch.  Stretches
    are cut out and joined once, so long texts with many spans stay linear.
    """

    def opened(ordered: Column) -> Column:
        return let(prefix_most(F.transform(ordered, lambda s: s["end"])), lambda reached: F.filter(F.transform(ordered, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(reached, i).alias("from"))), lambda s: s["start"] >= s["from"]))

    def joined(parts: Column, ordered: Column) -> Column:
        pieces = F.transform(opened(ordered), lambda s: F.concat(cut(parts, s["from"], s["start"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        end = F.array_max(F.transform(ordered, lambda s: s["end"]))
        # the last part of a text is reached by counting parts, so its length is not needed
        return F.concat(F.array_join(pieces, ""), cut(parts, end, F.size(parts) * PART - end))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = let(ordered, lambda o: let(parts_of(text), lambda parts: joined(parts, o)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, text: str = "text", gazetteer: DataFrame | None = None) -> DataFrame:
    """The rows of docs, columns and all, with personal data in the text replaced; null texts stay null.

    Repeated rows stay repeated and an empty table gives no rows.  The patterns
    read each text once: the rows are written with their spans and votes, and the
    classifier fitted on these decides as they are read back.
    """
    rows = save(candidates(docs, text, gazetteer), "redaction")
    rows = rows.select("row", all_spans(fit(vote_patterns(rows))).alias("spans"))
    own = F.col("row").getField(text)
    return rows.select(*[(F.when(own.isNotNull(), redacted(own, F.col("spans"))).alias(c) if c == text else F.col("row").getField(c).alias(c)) for c in docs.columns])
