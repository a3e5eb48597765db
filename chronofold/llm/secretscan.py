"""Secret scanning with false positives removed by a random forest, in DataFrame expressions only.

Candidates are blocks of a private key from its first to its last line, and runs
of 16 or more key characters, with or without digits.  A full stop at a run's end
belongs to the sentence.  An equals sign or a colon ends a run, so the name of an
assignment is not part of it; one or two equals signs that nothing of a key
follows are padding (before a quote, only if a quote opens the run).
Features are the candidate's length, its character classes and transitions, how
much of it a dictionary covers, whether it looks like a path, and the words
beside it.  The forest is trained on labelled findings (before, candidate,
after, secret): small trees grown on the driver from the bounded feature rows
of those findings, and put back into the plan as arrays of nodes that one column
expression walks, so scanning a corpus is one narrow pass.

Without findings of one's own, ``default_findings`` makes a fixed set of them:
keys of common shapes in assignments and headers as secrets; identifiers,
paths, commit hashes, checksums, versions and numbers as false positives.
"""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.spans import cut, found, let, parts_of

_KEY = "A-Za-z0-9+/_.-"
_RUN = rf"[{_KEY}]{{15,}}[A-Za-z0-9+/_-](?![A-Za-z0-9+/_-])"
_BLOCK = r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----[^-]{16,}+-----END [A-Z0-9\x20]{0,40}PRIVATE KEY-----"
CANDIDATE = rf"{_BLOCK}|(?<=[\x22'`]){_RUN}(?:={{1,2}}(?![{_KEY}=]))?|(?<![{_KEY}]){_RUN}(?:={{1,2}}(?![{_KEY}=\x22'`]))?"
BEFORE, AFTER = 40, 16
#: Findings that training reads at most.
FINDINGS = 4000
TREES, DEPTH, LEAST = 25, 5, 8
SECRET_WORDS = "token|secret|password|passwd|pwd|apikey|api_key|api-key|access_key|accesskey|auth|authorization|bearer|credential|credentials|private_key|client_secret|key"
HARMLESS_WORDS = "commit|sha1|sha256|md5|checksum|hash|digest|revision|rev|uuid|guid|version|id|integrity|etag|build|file|path|image|data|order|isbn|phone|number"
DICTIONARY = "the|and|ing|ion|ent|for|ter|user|name|file|path|data|test|main|src|lib|bin|usr|home|com|org|www|http|html|index|config|service|server|client|value|type|image|static|public|model|build|release|version|module|class|order|list|item|page|report|backup|archive|project|document|example|number|system|local|share|assets|script|style|table|query|result"

FEATURES = ("length", "digits", "upper", "lower", "signs", "transitions", "distinct", "dictionary", "slashes", "dots", "dashes", "hex", "secret_word", "harmless_word", "assigned", "quoted", "block")


def features(before: Column, candidate: Column, after: Column) -> dict[str, Column]:
    """Numbers that the forest sees, from a candidate and the text beside it."""
    size = F.length(candidate).cast("double")
    count = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")).cast("double")
    share = lambda pattern: 1 - count(pattern) / size
    lowered = F.lower(before)
    return {
        "length": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        # places where the class of characters changes
        "transitions": (size - F.length(F.regexp_replace(candidate, r"([0-9]++|[A-Z]++|[a-z]++|[^A-Za-z0-9]++)", "x"))).cast("double") / size,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))).cast("double"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(candidate), DICTIONARY, "")).cast("double") / size,
        "slashes": (size - count("/")) / size,
        "dots": (size - count(r"\.")) / size,
        "dashes": (size - count("[-_]")) / size,
        "hex": F.regexp(candidate, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")).cast("double"),
        "secret_word": F.regexp(lowered, F.lit(rf"(?:{SECRET_WORDS})[\x22']?\x20{{0,2}}[:=]?\x20{{0,2}}[\x22']?$")).cast("double"),
        "harmless_word": F.regexp(lowered, F.lit(rf"(?<![a-z])(?:{HARMLESS_WORDS})[\x22']?\x20{{0,2}}[:=/-]?\x20{{0,2}}[\x22']?$")).cast("double"),
        "assigned": F.regexp(before, F.lit(r"[:=]\x20{0,2}[\x22']?$")).cast("double"),
        "quoted": (F.regexp(before, F.lit(r"[\x22'`]$")) & F.regexp(after, F.lit(r"^[\x22'`]"))).cast("double"),
        "block": F.startswith(candidate, F.lit("-----BEGIN ")).cast("double"),
    }


def default_findings(count: int = FINDINGS, seed: int = 7) -> list[dict]:
    """Labelled findings made by rule, the same for every call."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes, upper_hex = "0123456789abcdef", "0123456789ABCDEF"
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    letters = base62[:52]
    words, names, harmless = DICTIONARY.split("|"), SECRET_WORDS.split("|"), HARMLESS_WORDS.split("|")
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    out = []
    while len(out) < count:
        secret = rng.random() < 0.5
        if secret:
            shape = rng.randrange(8)
            key = [pick(hexes, rng.choice((32, 40, 64))), pick(upper_hex, rng.choice((32, 40))), pick(base62, rng.randint(20, 48)), "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), rng.choice(("ghp_", "sk-", "xoxb-", "glpat-")) + pick(base62, rng.randint(20, 40)), pick(base62 + "+/", rng.choice((40, 64))) + rng.choice(("", "=", "==")), rng.choice(("AKIA", "", "ghp_", "sk-")) + pick(rng.choice((letters, letters.lower(), letters.upper())), rng.randint(16, 40)), _block(pick, rng)][shape]
            name = rng.choice(names)
            name = rng.choice((name, name.upper(), rng.choice(words) + "_" + name))
            form = rng.randrange(6)
            before, after = [(f'{text()} {name} = "', f'" {text()}'), (f"{text()} {name}='", "'"), (f"{name}: ", f"\n{text()}"), (f"{text()} {name}=", f" {text()}"), (f'"{name}": "', '",'), (f"{rng.choice(('Authorization: ', text() + ' '))}{rng.choice(('Bearer', 'bearer', 'token'))} ", rng.choice((f" {text()}", ".", f"\n{text()}")))][form]
            if shape == 7:
                before, after = rng.choice(("", f"{text()}\n", f"{name}: ")), f"\n{text()}"
            elif (shape in (3, 4) or key[:4] in ("AKIA", "ghp_")) and rng.random() < 0.3:
                before, after = f"{text()} ", f" {text()}"
        else:
            shape = rng.randrange(12)
            number = rng.choice((str(rng.randint(0, 9999)), ""))
            key = [
                "_".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + number,
                "/".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + number + rng.choice((".txt", ".py", "", ".png")),
                pick(hexes, rng.choice((40, 64, 32))),
                "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)),
                "".join(rng.choice(words).title() for _ in range(rng.randint(3, 5))) + number,
                pick("0123456789", rng.randint(16, 20)),
                ".".join(str(rng.randint(0, 99)) for _ in range(7)) + "-" + rng.choice(words),
                ".".join(rng.choice(words) for _ in range(4)) + "." + number,
                "-".join(rng.choice(words) for _ in range(rng.randint(3, 5))) + "-" + number,
                # a long word of prose, and a line of signs
                "".join(pick("bcdfghklmnprstvz", rng.randint(1, 2)) + pick("aeiou", 1) for _ in range(rng.randint(6, 12))),
                rng.choice("-_./+") * rng.randint(16, 60),
                rng.choice((str.upper, str.lower))("_".join(rng.choice(words + names) for _ in range(rng.randint(3, 5)))),
            ][shape]
            name = rng.choice(harmless)
            if shape in (2, 3):
                before, after = rng.choice(((f"{text()} {name} ", f" {text()}"), (f"{name}: ", f" {text()}"), (f'{name} = "', '"'), (f"{name}/", " ")))
            else:
                before, after = rng.choice(((f"{text()} ", f" {text()}"), (f'{rng.choice(words)} = "', '"'), (f"{text()}\n", f", {text()}"), (f"{rng.choice(names)} in ", f" {text()}")))
        # cut as a scan cuts the whole text; a long name beside a key is no secret
        whole, at = before + key + after, len(before)
        for m in re.finditer(CANDIDATE, whole):
            out.append({"before": whole[max(m.start() - BEFORE, 0) : m.start()], "candidate": m[0], "after": whole[m.end() : m.end() + AFTER], "secret": int(secret and m.start() <= at < m.end())})
    return out[:count]


def _block(pick, rng: random.Random) -> str:
    """A made-up private key of a few lines."""
    kind = rng.choice(("", "RSA ", "EC ", "OPENSSH "))
    lines = "\n".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64) for _ in range(rng.randint(2, 5)))
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----"


def findings_table(spark: SparkSession, findings: list[dict]) -> DataFrame:
    kind = "array<struct<before:string,candidate:string,after:string,secret:int>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(findings)), kind)).alias("f")).select("f.*")


def _grow(rows: list[tuple], rng: random.Random, depth: int):
    """A tree as nested (feature, threshold, low, high), or a leaf's share of secrets."""
    share = sum(y for _, y in rows) / len(rows)
    if not depth or share in (0.0, 1.0) or len(rows) < 2 * LEAST:
        return share
    best = None
    for k in rng.sample(range(len(FEATURES)), 5):
        ordered = sorted((x[k], y) for x, y in rows)
        total, n, left = sum(y for _, y in ordered), len(ordered), 0
        for i in range(1, n):
            left += ordered[i - 1][1]
            if i < LEAST or n - i < LEAST or ordered[i][0] == ordered[i - 1][0]:
                continue
            right = total - left
            impurity = left * (1 - left / i) + right * (1 - right / (n - i))
            if best is None or impurity < best[0]:
                best = (impurity, k, (ordered[i][0] + ordered[i - 1][0]) / 2)
    if best is None:
        return share
    _, k, edge = best
    return (k, edge, _grow([r for r in rows if r[0][k] < edge], rng, depth - 1), _grow([r for r in rows if r[0][k] >= edge], rng, depth - 1))


def train(findings: DataFrame, limit: int = FINDINGS, seed: int = 7) -> list:
    """A forest from a table (before, candidate, after, secret) of which at most `limit` rows are read.

    Rows are taken by a hash of what they hold, so the same table gives the same
    forest.
    """
    made = features(F.coalesce("before", F.lit("")), F.col("candidate"), F.coalesce("after", F.lit("")))
    rows = findings.where("candidate is not null and candidate <> '' and secret is not null").orderBy(F.xxhash64("before", "candidate", "after", "secret"), "before", "candidate", "after", "secret").limit(limit).select(*[made[x].alias(x) for x in FEATURES], F.col("secret").cast("int").alias("secret")).collect()
    data = sorted((tuple(r[:-1]), r[-1]) for r in rows)
    rng = random.Random(seed)
    return [_grow([rng.choice(data) for _ in data], rng, DEPTH) for _ in range(TREES)] if data else [0.0]


def vote(forest: list, values: tuple) -> float:
    """Mean share of secrets over the trees, for one row of feature values."""
    total = 0.0
    for node in forest:
        while isinstance(node, tuple):
            node = node[2] if values[node[0]] < node[1] else node[3]
        total += node
    return total / len(forest)


def _flat(forest: list) -> tuple[list[int], list[float], list[float]]:
    """Features and edges of complete trees of DEPTH levels, node n's children being 2n+1 and 2n+2, and their leaves."""
    feature, edge, leaf = [], [], []
    for root in forest:
        level = [root]
        for _ in range(DEPTH):
            below = []
            for node in level:
                k, at, low, high = node if isinstance(node, tuple) else (0, 0.0, node, node)
                feature.append(k)
                edge.append(float(at))
                below += [low, high]
            level = below
        leaf += [float(x) for x in level]
    return feature, edge, leaf


def nodes_of(forest: list) -> Column:
    """The forest as a struct of arrays, for `compiled`: made once where many candidates are judged."""
    feature, edge, leaf = (F.lit(x) for x in _flat(forest))
    return F.struct(feature.alias("feature"), edge.alias("edge"), leaf.alias("leaf"))


def compiled(forest: list, values: Column, nodes: Column | None = None) -> Column:
    """The same as `vote` as a column over an array of feature values: a walk down each tree by number."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    nodes = nodes_of(forest) if nodes is None else nodes

    def walk(tree: Column) -> Column:
        down = lambda n, _: 2 * n + 1 + F.when(F.get(values, F.get(nodes["feature"], tree * inner + n)) < F.get(nodes["edge"], tree * inner + n), 0).otherwise(1)
        return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), down, lambda n: F.get(nodes["leaf"], tree * leaves + n - inner))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(forest) - 1)), F.lit(0.0), lambda total, tree: total + walk(tree)) / len(forest)


def scanned(docs: DataFrame, forest: list, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """row (struct of all columns), t, n_candidates and secrets: array<struct<start,end,value,score>>."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    rows = rows.select("row", "t", found(F.col("t"), CANDIDATE).alias("c"))

    def scored(parts: Column, nodes: Column, s: Column) -> Column:
        begin = F.greatest(s["start"] - BEFORE, F.lit(0))
        near = F.struct(cut(parts, begin, s["start"] - begin).alias("before"), cut(parts, s["end"], F.lit(AFTER)).alias("after"))

        def values(x: Column) -> Column:
            made = features(x["before"], s["value"], x["after"])
            return F.array(*[made[name] for name in FEATURES])

        return let(let(near, values), lambda m: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), compiled(forest, m, nodes).alias("score")))

    judged = let(F.struct(parts_of(F.col("t")).alias("parts"), nodes_of(forest).alias("nodes")), lambda x: F.transform("c", lambda s: scored(x["parts"], x["nodes"], s)))
    rows = rows.select("row", "t", "c", F.when(F.size("c") > 0, judged).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string,score:double>>")).alias("scored"))
    return rows.select("row", "t", F.size("c").cast("bigint").alias("n_candidates"), F.filter("scored", lambda s: s["score"] >= threshold).alias("secrets"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, n_candidates, n_secrets, spans (start:end by start, comma-joined; code points).

    A null or empty text has none; repeated rows give repeated rows; an empty
    table gives no rows; other columns are not read.  A score of exactly the
    threshold counts as a secret.  Work on very long texts grows with their length
    and candidates, not with their product.
    """
    spark = docs.sparkSession
    forest = train(findings if findings is not None else findings_table(spark, default_findings()))
    rows = scanned(docs, forest, threshold=threshold)
    written = F.array_join(F.transform("secrets", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"), written.alias("spans"))
