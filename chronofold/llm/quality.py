"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``ledger`` evaluates every rule once and stores one bit per failed rule beside
the measurements.  Policies are versioned masks over those bits, so applying
another policy, or asking what a rule costs, reads the ledger and never the
texts: ``apply_policy`` is one bitwise and, ``ablations`` one aggregation over
bit patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import numbered, save

#: Name, meaning and test of each rule over the measurements; the position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("capitals", "10 * n_capitals > 3 * word_chars"),
    ("exclamations", "2 * n_exclamations > n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
]
BITS = {name: 1 << place for place, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Versioned policies: a document is kept if it fails no rule of the mask.
POLICIES = {1: BASE, 2: BASE | BITS["symbols"] | BITS["capitals"], 3: sum(BITS.values())}
POLICY = 3

SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns row (struct of all columns of docs) and the measurements of the whole text (null: empty)."""
    out = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    out = out.select("row", "t", F.filter(F.split("t", SPACE), lambda x: x != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0).alias("lines"))
    word = lambda i: F.get("w", i)
    windows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.select("row", "t", "w", "lines", windows.alias("h"))
    # only texts with some window twice are sorted; equal hashes are confirmed on the words
    twice = F.size(F.array_distinct("h")) < F.size("h")
    ordered = F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    out = out.select("row", "t", "w", "lines", ordered.alias("s"))

    def same(a: Column, b: Column) -> Column:
        words = [word(a["i"] + k).eqNullSafe(word(b["i"] + k)) for k in range(3)]
        return F.coalesce((a["h"] == b["h"]) & words[0] & words[1] & words[2], F.lit(False))

    again = F.filter("s", lambda x, k: same(x, F.get("s", k - 1)) | same(x, F.get("s", k + 1)))
    out = out.select("row", "t", "w", "lines", F.array_sort(F.transform(again, lambda x: x["i"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get("p", k - 1), F.lit(3)))), F.lit(0).cast("bigint"), lambda total, x: total + x)
    return out.select(
        "row",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate("t", _SPACES, "")).cast("bigint").alias("word_chars"),
        _removed(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _removed(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_capitals"),
        _removed(F.col("t"), "!").cast("bigint").alias("n_exclamations"),
        F.size("lines").cast("bigint").alias("n_lines"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, the measurements and `failed`, the bits of the rules that the text fails.

    A null or empty text has no words and fails few_words.  No shuffle.
    """
    bits = F.lit(0).cast("bigint")
    for place, (_, test) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << place)).otherwise(F.lit(0)).cast("bigint"))
    return measured(docs, text).withColumn("failed", bits)


def passes(failed: Column, version: int = POLICY) -> Column:
    """Whether failure bits pass a policy."""
    return failed.bitwiseAND(F.lit(POLICIES[version]).cast("bigint")) == 0


def apply_policy(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """Adds kept to a ledger (or anything with its column failed)."""
    return rows.withColumn("kept", passes(F.col("failed"), version))


def ablations(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    The ledger is first reduced to counts of its bit patterns, at most
    2^rules, before anything is told apart.
    """
    mask = POLICIES[version]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("bigint").alias("bit")) for name, bit in BITS.items() if bit & mask])
    each = patterns.select("failed", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations", "n_lines")


def saved_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger as a written table: doc_id, the measurements and failed; every text is read once.

    Policies and ablations of any version read this table only.
    """
    return save(ledger(docs, text).select(F.col("row.doc_id").alias("doc_id"), *MEASURES, "failed"), "ledger")


def judge(docs: DataFrame, version: int = POLICY) -> DataFrame:
    """A saved ledger with a policy's verdict per row of docs: doc_id, measurements, base_failed, kept, failed.

    A null or empty text has no words and fails; repeated rows give repeated rows,
    an empty table none; very long texts are measured as a whole; other columns
    are not read.
    """
    rows = apply_policy(saved_ledger(docs), version)
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("bigint")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed")


def keep_good(docs: DataFrame, version: int = POLICY) -> DataFrame:
    """The rows of docs, columns and all, that pass a policy.

    Null and empty texts go; repeated rows are judged alike; an empty table gives
    no rows.
    """
    rows = numbered(ledger(docs).select("row", "failed"), "number")
    return rows.where(passes(F.col("failed"), version) & (F.col("number") >= 0)).select("row.*")


def ablation_report(docs: DataFrame, versions: tuple[int, ...] = tuple(POLICIES)) -> DataFrame:
    """version, rule, n_failed and n_only of every policy version, all from one saved ledger.

    A rule that nothing fails has zeros; an empty table gives no rows.
    """
    rows, out = saved_ledger(docs), None
    for version in versions:
        own = ablations(rows, version).select(F.lit(version).alias("version"), "rule", "n_failed", "n_only")
        out = own if out is None else out.unionByName(own)
    return out
