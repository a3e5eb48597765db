"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased in ASCII; letters (ASCII ones and all bytes of other
scripts) form words.  Every byte n-gram of 1 to 4 bytes that lies in a word
with its two borders is hashed to a bucket; the mean of the buckets' vectors
goes through a linear softmax.  Vectors and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows.

Scores are calibrated: a temperature is fitted on the part of the sample that
was not trained on, and so is the score under which a document is rejected,
against imitated texts of no learned language.
As everything behind the mean is linear, prediction adds one row of a
buckets x languages table per n-gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.common import small_batches, text_of

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
#: Labelled rows that training reads at most, by the order of a hash of their ids.
SAMPLE_ROWS = 3000
EPOCHS, STEPS = 4, 10_000
#: Held-out texts that a rejection score needs, the share of strange texts it keeps out, and the weight of the temperature's prior.
CALIBRATION, REJECTED, PRIOR = 200, 0.99, 2.0
UNKNOWN = "und"
#: Bytes handled at once, which bounds a worker's memory for very long texts.
CHUNK = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = range(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
_FOLD[128:] = range(128, 256)


def _folded(data: bytes, after_space: bool) -> np.ndarray:
    """Letters of a stretch of a text as bytes; runs of anything else become one space (none after a space)."""
    text = _FOLD[np.frombuffer(data, np.uint8)]
    space = text == 32
    return text[~(space & np.concatenate(([after_space], space[:-1])))]


def _grams(text: np.ndarray, known: int) -> np.ndarray:
    """Buckets of the n-grams of `text` that do not end within its first `known` bytes."""
    space = text == 32
    out, code = [], np.zeros(len(text), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        here = len(text) - n + 1
        if here <= 0:
            break
        code = code[:here] * np.uint32(257) + text[n - 1 :] + np.uint32(1)
        if n == 1:
            inside = ~space
        elif n == 2:
            inside = np.ones(here, bool)
        else:  # no border but at the ends
            inside = ~space[1 : 1 + here]
            for k in range(2, n - 1):
                inside &= ~space[k : k + here]
        if n in GRAMS:
            begin = max(0, known - n + 1)
            mixed = code[begin:][inside[begin:]] * np.uint32(2654435761)
            out.append(((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.uint16))
    return np.concatenate(out) if out else np.empty(0, np.uint16)


def bucket_chunks(data: bytes, size: int = CHUNK) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text's words, with one border at each end of a word.

    The text is read in stretches of `size` bytes; the last bytes of each go on
    into the next one, so the stretches' ends change nothing.
    """
    tail = np.array([32], np.uint8)
    for begin in range(0, len(data), size):
        fresh = _folded(data[begin : begin + size], bool(tail[-1] == 32))
        text = np.concatenate((tail, fresh))
        yield _grams(text, len(tail))
        tail = text[-(max(GRAMS) - 1) :]
    if tail[-1] != 32:
        yield _grams(np.append(tail, np.uint8(32)), len(tail))


def bucket_counts(data: bytes, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, ascending, and how often each comes; at most BUCKETS of them."""
    total = np.zeros(BUCKETS, np.int64)
    for found in bucket_chunks(data, size):
        total += np.bincount(found, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letters(column):
    """Whether a text column has any letter (any script)."""
    return F.coalesce(F.regexp(column, F.lit(r"\p{L}")), F.lit(False))


class LanguageModel:
    """A trained table of logits by bucket with its bias, temperature and rejection score."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject_below: float = 0.0):
        self.languages, self.table, self.bias = languages, table.astype(np.float32), bias.astype(np.float32)
        self.temperature, self.reject_below = temperature, reject_below

    def logits(self, data: bytes) -> np.ndarray | None:
        """Of a whole UTF-8 text, or None if it has no n-gram; long texts are added up in stretches."""
        total, grams = np.zeros(len(self.languages)), 0
        for found in bucket_chunks(data):
            total += self.table[found].sum(axis=0, dtype=np.float64)
            grams += len(found)
        return total / grams + self.bias if grams else None

    def mean(self, found: np.ndarray, counts: np.ndarray | int) -> np.ndarray:
        """Logits of a text given as buckets and how often each comes."""
        share = np.broadcast_to(counts, found.shape) / np.broadcast_to(counts, found.shape).sum()
        return (self.table[found] * share[:, None]).sum(axis=0) + self.bias

    def predict(self, data: bytes) -> tuple[str, float]:
        """Language and calibrated score; (und, 0) without letters."""
        logits = self.logits(data)
        if logits is None or not self.languages:
            return UNKNOWN, 0.0
        odds = np.exp((logits - logits.max()) / self.temperature)
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent on (buckets, counts) of texts; every fifth text calibrates.

    Small samples are gone through more often, so that at least STEPS steps are
    taken.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    answers = np.array([languages.index(x) for x in labels])
    usable = [i for i, (found, _) in enumerate(bags) if len(found)]
    held = [i for k, i in enumerate(usable) if k % 5 == 4]
    learn = [i for k, i in enumerate(usable) if k % 5 != 4]
    epochs = max(EPOCHS, -(-STEPS // max(1, len(learn))))
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            found, counts = bags[i]
            share = (counts / counts.sum())[:, None]
            hidden = (vectors[found] * share).sum(axis=0)
            odds = np.exp((z := hidden @ weights + bias) - z.max())
            error = odds / odds.sum()
            error[answers[i]] -= 1
            rate = 0.5 * (1 - done / steps)
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * error
            vectors[found] -= rate * len(found) * share * back / max(1, np.sqrt(len(found)))
            done += 1
    model = LanguageModel(languages, vectors @ weights, bias)
    calibrate(model, [bags[i] for i in held], answers[held], rng)
    return model


def calibrate(model: LanguageModel, bags: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, rng: np.random.Generator) -> None:
    """Temperature and rejection score from texts that were not trained on.

    The temperature minimises the loss of the held-out texts with a weak prior
    at 1.  Texts of no learned language are imitated by as many n-grams drawn
    evenly from all that the held-out texts hold: they belong to no one.  The
    rejection score is the least one that keeps REJECTED of these and of the wrong
    predictions out, but never one that would cost more than a thousandth of
    the right predictions.  Fewer than CALIBRATION texts say too little about
    a thousandth, so then nothing is rejected by its score.
    """
    if len(bags) < CALIBRATION:
        return
    logits = np.array([model.mean(*bag) for bag in bags])
    pool = np.unique(np.concatenate([found for found, _ in bags]))
    strange = np.array([model.mean(rng.choice(pool, int(min(counts.sum(), 400))), 1) for _, counts in bags])

    def odds(values: np.ndarray, t: float) -> np.ndarray:
        z = np.exp((values - values.max(axis=1, keepdims=True)) / t)
        return z / z.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        right = odds(logits, t)[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(right, 1e-300)).sum() + PRIOR * np.log(t) ** 2)

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    made = odds(logits, model.temperature)
    best, right = made.max(axis=1), made.argmax(axis=1) == truth
    bad = np.concatenate((odds(strange, model.temperature).max(axis=1), best[~right]))
    if right.any():
        model.reject_below = float(min(np.quantile(bad, REJECTED), np.quantile(best[right], 0.001)))


MODEL = "languages array<string>, weights binary, bias array<float>, temperature double, reject_below double"


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Trains on at most `sample_rows` rows (doc_id, text, lang) with a text and a label.

    The sample is the distinct rows whose hashes come first, spread evenly over
    the table whatever its order.  Executors turn each whole sampled text into
    bucket counts, at most BUCKETS of them; one task trains on these, and only the
    table of logits (BUCKETS x languages) reaches the driver.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # hashes alone are ranked; the whole texts of the chosen rows are then read again
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    edge = rows.select(order.alias("h")).distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return train([], [])

    def bags(batches):
        for batch in batches:
            found = [bucket_counts(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            columns = [pa.array([x[k].astype(kind) for x in found], pa.list_(own)) for k, kind, own in ((0, np.uint16, pa.int32()), (1, np.float32, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["h", "lang", "found", "counts"])

    def learn(batches):
        own = [(h, lang, bag) for batch in batches for h, lang, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), zip(_lists(batch.column(2), np.uint16), _lists(batch.column(3), np.float32), strict=True), strict=True)]
        own.sort(key=lambda x: x[0])
        if own:
            model = train([bag for *_, bag in own], [lang for _, lang, _ in own])
            yield pa.RecordBatch.from_pylist([{"languages": model.languages, "weights": model.table.tobytes(), "bias": model.bias.tolist(), "temperature": model.temperature, "reject_below": model.reject_below}], schema=pa.schema([("languages", pa.list_(pa.string())), ("weights", pa.binary()), ("bias", pa.list_(pa.float32())), ("temperature", pa.float64()), ("reject_below", pa.float64())]))

    small_batches(labelled.sparkSession)
    # a row that is repeated counts once, so no more than sample_rows remain
    chosen = rows.where(order <= edge).groupBy(order.alias("h")).agg(F.min(F.struct("lang", "text")).alias("r")).select("h", "r.lang", "r.text")
    made = chosen.mapInArrow(bags, "h long, lang string, found array<int>, counts array<float>").repartition(1).mapInArrow(learn, MODEL).first()
    table = np.frombuffer(made.weights, np.float32).reshape(BUCKETS, len(made.languages))
    return LanguageModel(list(made.languages), table, np.array(made.bias), made.temperature, made.reject_below)


def _lists(column: pa.Array, kind: type) -> list[np.ndarray]:
    """A column of lists as arrays, without making a Python object of each element."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b].astype(kind) for a, b in zip(at[:-1], at[1:], strict=True)]


def predictor(spark, model: LanguageModel) -> Callable:
    """A column function text -> struct<lang, score>; the model (a few MB at most) is sent once to each executor."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        own = shared.value
        made = [own.predict(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([y for _, y in made], pa.float64())], names=["lang", "score"])

    return predict


def held_out(doc_id="doc_id"):
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every whole text.

    The language is `und` with score 0 where the text is null or has no letter.
    Without any labelled row every language is `und`.  Of equal scores the
    language first by name wins.  Repeated rows give repeated rows, an empty table
    gives none; very long texts are read in stretches; lang is read for training
    only, other columns not at all.
    """
    small_batches(docs.sparkSession)
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), sample_rows)
    made = predictor(docs.sparkSession, model)(text_of(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), has_letters(F.col("text")).alias("letters"), made.alias("made"))
    unknown = ~F.col("letters") | (F.col("made.lang") == UNKNOWN)
    score = F.when(unknown, 0.0).otherwise(F.col("made.score"))
    return rows.select("doc_id", "held_out", F.when(unknown, UNKNOWN).otherwise(F.col("made.lang")).alias("lang_pred"), score.alias("score"), (unknown | (score < F.lit(model.reject_below))).alias("rejected"))


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, columns and all, whose language is not rejected.

    Null, empty and letterless texts go.  A row without doc_id or lang is judged
    like any other; repeated rows stay repeated; an empty table gives no rows, and
    a table without any labelled row none either.
    """
    small_batches(docs.sparkSession)
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), sample_rows)
    made = predictor(docs.sparkSession, model)(text_of(docs))
    return docs.where(has_letters(F.col("text"))).where((made["lang"] != UNKNOWN) & (made["score"] >= F.lit(model.reject_below)))
