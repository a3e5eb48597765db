"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; the dynamic programme keeps, per end, only the best score and the
number of pieces on that path, so no segmentation is ever built.

Tie rules are those of the `tokenizers` unigram model: scores are summed from
the left in double precision; of equal paths to one end the one whose last
piece is longest stays; a character that is no piece of its own may be passed
at the least score of the vocabulary minus 10 (it competes as the shortest
piece there); with byte fallback such a character counts one token per byte,
else a run of them counts one.

The box holds no unigram model, so the vocabulary is the piece list of a
SentencePiece file with its own scores taken as unigram scores.  The file, or a
list of (piece, score), is a parameter.
"""

from __future__ import annotations

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from chronofold.llm.common import small_batches, text_of

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
CACHED_LENGTH = 64


def load_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece file with their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]


class UnigramCounter:
    """Counts tokens of texts cut before each space (as the Metaspace pre-tokenizer does)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.words: dict[str, int] = _Words(self.count_word)

    def count_word(self, word: str) -> int:
        """Best path's number of pieces over one pre-token."""
        size, unknown, fallback = len(word), self.unknown, self.byte_fallback
        found: list[list | None] = [None] * size
        for end, piece in self.automaton.iter(word):
            if found[end] is None:
                found[end] = [piece]
            else:
                found[end].append(piece)
        score, count, open_run = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end in range(size):
            best = None
            single = False
            for length, own in found[end] or ():  # longest first
                single |= length == 1
                total = own + score[end + 1 - length]
                if best is None or total > best:
                    best, from_ = total, end + 1 - length
            if best is not None:
                number, run = count[from_] + 1, False
            if not single:
                total = unknown + score[end]
                if best is None or total > best:
                    best, run = total, True
                    number = count[end] + (len(word[end].encode()) if fallback else not open_run[end])
            score[end + 1], count[end + 1], open_run[end + 1] = best, number, run
        return count[size]

    def count(self, text: str) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        first, *rest = text.replace(SPACE, " ").split(" ")
        # a leading space is itself the mark of the first word
        return sum(map(self.words.__getitem__, rest)) + (self.words[first] if first else 0)


class _Words(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> int:
        n = self.make(SPACE + word)
        if len(word) <= CACHED_LENGTH:
            self[word] = n
        return n


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(load_pieces(path))
    return _COUNTERS[path]


def count_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_chars and chars_per_token of every whole text.

    A null or empty text has no tokens and a null ratio; repeated rows give
    repeated rows; other columns are not read.  One narrow pass without a
    shuffle.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [own.count(x) for x in texts]
            chars = [len(x) for x in texts]
            ratio = [c / n if n else None for c, n in zip(chars, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(chars, pa.int64()), pa.array(ratio, pa.float64())], names=["doc_id", "n_tokens", "n_chars", "chars_per_token"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_chars long, chars_per_token double")
