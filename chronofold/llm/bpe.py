"""Byte-level BPE by prefix dynamic programming.

For byte-level BPE each prefix of a byte string has exactly one valid last
token: the last token of the prefix's own encoding.  ``PrefixState`` keeps that
token for every prefix, so

* encoding reads the tokens by walking back from the end,
* appending bytes only extends the table, and
* an edit is encoded again from its place to where the table agrees with the
  old one for as many prefixes as the longest token has bytes.

A token fits behind another one if plain BPE would leave the two side by side;
undoing the merges from the border outwards decides that without encoding
anything, and the answers are remembered by pair.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import small_batches, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces whose ids a Python worker remembers; then it starts anew.
CACHED_PIECES = 1_000_000
#: Longest piece that is remembered; longer ones are encoded each time.
CACHED_LENGTH = 64
#: White space besides space and line feed; texts with it are cut by the pattern alone.
ODD_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks with what the dynamic programme asks about tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split: dict[int, tuple[int, int]] = {}
        #: Tokens that merging makes from their own bytes; others only stand for a whole piece.
        self.made: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank], self.made[token] = (rank, rank), rank
            elif len(two := self.merged(token, 2)) == 2 and self.ranks.get(token) is not None:
                left, right = self.ranks[two[0]], self.ranks[two[1]]
                if rank > max(left, right) or self.merged(token, 1) == [token]:
                    self.split[rank], self.made[token] = (left, right), rank
        ends: dict[int, set[int]] = {}
        for token in self.made:
            ends.setdefault(token[-1], set()).add(len(token))
        #: By last byte and then by prefix length (the last stands for all longer ones), the lengths of the tokens that end so, longest first.
        self.lengths = [[tuple(sorted((n for n in ends.get(byte, ()) if n <= most), reverse=True)) for most in range(self.longest + 1)] for byte in range(256)]
        self.fits: dict[int, bool] = {}

    def merged(self, data: bytes, parts: int = 1) -> list[bytes]:
        """Plain BPE: merge the leftmost pair of least rank until `parts` parts or no pair is left."""
        out = [data[i : i + 1] for i in range(len(data))]
        while len(out) > parts:
            ranked = [(rank, i) for i in range(len(out) - 1) if (rank := self.ranks.get(out[i] + out[i + 1])) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def fill(self, data: bytes, last: list[int], stop: int) -> None:
        """Extends the table of last tokens to the prefix of `stop` bytes."""
        made, fits, lengths, longest = self.made.get, self.fits.get, self.lengths, self.longest
        for end in range(len(last), stop + 1):
            for n in lengths[data[end - 1]][end if end < longest else longest]:
                token = made(data[end - n : end])
                if token is not None:
                    if n == end:
                        break
                    left = last[end - n]
                    fit = fits(left << 32 | token)
                    if fit or fit is None and self.fit(left, token):
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)

    def fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves token `right` directly behind token `left`."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        limit = None  # merges from this rank on come too late
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and (limit is None or joined < limit):
                return False
            # undo the later one of the two tokens' own last merges
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.split[left][1] != left:
                    limit, left = left, self.split[left][1]
                    break
                if side == "right" and self.split[right][0] != right:
                    limit, right = right + 1, self.split[right][0]
                    break
            else:
                return True


class PrefixState:
    """The unique last token of each prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact encoding of the longer string; earlier prefixes keep their tokens."""
        self.data += more
        self.vocabulary.fill(self.data, self.last, len(self.data))

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Replaces data[begin:end]; returns how many prefixes were computed again."""
        old, shift = self.last, len(new) - (end - begin)
        data, last = self.data[:begin] + new + self.data[end:], self.last[: begin + 1]
        agreed = count = 0
        for stop in range(begin + 1, len(data) + 1):
            self.vocabulary.fill(data, last, stop)
            count += 1
            if stop > begin + len(new):
                agreed = agreed + 1 if last[stop] == old[stop - shift] else 0
                if agreed >= self.vocabulary.longest:
                    last += old[stop - shift + 1 :]
                    break
        self.data, self.last = data, last
        return count

    def tokens(self, end: int | None = None) -> list[int]:
        """Token ids of the whole string, or of its first `end` bytes."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece as tiktoken's encode_ordinary does.

    Three bounded memories serve a whole process: the last tokens of prefixes
    (pieces that begin alike share them), the ids of pieces, and the ids of
    stretches between spaces.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.prefixes: dict[bytes, int] = {}
        self.known = _Known(self.piece_ids)
        self.behind_space = _Known(self.stretch_ids)
        self.by_spaces = pattern == public_tokenizers.PATTERN

    def piece(self, data: bytes) -> list[int]:
        """One match: itself if it is a token, else its BPE."""
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > CACHED_LENGTH:
            return PrefixState(self.vocabulary, data).tokens()
        prefixes, state = self.prefixes, PrefixState(self.vocabulary)
        for end in range(1, len(data) + 1):
            token = prefixes.get(data[:end])
            if token is None:
                break
            state.last.append(token)
        begin = len(state.last)
        state.append(data)
        for end in range(begin, len(data) + 1):
            prefixes[data[:end]] = state.last[end]
        return state.tokens()

    def piece_ids(self, piece: str) -> bytes:
        return array("I", self.piece(piece.encode())).tobytes()

    def stretch_ids(self, stretch: str) -> bytes:
        """Of a space and what stands behind it up to the next one."""
        return b"".join(map(self.known.__getitem__, self.pieces(" " + stretch)))

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        for memory in (self.prefixes, self.known, self.behind_space):
            if len(memory) > CACHED_PIECES:
                memory.clear()
        if not self.by_spaces or "  " in text or " \n" in text or text[-1:] == " " or any(map(text.__contains__, ODD_SPACES)):
            return b"".join(map(self.known.__getitem__, self.pieces(text)))
        # matches of PATTERN cross no space whose neighbours are no white space, nor one right behind line ends
        first, *rest = text.split(" ")
        return b"".join(map(self.known.__getitem__, self.pieces(first))) + b"".join(map(self.behind_space.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class _Known(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= CACHED_LENGTH:
            self[key] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null text has none."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and bytes of rows (doc_id, ids); null ids give null bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            data = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of every whole text's ids and of the bytes they decode to.

    A null or empty text has no tokens and the digests of no bytes; repeated
    rows give repeated rows; other columns are not read.  One narrow pass: no
    shuffle, and a worker's memory holds one batch and a bounded cache.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own, sha = encoder(path), hashlib.sha256
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                packed = own.packed(text)
                counts.append(len(packed) // 4)
                ids.append(sha(packed).hexdigest())
                decoded.append(sha(own.decode(array("I", packed))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, DIGESTS)
