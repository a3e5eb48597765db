"""Sum-of-squares packing of tokenized documents into fixed-length sequences.

A document goes where sum over gaps g of N(g)^2 becomes smallest, N(g) being the
number of open sequences with g free places (full ones do not count); a new
sequence is one of the choices.  Only lengths are packed: token ids never cross
the network.  Rows are dealt to groups of about GROUP pieces by a hash of
their place in the saved table of pieces, whatever their ids; each group is packed
in one task, largest pieces first, so a group leaves a handful of sequences open
at most, of the more than ten thousand that it fills.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronofold.llm.common import save, small_batches, text_of

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 4096
END = 1
CACHED_WORDS = 600_000
CACHED_LENGTH = 64
#: Pieces that one task packs.
GROUP = 50_000


class WordTokenizer:
    """Ids of a `tokenizers` file that cuts at white space, remembered by word.

    The file's own normalizer and pre-tokenizer drop white space, so the ids of
    a text are those of its stretches between ASCII white space.  Stretches of
    plain lower- or upper-case Latin words go through a byte merge table built
    from the same merges (the last letter, which carries the end mark, is
    written as a capital); anything else, added tokens among it, is encoded by
    the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # added tokens are found in the text as it is, before anything else
        self.special = re.compile("|".join(map(re.escape, sorted((x.content for x in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True))) or "(?!)").search
        self.stretches = _Known(self.stretch)
        self.words = _Known(self.word)
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile(r"[A-Za-z.,;:!?*$%&#|\"()\[\]{}<>/=+_-]+").fullmatch
        self.ids: list[int] = []
        self.merge = self._merge_table()

    def _merge_table(self):
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.ids = [-1] * 256
        for token, own in sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]):
            ends = token.endswith("</w>")
            word = token.removesuffix("</w>")
            if not re.fullmatch("[a-z]+", word) or token == "</w>":
                continue
            key = (word[:-1] + word[-1].upper() if ends else word).encode()
            if len(key) == 1:
                self.ids[key[0]] = own
            elif key not in ranks:
                ranks[key] = len(self.ids)
                self.ids.append(own)
        return tiktoken.Encoding("words", pat_str=r"[a-z]*[A-Z]", mergeable_ranks=ranks, special_tokens={})

    def word(self, word: str) -> bytes:
        """Ids of one pre-token in lower case."""
        if re.fullmatch("[a-z]+", word):
            return array("I", map(self.ids.__getitem__, self.merge.encode_ordinary(word[:-1] + word[-1].upper()))).tobytes()
        return self.exact(word)

    def exact(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def stretch(self, data: bytes) -> bytes:
        text = data.decode()
        if self.special(text):
            return self.exact(text)
        if self.plain(text):
            return b"".join(map(self.words.__getitem__, self.cut(text.lower())))
        if any(map("Σİ".__contains__, text)) or not text.isprintable() or not unicodedata.is_normalized("NFC", text):
            return self.exact(text)
        return b"".join(map(self.words.__getitem__, self.cut(text.lower())))

    def packed(self, data: bytes) -> bytes:
        """Ids of a whole UTF-8 text as little-endian unsigned 32-bit integers."""
        for memory in (self.stretches, self.words):
            if len(memory) > CACHED_WORDS:
                memory.clear()
        return b"".join(map(self.stretches.__getitem__, data.split()))


class _Known(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        ids = self.make(key)
        if len(key) <= CACHED_LENGTH:
            self[key] = ids
        return ids


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Tokenizes every whole text and cuts documents longer than `size`: one row a piece."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own = tokenizer(path)
        end = array("I", [END]).tobytes()
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = own.packed(data) + end
                for piece, start in enumerate(range(0, len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        own.stretches.clear()  # the worker lives on; words, far fewer, are kept for its next task

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, in the order given.

    Of equally good places the least gap wins; a new sequence counts as the gap
    `size`.  The last sequence opened with a gap is the next to be filled.
    """
    count = np.zeros(size + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    place, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # going from gap g to g - n changes the sum by 2 N(g-n) + 1 - (2 N(g) - 1); gap 0 and new sequences count nothing
        change = 2 * (1 - count[n:])
        change[1:] += 2 * count[1 : size + 1 - n]
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[size - n] + 1 if n < size else 0
        change[size - n] = fresh
        gap = n + int(change.argmin())
        if gap == size:
            own, made = made, made + 1
        else:
            own = open_by_gap[gap].pop()
            count[gap] -= 1
        place[i], offset[i] = own, size - gap
        if gap > n:
            open_by_gap[gap - n].append(own)
            count[gap - n] += 1
    return place, offset


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows of `pieces` (doc_id, piece, start, length, ids_crc32), a saved table.

    Repeated rows are packed as often as they come, and rows of one id (or none)
    are spread over all groups; an empty table gives none.
    """
    total = pieces.count()
    groups = max(1, -(-total // group))
    place = F.xxhash64(F.monotonically_increasing_id())
    keyed = pieces.withColumn("group", F.pmod(place, F.lit(groups)).cast("int") if groups > 1 else F.lit(0))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        place, offset = sum_of_squares(frame["length"].to_numpy(), size)
        frame = frame.assign(sequence_id=(np.int64(frame["group"].iloc[0]) << 40) + place, offset=offset)
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return keyed.groupBy("group").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Every document's pieces with their sequence and place there.

    A null or empty text is the end mark alone.  Repeated rows are packed as
    documents of their own; other columns are not read.
    """
    return pack_pieces(save(cut_documents(docs, path, size), "pieces"), size, group)
