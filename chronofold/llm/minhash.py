"""Near-duplicate components by circulant MinHash, banding and exact verification.

Signatures: one permutation sigma scatters the shingles of a document over 2^32
places, and one permutation pi, shifted circularly by k places, gives coordinate
k, so two permutations make the whole signature.  Bands of coordinates form
buckets; each bucket links its members to its least document (a star, not all
pairs), every link is confirmed on the full shingle sets, and components follow
from confirmed links by label propagation.

A star can miss a link between two members that are both too far from the
centre.  So each bucket whose members are in different components after the
first round is looked at again: the members outside its largest component are
compared with every document they share a bucket with.  That is done in blocks,
dealt by the largest component, in which a pair is a pair of numbers in one
task's memory and never a row; members of one component are not compared.

Missed links: with ROWS coordinates a band and BANDS bands, two documents of
similarity s share no bucket with probability (1 - s^ROWS)^BANDS, 6e-7 at 0.8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import drop, free_name, save, small_batches, text_of

ROWS, BANDS = 5, 36
#: Ids up to this number are sent to every executor (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles of each side of a block (8 MB), and what a document counts besides its own: what is
#: kept of it takes some hundred bytes, however few its shingles are.
BLOCK_CODES, DOC_CODES = 1_000_000, 12


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole UTF-8 text.

    ASCII capitals are lowered and words end at ASCII white space.  With fewer
    words than `size` the whole sequence is one shingle; without words none.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    code = np.full(count, size, np.uint64)
    for k in range(size):
        code = (code ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return np.unique(code)


def _scatter(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(codes: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash of a non-empty set: coordinate k is min of pi(sigma(x) + k)."""
    sigma = _scatter((codes >> np.uint64(32)).astype(np.uint32) ^ codes.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(sigma), 1024):
        np.minimum(out, _scatter(sigma[None, begin : begin + 1024] + shift, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=out)
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    parts = sign.reshape(-1, rows).astype(np.uint64)
    code = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        code = (code ^ parts[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
    return code.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit fingerprint and its band keys (both null for an empty set)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts, prints, keys = [], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                own = shingles(data, size)
                counts.append(len(own))
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                keys.append(bands(signature(own)) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "bands"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, print binary, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id and full set of the documents whose doc_id is among `ids` (a saved table)."""
    few = ids.count() <= BROADCAST_IDS

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, size).view(np.int64) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "codes"])

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return chosen.mapInArrow(run, "doc_id long, codes array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of pairs whose sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("codes").alias("of_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("codes").alias("of_b"))
    sized = pairs.join(one, "a").join(two, "b").where((100 * F.size("of_a") >= percent * F.size("of_b")) & (100 * F.size("of_b") >= percent * F.size("of_a")))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return sized.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the least id that each can reach; a saved table.

    Every round takes the least label among an id and its neighbours and then
    follows labels once (pointer jumping); each round's table is written, so
    lineage stays short.
    """
    count = 2 * links.count()
    edges = save(links.select(F.col("a").alias("from"), F.col("b").alias("to")).union(links.select("b", "a")).where("from <> to").distinct(), "edges", count)
    labels = save(edges.groupBy(F.col("from").alias("id")).agg(F.least(F.min("to"), F.col("id")).alias("component")), "labels", count)
    while True:
        labelled = labels.select("id", "component")
        near = edges.join(labelled, F.col("to") == F.col("id")).groupBy("from").agg(F.min("component").alias("near")).withColumnRenamed("from", "id")
        reached = labelled.join(near, "id").select("id", F.least("component", "near").alias("reached"), F.col("component").alias("was"))
        ahead = labelled.select(F.col("id").alias("reached"), F.col("component").alias("ahead"))
        moved = save(reached.join(ahead, "reached", "left").select("id", F.least("reached", "ahead").alias("component"), "was"), "labels", count)
        done = moved.where("component <> was").isEmpty()
        drop(labels)
        labels = moved
        if done:
            drop(edges)
            return labels


def block_counts(rows: DataFrame, name: str) -> DataFrame:
    """cell and, as `name`, the number of parts that its rows (cell, codes) are dealt into."""
    return rows.groupBy("cell").agg(F.ceil(F.sum(F.size("codes") + F.lit(DOC_CODES)) / BLOCK_CODES).cast("int").alias(name))


def missed_links(members: DataFrame, ids: DataFrame, sets: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that a link between documents of one bucket joins.

    One link per document, other component and block is enough.
    """
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    labelled = members.select("band", "id").join(own, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    sized = labelled.join(sizes, "component", "left").select("band", "id", "component", F.coalesce("size", F.lit(1)).alias("size"))
    apart = sized.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.struct("size", (-F.col("component")).alias("negative"))).alias("top")).where("least <> most").select("band", (-F.col("top.negative")).alias("cell"))
    outside = labelled.join(apart, "band").where("component <> cell").select("cell", "id", "component").distinct()
    outside = save(outside.join(sets.withColumnRenamed("doc_id", "id"), "id"), "outside")
    cells = block_counts(outside, "parts")
    inside = ids.select(F.col("doc_id").alias("id")).join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    inside = inside.join(cells.select(F.col("cell").alias("component")), "component", "left_semi").join(sets.withColumnRenamed("doc_id", "id"), "id")
    others = save(inside.select(F.col("component").alias("cell"), "id", "component", "codes").union(outside.select("cell", "id", "component", "codes")), "others")
    cells = cells.join(block_counts(others, "other_parts"), "cell")
    left = outside.join(cells, "cell").withColumn("part", F.pmod(F.hash("id"), F.col("parts"))).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    right = others.join(cells, "cell").withColumn("other_part", F.pmod(F.hash("id"), F.col("other_parts"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys, kept = ["cell", "part", "other_part"], ["cell", "part", "other_part", "id", "component", "codes"]

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        links = block_links(*(_columns(x) for x in (one, two)), percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return left.select(kept).groupBy(keys).cogroup(right.select(kept).groupBy(keys)).applyInArrow(compare, "a long, b long")


def _columns(block: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
    codes = block.column("codes").combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    at, flat = codes.offsets.to_numpy(), codes.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return block.column("id").to_pylist(), block.column("component").to_pylist(), [np.sort(flat[at[i] : at[i + 1]]) for i in range(len(codes))]


def block_links(one, two, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that a confirmed link joins, one per document of `one` and component of `two`.

    Linked sets have at least percent of either in common, so they share one of
    the first n - percent * n / 100 + 1 shingles of each in any one order.  With
    the rarest first, documents that have only frequent shingles in common are not
    compared, and only those first shingles are indexed.
    """
    (ids, own, sets), (other_ids, others, other_sets) = one, two
    sizes = np.fromiter(map(len, other_sets), np.int64, len(other_sets))
    if not sizes.any():
        return []
    at = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.concatenate(other_sets)
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(first, append=len(codes)).astype(np.int32)
    codes = codes[first]
    del first
    rank = np.empty(len(codes), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(codes), dtype=np.int32)
    del counts
    ranks = np.empty(at[-1], np.int32)
    for j, other in enumerate(other_sets):
        ranks[at[j] : at[j + 1]] = rank[np.searchsorted(codes, other)]
    firsts = sizes + (-percent * sizes) // 100 + 1
    heads = [np.sort(ranks[at[j] : at[j + 1]])[: firsts[j]] for j in range(len(sizes))]
    holders = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(x) for x in heads])
    heads = np.concatenate(heads)
    holders = holders[np.argsort(heads, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(heads, minlength=len(codes)))))
    del heads
    number, part, has, links = np.array(other_ids, np.int64), np.array(others, np.int64), np.zeros(len(codes), bool), []
    for i, mine in enumerate(sets):
        n = len(mine)
        place = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
        known = np.sort(rank[place[codes[place] == mine]])
        # shingles that no set of `two` has come first
        head = known[: max(0, (-percent * n) // 100 + 1 + len(known))]
        if not len(head):
            continue
        near = np.unique(np.concatenate([holders[starts[k] : starts[k + 1]] for k in head]))
        m = sizes[near]
        near = near[(part[near] != own[i]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
        has[known] = True
        done = set()
        for j in near[np.argsort(number[near], kind="stable")].tolist():
            if others[j] in done:
                continue
            common = np.count_nonzero(has[ranks[at[j] : at[j + 1]]])
            if 100 * common >= percent * (n + len(other_sets[j]) - common):
                links.append((own[i], others[j]))
                done.add(others[j])
        has[known] = False
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Links join documents with 100 * intersection >= percent * union of their
    shingle sets.  A null text counts as empty; a document without words has no
    shingles, is linked with nothing and kept.  Rows that share a doc_id are one
    document.  A row without doc_id is linked with nothing; its component is
    null and it is kept.  Very long texts are one set like any other; an empty
    table gives no rows.  Other columns are not read.
    """
    # copies of a set are one node, named by their least document
    rows = save(signatures(docs, size), "signatures")
    count = rows.count()
    nodes = rows.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    keyed = nodes.select("id", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("other")).where("centre <> other").select("band", "centre")
    members = save(keyed.join(buckets, "band"), "members", BANDS * count, dealt=True)
    places = members.count()
    ids = save(members.select(F.col("id").alias("doc_id")).distinct(), "ids", places)
    sets = save(shingle_sets(docs, ids, size), "sets")
    pairs = members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    links = save(confirm(pairs, sets, percent), "links", places, dealt=True)
    own = components(links)
    more = save(missed_links(members, ids, sets, own.select("id", "component"), percent), "links")
    joined = components(more)

    # from nodes back to all copies: a node's component, and what that one was joined to
    first = nodes.select("print", "id").join(own.select("id", "component"), "id", "left").select("print", F.coalesce("component", "id").alias("first"))
    again = joined.select(F.col("id").alias("first"), "component")
    named = save(first.join(again, "first", "left").select("print", F.coalesce("component", "first").alias("component")), "named", count)
    drop(members, ids, sets, links, own, more, joined)
    same = rows.select("doc_id", "n_shingles", "print")
    linked = same.where("print is not null and doc_id is not null").join(named, "print").select("doc_id", "n_shingles", "component")
    alone = same.where("print is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    both = linked.union(alone)
    return both.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, columns and all, of one document per component, that of the least doc_id.

    A document is here a doc_id with a text: one id with several texts is as many
    documents, each linked by its own text (of one component's documents with the
    same id, one stays), and rows that repeat both stay once.  Every row without
    doc_id stays.  Id and text are told apart by a 64-bit hash of both.
    """
    number = free_name(docs, "document")
    own = docs["doc_id"].cast("long")
    numbered = docs.where(own.isNotNull()).withColumn(number, F.xxhash64(own, docs["text"]))
    near = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), size, percent)
    components = near.select(F.col("doc_id").alias(number), "component_id").distinct()
    ids = numbered.select(number, F.col("doc_id").cast("long").alias("id")).distinct()
    least = components.join(ids, number).groupBy("component_id").agg(F.min_by(number, F.struct("id", number)).alias(number)).select(number)
    return numbered.join(least, number, "left_semi").dropDuplicates([number]).drop(number).unionByName(docs.where(own.isNull()))
