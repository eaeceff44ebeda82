"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Two fingerprints that differ in
at most four bits differ in at most two bits in each of two segments (three or more errors in two
segments would be six). The binary Golay code of length 23 is perfect: each word lies within three
bits of exactly one codeword. The index of a segment is the set of codewords next to the words of
its ball of radius one (one or six of them); words at most two bits apart have a word between them
and so share an index. Two segments together hold at most two errors, spread as (0, 2), (2, 0) or
(1, 1). The keys of a fingerprint are, for each pair of segments, its own codeword of one segment
with each index of the other one, both ways round. (0, 2): the own codewords are equal and an index
is shared. (1, 1): the own codeword of either side is an index of the other side, so that the own
codeword of the first side and that of the second side make a key of both.

Distinct fingerprints that share a key are verified by their bit distance. A bucket yields a
spanning forest of its links rather than all pairs; large buckets are dealt out in blocks.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import map_texts, query, table, worker_state
from tabguard.llm.components import connected
from tabguard.session import write_and_reread

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Largest distance that the keys cover.
MOST_BITS = 4
#: Fingerprints of a bucket that one task compares with each other; more are dealt out in blocks.
BLOCK = 4096
#: Generator polynomial of the Golay code of length 23.
GENERATOR = 0b101011100011
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for shift in range(11, -1, -1):
        rest = np.where(rest >> (shift + 11) & 1, rest ^ (GENERATOR << shift), rest)
    return rest


@lru_cache(1)
def _corrections() -> np.ndarray:
    """Error pattern of each of the 2,048 syndromes: one of the 2,048 patterns of at most three bits."""
    bits = 1 << np.arange(23)
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]),
                *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    patterns = np.array(patterns, np.int64)
    out = np.full(2048, -1, np.int64)
    out[_syndromes(patterns)] = patterns
    return out


def codewords(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    table_ = worker_state("golay", _corrections)
    return (words ^ table_[_syndromes(words)]) >> 11


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for each distinct codeword next to a word of the row's ball of radius one."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    # The code is linear: a flipped bit changes the syndrome by that of the bit alone.
    errors = worker_state("golay", _corrections)[_syndromes(words)[:, None] ^ _syndromes(flips)[None, :]]
    near = np.sort((words[:, None] ^ flips[None, :] ^ errors) >> 11, axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, at = np.nonzero(new)
    return rows, near[rows, at]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint; a key is the pair of segments and two codewords of 12 bits."""
    words = [(prints >> np.uint64(at)).astype(np.int64) & ((1 << size) - 1) for at, size in SEGMENTS]
    own = [codewords(w) for w in words]
    near = [indices(w) for w in words]
    rows, out = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        row, code = near[j]
        rows.append(row)
        out.append(pair << 24 | own[i][row] << 12 | code)
        row, code = near[i]
        once = code != own[i][row]  # both own codewords together are a key already
        rows.append(row[once])
        out.append(pair << 24 | code[once] << 12 | own[j][row[once]])
    return np.concatenate(rows), np.concatenate(out)


def fingerprints(docs: DataFrame, size: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``fp``, the 64-bit SimHash of every row's word shingles (repeats included).

    Null and empty texts get zero; fewer words than ``size`` make one shingle.
    """

    def run(texts):
        import xxhash

        digest = xxhash.xxh64_intdigest
        out = np.zeros(len(texts), np.uint64)
        for row, text in enumerate(texts):
            words = WORDS.findall(text.lower())  # bytes: lower-cases A-Z only
            if not words:
                continue
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            n = max(1, len(words) - size + 1)
            starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
            ends = ends[-n:].tolist()
            total = np.zeros(64, np.int64)
            for low in range(0, n, CHUNK):
                hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[low : low + CHUNK], ends[low : low + CHUNK])], "<u8")
                total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[row] = np.packbits(2 * total > n, bitorder="little").view("<u8")[0]
        return [out.view(np.int64)]

    return map_texts(docs, run, "fp long", id_column, text_column, as_bytes=True)


def _forest(prints: np.ndarray, most: int):
    """Links of a spanning forest of one bucket: each row is compared with all, found links are merged."""
    n = len(prints)
    root = np.arange(n)
    for i in range(n - 1):
        far = np.bitwise_count(prints[i + 1 :] ^ prints[i])
        near = (far <= most) & (far > 0) & (root[i + 1 :] != root[i])
        reached = np.nonzero(near)[0] + i + 1
        others, place = np.unique(root[reached], return_index=True)
        for other, j in zip(others.tolist(), reached[place].tolist()):
            yield i, j
        if len(others):
            root[np.isin(root, others)] = root[i]


def _links_of(batches, most):
    """Buckets are runs of equal (key, block) in sorted rows; a run may cross batches."""
    kept = None
    for batch in _with_end(batches):
        part = None if batch is None else [np.asarray(batch.column(k)) for k in range(3)]
        if kept is None:
            kept = part
        elif part is not None:
            kept = [np.concatenate([a, b]) for a, b in zip(kept, part)]
        if kept is None or not len(kept[0]):
            continue
        key, block, fp = kept
        change = np.nonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))[0] + 1
        bounds = np.concatenate([[0], change, [len(key)]])
        last = len(bounds) - 1 if batch is None else len(bounds) - 2
        first, second = [], []
        prints = fp.view(np.uint64)
        several = np.nonzero(np.diff(bounds[: last + 1]) > 1)[0]
        for s, e in zip(bounds[several].tolist(), bounds[several + 1].tolist()):
            for i, j in _forest(prints[s:e], most):
                first.append(fp[s + i])
                second.append(fp[s + j])
        kept = [x[bounds[last] :] for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def near_links(prints: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that hold the pairs within ``most`` bits together.

    Every pair within ``most`` bits ends up in one component; each link given is such a pair.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"the keys cover up to {MOST_BITS} bits")

    def emit(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for low in range(0, len(fp), 4096):
                part = fp[low : low + 4096]
                rows, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows])], names=["key", "fp"])

    # Each fingerprint makes some 30 rows: spread them before they are made.
    n = prints.count()
    parts = max(1, min(100_000, n // 4096 + 1))
    keyed = prints.select("fp").repartition(parts, "fp").mapInArrow(emit, "key long, fp long")
    # Buckets above the block size: counted by cells of the keys, so that few rows are shuffled. A
    # cell holds at least what its keys hold, so that no large bucket is missed.
    cells = 1 << max(10, (n // 8).bit_length())
    cell = F.pmod(F.xxhash64("key"), F.lit(cells)).alias("cell")
    large = write_and_reread(keyed.select(cell).groupBy("cell").count().where(F.col("count") > block)
                             .select("cell", F.ceil(F.col("count") / (block // 2)).cast("int").alias("blocks")), "cells")
    dealt = keyed.withColumn("block", F.lit(0))
    if large.head(1):
        # A row of a large cell goes to all pairs of blocks that its own block is part of.
        mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = keyed.withColumn("cell", cell).join(large, "cell", "left").withColumn("mine", F.coalesce(mine, F.lit(0)))
        dealt = dealt.select("key", "fp", "mine", other.alias("other"))
        dealt = dealt.select("key", "fp", (F.least("mine", "other") * 65_536 + F.greatest("mine", "other")).cast("int").alias("block"))
    buckets = dealt.select("key", "block", "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    return buckets.mapInArrow(lambda b: _links_of(b, most), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, most: int = MOST_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``fingerprint`` and ``component_id`` (smallest id reachable over links) of every row.

    Texts without words have the fingerprint zero and are linked like any other. Repeated rows are
    kept; rows with a null id are given the component of the rows they reach, null if there is none.
    Other columns are not read.
    """
    marked = write_and_reread(fingerprints(docs, size, id_column, text_column), "fingerprints")
    # Copies meet here: one row for each distinct fingerprint, combined before the shuffle.
    groups = write_and_reread(marked.groupBy("fp").agg(F.min(id_column).alias("least")), "prints")
    stars = connected(near_links(groups, most), "a", "b")
    rooted = groups.join(stars, groups["fp"] == stars["vertex"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op8_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
