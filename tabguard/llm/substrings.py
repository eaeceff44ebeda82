"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text. A chunk ends where the hash is the least within a window
around it, which depends on nearby bytes alone, so that chunks fall into step again soon after an
insertion. Each chunk is compared together with the one behind it, by a 96-bit digest of the two over
the whole corpus, so that neighbours in a repeated passage are neighbours at its other place too. Runs
of pairs that stand in two places or more, of other documents or the same, make a repeated passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm.common import query, small_batches, table

#: Bytes on either side among which a cut's hash is the least, and the longest chunk (periodic texts).
NEAR, LONGEST = 16, 2048
#: Words of a repeated passage, counted over whole chunks: passages of 50 words and more have as many at any offset.
LEAST_WORDS = 25
#: Bytes that count as a word where fewer blanks stand: scripts without blanks, code, encoded blocks.
WORD_LENGTH = 8
#: Bytes that the rolling hash covers: 2 to the power of its doubling steps.
DOUBLINGS = 4


def gear_table() -> np.ndarray:
    """A random number for each byte value."""
    return np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, gear: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Ends of the chunks of one text, its length included; never inside a character."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # h[i] = sum of gear[byte i - j] << j: doubling the covered bytes in each step.
    h = gear[data]
    for step in range(DOUBLINGS):
        reach = 1 << step
        rolled = h.copy()
        rolled[reach:] += h[:-reach] << np.uint32(reach) if n > reach else 0
        h = rolled
    least = h  # of h[i : i + covered], by doubling
    covered = 1
    while covered < near:
        by = min(covered, near - covered)
        wider = least.copy()
        if n > by:
            wider[:-by] = np.minimum(least[:-by], least[by:])
        least, covered = wider, covered + by
    ok = np.zeros(n, bool)
    if n > 2 * near:
        middle = slice(near, n - near)
        # Least of the bytes before must be larger, of those behind not smaller: of equal ones the first.
        ok[middle] = (h[middle] < least[: n - 2 * near]) & (h[middle] <= least[near + 1 : n - near + 1])
        ok[:-1] &= (data[1:] & 0xC0) != 0x80
    ends = np.append(np.nonzero(ok)[0] + 1, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= LONGEST:
        return ends
    out = []
    start = 0
    for end in ends.tolist():
        while end - start > LONGEST:
            start += LONGEST
            while data[start] & 0xC0 == 0x80:
                start -= 1
            out.append(start)
        out.append(end)
        start = end
    return np.array(out, np.int64)


def chunk_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each chunk of every text and the chunk behind it (none behind the last): ``a`` and ``b``, the digest of
    both; id; ``start`` in code points; ``size`` and ``words`` of the chunk and, from bit 16 on, of the next one.

    These rows are what is shuffled: narrow columns, since there is one for every 30 bytes of text.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("t")).where("doc is not null and t is not null")
    kind = chosen.schema["doc"].dataType.simpleString()

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        gear = gear_table()
        blank = np.zeros(256, np.int32)
        blank[[9, 10, 11, 12, 13, 32]] = 1
        for batch in batches:
            digests, rows, parts = [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                data = np.frombuffer(text, np.uint8)
                ends = cuts(data, gear)
                if not len(ends):
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                behind = np.append(ends[1:], n := len(data))
                # Where the first chunk ends is part of the digest; the last chunk stands alone.
                digests += [digest(text[s:t], (e - s) << 1 | (e == n)) for s, e, t in zip(starts.tolist(), ends.tolist(), behind.tolist())]
                places = np.cumsum((data & 0xC0) != 0x80)
                place = places[ends - 1]
                # A word belongs to the chunk that holds the blank behind it.
                words = np.add.reduceat(blank[data] & ~np.append(blank[data[1:]], 0), starts)
                words = np.maximum(words, (ends - starts) // WORD_LENGTH)
                rows.append(np.full(len(ends), row))
                sizes = np.diff(place, prepend=0)
                first = np.concatenate([[0], place[:-1]])
                parts.append(np.stack([first, sizes | np.append(sizes[1:], 0) << 16, words | np.append(words[1:], 0) << 16]))
            if not rows:
                continue
            pairs = np.frombuffer(b"".join(digests), [("a", "<i8"), ("b", "<i4"), ("rest", "<i4")])
            start, size, words = np.concatenate(parts, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs["a"].copy()), pa.array(pairs["b"].copy()), batch.column(0).take(pa.array(np.concatenate(rows))),
                 pa.array(start), pa.array(size), pa.array(words)], names=["a", "b", "doc", "start", "size", "words"])

    return chosen.mapInArrow(run, f"a long, b int, doc {kind}, start int, size int, words int")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document with a passage that stands in two places or more, in other documents or in this one.

    ``n_passages``, ``n_words`` in them, ``passages`` (start:end in code points, comma-joined),
    ``dropped`` (those parts of them that stand earlier, in a smaller document or before in this one: what
    deduplication removes) and ``first_doc``, the smallest document that has any of it. Passages are whole
    chunks: their ends lie up to a chunk inside what is repeated. A chunk counts a word for each
    eight bytes at least, so that texts without blanks have words too. Null ids or texts and empty
    texts have no row, rows of the same id are one document, whose equal rows count once.
    """
    chunks = chunk_rows(docs, id_column, text_column)
    place = F.struct("doc", "start")
    # Copies of a pair meet after a map-side minimum, whatever their number.
    seen = chunks.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = seen.where(F.col("first") != F.col("last")).select("a", "b", "first")
    # One row a pair against all its places: the side with many places is dealt out by the skew join.
    hit = chunks.join(shared, ["a", "b"]).select("doc", "start", "size", "words", F.col("first.doc").alias("first_doc"), (F.col("first") != place).alias("later"))
    size, words = F.col("size").bitwiseAND(0xFFFF), F.col("words").bitwiseAND(0xFFFF)
    hit = hit.dropDuplicates(["doc", "start"]).select(
        "doc", "start", (F.col("start") + size).alias("middle"), (F.col("start") + size + F.shiftrightunsigned("size", 16)).alias("end"),
        words.alias("words"), F.shiftrightunsigned("words", 16).alias("next_words"), "first_doc", "later")
    in_doc = Window.partitionBy("doc").orderBy("start")
    # A run goes on where the next pair starts with this one's second chunk.
    goes_on = F.col("start") == F.lag("middle").over(in_doc)
    cut = (~F.coalesce(goes_on, F.lit(False))).cast("int")
    turn = (~F.coalesce(goes_on & (F.col("later") == F.lag("later").over(in_doc)), F.lit(False))).cast("int")
    numbered = hit.withColumn("cut", cut).withColumn("turn", turn).withColumn("run", F.sum("cut").over(in_doc)).withColumn("part", F.sum("turn").over(in_doc))
    last_words = F.max_by("next_words", "start")
    stretches = numbered.groupBy("doc", "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), last_words.alias("last_words"),
        F.min("first_doc").alias("first_doc"), F.first("later").alias("later"))
    passages = stretches.groupBy("doc", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("words") + F.max_by("last_words", "start")).alias("words"), F.min("first_doc").alias("first_doc"),
        F.sort_array(F.collect_list(F.when(F.col("later"), F.struct("start", "end")))).alias("gone")).where(F.col("words") >= least_words)
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return passages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum("words").alias("n_words"), text(F.sort_array(F.collect_list(F.struct("start", "end")))).alias("passages"),
        text(F.array_sort(F.flatten(F.collect_list("gone")))).alias("dropped"), F.min("first_doc").alias("first_doc")).withColumnRenamed("doc", id_column)


@query()
def op6_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
