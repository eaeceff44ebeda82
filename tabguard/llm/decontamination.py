"""Benchmark decontamination: passages within a small edit distance (in words) of a benchmark item.

Windows of an item's size are embedded by the CGK random walk, which maps edit distance to Hamming
distance: a pointer runs over the words and moves on or stays by a random bit of step and word, and
the embedding is the word under the pointer at each step. Bit-sampling LSH takes a few places of the
embedding as a key, in as many independent repetitions as the target recall needs; that number is
measured for each item size on edited copies of all items of the size. Windows that meet an item
under a key are verified by their exact edit distance. Sizes that would need more than ``REPEATS``
repetitions, those without an edit and those above ``KEYED`` words have no keys: every window of
theirs is verified where at least the item's unedited words stand.

Windows are placed where they can matter: an item of ``n`` words with ``k`` edits has, cut into
``k + 1`` runs, at least one run untouched (pigeonhole), so every passage to be found holds one, and
the passage starts at most ``k`` words from where the run says. That loses nothing. The items are
broadcast in blocks of checked size.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import WORD_BYTES, filter_texts, query, small_batches, table, words_of

#: Share of edits that still counts as the same text (similarity 0.8), fewest words of an item. Below five words no edit is allowed.
EDITS, LEAST_WORDS = 0.2, 1
#: Places of an embedding in a key, wanted recall for passages at the largest distance, repetitions beyond which windows are verified without keys.
PLACES, RECALL, REPEATS = 3, 0.995, 48
#: Words of the longest items that get keys; longer ones hold more edits than keys survive.
KEYED = 512
#: Edited copies that measure the repetitions of a size, at least: as many of each item.
TRIALS = 1000
#: Repetitions that are measured at once.
ROUND = 8
#: Untouched runs whose windows are listed at once.
HITS = 1 << 14
#: Cells of the table that is held while regions are verified.
CELLS = 1 << 22
#: Bytes of item text in one broadcast; more items take more passes.
BLOCK_BYTES = 16 << 20
FOREIGN, END, BREAK = 0, -1, -2


@dataclass
class Runs:
    """Runs of one length: their sorted codes, and for each the places of windows, once for all items of a size with the run
    at the same word: rows (size, edits, word), from ``starts`` on as many as ``counts``. Items without keys are listed."""

    codes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    rows: np.ndarray
    direct: dict[int, list]


@dataclass
class Items:
    """Items of one block: word sequences over an own vocabulary, runs for placing windows, keys."""

    ids: list[list]
    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    edits: list[int]
    repeats: dict[int, int] = field(default_factory=dict)
    runs: dict[int, Runs] = field(default_factory=dict)
    places: dict = field(default_factory=dict)
    buckets: tuple = ()


def _bits(step: int, words: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """The random bit of each (repetition, step, word)."""
    x = (words + 3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= (repeats * 1_000_003 + step).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40) & np.uint64(1)).astype(np.int64)


def sampled(size: int, repeats: int) -> np.ndarray:
    """The sorted places of an embedding, one row for each repetition, that make its keys."""
    rng = np.random.default_rng(size)
    return np.sort(np.array([rng.choice(2 * size, PLACES, replace=False) for _ in range(repeats)]), axis=1)


def embedded_keys(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Keys of the windows flat[start:end], each in its repetition at its places; behind a window's end stands END."""
    at, key = starts.copy(), (repeats + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    taken = np.zeros(len(starts), np.int64)
    for step in range(int(places.max(initial=-1)) + 1):
        word = np.where(at < ends, flat[np.minimum(at, len(flat) - 1)], END)
        here = np.nonzero(places[np.arange(len(at)), np.minimum(taken, PLACES - 1)] == step)[0]
        key[here] = (key[here] ^ (word[here] + 5).astype(np.uint64)) * np.uint64(0x100000001B3)
        key[here] ^= key[here] >> np.uint64(29)
        taken[here] += 1
        at += np.where(at < ends, _bits(step, word, repeats), 0)
    return key


def edit_distances(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item (row) to any stretch of its region, and where that stretch ends."""
    n, width = regions.shape
    row = np.zeros((n, width + 1), np.int32)
    offset = np.arange(width + 1, dtype=np.int32)[None, :]
    for i in range(items.shape[1]):
        cost = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != items[:, i : i + 1]))
        cost = np.concatenate([np.full((n, 1), i + 1, np.int32), cost], axis=1)
        row = np.minimum.accumulate(cost - offset, axis=1) + offset
    best = row.argmin(axis=1)
    return row[np.arange(n), best], best


def build_items(rows: list[tuple]) -> Items:
    """``rows``: (id, text). Equal word sequences become one item with several ids; items without words are left out."""
    grouped = defaultdict(list)
    for item, text in rows:
        words = tuple(words_of((text or "").encode()))
        if len(words) >= LEAST_WORDS:
            grouped[words].append(item)
    vocabulary: dict[bytes, int] = {}
    for words in grouped:
        for word in words:
            vocabulary.setdefault(word, len(vocabulary) + 1)
    items = Items(list(grouped.values()), vocabulary, [np.array([vocabulary[w] for w in words], np.int64) for words in grouped], [int(EDITS * len(w)) for w in grouped])
    items.repeats = _repeats_needed(items)
    runs = defaultdict(lambda: defaultdict(set))
    for number, (words, k) in enumerate(zip(items.words, items.edits)):
        cuts = np.linspace(0, len(words), k + 2).astype(int)
        size = min(4, len(words) // (k + 1))
        for cut in cuts[:-1].tolist():
            runs[size][_code(words[cut : cut + size])].add((number, cut))
    for size, found in runs.items():
        items.runs[size] = _runs_of(found, items)
    if items.words:
        sizes = np.array([len(w) for w in items.words])
        starts = np.cumsum(sizes) - sizes
        keyed = np.isin(sizes, [n for n, count in items.repeats.items() if count])
        items.places = {n: sampled(n, count) for n, count in items.repeats.items() if count}
        key, window = _keys_of(np.concatenate(items.words), starts[keyed], (starts + sizes)[keyed], sizes[keyed], items)
        number = np.nonzero(keyed)[0][window]
        order = np.argsort(key, kind="stable")
        items.buckets = key[order], number[order]
    return items


def _keys_of(flat, starts, ends, sizes, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(key, window) of every window in every repetition."""
    keys, windows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    step = (1 << 18) // REPEATS
    for low in range(0, len(starts), step):
        part = slice(low, low + step)
        counts = np.array([len(items.places[k]) for k in sizes[part].tolist()])
        row = np.repeat(np.arange(len(counts)), counts)
        repeats = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = np.concatenate([items.places[k] for k in sizes[part].tolist()])
        salt = sizes[part][row].astype(np.uint64) << np.uint64(48)
        keys.append(embedded_keys(flat, starts[part][row], ends[part][row], places, repeats) ^ salt)
        windows.append(row + low)
    return np.concatenate(keys), np.concatenate(windows)


def _runs_of(found: dict[int, set], items: Items) -> Runs:
    codes, rows, counts, direct = sorted(found), [], [], {}
    for slot, code in enumerate(codes):
        keyed = {(len(items.words[i]), items.edits[i], cut) for i, cut in found[code] if items.repeats[len(items.words[i])]}
        others = sorted((i, cut) for i, cut in found[code] if not items.repeats[len(items.words[i])])
        rows += sorted(keyed)
        counts.append(len(keyed))
        if others:
            direct[slot] = others
    counts = np.array(counts, np.int64)
    return Runs(np.array(codes, np.uint64), np.cumsum(counts) - counts, counts, np.array(rows, np.int64).reshape(len(rows), 3), direct)


def _stretch(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _code(words: np.ndarray) -> int:
    code = len(words)
    for word in words.tolist():
        code = (code * 0x100000001B3 ^ word) & (1 << 64) - 1
    return code


def _repeats_needed(items: Items) -> dict[int, int]:
    """Repetitions by item size until edited copies, at the largest distance allowed, meet their item often enough; 0 if REPEATS are too few."""
    by_size = defaultdict(list)
    for words, k in zip(items.words, items.edits):
        by_size[len(words)].append((words, k))
    return {size: _repeats_of_size(size, held) for size, held in sorted(by_size.items())}


def _repeats_of_size(size: int, held: list[tuple]) -> int:
    if held[0][1] == 0 or size > KEYED:
        return 0
    rng = np.random.default_rng([5, size])
    whole, copies = [], []
    for words, k in held * -(-TRIALS // len(held)):
        copy = words.tolist()
        for _ in range(k):
            at, kind = int(rng.integers(len(copy))), int(rng.integers(3))
            copy[at : at + (kind != 0)] = [FOREIGN] if kind < 2 else []
        whole.append(words)
        copies.append(np.array(copy[:size], np.int64))
    open_, allowed = np.arange(len(whole)), int((1 - RECALL) * len(whole) + 1e-9)
    places = sampled(size, REPEATS)
    # Only copies that have not met their item yet go on to the next repetitions.
    for low in range(0, REPEATS, ROUND):
        high, left, still = min(low + ROUND, REPEATS), [], 0
        for part in np.array_split(open_, -(-len(open_) * size // CELLS)):
            both = [x[i] for x in (whole, copies) for i in part.tolist()]
            mine, theirs = np.split(_keys_in(low, high, both, places), 2)
            met = np.logical_or.accumulate(mine == theirs, axis=1)
            still, left = still + (~met).sum(axis=0), [*left, part[~met[:, -1]]]
        if still.min() <= allowed:
            return low + int(np.argmax(still <= allowed)) + 1
        open_ = np.concatenate(left)
    return 0


def _keys_in(low: int, high: int, texts: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Keys of whole texts, a row for each, in the repetitions from ``low`` to ``high``."""
    sizes = np.array([len(x) for x in texts])
    starts, n = np.cumsum(sizes) - sizes, high - low
    begins, repeats = np.repeat(starts, n), np.tile(np.arange(low, high), len(texts))
    return embedded_keys(np.concatenate(texts), begins, np.repeat(starts + sizes, n), places[repeats], repeats).reshape(len(texts), n)


def _windows(flat: np.ndarray, items: Items):
    """Around every untouched run: (starts, sizes) of the distinct windows of items with keys, (item, low, high) of the regions of the others."""
    known = flat > FOREIGN
    direct, asked, listed = set(), defaultdict(list), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size, runs in items.runs.items():
        n = len(flat) - size + 1
        if n <= 0:
            continue
        ok = known[:n].copy()
        for i in range(1, size):
            ok &= known[i : n + i]
        places = np.nonzero(ok)[0]
        code = np.full(len(places), size, np.uint64)
        for i in range(size):
            code = code * np.uint64(0x100000001B3) ^ flat[places + i].astype(np.uint64)
        slot = np.minimum(np.searchsorted(runs.codes, code), len(runs.codes) - 1)
        hit = runs.codes[slot] == code
        places, slot = places[hit], slot[hit]
        # A run that many items share asks for each size of window once, however many items there are.
        for low in range(0, len(places), HITS):
            some, at = slot[low : low + HITS], places[low : low + HITS]
            row = runs.rows[_stretch(runs.starts[some], runs.counts[some])]
            first = np.repeat(at, runs.counts[some]) - row[:, 2] - row[:, 1]
            for length in np.unique(row[:, 0]).tolist():
                same = row[:, 0] == length
                asked[length].append(np.unique(_stretch(first[same], 2 * row[same, 1] + 1)))
        if runs.direct:
            for place, s in zip(places.tolist(), slot.tolist()):
                for number, cut in runs.direct.get(s, ()):
                    k, n = items.edits[number], len(items.words[number])
                    direct.add((number, place, place - cut - k, place - cut + n + k))
    for length, starts in asked.items():
        starts = np.unique(np.concatenate(starts))
        listed.append((starts, np.full(len(starts), length)))
    return *(np.concatenate(x) for x in zip(*listed)), direct


def find_in_batch(texts: list[bytes], items: Items):
    """(text, item, last word, distance) of the best place of each item found in each text."""
    words = b" . ".join(t.translate(WORD_BYTES) for t in texts).split()  # no word holds a dot
    flat = np.fromiter(map((items.vocabulary | {b".": BREAK}).get, words, repeat(FOREIGN)), np.int64, len(words))
    breaks = np.nonzero(flat == BREAK)[0]
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(flat)]])
    best: dict[tuple, tuple] = {}
    starts, sizes, direct = _windows(flat, items)
    if not len(starts) and not direct:
        return []
    # A window belongs to the text that its middle stands in, and ends with it.
    own = np.searchsorted(first, np.clip(starts + sizes // 2, 0, len(flat) - 1), side="right") - 1
    begins, ends = np.maximum(starts, first[own]), np.minimum(starts + sizes, last[own])
    fit = ends > begins
    own, begins, ends, sizes = own[fit], begins[fit], ends[fit], sizes[fit]
    key, window = _keys_of(flat, begins, ends, sizes, items)
    keys, numbers = items.buckets
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    met = np.nonzero(high > low)[0]
    found = {(int(window[x]), int(i)) for x in met for i in numbers[low[x] : high[x]] if len(items.words[i]) == sizes[window[x]]}
    # (item, text, low, high): where each item may stand.
    spans = []
    for w, i in found:
        k, o = items.edits[i], int(own[w])
        spans.append((i, o, max(int(begins[w]) - k, int(first[o])), min(int(begins[w]) + int(sizes[w]) + k, int(last[o]))))
    for i, place, low, high in direct:
        o = int(np.searchsorted(first, place, side="right")) - 1
        spans.append((i, o, max(low, int(first[o])), min(high, int(last[o]))))
    by_size: dict[int, list] = defaultdict(list)
    for i, o, low, high in sorted(spans):
        # Windows of one text and item that lie close together are verified as one region.
        held, k, size = by_size[len(items.words[i])], items.edits[i], len(items.words[i])
        if held and held[-1][:2] == (i, o) and low <= held[-1][2] + 4 * k + 4 and high - held[-1][2] <= 3 * size:
            held[-1] = (i, o, held[-1][2], max(held[-1][3], high))
        else:
            held.append((i, o, low, high))
    for size, verify in sorted(by_size.items()):
        # Each edit takes away one word of the item at most, so the others must stand in the region.
        verify = [x for x in verify if items.repeats[size] or np.isin(items.words[x[0]], flat[x[2] : x[3]]).sum() >= size - items.edits[x[0]]]
        if not verify:
            continue
        step = max(1, min(2048, CELLS // max(high - low for *_, low, high in verify)))
        for part in range(0, len(verify), step):
            some = verify[part : part + step]
            width = max(high - low for *_, low, high in some)
            region = np.full((len(some), width), END, np.int64)
            for row, (_, _, low, high) in enumerate(some):
                region[row, : high - low] = flat[low:high]
            distance, end = edit_distances(np.array([items.words[i] for i, *_ in some]), region)
            for (i, o, low, high), d, e in zip(some, distance.tolist(), end.tolist()):
                if d <= items.edits[i]:
                    place = (d, low + min(e, high - low) - 1 - int(first[o]))
                    best[o, i] = min(best.get((o, i), place), place)
    return [(o, i, place, d) for (o, i), (d, place) in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_column: str, text_column: str):
    """Broadcasts of the items in blocks of checked size, with a token that names each."""
    rows = benchmark.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    spark = benchmark.sparkSession
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).orderBy("i", "t")
        listed = [(r.i, r.t) for r in part.collect()]
        yield spark.sparkContext.broadcast(build_items(listed))


def find_passages(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  item_text_column: str = "text") -> DataFrame:
    """One row for each document and item found in it: ``distance`` (edits in words) and ``last_word`` of the best place.

    Null and empty texts and items without a word find nothing; items of fewer than five words are found
    where they stand unchanged. Items with equal words are
    reported under each of their ids, repeated documents each, null ids as null. No rows without items.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    kind, item_type = chosen.schema["id"].dataType.simpleString(), benchmark.schema[item_column].dataType
    item_kind = item_type.simpleString()
    out = None
    for sent in _blocks(benchmark, item_column, item_text_column):

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                found = [(o, item, place, d) for o, i, place, d in find_in_batch(texts, items) for item in items.ids[i]] if items.words else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([o for o, *_ in found], pa.int64())), pa.array([x[1] for x in found], batch_type),
                     pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int32())], names=["id", "item", "last_word", "distance"])

        from pyspark.sql.pandas.types import to_arrow_type

        batch_type = to_arrow_type(item_type)
        part = chosen.mapInArrow(run, f"id {kind}, item {item_kind}, last_word long, distance int")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_column), F.col("item").alias("item_id"), "distance", "last_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, without those that hold a passage of an item."""
    for sent in _blocks(benchmark, "item_id", "text"):

        def keep(texts, sent=sent):
            items = sent.value
            bad = {o for o, *_ in find_in_batch([t.encode() for t in texts], items)} if items.words else ()
            return [i not in bad for i in range(len(texts))]

        docs = filter_texts(docs, keep, text_column)
    return docs


@query()
def op10_decontamination(spark, sf_dir):
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
