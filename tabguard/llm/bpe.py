"""Byte-level BPE: encoding by numpy matrices of equal-length pre-tokens, and decoding.

Pre-tokens that a worker has not met yet are grouped by length and become the rows of matrices of
token ids. In each round every row merges its leftmost pair of minimum rank; pairs are looked up in a
sorted array of hashed pairs, the gap is closed by compaction, and rows without a pair are done.
Known pre-tokens come from a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from tabguard.llm.common import map_texts, query, table, worker_state

#: Words that a worker remembers, how many of the first it keeps when that is full, and the longest in characters.
CACHED, KEPT, LONGEST = 500_000, 150_000, 64
#: Cells of one matrix.
CELLS = 1 << 20
#: A blank that may stand inside a pre-token: other white space before it, and white space or the end behind it.
INNER_BLANK = re.compile(r" (?<=[^\S ] )(?:\s|\Z)")
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each rank, in order."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without a gap")
    return [found[i] for i in range(len(found))]


class PairTable:
    """Rank of the token that two neighbours form, by open addressing over a hash of both ids."""

    def __init__(self, vocabulary: list[bytes]):
        rank = {token: i for i, token in enumerate(vocabulary)}
        keys, ranks = [], []
        for token, i in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(i)
        self.mask = (1 << (max(2, 4 * len(keys)) - 1).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, NONE, np.int32)
        keys, ranks = np.array(keys, np.int64), np.array(ranks, np.int32)
        slots, self.probes = self.slot(keys), 1
        while len(keys):
            # Of the keys that want a free slot, the first gets it; the others try the next one.
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], ranks[won]
            keys, ranks, slots = keys[~won], ranks[~won], (slots[~won] + 1) & self.mask
            self.probes += bool(len(keys))

    def slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, left, right):
        """Ranks of the pairs, NONE where they form no token; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self.slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], NONE)
        open_ = np.nonzero((held != keys) & (held != -1) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_[0]):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[tuple(x[hit] for x in open_)] = self.ranks[slots[tuple(x[hit] for x in open_)]]
            open_ = tuple(x[~hit & (held != -1)] for x in open_)
        out[right < 0] = NONE
        return out


class Coder:
    """Encodes pre-tokens in bulk and remembers whole words."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.rank = {token: i for i, token in enumerate(vocabulary)}
        self.pairs = PairTable(vocabulary)
        self.split = regex.compile(pattern).findall
        self.byte_rank = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte_rank < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.words: dict[str, bytes] = {}

    def merge_rows(self, rows):
        """Merge the rows of a padded matrix (-1 behind the last id) to the end; returns ids and counts."""
        n, width = rows.shape
        done = np.full((n, width), -1, np.int32)
        live, index = rows, np.arange(n)
        while True:
            ranks = self.pairs.find(live[:, :-1], live[:, 1:]) if live.shape[1] > 1 else np.full((len(live), 1), NONE, np.int32)
            best = ranks.argmin(axis=1)  # the first of equal ranks is the leftmost
            at = np.arange(len(live))
            least = ranks[at, best]
            over = least == NONE
            if over.any():
                done[index[over], : live.shape[1]] = live[over]
                keep = ~over
                live, index, best, least = live[keep], index[keep], best[keep], least[keep]
            if not len(live):
                return done, (done >= 0).sum(axis=1)
            # Compaction: what stands behind the merged pair moves one place to the left.
            columns = np.arange(live.shape[1] - 1)[None, :]
            shifted = np.take_along_axis(live, columns + (columns > best[:, None]), axis=1)
            shifted[np.arange(len(live)), best] = least
            live = shifted

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each distinct piece as little-endian 32-bit integers."""
        out = {}
        by_length: dict[int, list[bytes]] = {}
        for piece in pieces:
            whole = self.rank.get(piece)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(piece) > CELLS >> 6:
                out[piece] = self.encode_long(piece)
            else:
                by_length.setdefault((len(piece) + 3) & ~3, []).append(piece)
        for width, group in by_length.items():
            step = max(1, CELLS // width)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in part), np.uint8).reshape(len(part), width)
                sizes = np.array([len(p) for p in part])
                rows = np.where(np.arange(width)[None, :] < sizes[:, None], self.byte_rank[raw], -1).astype(np.int32)
                ids, counts = self.merge_rows(rows)
                ends = np.cumsum(counts)
                flat = ids[ids >= 0].astype("<u4").tobytes()
                for piece, start_id, end in zip(part, (ends - counts).tolist(), ends.tolist()):
                    out[piece] = flat[4 * start_id : 4 * end]
        return out

    def encode_long(self, piece: bytes) -> bytes:
        """A piece too long for a matrix: the same merges, least rank and then leftmost first, from a heap."""
        import heapq

        ids = self.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        rank_of = self.rank
        name = self.vocabulary
        pair = lambda i, j: rank_of.get(name[ids[i]] + name[ids[j]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pair(i, after[i])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := pair(before[i], i)) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def encode_units(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units, each split by the pattern by itself."""
        split = {unit: [p.encode() for p in self.split(unit)] for unit in units}
        known = self.encode_pieces(list({p for pieces in split.values() for p in pieces}))
        return {unit: known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces]) for unit, pieces in split.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        Without two blanks in a row and without a blank inside other white space, a blank always opens
        a pre-token, so that a text falls into words with the blank before them; other texts are split
        by the pattern as a whole.
        """
        if len(self.words) > CACHED:
            self.words = dict(islice(self.words.items(), KEPT))  # the first met are the frequent ones
        search = INNER_BLANK.search
        parts = [[] if not t else t.replace(" ", "\0 ").split("\0") if "  " not in t and "\0" not in t and not search(t) else self.split(t) for t in texts]
        known = self.words
        missing = set().union(*parts).difference(known)
        own = self.encode_units(missing) if missing else {}
        known.update((k, v) for k, v in own.items() if len(k) <= LONGEST)
        long = {k: v for k, v in own.items() if len(k) > LONGEST}
        if long:
            return [b"".join([known[p] if p in known else long[p] for p in words]) for words in parts]
        return [b"".join(map(known.__getitem__, words)) for words in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(sent):
    ranks, pattern, digest = sent.value
    return worker_state(("bpe", digest, pattern), lambda: Coder(ranks, pattern))


def _send(docs: DataFrame, ranks_path: str, pattern: str):
    ranks = read_ranks(ranks_path)
    # Names the vocabulary in workers that live on: many vocabularies start alike.
    digest = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in ranks)).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((ranks, pattern, digest))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The token ids of every row's whole text: ``ids`` (array), ``n_tokens``.

    Null and empty texts have no ids. Repeated rows are encoded each; other columns are not read.
    Special tokens are ordinary text. An empty table gives no rows.
    """
    sent = _send(docs, ranks_path, pattern)

    def encode(texts):
        found = [np.frombuffer(x, "<u4").astype(np.int32) for x in _coder(sent).encode(texts)]
        return found, [len(x) for x in found]

    return map_texts(docs, encode, "ids array<int>, n_tokens long", id_column, text_column)


def decode_documents(encoded: DataFrame, ranks_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The bytes that ``ids`` stand for, as ``decoded`` (binary); null ids give no bytes, unknown ids raise an error."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    sent = _send(encoded, ranks_path, "")
    chosen = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("i"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        vocabulary = sent.value[0]
        for batch in batches:
            out = [b"".join([vocabulary[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    return chosen.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass; returns counts and digests of ids and decoded bytes."""
    sent = _send(docs, ranks_path, pattern)

    def run(texts):
        coder = _coder(sent)
        ids = coder.encode(texts)
        return ([len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids])

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_column, text_column)


@query()
def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
