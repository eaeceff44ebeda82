"""Ranked lexical search by the Best Position Algorithm over impact lists of document shards.

Every task holds a shard of the documents. It lays out, for each query term, the shard's documents by
falling impact, and runs the Best Position Algorithm for each item: documents met by sorted access are
looked up in all other lists (direct access), which marks their positions there as seen; a list's best
position is the end of its seen stretch from the top. No document that was not met yet can score more
than the sum of the impacts at the best positions, so the search stops once that sum is strictly below
the k-th score (strictly, because an equal score may win by its smaller id).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm.common import map_texts, query, table, words_of
from tabguard.session import write_and_reread

#: Text of the items that are searched in one pass over the documents; more items take more passes.
ITEM_BYTES = 8 << 20
#: Postings and documents of one shard, as held by a task at a time.
SHARD_POSTINGS = 1 << 21
SHARD_DOCS = 1 << 15
#: Positions read by sorted access in the first round; doubled each round up to the second figure.
FIRST_STRIDE, LAST_STRIDE = 16, 1024
#: Parts in which an item's best documents are ranked before the last ranking.
RANK_PARTS = 64
_FLOOR_EXACT = 1 << 62


def weight(n_docs: int, df: int) -> int:
    """floor(1000 * ln((2N + 2) / (2df + 1))) in doubles."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """10 + (90 * n * N) div L for each document, exact also where the product passes 64 bits."""
    if len(n) and 90 * int(n.max()) * n_docs >= _FLOOR_EXACT:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    return 10 + 90 * n.astype(np.int64) * n_docs // n_terms


class Shard:
    """Impact lists of one shard: for each term its documents, their impacts and their positions by falling impact."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        self.n_docs = n_docs
        #: Positions of each list that sorted access read in the last search.
        self.depth = 0
        by_term = np.lexsort((doc, term))
        self.doc, self.impact = doc[by_term], impact[by_term]
        term = term[by_term]
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        #: ``order[start + p]`` is the posting at position p of its list; ``position`` is the way back.
        self.order = np.lexsort((self.doc, -self.impact, term))
        self.position = np.empty(len(doc), dtype=np.int64)
        self.position[self.order] = np.arange(len(doc)) - np.repeat(self.start[:-1], np.diff(self.start))

    def best(self, terms, k: int, worst: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that may be among the ``k`` best, given that ``k`` score at least ``worst`` already (0: none known)."""
        lists = [(int(a), int(b)) for a, b in ((self.start[t], self.start[t + 1]) for t in terms) if b > a]
        if not lists:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        met = np.zeros(self.n_docs, dtype=bool)
        seen = [np.zeros(b - a + 1, dtype=bool) for a, b in lists]  # the last place is never seen
        best_position = [0] * len(lists)
        found_docs, found_scores, kth = [], [], worst
        top = np.empty(0, np.int64)
        depth, stride, longest = 0, FIRST_STRIDE, max(b - a for a, b in lists)
        while depth < longest:
            # Sorted access: the next stretch of every list.
            reached = np.unique(np.concatenate([self.doc[self.order[a + depth:min(b, a + depth + stride)]] for a, b in lists]))
            new = reached[~met[reached]]
            met[new] = True
            scores = np.zeros(len(new), dtype=np.int64)
            for (a, b), marks in zip(lists, seen):
                # Direct access: impact and position of the new documents in this list.
                at = np.minimum(np.searchsorted(self.doc[a:b], new), b - a - 1) + a
                held = self.doc[at] == new
                scores[held] += self.impact[at[held]]
                marks[self.position[at[held]]] = True
            possible = scores >= max(kth, 1)
            found_docs.append(new[possible])
            found_scores.append(scores[possible])
            top = np.concatenate([top, scores[possible]])
            if len(top) >= k:
                top = np.partition(top, len(top) - k)[-k:]
                kth = max(kth, int(top[0]))
            depth += stride
            stride = min(2 * stride, LAST_STRIDE)
            bound = 0
            for i, (a, b) in enumerate(lists):
                best_position[i] += int(np.argmin(seen[i][best_position[i]:]))
                if best_position[i] < b - a:
                    # At most the impact at the best position; nothing was seen of a list only where it is 0.
                    bound += int(self.impact[self.order[a + max(best_position[i] - 1, 0)]])
            if kth > 0 and bound < kth:
                break
        self.depth = depth
        return np.concatenate(found_docs), np.concatenate(found_scores)


class Best:
    """The ``k`` best documents of one item over the shards that a task has searched."""

    __slots__ = ("ids", "scores")

    def __init__(self):
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def worst(self, k: int) -> int:
        return int(self.scores[-1]) if len(self.scores) == k else 0

    def add(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        chosen = np.lexsort((ids, -scores))[:k]
        self.ids, self.scores = ids[chosen], scores[chosen]


def postings(docs: DataFrame, terms: dict[bytes, int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) for each row with at least one term: its length and its counts of the query terms."""

    def count(texts):
        lengths, held, counts = [], [], []
        for text in texts:
            words = words_of(text)
            tf: dict[int, int] = {}
            for t in map(terms.get, words):
                if t is not None:
                    tf[t] = tf.get(t, 0) + 1
            lengths.append(len(words))
            held.append(list(tf))
            counts.append(list(tf.values()))
        return [lengths, pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]

    return map_texts(docs, count, "n long, terms array<int>, tfs array<bigint>", id_column, text_column, as_bytes=True).where("n > 0")


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def search_shards(index: DataFrame, item_terms: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): for each item its ``k`` best documents of every task."""

    def search(batches):
        best = [Best() for _ in item_terms]

        def shard(held):
            ids = np.concatenate([h[0] for h in held])
            norms = length_norms(np.concatenate([h[1] for h in held]), n_docs, n_terms)
            doc = np.repeat(np.arange(len(ids)), np.concatenate([h[2] for h in held]))
            term = np.concatenate([h[3] for h in held]).astype(np.int64)
            tf = np.concatenate([h[4] for h in held])
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norms[doc]))
            some = impact > 0
            lists = Shard(doc[some], term[some], impact[some], len(weights), len(ids))
            for item, terms in zip(best, item_terms):
                docs, scores = lists.best(terms, k, item.worst(k))
                item.add(ids[docs], scores, k)

        held, size, rows = [], 0, 0
        for batch in batches:
            # Slices, so that a batch of any number of rows is cut into shards of bounded size.
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                columns = [part.column(i) for i in range(4)]
                sizes = columns[2].value_lengths().to_numpy(zero_copy_only=False)
                held.append((columns[0].to_numpy(zero_copy_only=False), columns[1].to_numpy(zero_copy_only=False), sizes, _flat(columns[2]), _flat(columns[3])))
                size, rows = size + int(sizes.sum()), rows + part.num_rows
                if size >= SHARD_POSTINGS or rows >= SHARD_DOCS:
                    shard(held)
                    held, size, rows = [], 0, 0
        if held:
            shard(held)
        for i, item in enumerate(best):
            if len(item.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item.ids), i, np.int32)), pa.array(item.ids), pa.array(item.scores)],
                                                 names=["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id long, score long")


def _item_blocks(items: DataFrame, id_column: str, text_column: str):
    """Blocks of (id, set of terms), ``ITEM_BYTES`` of text each; texts of one id are one item."""
    block, size, last, terms = [], 0, None, None
    chosen = items.select(F.col(id_column).cast("long").alias("i"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("t"))
    for row in chosen.orderBy("i").toLocalIterator():
        if terms is not None and row.i == last:
            terms.update(words_of(bytes(row.t)))
            continue
        if size >= ITEM_BYTES:
            yield block
            block, size = [], 0
        last, terms = row.i, set(words_of(bytes(row.t)))
        block.append((row.i, terms))
        size += len(row.t)
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0, equal scores by id.

    A row of ``docs`` is a document; rows that share an id are documents of their own. Null and empty
    texts have no terms and are not counted. Rows without an id count in the statistics and are never
    returned. Item rows that share an id (or have none) are one item, their terms joined; an item
    without terms, or whose terms stand nowhere, has no rows. Other columns are ignored.

    The documents are read once for each ``ITEM_BYTES`` of item texts: once to write the counts of
    the query terms, from which all statistics come, and the lists of a shard are built from that table.
    """
    spark = docs.sparkSession
    result = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in _item_blocks(items, item_id, text):
        terms = {t: n for n, t in enumerate(sorted(set().union(*(found for _, found in block))))}
        if not terms:
            continue
        index = write_and_reread(postings(docs, terms, doc_id, text), "postings")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(terms), dtype=np.int64)
        for term, held in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = held
        weights = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
        chosen = index.where(F.col(doc_id).isNotNull() & (F.size("terms") > 0)).select(F.col(doc_id).cast("long").alias("doc_id"), "n", "terms", "tfs")
        found = search_shards(chosen, [sorted(terms[t] for t in held) for _, held in block], weights, n_docs, n_terms, k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id long")
        result = result.unionByName(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    part = Window.partitionBy("item_id", "part").orderBy(F.desc("score"), "doc_id")
    whole = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (
        result.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS)))
        .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


@query(sql=r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents),
    lengths AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
    tf AS (SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY r, word),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
    items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
        FROM benchmark),
    scored AS (
        SELECT i.item_id, l.r, l.doc_id,
               CAST(sum(CAST(floor(1000 * ln((2 * t.docs + 2) / (2 * df.df + 1)::DOUBLE)) AS BIGINT)
                   * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * l.n * t.docs) // t.terms)))) AS BIGINT) AS score
        FROM items i JOIN df USING (word) JOIN tf USING (word) JOIN lengths l USING (r), totals t
        WHERE l.doc_id IS NOT NULL
        GROUP BY i.item_id, l.r, l.doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op11_ranked_search(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
