"""Page corpus: ingest, statistics, ranked search, search log and highlight segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.plans.lookups import lookup_join
from tabguard.plans.ordered import PIECE_ROWS, previous_in_groups
from tabguard.schema import c
from tabguard.session import write_and_reread

MIN_PAGE_CHARS = 50
# Usual constants of the BM25 ranking.
BM25_K1, BM25_B = 1.2, 0.75
EMPTY_CORPUS = "The corpus holds no pages yet."


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_counts(words: Column) -> Column:
    """``(term, tf)`` of each distinct word, inside the row: the words sorted, and the places where another one starts."""
    ordered = F.array_sort(words)
    starts = lambda held: F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
    runs = lambda held, at: F.transform(at, lambda i, j: F.struct(
        F.get(held, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(held)) - i).cast("long").alias("tf")))
    # A transform over one element evaluates the inner column once.
    counted = F.transform(F.array(ordered), lambda held: F.get(F.transform(F.array(starts(held)), lambda at: runs(held, at)), F.lit(0)))
    return F.when(F.size(words) > 0, F.get(counted, F.lit(0)))


def ingest_pages(documents: DataFrame, separator: str = "\f") -> DataFrame:
    """``(filename, text)`` -> ``(filename, page_number, text)``: pages from 1, trimmed, only those over 50 characters."""
    pages = documents.select("filename", F.posexplode(F.split("text", separator)).alias("at", "raw"))
    return pages.select("filename", (F.col("at") + 1).alias("page_number"), strip(F.col("raw")).alias("text")).filter(
        F.length("text") > MIN_PAGE_CHARS
    )


def corpus_statistics(pages: DataFrame) -> DataFrame:
    """One row: distinct files and pages; zeros for an empty corpus."""
    files = pages.groupBy("filename").agg(F.count(F.lit(1)).alias("pages"))
    return files.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"))


def corpus_files(pages: DataFrame) -> DataFrame:
    """The file list with the pages of each, as rows: a list of all files would be one unbounded value."""
    return pages.groupBy("filename").agg(F.count(F.lit(1)).alias("pages"))


def _frequency(column: str, term: str) -> Column:
    return F.size(F.filter(column, lambda t: t == F.lit(term)))


def search_pages(pages: DataFrame, question: str, top_k: int = 5) -> DataFrame:
    """The ``top_k`` pages by BM25 with a score from 0 to 1 relative to the best, and their full text.

    Only the terms of the question matter, so a page shrinks to its length and a few counts. That
    narrow table is written once; the corpus figures and the ranking come from it without another
    look at the texts, which are fetched for the ``top_k`` winners only. Nothing is shuffled but those.
    """
    terms = sorted(set(pages.sparkSession.range(1).select(tokens(F.lit(question))).first()[0]))
    schema = "rank int, filename string, page_number int, score double, text string"
    if not terms:
        return pages.sparkSession.createDataFrame([], schema)
    # explode(array(x)) evaluates x once per page; as a plain column it would be copied into every use.
    page = pages.select("filename", "page_number", F.explode(F.array(tokens(F.col("text")))).alias("_tokens"))
    asked = page.select(
        "filename", "page_number", F.size("_tokens").alias("_length"),
        F.explode(F.array(F.filter("_tokens", lambda t: t.isin(*terms)))).alias("_asked"),
    )
    counted = write_and_reread(asked.select(
        "filename", "page_number", "_length", *[_frequency("_asked", term).alias(f"_tf{i}") for i, term in enumerate(terms)],
    ), "page-counts")
    corpus = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_length").alias("mean"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    if not corpus["n"]:
        return pages.sparkSession.createDataFrame([], schema)
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B / (corpus["mean"] or 1.0)) * F.col("_length"))
    score = F.lit(0.0)
    for i in range(len(terms)):
        found = F.lit(float(corpus[f"df{i}"]))
        weight = F.log(F.lit(1.0) + (F.lit(float(corpus["n"])) - found + 0.5) / (found + 0.5))
        tf = F.col(f"_tf{i}")
        score = score + weight * tf * F.lit(BM25_K1 + 1) / (tf + norm)
    best = (
        counted.withColumn("_score", score).filter(F.col("_score") > 0)
        .orderBy(F.round("_score", 9).desc(), "filename", "page_number").limit(top_k)
    )
    return _with_texts(pages, best.select("filename", "page_number", "_score"))


def _with_texts(pages: DataFrame, best: DataFrame) -> DataFrame:
    """Rank, relative score and text of the few pages in ``best`` (best first)."""
    winners = best.collect()
    if not winners:
        return pages.sparkSession.createDataFrame([], "rank int, filename string, page_number int, score double, text string")
    ranked = pages.sparkSession.createDataFrame(
        [(i + 1, r["filename"], r["page_number"], r["_score"] / winners[0]["_score"]) for i, r in enumerate(winners)],
        "rank int, filename string, page_number int, score double",
    )
    # The literal list of files reaches the scan of a stored corpus; the join has top_k rows on one side.
    texts = pages.filter(F.col("filename").isin(*{r["filename"] for r in winners}))
    texts = texts.select("filename", F.col("page_number").cast("int").alias("page_number"), "text")
    return texts.join(F.broadcast(ranked), ["filename", "page_number"]).select("rank", "filename", "page_number", "score", "text")


def build_index(pages: DataFrame, path: str, buckets: int = 256) -> None:
    """The search index of ``pages`` below ``path``: postings by term, and the corpus figures.

    Postings lie in folders by a hash of the term, sorted by term inside a file, so that a search
    reads the files of its terms only. A folder with very many rows is written by several tasks.
    Rows that repeat a page are pages of their own, whose scores a search adds up.
    """
    page = pages.select("filename", F.col("page_number").cast("int").alias("page_number"), F.explode(F.array(tokens(F.col("text")))).alias("_tokens"))
    sized = page.select("filename", "page_number", F.size("_tokens").alias("length"), "_tokens")
    # A page is one row, so its terms are counted there: only the finished postings are shuffled.
    counted = sized.select("filename", "page_number", "length", F.inline(term_counts(F.col("_tokens"))))
    placed = counted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    figures = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.lit(buckets).alias("buckets"))
    figures.coalesce(1).write.parquet(f"{path}/figures")


def search_index(pages: DataFrame, path: str, question: str, top_k: int = 5) -> DataFrame:
    """As :func:`search_pages`, from an index of the same pages: only the postings of the question's terms are read."""
    spark = pages.sparkSession
    asked = sorted(set(spark.range(1).select(tokens(F.lit(question))).first()[0]))
    corpus = spark.read.parquet(f"{path}/figures").first()
    if not asked or not corpus["n"]:
        return spark.createDataFrame([], "rank int, filename string, page_number int, score double, text string")
    places = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "term string").select(
        F.pmod(F.xxhash64("term"), F.lit(corpus["buckets"])).cast("int")).distinct().collect()]
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*places) & F.col("term").isin(*asked))
    found = {r["term"]: r["df"] for r in postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    if not found:
        return spark.createDataFrame([], "rank int, filename string, page_number int, score double, text string")
    weights = F.create_map(*[F.lit(x) for t, df in found.items() for x in (t, math.log(1.0 + (corpus["n"] - df + 0.5) / (df + 0.5)))])
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B / (corpus["mean"] or 1.0)) * F.col("length"))
    score = F.sum(weights[F.col("term")] * F.col("tf") * F.lit(BM25_K1 + 1) / (F.col("tf") + norm))
    best = postings.groupBy("filename", "page_number").agg(score.alias("_score"))
    return _with_texts(pages, best.orderBy(F.round("_score", 9).desc(), "filename", "page_number").limit(top_k))


def search_message(pages: DataFrame) -> str | None:
    """The answer to a search in an empty corpus."""
    return EMPTY_CORPUS if pages.isEmpty() else None


def nearest_vectors(vectors: DataFrame, query: list[float], top_k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``top_k`` vectors by cosine, ties by key; one scan that keeps ``top_k`` rows per task."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(c(column), wanted, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(c(column), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) * float(x) for x in query) ** 0.5
    scored = vectors.select(c(key), F.coalesce(F.try_divide(dot, norm * F.lit(length)), F.lit(0.0)).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), c(key)).limit(top_k)


def log_search(searches: DataFrame, question: str, timestamp: str, top_k: int = 5) -> DataFrame:
    """The search log with one more entry."""
    entry = searches.sparkSession.createDataFrame([(question, timestamp, top_k)], "query string, timestamp string, top_k int")
    typed = entry.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in searches.schema])
    return searches.unionByName(typed)


def search_history(searches: DataFrame) -> DataFrame:
    """The search log ``(query, timestamp, top_k)``, newest first."""
    return searches.orderBy(F.desc("timestamp"), "query")


def highlight_segments(documents: DataFrame, highlights: DataFrame, piece_rows: int = PIECE_ROWS, share: int = 10_000) -> DataFrame:
    """Cut every ``(doc_id, text)`` at its highlights ``(doc_id, highlight_id, start, end, color, comment)``.

    Rows ``(doc_id, position, part, text, color, comment)`` in order of (position, part): plain gaps,
    marked slices, and the tail. Overlapping slices are kept whole; a gap exists only where a slice
    starts behind the end of the one before it. Offsets count from 0.
    """
    order = ["start", "highlight_id"]
    chained = previous_in_groups(highlights, ["doc_id"], order, F.col("end"), "before", piece_rows)
    chained = chained.withColumn("before", F.coalesce("before", F.lit(0)))
    # Each part is a pair of offsets; texts are joined last, and only their slices travel on.
    gap = F.when(
        F.col("start") > F.col("before"),
        F.struct(F.lit(0).alias("part"), F.col("before").alias("position"), F.col("before").alias("from"), F.col("start").alias("to"),
                 F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("comment"), F.col("highlight_id")),
    )
    mark = F.struct(F.lit(1).alias("part"), F.col("start").alias("position"), F.col("start").alias("from"), F.col("end").alias("to"),
                    "color", "comment", F.col("highlight_id"))
    parts = chained.select("doc_id", F.inline(F.array_compact(F.array(gap, mark))))
    marked = highlights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("marks"), F.max_by("end", F.struct(*order)).alias("last_end")
    )
    # Documents with many highlights are copied once per ``share`` of them, and their parts spread over the copies.
    sized = lookup_join(parts, marked, ["doc_id"], "marks", ["marks"])
    copies = F.ceil(F.col("marks") / F.lit(share)).cast("int")
    placed = sized.withColumn("_copy", F.pmod(F.xxhash64("highlight_id", "part"), copies).cast("int")).drop("marks")
    texts = documents.join(marked, "doc_id", "left")
    spread = texts.filter(F.col("marks").isNotNull()).withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    cut = placed.join(spread.select("doc_id", "_copy", F.col("text").alias("_text")), ["doc_id", "_copy"]).select(
        "doc_id", "position", "part",
        F.substring("_text", F.col("from") + 1, F.greatest(F.col("to") - F.col("from"), F.lit(0))).alias("text"), "color", "comment",
    )
    last = F.coalesce("last_end", F.lit(0))
    tail = texts.filter((last < F.length("text")) | F.col("last_end").isNull()).select(
        "doc_id", last.alias("position"), F.lit(2).alias("part"), F.substring("text", last + 1, F.length("text")).alias("text"),
        F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("comment"),
    )
    return cut.unionByName(tail)
