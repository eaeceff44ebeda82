"""Ranked page search over blocks of postings with score bounds, in appended segments with tombstones.

An index lies below a path. ``segments/v=<n>`` holds what commit ``n`` appended: ``pages`` (id, block, name,
length, distinct terms) and ``postings`` (one row a term and block of pages, in folders by a hash of the
term, with the largest count and least length in the block). ``removed/v=<n>`` names pages that commit ``n``
took out, and how many of them held each term. ``manifest/version=<n>`` lists the live commits and the corpus
figures; it is written last, so a broken commit is never read, and fails where another one took its number.

All terms share the borders of blocks, so the bounds of the asked terms add up to a bound for every page of
a block. A search scores the blocks with the largest bounds first and reads another block only where its
bound reaches the last score found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.operators.corpus import BM25_B, BM25_K1, _with_texts, term_counts, tokens
from tabguard.session import write_and_reread

#: Folders of a segment's postings, and pages of a block as a power of two.
BUCKETS, BLOCK_BITS = 64, 10
#: Blocks that the first look of a search scores.
PROBED = 16
_MANIFEST = "segments array<int>, removals array<int>, pages long, words long"
_PAGES = "page long, block long, filename string, page_number int, length int, terms array<string>"
_POSTINGS = "term string, block long, n long, top long, least int, held array<struct<page:long,tf:long,length:int>>, bucket int"


@dataclass(frozen=True)
class BlockIndex:
    """Pages ``(filename, page_number, text)``. Null texts have no terms but count as pages; repeated pages are pages each."""

    spark: SparkSession
    path: str
    block_bits: int = BLOCK_BITS

    # --- commits

    def _manifest(self):
        found = self.spark.read.schema(_MANIFEST + ", version int").json(f"{self.path}/manifest")
        return found.orderBy(F.desc("version")).first()

    def _publish(self, version: int, segments: list[int], removals: list[int], pages: int, words: int) -> None:
        row = self.spark.createDataFrame([(segments, removals, pages, words)], _MANIFEST)
        row.coalesce(1).write.mode("error").json(f"{self.path}/manifest/version={version}")

    def create(self) -> None:
        """An index without pages."""
        self._publish(0, [], [], 0, 0)

    def append(self, pages: DataFrame) -> None:
        """One more segment; the others are not read."""
        last = self._manifest()
        version = last["version"] + 1
        words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
        sized = pages.select("filename", F.col("page_number").cast("int").alias("page_number"), F.explode(F.array(words)).alias("words"))
        # Numbers are fixed by the written table; everything else is made from it.
        numbered = write_and_reread(sized.withColumn("page", F.monotonically_increasing_id()), "numbered-pages")
        numbered = numbered.withColumn("block", F.shiftright("page", self.block_bits)).withColumn("length", F.size("words"))
        place = f"{self.path}/segments/v={version}"
        numbered.select("page", "block", "filename", "page_number", "length", F.array_distinct("words").alias("terms")).write.mode("error").parquet(f"{place}/pages")
        # One shuffle serves the counts of a block and the folders: by bucket, and by block, so that no bucket is one task's.
        spread = max(1, math.ceil(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) / BUCKETS))
        counted = numbered.select("page", "block", "length", F.inline(term_counts(F.col("words")))).withColumn(
            "bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(spread)))
        # A list holds a block's pages at most, however frequent the term is.
        blocks = counted.repartition("bucket", "part").groupBy("bucket", "part", "term", "block").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("top"), F.min("length").alias("least"), F.collect_list(F.struct("page", "tf", "length")).alias("held"))
        blocks.drop("part").sortWithinPartitions("bucket", "term", "block").write.mode("error").partitionBy("bucket").parquet(f"{place}/postings")
        figures = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        self._publish(version, [*last["segments"], version], list(last["removals"]), last["pages"] + figures["n"], last["words"] + figures["words"])

    def delete(self, names: DataFrame) -> None:
        """Take out all live pages with the ``(filename, page_number)`` of ``names``; no segment is written again."""
        last = self._manifest()
        version = last["version"] + 1
        wanted = names.select("filename", F.col("page_number").cast("int").alias("page_number")).distinct()
        gone = self._live_pages(last).join(wanted, ["filename", "page_number"], "left_semi")
        gone = write_and_reread(gone.select("segment", "page", "block", "length", "terms"), "removed-pages")
        place = f"{self.path}/removed/v={version}"
        gone.select("segment", "page", "block").write.mode("error").parquet(f"{place}/pages")
        gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).write.mode("error").parquet(f"{place}/terms")
        figures = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        self._publish(version, list(last["segments"]), [*last["removals"], version], last["pages"] - figures["n"], last["words"] - figures["words"])

    # --- reading

    def _parts(self, kind: str, commits: list[int], what: str, schema: str) -> DataFrame:
        """The tables of some commits, with the commit as ``segment``; no other files are listed."""
        out = self.spark.createDataFrame([], schema + ", segment int")
        for v in commits:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/v={v}/{what}")
            out = out.unionByName(part.withColumn("segment", F.lit(v)))
        return out

    def _tombstones(self, manifest) -> DataFrame:
        out = self.spark.createDataFrame([], "segment int, page long, block long")
        for v in manifest["removals"]:
            out = out.unionByName(self.spark.read.schema("segment int, page long, block long").parquet(f"{self.path}/removed/v={v}/pages"))
        return out

    def _live_pages(self, manifest) -> DataFrame:
        pages = self._parts("segments", manifest["segments"], "pages", _PAGES)
        return pages.join(self._tombstones(manifest).select("segment", "page"), ["segment", "page"], "left_anti")

    def _asked(self, question: str, manifest) -> tuple[DataFrame, dict[str, float]]:
        """The posting blocks of the question's terms, and the weight of each term among the live pages."""
        terms = sorted(set(self.spark.range(1).select(tokens(F.lit(question))).first()[0]))
        places = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(
            F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        blocks = self._parts("segments", manifest["segments"], "postings", _POSTINGS).filter(F.col("bucket").isin(*places) & F.col("term").isin(*terms))
        found = blocks.select("term", "n")
        for v in manifest["removals"]:
            removed = self.spark.read.schema("term string, n long").parquet(f"{self.path}/removed/v={v}/terms")
            found = found.unionByName(removed.filter(F.col("term").isin(*terms)).select("term", (-F.col("n")).alias("n")))
        held = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        return blocks, {t: math.log(1.0 + (manifest["pages"] - df + 0.5) / (df + 0.5)) for t, df in held.items() if df > 0}

    def search(self, pages: DataFrame, question: str, top_k: int = 5) -> DataFrame:
        """As :func:`tabguard.operators.corpus.search_pages` over the live pages, whose texts are fetched from ``pages``."""
        best, _ = self.ranked(question, top_k)
        return _with_texts(pages, best)

    def ranked(self, question: str, top_k: int = 5, probed: int = PROBED) -> tuple[DataFrame, DataFrame]:
        """The best pages ``(filename, page_number, _score)``, and the blocks ``(segment, block, bound)`` that were read for them."""
        manifest = self._manifest()
        blocks, weights = self._asked(question, manifest)
        if not weights:
            empty = self.spark.createDataFrame([], "filename string, page_number int, _score double")
            return empty, self.spark.createDataFrame([], "segment int, block long, bound double")
        blocks = blocks.filter(F.col("term").isin(*weights))
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]
        mean = manifest["words"] / manifest["pages"] or 1.0

        def worth(tf: Column, length: Column) -> Column:
            return weight * tf * F.lit(BM25_K1 + 1) / (tf + F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B / mean) * length))

        bounds = blocks.groupBy("segment", "block").agg(F.sum(worth(F.col("top"), F.col("least"))).alias("bound"))
        bounds = write_and_reread(bounds, "block-bounds")
        gone = self._tombstones(manifest)

        def scored(chosen: DataFrame) -> DataFrame:
            held = blocks.join(chosen.select("segment", "block"), ["segment", "block"], "left_semi")
            each = held.select("segment", "block", "term", F.explode("held").alias("at")).select(
                "segment", F.col("at.page").alias("page"), worth(F.col("at.tf"), F.col("at.length")).alias("part"))
            return each.groupBy("segment", "page").agg(F.sum("part").alias("_score")).join(gone.select("segment", "page"), ["segment", "page"], "left_anti")

        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(probed)
        leaders = scored(first).orderBy(F.desc("_score")).limit(top_k).collect()
        # Scores are compared at nine digits, so bounds and scores that are equal there stay.
        floor = leaders[-1]["_score"] - 2e-9 if len(leaders) == top_k else 0.0
        read = bounds.filter(F.col("bound") >= floor)
        named = self._parts("segments", manifest["segments"], "pages", _PAGES).select("segment", "page", "filename", "page_number")
        best = scored(read).filter(F.col("_score") >= floor).join(named, ["segment", "page"])
        return best.select("filename", "page_number", "_score").orderBy(F.round("_score", 9).desc(), "filename", "page_number").limit(top_k), read
